"""Patterns over a window's text: the linear forms find what the stated ones find, and in time that does not grow by powers."""

import random
import time

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from fenceline.functions import fixed
from fenceline.operators import detect, features, selection, subgraphs

WORDS = "eor xor ldrb movb movzbl lsl shl sal ldr mov clflush dc civac mfence dsb [ ] ], , str cmp test $4 #1 jae jbe ja b.hs b.ls and bic isb lea adrp rdtsc mrs cntvct lfence call callq bl ret retq sp foo x0".split()


def test_text_patterns_find_the_same(spark):
    rng = random.Random(5)
    texts = []
    for name in features._CHAINS:
        own = [w for w in WORDS if w in fixed.TEXT_PATTERNS[name] or w in "[],$4#1"]
        for _ in range(600):
            pool = rng.sample(WORDS, 3) + own * 2
            texts.append("".join(rng.choice(pool) + rng.choice(("", "\n", " ", "\n", " ", "\n\n", "  \n")) for _ in range(rng.randint(1, 26))))
    names = sorted(fixed.TEXT_PATTERNS)
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", *(F.col("text").rlike(features.text_pattern(n)).alias(n) for n in names)).collect()
    con = duckdb.connect()
    con.register("rows", pa.table({"text": [r["text"] for r in got]}))
    for name in names:
        want = [r[0] for r in con.execute(f"SELECT regexp_matches(text, '{fixed.TEXT_PATTERNS[name]}') FROM rows").fetchall()]
        assert [r[name] for r in got] == want, name
        assert name not in features._CHAINS or 5 < sum(want) < len(want)


def test_text_patterns_take_linear_time(spark):
    text = "mov [sp]\nmov x, [ sp ]\n" * 400  # no return: every dot of the stated pattern would be tried at every place
    began = time.time()
    found = spark.createDataFrame([(text,)], "text string").select(*(F.col("text").rlike(features.text_pattern(n)).alias(n) for n in features._CHAINS)).first()
    assert time.time() - began < 20 and not found["return_control"] and found["terminal_fault"]


def test_signatures_meet_each_list_once(spark):
    rows = spark.createDataFrame([(1, "x", "a b c d a b c".split()), (1, "x", "b c d e".split()), (2, "x", ["a", "b"]), (3, "x", None), (None, "x", "a b c".split()), (4, "x", "q r s".split())], "id int, label string, words array<string>")
    known = spark.createDataFrame([(7, "b", "a b c d".split()), (8, "b", "c d e a b c".split()), (9, "b", ["a"])], "id int, label string, words array<string>")
    found = detect.signature_matches(rows, known)
    one, seven, eight = {"abc", "bcd", "cda", "dab", "cde"}, {"abc", "bcd"}, {"cde", "dea", "eab", "abc"}
    assert sorted(map(tuple, found.collect())) == [(1, i, round(len(one & s) / len(one | s), 6)) for i, s in ((7, seven), (8, eight))]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [id#") == 2  # of lists and of pairs, none of a row a gram


def test_windows_come_in_slices():
    edges = [{"src": a, "dst": b} for a in range(8) for b in (a + 1, a + 2)]
    batch = pa.record_batch([pa.array([str(i) for i in range(1000)]), pa.array([edges] * 999 + [[]])], ["seq", "e"])
    out = list(subgraphs._sliced(subgraphs._paths, ["start", "node", "dist"])([batch, batch.slice(0, 0)]))
    each = list(subgraphs._paths([(e["src"], e["dst"]) for e in edges]))
    assert each and all(len(set(b.column("seq").to_pylist())) <= subgraphs.SLICE for b in out)
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(str(i), *p) for i in range(999) for p in each]


def test_flags_of_a_line_are_one_number(spark):
    rows = spark.createDataFrame([(1, p, "ldr x0, [x1]") for p in range(60)], "seq long, pos long, line string")
    plan = selection.discriminative(rows)._jdf.queryExecution().optimizedPlan().toString()
    frames = [line for line in plan.split("\n") if "currentrow$()" in line]
    assert len(frames) == 3 and all(line.count("windowspecdefinition") == 1 for line in frames)


def test_graph_edges_read_node_columns_made_once(spark):
    from fenceline.operators import listings
    from fenceline.plans.assembly_analog import code_windows

    plan = listings.graph_edges(listings.graph_nodes(code_windows(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "RLIKE" not in plan  # not the lines' patterns again in each kind of edge
