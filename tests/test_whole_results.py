"""Rows that a limit of a plan once lost: long spans, edges over a stretch, long prefixes, late nodes; and values by place."""

from pyspark.sql import functions as F

from fenceline.functions import fixed
from fenceline.operators import detect, fusion, listings
from fenceline.sources import sinks


def test_spans_of_any_length_meet_their_rows(spark):
    ops = "abcdefg"
    rows = [(1, p, ops[p % 7] if p % 11 else None) for p in range(400) if p % 13] + [(2, 5, "z")]
    spans = [(1, 0, 10), (1, 0, 100), (1, 0, 399), (1, 63, 64), (1, 64, 127), (1, 65, 126), (1, 13, 13), (1, 128, 320), (1, 7, 3), (2, 0, 1000), (3, 0, 5), (1, 0, 10)]
    got = fusion.span_lines(spark.createDataFrame(spans, "seq int, lo int, hi int"), spark.createDataFrame(rows, "seq int, pos int, op string")).collect()
    want = set()
    for s, lo, hi in spans:
        held = [op for q, p, op in rows if q == s and lo <= p <= hi]
        if held:
            want.add((s, lo, hi, len(held), len(set(held) - {None})))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_graph_records_keep_every_edge(spark):
    nodes = spark.createDataFrame([(1, p, "op") for p in range(10)], "seq int, pos int, op string")
    edges = [(1, a, b, 0) for a in range(10) for b in range(a + 1, 10)]
    got = sinks.graph_records(nodes, spark.createDataFrame(edges, "seq int, src int, dst int, type int"), 4).collect()
    assert sorted((e["src"], e["dst"]) for r in got for e in r["edges"] or []) == sorted((a, b) for _, a, b, _ in edges)


def test_prefixes_of_any_length(spark):
    lists = {1: "a" * 90, 2: "a" * 80 + "b" * 30, 3: "a" * 80 + "b" * 30, 4: "x", 6: "x", 7: "xyz"}
    rows = spark.createDataFrame([(s, p, op) for s, ops in lists.items() for p, op in enumerate(ops)], "seq int, pos int, op string")
    assert sorted(tuple(r) for r in detect.prefix_lengths(rows).collect()) == [(1, 2, 80), (2, 3, 110), (3, 4, 0), (6, 7, 1)]


def test_coordinate_lists_are_cut_at_their_limits_only(spark):
    edges = spark.createDataFrame([("w", i, i + 1, 1, 1.0, None) for i in range(70)], "seq string, src int, dst int, type int, weight double, reg string")
    assert (listings.NODE_LIMIT, listings.EDGE_LIMIT) == (64, 512)
    assert listings.coo(edges).count() == 63
    assert sorted(r["dst"] for r in listings.coo(edges, 10, 5).collect()) == [1, 2, 3, 4, 5]


def test_places_of_categories():
    places = dict(LOAD=0, STORE=1, BRANCH_COND=2, COMPARE=8, SHIFT=11, FENCE=12, CACHE=13, TIMING=14, MOVE=15, STACK=16, NOP=17, OTHER=18)
    assert {k: fixed.OPCODE_CATEGORIES.index(k) for k in places} == places and len(fixed.OPCODE_CATEGORIES) == 19
