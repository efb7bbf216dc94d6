"""Operators 11 to 13 against brute force, with edge rows."""

import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fenceline.llm import filter_audit, merkle, neighbours, queries

from ..conftest import SF

# --------------------------------------------------------------------------- operator 11

LONG = " ".join(f"w{i}" for i in range(150))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (None, LONG, "en"), (3, None, None), (4, "", ""), (5, "", "en"), (6, "A" * 50 + " b", "de"), (7, "x " * 30_000, "de"), (8, "x " * 30_000, "fr"),
    (9, LONG + " #", "en"), (9, "other", "en"), (10, "É Ü ß", "de"), (11, "one\ttwo\x0bthree four", "de"), (12, LONG.upper(), None), (None, None, None), (0, LONG, "fr"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, 1), (9, 1, 1), (77, 1, 1), (None, 1, 1), (7, 1, 0)]


def simulated(rows, labels):
    """Every order of the filters applied row by row."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    facts = defaultdict(list)
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > first[text]}
        facts[part or ""].append((fails, i in good, i in toxic))
    out = []
    for part, each in facts.items():
        removed = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = each
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if x[0][f]], [x for x in left if not x[0][f]]
                removed[f] += len(gone)
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in each)
                out.append([part, order, step, len(left), len(gone), sum(x[0][f] for x in each) - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone), f])
        for row in out:
            if row[0] == part:
                row[-1] = removed[row[-1]]
    return sorted(map(tuple, out))


def test_filter_audit_is_the_simulation_of_all_orders(spark):
    docs = spark.createDataFrame([(*r, 5, "x", 1) for r in ROWS], "doc_id long, text string, lang string, fails int, part string, n int").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audited(filter_audit.labelled(filter_audit.failures(docs), labels))
    assert sorted(map(tuple, got.collect())) == simulated(ROWS, LABELS)
    assert filter_audit.audited(filter_audit.labelled(filter_audit.failures(docs.where("false")), labels)).count() == 0
    assert filter_audit.audited(filter_audit.labelled(filter_audit.failures(docs), labels.where("false"))).agg(F.sum("good_lost")).first()[0] == 0


def test_filter_audit_of_other_filters(spark):
    rng = random.Random(5)
    rows = [(rng.choice("pq"), rng.randrange(8), rng.randrange(4), rng.random() < 0.5, False) for _ in range(60)]
    got = filter_audit.audited(spark.createDataFrame(rows, "part string, fails int, n long, good boolean, toxic boolean"), "XYZ").collect()
    for r in got:
        bits = ["XYZ".index(f) for f in r["filter_order"]][: r["step"]]
        own = [x for x in rows if x[0] == r["part"]]
        assert r["kept"] == sum(n for _, fails, n, *_ in own if not any(fails >> b & 1 for b in bits))
        assert r["removed"] == sum(n for _, fails, n, *_ in own if fails >> bits[-1] & 1 and not any(fails >> b & 1 for b in bits[:-1]))
    assert len(got) == 2 * 6 * 3
    by = {(r["part"], r["filter_order"][r["step"] - 1]): r["shapley"] for r in got}
    for (part, f), value in by.items():
        assert value == sum(r["removed"] for r in got if r["part"] == part and r["filter_order"][r["step"] - 1] == f)


# --------------------------------------------------------------------------- operator 12


def digest(text):
    return sha256(text.encode()).hexdigest()


def plain_manifest(rows, fanout):
    """Trees built node by node; ``rows`` are (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    paths, tops, subs, parts = defaultdict(list), [], {}, defaultdict(list)

    def reduced(nodes):
        while len(nodes) > 1:
            runs, nodes = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)], []
            for run in runs:
                for k, (_, below) in enumerate(run):
                    for x in below:
                        paths[x].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :])))
                nodes.append((digest("".join(d for d, _ in run)), [x for _, below in run for x in below]))
        return nodes[0]

    for r in rows:
        parts[r[2]].append(r)
    for p in sorted(parts, key=lambda p: (p is not None, (p or "").encode())):
        parts[p].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tops.append(reduced([(leaf(r), [(p, i)]) for i, r in enumerate(parts[p])]))
        subs[p] = tops[-1][0]
    root = reduced(tops)[0] if tops else None
    for p, own in parts.items():
        for i, r in enumerate(own):
            seen = list(r)
            if None not in (r[0], r[3]) and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                seen[3] += 1
            value = leaf(seen)
            for left, right in paths[p, i]:
                value = digest(left + value + right)
            yield r[0], leaf(r), subs[p], root, digest("".join(a + b for a, b in paths[p, i])), value, value == root


KINDS = "doc_id long, source string, lang string, n_chars long, text string"
ODD = [(None, None, None, None, None)] * 2 + [(3, "s", "zz", 4, "abcd")] * 3 + [(5, "", "", 0, ""), (6, "ü", "é", 1, "é" * 30_000), (14, "s", "only", None, "t"), (4, "-", None, 1, "1:-")]


@pytest.mark.parametrize(("fanout", "depth"), [(2, 10), (2, 2), (3, 1), (4, 2)])
def test_manifest_is_the_plain_tree(spark, fanout, depth):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").union(spark.createDataFrame(ODD, KINDS))
    seen = {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    rows = [tuple(r) for r in docs.collect()]
    got = merkle.manifest(docs.withColumns({"leaf": F.lit(1), "part": F.lit("x"), "pos": F.lit(2)}), seen=seen, fanout=fanout, depth=depth)
    as_text = lambda found: sorted(tuple(map(str, r)) for r in found)
    assert as_text(got.collect()) == as_text(plain_manifest(rows, fanout))


def test_manifest_query_finds_what_was_tampered(spark):
    got = queries.QUERIES["op12_merkle_manifest"](spark, SF).collect()
    docs = {r["doc_id"]: r["n_chars"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"] for r in got if not r["verified"]} == {i for i, n in docs.items() if n is not None and zlib.crc32(str(i).encode()) % 7 == 0}
    assert len({r["root"] for r in got}) == 1 and len(got) == len(docs)


def test_manifest_of_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "s", "en", 1, "x")], KINDS)
    (r,) = merkle.manifest(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == digest("") and r["verified"]
    assert merkle.manifest(one.where("false")).count() == 0


# --------------------------------------------------------------------------- operator 13


def plain_nearest(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    for a, (i, v) in enumerate(ok):
        if i % 50 == 0:
            found = sorted((-round(float(v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w))), 12), j) for b, (j, w) in enumerate(ok) if a != b and len(v) == len(w))[:k]
            yield from ((i, n, j, -s) for n, (s, j) in enumerate(found, 1))


@pytest.mark.parametrize("size", [3, 40])
def test_neighbours_are_brute_force(spark, size):
    rng = np.random.default_rng(size)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(1500, size)).astype("f4"))]
    rows += [(2000 + i, rows[7][1]) for i in range(700)] + [(7, rows[7][1]), (50, rows[7][1]), (100, rows[100][1]), (None, rows[3][1])]  # a vector of a third of all rows, repeated ids and rows
    rows += [(9000, None), (9050, [0.0] * size), (9100, [float("nan")] * size), (9150, [1.0, None]), (9200, []), (9250, [1.0, 2.0]), (9251, [2.0, 1.0]), (9252, [float("inf"), 1.0]), (9300, [4.0, 8.0])]
    rows += [(9400 + i, [2 * x for x in rows[11][1]]) for i in range(3)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, row int, members string").repartition(5)
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0, group_bytes=1 << 16)
    fix = lambda found: sorted((a, b, c, round(d, 9)) for a, b, c, d in found)
    assert fix(got.collect()) == fix(plain_nearest(rows, 5))
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    few = neighbours.nearest(df.where("vec_id in (9250, 9251)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(9250, 1, 9251)]


@pytest.mark.parametrize("size", [5, 64, 3000])
def test_tile_bounds_hold(size):
    rng = np.random.default_rng(size)
    a, b = rng.normal(size=(30, size)) * 10.0 ** rng.integers(-20, 20, (30, 1)), rng.normal(size=(50, size))
    a8, a_scale, a_left = neighbours.quantised(a)
    b8, b_scale, b_left = neighbours.quantised(b)
    whole = neighbours.tile(a8, b8)
    assert (whole == a8.astype(int) @ b8.astype(int).T).all()
    exact = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    off = a_left[:, None] + (1 + a_left[:, None]) * b_left[None]
    assert (np.abs(whole * a_scale[:, None] * b_scale - exact) <= off + 1e-12).all()


def test_neighbour_cells_skip_most_pairs():
    rng = np.random.default_rng(2)
    rows, computed, dots = rng.normal(size=(20_000, 64)), [], neighbours.dots
    neighbours.dots = lambda a, b: computed.append(len(a)) or dots(a, b)
    try:
        found = neighbours.best_of_cell(rows[:50], rows, np.arange(20_000), 6)
    finally:
        neighbours.dots = dots
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    assert [[b for _, b in x] for x in found] == np.argsort(-(unit[:50] @ unit.T), axis=1)[:, :6].tolist()
    assert sum(computed[2:]) < 0.01 * 50 * 20_000
