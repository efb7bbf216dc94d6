"""Every reference query against its SQL on the smallest tables; those without SQL by their own rules."""

import duckdb
import pytest

from fenceline import catalog
from fenceline.operators import detect
from fenceline.plans.analogs import instructions

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted([tuple(repr(fix(r[i])) for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)


def test_suppression_is_greedy(spark):
    groups = {}
    for r in catalog.QUERIES["detections"](spark, SF).distinct().collect():
        groups.setdefault(r["seq"], []).append((-r["confidence"], r["lo"], r["hi"], r["type"]))
    want = []
    for seq, spans in groups.items():
        kept = []
        for worse, lo, hi, kind in sorted(spans):
            if len(kept) < 20 and all(min(hi, b) - max(lo, a) <= 0.5 * max(1, min(hi - lo, b - a)) for _, a, b, _ in kept):
                kept.append((worse, lo, hi, kind))
        want += [(seq, lo, hi, kind) for _, lo, hi, kind in kept]
    got = catalog.QUERIES["nms_filter"](spark, SF).collect()
    assert sorted((r["seq"], r["lo"], r["hi"], r["type"]) for r in got) == sorted(want)
    spans = [(1, 0, 999, "x", 0.5), (1, 900, 1500, "x", 0.4), (1, 100, 700, "x", 0.6), (1, 600, 720, "x", 0.55), (1, 5000, 5000, "x", 0.1), (1, 690, 760, "y", 0.3)]
    kept = detect.suppressed(spark.createDataFrame(spans, "seq long, lo long, hi long, type string, confidence double")).collect()
    assert sorted((r["lo"], r["hi"]) for r in kept) == [(100, 700), (690, 760), (900, 1500), (5000, 5000)]  # spans over many stretches


def test_ensemble_is_ranked_by_three_keys_within_types(spark):
    groups = {}
    for r in catalog.QUERIES["ensemble_fusion"](spark, SF).collect():
        groups.setdefault(r["seq"], set()).add((-r["confidence"], -r["strength"], -r["agreement"], r["lo"], r["hi"], r["type"]))
    want = []
    for seq, spans in groups.items():
        kept = []
        for span in sorted(spans):
            lo, hi, kind = span[3:]
            if all(kind != k or max(0, min(hi, b) - max(lo, a)) <= 0.5 * max(1, min(hi - lo, b - a)) for *_, a, b, k in kept):
                kept.append(span)
        want += [(seq, lo, hi, kind, -c) for c, _, _, lo, hi, kind in kept[:10]]
    got = catalog.QUERIES["ensemble_top"](spark, SF).collect()
    assert sorted((r["seq"], r["lo"], r["hi"], r["type"], r["confidence"]) for r in got) == sorted(want)


def test_lcs_is_brute_force(spark):
    pairs = detect.neighbours(detect.traces(instructions(spark, SF))).collect()
    got = {(r["a"], r["b"]): r["ratio"] for r in catalog.QUERIES["lcs_ratio"](spark, SF).collect()}

    def longest(x, y):
        table = {}
        for i in range(len(x), -1, -1):
            for j in range(len(y), -1, -1):
                table[i, j] = 0 if i == len(x) or j == len(y) else 1 + table[i + 1, j + 1] if x[i] == y[j] else max(table[i + 1, j], table[i, j + 1])
        return table[0, 0]

    assert len(got) == len(pairs) > 0
    for r in pairs:
        assert got[r["a"], r["b"]] == round(longest(r["x"], r["y"]) / max(len(r["x"]), len(r["y"])), 6)
