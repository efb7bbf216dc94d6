"""Pairs of windows and signatures, found and measured block by block, against plain sets; no plan of theirs joins or shuffles pairs."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from fenceline.functions.nodes import SEMANTIC_TYPES
from fenceline.operators import alignment, clusters, library, similarity

from .test_similarity import longest

OPS = [*(f"o{i}" for i in range(90)), "ldr", "str", "b", "cmp", "mov", "nop"]
SMALL = {"BLOCK": 4, "CELLS": 40, "POSTINGS": 60, "ROWS": 3}


def lists():
    """Windows by (seq, lo): parts of one text with some entries changed, copies, short ones and one of a single opcode."""
    rng = random.Random(8)
    text = [rng.choice(OPS) for _ in range(300)]
    out = {}
    for seq in range(60):
        at = rng.randrange(200)
        own = [x if rng.random() < 0.8 else rng.choice(OPS) for x in text[at : at + rng.choice((2, 12, 45, 45))]]
        out |= {(seq, lo): own[lo : lo + 30] for lo in (0, 15) if len(own) > lo}
    out |= {(100 + i, 0): out[20, 0] for i in range(12)} | {(200, 0): ["nop"] * 30, (210, 0): ["nop"] * 31, (220, 0): ["a", "b"], (230, 0): ["new"] * 3 + ["nop"] * 3}
    return out


@pytest.fixture(scope="module")
def windows(spark):
    rows = [(seq, lo, i, op) for (seq, lo), ops in lists().items() for i, op in enumerate(ops)]
    rows += [(None, 0, i, "nop") for i in range(5)]
    return similarity.shapes(spark.createDataFrame(rows, "seq long, lo long, i int, line string").repartition(4)).persist()


def pairs(windows):
    grams = lambda ops, n: {tuple(ops[i : i + n]) for i in range(len(ops) - n + 1)}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    shapes = {(r["seq"], r["lo"]): r for r in windows.where("seq IS NOT NULL").collect()}
    for k, r in shapes.items():
        for s, o in shapes.items():
            if s[1] == 0 and s[0] % 10 == 0 and s != k and grams(r["ops"], 3) & grams(o["ops"], 3):
                j = {n: jaccard(grams(r["ops"], n), grams(o["ops"], n)) for n in (1, 2, 3, 4, 5)}
                kinds = jaccard(set(r["kinds"]), set(o["kinds"]))
                graph = (kinds + jaccard(set(r["edges"]), set(o["edges"]))) / 2
                yield (*k, s[0]), r["ops"], o["ops"], {f"j{n}": j[n] for n in (2, 3, 4, 5)} | {"ngram": sum(n * j[n] for n in (2, 3, 4, 5)) / 14, "graph": graph, "semantic": kinds, "opcodes": j[1]}


def nothing_joined(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Join" not in plan and "ops" not in plan.split("MapInArrow")[0]


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_measures_of_all_pairs_without_a_join(windows, monkeypatch, sizes):
    for name, size in sizes.items():
        monkeypatch.setattr(library, name, size)
    found = similarity.measured(windows)
    assert nothing_joined(found)
    rows = found.collect()
    got, want = {(r["seq"], r["lo"], r["s_seq"]): r for r in rows}, {k: m for k, _, _, m in pairs(windows)}
    assert len(rows) == len(got) > 100 and got.keys() == want.keys()
    assert all(abs(got[k][c] - x) < 1e-12 for k, m in want.items() for c, x in m.items())
    graph = similarity.measured(windows, "graph")
    assert "j2" not in graph.columns and sorted(r["graph"] for r in graph.collect()) == sorted(r["graph"] for r in rows)


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_alignment_and_equal_places_without_a_join(windows, monkeypatch, sizes):
    for name, size in sizes.items():
        monkeypatch.setattr(library, name, size)
    want = {k: (a, b) for k, a, b, _ in pairs(windows)}
    found = similarity.aligned(windows)
    assert nothing_joined(found)
    got = {(r["seq"], r["lo"], r["s_seq"]): (r["alignment"], r["lcs"]) for r in found.collect()}
    assert got == {k: (SequenceMatcher(None, a, b).ratio(), longest(a, b) / max(len(a), len(b))) for k, (a, b) in want.items()}
    kind = {op: k for r in windows.collect() for op, k in ((op, next((t for t, ops in SEMANTIC_TYPES if op in ops), "COMPUTE")) for op in r["ops"])}
    found = similarity.fuzzy(windows)
    assert nothing_joined(found)
    score = lambda a, b: round(sum(0.7 * (x == y) + 0.3 * (kind[x] == kind[y]) for x, y in zip(a, b, strict=True)) / len(a), 6)
    got = {(r["seq"], r["lo"], r["s_seq"]): r["score"] for r in found.collect()}
    assert got.keys() == {k for k, (a, b) in want.items() if len(a) == len(b)} and all(abs(x - score(*want[k])) < 2e-6 for k, x in got.items())


def test_best_of_the_library_by_window(windows):
    want = {}
    for (seq, lo, s), _, _, m in pairs(windows):
        if seq % 2 == s % 2:
            want[seq, lo] = max(want.get((seq, lo), 0), m["opcodes"])
    assert {(r["seq"], r["lo"]): r["bonus"] for r in similarity.bonuses(similarity.measured(windows, "opcodes")).collect()} == {k: round(x * 0.2, 6) for k, x in want.items()}


def test_blocks_and_subsequences_by_words_equal_those_by_matrices():
    rng = np.random.default_rng(2)
    for kinds, n, m in ((1, 5, 64), (2, 40, 40), (6, 70, 64), (45, 30, 30)):
        x, y = rng.integers(0, kinds, (200, n)), rng.integers(0, kinds, (200, m))
        nx, ny = rng.integers(0, n + 1, 200), rng.integers(0, m + 1, 200)
        x[np.arange(n) >= nx[:, None]], y[np.arange(m) >= ny[:, None]] = -1, -2
        rows = alignment.masks(x, y)
        assert (alignment.mask_blocks(rows, nx, ny) == alignment.block_sizes(x, y, nx, ny)).all() and (alignment.mask_lcs(rows) == alignment.lcs_lengths(x, y)).all()
        ratio, common = alignment.measured_codes(x, y, nx, ny)
        for k in range(200):
            a, b = x[k, : nx[k]].tolist(), y[k, : ny[k]].tolist()
            assert ratio[k] == SequenceMatcher(None, a, b).ratio() and common[k] == longest(a, b) / max(len(a), len(b), 1)


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_close_signatures_meet_the_library_only(windows, monkeypatch, sizes):
    for name, size in sizes.items():
        monkeypatch.setattr(library, name, size)
    monkeypatch.setattr(clusters, "candidates", None)  # all pairs of windows
    rows = windows.unionByName(windows.where("seq = 20 AND lo = 0").selectExpr("CAST(NULL AS long) AS seq", "30L AS lo", *windows.columns[2:])).persist()
    for least in (0.3, 0.5, 0.9):
        want = {(r["seq"], r["lo"], r["s_seq"]): r["cosine"] for r in similarity.dots(rows).where(F.col("cosine") >= least).collect()}
        found = similarity.close(rows, least)
        got = found.collect()
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        assert len(got) == len(want) > 12 and {(r["seq"], r["lo"], r["s_seq"]): r["cosine"] for r in got} == want
        assert (None, 30, 20) in want and (20, 0, 20) not in want
    assert similarity.close(rows.where("false")).count() == 0 == similarity.close(rows.where("seq = 21")).count()
