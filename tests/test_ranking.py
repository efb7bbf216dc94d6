"""The ranking of all pairs of windows and signatures against a plain version, with copies, and with few pairs measured."""

import math
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest

from fenceline.operators import alignment, bounds, similarity

from .test_similarity import longest

OPS = [f"o{i}" for i in range(40)] + ["ldr", "str", "b", "cmp"]


def lists(copies):
    """Windows by (seq, lo): random ones, listings whose second window overlaps the first, ``copies`` of one, and near copies."""
    rng = random.Random(4)
    out = {}
    for seq in range(100):
        own = [rng.choice(OPS) for _ in range(rng.choice((12, 20, 45, 45)))]
        out |= {(seq, lo): own[lo : lo + 30] for lo in (0, 15) if len(own) - lo >= 12}
    out |= {(1000 + i, 0): out[20, 0] for i in range(copies)}  # every tenth is a signature
    out |= {(2000 + i, 15): out[30, 0][:i] + ["nop"] + out[30, 0][i + 1 :] for i in range(8)}
    return out | {(3000, 0): ["nop"], (3001, 0): ["nop"], (3011, 0): ["zz"] * 230, (3020, 0): ["zz"] * 229 + ["nop"]}


def plain(shapes):
    """(-score, seq, lo, s_seq) of all pairs."""
    grams = lambda ops, n: {tuple(ops[i : i + n]) for i in range(len(ops) - n + 1)}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    bags = {k: Counter(g for n in (1, 2, 3) for g in (tuple(r["ops"][i : i + n]) for i in range(len(r["ops"]) - n + 1))) for k, r in shapes.items()}
    df, unit, out = Counter(t for b in bags.values() for t in b), {}, []
    for k, b in bags.items():
        v = {t: c * (math.log((1 + len(bags)) / (1 + df[t])) + 1) for t, c in b.items()}
        unit[k] = {t: x / math.sqrt(sum(x * x for x in v.values())) for t, x in v.items()}
    for k, r in shapes.items():
        for s, o in ((s[0], o) for s, o in shapes.items() if s[1] == 0 and s[0] % 10 == 0 and s != k):
            a, b = r["ops"], o["ops"]
            ngram = sum(n * jaccard(grams(a, n), grams(b, n)) for n in (2, 3, 4, 5)) / 14
            graph = (jaccard(set(r["kinds"]), set(o["kinds"])) + jaccard(set(r["edges"]), set(o["edges"]))) / 2
            cosine = round(sum(x * unit[s, 0].get(t, 0) for t, x in unit[k].items()), 5)
            score = 0.3 * ngram + 0.25 * SequenceMatcher(None, a, b).ratio() + 0.2 * longest(a, b) / max(len(a), len(b)) + 0.15 * graph + 0.1 * cosine
            out.append((-round(score, 6), *k, s))
    return sorted(out)


def best(shapes, k):
    return [w for w in plain(shapes) if w[0] < -0.3][:k]


def frame(spark, own):
    rows = [(seq, lo, i, op) for (seq, lo), ops in own.items() for i, op in enumerate(ops)]
    return similarity.shapes(spark.createDataFrame(rows, "seq long, lo long, i int, line string").repartition(4)).persist()


@pytest.mark.parametrize(("copies", "k"), [(0, 15), (35, 100)])
def test_ranked_has_the_best_rows_and_measures_few_pairs(spark, monkeypatch, copies, k):
    windows = frame(spark, lists(copies))
    shapes = {(r["seq"], r["lo"]): r for r in windows.collect()}
    want = best(shapes, k)
    measured, real = [], alignment.aligned
    monkeypatch.setattr(alignment, "aligned", lambda pairs, *more: measured.append(pairs.count()) or real(pairs, *more))
    monkeypatch.setattr(similarity, "FIRST", 2, raising=False)
    got = [(-r["score"], r["seq"], r["lo"], r["s_seq"]) for r in similarity.ranked(windows, k).collect()]
    assert [g[1:] for g in got] == [w[1:] for w in want] and len(got) > 10
    assert all(abs(g[0] - w[0]) < 2e-6 for g, w in zip(got, want, strict=True))
    if k == 15:
        assert sum(measured) < len(shapes) * sum(lo == 0 and seq % 10 == 0 for seq, lo in shapes) / 10


def test_score_vectors_bound_every_score_and_the_grid_loses_no_pair(spark, monkeypatch):
    windows = frame(spark, lists(0))
    want = plain({(r["seq"], r["lo"]): r for r in windows.collect()})
    found = windows.selectExpr("seq * 100 + lo AS n", "ops", "1L AS times", "CAST(lo = 0 AND seq % 10 = 0 AS LONG) AS sigs")
    counts = found.select("n", "times", similarity.F.explode(similarity.terms()).alias("term")).groupBy("n", "times", "term").agg(similarity.F.count("*").alias("tf"))
    vectors = similarity.score_vectors(similarity.shaped(found, "n", "times", "sigs"), similarity.clusters.unit_vectors(counts, "n", "times")).persist()
    own = {}
    for r in vectors.collect():
        own[r["n"]] = Counter()
        for t, w in zip(r["terms"], r["ws"], strict=True):
            own[r["n"]][t] += w
        assert abs(sum(w * w for w in own[r["n"]].values()) - 1) < 1e-4 or len(r["terms"]) < 20
    product = lambda a, b: sum(w * own[b].get(t, 0) for t, w in own[a].items())
    products = {(seq * 100 + lo, s * 100): product(seq * 100 + lo, s * 100) for _, seq, lo, s in want}
    assert all(products[seq * 100 + lo, s * 100] >= -score - 1e-4 for score, seq, lo, s in want)
    near = {p for p, x in products.items() if x >= 0.35}
    for sizes in ((1 << 15, 1 << 15, 256, 1 << 22), (50, 7, 3, 40)):
        for name, size in zip(("ROWS", "KNOWN", "DENSE", "CELLS"), sizes, strict=True):
            monkeypatch.setattr(bounds, name, size)
        got = [tuple(r) for r in bounds.candidates(vectors, 0.35, len(own), sum(n % 1000 == 0 for n in own)).collect()]
        assert len(got) == len(set(got)) and near <= set(got) and all(a == b or products[a, b] >= 0.3498 for a, b in got)


def test_ranked_of_no_windows_is_empty(spark):
    assert similarity.ranked(frame(spark, lists(0)).where("false")).count() == 0
