"""Components, longest paths, triangles and the isolation forest against plain walks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fenceline import catalog
from fenceline.operators import measures, robust
from fenceline.plans.assembly_analog import code_windows
from fenceline.plans.steps import settled

from .conftest import SF


def reach(n, edges):
    out = {i: set() for i in range(n)}
    for a, b in edges:
        out[a].add(b)
    found = {}
    for i in range(n):
        seen, stack = set(), [i]
        while stack:
            for b in out[stack.pop()]:
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        found[i] = seen
    return found


@pytest.mark.parametrize("stretch", [3, 4096])
def test_components_are_mutual_reach(spark, stretch):
    rng = random.Random(stretch)
    nodes, edges, want = [], [], {}
    for seq in range(25):
        places = sorted(rng.sample(range(60), rng.randint(1, 25)))
        own = [(i, i + 1) for i in range(len(places) - 1)] + [(rng.randrange(len(places)), rng.randrange(len(places))) for _ in range(rng.randint(0, 5))]
        far = reach(len(places), own)
        nodes += [(seq, p) for p in places]
        edges += [(seq, places[a], places[b]) for a, b in own + own[-1:]]
        for i, p in enumerate(places):
            want[seq, p] = places[min([i, *(j for j in far[i] if i in far[j])])]
    got = measures.control_components(spark.createDataFrame(nodes, "seq int, pos int"), spark.createDataFrame(edges, "seq int, src int, dst int"), stretch).collect()
    assert {(r["seq"], r["pos"]): r["component"] for r in got} == want and len(got) == len(want)


def test_complexity_of_loops_and_lone_lines(spark):
    nodes = spark.createDataFrame([(s, p) for s, n in ((1, 5), (2, 5), (3, 1), (4, 3)) for p in range(n)], "seq int, pos int")
    path = [(s, p, p + 1) for s, n in ((1, 5), (2, 5), (4, 3)) for p in range(n - 1)]
    edges = spark.createDataFrame([*path, (1, 0, 3), (1, 0, 3), (2, 3, 1), (4, 1, 1), (4, None, 1)], "seq int, src int, dst int")
    got = {r["seq"]: tuple(r)[1:] for r in measures.complexity(nodes, edges).collect()}
    assert got == {1: (5, 5, 2, 0.2, 5, 4, 4), 2: (5, 5, 2, 0.2, 3, 0, 2), 3: (1, 0, 1, 0.0, 1, 0, 0), 4: (3, 3, 2, round(1 / 3, 6), 3, 0, 2)}
    assert measures.complexity(nodes.where("false"), edges.where("false")).count() == 0


def test_a_long_listing_goes_through_stretches(spark):
    n = 300_000
    nodes = spark.range(n).select(F.lit(1).alias("seq"), F.col("id").alias("pos"))
    edges = nodes.where(f"pos < {n - 1}").select("seq", F.col("pos").alias("src"), (F.col("pos") + 1).alias("dst"))
    edges = edges.union(nodes.where("pos % 1000 = 999").select("seq", F.col("pos").alias("src"), (F.col("pos") - 99).alias("dst")))
    row = measures.complexity(nodes, edges).first()
    assert (row["nodes"], row["edges"], row["components"], row["max_path_length"], row["condensed_path"]) == (n, n - 1 + 300, n - 300 * 99, 0, n - 300 * 99 - 1)


def test_clustering_is_brute_force(spark):
    rng = random.Random(3)
    edges = [(g, rng.randrange(12), rng.randrange(12)) for g in range(6) for _ in range(30)] + [(7, 0, k) for k in range(1, 200)] + [(7, 1, 2), (7, 2, 1), (8, None, 1), (9, 4, 4)]
    near = {}
    for g, a, b in edges:
        if a is not None and a != b:
            near.setdefault((g, a), set()).add(b)
            near.setdefault((g, b), set()).add(a)
    want = {}
    for (g, a), own in near.items():
        closed = sum(y in near[g, x] for x in own for y in own if x < y)
        want[g, a] = (len(own), closed, 2 * closed / (len(own) * (len(own) - 1)) if len(own) > 1 else 0.0)
    df = spark.createDataFrame(edges, "seq int, src int, dst int")
    got = {(r["seq"], r["node"]): (r["degree"], r["triangles"], r["coefficient"]) for r in measures.clustering(df).collect()}
    assert got == want
    nodes = spark.createDataFrame([(7, k) for k in range(200)] + [(5000, 1)], "seq int, pos int")
    mean = {r["seq"]: r["avg_clustering"] for r in measures.average_clustering(nodes, df).collect()}
    assert mean[7] == pytest.approx(sum(v[2] for (g, _), v in want.items() if g == 7) / 200) and mean[5000] == 0.0


def plain_length(forest, root, x):
    """One row in one tree, node by node."""
    node, depth = int(root), 0
    while forest.table[node, 1] >= 0:
        node = int(forest.table[node, 3] if x[int(forest.table[node, 1])] <= forest.table[node, 2] else forest.table[node, 4])
        depth += 1
    n = forest.table[node, 5]
    return depth + (0 if n < 2 else 1 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n)


def test_forest_paths_are_plain_walks_and_outliers_are_low():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 64))
    x[:, 22:] = 0
    x[:5, :22] += 8
    forest = robust.grown(x, trees=30)
    lengths = forest.lengths(x[:50])
    assert np.allclose(lengths, [[plain_length(forest, r, v) for r in forest.roots] for v in x[:50]])
    assert np.allclose(forest.scores(x[:50]), [2 ** -(np.mean([plain_length(forest, r, v) for r in forest.roots]) / float(robust.mean_depth(256))) for v in x[:50]])
    assert (forest.decisions(x[:5]) < np.median(forest.decisions(x))).all() and abs((forest.decisions(x) < 0).mean() - 0.1) < 0.01
    for t, root in enumerate(forest.roots):
        own = forest.table[forest.table[:, 0] == t]
        assert own[own[:, 1] < 0][:, 5].sum() == 256 and own[:, 6].max() <= 8 and forest.table[root, 6] == 0
    assert np.allclose(robust.grown(np.ones((9, 64))).scores(np.ones((2, 64))), 0.5) and len(robust.grown(np.empty((0, 64))).roots) == 0


def test_the_best_of_all_scores_wins(spark):
    rows = [(1, 0, "K1", 0.5), (1, 0, "ml_K2", 0.5), (1, 0, "anomaly", 0.5), (2, 0, "K1", 0.2), (2, 0, "anomaly", 0.6), (3, 0, "ml_K0", 0.9), (3, 0, "K1", 0.8), (4, 0, "K1", 0.3), (5, 0, "K2", 0.7), (5, 0, "K1", 0.7), (6, 0, "K1", None)]
    got = robust.best(spark.createDataFrame(rows, "seq int, lo int, name string, score double")).collect()
    assert {r["seq"]: (r["winner"], r["score"]) for r in got} == {1: ("K1", 0.5), 2: ("anomaly", 0.6), 3: ("ml_K0", 0.9), 5: ("K1", 0.7)}


def test_robust_detector(spark):
    found = settled(robust.signatures(code_windows(spark, SF)))
    library = robust.known(found)
    known, said = library.collect(), {(r["seq"], r["lo"]): r for r in found.collect()}
    from difflib import SequenceMatcher

    sets = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0
    close = lambda a, b: 1.0 if a == b == 0 else 0.0 if 0 in (a, b) else 1 - abs(a - b) / max(a, b)
    want = {}
    for k, r in said.items():
        for s in known:
            if s["arch"] == r["arch"] and k != (s["seq"], s["lo"]):
                statistics = sum(close(r[c], s[c]) for c in robust.STATISTICS) / 7
                score = 0.3 * SequenceMatcher(None, r["ops"], s["ops"]).ratio() + 0.2 * sets(r["branches"], s["branches"]) + 0.2 * sets(r["memory"], s["memory"]) + 0.3 * statistics
                want[*k, s["kind"]] = max(score, want.get((*k, s["kind"]), 0))
    got = {(r["seq"], r["lo"], r["name"]): r["score"] for r in robust.signature_scores(found, library).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())
    ml = robust.classifier_scores(found, library).groupBy("seq", "lo").agg(F.sum("score").alias("s"), F.count("*").alias("n")).collect()
    assert len(ml) == len(said) and all(r["s"] == pytest.approx(1) and r["n"] == len({s["kind"] for s in known}) for r in ml)
    rows = catalog.QUERIES["robust_detector"](spark, SF).collect()
    odd = {(r["seq"], r["lo"]): r["score"] for r in catalog.QUERIES["robust_anomaly"](spark, SF).collect()}
    assert len(odd) == len(said) and all(0 <= v <= 1 for v in odd.values())
    for r in rows:
        scores = [v for (a, b, _), v in want.items() if (a, b) == (r["seq"], r["lo"])]
        assert r["score"] > 0.3 and r["score"] >= round(max(scores, default=0), 6) - 1e-6 and r["score"] >= odd[r["seq"], r["lo"]] - 1e-6


def test_signatures_of_edge_windows(spark):
    lines = [(2, 0, 0, "cmp x0, x1"), (2, 0, 1, None), (2, 0, 2, "b.hs .L1"), (4, 0, 0, "ret"), (4, 0, 1, "ret")] + [(6, 0, i, "nop") for i in range(3)]
    found = {r["seq"]: r for r in robust.signatures(spark.createDataFrame(lines, "seq int, lo int, i int, line string")).collect()}
    assert set(found) == {2, 6}  # two lines are too few
    assert found[2]["branches"] == ["b.hs_COND"] and found[6]["branches"] == [] and found[6]["most_common_opcode_freq"] == 1.0
    assert (found[6]["num_edges"], found[2]["num_edges"]) == (2, 2) and found[6]["avg_clustering"] == 0.0
