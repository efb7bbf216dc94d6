"""Alignment, the exact cosine join and greedy clusters against plain versions and the standard library."""

import math
import random
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import functions as F

from fenceline import catalog
from fenceline.operators import alignment, clusters, similarity
from fenceline.plans.assembly_analog import code_windows

from .conftest import SF


def longest(x, y):
    row = [0] * (len(y) + 1)
    for u in x:
        last = 0
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if u == v else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_equals_the_standard_library():
    rng = random.Random(1)
    x, y = [], []
    for _ in range(600):
        kinds = rng.randint(1, 8)
        x.append([f"o{rng.randrange(kinds)}" for _ in range(rng.choice((0, 1, 2, 7, 30, 64, 65, 130)))])
        y.append([f"o{rng.randrange(kinds)}" for _ in range(rng.choice((0, 1, 2, 7, 30, 64, 65, 199, 200, 260)))])
    x += [["a"] * 300, list("abcd") * 60, []]
    y += [["a"] * 300, list("dcba") * 60, []]
    ratio, lcs = alignment.measured(pa.array(x, pa.list_(pa.string())), pa.array(y, pa.list_(pa.string())))
    for k, (a, b) in enumerate(zip(x, y, strict=True)):
        assert ratio[k] == SequenceMatcher(None, a, b).ratio(), (a, b)
        assert lcs[k] == longest(a, b) / max(len(a), len(b), 1)


def test_alignment_of_edge_rows(spark):
    rows = [(1, None, None, "p", 0.5), (2, [], ["a"], None, 0.5), (3, [None, "a"], [None, "a"], "q", None), (4, ["x"] * 500, ["x"] * 500, "r", 1.0), (4, ["x"] * 500, ["x"] * 500, "r", 1.0)]
    df = spark.createDataFrame(rows, "id int, x array<string>, y array<string>, extra string, lcs double")
    got = {r["id"]: (r["alignment"], r["lcs"], r["extra"]) for r in alignment.aligned(df).collect()}
    assert got == {1: (1.0, 0.0, "p"), 2: (0.0, 0.0, None), 3: (1.0, 1.0, "q"), 4: (SequenceMatcher(None, "x" * 500, "x" * 500).ratio(), 1.0, "r")}
    assert alignment.aligned(df).count() == 5 and alignment.aligned(df.where("false")).count() == 0


def test_ranked_is_the_five_weights_over_all_pairs(spark):
    shapes = {(r["seq"], r["lo"]): r for r in similarity.shapes(code_windows(spark, SF)).collect()}
    library = {r["s_seq"] for r in similarity.signatures(similarity.shapes(code_windows(spark, SF))).collect()}
    assert len(library) <= similarity.LIBRARY
    grams = lambda ops, n: {tuple(ops[i : i + n]) for i in range(len(ops) - n + 1)}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    bags = {k: Counter(g for n in (1, 2, 3) for g in (tuple(r["ops"][i : i + n]) for i in range(len(r["ops"]) - n + 1))) for k, r in shapes.items()}
    df = Counter(t for b in bags.values() for t in b)
    unit = {}
    for k, b in bags.items():
        v = {t: c * (math.log((1 + len(bags)) / (1 + df[t])) + 1) for t, c in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        unit[k] = {t: x / norm for t, x in v.items()}
    want = []
    for k, r in shapes.items():
        for s in library:
            if k == (s, 0):
                continue
            o = shapes[s, 0]
            a, b = r["ops"], o["ops"]
            ngram = sum(n * jaccard(grams(a, n), grams(b, n)) for n in (2, 3, 4, 5)) / 14
            graph = (jaccard(set(r["kinds"]), set(o["kinds"])) + jaccard(set(r["edges"]), set(o["edges"]))) / 2
            cosine = round(sum(x * unit[s, 0].get(t, 0) for t, x in unit[k].items()), 5)
            score = 0.3 * ngram + 0.25 * SequenceMatcher(None, a, b).ratio() + 0.2 * longest(a, b) / max(len(a), len(b)) + 0.15 * graph + 0.1 * cosine
            want.append((-round(score, 6), *k, s))
    got = [(-r["score"], r["seq"], r["lo"], r["s_seq"]) for r in catalog.QUERIES["candidate_rank"](spark, SF).collect()]
    best = sorted(w for w in want if -w[0] > 0.3)[:100]
    assert len(got) == len(best) > 0 and all(abs(g[0] - w[0]) < 2e-6 for g, w in zip(sorted(got), best, strict=True))
    pairs = {(r["seq"], r["lo"], r["s_seq"]): (r["alignment"], r["lcs"]) for r in catalog.QUERIES["alignment_pairs"](spark, SF).collect()}
    for (seq, lo, s), (ratio, lcs) in pairs.items():
        a, b = shapes[seq, lo]["ops"], shapes[s, 0]["ops"]
        assert (ratio, lcs) == (round(SequenceMatcher(None, a, b).ratio(), 6), round(longest(a, b) / max(len(a), len(b)), 6))
    assert set(pairs) == {(*k, s) for k, r in shapes.items() for s in library if k != (s, 0) and grams(r["ops"], 3) & grams(shapes[s, 0]["ops"], 3)}


def plain_vectors(lists):
    bags = {i: Counter(t) for i, t in lists.items() if t}
    df = Counter(t for b in bags.values() for t in b)
    out = {}
    for i, b in bags.items():
        v = {t: c * (math.log((1 + len(bags)) / (1 + df[t])) + 1) for t, c in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out[i] = {t: x / norm for t, x in v.items()}
    return out


def plain_clusters(lists, least):
    """The sequential rule."""
    unit, processed, out = plain_vectors(lists), set(), set()
    keys = sorted(unit)
    for k, i in enumerate(keys):
        if i in processed:
            continue
        out.add((i, i))
        for j in keys[k + 1 :]:
            if round(sum(x * unit[j].get(t, 0) for t, x in unit[i].items()), 5) >= least:
                out.add((i, j))
                processed.add(j)
    return out


def lists_with_a_common_term(n, seed=3):
    rng = random.Random(seed)
    lists = {}
    for i in range(n):
        own = ["mov"] * 3 + [f"t{rng.randrange(3 * n)}" for _ in range(6)]
        if i and rng.random() < 0.3:
            own = list(lists[rng.randrange(i)] or own)
            own[rng.randrange(len(own))] = f"t{rng.randrange(3 * n)}"
        lists[i] = own
    return lists


def test_clusters_follow_the_sequential_rule(spark):
    lists = lists_with_a_common_term(150)
    lists |= {200 + i: lists[3] for i in range(80)} | {300: [], 301: None, 302: ["mov"], 303: ["mov", "mov"], 304: [None, "a"], 305: ["a", ""]}  # a third are copies
    df = spark.createDataFrame(list(lists.items()), "id int, terms array<string>").repartition(4)
    plain = {i: [x or "" for x in t] if t else t for i, t in lists.items()}
    for least in (0.5, 0.7, 0.9):
        got = clusters.clustered(df, "terms", least).collect()
        assert sorted(map(tuple, got)) == sorted(plain_clusters(plain, least)), least
    assert clusters.clustered(df.where("false"), "terms").count() == 0


def test_cosine_join_has_all_pairs_and_few_candidates(spark):
    counts = []
    for n in (200, 800):
        lists = lists_with_a_common_term(n)
        df = spark.createDataFrame([(i, t) for i, own in lists.items() for t in own], "id int, term string").groupBy("id", "term").agg(F.count("*").alias("tf"))
        unit = clusters.unit_vectors(df).persist()
        want = plain_vectors(lists)
        pairs = {(a, b): round(sum(x * want[b].get(t, 0) for t, x in want[a].items()), 5) for b in want for a in want if a < b} if n == 200 else {}
        if n == 200:
            got = {(r["a"], r["b"]): r["cosine"] for r in clusters.similar(unit, 0.6).collect()}
            assert got == {k: v for k, v in pairs.items() if v >= 0.6}
        counts.append(clusters.candidates(unit, 0.6).count())
        unit.unpersist()
    assert counts[1] < 8 * counts[0] < 0.1 * 8 * 200 * 199 / 2  # "mov" is in every vector


def test_window_clusters(spark):
    shapes = {(r["seq"], r["lo"]): r["ops"] for r in similarity.shapes(code_windows(spark, SF)).collect()}
    lists = {k: [*ops, *("::".join(ops[i : i + 2]) for i in range(len(ops) - 1))] for k, ops in shapes.items()}
    got = catalog.QUERIES["gadget_clusters"](spark, SF).collect()
    assert sorted(((r["seq"], r["lo"]), (r["m_seq"], r["m_lo"])) for r in got) == sorted(plain_clusters(lists, 0.7))


def test_alignment_without_subsequences_and_flags_by_one_number(spark):
    from fenceline.functions import nodes

    rng = random.Random(9)
    lists = [([rng.choice("abcdef") for _ in range(rng.randint(0, 30))], [rng.choice("abcdef") for _ in range(rng.randint(0, 30))]) for _ in range(300)]
    got = alignment.aligned(spark.createDataFrame(lists, "x array<string>, y array<string>"), common=False)
    assert got.columns == ["x", "y", "alignment"]
    assert all(abs(r["alignment"] - SequenceMatcher(None, r["x"], r["y"]).ratio()) < 1e-12 for r in got.collect())
    rows = spark.createDataFrame([("jne", "x", "x86_64"), ("jmp", "[rax]", "x86_64"), ("call", "%rax", "x86_64"), ("b.eq", "x", None), ("mrs", "x", "arm64"), (None, None, "x86_64")], "op string, rest string, arch string")
    flags = nodes.semantics(F.col("op"), F.col("rest"), F.col("arch"))
    said = [{n for n in nodes.SEMANTICS if r["f"][n]} for r in rows.select(flags.alias("f")).collect()]
    assert said == [{"is_branch", "is_conditional"}, {"is_branch", "is_indirect"}, {"is_call", "is_indirect"}, {"is_branch", "is_conditional"}, {"is_timing_sensitive", "is_privileged"}, set()]
