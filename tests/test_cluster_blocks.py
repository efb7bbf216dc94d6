"""The cosine join in a grid of groups: all pairs, and few candidates where vectors share terms that are neither rare nor common."""

import random

from pyspark.sql import functions as F

from fenceline.operators import clusters, similarity

from .test_similarity import plain_vectors


def test_shared_terms_make_no_candidates(spark, monkeypatch):
    rng = random.Random(7)
    lists = {i: [f"t{rng.randrange(300)}" for _ in range(30)] for i in range(400)}
    for i in range(0, 400, 8):
        lists[i + 1] = lists[i][: rng.randint(12, 29)] + lists[i + 1][:6]
    rows = spark.createDataFrame([(i, t) for i, own in lists.items() for t in own], "id int, term string").groupBy("id", "term").agg(F.count("*").alias("tf"))
    unit = clusters.unit_vectors(rows).persist()
    want = plain_vectors(lists)
    cosines = {(a, b): round(sum(x * want[b].get(t, 0) for t, x in want[a].items()), 5) for b in want for a in want if a < b}
    for group, least in ((65536, 0.7), (50, 0.7), (50, 0.3)):
        monkeypatch.setattr(clusters, "GROUP", group)
        assert {(r["a"], r["b"]): r["cosine"] for r in clusters.similar(unit, least).collect()} == {k: v for k, v in cosines.items() if v >= least}
    assert clusters.candidates(unit, 0.7).count() < 1600  # of 79,800 pairs, most of which share a term
    assert clusters.similar(unit.where("false"), 0.7).count() == 0


def test_library_is_every_tenth_listing(spark):
    rows = spark.createDataFrame([(seq, lo, ["ldr", "cmp", "b", f"o{seq}"]) for seq in range(400) for lo in (0, 15)], "seq long, lo long, ops array<string>")
    assert sorted(r["s_seq"] for r in similarity.signatures(rows).collect()) == list(range(0, 400, 10))
    few = rows.where("seq < 60")
    want = {(r["seq"], r["lo"], r["s_seq"]): r["cosine"] for r in similarity.dots(few).collect() if r["cosine"] >= 0.5}
    assert {(r["seq"], r["lo"], r["s_seq"]): r["cosine"] for r in similarity.close(few).collect()} == want and len({s for *_, s in want}) == 6
