"""Folds, models that tell what they saw, reports, and class quotas."""

import random

import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F

from fenceline.operators import patterns, splits, stacking, windows

from .conftest import SF

SEEN: list[set] = []


class Remembers:
    """A model that scores 1 where it has seen a row's group, else 0."""

    def fit(self, rows):
        self.groups = {r["group"] for r in rows.select("group").distinct().collect()}
        assert rows.where("label IS NULL").count() == 0
        SEEN.append(self.groups)
        return self

    def transform(self, rows):
        known = F.col("group").isin(*self.groups) if self.groups else F.lit(False)
        make = F.udf(lambda x: Vectors.dense(1.0 - x, x), VectorUDT())
        return rows.withColumn("probability", make(F.coalesce(known, F.lit(False)).cast("double")))


def test_no_row_is_scored_by_a_model_that_saw_its_group(spark):
    rng = random.Random(1)
    rows = [(i, f"g{rng.randrange(40)}" if i % 9 else None, float(rng.randrange(2)) if i % 7 else None) for i in range(400)] + [(1, "g1", 1.0)]
    df = spark.createDataFrame(rows, "id int, group string, label double")
    SEEN.clear()
    found = stacking.first_level(stacking.folded(df, 5), {"a": Remembers, "b": Remembers}, 5)
    assert found.count() == 401 and found.where("a > 0 OR b > 0").count() == 0
    folds = {}
    for r in found.collect():
        folds.setdefault(r["group"], set()).add(r["fold"])
    assert all(len(f) == 1 for f in folds.values()) and {f for own in folds.values() for f in own} == set(range(5))
    tests = {g for g, own in folds.items() if own == {0}}
    assert len(SEEN) == 10 and all(not tests & seen for seen in SEEN) and any(SEEN)
    with pytest.raises(ValueError):
        stacking.stacked(df, folds=2)


def test_votes_and_the_second_level(spark):
    scores = stacking.stacked(stacking.text_rows(spark, SF.replace("0.001", "0.01")))
    rows = scores.collect()
    for r in rows:
        assert r["soft"] == pytest.approx((r["forest"] + r["bayes"]) / 2) and r["weighted"] == pytest.approx(0.6 * r["forest"] + 0.4 * r["bayes"])
        assert (r["stacked"] is None) == (r["fold"] != 0)
    test = [r for r in rows if r["fold"] == 0]
    right = lambda c: sum((r[c] >= 0.5) == (r["label"] == 1) for r in test) / len(test)
    assert len(test) > 30 and right("stacked") >= max(right("forest"), right("bayes")) - 0.1 and right("stacked") > 0.6


def test_report_of_odd_rows(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 2 + [(0, 2), (None, 1), (1, None), (3, 1)]
    got = {r["class"]: tuple(r)[1:] for r in stacking.report(spark.createDataFrame(rows, "truth int, said int")).collect()}
    assert got["1"] == (0.75, 0.75, 0.75, 4) and got["2"] == (0.0, 0.0, 0.0, 0) and got["3"] == (0.0, 0.0, 0.0, 1)
    assert got["0"] == (round(2 / 3, 6), round(2 / 3, 6), round(2 / 3, 6), 3)
    f1 = [0.75, 2 / 3, 0, 0]
    assert got["macro"][2] == round(sum(f1) / 4, 6) and got["weighted"][2] == round((4 * 0.75 + 3 * 2 / 3) / 8, 6) and got["macro"][3] == got["weighted"][3] == 8
    assert stacking.report(spark.createDataFrame([], "truth int, said int")).count() == 0


def test_class_quotas(spark):
    rng = random.Random(4)
    rows = [(i, f"g{rng.randrange(30)}", rng.choice(["a", "b", "UNKNOWN", None]), rng.choice([0.1, 0.5, 0.9, None])) for i in range(300)] + [(400 + i, "hot", "a", 1.0) for i in range(150)] + [(600, None, "a", 1.0)]
    info = {}
    for i, g, label, c in rows:
        if g and c is not None and (g not in info or c > info[g][1]):
            info[g] = (label, c)
    got = splits.class_quotas(spark.createDataFrame(rows, "id int, group string, label string, confidence double"), 2, 4).collect()
    by = {}
    for r in got:
        assert (r["label"], r["confidence"]) == info[r["group"]]
        by.setdefault(r["group"], []).append((r["id"], r["split"]))
    assert set(by) == {g for g, (label, _) in info.items() if label in ("a", "b")}
    for g, own in by.items():
        assert sorted(i for i, _ in own) == sorted(i for i, x, *_ in rows if x == g)[:4] and len({s for _, s in own}) == 1
    for label in "ab":
        assert sum(own[0][1] == "test" for g, own in by.items() if info[g][0] == label) == 2


def test_windows_are_cut_from_anchors_only(spark):
    rng = random.Random(6)
    lists = {s: [rng.choice("abc") for _ in range(n)] for s, n in ((1, 0), (2, 3), (3, 40))}
    rows = spark.createDataFrame([(s, p, op) for s, own in lists.items() for p, op in enumerate(own)], "seq int, pos int, op string")
    got = {(r["seq"], r["anchor"]): (r["lo"], r["hi"], r["ops"]) for r in windows.anchored(rows, F.col("op") == "a", 2, 5, 4).collect()}
    want = {}
    for s, own in lists.items():
        for p, op in enumerate(own):
            part = own[max(0, p - 2) : p + 6]
            if op == "a" and len(part) >= 4:
                want[s, p] = (max(0, p - 2), min(len(own) - 1, p + 5), " ".join(part))
    assert got == want
    for size, step in ((5, 2), (3, 7), (4, 4)):
        cut = {(r["seq"], r["lo"]): list(r["ops"]) for r in patterns.cut_windows(rows, size, step).collect()}
        assert cut == {(s, lo): own[lo : lo + size] for s, own in lists.items() for lo in range(0, len(own) - size + 1, step)}


def test_fits_and_scores_read_rows_made_once(spark):
    plans = []

    class Watches(Remembers):
        def fit(self, rows):
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
            return super().fit(rows)

        def transform(self, rows):
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
            return super().transform(rows)

    rows = stacking.text_rows(spark, SF)
    assert "words" not in rows.columns  # nor are whole texts carried along
    stacking.first_level(stacking.folded(rows), {"a": Watches})
    assert len(plans) == 8 and all("parquet" not in p and "regexp" not in p for p in plans)
