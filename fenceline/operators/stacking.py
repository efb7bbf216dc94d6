"""Two trained models, their soft and weighted votes, and a second level trained on out-of-fold scores, without leakage between groups.

Rows have a group (copies of one text, windows of one file), and a group's hash is its fold, so a group is in one fold whole. Fold
0 is the test: nothing is fitted on it. Each other fold is scored by models fitted on the remaining ones, and these out-of-fold scores are
what the second level is fitted on; the test is scored by models fitted on all other folds, and by that second level. So no row is
scored by a model that has seen its group, at either level. Fitting and scoring are Spark ML jobs; nothing but coefficients and trees comes to the driver.
Rows are computed once, with their hashed word counts and measures and without their words, and every fit and score reads these.

``report`` has precision, recall, F1 and support of each class, their plain means (``macro``) and the means weighted by support (``weighted``).

Defined results: rows with a null label are scored, and nothing is fitted on or counted from them; a null group is a group of its own, the empty one; null
texts are empty. A part to be fitted on that lacks a class is an error of the fitting, not a guess.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenceline.operators import detect
from fenceline.plans.analogs import read
from fenceline.plans.steps import settled

FOLDS, WORDS, TREES, DEPTH, ROUNDS = 4, 1 << 12, 20, 6, 20
#: Weights of the two models in a weighted vote, and the least score of class 1.
WEIGHTS, LEAST = (0.6, 0.4), 0.5
MEASURES = ("n_words", "mean_word", "punctuation", "digits", "capitals", "distinct", "lines")

#: What makes an estimator: ``fit(rows with label)`` gives what has ``transform(rows)``, which adds ``probability``.
Maker = Callable[[], object]


def text_rows(spark, sf_dir: str) -> DataFrame:
    """(id, group, label, counts, <measures>): documents with their quality label and hashed word counts, copies of a text but for case and white space in one group."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    rows = docs.join(labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))
    rows = rows.select(
        F.col("doc_id").alias("id"), F.md5(F.array_join(words, " ")).alias("group"), F.col("quality").cast("double").alias("label"), words.alias("words"), (1 - share(r"[^\w\s]")).alias("punctuation"), (1 - share(r"[0-9]")).alias("digits"),
        (1 - share(r"[A-Z]")).alias("capitals"), F.length(text).alias("size"), F.size(F.split(text, "\n")).cast("double").alias("lines"),
    )
    n = F.greatest(F.size("words"), F.lit(1))
    rows = HashingTF(inputCol="words", outputCol="counts", numFeatures=WORDS).transform(rows)
    return rows.select("id", "group", "label", "counts", F.size("words").cast("double").alias("n_words"), (F.col("size") / n).alias("mean_word"), "punctuation", "digits", "capitals", (F.size(F.array_distinct("words")) / n).alias("distinct"), "lines")


def forest() -> Pipeline:
    """Random forest on the measures of a text."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(MEASURES), outputCol="measures"), RandomForestClassifier(featuresCol="measures", numTrees=TREES, maxDepth=DEPTH, seed=42)])


def bayes() -> Pipeline:
    """Naive Bayes on hashed word counts."""
    return Pipeline(stages=[NaiveBayes(featuresCol="counts")])


MODELS: Mapping[str, Maker] = {"forest": forest, "bayes": bayes}


def folded(rows: DataFrame, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """``rows`` with ``fold``, from 0 on, the same for all rows of a group."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("group").cast("string"), F.lit(""))))
    return rows.withColumn("fold", (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % folds).cast("int"))


def _scored(model, rows: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """``rows`` with ``name``, the model's probability of class 1."""
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).select(*keep, name)


def first_level(rows: DataFrame, models: Mapping[str, Maker] = MODELS, folds: int = FOLDS) -> DataFrame:
    """``rows`` (folded) with a score of each model: fold 0 by models of all other folds, each other fold by models of those but itself and fold 0."""
    rows, parts = settled(rows), []  # read by every fit and score
    for fold in range(folds):
        train = rows.where((F.col("fold") != fold) & (F.col("fold") != 0) & F.col("label").isNotNull())
        part, keep = rows.where(F.col("fold") == fold), list(rows.columns)
        for name, make in models.items():
            part = _scored(make().fit(train), part, name, keep)
            keep.append(name)
        parts.append(part)
    return settled(reduce(DataFrame.unionByName, parts))


def stacked(rows: DataFrame, models: Mapping[str, Maker] = MODELS, folds: int = FOLDS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(id, group, label, fold, <models>, soft, weighted, stacked): all scores of class 1; ``stacked`` of the test fold only, where alone the second level has seen nothing."""
    if folds < 3:
        raise ValueError("a test fold and two others at least")
    scored = first_level(folded(rows, folds), models, folds)
    names = list(models)
    assemble = VectorAssembler(inputCols=names, outputCol="scores")
    level = LogisticRegression(featuresCol="scores", maxIter=ROUNDS).fit(assemble.transform(scored.where((F.col("fold") != 0) & F.col("label").isNotNull())))
    out = level.transform(assemble.transform(scored)).withColumn("second", vector_to_array("probability")[1])
    soft = reduce(lambda a, b: a + b, (F.col(c) for c in names)) / len(names)
    vote = reduce(lambda a, b: a + b, (F.col(c) * w for c, w in zip(names, weights, strict=True))) / sum(weights)
    return out.select("id", "group", "label", "fold", *names, soft.alias("soft"), vote.alias("weighted"), F.when(F.col("fold") == 0, F.col("second")).alias("stacked"))


def report(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(<by>, class, precision, recall, f1, support) of ``truth`` and ``said``: a row a class that either has, ``macro`` and ``weighted``. Rows with a null in either count nowhere."""
    seen = rows.where("truth IS NOT NULL AND said IS NOT NULL").select(*by, F.col("truth").cast("string").alias("truth"), F.col("said").cast("string").alias("said"))
    cells = seen.groupBy(*by, "truth", "said").agg(F.count("*").alias("n"))  # a row a pair of classes
    hit = F.when(F.col("truth") == F.col("said"), F.col("n")).otherwise(0)
    each = cells.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("class"), hit.alias("tp"), F.lit(0).cast("long").alias("pp"), F.col("n").alias("support")), F.struct(F.col("said").alias("class"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("pp"), F.lit(0).cast("long").alias("support")))).alias("c"))
    sums = each.select(*by, "c.*").groupBy(*by, "class").agg(F.sum("tp").alias("tp"), F.sum("pp").alias("pp"), F.sum("support").alias("support"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    found = sums.withColumns({"precision": ratio(F.col("tp"), F.col("pp")), "recall": ratio(F.col("tp"), F.col("support"))})
    found = found.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(*by, "class", "precision", "recall", "f1", "support")
    values = ("precision", "recall", "f1")
    macro = found.groupBy(*by).agg(*(F.avg(c).alias(c) for c in values), F.sum("support").alias("support")).withColumn("class", F.lit("macro"))
    weighted = found.groupBy(*by).agg(*(ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in values), F.sum("support").alias("support")).withColumn("class", F.lit("weighted"))
    every = found.unionByName(macro).unionByName(weighted).where("support IS NOT NULL")
    return every.select(*by, "class", *(F.round(c, 6).alias(c) for c in values), "support")


def compared(scores: DataFrame, models: Mapping[str, Maker] = MODELS) -> DataFrame:
    """The report of each model, vote and the second level on the test fold."""
    methods = [*models, "soft", "weighted", "stacked"]
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods)))
    rows = scores.where("fold = 0").select(F.col("label").cast("int").alias("truth"), each.alias("e"))
    return report(rows.select("truth", "e.method", (F.col("e.score") >= LEAST).cast("int").alias("said")), ("method",))


QUERIES = {
    "stacking_scores": lambda s, d: stacked(text_rows(s, d)).select("id", "fold", *(F.round(c, 6).alias(c) for c in (*MODELS, "soft", "weighted", "stacked"))),
    "stacking_report": lambda s, d: compared(settled(stacked(text_rows(s, d)))),
    "classification_report": lambda s, d: report(detect.votes(s, d).select("truth", (F.col("v1") * F.col("v2")).alias("said"))),
    "fold_sizes": lambda s, d: folded(text_rows(s, d)).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("group").alias("groups")),
}
ORACLES = {
    "classification_report": f"""{detect._VOTES}, s AS (SELECT truth::VARCHAR AS t, (v1 * v2)::VARCHAR AS p FROM v), k AS (SELECT t AS class FROM s UNION SELECT p FROM s),
      m AS (SELECT class, count(*) FILTER (t = class AND p = class) AS tp, count(*) FILTER (p = class) AS pp, count(*) FILTER (t = class) AS support FROM s, k GROUP BY class),
      r AS (SELECT class, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS a, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS b, support FROM m), f AS (SELECT *, CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END AS c FROM r),
      u AS (SELECT * FROM f UNION ALL SELECT 'macro', avg(a), avg(b), sum(support), avg(c) FROM f UNION ALL SELECT 'weighted', sum(a * support) / sum(support), sum(b * support) / sum(support), sum(support), sum(c * support) / sum(support) FROM f)
      SELECT class, round(a, 6) AS precision, round(b, 6) AS recall, round(c, 6) AS f1, support::BIGINT AS support FROM u""",
    "fold_sizes": r"""WITH t AS (SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> ''), ' ')) AS g FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)),
      f AS (SELECT g, ('0x' || md5('42|' || g)[1:8])::BIGINT % 4 AS fold FROM t) SELECT fold::INT AS fold, count(*) AS n, count(DISTINCT g) AS groups FROM f GROUP BY fold""",
}
