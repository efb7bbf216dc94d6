"""Deterministic caps, splits, balancing and pairs: every choice is the order of md5(seed || id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled(spark, sf_dir: str) -> DataFrame:
    """(id, label, group) of the documents: language and source."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), F.col("source").alias("group"))


def chance(seed: int, column: str = "id"):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(column).cast("string")))


def capped(rows: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` rows of each label by id."""
    order = Window.partitionBy("label").orderBy("id")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap).drop("nth")


def ranked(rows: DataFrame, by: str, seed: int = 42) -> DataFrame:
    """``rows`` with ``nth``, the place from 1 within ``by`` in the order of md5(seed || id), and ``n``, the size of ``by``.

    Rows are numbered within 4096 parts of the md5 and the parts' counts give each part's first number, so a value of
    ``by`` may hold any share of all rows.
    """
    parts = rows.withColumn("chance", chance(seed)).withColumn("part", F.substring("chance", 1, 3))
    counts = parts.groupBy(by, "part").agg(F.count("*").alias("c"))
    own = Window.partitionBy(by).orderBy("part")
    bases = counts.select(by, "part", (F.sum("c").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("base"), F.sum("c").over(Window.partitionBy(by)).alias("n"))
    nth = F.row_number().over(Window.partitionBy(by, "part").orderBy("chance", "id"))
    return parts.withColumn("own", nth).join(bases, [by, "part"]).withColumn("nth", F.col("base") + F.col("own")).drop("chance", "part", "own", "base")


def stratified(rows: DataFrame, share_percent: int = 20, seed: int = 42) -> DataFrame:
    """(id, label, split): ``share_percent`` of each label, rounded up, to test."""
    return ranked(rows, "label", seed).select("id", "label", F.when(F.col("nth") * 100 < F.col("n") * share_percent + 100, F.lit("test")).otherwise(F.lit("train")).alias("split"))


def grouped(rows: DataFrame, k: int = 4, cap: int = 10, seed: int = 42) -> DataFrame:
    """(id, group, split): ``k`` groups go to test whole, and of every group only ``cap`` rows are taken."""
    test = rows.select("group").where("group IS NOT NULL").distinct().orderBy(chance(seed, "group"), "group").limit(k).withColumn("split", F.lit("test"))  # k rows
    few = rows.where("group IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy("group").orderBy(chance(seed), "id"))).where(F.col("nth") <= cap)
    return few.join(F.broadcast(test), "group", "left").select("id", "group", F.coalesce("split", F.lit("train")).alias("split"))


def group_labels(rows: DataFrame) -> DataFrame:
    """(group, label, confidence): each group's label of the largest confidence, of equals the first by ``id``; so a group in two classes is in one. Null groups are none."""
    best = F.max_by(F.struct("label", "confidence"), F.struct("confidence", -F.col("id")))
    return rows.where("group IS NOT NULL AND confidence IS NOT NULL").groupBy("group").agg(best.alias("b")).select("group", "b.label", "b.confidence")


def class_quotas(rows: DataFrame, k: int = 3, cap: int = 10, unknown: str = "UNKNOWN", seed: int = 42) -> DataFrame:
    """(id, group, label, confidence, split): of each class the first ``k`` groups in the order of md5(seed || group) go to test whole, the others to train; ``cap`` rows a group, first ids first.

    ``rows`` has id (a number), group, label and confidence. A group belongs to the class of its most confident row; those of the class ``unknown`` and of none are
    left out. A class's rank limit cuts each task's groups before the shuffle, so no task numbers all groups, and a class may hold any share of them.
    """
    groups = group_labels(rows).where((F.col("label") != unknown) & F.col("label").isNotNull())
    nth = F.row_number().over(Window.partitionBy("label").orderBy(chance(seed, "group"), "group"))
    test = groups.withColumn("nth", nth).where(F.col("nth") <= k).select("group", F.lit("test").alias("split"))
    few = rows.withColumn("own", F.row_number().over(Window.partitionBy("group").orderBy("id"))).where(F.col("own") <= cap).select("id", "group")
    return few.join(groups, "group").join(test, "group", "left").select("id", "group", "label", "confidence", F.coalesce("split", F.lit("train")).alias("split"))


def scored_groups(spark, sf_dir: str) -> DataFrame:
    """(id, group, label, confidence): documents of a source and site of it, labelled with their language, as sure as their share of letters of one kind; the longest are UNKNOWN."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    group = F.concat_ws("/", "source", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2))
    label = F.when(F.col("n_chars") > 4000, "UNKNOWN").otherwise(F.col("lang"))
    return docs.select(F.col("doc_id").alias("id"), group.alias("group"), label.alias("label"), F.round(F.col("n_chars") % 1000 / 1000, 6).alias("confidence"))


def balanced(rows: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """(id, label, copy): exactly ``target`` rows a label; labels with fewer repeat rows in turn."""
    nth = F.row_number().over(Window.partitionBy("label").orderBy(chance(seed), "id"))  # the limit below cuts each task's rows before the shuffle
    few = rows.select("id", "label").withColumn("nth", nth).where(F.col("nth") <= target)
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    copies = F.floor((F.lit(target) - F.col("nth")) / F.col("n")).cast("int")
    return few.join(sizes, "label").select("id", "label", F.explode(F.sequence(F.lit(0), copies)).alias("copy"))


def contrastive(rows: DataFrame) -> DataFrame:
    """(a, b, same): each row with the next of its group, and with the row at the mirrored place of all, of another group."""
    nxt = F.lead("id").over(Window.partitionBy("group").orderBy("id"))
    positive = rows.select(F.col("id").alias("a"), nxt.alias("b"), F.lit(1).alias("same")).where("b IS NOT NULL")
    n, by = _numbered(rows)
    left, right = by.select(F.col("id").alias("a"), F.col("group").alias("ga"), "i"), by.select(F.col("id").alias("b"), F.col("group").alias("gb"), (n - 1 - F.col("i")).alias("i"))
    negative = left.join(right, "i").where((F.col("i") < n - 1 - F.col("i")) & (F.col("ga") != F.col("gb"))).select("a", "b", F.lit(0).alias("same"))
    return positive.unionByName(negative)


def _numbered(rows: DataFrame) -> tuple[int, DataFrame]:
    """Number of rows, and their places by id from 0: counts of range parts, and of parts of parts, so no task sees all rows."""
    small, large = F.floor(F.col("id") / 4096), F.floor(F.col("small") / 4096)
    counts = rows.groupBy(small.alias("small")).agg(F.count("*").alias("c")).withColumn("large", large)
    before = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = counts.groupBy("large").agg(F.sum("c").alias("c")).select("large", before(Window.orderBy("large")).alias("top"))  # a row for 16 million ids
    bases = counts.select("small", "large", before(Window.partitionBy("large").orderBy("small")).alias("base")).join(tops, "large")
    own = F.row_number().over(Window.partitionBy("small").orderBy("id")) - 1
    placed = rows.withColumn("small", small).withColumn("own", own).join(bases, "small")
    return rows.count(), placed.select("id", "group", (F.col("top") + F.col("base") + F.col("own")).alias("i"))


def class_weights(rows: DataFrame) -> DataFrame:
    """(label, weight): N / (K * n)."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    every = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))  # one row
    return counts.crossJoin(F.broadcast(every)).select("label", F.round(F.col("total") / (F.col("k") * F.col("n")), 6).alias("weight"))


QUERIES = {
    "class_cap": lambda s, d: capped(labelled(s, d), 100),
    "stratified_split": lambda s, d: stratified(labelled(s, d)),
    "group_split": lambda s, d: grouped(labelled(s, d)),
    "balance_target": lambda s, d: balanced(labelled(s, d), 150),
    "class_group_split": lambda s, d: class_quotas(scored_groups(s, d)),
    "contrastive_pairs": lambda s, d: contrastive(labelled(s, d)),
    "class_weights": lambda s, d: class_weights(labelled(s, d)),
}
_L = 'lab AS (SELECT doc_id AS id, lang AS label, source AS "group" FROM documents)'
ORACLES = {
    "class_cap": f'WITH {_L} SELECT id, label, "group" FROM lab QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= 100',
    "stratified_split": f"""WITH {_L}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) AS nth, count(*) OVER (PARTITION BY label) AS n FROM lab)
      SELECT id, label, CASE WHEN nth <= ceil(n * 20 / 100.0) THEN 'test' ELSE 'train' END AS split FROM r""",
    "group_split": f"""WITH {_L}, g AS (SELECT "group", row_number() OVER (ORDER BY md5('42|' || "group"), "group") AS nth FROM (SELECT DISTINCT "group" FROM lab)),
      f AS (SELECT * FROM lab QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY md5('42|' || id), id) <= 10)
      SELECT id, f."group", CASE WHEN nth <= 4 THEN 'test' ELSE 'train' END AS split FROM f JOIN g ON f."group" = g."group" """,
    "class_group_split": """WITH r AS (SELECT doc_id AS id, source || '/' || md5(doc_id::VARCHAR)[1:2] AS g, CASE WHEN n_chars > 4000 THEN 'UNKNOWN' ELSE lang END AS label, round(n_chars % 1000 / 1000, 6) AS confidence FROM documents),
      b AS (SELECT DISTINCT ON (g) g, label, confidence FROM r ORDER BY g, confidence DESC, id), c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || g), g) AS nth FROM b WHERE label <> 'UNKNOWN'),
      f AS (SELECT id, g FROM r QUALIFY row_number() OVER (PARTITION BY g ORDER BY id) <= 10) SELECT id, g AS "group", label, confidence, CASE WHEN nth <= 3 THEN 'test' ELSE 'train' END AS split FROM f JOIN c USING (g)""",
    "balance_target": f"""WITH {_L}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) AS nth, count(*) OVER (PARTITION BY label) AS n FROM lab)
      SELECT id, label, ((t - 1) // n)::INT AS copy FROM r, range(1, 151) AS x(t) WHERE (t - 1) % n = nth - 1""",
    "contrastive_pairs": f"""WITH {_L}, p AS (SELECT id AS a, lead(id) OVER (PARTITION BY "group" ORDER BY id) AS b, 1 AS same FROM lab),
      i AS (SELECT id, "group", row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM lab)
      SELECT a, b, same FROM p WHERE b IS NOT NULL UNION ALL SELECT x.id, y.id, 0 FROM i x JOIN i y ON y.i = x.n - 1 - x.i WHERE x.i < y.i AND x."group" <> y."group" """,
    "class_weights": f"WITH {_L} SELECT label, round((SELECT count(*) FROM lab) / ((SELECT count(DISTINCT label) FROM lab) * count(*)), 6) AS weight FROM lab GROUP BY label",
}
