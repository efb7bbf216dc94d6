"""Policies for records that occur more than once, within one label or across labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fenceline.plans.analogs import LINES, RECORDS, line_records, records


def clean(rows: DataFrame, cap: int = 2) -> DataFrame:
    """Drops every key under more than one label; of the others keeps the first ``cap`` rows by id."""
    order = Window.partitionBy("key").orderBy("id")
    few = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap)  # the limit cuts each task's rows before the shuffle
    one = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo = hi").select("key")
    return few.join(one, "key", "left_semi").select("id", "key", "label")


def majority(rows: DataFrame) -> DataFrame:
    """Rows of each key's most frequent label; keys whose top labels tie are dropped."""
    counts = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    key = Window.partitionBy("key")
    top = counts.withColumn("most", F.max("n").over(key)).where("n = most").withColumn("ties", F.count("*").over(key)).where("ties = 1")
    return rows.join(top.select("key", "label"), ["key", "label"]).select("id", "key", "label")


def soft_labels(rows: DataFrame) -> DataFrame:
    """(key, label, share): the label distribution of each key."""
    counts = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    return counts.select("key", "label", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("key")), 6).alias("share"))


def cross_label_pairs(rows: DataFrame) -> DataFrame:
    """(label_a, label_b, n_keys): how many keys two labels share, from each key's set of labels."""
    sets = rows.groupBy("key").agg(F.array_sort(F.collect_set("label")).alias("s")).where(F.size("s") > 1)
    a = sets.select("s", F.posexplode("s").alias("i", "label_a"))
    pairs = a.select("label_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("label_b"))
    return pairs.groupBy("label_a", "label_b").agg(F.count("*").alias("n_keys"))


def overlap(rows: DataFrame, one: str, other: str) -> DataFrame:
    """Keys that occur under both labels."""
    return rows.where(F.col("label") == one).select("key").intersect(rows.where(F.col("label") == other).select("key"))


def without_duplicates(spark, sf_dir: str) -> DataFrame:
    return clean(line_records(spark, sf_dir), 1)


QUERIES = {
    "clean_cross_label": lambda s, d: clean(records(s, d), 2),
    "dedup_keep_one": lambda s, d: clean(records(s, d), 1),
    "dedup_lines": without_duplicates,
    "majority_label": lambda s, d: majority(line_records(s, d)),
    "soft_labels": lambda s, d: soft_labels(records(s, d)),
    "cross_label_pairs": lambda s, d: cross_label_pairs(line_records(s, d)),
    "overlap_intersect": lambda s, d: overlap(line_records(s, d), "src0", "src1"),
    "label_distribution": lambda s, d: records(s, d).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys")),
}


def _clean_sql(cte: str, name: str, cap: int) -> str:
    return f"""WITH {cte}, one AS (SELECT key FROM {name} GROUP BY key HAVING count(DISTINCT label) = 1),
    r AS (SELECT id, key, label, row_number() OVER (PARTITION BY key ORDER BY id) AS nth FROM {name} SEMI JOIN one USING (key))
    SELECT id, key, label FROM r WHERE nth <= {cap}"""


ORACLES = {
    "clean_cross_label": _clean_sql(RECORDS, "rec", 2),
    "dedup_keep_one": _clean_sql(RECORDS, "rec", 1),
    "dedup_lines": _clean_sql(LINES, "lrec", 1),
    "majority_label": f"""WITH {LINES}, c AS (SELECT key, label, count(*) AS n FROM lrec GROUP BY ALL),
      m AS (SELECT key, max(n) AS n FROM c GROUP BY key), t AS (SELECT key, min(label) AS label FROM c JOIN m USING (key, n) GROUP BY key HAVING count(*) = 1)
      SELECT id, key, label FROM lrec JOIN t USING (key, label)""",
    "soft_labels": f"""WITH {RECORDS}, k AS (SELECT key, count(*) AS total FROM rec GROUP BY key)
      SELECT key, label, round(count(*) / any_value(total), 6) AS share FROM rec JOIN k USING (key) GROUP BY key, label""",
    "cross_label_pairs": f"""WITH {LINES}, u AS (SELECT DISTINCT key, label FROM lrec)
      SELECT a.label AS label_a, b.label AS label_b, count(*) AS n_keys FROM u a JOIN u b ON a.key = b.key AND a.label < b.label GROUP BY ALL""",
    "overlap_intersect": f"WITH {LINES} SELECT key FROM lrec WHERE label = 'src0' INTERSECT SELECT key FROM lrec WHERE label = 'src1'",
    "label_distribution": f"WITH {RECORDS} SELECT label, count(*) AS n, count(DISTINCT key) AS n_keys FROM rec GROUP BY label",
}
