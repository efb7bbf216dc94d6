"""The driver's tables seen as the engine's relations.

``events`` is an instruction stream per user: error is a fence, purchase a conditional branch, signup a return, view a
load and click a store; an instruction writes register ``event_id % 5`` (stores and branches write none) and reads
register ``event_id div 5 % 5``. ``documents`` are labelled records whose lines are instructions and whose source is
the label. The SQL forms are common table expressions for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FENCE, BRANCH, RET, LOAD, STORE = "error", "purchase", "signup", "view", "click"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, pos, op, dest, src): one row an instruction, ``pos`` from 0 within ``seq``."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("seq"),
        (F.row_number().over(order) - 1).alias("pos"),
        F.col("event_type").alias("op"),
        F.when(~F.col("event_type").isin(STORE, BRANCH), F.col("event_id") % 5).alias("dest"),
        (F.floor(F.col("event_id") / 5) % 5).alias("src"),
    )


EV = f"""ev AS (SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS op,
  CASE WHEN event_type NOT IN ('{STORE}', '{BRANCH}') THEN event_id % 5 END AS dest, (event_id // 5) % 5 AS src FROM events)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, key, label): documents by the hash of their trimmed, lower-cased text, labelled with their source."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.md5(F.lower(F.trim("text"))).alias("key"), F.col("source").alias("label"))


RECORDS = "rec AS (SELECT doc_id AS id, md5(lower(trim(text, ' '))) AS key, source AS label FROM documents)"


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, key, label): every line that isn't blank, keyed by its trimmed, lower-cased text."""
    docs = read(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.where(F.trim("line") != "").select(
        (F.col("doc_id").cast("decimal(38,0)") * 2**31 + F.col("at")).alias("id"), F.md5(F.lower(F.trim("line"))).alias("key"), F.col("source").alias("label")
    )


LINES = """lrec AS (SELECT doc_id::DECIMAL(38,0) * 2147483648 + nth - 1 AS id, md5(lower(trim(line, ' '))) AS key, source AS label
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents)
  WHERE trim(line, ' ') <> '')"""


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, words): a document's words, by its language."""
    words = F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda w: w != "")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), words.alias("words"))


WORDS = r"wl AS (SELECT doc_id AS id, lang AS label, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda w: w <> '') AS words FROM documents)"
