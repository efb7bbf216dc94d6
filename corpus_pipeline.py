"""Corpus pipeline: quality rules, line dedup, near-duplicate dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; ``run`` writes what a stage returns as
Parquet and rereads it as the next one's ``docs``. All but the last return the columns of ``documents``.

Defined results, in any stage: ids, languages and sources may be null or repeated and extra columns pass through
unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenceline.llm import lines, near_dup, packing, quality, secrets
from fenceline.llm.common import written


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have no words and go; each row is judged by itself, so repeated rows stay or go together."""
    return quality.good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many sources share. A null text stays null, a text left without lines is empty; a null source is one source of its own."""
    return _counted(lines.without_shared_lines(docs, counts=False))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id (null ids last, equal ids by the text's hash). Null and empty texts have no
    group and stay, but rows alike in id and text count once."""
    return near_dup.deduplicated(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with ``[kind]`` in place of each secret; null and empty texts stay as they are."""
    return _counted(secrets.redacted(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their sequence and offset; a null or empty text is one piece, the end id. Equal pieces are ranked by id, then by hash."""
    return packing.packed_documents(docs, keep_ids=False)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dup_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]
#: SQL can express neither the tokenizer nor the compressed sizes; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
