"""Sinks and stores of records: upsert, reload, exports, text corpus, vocabulary, graphs, report.

A store is a folder of Parquet files, one folder a version, named so that the newest is the last one; a version is
written whole before readers see it, so a lost executor or driver leaves the old one in place. Nothing but the report's
few aggregate rows comes to the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenceline.operators.dedup import QUERIES as DEDUP  # the cleaning that the report describes
from fenceline.operators.detect import best_spans, detections, risk
from fenceline.operators.graph import all_edges
from fenceline.plans.analogs import EV, RECORDS, instructions, records


def last_writer(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key, that of the largest ``order``; equal orders are settled by all columns."""
    own = Window.partitionBy(*key).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*rows.columns))
    return rows.withColumn("__nth", F.row_number().over(own)).where("__nth = 1").drop("__nth")


def _versions(spark: SparkSession, path: str) -> tuple[object, list[str]]:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return fs, []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return fs, sorted(n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the store."""
    _, names = _versions(spark, path)
    if not names:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{names[-1]}")


def replace_store(rows: DataFrame, path: str) -> None:
    """Writes ``rows`` as the store's new version: what was there before is no longer read."""
    _, names = _versions(rows.sparkSession, path)
    number = int(names[-1].split("-")[0][1:]) + 1 if names else 0
    rows.write.parquet(f"{path}/v{number:09d}-{uuid.uuid4().hex}")


def upsert(rows: DataFrame, path: str, key: list[str], order: str) -> None:
    """Adds ``rows`` to the store; of rows with an equal ``key`` the one of the largest ``order`` stays."""
    spark = rows.sparkSession
    _, names = _versions(spark, path)
    every = read_store(spark, path).unionByName(rows, allowMissingColumns=True) if names else rows
    replace_store(last_writer(every, key, order), path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def summary(found: DataFrame) -> DataFrame:
    """(summary): one JSON text with counts by type and risk of detections."""
    flat = found.groupBy("type", risk(F.col("confidence")).alias("risk")).agg(F.count("*").alias("n"))  # a row a type and risk
    return flat.agg(F.to_json(F.struct(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("type", "risk", "n"))).alias("counts"))).alias("summary"))


def corpus(rows: DataFrame, by: str = "seq", order: str = "pos", token: str = "op", longest: int = 512) -> DataFrame:
    """(value): a line of space-joined tokens for each stretch of at most ``longest`` positions of ``by``."""
    part = F.floor(F.col(order) / longest)
    lists = rows.groupBy(by, part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(order, token))).alias("s"))
    return lists.select(F.array_join(F.transform("s", lambda x: x[token]), " ").alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def vocabulary(tokens: DataFrame, least: int = 1) -> DataFrame:
    """(token, id): see ``fusion.vocabulary_ids``."""
    from fenceline.operators.fusion import vocabulary_ids

    return vocabulary_ids(tokens, least).select("token", "id")


def graph_records(nodes: DataFrame, edges: DataFrame, width: int = 64) -> DataFrame:
    """(seq, part, nodes, edges): the graph of each stretch of ``width`` positions, nodes as a map, edges as a sorted list, for JSON lines.

    An edge is in the stretch of its source, wherever its target is, so none is lost between stretches.
    """
    part = lambda c: F.floor(F.col(c) / width).alias("part")
    n = nodes.groupBy("seq", part("pos")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pos", "op")))).alias("nodes"))
    e = edges.groupBy("seq", part("src")).agg(F.array_sort(F.collect_set(F.struct("src", "dst", "type"))).alias("edges"))
    return n.join(e, ["seq", "part"], "left")


def report_rows(before: DataFrame, after: DataFrame, by: str = "label") -> DataFrame:
    """(label, rows, kept, removed, percent): what a cleaning did to each label."""
    a, b = before.groupBy(by).agg(F.count("*").alias("rows")), after.groupBy(by).agg(F.count("*").alias("kept"))
    out = a.join(b, by, "left").fillna(0, ["kept"]).withColumn("removed", F.col("rows") - F.col("kept"))
    return out.withColumn("percent", F.round(100 * F.col("removed") / F.col("rows"), 4))


def markdown(report: DataFrame, title: str, most: int = 30) -> str:
    """The report as Markdown: totals, and the ``most`` labels that lost most rows."""
    total = report.agg(F.sum("rows").alias("rows"), F.sum("kept").alias("kept")).first()
    top = report.orderBy(F.col("removed").desc(), report.columns[0]).limit(most).collect()
    lines = [f"# {title}", "", f"Rows {total['rows'] or 0}, kept {total['kept'] or 0}, removed {(total['rows'] or 0) - (total['kept'] or 0)}.", "", "| label | rows | kept | removed | % |", "|-|-|-|-|-|"]
    return "\n".join([*lines, *(f"| {r[0]} | {r['rows']} | {r['kept']} | {r['removed']} | {r['percent']:.2f} |" for r in top)]) + "\n"


def _clean(spark, sf_dir: str) -> DataFrame:
    return DEDUP["clean_cross_label"](spark, sf_dir)


QUERIES = {
    "upsert_latest": lambda s, d: last_writer(s.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "event_id", F.round("value", 4).alias("value")), ["user_id", "event_type"], "event_id"),
    "summary_json": lambda s, d: summary(best_spans(detections(instructions(s, d)))),
    "corpus_lines": lambda s, d: corpus(instructions(s, d), longest=32),
    "graph_sizes": lambda s, d: graph_records(instructions(s, d), all_edges(instructions(s, d)), 32).select("seq", "part", F.size("nodes").alias("n_nodes"), F.coalesce(F.when(F.col("edges").isNotNull(), F.size("edges")), F.lit(0)).alias("n_edges")),
    "clean_report": lambda s, d: report_rows(records(s, d), _clean(s, d)),
}


def _graph_sql() -> str:
    from fenceline.operators.graph import _CACHE, _DATA, _MEM, _NEXT, _SPEC, FENCE

    return f"""WITH {EV}, {_DATA}, {_MEM}, {_SPEC}, {_CACHE}, {_NEXT}, e AS (SELECT seq, src, dst, 0 AS type FROM dd UNION ALL SELECT seq, src, dst, 1 FROM nx UNION ALL SELECT seq, src, dst, type FROM sp UNION ALL SELECT seq, src, dst, 5 FROM mm
      UNION ALL SELECT seq, src, dst, 6 FROM cc UNION ALL SELECT seq, src, dst, 7 FROM nx WHERE op = '{FENCE}'), n AS (SELECT seq, pos // 32 AS part, count(*) AS n_nodes FROM ev GROUP BY ALL),
      x AS (SELECT seq, src // 32 AS part, count(DISTINCT (src, dst, type)) AS n_edges FROM e GROUP BY ALL) SELECT seq, part, n_nodes, coalesce(n_edges, 0) AS n_edges FROM n LEFT JOIN x USING (seq, part)"""


def _summary_sql() -> str:
    from fenceline.operators.detect import _DET

    return f"""{_DET}, b AS (SELECT DISTINCT ON (seq, lo, hi) * FROM det ORDER BY seq, lo, hi, confidence DESC, type), r AS (SELECT type, CASE WHEN confidence >= 0.8 THEN 'CRITICAL' WHEN confidence >= 0.6 THEN 'HIGH' WHEN confidence >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk, count(*) AS n FROM b GROUP BY ALL)
      SELECT '{{"total":' || sum(n) || ',"counts":[' || string_agg('{{"type":"' || type || '","risk":"' || risk || '","n":' || n || '}}', ',' ORDER BY type, risk) || ']}}' AS summary FROM r"""


ORACLES = {
    "upsert_latest": "SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, round(value, 4) AS value FROM events ORDER BY user_id, event_type, event_id DESC",
    "summary_json": _summary_sql(),
    "corpus_lines": f"WITH {EV} SELECT string_agg(op, ' ' ORDER BY pos) AS value FROM ev GROUP BY seq, pos // 32",
    "graph_sizes": _graph_sql(),
    "clean_report": f"""WITH {RECORDS}, one AS (SELECT key FROM rec GROUP BY key HAVING count(DISTINCT label) = 1), r AS (SELECT label, row_number() OVER (PARTITION BY key ORDER BY id) AS nth FROM rec SEMI JOIN one USING (key)),
      k AS (SELECT label, count(*) AS kept FROM r WHERE nth <= 2 GROUP BY label), a AS (SELECT label, count(*) AS "rows" FROM rec GROUP BY label)
      SELECT label, "rows", coalesce(kept, 0) AS kept, "rows" - coalesce(kept, 0) AS removed, round(100 * ("rows" - coalesce(kept, 0)) / "rows", 4) AS percent FROM a LEFT JOIN k USING (label)""",
}
