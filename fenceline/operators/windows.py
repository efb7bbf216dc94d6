"""Slices of positions within a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.plans.analogs import BRANCH, EV, FENCE, LOAD, RET, STORE, instructions


def _seq():
    return Window.partitionBy("seq").orderBy("pos")


def anchored(rows: DataFrame, anchor: Column, before: int, after: int, least: int = 1) -> DataFrame:
    """(seq, anchor, lo, hi, ops): the slice from ``before`` rows before to ``after`` rows after each anchor row.

    Only anchors ask for places, which meet rows by equality; positions are numbers without gaps. Null operations are left out of the text and count as rows.
    """
    asked = rows.where(anchor).select("seq", F.col("pos").alias("anchor"), F.explode(F.sequence(F.col("pos") - before, F.col("pos") + after)).alias("pos"))
    met = asked.join(rows.select("seq", "pos", "op"), ["seq", "pos"]).groupBy("seq", "anchor")
    found = met.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "op"))).alias("s"))
    return found.where(F.col("n") >= least).select("seq", "anchor", "lo", "hi", F.array_join(F.transform("s", lambda x: x["op"]), " ").alias("ops"))


def sliding(rows: DataFrame, sizes: list[int], step: int) -> DataFrame:
    """(seq, lo, size, n_branch): whole windows of the sizes that begin every ``step`` positions."""
    branch = (F.col("op") == BRANCH).cast("int")
    total = F.count("*").over(Window.partitionBy("seq"))
    base = rows.withColumn("total", total)
    for k in sizes:  # one window pass a size, all under the same partitioning
        base = base.withColumn(f"n{k}", F.sum(branch).over(_seq().rowsBetween(0, k - 1)))
    each = F.array(*(F.struct(F.lit(k).alias("size"), F.col(f"n{k}").alias("n_branch")) for k in sizes))
    out = base.where(F.col("pos") % step == 0).select("seq", "pos", "total", F.explode(each).alias("w"))
    return out.where(F.col("pos") + F.col("w.size") <= F.col("total")).select("seq", F.col("pos").alias("lo"), "w.size", "w.n_branch")


def strided(rows: DataFrame, size: int, stride: int, least: int) -> DataFrame:
    """(seq, lo, length): windows every ``stride`` positions, a short last one if it has ``least`` rows."""
    total = F.count("*").over(Window.partitionBy("seq"))
    return (
        rows.withColumn("length", F.least(total - F.col("pos"), F.lit(size)))
        .where((F.col("pos") % stride == 0) & (F.col("length") >= least))
        .select("seq", F.col("pos").alias("lo"), "length")
    )


def bucketed(rows: DataFrame, first: Column, second: Column, width: int = 8, least: int = 12, cap: int = 64) -> DataFrame:
    """Windows of two strategies, one for each (lo, hi) bucket, the earlier strategy and anchor first, ``cap`` a sequence."""
    total = F.count("*").over(Window.partitionBy("seq"))
    ways = F.array_compact(F.array(F.when(first, F.struct(F.lit(0).alias("way"), F.lit(20).alias("b"), F.lit(30).alias("a"))), F.when(second, F.struct(F.lit(1).alias("way"), F.lit(15).alias("b"), F.lit(25).alias("a")))))
    found = rows.withColumn("total", total).select("seq", "pos", "total", F.explode(ways).alias("w"))
    spans = found.select("seq", "pos", "w.way", F.greatest(F.lit(0), F.col("pos") - F.col("w.b")).alias("lo"), F.least(F.col("total"), F.col("pos") + F.col("w.a") + 1).alias("hi"))
    long = spans.where(F.col("hi") - F.col("lo") >= least)
    bucket = Window.partitionBy("seq", F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)).orderBy("way", "pos")
    one = long.withColumn("nth", F.row_number().over(bucket)).where("nth = 1")
    order = Window.partitionBy("seq").orderBy("way", "pos")
    return one.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap).select("seq", "way", "lo", "hi")


def lookahead(rows: DataFrame, what: Column, k: int) -> DataFrame:
    """(seq, pos, ahead): how many of the next ``k`` rows are ``what``."""
    return rows.select("seq", "pos", F.coalesce(F.sum(what.cast("int")).over(_seq().rowsBetween(1, k)), F.lit(0)).alias("ahead"))


def segments(rows: DataFrame, label: Column) -> DataFrame:
    """(seq, segment, n, lo): runs that begin at label rows; what comes before the first is segment 0."""
    marked = rows.withColumn("segment", F.sum(label.cast("int")).over(_seq().rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("seq", "segment").agg(F.count("*").alias("n"), F.min("pos").alias("lo"))


def longest_run(rows: DataFrame, op: str) -> DataFrame:
    """(seq, run): the longest run of ``op``, by gaps and islands."""
    hits = rows.where(F.col("op") == op).withColumn("island", F.col("pos") - F.row_number().over(_seq()))
    return hits.groupBy("seq", "island").agg(F.count("*").alias("n")).groupBy("seq").agg(F.max("n").alias("run"))


QUERIES = {
    "anchor_windows": lambda s, d: anchored(instructions(s, d), F.col("op") == BRANCH, 8, 12, 5),
    "sliding_windows": lambda s, d: sliding(instructions(s, d), [5, 10, 20], 5),
    "strided_windows": lambda s, d: strided(instructions(s, d), 30, 15, 12),
    "bucket_dedup_windows": lambda s, d: bucketed(instructions(s, d), F.col("op") == RET, F.col("op") == BRANCH),
    "lookahead_count": lambda s, d: lookahead(instructions(s, d), F.col("op").isin(LOAD, STORE), 9),
    "function_segments": lambda s, d: segments(instructions(s, d), F.col("op") == FENCE),
    "longest_run": lambda s, d: longest_run(instructions(s, d), RET),
}
ORACLES = {
    "anchor_windows": f"""WITH {EV} SELECT a.seq, a.pos AS anchor, min(b.pos) AS lo, max(b.pos) AS hi, string_agg(b.op, ' ' ORDER BY b.pos) AS ops
      FROM ev a JOIN ev b ON a.seq = b.seq AND b.pos BETWEEN a.pos - 8 AND a.pos + 12 WHERE a.op = '{BRANCH}' GROUP BY a.seq, a.pos HAVING count(*) >= 5""",
    "sliding_windows": f"""WITH {EV}, t AS (SELECT seq, count(*) AS total FROM ev GROUP BY seq),
      w AS (SELECT seq, size, unnest(range(0, total - size + 1, 5)) AS lo FROM t, (VALUES (5), (10), (20)) s(size) WHERE total >= size)
      SELECT w.seq, lo, size, count(*) FILTER (op = '{BRANCH}') AS n_branch FROM w JOIN ev ON ev.seq = w.seq AND pos >= lo AND pos < lo + size GROUP BY ALL""",
    "strided_windows": f"""WITH {EV}, t AS (SELECT seq, count(*) AS total FROM ev GROUP BY seq)
      SELECT seq, lo, least(30, total - lo) AS length FROM (SELECT seq, total, unnest(range(0, total, 15)) AS lo FROM t) WHERE total - lo >= 12""",
    "bucket_dedup_windows": f"""WITH {EV}, t AS (SELECT seq, count(*) AS total FROM ev GROUP BY seq),
      w AS (SELECT seq, pos, 0 AS way, greatest(0, pos - 20) AS lo, least(total, pos + 31) AS hi FROM ev JOIN t USING (seq) WHERE op = '{RET}'
        UNION ALL SELECT seq, pos, 1, greatest(0, pos - 15), least(total, pos + 26) FROM ev JOIN t USING (seq) WHERE op = '{BRANCH}'),
      o AS (SELECT DISTINCT ON (seq, lo // 8, hi // 8) * FROM w WHERE hi - lo >= 12 ORDER BY seq, lo // 8, hi // 8, way, pos)
      SELECT seq, way, lo, hi FROM o QUALIFY row_number() OVER (PARTITION BY seq ORDER BY way, pos) <= 64""",
    "lookahead_count": f"""WITH {EV} SELECT a.seq, a.pos, count(b.pos) AS ahead FROM ev a
      LEFT JOIN ev b ON a.seq = b.seq AND b.pos BETWEEN a.pos + 1 AND a.pos + 9 AND b.op IN ('{LOAD}', '{STORE}') GROUP BY ALL""",
    "function_segments": f"""WITH {EV}, g AS (SELECT seq, pos, (SELECT count(*) FROM ev b WHERE b.seq = a.seq AND b.pos <= a.pos AND b.op = '{FENCE}') AS segment FROM ev a)
      SELECT seq, segment, count(*) AS n, min(pos) AS lo FROM g GROUP BY ALL""",
    "longest_run": f"""WITH {EV}, r AS (SELECT seq, pos - row_number() OVER (PARTITION BY seq ORDER BY pos) AS island FROM ev WHERE op = '{RET}'),
      c AS (SELECT seq, island, count(*) AS n FROM r GROUP BY ALL) SELECT seq, max(n) AS run FROM c GROUP BY seq""",
}
