"""Reports over stored detections: counts, top groups, a left join with validations, grouping sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from fenceline.functions.instructions import normalized
from fenceline.plans.analogs import read


def _lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem")


def left_join_filtered(spark, sf_dir):
    """Detections with their validation, where one is there and doubtful; the filter makes the join an inner one."""
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    both = orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left").where("c_acctbal < 0")
    return both.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice", "c_acctbal")


def scan_stats(spark, sf_dir):
    rows = _lines(spark, sf_dir).select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity")
    sets = [[F.col("flag")], [F.col("status")], []]
    return rows.groupingSets(sets, "flag", "status").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"))


def normalized_lines(spark, sf_dir):
    """(page_id, line_number, line): page lines trimmed, cut at the first ``;``, without blanks, directives and labels."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("line_number", "raw"))
    out = pages.select("page_id", "line_number", normalized(F.col("raw")).alias("line"))
    return out.where(F.col("line") != "")


QUERIES = {
    "count_all": lambda s, d: read(s, d, "events").agg(F.count("*").alias("n")),
    "detections_by_type": lambda s, d: read(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "event_type"),
    "top5_groups": lambda s, d: read(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(5),
    "high_risk_top5": lambda s, d: read(s, d, "events").where(F.col("event_type").isin("error", "purchase")).orderBy(F.col("value").desc(), "event_id").limit(5).select("event_id", "event_type", "value"),
    "distinct_sorted": lambda s, d: read(s, d, "orders").select("o_orderpriority", "o_orderstatus").distinct().orderBy("o_orderpriority", "o_orderstatus"),
    "left_join_fp": left_join_filtered,
    "grouping_sets_scan": scan_stats,
    "normalize_lines": normalized_lines,
    "unique_counts": lambda s, d: _lines(s, d).groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.avg("l_discount"), 6).alias("mean_discount")),
}
ORACLES = {
    "count_all": "SELECT count(*) AS n FROM events",
    "detections_by_type": "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1",
    "top5_groups": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5",
    "high_risk_top5": "SELECT event_id, event_type, value FROM events WHERE event_type IN ('error', 'purchase') ORDER BY value DESC, event_id LIMIT 5",
    "distinct_sorted": "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders ORDER BY 1, 2",
    "left_join_fp": "SELECT o_orderkey, o_totalprice, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "grouping_sets_scan": "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "normalize_lines": r"""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS raw, generate_subscripts(string_split(html, chr(10)), 1) - 1 AS line_number FROM pages),
      n AS (SELECT page_id, line_number::INT AS line_number, regexp_replace(split_part(regexp_replace(raw, '^[ \t\r]+|[ \t\r]+$', '', 'g'), ';', 1), '[ \t\r]+$', '') AS line FROM l)
      SELECT * FROM n WHERE line <> '' AND NOT starts_with(line, '.') AND NOT ends_with(line, ':')""",
    "unique_counts": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY 1",
}
