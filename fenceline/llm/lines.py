"""Operator 6 [native]: removal of boilerplate lines that many sites share, by DataFrame and SQL functions only.

1. Lines (split at newlines, of ``min_words`` words or more) are counted by hash. A line found in fewer than
   ``min_sites`` rows cannot be on so many sites; the rest are candidates.
2. Each candidate's sites go into a HyperLogLog sketch. Sketches are partial aggregates, so a line in a third of all
   rows costs one small sketch a task. Estimates within ``margin`` of the threshold are settled by exact distinct
   counts, again by two-step aggregation.
3. Lines on ``min_sites`` sites or more are cut from every text that has them.

Lines are told apart by two 64-bit hashes. Defined results: a null text stays null; an empty text has one empty line,
never removed; a null site counts as one site of its own; texts left without lines are empty strings. Rows with equal
ids are treated one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MIN_SITES, MIN_WORDS, LG_K, BROADCAST_LINES = 5, 3, 12, 50_000


def _at_least(line: Column, words: int) -> Column:
    """Whether the line has so many words."""
    ws, w = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]++"
    return line.rlike(f"^{ws}*+" + f"{ws}++".join([w] * words))  # anchored and possessive: linear in the line's length


def shared_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, margin: int = 1) -> DataFrame:
    """(h1, h2): hashes of the lines on ``min_sites`` sites or more."""
    lines = (
        docs.select(F.coalesce(F.col(site_col).cast("string"), F.lit("\x00")).alias("site"), F.explode(F.split(text_col, "\n")).alias("line"))
        .where(_at_least(F.col("line"), min_words))
        .select("site", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"))
    )
    often = written(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h1", "h2"), "often")
    found = lines.join(_sized(often), ["h1", "h2"], "left_semi")
    spread = written(
        found.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")),
        "spread",
    )
    near = spread.where(F.abs(F.col("sites") - min_sites) <= F.greatest(F.lit(margin), F.ceil(F.lit(0.1 * min_sites)))).select("h1", "h2")
    exact = lines.join(_sized(near), ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    return written(
        spread.join(exact, ["h1", "h2"], "left").where(F.coalesce("exact", "sites") >= min_sites).select("h1", "h2"),
        "boilerplate",
    )


def _sized(lines: DataFrame) -> DataFrame:
    """``lines`` for a join: broadcast while it is no more than BROADCAST_LINES rows of two longs, else shuffled."""
    return F.broadcast(lines) if lines.count() <= BROADCAST_LINES else lines


def without_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, counts: bool = True) -> DataFrame:
    """``docs`` with the shared lines cut from the text, and with ``counts`` also ``n_lines`` and ``n_removed``, in place of any such columns."""
    names = docs.columns
    dropped = shared_lines(docs, text_col, site_col, min_sites, min_words)
    keyed = docs.select(*(F.col(f"`{c}`") for c in names), F.xxhash64(text_col).alias("__t1"), F.xxhash64(text_col, F.lit(1)).alias("__t2"))
    hit = (
        keyed.select("__t1", "__t2", F.posexplode(F.split(text_col, "\n")).alias("__at", "__line"))
        .where(_at_least(F.col("__line"), min_words))
        .select("__t1", "__t2", "__at", F.xxhash64("__line").alias("h1"), F.xxhash64("__line", F.lit(1)).alias("h2"))
        .join(_sized(dropped), ["h1", "h2"], "left_semi")
        .groupBy("__t1", "__t2")
        .agg(F.collect_set("__at").alias("__cut"))
    )
    lines = F.split(text_col, "\n")
    left = F.array_join(F.filter(lines, lambda line, k: ~F.array_contains(F.col("__cut"), k)), "\n")
    out = keyed.join(hit, ["__t1", "__t2"], "left")
    names = [c for c in names if not counts or c not in ("n_lines", "n_removed")]
    rest = [F.col(f"`{c}`") if c != text_col else F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(left).alias(text_col) for c in names]
    if not counts:
        return out.select(*rest)
    return out.select(
        *rest,
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("__cut").isNotNull(), F.size("__cut")), F.lit(0)).cast("long").alias("n_removed"),
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Operator 6 over all of ``documents``: line counts, and length and hash of what is left of each text."""
    done = without_shared_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")).alias("n_lines"), "n_removed", F.length(text).cast("long").alias("kept_chars"), F.md5(text).alias("kept_md5"))


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
l AS (SELECT r, coalesce(source, chr(1)) AS site, line, k FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d)),
f AS (SELECT line FROM l WHERE regexp_matches(line, '{r"[\x20\x09-\x0D]+".join([r"[^\x20\x09-\x0D]+"] * MIN_WORDS)}') GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
k AS (SELECT r, count(*) AS n_lines, count(f.line) AS n_removed, string_agg(CASE WHEN f.line IS NULL THEN l.line END, chr(10) ORDER BY k) AS kept FROM l LEFT JOIN f ON l.line = f.line GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, length(coalesce(kept, ''))::BIGINT AS kept_chars, md5(coalesce(kept, '')) AS kept_md5
FROM d LEFT JOIN k USING (r)
"""
