"""N-gram distributions of sequences and measures over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fenceline.plans.analogs import EV, WORDS, instructions, word_lists


def ngrams(rows: DataFrame, n: int, words: str = "words") -> DataFrame:
    """(id, label, gram): every ``n``-gram of a row's list, joined by ``::``; n-grams don't cross rows."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(F.col(words), i + 1, n), "::"))
    return rows.where(F.size(words) >= n).select("id", "label", F.explode(grams).alias("gram"))


def sequences(spark, sf_dir: str) -> DataFrame:
    """(id, label, words): each sequence's operations in order."""
    rows = instructions(spark, sf_dir).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "op"))).alias("s"))
    return rows.select(F.col("seq").alias("id"), (F.col("seq") % 4).alias("label"), F.col("s.op").alias("words"))


def entropy(counts: DataFrame, by: str) -> DataFrame:
    """Shannon entropy in bits of the counts ``n`` within ``by``: log2(N) - sum(n log2 n) / N, so no group's items meet in one task."""
    n, total = F.col("n"), F.sum("n")
    return counts.groupBy(by).agg(F.round(F.log2(total) - F.sum(n * F.log2(n.cast("double"))) / total, 6).alias("entropy"))


def coverage(counts: DataFrame, by: str, k: int) -> DataFrame:
    """Share of all occurrences that the ``k`` most frequent items make up; the rank's limit cuts each task's rows first."""
    order = Window.partitionBy(by).orderBy(F.col("n").desc(), "gram")
    tops = counts.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).groupBy(by).agg(F.sum("n").alias("top"))
    return tops.join(counts.groupBy(by).agg(F.sum("n").alias("all")), by).select(by, F.round(F.col("top") / F.col("all"), 6).alias("coverage"))


def counted(rows: DataFrame, n: int) -> DataFrame:
    return ngrams(rows, n).groupBy("label", "gram").agg(F.count("*").alias("n"))


def sides(rows: DataFrame, n: int, one, other) -> DataFrame:
    """(gram, p, q): shares of each n-gram under two labels, 0 where absent."""
    c = counted(rows.where(F.col("label").isin(one, other)), n)
    both = c.groupBy("gram").agg(*(F.coalesce(F.sum(F.when(F.col("label") == x, F.col("n"))), F.lit(0)).alias(y) for x, y in ((one, "a"), (other, "b"))))
    total = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))  # one row
    return both.crossJoin(F.broadcast(total)).select("gram", "a", "b", (F.col("a") / F.col("ta")).alias("p"), (F.col("b") / F.col("tb")).alias("q"))


def set_difference(rows: DataFrame, n: int, one, other) -> DataFrame:
    """N-grams under ``one`` that never occur under ``other``."""
    c = counted(rows, n)
    return c.where(F.col("label") == one).select("gram").subtract(c.where(F.col("label") == other).select("gram"))


def delta_topk(rows: DataFrame, n: int, one, other, k: int) -> DataFrame:
    s = sides(rows, n, one, other).select("gram", F.round(F.col("p") - F.col("q"), 9).alias("delta"))
    return s.orderBy(F.abs("delta").desc(), "gram").limit(k)


def divergences(rows: DataFrame, n: int, one, other) -> DataFrame:
    """Jaccard of the sets, cosine of the counts and Jensen-Shannon divergence (bits) of the shares."""
    s = sides(rows, n, one, other)
    x, y = F.col("a").cast("double"), F.col("b").cast("double")
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    return s.agg(
        F.round(F.sum(((F.col("a") > 0) & (F.col("b") > 0)).cast("int")) / F.count("*"), 6).alias("jaccard"),
        F.round(F.sum(x * y) / F.sqrt(F.sum(x * x)) / F.sqrt(F.sum(y * y)), 6).alias("cosine"),
        F.round(F.sum(part("p") + part("q")) / 2, 6).alias("js"),
    )


QUERIES = {
    "ngram_counts": lambda s, d: counted(sequences(s, d), 3),
    "word_bigrams": lambda s, d: counted(word_lists(s, d), 2).where("n > 2"),
    "token_entropy": lambda s, d: entropy(counted(word_lists(s, d), 1), "label"),
    "topk_coverage": lambda s, d: coverage(counted(word_lists(s, d), 1), "label", 20),
    "new_ngrams": lambda s, d: set_difference(word_lists(s, d), 1, "de", "en"),
    "dropped_ngrams": lambda s, d: set_difference(word_lists(s, d), 1, "en", "de"),
    "ngram_delta_topk": lambda s, d: delta_topk(word_lists(s, d), 1, "en", "fr", 25),
    "js_divergence": lambda s, d: divergences(word_lists(s, d), 1, "en", "de"),
    "opcode_divergence": lambda s, d: divergences(sequences(s, d), 2, 0, 1),
    "length_stats": lambda s, d: word_lists(s, d).groupBy("label").agg(
        F.round(F.avg(F.size("words")), 6).alias("mean_words"), F.round(F.var_pop(F.size("words")), 4).alias("var_words"), F.max(F.size(F.array_distinct("words"))).alias("max_unique")
    ),
    "vocabulary": lambda s, d: word_lists(s, d).select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n >= 20"),
}
_W1 = f"WITH {WORDS}, c AS (SELECT label, gram, count(*) AS n FROM (SELECT label, unnest(words) AS gram FROM wl) GROUP BY ALL)"
_SQ = f"WITH {EV}, sq AS (SELECT seq AS id, seq % 4 AS label, list(op ORDER BY pos) AS words FROM ev GROUP BY seq)"


def _grams_sql(name: str, n: int) -> str:
    return f"g AS (SELECT label, array_to_string(words[i:i + {n - 1}], '::') AS gram FROM (SELECT label, words, unnest(range(1, len(words) - {n - 2})) AS i FROM {name} WHERE len(words) >= {n}))"


def _divergence_sql(head: str, one: str, other: str) -> str:
    return f"""{head}, t AS (SELECT gram, coalesce(sum(n) FILTER (label = {one}), 0)::DOUBLE AS a, coalesce(sum(n) FILTER (label = {other}), 0)::DOUBLE AS b FROM c WHERE label IN ({one}, {other}) GROUP BY gram),
    s AS (SELECT *, a / (SELECT sum(a) FROM t) AS p, b / (SELECT sum(b) FROM t) AS q FROM t)"""


_DIV = """SELECT round(sum((a > 0 AND b > 0)::INT) / count(*), 6) AS jaccard, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine,
    round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 6) AS js FROM s"""
ORACLES = {
    "ngram_counts": f"{_SQ}, {_grams_sql('sq', 3)} SELECT label, gram, count(*) AS n FROM g GROUP BY ALL",
    "word_bigrams": f"WITH {WORDS}, {_grams_sql('wl', 2)} SELECT label, gram, count(*) AS n FROM g GROUP BY ALL HAVING count(*) > 2",
    "token_entropy": f"{_W1}, p AS (SELECT label, n / sum(n) OVER (PARTITION BY label) AS p FROM c) SELECT label, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY label",
    "topk_coverage": f"""{_W1}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, gram) AS nth FROM c)
      SELECT label, round(coalesce(sum(n) FILTER (nth <= 20), 0) / sum(n), 6) AS coverage FROM r GROUP BY label""",
    "new_ngrams": f"{_W1} SELECT gram FROM c WHERE label = 'de' EXCEPT SELECT gram FROM c WHERE label = 'en'",
    "dropped_ngrams": f"{_W1} SELECT gram FROM c WHERE label = 'en' EXCEPT SELECT gram FROM c WHERE label = 'de'",
    "ngram_delta_topk": f"{_divergence_sql(_W1, chr(39) + 'en' + chr(39), chr(39) + 'fr' + chr(39))} SELECT gram, round(p - q, 9) AS delta FROM s ORDER BY abs(round(p - q, 9)) DESC, gram LIMIT 25",
    "js_divergence": f"{_divergence_sql(_W1, chr(39) + 'en' + chr(39), chr(39) + 'de' + chr(39))} {_DIV}",
    "opcode_divergence": f"{_divergence_sql(_SQ + ', ' + _grams_sql('sq', 2) + ', c AS (SELECT label, gram, count(*) AS n FROM g GROUP BY ALL)', '0', '1')} {_DIV}",
    "length_stats": f"WITH {WORDS} SELECT label, round(avg(len(words)), 6) AS mean_words, round(var_pop(len(words)), 4) AS var_words, max(len(list_distinct(words)))::INT AS max_unique FROM wl GROUP BY label",
    "vocabulary": f"WITH {WORDS} SELECT token, count(*) AS n FROM (SELECT unnest(words) AS token FROM wl) GROUP BY token HAVING count(*) >= 20",
}
