"""Scores, fusion, validation and ranking of detections, and similarity to a signature library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.operators import alignment
from fenceline.operators.ngrams import ngrams
from fenceline.operators.windows import anchored
from fenceline.plans.analogs import BRANCH, EV, FENCE, LOAD, RET, STORE, instructions, read, word_lists
from fenceline.plans.steps import settled


def risk(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "CRITICAL").when(confidence >= 0.6, "HIGH").when(confidence >= 0.4, "MEDIUM").otherwise("LOW")


def detections(rows: DataFrame) -> DataFrame:
    """(seq, lo, hi, type, confidence): windows around branches, scored by what they hold; the best type, the first of equals."""
    found = anchored(rows, F.col("op") == BRANCH, 5, 10, 8)
    n = lambda op: F.size(F.split("ops", op)) - 1
    score = lambda a, b: F.round(F.least(F.lit(1.0), F.lit(0.3) + a * 0.1 + b * 0.05) - n(FENCE) * 0.05, 6)
    types = (("LOAD_CHAIN", score(n(LOAD), n(STORE))), ("RETURN", score(n(RET), n(LOAD))), ("STORE_BYPASS", score(n(STORE), n(RET))))
    best = F.greatest(*(s for _, s in types))
    kind = F.coalesce(*(F.when(s == best, F.lit(k)) for k, s in types))
    return found.select("seq", "lo", "hi", kind.alias("type"), best.alias("confidence"))


def suppressed(found: DataFrame, overlap: float = 0.5, most: int = 20, stretch: int = 64, keys: tuple[str, ...] = ("confidence",), same_type: bool = False) -> DataFrame:
    """Greedy overlap suppression within each ``seq``: best first by ``keys``, then by place and type, dropped if it overlaps a kept span (with ``same_type``, one of its type) by more than ``overlap`` of the shorter; the best ``most`` stay.

    Done in rounds: a span that is better than all undecided spans it clashes with is kept, those it clashes with are
    dropped. That is the greedy choice, without one task for a sequence. Clashes are an equi-join on stretches of
    ``stretch`` positions; a span is in all stretches that it touches, so spans of any length that overlap meet in one.
    Spans alike in all columns count once.
    """
    order = [*(F.col(k).desc() for k in keys), "lo", "hi", "type"]
    spans = found.distinct().withColumn("rank", F.struct(*((-F.col(k)).alias(k) for k in keys), "lo", "hi", "type"))
    parts = F.explode(F.sequence(F.floor(F.col("lo") / stretch), F.floor(F.col("hi") / stretch)))
    a, b = spans.select("*", parts.alias("part")).alias("a"), spans.select("*", parts.alias("part")).alias("b")
    shared = F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo")
    shorter = F.greatest(F.lit(1), F.least(F.col("a.hi") - F.col("a.lo"), F.col("b.hi") - F.col("b.lo")))
    alike = (F.col("a.type") == F.col("b.type")) if same_type else F.lit(True)
    clash = alike & (F.col("a.seq") == F.col("b.seq")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.rank") < F.col("b.rank")) & (shared > F.lit(overlap) * shorter)
    clashes = settled(a.join(b, clash).select(F.col("a.seq").alias("seq"), F.col("a.rank").alias("better"), F.col("b.rank").alias("worse")).distinct())
    open_, kept = settled(spans.select("seq", "rank")), None
    while not open_.isEmpty():
        left = clashes.join(open_.withColumnRenamed("rank", "better"), ["seq", "better"], "left_semi")
        wins = settled(open_.join(left.select("seq", F.col("worse").alias("rank")).distinct(), ["seq", "rank"], "left_anti"))
        losers = clashes.join(wins.withColumnRenamed("rank", "better"), ["seq", "better"], "left_semi").select("seq", F.col("worse").alias("rank")).distinct()
        kept = wins if kept is None else kept.unionByName(wins)
        open_ = settled(open_.join(wins, ["seq", "rank"], "left_anti").join(losers, ["seq", "rank"], "left_anti"))
    out = spans.drop("rank") if kept is None else spans.join(kept, ["seq", "rank"], "left_semi").drop("rank")
    return out.withColumn("nth", F.row_number().over(Window.partitionBy("seq").orderBy(*order))).where(F.col("nth") <= most).drop("nth")


def best_spans(found: DataFrame) -> DataFrame:
    """One detection a (seq, lo, hi): the most confident, then the first type."""
    order = Window.partitionBy("seq", "lo", "hi").orderBy(F.col("confidence").desc(), "type")
    return found.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def votes(spark, sf_dir: str) -> DataFrame:
    """(id, truth, v1, v2, v3): labelled documents and three simple validators; the last abstains on short texts."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    text, long = F.coalesce("text", F.lit("")), F.length("text") > 500
    return labels.where("quality IS NOT NULL").join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("truth"), (F.length(text) > 300).cast("int").alias("v1"), text.contains(".").cast("int").alias("v2"),
        F.when(long, (~text.contains("|")).cast("int")).alias("v3"),
    )


def consensus(rows: DataFrame) -> DataFrame:
    """(id, agreement, exploitable, level): mean of the votes that aren't null."""
    given = F.array_compact(F.array("v1", "v2", "v3"))
    share = F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / F.size(given)
    level = F.when(F.size(given) == 0, "LOW").when(share >= 0.8, "HIGH").when(share >= 0.6, "MEDIUM").otherwise("LOW")
    return rows.select("id", F.round(share, 6).alias("agreement"), F.coalesce(share >= 0.5, F.lit(False)).alias("exploitable"), level.alias("level"))


def scores(rows: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) of v1 and v2 together against the truth."""
    seen = rows.select("truth", (F.col("v1") * F.col("v2")).alias("said"))
    each = seen.select("truth", "said", F.explode(F.array(F.lit(0), F.lit(1))).alias("class"))
    one = lambda cond: F.sum(cond.cast("int"))
    t, p = F.col("truth") == F.col("class"), F.col("said") == F.col("class")
    got = each.groupBy("class").agg(one(t & p).alias("tp"), one(p).alias("pp"), one(t).alias("support"))
    pr, rc = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return got.select("class", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0), 6).alias("f1"), "support")


def library(spark, sf_dir: str) -> DataFrame:
    """(id, label, words): benchmark items as signatures."""
    words = F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda w: w != "")
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("b").alias("label"), words.alias("words"))


def signature_matches(rows: DataFrame, known: DataFrame, n: int = 3, least: float = 0.01) -> DataFrame:
    """(id, item, jaccard): rows and signatures that share n-grams, with the Jaccard similarity of their n-gram sets.

    An equi-join on n-grams, so only pairs with something in common are ever made. A row's words are shuffled once, in one
    list, and its n-grams go no further than to the signatures'; rows of one id are one set.
    """
    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), "::"))
    lists = rows.where((F.size("words") >= n) & F.col("id").isNotNull()).groupBy("id").agg(F.array_distinct(F.flatten(F.transform(F.collect_list("words"), grams))).alias("grams"))
    a = lists.select("id", F.size("grams").alias("na"), F.explode("grams").alias("gram"))
    b = ngrams(known, n).select(F.col("id").alias("item"), "gram").distinct()
    of_b = b.groupBy("item").agg(F.count("*").alias("nb"))
    both = a.join(b, "gram").groupBy("id", "item").agg(F.count("*").alias("both"), F.first("na").alias("na"))
    found = both.join(of_b, "item").select("id", "item", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("jaccard"))
    return found.where(F.col("jaccard") >= least)


def best_matches(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.col("jaccard").desc(), "item")
    return found.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def traces(rows: DataFrame, longest: int = 50) -> DataFrame:
    """(seq, ops): the first ``longest`` operations of each sequence; the cut comes before the list."""
    few = rows.where(F.col("pos") < longest).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "op"))).alias("s"))
    return few.select("seq", F.col("s.op").alias("ops"))


def neighbours(lists: DataFrame) -> DataFrame:
    """(a, b, x, y): each sequence's trace with that of the next number."""
    left, right = lists.select(F.col("seq").alias("a"), F.col("ops").alias("x")), lists.select(F.col("seq").alias("b"), F.col("ops").alias("y"))
    return left.join(right, F.col("b") == F.col("a") + 1)


def prefix_lengths(rows: DataFrame) -> DataFrame:
    """(a, b, n): how many first operations each sequence shares with that of the next number, whatever their lengths.

    Places meet by equality and the first differing one decides; where none differs, the shorter sequence's length.
    """
    x, y = rows.select(F.col("seq").alias("a"), "pos", F.col("op").alias("x")), rows.select(F.col("seq").alias("b"), (F.col("seq") - 1).alias("a"), "pos", F.col("op").alias("y"))
    met = x.join(y, ["a", "pos"]).groupBy("a", "b").agg(F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("pos"))).alias("first"), F.count("*").alias("all"))
    return met.select("a", "b", F.coalesce("first", "all").cast("long").alias("n"))


def lcs_ratios(pairs: DataFrame) -> DataFrame:
    """(a, b, ratio): longest common subsequence of two traces over the longer one."""
    return alignment.aligned(pairs, "x", "y").select("a", "b", F.round("lcs", 6).alias("ratio"))


def centroid_cosine(spark, sf_dir: str) -> DataFrame:
    """(label, cosine): mean cosine of each label's vectors with the label's mean vector."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    means = vectors.groupBy("label", "dim").agg(F.avg("x").alias("m"))
    parts = vectors.join(means, ["label", "dim"]).groupBy("label", "vec_id").agg(F.sum(F.col("x") * F.col("m")).alias("xm"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    return parts.groupBy("label").agg(F.round(F.avg(F.col("xm") / F.sqrt(F.col("xx") * F.col("mm"))), 5).alias("cosine"))


QUERIES = {
    "detections": lambda s, d: detections(instructions(s, d)),
    "risk_bucket": lambda s, d: detections(instructions(s, d)).groupBy("type", risk(F.col("confidence")).alias("risk")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 5).alias("mean_confidence")),
    "best_spans": lambda s, d: best_spans(detections(instructions(s, d))),
    "nms_filter": lambda s, d: suppressed(detections(instructions(s, d))),
    "consensus_vote": lambda s, d: consensus(votes(s, d)),
    "confusion_matrix": lambda s, d: votes(s, d).groupBy("truth", (F.col("v1") * F.col("v2")).alias("said")).agg(F.count("*").alias("n")),
    "precision_recall_f1": lambda s, d: scores(votes(s, d)),
    "signature_cross_match": lambda s, d: signature_matches(word_lists(s, d), library(s, d)),
    "best_match": lambda s, d: best_matches(signature_matches(word_lists(s, d), library(s, d))),
    "lcs_ratio": lambda s, d: lcs_ratios(neighbours(traces(instructions(s, d)))),
    "prefix_match": lambda s, d: prefix_lengths(instructions(s, d)),
    "centroid_cosine": centroid_cosine,
}


def _n(op: str) -> str:
    return f"len(list_filter(ops, lambda x: x = '{op}'))"


def _score(a: str, b: str) -> str:
    return f"round(least(1.0::DOUBLE, 0.3::DOUBLE + {_n(a)} * 0.1::DOUBLE + {_n(b)} * 0.05::DOUBLE) - {_n(FENCE)} * 0.05::DOUBLE, 6)"


_DET = f"""WITH {EV}, w AS (SELECT a.seq, min(b.pos) AS lo, max(b.pos) AS hi, list(b.op) AS ops FROM ev a JOIN ev b ON a.seq = b.seq AND b.pos BETWEEN a.pos - 5 AND a.pos + 10
    WHERE a.op = '{BRANCH}' GROUP BY a.seq, a.pos HAVING count(*) >= 8),
  s AS (SELECT seq, lo, hi, {_score(LOAD, STORE)} AS s1, {_score(RET, LOAD)} AS s2, {_score(STORE, RET)} AS s3 FROM w),
  det AS (SELECT seq, lo, hi, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 'LOAD_CHAIN' WHEN s2 >= s3 THEN 'RETURN' ELSE 'STORE_BYPASS' END AS type, greatest(s1, s2, s3) AS confidence FROM s)"""
_VOTES = """WITH v AS (SELECT doc_id AS id, quality AS truth, (length(coalesce(text, '')) > 300)::INT AS v1, contains(coalesce(text, ''), '.')::INT AS v2,
    CASE WHEN length(text) > 500 THEN (NOT contains(text, '|'))::INT END AS v3 FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"""
_BM = r"bm AS (SELECT item_id AS item, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda w: w <> '') AS words FROM benchmark)"
_WL = r"wl AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda w: w <> '') AS words FROM documents)"
_SIG = f"""WITH {_WL}, {_BM}, a AS (SELECT DISTINCT id, words[i] || '::' || words[i + 1] || '::' || words[i + 2] AS gram FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM wl WHERE len(words) >= 3)),
  b AS (SELECT DISTINCT item, words[i] || '::' || words[i + 1] || '::' || words[i + 2] AS gram FROM (SELECT item, words, unnest(range(1, len(words) - 1)) AS i FROM bm WHERE len(words) >= 3)),
  na AS (SELECT id, count(*) AS na FROM a GROUP BY id), nb AS (SELECT item, count(*) AS nb FROM b GROUP BY item), c AS (SELECT id, item, count(*) AS common FROM a JOIN b USING (gram) GROUP BY ALL),
  m AS (SELECT id, item, round(common / (na + nb - common), 6) AS jaccard FROM c JOIN na USING (id) JOIN nb USING (item))"""
ORACLES = {
    "detections": f"{_DET} SELECT * FROM det",
    "risk_bucket": f"""{_DET} SELECT type, CASE WHEN confidence >= 0.8 THEN 'CRITICAL' WHEN confidence >= 0.6 THEN 'HIGH' WHEN confidence >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
      count(*) AS n, round(avg(confidence), 5) AS mean_confidence FROM det GROUP BY ALL""",
    "best_spans": f"{_DET} SELECT DISTINCT ON (seq, lo, hi) * FROM det ORDER BY seq, lo, hi, confidence DESC, type",
    "consensus_vote": f"""{_VOTES}, c AS (SELECT id, list_avg(list_filter([v1, v2, v3], lambda x: x IS NOT NULL)) AS share FROM v)
      SELECT id, round(share, 6) AS agreement, coalesce(share >= 0.5, false) AS exploitable, CASE WHEN share >= 0.8 THEN 'HIGH' WHEN share >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM c""",
    "confusion_matrix": f"{_VOTES} SELECT truth, v1 * v2 AS said, count(*) AS n FROM v GROUP BY ALL",
    "precision_recall_f1": f"""{_VOTES}, c AS (SELECT class, count(*) FILTER (truth = class AND v1 * v2 = class) AS tp, count(*) FILTER (v1 * v2 = class) AS pp, count(*) FILTER (truth = class) AS support
      FROM v, (VALUES (0), (1)) k(class) GROUP BY class), r AS (SELECT *, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM c)
      SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support FROM r""",
    "signature_cross_match": f"{_SIG} SELECT * FROM m WHERE jaccard >= 0.01",
    "best_match": f"{_SIG} SELECT DISTINCT ON (id) id, item, jaccard FROM m WHERE jaccard >= 0.01 ORDER BY id, jaccard DESC, item",
    "prefix_match": f"""WITH {EV}, p AS (SELECT x.seq AS a, y.seq AS b, x.pos, x.op = y.op AS same FROM ev x JOIN ev y ON y.seq = x.seq + 1 AND y.pos = x.pos)
      SELECT a, b, coalesce(min(pos) FILTER (NOT same), count(*)) AS n FROM p GROUP BY ALL""",
    "centroid_cosine": """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), m AS (SELECT label, dim, avg(x) AS m FROM v GROUP BY ALL),
      p AS (SELECT label, vec_id, sum(x * m) / sqrt(sum(x * x) * sum(m * m)) AS c FROM v JOIN m USING (label, dim) GROUP BY ALL) SELECT label, round(avg(c), 5) AS cosine FROM p GROUP BY label""",
}
