"""Classification, fusion of detectors, validation and ranking of detections.

Detections are (seq, type, lo, hi, ...) of the event stream; every fusion is a grouped aggregate. Null scores count as 0
in a fusion and as no vote in a consensus; equal scores are settled by name, so results repeat.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.operators import detect, features
from fenceline.operators.features import KEY
from fenceline.operators.windows import anchored
from fenceline.plans.analogs import BRANCH, EV, FENCE, LOAD, RET, STORE, instructions
from fenceline.plans.assembly_analog import CODE, code, code_windows

# The detectors' weights.
WEIGHTS = {"robust": 0.4, "semantic": 0.35, "pattern": 0.15, "anomaly": 0.1}
#: Defaults of our own: the least confidence of a type of the event stream.
LEAST = {"LOAD_CHAIN": 0.7, "RETURN": 0.6, "STORE_BYPASS": 0.65}
CLASS_SCORES = ("mds_gadget_score", "spectre_v1_score", "bhi_score", "l1tf_score", "benign_score", "retbleed_score", "inception_score")


def adjusted_risk(confidence: Column, doubt: Column) -> Column:
    """Of a confidence less the likelihood of a false positive."""
    x = confidence * (1 - doubt)
    return F.when(x >= 0.85, "CRITICAL").when(x >= 0.75, "HIGH").when(x >= 0.65, "MEDIUM").otherwise("LOW")


def detector_rows(rows: DataFrame) -> DataFrame:
    """(seq, type, lo, hi, detector, confidence, code, anomaly, evidence, penalty): the detections of two detectors on the event stream."""
    n = lambda op: F.size(F.split("ops", op)) - 1
    robust = detect.detections(rows).select("seq", "type", "lo", "hi", F.lit("robust").alias("detector"), "confidence", F.lit(0.0).alias("code"), (F.col("confidence") / 2).alias("anomaly"), F.lit(2).alias("evidence"), F.lit(0).alias("penalty"))
    seen = anchored(rows, F.col("op") == BRANCH, 5, 10, 8).where(n(LOAD) >= 3)
    kind = F.when(n(RET) > n(STORE), "RETURN").otherwise("LOAD_CHAIN")
    semantic = seen.select("seq", kind.alias("type"), "lo", "hi", F.lit("semantic").alias("detector"), F.least(F.lit(1.0), n(LOAD) * 0.15).alias("confidence"), (n(STORE) * 0.1).alias("code"), F.lit(0.0).alias("anomaly"), n(LOAD).alias("evidence"), (n(FENCE) > 1).cast("int").alias("penalty"))
    return robust.unionByName(semantic)


def fused(found: DataFrame, least: float = 0.4) -> DataFrame:
    """One row for each (seq, type, lo, hi): weighted confidence, agreement of the detectors, strength of evidence, likelihood of a false positive, risk."""
    best = lambda d, c: F.coalesce(F.max(F.when(F.col("detector") == d, F.col(c))), F.lit(0.0))
    got = found.groupBy("seq", "type", "lo", "hi").agg(
        best("robust", "confidence").alias("robust"), best("semantic", "confidence").alias("semantic"), best("semantic", "code").alias("pattern"), best("robust", "anomaly").alias("anomaly"),
        (F.countDistinct("detector") / 2).alias("agreement"), F.least(F.sum("evidence") / 10, F.lit(1.0)).alias("strength"), F.sum("penalty").alias("k"), F.array_join(F.sort_array(F.collect_list("detector")), ",").alias("detected_by"),
    )
    confidence = reduce(lambda a, b: a + b, (F.col(c) * w for c, w in WEIGHTS.items()))
    got = got.withColumn("confidence", F.round(confidence, 6)).withColumn("doubt", F.round(F.least(0.3 + (1 - F.col("agreement")) * 0.3 + F.col("k") * 0.2, F.lit(1.0)), 6))
    score = F.round(F.col("confidence") * 0.5 + F.col("agreement") * 0.3 + F.col("strength") * 0.2, 6)
    return got.where(F.col("confidence") >= least).select("seq", "type", "lo", "hi", "confidence", "agreement", F.round("strength", 6).alias("strength"), "doubt", "detected_by", detect.risk(score).alias("risk"))


def validated(found: DataFrame) -> DataFrame:
    """Fused detections with the mended confidence, likelihood of a false positive and risk of a second look.

    The look is at the span itself: its share of agreeing detectors is the score, its length the number of instructions.
    """
    size, look = F.col("hi") - F.col("lo") + 1, F.col("agreement")
    complexity = F.col("strength")
    mended = (F.col("confidence") * 0.6 + look * 0.4) * F.when(size < 10, 0.8).otherwise(1.0) * F.when(complexity > 0.5, 1.1).when(complexity < 0.2, 0.7).otherwise(1.0)
    mended = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mended)), 6)
    doubt = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - look + F.when(F.col("doubt") > 0.5, 0.1).otherwise(0.0))), 6)
    return found.select("seq", "type", "lo", "hi", mended.alias("mended"), doubt.alias("fp"), adjusted_risk(mended, doubt).alias("risk"))


def consensus_full(votes: DataFrame) -> DataFrame:
    """(id, exploitable, level, fp): the consensus of votes with its likelihood of a false positive, 0.9 without any vote."""
    given = F.array_compact(F.array("v1", "v2", "v3"))
    share = F.when(F.size(given) > 0, F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / F.size(given))
    level = F.when(share >= 0.8, "HIGH").when(share >= 0.6, "MEDIUM").otherwise("LOW")
    return votes.select("id", F.coalesce(share >= 0.5, F.lit(False)).alias("exploitable"), level.alias("level"), F.round(F.coalesce(1 - share, F.lit(0.9)), 6).alias("fp"))


def union_ranked(parts: list[DataFrame], least: dict[str, float]) -> DataFrame:
    """Detections of several methods, one a span (the most confident, then the first type and method), over their type's least confidence, ranked within a sequence."""
    every = reduce(DataFrame.unionByName, parts).withColumn("confidence", F.round("confidence", 6))
    one = Window.partitionBy("seq", "lo", "hi").orderBy(F.col("confidence").desc(), "type", "detector")
    floor = F.coalesce(*(F.when(F.col("type") == k, F.lit(v)) for k, v in least.items()), F.lit(0.5))
    kept = every.withColumn("nth", F.row_number().over(one)).where((F.col("nth") == 1) & (F.col("confidence") >= floor))
    order = Window.partitionBy("seq").orderBy(F.col("confidence").desc(), "lo", "hi", "type")
    return kept.withColumn("rank", F.row_number().over(order)).select("seq", "lo", "hi", "type", "detector", "confidence", "rank")


#: Defaults of our own, a gadget table: required features, opcode patterns, opcodes against, least instructions.
GADGETS = (
    ("SPECTRE_V1", ("has_bounds_check", "has_cond_branch_then_load"), ("bounds_cmp", "index_mask"), ("lfence",), 5),
    ("L1TF", ("l1tf_flush_then_access", "has_timing"), ("cache_timing", "tlb"), (), 8),
    ("MDS", ("has_cache_flush", "has_fence"), ("fill_buffer", "verw"), ("bounds_check",), 6),
    ("RETBLEED", ("has_deep_call_pattern", "retbleed_unbalanced_ret"), ("leave_ret", "rsb_flush"), (), 0),
    ("INCEPTION", ("inception_btb_pollution", "inception_phantom_window"), ("return_control",), (), 0),
)


def classified(found: DataFrame, gadgets: tuple = GADGETS) -> DataFrame:
    """(seq, lo, type, score): .4 requirements (half off for each missing one, 0 at least), .4 patterns, .2 context, less .2 for each thing against; the first best type."""
    flag = lambda name: F.col("text").rlike(features.text_pattern(name)).cast("int")
    each = []
    for name, needs, patterns, against, least in gadgets:
        semantic = F.greatest(F.lit(0.0), sum((F.when(F.col(k) == 1, 1.0).otherwise(-0.5) for k in needs), F.lit(0.0)) / len(needs))
        pattern = sum((flag(p) for p in patterns), F.lit(0)) / len(patterns)
        context = F.when(F.col("n") < least, 0.5).otherwise(1.0)
        anti = sum((flag(p) for p in against), F.lit(0)) * 0.2
        each.append(F.struct(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), semantic * 0.4 + pattern * 0.4 + context * 0.2 - anti)), 6).alias("score"), F.lit(-len(each)).alias("o"), F.lit(name).alias("type")))
    best = F.array_max(F.array(*each))
    return found.select(*KEY, best["type"].alias("type"), best["score"].alias("score"))


def keyword_classes(lines: DataFrame) -> DataFrame:
    """(seq, lo, type, score): a class's keywords, 1 for an opcode, 0.5 for a mention, over their number, a fifth more beyond two, 1 at most; classes of 0.2 and more."""
    rows = lines.select(*KEY, "line", features.opcode(F.col("line")).alias("op"))
    whole = rows.groupBy(*KEY).agg(F.collect_set("op").alias("ops"), F.array_join(F.collect_set(F.lower("line")), "\n").alias("text"))
    each = []
    for name, words in KEYWORDS:
        hits = [F.when(F.array_contains("ops", w), 1.0).when(F.contains("text", F.lit(w)), 0.5).otherwise(0.0) for w in words]
        n = sum((F.when(h > 0, 1).otherwise(0) for h in hits), F.lit(0))
        each.append(F.struct(F.lit(name).alias("type"), F.round(F.least(F.lit(1.0), sum(hits, F.lit(0.0)) / len(words) * F.when(n > 2, 1.2).otherwise(1.0)), 6).alias("score")))
    return whole.select(*KEY, F.explode(F.array(*each)).alias("k")).select(*KEY, "k.type", "k.score").where("score >= 0.2")


#: Defaults of our own, a keyword table.
KEYWORDS = (("CACHE", ("clflush", "mfence", "rdtsc", "dc")), ("BRANCH", ("cmp", "b.hs", "jae", "ldr")), ("CALL", ("call", "bl", "ret", "leave")))


def soft_vote(found: DataFrame) -> DataFrame:
    """(seq, lo, said, share): two models' class shares, .6 and .4, averaged; the largest, then the first name.

    The first model is the class scores over their sum, the second their squares over theirs.
    """
    names = list(CLASS_SCORES)
    total = sum((F.col(c) for c in names), F.lit(0.0))
    square = sum((F.col(c) * F.col(c) for c in names), F.lit(0.0))
    each = [F.struct(F.round(F.when(total > 0, F.col(c) / total * 0.6 + F.col(c) * F.col(c) / square * 0.4).otherwise(0.0), 6).alias("share"), F.lit(-k).alias("o"), F.lit(c).alias("said")) for k, c in enumerate(names)]
    best = F.array_max(F.array(*each))
    return found.select(*KEY, best["said"].alias("said"), best["share"].alias("share"))


def heat_map(found: DataFrame) -> DataFrame:
    """(kind, <score>): the mean of each class score by class, here the listing's number modulo 4, over the largest mean of its column."""
    means = found.groupBy((F.col("seq") % 4).alias("kind")).agg(*(F.avg(c).alias(c) for c in CLASS_SCORES))  # a row a class
    top = means.agg(*(F.max(c).alias(f"top_{c}") for c in CLASS_SCORES))  # one row
    return means.crossJoin(F.broadcast(top)).select("kind", *(F.round(F.when(F.col(f"top_{c}") > 0, F.col(c) / F.col(f"top_{c}")).otherwise(0.0), 5).alias(c) for c in CLASS_SCORES))


def group_labels(found: DataFrame) -> DataFrame:
    """(seq, type, confidence): each group's label of the largest confidence, the first one in order of place."""
    best = F.max_by(F.struct("type", "confidence"), F.struct("confidence", -F.col("lo"), -F.col("hi")))
    return found.groupBy("seq").agg(best.alias("b")).select("seq", "b.type", "b.confidence")


def span_lines(spans: DataFrame, rows: DataFrame, stretch: int = 64) -> DataFrame:
    """(seq, lo, hi, lines, ops): how many rows each span holds and how many distinct operations, spans without a row left out.

    A span of any length is cut at multiples of ``stretch``: whole stretches meet a table of counts and sets by stretch, the
    places of the two rests, fewer than ``2 * stretch``, meet rows by equality. Null ends hold nothing; spans count once.
    """
    each = spans.select("seq", "lo", "hi").distinct().where("hi >= lo")
    first, last = F.ceil(F.col("lo") / stretch), F.floor((F.col("hi") + 1) / stretch) - 1  # the whole stretches
    each = each.withColumns({"first": first, "last": last}).withColumn("whole", F.col("last") >= F.col("first"))
    none = F.array().cast("array<bigint>")
    to = lambda a, b: F.when(b >= a, F.sequence(a.cast("long"), b.cast("long"))).otherwise(none)
    lo, hi = F.col("lo"), F.col("hi")
    rest = F.when(F.col("whole"), F.concat(to(lo, F.col("first") * stretch - 1), to((F.col("last") + 1) * stretch, hi))).otherwise(to(lo, hi))
    inner = each.where("whole").select("seq", "lo", "hi", F.explode(to(F.col("first"), F.col("last"))).alias("part"))
    parts = rows.groupBy("seq", F.floor(F.col("pos") / stretch).alias("part")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("op")).alias("ops"))
    outer = each.select("seq", "lo", "hi", F.explode(rest).alias("pos")).join(rows.select("seq", "pos", F.lit(1).cast("long").alias("n"), F.array_compact(F.array("op")).alias("ops")), ["seq", "pos"])
    met = inner.join(parts, ["seq", "part"]).select("seq", "lo", "hi", "n", "ops").unionByName(outer.select("seq", "lo", "hi", "n", "ops"))
    distinct = F.size(F.array_distinct(F.flatten(F.collect_set("ops")))).cast("long")
    return met.groupBy("seq", "lo", "hi").agg(F.sum("n").alias("lines"), distinct.alias("ops"))


def vocabulary_ids(tokens: DataFrame, least: int = 2, offset: int = 2) -> DataFrame:
    """(token, n, id): tokens found ``least`` times, numbered by name from ``offset``: counts of first letters, then places within them."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("part", F.substring("token", 1, 2))
    sizes = counts.groupBy("part").agg(F.count("*").alias("c"))
    bases = sizes.select("part", (F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("base"))  # a row for two letters
    own = F.row_number().over(Window.partitionBy("part").orderBy("token")) - 1
    return counts.withColumn("own", own).join(bases, "part").select("token", "n", (F.col("base") + F.col("own") + offset).alias("id"))


def ensemble_top(found: DataFrame, most: int = 10) -> DataFrame:
    """(seq, lo, hi, type, confidence, strength, agreement): fused detections by these three, largest first, without those that overlap a better one of their type by half; ``most`` a sequence."""
    keys = ("confidence", "strength", "agreement")
    return detect.suppressed(found.select("seq", "lo", "hi", "type", *keys), most=most, keys=keys, same_type=True)


def _fused(s, d):
    return fused(detector_rows(instructions(s, d)))


QUERIES = {
    "gadget_classes": lambda s, d: classified(features.profiles(code_windows(s, d))),
    "keyword_classes": lambda s, d: keyword_classes(code_windows(s, d)),
    "ensemble_fusion": _fused,
    "ensemble_top": lambda s, d: ensemble_top(_fused(s, d)),
    "validated_detections": lambda s, d: validated(_fused(s, d)),
    "consensus_full": lambda s, d: consensus_full(detect.votes(s, d)),
    "union_ranked": lambda s, d: union_ranked([detector_rows(instructions(s, d)).where(F.col("detector") == m).select("seq", "lo", "hi", "type", "detector", "confidence") for m in ("robust", "semantic")], LEAST),
    "soft_vote": lambda s, d: soft_vote(features.profiles(code_windows(s, d))),
    "heat_map": lambda s, d: heat_map(features.profiles(code_windows(s, d))),
    "group_max_label": lambda s, d: group_labels(detect.detections(instructions(s, d))),
    "type_means": lambda s, d: _fused(s, d).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 5).alias("confidence"), F.round(F.avg("doubt"), 5).alias("fp")),
    "span_lines": lambda s, d: span_lines(detect.detections(instructions(s, d)), instructions(s, d)),
    "vocabulary_ids": lambda s, d: vocabulary_ids(code(s, d).select(features.opcode(F.col("line")).alias("token"))),
    "detection_scan": lambda s, d: detect.best_spans(detect.detections(instructions(s, d))).where("confidence >= 0.5").orderBy(F.col("confidence").desc(), "seq", "lo", "hi"),
}
_N = lambda op: f"len(list_filter(ops, lambda x: x = '{op}'))"
_DET2 = f"""{detect._DET}, sw AS (SELECT seq, lo, hi, ops FROM w WHERE {_N(LOAD)} >= 3),
  al AS (SELECT seq, type, lo, hi, 'robust' AS detector, confidence, 0.0 AS code, confidence / 2 AS anomaly, 2 AS evidence, 0 AS penalty FROM det
    UNION ALL SELECT seq, CASE WHEN {_N(RET)} > {_N(STORE)} THEN 'RETURN' ELSE 'LOAD_CHAIN' END, lo, hi, 'semantic', least(1.0, {_N(LOAD)} * 0.15), {_N(STORE)} * 0.1, 0, {_N(LOAD)}, ({_N(FENCE)} > 1)::INT FROM sw)"""
_FUSED = f"""{_DET2}, g AS (SELECT seq, type, lo, hi, coalesce(max(confidence) FILTER (detector = 'robust'), 0)::DOUBLE AS r, coalesce(max(confidence) FILTER (detector = 'semantic'), 0)::DOUBLE AS s, coalesce(max(code) FILTER (detector = 'semantic'), 0)::DOUBLE AS p,
    coalesce(max(anomaly) FILTER (detector = 'robust'), 0)::DOUBLE AS a, count(DISTINCT detector) / 2 AS agreement, least(sum(evidence) / 10, 1) AS strength, sum(penalty)::DOUBLE AS k, string_agg(detector, ',' ORDER BY detector) AS detected_by FROM al GROUP BY ALL),
  h AS (SELECT *, round(r * 0.4::DOUBLE + s * 0.35::DOUBLE + p * 0.15::DOUBLE + a * 0.1::DOUBLE, 6) AS confidence, round(least(0.3::DOUBLE + (1 - agreement) * 0.3::DOUBLE + k * 0.2::DOUBLE, 1), 6) AS doubt FROM g),
  x AS (SELECT *, round(confidence * 0.5::DOUBLE + agreement * 0.3::DOUBLE + strength * 0.2::DOUBLE, 6) AS z FROM h WHERE confidence >= 0.4),
  fu AS (SELECT seq, type, lo, hi, confidence, agreement, round(strength, 6) AS strength, doubt, detected_by, CASE WHEN z >= 0.8 THEN 'CRITICAL' WHEN z >= 0.6 THEN 'HIGH' WHEN z >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM x)"""
_S = features._SCORED


def _gadget_sql() -> str:
    parts = []
    for k, (name, needs, patterns, against, least) in enumerate(GADGETS):
        met = " + ".join(f"CASE WHEN {n} = 1 THEN 1 ELSE -0.5::DOUBLE END" for n in needs)
        hit = lambda names: " + ".join(f"regexp_matches(text, '{features.fixed.TEXT_PATTERNS[p]}')::INT" for p in names) or "0"
        parts.append(f"SELECT seq, lo, {k} AS o, '{name}' AS type, round(greatest(0::DOUBLE, least(1::DOUBLE, greatest(0, ({met}) / {len(needs)}) * 0.4::DOUBLE + ({hit(patterns)}) / {len(patterns)} * 0.4::DOUBLE + CASE WHEN n < {least} THEN 0.5::DOUBLE ELSE 1 END * 0.2::DOUBLE - ({hit(against)}) * 0.2::DOUBLE)), 6) AS score FROM t")
    return f"{_S}, t AS (SELECT z.*, w.text, w.n FROM z JOIN w USING (seq, lo)), u AS ({' UNION ALL '.join(parts)}) SELECT DISTINCT ON (seq, lo) seq, lo, type, score FROM u ORDER BY seq, lo, score DESC, o"


def _keyword_sql() -> str:
    rows = ", ".join(f"('{name}', '{w}', {len(words)})" for name, words in KEYWORDS for w in words)
    return f"""{features._F}, k(type, word, many) AS (VALUES {rows}), h AS (SELECT w.seq, w.lo, type, any_value(many) AS many, sum(CASE WHEN o THEN 1 WHEN m THEN 0.5::DOUBLE ELSE 0 END) AS s, count(*) FILTER (o OR m) AS n
      FROM (SELECT w.seq, w.lo, k.type, k.many, EXISTS (SELECT 1 FROM f WHERE f.seq = w.seq AND f.lo = w.lo AND f.op = k.word) AS o, contains(w.text, k.word) AS m FROM w, k) w GROUP BY ALL),
      r AS (SELECT seq, lo, type, round(least(1::DOUBLE, s / many * CASE WHEN n > 2 THEN 1.2::DOUBLE ELSE 1 END), 6) AS score FROM h) SELECT * FROM r WHERE score >= 0.2"""


_SHARES = " UNION ALL ".join(f"SELECT seq, lo, {k} AS o, '{c}' AS said, CASE WHEN t > 0 THEN round({c} / t * 0.6::DOUBLE + {c} * {c} / q * 0.4::DOUBLE, 6) ELSE 0 END AS share FROM y" for k, c in enumerate(CLASS_SCORES))
ORACLES = {
    "gadget_classes": _gadget_sql(),
    "keyword_classes": _keyword_sql(),
    "ensemble_fusion": f"{_FUSED} SELECT * FROM fu",
    "validated_detections": f"""{_FUSED}, m AS (SELECT *, (confidence * 0.6::DOUBLE + agreement * 0.4::DOUBLE) * CASE WHEN hi - lo + 1 < 10 THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN strength > 0.5 THEN 1.1::DOUBLE WHEN strength < 0.2 THEN 0.7::DOUBLE ELSE 1 END AS c FROM fu),
      v AS (SELECT seq, type, lo, hi, round(greatest(0, least(1, c)), 6) AS mended, round(greatest(0, least(1, 1 - agreement + CASE WHEN doubt > 0.5 THEN 0.1::DOUBLE ELSE 0 END)), 6) AS fp FROM m)
      SELECT *, CASE WHEN mended * (1 - fp) >= 0.85 THEN 'CRITICAL' WHEN mended * (1 - fp) >= 0.75 THEN 'HIGH' WHEN mended * (1 - fp) >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM v""",
    "consensus_full": f"""{detect._VOTES}, c AS (SELECT id, list_avg(list_filter([v1, v2, v3], lambda x: x IS NOT NULL)) AS share FROM v)
      SELECT id, coalesce(share >= 0.5, false) AS exploitable, CASE WHEN share >= 0.8 THEN 'HIGH' WHEN share >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS level, round(coalesce(1 - share, 0.9), 6) AS fp FROM c""",
    "union_ranked": f"""{_DET2}, rd AS (SELECT seq, lo, hi, type, detector, round(confidence, 6) AS confidence FROM al), o AS (SELECT DISTINCT ON (seq, lo, hi) * FROM rd ORDER BY seq, lo, hi, confidence DESC, type, detector)
      SELECT *, row_number() OVER (PARTITION BY seq ORDER BY confidence DESC, lo, hi, type)::INT AS rank FROM o WHERE confidence >= CASE type WHEN 'LOAD_CHAIN' THEN 0.7 WHEN 'RETURN' THEN 0.6 ELSE 0.65 END""",
    "soft_vote": f"{_S}, y AS (SELECT *, {' + '.join(CLASS_SCORES)} AS t, {' + '.join(f'{c} * {c}' for c in CLASS_SCORES)} AS q FROM z), u AS ({_SHARES}) SELECT DISTINCT ON (seq, lo) seq, lo, said, share FROM u ORDER BY seq, lo, share DESC, o",
    "heat_map": f"{_S}, m AS (SELECT seq % 4 AS kind, {', '.join(f'avg({c}) AS {c}' for c in CLASS_SCORES)} FROM z GROUP BY 1) SELECT kind, {', '.join(f'round(coalesce({c} / nullif(max({c}) OVER (), 0), 0), 5) AS {c}' for c in CLASS_SCORES)} FROM m",
    "group_max_label": f"{detect._DET} SELECT DISTINCT ON (seq) seq, type, confidence FROM det ORDER BY seq, confidence DESC, lo, hi, type DESC",
    "type_means": f"{_FUSED} SELECT type, count(*) AS n, round(avg(confidence), 5) AS confidence, round(avg(doubt), 5) AS fp FROM fu GROUP BY type",
    "span_lines": f"{detect._DET}, sp AS (SELECT DISTINCT seq, lo, hi FROM det) SELECT sp.seq, lo, hi, count(*) AS lines, count(DISTINCT op) AS ops FROM sp JOIN ev ON ev.seq = sp.seq AND pos BETWEEN lo AND hi GROUP BY ALL",
    "vocabulary_ids": rf"""WITH {CODE}, t AS (SELECT replace(lower(regexp_extract(line, '^\s*(\S+)', 1)), ',', '') AS token, count(*) AS n FROM co GROUP BY 1 HAVING count(*) >= 2) SELECT token, n, row_number() OVER (ORDER BY token) + 1 AS id FROM t""",
    "detection_scan": f"{detect._DET}, b AS (SELECT DISTINCT ON (seq, lo, hi) * FROM det ORDER BY seq, lo, hi, confidence DESC, type) SELECT * FROM b WHERE confidence >= 0.5 ORDER BY confidence DESC, seq, lo, hi",
}
