"""Similarity of windows of assembly lines to a signature library: n-gram, alignment, graph, semantic, TF-IDF and profile measures.

The library is the first windows of every tenth listing, so it grows with the listings and is never broadcast whole;
windows stream past blocks of it and pairs come from the postings of shared 3-grams (``library``), so that only results are rows. They are
as many as windows times signatures for a fixed set of opcodes; the ranking by all five measures has a bound instead (``bounds``). Cosines with
a threshold come from exact prefix filters, there for the library and in ``clusters`` for all pairs. A window is (seq, lo); windows too short for an n-gram have
none; a null line counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.functions.instructions import opcode
from fenceline.functions.nodes import semantic_type
from fenceline.operators import alignment, bounds, clusters, library
from fenceline.plans.assembly_analog import WINDOWS, code_windows
from fenceline.plans.steps import settled

KEY, EVERY, NS = ("seq", "lo"), 10, (2, 3, 4, 5)
LIBRARY = 16  # more than the library of the smallest tables; the library has no limit
# How far from a branch its target is looked for, the types that may be one, and the weights of the combined score.
BRANCH_FROM, BRANCH_TO, BRANCH_TARGETS = 2, 9, ("LOAD", "STORE", "COMPUTE")
# The most pairs measured for a floor of the score, as times the rows wanted, and the most pairs whose numbers are broadcast.
FIRST, FEW = 20, 500_000
SCORE_WEIGHTS = {"ngram": 0.3, "alignment": 0.25, "lcs": 0.2, "graph": 0.15, "cosine": 0.1}


def grams(ops: Column, n: int) -> Column:
    """The distinct ``n``-grams of an array."""
    every = F.transform(F.sequence(F.lit(0), F.size(ops) - n), lambda i: F.array_join(F.slice(ops, i + 1, n), "::"))
    return F.array_distinct(F.when(F.size(ops) >= n, every).otherwise(F.array().cast("array<string>")))


def shapes(lines: DataFrame) -> DataFrame:
    """(seq, lo, arch, ops, kinds, edges, g2 ... g5): a window's opcodes, its sets of semantic types, of kinds of control edges, and of n-grams.

    Edges are ``sequential`` and, where a branch has a load, store or computation 2 to 9 lines on, ``branch``.
    """
    rows = lines.select(*KEY, "i", opcode(F.coalesce("line", F.lit(""))).alias("op"))
    whole = rows.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "op"))), lambda s: s["op"]).alias("ops"))
    return shaped(whole, *KEY, (F.col("seq") % 2).alias("arch"))


def shaped(whole: DataFrame, *keys: str | Column) -> DataFrame:
    """(keys, ops, kinds, edges, g2 ... g5) of a table with ``ops``."""
    whole = whole.withColumn("types", F.transform("ops", semantic_type))
    target = lambda i: F.exists(F.slice("types", i + BRANCH_FROM + 1, BRANCH_TO - BRANCH_FROM + 1), lambda t: t.isin(*BRANCH_TARGETS))
    branches = F.exists(F.sequence(F.lit(0), F.size("types") - 1), lambda i: (F.get("types", i) == "BRANCH") & target(i))
    edges = F.array_compact(F.array(F.when(F.size("types") > 1, "sequential"), F.when(branches, "branch")))
    return whole.select(*keys, "ops", F.array_distinct("types").alias("kinds"), edges.alias("edges"), *(grams(F.col("ops"), n).alias(f"g{n}") for n in NS))


def signatures(windows: DataFrame) -> DataFrame:
    """(s_seq): the listings whose first windows are the library."""
    return windows.where((F.col("lo") == 0) & (F.col("seq") % EVERY == 0)).select(F.col("seq").alias("s_seq"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def pairs(windows: DataFrame, work, schema: str, *lists: str, most: int = max(NS)) -> DataFrame:
    """(seq, lo, s_seq, and ``schema``): ``work`` of every window with every signature that shares an opcode 3-gram with it, but for itself; ``lists`` are the columns that it needs."""
    known = (F.col("lo") == 0) & (F.col("seq") % EVERY == 0)
    keys = ", ".join(f"{new} {windows.schema[c].dataType.simpleString()}" for new, c in (("seq", "seq"), ("lo", "lo"), ("s_seq", "seq")))
    own = lambda met: {c: met.key(c) for c in (*KEY, "s_seq")} | work(met)
    return library.met(windows.select(*KEY, "arch", *dict.fromkeys(("ops", *lists))), known, own, f"{keys}, {schema}", most)


#: What ``measured`` can have, and the lists that it takes.
MEASURES = {f"j{n}": ((lambda met, n=n: met.gram(n)), ()) for n in NS} | {"ngram": (lambda met: met.ngram(), ())}
MEASURES |= {"graph": (lambda met: met.graph(), ("kinds", "edges")), "semantic": (lambda met: met.jaccard("kinds"), ("kinds",)), "opcodes": (lambda met: met.jaccard("ops"), ())}


def measured(windows: DataFrame, *names: str) -> DataFrame:
    """(seq, lo, s_seq, arch, s_arch, j2 ... j5, ngram, graph, semantic, opcodes, or just those of ``names``): the measures of ``pairs``; n-grams weigh n."""
    names = names or tuple(MEASURES)
    work = lambda met: {c: met.key(c) for c in ("arch", "s_arch")} | {c: MEASURES[c][0](met) for c in names}
    arch = windows.schema["arch"].dataType.simpleString()
    most = max(NS) if any(c[0] == "j" or c == "ngram" for c in names) else library.SHARED
    return pairs(windows, work, f"arch {arch}, s_arch {arch}, {', '.join(f'{c} double' for c in names)}", *(x for c in names for x in MEASURES[c][1]), most=most)


def measures(out: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, j2 ... j5, ngram, graph, semantic and opcodes of pairs of shapes."""
    each = {n: jaccard(F.col(f"g{n}"), F.col(f"s_g{n}")) for n in NS}
    weighted = sum((F.col(f"j{n}") * n for n in NS[1:]), F.col(f"j{NS[0]}") * NS[0]) / sum(NS)
    graph = (jaccard(F.col("kinds"), F.col("s_kinds")) + jaccard(F.col("edges"), F.col("s_edges"))) / 2
    out = out.select(
        *keep, *(c.alias(f"j{n}") for n, c in each.items()), graph.alias("graph"), jaccard(F.col("kinds"), F.col("s_kinds")).alias("semantic"),
        jaccard(F.array_distinct("ops"), F.array_distinct("s_ops")).alias("opcodes"),
    )
    return out.withColumn("ngram", weighted)


def aligned(windows: DataFrame) -> DataFrame:
    """(seq, lo, s_seq, alignment, lcs): of the windows' and signatures' opcodes, for the pairs that share a 3-gram."""
    return pairs(windows, lambda met: dict(zip(("alignment", "lcs"), met.aligned(), strict=True)), "alignment double, lcs double", most=library.SHARED)


def ranked(windows: DataFrame, k: int = 100, least: float = 0.3) -> DataFrame:
    """(seq, lo, s_seq, <measures>, score): the ``k`` best of all pairs with a weighted sum of all five measures above ``least``.

    Windows of the same opcodes are one class, whatever their number. The ``k``-th score of pairs that share n-grams is a floor, and only
    pairs of classes whose vectors (``score_vectors``) have such a product are measured, so leaving the others out loses nothing.
    """
    windows = settled(windows.select(*KEY, "ops"))
    known = (F.col("lo") == 0) & (F.col("seq") % EVERY == 0)
    found = windows.groupBy("ops").agg(F.count("*").alias("times"), F.count(F.when(known, 1)).alias("sigs"))
    found = settled(found.withColumn("n", F.monotonically_increasing_id()))
    counts = found.select("n", "times", F.explode(terms()).alias("term")).groupBy("n", "times", "term").agg(F.count("*").alias("tf"))
    unit = settled(clusters.unit_vectors(counts, "n", "times"))
    rows = shaped(found, "n", "times", "sigs")
    first = scored(bounds.promising(rows, "g3", "g5").limit(FIRST * k), found, unit, least).orderBy(F.col("score").desc()).limit(k)
    scores = [r["score"] for r in first.select("score").collect()]  # k numbers
    floor = min(scores) if len(scores) == k else least
    sizes = found.agg(F.count("*"), F.count(F.when(F.col("sigs") > 0, 1))).first()
    best = scored(bounds.candidates(score_vectors(rows, unit), floor, *sizes), found, unit, least)
    return expanded(settled(best), windows, found, k)


def scored(pairs: DataFrame, found: DataFrame, unit: DataFrame, least: float) -> DataFrame:
    """(a, b, <measures>, score): of the ``pairs`` of classes, a window's and a signature's, those that have a row and a score above ``least``."""
    pairs = settled(pairs)
    ids = pairs.select(F.col("a").alias("n")).union(pairs.select(F.col("b").alias("n"))).distinct()
    ids = F.broadcast(ids) if pairs.count() <= FEW else ids
    rows, unit = shaped(found.join(ids, "n", "left_semi"), "n", "times"), unit.join(ids, "n", "left_semi")
    right = rows.select(F.col("n").alias("b"), *(F.col(c).alias(f"s_{c}") for c in ("ops", "kinds", "edges", *(f"g{n}" for n in NS))))
    both = pairs.join(rows.withColumnRenamed("n", "a"), "a").where("a <> b OR times > 1").join(right, "b")
    dots = pairs.join(unit.withColumnRenamed("n", "a"), "a").join(unit.select(F.col("n").alias("b"), "term", F.col("w").alias("v")), ["b", "term"])
    dots = dots.groupBy("a", "b").agg(F.round(F.sum(F.col("w") * F.col("v")), 5).alias("cosine"))
    out = alignment.aligned(measures(both, "a", "b", "ops", "s_ops"), "ops", "s_ops").join(dots, ["a", "b"], "left").fillna(0.0, ["cosine"])
    score = sum((F.col(c) * w for c, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    return out.select("a", "b", *SCORE_WEIGHTS, F.round(score, 6).alias("score")).where(F.col("score") > least)


def score_vectors(rows: DataFrame, unit: DataFrame) -> DataFrame:
    """(n, known, terms, ws): vectors of length 1 whose products are no less than the scores of ``ranked``.

    An alignment's blocks and a common subsequence are no more than the opcodes that two windows share, repeats among them; n + m over 2 and
    the larger of n and m are no less than the root of n m. A Jaccard is no more than the shared entries over the root of the sizes' product.
    So each measure is a product of two vectors, and its weight is the square of their length. Terms are hashes: equal ones of different terms make a product larger only.
    """
    times = F.transform("ops", lambda op, i: F.struct(op, F.size(F.filter(F.slice("ops", 1, i + 1), lambda o: o == op))))
    parts = [("ops", times, SCORE_WEIGHTS["alignment"] + SCORE_WEIGHTS["lcs"]), *((c, F.col(c), SCORE_WEIGHTS["graph"] / 2) for c in ("kinds", "edges"))]
    parts += [(f"g{n}", F.col(f"g{n}"), SCORE_WEIGHTS["ngram"] * n / sum(NS)) for n in NS]
    entry = lambda name, c, w: F.struct(F.xxhash64(F.lit(name), c).alias("t"), w.cast("float").alias("w"))

    def entries(name: str, column: Column, weight: float) -> Column:
        return F.transform(column, lambda x: entry(name, x, F.sqrt(F.lit(weight) / F.greatest(F.size(name), F.lit(1)))))

    own = F.concat(*(entries(*part) for part in parts))
    cosines = unit.groupBy("n").agg(F.collect_list(entry("term", F.col("term"), F.col("w") * SCORE_WEIGHTS["cosine"] ** 0.5)).alias("more"))
    every = rows.withColumn("own", own).join(cosines, "n").select("n", (F.col("sigs") > 0).alias("known"), F.concat("own", "more").alias("v"))
    return every.select("n", "known", F.col("v.t").alias("terms"), F.col("v.w").alias("ws"))


def expanded(best: DataFrame, windows: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of pairs of classes: of each class no more windows and signatures than could be among them."""
    top = best.orderBy(F.col("score").desc()).limit(k).agg(F.min("score").alias("last"))
    best = best.join(F.broadcast(top), F.col("score") >= F.col("last")).drop("last")
    used = best.select(F.col("a").alias("n")).union(best.select(F.col("b").alias("n"))).distinct()
    own = windows.select(*KEY, "ops").join(found.join(used, "n", "left_semi").select("n", "ops", "sigs"), "ops").drop("ops")
    of = lambda rows, *order: rows.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(*order))).where(F.col("rank") <= k + 1)
    signs = of(own.where((F.col("lo") == 0) & (F.col("seq") % EVERY == 0)), "seq").select(F.col("n").alias("b"), F.col("seq").alias("s_seq"), F.col("sigs").alias("many"))
    each = best.join(of(own, *KEY).select(F.col("n").alias("a"), *KEY, "rank"), "a").join(signs, "b")
    each = each.where((F.col("rank") - 2) * F.least("many", F.lit(k)) <= k).where(~((F.col("lo") == 0) & (F.col("seq") == F.col("s_seq"))))
    each = each.orderBy(F.col("score").desc(), *KEY, "s_seq").limit(k)
    return each.select(*KEY, "s_seq", *(F.round(c, 6).alias(c) for c in SCORE_WEIGHTS), "score")


def combined(found: DataFrame, k: int = 100) -> DataFrame:
    """(seq, lo, s_seq, score): the ``k`` best pairs by .3 n-grams, .15 graph and .1 semantic, over the weights' sum, of those above 0.3."""
    score = F.round((F.col("ngram") * 0.3 + F.col("graph") * 0.15 + F.col("semantic") * 0.1) / 0.55, 6)
    return found.select(*KEY, "s_seq", score.alias("score")).where("score > 0.3").orderBy(F.col("score").desc(), *KEY, "s_seq").limit(k)


def terms(most: int = 3) -> Column:
    """All 1- to ``most``-grams of a window's opcodes, repeats among them."""
    every = lambda n: F.when(F.size("ops") >= n, F.transform(F.sequence(F.lit(0), F.size("ops") - n), lambda i: F.array_join(F.slice("ops", i + 1, n), "::"))).otherwise(F.array().cast("array<string>"))
    return F.concat(*(every(n) for n in range(1, most + 1)))


def weights(windows: DataFrame) -> DataFrame:
    """(id, term, w): TF-IDF vectors of 1- to 3-grams, an id a window."""
    counts = windows.select(F.struct(*KEY).alias("id"), F.explode(terms()).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return clusters.unit_vectors(counts)


def vectors(windows: DataFrame) -> DataFrame:
    """(seq, lo, terms, ws): the vectors of ``weights`` as a row a window."""
    counts = windows.select(*KEY, F.explode(terms()).alias("term")).groupBy(*KEY, "term").agg(F.count("*").alias("tf"))
    total = windows.where(F.size("ops") > 0).agg(F.count("*").alias("n"))  # one row
    idf = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    rows = counts.join(idf, "term").groupBy(*KEY).agg(F.collect_list(F.struct("term", (F.col("tf") * F.col("idf")).alias("w"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    return rows.withColumn("norm", norm).select(*KEY, F.col("v.term").alias("terms"), F.transform("v", lambda x: x["w"] / F.col("norm")).alias("ws"))


def close(windows: DataFrame, least: float = 0.5) -> DataFrame:
    """(seq, lo, s_seq, cosine): the rows of ``dots`` of ``least`` and more."""
    found = library.close(vectors(settled(windows.select(*KEY, "ops"))), (F.col("lo") == 0) & (F.col("seq") % EVERY == 0), least)
    return found.withColumn("cosine", F.round("cosine", 5)).where(F.col("cosine") >= least)


def dots(windows: DataFrame) -> DataFrame:
    """(seq, lo, s_seq, cosine): TF-IDF vectors of 1- to 3-grams, smoothed inverse frequencies, unit length: windows with the signatures that share a term."""
    unit = weights(windows).select("id.*", "term", "w")
    known = unit.where((F.col("lo") == 0) & (F.col("seq") % EVERY == 0)).select(F.col("seq").alias("s_seq"), "term", F.col("w").alias("v"))
    met = unit.join(known, "term").where(~((F.col("lo") == 0) & (F.col("seq") == F.col("s_seq"))))
    return met.groupBy(*KEY, "s_seq").agg(F.round(F.sum(F.col("w") * F.col("v")), 5).alias("cosine"))


def gadget_clusters(windows: DataFrame, least: float = 0.7) -> DataFrame:
    """(seq, lo, m_seq, m_lo): greedy clusters of windows by the cosine of their TF-IDF vectors of 1- and 2-grams: leader and member, lone windows with themselves."""
    found = clusters.clustered(windows.select(F.struct(*KEY).alias("id"), terms(2).alias("terms")), "terms", least)
    return found.select(F.col("leader.seq").alias("seq"), F.col("leader.lo").alias("lo"), F.col("member.seq").alias("m_seq"), F.col("member.lo").alias("m_lo"))


def similar_windows(windows: DataFrame, least: float = 0.7) -> DataFrame:
    """(seq, lo, t_seq, t_lo, cosine, copies, t_copies): all pairs of windows, an earlier and a later one, with a cosine of ``least`` and more.

    Windows of the same 1- and 2-grams are one, the first of them, with their number.
    """
    _, found = clusters.classes(windows.select(F.struct(*KEY).alias("id"), terms(2).alias("terms")), "terms")
    of = lambda k, name: found.select(F.col("id").alias(k), F.col("times").alias(name))
    both = clusters.class_pairs(found, least).join(of("a", "copies"), "a").join(of("b", "t_copies"), "b")
    return both.select("a.seq", "a.lo", F.col("b.seq").alias("t_seq"), F.col("b.lo").alias("t_lo"), "cosine", "copies", "t_copies")


def profiles(windows: DataFrame) -> DataFrame:
    """(kind, op, share): opcode frequencies of each class, here the listing's number modulo 4."""
    counts = windows.select((F.col("seq") % 4).alias("kind"), F.explode("ops").alias("op")).groupBy("kind", "op").agg(F.count("*").alias("c"))
    return counts.join(counts.groupBy("kind").agg(F.sum("c").alias("all")), "kind").select("kind", "op", (F.col("c") / F.col("all")).alias("share"))


def profile_cosine(windows: DataFrame, least: float = 0.8) -> DataFrame:
    """(seq, lo, kind, cosine): windows whose opcode counts are close to a class's frequencies."""
    own = windows.select(*KEY, F.explode("ops").alias("op")).groupBy(*KEY, "op").agg(F.count("*").cast("double").alias("c"))
    norm = own.groupBy(*KEY).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("a"))
    known = profiles(windows)
    size = known.groupBy("kind").agg(F.sqrt(F.sum(F.col("share") * F.col("share"))).alias("b"))
    dots = own.join(known, "op").groupBy(*KEY, "kind").agg(F.sum(F.col("c") * F.col("share")).alias("dot"))
    return dots.join(norm, list(KEY)).join(size, "kind").select(*KEY, "kind", F.round(F.col("dot") / (F.col("a") * F.col("b")), 5).alias("cosine")).where(F.col("cosine") > least)


def robust(found: DataFrame) -> DataFrame:
    """(seq, lo, s_seq, score): .3 n-grams, .2 semantic, .2 graph, .3 opcodes, within an architecture, of 0.3 and more."""
    score = F.round(F.col("ngram") * 0.3 + F.col("semantic") * 0.2 + F.col("graph") * 0.2 + F.col("opcodes") * 0.3, 6)
    return found.where(F.col("arch") == F.col("s_arch")).select(*KEY, "s_seq", score.alias("score")).where("score >= 0.3")


def bonuses(found: DataFrame) -> DataFrame:
    """(seq, lo, bonus): a fifth of the best opcode-set similarity to any signature of the same architecture."""
    return found.where(F.col("arch") == F.col("s_arch")).groupBy(*KEY).agg(F.round(F.max("opcodes") * 0.2, 6).alias("bonus"))


def fuzzy(windows: DataFrame) -> DataFrame:
    """(seq, lo, s_seq, score): 0.7 for each equal opcode and 0.3 for each other one of an equal semantic type, over the length; pairs of equal length."""
    found = pairs(windows.withColumn("types", F.transform("ops", semantic_type)), lambda met: {"score": met.fuzzy()}, "score double", "types", most=library.SHARED)
    return found.where(~F.isnan("score")).select(*KEY, "s_seq", F.round("score", 6).alias("score"))


def _of(work):
    return lambda s, d: work(shapes(code_windows(s, d)))


QUERIES = {
    "jaccard_pairs": _of(lambda w: measured(w, *(f"j{n}" for n in NS), "ngram").select(*KEY, "s_seq", *(F.round(f"j{n}", 6).alias(f"j{n}") for n in NS), F.round("ngram", 6).alias("ngram"))),
    "graph_similarity": _of(lambda w: measured(w, "graph").select(*KEY, "s_seq", F.round("graph", 6).alias("graph"))),
    "combined_rank": _of(lambda w: combined(measured(w, "ngram", "graph", "semantic"))),
    "tfidf_cosine": _of(close),
    "alignment_pairs": _of(lambda w: aligned(w).select(*KEY, "s_seq", F.round("alignment", 6).alias("alignment"), F.round("lcs", 6).alias("lcs"))),
    "candidate_rank": _of(ranked),
    "similar_windows": _of(similar_windows),
    "gadget_clusters": _of(gadget_clusters),
    "opcode_profiles": _of(lambda w: profiles(w).select("kind", "op", F.round("share", 6).alias("share"))),
    "profile_cosine": _of(profile_cosine),
    "robust_similarity": _of(lambda w: robust(measured(w, "ngram", "semantic", "graph", "opcodes"))),
    "reference_bonus": _of(lambda w: bonuses(measured(w, "opcodes"))),
    "fuzzy_match": _of(fuzzy),
}
_OPS = r"""op AS (SELECT seq, lo, i, replace(lower(regexp_extract(line, '^\s*(\S+)', 1)), ',', '') AS op FROM aw)"""


_LIB = f"lib AS (SELECT seq AS s FROM sh WHERE lo = 0 AND seq % {EVERY} = 0)"


def _head() -> str:
    from fenceline.operators.listings import _SEMTYPE

    return f"""WITH {WINDOWS}, {_OPS}, sh AS (SELECT seq, lo, list(op ORDER BY i) AS ops, list({_SEMTYPE} ORDER BY i) AS ks FROM op GROUP BY ALL),
      g AS (SELECT DISTINCT seq, lo, n, array_to_string(ops[i:i + n - 1], '::') AS gram FROM (SELECT seq, lo, ops, n, unnest(range(1, len(ops) - n + 2)) AS i FROM sh, range(2, 6) t(n))),
      {_LIB},
      pr AS (SELECT DISTINCT a.seq, a.lo, b.seq AS s_seq FROM g a JOIN g b ON a.n = 3 AND b.n = 3 AND a.gram = b.gram JOIN lib ON lib.s = b.seq AND b.lo = 0 WHERE NOT (a.lo = 0 AND a.seq = b.seq)),
      nc AS (SELECT seq, lo, n, count(*) AS c FROM g GROUP BY ALL), cc AS (SELECT pr.seq, pr.lo, s_seq, a.n, count(*) AS c FROM pr JOIN g a ON a.seq = pr.seq AND a.lo = pr.lo JOIN g b ON b.seq = s_seq AND b.lo = 0 AND a.n = b.n AND a.gram = b.gram GROUP BY ALL),
      jn AS (SELECT pr.seq, pr.lo, pr.s_seq, x.n, coalesce(cc.c, 0) / (x.c + y.c - coalesce(cc.c, 0)) AS j FROM pr JOIN nc x ON x.seq = pr.seq AND x.lo = pr.lo JOIN nc y ON y.seq = s_seq AND y.lo = 0 AND x.n = y.n
        LEFT JOIN cc ON cc.seq = pr.seq AND cc.lo = pr.lo AND cc.s_seq = pr.s_seq AND cc.n = x.n),
      je AS (SELECT seq, lo, s_seq, max(j) FILTER (n = 2) AS j2, max(j) FILTER (n = 3) AS j3, max(j) FILTER (n = 4) AS j4, max(j) FILTER (n = 5) AS j5, sum(j * n) / 14 AS ngram FROM jn GROUP BY ALL),
      ed AS (SELECT seq, lo, list_concat(CASE WHEN len(ks) > 1 THEN ['sequential'] ELSE [] END, CASE WHEN len(list_filter(range(1, len(ks) + 1), lambda i: ks[i] = 'BRANCH' AND list_has_any(ks[i + 2:i + 9], ['LOAD', 'STORE', 'COMPUTE']))) > 0 THEN ['branch'] ELSE [] END) AS es,
        list_distinct(ks) AS kinds, list_distinct(ops) AS os FROM sh),
      gs AS (SELECT pr.*, len(list_intersect(a.kinds, b.kinds)) / len(list_distinct(list_concat(a.kinds, b.kinds))) AS semantic, len(list_intersect(a.es, b.es)) / len(list_distinct(list_concat(a.es, b.es))) AS edges,
        len(list_intersect(a.os, b.os)) / len(list_distinct(list_concat(a.os, b.os))) AS opcodes FROM pr JOIN ed a ON a.seq = pr.seq AND a.lo = pr.lo JOIN ed b ON b.seq = s_seq AND b.lo = 0),
      ms AS (SELECT je.*, (semantic + edges) / 2 AS graph, semantic, opcodes FROM je JOIN gs USING (seq, lo, s_seq))"""


_TERMS = """WITH {w}, {o}, sh AS (SELECT seq, lo, list(op ORDER BY i) AS ops FROM op GROUP BY ALL),
  t AS (SELECT seq, lo, array_to_string(ops[i:i + n - 1], '::') AS term, count(*) AS tf FROM (SELECT seq, lo, ops, n, unnest(range(1, len(ops) - n + 2)) AS i FROM sh, range(1, 4) t(n)) GROUP BY ALL)"""
_T = _TERMS.format(w=WINDOWS, o=_OPS)
_UNIT = """n AS (SELECT count(*) AS n FROM sh), f AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM t GROUP BY term), w AS (SELECT seq, lo, term, tf * idf AS w FROM t JOIN f USING (term)),
      u AS (SELECT seq, lo, term, w / sqrt(sum(w * w) OVER (PARTITION BY seq, lo)) AS w FROM w)"""
ORACLES = {
    "jaccard_pairs": f"{_head()} SELECT seq, lo, s_seq, round(j2, 6) AS j2, round(j3, 6) AS j3, round(j4, 6) AS j4, round(j5, 6) AS j5, round(ngram, 6) AS ngram FROM je",
    "graph_similarity": f"{_head()} SELECT seq, lo, s_seq, round(graph, 6) AS graph FROM ms",
    "combined_rank": f"{_head()}, c AS (SELECT seq, lo, s_seq, round((ngram * 0.3 + graph * 0.15 + semantic * 0.1) / 0.55, 6) AS score FROM ms) SELECT * FROM c WHERE score > 0.3 ORDER BY score DESC, seq, lo, s_seq LIMIT 100",
    "robust_similarity": f"{_head()}, c AS (SELECT seq, lo, s_seq, round(ngram * 0.3 + semantic * 0.2 + graph * 0.2 + opcodes * 0.3, 6) AS score FROM ms WHERE seq % 2 = s_seq % 2) SELECT * FROM c WHERE score >= 0.3",
    "reference_bonus": f"{_head()} SELECT seq, lo, round(max(opcodes) * 0.2, 6) AS bonus FROM ms WHERE seq % 2 = s_seq % 2 GROUP BY ALL",
    "fuzzy_match": f"""{_head()}, p AS (SELECT pr.seq, pr.lo, s_seq, a.ops AS x, b.ops AS y, a.ks AS u, b.ks AS v FROM pr JOIN sh a ON a.seq = pr.seq AND a.lo = pr.lo JOIN sh b ON b.seq = s_seq AND b.lo = 0 WHERE len(a.ops) = len(b.ops))
      SELECT seq, lo, s_seq, round((len(list_filter(range(1, len(x) + 1), lambda i: x[i] = y[i])) * 0.7 + len(list_filter(range(1, len(x) + 1), lambda i: u[i] = v[i])) * 0.3) / len(x), 6) AS score FROM p""",
    "tfidf_cosine": f"""{_T}, {_LIB}, {_UNIT}, d AS (SELECT a.seq, a.lo, b.seq AS s_seq, round(sum(a.w * b.w), 5) AS cosine FROM u a JOIN u b ON a.term = b.term AND b.lo = 0 JOIN lib ON lib.s = b.seq WHERE NOT (a.lo = 0 AND a.seq = b.seq) GROUP BY ALL)
      SELECT * FROM d WHERE cosine >= 0.5""",
    "similar_windows": f"""{_T.replace("range(1, 4)", "range(1, 3)")}, {_UNIT}, bag AS (SELECT seq, lo, list(term || '*' || tf ORDER BY term) AS b FROM t GROUP BY ALL), one AS (SELECT min((seq, lo)) AS k, count(*) AS copies FROM bag GROUP BY b),
      v AS (SELECT u.*, copies FROM u JOIN one ON k = (seq, lo)), d AS (SELECT a.seq, a.lo, b.seq AS t_seq, b.lo AS t_lo, round(sum(a.w * b.w), 5) AS cosine, a.copies, b.copies AS t_copies FROM v a JOIN v b ON a.term = b.term AND (a.seq, a.lo) < (b.seq, b.lo) GROUP BY ALL)
      SELECT * FROM d WHERE cosine >= 0.7""",
    "opcode_profiles": f"WITH {WINDOWS}, {_OPS}, c AS (SELECT seq % 4 AS kind, op, count(*) AS c FROM op GROUP BY ALL) SELECT kind, op, round(c / sum(c) OVER (PARTITION BY kind), 6) AS share FROM c",
    "profile_cosine": f"""WITH {WINDOWS}, {_OPS}, c AS (SELECT seq % 4 AS kind, op, count(*) AS c FROM op GROUP BY ALL), p AS (SELECT kind, op, c / sum(c) OVER (PARTITION BY kind) AS share FROM c), o AS (SELECT seq, lo, op, count(*) AS c FROM op GROUP BY ALL),
      a AS (SELECT seq, lo, sqrt(sum(c * c)) AS a FROM o GROUP BY ALL), b AS (SELECT kind, sqrt(sum(share * share)) AS b FROM p GROUP BY ALL), d AS (SELECT seq, lo, kind, sum(c * share) AS dot FROM o JOIN p USING (op) GROUP BY ALL),
      r AS (SELECT seq, lo, kind, round(dot / (a * b), 5) AS cosine FROM d JOIN a USING (seq, lo) JOIN b USING (kind)) SELECT * FROM r WHERE cosine > 0.8""",
}
