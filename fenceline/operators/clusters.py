"""Exact cosine join of sparse vectors and greedy clusters of alike ones.

The join is a prefix filter: with terms in order of how many vectors hold them, a vector's prefix ends where what is left of it
is shorter than a share of the threshold. The prefixes' product and the longer rest bound a cosine by Cauchy-Schwarz, so pairs
that share a few rare terms, or only common ones, are no candidates. Prefixes are compared in numpy, group by group in a grid,
and only pairs that pass become rows, which are computed whole. The time is in the pairs of prefixes that share a rare term,
quadratic for a fixed vocabulary; memory is two groups a task.

Clusters follow the sequential rule: vectors are taken in their order, one that is like no leader before it is a leader, and a leader's
cluster is itself with all later vectors like it. It is done in rounds: whoever has no undecided neighbour before it decides.
Vectors alike in all terms are one class before anything else, whatever their number.

Defined results: a vector without terms is like nothing. Null terms count as empty ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.plans.steps import settled

#: Similarities are rounded to so many places, and compared so.
PLACES = 5
#: What a prefix may leave, of the threshold: less makes fewer candidates of longer prefixes.
REST = 0.75
#: The most vectors of a group; two groups are in a task's memory.
GROUP = 65536


def unit_vectors(counts: DataFrame, key: str = "id", weight: str | None = None) -> DataFrame:
    """(key, term, w): smoothed TF-IDF of (key, term, tf), of length 1. ``weight`` names a column with the number of rows that a key stands for."""
    rows = counts.withColumn("times", F.col(weight) if weight else F.lit(1))
    total = rows.select(key, "times").distinct().agg(F.sum("times").alias("n"))  # one row
    idf = rows.groupBy("term").agg(F.sum("times").alias("df")).crossJoin(F.broadcast(total)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weights = rows.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def _prefixes(unit: DataFrame, least: float, key: str) -> DataFrame:
    """(key, nid, rest, terms, ws): of each vector its terms, rarest first, up to where what is left is shorter than ``REST`` of the threshold; terms are numbers."""
    words = settled(unit.groupBy("term").agg(F.count("*").alias("df")).withColumn("tid", F.monotonically_increasing_id()))
    order = Window.partitionBy(key).orderBy("df", "tid")
    ranked = unit.join(words, "term").withColumn("left", 1 - F.coalesce(F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    prefix = ranked.where(F.col("left") >= (REST * (least - 10.0**-PLACES)) ** 2)
    shared = F.sort_array(F.collect_list(F.when(F.col("df") > 1, F.struct("tid", F.col("w").cast("float").alias("w")))))  # a term of one vector meets nothing
    rows = prefix.groupBy(key).agg(F.sqrt(F.greatest(F.lit(0.0), F.min(F.col("left") - F.col("w") * F.col("w")))).alias("rest"), shared.alias("s"))
    return settled(rows.where(F.size("s") > 0).select(key, F.monotonically_increasing_id().alias("nid"), "rest", F.col("s.tid").alias("terms"), F.col("s.w").alias("ws")))


def _block_pairs(least: float):
    """Of two groups of prefixes: the pairs (x, y) of their numbers, x from the first and smaller where the groups are one, that may reach ``least``."""

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            (n, rest, terms, ws, sizes), (m, other, into, vs, many) = map(_arrays, (left, right))
            sought, stated = (t["known"].to_numpy(zero_copy_only=False).astype(bool) for t in (left, right))
            same = left["g"][0].as_py() == right["g"][0].as_py()
            names, into = np.unique(into, return_inverse=True)  # the right group's terms, by place
            order = np.argsort(into, kind="stable")
            rows, vs = np.repeat(np.arange(len(m)), many)[order], vs[order]
            begin = np.searchsorted(into[order], np.arange(len(names) + 1))
            at = np.minimum(np.searchsorted(names, terms), len(names) - 1)
            known, ends = names[at] == terms, np.cumsum(sizes)
            for i, end in enumerate(ends):
                own = slice(end - sizes[i], end)
                lists = [(begin[a], begin[a + 1], w) for a, w, k in zip(at[own], ws[own], known[own], strict=True) if k]
                if not lists:
                    continue
                dot = np.bincount(np.concatenate([rows[a:b] for a, b, _ in lists]), np.concatenate([vs[a:b] * w for a, b, w in lists]), len(m))
                hit = np.flatnonzero((dot > 0) & (dot + np.maximum(other, rest[i]) >= least) & (stated | sought[i]))
                hit = m[hit][m[hit] > n[i]] if same else m[hit]
                xs.append(np.full(len(hit), n[i]))
                ys.append(hit)
        return pa.table({"x": np.concatenate(xs), "y": np.concatenate(ys)})

    return found


def _arrays(rows: pa.Table) -> tuple[np.ndarray, ...]:
    terms, ws = (rows[c].combine_chunks() for c in ("terms", "ws"))
    return rows["nid"].to_numpy(), rows["rest"].to_numpy(), terms.flatten().to_numpy(), ws.flatten().to_numpy().astype(float), terms.value_lengths().to_numpy()


def candidates(unit: DataFrame, least: float, key: str = "id", known: Column | None = None) -> DataFrame:
    """(a, b): pairs of keys, a < b, whose cosine may reach ``least``; one of them is ``known``, where that is given.

    Prefixes meet in a grid of groups, so a row is shuffled once for each group and no shared term makes a row. Weights are floats there, with a margin for it.
    """
    rows = _prefixes(unit, least, key).withColumn("known", F.lit(True) if known is None else known)
    n = rows.count()
    groups = max(-(-n // GROUP), min(8, -(-n // 1024)), 1)
    own = rows.select("nid", "rest", "terms", "ws", "known", F.pmod(F.hash("nid"), F.lit(groups)).alias("g"))
    to = lambda a, b: F.explode(F.sequence(a, b))
    left = own.withColumn("h", to(F.col("g"), F.lit(groups - 1))).withColumn("f", F.col("g"))
    right = own.withColumn("f", to(F.lit(0), F.col("g"))).withColumn("h", F.col("g"))
    met = left.groupBy("f", "h").cogroup(right.groupBy("f", "h")).applyInArrow(_block_pairs(least - 2 * 10.0**-PLACES), "x long, y long")
    name = lambda n, k: rows.select(F.col("nid").alias(n), F.col(key).alias(k))
    both = settled(met).join(name("x", "p"), "x").join(name("y", "q"), "y")
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def similar(unit: DataFrame, least: float, key: str = "id", known: Column | None = None) -> DataFrame:
    """(a, b, cosine): all pairs of keys, a < b, with a cosine of ``least`` and more; with a ``known`` one, where that is given."""
    pairs = candidates(unit, least, key, known)
    left = pairs.join(unit.select(F.col(key).alias("a"), "term", F.col("w").alias("v")), "a")
    both = left.join(unit.select(F.col(key).alias("b"), "term", "w"), ["b", "term"])
    return both.groupBy("a", "b").agg(F.round(F.sum(F.col("v") * F.col("w")), PLACES).alias("cosine")).where(F.col("cosine") >= least)


def leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): the leaders among ``nodes`` (id) by the sequential rule, given ``edges`` (a, b), a < b."""
    open_, edges, found = settled(nodes.select("id")), settled(edges.select("a", "b")), None
    while not open_.isEmpty():
        waiting = edges.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        new = settled(open_.join(waiting, "id", "left_anti"))
        led = edges.join(new.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        found = new if found is None else found.union(new)
        open_ = settled(open_.join(new, "id", "left_anti").join(led, "id", "left_anti"))
    return nodes.select("id") if found is None else found


def classes(lists: DataFrame, terms: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``lists`` (id, ``terms``) with their class, and the classes (class, id, times, terms): rows alike in all terms, whatever their order, by their first id."""
    rows = lists.select("id", F.transform(terms, lambda t: F.coalesce(t, F.lit(""))).alias("terms")).where(F.size("terms") > 0)
    rows = settled(rows.withColumn("class", F.sha2(F.to_json(F.array_sort("terms")), 256)))
    return rows, rows.groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("times"), F.first("terms").alias("terms"))


def class_pairs(found: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine): all pairs of ``classes`` with a cosine of ``least`` and more; copies count in the frequencies of terms and make no pairs."""
    counts = found.select("id", "times", F.explode("terms").alias("term")).groupBy("id", "times", "term").agg(F.count("*").alias("tf"))
    return similar(settled(unit_vectors(counts, weight="times")), least)


def clustered(lists: DataFrame, terms: str, least: float = 0.7) -> DataFrame:
    """(leader, member): the clusters of the rows of ``lists`` (id, ``terms``, an array with repeats), leaders with themselves among their members.

    Ids are ordered and unique. A member that is like several leaders is in each of their clusters.
    """
    rows, found = classes(lists, terms)
    edges = settled(class_pairs(found, least))
    firsts = found.select("class", "id")
    top = leaders(firsts, edges)
    of = edges.join(top.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("a").alias("leader"), F.col("b").alias("first"))
    back = edges.join(top.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("b").alias("leader"), F.col("a").alias("first"))  # later copies of an earlier class
    own = top.select(F.col("id").alias("leader"), F.col("id").alias("first"))
    members = rows.select(F.col("id").alias("member"), "class").join(firsts.withColumnRenamed("id", "first"), "class").select("member", "first")
    return of.union(back).union(own).join(members, "first").where(F.col("member") >= F.col("leader")).select("leader", "member")
