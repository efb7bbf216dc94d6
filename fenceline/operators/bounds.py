"""Pairs of vectors that may reach a score, found by a product that bounds it.

All vectors meet the known ones in a grid of groups. Within a cell the terms that most known vectors hold are a matrix and its
product, the others are met by postings; only pairs that reach the floor become rows. The time is in all vectors times the known
ones, some nanoseconds a pair; memory is two groups a task, and the rows are as many as the floor lets through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most vectors and known vectors of a cell, the terms of its matrix, the cells of a product, and what float sums may lack.
ROWS, KNOWN, DENSE, CELLS, MARGIN = 32768, 32768, 256, 1 << 22, 1e-4


def promising(rows: DataFrame, *by: str) -> DataFrame:
    """(a, b): pairs of a row and a row with ``sigs``, those that meet most often first. Each entry of the arrays ``by`` brings its first and last such rows together only."""
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(F.lit(c), x))
    entries = F.concat(*map(hashed, by))
    known = F.when(F.col("sigs") > 0, F.col("n"))
    ends = rows.select("n", "sigs", F.explode(entries).alias("x")).groupBy("x").agg(F.min("n").alias("p"), F.max("n").alias("q"), F.min(known).alias("u"), F.max(known).alias("v"))
    pairs = ends.where("u IS NOT NULL").select(F.explode(F.array_distinct(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a in "pq" for b in "uv")))).alias("pair"))
    twins = rows.where("sigs > 0 AND times > 1").select(F.col("n").alias("a"), F.col("n").alias("b"), F.lit(1 << 40).alias("c"))  # copies
    met = pairs.select("pair.*").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("c"))
    return met.union(twins).orderBy(F.col("c").desc(), "a", "b").select("a", "b")


def _arrays(rows: pa.Table, key: str) -> tuple[np.ndarray, ...]:
    terms, ws = (rows[f"{key}_{c}"].combine_chunks() for c in ("terms", "ws"))
    sizes = terms.value_lengths().to_numpy().astype(np.int64)
    return rows[key].to_numpy(), terms.flatten().to_numpy(), ws.flatten().to_numpy(), sizes, np.concatenate(([0], np.cumsum(sizes)))


def _cell(floor: float):
    """Of a group of vectors and one of known ones: the pairs (a, b) of their numbers whose product reaches ``floor``."""

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 2]
        if left.num_rows and right.num_rows:
            (n, terms, ws, sizes, ends), (m, into, vs, many, _) = _arrays(left, "a"), _arrays(right, "b")
            names, place, df = np.unique(into, return_inverse=True, return_counts=True)
            column = np.full(len(names), -1)  # of the matrix, for the most common terms
            common = np.argsort(-df, kind="stable")[:DENSE]
            column[common] = np.arange(len(common))
            row = np.repeat(np.arange(len(m)), many)
            matrix, at = np.zeros((len(common), len(m)), np.float32), column[place]
            np.add.at(matrix, (at[at >= 0], row[at >= 0]), vs[at >= 0])
            rare = np.flatnonzero(at < 0)
            rare = rare[np.argsort(place[rare], kind="stable")]
            row, vs, begin = row[rare], vs[rare], np.searchsorted(place[rare], np.arange(len(names) + 1))
            step = max(1, CELLS // len(m))
            for k in range(0, len(n), step):
                own = slice(ends[k], ends[min(k + step, len(n))])
                height = min(step, len(n) - k)
                x, w, t = np.repeat(np.arange(height), sizes[k : k + step]), ws[own], terms[own]
                p = np.minimum(np.searchsorted(names, t), len(names) - 1)
                here = names[p] == t
                x, w, p = x[here], w[here], p[here]
                mine, c = np.zeros((height, len(common)), np.float32), column[p]
                np.add.at(mine, (x[c >= 0], c[c >= 0]), w[c >= 0])
                dot = (mine @ matrix).ravel()
                x, w, p = x[c < 0], w[c < 0], p[c < 0]
                count = begin[p + 1] - begin[p]
                post = np.arange(count.sum()) + np.repeat(begin[p] - np.cumsum(count) + count, count)  # the postings of all terms, one after another
                np.add.at(dot, np.repeat(x, count) * len(m) + row[post], np.repeat(w, count) * vs[post])
                hit = np.flatnonzero(dot >= floor)
                out.append((n[k + hit // len(m)], m[hit % len(m)]))
        return pa.table({"a": np.concatenate([a for a, _ in out]), "b": np.concatenate([b for _, b in out])})

    return found


def candidates(vectors: DataFrame, floor: float, total: int, known: int) -> DataFrame:
    """(a, b): the pairs of ``vectors`` (n, known, terms, ws), any of the ``total`` and one of the ``known``, whose product may reach ``floor``, each with itself among them."""
    wide, high = max(-(-known // KNOWN), 1), max(-(-total // ROWS), min(16, -(-total // 1024)), 1)
    group = lambda size: F.pmod(F.hash("n"), F.lit(size))
    to = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = vectors.select(F.col("n").alias("a"), F.col("terms").alias("a_terms"), F.col("ws").alias("a_ws"), group(high).alias("f"), to(wide).alias("h"))
    right = vectors.where("known").select(F.col("n").alias("b"), F.col("terms").alias("b_terms"), F.col("ws").alias("b_ws"), group(wide).alias("h"), to(high).alias("f"))
    return left.groupBy("f", "h").cogroup(right.groupBy("f", "h")).applyInArrow(_cell(floor - MARGIN), "a long, b long")
