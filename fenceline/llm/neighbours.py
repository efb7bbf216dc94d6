"""Operator 13: nearest neighbours by cosine, as a block matrix join of int8 tiles.

1. Equal vectors collapse into a class with its first ``k + 1`` rows by id, all that any query can report of it, whatever
   their number; a rank limit cuts each task's rows before the shuffle. Queries collapse likewise.
2. Query classes and candidate classes are dealt by hash to a grid of groups whose size follows from a byte bound. A cell of
   the grid, one group of a grouped Arrow step, meets one query group and one candidate group, so a task's memory is two
   groups and a tile; a query group is copied once a candidate group and the other way round.
3. Within a cell both sides are normalised and rounded to int8 with one scale a vector. A tile is an exact integer matrix
   product (in float32, whose sums of int8 products stay below 2 ** 24 in pieces of ``PIECE`` dimensions). With u = s q + a and
   v = t r + b, |u v - s t q r| <= |a| + (1 + |a|) |b|, and both norms are known, so a tile gives each cosine with a bound on
   its error. A pair is dropped only if its upper bound is below the query's (k + 1)-th best so far: the best lower bounds
   of the first tile, exact scores after.
4. What survives is computed again in double precision from the original vectors, component after component, and goes into
   the query's heap. The cells' heaps are merged by rank. So nothing is approximate in the result: recall is 1.

Defined results: a vector that is null, empty or zero, or holds a null or a component that isn't finite (or whose squared norm isn't
a positive finite double) takes no part, neither does a row with a null id. Vectors of different lengths never meet. A query
row is left out of its own list by row, so another row with its id or its vector is a neighbour like any other; ties go to
the smaller id. Repeated query rows have a list each. Fewer candidates than ``k`` give a shorter list, an empty table none.
Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import trim, written

K, QUERY_EVERY = 5, 50
#: Bytes of a group's vectors as doubles; rows of a tile on either side; dimensions of an exact float32 product; least rows of a group.
GROUP_BYTES, TILE_QUERIES, TILE_ROWS, PIECE, LEAST_ROWS = 16 << 20, 512, 2048, 1024, 1024
SLACK = 1e-9


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of length 1 in the direction of the rows, as int8 matrix, scales, and the norms of what rounding leaves."""
    big = np.abs(vectors).max(axis=1, keepdims=True)
    unit = vectors / big
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    whole = np.rint(unit / scale).astype(np.int8)
    left = unit - whole * scale
    return whole, scale[:, 0], np.sqrt((left * left).sum(axis=1))


def tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact products of the int8 rows of a with those of b."""
    parts = [a[:, i : i + PIECE].astype(np.float32) @ b[:, i : i + PIECE].astype(np.float32).T for i in range(0, a.shape[1], PIECE)]
    return parts[0] if len(parts) == 1 else sum(p.astype(np.float64) for p in parts)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row products in double precision, component after component, so that they don't depend on a row's neighbours."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def best_of_cell(queries: np.ndarray, rows: np.ndarray, order: np.ndarray, keep: int) -> list[list[tuple[float, int]]]:
    """For each query its ``keep`` best rows of the cell as (cosine, row), ties to the smaller ``order``; rows are distinct in ``order``."""
    q8, q_scale, q_left = quantised(queries)
    r8, r_scale, r_left = quantised(rows)
    q_norm, r_norm = np.sqrt(dots(queries, queries)), np.sqrt(dots(rows, rows))
    heaps: list[list[tuple[float, int, int]]] = [[] for _ in range(len(queries))]
    for q0 in range(0, len(queries), TILE_QUERIES):
        qs = slice(q0, q0 + TILE_QUERIES)
        floors = np.full(len(q_scale[qs]), -np.inf)
        for r0 in range(0, len(rows), TILE_ROWS):
            rs = slice(r0, r0 + TILE_ROWS)
            near = tile(q8[qs], r8[rs]) * (q_scale[qs, None] * r_scale[None, rs])
            off = q_left[qs, None] + (1 + q_left[qs, None]) * r_left[None, rs] + SLACK
            if r0 == 0 and near.shape[1] > keep:
                floors = np.partition(near - off, near.shape[1] - keep, axis=1)[:, near.shape[1] - keep]
            i, j = np.nonzero(near + off >= floors[:, None])
            i, j = i + q0, j + r0
            scores = dots(queries[i], rows[j]) / (q_norm[i] * r_norm[j])
            for a, b, score in zip(i.tolist(), j.tolist(), scores.tolist(), strict=True):
                entry, heap = (score, -int(order[b]), b), heaps[a]
                if len(heap) < keep:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            for a, heap in enumerate(heaps[qs]):
                if len(heap) == keep:
                    floors[a] = max(floors[a], heap[0][0])
    return [[(score, b) for score, _, b in sorted(heap, reverse=True)] for heap in heaps]


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _cell(keep: int):
    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, r, score = [], [], []
        if len(queries) and len(rows):
            order = np.empty(len(rows), np.int64)
            ids = rows["first"].to_pylist()
            order[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
            for a, found in enumerate(best_of_cell(_vectors(queries["vec"]), _vectors(rows["vec"]), order, keep)):
                q += [a] * len(found)
                r += [b for _, b in found]
                score += [s for s, _ in found]
        q, r = pa.array(q, pa.int64()), pa.array(r, pa.int64())
        out = pa.table({"q1": queries["h1"].take(q), "q2": queries["h2"].take(q), "members": rows["members"].take(r), "score": pa.array(score, pa.float64())})
        trim()
        return out

    return run


def nearest(df: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``df`` nearest to each row for which ``queries`` holds, nearest first."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    square = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)  # null, NaN or infinite if a component is
    rows = rows.where(F.col("id").isNotNull()).withColumn("square", square).where((F.col("square") > 0) & (F.col("square") < float("inf"))).drop("square")
    rows = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64("vec", F.lit(1)), "row": F.monotonically_increasing_id()})
    rows = written(rows, "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    firsts = Window.partitionBy("h1", "h2").orderBy("id", "row")
    members = F.array_sort(F.collect_list(F.struct("id", "row"))).alias("members")
    ranked = rows.withColumn("place", F.row_number().over(firsts)).where(F.col("place") <= k + 1)
    classes = ranked.groupBy("h1", "h2").agg(F.first("vec").alias("vec"), members)
    classes = written(classes.withColumn("first", F.col("members")[0]["id"]), "vector-classes")
    asked = rows.where("asks").select("id", "row", "h1", "h2")
    wanted = written(rows.where("asks").groupBy("h1", "h2").agg(F.first("vec").alias("vec")), "vector-queries")

    sizes = classes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    group = max(LEAST_ROWS, group_bytes // (8 * (sizes["dim"] or 1)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, math.ceil(sizes["n"] / group), min(tasks, sizes["n"] // LEAST_ROWS))
    down = max(1, math.ceil(wanted.count() / group))
    part = lambda n: F.pmod(F.xxhash64("h2", "h1"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = wanted.select("h1", "h2", "vec", F.size("vec").alias("dim"), part(down).alias("down"), every(across).alias("across"))
    right = classes.select("vec", "members", "first", F.size("vec").alias("dim"), part(across).alias("across"), every(down).alias("down"))
    cell = ("dim", "down", "across")
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k + 1), f"q1 long, q2 long, members array<struct<id:{kind},row:long>>, score double")
    best = Window.partitionBy("q1", "q2").orderBy(F.col("score").desc(), "m.id", "m.row")
    found = written(found, "vector-cells").withColumn("m", F.explode("members")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    ends = found.groupBy(F.col("q1").alias("h1"), F.col("q2").alias("h2")).agg(F.array_sort(F.collect_list(F.struct("place", "m.id", "m.row", "score"))).alias("top"))
    lists = asked.join(written(ends, "vector-tops"), ["h1", "h2"]).select(F.col("id").alias("query_id"), F.filter("top", lambda x: x["row"] != F.col("row")).alias("top"))
    ranks = lists.select("query_id", F.posexplode(F.slice("top", 1, k)).alias("at", "t"))
    return ranks.select("query_id", (F.col("at") + 1).alias("rank"), F.col("t.id").alias(id_col), F.col("t.score").alias("score"))


def op13_block_neighbours(spark, sf_dir: str) -> DataFrame:
    """Operator 13: for every vector whose id is divisible by 50, its 5 nearest among all of ``embeddings``."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % QUERY_EVERY == 0)


OP13_SQL = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
f AS (SELECT r, vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM e WHERE list_inner_product(v, v) > 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) / (a.norm * b.norm) AS score FROM f a JOIN f b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % {QUERY_EVERY} = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= {K}
"""
