"""Operator 7: packing token pieces into sequences by cutting-stock column generation.

1. Texts are encoded, closed with an end id and cut into pieces of at most ``seq_len`` ids; only the last piece of a
   text is shorter. Pieces go to a written table with their lengths.
2. The length histogram goes to the driver: pieces under ``SHORT`` ids by exact length, longer ones in classes of
   ``unit`` ids, so it has some hundreds of entries whatever the corpus. For each of the two a linear program over
   patterns (how many pieces of each class fill one sequence) is solved by column generation: the simplex method with
   a dense basis of one row a class, and a knapsack by dynamic programming that prices new columns by the dual values,
   until the patterns are within ``GAP`` of the program's lower bound, or within one sequence. Pattern counts are rounded down; the few pieces left are packed
   first-fit decreasing.
3. Pieces are ranked within their class; ranks are dealt out over the pattern slots of their class, which gives the
   sequence. Ranks come from counts per (class, salt), with as many salts as the rows need, so a class may hold any
   share of all rows.

A sequence is never longer than ``seq_len`` ids, as a class counts with its longest member. What is missing to
``seq_len`` is padding. Defined results: null and empty texts are one piece, the end id; ids may be null or repeated.
"""

from __future__ import annotations

import logging
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_at, slices, tidy, vocabulary, written
from .token_output import encoder, per_text, word_units

SEQ_LEN, UNIT, SHORT, END_ID = 4096, 16, 256, 2
#: Rows of a (class, salt), about; and by which share a linear program may be off its optimum.
SALT_ROWS, GAP = 250_000, 1e-3
log = logging.getLogger(__name__)


def _cut(path: str, end_id: int, seq_len: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tokens = encoder(path)
        for batch in batches:
            for texts in slices(batch.column(1)):
                parts, first_part = cut_at(texts, tokens)
                starts, ends, first = word_units(parts)
                ids, sizes = encode(texts.buf, starts, ends)
                at = per_text(ids, sizes, first[first_part])
                rows, begin, length, crc, total, pieces = [], [], [], [], [], []
                for k in range(texts.n):
                    own = np.append(ids[at[k] : at[k + 1]], end_id).astype("<u4")
                    for a in range(0, len(own), seq_len):
                        part = own[a : a + seq_len]
                        rows.append(texts.rows[k])
                        begin.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        total.append(len(own))
                        if keep_ids:
                            pieces.append(part.astype(np.int32))
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (begin, length, crc, total))]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns.append(pa.array(pieces, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(columns, names)

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = END_ID, seq_len: int = SEQ_LEN, keep_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): the pieces of all texts."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return texts.mapInArrow(tidy(_cut(vocab or vocabulary("word_bpe_49k.json"), end_id, seq_len, keep_ids)), schema)


# --------------------------------------------------------------------------- the linear program, over length classes


def best_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: counts of items of weights 1 ... len(values) (by index + 1) with the largest total value."""
    n = len(values)
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    for k in np.flatnonzero(values > 0).tolist():
        if (w := k + 1) > capacity:
            break
        turns = -(-(capacity + 1) // w)
        paid = np.arange(turns)[:, None] * values[k]
        grid = np.full(turns * w, -np.inf)  # by remainder: any number of pieces is a running maximum
        grid[: capacity + 1] = best
        new = (np.maximum.accumulate(grid.reshape(turns, w) - paid, axis=0) + paid).reshape(-1)[: capacity + 1]
        better = new > best + 1e-12
        best[better], took[better] = new[better], w
    counts, c = np.zeros(n, np.int64), capacity
    while c > 0:
        if took[c]:
            counts[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def solve_patterns(demand: np.ndarray, capacity: int | None = None, gap: float = GAP, rounds: int = 3000) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Patterns, how often each is used, and what they leave, for ``demand[k]`` pieces of k + 1 units in sequences of ``capacity`` units.

    Each pattern fits a sequence; what is left comes of rounding down, less than a pattern's worth for each pattern. Where ``rounds`` end before the ``gap``
    is reached, the patterns found so far are used, and a warning says by how much they may be off.
    """
    classes = len(demand)
    capacity = capacity or classes
    used = np.flatnonzero(demand)
    m = len(used)
    if not m:
        return [], demand
    basis = np.zeros((m, m))
    basis[np.arange(m), np.arange(m)] = capacity // (used + 1)
    columns = [np.bincount([k], minlength=classes) * (capacity // (k + 1)) for k in used]
    need = demand[used].astype(float)
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ need
    center, floor = None, 0.0  # the prices of the best lower bound so far, and that bound
    for step in range(rounds):
        duals = inverse.sum(axis=0)
        for price in (duals,) if center is None else (0.7 * center + 0.3 * duals, duals):  # near the best prices first, which keeps them steady
            values = np.full(classes, -1.0)
            values[used] = price
            worth, counts = best_pattern(values, capacity)
            if (bound := float(need @ price) / max(worth, 1e-9)) > floor:
                center, floor = price, bound
            if float(duals @ counts[used]) > 1 + 1e-7:
                break
        else:
            break  # no pattern is worth more than it costs
        if x.sum() <= max((1 + gap) * floor, floor + 1):
            break
        enter = counts[used].astype(float)
        move = inverse @ enter
        ratio = np.full(m, np.inf)
        ratio[move > 1e-9] = x[move > 1e-9] / move[move > 1e-9]
        out = int(np.argmin(ratio))
        columns[out] = counts
        basis[:, out] = enter
        if step % 64 == 63:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
        x = np.maximum(inverse @ need, 0)
    else:
        log.warning("column generation ended after %d rounds; patterns are at most %.3f %% over the optimum", rounds, 100 * (x.sum() / floor - 1))
    plan = [(c, int(np.floor(v + 1e-6))) for c, v in zip(columns, x, strict=True)]
    plan = [(c, n) for c, n in plan if n]
    return plan, np.maximum(demand - sum((c * n for c, n in plan), np.zeros(classes, np.int64)), 0)


def first_fit(left: list[tuple[int, int, int]], capacity: int) -> list[dict[int, int]]:
    """Counts by class of each sequence that takes what is left, (weight, class, pieces), the heaviest first."""
    sequences: list[list] = []  # [room, counts], a few a class
    for weight, kind, todo in sorted(left, reverse=True):
        for s in sequences:
            if many := min(todo, s[0] // weight):
                s[0] -= many * weight
                s[1][kind] = many
                todo -= many
        while todo > 0:
            many = min(todo, capacity // weight)
            sequences.append([capacity - many * weight, {kind: many}])
            todo -= many
    return [counts for _, counts in sequences]


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each class (first rank, pieces of the class a sequence, first sequence) of its patterns, by rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    filled: dict[int, int] = {}
    base = 0
    for counts, n in plan:
        for kind, many in counts.items():
            lo = filled.get(kind, 0)
            out.setdefault(kind, []).append((lo, many, base))
            filled[kind] = lo + many * n
        base += n
    return out


# --------------------------------------------------------------------------- packing


def dealt_slots(demand: dict[int, int], seq_len: int, unit: int, short: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(class, slots) for ``demand`` by class: class ``length`` under ``short`` ids, else minus the number of units."""
    few = np.zeros(short - 1, np.int64)
    long = np.zeros(seq_len // unit, np.int64)
    for k, n in demand.items():
        if k > 0:
            few[k - 1] = n
        else:
            long[-k - 1] = n
    plan, left = [], []
    for counts, kind, weight, capacity in ((long, -1, unit, seq_len // unit), (few, 1, 1, seq_len)):
        patterns, rest = solve_patterns(counts, capacity)
        plan += [({kind * (k + 1): int(c[k]) for k in np.flatnonzero(c).tolist()}, n) for c, n in patterns]
        left += [((k + 1) * weight, kind * (k + 1), int(rest[k])) for k in np.flatnonzero(rest).tolist()]
    return list(slots(plan + [(counts, 1) for counts in first_fit(left, seq_len)]).items())


def packed(cut: DataFrame, seq_len: int = SEQ_LEN, unit: int = UNIT, short: int = SHORT) -> DataFrame:
    """``cut`` with sequence_id and offset. ``cut`` should be a written table: it is read for the histogram and again."""
    spark = cut.sparkSession
    short = max(1, min(short, seq_len))
    order = ["id", "start", "doc_tokens", "ids_crc32"]
    salts = max(8, math.ceil(cut.count() / SALT_ROWS))
    classed = cut.withColumn("class", F.when(F.col("length") < short, F.col("length")).otherwise(-F.ceil(F.col("length") / unit)).cast("int"))
    classed = classed.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    parts = written(classed.groupBy("class", "salt").agg(F.count("*").alias("n")), "class-counts")
    demand = {r["class"]: r["n"] for r in parts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # a row a class
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("class", "salt").orderBy(*order)
    ranked = classed.withColumn("own", F.row_number().over(own) - 1).join(bases, ["class", "salt"]).withColumn("rank", F.col("base") + F.col("own"))
    dealt = spark.createDataFrame(dealt_slots(demand, seq_len, unit, short), "class int, slots array<struct<lo:long,each:long,first:long>>")  # a row a class
    slot = F.element_at(F.filter("slots", lambda s: s["lo"] <= F.col("rank")), -1)
    placed = ranked.join(F.broadcast(dealt), "class").withColumn("slot", slot)
    placed = placed.withColumn("sequence_id", F.col("slot.first") + F.floor((F.col("rank") - F.col("slot.lo")) / F.col("slot.each")))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "class", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("class", "salt", "own", "base", "rank", "slots", "slot")


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, seq_len: int = SEQ_LEN, unit: int = UNIT, vocab: str | None = None) -> DataFrame:
    """The pieces of all texts with their place: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]."""
    cut = written(pieces(docs, id_col, text_col, vocab, seq_len=seq_len, keep_ids=keep_ids), "pieces")
    return packed(cut, seq_len, unit).withColumnRenamed("id", id_col)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """Operator 7 over all of ``documents``."""
    out = packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
