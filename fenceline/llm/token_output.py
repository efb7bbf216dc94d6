"""Operator 2: token ids of whole texts, written as ORC in ascending id order and read back.

Texts are range-partitioned by id and sorted, then encoded where they lie, so each task writes one file of a
contiguous id range; there is a file for ``FILE_BYTES`` of input, and rows of one id go to several files where they are many. Integer run-length encoding, a row index every ``stride`` rows and a Bloom filter on the id are
ORC's own; a reader prunes stripes and row groups by id and takes stripes in parallel.

Encoding goes through the tokenizers library, each distinct unit of a text once. A unit is what the byte-level
pattern can never join with its neighbours: a word with the one space before it, or white space that stands alone.
Texts are first cut at the text of added tokens, as the library cuts them; such a token is a unit, and so is as a whole what
holds white space outside ASCII.

Defined results: null and empty texts hold the end id alone; null ids come first; rows of equal ids are ordered by
file, and in it by number of ids and their hash.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, Texts, UnitEncoder, added_tokens, cut_at, discard, load_tokenizer, shared_dir, slices, spans_where, tidy, vocabulary, written

END_ID, STRIDE, STRIPE_BYTES, FILE_BYTES = 0, 1000, 16 << 20, 512 << 20
_encoders: dict[str, tuple[UnitEncoder, re.Pattern[bytes] | None]] = {}


def encoder(path: str) -> tuple[UnitEncoder, re.Pattern[bytes] | None]:
    """This Python worker's encoder for a vocabulary file, and what matches its added tokens."""
    if path not in _encoders:
        import gc

        tok = load_tokenizer(path)

        def encode(units: list[str]) -> list[list[int]]:
            return [e.ids for k in range(0, len(units), 4096) for e in tok.encode_batch(units[k : k + 4096], add_special_tokens=False)]

        _encoders[path] = UnitEncoder(encode), added_tokens(tok)
        gc.freeze()
    return _encoders[path]


def _odd_space(texts: Texts) -> np.ndarray:
    """Texts that may hold white space outside ASCII, by the first two bytes of its UTF-8 forms."""
    b = texts.buf
    out = np.zeros(texts.n, bool)
    if len(b) > 1:
        x, y = b[:-1], b[1:]
        hit = ((x == 0xC2) & ((y == 0x85) | (y == 0xA0))) | ((x == 0xE1) & (y == 0x9A)) | ((x == 0xE2) & ((y == 0x80) | (y == 0x81))) | ((x == 0xE3) & (y == 0x80))
        out[np.searchsorted(texts.bounds, np.flatnonzero(hit), "right") - 1] = True
    return out


def byte_level_units(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units, which cover the slice, and for each text the index of its first unit."""
    buf, bounds = texts.buf, texts.bounds
    runs, stops = spans_where(IS_SPACE[buf], bounds)
    followed = ~np.isin(stops, bounds)
    last = stops[followed] - 1
    full = np.diff(bounds) > 0
    starts = np.unique(np.concatenate((bounds[:-1][full], runs, last, stops[followed][buf[last] != 0x20])))
    odd = _odd_space(texts)
    if odd.any():
        owner = np.searchsorted(bounds, starts, "right") - 1
        starts = starts[~odd[owner] | (starts == bounds[owner])]
    ends = np.append(starts[1:], len(buf)) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, bounds)


def word_units(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a vocabulary that drops white space: the words."""
    return texts.words()


def per_text(ids: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where each text's ids begin in ``ids`` (one more at the end)."""
    return np.concatenate(([0], np.cumsum(sizes)))[first]


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tokens = encoder(path)
        for batch in batches:
            for texts in slices(batch.column(1)):
                parts, first_part = cut_at(texts, tokens)
                starts, ends, first = byte_level_units(parts)
                ids, sizes = encode(texts.buf, starts, ends)
                at = per_text(ids, sizes, first[first_part])
                out = np.full(len(ids) + texts.n, end_id, np.int32)
                own = np.ones(len(out), bool)
                own[at[1:] + np.arange(texts.n)] = False
                out[own] = ids
                lists = pa.ListArray.from_arrays(pa.array((at + np.arange(texts.n + 1)).astype(np.int32)), pa.array(out))
                yield pa.record_batch([batch.column(0).slice(texts.rows[0], texts.n), lists], ["id", "ids"])

    return run


def _input_bytes(df: DataFrame) -> int:
    """The planner's estimate, which for files is their size; 0 where it has none, as for rows from the driver."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 52 else 0


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = END_ID, files: int | None = None, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Writes (``id_col``, ids) in ascending id order to ORC files at ``path``."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    many = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(_input_bytes(docs) / FILE_BYTES))
    spread = texts.repartitionByRange(many, "id", F.monotonically_increasing_id()).sortWithinPartitions("id")
    done = spread.mapInArrow(tidy(_encoded(vocab or vocabulary("byte_bpe_50k.json"), end_id)), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
    done.write.option("orc.bloom.filter.columns", id_col).option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", str(STRIDE)).option(
        "orc.stripe.size", str(stripe_bytes)
    ).option("orc.compress", "ZSTD").orc(path)


def read_tokens(spark, path: str) -> DataFrame:
    """The written rows; filters on the id prune stripes and row groups."""
    return spark.read.orc(path)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        flat = np.asarray(lists.values, dtype="<u4")
        at = np.asarray(lists.offsets)
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["id", "file", "n_tokens", "ids_crc32"])


def token_index(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, start, n_tokens, ids_crc32) of written rows: ``start`` counts the ids of all rows before.

    Sums per file are few; they give each file's start, and a window within the file gives the rest.
    """
    kind = tokens.schema[id_col].dataType.simpleString()
    rows = tokens.select(F.col(id_col).alias("id"), "ids", F.col("_metadata.file_path").alias("file"))
    rows = written(rows.mapInArrow(tidy(_summed), f"id {kind}, file string, n_tokens long, ids_crc32 long"), "token-sums")
    files = rows.groupBy("file").agg(F.min(F.struct(F.col("id").isNotNull().alias("n"), "id")).alias("least"), F.sum("n_tokens").alias("all"))
    before = Window.orderBy("least", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy(F.col("id").asc_nulls_first(), "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(files, "file").select(
        F.col("id").alias(id_col), (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32"
    )


def op2_token_output(spark, sf_dir: str) -> DataFrame:
    """Operator 2 over all of ``documents``."""
    path = f"{shared_dir(spark)}/fenceline-tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    tokens = read_tokens(spark, path)
    found = token_index(tokens)  # a written table, which no longer needs the files
    discard(tokens)
    return found
