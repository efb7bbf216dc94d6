"""Operator 9: language identification by string kernels.

The kernel of two chunks is the blended-spectrum presence kernel: how many distinct character n-grams (n = 1 ...
``MAX_N``, lower-cased, hashed to ``2 ** BITS`` places) both hold, over the root of the product of how many each
holds. Nystroem features come from ``LANDMARKS`` training chunks; one-versus-rest kernel ridge regression is fitted on
them. A chunk's scores are K(chunk, landmarks) times a small weight matrix; as the kernel's numerator is a product of
presence matrices, landmarks times weights is multiplied once, and scoring is one matrix product a block of chunks.

Training takes at most ``PER_LANGUAGE`` labelled rows a language, those of the smallest hashed ids (the documented
bound; rows without a letter don't count, and of rows alike in id and language the smallest text does), and of these every chunk, weighted by its share of the text; landmarks are chunks of different texts as long as
there are enough. Presence bits pass through the driver a part of a sorted table at a time, so a text may have any
length. Every text is scored whole: chunks of ``CHUNK`` code points, whose scores are averaged by their length.

Defined results: ``und`` with score 0 where the text is null or has no letter, or nothing could be learned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written

MAX_N, BITS, CHUNK, LANDMARKS, PER_LANGUAGE, RIDGE, BLOCK = 3, 14, 4096, 192, 300, 1e-2, 96
HELD_MOD, HELD_REST = 4, 2
_FACTOR = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def presence(chunks: list[str]) -> np.ndarray:
    """Rows of 0 and 1: which hashed n-grams each chunk holds."""
    sizes = np.array([len(c) for c in chunks])
    codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(chunks)), sizes)
    out = np.zeros((len(chunks), 1 << BITS), np.float32)
    flat = out.reshape(-1)
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, MAX_N + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] ^ (codes[n - 1 :] * _FACTOR[0])) * _FACTOR[1]
        h ^= h >> np.uint32(15)
        place = ((h + np.uint32(n)) * _FACTOR[2]) >> np.uint32(32 - BITS)
        here = owner[: len(h)]
        whole = here == owner[n - 1 :]
        flat[(here[whole] << BITS) + place[whole]] = 1
    return out


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode's L), which numerals, fractions and signs are not."""
    return next(filter(str.isalpha, text), None) is not None


def _parts(text: str | None) -> list[str]:
    if not text or not has_letter(text):
        return []
    text = text.lower()
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


class Model:
    """Languages and the matrix that maps presence rows, over the root of their sums, to one-versus-rest scores."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        parts, owner = [], []
        for k, text in enumerate(texts):
            for p in _parts(text):
                parts.append(p)
                owner.append(k)
        n = len(texts)
        if not parts or not self.languages:
            return ["und"] * n, np.zeros(n)
        sums, total = np.zeros((n, len(self.languages))), np.zeros(n)
        own = np.array(owner)
        for i in range(0, len(parts), BLOCK):
            x = presence(parts[i : i + BLOCK])
            f = (x @ self.weights) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
            w = np.array([len(p) for p in parts[i : i + BLOCK]], float)
            np.add.at(sums, own[i : i + BLOCK], f * w[:, None])
            np.add.at(total, own[i : i + BLOCK], w)
        mean = sums / np.maximum(total, 1)[:, None]
        best = mean.argmax(axis=1)
        score = np.clip((mean[np.arange(n), best] + 1) / 2, 0, 1)
        return [self.languages[b] if t else "und" for b, t in zip(best, total, strict=True)], np.where(total > 0, score, 0.0)


def _unit(bits: list[bytes]) -> np.ndarray:
    """Presence rows from packed bits, over the root of their sums."""
    x = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]


def fit(languages: list[str], landmarks: list[bytes], rows: Iterable[tuple[str, bytes, float]]) -> Model:
    """From the packed presence bits of landmarks, and (language, packed bits, weight) of all training chunks."""
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    marks = _unit(landmarks)
    kernel = (marks @ marks.T).astype(float)
    values, vectors = np.linalg.eigh(kernel)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    gram, right = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(languages)))
    for part in batched(rows, BLOCK):
        z = (_unit([bits for _, bits, _ in part]) @ marks.T).astype(float) @ root
        y = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _, _ in part])
        weighted = z * np.array([w for _, _, w in part])[:, None]
        gram += weighted.T @ z
        right += weighted.T @ y
    beta = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), right)
    return Model(languages, (marks.T @ (root @ beta).astype(np.float32)).astype(np.float32))


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """(id, lang, text): at most ``per_language`` rows a language, one an id, of those with a letter, a language and crc32(id as text) mod 4 other than 2."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    letter = F.col("text").rlike(r"\p{L}")  # as has_letter
    able = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")) & letter)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = able.select("id", "lang").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("id", "lang")
    return able.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))  # bounded by the limit above


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fits on ``training_rows``."""
    sample = training_rows(docs, id_col, text_col, lang_col, per_language).select("lang", "text")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = _parts(text)
                size = sum(map(len, parts))
                raw = zlib.crc32((text or "").encode("utf-8", "surrogatepass"))
                turns = np.random.default_rng(raw).permutation(len(parts))  # which of a text's chunks is its first landmark
                for i in range(0, len(parts), BLOCK):
                    own = parts[i : i + BLOCK]
                    n = len(own)
                    found = np.packbits(presence(own) > 0, axis=1)
                    columns = [[lang] * n, [x.tobytes() for x in found], [len(p) / size for p in own], turns[i : i + n].tolist(), [raw] * n]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "bits", "weight", "turn", "raw"])

    kinds = (pa.string(), pa.binary(), pa.float64(), pa.int64(), pa.int64())
    got = written(sample.mapInArrow(tidy(chunks), "lang string, bits binary, weight double, turn long, raw long"), "chunks")
    languages = sorted(r["lang"] for r in got.select("lang").distinct().collect())
    landmarks = got.orderBy("turn", F.xxhash64("raw"), "lang", "bits").limit(LANDMARKS).select("bits").collect()
    rows = got.select("lang", "bits", "weight").orderBy("lang", "bits", "weight").toLocalIterator()
    return fit(languages, [bytes(r["bits"]) for r in landmarks], ((r["lang"], bytes(r["bits"]), r["weight"]) for r in rows))


def held_out(id_column):
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(HELD_MOD)) == HELD_REST


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, lang_pred, score) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                lang, score = model.scores(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(tidy(run), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Operator 9 over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identified(docs, train(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
