"""Shared pieces of the corpus operators.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; in UTF-8 those
bytes never occur inside another character, so words, lines and hashes can be
found on the raw Arrow buffers with a few numpy passes instead of one Python
object per word.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is worked on in slices of about this many bytes, which bounds a task's numpy arrays.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch, at most, while a step is written: some kilobytes a text, held by the executor and by its Python worker.
ARROW_ROWS = 2000

_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 62)) | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


# --------------------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a local master (tests) gets a local one; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors share; the master is {master}")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'fenceline-checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, fmt: str = "parquet", by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder, in folders of ``by`` where that is given, and read back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fenceline-{name}-{uuid.uuid4().hex}"
    writer = df.write.format(fmt)
    rows, was = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(rows, str(min(ARROW_ROWS, int(was)) if int(was) > 0 else ARROW_ROWS))
    try:
        (writer.partitionBy(by) if by else writer).save(path)
    finally:
        spark.conf.set(rows, was)
    return spark.read.schema(df.schema).format(fmt).load(path)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a ``written`` table that nothing reads any more; other tables stay."""
    spark = df.sparkSession
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("fenceline-"):
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def trim() -> None:
    """Gives freed memory of this worker back to the system; a worker lives on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    for base, have in list(_powers.items()):
        if len(have) > 1 << 17:
            del _powers[base]
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, with freed memory given back after every batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            trim()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(each(batches))
        finally:
            trim()

    return go


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns: extra columns, whatever their names, never reach an operator."""
    return df.select(*columns)


def mix_column(*columns: Column) -> Column:
    return F.xxhash64(*columns)


# --------------------------------------------------------------------------- hashing of spans


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX_A
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX_B
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            k = min(done, size - done)
            have[done : done + k] = have[:k] * np.uint64(pow(base, done, 1 << 64))
            done += k
        _powers[base] = have
    return have


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of buf; starts ascend and spans don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + SLICE_BYTES, "right"))
        if j <= i:  # one span longer than a slice
            raw = hashlib.blake2b(buf[lo : int(ends[i])].tobytes(), digest_size=8).digest()
            out[i] = np.frombuffer(raw, "<u8")[0]
            i += 1
            continue
        hi = int(ends[j - 1])
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[buf[lo:hi]] * powers(_BASE, hi - lo)[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        h = (sums[e] - sums[s]) * powers(_BASE_INV, hi - lo)[s]
        out[i:j] = h + (e - s).astype(np.uint64) * _MIX_B
        i = j
    return mix(out)


def spans_where(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True in ``inside``, also cut at the positions in ``cuts``."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    opens, closes = inside.copy(), inside.copy()
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before[cuts] = False
    after[cuts - 1] = False
    opens &= ~before
    closes &= ~after
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


class Texts:
    """A slice of whole texts: ``buf`` holds their UTF-8 bytes back to back, ``bounds`` where each begins."""

    def __init__(self, rows: np.ndarray, buf: np.ndarray, bounds: np.ndarray):
        self.rows, self.buf, self.bounds = rows, buf, bounds
        self.n = len(bounds) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the words, and for each text the index of its first word (one more at the end)."""
        starts, ends = spans_where(~IS_SPACE[self.buf], self.bounds)
        return starts, ends, np.searchsorted(starts, self.bounds)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Byte starts and ends of the \n-split lines, and for each text the index of its first line."""
        at = np.flatnonzero(self.buf == 0x0A)
        lengths = np.bincount(np.searchsorted(self.bounds, at, "right") - 1, minlength=self.n) + 1
        first = np.concatenate(([0], np.cumsum(lengths)))
        starts = np.empty(first[-1], np.int64)
        ends = np.empty(first[-1], np.int64)
        inner = np.ones(first[-1], bool)
        inner[first[:-1]] = False
        starts[first[:-1]] = self.bounds[:-1]
        starts[inner] = at + 1
        last = np.ones(first[-1], bool)
        last[first[1:] - 1] = False
        ends[first[1:] - 1] = self.bounds[1:]
        ends[last] = at
        return starts, ends, first

    def text(self, k: int) -> str:
        return self.buf[self.bounds[k] : self.bounds[k + 1]].tobytes().decode("utf-8", "replace")


def slices(column: pa.Array, lead: bytes = b"", limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow string column (null: empty) in slices of about ``limit`` bytes; a longer text is alone in its slice.

    ``lead`` is put before each text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    if column.null_count:
        sizes = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
    else:
        sizes = np.diff(offsets)
    lo = 0
    total = np.concatenate(([0], np.cumsum(sizes)))
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, "right")) - 1)
        bounds = total[lo : hi + 1] - total[lo]
        if lead:
            view = data.data
            parts = []
            for k in range(lo, hi):
                parts.append(lead)
                parts.append(view[offsets[k] : offsets[k] + sizes[k]])
            buf = np.frombuffer(b"".join(parts), np.uint8)
            bounds = bounds + np.arange(hi - lo + 1) * len(lead)
        elif column.null_count and (offsets[hi] - offsets[lo]) != bounds[-1]:
            view = data.data
            buf = np.frombuffer(b"".join(view[offsets[k] : offsets[k] + sizes[k]] for k in range(lo, hi)), np.uint8)
        else:
            buf = data[offsets[lo] : offsets[lo] + bounds[-1]]
        yield Texts(np.arange(lo, hi), buf, bounds.astype(np.int64))
        lo = hi


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows, text after text, and for each text the index of its first one."""
    n = len(words)
    counts = np.diff(first)
    many = np.maximum(counts - width + 1, 0)
    at = np.concatenate(([0], np.cumsum(many)))
    if n < width:
        return np.empty(0, np.uint64), at
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = h * _MIX_A + words[k : n - width + 1 + k]
    keep = np.zeros(n + 1, np.int64)  # windows that stay within their text
    has = many > 0
    np.add.at(keep, first[:-1][has], 1)
    np.add.at(keep, (first[:-1] + many)[has], -1)
    return mix(h[np.cumsum(keep)[: n - width + 1] > 0]), at


# --------------------------------------------------------------------------- encoding by distinct units


class UnitEncoder:
    """Encodes byte units, each distinct one once, with ``encode(list[str]) -> list[list[int]]``.

    Results are remembered in sorted arrays for up to ``most`` units; then the memory starts anew, which changes
    the time taken and nothing else.
    """

    def __init__(self, encode, most: int = 1_500_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        empty = lambda: [np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)]
        self.main, self.fresh = empty(), empty()  # sorted keys, where their ids begin, how many; new ones go to the smaller part
        self.ids = np.empty(0, np.int32)
        self.used = 0

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in the order of the units, and how many each unit has."""
        if not len(starts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        keys, first, back = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.main[0]) + len(self.fresh[0]) + len(keys) > self.most:
            self.clear()
        at, size, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for have, have_at, have_size in (self.main, self.fresh):
            where = np.searchsorted(have, keys)
            hit = where < len(have)
            hit[hit] = have[where[hit]] == keys[hit]
            at[hit], size[hit] = have_at[where[hit]], have_size[where[hit]]
            known |= hit
        if not known.all():
            new = np.flatnonzero(~known)
            units = [buf[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[first[new]], ends[first[new]], strict=True)]
            found = self.encode(units)
            sizes = np.fromiter(map(len, found), np.int32, len(found))
            fresh = np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum()))
            at[new], size[new] = self.used + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[:-1], sizes
            need = self.used + len(fresh)
            if need > len(self.ids):
                self.ids = np.concatenate((self.ids[: self.used], np.empty(max(need, 2 * self.used) - self.used, np.int32)))
            self.ids[self.used : need] = fresh
            self.used = need
            self.fresh = self._merged(self.fresh, [keys[new], at[new], sizes])
            if len(self.fresh[0]) > max(1 << 14, len(self.main[0]) // 4):  # so a key is moved a few times only
                self.main, self.fresh = self._merged(self.main, self.fresh), self._merged([x[:0] for x in self.fresh], [x[:0] for x in self.fresh])
        at, size = at[back], size[back]
        ends_ = np.cumsum(size)
        index = np.arange(ends_[-1]) + np.repeat(at - (ends_ - size), size)
        return self.ids[index], size

    @staticmethod
    def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        """Two parts as one, sorted by key; they share no key."""
        order = np.argsort(np.concatenate((a[0], b[0])), kind="stable")
        return [np.concatenate((x, y))[order] for x, y in zip(a, b, strict=True)]


def load_tokenizer(path: str):
    """A tokenizers.Tokenizer on one thread. It takes the text of an added token, wherever that occurs, for the token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def added_tokens(tokenizer) -> re.Pattern[bytes] | None:
    """Matches the added tokens, at which a tokenizer cuts a text before anything else. Only plain ones (taken from the raw text, whatever stands around them) are supported."""
    found = list(tokenizer.get_added_tokens_decoder().values())
    if odd := [t.content for t in found if t.normalized or t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content)]:
        raise ValueError(f"added tokens that depend on their neighbours: {odd}")
    return re.compile(b"|".join(re.escape(t.content.encode()) for t in sorted(found, key=lambda t: -len(t.content)))) if found else None


def cut_at(texts: Texts, tokens: re.Pattern[bytes] | None) -> tuple[Texts, np.ndarray]:
    """The texts cut before and after each of ``tokens``, as texts of their own, and the index of each text's first part (one more at the end)."""
    whole = np.arange(texts.n + 1)
    if tokens is None or not tokens.search(texts.buf):
        return texts, whole
    cuts = []
    for lo, hi in zip(texts.bounds[:-1].tolist(), texts.bounds[1:].tolist(), strict=True):
        cuts += [lo + x for m in tokens.finditer(texts.buf[lo:hi]) for x in m.span()]  # not over the buffer: a match must lie within a text
    inner = np.setdiff1d(np.array(cuts, np.int64), texts.bounds)
    bounds = np.concatenate((texts.bounds, inner))
    order = np.argsort(bounds, kind="stable")  # bounds of empty texts repeat and stay in order
    place = np.empty(len(bounds), np.int64)
    place[order] = np.arange(len(bounds))
    return Texts(np.arange(len(bounds) - 1), texts.buf, bounds[order]), place[whole]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)
