"""Operator 4: secret scan.

Base kinds, leftmost and non-overlapping within a kind, spans in code points with exclusive ends: ``assign`` (a
password-like name, ``:`` or ``=``, and a value of 8+ characters; the span is the whole match), ``access`` (``AKIA``
keys of 16+ characters) and ``hex`` (32+ characters of ``[0-9a-f]``).

The method adds ``novel`` spans: dictionary-primed zstandard novelty. A candidate is a run of token characters that
begins within 64 characters after a sensitive word, or what follows the first sensitive word within a run; it has 20+
characters, a letter and a digit, and touches no base span. Its marginal size is what it adds to the compressed size of the 256 characters before it, under a dictionary of ordinary code
words; where that is ``novelty`` or more of its own length, nothing around it predicts it, and it is reported.

Time is linear in the text: a run is a candidate once, whatever the words around it.

Every byte of every text is looked at: the slice is searched for the words, ``AKIA`` and long hex runs as bytes, and
texts with any of these are then matched in full. Defined results: null and empty texts have no spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Texts, slices, spans_where, tidy

KINDS = ("assign", "access", "hex", "novel")
NOVELTY, CONTEXT, REACH = 0.7, 256, 64

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: The words that make a context sensitive; those of ``assign`` among them.
SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "auth", "bearer", "credential", "private", "signature", "session")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.A | re.I)
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST = 20
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
#: Ordinary words of code and configuration, which prime the dictionary.
CODE_WORDS = (
    "import from return class public static final void string const function export default async await except raise with open close read write "
    "config settings environment variable production development staging database connection host port user username password secret token api_key "
    "access_key private_key client_id client_secret authorization bearer header request response session cookie signature credential service account "
    "http https localhost example.com application json content type value name null true false none self this new delete update select insert"
)
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True
_tools: dict[str, object] = {}


def _compressor():
    if "zstd" not in _tools:
        import zstandard

        words = zstandard.ZstdCompressionDict((CODE_WORDS + ' = "\': ').encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=3)
        _tools["zstd"] = zstandard.ZstdCompressor(dict_data=words, level=3, write_checksum=False, write_content_size=False)
    return _tools["zstd"]


def marginal(context: str, candidate: str) -> float:
    """Compressed bytes that ``candidate`` adds after ``context``, over its own bytes."""
    press, before, own = _compressor(), context.encode("utf-8", "replace"), candidate.encode()
    return (len(press.compress(before + own)) - len(press.compress(before))) / max(1, len(own))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """Where a token run begins soon after a sensitive word, or goes on after one; at most one a run."""
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    out, k, last = [], 0, -REACH - 1
    for m in _TOKEN.finditer(text) if words else ():
        start, end = m.span()
        while k < len(words) and words[k][1] <= start:
            last = words[k][1]
            k += 1
        if start - last <= REACH:
            out.append((start, end))
        elif k < len(words) and words[k][1] <= end - LEAST:
            out.append((words[k][1], end))
    return out


def novel_spans(text: str, base: list[tuple[str, int, int]], novelty: float = NOVELTY) -> list[tuple[str, int, int]]:
    taken: list[list[int]] = []  # the base spans, joined where they touch
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    out = []
    for s, e in candidates(text):
        k = bisect_left(taken, [e])  # the spans that begin before the candidate's end
        if k and taken[k - 1][1] > s:
            continue
        own = text[s:e]
        if _LETTER.search(own) and _DIGIT.search(own) and marginal(text[max(0, s - CONTEXT) : s], own) >= novelty:
            out.append(("novel", s, e))
    return out


def find_spans(text: str, novelty: float = NOVELTY) -> list[tuple[str, int, int]]:
    """All spans by start, then by kind as listed."""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, novelty), key=lambda x: (x[1], KINDS.index(x[0])))


def _suspects(texts: Texts) -> np.ndarray:
    """The texts that hold a sensitive word, ``AKIA`` or a long hex run."""
    raw, lower = texts.buf.tobytes(), LOWER[texts.buf].tobytes()
    marked = np.zeros(texts.n, bool)
    for where, needle in ((raw, b"AKIA"), *((lower, w.encode()) for w in SENSITIVE)):
        at = where.find(needle)
        while at >= 0:
            k = int(np.searchsorted(texts.bounds, at, "right")) - 1
            marked[k] = True
            at = where.find(needle, int(texts.bounds[k + 1]))
    starts, ends = spans_where(_HEX_BYTE[texts.buf], texts.bounds)
    marked[np.searchsorted(texts.bounds, starts[ends - starts >= 32], "right") - 1] = True
    return np.flatnonzero(marked)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SCHEMA = "spans array<struct<kind:string,start:bigint,end:bigint>>"


def _scan(at: int, novelty: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for texts in slices(batch.column(at)):
                for k in _suspects(texts):
                    found[texts.rows[k]] = [{"kind": a, "start": b, "end": c} for a, b, c in find_spans(texts.text(k), novelty)]
            columns = [c for i, c in enumerate(batch.columns) if names[i] is not None]
            yield pa.record_batch([*columns, pa.array(found, _SPANS)], [*(x for x in names if x is not None), "spans"])

    return run


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", novelty: float = NOVELTY) -> DataFrame:
    """(``id_col``, spans) of each row."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, {_SCHEMA}"
    return texts.mapInArrow(tidy(_scan(1, novelty, ["id", None])), schema).withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text_col: str = "text", novelty: float = NOVELTY) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``; spans that overlap go as one, under the kind of the first."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed = {}
            for texts in slices(batch.column(at)):
                for k in _suspects(texts):
                    text = texts.text(k)
                    if spans := find_spans(text, novelty):
                        changed[int(texts.rows[k])] = redact(text, spans)
            if not changed:
                yield batch
                continue
            new = batch.column(at).to_pylist()
            for row, text in changed.items():
                new[row] = text
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.record_batch(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), docs.schema)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Operator 4 over all of ``documents``."""
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *(of(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
