"""Operator 1: document quality rules as a short-circuit cascade.

A rule looks at a slice of whole texts and marks the ones it rejects. Before the corpus is read, every rule is run on
a bounded sample (``sample_rows`` rows, each of at most ``sample_chars`` characters), which gives its seconds a
document and its share of rejections; rules are then ordered by rejections per second. On the corpus each rule sees
only what earlier rules let through. The order changes the time taken and which rule a rejected text is charged to;
it never changes the verdict, which is that no rule rejects.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined results: null and empty texts have no words and are rejected (fewer than
20 words); ids may be null or repeated, every input row gives one output row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, Texts, mix, shingles, slices, span_hashes, tidy

MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
SAMPLE_ROWS, SAMPLE_CHARS = 512, 50_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


class Measures:
    """Counts of each text of a slice, found when first asked for."""

    def __init__(self, texts: Texts):
        self.texts = texts

    def keep(self, rows: np.ndarray) -> Measures:
        """The same for the texts at ``rows`` only."""
        t = self.texts
        if len(rows) == t.n:
            return self
        sizes = np.diff(t.bounds)[rows]
        parts = [t.buf[t.bounds[k] : t.bounds[k + 1]] for k in rows]
        buf = np.concatenate(parts) if parts else np.empty(0, np.uint8)
        out = Measures(Texts(t.rows[rows], buf, np.concatenate(([0], np.cumsum(sizes)))))
        for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"):
            if name in self.__dict__:
                out.__dict__[name] = self.__dict__[name][rows]
        return out

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text ``mask`` (256 booleans) takes."""
        t = self.texts
        sums = np.concatenate(([0], np.cumsum(mask[t.buf], dtype=np.int64)))
        return sums[t.bounds[1:]] - sums[t.bounds[:-1]]

    @cached_property
    def spans(self):
        return self.texts.words()

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.spans[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.count(~IS_SPACE & ((np.arange(256) & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count(_SYMBOL)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = self.texts.lines()
        words = self.spans[0]
        full = np.searchsorted(words, ends) > np.searchsorted(words, starts)
        owner = np.repeat(np.arange(self.texts.n), np.diff(first))[full]
        keys = mix(span_hashes(self.texts.buf, starts[full], ends[full]) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, index = np.unique(keys, return_index=True)
        lines = np.bincount(owner, minlength=self.texts.n)
        return lines, lines - np.bincount(owner[index], minlength=self.texts.n)

    @cached_property
    def n_lines(self) -> np.ndarray:
        """Lines with a word."""
        return self._lines[0]

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        starts, ends, first = self.spans
        windows, at = shingles(span_hashes(self.texts.buf, starts, ends), first, REPEAT_WINDOW)
        out = np.zeros(self.texts.n, np.int64)
        for k in range(self.texts.n):
            part = windows[at[k] : at[k + 1]]
            if len(part) < 2:
                continue
            order = np.argsort(part, kind="stable")
            ranked = part[order]
            same = ranked[1:] == ranked[:-1]
            if not same.any():
                continue
            twice = np.zeros(len(part), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(len(part) + REPEAT_WINDOW, np.int64)
            where = np.flatnonzero(twice)
            cover[where] += 1
            cover[where + REPEAT_WINDOW] -= 1
            out[k] = np.count_nonzero(np.cumsum(cover) > 0)
        return out


def _of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER, _DIGIT = _of(bytes(range(65, 91))), _of(bytes(range(97, 123))), _of(b"0123456789")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], np.ndarray]


def _shouts(m: Measures) -> np.ndarray:
    upper = m.count(_UPPER)
    return 2 * upper > upper + m.count(_LOWER)


BASE = (
    Rule("few_words", lambda m: m.n_words < MIN_WORDS),
    Rule("repeats", lambda m: 100 * m.n_repeat_words > REPEAT_PERCENT * m.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("dup_lines", lambda m: 10 * m.n_dup_lines > 3 * m.n_lines),
    Rule("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 12 * m.n_words)),
    Rule("shouting", _shouts),
    Rule("digits", lambda m: 4 * m.count(_DIGIT) > m.word_chars),
)


def cascade(measures: Measures, rules: tuple[Rule, ...]) -> np.ndarray:
    """For each text the index of the first rule that rejects it, -1 where none does."""
    out = np.full(measures.texts.n, -1)
    left = np.arange(measures.texts.n)
    for k, rule in enumerate(rules):
        if not len(left):
            break
        bad = np.asarray(rule.rejects(measures), bool)
        out[left[bad]] = k
        if bad.any():
            left, measures = left[~bad], measures.keep(np.flatnonzero(~bad))
    return out


def _measured(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, bad = 0, np.zeros(len(rules)), np.zeros(len(rules))
        for batch in batches:
            for texts in slices(batch.column(0)):
                n += texts.n
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    bad[k] += np.count_nonzero(rule.rejects(Measures(texts)))
                    cost[k] += time.perf_counter() - began
        yield pa.record_batch([pa.array(range(len(rules)), pa.int32()), pa.array([n] * len(rules), pa.int64()), pa.array(cost), pa.array(bad)], ["rule", "n", "cost", "bad"])

    return run


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> tuple[Rule, ...]:
    """``rules`` by rejections per second, as measured on a bounded sample of ``docs``."""
    sample = (
        docs.select(F.col(text_col).alias("text"))
        .where((F.length("text") <= sample_chars) & (F.pmod(F.xxhash64("text"), F.lit(16)) == 0))
        .limit(sample_rows)
    )
    seen = sample.mapInArrow(tidy(_measured(rules)), "rule int, n long, cost double, bad double").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("bad").alias("bad"))
    worth = {r["rule"]: (r["bad"] + 0.5) / (r["cost"] + 1e-9) for r in seen.collect()}  # a row a rule
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-worth.get(k, 0.0), k)))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rule) of each row."""
    best = ordered(docs, rules, text_col, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([r.name for r in best] + [None], object)
        for batch in batches:
            parts = []
            for texts in slices(batch.column(1)):
                m = Measures(texts)
                base = BASE[0].rejects(m) | BASE[1].rejects(m)
                counts = (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)
                first = cascade(m, best)
                parts.append((*counts, base, (first < 0) & ~base, names[first]))
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                yield pa.record_batch(
                    [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.bool_()) for c in columns[5:7]), pa.array(columns[7], pa.string())],
                    ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule"],
                )

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rule string"
    return texts.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    best = ordered(docs, rules, text_col, sample_rows)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [texts.rows[cascade(Measures(texts), best) < 0] for texts in slices(batch.column(at))]
            if kept:
                yield batch.take(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(tidy(run), docs.schema)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Operator 1 over all of ``documents``."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("failed_rule")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ANY = r"'[^\x20\x09-\x0D]'"

OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
f AS (SELECT r, line FROM l WHERE regexp_matches(line, {_ANY})),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM f GROUP BY r),
g AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 8) AS t(k) GROUP BY r),
m AS (
  SELECT d.r, doc_id, text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^a-z]', '', 'g')) AS low, length(regexp_replace(text, '[^0-9]', '', 'g')) AS dig
  FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 12 * n_words
    OR 2 * up > up + low OR 4 * dig > word_chars) AS kept
FROM b
"""
