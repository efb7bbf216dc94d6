"""Alignment of pairs of operation lists: the matching-block ratio and the longest common subsequence, in numpy batches.

Pairs come as rows with two lists, from an equi-join or a bounded signature library; a batch of them is one set of
matrices, so there is no loop over a pair's cells. The ratio is 2 M / (n + m), where M is the size of the blocks found by taking the longest
common block, of equals the earliest in the first list and then in the second, and going on left and right of it; it equals the
ratio of the standard library's sequence matcher, which for second lists of 200 entries and more leaves out popular
entries: such pairs are handed to it one by one. The subsequence is counted by bit-parallel steps over words of 64 places,
and so are the blocks where second lists have at most 64 places.

Defined results: null lists are empty, null entries equal each other; two empty lists have ratio 1 and no common subsequence (0).
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Cells of a batch's matrices, and the length from which the standard library leaves out popular entries.
CELLS, POPULAR_FROM = 1 << 21, 200
#: Second lists of up to so many places have one word of bits for each place of the first list.
WORD = 64


def lcs_lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the rows of two code matrices, padded with -1 and -2."""
    b, n = x.shape
    words = -(-n // 64)
    wide = np.full((b, words * 64), -1, x.dtype)
    wide[:, :n] = x
    state = np.full((b, words), np.iinfo(np.uint64).max, np.uint64)
    for j in range(y.shape[1]):
        match = np.packbits(wide == y[:, j, None], axis=1, bitorder="little").view(np.uint64)
        both, carry, new = state & match, np.zeros(b, np.uint64), np.empty_like(state)
        for w in range(words):  # state + both, a word at a time
            first = state[:, w] + both[:, w]
            total = first + carry
            carry = ((first < state[:, w]) | (total < first)).astype(np.uint64)
            new[:, w] = total | (state[:, w] & ~match[:, w])
        state = new
    return np.bitwise_count(~state).sum(axis=1).astype(np.int64)


def _runs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(pairs, n, m): the length of the common run that ends at two places."""
    (b, n), m = x.shape, y.shape[1]
    runs = np.zeros((b, n, m), np.int16)
    for i in range(n):
        same = x[:, i, None] == y
        runs[:, i] = same
        if i:
            runs[:, i, 1:] += np.where(same[:, 1:], runs[:, i - 1, :-1], 0).astype(np.int16)
    return runs


def longest_blocks(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, start in x, start in y) of the longest common block of each pair of rows, of equals the earliest in x and then in y."""
    b, n, m = len(x), x.shape[1], y.shape[1]
    out = np.zeros((3, b), np.int64)
    step = max(1, CELLS // max(1, n * m))
    for k in range(0, b if n and m else 0, step):
        flat = _runs(x[k : k + step], y[k : k + step]).reshape(-1, n * m)
        at = flat.argmax(axis=1)
        size = flat[np.arange(len(flat)), at].astype(np.int64)
        out[:, k : k + step] = size, at // m + 1 - size, at % m + 1 - size
    return tuple(out)


def block_sizes(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """The total size of the matching blocks of each pair of rows."""
    b, n, m = len(x), x.shape[1], y.shape[1]
    total = np.zeros(b, np.int64)
    if not b or not n or not m:
        return total
    runs = _runs(x, y)
    i, j = np.arange(n)[None, :, None], np.arange(m)[None, None, :]
    regions = np.stack((np.arange(b), np.zeros(b, np.int64), nx, np.zeros(b, np.int64), ny), axis=1)
    step = max(1, CELLS // (n * m))
    while len(regions):
        regions = regions[(regions[:, 1] < regions[:, 2]) & (regions[:, 3] < regions[:, 4])]
        later = []
        for k in range(0, len(regions), step):
            part = regions[k : k + step]
            pair, (alo, ahi, blo, bhi) = part[:, 0], (part[:, c, None, None] for c in range(1, 5))
            size = np.minimum(runs[pair], np.minimum(i - alo, j - blo) + 1)
            size[~((i >= alo) & (i < ahi) & (j >= blo) & (j < bhi))] = 0
            flat = size.reshape(len(part), -1)
            at = flat.argmax(axis=1)  # of equals the first place in the first list, then in the second
            best = flat[np.arange(len(part)), at].astype(np.int64)
            found = best > 0
            pair, best, at, part = pair[found], best[found], at[found], part[found]
            np.add.at(total, pair, best)
            i1, j1 = at // m + 1, at % m + 1
            later.append(np.stack((pair, part[:, 1], i1 - best, part[:, 3], j1 - best), axis=1))
            later.append(np.stack((pair, i1, part[:, 2], j1, part[:, 4]), axis=1))
        regions = np.concatenate(later) if later else regions[:0]
    return total


def masks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(pairs, n): of each place of x the places of y with the same entry, as the bits of one word; y has at most ``WORD`` places."""
    places, other = np.ascontiguousarray(x.T.astype(np.int32)), np.ascontiguousarray(y.T.astype(np.int32))
    out = np.zeros(places.shape, np.uint64)
    for j in range(len(other)):
        out |= (places == other[j]).astype(np.uint64) << np.uint64(j)
    return np.ascontiguousarray(out.T)


def mask_lcs(rows: np.ndarray) -> np.ndarray:
    """``lcs_lengths`` from ``masks``."""
    state = np.full(len(rows), np.iinfo(np.uint64).max, np.uint64)
    for i in range(rows.shape[1]):
        both = state & rows[:, i]
        state = (state + both) | (state & ~rows[:, i])
    return np.bitwise_count(~state).astype(np.int64)


def mask_blocks(rows: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """``block_sizes`` from ``masks``: bits are where a common run of a length starts, and runs grow by one until no region has a longer one."""
    n, one, full = rows.shape[1], np.uint64(1), np.iinfo(np.uint64).max
    below = np.array([full >> np.uint64(64 - k) if k else 0 for k in range(WORD + 1)], np.uint64)  # the first k bits
    before = np.where(np.arange(n) < np.arange(n + 1)[:, None], full, np.uint64(0))  # all bits of the first k places
    after = ~before
    total, zero = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    pair, alo, ahi, blo, bhi = np.arange(len(rows)), zero, nx, zero, ny
    while len(pair):
        starts = rows[pair]
        starts &= (below[bhi] & ~below[blo])[:, None]
        starts &= before[ahi]
        starts &= after[alo]
        some = starts.any(axis=1)
        pair, alo, ahi, blo, bhi, starts = (c[some] for c in (pair, alo, ahi, blo, bhi, starts))
        size, longest, open_ = np.ones(len(pair), np.int64), starts, np.arange(len(pair))
        while len(open_):
            starts = starts[:, :-1] & (starts[:, 1:] >> one)
            some = starts.any(axis=1)
            starts, open_ = starts[some], open_[some]
            size[open_] += 1
            longest[open_, : starts.shape[1]] = starts
            longest[open_, starts.shape[1] :] = 0
        i = (longest != 0).argmax(axis=1)  # of equals the first place in the first list, then in the second
        word = longest[np.arange(len(pair)), i]
        j = np.bitwise_count((word & (~word + one)) - one).astype(np.int64)
        np.add.at(total, pair, size)
        sides = (pair, alo, i, blo, j), (pair, i + size, ahi, j + size, bhi)
        pair, alo, ahi, blo, bhi = (np.concatenate(c) for c in zip(*sides, strict=True))
        some = (alo < ahi) & (blo < bhi)
        pair, alo, ahi, blo, bhi = (c[some] for c in (pair, alo, ahi, blo, bhi))
    return total


def _coded(lists: pa.ListArray, codes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """A padded matrix of a list column's entries, given as codes, and the lists' lengths."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(lists), int(sizes.max(initial=0))), pad, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = codes
    return out, sizes


def coded(x: pa.ListArray, y: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both columns as padded code matrices under one coding, and their lists' lengths."""
    flat = [pc.list_flatten(x), pc.list_flatten(y)]
    codes = pa.concat_arrays([f.cast(pa.string()) for f in flat]).dictionary_encode(null_encoding="encode").indices.to_numpy()
    a, na = _coded(x, codes[: len(flat[0])], -1)
    b, nb = _coded(y, codes[len(flat[0]) :], -2)
    return a, b, na, nb


def measured(x: pa.ListArray, y: pa.ListArray, common: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(alignment, lcs) of each pair: the matching-block ratio, and with ``common`` the longest common subsequence over the longer list."""
    return measured_codes(*coded(x, y), common)


def measured_codes(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, common: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """``measured`` of lists as code matrices, padded with -1 and -2, and their lengths."""
    both, longer = na + nb, np.maximum(na, nb)
    if len(a) and 0 < b.shape[1] <= WORD and a.shape[1]:
        step = max(1, CELLS // (a.shape[1] * b.shape[1]))
        rows = np.concatenate([masks(a[k : k + step], b[k : k + step]) for k in range(0, len(a), step)])
        ratio = np.where(both > 0, 2 * mask_blocks(rows, na, nb) / np.maximum(both, 1), 1.0)
        return ratio, mask_lcs(rows) / np.maximum(longer, 1) if common else None
    plain = nb < POPULAR_FROM
    blocks = np.zeros(len(na))
    order = np.flatnonzero(plain)
    step = max(1, CELLS // max(1, a.shape[1] * b.shape[1]))
    for k in range(0, len(order), step):
        rows = order[k : k + step]
        own_a, own_b = a[rows, : na[rows].max(initial=0)], b[rows, : nb[rows].max(initial=0)]
        blocks[rows] = 2 * block_sizes(own_a, own_b, na[rows], nb[rows]) / np.maximum(both[rows], 1)
    for r in np.flatnonzero(~plain):
        blocks[r] = SequenceMatcher(None, a[r, : na[r]].tolist(), b[r, : nb[r]].tolist()).ratio()
    ratio = np.where(both > 0, blocks, 1.0)
    if not common:
        return ratio, None
    lengths = lcs_lengths(a, b) if a.shape[1] and b.shape[1] else np.zeros(len(na), np.int64)
    return ratio, lengths / np.maximum(longer, 1)


def _plain_lists(column: pa.Array) -> pa.ListArray:
    """The column with null lists as empty ones."""
    return pc.if_else(pc.is_valid(column), column, pa.scalar([], column.type)) if column.null_count else column


def aligned(pairs: DataFrame, x: str = "x", y: str = "y", rows: int = 512, common: bool = True) -> DataFrame:
    """``pairs`` with ``alignment`` and, with ``common``, ``lcs`` of its two lists of strings, in place of such columns."""
    new = ("alignment", "lcs") if common else ("alignment",)
    names = [c for c in pairs.columns if c not in new]
    schema = T.StructType([pairs.schema[c] for c in names] + [T.StructField(c, T.DoubleType()) for c in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                ratio, lcs = measured(_plain_lists(part.column(names.index(x))), _plain_lists(part.column(names.index(y))), common)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c) for c in (ratio, lcs) if c is not None)], names=[*names, *new])

    return pairs.select(*names).mapInArrow(run, schema)
