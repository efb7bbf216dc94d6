"""Operator 3: SentencePiece encoding with the n best segmentations, and decoding.

A text is normalized as the model says (one leading and every other space become U+2581); its segmentations are the
paths of a lattice whose edges are the vocabulary's pieces, scored by the sum of piece scores. A character that is no
piece is an edge to its byte pieces, ``UNKNOWN`` below the worst piece.

1. The lattice falls apart, exactly, between two characters that stand side by side in no piece. Each distinct part
   of a slice is solved once: forward Viterbi scores, backward scores and so the loss of a part's second-best path,
   for all parts together in numpy.
2. Only the ``n - 1`` parts of a text with the smallest second-best losses can differ from the best in its ``n`` best
   segmentations. On these, backward A-star search from the part's end takes the forward Viterbi scores as an exact
   heuristic, so every path taken from the heap is the next best one.
3. A text's n best are the n smallest sums of losses over these parts.

Scores of this vocabulary are whole numbers, so sums are exact. Equal scores: the longest last piece first in the best
path, then the order of the search, which depends on the text alone. Defined results: null and empty texts have one
segmentation, without ids, of score 0. U+2581 in a text decodes as a space, the only case that doesn't come back.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, slices, tidy, vocabulary

N_BEST, UNKNOWN, SPACE, SLICE = 4, 10.0, 0x2581, 6 << 20
_STEP = np.uint64(0x9FB21C651E98DF25)
_BASE, _BASE_INV = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_loaded: dict = {}


def _code_keys(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(1))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``size`` numbers each."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _by_level(level: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The stable order by (level, node); a 16-bit level is sorted by radix."""
    order = np.argsort(node.astype(np.int32) if len(node) and node.max() < 1 << 31 else node, kind="stable")
    level = level[order]
    return order[np.argsort(level.astype(np.uint16) if level.max() < 1 << 16 else level, kind="stable")]


class Pieces:
    """The vocabulary: prefixes of pieces by hash, pairs of characters that pieces hold, and the pieces' bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.score = np.array([model.get_score(i) for i in range(n)], float)
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        names = {i: model.id_to_piece(i) for i in plain}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.unknown = min(s for s in self.score[plain] if s > -1e8) - UNKNOWN
        found: dict[int, int] = {}
        chars = sorted({c for x in names.values() if len(x) > 1 for c in map(ord, x)})
        self.char = np.zeros(0x110000, np.int16)
        self.char[chars] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        self.longest = max(map(len, names.values()))
        #: Of one and of two characters: the piece, or -1; and of two whether some longer piece begins so.
        self.single = np.full(0x110000, -1, np.int32)
        self.pair = np.full(self.beside.shape, -1, np.int32)
        self.opens = np.zeros(self.beside.shape, bool)
        for i, x in names.items():
            if len(x) == 1:
                self.single[ord(x)] = i
            elif len(x) == 2:
                self.pair[self.char[ord(x[0])], self.char[ord(x[1])]] = i
            else:
                self.opens[self.char[ord(x[0])], self.char[ord(x[1])]] = True
            codes = codes_of(x)
            for a, b in itertools.pairwise(codes):
                self.beside[self.char[a], self.char[b]] = True
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for k, key in enumerate(_code_keys(codes)):
                    h = h * _STEP + key
                    found.setdefault(int(h), -1)
                    if k == len(codes) - 1:
                        found[int(h)] = i
        self.prefixes = np.array(sorted(found), np.uint64)
        self.prefix_id = np.array([found[int(h)] for h in self.prefixes], np.int32)
        raw = [names[i].replace(chr(SPACE), " ").encode() if i in names else b"" for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate(([0], np.cumsum([len(x) for x in raw])))

    @staticmethod
    def of(path: str) -> Pieces:
        if path not in _loaded:
            _loaded[path] = Pieces(path)
        return _loaded[path]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, back to back; the first space is the one that encoding put there."""
        sizes = np.diff(self.raw_at)[ids]
        out = self.raw[_ranges(self.raw_at[ids], sizes)].tobytes() if len(ids) else b""
        return out[1:] if out[:1] == b" " else out


class Lattice:
    """The piece lattices of units, which are spans [start, end) of ``codes``; all of a slice's units at once.

    Node numbers run over the units in order, one more than its characters each.
    """

    def __init__(self, pieces: Pieces, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.pieces, self.n = pieces, len(starts)
        sizes = ends - starts
        self.codes = codes[_ranges(starts, sizes)]
        self.sizes, unit = sizes, np.repeat(np.arange(self.n), sizes)
        self.first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        self.last = self.first + sizes
        ends_ = np.cumsum(sizes)[unit]
        every = np.arange(len(self.codes))
        froms, tos, ids = [every + unit], [every + unit + 1], [pieces.single[self.codes]]  # a single character always has an edge
        at = np.flatnonzero(every + 1 < ends_)
        chars = pieces.char[self.codes]
        left, right = chars[at], chars[at + 1]
        found = pieces.pair[left, right]
        edge = found >= 0
        froms.append(at[edge] + unit[at[edge]])
        tos.append(froms[-1] + 2)
        ids.append(found[edge])
        at = at[pieces.opens[left, right] & (at + 2 < ends_[at])]
        h = _code_keys(self.codes[at]) * _STEP + _code_keys(self.codes[at + 1])
        for k in range(3, pieces.longest + 1):
            if not len(at):
                break
            h = h * _STEP + _code_keys(self.codes[at + k - 1])
            where = np.minimum(np.searchsorted(pieces.prefixes, h), len(pieces.prefixes) - 1)
            known = pieces.prefixes[where] == h
            found = np.where(known, pieces.prefix_id[where], -1)
            edge = found >= 0
            froms.append(at[edge] + unit[at[edge]])
            tos.append(froms[-1] + k)
            ids.append(found[edge])
            go = known & (at + k < ends_[at])
            at, h = at[go], h[go]
        self.src, self.dst, self.id = (np.concatenate(x[::-1]) for x in (froms, tos, ids))  # longer pieces first
        self.score = np.where(self.id >= 0, pieces.score[self.id], pieces.unknown)
        owner = np.repeat(np.arange(self.n), sizes + 1)
        self.edge_unit = owner[self.src]
        self.nodes = len(owner)

    def _relaxed(self, order: np.ndarray, level: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score of each node, level by level, and the edge that gives it (the first of equals)."""
        value, best = np.zeros(self.nodes), np.full(self.nodes, -1)
        level, near, far, score = level[order], near[order], far[order], self.score[order]
        new = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1])))
        sizes = np.diff(np.append(new, len(near)))
        edges_at = np.searchsorted(level, np.arange(1, int(level[-1]) + 2))
        groups_at = np.searchsorted(new, edges_at)
        for p in range(len(edges_at) - 1):
            lo, hi, g, e = edges_at[p], edges_at[p + 1], groups_at[p], groups_at[p + 1]
            if lo == hi:
                continue
            sums = value[far[lo:hi]] + score[lo:hi]
            starts = new[g:e] - lo
            top = np.maximum.reduceat(sums, starts)
            value[near[new[g:e]]] = top
            same = np.flatnonzero(sums == np.repeat(top, sizes[g:e]))
            best[near[new[g:e]]] = order[lo + same[np.searchsorted(same, starts)]]
        return value, best

    def solve(self) -> None:
        """Forward and backward scores, each unit's best ids and the loss of its second-best path."""
        if not self.n:
            self.ids, self.path_unit, self.loss, self.forward = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0), np.empty(0)
            return
        start, end = self.first[self.edge_unit], self.last[self.edge_unit]
        to, left = self.dst - start, end - self.src
        self.forward, self.best = self._relaxed(_by_level(to, self.dst), to, self.dst, self.src)
        backward, _ = self._relaxed(_by_level(left, self.src), left, self.src, self.dst)
        chosen = np.zeros(len(self.src), bool)
        node, start = self.last, self.first
        while len(node):
            edge = self.best[node]
            chosen[edge] = True
            node = self.src[edge]
            go = node != start
            node, start = node[go], start[go]
        through = self.forward[self.src] + self.score + backward[self.dst]
        second = np.full(self.n, -np.inf)
        np.maximum.at(second, self.edge_unit[~chosen], through[~chosen])
        self.loss = self.forward[self.last] - second
        path = np.flatnonzero(chosen)
        path = path[np.argsort(self.src[path])]
        self.ids, self.path_unit = self.id[path], self.edge_unit[path]
        self.path_code = self.codes[self.src[path] - self.path_unit]

    def emitted(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units' best paths, bytes in place of unknown characters, and how many each unit has."""
        if not self.n:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        ids, sizes = self.ids, np.ones(len(self.ids), np.int64)
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            codes = self.path_code[odd]
            sizes[odd] = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
            out = np.repeat(ids, sizes)
            raw = np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le", "replace").encode(), np.uint8)
            out[out < 0] = self.pieces.byte_ids[raw]
            ids = out
        return ids.astype(np.int32), np.bincount(self.path_unit, sizes, self.n).astype(np.int64)

    def search(self, k: int, incoming: tuple[np.ndarray, np.ndarray], n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best (loss, ids) of unit ``k``, best first: backward A-star from the unit's end.

        A partial path's value is its own score and the forward score of the node it has come to, which is exact. A
        partial path that goes on by a node's best edge keeps its value, so it is followed at once; its other edges wait in the
        heap.
        """
        order, at = incoming
        start, end = int(self.first[k]), int(self.last[k])
        heap: list = [(0.0, 0, end, None)]
        tick, out = itertools.count(1), []
        while heap and len(out) < n:
            loss, _, node, trail = heapq.heappop(heap)
            while node != start:
                top = int(self.best[node])
                for e in order[at[node] : at[node + 1]]:
                    e = int(e)
                    if e != top:
                        worse = self.forward[node] - self.forward[self.src[e]] - self.score[e]
                        heapq.heappush(heap, (loss + worse, next(tick), int(self.src[e]), (e, trail)))
                node, trail = int(self.src[top]), (top, trail)
            ids: list[int] = []
            while trail is not None:
                e, trail = trail
                if self.id[e] >= 0:
                    ids.append(int(self.id[e]))
                else:
                    ids.extend(self.pieces.byte_ids[list(chr(self.codes[self.src[e] - k]).encode("utf-8", "replace"))].tolist())
            out.append((float(loss), ids))
        return out

    def incoming(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges by the node they lead to, and where each node's begin."""
        order = np.argsort(self.dst, kind="stable")
        return order, np.searchsorted(self.dst[order], np.arange(self.nodes + 1))


def _units(pieces: Pieces, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of texts begin and end: a part never goes on where no piece can."""
    chars = pieces.char[codes]
    cut = np.ones(len(codes), bool)
    cut[1:] = ~pieces.beside[chars[:-1], chars[1:]]
    cut[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(codes)) if len(starts) else starts


def _unit_keys(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_code_keys(codes) * powers(_BASE, n + 1)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_BASE_INV, n + 1)[starts] + (ends - starts).astype(np.uint64))


def combined(best: np.ndarray, at: np.ndarray, options: list[tuple[int, list[tuple[float, list[int]]]]], n: int) -> list[tuple[float, np.ndarray]]:
    """The ``n`` segmentations of a text with the least (loss, choices): ``options`` are its parts that may differ."""
    out: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for _, ways in options:
        out = heapq.nsmallest(n, ((loss + w[0], (*took, j)) for loss, took in out for j, w in enumerate(ways)))
    found = []
    for loss, took in out:
        parts, done = [], 0
        for (u, ways), j in zip(options, took, strict=True):
            if j:
                parts += [best[done : at[u]], np.array(ways[j][1], np.int32)]
                done = at[u + 1]
        found.append((loss, np.concatenate([*parts, best[done:]]) if parts else best))
    return found


def segment(pieces: Pieces, codes: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[list[tuple[float, np.ndarray]]]:
    """For each text (code points [bounds[k], bounds[k + 1]) of ``codes``) its ``n`` best (score, ids), best first."""
    starts, ends = _units(pieces, codes, bounds)
    _, first, back = np.unique(_unit_keys(codes, starts, ends), return_index=True, return_inverse=True)
    lattice = Lattice(pieces, codes, starts[first], ends[first])
    lattice.solve()
    ids, sizes = lattice.emitted()
    ids_at = np.concatenate(([0], np.cumsum(sizes)))
    of = sizes[back]
    flat = ids[_ranges(ids_at[back], of)]
    flat_at = np.concatenate(([0], np.cumsum(of)))
    unit_at = np.searchsorted(starts, bounds)
    scores = lattice.forward[lattice.last][back] if lattice.n else np.empty(0)
    losses = lattice.loss[back]
    near = []
    for k in range(len(bounds) - 1):
        own = losses[unit_at[k] : unit_at[k + 1]]
        if n > 1 and len(own) >= n:  # with ties at the edge, the first ones in the text
            edge = np.partition(own, n - 2)[n - 2]
            under, level = np.flatnonzero(own < edge), np.flatnonzero(own == edge)
            own_near = np.sort(np.concatenate((under, level[: n - 1 - len(under)])))
        else:
            own_near = np.arange(len(own) if n > 1 else 0)
        near.append(own_near[np.isfinite(own[own_near])] + unit_at[k])
    needed = np.unique(back[np.concatenate(near)]) if near else np.empty(0, np.int64)
    ways: dict[int, list] = {}
    if len(needed):
        few = Lattice(pieces, codes, starts[first[needed]], ends[first[needed]])
        few.solve()
        incoming = few.incoming()
        ways = {int(u): few.search(i, incoming, n) for i, u in enumerate(needed)}
    for k in range(len(bounds) - 1):
        lo, hi = unit_at[k], unit_at[k + 1]
        best = flat[flat_at[lo] : flat_at[hi]]
        options = [(int(u) - lo, ways[int(back[u])]) for u in near[k]]
        total = float(scores[lo:hi].sum())
        yield [(total - loss, found) for loss, found in combined(best, flat_at[lo : hi + 1] - flat_at[lo], options, n)]


def _segmented(column: pa.Array, path: str, n: int) -> Iterator[tuple[int, bytes, list[tuple[float, np.ndarray]]]]:
    """(row, text bytes, segmentations) of each text of an Arrow column."""
    pieces = Pieces.of(path)
    for texts in slices(column, limit=SLICE):
        parts, bounds = [], [0]
        for k in range(texts.n):
            text = texts.text(k)
            codes = codes_of(" " + text if text else "").copy()
            codes[codes == 0x20] = SPACE
            parts.append(codes)
            bounds.append(bounds[-1] + len(codes))
        found = segment(pieces, np.concatenate(parts) if parts else np.empty(0, np.uint32), np.array(bounds), n)
        for k, ways in enumerate(found):
            yield int(texts.rows[k]), texts.buf[texts.bounds[k] : texts.bounds[k + 1]].tobytes(), ways


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST, vocab: str | None = None) -> DataFrame:
    """(``id_col``, segmentations array<struct<score double, ids array<int>>>): each text's ``n`` best, best first."""
    path = vocab or vocabulary("piece_bpe_32k.model")
    kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ways = [[{"score": s, "ids": ids} for s, ids in found] for _, _, found in _segmented(part.column(1), path, n)]
                yield pa.record_batch([part.column(0), pa.array(ways, kind)], ["id", "segmentations"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, segmentations array<struct<score:double,ids:array<int>>>"
    return texts.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocab: str | None = None) -> DataFrame:
    """(``id_col``, text) of rows of ids; null ids give an empty text."""
    path = vocab or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in batches:
            texts = [pieces.decode_bytes(np.array(x or [], np.int32)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    picked = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(tidy(run), f"id {picked.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


_DIGEST = "n_pieces long, score double, ids_crc32 long, n_found int, last_score double, nbest_crc32 long, round_trip boolean"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST, vocab: str | None = None) -> DataFrame:
    """For each row: pieces, score and crc32 of the best segmentation; how many were found, the last one's score, the crc32 of all their
    ids; and whether every one of them decodes to the text."""
    path = vocab or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in batches:
            out = []
            for _, raw, ways in _segmented(batch.column(1), path, n):
                best, every = ways[0][1].astype("<u4"), 0
                plain = raw.replace("▁".encode(), b" ")
                same = all(pieces.decode_bytes(ids) == plain for _, ids in ways)
                for _, ids in ways:
                    every = zlib.crc32(ids.astype("<u4"), every)
                out.append((len(best), ways[0][0], zlib.crc32(best), len(ways), ways[-1][0], every, same))
            if out:
                kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.bool_())
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.record_batch([batch.column(0), *columns], ["id", "n_pieces", "score", "ids_crc32", "n_found", "last_score", "nbest_crc32", "round_trip"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(tidy(run), f"id {texts.schema['id'].dataType.simpleString()}, {_DIGEST}").withColumnRenamed("id", id_col)


def op3_sentencepiece_nbest(spark, sf_dir: str) -> DataFrame:
    """Operator 3 over all of ``documents``."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
