"""Operator 8: toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word (a run of ASCII letters, digits and non-ASCII characters, lower-cased in A-Z) are a vector of its own,
if it is in ``MIN_DF`` or more training texts, and the mean vector of its hashed character trigrams. Both directions of
the network run over windows of ``WINDOW`` words that begin every ``STRIDE`` words, so windows overlap by half and
cover the whole text. Attention pools a window's states into one logit; a text's score is that of its highest window,
calibrated on the training texts.

Training takes at most ``PER_CLASS`` labelled rows of each class and ``SAMPLE_CHARS`` characters a row (longer rows
are not trained on): the rows of the smallest hashed ids whose crc32(id as text) mod 3 is not 1. Word vectors begin
with the word's log odds; at most ``FIRST_WINDOWS``
random windows are first labelled as their text, then each toxic text by its highest windows.

Defined results: texts without words, null or empty ones too, get the score of a window of padding; without labels of
both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Texts, mix, slices, span_hashes, spans_where, tidy

WINDOW, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BITS = 32, 16, 8, 8, 8, 12
PER_CLASS, SAMPLE_CHARS, MIN_DF, THRESHOLD, DECAY = 800, 20_000, 3, 0.7, 1e-5
#: Random windows of the first turn of training, at most.
FIRST_WINDOWS = 12_288
HELD_MOD, HELD_REST = 3, 1

_WORD = np.zeros(256, bool)
_WORD[0x80:] = True
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Windows:
    """A slice's distinct words, their trigrams, and its windows as indices into them (the last index is padding)."""

    def __init__(self, texts: Texts):
        lower = LOWER[texts.buf]
        starts, ends = spans_where(_WORD[lower], texts.bounds)
        self.keys, first, back = np.unique(span_hashes(lower, starts, ends), return_index=True, return_inverse=True)
        self.counts = np.diff(np.searchsorted(starts, texts.bounds))
        s, e = starts[first], ends[first]
        sizes = e - s
        self.tri_first = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(self.tri_first[-1]) + np.repeat(s - self.tri_first[:-1], sizes)
        if len(at):
            mid = lower[at].astype(np.uint64)
            left = np.where(at == np.repeat(s, sizes), 0, lower[np.maximum(at - 1, 0)]).astype(np.uint64)
            right = np.where(at == np.repeat(e - 1, sizes), 0, lower[np.minimum(at + 1, len(lower) - 1)]).astype(np.uint64)
            self.trigrams = (mix((left << np.uint64(16)) | (mid << np.uint64(8)) | right) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)
        else:
            self.trigrams = np.empty(0, np.int64)
        n = self.counts
        many = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
        self.owner = np.repeat(np.arange(texts.n), many)
        self.first = np.concatenate(([0], np.cumsum(many)))
        within = np.arange(self.first[-1]) - np.repeat(self.first[:-1], many)
        base = np.concatenate(([0], np.cumsum(n)))[self.owner] + within * STRIDE
        place = base[:, None] + np.arange(WINDOW)
        inside = within[:, None] * STRIDE + np.arange(WINDOW) < n[self.owner][:, None]
        words = np.append(back, len(self.keys)).astype(np.int32)
        self.index = words[np.where(inside, place, len(back))]


class Network:
    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        g = lambda *shape, scale=0.3: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.vocabulary, h, d = vocabulary, HIDDEN, WORD_DIM + CHAR_DIM
        words = g(len(vocabulary) + 1, WORD_DIM, scale=0.05)
        words[1:, 0] = odds
        words[0] = 0
        self.w = {
            "words": words, "chars": g(1 << CHAR_BITS, CHAR_DIM, scale=0.05), "in": g(d, 6 * h), "bias": np.zeros(6 * h, np.float32),
            "fz": g(h, h), "fr": g(h, h), "fn": g(h, h), "bz": g(h, h), "br": g(h, h), "bn": g(h, h),
            "attend": g(2 * h), "out": g(2 * h), "out0": np.zeros(1, np.float32),
        }
        self.scale, self.shift = 1.0, 0.0

    def known(self, keys: np.ndarray) -> np.ndarray:
        """The vocabulary rows of words, 0 where a word is not in it."""
        where = np.searchsorted(self.vocabulary, keys)
        out = np.zeros(len(keys), np.int64)
        inside = where < len(self.vocabulary)
        out[inside] = np.where(self.vocabulary[where[inside]] == keys[inside], where[inside] + 1, 0)
        return out

    def inputs(self, keys: np.ndarray, trigrams: np.ndarray, tri_first: np.ndarray) -> np.ndarray:
        """Vectors of distinct words; the last row, zeros, is padding."""
        x = np.zeros((len(keys) + 1, WORD_DIM + CHAR_DIM), np.float32)
        x[:-1, :WORD_DIM] = self.w["words"][self.known(keys)]
        if len(keys):
            sums = np.add.reduceat(self.w["chars"][trigrams], tri_first[:-1], axis=0)
            x[:-1, WORD_DIM:] = sums / np.diff(tri_first).astype(np.float32)[:, None]
        return x

    def recurrent(self) -> np.ndarray:
        """Both directions' recurrent weights as one matrix; its columns are z, r, n, each forward then backward."""
        w, h = self.w, HIDDEN
        u = np.zeros((2, h, 3, 2, h), np.float32)
        for g, name in enumerate("zrn"):
            u[0, :, g, 0] = w[f"f{name}"]
            u[1, :, g, 1] = w[f"b{name}"]
        return u.reshape(2 * h, 6 * h)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What words bring to the gates, forward and backward."""
        table = (x @ self.w["in"] + self.w["bias"]).reshape(-1, 3, 2, HIDDEN)
        return tuple(np.ascontiguousarray(table[:, :, k].reshape(-1, 3 * HIDDEN)) for k in (0, 1))

    def forward(self, gates: tuple[np.ndarray, np.ndarray], index: np.ndarray, pad: int, keep: bool = False):
        """Logits of windows; with ``keep``, also what ``backward`` needs."""
        w, h, (n, steps) = self.w, HIDDEN, index.shape
        mask = index != pad
        whole = bool(mask.all())
        front, behind = gates
        u = self.recurrent()
        across = np.ascontiguousarray(index.T)
        state = np.zeros((n, 2 * h), np.float32)
        states = np.empty((steps, n, 2 * h), np.float32)
        a = np.empty((n, 3, 2, h), np.float32)
        flat = a.reshape(n, 6 * h)
        kept = []
        for t in range(steps):
            a[:, :, 0] = front[across[t]].reshape(n, 3, h)
            a[:, :, 1] = behind[across[steps - 1 - t]].reshape(n, 3, h)
            q = state @ u
            zr = _sigmoid(flat[:, : 4 * h] + q[:, : 4 * h])
            z, r, qn = zr[:, : 2 * h], zr[:, 2 * h :], q[:, 4 * h :]
            new = np.tanh(flat[:, 4 * h :] + r * qn)
            after = new + z * (state - new)
            m = None
            if not whole:
                m = np.repeat(np.stack((mask[:, t], mask[:, steps - 1 - t]), axis=1), h, axis=1).astype(np.float32)
                after = state + m * (after - state)
            if keep:
                kept.append((state, z, r, new, qn, m))
            state = after
            states[t] = state
        y = np.concatenate((states[:, :, :h], states[::-1, :, h:]), axis=2)
        e = y @ w["attend"]
        if not whole:
            e[~mask.T] = -1e9
        weight = np.exp(e - e.max(axis=0))
        weight /= weight.sum(axis=0)
        if not keep:
            return (weight * (y @ w["out"])).sum(axis=0) + w["out0"][0]
        pooled = np.einsum("tn,tnd->nd", weight, y)
        return pooled @ w["out"] + w["out0"][0], (kept, y, weight, pooled)

    def backward(self, kept, index: np.ndarray, slope: np.ndarray, n_words: int) -> tuple[dict, np.ndarray]:
        """Gradients of the recurrent weights and of the gates, for d loss / d logit = ``slope``."""
        w, h, steps = self.w, HIDDEN, index.shape[1]
        trail, y, weight, pooled = kept
        grad = {"out": pooled.T @ slope, "out0": slope.sum(keepdims=True)}
        dp = slope[:, None] * w["out"]
        da = np.einsum("tnd,nd->tn", y, dp)
        de = weight * (da - (weight * da).sum(axis=0))
        grad["attend"] = np.einsum("tn,tnd->d", de, y)
        dy = weight[:, :, None] * dp + de[:, :, None] * w["attend"]
        dgates = np.zeros((n_words, 3, 2, h), np.float32)
        for k in ("fz", "fr", "fn", "bz", "br", "bn"):
            grad[k] = np.zeros((h, h), np.float32)
        dh = np.zeros((len(index), 2 * h), np.float32)
        for t in range(steps - 1, -1, -1):
            state, z, r, new, qn, m = trail[t]
            dh = dh + np.concatenate((dy[t, :, :h], dy[steps - 1 - t, :, h:]), axis=1)
            back = 0.0
            if m is not None:
                back = (1 - m) * dh
                dh = m * dh
            dz = dh * (state - new) * z * (1 - z)
            dn = dh * (1 - z) * (1 - new * new)
            dr = dn * qn * r * (1 - r)
            dq = dn * r
            back = back + dh * z
            for way, column in (("f", index[:, t]), ("b", index[:, steps - 1 - t])):
                side = slice(0, h) if way == "f" else slice(h, 2 * h)
                for name, d in zip("zrn", (dz, dr, dq), strict=True):
                    grad[way + name] += state[:, side].T @ d[:, side]
                    back[:, side] += d[:, side] @ w[way + name].T
                np.add.at(dgates[:, :, int(way == "b")], column, np.stack((dz[:, side], dr[:, side], dn[:, side]), axis=1))
            dh = back
        return grad, dgates.reshape(n_words, 6 * h)

    def window_logits(self, win: Windows, block: int = 1024) -> np.ndarray:
        gates = self.gates(self.inputs(win.keys, win.trigrams, win.tri_first))
        return np.concatenate([self.forward(gates, win.index[i : i + block], len(win.keys)) for i in range(0, len(win.index), block)])

    def text_logits(self, win: Windows) -> np.ndarray:
        return np.maximum.reduceat(self.window_logits(win), win.first[:-1]) if len(win.counts) else np.empty(0, np.float32)

    def scores(self, win: Windows) -> np.ndarray:
        return _sigmoid((self.scale * self.text_logits(win) + self.shift).astype(float))


def _step(net: Network, win: Windows, rows: np.ndarray, target: np.ndarray, weight: np.ndarray, moments: dict, count: int, rate: float) -> None:
    pad = len(win.keys)
    used, index = np.unique(np.append(win.index[rows], pad), return_inverse=True)  # the last one is padding
    index = index[:-1].reshape(len(rows), -1)
    used = used[:-1]
    sizes = np.diff(win.tri_first)[used]
    first = np.concatenate(([0], np.cumsum(sizes)))
    trigrams = win.trigrams[np.arange(first[-1]) + np.repeat(win.tri_first[used] - first[:-1], sizes)]
    keys = win.keys[used]
    x = net.inputs(keys, trigrams, first)
    logits, kept = net.forward(net.gates(x), index, len(used), keep=True)
    slope = ((_sigmoid(logits) - target) * weight / weight.sum()).astype(np.float32)
    grad, dgates = net.backward(kept, index, slope, len(x))
    grad["in"], grad["bias"] = x.T @ dgates, dgates.sum(axis=0)
    dx = dgates @ net.w["in"].T
    grad["words"] = np.zeros_like(net.w["words"])
    np.add.at(grad["words"], net.known(keys), dx[:-1, :WORD_DIM])
    grad["words"][0] = 0
    grad["chars"] = np.zeros_like(net.w["chars"])
    np.add.at(grad["chars"], trigrams, np.repeat(dx[:-1, WORD_DIM:] / sizes[:, None], sizes, axis=0).astype(np.float32))
    for k, g in grad.items():
        g = g + DECAY * net.w[k]
        m, v = moments.setdefault(k, (np.zeros_like(net.w[k]), np.zeros_like(net.w[k])))
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        net.w[k] -= rate * ((m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.99**count)) + 1e-7)).astype(np.float32)


def fit(texts: list[str], toxic: list[int], seed: int = 7) -> Network | None:
    """A network for labelled texts; None unless both labels occur."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return None
    whole = next(slices(pa.array(texts, pa.large_string()), limit=1 << 62))
    win = Windows(whole)
    owner = np.repeat(np.arange(len(texts)), win.counts)
    spans = spans_where(_WORD[LOWER[whole.buf]], whole.bounds)
    back = np.searchsorted(win.keys, span_hashes(LOWER[whole.buf], *spans))
    pairs = np.unique(back.astype(np.int64) * len(texts) + owner)
    word, doc = pairs // len(texts), pairs % len(texts)
    bad = np.bincount(word, y[doc], len(win.keys))
    good = np.bincount(word, 1 - y[doc], len(win.keys))
    often = bad + good >= MIN_DF
    odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((good + 0.5) / ((1 - y).sum() + 1))
    sure = (bad + good) / (bad + good + 5)
    net = Network(win.keys[often], np.clip(odds * sure, -3, 3)[often].astype(np.float32))
    rng, moments, count = np.random.default_rng(seed), {}, 0
    of = y[win.owner]
    for turn in range(4):
        if turn == 0:
            rows = rng.permutation(len(win.index))[:FIRST_WINDOWS]
        else:
            logits = net.window_logits(win)
            tops = np.array([win.first[k] + i for k in range(len(texts)) for i in np.argsort(-logits[win.first[k] : win.first[k + 1]], kind="stable")[: 1 if y[k] else 3]])
            others = rng.permutation(np.flatnonzero(of == 0))[: len(tops)]
            rows = rng.permutation(np.unique(np.concatenate((tops, others))))
        weight = np.where(of[rows] == 1, 0.5 / max(1, (of[rows] == 1).sum()), 0.5 / max(1, (of[rows] == 0).sum()))
        for _ in range(1 if turn == 0 else 3):
            for i in range(0, len(rows), 512):
                part = rows[i : i + 512]
                count += 1
                _step(net, win, part, of[part], weight[i : i + 512], moments, count, 0.01 if turn < 3 else 0.004)
    _calibrate(net, net.text_logits(win).astype(float), y)
    return net


def _calibrate(net: Network, logits: np.ndarray, y: np.ndarray) -> None:
    """Logistic regression of the label on a text's logit, both classes of equal weight; the order of scores stays."""
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    a, b = 1.0, -float(np.median(logits))
    for _ in range(50):
        p = _sigmoid(a * logits + b)
        g = weight * (p - y)
        s = weight * p * (1 - p)
        hess = np.array([[(s * logits * logits).sum(), (s * logits).sum()], [(s * logits).sum(), s.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, [(g * logits).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    net.scale, net.shift = max(a, 0.05), b


def held_out(id_column):
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(HELD_MOD)) == HELD_REST


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS) -> Network | None:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    order = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id")
    chosen = known.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_class).select("id", "y")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= sample_chars)
    one = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    got = one.collect()  # a row an id: bounded by per_class and sample_chars
    got = sorted(((r["text"], r["y"]) for r in got), key=lambda r: (r[1], r[0]))
    return fit([r[0] for r in got], [r[1] for r in got])


def scored(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for texts in slices(batch.column(1)):
                found = model.scores(Windows(texts)) if model is not None else np.zeros(texts.n)
                yield pa.record_batch([batch.column(0).slice(texts.rows[0], texts.n), pa.array(found, pa.float64())], ["id", "score"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(tidy(run), f"id {kind}, score double").withColumnRenamed("id", id_col)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Operator 8 over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scored(docs, net)
    return found.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
