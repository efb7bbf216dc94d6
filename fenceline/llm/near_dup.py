"""Operator 10: near-duplicate documents by circulant MinHash.

A document's set holds its distinct ``width``-word shingles (words lower-cased in A-Z; with fewer words, the whole
sequence is the one shingle; without words the set is empty and linked with nothing). Two documents are linked when
``100 * |intersection| >= percent * |union|``; groups are the connected components of the links.

Plan
----
1. One Arrow pass finds each document's set, its 128-bit key, and a signature from two permutations: sigma places a
   shingle on a circle, pi is read from there on, ``bands * rows`` places, and the smallest value for each place is a
   coordinate. A whole window of pi is one contiguous read, so all coordinates of a shingle cost one gather.
2. Documents with equal sets collapse into a class at once, whatever their number.
3. Up to ``TURNS`` turns over the buckets of all bands: a bucket that still holds several components offers its other
   classes the head of its largest one, which is the class with the most bucket mates in all bands (in a group of copies
   most likely the text they come from). A class takes the head that most of its buckets offer and that it has not been
   held against, so a turn tests one pair a class at most. Pairs are confirmed on full sets and connected.
4. What then still shares a bucket across components is paired too, but for classes without a mate by an exact prefix filter
   on their rarest shingles (``prefix_mates``) and for pairs that cannot reach the threshold because of their sizes, or because
   too few of a class's shingles occur anywhere else among these candidates (both exact bounds). So a bucket is a star first
   and loses no link after, and texts on one template below the threshold, however many share a bucket, make no pairs.

Nothing is collected; joins on a class or a bucket are plain shuffles that adaptive execution can split when skewed.

Defined results: null or empty text has an empty set, forms its own component and is kept. Of every other component
one row is kept: that of the smallest id (nulls last), among these that of the smallest text hash. Its id is the
component's, so a component whose rows all have a null id has a null one. Repeated ids and rows count as copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SLICE_BYTES, Texts, discard, mix, shingles, slices, span_hashes, tidy, written

WIDTH, PERCENT, BANDS, ROWS, TURNS = 5, 75, 32, 4, 2
#: Places on the circle that sigma maps to and pi permutes.
CIRCLE = 1 << 20
_pi: dict[int, np.ndarray] = {}


def _windows(k: int) -> np.ndarray:
    """View [i, j] = pi[(i + j) mod CIRCLE], for j < k."""
    if k not in _pi:
        pi = np.random.default_rng(77).permutation(CIRCLE).astype(np.uint32)
        _pi[k] = np.lib.stride_tricks.sliding_window_view(np.concatenate((pi, pi[: k - 1])), k)
    return _pi[k]


def signature(distinct: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` circulant MinHash coordinates of a set of 64-bit shingles."""
    windows = _windows(k)
    places = (mix(distinct ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64)
    out = np.full(k, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(places), 2048):
        np.minimum(out, windows[places[i : i + 2048]].min(axis=0), out=out)
    return out


def shingle_sets(texts: Texts, width: int) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct shingle hashes."""
    lower = LOWER[texts.buf]
    starts, ends, first = texts.words()
    words = span_hashes(lower, starts, ends)
    every, at = shingles(words, first, width)
    for k in range(texts.n):
        lo, hi = at[k], at[k + 1]
        if hi > lo:
            part = np.sort(every[lo:hi])
            yield part[np.concatenate(([True], part[1:] != part[:-1]))]
        elif first[k + 1] > first[k]:
            raw = words[first[k] : first[k + 1]].tobytes()
            yield np.frombuffer(hashlib.blake2b(raw, digest_size=8, person=b"short").digest(), np.uint64)
        else:
            yield np.empty(0, np.uint64)


def _key(distinct: np.ndarray) -> bytes:
    return hashlib.blake2b(distinct.tobytes(), digest_size=16).digest()


def _fingerprints(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            sizes, keys, marks = [], [], []
            for texts in slices(batch.column(1)):
                for found in shingle_sets(texts, width):
                    sizes.append(len(found))
                    if not len(found):
                        keys.append(None)
                        marks.append(None)
                        continue
                    keys.append(_key(found))
                    parts = signature(found, bands * rows).reshape(bands, rows).astype(np.uint64)
                    h = numbers.copy()
                    for r in range(rows):
                        h = mix(h ^ parts[:, r]) + numbers
                    marks.append(h.view(np.int64))
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.list_(pa.int64()))],
                ["id", "mark", "n_shingles", "set_key", "bands"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            for texts in slices(batch.column(0), limit=SLICE_BYTES):
                found = {_key(x): x for x in shingle_sets(texts, width) if len(x)}
                keys = [k for k in found if k not in met]
                met.update(keys)
                found = [found[k] for k in keys]
                if found:
                    flat = np.concatenate(found).view(np.int64)
                    at = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                    yield pa.record_batch(
                        [pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                        ["set_key", "shingles"],
                    )

    return run


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest node of each node's connected component, for the nodes in ``edges`` (a, b).

    Smallest neighbouring label, then the label's own label, until nothing changes; each round is a written table.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = written(labels, f"{name}-labels")
    while True:
        around = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        )
        nearer = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(nearer.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), f"{name}-labels")
        before, labels = labels, new.select("node", "label")
        discard(before)
        if new.where(F.col("old") != F.col("label")).isEmpty():
            discard(both)
            return labels


def _reaches(common, a, b, percent: int):
    """Whether an intersection of ``common`` makes sets of sizes a and b similar enough."""
    return (100 + percent) * common >= percent * (a + b)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.select("a", "b")
        .join(left, "a")
        .join(right, "b")
        .where(_reaches(common.cast("long"), F.size("of_a"), F.size("of_b"), percent))
        .select("a", "b")
        .distinct()
    )


def _mark(id_col: str, text_col: str):
    """Equal for rows alike in id and text, and never null."""
    own = F.concat(F.lit(":"), F.col(id_col).cast("string"))
    return F.concat(F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")), F.coalesce(own, F.lit("")))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(``id_col``, n_shingles, component_id, kept), one row per input row; see the module's text.

    A pair at the threshold of 0.75 shares no band with probability (1 - 0.75 ** 4) ** 32 = 5e-6.
    """
    return _marked(docs, id_col, text_col, width, percent, bands, rows).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _marked(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, mark, n_shingles, component_id, kept), one row per input row."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _mark(id_col, text_col).alias("mark"))
    id_type = texts.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, mark string, n_shingles long, set_key binary, bands array<long>"
    prints = written(texts.mapInArrow(tidy(_fingerprints(width, bands, rows)), schema).withColumn("row", F.monotonically_increasing_id()), "prints")
    full = prints.where("set_key is not null")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark", "row"))
    classes = written(full.groupBy("set_key").agg(first.alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    members = classes.select("set_key", "n", F.explode("bands").alias("band"))
    heads = members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(members.join(heads, "band").select("band", "set_key", "n", "size"), "met")
    mates = shared.groupBy("set_key").agg(F.sum("size").alias("mates"))
    shared = written(shared.drop("size").join(mates, "set_key"), "shared")
    labels = None
    if not shared.isEmpty():
        close = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))
        wanted = classes.join(shared.select("set_key").distinct(), "set_key", "left_semi").select("first.mark")
        sets = written(
            texts.join(wanted, "mark", "left_semi").select("text").mapInArrow(tidy(_sets(width)), "set_key binary, shingles array<long>"), "sets"
        )
        if not sets.groupBy("set_key").agg(F.count("*").alias("of")).where("of > 1").isEmpty():  # rows alike in id and text
            sets = written(sets.dropDuplicates(["set_key"]), "sets")
        labelled, tried = shared.withColumn("label", F.col("set_key")), None
        for _ in range(TURNS):
            pairs = written(_offers(labelled, tried, close), "stars")
            if pairs.isEmpty():
                break
            found = written(_confirmed(pairs, sets, percent), "links")
            tried = pairs if tried is None else tried.union(pairs)
            if not found.isEmpty():
                labels = _joined(labels, found)
                labelled = _labelled(shared, labels)
        later = _across(written(labelled, "labelled"), classes, sets, percent, close)
        if later is not None:
            labels = _joined(labels, later)
    named = classes.select("set_key", "first")
    if labels is not None:
        named = named.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
        tops = named.groupBy("label").agg(F.min("first").alias("first"))
        named = named.drop("first").join(tops, "label")
    named = named.select("set_key", F.col("first.id").alias("component_id"), F.col("first.row").alias("first_row"))
    out = prints.drop("bands").join(named, "set_key", "left")
    alone = F.col("set_key").isNull()
    return out.select(
        "id", "mark", "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("row") == F.col("first_row"))).alias("kept")
    )


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) after further links: only the components that they touch are connected anew."""
    if labels is None:
        return components(links, "turn")
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a != b")
    tops = components(between, "turn").select(F.col("node").alias("label"), F.col("label").alias("top"))
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(labels, "node", "left_anti")
    every = labels.unionByName(nodes.withColumn("label", F.col("node")))
    return written(every.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")


def _labelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """``shared`` with each class's component, itself where it has no link yet."""
    return shared.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))


def _offers(labelled: DataFrame, tried: DataFrame | None, close) -> DataFrame:
    """(a, b): for each class that shares a bucket with another component at most one pair, with the head that most of its buckets offer, none of ``tried``."""
    head = F.max(F.struct("mates", F.xxhash64("set_key").alias("o"), "set_key", "n")).alias("head")
    parts = labelled.groupBy("band", "label").agg(F.count("*").alias("size"), head)
    tops = parts.groupBy("band").agg(F.max(F.struct("size", "head", "label")).alias("top"), F.count("*").alias("n_labels"))
    tops = tops.where("n_labels > 1").select("band", F.col("top.label").alias("main"), F.col("top.head").alias("head"))
    own = labelled.join(tops, "band").where((F.col("label") != F.col("main")) & close(F.col("n"), F.col("head.n")))
    offered = own.groupBy("set_key", F.col("head.set_key").alias("head")).agg(F.count("*").alias("times"))
    offered = offered.withColumn("a", F.least("set_key", "head")).withColumn("b", F.greatest("set_key", "head"))
    if tried is not None:
        offered = offered.join(tried, ["a", "b"], "left_anti")
    return offered.groupBy("set_key").agg(F.max(F.struct("times", "head", "a", "b")).alias("best")).select("best.a", "best.b").distinct()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their group; rows alike in id and text count once."""
    mark = "mark" + "_" * max(map(len, docs.columns), default=0)  # longer than any column of ``docs``
    kept = _marked(docs, id_col, text_col).where("kept").select(F.col("mark").alias(mark)).distinct()
    return docs.withColumn(mark, _mark(id_col, text_col)).join(kept, mark, "left_semi").dropDuplicates([mark]).select(*docs.columns)


def prefix_mates(sets: DataFrame, percent: int) -> DataFrame:
    """(set_key, elsewhere): those classes of ``sets`` (set_key, n, label, shingles) that may be linked with one of another label.

    ``elsewhere`` is how many of a class's shingles occur in other classes. Exact prefix filter: with shingles in order of how many of these
    sets hold them, two sets with an intersection of at least m share one of the first n - m + 1 of each. At the threshold,
    with t = percent / 100, the larger set meets t of its own size and the smaller one 2t / (1 + t) of its own; so the smaller
    set offers a shorter prefix than the larger one asks with. A shingle that no other set holds takes its place in the prefix:
    texts that share a template below the threshold differ in more of their rarest shingles than the prefix is long, and have no
    mates. Which labels offer and ask for a shingle is one small aggregate a shingle; no pairs are made.
    """
    every = sets.select("set_key", F.explode("shingles").alias("shingle"))
    often = every.groupBy("shingle").agg(F.count("*").alias("of")).where("of > 1")
    found = every.join(often, "shingle").groupBy("set_key").agg(F.array_sort(F.collect_list(F.struct("of", "shingle"))).alias("common"))
    n, alone = F.col("n"), F.col("n") - F.size("common")
    asks = n - F.ceil(percent * n / 100).cast("long") + 1 - alone
    offers = n - F.ceil(2 * percent * n / (100 + percent)).cast("long") + 1 - alone
    ranked = sets.select("set_key", "n", "label").join(found, "set_key").withColumns({"asks": asks, "offers": offers}).where("asks > 0")
    first = F.slice("common", 1, F.col("asks").cast("int"))["shingle"]
    ranked = written(ranked.select("set_key", "label", F.size("common").cast("long").alias("elsewhere"), "offers", F.posexplode(first).alias("at", "shingle")), "prefixes")
    offered = F.col("at") < F.col("offers")
    own = ranked.withColumn("offered", F.when(offered, F.col("label")))
    sides = own.groupBy("shingle").agg(F.min("label").alias("a0"), F.max("label").alias("a1"), F.min("offered").alias("o0"), F.max("offered").alias("o1")).where("a0 != a1 AND o0 IS NOT NULL")
    other = lambda low, high: (F.col(low) != F.col("label")) | (F.col(high) != F.col("label"))
    met = own.join(sides, "shingle").where(other("o0", "o1") | (F.col("offered").isNotNull() & other("a0", "a1")))
    return met.select("set_key", "elsewhere").distinct()


def _across(labelled: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, close) -> DataFrame | None:
    """Links between components that still meet in a bucket; None when no bucket holds two."""
    parts = labelled.groupBy("band", "label").agg(F.count("*").alias("size"))
    mains = parts.groupBy("band").agg(F.max(F.struct("size", "label")).alias("main"), F.count("*").alias("n_labels")).where("n_labels > 1")
    mixed = written(labelled.join(mains.select("band", F.col("main.label").alias("main")), "band"), "mixed")
    if mixed.isEmpty():
        return None
    open_ = sets.join(mixed.select("set_key", "n", "label").distinct(), "set_key")
    mates = written(prefix_mates(open_, percent), "mates")
    mixed = written(mixed.join(mates, "set_key"), "mated")
    less = mixed.where(F.col("label") != F.col("main")).select("band", F.col("set_key").alias("x"), F.col("n").alias("nx"), F.col("label").alias("lx"), F.col("elsewhere").alias("ex"))
    other = mixed.select("band", F.col("set_key").alias("y"), F.col("n").alias("ny"), F.col("label").alias("ly"), F.col("elsewhere").alias("ey"))
    bound = _reaches(F.least("ex", "ey"), F.col("nx"), F.col("ny"), percent)
    may = (F.col("lx") != F.col("ly")) & close(F.col("nx"), F.col("ny")) & bound
    near = F.col("x.band") == F.col("y.band")
    less = written(less.where(100 * F.col("ex") >= percent * F.col("nx")), "less")
    other = written(other.alias("y").join(less.alias("x"), near & may, "left_semi"), "other")
    less = less.alias("x").join(other.alias("y"), near & may, "left_semi")
    whole = sets.join(classes.select("set_key", "bands"), "set_key")
    left = less.join(whole.select(F.col("set_key").alias("x"), F.col("shingles").alias("of_x"), F.col("bands").alias("bands_x")), "x")
    right = other.join(whole.select(F.col("set_key").alias("y"), F.col("shingles").alias("of_y"), F.col("bands").alias("bands_y")), "y")
    first = F.array_min(F.array_intersect("bands_x", "bands_y")) == F.col("x.band")  # a pair is met once, whatever it shares
    common = F.size(F.array_intersect("of_x", "of_y")).cast("long")
    links = (
        left.alias("x")
        .join(right.alias("y"), near & may & first & _reaches(common, F.col("nx"), F.col("ny"), percent))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    return written(links, "later")


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Operator 10 over all of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
