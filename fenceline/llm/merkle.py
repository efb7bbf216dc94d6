"""Operator 12: a Merkle manifest of a table, a tree a part and one over the parts.

A row's leaf is the SHA-256 of its columns, each ``-`` if null and else its UTF-8 byte count, ``:`` and value. A part's leaves
ascend by id; while several nodes remain, every ``fanout`` consecutive ones (the last run may be shorter) become the hash
of their concatenated hex digests. The parts' subroots, null part first and then bytewise, are reduced likewise.

1. Leaves are hashed JVM-side and numbered within their part without a window over it: range partitions are sorted, numbered
   in order, and a row a partition and part gives the offsets.
2. ``fanout ** depth`` leaves at aligned places are a block, one group of a grouped Arrow step: a contiguous byte matrix of hex
   digests, reshaped by the fanout and hashed row by row, level by level. Block roots are the leaves of the next step,
   until each part has one node; so a step's memory is a block, whatever the part's share of the rows.
3. The way back hands each block the siblings of its path to the root. Within a block every sibling's place is arithmetic on
   the leaf's place, so a row's proof is folded without a stored tree.

A lone last node is hashed up like any run as long as its part has several nodes, so a block of a part with several
blocks always has all its ``depth`` levels.

Defined results: null ids come first, as one id that no row is checked under (they are never tampered with); rows of the
same id are ordered by their leaves, so repeated rows are equal leaves at neighbouring places; a null part is a part of its
own, apart from the empty string; a null or empty text is ``-`` or ``0:``. An empty table gives no rows. Extra columns are
no part of a leaf.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

COLUMNS, FANOUT, DEPTH, HEX = ("doc_id", "source", "lang", "n_chars", "text"), 2, 10, 64
#: Rows of a sorted range, about.
RANGE_ROWS = 1 << 20
_PATH = "lefts array<string>, rights array<string>"


# --------------------------------------------------------------------------- a block in numpy


def hashed(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hex digests, an (n, 64) byte matrix, of the first ``sizes`` bytes of each row of a byte matrix."""
    data, width = np.ascontiguousarray(rows).data.cast("B") if rows.size else b"", rows.shape[1]
    found = "".join(sha256(data[i * width : i * width + size]).hexdigest() for i, size in enumerate(sizes.tolist()))
    return np.frombuffer(found.encode(), np.uint8).reshape(-1, HEX)


def levels(leaves: np.ndarray, fanout: int, depth: int | None) -> list[np.ndarray]:
    """A block's nodes, level by level: up to ``depth`` levels above the leaves, or where it is None until one node is left."""
    found = [leaves]
    while len(found) <= depth if depth is not None else len(found[-1]) > 1:
        nodes = found[-1]
        runs = -(-len(nodes) // fanout)
        padded = np.zeros((runs * fanout, HEX), np.uint8)
        padded[: len(nodes)] = nodes
        sizes = np.minimum(fanout, len(nodes) - np.arange(runs) * fanout) * HEX
        found.append(hashed(padded.reshape(runs, fanout * HEX), sizes))
    return found


def _runs(nodes: np.ndarray, place: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place at this level the nodes of its run (n, fanout, 64), its own place in it, and the run's length."""
    start = place // fanout * fanout
    of = np.minimum(start[:, None] + np.arange(fanout), len(nodes) - 1)
    return nodes[of], place - start, np.minimum(fanout, len(nodes) - start)


def climbed(tree: list[np.ndarray], values: np.ndarray, fanout: int) -> np.ndarray:
    """What each leaf's path gives at the block's root when ``values`` stand in the leaves' places, one at a time."""
    place, at = np.arange(len(values)), np.arange(len(values))
    for nodes in tree[:-1]:
        runs, own, sizes = _runs(nodes, place, fanout)
        runs[at, own] = values
        values, place = hashed(runs.reshape(len(at), fanout * HEX), sizes * HEX), place // fanout
    return values


def siblings(tree: list[np.ndarray], fanout: int) -> list[bytes]:
    """For each leaf its siblings within the block, level by level, left to right."""
    n, place, parts, real = len(tree[0]), np.arange(len(tree[0])), [], []
    for nodes in tree[:-1]:
        runs, own, sizes = _runs(nodes, place, fanout)
        of = np.arange(fanout)
        parts.append(runs)
        real.append((of < sizes[:, None]) & (of != own[:, None]))
        place = place // fanout
    if not parts:
        return [b""] * n
    nodes, real = np.concatenate(parts, axis=1), np.concatenate(real, axis=1)
    return [nodes[i][real[i]].tobytes() for i in range(n)]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, HEX)


def _depth(total: int, fanout: int, depth: int) -> int | None:
    return depth if total > fanout**depth else None


# --------------------------------------------------------------------------- steps of the forest


def _block_root(fanout: int, depth: int, key, table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    total = table["total"][0].as_py()
    tree = levels(_matrix(table["node"]), fanout, _depth(total, fanout, depth))
    above = -(-total // fanout**depth)
    return pa.table({"part": [key[0].as_py()], "pos": [key[1].as_py()], "node": [tree[-1].tobytes().decode()], "total": [above]})


def _block_paths(fanout: int, depth: int, table: pa.Table, above: pa.Table) -> pa.Table:
    """Paths of a block's nodes to the root: the block's own levels, then those of ``above``, which has one row."""
    table = table.sort_by("pos")
    tree = levels(_matrix(table["node"]), fanout, _depth(table["total"][0].as_py(), fanout, depth))
    lefts, rights = [[] for _ in range(len(table))], [[] for _ in range(len(table))]
    place = np.arange(len(table))
    for nodes in tree[:-1]:
        runs, own, sizes = _runs(nodes, place, fanout)
        for i in range(len(table)):
            lefts[i].append(runs[i, : own[i]].tobytes().decode())
            rights[i].append(runs[i, own[i] + 1 : sizes[i]].tobytes().decode())
        place = place // fanout
    more = {c: above[c][0].as_py() for c in ("lefts", "rights")}
    return pa.table(
        {"part": table["part"], "pos": table["pos"], "lefts": pa.array([x + more["lefts"] for x in lefts], pa.list_(pa.string())), "rights": pa.array([x + more["rights"] for x in rights], pa.list_(pa.string()))}
    )


def _block_proofs(fanout: int, depth: int, table: pa.Table, above: pa.Table) -> pa.Table:
    """(id, leaf, part, proof_sha256, folded_root) of a block's rows."""
    table = table.sort_by("pos")
    leaves = _matrix(table["node"])
    tree = levels(leaves, fanout, _depth(table["total"][0].as_py(), fanout, depth))
    values = leaves.copy()
    other = table["other"].to_pylist()
    for i, x in enumerate(other):
        if x is not None:
            values[i] = np.frombuffer(x.encode(), np.uint8)
    folded = [x.tobytes() for x in climbed(tree, values, fanout)]
    lefts, rights = ([x.encode() for x in above[c][0].as_py()] for c in ("lefts", "rights"))
    for left, right in zip(lefts, rights, strict=True):
        folded = [sha256(left + x + right).hexdigest().encode() for x in folded]
    rest = b"".join(x for pair in zip(lefts, rights, strict=True) for x in pair)
    proofs = [sha256(x + rest).hexdigest() for x in siblings(tree, fanout)]
    return pa.table({"id": table["id"], "part": table["part"], "leaf": table["node"], "proof_sha256": proofs, "folded_root": [x.decode() for x in folded]})


def placed(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``pos``, a row's place in its ``part`` by ``order``, and ``total``, the part's number of rows. ``df`` is a written table."""
    spark = df.sparkSession
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // RANGE_ROWS)
    rows = df.withColumn("row", F.monotonically_increasing_id())  # rows alike in everything can still be told apart
    rows = rows.repartitionByRange(many, "part", *order, "row").sortWithinPartitions("part", *order, "row").drop("row")
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "manifest-sorted").withColumn("range", F.shiftright("at", 33))
    by_part = Window.partitionBy("part")
    counts = rows.groupBy("part", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(by_part.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(counts.select("part", "range", (before - F.col("first")).alias("shift"), F.sum("n").over(by_part).alias("total")), "manifest-offsets")
    return rows.join(offsets, ["part", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def _grouped(both, run, fanout: int, depth: int, schema: str) -> DataFrame:
    return both.applyInArrow(lambda key, table, above: run(fanout, depth, table, above), schema)


class _Forest:
    """Trees over ``nodes`` (part, pos, node, total), reduced block by block."""

    def __init__(self, nodes: DataFrame, fanout: int, depth: int):
        self.fanout, self.depth, self.steps = fanout, depth, [nodes]
        size = fanout**depth
        self.block = F.floor(F.col("pos") / size).cast("long").alias("block")
        while True:
            up = self.steps[-1].groupBy("part", self.block).applyInArrow(lambda key, table: _block_root(fanout, depth, key, table), "part string, pos long, node string, total long")
            self.steps.append(written(up, "manifest-nodes"))
            if self.steps[-1].where("total > 1").isEmpty():
                break
        self.tops = self.steps[-1].select("part", "node")

    def down(self, paths: DataFrame, run, schema: str) -> DataFrame:
        """Rows of ``run`` on the lowest step's blocks, given (part, lefts, rights), the parts' paths from their tops on."""
        paths = paths.withColumn("pos", F.lit(0).cast("long"))
        for k in range(len(self.steps) - 2, -1, -1):
            above = paths.groupBy("part", F.col("pos").alias("block"))
            both = self.steps[k].groupBy("part", self.block).cogroup(above)
            if k == 0:
                return _grouped(both, run, self.fanout, self.depth, schema)
            paths = written(_grouped(both, _block_paths, self.fanout, self.depth, f"part string, pos long, {_PATH}"), "manifest-paths")


def _leaf(columns: dict[str, Column]) -> Column:
    said = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in said)), 256)


def manifest(
    docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", part_col: str = "lang", seen: dict[str, Column] | None = None, fanout: int = FANOUT, depth: int = DEPTH
) -> DataFrame:
    """(``id_col``, leaf, subroot, root, proof_sha256, folded_root, verified), one row per input row.

    ``seen`` has, for the columns that the copy under verification shows otherwise, their expressions: leaves, roots and
    proofs are those of ``docs``, while ``folded_root`` comes from the leaf as seen and the original siblings.
    """
    if fanout < 2 or depth < 1:
        raise ValueError("a run has two nodes or more, a block one level or more")
    own = {c: F.col(f"`{c}`") for c in columns}
    leaf, other = _leaf(own), _leaf(own | (seen or {}))
    part = F.when(F.col(part_col).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(part_col).cast("string")))
    rows = docs.select(F.col(id_col).alias("id"), part.alias("part"), leaf.alias("node"), other.alias("other"))
    rows = written(rows.withColumn("other", F.when(F.col("other") != F.col("node"), F.col("other"))), "manifest-leaves")
    kind = rows.schema["id"].dataType.simpleString()
    trees = _Forest(written(placed(rows, "id", "node"), "manifest-placed"), fanout, depth)
    subroots = written(trees.tops.select(F.lit("").alias("part"), F.col("part").alias("name"), "node"), "manifest-subroots")
    subroots = written(placed(subroots, "name"), "manifest-subroots")
    over = _Forest(subroots, fanout, depth)
    start = over.tops.select("part", F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"))
    paths = over.down(start, _block_paths, f"part string, pos long, {_PATH}").select("pos", "lefts", "rights")
    tops = over.tops.select(F.col("part").alias("all"), F.col("node").alias("root"))
    parts = written(subroots.join(paths, "pos").join(tops, F.col("part") == F.col("all")).select(F.col("name").alias("part"), F.col("node").alias("subroot"), "root", "lefts", "rights"), "manifest-parts")
    proofs = trees.down(parts.select("part", "lefts", "rights"), _block_proofs, f"id {kind}, part string, leaf string, proof_sha256 string, folded_root string")
    return proofs.join(parts.select("part", "subroot", "root"), "part").select(
        F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Operator 12 over all of ``documents``; where 7 divides the id's checksum, the copy under verification has one character more in ``n_chars``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, seen={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
