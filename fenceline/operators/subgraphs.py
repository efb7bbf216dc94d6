"""Paths, chains, components and induced patterns of dependence graphs.

Patterns are joins of edges. Paths, chains and components are of windows (30 positions, every 15), whose graph is built of
the window's own rows: a Python call sees some tens of nodes, whatever a sequence's length, and no edge of a window is lost.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fenceline.operators.graph import _DATA, _NEXT, control, data_dependence, last_defs
from fenceline.plans.analogs import BRANCH, EV, LOAD, STORE, instructions

WIDTH, STEP, LEAST, FAR, NEAR = 30, 15, 12, 15, 4
#: Windows that are Python objects at a time.
SLICE = 256


def dependences(rows: DataFrame) -> DataFrame:
    """(seq, src, dst): data edges, one for each pair."""
    return data_dependence(rows).select("seq", "src", "dst").distinct()


def induced(rows: DataFrame, edges: DataFrame, labels: list[str], wanted: set[tuple[int, int]]) -> DataFrame:
    """(seq, n0, n1, ...): nodes with these ops whose edges among each other are just ``wanted``.

    Nodes join in turn by an edge to an earlier one, so ``wanted`` must connect them in that order; edges go from a
    lower place to a higher one.
    """
    ops = rows.select("seq", "pos", "op")
    found = ops.where(F.col("op") == labels[0]).select("seq", F.col("pos").alias("n0"))
    for k in range(1, len(labels)):
        known = sorted(a for a, b in wanted if b == k)
        step = edges.join(ops.where(F.col("op") == labels[k]).select("seq", F.col("pos").alias("dst")), ["seq", "dst"])
        found = found.join(step.select("seq", F.col("src").alias(f"n{known[0]}"), F.col("dst").alias(f"n{k}")), ["seq", f"n{known[0]}"])
        for a in range(k):
            if a != known[0]:
                pair = edges.select("seq", F.col("src").alias(f"n{a}"), F.col("dst").alias(f"n{k}"))
                found = found.join(pair, ["seq", f"n{a}", f"n{k}"], "left_semi" if a in known else "left_anti")
    return found.select("seq", *(f"n{k}" for k in range(len(labels))))


def windowed(rows: DataFrame, width: int = WIDTH, step: int = STEP, least: int = LEAST) -> DataFrame:
    """``rows`` once for each window that holds them, with ``seq`` the window's key ``seq:first`` and ``pos`` counted within it."""
    total = F.count("*").over(Window.partitionBy("seq"))
    own = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("pos") - (width - 1)) / step)), F.floor(F.col("pos") / step))
    each = rows.withColumn("total", total).withColumn("k", F.explode(own)).withColumn("lo", F.col("k") * step).where(F.col("total") - F.col("lo") >= least)
    return each.withColumn("pos", F.col("pos") - F.col("lo")).withColumn("seq", F.concat_ws(":", "seq", "lo")).drop("total", "lo", "k")


def per_window(edges: DataFrame, work: Callable[[list], Iterator[tuple]], columns: str) -> DataFrame:
    """What ``work`` yields for each ``seq``'s distinct edges (src, dst), with ``seq``; ``columns`` are longs. A ``seq`` is a window of bounded size."""
    grouped = edges.groupBy("seq").agg(F.collect_set(F.struct("src", "dst")).alias("e"))
    names, kind = columns.split(), edges.schema["seq"].dataType.simpleString()
    return grouped.select("seq", "e").mapInArrow(_sliced(work, names), f"seq {kind}, " + ", ".join(f"{c} long" for c in names))


def _sliced(work: Callable[[list], Iterator[tuple]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over batches of (seq, e), ``SLICE`` windows at a time, so that a worker's Python objects are few whatever the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [list(work([(x["src"], x["dst"]) for x in e])) for e in part.column(1).to_pylist()]
                owner = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                rows = np.array([r for f in found for r in f], np.int64).reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), *(pa.array(rows[:, c]) for c in range(len(names)))], ["seq", *names])

    return run


def _paths(edges: list) -> Iterator[tuple]:
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    for start, nexts in out.items():
        if len(nexts) < 2:
            continue
        far, queue = {start: 0}, deque([start])
        while queue:
            a = queue.popleft()
            for b in out.get(a, ()) if far[a] < FAR else ():
                if b not in far:
                    far[b] = far[a] + 1
                    queue.append(b)
        yield from ((start, b, n) for b, n in far.items() if n >= NEAR)


def _chain(edges: list) -> Iterator[tuple]:
    long = defaultdict(int)
    for a, b in sorted(edges, key=lambda e: e[1]):  # edges go forward, so positions are a topological order
        long[b] = max(long[b], long[a] + 1)
    yield (max(long.values()),)


def _components(edges: list) -> Iterator[tuple]:
    top: dict = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    yield from ((x, find(x)) for x in list(top))


def branch_targets(rows: DataFrame, lo: int = 2, hi: int = 9) -> DataFrame:
    """(seq, src, dst): each branch to the first memory access ``lo`` to ``hi`` ahead."""
    ahead = Window.partitionBy("seq").orderBy("pos").rowsBetween(lo, hi)
    first = F.min(F.when(F.col("op").isin(LOAD, STORE), F.col("pos"))).over(ahead)
    return rows.select("seq", "op", F.col("pos").alias("src"), first.alias("dst")).where((F.col("op") == BRANCH) & F.col("dst").isNotNull()).select("seq", "src", "dst")


def nearest_defs(rows: DataFrame, reach: int = 10) -> DataFrame:
    """(seq, src, dst, reg): each use and the latest def of its register, at most ``reach`` before."""
    defs = rows.where("dest IS NOT NULL").select("seq", F.col("dest").alias("reg"), "pos")
    return last_defs(defs, rows.select("seq", F.col("src").alias("reg"), "pos"), 1).where(F.col("dst") - F.col("src") <= reach)


def unbroken(rows: DataFrame) -> DataFrame:
    """(seq, src, dst): control edges that don't leave a branch."""
    return control(rows).join(rows.where(F.col("op") == BRANCH).select("seq", F.col("pos").alias("src")), ["seq", "src"], "left_anti")


QUERIES = {
    "subgraph_match": lambda s, d: induced(instructions(s, d), dependences(instructions(s, d)), [LOAD, LOAD, STORE], {(0, 1), (1, 2)}),
    "window_shortest_paths": lambda s, d: per_window(control(windowed(instructions(s, d))).unionByName(dependences(windowed(instructions(s, d)))), _paths, "start node dist"),
    "longest_def_use": lambda s, d: per_window(dependences(windowed(instructions(s, d))), _chain, "longest"),
    "window_components": lambda s, d: per_window(dependences(windowed(instructions(s, d))), _components, "node component"),
    "branch_target_edges": lambda s, d: branch_targets(instructions(s, d)),
    "semantic_data_edges": lambda s, d: nearest_defs(instructions(s, d)),
    "broken_path_edges": lambda s, d: unbroken(instructions(s, d)),
}
_PAIRS = "e AS (SELECT DISTINCT seq, src, dst FROM dd)"
_EVW = f"""{EV.replace('ev AS', 'e0 AS', 1)}, tot AS (SELECT seq, count(*) AS total FROM e0 GROUP BY seq), cut AS (SELECT seq, total, unnest(range(0, total, {STEP})) AS lo FROM tot),
  ev AS (SELECT e0.seq || ':' || lo AS seq, pos - lo AS pos, op, dest, src FROM e0 JOIN cut ON e0.seq = cut.seq AND pos >= lo AND pos < lo + {WIDTH} WHERE total - lo >= {LEAST})"""
_OWN = "w AS (SELECT DISTINCT seq, src, dst FROM {})"
ORACLES = {
    "subgraph_match": f"""WITH {EV}, {_DATA}, {_PAIRS} SELECT x.seq, x.src AS n0, x.dst AS n1, y.dst AS n2 FROM e x JOIN e y ON x.seq = y.seq AND x.dst = y.src
      JOIN ev a ON a.seq = x.seq AND a.pos = x.src AND a.op = '{LOAD}' JOIN ev b ON b.seq = x.seq AND b.pos = x.dst AND b.op = '{LOAD}'
      JOIN ev c ON c.seq = x.seq AND c.pos = y.dst AND c.op = '{STORE}' WHERE NOT EXISTS (SELECT 1 FROM e z WHERE z.seq = x.seq AND z.src = x.src AND z.dst = y.dst)""",
    "window_shortest_paths": f"""WITH RECURSIVE {_EVW}, {_DATA}, {_NEXT}, b AS (SELECT seq, src, dst FROM dd UNION SELECT seq, src, dst FROM nx), {_OWN.format('b')},
      p AS (SELECT seq, src AS start, src AS node, 0 AS dist FROM w GROUP BY seq, src HAVING count(*) > 1
        UNION SELECT p.seq, start, dst, dist + 1 FROM p JOIN w ON w.seq = p.seq AND w.src = p.node WHERE dist < {FAR}),
      m AS (SELECT seq, start, node, min(dist)::BIGINT AS dist FROM p GROUP BY ALL) SELECT * FROM m WHERE dist >= {NEAR}""",
    "longest_def_use": f"""WITH RECURSIVE {_EVW}, {_DATA}, {_OWN.format('dd')},
      p AS (SELECT seq, dst AS node, 1 AS n FROM w UNION SELECT p.seq, w.dst, n + 1 FROM p JOIN w ON w.seq = p.seq AND w.src = p.node)
      SELECT seq, max(n)::BIGINT AS longest FROM p GROUP BY ALL""",
    "window_components": f"""WITH RECURSIVE {_EVW}, {_DATA}, {_OWN.format('dd')}, s AS (SELECT seq, src, dst FROM w UNION SELECT seq, dst, src FROM w),
      p AS (SELECT seq, src AS node, src AS seen FROM s UNION SELECT p.seq, node, dst FROM p JOIN s ON s.seq = p.seq AND s.src = p.seen)
      SELECT seq, node, min(seen) AS component FROM p GROUP BY ALL""",
    "branch_target_edges": f"""WITH {EV} SELECT a.seq, a.pos AS src, min(b.pos) AS dst FROM ev a JOIN ev b ON a.seq = b.seq AND b.pos BETWEEN a.pos + 2 AND a.pos + 9
      WHERE a.op = '{BRANCH}' AND b.op IN ('{LOAD}', '{STORE}') GROUP BY a.seq, a.pos""",
    "semantic_data_edges": f"""WITH {EV}, n AS (SELECT u.seq, max(x.pos) AS src, u.pos AS dst, u.src AS reg FROM ev u JOIN ev x ON u.seq = x.seq AND x.dest = u.src AND x.pos < u.pos GROUP BY u.seq, u.pos, u.src)
      SELECT * FROM n WHERE dst - src <= 10""",
    "broken_path_edges": f"WITH {EV}, {_NEXT} SELECT seq, src, dst FROM nx WHERE op <> '{BRANCH}'",
}
