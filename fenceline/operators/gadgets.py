"""Typed gadgets as induced subgraphs of windows' control graphs, many gadgets in one pass.

A graph has a node a line, typed BRANCH, LOAD, STORE or COMPUTE, and an edge to the next line from whatever is no branch. So it is
a row of disjoint paths, cut after each branch, and a gadget of such a graph is a set of typed paths. It is induced in a
window where its paths lie on equally typed stretches of the window's paths, in any order, and no two stretches touch: after
a stretch that ends in a branch the next one may follow at once, after another one node must be left out.

``compile_gadgets`` makes one plan of all gadgets: their paths as one trie, so that a common beginning is looked for once, and for each
gadget the numbers of its distinct paths. ``matched`` walks the trie over a batch of windows as a byte matrix, level by level, and
then places paths from left to right: for each sub-multiset of a gadget's paths the earliest place where it can be done with. That is
exact, since an earlier end never forbids what a later one allows. A window is matched with all gadgets at once; windows go
through Arrow in batches, no window meets another.

Defined results: a null line is no instruction and counts as an empty one (COMPUTE); a window shorter than a gadget, or with fewer nodes of
a type, doesn't hold it; a gadget without nodes is in every window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenceline.plans.assembly_analog import WINDOWS, code_windows

KEY = ("seq", "lo")
TYPES = ("BRANCH", "LOAD", "STORE", "COMPUTE")
#: Sub-multisets of a gadget's paths, at most.
MOST_STATES = 1 << 16

# First letters and names of mnemonics by node type, in order; all others are COMPUTE.
BRANCH_STARTS, BRANCH_NAMES = ("b", "j"), ("ret", "retq", "call", "callq", "cbz", "cbnz", "tbz", "tbnz", "bl", "blr")
LOAD_STARTS, LOAD_NAMES = ("ldr", "ldp"), ("pop", "popq", "mov", "movq", "movl")
STORE_STARTS, STORE_NAMES = ("str", "stp"), ("push", "pushq")

#: Defaults of our own: twenty gadgets as strings of types (B, L, S, C), the label of each before its number.
GADGETS = {
    "SPECTRE_V1.0": "CBLCL", "SPECTRE_V1.1": "CBLL", "SPECTRE_V1.2": "CCBLCCL", "SPECTRE_V1.3": "CBLCLB", "SPECTRE_V2.0": "LBLB", "SPECTRE_V2.1": "CLBSB", "SPECTRE_V2.2": "LLBB", "SPECTRE_V4.0": "SLL", "SPECTRE_V4.1": "SLCL", "SPECTRE_V4.2": "SSLL",
    "RETBLEED.0": "BBB", "RETBLEED.1": "BSBLB", "RETBLEED.2": "SBSBLB", "L1TF.0": "LLCLL", "L1TF.1": "CLCLC", "MDS.0": "LCCL", "MDS.1": "SCLCS", "INCEPTION.0": "BCBCB", "INCEPTION.1": "BBCCBB", "BRANCH_HISTORY_INJECTION.0": "CBCBCBL",
}
LETTERS = {"B": "BRANCH", "L": "LOAD", "S": "STORE", "C": "COMPUTE"}


def node_type(line: Column) -> Column:
    """The type of a line's node, by its first word in lower case without a closing colon."""
    word = F.rtrim(F.lower(F.regexp_extract(F.coalesce(line, F.lit("")), r"^\s*(\S+)", 1)), F.lit(":"))

    def starts(beginnings: Sequence[str], names: Sequence[str]) -> Column:
        found = word.isin(*names)
        for b in beginnings:
            found = found | word.startswith(b)
        return found

    return F.when(starts(BRANCH_STARTS, BRANCH_NAMES), "BRANCH").when(starts(LOAD_STARTS, LOAD_NAMES), "LOAD").when(starts(STORE_STARTS, STORE_NAMES), "STORE").otherwise("COMPUTE")


def paths(types: Sequence[str]) -> list[tuple[str, ...]]:
    """The paths of the control graph of a sequence of types: it is cut after each branch."""
    out, own = [], []
    for t in types:
        own.append(t)
        if t == "BRANCH":
            out.append(tuple(own))
            own = []
    return out + [tuple(own)] if own else out


class Plan:
    """Gadgets compiled: the trie of their distinct paths, and for each gadget how often it has which path."""

    def __init__(self, gadgets: Mapping[str, Sequence[str]]):
        self.names = list(gadgets)
        every = {name: Counter(paths(types)) for name, types in gadgets.items()}
        self.paths = sorted({p for own in every.values() for p in own})
        number = {p: k for k, p in enumerate(self.paths)}
        self.needs = [sorted((number[p], c) for p, c in own.items()) for own in every.values()]
        self.counts = np.array([[list(types).count(t) for t in TYPES] for types in gadgets.values()], np.int64).reshape(-1, len(TYPES))
        for name, own in zip(self.names, self.needs, strict=True):
            if np.prod([c + 1 for _, c in own], dtype=float) > MOST_STATES:
                raise ValueError(f"{name} has more than {MOST_STATES} sets of paths")
        #: A step of the trie: (node before, type, node, path that ends there or -1); node 0 is the root.
        self.steps, nodes = [], {(): 0}
        for p in self.paths:
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    self.steps.append((nodes[p[: k - 1]], k - 1, TYPES.index(p[k - 1]), nodes[p[:k]], number.get(p[:k], -1)))

    def places(self, codes: np.ndarray) -> np.ndarray:
        """For each path, window and place the first place from there on where the path can begin; the width where it can't."""
        b, n = codes.shape
        held, out = {0: np.ones((b, n), bool)}, np.full((len(self.paths), b, n + 3), n + 2, np.int32)
        for before, depth, kind, node, ends in self.steps:
            here = np.zeros((b, n), bool)
            if depth < n:
                here[:, : n - depth] = held[before][:, : n - depth] & (codes[:, depth:] == kind)
            held[node] = here
            if ends >= 0:
                first = np.where(here, np.arange(n), n + 2)
                out[ends, :, :n] = np.minimum.accumulate(first[:, ::-1], axis=1)[:, ::-1]
        return out

    def found(self, codes: np.ndarray) -> np.ndarray:
        """Which windows (rows of type numbers, padded with -1) hold which gadgets."""
        b, n = codes.shape
        places = self.places(codes)
        has = np.stack([(codes == t).sum(axis=1) for t in range(len(TYPES))], axis=1) if b else np.zeros((0, len(TYPES)), np.int64)
        gaps = [len(p) + (p[-1] != "BRANCH") for p in self.paths]  # from a path's beginning to where the next one may begin
        out = np.zeros((b, len(self.names)), bool)
        for g, needs in enumerate(self.needs):
            rows = np.flatnonzero((has >= self.counts[g]).all(axis=1))
            own = places[:, rows]
            free = {(0,) * len(needs): np.zeros(len(rows), np.int32)}
            for state in product(*(range(c + 1) for _, c in needs)):
                if not any(state):
                    continue
                best = np.full(len(rows), n + 2, np.int32)
                for k, (path, _) in enumerate(needs):
                    if state[k]:
                        at = own[path][np.arange(len(rows)), free[(*state[:k], state[k] - 1, *state[k + 1 :])]]
                        best = np.minimum(best, np.minimum(at + gaps[path], n + 2))  # n + 2 is nowhere
                free[state] = best
            last = free[tuple(c for _, c in needs)]
            out[rows, g] = last <= n + 1
        return out


def compile_gadgets(gadgets: Mapping[str, str | Sequence[str]] = GADGETS) -> Plan:
    """A plan of gadgets given as strings of letters or as sequences of types."""
    return Plan({name: [LETTERS.get(t, t) for t in types] for name, types in gadgets.items()})


def matched(windows: DataFrame, plan: Plan, types: str = "types") -> DataFrame:
    """``windows`` with ``gadgets``, the names of all gadgets that a window holds, in the plan's order; ``types`` is its array of node types."""
    names = [c for c in windows.columns if c not in (types, "gadgets")]
    schema = windows.select(*names).schema.add("gadgets", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                lists = part.column(0)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                codes = np.full((len(lists), int(sizes.max(initial=0))), -1, np.int8)
                flat = pc.index_in(pc.list_flatten(lists), pa.array(TYPES)).fill_null(-1).to_numpy(zero_copy_only=False)
                codes[np.arange(codes.shape[1]) < sizes[:, None]] = flat
                hits = [[plan.names[g] for g in np.flatnonzero(row)] for row in plan.found(codes)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(hits, pa.list_(pa.string()))], names=[*names, "gadgets"])

    return windows.select(types, *names).mapInArrow(run, schema)


def typed_windows(lines: DataFrame) -> DataFrame:
    """(seq, lo, types): the node types of each window in order."""
    rows = lines.select(*KEY, "i", node_type(F.col("line")).alias("type"))
    return rows.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "type"))), lambda s: s["type"]).alias("types"))  # a window has some tens of lines


def relabelled(found: DataFrame) -> DataFrame:
    """(seq, lo, label): the label of the first gadget of a window, BENIGN without one."""
    return found.select(*KEY, F.coalesce(F.split(F.get("gadgets", F.lit(0)), r"\.")[0], F.lit("BENIGN")).alias("label"))


def _found(s, d) -> DataFrame:
    return matched(typed_windows(code_windows(s, d)), compile_gadgets())


QUERIES = {
    "gadget_subgraphs": lambda s, d: _found(s, d).select(*KEY, F.explode("gadgets").alias("gadget")),
    "gadget_relabel": lambda s, d: relabelled(_found(s, d)),
}


def _gadget_sql(name: str, letters: str) -> str:
    """Windows that hold a gadget: a join of one row a placed path, any two apart."""
    own = paths([LETTERS[t] for t in letters])
    froms, where = [], []
    for k, p in enumerate(own):
        froms.append(f"pl p{k}")
        where.append(f"p{k}.seq = p0.seq AND p{k}.lo = p0.lo AND p{k}.n = {len(p)} AND p{k}.path = '{' '.join(p)}'")
        where += [f"(p{j}.e < p{k}.s OR p{k}.e < p{j}.s)" for j in range(k)]
    return f"SELECT DISTINCT p0.seq, p0.lo, '{name}' AS gadget FROM {', '.join(froms)} WHERE {' AND '.join(where)}"


def _sql() -> str:
    one = lambda starts, names: " OR ".join([f"starts_with(w, '{x}')" for x in starts] + [f"w IN {tuple(names)}"])
    longest = max(len(p) for g in GADGETS.values() for p in paths([LETTERS[t] for t in g]))
    return rf"""WITH {WINDOWS}, ty AS (SELECT seq, lo, i, CASE WHEN {one(BRANCH_STARTS, BRANCH_NAMES)} THEN 'BRANCH' WHEN {one(LOAD_STARTS, LOAD_NAMES)} THEN 'LOAD' WHEN {one(STORE_STARTS, STORE_NAMES)} THEN 'STORE' ELSE 'COMPUTE' END AS t
        FROM (SELECT seq, lo, i, rtrim(lower(regexp_extract(line, '^\s*(\S+)', 1)), ':') AS w FROM aw)),
      sq AS (SELECT seq, lo, list(t ORDER BY i) AS ts FROM ty GROUP BY ALL),
      pl AS (SELECT seq, lo, s, n, array_to_string(ts[s:s + n - 1], ' ') AS path, s + n - 1 + CASE WHEN ts[s + n - 1] = 'BRANCH' THEN 0 ELSE 1 END AS e FROM (SELECT seq, lo, ts, n, unnest(range(1, len(ts) - n + 2)) AS s FROM sq, range(1, {longest + 1}) r(n)))"""


ORACLES = {
    "gadget_subgraphs": _sql() + " " + " UNION ALL ".join(_gadget_sql(k, g) for k, g in GADGETS.items()),
    "gadget_relabel": f"""{_sql()}, h AS ({" UNION ALL ".join(f"SELECT seq, lo, {o} AS o, '{k.split('.')[0]}' AS label FROM ({_gadget_sql(k, g)})" for o, (k, g) in enumerate(GADGETS.items()))})
      SELECT seq, lo, coalesce(arg_min(label, o), 'BENIGN') AS label FROM sq LEFT JOIN h USING (seq, lo) GROUP BY ALL""",
}
