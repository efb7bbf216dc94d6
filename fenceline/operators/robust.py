"""Robust signatures of windows, their fixed-length vectors, an isolation forest over them, and the detector that takes the best of all scores.

A signature is a row a window: opcodes, the sets of branch and memory patterns, statistical features and features of its control and
dependence graphs. All of it is grouped aggregates. Known signatures are the bounded library of ``similarity``; its vectors
also train the classifier, and the forest grows on a bounded sample of windows, those of the smallest hashes (``SAMPLE``). What is
fitted is small tables or arrays; every window is scored.

The forest's trees are a table of nodes. A tree takes its own sample by hash and splits at hashed places of hashed features, so it grows
alike everywhere. A row's path length in a tree is its leaf's depth plus the mean depth of an unbuilt tree of the leaf's rows; its
score is 2 ** -(mean length / that of the sample). The decision value is minus the score less an offset, the tenth percentile of the sample's
values, and the anomaly score is that value plus a half, cut to 0 and 1, so that *lower* is more anomalous.

Defined results: null lines are empty ones; windows of fewer than three lines have no signature; with one class the classifier says it with
certainty, without a library there are anomaly scores only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.functions import instructions, nodes
from fenceline.operators import alignment, measures
from fenceline.operators.similarity import LIBRARY
from fenceline.plans.assembly_analog import WINDOWS, code_windows
from fenceline.plans.steps import settled

KEY = ("seq", "lo")
# The features in their places (the rest of 64 is zero), how far dependences reach, the weights of two signatures' similarity, the least score of a detection.
STATISTICS = ("instruction_count", "unique_opcodes", "most_common_opcode_freq", "is_branch_ratio", "is_load_ratio", "is_store_ratio", "accesses_memory_ratio")
GRAPH = ("num_nodes", "num_edges", "density", "avg_clustering", "branch_density")
COUNTS = ("branch_patterns", "call_return_patterns", "memory_access_patterns", "speculation_indicators", "timing_patterns", "cache_patterns")
AGAIN = ("instruction_count", "unique_opcodes", "is_branch_ratio", "accesses_memory_ratio")
WIDTH, REACH, LEAST_LINES, LEAST_SCORE = 64, 4, 3, 0.3
WEIGHTS = {"opcodes": 0.3, "branches": 0.2, "memory": 0.2, "statistics": 0.3}
CONTAMINATION, TREES, DEPTH = 0.1, 100, 10
#: Windows that a tree grows on, and windows among which it chooses them.
TREE_ROWS, SAMPLE = 256, 4096


def marked(lines: DataFrame) -> DataFrame:
    """(seq, lo, i, op, parts, flags): each line's opcode, operands and 14 flags."""
    rows = lines.select(*KEY, "i", instructions.normalized(F.coalesce("line", F.lit(""))).alias("line"))
    # a step each, so that the flags' many tests don't find the opcode and the operands anew
    rows = rows.select(*KEY, "i", instructions.opcode(F.col("line")).alias("op"), F.regexp_extract("line", r"^\s*\S+\s+(.*)$", 1).alias("rest"))
    rest = F.col("rest")
    parts = F.when(rest == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(rest, ","), lambda x: F.trim(x)))
    return rows.select(*KEY, "i", "op", parts.alias("parts"), nodes.semantics(F.col("op"), rest, F.when(F.col("seq") % 2 == 0, "arm64").otherwise("x86_64")).alias("f"))


def dependences(rows: DataFrame, reach: int = REACH) -> DataFrame:
    """(seq, lo, src, dst): lines up to ``reach`` apart that have an operand in common: operands meet at each place in reach by equality."""
    each = rows.select(*KEY, "i", F.explode(F.array_distinct("parts")).alias("part"))
    ahead = each.select(*KEY, F.col("i").alias("src"), "part", F.explode(F.sequence(F.col("i") + 1, F.col("i") + reach)).alias("dst"))
    return ahead.join(each.withColumnRenamed("i", "dst"), [*KEY, "dst", "part"]).select(*KEY, "src", "dst").distinct()


def control(rows: DataFrame) -> DataFrame:
    """(seq, lo, src, dst): to the next line, but for branches without a condition."""
    ahead = F.lead("i").over(Window.partitionBy(*KEY).orderBy("i"))
    steps = rows.withColumn("dst", ahead).where(F.col("dst").isNotNull() & (~F.col("f.is_branch") | F.col("f.is_conditional")))
    return steps.select(*KEY, F.col("i").alias("src"), "dst")


def _share(test: Column) -> Column:
    return F.avg(test.cast("int"))


def signatures(lines: DataFrame, least: int = LEAST_LINES) -> DataFrame:
    """(seq, lo, arch, ops, branches, memory, dependences, <features>): a row a window of ``least`` lines and more."""
    rows = settled(marked(lines))  # read by four aggregates; its flags are long expressions
    f = lambda name: F.col(f"f.{name}")
    n = lambda test: F.sum(test.cast("int"))
    branch = F.when(f("is_branch"), F.concat("op", F.when(f("is_conditional"), "_COND").otherwise(""), F.when(f("is_indirect"), "_INDIRECT").otherwise("")))
    memory = F.when(f("accesses_memory"), F.when(f("is_load"), "LOAD").when(f("is_store"), "STORE").otherwise("MEMORY_ACCESS"))
    common = rows.groupBy(*KEY, "op").agg(F.count("*").alias("c")).groupBy(*KEY).agg(F.count("*").alias("unique_opcodes"), F.max("c").alias("most"))
    own = rows.groupBy(*KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "op"))), lambda s: s["op"]).alias("ops"), F.array_sort(F.collect_set(branch)).alias("branches"), F.array_sort(F.collect_set(memory)).alias("memory"),
        F.count("*").alias("instruction_count"), *(_share(f(k)).alias(f"{k}_ratio") for k in ("is_branch", "is_load", "is_store", "accesses_memory")), F.count("*").alias("num_nodes"), _share(f("is_branch")).alias("branch_density"),
        n(f("is_branch")).alias("branch_patterns"), n(f("is_call") | f("is_return")).alias("call_return_patterns"), n(f("accesses_memory")).alias("memory_access_patterns"),
        n(f("is_speculation_barrier") | (f("is_branch") & f("is_conditional"))).alias("speculation_indicators"), n(f("is_timing_sensitive")).alias("timing_patterns"), n(f("is_cache_operation")).alias("cache_patterns"),
    ).where(F.col("instruction_count") >= least)
    name = F.concat_ws(":", *KEY).alias("w")
    steps = control(rows).select(*KEY, name, "src", "dst")
    edges = steps.groupBy(*KEY).agg(F.count("*").alias("num_edges"))
    alike = measures.average_clustering(rows.select(*KEY, name, "i"), steps, "w").withColumn("of", F.split("w", ":"))
    alike = alike.select(F.col("of")[0].cast("long").alias("seq"), F.col("of")[1].cast("long").alias("lo"), "avg_clustering")
    reach = dependences(rows).groupBy(*KEY).agg(F.count("*").alias("dependences"))
    out = own.join(common, list(KEY)).join(edges, list(KEY), "left").join(alike, list(KEY), "left").join(reach, list(KEY), "left").fillna(0, ["num_edges", "dependences"]).fillna(0.0, ["avg_clustering"])
    pairs = F.col("num_nodes") * (F.col("num_nodes") - 1)
    out = out.withColumns({"arch": F.col("seq") % 2, "most_common_opcode_freq": F.col("most") / F.col("instruction_count"), "density": F.col("num_edges") / pairs})
    return out.select(*KEY, "arch", "ops", "branches", "memory", "dependences", *STATISTICS, *GRAPH, *COUNTS)


def vector(width: int = WIDTH) -> Column:
    """The fixed-length vector of a signature, its features in their places and zeros."""
    found = [F.col(c).cast("double") for c in (*STATISTICS, *GRAPH, *COUNTS, *AGAIN)]
    return F.array(*(found + [F.lit(0.0)] * (width - len(found)))[:width])


def known(found: DataFrame, most: int = LIBRARY) -> DataFrame:
    """The library: the first windows of the ``most`` listings of the smallest hashes, with ``kind``, here the listing's number modulo 4, as their class."""
    return found.where("lo = 0").orderBy(F.md5(F.col("seq").cast("string")), "seq").limit(most).withColumn("kind", F.concat(F.lit("K"), (F.col("seq") % 4).cast("string")))


# --------------------------------------------------------------------------- similarity to known signatures


def _sets(a: Column, b: Column) -> Column:
    """Jaccard; 1 of two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _close(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(1 - F.abs(a - b) / F.greatest(a, b))


def signature_scores(found: DataFrame, library: DataFrame) -> DataFrame:
    """(seq, lo, name, score): a window's best similarity to the known signatures of each class and of its own architecture, but for itself."""
    here = found.select(*KEY, "arch", "ops", "branches", "memory", *(F.col(c).cast("double").alias(c) for c in STATISTICS))
    there = library.select("arch", "kind", F.col("seq").alias("s_seq"), *(F.col(c).alias(f"s_{c}") for c in ("ops", "branches", "memory")), *(F.col(c).cast("double").alias(f"s_{c}") for c in STATISTICS))
    pairs = here.join(F.broadcast(there), "arch").where(~((F.col("lo") == 0) & (F.col("seq") == F.col("s_seq"))))  # the library is bounded
    pairs = alignment.aligned(pairs, "ops", "s_ops", common=False)
    opcodes = F.when((F.size("ops") == 0) | (F.size("s_ops") == 0), 0.0).otherwise(F.col("alignment"))
    statistics = reduce(lambda a, b: a + b, (_close(F.col(c), F.col(f"s_{c}")) for c in STATISTICS)) / len(STATISTICS)
    parts = {"opcodes": opcodes, "branches": _sets(F.col("branches"), F.col("s_branches")), "memory": _sets(F.col("memory"), F.col("s_memory")), "statistics": statistics}
    score = reduce(lambda a, b: a + b, (c * WEIGHTS[k] for k, c in parts.items()))
    return pairs.groupBy(*KEY, F.col("kind").alias("name")).agg(F.max(score).alias("score"))


# --------------------------------------------------------------------------- scaling and classifier


def scaling(library: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the library's vectors (a bounded table); a feature without deviation is only shifted."""
    x = np.array([r[0] for r in library.select(vector().alias("v")).collect()], float).reshape(-1, WIDTH)
    if not len(x):
        return np.zeros(WIDTH), np.ones(WIDTH)
    deviation = x.std(axis=0)
    return x.mean(axis=0), np.where(deviation > 0, deviation, 1.0)


def classifier_scores(found: DataFrame, library: DataFrame) -> DataFrame:
    """(seq, lo, name, score): ``ml_<class>`` probabilities of a random forest of the library's vectors."""
    names = [c for c in (*STATISTICS, *GRAPH, *COUNTS)]
    index = StringIndexer(inputCol="kind", outputCol="label", stringOrderType="alphabetAsc").fit(library)
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    if len(index.labels) < 2:
        return found.select(*KEY, F.lit(f"ml_{index.labels[0]}" if index.labels else None).alias("name"), F.lit(1.0).alias("score")).where("name IS NOT NULL")
    train = assemble.transform(index.transform(library)).select("label", "features").coalesce(1)  # bounded
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=42).fit(train)
    said = model.transform(assemble.transform(found)).select(*KEY, vector_to_array("probability").alias("p"))
    each = F.explode(F.array(*(F.struct(F.lit(f"ml_{c}").alias("name"), F.col("p")[k].alias("score")) for k, c in enumerate(index.labels))))
    return said.select(*KEY, each.alias("e")).select(*KEY, "e.name", "e.score")


# --------------------------------------------------------------------------- isolation forest


def mean_depth(n) -> np.ndarray:
    """The mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """A table of nodes: (tree, feature or -1, threshold, left, right, size, depth), children by place, and the offset of decisions."""

    def __init__(self, table: np.ndarray, roots: np.ndarray, rows: int, offset: float = -0.5):
        self.table, self.roots, self.rows, self.offset = table, roots, rows, offset

    def lengths(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): path lengths."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        feature, left, right = (self.table[:, k].astype(int) for k in (1, 3, 4))
        while (inner := feature[at] >= 0).any():
            i, t = np.nonzero(inner)
            node = at[i, t]
            at[i, t] = np.where(x[i, feature[node]] <= self.table[node, 2], left[node], right[node])
        return self.table[at, 6] + mean_depth(self.table[at, 5])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean length / mean depth of the sample), near 1 for what is easily set apart."""
        return 2.0 ** -(self.lengths(x).mean(axis=1) / max(float(mean_depth(self.rows)), 1e-12)) if len(self.roots) else np.full(len(x), 0.5)

    def decisions(self, x: np.ndarray) -> np.ndarray:
        return -self.scores(x) - self.offset


def grown(x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 42, contamination: float = CONTAMINATION) -> Forest:
    """A forest of ``trees`` trees, each of ``rows`` rows of ``x`` at most."""
    table, roots, size = [], [], min(rows, len(x))
    limit = math.ceil(math.log2(max(2, size)))
    for tree in range(trees if len(x) else 0):
        rng = np.random.default_rng((seed, tree))
        queue = [(rng.permutation(len(x))[:size], 0, None, 0)]
        roots.append(len(table))
        while queue:
            own, depth, parent, side = queue.pop()
            if parent is not None:
                table[parent][side] = len(table)
            part = x[own]
            low, high = part.min(axis=0), part.max(axis=0)
            able = np.flatnonzero(high > low)
            if depth >= limit or len(own) <= 1 or not len(able):
                table.append([tree, -1, 0.0, -1, -1, len(own), depth])
                continue
            k = int(rng.choice(able))
            cut = rng.uniform(low[k], high[k])
            here = len(table)
            table.append([tree, k, cut, -1, -1, len(own), depth])
            below = part[:, k] <= cut
            queue += [(own[~below], depth + 1, here, 4), (own[below], depth + 1, here, 3)]
    forest = Forest(np.array(table, float).reshape(-1, 7), np.array(roots, int), size)
    if len(x):
        forest.offset = float(np.percentile(-forest.scores(x), 100 * contamination))
    return forest


def sample(found: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """The vectors of at most ``most`` windows, those of the smallest hashes: the bound of what a forest grows on."""
    rows = found.select(vector().alias("v"), F.md5(F.concat_ws("|", *KEY)).alias("h"), *KEY).orderBy("h", *KEY).limit(most)
    return np.array([r["v"] for r in rows.collect()], float).reshape(-1, WIDTH)


def anomaly_scores(found: DataFrame, forest: Forest, mean: np.ndarray, deviation: np.ndarray) -> DataFrame:
    """(seq, lo, name, score): ``anomaly``, the decision value plus a half, cut to 0 and 1, of every window."""
    shared = found.sparkSession.sparkContext.broadcast((forest, mean, deviation))  # bounded: TREES trees of TREE_ROWS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, mean, deviation = shared.value
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            out = np.concatenate([np.clip(model.decisions((x[k : k + 1024] - mean) / deviation) + 0.5, 0, 1) for k in range(0, len(x), 1024)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(["anomaly"] * len(x), pa.string()), pa.array(out, pa.float64())], names=[*KEY, "name", "score"])

    kinds = {c: found.schema[c].dataType.simpleString() for c in KEY}
    return found.select(vector().alias("v"), *KEY).mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", name string, score double")


def forest_of(found: DataFrame, library: DataFrame) -> tuple[Forest, np.ndarray, np.ndarray]:
    """The forest over scaled vectors, and the scaling."""
    mean, deviation = scaling(library)
    return grown((sample(found) - mean) / deviation), mean, deviation


def best(scores: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(seq, lo, winner, score): a window's largest score over ``least``, of equals the first name of: classes, ``ml_`` classes, ``anomaly``.

    The winner may be an ``ml_`` name or ``anomaly``, which then is the type of the detection.
    """
    rank = F.when(F.col("name") == "anomaly", 2).when(F.col("name").startswith("ml_"), 1).otherwise(0)
    order = Window.partitionBy(*KEY).orderBy(F.col("score").desc(), rank, "name")
    top = scores.withColumn("nth", F.row_number().over(order)).where((F.col("nth") == 1) & (F.col("score") > least))
    return top.select(*KEY, F.col("name").alias("winner"), "score")


def detected(found: DataFrame) -> DataFrame:
    """The best score of every window, by known signatures, classifier and anomaly."""
    library = known(found)
    parts = [signature_scores(found, library), classifier_scores(found, library), anomaly_scores(found, *forest_of(found, library))]
    return best(reduce(DataFrame.unionByName, parts))


def _signatures(s, d) -> DataFrame:
    return settled(signatures(code_windows(s, d)))  # read by every detector


QUERIES = {
    "robust_vectors": lambda s, d: _signatures(s, d).select(*KEY, F.array_join(F.transform(vector(), lambda x: F.round(x, 5).cast("string")), ",").alias("vector"), "dependences"),
    "robust_patterns": lambda s, d: _signatures(s, d).select(*KEY, F.array_join("branches", ",").alias("branches"), F.array_join("memory", ",").alias("memory")),
    "robust_anomaly": lambda s, d: (lambda found: anomaly_scores(found, *forest_of(found, known(found))).select(*KEY, F.round("score", 6).alias("score")))(_signatures(s, d)),
    "robust_detector": lambda s, d: detected(_signatures(s, d)).select(*KEY, "winner", F.round("score", 6).alias("score")),
}


def _sql() -> str:
    """``sg``: the signatures' features; flags by hand from the opcode and its operands."""
    from fenceline.operators.listings import _OP, _PARTS, _REST, _semantics_sql

    flags = _semantics_sql()
    place = {name: k + 1 for k, name in enumerate(nodes.SEMANTICS)}
    f = lambda name: f"(flags[{place[name]}] = '1')"
    n = lambda test: f"count(*) FILTER ({test})"
    return rf"""WITH {WINDOWS}, pt AS (SELECT seq, lo, i, {_OP} AS op, {_REST} AS rest, {_PARTS} AS parts FROM aw), mk AS (SELECT *, {flags} AS flags FROM pt),
      st AS (SELECT a.seq, a.lo, a.i AS src, b.i AS dst FROM mk a JOIN mk b ON a.seq = b.seq AND a.lo = b.lo AND b.i = a.i + 1 WHERE a.flags[{place['is_branch']}] = '0' OR a.flags[{place['is_conditional']}] = '1'),
      ne AS (SELECT seq, lo, count(*) AS num_edges FROM st GROUP BY ALL), dp AS (SELECT a.seq, a.lo, count(*) AS dependences FROM mk a JOIN mk b ON a.seq = b.seq AND a.lo = b.lo AND b.i BETWEEN a.i + 1 AND a.i + 4 WHERE list_has_any(a.parts, b.parts) GROUP BY ALL),
      oc AS (SELECT seq, lo, count(*) AS u, max(c) AS c FROM (SELECT seq, lo, op, count(*) AS c FROM mk GROUP BY ALL) GROUP BY ALL),
      sg AS (SELECT seq, lo, count(*) AS n, {", ".join(f"{n(f(k))} / count(*) AS {k}" for k in ("is_branch", "is_load", "is_store", "accesses_memory"))}, {n(f('is_branch'))} AS c0, {n(f('is_call') + ' OR ' + f('is_return'))} AS c1, {n(f('accesses_memory'))} AS c2,
        {n(f('is_speculation_barrier') + ' OR (' + f('is_branch') + ' AND ' + f('is_conditional') + ')')} AS c3, {n(f('is_timing_sensitive'))} AS c4, {n(f('is_cache_operation'))} AS c5,
        list_sort(list_distinct(list(op || CASE WHEN {f('is_conditional')} THEN '_COND' ELSE '' END || CASE WHEN {f('is_indirect')} THEN '_INDIRECT' ELSE '' END) FILTER ({f('is_branch')}))) AS branches,
        list_sort(list_distinct(list(CASE WHEN {f('is_load')} THEN 'LOAD' WHEN {f('is_store')} THEN 'STORE' ELSE 'MEMORY_ACCESS' END) FILTER ({f('accesses_memory')}))) AS memory FROM mk GROUP BY seq, lo)"""


ORACLES = {
    "robust_vectors": f"""{_sql()} SELECT seq, lo, array_to_string(list_transform(list_concat([n::DOUBLE, u::DOUBLE, c / n, is_branch, is_load, is_store, accesses_memory, n::DOUBLE, coalesce(num_edges, 0)::DOUBLE, coalesce(num_edges, 0) / (n * (n - 1)), 0::DOUBLE, is_branch, c0, c1, c2, c3, c4, c5, n, u, is_branch, accesses_memory],
        list_transform(range(0, 42), lambda x: 0::DOUBLE)), lambda x: round(x, 5)::VARCHAR), ',') AS vector, coalesce(dependences, 0) AS dependences FROM sg JOIN oc USING (seq, lo) LEFT JOIN ne USING (seq, lo) LEFT JOIN dp USING (seq, lo)""",
    "robust_patterns": f"{_sql()} SELECT seq, lo, coalesce(array_to_string(branches, ','), '') AS branches, coalesce(array_to_string(memory, ','), '') AS memory FROM sg",
}
