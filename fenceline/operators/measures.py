"""Measures of control and dependence graphs: loops, strongly connected components, longest paths, triangles and clustering.

A listing's control graph has its code lines in order, an edge from each to the next, and jumps. As every line reaches all later ones, the
lines between a backward jump's target and its source are one component, and components are the unions of such stretches: a
step between neighbours lies in a loop where more backward jumps have begun than ended. That is a running sum, so no
listing is walked; running sums and maxima go through stretches of ``STRETCH`` lines, which bounds a task's window whatever a
listing's length. The condensed graph is a path of the components, so its longest path has one edge less than there are components.

Triangles of any graph come from wedges of the node of smaller degree (ties by name): each edge is kept at that end, so a
hub has no wedges of its own and an edge list of m edges makes at most some m * sqrt(m) wedges.

Defined results: repeated edges count once, and edges to oneself as a loop, not in triangles; null ends are no edges; a listing
of one line has one component and no path. A node of fewer than two neighbours has clustering 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.functions.instructions import normalized
from fenceline.operators.graph import data_dependence
from fenceline.operators.variants import cfg_targets
from fenceline.plans.analogs import instructions
from fenceline.plans.assembly_analog import LISTING, listing

#: Positions of a stretch of running sums.
STRETCH = 4096


def running(rows: DataFrame, by: str, order: str, value: str, name: str, total: Callable[[Column], Column] = F.sum, stretch: int = STRETCH) -> DataFrame:
    """``rows`` with ``name``, the running sum (or ``total``, which may be ``F.max``) of ``value`` along ``order`` within ``by``, itself included.

    Stretches of positions are totalled first, so that a window holds the rows of a stretch or a row a stretch. ``order`` is a unique number from 0 on, gaps or not.
    """
    join = F.greatest if total is F.max else lambda a, b: a + b
    parts = rows.withColumn("part", F.floor(F.col(order) / stretch))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy(by, "part").agg(total(F.col(value)).alias("all")).select(by, "part", total(F.col("all")).over(before).alias("base"))
    own = Window.partitionBy(by, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    here = parts.withColumn(name, total(F.col(value)).over(own)).join(bases, [by, "part"])
    both = F.when(F.col("base").isNull(), F.col(name)).when(F.col(name).isNull(), F.col("base")).otherwise(join(F.col("base"), F.col(name)))
    return here.withColumn(name, both).drop("part", "base")


def code_lines(rows: DataFrame) -> DataFrame:
    """(seq, pos): the nodes of a listing's control graph."""
    return rows.where(normalized(F.col("line")) != "").select("seq", "pos")


def control_components(nodes: DataFrame, edges: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(seq, pos, component): each node's strongly connected component, by its first node.

    Exact for graphs with an edge from every node to the next one of its ``seq``, as ``cfg_targets`` makes them.
    """
    back = edges.where("dst < src").select("seq", "src", "dst").distinct()
    turns = back.groupBy("seq", F.col("dst").alias("pos")).agg(F.count("*").alias("n")).unionByName(back.groupBy("seq", F.col("src").alias("pos")).agg((-F.count("*")).alias("n")))
    turns = turns.groupBy("seq", "pos").agg(F.sum("n").alias("turn"))
    marked = running(nodes.join(turns, ["seq", "pos"], "left").fillna(0, ["turn"]), "seq", "pos", "turn", "open", stretch=stretch)
    starts = marked.withColumn("start", F.when(F.col("open") == F.col("turn"), F.col("pos")))  # no loop is open before the node
    return running(starts, "seq", "pos", "start", "component", F.max, stretch).select("seq", "pos", "component")


def complexity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, nodes, edges, cyclomatic, branch_factor, components, max_path_length, condensed_path) of control graphs.

    ``max_path_length`` is 0 where there is a loop, an edge to oneself among them; ``condensed_path`` is the longest path of the components, loops or not.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("seq", "src", "dst").distinct()
    parts = control_components(nodes, edges).groupBy("seq").agg(F.count("*").alias("nodes"), F.count_distinct("component").alias("components"))
    out = edges.groupBy("seq", "src").agg(F.count("*").alias("n"), F.max((F.col("dst") <= F.col("src")).cast("int")).alias("back"))
    out = out.groupBy("seq").agg(F.sum("n").alias("edges"), F.sum((F.col("n") > 1).cast("int")).alias("forks"), F.max("back").alias("loops"))
    both = parts.join(out, "seq", "left").fillna(0, ["edges", "forks", "loops"])
    return both.select(
        "seq", "nodes", "edges", (F.col("edges") - F.col("nodes") + 2).alias("cyclomatic"), F.round(F.col("forks") / F.col("nodes"), 6).alias("branch_factor"), "components",
        F.when(F.col("loops") == 0, F.col("nodes") - 1).otherwise(0).alias("max_path_length"), (F.col("components") - 1).alias("condensed_path"),
    )


def undirected(edges: DataFrame, by: str = "seq") -> DataFrame:
    """(by, a, b): the distinct pairs of ends, a < b."""
    ends = edges.where("src != dst").select(by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return ends.distinct()


def clustering(edges: DataFrame, by: str = "seq") -> DataFrame:
    """(by, node, degree, triangles, coefficient): local clustering of every node with an edge; a node's neighbours are those at either end of its edges."""
    pairs = undirected(edges, by)
    both = pairs.union(pairs.select(by, F.col("b"), F.col("a")))
    degree = both.groupBy(by, F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    of = lambda k: degree.select(by, F.col("node").alias(k), F.col("degree").alias(f"d_{k}"))
    ranked = pairs.join(of("a"), [by, "a"]).join(of("b"), [by, "b"])
    swap = (F.col("d_a") > F.col("d_b")) | ((F.col("d_a") == F.col("d_b")) & (F.col("a") > F.col("b")))
    away = ranked.select(by, F.when(swap, F.col("b")).otherwise(F.col("a")).alias("low"), F.when(swap, F.struct(F.col("d_a").alias("d"), F.col("a").alias("node"))).otherwise(F.struct(F.col("d_b").alias("d"), F.col("b").alias("node"))).alias("high"))
    first, second = away.select(by, "low", F.col("high").alias("x")), away.select(by, "low", F.col("high").alias("y"))
    wedges = first.join(second, [by, "low"]).where("x < y").select(by, "low", F.col("x.node").alias("p"), F.col("y.node").alias("q"))
    closed = wedges.withColumns({"a": F.least("p", "q"), "b": F.greatest("p", "q")}).join(pairs, [by, "a", "b"])
    corners = closed.select(by, F.explode(F.array("low", "p", "q")).alias("node")).groupBy(by, "node").agg(F.count("*").alias("triangles"))
    found = degree.join(corners, [by, "node"], "left").fillna(0, ["triangles"])
    most = F.col("degree") * (F.col("degree") - 1)
    return found.withColumn("coefficient", F.when(most > 0, 2 * F.col("triangles") / most).otherwise(0.0))


def average_clustering(nodes: DataFrame, edges: DataFrame, by: str = "seq") -> DataFrame:
    """(by, avg_clustering): the mean over all of ``nodes`` (by, ...), those without an edge count as 0."""
    total = nodes.groupBy(by).agg(F.count("*").alias("n"))
    sums = clustering(edges, by).groupBy(by).agg(F.sum("coefficient").alias("s"))
    return total.join(sums, by, "left").select(by, (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("avg_clustering"))


def _edges(s, d) -> DataFrame:
    return cfg_targets(listing(s, d))


QUERIES = {
    "control_components": lambda s, d: control_components(code_lines(listing(s, d)), _edges(s, d)),
    "cfg_complexity": lambda s, d: complexity(code_lines(listing(s, d)), _edges(s, d)),
    "dependence_clustering": lambda s, d: clustering(data_dependence(instructions(s, d))).withColumn("coefficient", F.round("coefficient", 6)),
}


def _cfg_sql() -> str:
    """``nd`` (seq, pos) and ``e`` (seq, src, dst), and ``r``: which node reaches which."""
    from fenceline.operators.variants import ORACLES as VARIANTS

    return rf"""WITH RECURSIVE {LISTING}, tc AS (SELECT seq, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS b FROM li),
      nd AS (SELECT seq, pos FROM tc WHERE b <> '' AND b NOT LIKE '.%' AND b NOT LIKE '%:' AND regexp_replace(split_part(b, ';', 1), '\s+$', '') <> ''),
      e AS (SELECT DISTINCT seq, src, dst FROM ({VARIANTS['cfg_targets']})),
      r AS (SELECT seq, src AS a, dst AS b FROM e UNION SELECT r.seq, r.a, e.dst FROM r JOIN e ON e.seq = r.seq AND e.src = r.b),
      m AS (SELECT nd.seq, nd.pos, least(nd.pos, coalesce(min(x.b), nd.pos)) AS component FROM nd LEFT JOIN r x ON x.seq = nd.seq AND x.a = nd.pos AND EXISTS (SELECT 1 FROM r y WHERE y.seq = x.seq AND y.a = x.b AND y.b = x.a) GROUP BY nd.seq, nd.pos)"""


def _complexity_sql() -> str:
    return f"""{_cfg_sql()}, ce AS (SELECT DISTINCT e.seq, a.component AS src, b.component AS dst FROM e JOIN m a ON a.seq = e.seq AND a.pos = e.src JOIN m b ON b.seq = e.seq AND b.pos = e.dst WHERE a.component <> b.component),
      p AS (SELECT DISTINCT seq, component AS node, 0 AS n FROM m UNION SELECT p.seq, ce.dst, n + 1 FROM p JOIN ce ON ce.seq = p.seq AND ce.src = p.node),
      g AS (SELECT seq, max(n) AS condensed FROM p GROUP BY seq), c AS (SELECT seq, count(*) AS nodes, count(DISTINCT component) AS components FROM m GROUP BY seq),
      o AS (SELECT seq, sum(n)::BIGINT AS edges, count(*) FILTER (n > 1) AS forks, max(b) AS loops FROM (SELECT seq, src, count(*) AS n, max((dst <= src)::INT) AS b FROM e GROUP BY ALL) GROUP BY seq)
      SELECT seq, nodes, coalesce(edges, 0) AS edges, coalesce(edges, 0) - nodes + 2 AS cyclomatic, round(coalesce(forks, 0) / nodes, 6) AS branch_factor, components, CASE WHEN coalesce(loops, 0) = 0 THEN condensed ELSE 0 END AS max_path_length, condensed AS condensed_path
      FROM c JOIN g USING (seq) LEFT JOIN o USING (seq)"""


def _clustering_sql() -> str:
    from fenceline.operators.graph import _DATA
    from fenceline.plans.analogs import EV

    return f"""WITH {EV}, {_DATA}, n AS (SELECT DISTINCT seq, src AS a, dst AS b FROM dd WHERE src <> dst UNION SELECT seq, dst, src FROM dd WHERE src <> dst), d AS (SELECT seq, a AS node, count(*) AS degree FROM n GROUP BY ALL),
      t AS (SELECT x.seq, x.a AS node, count(*) // 2 AS triangles FROM n x JOIN n y ON y.seq = x.seq AND y.a = x.a AND y.b <> x.b JOIN n z ON z.seq = x.seq AND z.a = x.b AND z.b = y.b GROUP BY ALL)
      SELECT seq, node, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS coefficient FROM d LEFT JOIN t USING (seq, node)"""


ORACLES = {
    "control_components": f"{_cfg_sql()} SELECT seq, pos, component FROM m",
    "cfg_complexity": _complexity_sql(),
    "dependence_clustering": _clustering_sql(),
}
