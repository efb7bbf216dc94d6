"""Semantic graphs of windows: typed nodes, sequential, data and memory edges, their matrices, pattern counts and eight class scores.

Nodes are a window's lines but for no-ops and what is no instruction, numbered anew. A data edge leads from the latest definition of a
register to its use, unless that is more than ``REACH`` nodes back; memory edges lead from every store to an address within
``REACH`` nodes to a load from it. Addresses are compared by a key (the stack, or the base register). Definitions meet uses by a
running last value along each register, stores meet loads by equality on address and place, so no pairs of nodes are tried. All of it is
DataFrame plans keyed by the window, whose some tens of lines are one small group.

Defined results: null and blank lines are no nodes; two registers of one definition make two edges to a use of both; a window
without a node has no row; a window without a call before a return has the distance -1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.functions import fixed
from fenceline.plans.assembly_analog import WINDOWS, code_windows
from fenceline.plans.steps import settled

KEY, REACH, MOST_NODES = ("seq", "lo"), 10, 128
ATTRIBUTES = ("reads_memory", "writes_memory", "is_indirect", "uses_stack", "uses_index")
COUNTS = ("total_nodes", "load_count", "store_count", "branch_count", "indirect_count", "fence_count", "cache_op_count", "timing_count", "ret_count", "call_count")
SHARES = ("branch_density", "indirect_ratio", "data_dep_density", "call_ret_distance")


def _has(line: Column, name: str) -> Column:
    return line.rlike("(?i)" + fixed.SEMANTIC_PATTERNS[name])


def _contains(line: Column, part: str) -> Column:
    return F.lower(line).contains(part)


def node_type(line: Column) -> Column:
    """The type of a line's node; NOP and UNKNOWN are none."""
    bare = F.lower(F.trim(line))
    memory = line.contains("[") | (line.contains("(") & line.contains("%"))
    indirect, stack = _has(line, "indirect"), _has(line, "stack_access")
    stores = (_has(line, "store_arm") | _has(line, "store_x86")) & (memory | _contains(line, "push"))
    loads = (_has(line, "load_arm") | _has(line, "load_x86")) & (memory | _contains(line, "pop"))
    tests = (
        (bare.endswith(":") | bare.startswith("."), F.lit("NOP")),
        (_has(line, "ret"), F.lit("RET")),
        (indirect & (_has(line, "call") | _contains(line, "blr")), F.lit("CALL_INDIRECT")),
        (indirect & (_contains(line, "br ") | _contains(line, "jmp")), F.lit("JUMP_INDIRECT")),
        *((_has(line, k), F.lit(t)) for k, t in (("call", "CALL"), ("branch_cond", "BRANCH_COND"), ("branch_uncond", "BRANCH_UNCOND"), ("fence", "FENCE"), ("cache", "CACHE_OP"), ("timing", "TIMING"), ("compare", "COMPARE"), ("nop", "NOP"))),
        (stores, F.when(stack, "STORE_STACK").otherwise("STORE")),
        (loads, F.when(stack, "LOAD_STACK").when(_has(line, "indexed_access"), "LOAD_INDEXED").otherwise("LOAD")),
        (_has(line, "arithmetic") | line.rlike("[A-Za-z]"), F.lit("COMPUTE")),
    )
    return F.coalesce(*(F.when(test, kind) for test, kind in tests), F.lit("UNKNOWN"))


def address_key(line: Column) -> Column:
    """What memory a line's operand is compared by: STACK, MEM_<base register>, MEM_UNKNOWN, null without an operand."""
    pattern = fixed.SEMANTIC_PATTERNS

    def key(content: Column, base: str, stack: tuple[str, ...]) -> Column:
        found = F.regexp_extract(content, pattern[base], 0)
        return F.when(reduce(lambda a, b: a | b, (content.contains(x) for x in stack)), "STACK").when(found != "", F.concat(F.lit("MEM_"), found)).otherwise("MEM_UNKNOWN")

    arm, x86 = (F.lower(F.regexp_extract(line, pattern[k], 1)) for k in ("arm_address", "x86_address"))
    return F.when(arm != "", key(arm, "arm_base", ("sp", "x29", "fp"))).when(x86 != "", key(x86, "x86_base", ("sp", "bp")))


def graph_nodes(lines: DataFrame) -> DataFrame:
    """(seq, lo, node, type, defs, uses, address, <attributes>): the nodes of each window, numbered from 0."""
    line = F.coalesce("line", F.lit(""))
    regs = F.concat(*(F.transform(F.regexp_extract_all(line, F.lit("(?i)" + fixed.SEMANTIC_PATTERNS[k]), F.lit(1)), F.lower) for k in ("arm_reg", "x86_reg")))
    read_only = reduce(lambda a, b: a | b, (_has(line, k) for k in ("store_arm", "store_x86", "compare", "branch_cond", "branch_uncond")))
    rows = lines.where(F.trim(line) != "").select(
        *KEY, "i", node_type(line).alias("type"), regs.alias("regs"), read_only.alias("read_only"), address_key(line).alias("address"), _has(line, "indirect").alias("is_indirect"), _has(line, "stack_access").alias("uses_stack"), _has(line, "indexed_access").alias("uses_index")
    )
    rows = rows.where(~F.col("type").isin("NOP", "UNKNOWN"))
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("i")) - 1
    none = F.array().cast("array<string>")
    defs = F.when(F.col("read_only"), none).otherwise(F.slice("regs", 1, 1))
    uses = F.array_distinct(F.when(F.col("read_only"), F.col("regs")).otherwise(F.slice("regs", 2, F.greatest(F.size("regs"), F.lit(1)))))
    reads, writes = F.col("type").isin("LOAD", "LOAD_STACK", "LOAD_INDEXED"), F.col("type").isin("STORE", "STORE_STACK")
    return rows.select(*KEY, number.alias("node"), "type", defs.alias("defs"), uses.alias("uses"), "address", reads.alias("reads_memory"), writes.alias("writes_memory"), "is_indirect", "uses_stack", "uses_index")


def graph_edges(nodes: DataFrame, reach: int = REACH) -> DataFrame:
    """(seq, lo, src, dst, type, by): SEQ, DATA (a register) and MEM (an address) edges of ``graph_nodes``."""
    steps = nodes.where("node > 0").select(*KEY, (F.col("node") - 1).alias("src"), F.col("node").alias("dst"), F.lit("SEQ").alias("type"), F.lit(None).cast("string").alias("by"))
    each = nodes.select(*KEY, "node", F.lit(0).alias("is_def"), F.explode("uses").alias("by")).unionByName(nodes.select(*KEY, "node", F.lit(1).alias("is_def"), F.explode("defs").alias("by")))
    before = Window.partitionBy(*KEY, "by").orderBy("node", "is_def").rowsBetween(Window.unboundedPreceding, -1)  # a line's uses come before its definition
    last = F.last(F.when(F.col("is_def") == 1, F.col("node")), ignorenulls=True).over(before)
    data = each.withColumn("src", last).where((F.col("is_def") == 0) & (F.col("node") - F.col("src") <= reach)).select(*KEY, "src", F.col("node").alias("dst"), F.lit("DATA").alias("type"), "by")
    stores = nodes.where("writes_memory AND address IS NOT NULL").select(*KEY, F.col("node").alias("src"), F.col("address").alias("by"), F.explode(F.sequence(F.col("node") + 1, F.col("node") + reach)).alias("dst"))
    loads = nodes.where("reads_memory AND address IS NOT NULL").select(*KEY, F.col("node").alias("dst"), F.col("address").alias("by"))
    memory = stores.join(loads, [*KEY, "dst", "by"]).select(*KEY, "src", "dst", F.lit("MEM").alias("type"), "by")
    return steps.unionByName(data).unionByName(memory)


def matrices(nodes: DataFrame, edges: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """(seq, lo, node, features, neighbours): the node's 21 numbers (type, attributes) and the ones of its row of the undirected adjacency matrix; nodes from ``most`` on are cut away."""
    few = nodes.where(F.col("node") < most)
    ones = [(F.col("type") == t).cast("int") for t in fixed.SEMANTIC_NODES] + [F.col(a).cast("int") for a in ATTRIBUTES]
    ends = edges.where((F.col("src") < most) & (F.col("dst") < most))
    both = ends.select(*KEY, F.col("src").alias("node"), F.col("dst").alias("other")).union(ends.select(*KEY, "dst", "src"))
    rows = both.groupBy(*KEY, "node").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))
    return few.select(*KEY, "node", F.array(*ones).alias("features")).join(rows, [*KEY, "node"], "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<int>")))


def patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, lo, <counts>, <shares>, <patterns>, <scores>): a row a window with a node."""
    order = Window.partitionBy(*KEY).orderBy("node")
    kind, following = F.col("type"), F.col("following")
    fence, indexed, call, ret = kind == "FENCE", kind == "LOAD_INDEXED", kind.isin("CALL", "CALL_INDIRECT"), kind == "RET"
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    latest = lambda test: F.last(F.when(test, F.col("node")), ignorenulls=True).over(before)
    rows = nodes.withColumns({"following": F.lead("type").over(order), "fence_at": latest(fence), "indexed_at": latest(indexed), "call_at": latest(call), "ret_at": latest(ret)})
    bare = indexed & (F.col("fence_at").isNull() | (F.col("fence_at") < F.col("indexed_at")))  # no fence since the last one, or since the beginning
    paired = ret & F.col("call_at").isNotNull() & (F.col("ret_at").isNull() | (F.col("ret_at") < F.col("call_at")))
    n = lambda test: F.sum(F.coalesce(test, F.lit(False)).cast("int")).cast("long")
    of = lambda *types: n(kind.isin(*types))
    found = rows.groupBy(*KEY).agg(
        F.count("*").alias("total_nodes"), of("LOAD", "LOAD_INDEXED", "LOAD_STACK").alias("load_count"), of("STORE", "STORE_STACK").alias("store_count"), of("BRANCH_COND", "BRANCH_UNCOND").alias("branch_count"),
        of("CALL_INDIRECT", "JUMP_INDIRECT").alias("indirect_count"), of("FENCE").alias("fence_count"), of("CACHE_OP").alias("cache_op_count"), of("TIMING").alias("timing_count"), of("RET").alias("ret_count"), of("CALL", "CALL_INDIRECT").alias("call_count"),
        *(n((kind == p[0]) if len(p) == 1 else (kind == p[0]) & (following == p[1])).alias(name) for name, p in fixed.NODE_SEQUENCES.items()),
        n(bare).alias("unfenced_indexed_load"), F.coalesce(F.avg(F.when(paired, F.col("node") - F.col("call_at"))), F.lit(-1.0)).alias("call_ret_distance"),
    )
    kinds = edges.groupBy(*KEY).agg(F.sum((F.col("type") == "MEM").cast("int")).cast("long").alias("memory_dep_count"), F.sum((F.col("type") == "DATA").cast("int")).alias("data_edges"))
    found = found.join(kinds, list(KEY), "left").fillna(0, ["memory_dep_count", "data_edges"])
    total, distance = F.col("total_nodes"), F.col("call_ret_distance")
    found = found.withColumns({
        "branch_density": F.col("branch_count") / total, "indirect_ratio": F.col("indirect_count") / F.greatest(F.col("branch_count") + F.col("indirect_count"), F.lit(1)), "data_dep_density": F.col("data_edges") / total,
        "short_call_ret": ((distance > 0) & (distance < 5)).cast("int"),
    })
    scores = {name: reduce(lambda a, b: a + b, (F.col(c) * w for c, w in parts.items())).cast("double") for name, parts in fixed.NODE_SCORES.items()}
    return found.withColumns(scores).select(*KEY, *COUNTS, *SHARES, *fixed.NODE_SEQUENCES, "memory_dep_count", "unfenced_indexed_load", *fixed.NODE_SCORES)


def _graph(s, d) -> tuple[DataFrame, DataFrame]:
    nodes = settled(graph_nodes(code_windows(s, d)))
    return nodes, graph_edges(nodes)


QUERIES = {
    "semantic_nodes": lambda s, d: graph_nodes(code_windows(s, d)).select(*KEY, "node", "type", F.array_join("defs", ",").alias("defs"), F.array_join(F.array_sort("uses"), ",").alias("uses"), F.coalesce("address", F.lit("")).alias("address")),
    "semantic_edges": lambda s, d: _graph(s, d)[1].select(*KEY, "src", "dst", "type", F.coalesce("by", F.lit("")).alias("by")),
    "semantic_matrix": lambda s, d: matrices(*_graph(s, d)).select(*KEY, "node", F.array_join("features", "").alias("features"), F.array_join("neighbours", ",").alias("neighbours")),
    "semantic_scores": lambda s, d: (lambda found: found.select(*KEY, *(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes if c not in KEY)))(patterns(*_graph(s, d))),
}


def _sql() -> str:
    """``nd``: the nodes with their registers and addresses; ``ge``: the edges."""
    m = lambda k: f"regexp_matches(line, '(?i){fixed.SEMANTIC_PATTERNS[k]}')"
    p = fixed.SEMANTIC_PATTERNS
    has = lambda x: f"contains(lower(line), '{x}')"
    memory = "(contains(line, '[') OR (contains(line, '(') AND contains(line, '%')))"
    return rf"""WITH {WINDOWS}, k0 AS (SELECT seq, lo, i, line, CASE WHEN lower(trim(line)) LIKE '%:' OR lower(trim(line)) LIKE '.%' THEN 'NOP' WHEN {m('ret')} THEN 'RET' WHEN {m('indirect')} AND ({m('call')} OR {has('blr')}) THEN 'CALL_INDIRECT'
        WHEN {m('indirect')} AND ({has('br ')} OR {has('jmp')}) THEN 'JUMP_INDIRECT' WHEN {m('call')} THEN 'CALL' WHEN {m('branch_cond')} THEN 'BRANCH_COND' WHEN {m('branch_uncond')} THEN 'BRANCH_UNCOND' WHEN {m('fence')} THEN 'FENCE' WHEN {m('cache')} THEN 'CACHE_OP'
        WHEN {m('timing')} THEN 'TIMING' WHEN {m('compare')} THEN 'COMPARE' WHEN {m('nop')} THEN 'NOP' WHEN ({m('store_arm')} OR {m('store_x86')}) AND ({memory} OR {has('push')}) THEN CASE WHEN {m('stack_access')} THEN 'STORE_STACK' ELSE 'STORE' END
        WHEN ({m('load_arm')} OR {m('load_x86')}) AND ({memory} OR {has('pop')}) THEN CASE WHEN {m('stack_access')} THEN 'LOAD_STACK' WHEN {m('indexed_access')} THEN 'LOAD_INDEXED' ELSE 'LOAD' END WHEN regexp_matches(line, '[A-Za-z]') THEN 'COMPUTE' ELSE 'UNKNOWN' END AS type,
        list_transform(list_concat(regexp_extract_all(line, '(?i){p['arm_reg']}', 1), regexp_extract_all(line, '(?i){p['x86_reg']}', 1)), lambda x: lower(x)) AS regs, {m('store_arm')} OR {m('store_x86')} OR {m('compare')} OR {m('branch_cond')} OR {m('branch_uncond')} AS ro,
        lower(regexp_extract(line, '{p['arm_address']}', 1)) AS arm, lower(regexp_extract(line, '{p['x86_address']}', 1)) AS x86, {m('indirect')} AS is_indirect, {m('stack_access')} AS uses_stack, {m('indexed_access')} AS uses_index FROM aw WHERE trim(line) <> ''),
      nd AS (SELECT *, row_number() OVER (PARTITION BY seq, lo ORDER BY i) - 1 AS node, CASE WHEN ro THEN [] ELSE regs[1:1] END AS defs, list_distinct(CASE WHEN ro THEN regs ELSE regs[2:] END) AS uses,
        CASE WHEN arm <> '' THEN CASE WHEN contains(arm, 'sp') OR contains(arm, 'x29') OR contains(arm, 'fp') THEN 'STACK' WHEN regexp_matches(arm, '{p['arm_base']}') THEN 'MEM_' || regexp_extract(arm, '{p['arm_base']}') ELSE 'MEM_UNKNOWN' END
          WHEN x86 <> '' THEN CASE WHEN contains(x86, 'sp') OR contains(x86, 'bp') THEN 'STACK' WHEN regexp_matches(x86, '{p['x86_base']}') THEN 'MEM_' || regexp_extract(x86, '{p['x86_base']}') ELSE 'MEM_UNKNOWN' END END AS address,
        type IN ('LOAD', 'LOAD_STACK', 'LOAD_INDEXED') AS reads, type IN ('STORE', 'STORE_STACK') AS writes FROM k0 WHERE type NOT IN ('NOP', 'UNKNOWN')),
      us AS (SELECT seq, lo, node, unnest(uses) AS reg FROM nd), df AS (SELECT seq, lo, node, unnest(defs) AS reg FROM nd),
      dt AS (SELECT us.seq, us.lo, max(df.node) AS src, us.node AS dst, us.reg FROM us JOIN df ON df.seq = us.seq AND df.lo = us.lo AND df.reg = us.reg AND df.node < us.node GROUP BY us.seq, us.lo, us.node, us.reg),
      ge AS (SELECT seq, lo, node - 1 AS src, node AS dst, 'SEQ' AS type, '' AS "by" FROM nd WHERE node > 0 UNION ALL SELECT seq, lo, src, dst, 'DATA', reg FROM dt WHERE dst - src <= 10
        UNION ALL SELECT a.seq, a.lo, a.node, b.node, 'MEM', a.address FROM nd a JOIN nd b ON a.seq = b.seq AND a.lo = b.lo AND a.address = b.address AND a.writes AND b.reads AND b.node BETWEEN a.node + 1 AND a.node + 10)"""


def _scores_sql() -> str:
    n = lambda test: f"count(*) FILTER ({test})"
    of = lambda *types: n(" OR ".join(f"type = '{t}'" for t in types))
    sequences = ", ".join(n(f"type = '{p[0]}'" + (f" AND nx = '{p[1]}'" if len(p) == 2 else "")) + f" AS {name}" for name, p in fixed.NODE_SEQUENCES.items())
    scores = ", ".join("round((" + " + ".join(f"{c} * {w}" for c, w in parts.items()) + f")::DOUBLE, 6) AS {name}" for name, parts in fixed.NODE_SCORES.items())
    return f"""{_sql()}, z AS (SELECT a.seq, a.lo, a.node, a.type, b.type AS nx, (SELECT max(node) FROM nd c WHERE c.seq = a.seq AND c.lo = a.lo AND c.node < a.node AND c.type = 'FENCE') AS f, (SELECT max(node) FROM nd c WHERE c.seq = a.seq AND c.lo = a.lo AND c.node < a.node AND c.type = 'LOAD_INDEXED') AS x,
        (SELECT max(node) FROM nd c WHERE c.seq = a.seq AND c.lo = a.lo AND c.node < a.node AND c.type IN ('CALL', 'CALL_INDIRECT')) AS c, (SELECT max(node) FROM nd c WHERE c.seq = a.seq AND c.lo = a.lo AND c.node < a.node AND c.type = 'RET') AS r FROM nd a LEFT JOIN nd b ON b.seq = a.seq AND b.lo = a.lo AND b.node = a.node + 1),
      g AS (SELECT seq, lo, count(*) AS total_nodes, {of('LOAD', 'LOAD_INDEXED', 'LOAD_STACK')} AS load_count, {of('STORE', 'STORE_STACK')} AS store_count, {of('BRANCH_COND', 'BRANCH_UNCOND')} AS branch_count, {of('CALL_INDIRECT', 'JUMP_INDIRECT')} AS indirect_count, {of('FENCE')} AS fence_count, {of('CACHE_OP')} AS cache_op_count,
        {of('TIMING')} AS timing_count, {of('RET')} AS ret_count, {of('CALL', 'CALL_INDIRECT')} AS call_count, {sequences}, {n("type = 'LOAD_INDEXED' AND (f IS NULL OR f < x)")} AS unfenced_indexed_load, coalesce(avg(node - c) FILTER (type = 'RET' AND c IS NOT NULL AND (r IS NULL OR r < c)), -1) AS d FROM z GROUP BY seq, lo),
      e AS (SELECT seq, lo, count(*) FILTER (type = 'MEM') AS m, count(*) FILTER (type = 'DATA') AS dd FROM ge GROUP BY ALL),
      h AS (SELECT g.*, coalesce(m, 0) AS memory_dep_count, branch_count / total_nodes AS branch_density, indirect_count / greatest(branch_count + indirect_count, 1) AS indirect_ratio, coalesce(dd, 0) / total_nodes AS data_dep_density, (d > 0 AND d < 5)::INT AS short_call_ret FROM g LEFT JOIN e USING (seq, lo))
      SELECT seq, lo, {", ".join(COUNTS)}, round(branch_density, 6) AS branch_density, round(indirect_ratio, 6) AS indirect_ratio, round(data_dep_density, 6) AS data_dep_density, round(d, 6) AS call_ret_distance, {", ".join(fixed.NODE_SEQUENCES)}, memory_dep_count, unfenced_indexed_load, {scores} FROM h"""


ORACLES = {
    "semantic_nodes": f"{_sql()} SELECT seq, lo, node, type, array_to_string(defs, ',') AS defs, array_to_string(list_sort(uses), ',') AS uses, coalesce(address, '') AS address FROM nd",
    "semantic_edges": f"""{_sql()} SELECT seq, lo, src, dst, type, "by" FROM ge""",
    "semantic_matrix": f"""{_sql()}, b AS (SELECT seq, lo, src AS node, dst AS o FROM ge UNION SELECT seq, lo, dst, src FROM ge), r AS (SELECT seq, lo, node, string_agg(o::VARCHAR, ',' ORDER BY o) AS neighbours FROM b GROUP BY ALL)
      SELECT seq, lo, node, {" || ".join(f"(type = '{t}')::INT" for t in fixed.SEMANTIC_NODES)} || reads::INT || writes::INT || is_indirect::INT || uses_stack::INT || uses_index::INT AS features, coalesce(neighbours, '') AS neighbours FROM nd LEFT JOIN r USING (seq, lo, node)""",
    "semantic_scores": _scores_sql(),
}
