"""Program-dependence edges of sequences: control, data, speculation, memory order, cache, fence.

All rules look back or ahead along positions of one sequence; each is a window or an equi-join, never a join of all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.plans.analogs import BRANCH, EV, FENCE, LOAD, RET, STORE, instructions

EDGES = {"DATA": 0, "CONTROL": 1, "SPEC_COND": 2, "SPEC_INDIRECT": 3, "SPEC_RETURN": 4, "MEMORY": 5, "CACHE": 6, "FENCE": 7}


def _seq():
    return Window.partitionBy("seq").orderBy("pos")


def control(rows: DataFrame) -> DataFrame:
    """(seq, src, dst): each instruction to the next."""
    return rows.select("seq", F.lag("pos").over(_seq()).alias("src"), F.col("pos").alias("dst")).where("src IS NOT NULL")


def last_defs(defs: DataFrame, uses: DataFrame, k: int) -> DataFrame:
    """(seq, src, dst, reg): for each use (seq, reg, pos) the last ``k`` defs of the register before it.

    Defs are numbered; a running count tells a use the number of the last def before it, so the join is on equal
    numbers and linear in the rows, however long the sequence.
    """
    own = Window.partitionBy("seq", "reg").orderBy("pos")
    numbered = defs.select("seq", "reg", F.col("pos").alias("src"), F.row_number().over(own).alias("nth"))
    both = defs.select("seq", "reg", "pos", F.lit(1).alias("is_def")).unionByName(uses.select("seq", "reg", "pos", F.lit(0).alias("is_def")))
    before = Window.partitionBy("seq", "reg").orderBy("pos", "is_def").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("seen", F.sum("is_def").over(before)).where("is_def = 0 AND seen > 0")
    wanted = seen.select("seq", "reg", F.col("pos").alias("dst"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("seen") - (k - 1)).cast("int"), F.col("seen").cast("int"))).alias("nth"))
    return wanted.join(numbered, ["seq", "reg", "nth"]).select("seq", "src", "dst", "reg")


def data_dependence(rows: DataFrame, k: int = 3) -> DataFrame:
    defs = rows.where("dest IS NOT NULL").select("seq", F.col("dest").alias("reg"), "pos")
    return last_defs(defs, rows.select("seq", F.col("src").alias("reg"), "pos"), k)


def memory_order(rows: DataFrame, store: Column, load: Column, k: int = 2) -> DataFrame:
    """The last ``k`` stores through a load's register before it."""
    by = rows.select("seq", F.col("src").alias("reg"), "pos", "op")
    return last_defs(by.where(store), by.where(load), k)


def within(rows: DataFrame, source: Column, target: Column, reach: int, fences: Column | None = None) -> DataFrame:
    """(seq, src, dst): sources to targets at most ``reach`` ahead; with ``fences``, none in (src, dst]."""
    stops = F.sum(fences.cast("int")).over(_seq().rowsBetween(Window.unboundedPreceding, 0)) if fences is not None else F.lit(0)
    marked = rows.select("seq", "pos", "op", stops.alias("stops"))
    ahead = marked.where(source).select("seq", F.col("pos").alias("src"), "stops", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + reach)).alias("dst"))
    return ahead.join(marked.where(target).select("seq", F.col("pos").alias("dst"), "stops"), ["seq", "dst", "stops"]).select("seq", "src", "dst")


def speculation(rows: DataFrame, reach: int = 10) -> DataFrame:
    """(seq, src, dst, type, weight): from each source to the relevant rows at most ``reach`` ahead with no fence in (src, dst].

    ``rows`` has seq, pos, source (the edge's type, null for other rows), factor, relevant and fence. Indirect sources
    (type 3) reach every row. The weight is factor / distance, 3 at most.
    """
    stops = F.sum(F.col("fence").cast("int")).over(_seq().rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("stops", stops)
    ahead = marked.where("source IS NOT NULL").select("seq", F.col("pos").alias("src"), F.col("source").alias("type"), "stops", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + reach)).alias("dst"))
    found = ahead.join(marked.select("seq", F.col("pos").alias("dst"), "stops", "factor", "relevant"), ["seq", "dst", "stops"]).where(F.col("relevant") | (F.col("type") == EDGES["SPEC_INDIRECT"]))
    return found.select("seq", "src", "dst", "type", F.round(F.least(F.lit(3.0), F.col("factor") / (F.col("dst") - F.col("src"))), 6).alias("weight"))


def speculative(rows: DataFrame) -> DataFrame:
    """Speculation edges of the event stream: branches, returns and stores through register 0 (as indirect jumps); loads through register 1 are secrets (3), through 2 timing (2.5)."""
    op, load = F.col("op"), F.col("op") == LOAD
    source = F.when(op == BRANCH, F.lit(EDGES["SPEC_COND"])).when(op == RET, F.lit(EDGES["SPEC_RETURN"])).when((op == STORE) & (F.col("src") == 0), F.lit(EDGES["SPEC_INDIRECT"]))
    factor = F.when(load & (F.col("src") == 1), 3.0).when(load & (F.col("src") == 2), 2.5).when(op.isin(LOAD, STORE), 2.0).otherwise(1.0)
    return speculation(rows.select("seq", "pos", source.alias("source"), factor.alias("factor"), op.isin(LOAD, STORE).alias("relevant"), (op == FENCE).alias("fence")))


def after_fence(rows: DataFrame) -> DataFrame:
    found = rows.select("seq", F.lag("pos").over(_seq()).alias("src"), F.col("pos").alias("dst"), F.lag("op").over(_seq()).alias("before"))
    return found.where(F.col("before") == FENCE).select("seq", "src", "dst")


def all_edges(rows: DataFrame) -> DataFrame:
    """(seq, src, dst, type): every edge; data and memory edges count once a register."""
    op = F.col("op")
    parts = {
        "CONTROL": control(rows), "DATA": data_dependence(rows), "MEMORY": memory_order(rows, op == STORE, op == LOAD), "CACHE": within(rows, op == STORE, op == LOAD, 5), "FENCE": after_fence(rows),
    }
    found = [df.select("seq", "src", "dst", F.lit(EDGES[k]).alias("type")) for k, df in parts.items()]
    out = speculative(rows).select("seq", "src", "dst", "type")
    for df in found:
        out = out.unionByName(df)
    return out


def degrees(rows: DataFrame) -> DataFrame:
    """(seq, nodes, edges, density, max_out): of the control and data edges."""
    edges = control(rows).unionByName(data_dependence(rows).select("seq", "src", "dst"))
    out = edges.groupBy("seq", "src").agg(F.count("*").alias("n")).groupBy("seq").agg(F.sum("n").alias("edges"), F.max("n").alias("max_out"))
    nodes = rows.groupBy("seq").agg(F.count("*").alias("nodes"))
    return nodes.join(out, "seq").select("seq", "nodes", "edges", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6).alias("density"), "max_out")


QUERIES = {
    "pdg_control": lambda s, d: control(instructions(s, d)),
    "pdg_data_dep": lambda s, d: data_dependence(instructions(s, d)),
    "pdg_spec_edges": lambda s, d: speculative(instructions(s, d)),
    "pdg_mem_order": lambda s, d: memory_order(instructions(s, d), F.col("op") == STORE, F.col("op") == LOAD),
    "pdg_cache_temporal": lambda s, d: within(instructions(s, d), F.col("op") == STORE, F.col("op") == LOAD, 5),
    "pdg_fence": lambda s, d: after_fence(instructions(s, d)),
    "edge_type_dist": lambda s, d: all_edges(instructions(s, d)).groupBy("type").agg(F.count("*").alias("n")),
    "graph_degrees": lambda s, d: degrees(instructions(s, d)),
}
_DATA = """dd AS (SELECT u.seq, x.pos AS src, u.pos AS dst, u.src AS reg FROM ev u JOIN ev x ON u.seq = x.seq AND x.dest = u.src AND x.pos < u.pos
  QUALIFY row_number() OVER (PARTITION BY u.seq, u.pos ORDER BY x.pos DESC) <= 3)"""
_MEM = f"""mm AS (SELECT u.seq, x.pos AS src, u.pos AS dst, u.src AS reg FROM ev u JOIN ev x ON u.seq = x.seq AND x.src = u.src AND x.pos < u.pos AND x.op = '{STORE}' AND u.op = '{LOAD}'
  QUALIFY row_number() OVER (PARTITION BY u.seq, u.pos ORDER BY x.pos DESC) <= 2)"""


_SPEC = f"""sp AS (SELECT a.seq, a.pos AS src, b.pos AS dst, CASE a.op WHEN '{BRANCH}' THEN 2 WHEN '{RET}' THEN 4 ELSE 3 END AS type,
    round(least(3.0, (CASE WHEN b.op = '{LOAD}' AND b.src = 1 THEN 3 WHEN b.op = '{LOAD}' AND b.src = 2 THEN 2.5 WHEN b.op IN ('{LOAD}', '{STORE}') THEN 2 ELSE 1 END) / (b.pos - a.pos)), 6) AS weight
  FROM ev a JOIN ev b ON a.seq = b.seq AND b.pos BETWEEN a.pos + 1 AND a.pos + 10
  WHERE (a.op IN ('{BRANCH}', '{RET}') AND b.op IN ('{LOAD}', '{STORE}') OR a.op = '{STORE}' AND a.src = 0)
    AND NOT EXISTS (SELECT 1 FROM ev f WHERE f.seq = a.seq AND f.op = '{FENCE}' AND f.pos > a.pos AND f.pos <= b.pos))"""
_CACHE = f"cc AS (SELECT a.seq, a.pos AS src, b.pos AS dst FROM ev a JOIN ev b ON a.seq = b.seq AND b.pos BETWEEN a.pos + 1 AND a.pos + 5 WHERE a.op = '{STORE}' AND b.op = '{LOAD}')"
_NEXT = "nx AS (SELECT a.seq, a.pos AS src, b.pos AS dst, a.op FROM ev a JOIN ev b ON a.seq = b.seq AND b.pos = a.pos + 1)"
ORACLES = {
    "pdg_control": f"WITH {EV}, {_NEXT} SELECT seq, src, dst FROM nx",
    "pdg_data_dep": f"WITH {EV}, {_DATA} SELECT * FROM dd",
    "pdg_spec_edges": f"WITH {EV}, {_SPEC} SELECT seq, src, dst, type, weight FROM sp",
    "pdg_mem_order": f"WITH {EV}, {_MEM} SELECT * FROM mm",
    "pdg_cache_temporal": f"WITH {EV}, {_CACHE} SELECT * FROM cc",
    "pdg_fence": f"WITH {EV}, {_NEXT} SELECT seq, src, dst FROM nx WHERE op = '{FENCE}'",
    "edge_type_dist": f"""WITH {EV}, {_DATA}, {_MEM}, {_SPEC}, {_CACHE}, {_NEXT},
      t AS (SELECT 0 AS type FROM dd UNION ALL SELECT 1 FROM nx UNION ALL SELECT type FROM sp UNION ALL SELECT 5 FROM mm UNION ALL SELECT 6 FROM cc UNION ALL SELECT 7 FROM nx WHERE op = '{FENCE}')
      SELECT type, count(*) AS n FROM t GROUP BY type""",
    "graph_degrees": f"""WITH {EV}, {_DATA}, {_NEXT}, e AS (SELECT seq, src FROM dd UNION ALL SELECT seq, src FROM nx),
      o AS (SELECT seq, sum(n)::BIGINT AS edges, max(n) AS max_out FROM (SELECT seq, src, count(*) AS n FROM e GROUP BY ALL) GROUP BY seq),
      n AS (SELECT seq, count(*) AS nodes FROM ev GROUP BY seq) SELECT seq, nodes, edges, round(edges / (nodes * (nodes - 1)), 6) AS density, max_out FROM n JOIN o USING (seq)""",
}
