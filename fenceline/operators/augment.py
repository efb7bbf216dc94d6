"""Sequences made from sequences: every choice is the order of an md5, and every edit a new position, never a rewritten array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.plans.analogs import BRANCH, EV, FENCE, LOAD, RET, STORE, instructions

SEED, BLOCK, WIDTH, LANES = 42, 6, 30, 16


def _seq():
    return Window.partitionBy("seq").orderBy("pos")


def _chance(*columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), *(F.col(c).cast("string") for c in columns)))


def renamed(rows: DataFrame) -> DataFrame:
    """(seq, pos, op, dest, src): registers of a sequence permuted among themselves, all at once, so no renames chain."""
    used = rows.select("seq", F.explode(F.array("dest", "src")).alias("reg")).where("reg IS NOT NULL").distinct()
    own = Window.partitionBy("seq")
    places = used.select("seq", "reg", F.row_number().over(own.orderBy(_chance("seq", "reg"), "reg")).alias("k"), F.row_number().over(own.orderBy("reg")).alias("i"))
    # a sequence has as many entries as registers, whatever its length
    lists = places.groupBy("seq").agg(F.collect_list(F.struct("reg", "k")).alias("p"), F.sort_array(F.collect_list(F.struct("i", "reg"))).alias("by"))
    names = lists.select("seq", F.map_from_entries(F.transform("p", lambda x: F.struct(x.reg, F.element_at("by", x.k).reg))).alias("names"))
    new = lambda c: F.when(F.col(c).isNotNull(), F.element_at("names", F.col(c)))
    return rows.join(names, "seq").select("seq", "pos", "op", new("dest").alias("dest"), new("src").alias("src"))


def with_noops(rows: DataFrame) -> DataFrame:
    """(seq, pos, op): a ``nop`` after about a tenth of the rows."""
    marked = rows.select("seq", "pos", "op", (F.substring(_chance("seq", "pos"), 1, 2) < "1a").cast("int").alias("extra"))
    moved = marked.withColumn("at", F.col("pos") + F.coalesce(F.sum("extra").over(_seq().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = F.when(F.col("extra") == 1, F.array("op", F.lit("nop"))).otherwise(F.array("op"))
    return moved.select("seq", "at", F.posexplode(both).alias("k", "op")).select("seq", (F.col("at") + F.col("k")).alias("pos"), "op")


def with_barrier(rows: DataFrame, branch: Column, load: Column, barrier: str) -> DataFrame:
    """(seq, pos, op): a barrier before the first load after the first branch; sequences without one are left out."""
    first = rows.withColumn("b", F.min(F.when(branch, F.col("pos"))).over(Window.partitionBy("seq")))
    at = first.withColumn("l", F.min(F.when(load & (F.col("pos") > F.col("b")), F.col("pos"))).over(Window.partitionBy("seq"))).where("l IS NOT NULL")
    both = F.when(F.col("pos") == F.col("l"), F.array(F.lit(barrier), "op")).otherwise(F.array("op"))
    shift = F.when(F.col("pos") > F.col("l"), 1).otherwise(0)
    return at.select("seq", (F.col("pos") + shift).alias("at"), F.posexplode(both).alias("k", "op")).select("seq", (F.col("at") + F.col("k")).alias("pos"), "op")


def recomposed(rows: DataFrame, control: Column) -> DataFrame:
    """(seq, pos, op): the first two thirds exchanged, where neither ends in a control transfer."""
    own = Window.partitionBy("seq")
    third = F.floor(F.count("*").over(own) / 3)
    cut = rows.withColumn("third", third)
    ends = F.max(((F.col("pos") + 1).isin(F.col("third"), 2 * F.col("third")) & control).cast("int")).over(own)
    safe = cut.withColumn("unsafe", ends).where("unsafe = 0 AND third > 0")
    moved = F.when(F.col("pos") < F.col("third"), F.col("pos") + F.col("third")).when(F.col("pos") < 2 * F.col("third"), F.col("pos") - F.col("third"))
    return safe.select("seq", F.coalesce(moved, F.col("pos")).alias("pos"), "op")


def independent_swap(rows: DataFrame, load: Column, store: Column, control: Column) -> DataFrame:
    """(seq, lo): one pair of neighbours a sequence that can change places.

    Neither writes a register of the other or transfers control, and they are not a store and another memory access.
    """
    marked = rows.select("seq", "pos", "dest", "src", (load | store).alias("m"), store.alias("w"), control.alias("c"))
    after = {k: F.lead(k).over(_seq()).alias(f"{k}2") for k in ("dest", "src", "m", "w", "c")}
    pairs = marked.select("*", *after.values()).where("src2 IS NOT NULL AND NOT c AND NOT c2 AND NOT (m AND m2 AND (w OR w2))")
    differ = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(True))
    free = pairs.where(differ("dest", "src2") & differ("src", "dest2") & differ("dest", "dest2"))
    return free.groupBy("seq").agg(F.min_by("pos", F.struct(_chance("seq", "pos"), "pos")).alias("lo"))


def recombined(rows: DataFrame, width: int = WIDTH, block: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """(seq_a, at_a, seq_b, at_b, ops): the start of one window up to a block and what follows the same block in another.

    Blocks of equal ops order the windows that hold them; each meets the next of its lane only, so a block that is in
    every window makes as many rows as windows. Lanes split such a block's windows.
    """
    window = Window.partitionBy("seq", F.floor(F.col("pos") / width)).orderBy("pos")
    marked = rows.select(
        "seq", "pos", F.floor(F.col("pos") / width).alias("win"),
        F.collect_list("op").over(window.rowsBetween(0, block - 1)).alias("of"),
        F.array_join(F.collect_list("op").over(window.rowsBetween(Window.unboundedPreceding, block - 1)), " ").alias("head"),
        F.array_join(F.collect_list("op").over(window.rowsBetween(block, Window.unboundedFollowing)), " ").alias("tail"),
    ).where(F.size("of") == block)
    blocks = marked.withColumn("key", F.array_join("of", " ")).groupBy("seq", "win", "key").agg(F.min_by(F.struct("pos", "head", "tail"), "pos").alias("x"))
    order = Window.partitionBy("key", F.col("seq") % lanes).orderBy("seq", "win")
    ahead = blocks.select("seq", "win", "x", F.lead("seq").over(order).alias("seq_b"), F.lead("win").over(order).alias("win_b"), F.lead("x").over(order).alias("y"))
    found = ahead.where("seq_b IS NOT NULL AND y.tail <> ''").groupBy("seq", "win", "seq_b", "win_b").agg(F.min_by(F.struct("x", "y"), F.col("x.pos")).alias("p"))
    return found.select(
        F.col("seq").alias("seq_a"), F.col("p.x.pos").alias("at_a"), "seq_b", F.col("p.y.pos").alias("at_b"), F.concat_ws(" ", "p.x.head", "p.y.tail").alias("ops")
    )


QUERIES = {
    "rename_registers": lambda s, d: renamed(instructions(s, d)),
    "noop_insertion": lambda s, d: with_noops(instructions(s, d)),
    "barrier_insertion": lambda s, d: with_barrier(instructions(s, d), F.col("op") == BRANCH, F.col("op") == LOAD, FENCE),
    "recompose_thirds": lambda s, d: recomposed(instructions(s, d), F.col("op").isin(BRANCH, RET)),
    "independent_swap": lambda s, d: independent_swap(instructions(s, d), F.col("op") == LOAD, F.col("op") == STORE, F.col("op").isin(BRANCH, RET, FENCE)),
    "cross_window_recombine": lambda s, d: recombined(instructions(s, d)),
}
_MD5 = f"md5('{SEED}|' || seq || '|' || pos)"
ORACLES = {
    "rename_registers": f"""WITH {EV}, u AS (SELECT seq, dest AS reg FROM ev WHERE dest IS NOT NULL UNION SELECT seq, src FROM ev),
      p AS (SELECT seq, reg, row_number() OVER (PARTITION BY seq ORDER BY md5('{SEED}|' || seq || '|' || reg), reg) AS k, row_number() OVER (PARTITION BY seq ORDER BY reg) AS i FROM u),
      m AS (SELECT a.seq, a.reg, b.reg AS name FROM p a JOIN p b ON a.seq = b.seq AND a.k = b.i)
      SELECT ev.seq, pos, op, d.name AS dest, s.name AS src FROM ev LEFT JOIN m d ON d.seq = ev.seq AND d.reg = dest JOIN m s ON s.seq = ev.seq AND s.reg = ev.src""",
    "noop_insertion": f"""WITH {EV}, x AS (SELECT seq, op, pos, CASE WHEN {_MD5}[1:2] < '1a' THEN 1 ELSE 0 END AS extra FROM ev),
      y AS (SELECT seq, op, pos, extra, sum(extra) OVER (PARTITION BY seq ORDER BY pos) AS upto FROM x)
      SELECT seq, (pos + upto - extra)::BIGINT AS pos, op FROM y UNION ALL SELECT seq, (pos + upto)::BIGINT, 'nop' FROM y WHERE extra = 1""",
    "barrier_insertion": f"""WITH {EV}, b AS (SELECT seq, min(pos) AS b FROM ev WHERE op = '{BRANCH}' GROUP BY seq),
      l AS (SELECT seq, min(pos) AS l FROM ev JOIN b USING (seq) WHERE op = '{LOAD}' AND pos > b GROUP BY seq)
      SELECT seq, CASE WHEN pos >= l THEN pos + 1 ELSE pos END AS pos, op FROM ev JOIN l USING (seq) UNION ALL SELECT seq, l, '{FENCE}' FROM l""",
    "recompose_thirds": f"""WITH {EV}, t AS (SELECT seq, count(*) // 3 AS third FROM ev GROUP BY seq),
      bad AS (SELECT DISTINCT seq FROM ev JOIN t USING (seq) WHERE (pos + 1 = third OR pos + 1 = 2 * third) AND op IN ('{BRANCH}', '{RET}'))
      SELECT seq, CASE WHEN pos < third THEN pos + third WHEN pos < 2 * third THEN pos - third ELSE pos END AS pos, op
      FROM ev JOIN t USING (seq) WHERE third > 0 AND seq NOT IN (SELECT seq FROM bad)""",
    "independent_swap": f"""WITH {EV} SELECT a.seq, arg_min(a.pos, md5('{SEED}|' || a.seq || '|' || a.pos)) AS lo FROM ev a JOIN ev b ON a.seq = b.seq AND b.pos = a.pos + 1
      WHERE a.op NOT IN ('{BRANCH}', '{RET}', '{FENCE}') AND b.op NOT IN ('{BRANCH}', '{RET}', '{FENCE}') AND NOT (a.op IN ('{LOAD}', '{STORE}') AND b.op IN ('{LOAD}', '{STORE}') AND '{STORE}' IN (a.op, b.op))
        AND coalesce(a.dest <> b.src, true) AND coalesce(a.src <> b.dest, true) AND coalesce(a.dest <> b.dest, true) GROUP BY a.seq""",
    "cross_window_recombine": f"""WITH {EV}, w AS (SELECT seq, pos // {WIDTH} AS win, min(pos) AS lo, list(op ORDER BY pos) AS ops FROM ev GROUP BY ALL),
      k AS (SELECT seq, win, lo, ops, unnest(range(1, len(ops) - {BLOCK} + 2)) AS i FROM w WHERE len(ops) >= {BLOCK}),
      f AS (SELECT seq, win, array_to_string(ops[i:i + {BLOCK} - 1], ' ') AS key, min(i) AS i, any_value(lo) AS lo, any_value(ops) AS ops FROM k GROUP BY ALL),
      n AS (SELECT *, lead(seq) OVER o AS seq_b, lead(win) OVER o AS win_b, lead(i) OVER o AS ib, lead(lo) OVER o AS lob, lead(ops) OVER o AS opsb FROM f WINDOW o AS (PARTITION BY key, seq % {LANES} ORDER BY seq, win)),
      g AS (SELECT * FROM n WHERE seq_b IS NOT NULL AND len(opsb) >= ib + {BLOCK} QUALIFY row_number() OVER (PARTITION BY seq, win, seq_b, win_b ORDER BY i) = 1)
      SELECT seq AS seq_a, lo + i - 1 AS at_a, seq_b, lob + ib - 1 AS at_b, array_to_string(list_concat(ops[:i + {BLOCK} - 1], opsb[ib + {BLOCK}:]), ' ') AS ops FROM g""",
}
