"""Patterns over sequences and a small declarative rule language."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.plans.analogs import BRANCH, EV, FENCE, LOAD, RET, STORE, instructions


def _seq():
    return Window.partitionBy("seq").orderBy("pos")


def _before():
    return _seq().rowsBetween(Window.unboundedPreceding, -1)


def unfenced(rows: DataFrame, target: Column, fence: Column) -> DataFrame:
    """(seq, n): targets with no fence since the target before them (or the start)."""
    event = F.when(target, F.lit("t")).when(fence, F.lit("f"))
    marked = rows.withColumn("is_target", target).withColumn("last", F.last(event, ignorenulls=True).over(_before()))
    hit = F.col("is_target") & (F.coalesce("last", F.lit("t")) != "f")
    return marked.groupBy("seq").agg(F.sum(hit.cast("int")).alias("n"))


def mean_distance(rows: DataFrame, opener: Column, closer: Column) -> DataFrame:
    """(seq, distance): mean distance from the latest opener to each closer, one closer an opener; -1 without any."""
    closed = F.coalesce(F.sum(closer.cast("int")).over(_before()), F.lit(0))
    marked = rows.withColumn("closer", closer).withColumn("opener", F.when(opener, F.col("pos"))).withColumn("part", closed)
    own = Window.partitionBy("seq", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    found = marked.withColumn("from", F.last("opener", ignorenulls=True).over(own))
    return found.groupBy("seq").agg(F.round(F.coalesce(F.avg(F.when(F.col("closer"), F.col("pos") - F.col("from"))), F.lit(-1.0)), 6).alias("distance"))


def contiguous(rows: DataFrame, pattern: list[str]) -> DataFrame:
    """(seq, pos): where the operations begin that match ``pattern``; ``*`` ends a prefix, alone it is any."""
    ops = [F.col("op"), *(F.lead("op", k).over(_seq()) for k in range(1, len(pattern)))]
    marked = rows.select("seq", "pos", *(o.alias(f"o{k}") for k, o in enumerate(ops)))
    hit = F.lit(True)
    for k, p in enumerate(pattern):
        hit = hit & (F.col(f"o{k}").startswith(p[:-1]) if p.endswith("*") else F.col(f"o{k}") == p) & F.col(f"o{k}").isNotNull()
    return marked.where(hit).select("seq", "pos")


@dataclass(frozen=True)
class Rule:
    """Constraints of one kind of gadget on a window's operations, all of which must hold.

    ``sequence``: (op, within) pairs, each found at the earliest place after the one before, within so many positions.
    ``near``: (op, op, reach) pairs, the second within ``reach`` after the first. ``counts``: least occurrences.
    ``absent``: operations that must not occur. ``longest``: most operations.
    """

    name: str
    sequence: tuple[tuple[str, int], ...] = ()
    near: tuple[tuple[str, str, int], ...] = ()
    counts: tuple[tuple[str, int], ...] = ()
    absent: tuple[str, ...] = ()
    longest: int | None = None


def _least(ops: Column, op: str, least: int) -> Column:
    return F.size(F.filter(ops, lambda x: x == op)) >= least


def _near(ops: Column, first: str, then: str, reach: int) -> Column:
    places = F.sequence(F.lit(0), F.size(ops) - 1)
    return F.exists(places, lambda i: (F.get(ops, i) == first) & F.array_contains(F.slice(ops, i + 2, F.lit(reach)), then))


def failure(rule: Rule, ops: Column) -> Column:
    """The first reason why a window's array of operations fails ``rule``, null where it matches: anti-pattern, sequence or length, nearness, counts."""
    no = F.lit(False)
    anti, count, near = no, no, no
    for op in rule.absent:
        anti = anti | F.array_contains(ops, op)
    for op, least in rule.counts:
        count = count | ~_least(ops, op, least)
    for first, then, reach in rule.near:
        near = near | ~_near(ops, first, then, reach)
    at = F.lit(0)  # one past the match so far; -1 once one is missing
    for op, reach in rule.sequence:
        found = F.array_position(F.slice(ops, F.greatest(at, F.lit(0)) + 1, F.lit(reach)), op).cast("int")
        at = F.when((at < 0) | (found == 0), F.lit(-1)).otherwise(at + found)
    long = F.size(ops) > rule.longest if rule.longest is not None else no
    return F.when(anti, F.lit("anti_pattern")).when((at < 0) | long, F.lit("sequence")).when(near, F.lit("near")).when(count, F.lit("count"))


def cut_windows(rows: DataFrame, size: int, step: int) -> DataFrame:
    """(seq, lo, ops): whole windows of ``size`` operations, every ``step`` positions."""
    own = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("pos") - (size - 1)) / step)), F.floor(F.col("pos") / step))  # empty between windows
    each = rows.where(F.col("pos") % step < size).select("seq", "pos", "op", F.explode(F.transform(own, lambda k: k * step)).alias("lo"))
    lists = each.groupBy("seq", "lo").agg(F.array_sort(F.collect_list(F.struct("pos", "op"))).alias("s")).where(F.size("s") == size)
    return lists.select("seq", "lo", F.transform("s", lambda x: x["op"]).alias("ops"))


RULES = (
    Rule("branch_then_load", near=((BRANCH, LOAD, 6),), absent=(FENCE,)),
    Rule("store_then_load", near=((STORE, LOAD, 5),), counts=((LOAD, 2),)),
    Rule("dependent_load", near=((LOAD, LOAD, 5),), sequence=((BRANCH, 5), (LOAD, 5), (RET, 5))),
    Rule("short", sequence=((LOAD, 10), (STORE, 10)), longest=9),
)


def matched(rows: DataFrame, rules: tuple[Rule, ...] = RULES, size: int = 10, step: int = 5) -> DataFrame:
    """(seq, lo, rule, reason): every window under every rule; reason is null where it matches."""
    windows = cut_windows(rows, size, step)
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), failure(r, F.col("ops")).alias("reason")) for r in rules))
    return windows.select("seq", "lo", F.explode(each).alias("m")).select("seq", "lo", "m.rule", "m.reason")


def hard_negatives(rows: DataFrame, rule: Rule = RULES[0], size: int = 12) -> DataFrame:
    """(seq, lo): windows that look like the rule's gadget, a branch with memory within 12 or two loads within 8, yet fail the rule."""
    ops = F.col("ops")
    like = _near(ops, BRANCH, LOAD, 12) | _near(ops, BRANCH, STORE, 12) | _near(ops, LOAD, LOAD, 8)
    return cut_windows(rows, size, size).where(like & failure(rule, ops).isNotNull()).select("seq", "lo")


def minimal_windows(rows: DataFrame, rule: Rule = RULES[1], size: int = 10, step: int = 5) -> DataFrame:
    """(seq, lo, left, right): for matching windows the greedy shortest part [left, right) that still matches, cut from the left first, then from the right."""
    found = cut_windows(rows, size, step).where(failure(rule, F.col("ops")).isNull())
    fits = lambda ops: failure(rule, ops).isNull()
    lefts = F.array(*(fits(F.slice("ops", i + 1, size - i)) for i in range(size)))
    gone = F.array_position(lefts, False).cast("int")
    found = found.withColumn("left", F.when(gone == 0, F.lit(size)).otherwise(gone - 1) - 1)
    rights = F.array(*(fits(F.slice("ops", F.col("left") + 1, F.greatest(F.lit(size - i) - F.col("left"), F.lit(0)))) for i in range(size)))
    gone = F.array_position(rights, False).cast("int")
    return found.select("seq", "lo", "left", (F.lit(size + 1) - F.when(gone == 0, F.lit(size)).otherwise(gone - 1)).alias("right"))


QUERIES = {
    "unfenced_count": lambda s, d: unfenced(instructions(s, d), F.col("op") == LOAD, F.col("op") == FENCE),
    "call_ret_distance": lambda s, d: mean_distance(instructions(s, d), F.col("op") == BRANCH, F.col("op") == RET),
    "pattern_contiguous": lambda s, d: contiguous(instructions(s, d), ["p*", "*", LOAD]),
    "compare_branch_load": lambda s, d: contiguous(instructions(s, d), [STORE, BRANCH, LOAD]),
    "dsl_matches": lambda s, d: matched(instructions(s, d)).where("reason IS NULL").select("seq", "lo", "rule"),
    "dsl_failure_summary": lambda s, d: matched(instructions(s, d)).where("reason IS NOT NULL").groupBy("rule", "reason").agg(F.count("*").alias("n")),
    "dsl_hard_negatives": lambda s, d: hard_negatives(instructions(s, d)),
    "minimal_window": lambda s, d: minimal_windows(instructions(s, d)),
}
_WIN = f"""WITH {EV}, w AS (SELECT a.seq, a.pos AS lo, list(b.op ORDER BY b.pos) AS ops FROM ev a JOIN ev b ON a.seq = b.seq AND b.pos BETWEEN a.pos AND a.pos + {{size}} - 1
  WHERE a.pos % {{step}} = 0 GROUP BY a.seq, a.pos HAVING count(*) = {{size}})"""
_NEAR = "len(list_filter(range(1, len(ops) + 1), lambda i: ops[i] = '{a}' AND list_contains(ops[i + 1:i + {r}], '{b}'))) > 0"
_N1, _N2, _N3 = _NEAR.format(a=BRANCH, b=LOAD, r=6), _NEAR.format(a=STORE, b=LOAD, r=5), _NEAR.format(a=LOAD, b=LOAD, r=5)
_REASONS = f"""{_WIN.format(size=10, step=5)}, p1 AS (SELECT *, coalesce(list_position(ops[1:5], '{BRANCH}'), 0) AS a FROM w),
  p2 AS (SELECT *, CASE WHEN a = 0 THEN 0 ELSE coalesce(list_position(ops[a + 1:a + 5], '{LOAD}'), 0) END AS b FROM p1),
  p3 AS (SELECT *, CASE WHEN b = 0 THEN 0 ELSE coalesce(list_position(ops[a + b + 1:a + b + 5], '{RET}'), 0) END AS c FROM p2),
  m AS (SELECT seq, lo, 'branch_then_load' AS rule, CASE WHEN list_contains(ops, '{FENCE}') THEN 'anti_pattern' WHEN NOT ({_N1}) THEN 'near' END AS reason FROM w
    UNION ALL SELECT seq, lo, 'store_then_load', CASE WHEN NOT ({_N2}) THEN 'near' WHEN len(list_filter(ops, lambda x: x = '{LOAD}')) < 2 THEN 'count' END FROM w
    UNION ALL SELECT seq, lo, 'dependent_load', CASE WHEN c = 0 THEN 'sequence' WHEN NOT ({_N3}) THEN 'near' END FROM p3 UNION ALL SELECT seq, lo, 'short', 'sequence' FROM w)"""
_LIKE = " OR ".join(_NEAR.format(a=a, b=b, r=r) for a, b, r in ((BRANCH, LOAD, 12), (BRANCH, STORE, 12), (LOAD, LOAD, 8)))
_PAIR = f"""EXISTS (SELECT 1 FROM x a JOIN x b ON a.seq = b.seq AND a.lo = b.lo AND b.i BETWEEN a.i + 1 AND a.i + 5 WHERE a.seq = s.seq AND a.lo = s.lo AND a.op = '{STORE}' AND b.op = '{LOAD}' AND a.i >= s.l AND b.i < s.r)
  AND (SELECT count(*) FROM x a WHERE a.seq = s.seq AND a.lo = s.lo AND a.op = '{LOAD}' AND a.i >= s.l AND a.i < s.r) >= 2"""
_L3 = "SELECT seq, pos, op, lead(op) OVER s AS o1, lead(op, 2) OVER s AS o2 FROM ev WINDOW s AS (PARTITION BY seq ORDER BY pos)"
ORACLES = {
    "unfenced_count": f"""WITH {EV}, t AS (SELECT seq, pos, op, (SELECT max(pos) FROM ev b WHERE b.seq = a.seq AND b.pos < a.pos AND b.op = '{LOAD}') AS lt,
      (SELECT max(pos) FROM ev b WHERE b.seq = a.seq AND b.pos < a.pos AND b.op = '{FENCE}') AS lf FROM ev a)
      SELECT seq, count(*) FILTER (op = '{LOAD}' AND (lf IS NULL OR lf < coalesce(lt, -1))) AS n FROM t GROUP BY seq""",
    "call_ret_distance": f"""WITH {EV}, r AS (SELECT seq, pos, coalesce(lag(pos) OVER (PARTITION BY seq ORDER BY pos), -1) AS prev FROM ev WHERE op = '{RET}'),
      d AS (SELECT r.seq, r.pos - max(c.pos) AS d FROM r JOIN ev c ON c.seq = r.seq AND c.op = '{BRANCH}' AND c.pos > r.prev AND c.pos < r.pos GROUP BY r.seq, r.pos)
      SELECT s.seq, round(coalesce(avg(d), -1), 6) AS distance FROM (SELECT DISTINCT seq FROM ev) s LEFT JOIN d ON d.seq = s.seq GROUP BY s.seq""",
    "pattern_contiguous": f"WITH {EV}, l AS ({_L3}) SELECT seq, pos FROM l WHERE op LIKE 'p%' AND o1 IS NOT NULL AND o2 = '{LOAD}'",
    "compare_branch_load": f"WITH {EV}, l AS ({_L3}) SELECT seq, pos FROM l WHERE op = '{STORE}' AND o1 = '{BRANCH}' AND o2 = '{LOAD}'",
    "dsl_matches": f"{_REASONS} SELECT seq, lo, rule FROM m WHERE reason IS NULL",
    "dsl_failure_summary": f"{_REASONS} SELECT rule, reason, count(*) AS n FROM m WHERE reason IS NOT NULL GROUP BY ALL",
    "dsl_hard_negatives": f"{_WIN.format(size=12, step=12)} SELECT seq, lo FROM w WHERE ({_LIKE}) AND (list_contains(ops, '{FENCE}') OR NOT ({_N1}))",
    "minimal_window": f"""{_WIN.format(size=10, step=5)}, x AS (SELECT seq, lo, unnest(ops) AS op, unnest(range(0, 10)) AS i FROM w),
      s AS (SELECT seq, lo, l, r FROM w, range(0, 10) a(l), range(1, 11) b(r) WHERE l < r), k AS (SELECT seq, lo, l, r FROM s WHERE {_PAIR}),
      f AS (SELECT seq, lo, max(l) AS l FROM k WHERE r = 10 GROUP BY ALL) SELECT seq, lo, l AS "left", min(k.r) AS "right" FROM f JOIN k USING (seq, lo, l) GROUP BY ALL""",
}
