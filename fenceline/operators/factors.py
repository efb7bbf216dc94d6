"""Registers and memory operands under canonical names, speculation and confidence factors, a short window vector, and feature maps merged by precedence.

Register numbers are first-seen numbers within a listing: a listing has some tens of names, so they are one small group after the
first aggregate, whatever the listing's length; numbers never depend on other listings. Windows are (seq, lo, i, line).

Defined results: null lines are empty ones; an operand without brackets or parentheses is MEM_COMPLEX; a window without
lines has no row; in a merge, a key that only one map has is kept, values of the later map win, and null maps are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.functions import nodes
from fenceline.operators import robust
from fenceline.plans.assembly_analog import CODE, WINDOWS, code, code_windows
from fenceline.plans.steps import settled

KEY = ("seq", "lo")
# Forms of memory operands in the order of their tests, and their names.
MEMORY_FORMS = ((r"\[([^+\-\]]+)\+([^+\-\]]+)\]", "MEM_BASE_OFFSET"), (r"\[([^+\-\]]+)\-([^+\-\]]+)\]", "MEM_BASE_NEG_OFFSET"), (r"\[([^+\-\]]+)\]", "MEM_BASE_ONLY"), (r"\(([^)]+)\)", "MEM_INDIRECT"))
BASE, OFFSET = r"\[([^+\-\]]+)", r"[+\-]\s*(\w+|\d+)"
# Full marks of a window's length and dependences, what branches and memory after a branch add, the share of memory that is high.
FULL_LENGTH, FULL_DEPENDENCES, CONDITIONAL_SCORE, AFTER_BRANCH_SCORE, HIGH_MEMORY = 20.0, 10.0, 0.5, 0.3, 0.3
VECTOR = ("is_branch", "accesses_memory", "is_comparison", "is_load", "is_store", "is_return", "is_indirect")


def first_seen(rows: DataFrame) -> DataFrame:
    """(seq, reg, name): each register of a listing as REG_n, n counted from 0 in the order of first mention."""
    each = rows.select("seq", "pos", F.posexplode(nodes.all_registers(F.coalesce("line", F.lit("")))).alias("k", "reg"))
    firsts = each.groupBy("seq", "reg").agg(F.min(F.struct("pos", "k")).alias("at"))
    number = F.row_number().over(Window.partitionBy("seq").orderBy("at")) - 1
    return firsts.select("seq", "reg", F.concat(F.lit("REG_"), number.cast("string")).alias("name"))


def memory_form(operand: Column) -> Column:
    """A memory operand by its form and the role or name of its base register."""
    tests = []
    for pattern, name in MEMORY_FORMS:
        tests.append(F.when(operand.rlike(pattern), F.concat(F.lit(name + "_"), nodes.register_role(F.regexp_extract(operand, pattern, 1)))))
    return F.coalesce(*tests, F.lit("MEM_COMPLEX"))


def memory_operands(rows: DataFrame) -> DataFrame:
    """(seq, pos, operand, form, numbered): memory operands of a listing by form, and as MEM_REG_n, with _OFFSET, n the first-seen number of the text before it."""
    line = F.coalesce("line", F.lit(""))
    # an operand is what is in brackets, or in parentheses with the offset before them
    every = F.regexp_extract_all(line, F.lit(r"(\[[^\]]*\]|-?[0-9]*\([^)]*\))"), F.lit(1))
    each = settled(rows.select("seq", "pos", F.posexplode(every).alias("k", "operand")).withColumn("base", F.trim(F.regexp_extract("operand", BASE, 1))))
    firsts = each.where("base <> ''").groupBy("seq", "base").agg(F.min(F.struct("pos", "k")).alias("at"))
    numbers = firsts.select("seq", "base", (F.row_number().over(Window.partitionBy("seq").orderBy("at")) - 1).alias("n"))
    named = F.when(F.col("n").isNull(), "MEM_COMPLEX").otherwise(F.concat(F.lit("MEM_REG_"), F.col("n").cast("string"), F.when(F.col("operand").rlike(OFFSET), "_OFFSET").otherwise("")))
    return each.join(numbers, ["seq", "base"], "left").select("seq", "pos", "k", "operand", memory_form(F.col("operand")).alias("form"), named.alias("numbered"))


def factors(lines: DataFrame) -> DataFrame:
    """(seq, lo, speculation_possible, speculation_score, indicators, <four factors>) of windows."""
    rows = settled(robust.marked(lines))
    f = lambda name: F.col(f"f.{name}")
    after = F.lead("f").over(Window.partitionBy(*KEY).orderBy("i"))
    rows = rows.withColumn("memory_next", F.coalesce(after["accesses_memory"], F.lit(False)))
    some = lambda test: F.max(test.cast("int")) == 1
    n = F.count("*")
    found = rows.groupBy(*KEY).agg(
        (some(f("is_branch")) & some(f("is_conditional"))).alias("possible"), some(f("is_branch") & F.col("memory_next")).alias("memory_after"), n.alias("n"), F.avg(f("is_branch").cast("int")).alias("control_flow_complexity"), F.avg(f("accesses_memory").cast("int")).alias("memory"),
        F.count_distinct(F.when(F.size("parts") >= 2, F.get("parts", F.lit(0)))).alias("targets"), *(some(f(k)).alias(k) for k in ("is_speculation_barrier", "is_timing_sensitive", "is_cache_operation")),
    )
    score = F.when(F.col("possible"), CONDITIONAL_SCORE).otherwise(0.0) + F.when(F.col("memory_after"), AFTER_BRANCH_SCORE).otherwise(0.0)
    named = (
        (F.col("possible"), "conditional_branches_present"), (F.col("memory_after"), "memory_access_after_branch"), (F.col("is_speculation_barrier"), "speculation_barriers_present"), (F.col("is_timing_sensitive"), "timing_operations_present"),
        (F.col("is_cache_operation"), "cache_operations_present"), (F.col("memory") > HIGH_MEMORY, "high_memory_access_density"),
    )
    indicators = F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in named)))
    return found.select(
        *KEY, F.col("possible").alias("speculation_possible"), score.alias("speculation_score"), indicators.alias("indicators"), F.least(F.col("n") / FULL_LENGTH, F.lit(1.0)).alias("instruction_complexity"), "control_flow_complexity",
        F.least(F.col("targets") / FULL_DEPENDENCES, F.lit(1.0)).alias("data_dependency_complexity"),
    )


def short_vectors(lines: DataFrame, width: int = robust.WIDTH) -> DataFrame:
    """(seq, lo, vector): length, distinct opcodes, seven shares, and zeros up to ``width``."""
    rows = settled(robust.marked(lines))
    shares = [F.avg(F.col(f"f.{k}").cast("int")) for k in VECTOR]
    values = [F.count("*").cast("double"), F.count_distinct("op").cast("double"), *shares]
    return rows.groupBy(*KEY).agg(F.array(*(values + [F.lit(0.0)] * (width - len(values)))[:width]).alias("vector"))


def merged(first: Column, last: Column) -> Column:
    """One map of two feature maps; of a key in both, the value of ``last`` counts."""
    none = F.create_map().cast("map<string,double>")
    a, b = F.coalesce(first, none), F.coalesce(last, none)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def merged_features(lines: DataFrame) -> DataFrame:
    """(seq, lo, features): a window's graph features as found before, under those of its sequence, as sorted ``name=value`` texts."""
    found = settled(robust.signatures(lines))
    pack = lambda names: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(c).cast("double") for c in names)))
    before = F.map_concat(pack(robust.GRAPH), F.create_map(F.lit("instruction_count"), F.lit(-1.0), F.lit("branch_patterns"), F.lit(-1.0)))
    both = merged(before, pack((*robust.STATISTICS, *robust.COUNTS)))
    texts = F.array_sort(F.transform(F.map_entries(both), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 5).cast("string"))))
    return found.select(*KEY, F.array_join(texts, ";").alias("features"))


QUERIES = {
    "first_seen_registers": lambda s, d: first_seen(code(s, d)),
    "memory_operands": lambda s, d: memory_operands(code(s, d)),
    "speculation_factors": lambda s, d: factors(code_windows(s, d)).withColumns({"indicators": F.array_join("indicators", ","), **{c: F.round(c, 6) for c in ("speculation_score", "instruction_complexity", "control_flow_complexity", "data_dependency_complexity")}}),
    "short_vectors": lambda s, d: short_vectors(code_windows(s, d)).select(*KEY, F.array_join(F.transform("vector", lambda x: F.round(x, 5).cast("string")), ",").alias("vector")),
    "merged_features": lambda s, d: merged_features(code_windows(s, d)),
}


def _flags() -> str:
    """``mk``: windows' lines with opcode, operands and flags."""
    from fenceline.operators.listings import _OP, _PARTS, _REST, _semantics_sql

    return rf"WITH {WINDOWS}, pt AS (SELECT seq, lo, i, {_OP} AS op, {_REST} AS rest, {_PARTS} AS parts FROM aw), mk AS (SELECT *, {_semantics_sql()} AS flags FROM pt)"


def _f(name: str) -> str:
    return f"(flags[{nodes.SEMANTICS.index(name) + 1}] = '1')"


def _role_sql(value: str) -> str:
    name = f"regexp_replace(lower({value}), '^[%$]+', '')"
    return "CASE " + " ".join(f"WHEN {name} IN {names} THEN '{role}'" for role, names in nodes.REGISTER_ROLES) + f" ELSE 'REG_' || upper({name}) END"


def _registers_sql() -> str:
    from fenceline.functions import fixed

    return f"list_concat(regexp_extract_all(lower(line), '{fixed.NODE_PATTERNS['arm_reg']}', 1), regexp_extract_all(lower(line), '{fixed.NODE_PATTERNS['x86_reg']}', 1))"


def _memory_sql() -> str:
    forms = " ".join(f"WHEN regexp_matches(operand, '{p}') THEN '{name}_' || {_role_sql(f'''regexp_extract(operand, '{p}', 1)''')}" for p, name in MEMORY_FORMS)
    return rf"""WITH {CODE}, l AS (SELECT seq, pos, regexp_extract_all(line, '(\[[^\]]*\]|-?[0-9]*\([^)]*\))', 1) AS os FROM co), o AS (SELECT seq, pos, unnest(os) AS operand, unnest(range(0, len(os)))::INT AS k FROM l),
      b AS (SELECT *, trim(regexp_extract(operand, '{BASE}', 1)) AS base FROM o), f AS (SELECT seq, base, min(pos * 1000 + k) AS fa FROM b WHERE base <> '' GROUP BY ALL), n AS (SELECT seq, base, row_number() OVER (PARTITION BY seq ORDER BY fa) - 1 AS n FROM f)
      SELECT b.seq, pos, k, operand, CASE {forms} ELSE 'MEM_COMPLEX' END AS form, CASE WHEN n IS NULL THEN 'MEM_COMPLEX' ELSE 'MEM_REG_' || n || CASE WHEN regexp_matches(operand, '{OFFSET}') THEN '_OFFSET' ELSE '' END END AS numbered FROM b LEFT JOIN n ON n.seq = b.seq AND n.base = b.base"""


ORACLES = {
    "first_seen_registers": f"""WITH {CODE}, l AS (SELECT seq, pos, {_registers_sql()} AS rs FROM co), r AS (SELECT seq, pos, unnest(rs) AS reg, unnest(range(0, len(rs))) AS k FROM l), f AS (SELECT seq, reg, min(pos * 1000 + k) AS fa FROM r GROUP BY ALL)
      SELECT seq, reg, 'REG_' || (row_number() OVER (PARTITION BY seq ORDER BY fa) - 1) AS name FROM f""",
    "memory_operands": _memory_sql(),
    "speculation_factors": f"""{_flags()}, g AS (SELECT a.*, coalesce((SELECT {_f('accesses_memory').replace('flags', 'b.flags')} FROM mk b WHERE b.seq = a.seq AND b.lo = a.lo AND b.i = a.i + 1), false) AS mn FROM mk a),
      h AS (SELECT seq, lo, bool_or({_f('is_branch')}) AND bool_or({_f('is_conditional')}) AS p, bool_or({_f('is_branch')} AND mn) AS m, count(*) AS n, avg({_f('is_branch')}::INT) AS c, avg({_f('accesses_memory')}::INT) AS mem, count(DISTINCT parts[1]) FILTER (len(parts) >= 2) AS t,
        bool_or({_f('is_speculation_barrier')}) AS sb, bool_or({_f('is_timing_sensitive')}) AS ti, bool_or({_f('is_cache_operation')}) AS ca FROM g GROUP BY seq, lo)
      SELECT seq, lo, p AS speculation_possible, round(CASE WHEN p THEN 0.5 ELSE 0 END + CASE WHEN m THEN 0.3 ELSE 0 END, 6)::DOUBLE AS speculation_score,
        array_to_string(list_filter([CASE WHEN p THEN 'conditional_branches_present' END, CASE WHEN m THEN 'memory_access_after_branch' END, CASE WHEN sb THEN 'speculation_barriers_present' END, CASE WHEN ti THEN 'timing_operations_present' END, CASE WHEN ca THEN 'cache_operations_present' END,
          CASE WHEN mem > 0.3 THEN 'high_memory_access_density' END], lambda x: x IS NOT NULL), ',') AS indicators, round(least(n / 20, 1), 6) AS instruction_complexity, round(c, 6) AS control_flow_complexity, round(least(t / 10, 1), 6) AS data_dependency_complexity FROM h""",
    "short_vectors": f"""{_flags()}, h AS (SELECT seq, lo, [count(*)::DOUBLE, count(DISTINCT op)::DOUBLE, {", ".join(f"avg({_f(k)}::INT)" for k in VECTOR)}] AS v FROM mk GROUP BY seq, lo)
      SELECT seq, lo, array_to_string(list_transform(list_concat(v, list_transform(range(0, 55), lambda x: 0::DOUBLE)), lambda x: round(x, 5)::VARCHAR), ',') AS vector FROM h""",
}
