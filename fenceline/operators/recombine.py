"""Recombination of windows of a class: two windows with a common block of lines exchange what comes before or after it.

Pairs come from an equi-join on runs of ``LEAST`` lines (any longer common block has one), within a class and an architecture. Of a pair
the longest common block is cut out, the earliest of equals; the exchange stands if both new windows have ``SHORTEST`` lines and a
branch, and need no register at their beginning that neither old window needed. All pairs of a class are quadratic in it,
so a class has a cap: its windows are taken in order, each with all later ones, until the exchanges made so far reach the
cap; what a window makes is never cut. Windows on the left side are taken in growing numbers (a rank limit a class), so with a cap the work grows
with the windows, not with their pairs. ``cap=None`` makes all exchanges.

A register is *free* in a window where it is used before it is defined: that is what the window needs at its beginning.

Defined results: null lines are empty ones; equal windows, and windows that lie whole in another, have nothing to exchange; windows of a null class are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fenceline.operators import alignment
from fenceline.plans.assembly_analog import WINDOWS, code_windows
from fenceline.plans.steps import settled

KEY = ("seq", "lo")
# Lines of a common block, lines of a new window, patterns of registers and of branches.
LEAST, SHORTEST = 3, 5
ARM_REGISTER, X86_REGISTER = r"\b([wx][0-9]{1,2})\b", r"(?i)\b(r(?:1[0-5]|[0-9])d?|e[abcd]x|[abcd]x|[sd]i|[sb]p)\b"
ARM_CONDITION, X86_CONDITION = r"(?i)\bb\.(eq|ne|hs|lo|mi|pl|vs|vc|hi|ls|ge|lt|gt|le)\b", r"(?i)\bj[a-z]{1,3}\b"
BRANCH_PARTS = ("jmp", "ret", "call", "bl", "blr")
CAP, FIRST = 60, 8


@lru_cache(maxsize=1 << 16)
def registers(line: str) -> tuple[frozenset[str], frozenset[str]]:
    """(defined, used) registers of a line: the first of several operands is defined, all others are used."""
    found = re.findall(ARM_REGISTER, line) or re.findall(X86_REGISTER, line)
    found = [r.lower() for r in found]
    parts = line.split(None, 1)
    if found and len(parts) > 1 and "," in parts[1]:
        return frozenset(found[:1]), frozenset(found[1:])
    return frozenset(), frozenset(found)


def free(lines: list[str]) -> set[str]:
    """The registers that are used before they are defined."""
    defined: set[str] = set()
    out: set[str] = set()
    for line in lines:
        defs, uses = registers(line)
        out |= uses - defined
        defined |= defs
    return out


def branches(lines: list[str], x86: bool) -> bool:
    pattern = X86_CONDITION if x86 else ARM_CONDITION
    return any(re.search(pattern, line) or any(p in line.lower() for p in BRANCH_PARTS) for line in lines)


def exchanges(a: list[str], b: list[str], x86: bool, size: int, i: int, j: int) -> Iterator[tuple[str, list[str], list[str]]]:
    """(tag, new a, new b) of two windows with a common block of ``size`` lines at ``i`` and ``j``."""
    if size < LEAST or size in (len(a), len(b)):
        return
    common, allowed = a[i : i + size], free(a) | free(b)
    ends = {"cross_swap_suffix": (a[i + size :], b[j + size :]), "cross_swap_prefix": (a[:i], b[:j])}
    for tag, (own, other) in ends.items():
        if not own or not other:
            continue
        new = (a[:i] + common + other, b[:j] + common + own) if tag == "cross_swap_suffix" else (other + common + a[i + size :], own + common + b[j + size :])
        if new == (a, b) or min(map(len, new)) < SHORTEST or not all(branches(x, x86) for x in new) or not all(free(x) <= allowed for x in new):
            continue
        yield tag, *new


def line_lists(lines: DataFrame, classes: int = 3) -> DataFrame:
    """(kind, arch, seq, lo, lines): each window's lines, with a class, here the listing's number modulo ``classes``."""
    rows = lines.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("line", F.lit("")).alias("line")))), lambda s: s["line"]).alias("lines"))
    return rows.select((F.col("seq") % classes).alias("kind"), (F.col("seq") % 2).alias("arch"), *KEY, "lines")


def _grams(least: int):
    places = F.sequence(F.lit(1), F.size("lines") - least + 1)
    return F.when(F.size("lines") >= least, F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice("lines", i, least), "\n")))))


def exchanged(pairs: DataFrame) -> DataFrame:
    """``pairs`` (kind, arch, seq_a, lo_a, a, seq_b, lo_b, b) with their exchanges: (kind, seq_a, lo_a, seq_b, lo_b, tag, new_a, new_b)."""
    schema = "kind long, seq_a long, lo_a long, seq_b long, lo_b long, tag string, new_a array<string>, new_b array<string>"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] + [pa.list_(pa.string())] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                x, y, _, _ = alignment.coded(part.column(6), part.column(7))
                sizes = alignment.longest_blocks(x, y)
                out = []
                for row, size, i, j in zip(part.to_pylist(), *(s.tolist() for s in sizes), strict=True):
                    key = (row["kind"], row["seq_a"], row["lo_a"], row["seq_b"], row["lo_b"])
                    out += [(*key, *found) for found in exchanges(row["a"], row["b"], row["arch"] == 1, size, i, j)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(len(names))], names=names)

    ids = (F.col(c).cast("long").alias(c) for c in ("kind", "arch", "seq_a", "lo_a", "seq_b", "lo_b"))
    return pairs.select(*ids, "a", "b").mapInArrow(run, schema)


def swapped(rows: DataFrame, cap: int | None = CAP, first: int = FIRST, least: int = LEAST) -> DataFrame:
    """(kind, seq_a, lo_a, seq_b, lo_b, tag, new_a, new_b): the exchanges of the classes of ``rows`` (see ``line_lists``), up to the cap."""
    order = Window.partitionBy("kind").orderBy(*KEY)
    rows = settled(rows.where("kind IS NOT NULL").withColumn("grams", _grams(least)))
    right = rows.select("kind", "arch", F.explode("grams").alias("gram"), F.col("seq").alias("seq_b"), F.col("lo").alias("lo_b"))
    lists = lambda k: rows.select("kind", F.col("seq").alias(f"seq_{k}"), F.col("lo").alias(f"lo_{k}"), F.col("lines").alias(k))
    largest = rows.groupBy("kind").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    taken = largest if cap is None else min(first, largest)
    while True:
        left = rows if taken >= largest else rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= taken).drop("nth")
        asks = left.select("kind", "arch", F.explode("grams").alias("gram"), F.col("seq").alias("seq_a"), F.col("lo").alias("lo_a"))
        later = (F.col("seq_a") < F.col("seq_b")) | ((F.col("seq_a") == F.col("seq_b")) & (F.col("lo_a") < F.col("lo_b")))
        pairs = asks.join(right, ["kind", "arch", "gram"]).where(later).select("kind", "arch", "seq_a", "lo_a", "seq_b", "lo_b").distinct()
        found = exchanged(pairs.join(lists("a"), ["kind", "seq_a", "lo_a"]).join(lists("b"), ["kind", "seq_b", "lo_b"]))
        if cap is None:
            return found
        found = settled(found)
        counts = found.groupBy("kind").agg(F.count("*").alias("made"))
        open_ = rows.groupBy("kind").agg(F.count("*").alias("n")).join(counts, "kind", "left").where((F.coalesce("made", F.lit(0)) < cap) & (F.col("n") > taken))
        if open_.isEmpty():
            break
        taken = min(4 * taken, largest)
    own = found.groupBy("kind", "seq_a", "lo_a").agg(F.count("*").alias("made"))  # of at most ``taken`` windows a class
    before = F.sum("made").over(Window.partitionBy("kind").orderBy("seq_a", "lo_a").rowsBetween(Window.unboundedPreceding, -1))
    within = own.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < cap).select("kind", "seq_a", "lo_a")
    return found.join(within, ["kind", "seq_a", "lo_a"], "left_semi")


def liveness(lines: DataFrame) -> DataFrame:
    """(seq, lo, reg, defs, uses, free): how many lines of a window define and use a register, and whether it is used before it is defined."""
    line = F.coalesce("line", F.lit(""))
    arm, x86 = (F.regexp_extract_all(line, F.lit(p), F.lit(1)) for p in (ARM_REGISTER, X86_REGISTER))
    regs = F.transform(F.when(F.size(arm) > 0, arm).otherwise(x86), F.lower)
    several = F.regexp_extract(line, r"^\s*\S+\s+(.*)$", 1).contains(",")
    rows = lines.select(*KEY, "i", regs.alias("regs"), several.alias("several"))
    defs = F.array_distinct(F.when(F.col("several"), F.slice("regs", 1, 1)).otherwise(F.array().cast("array<string>")))
    uses = F.array_distinct(F.when(F.col("several"), F.slice("regs", 2, F.greatest(F.size("regs"), F.lit(1)))).otherwise(F.col("regs")))
    each = rows.select(*KEY, "i", F.explode(F.concat(F.transform(defs, lambda r: F.struct(r.alias("reg"), F.lit(1).alias("d"))), F.transform(uses, lambda r: F.struct(r.alias("reg"), F.lit(0).alias("d"))))).alias("x"))
    is_def = F.col("x.d") == 1
    at = lambda test: F.min(F.when(test, F.col("i")))
    found = each.groupBy(*KEY, F.col("x.reg").alias("reg")).agg(F.sum(is_def.cast("int")).alias("defs"), F.sum((~is_def).cast("int")).alias("uses"), at(is_def).alias("first_def"), at(~is_def).alias("first_use"))
    needs = F.col("first_use").isNotNull() & (F.col("first_def").isNull() | (F.col("first_use") <= F.col("first_def")))
    return found.select(*KEY, "reg", "defs", "uses", needs.alias("free"))


def _swaps(s, d) -> DataFrame:
    found = swapped(line_lists(code_windows(s, d)))
    return found.select("kind", "seq_a", "lo_a", "seq_b", "lo_b", "tag", F.array_join("new_a", "\n").alias("new_a"), F.array_join("new_b", "\n").alias("new_b"))


QUERIES = {"cross_window_swaps": _swaps, "register_liveness": lambda s, d: liveness(code_windows(s, d))}
ORACLES = {
    "register_liveness": rf"""WITH {WINDOWS}, r AS (SELECT seq, lo, i, list_transform(CASE WHEN regexp_matches(line, '{ARM_REGISTER}') THEN regexp_extract_all(line, '{ARM_REGISTER}', 1) ELSE regexp_extract_all(line, '{X86_REGISTER}', 1) END, lambda x: lower(x)) AS regs,
        contains(regexp_extract(line, '^\s*\S+\s+(.*)$', 1), ',') AS several FROM aw),
      x AS (SELECT DISTINCT seq, lo, i, unnest(CASE WHEN several THEN regs[1:1] ELSE [] END) AS reg, 1 AS d FROM r UNION ALL SELECT DISTINCT seq, lo, i, unnest(CASE WHEN several THEN regs[2:] ELSE regs END), 0 FROM r)
      SELECT seq, lo, reg, count(*) FILTER (d = 1) AS defs, count(*) FILTER (d = 0) AS uses, coalesce(min(i) FILTER (d = 0) <= coalesce(min(i) FILTER (d = 1), 1000), false) AS free FROM x GROUP BY ALL""",
}
