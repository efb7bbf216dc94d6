"""Features of windows of assembly lines: class patterns and their scores, dependencies, memory, graph and structure.

Every input is (seq, lo, i, line): line ``i`` of the window that begins at ``lo`` of ``seq``. Look-ahead rules are
window frames within a window, and the text rules see its lines joined by newlines; a window has some tens of lines,
so a window's rows are a small group whatever the length of its listing. A null line counts as an empty one; windows
without lines do not occur; repeated rows are repeated lines. Nothing runs in Python.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.functions import fixed
from fenceline.functions.instructions import opcode
from fenceline.plans.assembly_analog import WINDOWS, code_windows

KEY = ("seq", "lo")
_INDIRECT = r"^(br|blr)(\s|$)|^(jmp|call)\s+.*\*"


def _frame(lo: int | None = None, hi: int | None = None):
    own = Window.partitionBy(*KEY).orderBy("i")
    return own if lo is None and hi is None else own.rowsBetween(lo, hi)


def _before():
    return Window.partitionBy(*KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)


def _is(name: str, column: str = "line") -> Column:
    return F.col(column).rlike("(?i)" + fixed.LINE_PATTERNS[name])


def _count(name: str) -> Column:
    return F.regexp_count("line", F.lit("(?i)" + fixed.LINE_PATTERNS[name]))


def _any(flag: Column) -> Column:
    return F.max(flag.cast("int"))


def _soon(first: Column, then: Column, k: int) -> Column:
    """On the lines of ``first``: whether one of the next ``k`` is ``then``."""
    return first & (F.coalesce(F.max(then.cast("int")).over(_frame(1, k)), F.lit(0)) == 1)


def marked(lines: DataFrame) -> DataFrame:
    """``lines`` with the opcode and the flags that rules over neighbouring lines need."""
    rows = lines.select(*KEY, "i", F.coalesce("line", F.lit("")).alias("line"))
    rows = rows.withColumn("op", opcode(F.col("line")))
    op, line = F.col("op"), F.lower("line")
    bcc = op.startswith("b.") | (op.startswith("j") & (op != "jmp"))
    rows = rows.select(
        "*", *(_is(k).alias(k) for k in ("load", "store", "flush", "fence", "timing", "clear", "shift", "ret", "call", "indirect_call", "target_setup", "result")),
        line.contains("mov").alias("mov"), F.trim(line).rlike(_INDIRECT).alias("indirect"), bcc.alias("bcc"), (bcc | op.startswith("cb")).alias("cond"), (op.startswith("b") | op.startswith("j")).alias("branch"),
    )
    place = lambda c: F.max(F.when(c, F.col("i"))).over(_before())
    flush, fence, timing = F.col("flush"), F.col("fence"), F.col("timing")
    return rows.select(
        "*", _soon(F.col("clear"), F.col("load") | F.col("mov"), 4).alias("clear_load"), _soon(F.col("shift"), F.col("load"), 3).alias("shift_load"), _soon(F.col("bcc"), F.col("load"), 5).alias("branch_load"),
        _soon(flush, F.col("load"), 7).alias("flush_load"), _soon(F.col("call"), F.col("result"), 3).alias("call_use"), _soon(F.col("call"), F.col("ret"), 4).alias("call_ret"),
        _soon(F.col("indirect"), F.col("load") | F.col("store"), 5).alias("indirect_access"), _soon(F.col("indirect"), F.col("store"), 3).alias("indirect_store"),
        (F.col("indirect_call") & (F.coalesce(F.max(F.col("target_setup").cast("int")).over(_frame(-4, -1)), F.lit(0)) == 1)).alias("target_set"),
        (F.col("load") & ~flush & ~fence & (place(fence & ~flush) > place(flush))).alias("flush_fence_load"), (F.col("load") & ~flush & ~timing & (place(timing & ~flush) > place(flush))).alias("flush_time_load"),
        F.coalesce(F.max(timing.cast("int")).over(_frame(1, 5)), F.lit(0)).alias("time_after"),
    )


# The patterns whose dots cross lines, as chains of parts that only have to follow each other, any of the chains of a name.
# Backtracking over a window costs a power of its length, one for each dot; a part's first end after the one before costs a pass.
_MEMORY = (("ldr",), ("mov", r"\["))
_CHAINS = {
    "mds_probe": (("eor|xor", r"\n", "ldrb|movb|movzbl", r"\n", "lsl|shl|sal", r"\n", "ldr|mov"),),
    "fill_buffer": tuple((r"clflush|dc\s+civac", r"\n", "mfence|dsb", r"\n", *m) for m in _MEMORY),
    "line_fill": (("clflush", r"\n", "mov|ldr", r"\[", r"\]"),),
    "store_buffer": tuple((*a, r"\n", *b) for a in (("str",), ("mov", ",", r"\[")) for b in (("ldr",), ("mov", r"\[", r"\],"))),
    "bounds_cmp": ((r"(?:cmp|test)\s", r"[$#][0-9]", r"\n", r"jae|jb|ja|b\.hs|b\.lo|b\.hi|b\.ls"),),
    "index_mask": tuple((r"(?:and|bic)\s", r"\n", *m) for m in _MEMORY),
    "dsb_isb": (("dsb", r"\n", "isb"),),
    "terminal_fault": tuple(("mov|lea|adrp", r"\n", *m) for m in _MEMORY),
    "cache_timing": tuple((r"clflush|dc\s+civac", r"\n", "lfence|mfence|dsb|dmb", r"\n", *t) for t in (("rdtsc",), (r"mrs", "cntvct"))),
    "rsb_flush": ((r"(?:callq?|bl)\s+\S+\s*?\n", r"retq?\s*?\n", "call|bl"),),
    "return_control": (("mov|str", r"\[", "sp", r"\]", r"\n", "ret"),),
}


def text_pattern(name: str) -> str:
    """A pattern that finds what ``fixed.TEXT_PATTERNS[name]`` finds, in time linear in the text where that is one of the chains."""
    if name not in _CHAINS:
        return fixed.TEXT_PATTERNS[name]
    return r"(?is)\A(?:" + "|".join("".join(f"(?>.*?(?:{part}))" for part in chain) for chain in _CHAINS[name]) + ")"


def _text(name: str) -> Column:
    return F.col("text").rlike(text_pattern(name)).cast("int")


def _score(weights: dict[str, float]) -> Column:
    return reduce(add, (F.col(k) * F.lit(v) for k, v in weights.items()))


def _when(flag: Column, weight: float) -> Column:
    return F.when(flag, F.lit(weight)).otherwise(F.lit(0.0))


def _at_most_one(score: Column) -> Column:
    return F.round(F.least(F.lit(1.0), score), 6)


def profiles(lines: DataFrame) -> DataFrame:
    """One row a window with every class-pattern feature; what a query does not select is never computed."""
    rows = marked(lines)
    c = F.col
    first_load = F.min(F.when(c("load"), F.struct("i", "time_after"))).over(_frame(1, 5))
    run = F.sum((~c("call")).cast("int")).over(_frame(Window.unboundedPreceding, 0))  # calls in one run share it
    chain = F.coalesce(F.sum(c("ret").cast("int")).over(_frame(Window.unboundedPreceding, 0)), F.lit(0))
    rows = rows.withColumn("around", c("timing") & (F.coalesce(first_load["time_after"], F.lit(0)) == 1)).withColumn("run", run).withColumn("part", chain)
    rows = rows.withColumn("in_run", F.sum(c("call").cast("int")).over(Window.partitionBy(*KEY, "run"))).withColumn("in_chain", F.sum((c("call")).cast("int")).over(Window.partitionBy(*KEY, "part")))
    target = F.when(c("call") & c("line").rlike(r"\S\s+\S"), F.regexp_extract("line", r"(\S+)\s*$", 1))
    rows = rows.withColumn("target", target)
    rows = rows.withColumn("same_target", F.when(c("target").isNotNull(), F.count("*").over(Window.partitionBy(*KEY, "target")))).withColumn("same_op", F.when(c("branch"), F.count("*").over(Window.partitionBy(*KEY, "op"))))
    n = lambda flag: F.sum(flag.cast("int"))
    letters = c("line").rlike(r"\s\S*[A-Za-z]\S*\s*$")
    got = rows.groupBy(*KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: F.lower(s["line"])), "\n").alias("text"),
        F.sum(_count("flush")).alias("cache_flush_count"), F.sum(_count("fence")).alias("fence_count"), F.sum(_count("ret")).alias("ret_count"), F.sum(_count("call")).alias("call_count"),
        F.sum(_count("push")).alias("pushes"), F.sum(_count("pop")).alias("pops"), F.count("*").alias("n"),
        _any(c("timing")).alias("has_timing"), _any(c("clear_load")).alias("has_clear_before_load"), _any(c("shift_load")).alias("has_shift_then_load"), _any(c("flush_fence_load")).alias("has_flush_fence_load"),
        _any(c("branch_load")).alias("has_cond_branch_then_load"), n(c("indirect")).alias("indirect_branch_count"), n(c("branch")).alias("branches"), n(c("cond")).alias("conds"),
        F.size(F.collect_set(F.when(c("branch") | c("op").startswith("cb"), F.substring("op", 1, 3)))).alias("bhi_branch_diversity"), F.coalesce(F.max("same_op"), F.lit(0)).alias("same_op"),
        _any(c("flush_time_load")).alias("l1tf_has_flush_reload"), _any(c("flush_load")).alias("l1tf_flush_then_access"), _any(c("around")).alias("l1tf_has_timing_around_load"), _any(c("load")).alias("has_load"),
        n(c("op").isin(*fixed.BENIGN_ARITHMETIC)).alias("ariths"), n((c("op") != "") & ~c("op").endswith(":")).alias("ops"), _any((c("op").startswith("b.") | c("op").startswith("cb")) & letters).alias("benign_loop_pattern"),
        _any(c("call_use")).alias("benign_function_call_pattern"), F.coalesce(F.max("same_target"), F.lit(0)).alias("same_target"), F.max("in_run").alias("longest_calls"), n(c("call_ret")).alias("call_rets"),
        F.max("in_chain").alias("retbleed_call_chain_depth"), _any(c("indirect_access")).alias("inception_phantom_window"), _any(c("target_set")).alias("inception_call_target_mismatch"), _any(c("indirect_store")).alias("inception_speculative_store"),
    )
    one = lambda flag: flag.cast("int")
    got = got.select(
        "*", one(c("cache_flush_count") > 0).alias("has_cache_flush"), one(c("fence_count") > 0).alias("has_fence"), _text("mds_probe").alias("has_mds_probe_pattern"), _text("verw").alias("mds_has_verw"),
        _text("fill_buffer").alias("mds_fill_buffer_probe"), _text("line_fill").alias("mds_line_fill_buffer"), _text("zombieload").alias("mds_explicit_zombieload"), _text("store_buffer").alias("mds_store_buffer_probe"),
        (1 - _text("compare_branch")).alias("mds_no_bounds_check"), _text("bounds_check").alias("has_bounds_check"), _text("lfence").alias("spectre_v1_lfence_guarded"), _text("bounds_cmp").alias("spectre_v1_bounds_cmp_pattern"),
        F.greatest(_text("array_load"), _text("x86_array_load")).alias("spectre_v1_array_index_load"), _text("index_mask").alias("spectre_v1_index_masking"),
        one(c("indirect_branch_count") >= 2).alias("has_multiple_indirect_branches"), one((c("branches") >= 3) & (c("indirect_branch_count") >= 1)).alias("has_branch_training_loop"), one(c("conds") >= 4).alias("bhi_history_training_loop"),
        one((c("conds") >= 2) & (c("indirect_branch_count") >= 1)).alias("bhi_mixed_branch_types"), _text("cntvct").alias("bhi_explicit_cntvct_timing"), one(c("same_op") >= 3).alias("bhi_repeated_branch_pattern"), _text("dsb_isb").alias("bhi_has_dsb_isb"),
        _text("tlb").alias("l1tf_has_tlb_invalidation"), _text("pte").alias("l1tf_has_pte_manipulation"), _text("fault").alias("l1tf_has_fault_trigger"), _text("cache_timing").alias("l1tf_cache_timing_pattern"), _text("lfence_full").alias("full_fence"),
        one((c("conds") <= 2) & (c("indirect_branch_count") == 0)).alias("simple"), (_text("stack_frame") * _text("epilogue")).alias("benign_stack_frame_pattern"), one((c("pushes") > 0) & (F.abs(c("pushes") - c("pops")) <= 1)).alias("benign_balanced_push_pop"),
        (1 - c("has_timing")).alias("benign_no_timing_ops"), one(c("indirect_branch_count") == 0).alias("benign_no_indirect_branch"), one((c("ops") > 0) & (c("ariths") > 0.6 * c("ops"))).alias("benign_pure_arithmetic"),
        _text("leave_ret").alias("has_leave_ret_pattern"), one(c("same_target") > 1).alias("has_recursive_call_hint"), one(c("longest_calls") >= 2).alias("has_deep_call_pattern"), F.abs(c("pushes") - c("pops")).alias("push_pop_imbalance"),
        one(((c("ret_count") > c("call_count")) & (c("ret_count") >= 2)) | (c("call_rets") >= 2)).alias("has_rsb_manipulation"), F.round(F.when(c("ret_count") > 0, c("call_count") / c("ret_count")).otherwise(F.lit(0.0)), 6).alias("call_ret_ratio"),
        one(c("ret_count") > c("call_count")).alias("retbleed_unbalanced_ret"), _text("rsb_flush").alias("retbleed_rsb_flush_pattern"), one((c("call_count") >= 3) & (c("ret_count") >= 1)).alias("retbleed_ret_after_many_calls"),
        _text("return_control").alias("inception_return_target_control"), _text("inline_asm").alias("inception_has_inline_asm"),
    )
    got = got.select(
        "*", one((c("has_bounds_check") == 1) & (c("spectre_v1_lfence_guarded") == 0)).alias("spectre_v1_speculation_barrier_missing"), one((c("has_load") == 1) & (c("full_fence") == 0)).alias("l1tf_no_fence_before_load"),
        (_text("terminal_fault") * c("l1tf_has_fault_trigger")).alias("l1tf_terminal_fault_setup"), (c("l1tf_flush_then_access") * c("mds_no_bounds_check")).alias("l1tf_unmapped_access_pattern"),
        one((c("l1tf_has_timing_around_load") == 1) & (c("full_fence") == 0)).alias("l1tf_speculative_window_no_guard"), c("simple").alias("benign_simple_control_flow"), (1 - c("has_cache_flush")).alias("benign_no_cache_ops"),
        c("benign_no_indirect_branch").alias("retbleed_no_indirect_branch"), c("indirect_branch_count").alias("inception_indirect_branch_count"), c("has_multiple_indirect_branches").alias("inception_btb_pollution"),
    )
    ind, ret = c("indirect_branch_count"), c("ret_count")
    bhi = (
        _when(ind >= 2, 0.3) + c("has_branch_training_loop") * 0.2 + _when(ind >= 3, 0.1) + c("bhi_history_training_loop") * 0.2 + c("bhi_mixed_branch_types") * 0.15 + c("bhi_explicit_cntvct_timing") * 0.2
        + _when(c("bhi_branch_diversity") >= 3, 0.1) + c("bhi_repeated_branch_pattern") * 0.15 + c("bhi_has_dsb_isb") * 0.1
    )
    retbleed = (
        F.when(ret >= 2, F.lit(0.25)).when(ret >= 1, F.lit(0.1)).otherwise(F.lit(0.0)) + c("has_leave_ret_pattern") * 0.2 + c("has_recursive_call_hint") * 0.2 + c("has_deep_call_pattern") * 0.15 + c("has_rsb_manipulation") * 0.25
        + _when(c("push_pop_imbalance") >= 2, 0.1) + c("retbleed_ret_after_many_calls") * 0.15 + _when(c("retbleed_call_chain_depth") >= 3, 0.15) + c("retbleed_unbalanced_ret") * 0.1 + c("retbleed_rsb_flush_pattern") * 0.15
        + _when((c("retbleed_no_indirect_branch") == 1) & (ret >= 1), 0.1)
    )
    inception = (
        F.when(ind >= 2, F.lit(0.3)).when(ind >= 1, F.lit(0.15)).otherwise(F.lit(0.0)) + c("inception_btb_pollution") * 0.2 + c("inception_phantom_window") * 0.25 + c("inception_call_target_mismatch") * 0.15
        + c("inception_return_target_control") * 0.2 + c("inception_speculative_store") * 0.15 + c("inception_has_inline_asm") * 0.1
    )
    benign = _score(fixed.SCORES["benign"]) - c("has_cache_flush") * 0.3 - c("has_timing") * 0.25
    return got.select(
        "*", _at_most_one(_score(fixed.SCORES["mds"]) + _when((c("mds_no_bounds_check") == 1) & (c("has_cache_flush") == 1), 0.1)).alias("mds_gadget_score"), _at_most_one(_score(fixed.SCORES["v1"])).alias("spectre_v1_score"),
        _at_most_one(bhi).alias("bhi_score"), _at_most_one(_score(fixed.SCORES["l1tf"])).alias("l1tf_score"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), benign)), 6).alias("benign_score"),
        _at_most_one(retbleed).alias("retbleed_score"), _at_most_one(inception).alias("inception_score"),
    )


FAMILIES = {
    "mds_features": "has_cache_flush has_fence has_timing has_clear_before_load has_shift_then_load has_flush_fence_load has_mds_probe_pattern cache_flush_count fence_count mds_gadget_score mds_has_verw mds_fill_buffer_probe mds_line_fill_buffer mds_explicit_zombieload mds_store_buffer_probe mds_no_bounds_check",
    "spectre_v1_features": "has_bounds_check has_cond_branch_then_load spectre_v1_score spectre_v1_lfence_guarded spectre_v1_bounds_cmp_pattern spectre_v1_array_index_load spectre_v1_index_masking spectre_v1_speculation_barrier_missing",
    "bhi_features": "has_multiple_indirect_branches has_branch_training_loop indirect_branch_count bhi_score bhi_history_training_loop bhi_mixed_branch_types bhi_explicit_cntvct_timing bhi_branch_diversity bhi_repeated_branch_pattern bhi_has_dsb_isb",
    "l1tf_features": "l1tf_has_flush_reload l1tf_has_tlb_invalidation l1tf_has_pte_manipulation l1tf_has_fault_trigger l1tf_has_timing_around_load l1tf_flush_then_access l1tf_cache_timing_pattern l1tf_score l1tf_no_fence_before_load l1tf_terminal_fault_setup l1tf_unmapped_access_pattern l1tf_speculative_window_no_guard",
    "benign_features": "benign_simple_control_flow benign_stack_frame_pattern benign_balanced_push_pop benign_no_timing_ops benign_no_cache_ops benign_no_indirect_branch benign_pure_arithmetic benign_loop_pattern benign_function_call_pattern benign_score",
    "retbleed_features": "ret_count call_count has_leave_ret_pattern has_recursive_call_hint has_deep_call_pattern has_rsb_manipulation call_ret_ratio push_pop_imbalance retbleed_score retbleed_call_chain_depth retbleed_unbalanced_ret retbleed_rsb_flush_pattern retbleed_ret_after_many_calls retbleed_no_indirect_branch",
    "inception_features": "inception_indirect_branch_count inception_btb_pollution inception_phantom_window inception_call_target_mismatch inception_return_target_control inception_speculative_store inception_has_inline_asm inception_score",
}
# The weights of the signals of pairs of classes that are easily confused; a pair's score is the first sum less the second.
PAIRS = {
    "l1tf_vs_spectre_v1": (
        {"l1tf_no_fence_before_load": 2.0, "l1tf_terminal_fault_setup": 1.5, "l1tf_unmapped_access_pattern": 1.5, "l1tf_has_tlb_invalidation": 2.0, "l1tf_has_pte_manipulation": 1.5},
        {"spectre_v1_lfence_guarded": 2.0, "spectre_v1_bounds_cmp_pattern": 2.0, "spectre_v1_array_index_load": 1.5, "spectre_v1_index_masking": 1.0, "has_bounds_check": 1.5},
    ),
    "retbleed_vs_inception": (
        {"retbleed_unbalanced_ret": 2.0, "retbleed_rsb_flush_pattern": 2.0, "retbleed_call_chain_depth": 0.5, "retbleed_no_indirect_branch": 1.5, "has_leave_ret_pattern": 1.5, "ret_count": 0.3},
        {"inception_indirect_branch_count": 1.0, "inception_btb_pollution": 2.0, "inception_phantom_window": 2.0, "inception_call_target_mismatch": 1.5, "inception_return_target_control": 1.5},
    ),
    "spectre_v1_vs_mds": (
        {"has_bounds_check": 2.0, "spectre_v1_bounds_cmp_pattern": 2.0, "spectre_v1_array_index_load": 1.5, "spectre_v1_index_masking": 1.5},
        {"mds_has_verw": 3.0, "mds_fill_buffer_probe": 2.0, "mds_explicit_zombieload": 3.0, "mds_line_fill_buffer": 1.5, "mds_store_buffer_probe": 1.5, "has_mds_probe_pattern": 2.0},
    ),
    "inception_vs_bhi": (
        {"inception_indirect_branch_count": 0.5, "inception_phantom_window": 2.0, "inception_speculative_store": 1.5, "inception_return_target_control": 2.0},
        {"bhi_history_training_loop": 2.0, "bhi_mixed_branch_types": 2.0, "bhi_explicit_cntvct_timing": 3.0, "bhi_repeated_branch_pattern": 1.5, "bhi_has_dsb_isb": 1.5, "bhi_branch_diversity": 0.3},
    ),
}


def exclusion(found: DataFrame) -> DataFrame:
    """(seq, lo, <pair>_score, <pair>_norm): signed scores of confusable pairs, and 1 / (1 + exp(-x / 3)) of each."""
    out = found.select(*KEY, *(F.round(_score(a) - _score(b), 6).alias(f"{k}_score") for k, (a, b) in PAIRS.items()))
    return out.select("*", *(F.round(sigmoid(F.col(f"{k}_score")), 6).alias(f"{k}_norm") for k in PAIRS))


def sigmoid(x: Column, scale: float = 3.0) -> Column:
    return 1 / (1 + F.exp(-x / scale))


def entropies(rows: DataFrame, item: str, name: str) -> DataFrame:
    """(seq, lo, ``name``): bits of the distribution of ``item`` within a window."""
    counts = rows.groupBy(*KEY, item).agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy(*KEY))
    return counts.withColumn("p", F.col("c") / total).groupBy(*KEY).agg(F.round(-F.sum(F.col("p") * F.log2("p")) + 0.0, 6).alias(name))


def structural(lines: DataFrame) -> DataFrame:
    """The structural features of a window: counts, densities, entropies, flags, register reuse, segments between branches."""
    c = F.col
    rows = lines.select(*KEY, "i", F.coalesce("line", F.lit("")).alias("line")).withColumn("op", opcode(c("line")))
    rest = F.regexp_extract("line", r"^\s*\S+\s+(.*)$", 1)
    rows = rows.withColumn("operands", F.when(rest == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(rest, ","), lambda x: F.trim(x))))
    regs = F.concat(*(F.regexp_extract_all("line", F.lit("(?i)" + fixed.LINE_PATTERNS[k]), F.lit(1)) for k in ("reg_arm", "reg_x86")))
    rows = rows.withColumn("regs", F.transform(regs, lambda r: F.regexp_replace(F.lower(r), "^%+", "")))
    op, mem = c("op"), c("line").contains("[") & c("line").contains("]")
    cond = op.rlike("(?i)" + fixed.CONDITIONAL_OPCODE)
    rows = rows.select("*", cond.alias("cond"), (cond | op.isin(*fixed.BRANCHES)).alias("branch"), mem.alias("mem"), (op.startswith("ldr") | ((op == "mov") & c("line").contains("["))).alias("ld"))
    own = Window.partitionBy(*KEY).orderBy("i")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda flag: F.max(F.when(flag, c("i"))).over(before)
    rows = rows.select(
        "*", (c("ld") & (c("i") - last(c("ld")) <= 5)).alias("dep"), _soon(c("branch"), c("mem"), 5).alias("after"),
        F.when(c("branch"), c("i") - F.coalesce(last(c("branch")), F.lit(0))).alias("gap"), F.when(c("branch"), c("i")).alias("branch_at"),
    )
    n = lambda flag: F.sum(flag.cast("int"))
    flag = lambda what, name: F.coalesce(_any(what), F.lit(0)).alias(name)
    low = F.lower("line")
    got = rows.groupBy(*KEY).agg(
        F.count("*").alias("num_instructions"), F.countDistinct("op").alias("unique_opcodes"), F.sum(F.size("operands")).alias("operand_total"), F.max(F.size("operands")).alias("max_operand_count"),
        n(op.isin(*fixed.ARITHMETIC)).alias("arithmetic_count"), n(c("mem")).alias("memory_access_count"), n(c("branch")).alias("branch_count"), n(c("cond")).alias("conds"), flag(op.isin("ret", "retq"), "has_return_instruction"),
        flag(op.isin("rdtsc", "rdtscp") | op.startswith("mrs"), "has_timing_instruction"), flag(op.isin("lfence", "mfence", "dsb", "dmb", "isb", "csdb"), "has_speculation_barrier"), flag(op.isin("clflush", "clflushopt", "clwb", "dc", "ic"), "has_cache_instruction"),
        flag(op.isin("push", "pop", "stp", "ldp") | low.contains("sp"), "has_stack_manipulation"), flag(op.isin("msr", "mrs", "wrmsr", "rdmsr", "in", "out"), "has_privileged_access"), flag(op.isin("svc", "hvc", "smc", "int", "syscall", "iret"), "has_exception_handling"),
        flag(op.contains("tlb") | low.contains("at "), "has_page_table_access"), flag(op.isin("clflush", "clflushopt", "dc", "prefetch", "prfm"), "has_l1_cache_interaction"), flag(op.isin("adr", "adrp", "lea"), "has_register_computation"),
        flag(op.isin("br", "blr") | (op.isin("jmp", "call") & c("line").contains("*")), "branch_target_computed"), flag(c("dep"), "has_dependent_load"), flag(c("after"), "memory_access_after_branch"),
        F.sum(F.size("regs")).alias("reg_total"), F.size(F.array_distinct(F.flatten(F.collect_list("regs")))).alias("hash_diversity"), F.max("gap").alias("gap"), F.max("branch_at").alias("last_branch"),
    )
    size = c("num_instructions")
    got = got.select(
        "*", *(F.round(c(a) / size, 6).alias(b) for a, b in (("unique_opcodes", "opcode_diversity"), ("operand_total", "avg_operand_count"), ("arithmetic_count", "arithmetic_density"), ("memory_access_count", "memory_density"), ("branch_count", "branch_density"))),
        (c("conds") > 0).cast("int").alias("has_conditional_branch"), F.round((c("reg_total") - c("hash_diversity")) / size, 6).alias("register_reuse_factor"), (c("conds") >= 3).cast("int").alias("has_branch_history_pollution"),
        (c("conds") + 1).alias("cyclomatic_complexity"), F.coalesce(F.greatest("gap", size - c("last_branch")), size).alias("max_path_length"),
    ).drop("operand_total", "conds", "reg_total", "gap", "last_branch")
    names = rows.select(*KEY, F.explode("operands").alias("operand"))
    return got.join(entropies(rows, "op", "opcode_entropy"), list(KEY)).join(entropies(names, "operand", "operand_entropy"), list(KEY), "left").fillna(0.0, ["operand_entropy"])


def _family(name: str):
    return lambda s, d: profiles(code_windows(s, d)).select(*KEY, *FAMILIES[name].split())


QUERIES = {
    **{k: _family(k) for k in FAMILIES},
    "indirect_branches": lambda s, d: marked(code_windows(s, d)).groupBy(*KEY).agg(F.sum(F.col("indirect").cast("int")).alias("n_indirect")),
    "exclusion_scores": lambda s, d: exclusion(profiles(code_windows(s, d))),
    "structural_features": lambda s, d: structural(code_windows(s, d)),
}


# --------------------------------------------------------------------------- oracles: the rules again, by self-joins over (seq, lo, i)


def _re(name: str, line: str = "line") -> str:
    return f"regexp_matches({line}, '(?i){fixed.LINE_PATTERNS[name]}')"


def _has(flag: str) -> str:
    return f"(EXISTS (SELECT 1 FROM f WHERE f.seq = w.seq AND f.lo = w.lo AND {flag}))::INT"


def _num(flag: str) -> str:
    return f"(SELECT count(*) FILTER ({flag}) FROM f WHERE f.seq = w.seq AND f.lo = w.lo)"


def _ahead(a: str, b: str, lo: int, hi: int) -> str:
    return f"(EXISTS (SELECT 1 FROM f a JOIN f b ON a.seq = b.seq AND a.lo = b.lo AND b.i BETWEEN a.i + {lo} AND a.i + {hi} WHERE a.seq = w.seq AND a.lo = w.lo AND a.{a} AND ({b})))::INT"


def _all(name: str) -> str:
    return f"len(regexp_extract_all(text, '(?i){fixed.LINE_PATTERNS[name]}'))"


def _t(name: str) -> str:
    return f"regexp_matches(text, '{fixed.TEXT_PATTERNS[name]}')::INT"


def _ordered(mid: str) -> str:
    """A flush, then ``mid``, then a load, each after the latest one before it."""
    return f"""(EXISTS (SELECT 1 FROM f x WHERE x.seq = w.seq AND x.lo = w.lo AND x.load AND NOT x.flush AND NOT x.{mid}
      AND (SELECT max(i) FROM f y WHERE y.seq = x.seq AND y.lo = x.lo AND y.i < x.i AND y.{mid} AND NOT y.flush) > (SELECT max(i) FROM f y WHERE y.seq = x.seq AND y.lo = x.lo AND y.i < x.i AND y.flush)))::INT"""


_F = rf"""WITH {WINDOWS}, o AS (SELECT *, replace(lower(regexp_extract(line, '^\s*(\S+)', 1)), ',', '') AS op FROM aw),
f AS (SELECT *, {", ".join(f"{_re(k)} AS {k}" for k in ("load", "store", "flush", "fence", "timing", "clear", "shift", "ret", "call", "indirect_call", "target_setup", "result"))}, contains(lower(line), 'mov') AS mov,
  op IN ('br', 'blr') OR (op IN ('jmp', 'call') AND contains(line, '*')) AS ind, op LIKE 'b.%' OR (op LIKE 'j%' AND op <> 'jmp') AS bcc, op LIKE 'b.%' OR op LIKE 'cb%' OR (op LIKE 'j%' AND op <> 'jmp') AS cond, op LIKE 'b%' OR op LIKE 'j%' AS branch FROM o),
w AS (SELECT seq, lo, lower(string_agg(line, chr(10) ORDER BY i)) AS text, count(*) AS n FROM aw GROUP BY ALL),
p AS (SELECT seq, lo, {_all("flush")} AS cache_flush_count, {_all("fence")} AS fence_count, {_all("ret")} AS ret_count, {_all("call")} AS call_count, {_all("push")} AS pushes, {_all("pop")} AS pops, {_has("timing")} AS has_timing,
  {_ahead("clear", "b.load OR b.mov", 1, 4)} AS has_clear_before_load, {_ahead("shift", "b.load", 1, 3)} AS has_shift_then_load, {_ordered("fence")} AS has_flush_fence_load, {_ahead("bcc", "b.load", 1, 5)} AS has_cond_branch_then_load,
  {_num("ind")} AS indirect_branch_count, {_num("branch")} AS branches, {_num("cond")} AS conds, (SELECT count(DISTINCT op[1:3]) FROM f WHERE f.seq = w.seq AND f.lo = w.lo AND (branch OR op LIKE 'cb%')) AS bhi_branch_diversity,
  coalesce((SELECT max(c) FROM (SELECT count(*) AS c FROM f WHERE f.seq = w.seq AND f.lo = w.lo AND branch GROUP BY op)), 0) AS same_op, {_ordered("timing")} AS l1tf_has_flush_reload, {_ahead("flush", "b.load", 1, 7)} AS l1tf_flush_then_access,
  (EXISTS (SELECT 1 FROM f a WHERE a.seq = w.seq AND a.lo = w.lo AND a.timing AND EXISTS (SELECT 1 FROM f z WHERE z.seq = a.seq AND z.lo = a.lo AND z.timing
    AND z.i - (SELECT min(i) FROM f b WHERE b.seq = a.seq AND b.lo = a.lo AND b.load AND b.i BETWEEN a.i + 1 AND a.i + 5) BETWEEN 1 AND 5)))::INT AS l1tf_has_timing_around_load, {_has("load")} AS has_load,
  {_num("op IN " + str(fixed.BENIGN_ARITHMETIC))} AS ariths, (SELECT count(*) FROM f WHERE f.seq = w.seq AND f.lo = w.lo AND op <> '' AND op NOT LIKE '%:') AS ops,
  {_has(r"(op LIKE 'b.%' OR op LIKE 'cb%') AND regexp_matches(line, '\s\S*[A-Za-z]\S*$')")} AS benign_loop_pattern, {_ahead("call", "b.result", 1, 3)} AS benign_function_call_pattern,
  coalesce((SELECT max(c) FROM (SELECT count(*) AS c FROM f WHERE f.seq = w.seq AND f.lo = w.lo AND call AND contains(line, ' ') GROUP BY list_last(regexp_split_to_array(line, '\s+')))), 0) AS same_target,
  coalesce((SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT i - row_number() OVER (ORDER BY i) AS g FROM f WHERE f.seq = w.seq AND f.lo = w.lo AND call) GROUP BY g)), 0) AS longest_calls,
  (SELECT count(*) FROM f a WHERE a.seq = w.seq AND a.lo = w.lo AND a.call AND EXISTS (SELECT 1 FROM f b WHERE b.seq = a.seq AND b.lo = a.lo AND b.ret AND b.i BETWEEN a.i + 1 AND a.i + 4)) AS call_rets,
  coalesce((SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT (SELECT count(*) FROM f r WHERE r.seq = a.seq AND r.lo = a.lo AND r.ret AND r.i < a.i) AS g FROM f a WHERE a.seq = w.seq AND a.lo = w.lo AND a.call) GROUP BY g)), 0) AS retbleed_call_chain_depth,
  {_ahead("ind", "b.load OR b.store", 1, 5)} AS inception_phantom_window, {_ahead("indirect_call", "b.target_setup", -4, -1)} AS inception_call_target_mismatch, {_ahead("ind", "b.store", 1, 3)} AS inception_speculative_store,
  {_t("mds_probe")} AS has_mds_probe_pattern, {_t("verw")} AS mds_has_verw, {_t("fill_buffer")} AS mds_fill_buffer_probe, {_t("line_fill")} AS mds_line_fill_buffer, {_t("zombieload")} AS mds_explicit_zombieload, {_t("store_buffer")} AS mds_store_buffer_probe,
  1 - {_t("compare_branch")} AS mds_no_bounds_check, {_t("bounds_check")} AS has_bounds_check, {_t("lfence")} AS spectre_v1_lfence_guarded, {_t("bounds_cmp")} AS spectre_v1_bounds_cmp_pattern, greatest({_t("array_load")}, {_t("x86_array_load")}) AS spectre_v1_array_index_load,
  {_t("index_mask")} AS spectre_v1_index_masking, {_t("cntvct")} AS bhi_explicit_cntvct_timing, {_t("dsb_isb")} AS bhi_has_dsb_isb, {_t("tlb")} AS l1tf_has_tlb_invalidation, {_t("pte")} AS l1tf_has_pte_manipulation, {_t("fault")} AS l1tf_has_fault_trigger,
  {_t("cache_timing")} AS l1tf_cache_timing_pattern, {_t("lfence_full")} AS full_fence, {_t("terminal_fault")} AS terminal, {_t("stack_frame")} * {_t("epilogue")} AS benign_stack_frame_pattern, {_t("leave_ret")} AS has_leave_ret_pattern,
  {_t("rsb_flush")} AS retbleed_rsb_flush_pattern, {_t("return_control")} AS inception_return_target_control, {_t("inline_asm")} AS inception_has_inline_asm FROM w),
q AS (SELECT *, (cache_flush_count > 0)::INT AS has_cache_flush, (fence_count > 0)::INT AS has_fence, (indirect_branch_count >= 2)::INT AS has_multiple_indirect_branches, (branches >= 3 AND indirect_branch_count >= 1)::INT AS has_branch_training_loop,
  (conds >= 4)::INT AS bhi_history_training_loop, (conds >= 2 AND indirect_branch_count >= 1)::INT AS bhi_mixed_branch_types, (same_op >= 3)::INT AS bhi_repeated_branch_pattern, (has_bounds_check = 1 AND spectre_v1_lfence_guarded = 0)::INT AS spectre_v1_speculation_barrier_missing,
  (has_load = 1 AND full_fence = 0)::INT AS l1tf_no_fence_before_load, terminal * l1tf_has_fault_trigger AS l1tf_terminal_fault_setup, l1tf_flush_then_access * mds_no_bounds_check AS l1tf_unmapped_access_pattern,
  (l1tf_has_timing_around_load = 1 AND full_fence = 0)::INT AS l1tf_speculative_window_no_guard, (conds <= 2 AND indirect_branch_count = 0)::INT AS benign_simple_control_flow, (pushes > 0 AND abs(pushes - pops) <= 1)::INT AS benign_balanced_push_pop,
  1 - has_timing AS benign_no_timing_ops, (cache_flush_count = 0)::INT AS benign_no_cache_ops, (indirect_branch_count = 0)::INT AS benign_no_indirect_branch, (ops > 0 AND ariths / ops > 0.6)::INT AS benign_pure_arithmetic,
  (same_target > 1)::INT AS has_recursive_call_hint, (longest_calls >= 2)::INT AS has_deep_call_pattern, abs(pushes - pops) AS push_pop_imbalance, ((ret_count > call_count AND ret_count >= 2) OR call_rets >= 2)::INT AS has_rsb_manipulation,
  round(CASE WHEN ret_count > 0 THEN call_count / ret_count ELSE 0 END, 6) AS call_ret_ratio, (ret_count > call_count)::INT AS retbleed_unbalanced_ret, (call_count >= 3 AND ret_count >= 1)::INT AS retbleed_ret_after_many_calls,
  (indirect_branch_count = 0)::INT AS retbleed_no_indirect_branch, indirect_branch_count AS inception_indirect_branch_count, (indirect_branch_count >= 2)::INT AS inception_btb_pollution FROM p)"""


def _sum(weights: dict[str, float]) -> str:
    return " + ".join(f"{k} * {v}::DOUBLE" for k, v in weights.items())


def _cap(x: str) -> str:
    return f"round(least(1.0::DOUBLE, {x}), 6)"


_SCORED = f"""{_F}, z AS (SELECT *, {_cap(_sum(fixed.SCORES["mds"]) + " + (mds_no_bounds_check = 1 AND has_cache_flush = 1)::INT * 0.1::DOUBLE")} AS mds_gadget_score, {_cap(_sum(fixed.SCORES["v1"]))} AS spectre_v1_score, {_cap(_sum(fixed.SCORES["l1tf"]))} AS l1tf_score,
  round(greatest(0::DOUBLE, least(1::DOUBLE, {_sum(fixed.SCORES["benign"])} - has_cache_flush * 0.3::DOUBLE - has_timing * 0.25::DOUBLE)), 6) AS benign_score,
  {_cap("has_multiple_indirect_branches * 0.3::DOUBLE + has_branch_training_loop * 0.2::DOUBLE + (indirect_branch_count >= 3)::INT * 0.1::DOUBLE + bhi_history_training_loop * 0.2::DOUBLE + bhi_mixed_branch_types * 0.15::DOUBLE + bhi_explicit_cntvct_timing * 0.2::DOUBLE + (bhi_branch_diversity >= 3)::INT * 0.1::DOUBLE + bhi_repeated_branch_pattern * 0.15::DOUBLE + bhi_has_dsb_isb * 0.1::DOUBLE")} AS bhi_score,
  {_cap("CASE WHEN ret_count >= 2 THEN 0.25::DOUBLE WHEN ret_count >= 1 THEN 0.1::DOUBLE ELSE 0 END + has_leave_ret_pattern * 0.2::DOUBLE + has_recursive_call_hint * 0.2::DOUBLE + has_deep_call_pattern * 0.15::DOUBLE + has_rsb_manipulation * 0.25::DOUBLE + (push_pop_imbalance >= 2)::INT * 0.1::DOUBLE + retbleed_ret_after_many_calls * 0.15::DOUBLE + (retbleed_call_chain_depth >= 3)::INT * 0.15::DOUBLE + retbleed_unbalanced_ret * 0.1::DOUBLE + retbleed_rsb_flush_pattern * 0.15::DOUBLE + (retbleed_no_indirect_branch = 1 AND ret_count >= 1)::INT * 0.1::DOUBLE")} AS retbleed_score,
  {_cap("CASE WHEN indirect_branch_count >= 2 THEN 0.3::DOUBLE WHEN indirect_branch_count >= 1 THEN 0.15::DOUBLE ELSE 0 END + inception_btb_pollution * 0.2::DOUBLE + inception_phantom_window * 0.25::DOUBLE + inception_call_target_mismatch * 0.15::DOUBLE + inception_return_target_control * 0.2::DOUBLE + inception_speculative_store * 0.15::DOUBLE + inception_has_inline_asm * 0.1::DOUBLE")} AS inception_score FROM q)"""
_PAIR = ", ".join(f"round(({_sum(a)}) - ({_sum(b)}), 6) AS {k}_score" for k, (a, b) in PAIRS.items())
_IN = lambda words: "(" + ", ".join(f"'{x}'" for x in words) + ")"
_ANY = lambda what, name: f"(count(*) FILTER ({what}) > 0)::INT AS {name}"
ORACLES = {
    **{k: f"{_SCORED} SELECT seq, lo, {v.replace(' ', ', ')} FROM z" for k, v in FAMILIES.items()},
    "indirect_branches": f"{_F} SELECT seq, lo, count(*) FILTER (ind) AS n_indirect FROM f GROUP BY ALL",
    "exclusion_scores": f"{_F}, x AS (SELECT seq, lo, {_PAIR} FROM q) SELECT *, {', '.join(f'round(1 / (1 + exp(-{k}_score / 3)), 6) AS {k}_norm' for k in PAIRS)} FROM x",
    "structural_features": rf"""WITH {WINDOWS}, o AS (SELECT *, replace(lower(regexp_extract(line, '^\s*(\S+)', 1)), ',', '') AS op, regexp_extract(line, '^\s*\S+\s+(.*)$', 1) AS rest, contains(line, '[') AND contains(line, ']') AS mem FROM aw),
      c AS (SELECT *, regexp_matches(op, '(?i){fixed.CONDITIONAL_OPCODE}') AS cond, op LIKE 'ldr%' OR (op = 'mov' AND contains(line, '[')) AS ld,
        list_transform(list_concat(regexp_extract_all(line, '(?i){fixed.LINE_PATTERNS["reg_arm"]}'), regexp_extract_all(line, '(?i){fixed.LINE_PATTERNS["reg_x86"]}')), lambda r: ltrim(lower(r), '%')) AS regs,
        CASE WHEN rest = '' THEN [] ELSE list_transform(string_split(rest, ','), lambda x: trim(x)) END AS operands FROM o),
      f AS (SELECT *, cond OR op IN {_IN(fixed.BRANCHES)} AS branch FROM c),
      b AS (SELECT seq, lo, i, i - coalesce(lag(i) OVER (PARTITION BY seq, lo ORDER BY i), 0) AS gap FROM f WHERE branch),
      s AS (SELECT seq, lo, max(gap) AS gap, max(i) AS last FROM b GROUP BY ALL),
      d AS (SELECT DISTINCT x.seq, x.lo FROM f x JOIN f y ON x.seq = y.seq AND x.lo = y.lo AND y.i BETWEEN x.i + 1 AND x.i + 5 WHERE x.ld AND y.ld), m AS (SELECT DISTINCT x.seq, x.lo FROM f x JOIN f y ON x.seq = y.seq AND x.lo = y.lo AND y.i BETWEEN x.i + 1 AND x.i + 5 WHERE x.branch AND y.mem),
      e1 AS (SELECT seq, lo, entropy(op) AS opcode_entropy FROM f GROUP BY ALL), e2 AS (SELECT seq, lo, entropy(x) AS operand_entropy FROM (SELECT seq, lo, unnest(operands) AS x FROM f) GROUP BY ALL),
      r AS (SELECT seq, lo, count(*) AS total, count(DISTINCT r) AS hash_diversity FROM (SELECT seq, lo, unnest(regs) AS r FROM f) GROUP BY ALL),
      g AS (SELECT seq, lo, count(*) AS num_instructions, count(DISTINCT op) AS unique_opcodes, sum(len(operands)) AS operand_total, max(len(operands)) AS max_operand_count, count(*) FILTER (op IN {_IN(fixed.ARITHMETIC)}) AS arithmetic_count, count(*) FILTER (mem) AS memory_access_count,
        count(*) FILTER (branch) AS branch_count, count(*) FILTER (cond) AS conds, {_ANY("op IN ('ret', 'retq')", "has_return_instruction")}, {_ANY("op IN ('rdtsc', 'rdtscp') OR op LIKE 'mrs%'", "has_timing_instruction")}, {_ANY("op IN ('lfence', 'mfence', 'dsb', 'dmb', 'isb', 'csdb')", "has_speculation_barrier")},
        {_ANY("op IN ('clflush', 'clflushopt', 'clwb', 'dc', 'ic')", "has_cache_instruction")}, {_ANY("op IN ('push', 'pop', 'stp', 'ldp') OR contains(lower(line), 'sp')", "has_stack_manipulation")}, {_ANY("op IN ('msr', 'mrs', 'wrmsr', 'rdmsr', 'in', 'out')", "has_privileged_access")},
        {_ANY("op IN ('svc', 'hvc', 'smc', 'int', 'syscall', 'iret')", "has_exception_handling")}, {_ANY("contains(op, 'tlb') OR contains(lower(line), 'at ')", "has_page_table_access")}, {_ANY("op IN ('clflush', 'clflushopt', 'dc', 'prefetch', 'prfm')", "has_l1_cache_interaction")},
        {_ANY("op IN ('adr', 'adrp', 'lea')", "has_register_computation")}, {_ANY("op IN ('br', 'blr') OR (op IN ('jmp', 'call') AND contains(line, '*'))", "branch_target_computed")} FROM f GROUP BY ALL)
      SELECT seq, lo, num_instructions, unique_opcodes, max_operand_count, arithmetic_count, memory_access_count, branch_count, has_return_instruction, has_timing_instruction, has_speculation_barrier, has_cache_instruction, has_stack_manipulation, has_privileged_access, has_exception_handling,
        has_page_table_access, has_l1_cache_interaction, has_register_computation, branch_target_computed, (d.seq IS NOT NULL)::INT AS has_dependent_load, (m.seq IS NOT NULL)::INT AS memory_access_after_branch, coalesce(hash_diversity, 0) AS hash_diversity,
        round(unique_opcodes / num_instructions, 6) AS opcode_diversity, round(operand_total / num_instructions, 6) AS avg_operand_count, round(arithmetic_count / num_instructions, 6) AS arithmetic_density, round(memory_access_count / num_instructions, 6) AS memory_density,
        round(branch_count / num_instructions, 6) AS branch_density, (conds > 0)::INT AS has_conditional_branch, round((coalesce(total, 0) - coalesce(hash_diversity, 0)) / num_instructions, 6) AS register_reuse_factor, (conds >= 3)::INT AS has_branch_history_pollution,
        conds + 1 AS cyclomatic_complexity, coalesce(greatest(gap, num_instructions - last), num_instructions) AS max_path_length, round(opcode_entropy, 6) AS opcode_entropy, round(coalesce(operand_entropy, 0), 6) AS operand_entropy
      FROM g LEFT JOIN s USING (seq, lo) LEFT JOIN d USING (seq, lo) LEFT JOIN m USING (seq, lo) LEFT JOIN e1 USING (seq, lo) LEFT JOIN e2 USING (seq, lo) LEFT JOIN r USING (seq, lo)""",
}
