"""Canonical names, factors and merges on small windows."""

from pyspark.sql import functions as F

from fenceline import catalog
from fenceline.operators import factors, robust

from .conftest import SF


def test_first_seen_numbers_belong_to_a_listing(spark):
    rows = [(1, 0, "add x2, x0, x2"), (1, 5, None), (1, 9, "mov x7, X0"), (2, 0, "ldr x7, [x1]"), (3, 0, "nop")]
    got = {(r["seq"], r["reg"]): r["name"] for r in factors.first_seen(spark.createDataFrame(rows, "seq int, pos int, line string")).collect()}
    assert got == {(1, "x2"): "REG_0", (1, "x0"): "REG_1", (1, "x7"): "REG_2", (2, "x7"): "REG_0", (2, "x1"): "REG_1"}


def test_memory_forms(spark):
    lines = ["mov [rbx+8], rax", "mov rax, [rbp-16]", "ldr x1, [x0]", "movq 8(%rsp), %rax", "nop", None, "ldr x1, [x0]", "mov rax, [rbx+rcx*8]", "ldr x2, []"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "seq int, pos int, line string")
    got = {r["pos"]: (r["form"], r["numbered"]) for r in factors.memory_operands(df).collect()}
    assert got == {
        0: ("MEM_BASE_OFFSET_REG_RBX", "MEM_REG_0_OFFSET"), 1: ("MEM_BASE_NEG_OFFSET_REG_FP", "MEM_REG_1_OFFSET"), 2: ("MEM_BASE_ONLY_REG_RET", "MEM_REG_2"), 3: ("MEM_INDIRECT_REG_SP", "MEM_COMPLEX"), 6: ("MEM_BASE_ONLY_REG_RET", "MEM_REG_2"),
        7: ("MEM_BASE_OFFSET_REG_RBX", "MEM_REG_0_OFFSET"), 8: ("MEM_COMPLEX", "MEM_COMPLEX"),
    }


def test_factors_of_windows(spark):
    windows = [["cmp x0, x1", "b.hs .L1", "ldr x2, [x3]"], ["b .L1", "nop"], [None], ["dsb sy", "mrs x0, cntvct_el0", "dc civac, x0"] * 8]
    rows = [(2 * s, 0, i, x) for s, own in enumerate(windows) for i, x in enumerate(own)]
    got = {r["seq"]: r for r in factors.factors(spark.createDataFrame(rows, "seq int, lo int, i int, line string")).collect()}
    assert (got[0]["speculation_possible"], got[0]["speculation_score"], got[0]["indicators"]) == (True, 0.8, ["conditional_branches_present", "memory_access_after_branch", "high_memory_access_density"])
    assert (got[2]["speculation_score"], got[2]["control_flow_complexity"], got[4]["speculation_score"], got[4]["indicators"]) == (0.0, 0.5, 0.0, [])
    assert got[6]["instruction_complexity"] == 1.0 and set(got[6]["indicators"]) >= {"speculation_barriers_present", "timing_operations_present", "cache_operations_present"}


def test_later_maps_win(spark):
    rows = [(1, {"a": 1.0, "b": 2.0}, {"b": 3.0, "c": None}), (2, None, {"a": 1.0}), (3, {"a": 1.0}, None), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, x map<string,double>, y map<string,double>")
    got = {r["id"]: r["m"] for r in df.select("id", factors.merged(F.col("x"), F.col("y")).alias("m")).collect()}
    assert got == {1: {"a": 1.0, "b": 3.0, "c": None}, 2: {"a": 1.0}, 3: {"a": 1.0}, 4: {}}
    found = {(r["seq"], r["lo"]): dict(x.split("=") for x in r["features"].split(";")) for r in catalog.QUERIES["merged_features"](spark, SF).collect()}
    assert all(set(v) == {*robust.GRAPH, *robust.STATISTICS, *robust.COUNTS} and float(v["instruction_count"]) > 0 and float(v["branch_patterns"]) >= 0 for v in found.values())
