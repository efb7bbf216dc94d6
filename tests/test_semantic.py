"""Semantic graphs against a walk over the lines with a table of last definitions and stores."""

import re

import pytest

from fenceline.functions import fixed
from fenceline.operators import semantic
from fenceline.plans.assembly_analog import code_windows

from .conftest import SF

KINDS = "seq int, lo int, i int, line string"


def window(spark, *lines):
    return spark.createDataFrame([(s, 0, i, x) for s, own in enumerate(lines) for i, x in enumerate(own)], KINDS)


def has(name, line):
    return re.search(fixed.SEMANTIC_PATTERNS[name], line, re.I | re.A) is not None


def walked(rows):
    """Edges of one window, node by node; ``rows`` are its nodes in order."""
    last, stores, out = {}, {}, []
    for r in rows:
        n = r["node"]
        if n:
            out.append((n - 1, n, "SEQ", None))
        for reg in r["uses"]:
            if reg in last and n - last[reg] <= 10:
                out.append((last[reg], n, "DATA", reg))
        for reg in r["defs"]:
            last[reg] = n
        if r["reads_memory"] and r["address"]:
            out += [(s, n, "MEM", r["address"]) for s in stores.get(r["address"], []) if n - s <= 10]
        if r["writes_memory"] and r["address"]:
            stores.setdefault(r["address"], []).append(n)
    return out


def test_edges_are_the_walk(spark):
    nodes = semantic.graph_nodes(code_windows(spark, SF))
    by, got = {}, {}
    for r in nodes.collect():
        by.setdefault((r["seq"], r["lo"]), []).append(r)
    for r in semantic.graph_edges(nodes).collect():
        got.setdefault((r["seq"], r["lo"]), []).append((r["src"], r["dst"], r["type"], r["by"]))
    key = lambda e: tuple(map(str, e))
    for k, rows in by.items():
        rows.sort(key=lambda r: r["node"])
        assert sorted(got.get(k, []), key=key) == sorted(walked(rows), key=key), k
    assert {e[2] for own in got.values() for e in own} == {"SEQ", "DATA", "MEM"}


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("ret", "RET"), ("blr x8", "CALL_INDIRECT"), ("br x9", "JUMP_INDIRECT"), ("bl f", "CALL"), ("b.hs .L1", "BRANCH_COND"), ("jmp .L5", "BRANCH_UNCOND"), ("dsb sy", "FENCE"), ("dc civac, x0", "CACHE_OP"), ("mrs x2, cntvct_el0", "COMPUTE"), ("rdtscp", "TIMING"), ("cmp x0, #16", "COMPARE"),
        ("str x1, [sp, #16]", "STORE_STACK"), ("str x2, [x3]", "STORE"), ("ldr x2, [x3, x0, lsl #3]", "LOAD_INDEXED"), ("ldr x1, [x0, #8]", "LOAD"), ("ldp x29, x30, [sp], #16", "LOAD_STACK"), ("pushq %rbp", "COMPUTE"), ("push rbx", "STORE"), ("add x0, x0, x1", "COMPUTE"), ("nop", None), (".L1:", None), ("", None), (None, None), ("42", None),
    ],
)
def test_node_types(spark, line, kind):
    found = [r["type"] for r in semantic.graph_nodes(window(spark, [line])).collect()]
    assert found == ([kind] if kind else [])


def test_known_sequences(spark):
    rows = window(
        spark, ["cmp x0, x1", "b.ge .L1", "ldr x2, [x3, x0, lsl #3]", "ldr x4, [x5, x2, lsl #6]"], ["dc civac, x0", "ldr x1, [x0]", "mrs x2, cntvct_el0"], ["bl func", "add x0, x0, #1", "ret"],
        ["cmp x0, #0", "b.eq .L1", "cmp x1, #0", "b.ne .L2", "cmp x2, #0", "b.lt .L3"], ["nop"], ["str x1, [sp, #8]", "", None, "ldr x2, [sp, #8]"],
    )
    nodes = semantic.graph_nodes(rows)
    found = {r["seq"]: r for r in semantic.patterns(nodes, semantic.graph_edges(nodes)).collect()}
    assert set(found) == {0, 1, 2, 3, 5}
    assert (found[0]["SPECTRE_V1_compare_branch"], found[0]["SPECTRE_V1_branch_load_indexed"], found[0]["unfenced_indexed_load"], found[0]["spectre_v1_score"]) == (1, 1, 2, 9.0)
    assert (found[1]["l1tf_score"], found[1]["timing_count"]) == (7.0, 0)  # the counter's name goes on after "cntvct", so the pattern does not hold
    assert (found[2]["call_ret_distance"], found[2]["retbleed_score"], found[0]["call_ret_distance"]) == (2.0, 4.0, -1.0)
    assert (found[3]["branch_density"], found[3]["bhi_score"]) == (0.5, 5.0)
    assert (found[5]["memory_dep_count"], found[5]["SPECTRE_V4_stack_store_load"], found[5]["spectre_v4_score"]) == (1, 1, 3.0)
    edges = {(r["seq"], r["src"], r["dst"], r["type"], r["by"]) for r in semantic.graph_edges(nodes).where("type != 'SEQ'").collect()}
    assert (0, 2, 3, "DATA", "x2") in edges and (5, 0, 1, "MEM", "STACK") in edges


def test_reach_and_matrices(spark):
    far = ["add x1, x2, x3", *["add x9, x8, x8"] * 10, "add x4, x1, x1"]
    near = ["add x1, x2, x3", *["add x9, x8, x8"] * 9, "add x4, x1, x1"]
    nodes = semantic.graph_nodes(window(spark, far, near))
    edges = semantic.graph_edges(nodes)
    assert [tuple(r) for r in edges.where("type = 'DATA' AND by = 'x1'").select("seq", "src", "dst").collect()] == [(1, 0, 10)]
    rows = {(r["seq"], r["node"]): r for r in semantic.matrices(nodes, edges, 5).collect()}
    assert len(rows) == 10 and list(rows[1, 0]["neighbours"]) == [1] and len(rows[0, 0]["features"]) == 21 and sum(rows[0, 0]["features"]) == 1
    assert semantic.graph_edges(nodes.where("false")).count() == 0
