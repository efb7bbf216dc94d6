"""Typed gadgets against a search over all mappings of an induced subgraph."""

import random

import numpy as np
import pytest

from fenceline.operators import gadgets


def induced(window, gadget):
    """Whether some injective mapping of the gadget's nodes keeps types, edges and missing edges."""
    def edges(types):
        return {(i, i + 1) for i in range(len(types) - 1) if types[i] != "BRANCH"}

    own, wanted = edges(window), edges(gadget)

    def placed(done):
        k = len(done)
        if k == len(gadget):
            return True
        for node in range(len(window)):
            if node in done or window[node] != gadget[k]:
                continue
            if all(((done[j], node) in own) == ((j, k) in wanted) and ((node, done[j]) in own) == ((k, j) in wanted) for j in range(k)) and placed([*done, node]):
                return True
        return False

    return placed([])


def codes(windows):
    out = np.full((len(windows), max(map(len, windows), default=0)), -1, np.int8)
    for k, w in enumerate(windows):
        out[k, : len(w)] = [gadgets.TYPES.index(t) for t in w]
    return out


def test_all_default_gadgets_in_one_pass_are_brute_force():
    rng = random.Random(7)
    plan = gadgets.compile_gadgets()
    assert len(plan.names) == 20 and len(plan.steps) < sum(map(len, gadgets.GADGETS.values()))  # common beginnings are one
    windows = [[rng.choice(gadgets.TYPES) for _ in range(rng.randint(0, 11))] for _ in range(200)]
    for _ in range(200):  # a gadget with other lines in between
        windows.append([gadgets.LETTERS[t] for x in rng.choice(list(gadgets.GADGETS.values())) for t in x + rng.choice(("", "", "", "C", "B"))])
    found = plan.found(codes(windows))
    for w, row in zip(windows, found, strict=True):
        for name, hit in zip(plan.names, row, strict=True):
            assert hit == induced(w, [gadgets.LETTERS[t] for t in gadgets.GADGETS[name]]), (w, name)
    assert found.any(axis=0).sum() >= 18


def test_random_gadgets_are_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        own = {f"g{k}": "".join(rng.choice("BLS") for _ in range(rng.randint(1, 6))) for k in range(6)}
        windows = [[gadgets.LETTERS[rng.choice("BBLS")] for _ in range(rng.randint(1, 9))] for _ in range(12)]
        found = gadgets.compile_gadgets(own).found(codes(windows))
        for w, row in zip(windows, found, strict=True):
            assert [bool(x) for x in row] == [induced(w, [gadgets.LETTERS[t] for t in g]) for g in own.values()]


def test_order_of_paths_is_free_and_touching_is_not():
    plan = gadgets.compile_gadgets({"a": "LBS"})  # a path of a load and a branch, and a store
    window = lambda s: [gadgets.LETTERS[c] for c in s]
    assert plan.found(codes([window(s) for s in ("LBS", "SCLB", "SLB", "SBLB", "LB")])).ravel().tolist() == [True, True, False, True, False]
    assert [induced(window(s), window("LBS")) for s in ("LBS", "SCLB", "SLB", "SBLB", "LB")] == [True, True, False, True, False]
    with pytest.raises(ValueError):
        gadgets.compile_gadgets({"wide": "".join("L" * (k + 1) + "B" for k in range(18))})


def test_edge_windows(spark):
    rows = [(1, 0, ["LOAD", "BRANCH", "STORE"], "x"), (1, 0, ["LOAD", "BRANCH", "STORE"], "x"), (2, 0, [], "y"), (3, 0, None, None), (4, 0, [None, "LOAD", "other", "BRANCH"], "z"), (5, 0, ["STORE", "COMPUTE"] * 400 + ["LOAD", "BRANCH"], "long")]
    df = spark.createDataFrame(rows, "seq int, lo int, types array<string>, extra string")
    plan = gadgets.compile_gadgets({"lbs": "LBS", "none": "", "s": "S"})
    got = {(r["seq"], r["extra"]): r["gadgets"] for r in gadgets.matched(df, plan).collect()}
    assert got == {(1, "x"): ["lbs", "none", "s"], (2, "y"): ["none"], (3, None): ["none"], (4, "z"): ["none"], (5, "long"): ["lbs", "none", "s"]}
    assert gadgets.matched(df, plan).count() == 6 and gadgets.matched(df.where("false"), plan).count() == 0


def test_node_types(spark):
    lines = ["b.hs .L1", "jne x", "ret", "ldrb w0, [x1]", "movq %rax, (%rbx)", "movzbl (%rdi), %eax", "str x0, [sp]", "pushq %rbp", "add x0, x0, 1", "", None, "brk #1", "callq f", "  LDR x1", "ret:"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = [r[1] for r in df.select("i", gadgets.node_type(df.line)).orderBy("i").collect()]
    assert got == ["BRANCH", "BRANCH", "BRANCH", "LOAD", "LOAD", "COMPUTE", "STORE", "STORE", "COMPUTE", "COMPUTE", "COMPUTE", "BRANCH", "BRANCH", "LOAD", "BRANCH"]
