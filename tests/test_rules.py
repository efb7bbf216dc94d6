"""Rules as data against a plain reading of the same document, window by window."""

import random

import pytest
from pyspark.sql import functions as F

from fenceline import catalog
from fenceline.operators import rules
from fenceline.plans.assembly_analog import code

from .conftest import SF

TAGS = {
    "COMPARISON": lambda f: f["is_comparison"], "BRANCH_CONDITIONAL": lambda f: f["is_branch"] and f["is_conditional"], "MEMORY_LOAD": lambda f: f["is_load"] or (f["accesses_memory"] and not f["is_store"]),
    "INDIRECT_BRANCH": lambda f: f["is_indirect"] and f["is_branch"], "RETURN": lambda f: f["is_return"],
}


def plain(lines, arch, rule):
    """(reason, missing, evidence) of a list of lines."""
    raw, flags, c = " ".join(x["line"] for x in lines), [x["f"] for x in lines], rule["constraints"]
    for a in rule["anti_patterns"]:
        if a.get("arch") in (None, arch) and (("opcode" in a and a["opcode"] in [x["op"] for x in lines]) or ("token" in a and a["token"].lower() in raw)):
            return "anti_pattern_triggered", None, []
    seen, at = [], -1
    for i, step in enumerate(c.get("sequence", [])):
        stop = len(lines) if step.get("within") is None else min(len(lines), at + 1 + step["within"] + 1)
        found = [j for j in range(at + 1, stop) if TAGS[step["semantic"]](flags[j])]
        if not found:
            return "sequence_constraints_failed", None, seen
        at = found[0]
        seen.append(f"seq_{i}_{step['semantic']}={at}")
    if c.get("sequence") and c.get("max_distance") is not None and len(lines) > c["max_distance"]:
        return "max_distance_exceeded", None, seen
    has = lambda k: [i for i, f in enumerate(flags) if f[k]]
    loads = [i for i, f in enumerate(flags) if TAGS["MEMORY_LOAD"](f)]
    near = lambda a, b, r: any(x < y <= x + r for x in a for y in b)
    conditional = [i for i, f in enumerate(flags) if TAGS["BRANCH_CONDITIONAL"](f)]
    tests = (
        ("requires_dependent_load", near(loads, loads, 5), "dependent_load", True), ("requires_branch_then_memory", near(conditional, has("accesses_memory"), 6), "branch_then_memory", True), ("requires_indirect_branch", has("is_indirect"), "indirect_branch", False),
        ("requires_branch_target_computed", any(TAGS["INDIRECT_BRANCH"](f) for f in flags), "branch_target_computed", True), ("requires_privileged_access", has("is_privileged"), "privileged_access", False), ("requires_memory_access", has("accesses_memory"), "memory_access", False),
        ("min_branch_count", len(has("is_branch")) >= c.get("min_branch_count", 0), "min_branch_count", False), ("requires_return_instruction", has("is_return"), "return_instruction", False), ("requires_call_or_indirect_call", has("is_call"), "call_or_indirect_call", False),
        ("min_memory_ops", len(has("accesses_memory")) >= c.get("min_memory_ops", 0), "min_memory_ops", False), ("requires_store_then_load", near(has("is_store"), loads, 5), "store_then_load", True),
        ("requires_exception_or_fault_context", any(t in raw for t in ("brk", "hvc", "svc", "ud2", "int")), "exception_or_fault", True),
    )
    met = []
    for key, ok, missing, evidence in tests:
        if c.get(key):
            if not ok:
                return "property_constraints_failed", missing, seen
            met += [f"{missing}=true"] if evidence else []
    return None, None, seen + met


def listings(spark):
    rows = rules.tagged(code(spark, SF)).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["seq"], r["pos"])):
        out.setdefault((r["seq"], r["arch"]), []).append(r)
    return out


def test_every_window_and_type_is_as_read(spark):
    known, want = rules.read_rules(rules.RULES), {}
    for (seq, arch), lines in listings(spark).items():
        for size in rules.SIZES:
            for lo in range(len(lines) - size + 1):
                for name, rule in known.items():
                    want[seq, lo, size, name] = plain(lines[lo : lo + size], arch, rule)
    found = rules.windows(rules.tagged(code(spark, SF)), block=7)  # blocks shorter than windows too
    got = {(r["seq"], r["lo"], r["size"], r["type"]): (r["reason"], r["missing"], r["evidence"]) for r in rules.validated(found).collect()}
    assert got == want
    assert {r[0] for r in want.values()} == {None, "anti_pattern_triggered", "sequence_constraints_failed", "max_distance_exceeded", "property_constraints_failed"}


def walk(lines, arch, rule):
    """The greedy walk from both ends."""
    fits = lambda a, b: plain(lines[a:b], arch, rule)[0] is None
    left, right = 0, len(lines)
    while left < right and fits(left + 1, right):
        left += 1
    while right > left and fits(left, right - 1):
        right -= 1
    return left, right


def test_minimal_windows_are_the_greedy_walk(spark):
    known, want = rules.read_rules(rules.RULES), {}
    for (seq, arch), lines in listings(spark).items():
        for lo in range(len(lines) - 9):
            part = lines[lo : lo + 10]
            for name, rule in known.items():
                if plain(part, arch, rule)[0] is None and (ends := walk(part, arch, rule))[0] < ends[1]:
                    want[seq, lo, name] = ends
    got = {(r["seq"], r["lo"], r["type"]): (r["left"], r["right"]) for r in catalog.QUERIES["rule_minimal"](spark, SF).collect()}
    assert got == want and len({e for e in want.values()}) > 10


def test_samples_and_negatives(spark):
    found = rules.windows(rules.tagged(code(spark, SF)), (8,))
    every = {tuple(r) for r in rules.negatives(found, cap=None).collect()}
    rule = rules.read_rules(rules.RULES)["SPECTRE_V1"]
    want = set()
    for (seq, arch), lines in listings(spark).items():
        for lo in range(len(lines) - 7):
            part = [x["f"] for x in lines[lo : lo + 8]]
            conditional, memory, loads = ([i for i, f in enumerate(part) if t(f)] for t in (TAGS["BRANCH_CONDITIONAL"], lambda f: f["accesses_memory"], TAGS["MEMORY_LOAD"]))
            if (any(a < b <= a + 12 for a in conditional for b in memory) or any(a < b <= a + 8 for a in loads for b in loads)) and plain(lines[lo : lo + 8], arch, rule)[0] is not None:
                want.add((seq, lo, 8))
    assert every == want and len(want) > 20
    few = {tuple(r) for r in rules.negatives(found, cap=20).collect()}
    assert len(few) == 20 and few < every
    labels = {r["label"]: r["n"] for r in rules.samples(found, cap=20).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert labels.pop("SAFE") == 20 and labels


def test_documents_are_checked_and_other_ones_work(spark):
    for bad in ({"constraints": {"requires_magic": True}}, {"constraints": {"sequence": [{"semantic": "JUMP"}]}}, {"anti_patterns": [{"arch": "arm64"}]}):
        with pytest.raises(ValueError):
            rules.read_rules({"vulnerabilities": {"X": bad}})
    text = '{"vulnerabilities": {"ANY": {}, "NONE": {"anti_patterns": [{"token": "R"}]}, "LONG": {"constraints": {"sequence": [{"semantic": "RETURN", "within": 0}], "max_distance": 2}}}}'
    rows = spark.createDataFrame([(2, 0, "ret"), (2, 1, None), (2, 2, "add x0, x0, x1"), (4, 0, "nop")], "seq int, pos int, line string")
    got = {(r["lo"], r["size"], r["type"]): (r["reason"], r["evidence"]) for r in rules.validated(rules.windows(rules.tagged(rows), (2, 3)), text, ("ANY", "NONE", "LONG", "OTHER")).collect()}
    assert got[0, 2, "ANY"] == (None, []) and got[0, 2, "NONE"] == ("anti_pattern_triggered", []) and got[0, 2, "LONG"] == (None, ["seq_0_RETURN=0"])
    assert got[0, 3, "LONG"] == ("max_distance_exceeded", ["seq_0_RETURN=0"]) and got[1, 2, "LONG"] == ("sequence_constraints_failed", []) and got[1, 2, "OTHER"] == ("unknown_vuln_type", [])
    assert len(got) == 12  # a listing of one line has no window
    assert rules.validated(rules.windows(rules.tagged(rows.where("false")), (2,)), text).count() == 0


def test_windows_over_blocks_are_whole(spark):
    rng = random.Random(2)
    rows = [(s, p, f"op{rng.randrange(9)} x") for s, n in ((1, 0), (2, 3), (3, 130)) for p in range(n)]
    df = rules.tagged(spark.createDataFrame(rows, "seq int, pos int, line string"))
    for block in (4, 64):
        got = {(r["seq"], r["lo"], r["size"]): [x["pos"] for x in r["w"]] for r in rules.windows(df, (3, 20), block).collect()}
        assert got == {(s, lo, size): list(range(lo, lo + size)) for s, n in ((2, 3), (3, 130)) for size in (3, 20) for lo in range(n - size + 1)}


def test_windows_of_numbers_need_no_lists_and_tokens_may_span_lines(spark):
    rows = spark.createDataFrame([(2, i, line) for i, line in enumerate(["dsb", "sy x0", "ldr x1, [x0]", "dsb sy", "ret"])], "seq int, pos int, line string")
    text = '{"vulnerabilities": {"A": {"anti_patterns": [{"token": "DSB sy"}]}, "B": {"constraints": {"min_memory_ops": 1}}}}'
    found = rules.windows(rules.tagged(rows), (2, 3), document=text)
    got = {(r["lo"], r["size"], r["type"]): r["reason"] for r in rules.validated(found, text).collect()}
    assert {k[:2] for k, v in got.items() if k[2] == "A" and v} == {(0, 2), (2, 2), (3, 2), (0, 3), (1, 3), (2, 3)}
    plain = rules.validated(found.select("seq", "arch", "lo", "size", "w"), text)  # marks from the lists of lines
    assert {(r["lo"], r["size"], r["type"]): r["reason"] for r in plain.collect()} == got
    kept = rules.minimal(found, text).collect()
    assert {(r["lo"], r["size"], r["left"], r["right"]) for r in kept if r["type"] == "B"} == {(1, 2, 1, 2), (2, 2, 0, 1), (0, 3, 2, 3), (1, 3, 1, 2), (2, 3, 0, 1)}
    for query in ("rule_failures", "rule_minimal"):
        plan = catalog.QUERIES[query](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "ExistingRDD" not in plan  # no lists of lines, no windows written
    with pytest.raises(ValueError):
        rules.windows(rules.tagged(rows), (64,))
