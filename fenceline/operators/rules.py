"""Gadget rules as data: a document of vulnerability types with constraints and anti-patterns, compiled to one plan over windows of real lines.

A type has ``constraints``: an ordered ``sequence`` of ``{"semantic": ..., "within": ...}``, a ``max_distance`` and properties such as
``requires_dependent_load`` or ``min_memory_ops``; and ``anti_patterns`` of an ``opcode`` or a ``token``, for one ``arch`` or all. ``compile_rules`` reads
a document, rejects what it doesn't know, and gives one column: for each type whether a window matches, else the first failing
reason (anti-pattern, sequence or length, property) and which property, and the evidence: where each element of the sequence was found, earliest first, and
what properties were met.

A window is looked at as numbers: for each mark of a line (a tag, an opcode or token of an anti-pattern) one whose bits are the window's places. They are
made once for a block of lines, by ``bit_or``, and a window's are those of its block, shifted and cut; so sizes, starts and cuts multiply no lists, and rules are
operations on bits. Lists of lines are made only where something reads them. Blocks follow from the numbering of a listing's lines, so they need no shuffle of their own.

Defined results: a null line is an empty one, without semantics; a type without constraints matches every window that no anti-pattern
is in; unknown types have the reason ``unknown_vuln_type``; ``max_distance`` bounds a window's length and is looked at once its sequence is found, so it means nothing
without one; listings shorter than a window have none. A window has ``LONGEST`` lines at most; longer ones are an error.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.functions import instructions, nodes
from fenceline.plans.assembly_analog import CODE, code

BLOCK, SIZES, CAP = 64, (5, 8, 10, 15, 20), 20_000
#: Places in a number.
LONGEST = 63
KEY = ("seq", "lo", "size")
# Reach of a dependent load, of memory after a branch, of a load after a store; tokens of a fault; the nearness of hard negatives.
LOAD_REACH, BRANCH_REACH, STORE_REACH = 5, 6, 5
FAULT_TOKENS = ("brk", "hvc", "svc", "ud2", "int")
NEGATIVE_BRANCH, NEGATIVE_LOAD = 12, 8
#: The semantics of a sequence's elements, by the tag that they need.
SEMANTICS = {"COMPARISON": "comparison", "BRANCH_CONDITIONAL": "conditional", "MEMORY_LOAD": "load", "INDIRECT_BRANCH": "computed", "RETURN": "return"}
TAGS = {
    "comparison": lambda f: f["is_comparison"], "conditional": lambda f: f["is_branch"] & f["is_conditional"], "load": lambda f: f["is_load"] | (f["accesses_memory"] & ~f["is_store"]), "computed": lambda f: f["is_branch"] & f["is_indirect"],
    "return": lambda f: f["is_return"], "store": lambda f: f["is_store"], "memory": lambda f: f["accesses_memory"], "branch": lambda f: f["is_branch"], "call": lambda f: f["is_call"], "indirect": lambda f: f["is_indirect"], "privileged": lambda f: f["is_privileged"],
}

#: Defaults of our own, in the shape of a rule document.
RULES = {
    "vulnerabilities": {
        "SPECTRE_V1": {
            "constraints": {"sequence": [{"semantic": "COMPARISON"}, {"semantic": "BRANCH_CONDITIONAL", "within": 4}, {"semantic": "MEMORY_LOAD", "within": 6}], "max_distance": 15, "requires_branch_then_memory": True},
            "anti_patterns": [{"arch": "x86_64", "opcode": "lfence"}, {"arch": "arm64", "token": "CSDB"}],
        },
        "SPECTRE_V2": {"constraints": {"sequence": [{"semantic": "INDIRECT_BRANCH", "within": 12}], "requires_branch_target_computed": True, "requires_memory_access": True}},
        "SPECTRE_V4": {"constraints": {"requires_store_then_load": True, "min_memory_ops": 2}, "anti_patterns": [{"arch": "arm64", "opcode": "dsb"}, {"token": "mfence"}]},
        "MELTDOWN": {"constraints": {"requires_exception_or_fault_context": True, "requires_memory_access": True, "max_distance": 10}},
        "L1TF": {"constraints": {"requires_privileged_access": True, "requires_dependent_load": True}},
        "BHI": {"constraints": {"min_branch_count": 3, "requires_branch_then_memory": True, "requires_indirect_branch": True}},
        "RETBLEED": {"constraints": {"requires_return_instruction": True, "requires_call_or_indirect_call": True, "max_distance": 15}},
        "INCEPTION": {"constraints": {"sequence": [{"semantic": "RETURN", "within": 8}, {"semantic": "MEMORY_LOAD"}], "min_branch_count": 1}},
    }
}


def tagged(rows: DataFrame) -> DataFrame:
    """(seq, pos, arch, op, line, f) of a listing's code lines."""
    line = F.coalesce("line", F.lit(""))
    arch = F.when(F.col("seq") % 2 == 0, "arm64").otherwise("x86_64")
    lines = rows.select("seq", "pos", arch.alias("arch"), instructions.opcode(line).alias("op"), F.lower(line).alias("line"), F.regexp_extract(line, r"^\s*\S+\s+(.*)$", 1).alias("rest"))
    return lines.select("seq", "pos", "arch", "op", "line", nodes.semantics(F.col("op"), F.col("rest"), F.col("arch")).alias("f"))


def marks(document: str | Mapping[str, Any] = RULES) -> dict[str, tuple[str, Any, int]]:
    """Column name -> (kind, value, span) of what a document's rules look for in a line and the ``span`` lines after it: tags, tokens of a fault, opcodes and tokens of anti-patterns.

    A token with blanks may begin in one line and end in a later one, so it has a mark for each span.
    """
    found = {f"m_{t}": ("tag", t, 0) for t in TAGS} | {"m_fault": ("fault", FAULT_TOKENS, 0)}
    for rule in read_rules(document).values():
        for a in rule["anti_patterns"]:
            if "opcode" in a:
                found[_name("op", a["opcode"])] = ("op", a["opcode"], 0)
            if "token" in a:
                found |= {_name("token", a["token"], j): ("token", a["token"].lower(), j) for j in range(a["token"].count(" ") + 1)}
    return found


def _name(kind: str, value: str, span: int = 0) -> str:
    return f"m_{kind}{span}_{(value.lower() if kind == 'token' else value).encode().hex()}"


def _holds(mark: tuple[str, Any, int], op: Column, f: Column, text: Column) -> Column:
    """Whether a line has a mark; ``text`` is the line's with as many after it as the mark's span."""
    kind, value, _ = mark
    if kind == "tag":
        return TAGS[value](f)
    return op == value if kind == "op" else text.rlike("|".join(value)) if kind == "fault" else F.contains(text, F.lit(value))


def _left(value: int | Column, n: int | Column) -> Column:
    return F.call_function("shiftleft", F.lit(value).cast("long"), n if isinstance(n, Column) else F.lit(n))


def _lowest(n: int | Column) -> Column:
    """The number whose ``n`` lowest bits are set."""
    return F.bitwise_not(_left(-1, n))


def _from(bits: str | Column, n: int | Column) -> Column:
    """``bits`` from place ``n`` on."""
    return F.call_function("shiftrightunsigned", F.col(bits) if isinstance(bits, str) else bits, n if isinstance(n, Column) else F.lit(n))


def windows(rows: DataFrame, sizes: tuple[int, ...] = SIZES, block: int = BLOCK, document: str | Mapping[str, Any] = RULES) -> DataFrame:
    """(seq, arch, lo, size, w, <marks of the document>): all windows of the sizes, ``w`` the array of their lines; ``rows`` are numbered from 0 without gaps."""
    reach = max(sizes) - 1
    if reach >= LONGEST:
        raise ValueError(f"windows of at most {LONGEST} lines")
    block, known = min(block, LONGEST - reach), marks(document)
    after = Window.partitionBy("seq").orderBy("pos")
    spans = max(span for _, _, span in known.values())
    text = lambda span: f"line{span}" if span else "line"
    rows = rows.withColumns({text(j): reduce(lambda a, b: F.concat(a, F.lit(" "), b), (F.lead("line", k).over(after) for k in range(1, j + 1)), F.col("line")) for j in range(1, spans + 1)})
    own = F.floor(F.col("pos") / block)
    into = F.array_distinct(F.array_compact(F.array(own, *(F.when((F.col("pos") - k * block >= 0) & (F.col("pos") % block < reach - (k - 1) * block), own - k) for k in range(1, reach // block + 2)))))
    # a line's marks are bits of few numbers, below the explode, so that they are tested once
    names, holds = list(known), [F.coalesce(_holds(m, F.col("op"), F.col("f"), F.col(text(m[2]))), F.lit(False)) for m in known.values()]
    packed = [reduce(lambda a, b: a + b, (F.when(test, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, test in enumerate(holds[k : k + LONGEST - 1]))) for k in range(0, len(holds), LONGEST - 1)]
    rows = rows.select("seq", "arch", "pos", "op", "line", "f", *(c.alias(f"bits{k}") for k, c in enumerate(packed)))
    each = rows.select("seq", "arch", "pos", "op", "line", "f", *(f"bits{k}" for k in range(len(packed))), F.explode(into).alias("block"))
    bit = lambda i: _from(f"bits{i // (LONGEST - 1)}", i % (LONGEST - 1)).bitwiseAND(F.lit(1))
    place = (F.col("pos") - F.col("block") * block).cast("int")
    shifted = [F.bit_or(F.call_function("shiftleft", bit(i), place)).alias(name) for i, name in enumerate(names)]
    blocks = each.groupBy("seq", "arch", "block").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "op", "line", "f"))).alias("lines"), *shifted)
    starts = blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.lit(block), F.col("n")) - 1))).withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("k + size <= n")
    cut = [_from(name, F.col("k")).bitwiseAND(_lowest(F.col("size"))).alias(name) for name in names]
    return starts.select("seq", "arch", (F.col("block") * block + F.col("k")).alias("lo"), "size", F.slice("lines", F.col("k") + 1, F.col("size")).alias("w"), *cut)


def marked(found: DataFrame, document: str | Mapping[str, Any] = RULES) -> DataFrame:
    """(seq, arch, lo, size, <marks>) of ``windows``: those that it was not made with are found in its lists of lines."""

    def of_list(mark: tuple[str, Any, int]) -> Column:
        span = mark[2]
        text = lambda i: F.array_join(F.transform(F.slice("w", i + 1, span + 1), lambda x: x["line"]), " ")
        here = F.transform("w", lambda x, i: F.when((i + span < F.size("w")) & _holds(mark, x["op"], x["f"], text(i)), _left(1, i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(here, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    known = marks(document)
    return found.withColumns({n: of_list(m) for n, m in known.items() if n not in found.columns}).select("seq", "arch", "lo", "size", *known)


def _part(rows: DataFrame, names: list[str], left: Column, right: Column) -> DataFrame:
    """``rows`` with the marks of a part of each window alone, and its size."""
    return rows.withColumns({n: _from(n, left).bitwiseAND(_lowest(right - left)) for n in names} | {"size": right - left})


def _near(first: str, then: str, reach: int) -> Column:
    later = reduce(lambda a, b: a.bitwiseOR(b), (_from(f"m_{then}", k) for k in range(1, min(reach, LONGEST - 1) + 1)))
    return F.col(f"m_{first}").bitwiseAND(later) != 0


def _any(tag: str) -> Column:
    return F.col(f"m_{tag}") != 0


#: Properties in the order of their tests: (name, test by value, what is missing, evidence or None).
PROPERTIES = (
    ("requires_dependent_load", lambda v: _near("load", "load", LOAD_REACH), "dependent_load", "dependent_load"), ("requires_branch_then_memory", lambda v: _near("conditional", "memory", BRANCH_REACH), "branch_then_memory", "branch_then_memory"),
    ("requires_indirect_branch", lambda v: _any("indirect"), "indirect_branch", None), ("requires_branch_target_computed", lambda v: _any("computed"), "branch_target_computed", "branch_target_computed"),
    ("requires_privileged_access", lambda v: _any("privileged"), "privileged_access", None), ("requires_memory_access", lambda v: _any("memory"), "memory_access", None), ("min_branch_count", lambda v: F.bit_count("m_branch") >= v, "min_branch_count", None),
    ("requires_return_instruction", lambda v: _any("return"), "return_instruction", None), ("requires_call_or_indirect_call", lambda v: _any("call"), "call_or_indirect_call", None), ("min_memory_ops", lambda v: F.bit_count("m_memory") >= v, "min_memory_ops", None),
    ("requires_store_then_load", lambda v: _near("store", "load", STORE_REACH), "store_then_load", "store_then_load"), ("requires_exception_or_fault_context", lambda v: _any("fault"), "exception_or_fault", "exception_or_fault"),
)
_KNOWN = {p[0] for p in PROPERTIES} | {"sequence", "max_distance"}


def read_rules(text: str | Mapping[str, Any]) -> dict[str, dict]:
    """The types of a rule document; a constraint, semantic or anti-pattern that isn't known is an error, not a rule that always matches."""
    document = json.loads(text) if isinstance(text, str) else text
    found = {}
    for name, spec in document.get("vulnerabilities", {}).items():
        constraints, anti = spec.get("constraints", {}), spec.get("anti_patterns", [])
        if odd := set(constraints) - _KNOWN:
            raise ValueError(f"{name} has constraints that aren't known: {sorted(odd)}")
        if odd := [s for s in constraints.get("sequence", []) if s.get("semantic") not in SEMANTICS]:
            raise ValueError(f"{name} has sequence elements that aren't known: {odd}")
        if odd := [a for a in anti if not {"opcode", "token"} & set(a)]:
            raise ValueError(f"{name} has anti-patterns without opcode or token: {odd}")
        found[name] = {"constraints": constraints, "anti_patterns": anti}
    return found


def placed(rows: DataFrame, known: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Rows of ``marked`` with ``p<type>_<element>``, the places of the sequences' elements, greedily the earliest ones; null from the first on that isn't there."""
    steps = [rule["constraints"].get("sequence") or [] for rule in known.values()]
    for i in range(max(map(len, steps), default=0)):
        own = {t: s[i] for t, s in enumerate(steps) if len(s) > i}

        def later(t: int, s: Mapping[str, Any], i: int = i) -> Column:
            bits, start = F.col(f"m_{SEMANTICS[s['semantic']]}"), F.col(f"p{t}_{i - 1}") + 1 if i else F.lit(0)
            bits = bits.bitwiseAND(_left(-1, start))
            return bits if s.get("within") is None else bits.bitwiseAND(_lowest(F.least(F.lit(LONGEST), start + 1 + int(s["within"]))))

        rows = rows.withColumns({f"b{t}_{i}": later(t, s) for t, s in own.items()})
        rows = rows.withColumns({f"p{t}_{i}": F.when(F.col(f"b{t}_{i}") != 0, F.bit_count(F.bitwise_not(f"b{t}_{i}").bitwiseAND(F.col(f"b{t}_{i}") - 1))) for t in own})
    return rows


def _tests(t: int, rule: Mapping[str, Any]) -> tuple[Column, Column, Column, Column]:
    """Of a type over rows of ``placed``: whether an anti-pattern is there, a sequence isn't, the window is too long, and the first missing property or null."""
    constraints, anti = rule["constraints"], F.lit(False)
    for a in rule["anti_patterns"]:
        here = F.lit(False)
        if "opcode" in a:
            here = here | (F.col(_name("op", a["opcode"])) != 0)
        if "token" in a:
            for j in range(a["token"].count(" ") + 1):
                here = here | (F.col(_name("token", a["token"], j)).bitwiseAND(_lowest(F.greatest(F.lit(0), F.col("size") - j))) != 0)
        anti = anti | (here & (F.col("arch") == a["arch"]) if a.get("arch") else here)
    steps = constraints.get("sequence") or []
    failed = F.col(f"p{t}_{len(steps) - 1}").isNull() if steps else F.lit(False)
    long = F.col("size") > constraints["max_distance"] if steps and constraints.get("max_distance") is not None else F.lit(False)  # tested with a sequence only
    wanted = [(test(constraints[key]), missing) for key, test, missing, _ in PROPERTIES if constraints.get(key)]
    missing = F.coalesce(*(F.when(~test, F.lit(m)) for test, m in wanted)) if wanted else F.lit(None).cast("string")
    return anti, failed, long, missing


def _fits(t: int, rule: Mapping[str, Any]) -> Column:
    anti, failed, long, missing = _tests(t, rule)
    return ~anti & ~failed & ~long & missing.isNull()


def judged(rows: DataFrame, known: Mapping[str, Mapping[str, Any]]) -> tuple[DataFrame, dict[str, Column]]:
    """Rows of ``marked`` with what the verdicts need, and a type's verdict: a struct (type, reason, missing, evidence); the reason is null where it matches."""
    rows, said, none = placed(rows, known), {}, F.array().cast("array<string>")
    tests = {t: _tests(t, rule) for t, rule in enumerate(known.values())}
    rows = rows.withColumns({f"missing{t}": missing for t, (*_, missing) in tests.items()})
    reason = lambda t, anti, failed, long: F.when(anti, "anti_pattern_triggered").when(failed, "sequence_constraints_failed").when(long, "max_distance_exceeded").when(F.col(f"missing{t}").isNotNull(), "property_constraints_failed")
    rows = rows.withColumns({f"reason{t}": reason(t, *own) for t, (*own, _) in tests.items()})
    for t, (name, rule) in enumerate(known.items()):
        constraints, steps = rule["constraints"], rule["constraints"].get("sequence") or []
        seen = F.array_compact(F.array(*(F.concat(F.lit(f"seq_{i}_{s['semantic']}="), F.col(f"p{t}_{i}").cast("string")) for i, s in enumerate(steps)))) if steps else none
        met = [F.lit(f"{evidence}=true") for key, _, _, evidence in PROPERTIES if constraints.get(key) and evidence]
        why = F.col(f"reason{t}")
        evidence = F.when(why == "anti_pattern_triggered", none).when(why.isNull(), F.concat(seen, F.array(*met)) if met else seen).otherwise(seen)
        said[name] = F.struct(F.lit(name).alias("type"), why.alias("reason"), F.when(why == "property_constraints_failed", F.col(f"missing{t}")).alias("missing"), evidence.alias("evidence"))
    return rows, said


def validated(found: DataFrame, document: str | Mapping[str, Any] = RULES, types: tuple[str, ...] | None = None) -> DataFrame:
    """(seq, arch, lo, size, type, reason, missing, evidence): every window under every type of the document, or of ``types``, which it may not have."""
    rows, said = judged(marked(found, document), read_rules(document))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    unknown = lambda name: F.struct(F.lit(name).alias("type"), F.lit("unknown_vuln_type").alias("reason"), none.alias("missing"), empty.alias("evidence"))
    each = rows.select("seq", "arch", "lo", "size", F.explode(F.array(*(said[n] if n in said else unknown(n) for n in types or said))).alias("v"))
    return each.select("seq", "arch", "lo", "size", "v.type", "v.reason", "v.missing", "v.evidence")


def minimal(found: DataFrame, document: str | Mapping[str, Any] = RULES) -> DataFrame:
    """(seq, arch, lo, size, type, left, right): for matching windows the greedy shortest part [left, right) that still matches, cut from the left first.

    Every cut that the walk could try is a row of numbers: first all from the left, then, with that end fixed, all from the right. Parts without a line are left out.
    """
    known, names, keys = read_rules(document), list(marks(document)), ("seq", "arch", "lo", "n", "t")
    whole = [f"whole_{n}" for n in names]

    def fits(cuts: DataFrame) -> DataFrame:
        """The cuts (..., left, right) with ``ok``, whether the part still matches the type."""
        part = _part(cuts.withColumns(dict(zip(names, map(F.col, whole), strict=True))), names, F.col("left"), F.col("right"))
        return placed(part, known).select(*keys, "left", "right", *whole, F.coalesce(*(F.when(F.col("t") == t, _fits(t, rule)) for t, rule in enumerate(known.values()))).alias("ok"))

    rows = placed(marked(found, document), known)
    types = F.array_compact(F.array(*(F.when(_fits(t, rule), F.lit(t)) for t, rule in enumerate(known.values())))) if known else F.array().cast("array<int>")
    yes = rows.withColumn("t", F.explode(types)).select("seq", "arch", "lo", F.col("size").alias("n"), "t", *(F.col(n).alias(w) for n, w in zip(names, whole, strict=True)))
    kept = [F.max(w).alias(w) for w in whole]  # the same in all cuts of a window
    lefts = fits(yes.withColumn("left", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("right", F.col("n"))) if known else yes.withColumns({"left": F.col("n"), "right": F.col("n"), "ok": F.lit(True)})
    ends = lefts.groupBy(*keys).agg(F.coalesce(F.min(F.when(~F.col("ok"), F.col("left"))) - 1, F.col("n")).alias("left"), *kept).where("left < n")
    rights = fits(ends.withColumn("right", F.explode(F.sequence(F.col("n") - 1, F.col("left"))))) if known else ends.withColumns({"right": F.col("n"), "ok": F.lit(True)})
    right = rights.groupBy(*keys, "left").agg(F.coalesce(F.max(F.when(~F.col("ok"), F.col("right"))) + 1, F.col("left")).alias("right")).where("left < right")
    label = F.get(F.array(*map(F.lit, known)) if known else F.array().cast("array<string>"), F.col("t"))
    return right.select("seq", "arch", "lo", F.col("n").alias("size"), label.alias("type"), "left", "right")


def negatives(found: DataFrame, document: str | Mapping[str, Any] = RULES, against: str = "SPECTRE_V1", cap: int | None = CAP) -> DataFrame:
    """(seq, lo, size): windows that look like a gadget, memory within 12 of a conditional branch or loads within 8, yet fail ``against``; with ``cap`` the first ones by md5."""
    rule = read_rules(document)[against]
    like = _near("conditional", "memory", NEGATIVE_BRANCH) | _near("load", "load", NEGATIVE_LOAD)
    rows = placed(marked(found, document), {against: rule}).where(like & ~_fits(0, rule)).select(*KEY)
    return rows if cap is None else rows.orderBy(F.md5(F.concat_ws("|", F.lit("42"), *KEY)), *KEY).limit(cap)


def samples(found: DataFrame, document: str | Mapping[str, Any] = RULES, cap: int | None = CAP) -> DataFrame:
    """(seq, lo, size, label): the minimal parts of all matching windows with their type, and hard negatives as SAFE."""
    positive = minimal(found, document).select("seq", (F.col("lo") + F.col("left")).alias("lo"), (F.col("right") - F.col("left")).alias("size"), F.col("type").alias("label"))
    return positive.unionByName(negatives(found, document, cap=cap).select("seq", "lo", "size", F.lit("SAFE").alias("label")))


def _windows(s, d, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    return windows(tagged(code(s, d)), sizes)


QUERIES = {
    "rule_matches": lambda s, d: validated(_windows(s, d)).where("reason IS NULL").select(*KEY, "type", F.array_join("evidence", ";").alias("evidence")),
    "rule_failures": lambda s, d: validated(_windows(s, d)).where("reason IS NOT NULL").groupBy("type", "reason", F.coalesce("missing", F.lit("")).alias("missing")).agg(F.count("*").alias("n"), F.sum(F.size("evidence")).alias("found")),
    "rule_minimal": lambda s, d: minimal(_windows(s, d, (10,))).select(*KEY, "type", "left", "right"),
    "rule_samples": lambda s, d: samples(_windows(s, d, (8,))).groupBy("label", "size").agg(F.count("*").alias("n")),
}


def _head(sizes: tuple[int, ...] = SIZES) -> str:
    """``x``: the lines of every window (seq, lo, size, k, op, line, the tags), and ``p``: a row a window with the lists of places."""
    from fenceline.operators.listings import _OP, _REST, _semantics_sql

    n = {name: f"flags[{k + 1}] = '1'" for k, name in enumerate(nodes.SEMANTICS)}
    tags = {
        "comparison": n["is_comparison"], "conditional": f"{n['is_branch']} AND {n['is_conditional']}", "load": f"{n['is_load']} OR ({n['accesses_memory']} AND NOT {n['is_store']})", "computed": f"{n['is_branch']} AND {n['is_indirect']}", "return": n["is_return"],
        "store": n["is_store"], "memory": n["accesses_memory"], "branch": n["is_branch"], "call": n["is_call"], "indirect": n["is_indirect"], "privileged": n["is_privileged"],
    }
    lists = ", ".join(f"coalesce(list(k ORDER BY k) FILTER ({test}), []) AS at_{t}" for t, test in tags.items())
    return rf"""WITH {CODE}, ol AS (SELECT seq, pos, lower(line) AS line, {_OP} AS op, {_REST} AS rest FROM co), fl AS (SELECT *, {_semantics_sql()} AS flags FROM ol),
      tt AS (SELECT seq, count(*) AS total FROM co GROUP BY seq), ww AS (SELECT seq, size, unnest(range(0, total - size + 1)) AS lo FROM tt, (SELECT unnest({list(sizes)}) AS size) WHERE total >= size),
      p AS (SELECT ww.seq, lo, size, string_agg(line, ' ' ORDER BY pos) AS raw, list(op) AS ops, {lists} FROM (SELECT ww.*, fl.*, pos - lo AS k FROM ww JOIN fl ON fl.seq = ww.seq AND pos >= lo AND pos < lo + size) ww GROUP BY ww.seq, lo, size)"""


_SQL_NEAR = lambda a, b, r: f"len(list_filter(at_{a}, lambda x: len(list_filter(at_{b}, lambda y: y > x AND y <= x + {r})) > 0)) > 0"
_SQL_PROPERTIES = {
    "requires_dependent_load": lambda v: _SQL_NEAR("load", "load", 5), "requires_branch_then_memory": lambda v: _SQL_NEAR("conditional", "memory", 6), "requires_indirect_branch": lambda v: "len(at_indirect) > 0", "requires_branch_target_computed": lambda v: "len(at_computed) > 0",
    "requires_privileged_access": lambda v: "len(at_privileged) > 0", "requires_memory_access": lambda v: "len(at_memory) > 0", "min_branch_count": lambda v: f"len(at_branch) >= {v}", "requires_return_instruction": lambda v: "len(at_return) > 0",
    "requires_call_or_indirect_call": lambda v: "len(at_call) > 0", "min_memory_ops": lambda v: f"len(at_memory) >= {v}", "requires_store_then_load": lambda v: _SQL_NEAR("store", "load", 5), "requires_exception_or_fault_context": lambda v: "regexp_matches(raw, 'brk|hvc|svc|ud2|int')",
}


def _type_sql(name: str, source: str = "p") -> str:
    """(seq, lo, size, type, reason, missing, evidence) of one type, its sequence step by step."""
    rule = RULES["vulnerabilities"][name]
    constraints, steps = rule["constraints"], rule["constraints"].get("sequence", [])
    inner = f"SELECT *, -1 AS s0 FROM {source}"
    for i, s in enumerate(steps):
        end = f" AND x <= s{i} + 1 + {s['within']}" if s.get("within") is not None else ""
        inner = f"SELECT *, list_min(list_filter(at_{SEMANTICS[s['semantic']]}, lambda x: x > s{i}{end})) AS s{i + 1} FROM ({inner})"
    anti = []
    for a in rule.get("anti_patterns", []):
        test = f"list_contains(ops, '{a['opcode']}')" if "opcode" in a else f"contains(raw, '{a['token'].lower()}')"
        anti.append(f"({test}" + (f" AND seq % 2 = {0 if a['arch'] == 'arm64' else 1})" if a.get("arch") else ")"))
    anti = " OR ".join(anti) or "false"
    wanted = [(p, _SQL_PROPERTIES[p[0]](constraints[p[0]])) for p in PROPERTIES if constraints.get(p[0])]
    missing = "CASE " + " ".join(f"WHEN NOT ({test}) THEN '{p[2]}'" for p, test in wanted) + " END" if wanted else "NULL"
    failed = f"s{len(steps)} IS NULL" if steps else "false"
    long = f"size > {constraints['max_distance']}" if steps and "max_distance" in constraints else "false"
    seen = ", ".join(f"'seq_{i}_{s['semantic']}=' || s{i + 1}" for i, s in enumerate(steps))
    met = ", ".join(f"'{p[3]}=true'" for p, _ in wanted if p[3])
    return f"""SELECT seq, lo, size, '{name}' AS type, reason, CASE WHEN reason = 'property_constraints_failed' THEN missing ELSE '' END AS missing,
      CASE WHEN reason = 'anti_pattern_triggered' THEN [] WHEN reason IS NULL THEN list_concat(seen, [{met}]::VARCHAR[]) ELSE seen END AS evidence FROM (SELECT *, CASE WHEN {anti} THEN 'anti_pattern_triggered' WHEN {failed} THEN 'sequence_constraints_failed' WHEN {long} THEN 'max_distance_exceeded' WHEN missing IS NOT NULL THEN 'property_constraints_failed' END AS reason
      FROM (SELECT *, {missing} AS missing, list_filter([{seen}]::VARCHAR[], lambda x: x IS NOT NULL) AS seen FROM ({inner})))"""


def _verdicts(source: str = "p") -> str:
    return " UNION ALL ".join(_type_sql(name, source) for name in RULES["vulnerabilities"])


ORACLES = {
    "rule_matches": f"{_head()}, v AS ({_verdicts()}) SELECT seq, lo, size, type, array_to_string(evidence, ';') AS evidence FROM v WHERE reason IS NULL",
    "rule_failures": f"{_head()}, v AS ({_verdicts()}) SELECT type, reason, missing, count(*) AS n, sum(len(evidence))::BIGINT AS found FROM v WHERE reason IS NOT NULL GROUP BY ALL",
}
