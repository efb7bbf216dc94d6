"""Operators over lines of real assembly text: line columns, dependence graphs of windows, dependency and memory features.

Inputs are (seq, pos, line) listings or (seq, lo, i, line) windows of ``assembly_analog``; a graph's key is its window,
whose some tens of lines are one small group. Nothing runs in Python but the longest chain of a window's data graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.functions import fixed, instructions, nodes
from fenceline.operators import graph
from fenceline.operators.features import KEY, sigmoid
from fenceline.operators.subgraphs import per_window
from fenceline.plans.assembly_analog import CODE, LISTING, WINDOWS, code, code_windows, listing, windows, windows_sql
from fenceline.plans.steps import settled

NODE_LIMIT, EDGE_LIMIT = 64, 512


def line_columns(rows: DataFrame) -> DataFrame:
    """(seq, pos, ...): both normalizations, opcode, first word, operands, classes, semantic and structural type of each raw line."""
    line = F.col("line")
    a, b = instructions.normalized(line), instructions.normalized(line, cut_hash=True)
    op = instructions.opcode(a)
    rest = F.regexp_extract(a, r"^\s*\S+\s+(.*)$", 1)
    parts = F.when(rest == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(rest, ","), lambda x: F.trim(x)))
    flags = nodes.semantics(op, rest, F.when(F.col("seq") % 2 == 0, "arm64").otherwise("x86_64"))
    out = rows.select("seq", "pos", a.alias("plain"), b.alias("cut"), op.alias("op"), F.regexp_extract(a, r"([A-Za-z0-9_]+)", 1).alias("word"), parts.alias("parts"), flags.alias("flags")).where("plain <> ''")
    bits = F.concat(*(F.col(f"flags.{n}").cast("int").cast("string") for n in nodes.SEMANTICS))
    return out.select(
        "seq", "pos", "plain", "cut", "op", "word", F.array_join("parts", "|").alias("operands"), F.array_join(F.transform("parts", nodes.operand_class), "|").alias("classes"), nodes.canonical_opcode(F.col("op")).alias("canonical"),
        F.array_join(F.transform("parts", nodes.immediate_class), "|").alias("immediates"), nodes.semantic_type(F.col("op")).alias("semantic"), nodes.simple_type(F.col("op")).alias("simple"), bits.alias("flags"),
    )


def kept_lines(rows: DataFrame) -> DataFrame:
    """(seq, pos, line): the lines that the stricter filters keep: no blanks, directives, comments, labels or data, and none with ``@`` or ``//``."""
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    bad = (line == "") | line.rlike(r"^[.#;/]|:$") | line.rlike(r"\.(word|byte|ascii|long|quad|zero)") | line.contains("@") | line.contains("//")
    return rows.where(~bad).select("seq", "pos", F.regexp_replace(F.regexp_extract(line, "^[^;#@]*", 0), r"\s+$", "").alias("line"))


def graph_nodes(lines: DataFrame) -> DataFrame:
    """(seq, pos, category, dest, src, memory, flags) of windows; ``seq`` is the window's key, ``pos`` its line."""
    line = F.col("line")
    rows = lines.select(F.concat_ws(":", *KEY).alias("seq"), F.col("i").alias("pos"), "line", nodes.node_category(line).alias("category"), nodes.all_registers(line).alias("regs"), nodes.memory_type(line).alias("memory"))
    rows = rows.withColumn("dest", nodes.destinations(F.col("regs"), F.col("category"))).withColumn("src", nodes.sources(F.col("regs"), F.col("category")))
    return rows.withColumn("flags", nodes.spec_flags(line, F.col("category"), F.col("memory"))).drop("regs")


def graph_edges(rows: DataFrame) -> DataFrame:
    """(seq, src, dst, type, weight, reg): all eight kinds of edges of ``graph_nodes``; a data or memory edge for each register."""
    c, kind = F.col, F.col("category")
    rows = settled(rows.select("seq", "pos", "category", "dest", "src", "flags"))  # read by nine branches; its columns are some thirty patterns a line
    uses = rows.select("seq", "pos", F.explode("src").alias("reg"))
    data = graph.last_defs(rows.select("seq", "pos", F.explode("dest").alias("reg")), uses, 3)
    bases = rows.where(kind.isin("LOAD", "STORE")).select("seq", "pos", "category", F.explode(F.when(F.size("src") == 0, F.array(F.lit("_mem_"))).otherwise(c("src"))).alias("reg"))
    memory = graph.last_defs(bases.where(kind == "STORE"), bases.where(kind == "LOAD"), 2)
    fence = kind == "FENCE"
    source = F.when(kind == "BRANCH_COND", F.lit(2)).when(kind.isin("CALL_INDIRECT", "JUMP_INDIRECT"), F.lit(3)).when(kind == "RET", F.lit(4))
    flag = lambda n: c(f"flags.{n}")
    factor = F.when(flag("is_cache_probe") | flag("is_timing_source"), 2.5).when(flag("is_transmitter") | flag("is_secret_source"), 3.0).when(flag("is_memory_access"), 2.0).otherwise(1.0)
    relevant = flag("is_memory_access") | flag("is_secret_source") | flag("is_transmitter") | flag("is_cache_probe") | flag("is_timing_source")
    spec = graph.speculation(rows.select("seq", "pos", source.alias("source"), factor.alias("factor"), relevant.alias("relevant"), fence.alias("fence")))
    marked = rows.withColumn("op", kind)
    cache = graph.within(marked, kind == "CACHE", kind.isin("LOAD", "TIMING"), 5)
    after = graph.control(rows).join(rows.where(fence).select("seq", c("pos").alias("src")), ["seq", "src"], "left_semi")
    none = F.lit(None).cast("string").alias("reg")
    one = lambda df, t, w, reg=none: df.select("seq", "src", "dst", F.lit(t).alias("type"), F.lit(w).alias("weight"), reg)
    out = one(data, 0, 1.0, F.col("reg")).unionByName(one(graph.control(rows), 1, 1.0)).unionByName(spec.select("seq", "src", "dst", "type", "weight", none))
    return out.unionByName(one(memory, 5, 1.0, F.col("reg"))).unionByName(one(cache, 6, 1.5)).unionByName(one(after, 7, 1.0))


def coo(edges: DataFrame, node_limit: int = NODE_LIMIT, edge_limit: int = EDGE_LIMIT) -> DataFrame:
    """(seq, k, src, dst, type): a window's first edges in order of their target, then control, fence, data, speculation, memory, cache."""
    rank = F.element_at(F.array(*map(F.lit, (2, 0, 3, 3, 3, 4, 5, 1))), F.col("type") + 1)
    order = Window.partitionBy("seq").orderBy("dst", rank, "src", "type", "reg")
    few = edges.where((F.col("src") < node_limit) & (F.col("dst") < node_limit)).withColumn("k", F.row_number().over(order) - 1)
    return few.where(F.col("k") < edge_limit).select("seq", "k", "src", "dst", "type")


def vectors(rows: DataFrame) -> DataFrame:
    """(seq, pos, vector): 34 numbers of each node and its place, i / (n - 1), joined by commas."""
    last = F.greatest(F.count("*").over(Window.partitionBy("seq")) - 1, F.lit(1))
    numbers = nodes.vector(F.col("category"), F.col("memory"), F.col("dest"), F.col("src"), F.col("flags"))
    every = F.concat(numbers, F.array(F.col("pos") / last))
    return rows.select("seq", "pos", F.array_join(F.transform(every, lambda x: F.round(x, 4).cast("string")), ",").alias("vector"))


def _registers(text: Column) -> Column:
    """Distinct register names of a text, without ``%``."""
    every = F.concat(*(F.regexp_extract_all(text, F.lit("(?i)" + fixed.LINE_PATTERNS[k]), F.lit(1)) for k in ("reg_arm", "reg_x86")))
    return F.array_distinct(F.transform(every, lambda r: F.regexp_replace(F.lower(r), "%", "")))


def _operands(lines: DataFrame) -> DataFrame:
    rest = F.regexp_extract("line", r"^\s*\S+\s+(.*)$", 1)
    parts = F.when(rest == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(rest, ","), lambda x: F.trim(x)))
    return lines.select(*KEY, "i", "line", instructions.opcode(F.col("line")).alias("op"), parts.alias("parts"))


def def_uses(rows: DataFrame) -> DataFrame:
    """(seq, lo, i, kind, reg, at, def_kind): each use in ``rows`` (uses, defs, kind) with the latest definition before its line, where there is one."""
    each = lambda column, is_def: rows.select(*KEY, "i", "kind", F.lit(is_def).alias("is_def"), F.explode(column).alias("reg"))
    both = each("uses", 0).unionByName(each("defs", 1))
    before = Window.partitionBy(*KEY, "reg").orderBy("i", "is_def").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("is_def") == 1, F.struct(F.col("i").alias("at"), F.col("kind").alias("def_kind"))), ignorenulls=True).over(before)
    return both.withColumn("last", last).where("is_def = 0 AND last IS NOT NULL").select(*KEY, "i", "kind", "reg", "last.at", "last.def_kind")


def dependency_features(lines: DataFrame) -> DataFrame:
    """(seq, lo, dep_load_to_load, dep_arith_to_load, dep_avg_distance, dep_count): uses by their latest definition; -1 without any."""
    rows = _operands(lines).where((F.col("op") != "nop") & ~F.col("op").endswith(":"))
    op, parts = F.col("op"), F.col("parts")
    load = op.startswith("ldr") | op.startswith("ldp") | (op.startswith("mov") & F.col("line").contains("["))
    kind = F.when(load, "LOAD").when(op.isin(*fixed.DEPENDENCY_ARITHMETIC), "ARITH").otherwise("OTHER")
    reads = op.startswith("str") | op.startswith("stp") | (op == "cmp") | op.rlike("^(b|j|ret)")
    stores = F.get(parts, F.lit(0)).contains("[") & op.contains("mov")
    used = F.when(reads, parts).when(stores, F.slice(parts, 1, 2)).otherwise(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))))
    made = F.when(~reads & ~F.coalesce(stores, F.lit(False)) & (F.size(parts) > 0), F.slice(parts, 1, 1)).otherwise(F.slice(parts, 1, 0))
    every = lambda a: F.flatten(F.transform(a, _registers))
    rows = rows.select(*KEY, "i", kind.alias("kind"), every(used).alias("uses"), every(made).alias("defs"))
    n = lambda a, b: F.sum(((F.col("kind") == a) & (F.col("def_kind") == b)).cast("int"))
    got = def_uses(rows).groupBy(*KEY).agg(n("LOAD", "LOAD").alias("dep_load_to_load"), n("LOAD", "ARITH").alias("dep_arith_to_load"), F.round(F.avg(F.col("i") - F.col("at")), 6).alias("dep_avg_distance"), F.count("*").alias("dep_count"))
    return lines.select(*KEY).distinct().join(got, list(KEY), "left").fillna({"dep_load_to_load": 0, "dep_arith_to_load": 0, "dep_avg_distance": -1.0, "dep_count": 0})


def memory_features(lines: DataFrame) -> DataFrame:
    """(seq, lo, mem_stack_accesses, mem_complex_addressing, mem_store_load_hazard, mem_stack_ratio); the base is the first register in brackets."""
    rows = _operands(lines).where((F.col("op") != "nop") & ~F.col("op").endswith(":"))
    side = lambda k: F.regexp_replace(F.get(F.split("line", ","), F.lit(k)), r"^\s+", "").startswith("[") | (F.get("parts", F.lit(k)).startswith("["))
    move = F.col("op").startswith("mov") & F.col("line").contains("[")
    is_load = F.col("line").rlike("(?i)" + fixed.LINE_PATTERNS["load"]) | (move & F.coalesce(side(1), F.lit(False)))
    is_store = F.col("line").rlike("(?i)" + fixed.LINE_PATTERNS["store"]) | (move & F.coalesce(side(0), F.lit(False)))
    content = F.regexp_extract("line", r"\[([^\]]*)\]", 1)
    rows = rows.select(*KEY, "i", is_load.alias("ld"), is_store.alias("st"), content.alias("content"), _registers(content).alias("regs")).where("ld OR st")
    base = F.get("regs", F.lit(0))
    before = Window.partitionBy(*KEY, "base").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("base", base)
    stored = F.max(F.when(F.col("st"), F.col("i"))).over(before)
    hazard = F.col("ld") & ~F.col("st") & F.col("base").isNotNull() & (F.col("i") - stored < 10)
    rows = rows.withColumn("hazard", F.coalesce(hazard, F.lit(False)))
    n = lambda flag: F.sum(flag.cast("int"))
    # Registers that point into the stack.
    stack = F.arrays_overlap("regs", F.array(*map(F.lit, ("sp", "rsp", "rbp", "esp", "ebp"))))
    got = rows.groupBy(*KEY).agg(
        n(F.coalesce(stack, F.lit(False))).alias("mem_stack_accesses"), n((F.size("regs") > 1) | F.col("content").rlike("[+*]")).alias("mem_complex_addressing"), n(F.col("hazard")).alias("mem_store_load_hazard"), F.count("*").alias("n")
    )
    got = got.withColumn("mem_stack_ratio", F.round(F.col("mem_stack_accesses") / F.col("n"), 6)).drop("n")
    return lines.select(*KEY).distinct().join(got, list(KEY), "left").fillna(0)


def graph_features(lines: DataFrame) -> DataFrame:
    """Control and data graph features of a window; the chain is the longest path of its data graph."""
    rows = _operands(lines)
    op = F.col("op")
    cond = op.startswith("b.") | op.isin("cbz", "cbnz", "tbz", "tbnz") | (op.startswith("j") & ~op.isin("jmp", "jmpq"))
    ret, uncond = op.isin("ret", "retq", "retn"), op.isin("b", "jmp", "jmpq")
    more = F.lead("i").over(Window.partitionBy(*KEY).orderBy("i")).isNotNull()
    edge = (~ret & ~uncond & more).cast("int")
    rows = rows.withColumn("cond", cond).withColumn("edge", edge).withColumn("out", edge + (cond | uncond).cast("int"))
    got = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("edge").alias("cfg_num_edges"), F.max("out").alias("cfg_max_out_degree"), F.sum(F.col("cond").cast("int")).alias("conds"))
    made = F.when(~op.isin("cmp", "test", "str", "stp", "push") & (F.size("parts") > 0), _registers(F.get("parts", F.lit(0)))).otherwise(F.array().cast("array<string>"))
    own = rows.where((op != "") & ~op.endswith(":")).select(*KEY, "i", F.lit("").alias("kind"), _registers(F.col("line")).alias("uses"), made.alias("defs"))
    data = def_uses(own)
    edges = data.groupBy(*KEY).agg(F.count("*").alias("dfg_num_edges"))
    chains = per_window(data.select(F.concat_ws(":", *KEY).alias("seq"), F.col("at").alias("src"), F.col("i").alias("dst")), _longest, "chain")
    part = lambda k: F.split_part("seq", F.lit(":"), F.lit(k)).cast("long")
    chains = chains.select(part(1).alias("seq"), part(2).alias("lo"), F.col("chain").alias("dfg_max_chain_length"))
    out = got.join(edges, list(KEY), "left").join(chains, list(KEY), "left").fillna(0, ["dfg_num_edges", "dfg_max_chain_length"])
    n = F.col("n")
    return out.select(
        *KEY, "cfg_num_edges", F.lit(0).alias("cfg_num_back_edges"), "cfg_max_out_degree", (F.col("conds") > 0).cast("int").alias("cfg_has_branch"), F.round(F.col("conds") / n, 6).alias("cfg_branch_ratio"), (F.col("conds") + 1).alias("cfg_cyclomatic_complexity"),
        "dfg_num_edges", "dfg_max_chain_length", F.round(F.col("dfg_num_edges") / n, 6).alias("dfg_avg_out_degree"), (F.col("dfg_max_chain_length") >= 4).cast("int").alias("dfg_has_long_chain"),
        F.round((F.col("cfg_num_edges") + F.col("dfg_num_edges")) / F.greatest(n * (n - 1), F.lit(1)), 6).alias("graph_density"),
    )


def _longest(edges: list):
    far: dict = {}
    for a, b in sorted(edges, key=lambda e: e[1]):  # edges go forward
        far[b] = max(far.get(b, 0), far.get(a, 0) + 1)
    yield (max(far.values()),)


_CONDITION, _BARRIER, _POINTER = (fixed.BASE_PATTERNS[k] for k in ("condition", "barrier", "pointer_arithmetic"))


def base_features(lines: DataFrame) -> DataFrame:
    """Traces, counts, the first branch's distances to the first load and barrier (-1 where one is missing), pointer arithmetic."""
    line, op, i = F.col("line"), F.col("op"), F.col("i")
    rows = lines.select(*KEY, "i", "line", instructions.opcode(line).alias("op"))
    rows = rows.select("*", nodes.simple_type(op).alias("kind"), line.rlike(_CONDITION).alias("branch"), line.rlike("(?i)" + fixed.LINE_PATTERNS["load"]).alias("ld"), line.rlike("(?i)" + fixed.LINE_PATTERNS["store"]).alias("st"), line.rlike(_BARRIER).alias("bar"))
    n = lambda flag: F.sum(flag.cast("int"))
    first = lambda flag: F.min(F.when(flag, i))
    trace = lambda what: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(op != "nop", F.struct("i", what)))), lambda s: s[what]), " ")
    got = rows.groupBy(*KEY).agg(
        trace("op").alias("op_trace"), trace("kind").alias("struc_trace"), n(line.contains("[") & line.contains("]")).alias("num_mem_ops"), n(F.col("st")).alias("num_store_ops"), n(F.col("ld")).alias("num_load_ops"),
        F.sum(F.regexp_count("line", F.lit(r"\b[wx][0-9]+\b"))).alias("num_reg_tokens"), n(F.col("branch")).alias("num_branches"), F.max(F.col("bar").cast("int")).alias("barrier_present"),
        first(F.col("branch")).alias("b"), first(F.col("ld")).alias("l"), first(F.col("bar")).alias("f"), F.max(line.rlike(_POINTER).cast("int")).alias("has_pointer_arith"), F.count("*").alias("window_length"),
    )
    far = lambda x: F.coalesce(F.col(x) - F.col("b"), F.lit(-1))
    return got.withColumn("dist_branch_to_first_load", far("l")).withColumn("dist_branch_to_first_barrier", far("f")).drop("b", "l", "f")


def token_stream(lines: DataFrame) -> DataFrame:
    """(seq, lo, i, tokens): opcode, operand classes (MEM, IMM, REG) and ``DIST_k``, the lines since the last branch, from -1 to 15."""
    rows = _operands(lines)
    place = F.max(F.when(F.col("op").rlike(r"^(b\.|cb|tb|j)"), F.col("i"))).over(Window.partitionBy(*KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    kind = lambda x: F.when(x.rlike(r"[\[(]"), "MEM").when(x.rlike("^[#$]"), "IMM").when(x.rlike("(?i)^%?([wx][0-9]+|sp|r[a-z0-9]+|e[a-z]x)"), "REG").otherwise("SYM")
    far = F.coalesce(F.least(F.col("i") - place, F.lit(15)), F.lit(-1))
    return rows.select(*KEY, "i", F.concat_ws(" ", F.col("op"), F.transform("parts", kind), F.concat(F.lit("DIST_"), far.cast("string"))).alias("tokens"))


def sequence_embedding(lines: DataFrame, dims: int = 4) -> DataFrame:
    """(seq, lo, d, mean, most): mean and maximum over a window's tokens of each token's vector, here from its hash."""
    tokens = lines.select(*KEY, instructions.opcode(F.col("line")).alias("op"))
    value = F.conv(F.substring(F.md5(F.concat_ws("|", "op", F.col("d").cast("string"))), 1, 4), 16, 10).cast("double") / 65535
    each = tokens.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(dims - 1)))).withColumn("x", value)
    return each.groupBy(*KEY, "d").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.max("x"), 6).alias("most"))


def stripped(lines: DataFrame) -> DataFrame:
    """(seq, lo, n): how many lines of each window stay without its boilerplate tail."""
    whole = lines.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]).alias("sequence"))
    return whole.select(*KEY, F.size(instructions.stripped_tail(F.col("sequence"))).alias("n"))


def _each(work):
    return lambda s, d: work(code_windows(s, d))


QUERIES = {
    "line_columns": lambda s, d: line_columns(listing(s, d)),
    "kept_lines": lambda s, d: kept_lines(listing(s, d)),
    "register_roles": lambda s, d: code(s, d).select(F.explode(_registers(F.col("line"))).alias("register")).groupBy("register", nodes.register_role(F.col("register")).alias("role")).agg(F.count("*").alias("n")),
    "label_buckets": lambda s, d: code(s, d).select(F.regexp_extract("line", r"(\.L[0-9]+|helper\w*)", 1).alias("label")).where("label <> ''").groupBy("label", nodes.label_bucket(F.col("label")).alias("bucket")).agg(F.count("*").alias("n")),
    "node_columns": _each(lambda w: graph_nodes(w).select("seq", "pos", "category", F.array_join("dest", ",").alias("dest"), F.array_join("src", ",").alias("src"), "memory", F.concat(*(F.col(f"flags.{n}").cast("int").cast("string") for n in fixed.SPEC_FLAGS)).alias("flags"))),
    "node_vectors": _each(lambda w: vectors(graph_nodes(w))),
    "listing_edges": _each(lambda w: graph_edges(graph_nodes(w)).select("seq", "src", "dst", "type", F.round("weight", 6).alias("weight"))),
    "listing_edge_dist": _each(lambda w: graph_edges(graph_nodes(w)).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 5).alias("mean_weight"))),
    "listing_coo": _each(lambda w: coo(graph_edges(graph_nodes(w)))),
    "base_features": _each(base_features),
    "dependency_features": _each(dependency_features),
    "memory_features": _each(memory_features),
    "graph_features": _each(graph_features),
    "token_stream": _each(token_stream),
    "sequence_embedding": _each(sequence_embedding),
    "strip_tail": lambda s, d: stripped(windows(listing(s, d))),
}


# --------------------------------------------------------------------------- oracles


def _m(name: str, line: str = "line") -> str:
    return f"regexp_matches({line}, '(?i){fixed.NODE_PATTERNS[name]}')"


_REST = r"regexp_extract(line, '^\s*\S+\s+(.*)$', 1)"
_OP = r"replace(lower(regexp_extract(line, '^\s*(\S+)', 1)), ',', '')"
_PARTS = f"CASE WHEN {_REST} = '' THEN [] ELSE list_transform(string_split({_REST}, ','), lambda x: trim(x)) END"
_REGS = lambda t: f"list_distinct(list_transform(list_concat(regexp_extract_all({t}, '(?i){fixed.LINE_PATTERNS['reg_arm']}'), regexp_extract_all({t}, '(?i){fixed.LINE_PATTERNS['reg_x86']}')), lambda r: replace(lower(r), '%', '')))"
_CAT = f"""CASE WHEN {_m('fence')} THEN 'FENCE' WHEN {_m('cache')} THEN 'CACHE' WHEN {_m('timing')} THEN 'TIMING' WHEN {_m('ret')} THEN 'RET' WHEN {_m('call')} THEN CASE WHEN {_m('indirect')} THEN 'CALL_INDIRECT' ELSE 'CALL' END
  WHEN {_m('indirect')} AND regexp_matches(line, '(?i)\\b(jmpq?|br)\\b') THEN 'JUMP_INDIRECT' WHEN {_m('branch_cond')} THEN 'BRANCH_COND' WHEN {_m('branch_uncond')} THEN 'BRANCH_UNCOND' WHEN {_m('compare')} THEN 'COMPARE' WHEN {_m('stack_op')} THEN 'STACK'
  WHEN {_m('memory_operand')} AND ({_m('store_arm')} OR {_m('store_x86')}) THEN CASE WHEN contains(lower(line), 'push') THEN 'STACK' ELSE 'STORE' END WHEN {_m('memory_operand')} AND ({_m('load_arm')} OR {_m('load_x86')}) THEN CASE WHEN contains(lower(line), 'pop') THEN 'STACK' ELSE 'LOAD' END
  WHEN {_m('move')} THEN 'MOVE' WHEN {_m('arithmetic')} THEN 'ARITHMETIC' WHEN {_m('logic')} THEN 'LOGIC' WHEN {_m('shift')} THEN 'SHIFT' WHEN contains(lower(line), 'nop') THEN 'NOP' ELSE 'OTHER' END"""
_SOURCES = str(nodes.ALL_SOURCE)
_NODES = f"""{WINDOWS}, n0 AS (SELECT seq || ':' || lo AS seq, i AS pos, line, {_CAT} AS category,
    CASE WHEN NOT {_m('memory_operand')} THEN 'NONE' WHEN {_m('stack_access')} THEN 'STACK' WHEN {_m('indexed_access')} THEN 'INDEXED' WHEN {_m('indirect')} THEN 'INDIRECT' ELSE 'HEAP' END AS memory,
    list_concat(regexp_extract_all(lower(line), '{fixed.NODE_PATTERNS["arm_reg"]}', 1), regexp_extract_all(lower(line), '{fixed.NODE_PATTERNS["x86_reg"]}', 1)) AS regs FROM aw),
  nd AS (SELECT *, CASE WHEN category IN {_SOURCES} THEN [] ELSE regs[1:1] END AS dest, CASE WHEN category IN {_SOURCES} THEN regs ELSE regs[2:] END AS srcs,
    category = 'FENCE' OR contains(lower(line), 'cpuid') AS f0, category = 'CACHE' AS f1, category IN ('BRANCH_COND', 'BRANCH_UNCOND', 'CALL', 'CALL_INDIRECT', 'JUMP_INDIRECT', 'RET') AS f2, category IN ('CALL_INDIRECT', 'JUMP_INDIRECT') AS f3,
    category IN ('LOAD', 'STORE', 'STACK') AS f4, category = 'TIMING' AS f5, category = 'LOAD' AND memory = 'INDEXED' AS f6, category = 'LOAD' AND memory IN ('INDEXED', 'INDIRECT') AS f7 FROM n0)"""
_USES = "ud AS (SELECT DISTINCT seq, pos, unnest(srcs) AS reg FROM nd), de AS (SELECT seq, pos, unnest(dest) AS reg FROM nd)"
_EDGES = f"""{_NODES}, {_USES}, bs AS (SELECT DISTINCT seq, pos, category, unnest(CASE WHEN len(srcs) = 0 THEN ['_mem_'] ELSE srcs END) AS reg FROM nd WHERE category IN ('LOAD', 'STORE')),
  e0 AS (SELECT u.seq, d.pos AS src, u.pos AS dst, u.reg FROM ud u JOIN de d ON u.seq = d.seq AND u.reg = d.reg AND d.pos < u.pos QUALIFY row_number() OVER (PARTITION BY u.seq, u.pos, u.reg ORDER BY d.pos DESC) <= 3),
  e5 AS (SELECT l.seq, s.pos AS src, l.pos AS dst, l.reg FROM bs l JOIN bs s ON l.seq = s.seq AND l.reg = s.reg AND s.pos < l.pos WHERE l.category = 'LOAD' AND s.category = 'STORE' QUALIFY row_number() OVER (PARTITION BY l.seq, l.pos, l.reg ORDER BY s.pos DESC) <= 2),
  sp AS (SELECT a.seq, a.pos AS src, b.pos AS dst, CASE a.category WHEN 'BRANCH_COND' THEN 2 WHEN 'RET' THEN 4 ELSE 3 END AS type,
    least(3.0, (CASE WHEN b.f1 OR b.f5 THEN 2.5 WHEN b.f6 OR b.f7 THEN 3 WHEN b.f4 THEN 2 ELSE 1 END) / (b.pos - a.pos)) AS weight FROM nd a JOIN nd b ON a.seq = b.seq AND b.pos BETWEEN a.pos + 1 AND a.pos + 10
    WHERE a.category IN ('BRANCH_COND', 'CALL_INDIRECT', 'JUMP_INDIRECT', 'RET') AND (a.category IN ('CALL_INDIRECT', 'JUMP_INDIRECT') OR b.f1 OR b.f4 OR b.f5 OR b.f6 OR b.f7)
    AND NOT EXISTS (SELECT 1 FROM nd z WHERE z.seq = a.seq AND z.category = 'FENCE' AND z.pos > a.pos AND z.pos <= b.pos)),
  nx AS (SELECT a.seq, a.pos AS src, b.pos AS dst, a.category FROM nd a JOIN nd b ON a.seq = b.seq AND b.pos = a.pos + 1),
  ed AS (SELECT seq, src, dst, 0 AS type, 1.0 AS weight, reg FROM e0 UNION ALL SELECT seq, src, dst, 1, 1.0, NULL FROM nx UNION ALL SELECT seq, src, dst, type, weight, NULL FROM sp UNION ALL SELECT seq, src, dst, 5, 1.0, reg FROM e5
    UNION ALL SELECT a.seq, a.pos, b.pos, 6, 1.5, NULL FROM nd a JOIN nd b ON a.seq = b.seq AND b.pos BETWEEN a.pos + 1 AND a.pos + 5 WHERE a.category = 'CACHE' AND b.category IN ('LOAD', 'TIMING') UNION ALL SELECT seq, src, dst, 7, 1.0, NULL FROM nx WHERE category = 'FENCE')"""
_FLAGBITS = " || ".join(f"f{k}::INT::VARCHAR" for k in range(8))
_PART = f"pt AS (SELECT seq, lo, i, line, {_OP} AS op, {_PARTS} AS parts FROM aw)"
_DU = """dd AS (SELECT u.seq, u.lo, u.i, u.kind, (SELECT max(d.i) FROM defs d WHERE d.seq = u.seq AND d.lo = u.lo AND d.reg = u.reg AND d.i < u.i) AS d_i, u.reg FROM uses u)"""


def _semantics_sql() -> str:
    yes = {  # flags that an opcode sets, for x86 and for ARM
        "is_branch": ("op LIKE 'j%'", "op LIKE 'b%'"), "is_conditional": ("op LIKE 'j%' AND op <> 'jmp'", "op LIKE 'b%' AND contains(op, '.')"),
        "is_indirect": ("(op LIKE 'j%' AND contains(rest, '[')) OR (op = 'call' AND (contains(rest, '[') OR contains(rest, '%')))", "op IN ('br', 'blr')"), "is_call": ("op = 'call'", "false"), "is_return": ("op = 'ret'", "op = 'ret'"),
        "is_load": ("op IN ('mov', 'movzx', 'movsx', 'movzbl', 'movzwl', 'lea') AND contains(rest, '[')", "op IN ('ldr', 'ldrb', 'ldrh', 'ldp')"), "is_store": ("false", "op IN ('str', 'strb', 'strh', 'stp')"),
        "accesses_memory": ("op IN ('mov', 'movzx', 'movsx', 'movzbl', 'movzwl', 'lea') AND contains(rest, '[')", "op IN ('ldr', 'ldrb', 'ldrh', 'ldp', 'str', 'strb', 'strh', 'stp')"),
        "is_arithmetic": ("op IN ('add', 'sub', 'mul', 'div', 'xor', 'and', 'or', 'shl', 'shr')", "op IN ('add', 'sub', 'mul', 'div', 'and', 'orr', 'eor', 'lsl', 'lsr')"), "is_comparison": ("op IN ('cmp', 'test')", "op IN ('cmp', 'subs')"),
        "is_speculation_barrier": ("op IN ('lfence', 'mfence', 'sfence')", "op IN ('dsb', 'isb', 'dmb')"), "is_cache_operation": ("op IN ('clflush', 'clwb', 'clflushopt')", "op IN ('dc', 'ic')"), "is_timing_sensitive": ("op IN ('rdtsc', 'rdtscp')", "op = 'mrs'"), "is_privileged": ("false", "op = 'mrs'"),
    }
    return " || ".join(f"(CASE WHEN seq % 2 = 1 THEN {yes[n][0]} ELSE {yes[n][1]} END)::INT::VARCHAR" for n in nodes.SEMANTICS)


_SEMTYPE = "CASE " + " ".join(f"WHEN op IN {str(ops) if len(ops) > 1 else '(' + repr(ops[0]) + ')'} THEN '{name}'" for name, ops in nodes.SEMANTIC_TYPES) + " ELSE 'COMPUTE' END"
_SIMPLE = """CASE WHEN op = 'nop' THEN NULL WHEN op LIKE 'ret%' THEN 'RET' WHEN op LIKE 'call%' THEN 'BRANCH_UNCOND' WHEN op LIKE 'b.%' OR op LIKE 'cb%' OR op LIKE 'tb%' THEN 'BRANCH_COND' WHEN op IN ('b', 'bl', 'br', 'blr') THEN 'BRANCH_UNCOND'
  WHEN op LIKE 'ldr%' OR op LIKE 'ldp%' OR op LIKE 'ldu%' THEN 'LOAD' WHEN op LIKE 'str%' OR op LIKE 'stp%' OR op LIKE 'stur%' THEN 'STORE' WHEN op LIKE 'dsb%' OR op LIKE 'dmb%' OR op LIKE 'isb%' THEN 'BARRIER' WHEN op = 'jmp' THEN 'BRANCH_UNCOND'
  WHEN op LIKE 'j%' THEN 'BRANCH_COND' WHEN op LIKE 'mov%' THEN 'MOVE' WHEN op IN ('lfence', 'mfence', 'sfence') THEN 'BARRIER' WHEN op = 'clflush' THEN 'FLUSH' WHEN op = 'rdtsc' THEN 'TIME' ELSE 'COMPUTE' END"""
_CLASS = f"""CASE WHEN len(list_filter({list(nodes.GENERAL_REGISTERS)}, lambda r: starts_with(lower(x), r))) > 0 THEN 'REG' WHEN contains(x, '[') OR contains(x, '(') THEN CASE WHEN contains(x, '+') OR contains(x, '-') THEN 'MEM_OFFSET' ELSE 'MEM_DIRECT' END
  WHEN x LIKE '#%' OR x LIKE '$%' OR x LIKE '0x%' OR regexp_full_match(x, '[0-9]+') THEN 'IMM' ELSE 'LABEL' END"""
_VAL = "try_cast(ltrim(x, '$#') AS BIGINT)"
_IMM = f"""CASE WHEN {_VAL} IS NULL THEN CASE WHEN regexp_matches(lower(x), 'offset|addr|ptr') THEN 'IMM_ADDRESS' ELSE 'IMM_SYMBOL' END WHEN {_VAL} = 0 THEN 'IMM_ZERO' WHEN {_VAL} = 1 THEN 'IMM_ONE' WHEN {_VAL} BETWEEN 2 AND 8 THEN 'IMM_SMALL_POWER2'
  WHEN {_VAL} IN (16, 32, 64, 128, 256, 512, 1024) THEN 'IMM_POWER2' WHEN {_VAL} BETWEEN -128 AND 127 THEN 'IMM_BYTE' WHEN {_VAL} BETWEEN -32768 AND 32767 THEN 'IMM_WORD' WHEN {_VAL} < 0 THEN 'IMM_NEGATIVE' WHEN {_VAL} <= 4294967295 THEN 'IMM_DWORD' ELSE 'IMM_LARGE' END"""
_ROLE = "CASE " + " ".join(f"WHEN register IN {names} THEN '{role}'" for role, names in nodes.REGISTER_ROLES) + " ELSE 'REG_' || upper(register) END"
_ONE_HOT = """['LOAD', 'STORE', 'BRANCH_COND', 'BRANCH_UNCOND', 'CALL', 'CALL_INDIRECT', 'RET', 'JUMP_INDIRECT', 'COMPARE', 'ARITHMETIC', 'LOGIC', 'SHIFT', 'FENCE', 'CACHE', 'TIMING', 'MOVE', 'STACK', 'NOP', 'OTHER']"""  # by hand: the places are the result
_FENCE_OR_TIME = "(" + _m("fence") + " OR " + _m("timing") + r" OR contains(lower(line), 'cntvct'))"
ORACLES = {
    "line_columns": rf"""WITH {LISTING}, tr AS (SELECT seq, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM li),
      c AS (SELECT seq, pos, regexp_replace(split_part(t, ';', 1), '\s+$', '') AS line, regexp_replace(split_part(split_part(t, ';', 1), '#', 1), '\s+$', '') AS cut FROM tr WHERE t <> '' AND t NOT LIKE '.%' AND t NOT LIKE '%:'),
      o AS (SELECT *, {_OP} AS op, {_REST} AS rest, {_PARTS} AS parts FROM c)
      SELECT seq, pos, line AS plain, cut, op, regexp_extract(line, '[A-Za-z0-9_]+') AS word, array_to_string(parts, '|') AS operands, array_to_string(list_transform(parts, lambda x: {_CLASS}), '|') AS classes, rtrim(split_part(op, '.', 1), 'qwlb') AS canonical,
        array_to_string(list_transform(parts, lambda x: {_IMM}), '|') AS immediates, {_SEMTYPE} AS semantic, {_SIMPLE} AS simple, {_semantics_sql()} AS flags FROM o""",
    "kept_lines": rf"""WITH {LISTING}, tr AS (SELECT seq, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM li)
      SELECT seq, pos, regexp_replace(regexp_extract(line, '^[^;#@]*'), '\s+$', '') AS line FROM tr WHERE line <> '' AND line[1] NOT IN ('.', '#', ';', '/') AND line NOT LIKE '%:' AND NOT contains(line, '@') AND NOT contains(line, '//')
        AND NOT (contains(line, '.word') OR contains(line, '.byte') OR contains(line, '.ascii') OR contains(line, '.long') OR contains(line, '.quad') OR contains(line, '.zero'))""",
    "register_roles": f"WITH {CODE}, r AS (SELECT unnest({_REGS('line')}) AS register FROM co) SELECT register, {_ROLE} AS role, count(*) AS n FROM r GROUP BY ALL",
    "label_buckets": f"""WITH {CODE}, l AS (SELECT regexp_extract(line, '(\\.L[0-9]+|helper\\w*)', 1) AS label FROM co) SELECT label, 'LABEL_' || (('0x' || md5(label)[1:8])::BIGINT % 1000) AS bucket, count(*) AS n FROM l WHERE label <> '' GROUP BY ALL""",
    "node_columns": f"WITH {_NODES} SELECT seq, pos, category, array_to_string(dest, ',') AS dest, array_to_string(list_filter(srcs, lambda x, k: list_position(srcs, x) = k), ',') AS src, memory, {_FLAGBITS} AS flags FROM nd",
    "node_vectors": f"""WITH {_NODES}, v AS (SELECT seq, pos, list_concat(list_transform({_ONE_HOT}, lambda x: (x = category)::INT::DOUBLE), list_transform({list(fixed.MEMORY_TYPES)}, lambda x: (x = memory)::INT::DOUBLE), [least(len(dest), 3) / 3, least(len(list_distinct(srcs)), 5) / 5],
        [{", ".join(f"f{k}::INT::DOUBLE" for k in range(8))}], [pos / greatest(count(*) OVER (PARTITION BY seq) - 1, 1)]) AS v FROM nd) SELECT seq, pos, array_to_string(list_transform(v, lambda x: round(x, 4)::VARCHAR), ',') AS vector FROM v""",
    "listing_edges": f"WITH {_EDGES} SELECT seq, src, dst, type, round(weight, 6) AS weight FROM ed",
    "listing_edge_dist": f"WITH {_EDGES} SELECT type, count(*) AS n, round(avg(weight), 5) AS mean_weight FROM ed GROUP BY type",
    "listing_coo": f"""WITH {_EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY dst, [2, 0, 3, 3, 3, 4, 5, 1][type + 1], src, type, reg NULLS FIRST) - 1 AS k FROM ed WHERE src < 64 AND dst < 64)
      SELECT seq, k, src, dst, type FROM r WHERE k < 512""",
    "base_features": f"""WITH {WINDOWS}, o AS (SELECT *, {_OP} AS op FROM aw), f AS (SELECT *, {_SIMPLE} AS kind, regexp_matches(line, '{_CONDITION}') AS br, regexp_matches(line, '(?i){fixed.LINE_PATTERNS["load"]}') AS ld, regexp_matches(line, '(?i){fixed.LINE_PATTERNS["store"]}') AS st, regexp_matches(line, '{_BARRIER}') AS bar FROM o)
      SELECT seq, lo, coalesce(string_agg(op, ' ' ORDER BY i) FILTER (op <> 'nop'), '') AS op_trace, coalesce(string_agg(kind, ' ' ORDER BY i), '') AS struc_trace, count(*) FILTER (contains(line, '[') AND contains(line, ']')) AS num_mem_ops, count(*) FILTER (st) AS num_store_ops, count(*) FILTER (ld) AS num_load_ops,
        sum(len(regexp_extract_all(line, '\\b[wx][0-9]+\\b')))::BIGINT AS num_reg_tokens, count(*) FILTER (br) AS num_branches, max(bar::INT) AS barrier_present, max(regexp_matches(line, '{_POINTER}')::INT) AS has_pointer_arith, count(*) AS window_length,
        coalesce(min(i) FILTER (ld) - min(i) FILTER (br), -1) AS dist_branch_to_first_load, coalesce(min(i) FILTER (bar) - min(i) FILTER (br), -1) AS dist_branch_to_first_barrier FROM f GROUP BY seq, lo""",
    "dependency_features": f"""WITH {WINDOWS}, {_PART}, k AS (SELECT *, CASE WHEN op LIKE 'ldr%' OR op LIKE 'ldp%' OR (op LIKE 'mov%' AND contains(line, '[')) THEN 'LOAD' WHEN op IN {fixed.DEPENDENCY_ARITHMETIC} THEN 'ARITH' ELSE 'OTHER' END AS kind,
        op LIKE 'str%' OR op LIKE 'stp%' OR op = 'cmp' OR op LIKE 'b%' OR op LIKE 'j%' OR op LIKE 'ret%' AS reads, coalesce(contains(parts[1], '[') AND contains(op, 'mov'), false) AS stores FROM pt WHERE op <> 'nop' AND op NOT LIKE '%:'),
      u AS (SELECT seq, lo, i, kind, unnest(CASE WHEN reads THEN parts WHEN stores THEN parts[1:2] ELSE parts[2:] END) AS part FROM k), uses AS (SELECT seq, lo, i, kind, unnest({_REGS('part')}) AS reg FROM u),
      defs AS (SELECT seq, lo, i, kind, unnest({_REGS('parts[1]')}) AS reg FROM k WHERE NOT reads AND NOT stores AND len(parts) > 0), {_DU},
      g AS (SELECT dd.seq, dd.lo, count(*) FILTER (dd.kind = 'LOAD' AND d.kind = 'LOAD') AS dep_load_to_load, count(*) FILTER (dd.kind = 'LOAD' AND d.kind = 'ARITH') AS dep_arith_to_load, avg(dd.i - d_i) AS far, count(*) AS dep_count
        FROM dd JOIN k d ON d.seq = dd.seq AND d.lo = dd.lo AND d.i = d_i GROUP BY ALL)
      SELECT seq, lo, coalesce(dep_load_to_load, 0) AS dep_load_to_load, coalesce(dep_arith_to_load, 0) AS dep_arith_to_load, round(coalesce(far, -1), 6) AS dep_avg_distance, coalesce(dep_count, 0) AS dep_count FROM (SELECT DISTINCT seq, lo FROM aw) LEFT JOIN g USING (seq, lo)""",
    "memory_features": f"""WITH {WINDOWS}, {_PART}, k AS (SELECT *, regexp_extract(line, '\\[([^\\]]*)\\]', 1) AS content, regexp_matches(line, '(?i){fixed.LINE_PATTERNS["load"]}') OR (op LIKE 'mov%' AND coalesce(parts[2] LIKE '[%', false)) AS ld,
        regexp_matches(line, '(?i){fixed.LINE_PATTERNS["store"]}') OR (op LIKE 'mov%' AND coalesce(parts[1] LIKE '[%', false)) AS st FROM pt WHERE op <> 'nop' AND op NOT LIKE '%:'),
      r AS (SELECT *, {_REGS('content')} AS bag, list_concat(regexp_extract_all(content, '(?i){fixed.LINE_PATTERNS["reg_arm"]}'), regexp_extract_all(content, '(?i){fixed.LINE_PATTERNS["reg_x86"]}')) AS all_regs FROM k WHERE ld OR st),
      b AS (SELECT *, replace(lower(all_regs[1]), '%', '') AS base FROM r),
      h AS (SELECT *, coalesce(ld AND NOT st AND i - (SELECT max(i) FROM b s WHERE s.seq = b.seq AND s.lo = b.lo AND s.base = b.base AND s.st AND s.i < b.i) < 10, false) AS hazard FROM b),
      g AS (SELECT seq, lo, count(*) FILTER (list_has_any(bag, ['sp', 'rsp', 'rbp', 'esp', 'ebp'])) AS stack, count(*) FILTER (len(bag) > 1 OR contains(content, '+') OR contains(content, '*')) AS complex, count(*) FILTER (hazard) AS hazard, count(*) AS n FROM h GROUP BY ALL)
      SELECT seq, lo, coalesce(stack, 0) AS mem_stack_accesses, coalesce(complex, 0) AS mem_complex_addressing, coalesce(hazard, 0) AS mem_store_load_hazard, round(coalesce(stack / n, 0), 6) AS mem_stack_ratio FROM (SELECT DISTINCT seq, lo FROM aw) LEFT JOIN g USING (seq, lo)""",
    "graph_features": f"""WITH RECURSIVE {WINDOWS}, {_PART}, k AS (SELECT *, op LIKE 'b.%' OR op IN ('cbz', 'cbnz', 'tbz', 'tbnz') OR (op LIKE 'j%' AND op NOT IN ('jmp', 'jmpq')) AS cond, op IN ('b', 'jmp', 'jmpq') AS uncond, op IN ('ret', 'retq', 'retn') AS ret,
        i < max(i) OVER (PARTITION BY seq, lo) AS more FROM pt),
      uses AS (SELECT seq, lo, i, '' AS kind, unnest({_REGS('line')}) AS reg FROM k), defs AS (SELECT seq, lo, i, '' AS kind, unnest({_REGS('parts[1]')}) AS reg FROM k WHERE op NOT IN ('cmp', 'test', 'str', 'stp', 'push') AND len(parts) > 0), {_DU},
      e AS (SELECT seq, lo, d_i, i FROM dd WHERE d_i IS NOT NULL), p AS (SELECT DISTINCT seq, lo, i AS node, 1 AS far FROM e UNION SELECT p.seq, p.lo, e.i, far + 1 FROM p JOIN e ON e.seq = p.seq AND e.lo = p.lo AND e.d_i = p.node),
      c AS (SELECT seq, lo, max(far) AS far FROM p GROUP BY ALL), d AS (SELECT seq, lo, count(*) AS de FROM e GROUP BY ALL),
      g AS (SELECT seq, lo, count(*) AS n, count(*) FILTER (NOT ret AND NOT uncond AND more) AS ce, max((NOT ret AND NOT uncond AND more)::INT + (cond OR uncond)::INT) AS top, count(*) FILTER (cond) AS conds FROM k GROUP BY ALL)
      SELECT seq, lo, ce AS cfg_num_edges, 0 AS cfg_num_back_edges, top AS cfg_max_out_degree, (conds > 0)::INT AS cfg_has_branch, round(conds / n, 6) AS cfg_branch_ratio, conds + 1 AS cfg_cyclomatic_complexity, coalesce(de, 0) AS dfg_num_edges, coalesce(far, 0) AS dfg_max_chain_length,
        round(coalesce(de, 0) / n, 6) AS dfg_avg_out_degree, (coalesce(far, 0) >= 4)::INT AS dfg_has_long_chain, round((ce + coalesce(de, 0)) / greatest(n * (n - 1), 1), 6) AS graph_density FROM g LEFT JOIN d USING (seq, lo) LEFT JOIN c USING (seq, lo)""",
    "token_stream": f"""WITH {WINDOWS}, {_PART}, b AS (SELECT p.*, (SELECT max(i) FROM pt q WHERE q.seq = p.seq AND q.lo = p.lo AND q.i < p.i AND (q.op LIKE 'b.%' OR q.op LIKE 'cb%' OR q.op LIKE 'tb%' OR q.op LIKE 'j%')) AS b_i FROM pt p)
      SELECT seq, lo, i, array_to_string(list_concat([op], list_transform(parts, lambda x: CASE WHEN contains(x, '[') OR contains(x, '(') THEN 'MEM' WHEN x LIKE '#%' OR x LIKE '$%' THEN 'IMM' WHEN regexp_matches(lower(x), '^%?([wx][0-9]+|sp|r[a-z0-9]+|e[a-z]x)') THEN 'REG' ELSE 'SYM' END),
        ['DIST_' || coalesce(least(i - b_i, 15), -1)]), ' ') AS tokens FROM b""",
    "sequence_embedding": f"""WITH {WINDOWS}, t AS (SELECT seq, lo, d, ('0x' || md5({_OP} || '|' || d)[1:4])::BIGINT / 65535 AS x FROM aw, range(0, 4) r(d)) SELECT seq, lo, d::INT AS d, round(avg(x), 6) AS mean, round(max(x), 6) AS most FROM t GROUP BY ALL""",
    "strip_tail": f"""WITH {LISTING}, {windows_sql("li")}, f AS (SELECT *, regexp_matches(line, '{instructions.BOILERPLATE_LABEL}') AS label, regexp_matches(line, '{instructions.MEASUREMENT}') AS m, regexp_matches(line, '(?i)^\\s*nop\\s*$') AS nop,
        regexp_matches(line, '(?i)^\\s*(ret|retq)\\s*$') AS ret, lower(line) LIKE 'add sp, sp,%' AS up, regexp_matches(line, '(?i)^(dsb|isb)') AS bar FROM aw),
      g AS (SELECT *, coalesce(lag(m) OVER w, false) AS pm, coalesce(lag(bar) OVER w, false) AS pb FROM f WINDOW w AS (PARTITION BY seq, lo ORDER BY i)),
      a AS (SELECT seq, lo, count(*) AS n, coalesce(min(i) FILTER (label), count(*)) AS n1 FROM g GROUP BY ALL),
      b AS (SELECT a.seq, a.lo, any_value(n) AS n, CASE WHEN any_value(n1) > 3 THEN greatest(3, coalesce(max(i) FILTER (i < n1 AND NOT (m OR nop OR (ret AND pm))), -1) + 1) ELSE any_value(n1) END AS n2 FROM a JOIN g USING (seq, lo) GROUP BY ALL),
      c AS (SELECT b.seq, b.lo, any_value(n) AS n, CASE WHEN any_value(n2) > 3 THEN greatest(3, coalesce(max(i) FILTER (i < n2 AND NOT (up AND pb)), -1) + 1) ELSE any_value(n2) END AS n3 FROM b JOIN g USING (seq, lo) GROUP BY ALL)
      SELECT seq, lo, CASE WHEN n <= 3 OR n3 < 3 THEN n ELSE n3 END AS n FROM c""",
}
