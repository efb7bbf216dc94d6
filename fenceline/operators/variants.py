"""Variants of windows and further candidates, labels and statistics over real assembly lines and the event stream.

Windows are (seq, lo, i, line). Every choice is the order of an md5 or the first in a fixed order; nulls count as empty lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.functions import nodes
from fenceline.functions.instructions import normalized, opcode
from fenceline.operators import augment, features, fusion, graph, patterns
from fenceline.operators.features import KEY
from fenceline.plans.analogs import BRANCH, EV, FENCE, LOAD, RET, STORE, instructions
from fenceline.plans.assembly_analog import LISTING, WINDOWS, code_windows, listing

# Parts of file names and the labels they mean, the first that a name holds decides.
NAME_LABELS = (
    ("SPECTRE_V1", ("spectre_1", "spectre_v1", "spectrev1")), ("SPECTRE_V2", ("spectre_2", "spectre_v2", "spectrev2")), ("SPECTRE_V4", ("spectre_4", "spectre_v4", "spectrev4")), ("MELTDOWN", ("meltdown",)), ("RETBLEED", ("retbleed",)),
    ("BRANCH_HISTORY_INJECTION", ("bhi", "branch_history")), ("INCEPTION", ("inception",)), ("L1TF", ("l1tf", "l1_terminal")), ("MDS", ("mds", "zombieload", "ridl")), ("BENIGN", ("benign", "negative")),
)
NAMES = ("spectre_1_x86", "SpectreV2", "spectre_v4_arm", "meltdown", "bhi_loop", "zombieload", "l1_terminal", "negative_7", "helper", "inception_retbleed")


def label_of_name(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*(F.when(reduce(lambda a, b: a | b, (low.contains(p) for p in parts)), F.lit(label)) for label, parts in NAME_LABELS), F.lit("UNKNOWN"))


def register_usage(lines: DataFrame) -> DataFrame:
    """(seq, lo, reg, state): a register is ``def`` where its first mention is a definition, else ``use``."""
    line = F.col("line")
    rows = lines.select(*KEY, "i", nodes.all_registers(line).alias("regs"), nodes.node_category(line).alias("category"))
    rows = rows.select(*KEY, "i", nodes.destinations(F.col("regs"), F.col("category")).alias("d"), nodes.sources(F.col("regs"), F.col("category")).alias("u"))
    each = rows.select(*KEY, "i", F.explode("d").alias("reg"), F.lit(1).alias("is_def")).unionByName(rows.select(*KEY, "i", F.explode("u").alias("reg"), F.lit(0).alias("is_def")))
    first = each.groupBy(*KEY, "reg").agg(F.min(F.struct("i", "is_def")).alias("f"))  # a use comes before a definition on one line
    return first.select(*KEY, "reg", F.when(F.col("f.is_def") == 1, "def").otherwise("use").alias("state"))


def swapped_registers(lines: DataFrame) -> DataFrame:
    """(seq, lo, i, line): the first pair, by name, of x registers on no common line, exchanged; windows without a pair are left out."""
    found = lines.select(*KEY, "i", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b(x[0-9]+)\b"), F.lit(1)))).alias("reg"))
    places = found.groupBy(*KEY, "reg").agg(F.collect_set("i").alias("at"))
    by = places.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("reg", "at"))).alias("r"))  # a window has some tens of registers at most
    every = F.flatten(F.transform("r", lambda a: F.transform(F.filter("r", lambda b: (b["reg"] > a["reg"]) & ~F.arrays_overlap(a["at"], b["at"])), lambda b: F.struct(a["reg"].alias("a"), b["reg"].alias("b")))))
    pairs = by.select(*KEY, F.get(every, F.lit(0)).alias("p")).where("p IS NOT NULL")
    parts = F.split(F.regexp_replace("line", r"\b(x[0-9]+)\b", "\u0001$1\u0001"), "\u0001")
    new = F.array_join(F.transform(parts, lambda t: F.when(t == F.col("p.a"), F.col("p.b")).when(t == F.col("p.b"), F.col("p.a")).otherwise(t)), "")
    return lines.join(pairs, list(KEY)).select(*KEY, "i", new.alias("line"))


def swapped_neighbours(rows: DataFrame) -> DataFrame:
    """(seq, pos, op): each sequence with the one pair of independent neighbours of ``augment.independent_swap`` exchanged."""
    op = F.col("op")
    at = augment.independent_swap(rows, op == LOAD, op == STORE, op.isin(BRANCH, RET, FENCE))
    moved = F.when(F.col("pos") == F.col("lo"), F.col("pos") + 1).when(F.col("pos") == F.col("lo") + 1, F.col("pos") - 1).otherwise(F.col("pos"))
    return rows.join(at, "seq").select("seq", moved.alias("pos"), "op")


def boosted(rows: DataFrame, factor: int = 3) -> DataFrame:
    """(seq, copy, pos, op): ``factor`` - 1 variants of each sequence, each with its own inserted ``nop`` s."""
    copies = rows.select("seq", "pos", "op", F.explode(F.sequence(F.lit(1), F.lit(factor - 1))).alias("copy"))
    extra = F.substring(F.md5(F.concat_ws("|", "copy", "seq", "pos")), 1, 2) < "1a"
    both = F.when(extra, F.array("op", F.lit("nop"))).otherwise(F.array("op"))
    order = Window.partitionBy("seq", "copy").orderBy("pos", "k")
    return copies.select("seq", "copy", "pos", F.posexplode(both).alias("k", "op")).select("seq", "copy", (F.row_number().over(order) - 1).alias("pos"), "op")


def cfg_targets(rows: DataFrame) -> DataFrame:
    """(seq, src, dst, kind): control edges of a listing, to the next instruction and from branches to what follows their label, the first one of its name."""
    bare = F.regexp_replace("line", r"^\s+|\s+$", "")
    marked = rows.select("seq", "pos", F.when(bare.rlike(r"^\.?\w+:$"), F.regexp_replace(bare, ":$", "")).alias("label"), F.when(normalized(F.col("line")) != "", normalized(F.col("line"))).alias("code"))
    ahead = Window.partitionBy("seq").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    marked = marked.withColumn("after", F.min(F.when(F.col("code").isNotNull(), F.col("pos"))).over(ahead))
    steps = marked.where("code IS NOT NULL AND after IS NOT NULL").select("seq", F.col("pos").alias("src"), F.col("after").alias("dst"), F.lit("next").alias("kind"))
    labels = marked.where("label IS NOT NULL").groupBy("seq", "label").agg(F.min_by("after", "pos").alias("dst")).where("dst IS NOT NULL")
    jumps = marked.where("code IS NOT NULL").select("seq", F.col("pos").alias("src"), F.regexp_extract("code", r"^(?:b|b\.\w+|cbn?z|tbn?z|j\w+)\s+(?:.*,\s*)?(\.L\w+)", 1).alias("label")).where("label <> ''")
    return steps.unionByName(jumps.join(labels, ["seq", "label"]).select("seq", "src", "dst", F.lit("branch").alias("kind")))


def class_letter_edges(lines: DataFrame, reach: int = 5) -> DataFrame:
    """(seq, lo, src, dst): lines up to ``reach`` apart that both name a register of one class, w or x."""
    each = lines.select(*KEY, "i", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b([wx])[0-9]+\b"), F.lit(1)))).alias("c"))
    ahead = each.select(*KEY, F.col("i").alias("src"), "c", F.explode(F.sequence(F.col("i") + 1, F.col("i") + reach)).alias("dst"))
    return ahead.join(each.withColumnRenamed("i", "dst"), [*KEY, "dst", "c"]).select(*KEY, "src", "dst").distinct()


def signatures(lines: DataFrame) -> DataFrame:
    """(seq, lo, signature): 16 hex digits of an md5 of the first five opcodes and the branch and memory shares in hundredths."""
    kind = nodes.node_category(F.col("line"))
    rows = lines.select(*KEY, "i", opcode(F.col("line")).alias("op"), kind.startswith("BRANCH").cast("int").alias("b"), kind.isin("LOAD", "STORE").cast("int").alias("m"))
    five = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("i", "op"))), 1, 5), lambda s: s["op"]), "_")
    share = lambda c: F.floor(F.sum(c) * 100 / F.count("*")).cast("string")
    return rows.groupBy(*KEY).agg(F.substring(F.md5(F.concat_ws("_", five, share("b"), share("m"))), 1, 16).alias("signature"))


def before_after(rows: DataFrame) -> DataFrame:
    """(op, before, after, delta): counts of operations before and after the insertion of ``nop`` s."""
    a = rows.groupBy("op").agg(F.count("*").alias("before"))
    b = augment.with_noops(rows).groupBy("op").agg(F.count("*").alias("after"))
    both = a.join(b, "op", "full").fillna(0, ["before", "after"])
    return both.withColumn("delta", F.col("after") - F.col("before"))


def sequence_stats(rows: DataFrame) -> DataFrame:
    """(seq, n, density, reuse, diversity): branches an operation, mentions a register, distinct operations an operation."""
    regs = rows.select("seq", F.explode(F.array("dest", "src")).alias("r")).where("r IS NOT NULL").groupBy("seq").agg((F.count("*") / F.countDistinct("r")).alias("reuse"))
    own = rows.groupBy("seq").agg(F.count("*").alias("n"), F.avg((F.col("op") == BRANCH).cast("int")).alias("density"), (F.countDistinct("op") / F.count("*")).alias("diversity"))
    return own.join(regs, "seq").select("seq", "n", *(F.round(c, 6).alias(c) for c in ("density", "reuse", "diversity")))


def flow_candidates(rows: DataFrame) -> DataFrame:
    """(seq, lo, hi): spans from a definition to a use of it, five either way, of five rows or more."""
    total = rows.groupBy("seq").agg(F.max("pos").alias("last"))
    spans = graph.data_dependence(rows).join(total, "seq").select("seq", F.greatest(F.lit(0), F.col("src") - 5).alias("lo"), F.least("last", F.col("dst") + 5).alias("hi"))
    return spans.where(F.col("hi") - F.col("lo") >= 4).distinct()


def pattern_candidates(rows: DataFrame) -> DataFrame:
    """(seq, lo, hi): ten rows either way of a contiguous pattern."""
    total = rows.groupBy("seq").agg(F.max("pos").alias("last"))
    return patterns.contiguous(rows, ["p*", "*", LOAD]).join(total, "seq").select("seq", F.greatest(F.lit(0), F.col("pos") - 10).alias("lo"), F.least("last", F.col("pos") + 12).alias("hi"))


#: Defaults of our own, node-type patterns (`semantic` has the fixed ones): contiguous types, and the weight of each in a class's score.
TYPE_PATTERNS = {
    "compare_branch": (("COMPARE", "BRANCH_COND"), "spectre_v1", 2), "branch_indexed": (("BRANCH_COND", "LOAD_INDEXED"), "spectre_v1", 3), "indexed_load": (("LOAD_INDEXED", "LOAD"), "spectre_v1", 2), "store_load": (("STORE", "LOAD"), "spectre_v4", 3),
    "cache_load": (("CACHE", "LOAD"), "l1tf", 4), "double_fence": (("FENCE", "FENCE"), "mds", 4), "call_ret": (("CALL", "RET"), "retbleed", 3), "branch_chain": (("BRANCH_COND", "BRANCH_COND"), "bhi", 2),
}


def type_scores(lines: DataFrame) -> DataFrame:
    """(seq, lo, <pattern> counts, <class>_score): contiguous node types and the weighted sums of them."""
    line = F.col("line")
    kind = nodes.node_category(line)
    rows = lines.select(*KEY, "i", F.when((kind == "LOAD") & (nodes.memory_type(line) == "INDEXED"), "LOAD_INDEXED").otherwise(kind).alias("t"))
    pairs = rows.withColumn("u", F.lead("t").over(Window.partitionBy(*KEY).orderBy("i")))
    got = pairs.groupBy(*KEY).agg(*(F.sum(((F.col("t") == a) & F.coalesce(F.col("u") == b, F.lit(False))).cast("int")).alias(k) for k, ((a, b), _, _) in TYPE_PATTERNS.items()))
    classes = dict.fromkeys(c for _, c, _ in TYPE_PATTERNS.values())
    return got.select("*", *(reduce(lambda a, b: a + b, (F.col(k) * w for k, (_, own, w) in TYPE_PATTERNS.items() if own == c)).alias(f"{c}_score") for c in classes))


def robust_best(found: DataFrame) -> DataFrame:
    """(seq, lo, winner, score): the largest class score over 0.3, of equals the first listed."""
    each = [F.struct(F.col(c).alias("score"), F.lit(-k).alias("o"), F.lit(c).alias("winner")) for k, c in enumerate(fusion.CLASS_SCORES)]
    # A row a score and their largest by group, so that the filter below doesn't go into each score's own terms; groups stay where they are.
    best = found.select(*KEY, F.explode(F.array(*each)).alias("s")).groupBy(*KEY).agg(F.max("s").alias("best"))
    return best.select(*KEY, "best.winner", "best.score").where("score > 0.3")


def samples(rows: DataFrame, cap: int = 40) -> DataFrame:
    """(seq, lo, label): windows that match the first rule, and of its hard negatives the first ``cap`` by md5."""
    rule = patterns.RULES[:1]
    positive = patterns.matched(rows, rule, 12, 12).where("reason IS NULL").select("seq", "lo", F.lit("SPECTRE_V1").alias("label"))
    order = F.md5(F.concat_ws("|", F.lit("42"), "seq", "lo"))
    negative = patterns.hard_negatives(rows, rule[0], 12).orderBy(order, "seq", "lo").limit(cap).select("seq", "lo", F.lit("BENIGN").alias("label"))
    return positive.unionByName(negative)


def _of(work):
    return lambda s, d: work(code_windows(s, d))


def _on(work):
    return lambda s, d: work(instructions(s, d))


QUERIES = {
    "label_from_name": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int")), F.lit(".s")).alias("name")).select("doc_id", label_of_name(F.col("name")).alias("label")),
    "register_usage": _of(register_usage), "register_swap": _of(swapped_registers), "neighbour_swap": _on(swapped_neighbours), "boosted_variants": _on(boosted), "cfg_targets": lambda s, d: cfg_targets(listing(s, d)), "class_letter_edges": _of(class_letter_edges),
    "gadget_signatures": _of(signatures), "before_after": _on(before_after), "sequence_stats": _on(sequence_stats), "flow_candidates": _on(flow_candidates), "pattern_candidates": _on(pattern_candidates), "type_scores": _of(type_scores),
    "robust_best": lambda s, d: robust_best(features.profiles(code_windows(s, d))), "labelled_samples": _on(samples),
}


def _nodes_sql() -> str:
    from fenceline.operators.listings import _NODES

    return f"WITH {_NODES}"


_NAME = f"{list(NAMES)}[(doc_id % {len(NAMES)} + 1)::INT]"
_LABEL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(n, '{p}')" for p in parts) + f" THEN '{label}'" for label, parts in NAME_LABELS) + " ELSE 'UNKNOWN' END"
_OPS = r"replace(lower(regexp_extract(line, '^\s*(\S+)', 1)), ',', '')"
_NOP = "CASE WHEN md5({k})[1:2] < '1a' THEN 1 ELSE 0 END"
_TYPES = ", ".join(f"count(*) FILTER (t = '{a}' AND u = '{b}') AS {k}" for k, ((a, b), _, _) in TYPE_PATTERNS.items())
_SUMS = ", ".join(" + ".join(f"{k} * {w}" for k, (_, own, w) in TYPE_PATTERNS.items() if own == c) + f" AS {c}_score" for c in dict.fromkeys(c for _, c, _ in TYPE_PATTERNS.values()))
ORACLES = {
    "label_from_name": f"SELECT doc_id, {_LABEL} AS label FROM (SELECT doc_id, lower({_NAME}) AS n FROM documents)",
    "register_usage": f"""{_nodes_sql()}, m AS (SELECT seq, pos, unnest(dest) AS reg, 1 AS d FROM nd UNION ALL SELECT seq, pos, unnest(srcs), 0 FROM nd), f AS (SELECT seq, reg, min(pos * 2 + d) AS k FROM m GROUP BY ALL)
      SELECT split_part(seq, ':', 1)::BIGINT AS seq, split_part(seq, ':', 2)::BIGINT AS lo, reg, CASE WHEN k % 2 = 1 THEN 'def' ELSE 'use' END AS state FROM f""",
    "register_swap": rf"""WITH {WINDOWS}, m AS (SELECT DISTINCT seq, lo, i, unnest(regexp_extract_all(line, '\b(x[0-9]+)\b', 1)) AS reg FROM aw), r AS (SELECT DISTINCT seq, lo, reg FROM m),
      p AS (SELECT a.seq, a.lo, a.reg AS x, b.reg AS y FROM r a JOIN r b ON a.seq = b.seq AND a.lo = b.lo AND a.reg < b.reg WHERE NOT EXISTS (SELECT 1 FROM m u JOIN m v ON u.seq = v.seq AND u.lo = v.lo AND u.i = v.i WHERE u.seq = a.seq AND u.lo = a.lo AND u.reg = a.reg AND v.reg = b.reg)),
      f AS (SELECT DISTINCT ON (seq, lo) * FROM p ORDER BY seq, lo, x, y)
      SELECT seq, lo, i, regexp_replace(regexp_replace(regexp_replace(line, '\b' || x || '\b', '@@', 'g'), '\b' || y || '\b', x, 'g'), '@@', y, 'g') AS line FROM aw JOIN f USING (seq, lo)""",
    "neighbour_swap": f"""WITH {EV}, s AS ({augment.ORACLES["independent_swap"].split(EV, 1)[1].strip()}) SELECT ev.seq, CASE WHEN pos = lo THEN pos + 1 WHEN pos = lo + 1 THEN pos - 1 ELSE pos END AS pos, op FROM ev JOIN s USING (seq)""",
    "boosted_variants": f"""WITH {EV}, c AS (SELECT seq, pos, op, k AS copy, {_NOP.format(k="k || '|' || seq || '|' || pos")} AS e FROM ev, range(1, 3) t(k)), u AS (SELECT seq, copy, pos, op, e, sum(e) OVER (PARTITION BY seq, copy ORDER BY pos) AS s FROM c)
      SELECT seq, copy::INT AS copy, (pos + s - e)::BIGINT AS pos, op FROM u UNION ALL SELECT seq, copy::INT, (pos + s)::BIGINT, 'nop' FROM u WHERE e = 1""",
    "cfg_targets": rf"""WITH {LISTING}, t AS (SELECT seq, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS b FROM li), m AS (SELECT *, b <> '' AND b NOT LIKE '.%' AND b NOT LIKE '%:' AND regexp_replace(split_part(b, ';', 1), '\s+$', '') <> '' AS code FROM t),
      a AS (SELECT m.*, (SELECT min(pos) FROM m n WHERE n.seq = m.seq AND n.pos > m.pos AND n.code) AS nx FROM m), l AS (SELECT seq, rtrim(b, ':') AS label, arg_min(nx, pos) AS dst FROM a WHERE regexp_full_match(b, '\.?\w+:') AND nx IS NOT NULL GROUP BY ALL),
      j AS (SELECT seq, pos AS src, regexp_extract(split_part(b, ';', 1), '^(b|b\.\w+|cbn?z|tbn?z|j\w+)\s+(.*,\s*)?(\.L\w+)', 3) AS label FROM a WHERE code)
      SELECT seq, pos AS src, nx AS dst, 'next' AS kind FROM a WHERE code AND nx IS NOT NULL UNION ALL SELECT j.seq, src, dst, 'branch' FROM j JOIN l ON l.seq = j.seq AND l.label = j.label WHERE j.label <> ''""",
    "class_letter_edges": rf"""WITH {WINDOWS}, c AS (SELECT DISTINCT seq, lo, i, unnest(regexp_extract_all(line, '\b([wx])[0-9]+\b', 1)) AS c FROM aw) SELECT DISTINCT a.seq, a.lo, a.i AS src, b.i AS dst FROM c a JOIN c b ON a.seq = b.seq AND a.lo = b.lo AND a.c = b.c AND b.i BETWEEN a.i + 1 AND a.i + 5""",
    "gadget_signatures": f"""{_nodes_sql()}, s AS (SELECT seq, string_agg({_OPS}, '_' ORDER BY pos) FILTER (pos < 5) AS five, count(*) FILTER (category LIKE 'BRANCH%') * 100 // count(*) AS b, count(*) FILTER (category IN ('LOAD', 'STORE')) * 100 // count(*) AS m FROM nd GROUP BY seq)
      SELECT split_part(seq, ':', 1)::BIGINT AS seq, split_part(seq, ':', 2)::BIGINT AS lo, md5(five || '_' || b || '_' || m)[1:16] AS signature FROM s""",
    "before_after": f"""WITH {EV}, c AS (SELECT op, count(*) AS n FROM ev GROUP BY op), x AS (SELECT sum({_NOP.format(k=f"'{augment.SEED}|' || seq || '|' || pos")})::BIGINT AS e FROM ev)
      SELECT op, n AS before, n AS after, 0 AS delta FROM c UNION ALL SELECT 'nop', 0, e, e FROM x""",
    "sequence_stats": f"""WITH {EV}, r AS (SELECT seq, count(*) / count(DISTINCT r) AS reuse FROM (SELECT seq, dest AS r FROM ev WHERE dest IS NOT NULL UNION ALL SELECT seq, src FROM ev) GROUP BY seq)
      SELECT seq, count(*) AS n, round(avg((op = '{BRANCH}')::INT), 6) AS density, round(any_value(reuse), 6) AS reuse, round(count(DISTINCT op) / count(*), 6) AS diversity FROM ev JOIN r USING (seq) GROUP BY seq""",
    "flow_candidates": f"WITH {EV}, {graph._DATA}, t AS (SELECT seq, max(pos) AS last FROM ev GROUP BY seq), s AS (SELECT DISTINCT dd.seq, greatest(0, dd.src - 5) AS lo, least(last, dst + 5) AS hi FROM dd JOIN t USING (seq)) SELECT * FROM s WHERE hi - lo >= 4",
    "pattern_candidates": f"WITH {EV}, l AS ({patterns._L3}), t AS (SELECT seq, max(pos) AS last FROM ev GROUP BY seq) SELECT l.seq, greatest(0, pos - 10) AS lo, least(last, pos + 12) AS hi FROM l JOIN t USING (seq) WHERE op LIKE 'p%' AND o1 IS NOT NULL AND o2 = '{LOAD}'",
    "type_scores": f"""{_nodes_sql()}, y AS (SELECT seq, pos, CASE WHEN category = 'LOAD' AND memory = 'INDEXED' THEN 'LOAD_INDEXED' ELSE category END AS t FROM nd), z AS (SELECT a.seq, a.t, b.t AS u FROM y a LEFT JOIN y b ON a.seq = b.seq AND b.pos = a.pos + 1), c AS (SELECT seq, {_TYPES} FROM z GROUP BY seq)
      SELECT split_part(seq, ':', 1)::BIGINT AS seq, split_part(seq, ':', 2)::BIGINT AS lo, {", ".join(TYPE_PATTERNS)}, {_SUMS} FROM c""",
    "robust_best": features._SCORED + ", u AS (" + " UNION ALL ".join(f"SELECT seq, lo, '{c}' AS winner, {c} AS score, {k} AS o FROM z" for k, c in enumerate(fusion.CLASS_SCORES)) + "), b AS (SELECT DISTINCT ON (seq, lo) * FROM u ORDER BY seq, lo, score DESC, o) SELECT seq, lo, winner, score FROM b WHERE score > 0.3",
    "labelled_samples": f"""{patterns._WIN.format(size=12, step=12)}, n AS (SELECT seq, lo FROM w WHERE ({patterns._LIKE}) AND (list_contains(ops, '{FENCE}') OR NOT ({patterns._N1})) ORDER BY md5('42|' || seq || '|' || lo), seq, lo LIMIT 40)
      SELECT seq, lo, 'SPECTRE_V1' AS label FROM w WHERE NOT list_contains(ops, '{FENCE}') AND ({patterns._N1}) UNION ALL SELECT seq, lo, 'BENIGN' FROM n""",
}
