"""Choosing windows and samples: large and discriminative windows, utility and benign filters, unions, caps by hash.

Windows are (seq, lo, ...) of assembly listings. A null line counts as an empty one, a null label as unknown; windows alike
in all columns are separate rows. Everything is window frames, aggregates and text patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fenceline.functions.instructions import category, opcode
from fenceline.operators.splits import chance, labelled
from fenceline.plans.assembly_analog import CODE, LISTING, WINDOWS, code, code_windows, listing, windows, windows_sql

# Labels and calls of utility code.
UTILITY_LABELS = (
    "_flush_probe_array:", "flush_probe_array:", "_measure_time:", "_rdtsc_wrapper:", "_rdtsc:", "rdtsc:", "_reload_side_channel:", "_perform_measurement:", "perform_measurement:", "__mm_mfence:", "_mm_mfence:", "__mm_lfence:", "_mm_lfence:",
    "__mm_clflush:", "_mm_clflush:", "mfence:", "lfence:", "check:", "_common_init:", "common_init:", "_benign_target:", "benign_target:", "_sigsegv_handler",
)
UTILITY_CALLS = (
    r"bl\s+_?flush_probe_array", r"bl\s+_?_mm_mfence", r"bl\s+_?_mm_lfence", r"bl\s+_?_mm_clflush", r"bl\s+_?perform_measurement", r"bl\s+_?common_init", r"bl\s+_?rdtsc", r"bl\s+_?printf", r"bl\s+_?bzero", r"bl\s+_?signal",
    r"bl\s+_?siglongjmp", r"bl\s+_?sigsetjmp", r"bl\s+_?clock_gettime", r"adrp\s+.*l_\.str", r"add\s+.*l_\.str.*@pageoff",
)
# Patterns that a benign window must not hold, over its lines joined by newlines.
ATTACK_PATTERNS = {
    "SPECTRE_V1": (r"(cmp|test|tst).*\n.*\bj[a-z]+\b.*\n.*\bmov.*\[", r"(cmp|tst).*\n.*\bb\.(eq|ne|lt|gt|le|ge).*\n.*\bldr"),
    "SPECTRE_V2": (r"\bjmp\s+\*", r"\bcall\s+\*", r"\bbr\s+x", r"\bblr\s+x"),
    "L1TF": (r"\bclflush\b", r"\bclflushopt\b", r"\bclwb\b", r"\bdc\s+civac\b"),
    "MDS": (r"\bverw\b", r"\bmfence\b.*\blfence\b", r"\blfence\b.*\bclflush\b"),
    "RETBLEED": (r"\bret\b.*\n.*\blfence\b", r"\bret\b.*\n.*\bint3\b", r"\bretq?\b.*\bnop\b.*\bnop\b"),
    "BHI": (r"\bjmp\s+\*.*\[", r"\bcall\s+\*.*\[", r"\bb\.[a-z]+.*\n.*\bb\.[a-z]+"),
    "INCEPTION": (r"\bcall\b.*\n.*\bret\b", r"\bbl\b.*\n.*\bret\b"),
    "TIMING": (r"\brdtsc\b", r"\brdtscp\b", r"\bmrs\b.*cntvct"),
}
# Patterns counted for a window's suspicion, and what each count weighs; the sum counts by thirds.
SUSPICION = {
    "indirect_branches": ((r"\b(jmp|call)\s+\*", r"\b(br|blr)\s+x"), 0.3),
    "branch_load_count": ((r"(j[a-z]+|b\.[a-z]+).*\n.*\b(mov|ldr)",), 0.2),
    "cache_ops": ((r"\b(clflush|clflushopt|clwb|dc\s+civac)\b",), 0.4),
    "timing_ops": ((r"\b(rdtsc|rdtscp|mrs.*cntvct)\b",), 0.5),
    "barriers": ((r"\b(mfence|lfence|sfence|dmb|dsb|isb)\b",), 0.1),
}


def texts(lines: DataFrame) -> DataFrame:
    """(seq, lo, n, first, text): a window's lines joined by newlines, lower-cased."""
    whole = lines.groupBy("seq", "lo").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("line", F.lit("")).alias("line")))), lambda s: s["line"]).alias("s"))
    return whole.select("seq", "lo", F.size("s").alias("n"), F.lower(F.trim(F.get("s", F.lit(0)))).alias("first"), F.lower(F.array_join("s", "\n")).alias("text"))


def utility(lines: DataFrame) -> DataFrame:
    """(seq, lo, utility): windows that begin at a utility label or whose lines are utility calls by more than three tenths."""
    own = lines.groupBy("seq", "lo").agg(F.sum((~F.col("line").rlike(r"^\s*$|:\s*$")).cast("int")).alias("code"))
    calls = sum((F.regexp_count("text", F.lit(p)) for p in UTILITY_CALLS), F.lit(0))
    label = F.lit(False)
    for x in UTILITY_LABELS:
        label = label | F.col("first").startswith(x)
    found = texts(lines).join(own, ["seq", "lo"])
    return found.select("seq", "lo", (label | ((F.col("code") > 0) & (calls > F.col("code") * 0.3))).alias("utility"))


def benign(lines: DataFrame, least: int = 12) -> DataFrame:
    """(seq, lo, valid, reasons, suspicion): windows long enough, without an attack's pattern, timing or cache operation, and of a suspicion of 0.5 at most."""
    found = texts(lines)
    hit = lambda patterns: F.coalesce(*(F.when(F.col("text").rlike("(?m)" + p), True) for p in patterns), F.lit(False))
    counts = {k: sum((F.regexp_count("text", F.lit(p)) for p in own), F.lit(0)) for k, (own, _) in SUSPICION.items()}
    suspicion = F.round(F.least(F.lit(1.0), sum((counts[k] * w for k, (_, w) in SUSPICION.items()), F.lit(0.0)) / 3), 6)
    reasons = [F.when(F.col("n") < least, "too_short"), *(F.when(hit(p), k) for k, p in ATTACK_PATTERNS.items()), F.when(suspicion > 0.5, "suspicious"), F.when(counts["timing_ops"] > 0, "timing_ops"), F.when(counts["cache_ops"] > 0, "cache_ops")]
    why = F.array_compact(F.array(*reasons))
    return found.select("seq", "lo", (F.size(why) == 0).alias("valid"), F.array_join(why, ",").alias("reasons"), suspicion.alias("suspicion"))


def large_windows(rows: DataFrame, width: int = 10, least: int = 15) -> DataFrame:
    """(seq, lo, hi, kind): windows round barriers (30 before, 40 after) and branches (20, 30), sliding ones of 30, 40 and 50 lines every 15, and whole listings of up to 80.

    Of windows in the same bucket of ``width`` the first stays, anchors before slides; the bucket is taken before the
    length is tested. Whole listings have no bucket.
    """
    total = F.count("*").over(Window.partitionBy("seq"))
    marked = rows.select("seq", "pos", category(F.col("line")).alias("kind"), total.alias("total"))
    before = F.when(F.col("kind").isin("FENCE", "CACHE"), 30).when(F.col("kind") == "BRANCH_COND", 20)
    around = marked.withColumn("before", before).where("before IS NOT NULL").select("seq", F.greatest(F.lit(0), F.col("pos") - F.col("before")).alias("lo"), F.least(F.col("total"), F.col("pos") + F.col("before") + 11).alias("hi"), F.when(F.col("before") == 30, "primary").otherwise("secondary").alias("kind"), F.col("pos").alias("o"), F.lit(0).alias("way"))
    sizes = F.explode(F.array(*map(F.lit, (30, 40, 50))))
    slides = marked.where("pos % 15 = 0").withColumn("size", sizes).where(F.col("pos") + F.col("size") <= F.col("total")).select("seq", F.col("pos").alias("lo"), (F.col("pos") + F.col("size")).alias("hi"), F.lit("sliding").alias("kind"), (F.col("size").cast("long") * 1_000_000_000 + F.col("pos")).alias("o"), F.lit(1).alias("way"))
    bucket = Window.partitionBy("seq", F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)).orderBy("way", "o")
    one = around.unionByName(slides).withColumn("nth", F.row_number().over(bucket)).where("nth = 1").select("seq", "lo", "hi", "kind")
    whole = marked.groupBy("seq").agg(F.lit(0).alias("lo"), F.count("*").alias("hi"), F.lit("full_file").alias("kind")).where("hi <= 80")
    return one.unionByName(whole.select("seq", "lo", "hi", "kind")).where(F.col("hi") - F.col("lo") >= least)


#: Defaults of our own, rules of a discriminative window: required, supporting and disqualifying patterns, least score.
DISCRIMINATIVE = (
    ("L1TF", (r"clflush|dc\s+civac", r"rdtsc|cntvct"), (r"mfence|dsb",), (r"\bcall\b",), 1.5),
    ("SPECTRE_V1", (r"cmp|test", r"jae|jb|b\.hs|b\.lo"), (r"\[.*,.*\]|\(.*,.*\)",), (r"lfence|csdb",), 2.0),
)


def discriminative(rows: DataFrame) -> DataFrame:
    """(seq, lo, size, kind, score): windows of 25, 35 and 50 lines every 10 that reach a class's least score: required + supporting / 2 - 2 disqualifying."""
    total = F.count("*").over(Window.partitionBy("seq"))
    own = Window.partitionBy("seq").orderBy("pos")
    marked = rows.withColumn("total", total)
    names = []
    for k, (_, required, supporting, against, _) in enumerate(DISCRIMINATIVE):
        for group, patterns in (("r", required), ("s", supporting), ("a", against)):
            for p, pattern in enumerate(patterns):
                names.append((f"{group}{k}{p}", pattern))
    if len(names) > 63:
        raise ValueError("more patterns than a number has bits")
    at = {n: k for k, (n, _) in enumerate(names)}
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.lower("line").rlike(p), F.lit(1 << at[n]).cast("long")).otherwise(F.lit(0).cast("long")) for n, p in names))
    marked = marked.select("seq", "pos", "total", bits.alias("bits"))  # a line's flags are one number, so that sorts and frames hold little
    out = None
    for size in (25, 35, 50):
        frame = own.rowsBetween(0, size - 1)
        seen = marked.select("seq", "pos", "total", F.bit_or("bits").over(frame).alias("bits")).where((F.col("pos") % 10 == 0) & (F.col("pos") + size <= F.col("total")))
        each = []
        for k, (name, required, supporting, against, least) in enumerate(DISCRIMINATIVE):
            count = lambda g, patterns, k=k: sum((F.getbit("bits", F.lit(at[f"{g}{k}{p}"])).cast("int") for p in range(len(patterns))), F.lit(0))
            score = count("r", required) + count("s", supporting) * 0.5 - count("a", against) * 2
            each.append(F.struct(F.lit(name).alias("kind"), score.cast("double").alias("score"), F.lit(least).alias("least")))
        part = seen.select("seq", F.col("pos").alias("lo"), F.lit(size).alias("size"), F.explode(F.array(*each)).alias("w")).select("seq", "lo", "size", "w.kind", "w.score", "w.least").where("score >= least").drop("least")
        out = part if out is None else out.unionByName(part)
    return out


def interesting(lines: DataFrame) -> DataFrame:
    """(seq, lo, interesting): windows with control flow or memory and two distinct opcodes."""
    kind = category(F.col("line"))
    rows = lines.select("seq", "lo", opcode(F.col("line")).alias("op"), (kind.startswith("BRANCH") | kind.isin("CALL", "CALL_INDIRECT", "RET", "JUMP_INDIRECT", "LOAD", "STORE")).alias("flow"))
    return rows.groupBy("seq", "lo").agg(((F.max(F.col("flow").cast("int")) == 1) & (F.countDistinct("op") >= 2)).alias("interesting"))


def merged(one: DataFrame, other: DataFrame, least: int = 5) -> DataFrame:
    """(id, label, group, weight): records of two schemas as one: missing labels of the first become BENIGN where it says benign, the second is benign of its own group; short ones go."""
    first = one.select("id", F.coalesce("vuln_label", F.when(F.col("label") == "benign", F.lit("BENIGN"))).alias("label"), "group", "n")
    second = other.select("id", F.lit("BENIGN").alias("label"), F.lit("github_negatives").alias("group"), "n", F.lit(1.0).alias("weight"))
    return first.unionByName(second, allowMissingColumns=True).where(F.col("n") >= least).drop("n")


def honoured(rows: DataFrame, seed: int = 42, share_percent: int = 20) -> DataFrame:
    """(id, split): an explicit split where there is one, else by the group's hash."""
    own = F.when(F.conv(F.substring(chance(seed, "group"), 1, 6), 16, 10).cast("long") % 100 < share_percent, F.lit("test")).otherwise(F.lit("train"))
    return rows.select("id", F.coalesce("given", own).alias("split"))


def shuffled(rows: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """(id, label): the first ``cap`` rows in the order of md5(seed || id)."""
    return rows.select("id", "label").orderBy(chance(seed), "id").limit(cap)


def positional_union(rows: DataFrame) -> DataFrame:
    """(seq, lo, hi): windows round memory accesses with two or more among the next nine, 15 lines either way, and round timing reads, 25 either way."""
    own = Window.partitionBy("seq").orderBy("pos")
    kind = category(F.col("line"))
    marked = rows.select("seq", "pos", kind.isin("LOAD", "STORE").cast("int").alias("mem"), (kind == "TIMING").alias("time"), F.count("*").over(Window.partitionBy("seq")).alias("total"))
    marked = marked.withColumn("next", F.sum("mem").over(own.rowsBetween(1, 9)))
    reach = F.when((F.col("mem") == 1) & (F.col("next") >= 2), 15).when(F.col("time"), 25)
    return marked.withColumn("reach", reach).where("reach IS NOT NULL").select("seq", F.greatest(F.lit(0), F.col("pos") - F.col("reach")).alias("lo"), F.least(F.col("total") - 1, F.col("pos") + F.col("reach")).alias("hi"))


def _merge_inputs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "benign").otherwise("vuln").alias("label"), F.when(F.col("doc_id") % 3 != 0, F.upper("lang")).alias("vuln_label"), F.col("source").alias("group"), F.size(F.split("text", "\n")).alias("n"))
    other = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n"))
    return one, other


def _given(spark, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).withColumn("given", F.when(F.col("id") % 7 == 0, "test").when(F.col("id") % 7 == 1, "train"))


QUERIES = {
    "utility_windows": lambda s, d: utility(windows(listing(s, d))),
    "benign_validation": lambda s, d: benign(code_windows(s, d)),
    "large_windows": lambda s, d: large_windows(code(s, d)),
    "discriminative_windows": lambda s, d: discriminative(code(s, d)),
    "interesting_windows": lambda s, d: interesting(code_windows(s, d)),
    "merged_records": lambda s, d: merged(*_merge_inputs(s, d)),
    "explicit_split": lambda s, d: honoured(_given(s, d)),
    "shuffle_cap": lambda s, d: shuffled(labelled(s, d), 60),
    "memory_timing_windows": lambda s, d: positional_union(code(s, d)),
}
_TX = "tx AS (SELECT seq, lo, count(*) AS n, lower(string_agg(line, chr(10) ORDER BY i)) AS text, lower(arg_min(line, i)) AS f FROM aw GROUP BY ALL)"


def _kinds_sql() -> str:
    """The mended category of each line of the analog's lists, as the functions' tests have them; a table by opcode and operands."""
    return r"""k AS (SELECT seq, pos, line, CASE WHEN regexp_matches(l, '^(lfence|mfence|sfence|dsb|dmb|isb|csdb|cpuid)\b') THEN 'FENCE' WHEN regexp_matches(l, '^(clflush|invlpg|prfm|dc)\b') THEN 'CACHE' WHEN regexp_matches(l, '^rdtscp?$|cntvct') THEN 'TIMING'
      WHEN regexp_matches(l, '^(b\.|cbn?z|tbn?z|j[^m])') THEN 'BRANCH_COND' WHEN regexp_matches(l, '^(str|stp)\b|^mov\w*\s+([^(\[]+,\s*-?\w*\(|\[)') THEN 'STORE' WHEN regexp_matches(l, '^(ldr\w*|ldp)\b|^mov\w*\s+(-?\w*\([^)]*\)\s*,|[^\[,]+,\s*\[)') THEN 'LOAD'
      WHEN regexp_matches(l, '^(ret|retq|bl|blr|br|b|jmp|call|callq)\b') THEN 'FLOW' ELSE 'OTHER' END AS kind FROM (SELECT *, lower(line) AS l FROM {rows}))"""


def _discriminative_sql() -> str:
    parts = []
    for name, required, supporting, against, least in DISCRIMINATIVE:
        has = lambda p: f"(EXISTS (SELECT 1 FROM co WHERE co.seq = w.seq AND co.pos BETWEEN w.lo AND w.lo + w.size - 1 AND regexp_matches(lower(line), '{p}')))::INT"
        score = " + ".join(map(has, required)) + "".join(f" + {has(p)} * 0.5" for p in supporting) + "".join(f" - {has(p)} * 2" for p in against)
        parts.append(f"SELECT seq, lo, size, '{name}' AS kind, ({score})::DOUBLE AS score, {least} AS least FROM w")
    return f"WITH {CODE}, n AS (SELECT seq, count(*) AS total FROM co GROUP BY seq), w AS (SELECT seq, size, unnest(range(0, total - size + 1, 10)) AS lo FROM n, (VALUES (25), (35), (50)) v(size) WHERE total >= size), u AS ({' UNION ALL '.join(parts)}) SELECT seq, lo, size, kind, score FROM u WHERE score >= least"


_SUS = " + ".join(f"len(regexp_extract_all(text, '{p}')) * {w}::DOUBLE" for own, w in SUSPICION.values() for p in own)
_WHY = ", ".join(f"CASE WHEN {' OR '.join(f'''regexp_matches(text, '(?m){p}')''' for p in patterns)} THEN '{k}' END" for k, patterns in ATTACK_PATTERNS.items())
ORACLES = {
    "utility_windows": rf"""WITH {LISTING}, {windows_sql("li")}, {_TX}, c AS (SELECT seq, lo, count(*) FILTER (trim(line) <> '' AND NOT regexp_matches(line, ':\s*$')) AS code FROM aw GROUP BY ALL)
      SELECT seq, lo, ({" OR ".join(f"starts_with(f, '{x}')" for x in UTILITY_LABELS)}) OR (code > 0 AND ({" + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in UTILITY_CALLS)}) / code > 0.3) AS utility FROM tx JOIN c USING (seq, lo)""",
    "benign_validation": f"""WITH {WINDOWS}, {_TX}, s AS (SELECT *, round(least(1, ({_SUS}) / 3), 6) AS suspicion FROM tx),
      r AS (SELECT seq, lo, suspicion, list_filter([CASE WHEN n < 12 THEN 'too_short' END, {_WHY}, CASE WHEN suspicion > 0.5 THEN 'suspicious' END, CASE WHEN regexp_matches(text, '{SUSPICION["timing_ops"][0][0]}') THEN 'timing_ops' END, CASE WHEN regexp_matches(text, '{SUSPICION["cache_ops"][0][0]}') THEN 'cache_ops' END], lambda x: x IS NOT NULL) AS why FROM s)
      SELECT seq, lo, len(why) = 0 AS valid, array_to_string(why, ',') AS reasons, suspicion FROM r""",
    "large_windows": f"""WITH {CODE}, {_kinds_sql().format(rows="co")}, n AS (SELECT seq, count(*) AS total FROM co GROUP BY seq), a AS (SELECT seq, pos, CASE WHEN kind IN ('FENCE', 'CACHE') THEN 30 WHEN kind = 'BRANCH_COND' THEN 20 END AS b FROM k),
      u AS (SELECT seq, greatest(0, pos - b) AS lo, least(total, pos + b + 11) AS hi, CASE b WHEN 30 THEN 'primary' ELSE 'secondary' END AS kind, pos AS o, 0 AS way FROM a JOIN n USING (seq) WHERE b IS NOT NULL
        UNION ALL SELECT seq, lo, lo + size, 'sliding', size * 1000000000 + lo, 1 FROM (SELECT seq, size, unnest(range(0, total - size + 1, 15)) AS lo FROM n, (VALUES (30::BIGINT), (40), (50)) v(size) WHERE total >= size)),
      f AS (SELECT DISTINCT ON (seq, lo // 10, hi // 10) seq, lo, hi, kind FROM u ORDER BY seq, lo // 10, hi // 10, way, o) SELECT * FROM (SELECT * FROM f UNION ALL SELECT seq, 0, total, 'full_file' FROM n WHERE total <= 80) WHERE hi - lo >= 15""",
    "discriminative_windows": _discriminative_sql(),
    "interesting_windows": rf"""WITH {WINDOWS}, {_kinds_sql().format(rows="(SELECT seq, lo, i AS pos, line FROM aw)").replace("SELECT seq, pos, line, CASE", "SELECT seq, lo, line, CASE")}
      SELECT seq, lo, max((kind IN ('BRANCH_COND', 'FLOW', 'LOAD', 'STORE'))::INT) = 1 AND count(DISTINCT replace(lower(regexp_extract(line, '^\s*(\S+)', 1)), ',', '')) >= 2 AS interesting FROM k GROUP BY seq, lo""",
    "merged_records": """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'BENIGN' ELSE upper(lang) END AS label, source AS "group", NULL::DOUBLE AS weight FROM documents WHERE len(string_split(text, chr(10))) >= 5
      UNION ALL SELECT conv_id, 'BENIGN', 'github_negatives', 1.0 FROM conversations GROUP BY conv_id HAVING count(*) >= 5""",
    "explicit_split": "SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'test' WHEN doc_id % 7 = 1 THEN 'train' WHEN ('0x' || md5('42|' || source)[1:6])::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM documents",
    "shuffle_cap": "SELECT doc_id AS id, lang AS label FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 60",
    "memory_timing_windows": f"""WITH {CODE}, {_kinds_sql().format(rows="co")}, n AS (SELECT seq, count(*) AS total FROM co GROUP BY seq),
      c AS (SELECT a.seq, a.pos, any_value(a.kind) AS kind, count(b.pos) AS nx FROM k a LEFT JOIN k b ON a.seq = b.seq AND b.pos BETWEEN a.pos + 1 AND a.pos + 9 AND b.kind IN ('LOAD', 'STORE') GROUP BY a.seq, a.pos),
      r AS (SELECT seq, pos, CASE WHEN kind IN ('LOAD', 'STORE') AND nx >= 2 THEN 15 WHEN kind = 'TIMING' THEN 25 END AS r FROM c) SELECT seq, greatest(0, pos - r) AS lo, least(total - 1, pos + r) AS hi FROM r JOIN n USING (seq) WHERE r IS NOT NULL""",
}
