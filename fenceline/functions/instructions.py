"""Column builders over assembly lines: normalization, tokens, categories, traces, keys. No Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first category whose pattern the lower-cased line matches is the line's; the order matters. ``nodes.node_category`` has the
# fixed patterns, which miss timer reads, indirect ARM calls, unsigned x86 branches, x86 loads and sized x86 opcodes.
CATEGORIES: tuple[tuple[str, str], ...] = (
    ("FENCE", r"^(lfence|mfence|sfence|dsb|dmb|isb|csdb|cpuid|fence)\b|^sb$"),
    ("CACHE", r"^(clflush|clflushopt|clwb|cldemote|invlpg|wbinvd|prefetch\w*|prfm|dc|ic|cbo\.\w+)\b"),
    ("TIMING", r"^(rdtsc|rdtscp|rdpmc)\b|\b(cntvct|pmccntr)"),
    ("RET", r"^(ret[qlw]?|eret|iretq?)\b"),
    ("CALL_INDIRECT", r"^(blr\b|callq?\s+\*|jalr\b)"),
    ("CALL", r"^(call|callq|bl|jal)\b"),
    ("JUMP_INDIRECT", r"^(br|jr)\b|^jmpq?\s+\*"),
    ("BRANCH_COND", r"^(b\.\w+|cbn?z|tbn?z|b(eq|ne|lt|le|gt|ge|hs|lo|hi|ls|mi|pl|ltu|geu|eqz|nez)|j(?!mp)\w+)\b"),
    ("BRANCH_UNCOND", r"^(b|jmp|jmpq|j)\b"),
    ("COMPARE", r"^(cmp|cmn|tst|test|ccmp|ccmn|fcmp)[bwlq]?\b"),
    ("STACK", r"^(push|pop)[wlq]?\b"),
    ("STORE", r"^(str\w*|stp|stur\w*|stl\w*|stx\w*|stnp|sttr\w*|movnti|stos[bwdq]?|sb|sh|sw|sd)\b|^mov\w*\s+([^(\[]+,\s*-?\w*\(|(\w+ ptr )?\[)"),
    ("LOAD", r"^(ldr\w*|ldp\w*|ldur\w*|lda\w*|ldx\w*|ldnp|ldtr\w*|lods[bwdq]?|lb|lh|lw|ld|lbu|lhu|lwu)\b|^mov\w*\s+(-?\w*\([^)]*\)\s*,|[^\[,]+,\s*(\w+ ptr )?\[)"),
    ("MOVE", r"^(mov\w*|lea[wlq]?|adrp?|li|la|mv|cmov\w*)\b"),
    ("ARITHMETIC", r"^(add|sub|mul|madd|msub|imul|div|idiv|sdiv|udiv|inc|dec|adc|sbb|sbc|neg)\w*\b"),
    ("LOGIC", r"^(and|orr|eor|orn|bic|or|xor|not|mvn)[bwlqi]?\b"),
    ("SHIFT", r"^(lsl|lsr|asr|ror|rol|shl|shr|sal|sar|sll|srl|sra)[bwlqi]?\b"),
    ("NOP", r"^(nop|hint)\b"),
)


def normalized(line: Column, cut_hash: bool = False) -> Column:
    """Trimmed, cut at the first ``;`` (and ``#`` with ``cut_hash``); empty for blanks, directives and labels."""
    bare = F.regexp_replace(line, r"^\s+|\s+$", "")
    cut = F.regexp_replace(F.regexp_extract(bare, r"^[^;#]*" if cut_hash else r"^[^;]*", 0), r"\s+$", "")
    return F.when((bare == "") | bare.startswith(".") | bare.endswith(":"), F.lit("")).otherwise(cut)


def opcode(line: Column) -> Column:
    """The first token, lower-cased, without a comma."""
    return F.regexp_replace(F.lower(F.regexp_extract(line, r"^\s*(\S+)", 1)), ",", "")


def operands(line: Column) -> Column:
    """What follows the opcode, split at commas outside brackets and trimmed."""
    rest = F.regexp_extract(line, r"^\s*\S+\s+(.*)$", 1)
    parts = F.transform(F.split(rest, r",(?![^\[(]*[\])])"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def _register_names() -> list[str]:
    """Register names of ARM64, x86 and RISC-V, from the rules by which each architecture numbers and widens them."""
    arm = [f"{kind}{n}" for kind in "xw" for n in range(31)] + ["sp", "wsp", "lr", "fp", "pc", "xzr", "wzr"]
    named = [prefix + stem for stem in ("ax", "bx", "cx", "dx", "si", "di", "bp", "sp") for prefix in ("r", "e", "")]
    numbered = [f"r{n}{width}" for n in range(8, 16) for width in ("", "d", "w", "b")]
    riscv = ["zero", "ra", "gp", "tp", *(f"a{n}" for n in range(8)), *(f"s{n}" for n in range(12)), *(f"t{n}" for n in range(7))]
    return [*dict.fromkeys(arm + named + numbered + riscv)]


_REGISTERS = _register_names()


def registers(line: Column) -> Column:
    """Distinct registers in order of appearance: the words of a line that name one, with or without ``%``."""
    words = F.split(F.regexp_replace(F.lower(line), "[^a-z0-9_.]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: w.isin(_REGISTERS)))


def category(line: Column) -> Column:
    text = F.lower(F.trim(line))
    return F.coalesce(*(F.when(text.rlike(pattern), F.lit(name)) for name, pattern in CATEGORIES), F.lit("OTHER"))


def trace(sequence: Column) -> Column:
    """Categories of a sequence's lines, without no-ops, joined by spaces."""
    kinds = F.transform(sequence, category)
    return F.array_join(F.filter(kinds, lambda k: k != "NOP"), " ")


def immediate_bucket(operand: Column) -> Column:
    """ZERO, SMALL (1 to 8), NEG, MED (up to 0xFFFF), LARGE, or UNK of ``#4``, ``$0x10``, ``-3`` and the like."""
    text = F.regexp_replace(F.trim(operand), r"^[#$]", "")
    hexed = F.regexp_extract(text, r"^0[xX]([0-9A-Fa-f]+)$", 1)
    value = F.coalesce(F.when(hexed != "", F.conv(hexed, 16, 10).try_cast("long")), text.try_cast("long"))
    return F.when(value.isNull(), "UNK").when(value == 0, "ZERO").when(value < 0, "NEG").when(value <= 8, "SMALL").when(value <= 0xFFFF, "MED").otherwise("LARGE")


def architecture(sequence: Column) -> Column:
    """By words of the text: arm64, then x86_64, then riscv, else unknown."""
    text = F.lower(F.array_join(sequence, "\n"))
    return F.when(text.rlike(r"\b(ldr|str|adrp|cbn?z|b\.\w+|dsb)\b"), "arm64").when(text.rlike(r"%[re][a-z]{2}|\b(lfence|movq|movl|clflush)\b"), "x86_64").when(text.rlike(r"\b(lw|sw|addi|jalr)\b"), "riscv").otherwise("unknown")


def sequence_key(sequence: Column, separator: str = "||", lower: bool = True, algorithm: str = "md5") -> Column:
    """Hash of the trimmed (and lower-cased) lines, joined."""
    strip = lambda x: F.regexp_replace(F.lower(x) if lower else x, r"^\s+|\s+$", "")
    joined = F.array_join(F.transform(sequence, strip), separator)
    return F.md5(joined) if algorithm == "md5" else F.sha2(joined, 256)


def group_key(path: Column) -> Column:
    """Base name, cut at ``_clang_`` or ``_gcc_``, else without its extension: variants of one source stay in one group."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    cut = F.regexp_extract(base, r"^(.*?)_(clang|gcc)_", 1)
    return F.when(cut != "", cut).otherwise(F.regexp_replace(base, r"\.[^.]*$", ""))


# Labels that begin measurement code, lines that end a measurement.
BOILERPLATE_LABEL = r"(?i)^\s*(_barrier:|_rd:|__mm_mfence:|__mm_lfence:|__mm_clflush:|__mm_clflushopt:)\s*$"
MEASUREMENT = r"(?i)^\s*(dsb\s+ish|dsb\s+sy|mrs\s+|rdtsc|rdtscp)\b"


def _through_last(flags: Column) -> Column:
    """How many entries there are up to the last false one."""
    back = F.array_position(F.reverse(flags), False).cast("int")
    return F.when(back == 0, F.lit(0)).otherwise(F.size(flags) - back + 1)


def stripped_tail(sequence: Column, keep: int = 3) -> Column:
    """Cut at the first measurement label; then without the trailing measurement lines, no-ops and returns right after a measurement
    line, then without ``add sp, sp,`` right after a barrier, but never under ``keep`` lines; unchanged where fewer would be left."""
    label = F.array_position(F.transform(sequence, lambda x: x.rlike(BOILERPLATE_LABEL)), True).cast("int")
    body = F.when(label > 0, F.slice(sequence, 1, F.greatest(label - 1, F.lit(0)))).otherwise(sequence)
    before = lambda a, i: F.coalesce(F.get(a, i - 1), F.lit(""))
    tail = F.transform(body, lambda x, i: x.rlike(MEASUREMENT) | x.rlike(r"(?i)^\s*nop\s*$") | (x.rlike(r"(?i)^\s*(ret|retq)\s*$") & before(body, i).rlike(MEASUREMENT)))
    short = F.when(F.size(body) > keep, F.slice(body, 1, F.greatest(F.lit(keep), _through_last(tail)))).otherwise(body)
    teardown = F.transform(short, lambda x, i: F.lower(x).rlike(r"^\s*add[ \t]sp, sp,") & F.lower(before(short, i)).rlike(r"^\s*(dsb|isb)"))
    out = F.when(F.size(short) > keep, F.slice(short, 1, F.greatest(F.lit(keep), _through_last(teardown)))).otherwise(short)
    return F.when((F.size(sequence) <= keep) | (F.size(out) < keep), sequence).otherwise(out)


def nop_inserted(key: Column, sequence: Column, one_in: int = 10) -> Column:
    """A ``nop`` after about one line in ``one_in``, chosen by hash."""
    pick = lambda x, i: F.when(F.pmod(F.xxhash64(key, i), F.lit(one_in)) == 0, F.array(x, F.lit("nop"))).otherwise(F.array(x))
    return F.flatten(F.transform(sequence, pick))


def barrier_inserted(sequence: Column, barrier: str = "dsb sy") -> Column:
    """A barrier before the first load after the first conditional branch; unchanged where there is none."""
    kinds = F.transform(sequence, category)
    branch = F.array_position(kinds, "BRANCH_COND").cast("int")
    load = F.array_position(F.slice(kinds, branch + 1, F.size(kinds)), "LOAD").cast("int")
    return F.when((branch > 0) & (load > 0), F.array_insert(sequence, branch + load, F.lit(barrier))).otherwise(sequence)
