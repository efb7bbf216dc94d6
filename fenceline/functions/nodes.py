"""Columns of dependence-graph nodes over one line of assembly: category, registers, memory access, flags, vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fenceline.functions import fixed

#: Categories whose registers are all sources.
ALL_SOURCE = ("STORE", "COMPARE", "BRANCH_COND", "BRANCH_UNCOND", "CALL", "CALL_INDIRECT")


def _has(line: Column, name: str) -> Column:
    return line.rlike("(?i)" + fixed.NODE_PATTERNS[name])


def node_category(line: Column) -> Column:
    """The category by the fixed patterns, in their order, quirks and all; ``instructions.category`` has the mended rules."""
    has = lambda *names: [_has(line, n) for n in names]
    fence, cache, timing, ret, call, indirect = has("fence", "cache", "timing", "ret", "call", "indirect")
    cond, uncond, compare, stack, mem, move, arithmetic, logic, shift = has("branch_cond", "branch_uncond", "compare", "stack_op", "memory_operand", "move", "arithmetic", "logic", "shift")
    store, load, low = _has(line, "store_arm") | _has(line, "store_x86"), _has(line, "load_arm") | _has(line, "load_x86"), F.lower(line)
    rules = (
        (fence, "FENCE"), (cache, "CACHE"), (timing, "TIMING"), (ret, "RET"), (call & indirect, "CALL_INDIRECT"), (call, "CALL"), (indirect & line.rlike(r"(?i)\b(jmpq?|br)\b"), "JUMP_INDIRECT"), (cond, "BRANCH_COND"),
        (uncond, "BRANCH_UNCOND"), (compare, "COMPARE"), (stack, "STACK"), (mem & store & low.contains("push"), "STACK"), (mem & store, "STORE"), (mem & load & low.contains("pop"), "STACK"), (mem & load, "LOAD"),
        (move, "MOVE"), (arithmetic, "ARITHMETIC"), (logic, "LOGIC"), (shift, "SHIFT"), (low.contains("nop"), "NOP"),
    )
    return F.coalesce(*(F.when(test, F.lit(name)) for test, name in rules), F.lit("OTHER"))


def all_registers(line: Column) -> Column:
    """Every mention of a register, ARM names first, lower-cased."""
    return F.concat(*(F.regexp_extract_all(F.lower(line), F.lit(fixed.NODE_PATTERNS[k]), F.lit(1)) for k in ("arm_reg", "x86_reg")))


def destinations(registers: Column, category: Column) -> Column:
    """The first register, unless the category reads all of them."""
    return F.when(category.isin(*ALL_SOURCE), F.slice(registers, 1, 0)).otherwise(F.slice(registers, 1, 1))


def sources(registers: Column, category: Column) -> Column:
    return F.array_distinct(F.when(category.isin(*ALL_SOURCE), registers).otherwise(F.slice(registers, 2, F.greatest(F.size(registers), F.lit(1)))))


def memory_type(line: Column) -> Column:
    out = F.when(~_has(line, "memory_operand"), "NONE").when(_has(line, "stack_access"), "STACK").when(_has(line, "indexed_access"), "INDEXED")
    return out.when(_has(line, "indirect"), "INDIRECT").otherwise("HEAP")


def spec_flags(line: Column, category: Column, memory: Column) -> Column:
    """A struct of the eight flags of speculation."""
    load = category == "LOAD"
    flags = (
        (category == "FENCE") | F.lower(line).contains("cpuid"), category == "CACHE", category.isin("BRANCH_COND", "BRANCH_UNCOND", "CALL", "CALL_INDIRECT", "JUMP_INDIRECT", "RET"),
        category.isin("CALL_INDIRECT", "JUMP_INDIRECT"), category.isin("LOAD", "STORE", "STACK"), category == "TIMING", load & (memory == "INDEXED"), load & memory.isin("INDEXED", "INDIRECT"),
    )
    return F.struct(*(f.alias(n) for f, n in zip(flags, fixed.SPEC_FLAGS, strict=True)))


def vector(category: Column, memory: Column, dest: Column, src: Column, flags: Column) -> Column:
    """34 numbers: one-hot category and memory type, min(|dest|, 3) / 3, min(|src|, 5) / 5, the flags."""
    one = lambda c, names: [(c == n).cast("double") for n in names]
    counts = [F.least(F.size(dest), F.lit(3)) / 3, F.least(F.size(src), F.lit(5)) / 5]
    return F.array(*one(category, fixed.OPCODE_CATEGORIES), *one(memory, fixed.MEMORY_TYPES), *counts, *(flags[n].cast("double") for n in fixed.SPEC_FLAGS))


# Opcodes by semantic type; the first type that lists an opcode is its type.
SEMANTIC_TYPES = (
    ("LOAD", ("mov", "ldr", "ldp", "ld", "lw", "lb", "lh", "movzx", "movsx")),
    ("STORE", ("str", "stp", "st", "sw", "sb", "sh")),
    ("ARITHMETIC", ("add", "sub", "mul", "div", "and", "or", "xor", "shl", "shr", "addi", "subi", "andi", "ori", "xori", "lsl", "lsr", "asr")),
    ("BRANCH", ("jmp", "je", "jne", "jz", "jnz", "jl", "jle", "jg", "jge", "ja", "jae", "jb", "jbe", "b", "bl", "br", "blr", "ret")),
    ("CALL", ("call", "bl", "blr")),
    ("COMPARE", ("cmp", "test", "subs")),
    ("CACHE", ("clflush", "clflushopt", "dc", "ic")),
    ("BARRIER", ("lfence", "mfence", "sfence", "dsb", "isb", "dmb")),
    ("TIMING", ("rdtsc", "rdtscp", "mrs")),
    ("NOP", ("nop", "hint")),
)
# Register names of operand classes (an operand is a register if it begins with one), and those with a role.
GENERAL_REGISTERS = (
    "rax", "rbx", "rcx", "rdx", "rsi", "rdi", "rbp", "rsp", "r8", "r9", "r10", "r11", "r12", "r13", "r14", "r15", "eax", "ebx", "ecx", "edx", "esi", "edi", "ebp", "esp",
    *(f"x{i}" for i in range(32)), *(f"w{i}" for i in range(32)), "sp", "lr", "pc", "xzr", "wzr", "cs", "ds", "es", "fs", "gs", "ss",
)
REGISTER_ROLES = (
    ("REG_RET", ("rax", "eax", "ax", "al", "x0", "r0")), ("REG_SP", ("rsp", "esp", "sp", "x31", "r13")), ("REG_FP", ("rbp", "ebp", "bp", "x29", "r11")), ("REG_ARG1", ("rdi", "edi", "x1", "r1")), ("REG_ARG2", ("rsi", "esi", "x2", "r2")),
)
#: The flags of an instruction, by tests in turn; the first test that holds decides.
SEMANTICS = (
    "is_branch", "is_conditional", "is_indirect", "is_call", "is_return", "is_load", "is_store", "accesses_memory", "is_arithmetic", "is_comparison", "is_speculation_barrier", "is_cache_operation", "is_timing_sensitive", "is_privileged",
)


def semantic_type(op: Column) -> Column:
    return F.coalesce(*(F.when(op.isin(*ops), F.lit(name)) for name, ops in SEMANTIC_TYPES), F.lit("COMPUTE"))


def semantics(op: Column, rest: Column, arch: Column) -> Column:
    """A struct of 14 flags of an opcode, its operand text and the architecture (x86_64, else ARM)."""
    bracket, percent = rest.contains("["), rest.contains("%")
    # What each group of opcodes sets, in this order.
    x86 = (
        (op.startswith("j"), {"is_branch": F.lit(True), "is_conditional": op != "jmp", "is_indirect": bracket}),
        (op.isin("call", "ret"), {"is_call": op == "call", "is_return": op == "ret", "is_indirect": (op == "call") & (bracket | percent)}),
        (op.isin("mov", "movzx", "movsx", "movzbl", "movzwl", "lea"), {"accesses_memory": bracket, "is_load": bracket}),
        (op.isin("add", "sub", "mul", "div", "xor", "and", "or", "shl", "shr"), {"is_arithmetic": F.lit(True)}),
        (op.isin("cmp", "test"), {"is_comparison": F.lit(True)}),
        (op.isin("lfence", "mfence", "sfence"), {"is_speculation_barrier": F.lit(True)}),
        (op.isin("clflush", "clwb", "clflushopt"), {"is_cache_operation": F.lit(True)}),
        (op.isin("rdtsc", "rdtscp"), {"is_timing_sensitive": F.lit(True)}),
    )
    arm = (
        (op.startswith("b"), {"is_branch": F.lit(True), "is_conditional": op.contains("."), "is_indirect": op.isin("br", "blr")}),
        (op == "ret", {"is_return": F.lit(True)}),
        (op.isin("ldr", "ldrb", "ldrh", "ldp"), {"is_load": F.lit(True), "accesses_memory": F.lit(True)}),
        (op.isin("str", "strb", "strh", "stp"), {"is_store": F.lit(True), "accesses_memory": F.lit(True)}),
        (op.isin("add", "sub", "mul", "div", "and", "orr", "eor", "lsl", "lsr"), {"is_arithmetic": F.lit(True)}),
        (op.isin("cmp", "subs"), {"is_comparison": F.lit(True)}),
        (op.isin("dsb", "isb", "dmb"), {"is_speculation_barrier": F.lit(True)}),
        (op.isin("dc", "ic"), {"is_cache_operation": F.lit(True)}),
        (op == "mrs", {"is_timing_sensitive": F.lit(True), "is_privileged": F.lit(True)}),
    )
    # the first test that holds is found once, as a number; each flag reads it, and no flag repeats the tests
    number = lambda rules, start: F.coalesce(*(F.when(test, F.lit(start + k)) for k, (test, _) in enumerate(rules)), F.lit(-1))
    first = F.when(arch == "x86_64", number(x86, 0)).otherwise(number(arm, len(x86)))
    flag = lambda name: F.coalesce(*(F.when(first == k, sets[name]) for k, (_, sets) in enumerate((*x86, *arm)) if name in sets), F.lit(False))
    return F.struct(*(flag(n).alias(n) for n in SEMANTICS))


def simple_type(op: Column) -> Column:
    """The nine structural types, null for ``nop``."""
    out = F.when(op == "nop", F.lit(None).cast("string")).when(op.startswith("ret"), "RET").when(op.startswith("call"), "BRANCH_UNCOND").when(op.rlike(r"^(b\.|cb|tb)"), "BRANCH_COND")
    out = out.when(op.isin("b", "bl", "br", "blr"), "BRANCH_UNCOND").when(op.rlike("^ld[rpu]"), "LOAD").when(op.rlike("^(str|stp|stur)"), "STORE").when(op.rlike("^(dsb|dmb|isb)"), "BARRIER")
    out = out.when(op == "jmp", "BRANCH_UNCOND").when(op.startswith("j"), "BRANCH_COND").when(op.startswith("mov"), "MOVE").when(op.isin("lfence", "mfence", "sfence"), "BARRIER")
    return out.when(op == "clflush", "FLUSH").when(op == "rdtsc", "TIME").otherwise("COMPUTE")


def operand_class(operand: Column) -> Column:
    """REG, MEM_OFFSET (a bracket with a sign), MEM_DIRECT, IMM or LABEL; registers are tested first."""
    text = F.lower(F.trim(operand))
    out = F.when(text.rlike("^(" + "|".join(GENERAL_REGISTERS) + ")"), "REG").when(text.rlike(r"[\[(]") & text.rlike("[+-]"), "MEM_OFFSET")
    return out.when(text.rlike(r"[\[(]"), "MEM_DIRECT").when(text.rlike(r"^([#$]|0x|[0-9]+$)"), "IMM").otherwise("LABEL")


def register_role(register: Column) -> Column:
    """By calling convention; registers without a role keep their own name, so the result depends on nothing else."""
    name = F.regexp_replace(F.lower(register), "^[%$]+", "")
    return F.coalesce(*(F.when(name.isin(*names), F.lit(role)) for role, names in REGISTER_ROLES), F.concat(F.lit("REG_"), F.upper(name)))


def immediate_class(operand: Column) -> Column:
    """Ten classes of an immediate's value, or of what is no number."""
    text = F.regexp_replace(F.trim(operand), "^[$]?[#]?", "")
    hexed, binary = F.regexp_extract(text, r"^0x([0-9A-Fa-f]{1,15})$", 1), F.regexp_extract(text, r"^0b([01]{1,62})$", 1)
    value = F.coalesce(F.when(hexed != "", F.conv(hexed, 16, 10).try_cast("long")), F.when(binary != "", F.conv(binary, 2, 10).try_cast("long")), text.try_cast("long"))
    out = F.when(value.isNull(), F.when(F.lower(text).rlike("offset|addr|ptr"), "IMM_ADDRESS").otherwise("IMM_SYMBOL")).when(value == 0, "IMM_ZERO").when(value == 1, "IMM_ONE")
    out = out.when(value.between(2, 8), "IMM_SMALL_POWER2").when(value.isin(16, 32, 64, 128, 256, 512, 1024), "IMM_POWER2").when(value.between(-128, 127), "IMM_BYTE")
    return out.when(value.between(-32768, 32767), "IMM_WORD").when(value < 0, "IMM_NEGATIVE").when(value <= 0xFFFFFFFF, "IMM_DWORD").otherwise("IMM_LARGE")


def label_bucket(operand: Column, buckets: int = 1000) -> Column:
    """A stable bucket of a label's name."""
    return F.concat(F.lit("LABEL_"), F.pmod(F.conv(F.substring(F.md5(operand.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("string"))


def canonical_opcode(op: Column) -> Column:
    """Without a condition after a dot and without trailing q, w, l, b."""
    return F.regexp_replace(F.split_part(op, F.lit("."), F.lit(1)), "[qwlb]+$", "")
