"""Assembly text made from ``events``, so that real lines go through the line and window operators and their oracles.

An event is one line of its user's listing: ARM64 for even users, x86 for odd ones, picked from a list by the event's
numbers. Listings hold blanks, labels, directives and comments as well. The SQL forms are common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenceline.plans.analogs import read

ARM = (
    "ldr x1, [x0, #8]", "  ldr\tx2, [x3, x0, lsl #3]", "ldrb w4, [x1]", "str x1, [sp, #16]", "str x2, [x3]", "stp x29, x30, [sp, #-16]!", "ldp x29, x30, [sp], #16", "cmp x0, #16", "cmp x1, x2",
    "b.hs .L1", "b.lo .L2", "b.eq .L3", "b.ne .L1 ; again", "cbz x0, .L4", "tbnz w1, #3, .L2", "b .L5", "bl helper", "bl helper2", "blr x8", "br x9", "ret", "dsb sy", "isb", "dmb ish", "csdb", "dc civac, x0",
    "mrs x2, cntvct_el0", "eor x0, x0, x0", "lsl x1, x1, #6", "add x3, x3, x1", "sub sp, sp, #32", "add sp, sp, #32", "and x0, x0, #15", "adrp x4, table", "mov x5, x4", "mul x6, x5, x1", "nop", "", ".L1:", ".cfi_startproc",
    "prfm pldl1keep, [x0]", "tlbi vae1, x0", "ldr x1, [x1]", "neg x0, x1", "brk #1", "ldrsw x7, [x6, w1, sxtw #2]", "ldr x2, [x3, #8] ; load", "svc #0", "_rd:",
)
X86 = (
    "movq (%rax,%rcx,8), %rdx", "\tmovl %eax, -12(%rbp)", "mov rax, [rbx+rcx*8]", "mov [rdi], rax", "movzbl (%rdi), %eax", "movq %rsp, %rbp", "cmpq $16, %rdi", "cmp eax, #16", "test rdi, rdi",
    "jae .L1", "jb .L2", "jne .L3", "je .L1 # again", "ja .L4", "jmp .L5", "jmp *%rdx", "call memcpy", "call memcpy@plt", "callq *%rax", "call *%rbx", "ret", "retq", "leave", "pushq %rbp", "popq %rbp", "push rbx", "pop rbx",
    "clflush (%rax)", "mfence", "lfence", "rdtsc", "rdtscp", "xor %eax, %eax", "shl $6, %rax", "add rax, rbx", "addq %rcx, %rdx", "sub rsp, 32", "and eax, 15", "lea rsi, [rip+8]", "imul rax, rcx", "nop", "", ".L2:", ".text",
    "verw (%rsp)", "invlpg (%rax)", "ud2", "cpuid",
)
SIZE, STRIDE, LEAST = 30, 15, 12


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, pos, line): raw lines, blanks, labels and directives among them."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = lambda n: (F.col("event_id") * 7 + F.col("user_id") * 3 + F.floor(F.col("event_id") / 11)) % n + 1
    pick = lambda lines: F.element_at(F.array(*map(F.lit, lines)), at(len(lines)).cast("int"))
    line = F.when(F.col("user_id") % 2 == 0, pick(ARM)).otherwise(pick(X86))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), (F.row_number().over(order) - 1).alias("pos"), line.alias("line"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, pos, line): the instruction lines of the listings, trimmed, cut at ``;``, numbered anew from 0."""
    from fenceline.functions.instructions import normalized

    rows = listing(spark, sf_dir).select("seq", "pos", normalized(F.col("line")).alias("line")).where("line <> ''")
    return rows.select("seq", (F.row_number().over(Window.partitionBy("seq").orderBy("pos")) - 1).alias("pos"), "line")


def windows(rows: DataFrame, size: int = SIZE, stride: int = STRIDE, least: int = LEAST) -> DataFrame:
    """(seq, lo, i, line): the rows of every window of ``size`` lines each ``stride``, short last ones of ``least`` among them.

    A row goes into the few windows that hold it; no lists are made and no join is needed.
    """
    total = F.count("*").over(Window.partitionBy("seq"))
    own = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("pos") - (size - 1)) / stride)), F.floor(F.col("pos") / stride))
    each = rows.withColumn("total", total).select("seq", "pos", "line", "total", F.explode(own).alias("k"))
    return each.withColumn("lo", F.col("k") * stride).where(F.col("total") - F.col("lo") >= least).select("seq", "lo", (F.col("pos") - F.col("lo")).alias("i"), "line")


def code_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(code(spark, sf_dir))


def _list(lines: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in lines) + "]"


LISTING = f"""li AS (SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  CASE WHEN user_id % 2 = 0 THEN {_list(ARM)}[((event_id * 7 + user_id * 3 + event_id // 11) % {len(ARM)} + 1)::INT]
    ELSE {_list(X86)}[((event_id * 7 + user_id * 3 + event_id // 11) % {len(X86)} + 1)::INT] END AS line FROM events)"""
CODE = rf"""{LISTING}, tr AS (SELECT seq, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM li),
co AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS pos, regexp_replace(split_part(line, ';', 1), '\s+$', '') AS line FROM tr
  WHERE line <> '' AND line NOT LIKE '.%' AND line NOT LIKE '%:')"""
def windows_sql(rows: str = "co") -> str:
    """``aw``: the windows of the relation ``rows``."""
    return f"""nn AS (SELECT seq, count(*) AS total FROM {rows} GROUP BY seq), ws AS (SELECT seq, total, unnest(range(0, total, {STRIDE})) AS lo FROM nn),
aw AS (SELECT ws.seq, lo, pos - lo AS i, line FROM ws JOIN {rows} r ON r.seq = ws.seq AND pos >= lo AND pos < lo + {SIZE} WHERE total - lo >= {LEAST})"""


WINDOWS = f"{CODE}, {windows_sql()}"
