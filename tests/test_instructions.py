import pytest
from pyspark.sql import functions as F

from fenceline.functions import instructions as I
from fenceline.operators.graph import last_defs, within
from fenceline.sources import assembly
from fenceline.streaming.incremental import windowed

from .conftest import SF


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("lfence", "FENCE"), ("dsb sy", "FENCE"), ("clflush (%rax)", "CACHE"), ("dc civac, x0", "CACHE"), ("mrs x2, cntvct_el0", "TIMING"), ("rdtscp", "TIMING"),
        ("ret", "RET"), ("blr x8", "CALL_INDIRECT"), ("callq *%rax", "CALL_INDIRECT"), ("bl _f", "CALL"), ("br x1", "JUMP_INDIRECT"), ("b.ge .L1", "BRANCH_COND"),
        ("jle .L3", "BRANCH_COND"), ("jmp .L2", "BRANCH_UNCOND"), ("cmpl $1, %eax", "COMPARE"), ("ldr x2, [x3, x0, lsl #3]", "LOAD"), ("str x0, [sp]", "STORE"),
        ("movl $0, -12(%rbp)", "STORE"), ("movl -12(%rbp), %eax", "LOAD"), ("mov x0, x1", "MOVE"), ("add x0, x0, #1", "ARITHMETIC"), ("and x0, x0, x1", "LOGIC"), ("lsl x0, x0, #3", "SHIFT"), ("nop", "NOP"), ("xyz", "OTHER"),
    ],
)
def test_category(spark, line, want):
    assert one(spark, I.category(F.col("x")), x=line) == want


def test_tokens(spark):
    assert one(spark, I.normalized(F.col("x")), x="  ldr x2, [x3, #8] ; load ") == "ldr x2, [x3, #8]"
    assert one(spark, I.normalized(F.col("x"), cut_hash=True), x="ldr x2, [x3, #8]") == "ldr x2, [x3,"
    assert [one(spark, I.normalized(F.col("x")), x=x) for x in ("", ".cfi_endproc", "LBB0_1:", "   ")] == ["", "", "", ""]
    assert one(spark, I.opcode(F.col("x")), x="\tMOVL, $0, %eax") == "movl"
    assert one(spark, I.operands(F.col("x")), x="ldr x2, [x3, x0, lsl #3]") == ["x2", "[x3, x0, lsl #3]"]
    assert one(spark, I.registers(F.col("x")), x="add x0, x1, x0") == ["x0", "x1"]
    assert [one(spark, I.immediate_bucket(F.col("x")), x=x) for x in ("#0", "$8", "-3", "0xFFFF", "70000", "x0")] == ["ZERO", "SMALL", "NEG", "MED", "LARGE", "UNK"]
    assert one(spark, I.group_key(F.col("x")), x="/a/b/spec_clang_O2.s") == "spec"
    assert one(spark, I.group_key(F.col("x")), x="/a/b/loop.s") == "loop"


def test_sequences(spark):
    seq = ["cmp x0, x1", "b.ge .L1", "nop", "ldr x2, [x3]", "dsb sy", "nop"]
    assert one(spark, I.trace(F.col("x")), x=seq) == "COMPARE BRANCH_COND LOAD FENCE"
    assert one(spark, I.stripped_tail(F.col("x")), x=seq) == seq[:4]
    assert one(spark, I.stripped_tail(F.col("x")), x=["nop", "nop", "nop", "nop"]) == ["nop"] * 3  # trailing no-ops go while more than three lines are left
    assert one(spark, I.barrier_inserted(F.col("x")), x=seq) == [*seq[:3], "dsb sy", *seq[3:]]
    assert one(spark, I.barrier_inserted(F.col("x")), x=["ret"]) == ["ret"]
    assert one(spark, I.architecture(F.col("x")), x=seq) == "arm64"
    out = one(spark, I.nop_inserted(F.lit(1), F.col("x")), x=seq)
    assert [x for x in out if x != "nop"] == [x for x in seq if x != "nop"]
    assert one(spark, I.sequence_key(F.col("x")), x=[" RET "]) == one(spark, I.sequence_key(F.col("x")), x=["ret"])


def test_graph_rules_match_a_state_machine(spark):
    import random

    rng = random.Random(3)
    rows = [(s, p, rng.choice("dux"), rng.randrange(3)) for s in range(5) for p in range(40)]
    df = spark.createDataFrame(rows, "seq int, pos int, op string, reg int")
    got = sorted(tuple(r) for r in last_defs(df.where("op = 'd'"), df.where("op = 'u'"), 2).select("seq", "src", "dst", "reg").collect())
    want = []
    for s in range(5):
        defs = {}
        for _, p, op, reg in [r for r in rows if r[0] == s]:
            if op == "u":
                want += [(s, d, p, reg) for d in defs.get(reg, [])[-2:]]
            if op == "d":
                defs.setdefault(reg, []).append(p)
    assert got == sorted(want)
    near = sorted(tuple(r) for r in within(df, F.col("op") == "d", F.col("op") == "u", 4, F.col("op") == "x").collect())
    want = [
        (s, a, b) for s in range(5) for a in range(40) for b in range(a + 1, min(40, a + 5))
        if rows[s * 40 + a][2] == "d" and rows[s * 40 + b][2] == "u" and all(rows[s * 40 + k][2] != "x" for k in range(a + 1, b + 1))
    ]
    assert near == sorted(want)


def test_sources(spark, tmp_path):
    folder = tmp_path / "arm64" / "clang" / "O2"
    folder.mkdir(parents=True)
    (folder / "a.s").write_bytes(b"_f:\r\n  ldr x0, [x1] ; x\r\n\xff\r\n  ret")
    (tmp_path / "other.s").write_text("ret")
    found = assembly.files(spark, str(tmp_path))
    assert [tuple(r) for r in found.select("arch", "compiler", "opt_level").collect()] == [("arm64", "clang", "O2")]
    assert [r["line_num"] for r in assembly.lines(found).orderBy("line_num").collect()] == [0, 1, 2, 3]
    (tmp_path / "r.jsonl").write_text('{"label": "vuln", "sequence": ["ret"]}\n\n{broken\n')
    assert assembly.records(spark, str(tmp_path / "r.jsonl"), "label string, sequence array<string>").collect()[0]["sequence"] == ["ret"]


def test_stream_gives_the_tables_counts(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    want = {(r["start"], r["op"]): r["n"] for r in windowed(table).collect()}
    stream = windowed(spark.readStream.schema(table.schema).parquet(f"{SF}/events.parquet*"))
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    query.awaitTermination(60)
    assert {(r["start"], r["op"]): r["n"] for r in spark.table("counts").collect()} == want


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "key", "label"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_mended_categories(spark):
    want = {
        "sb a0, 0(a1)": "STORE", "jr ra": "JUMP_INDIRECT", "cpuid": "FENCE", "wbinvd": "CACHE", "ldrsb w0, [x1]": "LOAD", "stlr x0, [x1]": "STORE", "mov eax, [rbx]": "LOAD", "mov dword ptr [rbx], eax": "STORE",
        "neg x0, x1": "ARITHMETIC", "leave": "OTHER", "mrs x2, cntvct_el0": "TIMING", "blr x8": "CALL_INDIRECT", "jae .L1": "BRANCH_COND", "cmpl $1, %eax": "COMPARE", "sb": "FENCE",
    }
    for line, kind in want.items():
        assert one(spark, I.category(F.col("x")), x=line) == kind, line


def test_boilerplate(spark):
    strip = lambda seq: one(spark, I.stripped_tail(F.col("x")), x=seq)
    body = ["cmp x0, x1", "b.ge .L1", "ldr x2, [x3]", "add x1, x1, x2"]
    assert strip([*body, "_rd:", "mrs x0, cntvct_el0", "ret"]) == body
    assert strip([*body, "mrs x0, cntvct_el0", "ret"]) == body
    assert strip([*body, "ret"]) == [*body, "ret"]
    assert strip([*body, "isb", "add sp, sp, #32"]) == [*body, "isb"]
    assert strip(["_barrier:", "a", "b", "c"]) == ["_barrier:", "a", "b", "c"]
