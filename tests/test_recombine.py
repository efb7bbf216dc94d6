"""Exchanges of windows against the nested loops over all pairs of a class."""

import random

import pytest

from fenceline.operators import recombine
from fenceline.plans.assembly_analog import code_windows

from .conftest import SF


def longest(a, b):
    """The longest common block by all pairs of starts."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > best[0]:
                best = (k, i, j)
    return best


def loops(rows, cap):
    """Windows in order, each with all later ones, until the class has its cap."""
    out, kinds = [], sorted({r[0] for r in rows if r[0] is not None})
    for kind in kinds:
        own, made = sorted(r for r in rows if r[0] == kind), 0
        own.sort(key=lambda r: (r[2], r[3]))
        for k, (_, arch, seq, lo, a) in enumerate(own):
            if cap is not None and made >= cap:
                break
            for _, other, seq_b, lo_b, b in own[k + 1 :]:
                if arch == other:
                    size, i, j = longest(a, b)
                    for tag, x, y in recombine.exchanges(a, b, arch == 1, size, i, j):
                        out.append((kind, seq, lo, seq_b, lo_b, tag, tuple(x), tuple(y)))
                        made += 1
    return sorted(out)


def as_rows(found):
    return sorted((r["kind"], r["seq_a"], r["lo_a"], r["seq_b"], r["lo_b"], r["tag"], tuple(r["new_a"]), tuple(r["new_b"])) for r in found.collect())


@pytest.mark.parametrize("cap", [None, 1, 25])
def test_exchanges_of_listings_are_the_loops(spark, cap):
    rows = recombine.line_lists(code_windows(spark, SF))
    plain = [(r["kind"], r["arch"], r["seq"], r["lo"], list(r["lines"])) for r in rows.collect()]
    assert as_rows(recombine.swapped(rows, cap, first=2)) == loops(plain, cap)


@pytest.mark.parametrize("cap", [None, 7])
def test_exchanges_of_made_windows(spark, cap):
    rng = random.Random(3)
    lines = ["cmp x0, x1", "b.hs .L1", "ldr x2, [x3]", "str x2, [x4]", "ret", "add x1, x1, x0", "nop"]
    rows = [(s % 3 if s % 11 else None, s % 2, s, lo, [rng.choice(lines[: rng.choice((3, 7))]) for _ in range(rng.randint(0, 12))]) for s in range(24) for lo in (0, 15)]
    rows += [(1, 1, 100 + k, 0, rows[5][4]) for k in range(10)]  # copies
    df = spark.createDataFrame(rows, "kind long, arch long, seq long, lo long, lines array<string>").repartition(4)
    got = as_rows(recombine.swapped(df, cap, first=1))
    assert got == loops(rows, cap) and got
    assert recombine.swapped(df.where("false"), cap).count() == 0


def test_what_an_exchange_needs():
    a = ["mov x1, x0", "cmp x1, x2", "b.hs .L1", "ldr x3, [x1]", "add x4, x3, x3", "ret"]
    b = ["mov x9, x8", "mov x1, x0", "cmp x1, x2", "b.hs .L1", "ldr x5, [x6]", "str x5, [x7]"]
    size, i, j = longest(a, b)
    assert (size, i, j) == (3, 0, 1)
    (tag, x, y), = recombine.exchanges(a, b, False, size, i, j)  # a has nothing before the block
    assert tag == "cross_swap_suffix" and x == a[:3] + b[4:] and y == b[:4] + a[3:]
    assert recombine.free(a) == {"x0", "x2"} and recombine.free(["str x1, [x2]", "mov x3, x1"]) == {"x2"} and recombine.free(["blr x8"]) == {"x8"}
    assert not list(recombine.exchanges(a, a, False, 6, 0, 0)) and not list(recombine.exchanges(a, b, False, 2, 1, 2))
    needy = [*b[:4], "ldr x5, [x29]", "ret"]
    assert recombine.free(a[:3] + needy[4:]) <= recombine.free(a) | recombine.free(needy)
    assert recombine.branches(["JMP x"], True) and recombine.branches(["b.EQ 1"], False) and not recombine.branches(["add x0, x0, x1"], False)
