"""Operator 11: what five filters remove together, alone and in each other's place, by inclusion-exclusion.

1. One Arrow pass measures each whole text and sets four failure flags; the fifth flag (a copy of a text with a smaller
   id) is set for every row but its text's first ones, which a join on text hash *and* id finds, so that a text shared by
   a third of all rows is one small partial aggregate a task and no hot join key. Rows alike in everything are counted first.
2. One aggregation by part sums the flag products of all 32 subsets of filters (with every row, with the good and with
   the toxic ones as weight): the joint-failure counts J.
3. A Moebius transform of J, one array step a filter, gives the survivors of every set of filters. Whatever an order of
   filters removes at a step is the difference of two survivor counts; what fails one filter alone is the difference of the
   two largest sets; the signed J are the Harsanyi dividends of "removed by this set", and their equal shares the Shapley
   value. Nothing is simulated by order, and no row leaves its task before it is counted.

Defined results: a null text is empty (no word, nothing distinct, no capital); a null part is the empty string, in one
part with an empty one; a row with a null id is nobody's copy, and no row is a copy of it; rows of the same id and text
don't make each other a copy. Labels repeated for an id count as good or toxic when one of them says so. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts, slices, span_hashes, tidy, written

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 100, 80, 10, "#$%&*|"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def text_failures(texts: Texts) -> np.ndarray:
    """For each text the failed ones of the first four filters, the first as bit 1, the second as bit 2 and so on."""
    starts, ends, first = texts.words()
    n_words = np.diff(first)
    owner = np.repeat(np.arange(texts.n), n_words)
    hashes = span_hashes(texts.buf, starts, ends)
    order = np.lexsort((hashes, owner))
    hashes, of = hashes[order], owner[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    distinct = np.bincount(of[new], minlength=texts.n)

    def within(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return np.diff(sums[texts.bounds])

    points = within((texts.buf & 0xC0) != 0x80)
    capitals = within((texts.buf >= 0x41) & (texts.buf <= 0x5A))
    flags = [n_words < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n_words, 100 * capitals > MAX_CAPITALS * points, within(_SYMBOL[texts.buf]) > 0]
    return sum(flag.astype(np.int32) << k for k, flag in enumerate(flags))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fails = [text_failures(texts) for texts in slices(batch.column(0))]
        found = np.concatenate(fails) if fails else np.empty(0, np.int32)
        yield pa.record_batch([batch.column(1), batch.column(2), batch.column(3), pa.array(found, pa.int32())], ["id", "part", "key", "fails"])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, fails, n): how many rows have this id, part and set of failed filters."""
    rows = docs.select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    ).withColumn("key", F.md5(F.col("text").cast("binary")))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.select("text", "id", "part", "key").mapInArrow(tidy(_measured), f"id {kind}, part string, key string, fails int")
    found = written(found.groupBy("key", "id", "part", "fails").agg(F.count("*").alias("n")), "failures")
    firsts = found.where("id is not null").groupBy("key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    fails = F.col("fails") + F.when(copy, 1 << 4).otherwise(0)
    return found.join(firsts, ["key", "id"], "left").select("id", "part", fails.alias("fails"), "n")


def labelled(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``counted`` with the booleans ``good`` and ``toxic``; ids without a label are neither."""
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    return counted.join(known, "id", "left").select("part", "fails", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def _joint(weight: Column, n_filters: int) -> Column:
    """The joint-failure counts of all subsets of filters, at the subset's bits."""
    flags = [F.shiftright("fails", k).bitwiseAND(1).cast("long") for k in range(n_filters)]
    product = lambda s: reduce(lambda a, k: a * flags[k] if s >> k & 1 else a, range(n_filters), weight)
    return F.array(*(F.sum(product(s)) for s in range(1 << n_filters)))


def _survivors(df: DataFrame, joint: str, name: str, n_filters: int) -> DataFrame:
    """``df`` with what is left after each set of filters: the Moebius transform of ``joint``, one step a filter."""


    def step(was: Column, bit: int) -> Column:
        return F.transform(was, lambda x, i: F.when(i.bitwiseAND(bit) != 0, was[i - bit] - x).otherwise(x))

    df = df.withColumn(name, F.col(joint))
    for k in range(n_filters):
        df = df.withColumn(name, step(F.col(name), 1 << k))
    return df


def _shared_out(joint: Column, k: int, n_filters: int) -> Column:
    """``n_filters!`` times filter k's Shapley value: the Harsanyi dividends of its sets, in equal shares."""
    whole, size = factorial(n_filters), lambda s: bin(s).count("1")
    shares = [(1 if size(s) % 2 else -1) * whole // size(s) if s >> k & 1 else 0 for s in range(1 << n_filters)]
    weighed = F.zip_with(joint, F.array(*(F.lit(x).cast("long") for x in shares)), lambda j, x: j * x)
    return F.aggregate(weighed, F.lit(0).cast("long"), lambda a, x: a + x)


def audited(counted: DataFrame, names: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the filters.

    ``counted`` has part, fails (filter k at bit k), n, good and toxic; ``names`` has a letter a filter, eight at most.
    """
    m = len(names)
    if not 0 < m <= 8:
        raise ValueError("one to eight filters: their orders are listed")
    n = F.col("n").cast("long")
    weights = {"all": n, "good": F.when(F.col("good"), n).otherwise(0), "toxic": F.when(F.col("toxic"), n).otherwise(0)}
    sums = counted.groupBy("part").agg(*(_joint(w, m).alias(f"joint_{c}") for c, w in weights.items()))
    for c in weights:
        sums = _survivors(sums, f"joint_{c}", f"left_{c}", m)
    sums = sums.withColumn("value", F.array(*(_shared_out(F.col("joint_all"), k, m) for k in range(m))))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(names)))
    steps = (
        sums.withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(m))))
        .withColumn("k", F.expr(f"instr('{names}', substr(filter_order, step, 1)) - 1"))
        .withColumn("after", F.expr(f"aggregate(sequence(1, step), 0, (a, i) -> a | shiftleft(1, instr('{names}', substr(filter_order, i, 1)) - 1))"))
        .withColumn("bit", F.expr("shiftleft(1, k)"))
        .withColumn("before", F.col("after") - F.col("bit"))
    )
    lost = lambda c: F.col(f"left_{c}")[F.col("before")] - F.col(f"left_{c}")[F.col("after")]
    left, every = F.col("left_all"), (1 << m) - 1
    return steps.select(
        "part", "filter_order", "step", left[F.col("after")].alias("kept"), lost("all").alias("removed"), (F.col("joint_all")[F.col("bit")] - lost("all")).alias("redundant"),
        (left[F.lit(every) - F.col("bit")] - left[every]).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("value")[F.col("k")].alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Operator 11 over all of ``documents`` and ``labels``: a row a language, order of filters and step."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audited(labelled(failures(docs), labels))


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT text, min(doc_id) AS doc_id FROM d GROUP BY text),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(
  CASE WHEN len(w) < {MIN_WORDS} THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w) THEN 'B' ELSE '' END,
  CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(d.text) THEN 'C' ELSE '' END,
  CASE WHEN regexp_matches(d.text, '[{SYMBOLS}]') THEN 'D' ELSE '' END, CASE WHEN d.doc_id > f.doc_id THEN 'E' ELSE '' END) AS fails
  FROM d JOIN f ON d.text = f.text LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM x GROUP BY part, fails),
s AS (SELECT unnest(string_split('A,B,C,D,E', ',')) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM s a, s b, s c, s d, s e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
t AS (SELECT part, filter_order, k AS step, c.fails, n, good, toxic, contains(c.fails, filter_order[k]) AS hit,
  len(regexp_replace(filter_order[1:k - 1], '[^' || c.fails || '.]', '', 'g')) > 0 AS gone FROM c, o, range(1, 6) r(k)),
u AS (SELECT part, filter_order, step, sum(n) FILTER (WHERE NOT hit AND NOT gone) AS kept, sum(n) FILTER (WHERE hit AND NOT gone) AS removed, sum(n) FILTER (WHERE hit AND gone) AS redundant,
  sum(n) FILTER (WHERE fails = filter_order[step]) AS unique_fails, sum(good) FILTER (WHERE hit AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE hit AND NOT gone) AS toxic_lost FROM t GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM u
"""
