"""Readers and sinks by round trips, window filters on hand-made rows, operators on empty tables and edge rows."""

import json

import pytest
from pyspark.sql import functions as F

from fenceline.operators import detect, features, graph, listings, selection, similarity, splits, windows
from fenceline.plans import assembly_analog
from fenceline.sources import assembly, sinks


def test_record_files_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"], None), (2, [], "x")], "id long, sequence array<string>, label string")
    assembly.write_records(rows, f"{tmp_path}/r")
    back = assembly.records(spark, f"file://{tmp_path}/r", rows.schema)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == [(1, ["a", "b"], None), (2, [], "x")]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": 1}\n\n{"id": }\n{"id": 3}\n')
    assert [r["id"] for r in assembly.records(spark, f"file://{bad}", "id long").orderBy("id").collect()] == [1, 3]
    good, broken = assembly.tolerant_records(spark, f"file://{bad}", "id long")
    assert good.count() == 2 and broken.count() == 1


def test_store_upserts_and_reloads(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        sinks.read_store(spark, path)
    sinks.upsert(spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.2), ("a", 2, 0.3)], "k string, at int, x double"), path, ["k"], "at")
    sinks.upsert(spark.createDataFrame([("b", 3, 0.5), ("c", 0, 0.6), ("a", 1, 9.0)], "k string, at int, x double"), path, ["k"], "at")
    assert sorted(map(tuple, sinks.read_store(spark, path).collect())) == [("a", 2, 0.3), ("b", 3, 0.5), ("c", 0, 0.6)]
    sinks.replace_store(spark.createDataFrame([("z", 1, 1.0)], "k string, at int, x double"), path)
    assert [tuple(r) for r in sinks.read_store(spark, path).collect()] == [("z", 1, 1.0)]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "ldr"), (1, 1, "ret"), (2, 0, "b")], "seq long, pos long, op string")
    sinks.write_csv(rows, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").count() == 3
    sinks.write_text(sinks.corpus(rows), f"{tmp_path}/t")
    assert sorted(r[0] for r in spark.read.text(f"file://{tmp_path}/t").collect()) == ["b", "ldr ret"]
    assert {tuple(r) for r in sinks.vocabulary(rows.select(F.col("op").alias("token"))).collect()} == {("b", 2), ("ldr", 3), ("ret", 4)}
    records = sinks.graph_records(rows, graph.control(rows).withColumn("type", F.lit(1)))
    assembly.write_records(records, f"{tmp_path}/g")
    lines = [json.loads(r[0]) for r in spark.read.text(f"file://{tmp_path}/g").collect()]
    assert next(x for x in lines if x["seq"] == 1)["edges"] == [{"src": 0, "dst": 1, "type": 1}]
    before = spark.createDataFrame([("a",), ("a",), ("b",)], "label string")
    text = sinks.markdown(sinks.report_rows(before, before.where("label = 'b'")), "Cleaning")
    assert "Rows 3, kept 1, removed 2." in text and "| a | 2 | 0 | 2 | 100.00 |" in text


def rows_of(spark, lines):
    return spark.createDataFrame([(0, 0, i, x) for i, x in enumerate(lines)], "seq long, lo long, i long, line string")


def test_utility_windows(spark):
    got = lambda lines: selection.utility(rows_of(spark, lines)).first()["utility"]
    assert got(["_rdtsc:", "mov x0, x1", "ret"])
    assert got(["bl _printf", "bl printf", "mov x0, x1"])
    assert not got(["mov x0, x1", "bl _printf", "ret", "nop"])


def test_windows_of_empty_tables_and_null_lines(spark):
    none = rows_of(spark, ["nop"]).where("false")
    odd = spark.createDataFrame([(0, 0, i, x) for i, x in enumerate([None, "", "ret", "ret", "ldr x0, [x1]" * 2000])] + [(None, 0, 0, "nop")], "seq long, lo long, i long, line string")
    for work in (features.profiles, features.structural, listings.base_features, listings.dependency_features, listings.memory_features, listings.graph_features, selection.benign, selection.interesting, selection.texts):
        assert work(none).count() == 0
        assert work(odd.where("seq IS NOT NULL")).count() == 1
    assert similarity.measured(similarity.shapes(none)).count() == 0
    assert listings.graph_edges(listings.graph_nodes(none)).count() == 0


def test_stream_operators_on_empty_and_odd_rows(spark):
    schema = "seq long, pos long, op string, dest long, src long"
    none = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, 0, "view", None, None), (1, 1, None, 2, 2), (1, 2, "purchase", None, 2)], schema)
    for work in (graph.control, graph.data_dependence, graph.speculative, graph.after_fence, graph.all_edges, detect.detections, lambda r: windows.sliding(r, [5], 5), lambda r: windows.strided(r, 30, 15, 1)):
        assert work(none).count() == 0
        work(odd).count()
    assert detect.suppressed(detect.detections(none)).count() == 0
    assert splits.stratified(spark.createDataFrame([], "id long, label string")).count() == 0
    assert {r["split"] for r in splits.stratified(spark.createDataFrame([(1, None), (2, None), (2, "a")], "id long, label string")).collect()} <= {"test", "train"}


def test_analog_windows_hold_every_line(spark):
    rows = spark.range(47).select(F.lit(1).cast("long").alias("seq"), F.col("id").alias("pos"), F.lit("nop").alias("line"))
    got = {(r["lo"], r["n"]) for r in assembly_analog.windows(rows).groupBy("lo").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 30), (15, 30), (30, 17)}
