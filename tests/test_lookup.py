"""Rows by index, one sorted file from many parts, and counts taken while writing."""

import csv

import pytest
from pyspark.sql import functions as F
from tideline.plans import export, ingest
from tideline.sources import rowindex
from tideline.sources.adapters import source_row


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_rows_by_index_are_those_of_a_scan(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(rowindex, "BLOCK", block)
    rows = [[f"r{i}", f"value {i}", "" if i % 3 else 'a "b", c'] for i in range(60)] + [['x,"1"', "odd", "ö"], ["r5", "again", "z"]]
    with open(tmp_path / "a.csv", "w", encoding="utf-8", newline="") as f:
        f.write("﻿")
        csv.writer(f, lineterminator="\r\n").writerows([["id", "text", "more"], *rows])
    (tmp_path / "b.csv").write_text("id,text\nr1,other")
    uri = {n: f"file://{tmp_path}/{n}" for n in ("a.csv", "b.csv")}
    index = rowindex.index_rows(spark, uri).cache()
    assert index.where("start > 0 and source_file = 'a.csv'").count() == len(rows) and index.where("source_file = 'b.csv'").count() == 2
    for key in ("r0", "r5", "r59", 'x,"1"'):
        cells = rowindex.indexed_row(index, key, "a.csv", set(uri)).first().cells
        assert [cells["id"], cells["text"], cells["more"] or ""] == next(r for r in rows if r[0] == key)
    assert rowindex.indexed_row(index, "r7", "a.csv", set(uri)).first().cells == source_row(spark, uri["a.csv"], "r7", set(uri), "a.csv").first().asDict()
    assert rowindex.indexed_row(index, "r1", "b.csv", set(uri)).first().cells["text"] == "other" and rowindex.indexed_row(index, "id", "b.csv", set(uri)).count() == 0
    with pytest.raises(ValueError):
        rowindex.indexed_row(index, "r1", "../c.csv", set(uri))


def test_a_lookup_reads_little(spark, tmp_path):
    spark.range(400_000).selectExpr("concat('r', lpad(cast(id as string), 8, '0')) AS id", "repeat('x', 40) AS text").coalesce(1).write.csv(f"{tmp_path}/in", header=True)
    file = next((tmp_path / "in").glob("*.csv"))
    path = f"{tmp_path}/index"
    spark.conf.set("parquet.block.size", str(1 << 20))
    rowindex.index_rows(spark, {"big.csv": f"file://{file}"}, path)
    index = spark.read.parquet(path)
    assert rowindex.indexed_row(index, "r00123456", "big.csv", {"big.csv"}).first().cells["id"] == "r00123456"
    plan = index.where("source_file = 'big.csv' and record_id = 'r00123456'")._jdf.queryExecution().executedPlan().toString()
    assert "ualTo(record_id" in plan  # statistics of sorted files and row groups prune the rest
    ranges = index.groupBy(F.input_file_name()).agg(F.min("record_id").alias("lo"), F.max("record_id").alias("hi")).where("'r00123456' between lo and hi").count()
    assert ranges <= 2 and index.where("record_id = 'r00123456'").first().length < 100


def test_one_sorted_file_from_many_parts(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).selectExpr("concat('s', lpad(cast((id * 7919) % 5000 as string), 5, '0')) AS signal_id", "'p' AS patient_id", "timestamp_ntz'2026-01-01 00:00:00' AS decision_time", "if(id % 7 = 0, 'a, \"b\"', 'c') AS explanation")
        path = export.export_csv(df, "signals", f"file://{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert path.endswith("/signals") and [p.name for p in (tmp_path / "out/signals").iterdir() if not p.name.startswith(".")] == ["signals.csv"]
    rows = list(spark.read.csv(path, header=True, escape='"').toLocalIterator())
    text = (tmp_path / "out/signals/signals.csv").read_text()
    ids = [line.split(",")[0] for line in text.splitlines()[1:]]
    assert text.startswith("signal_id,patient_id,decision_time,explanation\n") and ids == sorted(ids) and len(ids) == len(set(ids)) == len(rows) == 5000


def test_counts_are_taken_on_the_way(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.range(1000).selectExpr("if(id % 2 = 0, 'a', 'b') AS source_file", "if(id % 5 = 0, 'BAD', null) AS reject_reason").mapInArrow(counted, "source_file string, reject_reason string")
    rows, counts = ingest._counted(df, ["a", "b", "none"], "observations", "typed")
    assert {tuple(r) for r in counts.collect()} == {("a", 500, 400, 100, "observations"), ("b", 500, 400, 100, "observations"), ("none", 0, 0, 0, "observations")}
    assert rows.count() == 1000 and reads.value == 1000  # written and counted in one pass
