"""Commits that are whole or not at all, and constraints that stop a write."""

import pytest
from pyspark.sql import functions as F
from tideline.plans import audit, constraints
from tideline.plans.ingest import CommitError, Layout, forget, opened, publish

OBSERVED = "source_file string, record_id string, patient_id string, event_time timestamp_ntz, available_time timestamp_ntz, value_num double, value_text string"


class Stop(Exception):
    pass


@pytest.mark.parametrize("versions", [True, False])
def test_a_run_that_stops_anywhere_leaves_one_whole_version(spark, tmp_path, versions):
    layout = Layout(f"file://{tmp_path}/w", versions)
    of = lambda n: {name: spark.range(n) for name in ("observations", "quarantine", "ingest_manifest")}
    publish(spark, layout, of(1))
    size = 1
    seen = lambda at: {name: spark.read.parquet(at.table(name)).count() for name in of(0)}
    for stop in (*of(0), "ready", "waiting", "committed"):
        held = opened(spark, layout) if versions else None

        def step(name, stop=stop):
            if name == stop:
                raise Stop

        size += 1
        try:
            publish(spark, layout, of(size), step)
            done = True
        except Stop:
            done = stop in ("ready", "committed")  # all is written; a reader finishes the swap
        counts = seen(opened(spark, layout))
        assert len(set(counts.values())) == 1
        size = size if done else size - 1
        assert set(counts.values()) == {size}, stop
        if held:
            assert len(set(seen(held).values())) == 1  # who reads goes on reading one version


def test_versions_are_committed_once_and_forgotten(spark, tmp_path):
    layout = Layout(f"file://{tmp_path}/w", True)
    with pytest.raises(FileNotFoundError):
        opened(spark, layout)
    for n in range(4):
        publish(spark, layout, {"a": spark.range(n)})

    with pytest.raises(CommitError):
        publish(spark, layout, {"a": spark.range(8)}, lambda name: (tmp_path / "w/_commits/000000000005").touch() if name == "waiting" else None)
    (tmp_path / "w/_commits/000000000005").unlink()
    forget(spark, layout, 2)
    assert sorted(p.name for p in (tmp_path / "w/_versions").iterdir() if p.is_dir())[:2] == ["000000000003", "000000000004"] and spark.read.parquet(opened(spark, layout).table("a")).count() == 3


def test_declared_constraints(spark):
    good = spark.createDataFrame([("m", "1", "p", None, None, 1.0, None)], OBSERVED).withColumn("event_time", F.expr("timestamp_ntz'2026-01-01 00:00:00'")).withColumn("available_time", F.col("event_time"))
    constraints.require({"observations": good})
    bad = good.unionByName(good).unionByName(good.withColumn("record_id", F.lit("2")).withColumn("value_num", F.lit(None).cast("double")))
    assert sorted(constraints.faults({"observations": bad}).collect()) == [("observations", "key", 1), ("observations", "value", 1)]
    with pytest.raises(audit.ViolationError, match="key"):
        constraints.require({"observations": bad})
    signals = spark.createDataFrame([("s1",)], "signal_id string").select("signal_id", *[F.lit(v).alias(c) for c, v in {"priority": "LOW", "risk": 0.1, "confidence": 0.1, "explanation": "x", "model_version": "v", "evidence_start": 1, "evidence_end": 2, "decision_time": 2}.items()])
    cited = spark.createDataFrame([("s1",), ("s2",), (None,)], "signal_id string").select("signal_id", *[F.lit(v).alias(c) for c, v in {"source_file": "m", "record_id": "1", "event_time": 1, "available_time": 1, "role": "PRIMARY"}.items()])
    assert sorted(constraints.faults({"signals": signals, "evidence": cited}).collect()) == [("evidence", "signal_id", 1), ("evidence", "signal_id of signals", 2)]
    assert constraints.faults({"signals": signals.limit(0), "evidence": cited.limit(0)}).count() == 0
    manifest = spark.createDataFrame([("r1", "f", None, None, "observations")], "run_id string, source_file string, sha256 string, ingested_at string, target_table string")
    quarantine = spark.createDataFrame([("WHY",)], "reject_reason string")
    assert {(r.table, r.rule) for r in constraints.faults({"ingest_manifest": manifest, "quarantine": quarantine}).collect()} == {("ingest_manifest", "sha256"), ("ingest_manifest", "ingested_at"), ("quarantine", "reject_reason")}


def test_stored_tables_go_with_their_scope(spark):
    import os
    from concurrent.futures import ThreadPoolExecutor

    from tideline import queries
    from tideline.sources import stored

    top = f"{stored._folder(spark).removeprefix('file://')}/tables"
    there = lambda: set(os.listdir(top)) if os.path.isdir(top) else set()
    before = there()
    with ThreadPoolExecutor(2) as pool:
        jobs = [pool.submit(lambda n=n: queries.QUERIES[n](spark, "/root/testdata/sf0.001").count()) for n in ("report_volume", "dedupe_row_number")]
        counts = [j.result() for j in jobs]
    assert len(there() - before) == 2 and counts == [queries.QUERIES[n](spark, "/root/testdata/sf0.001").count() for n in ("report_volume", "dedupe_row_number")]
    with pytest.raises(ZeroDivisionError), stored.scope():
        stored.stored(spark.range(1), "gone")
        raise ZeroDivisionError
    assert not [p for p in there() - before if p.startswith("gone")]
