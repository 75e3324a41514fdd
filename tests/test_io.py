"""Ingestion from CSV, integrity verdicts, exports, audits, the query surface, wording and the stream."""

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tideline.config import EVENTS
from tideline.operators import quality
from tideline.plans import audit, export, narrative, serve
from tideline.plans import sweep as plans
from tideline.plans.ingest import Layout, clinical_facts, ingest
from tideline.sources import event_feed, integrity
from tideline.sources.adapters import Adapter, mirror, read_text_csv, source_row
from tideline.streaming.emit import emit_stream

SF = "/root/testdata/sf0.01"
ADAPTER = Adapter("vitals.csv", "VITAL", {"record_id": "id", "patient_id": "who", "event_time": "at", "available_time": "at", "variable_code": "what", "value": "value", "unit": "unit", "source_system": "system"})
HEAD = "id,who,at,what,value,unit,system\n"
LINES = "1,p,2026-01-01 10:00:00,click,5,raw,M\n2,p,2026-01-01,click,5,raw,M\n3,p,2026-01-01 11:00:00,click,12d,raw,M\n4,,2026-01-01 11:00:00,click,1,raw,M\n5,p,2026-01-01 12:00:00,click,1_000,zz,M\n6,p,2026-01-01 10:00:00,click,7,x10,RETRANSMIT\n"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "vitals.csv").write_text("﻿" + HEAD + LINES)
    (tmp_path / "official.txt").write_text(f"# list\nraw/vitals.csv | 1,234 | {sha('﻿' + HEAD + LINES).upper()}\nnot a line\n")
    return tmp_path


def run(spark, root, run_id="r1", at="2026-02-01 00:00:00"):
    links = spark.createDataFrame([], "record_id string, patient_id string, kind string, subtype string, value_text string, start_time timestamp_ntz, end_time timestamp_ntz, available_time timestamp_ntz")
    official = integrity.official_list(spark, str(root / "official.txt"), "raw/")
    return ingest(spark, f"file://{root}/raw", [ADAPTER], event_feed.units(spark), event_feed.variables(spark), links, official, Layout(f"file://{root}/warehouse"), run_id, at)


def test_ingest_splits_and_counts(spark, source):
    assert [r["verdict"] for r in run(spark, source)] == ["NEW"]
    obs = {r.record_id: r for r in spark.read.parquet(f"file://{source}/warehouse/observations").collect()}
    bad = {r.record_id: r.reject_reason for r in spark.read.parquet(f"file://{source}/warehouse/quarantine").collect()}
    assert bad == {"2": "BAD_EVENT_TIME", "4": "NO_PATIENT", "5": "UNIT_UNKNOWN"}
    assert set(obs) == {"1", "3", "6"} and obs["3"].value_text == "12d" and obs["3"].value_num is None
    assert not obs["6"].is_availability_known and obs["6"].is_duplicate and abs(obs["6"].value_num - 0.7) < 1e-9
    m = spark.read.parquet(f"file://{source}/warehouse/ingest_manifest").collect()
    assert [(r.rows_read, r.rows_loaded, r.rows_quarantined) for r in m] == [(6, 3, 3)]


def test_verdicts_over_runs(spark, source):
    run(spark, source)
    assert run(spark, source, "r2", "2026-02-02 00:00:00")[0]["verdict"] == "IDENTICAL"
    path = source / "raw" / "vitals.csv"
    path.write_text(path.read_text() + "7,p,2026-01-02 10:00:00,click,5,raw,M\n")
    assert run(spark, source, "r3", "2026-02-03 00:00:00")[0]["verdict"] == "APPENDED"
    path.write_text(HEAD + "7,p,2026-01-02 10:00:00,click,5,raw,M\n")
    before = spark.read.parquet(f"file://{source}/warehouse/observations").count()
    with pytest.raises(integrity.IntegrityError, match="modified"):
        run(spark, source, "r4", "2026-02-04 00:00:00")
    assert spark.read.parquet(f"file://{source}/warehouse/observations").count() == before
    (source / "official.txt").write_text(f"raw/vitals.csv | 9 | {sha(path.read_text())}\n")
    assert run(spark, source, "r5", "2026-02-05 00:00:00")[0]["verdict"] == "NEW_VERSION"
    path.unlink()
    with pytest.raises(integrity.IntegrityError, match="missing"):
        run(spark, source, "r6", "2026-02-06 00:00:00")
    assert spark.read.parquet(f"file://{source}/warehouse/ingest_manifest").count() == 4


def test_unlisted_first_ingest_is_refused(spark, source):
    (source / "official.txt").write_text("nothing\n")
    with pytest.raises(integrity.IntegrityError, match="not on the official list"):
        run(spark, source)


def test_csv_rows_and_mirrors(spark, source):
    path = f"file://{source}/raw/vitals.csv"
    assert read_text_csv(spark, path).columns[0] == "id" and {t for _, t in read_text_csv(spark, path).dtypes} == {"string"}
    assert source_row(spark, path, "3", {"vitals.csv"}, "vitals.csv").first().value == "12d"
    with pytest.raises(ValueError):
        source_row(spark, path, "3", {"vitals.csv"}, "../secret.csv")
    assert mirror(spark, {"vitals_view": path}) == {"vitals_view": 6} and spark.table("vitals_view").count() == 6


def test_facts_without_availability_are_quarantined(spark):
    rows = spark.createDataFrame([("1", "p", "c", "2026-01-01", "2026-01-02 00:00:00"), ("2", "p", "c", "2026", "2026-01-02")], "id string, who string, code string, onset string, recorded string")
    good, bad = clinical_facts(rows, {"record_id": "id", "patient_id": "who", "code": "code", "onset": "onset", "recorded": "recorded"})
    assert [r.record_id for r in good.collect()] == ["1"] and [r.reject_reason for r in bad.collect()] == ["BAD_AVAILABLE_TIME"]


def test_latest_covering_interval_wins(spark):
    t = datetime(2026, 1, 1, 10)
    obs = spark.createDataFrame([("m", "1", "p", t, t, True), ("m", "2", "p", t + timedelta(days=1), t + timedelta(days=1), True), ("m", "3", "p", t, t, False)], "source_file string, record_id string, patient_id string, event_time timestamp_ntz, available_time timestamp_ntz, is_retransmit boolean")
    links = spark.createDataFrame([("p", "CONNECTIVITY", t, t + timedelta(hours=h)) for h in (10, 30, 20)], "patient_id string, kind string, start_time timestamp_ntz, end_time timestamp_ntz").where("kind = 'CONNECTIVITY'")
    got = {r.record_id: (r.available_time, r.is_availability_known) for r in quality.resolve_availability(obs, links).collect()}
    assert got == {"1": (t + timedelta(hours=30), True), "2": (t + timedelta(days=1, hours=6), True), "3": (t, True)}


@pytest.fixture(scope="module")
def service(spark):
    links = quality.valid_intervals(event_feed.intervals(spark, SF)).where("reject_reason is null").cache()
    obs = quality.clean(event_feed.staged(spark, SF), event_feed.units(spark), event_feed.variables(spark), links).cache()
    clean = plans.Clean(obs, links)
    s = plans.written(plans.sweep(clean, EVENTS))
    return serve.Service(clean, plans.signals(s).cache(), plans.evidence(s, clean).cache(), EVENTS)


def test_service_answers(spark, service):
    assert {r.name for r in service.health().collect()} == {"observations", "intervals", "signals"}
    assert {r.source_file for r in service.loaded_sources().collect()} == {"monitor", "wearable", "intervals"}
    rows = service.list_signals().collect()
    assert [r.risk for r in rows] == sorted((r.risk for r in rows), reverse=True)
    for r in rows[:1]:
        assert service.signal(r.signal_id).first().evidence["PRIMARY"]
        live = service.decide(r.patient_id, str(r.decision_time)).first()
        assert abs(live.risk - r.risk) < 1e-4 and live.priority == r.priority and "concordant" in live.explanation
    told = service.narrative(r.patient_id, str(r.decision_time))
    assert told["source"] == "plain" and told["refs"] and live.priority not in told["summary"]
    with pytest.raises(serve.NotFound):
        service.signal("none")
    with pytest.raises(serve.NotFound):
        service.decide("nobody", "2024-01-20 00:00:00")
    with pytest.raises(ValueError):
        service.list_signals(limit=0)
    with pytest.raises(ValueError):
        service.history("U1", "2024-01-20 00:00:00", "2024-01-19 00:00:00", 60)
    assert service.patients().count() == 150
    full, cut = (sum(len(r.series) for r in service.timeline("U1", as_of=t).collect()) for t in (None, "2024-01-10 00:00:00"))
    assert 0 < cut < full
    h = service.history("U1", "2024-01-25 00:00:00", "2024-01-27 05:00:00", 1440).first()
    assert h.asked == 4 and h.last_t == datetime(2024, 1, 27, 5)
    assert h.current.t == h.last_t and [x.t for x in h.trajectory] == sorted(x.t for x in h.trajectory) and len(h.transitions) == 1 + sum(a.priority != b.priority for a, b in zip(h.trajectory, h.trajectory[1:]))
    assert service.timeline_intervals("U1").count() > 0 and live.visible > 0 and {c.variable_code for c in live.channels} <= {"click", "error", "purchase", "signup", "view"}


def test_audits_find_nothing_here_and_what_is_planted(spark, service):
    assert audit.late_evidence(service.evidence).count() == 0
    assert audit.orphans(service.signals, service.evidence).count() == 0
    assert audit.violations(service.signals, audit.signal_rules()).count() == 0
    text = service.signals.select("signal_id", "patient_id", "explanation", "model_version", *[F.col(c).cast("string").alias(c) for c in ("decision_time", "evidence_start", "evidence_end", "risk", "confidence")], "priority")
    assert audit.validate_submission(text, service.evidence, service.clean.observations.select("patient_id").distinct()).count() == 0
    broken = text.withColumn("risk", F.lit("2")).withColumn("priority", F.lit("URGENT")).union(text.withColumn("signal_id", F.lit("ghost")).limit(1))
    rules = {r.rule for r in audit.validate_submission(broken, service.evidence, service.clean.observations.limit(0).select("patient_id")).collect()}
    assert {"risk", "priority", "no_evidence", "unknown_patient"} <= rules
    with pytest.raises(audit.ViolationError):
        audit.validate_submission(text.drop("risk"), service.evidence)


def test_exports(spark, service, tmp_path):
    folder = f"file://{tmp_path}/out"
    export.persist(service.signals, service.evidence, folder)
    assert spark.read.parquet(f"{folder}/signals").count() == service.signals.count()
    path = export.export_csv(service.signals.drop("k", "demoted"), "signals", f"{folder}/csv")
    back = read_text_csv(spark, path)
    ids = [r.signal_id for r in back.collect()]
    assert ids == sorted(ids) and len(ids) == service.signals.count() and "T" not in back.first().decision_time
    (tmp_path / "out" / "csv" / "other.txt").write_text("stays")
    assert export.discard_exports(spark, f"{folder}/csv") == ["signals"] and export.discard_exports(spark, f"{folder}/csv") == []
    assert (tmp_path / "out" / "csv" / "other.txt").exists()
    with pytest.raises(audit.ViolationError):
        export.persist(service.signals.withColumn("risk", F.lit(2.0)), service.evidence, folder)


def test_narrative():
    channels = [{"variable_code": "HR", "place": 0, "score": 3.0, "centre": 70.0, "evidence": [{"record_id": "1", "value": 90.0}]}, {"variable_code": "RR", "place": 1, "score": 0.0, "centre": 16.0, "evidence": [{"record_id": "2", "value": 16.0}]}]
    plain = narrative.narrate(1, channels, 1, ["activity"])
    assert plain["source"] == "plain" and plain["refs"] == ["1"] and len(plain["review"]) == 3
    good = {"summary": "The heart rate rises.", "review": [], "refs": ["1"]}
    assert narrative.narrate(1, channels, 0, [], lambda _: good)["source"] == "generated"
    code = {"summary": "SpO2 falls.", "review": [], "refs": []}
    assert narrative.narrate(1, channels, 0, [], lambda _: code)["refs"] == ["1"] and narrative.findings(channels, units={"HR": "/min"})[0]["direction"] == "rise"
    for bad in ({"summary": "Risk 9.", "review": [], "refs": []}, {"summary": "A diagnosis.", "review": [], "refs": []}, {"summary": "x", "review": [], "refs": ["9"]}, {}):
        assert narrative.narrate(1, channels, 0, [], lambda _, b=bad: b)["source"] == "plain"
    assert "peaked" in narrative.history_fallback("LOW", "HIGH", 2)["summary"]
    assert "Several" in narrative.fallback(2, narrative.findings(channels), 0, [])["summary"] and narrative.fallback(0, [], 0, [])["refs"] == []


def test_stream_emits_what_the_batch_emits(spark, tmp_path):
    t = datetime(2026, 1, 1)
    steps = [("p", t, 1, 0.5, 9.0, 1, False), ("p", t + timedelta(hours=24), 1, 0.55, 9.0, 1, False), ("p", t + timedelta(hours=96), 1, 0.7, 9.0, 1, False), ("p", t + timedelta(hours=97), 2, 0.7, 9.0, 2, False), ("q", t, 0, 0.1, 20.0, 2, True), ("r", t, 2, 0.7, 14.5, 2, False), ("r", t + timedelta(hours=73), 0, 0.1, 14.5, 2, True)]
    schema = "patient_id string, t timestamp, band int, risk double, raw double, raw_band int, noted boolean"
    spark.createDataFrame(steps, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = emit_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), EVENTS)
    q = stream.writeStream.format("memory").queryName("emitted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.patient_id, r.t, r.demoted) for r in spark.table("emitted").collect()) == [("p", t, False), ("p", t + timedelta(hours=96), False), ("p", t + timedelta(hours=97), False), ("q", t, True), ("r", t, False), ("r", t + timedelta(hours=73), True)]
