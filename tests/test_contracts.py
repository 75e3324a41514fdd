"""Registries, snapshots, ranges, submissions, markers, hashes, swaps and plans."""

import hashlib
import json
import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_scoring import CLINICAL, INTERVAL, OBSERVATION, T, course, outcomes
from tideline import config, queries
from tideline.__main__ import main
from tideline.operators import asof, assess, channels, quality, ranges
from tideline.plans import audit, serve
from tideline.plans import sweep as plans
from tideline.plans.ingest import Layout, ingest_registry, publish, recover
from tideline.sources import integrity
from tideline.sources.adapters import migrated, read_registry

SF = "/root/testdata/sf0.001"


def sha(path):
    return hashlib.sha256(path.read_bytes()).hexdigest()


# ------------------------------------------------------------------ sources


@pytest.fixture
def source(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    files = {
        "vitals.csv": "id,who,at,what,value,unit,low,high,system\n1,p,2026-01-01 10:00:00,HR,70,bpm,,,\n2,p,2026-01-01 11:00:00,LAB_A,9,mg,1,5,LAB\n3,p,2026-01-01 10:30:00,HR,400,bpm,,,RETRANSMIT\n",
        "links.csv": "id,who,from,to,state,delayed\na,p,2026-01-01 10:00:00,2026-01-01 12:00:00,DOWN,3\nb,,2026-01-01 10:00:00,2026-01-01 12:00:00,DOWN,\nc,p,2026-01-01 10:00:00,2026-01-01 09:00:00,DOWN,\n",
        "history.csv": "id,who,kind,since,known\nf1,p,C1,2020-01-01,2026-01-01 00:00:00\nf2,p,C2,2020-01-01,soon\n",
        "units.csv": "unit_code,factor,unit_offset\nbpm,1,0\nmg,1,0\n",
        "variables.csv": "variable_code,plausible_min,plausible_max\nHR,20,250\nLAB_A,,\n",
    }
    for name, text in files.items():
        (raw / name).write_text(text)
    settings = {
        "observations": [{"source_file": "vitals.csv", "domain": "VITAL", "record_id": "id", "patient_id": "who", "event_time": "at", "available_time": "at", "variable_code": "what", "value": "value", "unit": "unit", "ref_low": "low", "ref_high": "high", "source_system": "system"}],
        "intervals": [{"source_file": "links.csv", "kind": "CONNECTIVITY", "record_id": "id", "patient_id": "who", "start_time": "from", "end_time": "to", "available_time": "from", "subtype": "state", "extra": ["delayed"]}],
        "facts": [{"source_file": "history.csv", "record_id": "id", "patient_id": "who", "category": "kind", "onset": "since", "available_time": "known"}],
        "catalogs": {"units": "units.csv", "variables": "variables.csv"},
    }
    (tmp_path / "sources.json").write_text(json.dumps(settings))
    (tmp_path / "official.txt").write_text("".join(f"{n} | {(raw / n).stat().st_size} | {sha(raw / n)}\n" for n in files))
    return tmp_path


def test_a_registry_is_ingested_whole(spark, source):
    registry = read_registry(str(source / "sources.json"))
    layout = Layout(f"file://{source}/warehouse")
    report = ingest_registry(spark, f"file://{source}/raw", registry, integrity.official_list(spark, str(source / "official.txt")), layout, "r1", "2026-02-01 00:00:00")
    assert {r["source_file"] for r in report} == set(registry.source_files()) and {r["verdict"] for r in report} == {"NEW"}
    read = lambda name: spark.read.parquet(layout.table(name)).collect()
    obs = {r.record_id: r for r in read("observations")}
    assert set(obs) == {"1", "2", "3"} and (obs["2"].ref_low, obs["2"].ref_high) == (1.0, 5.0)
    assert obs["1"].is_availability_known and not obs["1"].is_retransmit  # no source system is no retransmission
    assert obs["3"].available_time == datetime(2026, 1, 1, 12) and not obs["3"].is_plausible
    assert [(r.record_id, json.loads(r.extra_json)) for r in read("intervals")] == [("a", {"delayed": "3"})]
    assert [r.record_id for r in read("clinical_facts")] == ["f1"]
    assert {(r.record_id, r.reject_reason, r.detail) for r in read("quarantine")} == {("b", "NO_PATIENT", "interval"), ("c", "TIME_ORDER", "interval"), ("f2", "BAD_AVAILABLE_TIME", "fact")}
    rows = {r.source_file: r for r in read("ingest_manifest")}
    assert all(r.rows_read == r.rows_loaded + r.rows_quarantined for r in rows.values()) and rows["links.csv"].target_table == "intervals" and rows["vitals.csv"].code_version and rows["vitals.csv"].official_sha == rows["vitals.csv"].sha256
    (source / "bad.json").write_text(json.dumps({"observations": [{"source_file": "x", "domain": "d", "surprise": "y"}]}))
    with pytest.raises(ValueError, match="surprise"):
        read_registry(str(source / "bad.json"))


def test_a_swap_that_was_cut_off_is_finished_and_half_a_run_is_dropped(spark, tmp_path):
    layout = Layout(f"file://{tmp_path}/w")
    publish(spark, layout, {"a": spark.range(1), "b": spark.range(1)})
    spark.range(2).write.parquet(layout.table("_next/a"))
    spark.range(2).write.parquet(layout.table("_next/b"))
    recover(spark, layout)  # not all was written
    n = lambda name: spark.read.schema("id long").parquet(layout.table(name)).count()
    assert (n("a"), n("b")) == (1, 1)
    spark.range(2).write.parquet(layout.table("_next/b"))
    (tmp_path / "w" / "_next" / "_ready").touch()  # the swap ended after a
    recover(spark, layout)
    assert (n("a"), n("b")) == (1, 2)


def test_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(integrity, "PIECE", 7)
    (tmp_path / "a.csv").write_bytes(bytes(range(256)) * 3)
    (tmp_path / "b.csv").write_bytes(b"abc")
    before = spark.createDataFrame([("a.csv", 300), ("b.csv", 5)], "source_file string, bytes long")
    got = {r.source_file: r for r in integrity.file_hashes(spark, f"file://{tmp_path}", "*.csv", before).collect()}
    whole = bytes(range(256)) * 3
    assert (got["a.csv"].bytes, got["a.csv"].sha256, got["a.csv"].prefix_sha256) == (768, hashlib.sha256(whole).hexdigest(), hashlib.sha256(whole[:300]).hexdigest())
    assert got["b.csv"].sha256 == hashlib.sha256(b"abc").hexdigest() and got["b.csv"].prefix_sha256 is None


def test_old_tables_gain_columns_at_their_defaults(spark):
    df = migrated(spark.createDataFrame([(1, None), (2, False)], "id int, known boolean"), {"known": F.lit(True), "k": F.lit(0)})
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, True, 0), (2, False, 0)]


# ------------------------------------------------------------------ what was known


def test_meeting_gives_every_pair_once(spark):
    rng = random.Random(1)
    at = lambda h: T + timedelta(hours=h)
    rows = [(f"p{rng.randrange(3)}", i, at(a := rng.uniform(0, 100)), at(a + rng.choice([0, 3, 60]))) for i in range(150)]
    windows = [(f"p{rng.randrange(3)}", i, at(a := rng.uniform(0, 100)), at(a + rng.choice([0, 5, 30]))) for i in range(80)]
    met = asof.meeting(
        spark.createDataFrame(rows, "patient_id string, a int, lo timestamp_ntz, hi timestamp_ntz"), F.col("lo"), F.col("hi"),
        spark.createDataFrame(windows, "patient_id string, b int, since timestamp_ntz, t timestamp_ntz"), 7, since="since",
    )
    got = [(r.a, r.b) for r in met.collect()]
    want = {(a, b) for p, a, lo, hi in rows for q, b, since, t in windows if p == q and lo <= t and hi >= since}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_snapshot_refuses_what_came_later(spark):
    rows = course("p", lag=30)
    instants = spark.createDataFrame([("p", T)], "patient_id string, t timestamp_ntz")
    facts = spark.createDataFrame([("f", "1", "p", T - timedelta(days=1)), ("f", "2", "p", T + timedelta(days=1))], "source_file string, record_id string, patient_id string, available_time timestamp_ntz")
    clean = plans.Clean(spark.createDataFrame(rows, OBSERVATION), spark.createDataFrame([], INTERVAL), facts)
    parts = plans.snapshot(clean, instants, CLINICAL)
    assert [r.record_id for r in parts["facts"].collect()] == ["1"] and parts["observations"].count() == sum(r[5] <= T and r[4] >= T - timedelta(hours=54) for r in rows)
    with pytest.raises(asof.CausalityError):
        asof.assert_causal(parts["observations"].withColumn("available_time", F.expr("t + interval 1 minute")))


def test_laboratories_go_by_the_ranges_of_their_rows(spark):
    lab = lambda i, code, at, v, low, high: ("lab", i, "p", code, at, at, v, None, True, False, True, low, high)
    rows = [
        lab("1", "LAB_A", T - timedelta(hours=9), 9.0, 1.0, 5.0), lab("2", "LAB_A", T - timedelta(hours=2), 4.0, 1.0, 5.0),
        lab("4", "LAB_B", T - timedelta(hours=1), 9.0, 1.0, 5.0), lab("3", "LAB_B", T - timedelta(hours=1), 0.5, 1.0, None), lab("5", "LAB_C", T, 9.0, 1.0, 5.0), lab("6", "LAB_D", T - timedelta(hours=25), 9.0, 1.0, 5.0),
    ]
    visible = asof.at_instants(spark.createDataFrame(rows, OBSERVATION + ", ref_low double, ref_high double"), spark.createDataFrame([("p", T)], "patient_id string, t timestamp_ntz"), 54)
    got = {r.variable_code: (r.record_id, r.abnormal) for r in assess.labs(visible, config.CLINICAL).collect()}
    assert got == {"LAB_A": ("2", False), "LAB_B": ("3", False), "LAB_C": ("5", True)}


def test_explanations_name_channels_rules_and_totals(spark):
    rise = lambda code, at: max(0.0, min(1.0, (at - (T - timedelta(hours=4))) / timedelta(hours=4))) * 8
    spike = lambda code, at: 9.0 if code == "HR" and at >= T - timedelta(hours=1) else 0.0
    walk = ("i1", "spike", "CONTEXT", "PHYSICAL_ACTIVITY", "HIGH", T - timedelta(hours=2), T + timedelta(hours=1), T - timedelta(hours=2))
    _, s = outcomes(spark, [course("rise", rise), course("spike", spike), course("flat", lambda code, at: -1.0)], [walk])
    said = {r.patient_id: r.text for r in s.assessments.select("patient_id", assess.explanation(s.profile).alias("text")).collect()}
    assert said["rise"].count("level") == 4 and "priority CRITICAL" in said["rise"] and "rule" not in said["rise"]
    assert "rule activity, score reduced by 70%: HR carries" in said["spike"] and "risk 0." in said["spike"]
    assert all(t and "null" not in t for t in said.values())


def test_the_clinical_profile_is_the_one_that_is_tested():
    assert replace(config.CLINICAL, labs=CLINICAL.labs) == CLINICAL


# ------------------------------------------------------------------ statistics


def test_quantiles_of_groups_match_plain_ones(spark):
    import numpy as np

    rng = random.Random(2)
    rows = [(k, float(rng.choice([rng.randrange(5), rng.random()]))) for k in ("a", "b", "hot") for _ in range({"a": 1, "b": 10, "hot": 700}[k])]
    got = {r.k: (r["count"], r.q0, r.q1) for r in ranges.quantiles(spark.createDataFrame([*rows, ("b", None)], "k string, v double"), ("k",), "v", (0.5, 0.05), "q").collect()}
    for k in ("a", "b", "hot"):
        v = [x for key, x in rows if key == k]
        assert got[k][0] == len(v) and got[k][1:] == pytest.approx((np.quantile(v, 0.5), np.quantile(v, 0.05)))


def test_dispersion_floors_match_a_plain_loop(spark):
    import numpy as np

    rng, rows = random.Random(3), []
    for p in range(12):
        for h in range(0, 96, 2):
            rows.append(("m", f"{p}-{h}", f"p{p}", "HR", datetime(2026, 1, 1) + timedelta(hours=h), T, rng.gauss(70, 1 + p), None, True, False, True))
    got = channels.dispersion_floors(spark.createDataFrame(rows, OBSERVATION), 24, 3).first()
    scales = []
    for p in range(12):
        for d in range(4):
            v = np.array([r[6] for r in rows if r[2] == f"p{p}" and (r[4] - datetime(2026, 1, 1)).days == d])
            scales.append(np.median(np.abs(v - np.median(v))) * 1.4826)
    assert got.windows == 48 and got.floor == pytest.approx(np.quantile(scales, 0.05))


# ------------------------------------------------------------------ audits


SUBMITTED = "signal_id string, patient_id string, decision_time string, priority string, risk string, confidence string, evidence_start string, evidence_end string, explanation string, model_version string"
PROOF = "signal_id string, source_file string, record_id string, event_time string, available_time string, role string, contribution string"


def test_every_fault_of_a_submission_is_told(spark):
    good = {"signal_id": "s", "patient_id": "p", "decision_time": "2026-01-02 00:00:00", "priority": " high ", "risk": "0.5", "confidence": "", "evidence_start": "2026-01-01T18:00:00", "evidence_end": "2026-01-02 00:00:00", "explanation": "x", "model_version": "1"}
    bad = {
        "patient_id": ("patient_id", " "), "risk": ("risk", "1.5"), "priority": ("priority", "URGENT"), "confidence": ("confidence", "much"), "times": ("decision_time", "today"), "time_order": ("evidence_start", "2026-01-03 00:00:00"),
        "explanation": ("explanation", " "), "model_version": ("model_version", None), "unknown_patient": ("patient_id", "q"),
    }
    late = {"time_order_2": ("evidence_end", "2026-01-02 01:00:00")}
    rows = [good, *[{**good, "signal_id": rule, column: value} for rule, (column, value) in {**bad, **late}.items()], {**good, "signal_id": ""}, {**good, "signal_id": "twice"}, {**good, "signal_id": "twice"}, {**good, "signal_id": "bare"}]
    fine = {"signal_id": "s", "source_file": "f", "record_id": "1", "event_time": "2026-01-01 20:00:00", "available_time": "2026-01-01 21:00:00", "role": "primary", "contribution": ""}
    proof = [{**fine, "signal_id": r["signal_id"]} for r in rows if r["signal_id"] not in ("bare", "")]
    proof += [{**fine, "role": "MAIN"}, {**fine, "source_file": " "}, {**fine, "record_id": None}, {**fine, "event_time": "x"}, {**fine, "available_time": "2026-01-02 00:00:01"}, {**fine, "contribution": "much"}, {**fine, "signal_id": "ghost"}]
    signals, evidence = spark.createDataFrame([[r[c.split()[0]] for c in SUBMITTED.split(", ")] for r in rows], SUBMITTED), spark.createDataFrame([[r[c.split()[0]] for c in PROOF.split(", ")] for r in proof], PROOF)
    got = sorted((r.signal_id, r.rule) for r in audit.validate_submission(signals, evidence, spark.createDataFrame([("p",)], "patient_id string")).collect())
    want = [(rule, rule) for rule in bad] + [("time_order_2", "time_order"), ("", "signal_id"), ("twice", "repeated_id"), ("bare", "no_evidence"), ("ghost", "no_signal")]
    want += [("s", rule) for rule in ("role", "source_file", "record_id", "evidence_times", "late_evidence", "contribution")]
    assert got == sorted(want)
    with pytest.raises(audit.ViolationError, match="role"):
        audit.validate_submission(signals, evidence.drop("role"))


def test_markers_in_one_pass_match_a_plain_loop(spark):
    rng = random.Random(4)
    at = lambda h: T + timedelta(hours=h)
    observations = [(f"p{rng.randrange(4)}", at(rng.uniform(0, 200)), rng.choice(["OK", "LOW_SIGNAL", None]), rng.random() < 0.9, rng.random() < 0.1) for _ in range(60)]
    intervals = [(f"p{rng.randrange(4)}", rng.choice(["CONTEXT", "CONNECTIVITY"]), rng.choice(["PHYSICAL_ACTIVITY", "RECOVERY_PHASE"]), rng.choice(["LOW", "HIGH", None]), at(a := rng.uniform(0, 200)), at(a + rng.choice([1, 50]))) for _ in range(15)]
    signals = [(f"s{i}", f"p{rng.randrange(5)}", at(a := rng.uniform(0, 200)), at(a + 6)) for i in range(60)]
    got = audit.markers(
        spark.createDataFrame(signals, "signal_id string, patient_id string, evidence_start timestamp_ntz, evidence_end timestamp_ntz"),
        spark.createDataFrame(observations, "patient_id string, event_time timestamp_ntz, quality_flag string, is_plausible boolean, is_duplicate boolean"),
        spark.createDataFrame(intervals, "patient_id string, kind string, subtype string, value_text string, start_time timestamp_ntz, end_time timestamp_ntz"),
    ).collect()
    assert len(got) == 60
    for r in got:
        o = [x for x in observations if x[0] == r.patient_id and r.evidence_start <= x[1] <= r.evidence_end]
        i = [x for x in intervals if x[0] == r.patient_id and x[4] <= r.evidence_end and x[5] >= r.evidence_start]
        want = {
            "low_signal": any(x[2] == "LOW_SIGNAL" for x in o), "implausible": any(not x[3] for x in o), "retransmission": any(x[4] for x in o), "connectivity": any(x[1] == "CONNECTIVITY" for x in i),
            "activity": any(x[1] == "CONTEXT" and x[2] == "PHYSICAL_ACTIVITY" and x[3] == "HIGH" for x in i), "recovery": any(x[1] == "CONTEXT" and x[2] == "RECOVERY_PHASE" for x in i),
        }
        assert {n: r[n] for n in audit.MARKERS} == want and r.any_marker == any(want.values())


def test_ranks_share_places(spark):
    risks = [0.5, 0.9, 0.5, 0.1, 0.9, 0.3]
    got = {r.signal_id: r.place for r in audit.rank_of(spark.createDataFrame([(str(i), x) for i, x in enumerate(risks)], "signal_id string, risk double")).collect()}
    assert got == {str(i): 1 + sum(y > x for y in risks) for i, x in enumerate(risks)}


# ------------------------------------------------------------------ plans and the command line


def test_plans_read_written_tables_few_times(spark):
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")
    assert scans(queries.early_warning(spark, SF)) <= 8
    assert scans(queries.eventize(spark, SF)) <= 8
    assert scans(queries.ablation_variants(spark, SF)) <= 15


def test_catalogues_are_broadcast_only_if_they_are_small(spark, monkeypatch):
    from tideline.functions import scalars

    plan = lambda: queries._typed(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan().count("strategy=broadcast") == 2
    monkeypatch.setattr(quality, "small", lambda df: scalars.small(df, 2))
    assert "strategy=broadcast" not in plan()


def test_commands_run_on_a_warehouse(spark, tmp_path, capsys):
    clean = queries._clean(spark, SF)
    clean.observations.write.parquet(f"{tmp_path}/w/observations")
    clean.intervals.write.parquet(f"{tmp_path}/w/intervals")
    p = config.EVENTS
    settings = {"channels": [{"code": c.code, "direction": c.direction, "weight": c.weight, "floor": c.floor, "nominal_min": c.nominal_min} for c in p.channels], "evidence_h": p.evidence_h, "baseline_h": p.baseline_h, "streak_min": p.streak_min, "labs": [["signup", None, None]], "lab_h": p.lab_h, "lead_channel": "click", "cadence_h": 24, "medium": 0.05}
    (tmp_path / "p.json").write_text(json.dumps(settings))
    for command in ("report", "detect"):
        assert main([command, "--warehouse", f"file://{tmp_path}/w", "--profile", str(tmp_path / "p.json"), "--warmup", "576", "--patients", "10"], spark) == 0
    said = capsys.readouterr().out
    assert "study_window" in said and "MEDIUM" in said
    back = spark.read.csv(f"file://{tmp_path}/w/results/signals", header=True)
    assert back.columns[:4] == ["signal_id", "patient_id", "decision_time", "risk"] and "model_version" in back.columns and back.count() > 0


def test_a_cohort_is_the_first_patients(spark):
    clean = serve.cohort(queries._clean(spark, SF), 3)
    assert sorted(r.patient_id for r in clean.observations.select("patient_id").distinct().collect()) == ["U0", "U1", "U10"]
