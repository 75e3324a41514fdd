"""Structures that hold at size: sorted stretches, selection, levels of cells, courses of the fold, block maxima; each against a plain loop."""

import random
import statistics
import time
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_scoring import CLINICAL, OBSERVATION, T, brute_fold, course
from tideline import queries
from tideline.config import Channel
from tideline.functions.scalars import deviation_sql, seconds
from tideline.operators import asof, channels, events, quality, ranges, slopes
from tideline.plans import audit, sweep
from tideline.sources.stored import scope


def test_windows_of_a_stretch_are_those_of_its_instants(spark):
    rows = [(*r[:8], i % 11 != 0, False, True) for i, r in enumerate(course("p", lag=30) + course("q", seed=2, lag=200) + [r for r in course("r", seed=3) if r[4].hour % 5 and r[6]])]
    df = spark.createDataFrame(rows, OBSERVATION)
    span = asof.encounters(df)
    early = replace(CLINICAL, warmup_h=1)  # so that the grid has more than one stretch
    dealt = asof.dealt(df, span, early, 54)
    assert dealt.groupBy("record_id").count().agg(F.max("count")).first()[0] == 2 and dealt.count() <= 2 * df.count()
    columns = ["patient_id", "t", "variable_code", "evidence.record_id", "evidence.value", "baseline", "bad"]
    got = channels.grid_windows(dealt, early, 54).where("size(evidence) + size(baseline) + bad > 0").select(*columns)
    want = channels.windows(asof.on_grid(df, span, early, 54), early).where("size(evidence) + size(baseline) + bad > 0").select(*columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() > 50


def test_deviations_without_sorting(spark):
    rng = random.Random(1)
    arrays = [sorted(round(rng.gauss(0, 3), rng.choice([0, 3])) for _ in range(n)) for n in range(0, 25) for _ in range(3)]
    df = spark.createDataFrame([(a, rng.uniform(-1, 1)) for a in arrays], "a array<double>, c double")
    for r in df.select("a", "c", F.expr(deviation_sql("a", "c")).alias("d")).collect():
        assert r.d == (statistics.median(abs(x - r.c) for x in r.a) if r.a else None)


def _all_pairs(h, z):
    i, j = np.triu_indices(len(h), 1)
    apart = h[i] != h[j]
    return float(np.median((z[j] - z[i])[apart] / (h[j] - h[i])[apart])) if apart.any() else 0.0


def test_median_slopes_equal_all_pairs(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(slopes, "_LISTED", 64)
    monkeypatch.setattr(slopes, "_DRAWN", 64)
    for k in range(3000):
        n = int(rng.integers(0, 50))
        h = np.sort(rng.integers(0, (5, 1000, 30, 3)[k % 4], n)) / (1, 60, 3, 1)[k % 4]  # many equal times
        z = rng.integers(-3, 4, n).astype(float) if k % 3 == 0 else 2.0 * h if k % 7 == 0 else rng.normal(size=n)
        assert slopes.median_slope(h, z) == pytest.approx(_all_pairs(h, z), abs=1e-12)


def test_a_long_window_takes_seconds():
    rng = np.random.default_rng(1)
    h = np.arange(21_600) / 3600
    start = time.time()
    assert slopes.median_slope(h, 0.3 * h + rng.normal(size=len(h)).round(1)) == pytest.approx(0.3, abs=0.05)
    assert slopes.median_slope(h, np.zeros(len(h))) == 0.0 and time.time() - start < 20


def test_dense_channels_select_what_sparse_ones_list(spark):
    rng = random.Random(2)
    series = [[(i / 7, rng.gauss(0, 1)) for i in range(rng.choice([3, 5, 30, 90]))] for _ in range(40)]
    df = spark.createDataFrame([("HR", [h for h, _ in s], [z for _, z in s], len(s)) for s in series], "variable_code string, hours array<double>, z array<double>, n_evidence int")
    dense = replace(CLINICAL, channels=(Channel("HR", 1, 1.0, 2.82, 1),))
    assert dense.expected(dense.channels[0], dense.evidence_h) > channels.LISTED_SAMPLES
    values = lambda p: sorted(r.slope for r in channels.with_slope(df, p).collect())
    assert values(dense) == pytest.approx(values(CLINICAL))
    assert "MapInArrow" in channels.with_slope(df, dense)._jdf.queryExecution().toString() and "MapInArrow" not in channels.with_slope(df, CLINICAL)._jdf.queryExecution().toString()


def test_long_and_endless_stretches_meet(spark):
    rng = random.Random(3)
    at = lambda h: T + timedelta(hours=h)
    rows = [(rng.choice("pqr"), i, at(a := rng.uniform(0, 4000)), rng.choice([at(a), at(a + 5), at(a + 900), at(a + 20_000), None])) for i in range(150)]
    points = [(rng.choice("pqr"), i, at(a := rng.uniform(0, 6000)), at(a + rng.choice([0, 0, 40, 3000]))) for i in range(120)]
    left = spark.createDataFrame(rows, "patient_id string, a int, lo timestamp_ntz, hi timestamp_ntz")
    for since in (None, "since"):
        met = asof.meeting(left, F.col("lo"), F.col("hi"), spark.createDataFrame(points, "patient_id string, b int, since timestamp_ntz, t timestamp_ntz"), 2, since=since)
        got = [(r.a, r.b) for r in met.collect()]
        want = {(a, b) for p, a, lo, hi in rows for q, b, s, t in points if p == q and lo <= t and (hi is None or hi >= (s if since else t))}
        assert len(got) == len(set(got)) and set(got) == want and set(met.columns) == {"patient_id", "a", "lo", "hi", "b", "since", "t"}


def _assessments(n, seed):
    rng, state, steps = random.Random(seed), 0.1, []
    band = lambda x: 3 if x >= 0.85 else 2 if x >= 0.65 else 1 if x >= 0.4 else 0
    for i in range(n):
        state = min(0.95, max(0.0, state + rng.gauss(0, 0.15)))
        raw = -12 * np.log(1 - state)
        kept = rng.choice([1.0, 1.0, 0.1])
        steps.append((T + timedelta(hours=i), band(risk := round(float(1 - np.exp(-raw * kept / 12)), 9)), risk, float(raw), kept < 1, band(float(1 - np.exp(-raw / 12)))))
    return steps


def test_courses_and_blocks_fold_as_a_plain_loop(spark):
    steps = {"long": _assessments(3000, 1), "short": _assessments(40, 2), "one": _assessments(1, 3)}
    rows = [(p, t, b, r, raw, [("r", 0.9)] if noted else []) for p, s in steps.items() for t, b, r, raw, noted, _ in s]
    df = spark.createDataFrame(rows, "patient_id string, t timestamp_ntz, band int, risk double, raw double, rules array<struct<rule:string,strength:double>>")
    want = {p: e for p, s in steps.items() if (e := brute_fold(s, CLINICAL))}
    assert len(want["long"]) > 100
    for block_h in (None, 100):
        got = {}
        for r in events.eventize(df, CLINICAL, block_h).orderBy("t").collect():
            got.setdefault(r.patient_id, []).append((r.t, r.demoted))
        assert got == want
    blocks = events._courses_in_blocks(df.withColumn("noted", F.lit(False)), CLINICAL, 100)
    assert blocks.where("patient_id = 'long'").select(F.spark_partition_id()).distinct().count() > 1


def test_peaks_after_signals(spark):
    rng = random.Random(5)
    at = lambda h: T + timedelta(hours=h)
    obs = [("m", str(i), rng.choice("pq"), rng.choice(["HR", "SpO2"]), at(h := rng.randrange(200)), at(h), float(rng.randrange(9)), None, rng.random() > 0.1, rng.random() < 0.1, True) for i in range(600)]
    sent = [(f"s{i}", rng.choice("pqz"), at(rng.randrange(-30, 220)), rng.choice(["HR", "SpO2"])) for i in range(80)]
    signals = spark.createDataFrame([s[:3] for s in sent], "signal_id string, patient_id string, decision_time timestamp_ntz")
    cited = spark.createDataFrame([(s[0], "PRIMARY", s[3]) for s in sent], "signal_id string, role string, variable_code string")
    got = {r.signal_id: r.hours for r in audit.anticipation(signals, cited, spark.createDataFrame(obs, OBSERVATION), {"HR": 1, "SpO2": -1}, 24).collect()}
    want = {}
    for s, p, t, code in sent:
        after = [(o[6] * (1 if code == "HR" else -1), -o[4].timestamp(), o[4]) for o in obs if o[2] == p and o[3] == code and o[8] and not o[9] and t < o[4] <= t + timedelta(hours=24)]
        if after:
            want[s] = (max(after)[2] - t).total_seconds() / 3600
    assert got == want and len(want) > 40


def test_quantiles_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None)], "k string, v double")
    assert {(r.k, r["count"], r.q0) for r in ranges.quantiles(df, ("k",), "v", (0.5,), "values").collect()} == {(None, 2, 2.0), ("a", 1, 5.0)}


def test_texts_are_parsed_once_for_rows_that_load(spark):
    iv = spark.createDataFrame([("i", "p", "CONTEXT", "x", "LOW", "2024-01-01 00:00:00", "2024-01-01 06:00:00", None), ("j", "p", "CONTEXT", "x", "LOW", "soon", "2024-01-01 06:00:00", None)], "record_id string, patient_id string, kind string, subtype string, value_text string, start_time string, end_time string, delayed_records string")
    facts = spark.createDataFrame([("f", "r", "p", "c", None, "2024-01-01 00:00:00", "A", None, "E"), ("f", "s", "p", "c", None, "unknown", "A", None, "E")], "source_file string, record_id string, patient_id string, category string, onset string, available_time string, status string, severity string, source_system string")
    for rows, times, one in ((quality.valid_intervals(iv), 2, "i"), (quality.valid_facts(facts), 1, "r")):
        loaded = rows.where("reject_reason is null")
        plan = loaded.select("record_id", *[c for c in loaded.columns if c.endswith("_time")], "reject_reason")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE") == times and [r.record_id for r in loaded.collect()] == [one]


def test_heavy_steps_keep_the_parts_they_are_dealt_to(spark):
    df = spark.createDataFrame([(*r[:8], True, False, True) for r in course("p", lag=30)], OBSERVATION)
    assert asof.dealt(df, asof.encounters(df), replace(CLINICAL, warmup_h=1), 54).rdd.getNumPartitions() == 4
    bare = df.drop("is_duplicate").withColumn("is_retransmit", F.lit(False))
    assert quality.mark_duplicates(bare).rdd.getNumPartitions() == 4


def test_answers_without_evidence_work_none_out(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("no answer reads it")

    monkeypatch.setattr(sweep, "evidence", refuse)
    sf = "/root/testdata/sf0.001"
    assert queries.QUERIES["service_health"](spark, sf).count() == 3 and queries.QUERIES["service_signals"](spark, sf).count() >= 0


def test_instants_of_a_row_are_worked_out_once(spark):
    df = spark.createDataFrame(course("p"), OBSERVATION)
    plan = asof.dealt(df, asof.encounters(df), CLINICAL, 54)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("timestampdiff(") == 3  # to a row's event and availability, and to the end of its patient's grid


def test_seconds_of_a_time_without_zone_are_the_same_in_every_zone(spark):
    times = ["2024-03-10 02:30:00", "2024-03-10 03:30:00", "2024-11-03 01:30:00", "1950-06-01 00:00:01"]
    want = [int((datetime.fromisoformat(t) - datetime(1970, 1, 1)).total_seconds()) for t in times]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Europe/Madrid"):  # where half past two is skipped, or comes twice
            spark.conf.set("spark.sql.session.timeZone", name)
            got = spark.createDataFrame([(t,) for t in times], "t string").select(seconds(F.col("t").cast("timestamp_ntz")).alias("s")).collect()
            assert [r.s for r in got] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_stretch_far_from_the_border_gives_whole_windows(spark):
    """Samples at the very borders of both windows, with fractions of a second, and one that is known late."""
    p = replace(CLINICAL, warmup_h=1)
    start = T - timedelta(hours=100)
    at = [start, start + timedelta(hours=1), start + timedelta(hours=7), start + timedelta(hours=7, microseconds=1), start + timedelta(hours=55), start + timedelta(hours=60, microseconds=-1), T]
    rows = [(*r[:4], t, t + timedelta(hours=5 * (i == 3)), *r[6:]) for i, (r, t) in enumerate(zip(course("p"), at, strict=False))]
    df = spark.createDataFrame([(*r[:8], i != 2, False, True) for i, r in enumerate(rows)], OBSERVATION)
    span = asof.encounters(df)
    columns = ["t", "variable_code", "evidence", "baseline", "bad"]
    told = lambda w: sorted(map(repr, w.where("size(evidence) + size(baseline) + bad > 0").select(*columns).collect()))
    assert told(channels.grid_windows(asof.dealt(df, span, p, 54), p, 54)) == told(channels.windows(asof.on_grid(df, span, p, 54), p))


def test_columns_that_a_query_does_not_read_are_not_written(spark):
    with scope():
        whole, part = (queries._clean(spark, "/root/testdata/sf0.001", *w).observations for w in ((), (queries.UNREAD,)))
        assert set(whole.columns) - set(part.columns) == set(queries.UNREAD) and sorted(part.collect()) == sorted(whole.select(*part.columns).collect())
