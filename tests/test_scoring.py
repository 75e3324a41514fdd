"""Scores on synthetic courses: early detection, and what must not raise an alarm."""

import random
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tideline.config import Channel, Profile, profile_of, variants
from tideline.operators import asof, channels, events
from tideline.plans.sweep import Clean, decide, evidence

CLINICAL = Profile(
    channels=(Channel("HR", 1, 1.0, 2.82, 20), Channel("RR", 1, 1.0, 0.70, 20), Channel("TEMP", 1, 1.0, 0.12, 60), Channel("SpO2", -1, 1.0, 0.34, 20), Channel("SBP", -1, 0.5, 2.36, 120), Channel("DBP", -1, 0.5, 1.63, 120)),
    labs=(("LAB_A", 1.0, 2.0),),
)
REST = {"HR": (75, 3.0), "RR": (16, 0.8), "TEMP": (36.8, 0.12), "SpO2": (97, 0.4), "SBP": (120, 2.5), "DBP": (75, 1.7)}
OBSERVATION = "source_file string, record_id string, patient_id string, variable_code string, event_time timestamp_ntz, available_time timestamp_ntz, value_num double, value_text string, is_plausible boolean, is_duplicate boolean, is_availability_known boolean"
INTERVAL = "record_id string, patient_id string, kind string, subtype string, value_text string, start_time timestamp_ntz, end_time timestamp_ntz, available_time timestamp_ntz"
T = datetime(2026, 1, 4, 12)


def course(patient, change=lambda code, at: 0.0, seed=1, lag=0, codes=tuple(REST)):
    rows = []
    for c in CLINICAL.channels:
        if c.code not in codes:
            continue
        rng = random.Random(seed * 1_000_003 + zlib.crc32(c.code.encode()))
        at, i = T - timedelta(hours=60), 0
        while at <= T + timedelta(hours=2):
            mean, noise = REST[c.code]
            value = mean + rng.gauss(0, noise) + change(c.code, at) * noise * c.direction
            rows.append(("monitor", f"{patient}-{c.code}-{i}", patient, c.code, at, at + timedelta(minutes=lag), value, None, True, False, True))
            at, i = at + timedelta(minutes=c.nominal_min), i + 1
    return rows


def outcomes(spark, courses, intervals=(), at=(T,), profile=CLINICAL):
    observations = spark.createDataFrame([r for c in courses for r in c], OBSERVATION)
    instants = spark.createDataFrame([(p, t) for p in {r[2] for c in courses for r in c} for t in at], "patient_id string, t timestamp_ntz")
    s = decide(Clean(observations, spark.createDataFrame(list(intervals), INTERVAL)), instants, profile)
    return {(r.patient_id, r.t): r for r in s.assessments.collect()}, s


def test_courses(spark):
    rise = lambda code, at: max(0.0, min(1.0, (at - (T - timedelta(hours=4))) / timedelta(hours=4))) * 8
    one = lambda code, at: 12.0 if code == "HR" and at == T else 0.0
    dip = lambda code, at: 15.0 if code == "SpO2" and at == T - timedelta(minutes=60) else 0.0
    four = lambda code, at: 3.0 if code in ("HR", "RR", "TEMP", "SpO2") and at >= T - timedelta(hours=3) else 0.0
    spike = lambda code, at: 9.0 if code == "HR" and at >= T - timedelta(hours=1) else 0.0
    walk = ("i1", "spike", "CONTEXT", "PHYSICAL_ACTIVITY", "HIGH", T - timedelta(hours=2), T + timedelta(hours=1), T - timedelta(hours=2))
    got, _ = outcomes(spark, [course("rise", rise), course("one", one), course("dip", dip), course("four", four), course("spike", spike), *[course(f"flat{i}", seed=i) for i in range(4)]], [walk])
    of = {p: r for (p, _), r in got.items()}
    assert of["rise"].priority == "CRITICAL" and of["rise"].k >= 3 and of["rise"].risk > 0.85
    assert of["one"].priority == of["dip"].priority == "LOW"
    assert of["one"].risk < of["four"].risk
    assert [r["rule"] for r in of["spike"].rules] == ["activity"] and of["spike"].priority == "LOW"
    assert all(of[f"flat{i}"].priority == "LOW" for i in range(4))


def test_rules_and_encounters_are_cited(spark):
    rise = lambda code, at: max(0.0, min(1.0, (at - (T - timedelta(hours=4))) / timedelta(hours=4))) * 8
    odd = lambda at: (T - at) % timedelta(minutes=40) != timedelta(0)
    every_other = lambda code, at: 0.0 if at < T - timedelta(hours=6) else -5.0 if odd(at) else 60.0
    sparse = [r for r in course("sparse", rise, codes=("HR", "RR", "SpO2")) if r[4] < T - timedelta(hours=6) or r[4] >= T - timedelta(minutes=280) and not odd(r[4])]
    stay = [(f"e-{p}", p, "ENCOUNTER", "INPATIENT", None, T - timedelta(hours=60), T + timedelta(hours=9), T - timedelta(hours=60)) for p in ("rise", "walk", "sparse")]
    other = [
        ("w", "walk", "CONTEXT", "PHYSICAL_ACTIVITY", "HIGH", T - timedelta(hours=2), T, T - timedelta(hours=2)),
        ("cut", "sparse", "CONNECTIVITY", "LINK_LOSS", None, T - timedelta(hours=3), T - timedelta(hours=1), T - timedelta(hours=3)),
        ("old", "sparse", "CONNECTIVITY", "LINK_LOSS", None, T - timedelta(hours=30), T - timedelta(hours=20), T - timedelta(hours=30)),
        ("late", "sparse", "CONNECTIVITY", "LINK_LOSS", None, T - timedelta(hours=2), T, T + timedelta(hours=1)),
        ("unasked", "rise", "CONNECTIVITY", "LINK_LOSS", None, T - timedelta(hours=2), T, T - timedelta(hours=2)),
    ]
    courses = [course("rise", rise), course("walk", rise), course("blip", every_other, codes=("HR", "RR", "SpO2")), sparse]
    got, s = outcomes(spark, courses, stay + other)
    observations = spark.createDataFrame([r for c in courses for r in c], OBSERVATION)
    rows = evidence(s, Clean(observations, spark.createDataFrame(stay + other, INTERVAL))).collect()
    cited = lambda p, role, file: {r.record_id for r in rows if (r.patient_id, r.role, r.source_file) == (p, role, file)}
    rules = {p: [x["rule"] for x in r.rules] for (p, _), r in got.items()}
    assert rules["rise"] == [] and rules["walk"] == ["activity_considered"] and rules["blip"] == ["transient"] and rules["sparse"] == ["coverage"]
    assert cited("rise", "CONTEXT", "intervals") == {"e-rise"} and not cited("rise", "QUALITY", "intervals")
    assert cited("walk", "CONTEXT", "intervals") == {"w"}
    assert cited("blip", "QUALITY", "monitor") == cited("blip", "PRIMARY", "monitor") != set() and not cited("blip", "CONTEXT", "intervals")
    assert cited("sparse", "QUALITY", "intervals") == {"cut"} and cited("sparse", "CONTEXT", "intervals") == {"e-sparse"}
    assert max(r.n for r in rows) <= CLINICAL.citations


def test_nothing_that_was_not_known_counts(spark):
    rise = lambda code, at: max(0.0, min(1.0, (at - (T - timedelta(hours=4))) / timedelta(hours=4))) * 8
    rows = course("p", rise, lag=45)
    seen = [r for r in rows if r[5] <= T]
    a, _ = outcomes(spark, [rows])
    b, _ = outcomes(spark, [seen])
    assert a == b and a


def test_the_grid_sees_what_instants_see(spark):
    rows = spark.createDataFrame(course("p", lag=30) + course("q", seed=2), OBSERVATION)
    span = asof.encounters(rows)
    grid = asof.decision_grid(span, CLINICAL)
    a = asof.on_grid(rows, span, CLINICAL, 54).select("patient_id", "t", "record_id")
    b = asof.at_instants(rows, grid, 54).select("patient_id", "t", "record_id")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.count() > 1000


def test_no_grid_before_the_warmup_is_over(spark):
    span = spark.createDataFrame([("p", T, T + timedelta(hours=53)), ("q", T, T + timedelta(hours=54))], "patient_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    assert [(r.patient_id, r.t) for r in asof.decision_grid(span, CLINICAL).collect()] == [("q", T + timedelta(hours=54))]


def test_both_windows_are_closed(spark):
    border = T - timedelta(hours=6)
    rows = [("m", str(i), "p", "HR", at, at, 70.0, None, True, False, True) for i, at in enumerate([border, T, border - timedelta(hours=48), border - timedelta(hours=48, minutes=1)])]
    instants = spark.createDataFrame([("p", T)], "patient_id string, t timestamp_ntz")
    w = channels.windows(asof.at_instants(spark.createDataFrame(rows, OBSERVATION), instants, 60), CLINICAL).first()
    assert len(w.evidence) == 2 and len(w.baseline) == 2


def brute_fold(steps, p):
    band, last, risk, out = 0, None, 0.0, []
    for t, b, r, raw, noted, raw_band in sorted(steps):
        rested = last is not None and t - last >= timedelta(hours=p.refractory_h)
        if b >= p.floor_band:
            emit = b > band or (b == band and rested and r - risk >= p.re_emit)
            nxt = max(band, b)
        else:
            emit = noted and raw > 0 and raw_band > b and raw_band >= p.floor_band and (last is None or rested)
            nxt = b
        if emit:
            out.append((t, b < p.floor_band))
            last, risk = t, r
        band = nxt
    return out


def test_the_fold_matches_a_plain_loop(spark):
    rng, rows, want = random.Random(3), [], {}
    band = lambda x: 3 if x >= 0.85 else 2 if x >= 0.65 else 1 if x >= 0.4 else 0
    for p in range(80):
        steps = []
        for i in range(40):
            raw = rng.choice([0.0, rng.uniform(0, 40)])
            kept = rng.choice([1.0, 0.1])
            risk = round(1 - 2.718281828459045 ** (-raw * kept / 12), 9)
            raw_risk = 1 - 2.718281828459045 ** (-raw / 12)
            t = T + timedelta(hours=3 * i)
            rows.append((str(p), t, band(risk), risk, raw, [("r", 1.0 - kept)] if kept < 1 else []))
            steps.append((t, band(risk), risk, raw, kept < 1, band(raw_risk)))
        want[str(p)] = brute_fold(steps, CLINICAL)
    df = spark.createDataFrame(rows, "patient_id string, t timestamp_ntz, band int, risk double, raw double, rules array<struct<rule:string,strength:double>>")
    got = {}
    for r in events.eventize(df, CLINICAL).orderBy("t").collect():
        got.setdefault(r.patient_id, []).append((r.t, r.demoted))
    assert got == {p: e for p, e in want.items() if e}


def test_a_suppressed_low_is_emitted_though_the_state_is_high(spark):
    raw = 14.5  # alone it would be HIGH
    rows = [("p", T, 2, 0.7, raw, []), ("p", T + timedelta(hours=13), 0, 0.1, raw, [("activity", 0.7)]), ("p", T + timedelta(hours=14), 0, 0.1, raw, [("activity", 0.7)])]
    df = spark.createDataFrame(rows, "patient_id string, t timestamp_ntz, band int, risk double, raw double, rules array<struct<rule:string,strength:double>>")
    assert [(r.t, r.demoted) for r in events.eventize(df, CLINICAL).orderBy("t").collect()] == [(T, False), (T + timedelta(hours=13), True)]


def test_index_percentile(spark):
    values = [random.Random(4).random() for _ in range(101)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for share in (0.0, 0.5, 0.9, 0.999):
        assert events.percentile_by_index(df, "v", share).first().v == sorted(values)[min(100, int(101 * share))]
    tied = spark.createDataFrame([(v,) for v in [1.0] * 60 + [2.0] * 30 + [3.0] * 10 + [None]], "v double")
    assert [events.percentile_by_index(tied, "v", share).first().v for share in (0.0, 0.59, 0.6, 0.89, 0.9, 1.0)] == [1.0, 1.0, 2.0, 2.0, 3.0, 3.0]
    assert events.percentile_by_index(df.limit(0), "v", 0.5).first().v is None


def test_profiles_from_settings():
    p = profile_of({"channels": [{"code": "HR", "direction": 1, "weight": 1.0, "floor": 2.0, "nominal_min": 20}], "evidence_h": 12, "high": [0.6, 2]})
    assert p.evidence_h == 12 and p.high == (0.6, 2) and p.streak_goal(p.channels[0]) == 3
    with pytest.raises(ValueError):
        profile_of({"channels": [], "surprise": 1})
    assert [n for n, _ in variants(p)][-1] == "4_suppression" and variants(p)[-1][1] is p


def test_nearest_is_the_nearest(spark):
    rng = random.Random(5)
    mk = lambda n, code: [("m", f"{code}{i}", f"p{rng.randrange(3)}", code, T + timedelta(minutes=rng.randrange(3000)), T, float(i), None, True, False, True) for i in range(n)]
    a, b = mk(60, "A"), mk(60, "B")
    got = {r.record_id: (r.other_id, r.away) for r in asof.nearest(spark.createDataFrame(a, OBSERVATION), spark.createDataFrame(b, OBSERVATION), 30).collect()}
    want = {}
    for x in a:
        near = min(((abs((x[4] - y[4]).total_seconds()), y[4], y[1]) for y in b if y[2] == x[2]), default=None)
        if near and near[0] <= 1800:
            want[x[1]] = (near[2], int(near[0] * 1e6))
    assert got == want


def test_streak_and_ceiling_variants(spark):
    rows = [course("p", lambda code, at: 40.0 if at >= T - timedelta(hours=3) else 0.0)]
    plain, _ = outcomes(spark, rows, profile=variants(CLINICAL)[0][1])
    full, s = outcomes(spark, rows)
    assert plain["p", T].weighted > full["p", T].weighted
    assert s.channels.agg(F.max("score")).first()[0] <= CLINICAL.ceiling
