"""The registry of rules: a rule that nothing else knows shows in scores, priorities, explanations and evidence."""

from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_scoring import CLINICAL, INTERVAL, OBSERVATION, T, course
from tideline.functions.scalars import text
from tideline.operators import assess, citations, rules
from tideline.plans.sweep import Clean, decide, evidence, signals


def rise(code, at):
    return max(0.0, min(1.0, (at - (T - timedelta(hours=4))) / timedelta(hours=4))) * 8


@pytest.fixture
def medication():
    given = lambda seen: rules.overlapping(seen.intervals, seen.instants, seen.profile, "MEDICATION")
    rule = rules.Rule(
        "medication",
        (
            rules.Outcome("medication", lambda p: F.col("doses") >= 2, lambda p: text(F.col("doses").cast("string"), " doses in the window"), lambda p: 0.5, limits=True),
            rules.Outcome("medication_noted", lambda p: F.col("doses") > 0, lambda p: F.lit("one dose in the window")),
        ),
        given,
        {"doses": (lambda: F.count("*"), 0)},
        lambda seen, instants: citations.plain(given(replace(seen, instants=instants)), "CONTEXT", "intervals", "start_time"),
    )
    yield rules.register(rule)
    rules.unregister("medication")


def test_a_fifth_rule_shows_everywhere(spark, medication):
    dose = lambda p, n, h: (f"{p}-dose{n}", p, "MEDICATION", "DOSE", None, T - timedelta(hours=h), T - timedelta(hours=h), T - timedelta(hours=h))
    courses = [course(p, rise) for p in ("none", "one", "two")]
    observations = spark.createDataFrame([r for c in courses for r in c], OBSERVATION)
    clean = Clean(observations, spark.createDataFrame([dose("one", 1, 1), dose("two", 1, 1), dose("two", 2, 2), dose("two", 3, 20)], INTERVAL))
    instants = spark.createDataFrame([(p, T) for p in ("none", "one", "two")], "patient_id string, t timestamp_ntz")
    p = replace(CLINICAL, rules=(*CLINICAL.rules, "medication"))
    s = decide(clean, instants, p)
    got = {r.patient_id: r for r in s.assessments.select("*", assess.explanation(p).alias("said")).collect()}
    assert {k: [(x["rule"], x["strength"]) for x in r.rules] for k, r in got.items()} == {"none": [], "one": [("medication_noted", 0.0)], "two": [("medication", 0.5)]}
    assert got["one"].final == got["one"].raw and got["two"].final == got["two"].raw * 0.5 and got["none"].priority == got["one"].priority == "CRITICAL" != got["two"].priority
    assert "rule medication, score reduced by 50%: 2 doses in the window" in got["two"].said and "score kept: one dose" in got["one"].said
    assert {r.patient_id: r.suppressions for r in signals(s).collect()} == {"none": "", "one": "medication_noted", "two": "medication"}
    cited = {(r.patient_id, r.record_id) for r in evidence(s, clean).where("role = 'CONTEXT'").collect()}
    assert cited == {("one", "one-dose1"), ("two", "two-dose1"), ("two", "two-dose2")}
    plain = {r.patient_id: r for r in decide(clean, instants, CLINICAL).assessments.collect()}
    assert all(r.rules == [] and r.priority == "CRITICAL" for r in plain.values())
    off = decide(clean, instants, replace(p, rules_on=False)).assessments.collect()
    assert all(r.rules == [] for r in off)


def test_names_are_given_once(medication):
    with pytest.raises(ValueError):
        rules.register(replace(medication, outcomes=()))
    with pytest.raises(ValueError):
        rules.register(rules.Rule("other", (rules.Outcome("activity", lambda p: F.lit(True), lambda p: F.lit("")),)))
    with pytest.raises(ValueError):
        rules.of(replace(CLINICAL, rules=("unheard",)))
