"""Live decisions and histories where nothing can be judged, beyond the encounter, and with hostile texts."""

from datetime import timedelta

import pytest
from test_scoring import CLINICAL, INTERVAL, OBSERVATION, T, course
from tideline.plans import serve
from tideline.plans.sweep import Clean


@pytest.fixture(scope="module")
def service(spark):
    rise = lambda code, at: max(0.0, min(1.0, (at - (T - timedelta(hours=4))) / timedelta(hours=4))) * 8
    rows = course("p", rise) + [(*r[:9], True, True) for r in course("new", codes=("HR",)) if r[4] >= T][:2] + [r for r in course("new", codes=("HR",)) if r[4] >= T]
    walk = [("w", "new", "CONTEXT", "PHYSICAL_ACTIVITY", "HIGH", T, T + timedelta(hours=1), T)]
    facts = spark.createDataFrame([("history.csv", "f1", "p", T - timedelta(days=9))], "source_file string, record_id string, patient_id string, available_time timestamp_ntz")
    clean = Clean(spark.createDataFrame(rows, OBSERVATION).cache(), spark.createDataFrame(walk, INTERVAL), facts)
    nothing = spark.createDataFrame([], "signal_id string, patient_id string")
    return serve.Service(clean, nothing, nothing, CLINICAL)


def test_a_decision_without_a_baseline(spark, service):
    rows = service.decide("new", str(T + timedelta(hours=1))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.k, r.risk, r.confidence, r.priority, r.channels, r.lab_n) == (0, 0.0, 0.0, "LOW", [], 0)
    assert [x["rule"] for x in r.rules] == ["activity_considered"] and r.visible == 4 and len(r.set_aside) == 2 and r.within_encounter and "no deviation" in r.explanation
    assert service.narrative("new", str(T + timedelta(hours=1)))["source"] == "plain"
    before = service.decide("p", "2020-01-01 00:00:00").first()
    assert (before.visible, before.risk, before.within_encounter) == (0, 0.0, False)
    assert service.decide("p", str(T)).first().priority == "CRITICAL"


def test_histories(spark, service):
    whole = service.history("p", cadence_min=360).first()
    assert whole.history_mode == "complete" and whole.last_t == T + timedelta(hours=2) and whole.asked == 12 and whole.peak.t <= whole.last_t
    until = service.history("p", end=str(T), cadence_min=360).first()
    assert until.history_mode == "until" and until.current.t == T and until.current.priority == "CRITICAL" and until.skipped > 0
    none = service.history("new", cadence_min=60).first()
    assert none.evaluable is None and none.current.t == none.peak.t == none.last_t and none.current.priority == none.peak.priority == "LOW" and none.trajectory is None
    for start, end in ((None, str(T + timedelta(hours=3))), (None, "2020-01-01 00:00:00"), (str(T), str(T - timedelta(hours=1)))):
        with pytest.raises(ValueError):
            service.history("p", start, end)
    with pytest.raises(serve.NotFound):
        service.history("nobody")


def test_texts_of_callers_are_no_sql(service):
    with pytest.raises(Exception, match="CAST|cast|timestamp"):
        service.decide("p", "2026-01-01' or '1'='1").collect()


def test_sources_are_named(service):
    assert {r.source_file for r in service.loaded_sources().collect()} == {"monitor", "intervals", "history.csv"}
