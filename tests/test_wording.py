"""Wording as columns against the plain functions, decision by decision."""

from datetime import timedelta

from pyspark.sql import functions as F
from test_scoring import CLINICAL, T, course, outcomes
from tideline.plans import narrative, wording


def test_columns_say_what_the_plain_functions_say(spark):
    rise = lambda code, at: max(0.0, min(1.0, (at - (T - timedelta(hours=4))) / timedelta(hours=4))) * 8
    one = lambda code, at: 9.0 if code == "HR" and at >= T - timedelta(hours=1) else 0.0
    walk = [("i1", "one", "CONTEXT", "PHYSICAL_ACTIVITY", "HIGH", T - timedelta(hours=2), T + timedelta(hours=1), T - timedelta(hours=2))]
    _, s = outcomes(spark, [course("rise", rise), course("one", one), course("flat", seed=9)], walk, at=(T, T - timedelta(hours=2)))
    units = {"HR": "/min"}
    rows = wording.worded(s.assessments, units).cache()
    assert rows.count() == 6
    for r in rows.collect():
        channels, rules = [c.asDict(True) for c in r.channels], [x.rule for x in r.rules]
        found = narrative.findings(channels, units=units)
        assert [f.asDict() for f in r.findings] == found and r.allowed == narrative.allowed_refs(found)
        assert {"summary": r.summary, "review": r.review, "refs": r.refs} == narrative.fallback(r.k, found, r.lab_n, rules)
    texts = {
        "rise": [("The course changes.", [], []), ("SpO2 moves.", ["Look."], ["allowed"]), ("Risk 9.", [], []), ("A Diagnosis.", [], []), ("x", [], ["9"]), (None, [], []), ("x", [], ["many"]), ("ok", None, None)],
        "flat": [("Calm.", [], [])],
    }
    for p, some in texts.items():
        row = rows.where((F.col("patient_id") == p) & (F.col("t") == F.lit(T)))
        allowed = row.first().allowed
        for summary, review, refs in some:
            refs = allowed[:2] if refs == ["allowed"] else allowed[:7] if refs == ["many"] else refs
            df = spark.createDataFrame([(p, T, summary, review, refs)], "patient_id string, t timestamp_ntz, summary string, review array<string>, refs array<string>")
            r = wording.checked(row, df).first()
            try:
                want = narrative.check({"summary": summary or (_ for _ in ()).throw(narrative.NarrativeError()), "review": review or [], "refs": refs or []}, allowed)
                assert (r.source, r.fault, r.summary, r.review, r.refs) == ("generated", None, want["summary"], want["review"], want["refs"])
            except narrative.NarrativeError:
                assert r.source == "plain" and r.fault and r.summary == row.first().summary
    assert wording.checked(rows, df.limit(0)).where("source = 'plain' and fault is null").count() == 6


def test_histories_are_worded(spark):
    rows = spark.createDataFrame([(("LOW",), ("HIGH",), [("a",), ("b",)]), (("LOW",), ("LOW",), None)], "current struct<priority:string>, peak struct<priority:string>, transitions array<struct<priority:string>>")
    got = [(r.summary, r.review) for r in wording.history_worded(rows).collect()]
    want = [narrative.history_fallback("LOW", "HIGH", 2), narrative.history_fallback("LOW", "LOW", 0)]
    assert got == [(w["summary"], w["review"]) for w in want]
