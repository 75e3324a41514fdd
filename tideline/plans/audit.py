"""Constraints and audits as queries that should give no rows, and the metrics of a finished run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.config import BANDS
from tideline.functions.scalars import blank_to_null, parse_number, parse_time, seconds
from tideline.operators.asof import meeting
from tideline.operators.ranges import running

ROLES = ("PRIMARY", "SUPPORTING", "CONTEXT", "QUALITY")


class ViolationError(ValueError):
    """Raised before a write whose rows break a rule."""


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, ...): a row for each rule that a row of ``df`` breaks; a rule that is null is broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull())
    return df.withColumn("rule", F.explode(broken))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def require_none(df: DataFrame, what: str) -> None:
    if found := df.limit(5).collect():
        raise ViolationError(f"{what}: {found}")


def observation_rules() -> dict[str, Column]:
    return {"record_id": F.col("record_id").isNotNull(), "patient_id": F.col("patient_id").isNotNull(), "time_order": F.col("available_time") >= F.col("event_time"), "value": F.col("value_num").isNotNull() | F.col("value_text").isNotNull()}


def signal_rules() -> dict[str, Column]:
    unit = lambda c: F.col(c).between(0, 1)
    return {"signal_id": F.col("signal_id").isNotNull(), "priority": F.col("priority").isin(*BANDS), "risk": unit("risk"), "confidence": unit("confidence"), "window": F.col("evidence_start") <= F.col("evidence_end"), "decision": F.col("evidence_end") <= F.col("decision_time"), "explanation": F.length(F.trim("explanation")) > 0, "model_version": F.length(F.trim("model_version")) > 0}


def evidence_rules() -> dict[str, Column]:
    filled = lambda c: F.col(c).isNotNull()
    return {"signal_id": filled("signal_id"), "source_file": filled("source_file"), "record_id": filled("record_id"), "event_time": filled("event_time"), "available_time": filled("available_time"), "role": F.col("role").isin(*ROLES)}


def interval_rules() -> dict[str, Column]:
    return {"record_id": F.col("record_id").isNotNull(), "patient_id": F.col("patient_id").isNotNull(), "kind": F.col("kind").isin("CONTEXT", "CONNECTIVITY", "MEDICATION", "ENCOUNTER"), "time_order": F.col("end_time") >= F.col("start_time"), "available_time": F.col("available_time").isNotNull()}


def fact_rules() -> dict[str, Column]:
    return {"record_id": F.col("record_id").isNotNull(), "patient_id": F.col("patient_id").isNotNull(), "available_time": F.col("available_time").isNotNull()}


def quarantine_rules() -> dict[str, Column]:
    return {"reject_reason": F.col("reject_reason").isin("NO_RECORD_ID", "NO_PATIENT", "BAD_EVENT_TIME", "BAD_AVAILABLE_TIME", "TIME_ORDER", "UNIT_UNKNOWN", "NO_VALUE")}


def manifest_rules() -> dict[str, Column]:
    return {"run_id": F.col("run_id").isNotNull(), "source_file": F.col("source_file").isNotNull(), "sha256": F.col("sha256").isNotNull(), "ingested_at": F.col("ingested_at").isNotNull()}


def outside_encounter(observations: DataFrame, encounters: DataFrame) -> DataFrame:
    """Observations in none of their patient's ``encounters(patient_id, start_time, end_time)``; the two meet by cells of time."""
    key = ["source_file", "record_id", "variable_code"]
    spans = encounters.select("patient_id", F.col("start_time").alias("from_time"), F.col("end_time").alias("to_time"))
    inside = meeting(spans, F.col("from_time"), F.col("to_time"), observations.select("patient_id", "event_time", *key), 24, at="event_time").select(*key).distinct()
    return observations.join(inside, key, "left_anti")


def late_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence that nobody could know at the decision."""
    return evidence.where("available_time > t")


def orphans(signals: DataFrame, evidence: DataFrame) -> DataFrame:
    """(what, id): signals without evidence and evidence without a signal."""
    bare = signals.join(evidence, "signal_id", "left_anti").select(F.lit("signal").alias("what"), "signal_id")
    return bare.unionByName(evidence.join(signals, "signal_id", "left_anti").select(F.lit("evidence").alias("what"), "signal_id"))


def untraceable(evidence: DataFrame, observations: DataFrame, intervals: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Evidence that is neither an observation nor an interval nor a fact."""
    key = ["source_file", "record_id"]
    rows = evidence.join(observations.select(*key), key, "left_anti").join(intervals.select(F.lit("intervals").alias("source_file"), "record_id"), key, "left_anti")
    return rows if facts is None else rows.join(facts.select(*key), key, "left_anti")


#: Priorities and roles are read in any case; blank cells are those of white space alone.
def submitted_signals() -> dict[str, Column]:
    """What a submitted signal must fulfil, all cells being text."""
    time = lambda c: parse_time(F.col(c))
    filled = lambda c: blank_to_null(F.col(c)).isNotNull()
    return {
        "signal_id": filled("signal_id"),
        "patient_id": filled("patient_id"),
        "risk": parse_number(F.col("risk")).between(0, 1),
        "priority": F.upper(F.trim("priority")).isin(*BANDS),
        "confidence": ~filled("confidence") | parse_number(F.col("confidence")).between(0, 1),
        "times": time("evidence_start").isNotNull() & time("evidence_end").isNotNull() & time("decision_time").isNotNull(),
        "time_order": F.coalesce((time("evidence_start") <= time("evidence_end")) & (time("evidence_end") <= time("decision_time")), F.lit(True)),
        "explanation": filled("explanation"),
        "model_version": filled("model_version"),
    }


def submitted_evidence() -> dict[str, Column]:
    """What a submitted row of evidence must fulfil beside its signal's ``decision_time``, all cells being text."""
    filled = lambda c: blank_to_null(F.col(c)).isNotNull()
    return {
        "role": F.upper(F.trim("role")).isin(*ROLES),
        "source_file": filled("source_file"),
        "record_id": filled("record_id"),
        "evidence_times": parse_time(F.col("event_time")).isNotNull() & parse_time(F.col("available_time")).isNotNull(),
        "late_evidence": F.coalesce(parse_time(F.col("available_time")) <= F.col("decided"), F.lit(True)),
        "contribution": ~filled("contribution") | parse_number(F.col("contribution")).isNotNull(),
    }


#: Faults that are told but do not make a submission invalid.
WARNINGS = ("contribution",)
SIGNAL_COLUMNS = ("signal_id", "patient_id", "decision_time", "priority", "risk", "confidence", "evidence_start", "evidence_end", "explanation", "model_version")
EVIDENCE_COLUMNS = ("signal_id", "source_file", "record_id", "event_time", "available_time", "role")


def validate_submission(signals: DataFrame, evidence: DataFrame, patients: DataFrame | None = None) -> DataFrame:
    """(signal_id, rule) of all faults of a submission, keys both ways; no rows where it is sound.

    Missing columns raise.  An id that is given more than once is one fault for each time after the first; a blank id has no evidence to
    miss.  Unknown patients are a fault of each of their signals.
    """
    for name, df, required in (("signals", signals, SIGNAL_COLUMNS), ("evidence", evidence, EVIDENCE_COLUMNS)):
        if missing := set(required) - set(df.columns):
            raise ViolationError(f"columns missing in {name}: {sorted(missing)}")
    cell = lambda df, c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in df.columns else F.lit("")
    s = signals.select(*[cell(signals, c).alias(c) for c in SIGNAL_COLUMNS])
    e = evidence.select(*[cell(evidence, c).alias(c) for c in (*EVIDENCE_COLUMNS, "contribution")])
    ids = s.groupBy("signal_id").agg(F.count("*").alias("n"), F.max(parse_time(F.col("decision_time"))).alias("decided"))
    linked = e.join(ids.select("signal_id", "decided", F.lit(True).alias("known")), "signal_id", "left")
    of = lambda df, rule: df.select("signal_id", F.lit(rule).alias("rule"))
    parts = [
        violations(s, submitted_signals()).select("signal_id", "rule"),
        of(ids.where("signal_id <> '' and n > 1").withColumn("again", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n")))), "repeated_id"),
        violations(linked, submitted_evidence()).select("signal_id", "rule"),
        of(linked.where("known is null"), "no_signal"),
        of(ids.where("signal_id <> ''").join(e, "signal_id", "left_anti"), "no_evidence"),
    ]
    if patients is not None:
        parts.append(of(s.where("patient_id <> ''").join(patients.select("patient_id"), "patient_id", "left_anti"), "unknown_patient"))
    return reduce(DataFrame.unionByName, parts)


MARKERS = ("activity", "recovery", "connectivity", "low_signal", "implausible", "retransmission")


def markers(signals: DataFrame, observations: DataFrame, intervals: DataFrame, cell_h: int = 24) -> DataFrame:
    """Each signal with whether its evidence window meets each of six known distractors, in one pass.

    Marked rows and windows meet by cells of time, so that a patient with most rows is shared out by them.
    """
    of = lambda tests: F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    context = F.col("kind") == "CONTEXT"
    states = {"activity": context & (F.col("subtype") == "PHYSICAL_ACTIVITY") & F.col("value_text").isin("HIGH", "MODERATE"), "recovery": context & (F.col("subtype") == "RECOVERY_PHASE"), "connectivity": F.col("kind") == "CONNECTIVITY"}
    points = {"low_signal": F.col("quality_flag") == "LOW_SIGNAL", "implausible": ~F.col("is_plausible"), "retransmission": F.col("is_duplicate")}
    marked = intervals.select("patient_id", F.col("start_time").alias("lo"), F.col("end_time").alias("hi"), of(states).alias("names"))
    marked = marked.unionByName(observations.select("patient_id", F.col("event_time").alias("lo"), F.col("event_time").alias("hi"), of(points).alias("names"))).where("size(names) > 0")
    met = meeting(marked, F.col("lo"), F.col("hi"), signals.select("signal_id", "patient_id", "evidence_start", "evidence_end"), cell_h, at="evidence_end", since="evidence_start")
    found = met.select("signal_id", F.explode("names").alias("name")).groupBy("signal_id").agg(*[F.bool_or(F.col("name") == n).alias(n) for n in MARKERS])
    return signals.join(found, "signal_id", "left").na.fill(False, list(MARKERS)).withColumn("any_marker", reduce(lambda a, b: a | b, [F.col(n) for n in MARKERS]))


def distractor_impact(marked: DataFrame) -> DataFrame:
    """Of the urgent signals of ``markers``: how many there are, how many meet a marker, and the share that does so without a trace of any rule."""
    urgent, silent = F.col("priority").isin("HIGH", "CRITICAL"), F.col("any_marker") & (F.col("suppressions") == "")
    n = lambda c: F.count_if(urgent & c)
    return marked.agg(n(F.lit(True)).alias("urgent"), n(F.col("any_marker")).alias("marked"), n(silent).alias("silent"), (n(silent) / F.greatest(n(F.lit(True)), F.lit(1))).alias("share"))


def rank_of(signals: DataFrame) -> DataFrame:
    """Each signal's place by risk: one more than the signals of higher risk; equal risks share a place.

    Risks are counted by value and the counts added up, so no window reads all signals, and there are as many sums as risks.
    """
    counts = signals.groupBy("risk").agg(F.count("*").alias("n"))
    places = running(counts, ["risk"], "n", "risks").select("risk", (F.col("total") - F.col("upto") + 1).alias("place"), F.col("total").alias("of"))
    return signals.join(places, "risk")


def anticipation(signals: DataFrame, evidence: DataFrame, observations: DataFrame, directions: dict[str, int], hours: int) -> DataFrame:
    """Hours from each signal's decision to the worst value of its main channel in the hours after, the earliest of equals.

    Time is cut into blocks of a quarter of the horizon, so that a horizon is three whole blocks and the parts of two.  The worst of a whole block is
    worked out once for all signals; the parts are the worst so far in their block, from its start or from its end.  No signal meets the observations
    one by one.
    """
    width = hours * 3600 / 4
    block = lambda c: F.floor(seconds(F.col(c)) / width)
    key = ["patient_id", "variable_code", "block"]
    sign = F.element_at(F.create_map(*[x for c, d in directions.items() for x in (F.lit(c), F.lit(d))]), F.col("variable_code"))
    value = F.struct((F.col("value_num") * sign).alias("worst"), (-F.unix_micros(F.col("event_time").cast("timestamp"))).alias("early"), "event_time").alias("value")
    rows = observations.where("is_plausible and not is_duplicate and value_num is not null").where(F.col("variable_code").isin(list(directions)))
    rows = rows.select("patient_id", "variable_code", block("event_time").alias("block"), F.col("event_time").alias("at"), value)
    main = evidence.where("role = 'PRIMARY'").groupBy("signal_id").agg(F.min("variable_code").alias("variable_code"))
    asked = signals.join(main, "signal_id").select("signal_id", "decision_time", "patient_id", "variable_code", F.expr(f"decision_time + make_dt_interval(0, {hours})").alias("until"))
    name = F.struct("signal_id", "decision_time").alias("signal")
    whole = asked.select(name, "patient_id", "variable_code", F.explode(F.sequence(block("decision_time") + 1, block("until") - 1)).alias("block"))
    middle = whole.join(rows.groupBy(*key).agg(F.max("value").alias("value")), key).select("signal", "value")
    edge = lambda c, after: asked.select("patient_id", "variable_code", block(c).alias("block"), F.col(c).alias("at"), F.lit(None).cast(rows.schema["value"].dataType).alias("value"), name, F.lit(after).alias("after"))
    ends = rows.withColumn("signal", F.lit(None).cast(edge("until", False).schema["signal"].dataType)).withColumn("after", F.lit(None).cast("boolean"))
    ends = ends.unionByName(edge("decision_time", True)).unionByName(edge("until", False))
    here = F.col("signal").isNotNull()
    late = Window.partitionBy(*key).orderBy(F.desc("at"), F.desc(here))  # what comes after, without what is at the same time
    early = Window.partitionBy(*key).orderBy("at", here)  # what comes before, with it
    upto = lambda w: F.max("value").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = ends.withColumn("value", F.when(F.coalesce("after", F.lit(False)), upto(late)).otherwise(upto(early))).where(here).select("signal", "value")
    peaks = middle.unionByName(parts).where("value is not null").groupBy("signal").agg(F.max("value").alias("peak"))
    return peaks.select("signal.signal_id", (F.timestamp_diff("MICROSECOND", F.col("signal.decision_time"), F.col("peak.event_time")) / 3.6e9).alias("hours"))
