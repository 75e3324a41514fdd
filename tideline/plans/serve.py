"""The query surface: what a service would answer, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.config import BANDS, Profile
from tideline.operators import asof, events
from tideline.operators.assess import explanation
from tideline.plans.narrative import narrate
from tideline.plans.sweep import Clean, decide, snapshot
from tideline.sources.stored import stored


def timelines(clean: Clean, start: str | None = None, end: str | None = None, as_of: str | None = None, variables: list[str] | None = None) -> dict[str, DataFrame]:
    """``samples`` without duplicates, cut by what was known ``as_of``, and ``intervals``, which are not cut."""
    rows = clean.observations.where("not is_duplicate")
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    if start:
        rows = rows.where(F.col("event_time") >= at(start))
    if end:
        rows = rows.where(F.col("event_time") <= at(end))
    if as_of:
        rows = rows.where(F.col("available_time") <= at(as_of))
    if variables:
        rows = rows.where(F.col("variable_code").isin(variables))
    return {"samples": rows, "intervals": clean.intervals}


def cohort(clean: Clean, n: int) -> Clean:
    """The clean rows of the first ``n`` patients by id."""
    few = F.broadcast(clean.observations.select("patient_id").distinct().orderBy("patient_id").limit(n))
    return Clean(clean.observations.join(few, "patient_id", "left_semi"), clean.intervals.join(few, "patient_id", "left_semi"), clean.facts)


def patients_by_risk(clean: Clean, signals: DataFrame, limit: int) -> DataFrame:
    """Patients with the number of their signals and the highest risk; those without any come last."""
    of = signals.groupBy("patient_id").agg(F.count("*").alias("signals"), F.max("risk").alias("risk"))
    rows = clean.observations.select("patient_id").distinct().join(of, "patient_id", "left")
    return rows.select("patient_id", F.coalesce("signals", F.lit(0)).alias("signals"), "risk").orderBy(F.desc_nulls_last("risk"), "patient_id").limit(limit)


class NotFound(LookupError):
    """An entity that is not there."""


@dataclass(frozen=True)
class Service:
    """Read-only answers over clean rows and a finished run."""

    clean: Clean
    signals: DataFrame
    evidence: DataFrame | None
    profile: Profile

    def health(self) -> DataFrame:
        n = lambda df, name: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        rows = n(self.clean.observations, "observations").unionByName(n(self.clean.intervals, "intervals")).unionByName(n(self.signals, "signals"))
        return rows.withColumn("model_version", F.lit(self.profile.version))

    def loaded_sources(self) -> DataFrame:
        """The files that rows were loaded from; intervals that name none are told as such."""
        parts = [self.clean.observations, self.clean.intervals, *([] if self.clean.facts is None else [self.clean.facts])]
        named = [df.select(F.col("source_file") if "source_file" in df.columns else F.lit("intervals").alias("source_file")) for df in parts]
        return reduce(DataFrame.union, named).distinct()

    def list_signals(self, priority: str | None = None, patient: str | None = None, limit: int = 50) -> DataFrame:
        if not 1 <= limit <= 500:
            raise ValueError("limit is 1 to 500")
        rows = self.signals
        if priority is not None:
            if priority.upper() not in BANDS:
                raise ValueError(f"no priority {priority}")
            rows = rows.where(F.col("priority") == priority.upper())
        if patient is not None:
            rows = rows.where(F.col("patient_id") == patient)
        return rows.orderBy(F.desc("risk"), "signal_id").limit(limit)

    def signal(self, signal_id: str) -> DataFrame:
        """One signal with its evidence by role."""
        one = self.signals.where(F.col("signal_id") == signal_id)
        item = F.struct("n", "source_file", "record_id", "variable_code", "event_time", "available_time", "contribution")
        by_role = self.evidence.where(F.col("signal_id") == signal_id).groupBy("signal_id", "role").agg(F.array_sort(F.collect_list(item)).alias("items"))
        roles = by_role.groupBy("signal_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "items"))).alias("evidence"))
        found = one.join(roles, "signal_id", "left")
        if not found.limit(1).count():
            raise NotFound(signal_id)
        return found

    def patients(self, limit: int = 1000) -> DataFrame:
        if not 1 <= limit <= 1000:
            raise ValueError("limit is 1 to 1000")
        return patients_by_risk(self.clean, self.signals, limit)

    def timeline(self, patient: str, start: str | None = None, end: str | None = None, as_of: str | None = None, variables: list[str] | None = None) -> DataFrame:
        """One patient's series by variable; ``as_of`` cuts by what was known.  ``timeline_intervals`` has the intervals beside them."""
        rows = timelines(self._own(patient), start, end, as_of, variables)["samples"]
        item = F.struct("event_time", "record_id", "available_time", "value_num", "value_text", "is_plausible", "quality_flag", "ref_low", "ref_high")
        return rows.groupBy("variable_code").agg(F.array_sort(F.collect_list(item)).alias("series"))

    def timeline_intervals(self, patient: str) -> DataFrame:
        return timelines(self._own(patient))["intervals"].select("kind", "subtype", "value_text", "start_time", "end_time", "record_id").orderBy("start_time")

    def _own(self, patient: str) -> Clean:
        own = lambda df: df.where(F.col("patient_id") == patient)
        return Clean(own(self.clean.observations), own(self.clean.intervals), own(self.clean.facts) if self.clean.facts is not None else None)

    def _require(self, patient: str) -> None:
        if not self.clean.observations.where(F.col("patient_id") == patient).limit(1).count():
            raise NotFound(patient)

    def _instants(self, patient: str, times: str, **given: str) -> DataFrame:
        """(patient_id, t) of the SQL array ``times`` over columns of the ``given`` texts, which are read as times and never as SQL."""
        one = self.signals.sparkSession.range(1).select(F.lit(patient).alias("patient_id"), *[F.lit(text).cast("timestamp_ntz").alias(name) for name, text in given.items()])
        return one.select("patient_id", F.explode(F.expr(times)).alias("t"))

    def decide(self, patient: str, at: str) -> DataFrame:
        """A live decision at any instant, one row, with what was visible and what was set aside; without a baseline in any channel its risk is 0."""
        self._require(patient)
        clean, instants = self._own(patient), self._instants(patient, "array(moment)", moment=at)
        s = decide(clean, instants, self.profile, every=True)
        known = snapshot(clean, instants, self.profile)
        key = ["patient_id", "t"]
        span = asof.encounters(clean.observations)
        seen = known["observations"].groupBy(*key).agg(F.count("*").alias("visible"))
        aside = known["set_aside"].groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("record_id", "variable_code", "reason"))).alias("set_aside"))
        rows = s.assessments.join(span, "patient_id", "left").withColumn("within_encounter", F.col("t").between(F.col("start_time"), F.col("end_time")))
        return rows.join(seen, key, "left").join(aside, key, "left").select(*_decision(), "within_encounter", F.coalesce("visible", F.lit(0)).alias("visible"), "set_aside", explanation(self.profile).alias("explanation"))

    def narrative(self, patient: str, at: str, write: Callable[[dict], dict] | None = None) -> dict:
        """A text for the live decision, which is one row; the decision is made before and does not change."""
        found = self.decide(patient, at).first()
        return narrate(found.k, [c.asDict(True) for c in found.channels], found.lab_n, [r.rule for r in found.rules], write)

    def history(self, patient: str, start: str | None = None, end: str | None = None, cadence_min: int = 20) -> DataFrame:
        """One row: the assessment at the end, the peak, the transitions, the course of risk, and counts, over a grid from start to end.

        By default from the first to the last event of the patient (``history_mode`` complete, else until); an end before the start or beyond the
        last event is refused.  The end counts as ``current`` even where no channel takes part, and as the peak where that is so everywhere.
        """
        self._require(patient)
        own = self._own(patient)
        first, last = asof.encounters(own.observations).select(F.col("start_time").cast("string"), F.col("end_time").cast("string")).first()
        mode, start, end = "complete" if end is None else "until", start or first, end or last
        spark = self.signals.sparkSession
        time = lambda text: F.lit(text).cast("timestamp_ntz")
        early, late = spark.range(1).select(time(end) < time(start), time(end) > time(last)).first()
        if early:
            raise ValueError("the end comes before the start")
        if late:
            raise ValueError(f"the end must lie within the encounter: {first} to {last}")
        instants = self._instants(patient, asof.history_grid("since", "until", cadence_min), since=start, until=end)
        every = stored(decide(own, instants, self.profile, every=True).assessments, "assessments")
        evaluable = every.where("size(channels) > 0")
        point = F.struct("t", "priority", F.round("risk", 4).alias("risk"), "k")
        listed = lambda df, name: df.groupBy("patient_id").agg(F.array_sort(F.collect_list(point)).alias(name))
        current = every.where(F.col("t") == time(end)).select("patient_id", point.alias("current"), F.struct("band", "risk", "t", "priority").alias("at_end"))
        rows = events.history(evaluable, instants)
        for part in (current, listed(events.transitions(evaluable), "transitions"), listed(evaluable, "trajectory")):
            rows = rows.join(part, "patient_id", "left")
        return rows.withColumn("peak", F.coalesce("peak", "at_end")).drop("at_end").withColumn("history_mode", F.lit(mode))


def _decision() -> list:
    """What a decision tells, in the roundings of the contract."""
    rounded = {"score": 3, "level": 2, "slope": 2, "persistence": 2, "coverage": 3, "centre": 2, "scale": 3, "latest": 2}
    one = lambda c: F.struct(c["variable_code"].alias("variable_code"), *[F.round(c[n], k).alias(n) for n, k in rounded.items()], *[c[n].alias(n) for n in ("n_evidence", "n_baseline", "place", "evidence")])
    return ["patient_id", "t", "k", F.round("risk", 4).alias("risk"), F.round("confidence", 4).alias("confidence"), "priority", "rules", F.transform("channels", one).alias("channels"), "lab_n"]
