"""The whole cohort in one plan: clean rows, windows, channels, assessments, signals, evidence."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.config import Profile
from tideline.operators import asof, assess, channels, citations, events, rules
from tideline.sources.stored import stored


@dataclass(frozen=True)
class Clean:
    """What ingestion leaves behind; a sweep reads each table several times, so they should be written ones."""

    observations: DataFrame
    intervals: DataFrame
    facts: DataFrame | None = None


@dataclass(frozen=True)
class Sweep:
    """Everything decided over a grid of instants; all of it is lazy."""

    profile: Profile
    grid: DataFrame
    visible: DataFrame
    channels: DataFrame
    labs: DataFrame
    measures: dict[str, DataFrame]
    assessments: DataFrame


def _decide(clean: Clean, visible: DataFrame, windows: DataFrame, grid: DataFrame, p: Profile, samples: bool = False, every: bool = False) -> Sweep:
    measured = channels.measured(windows, p)
    found, measures = assess.labs(visible, p), rules.measured(rules.Seen(grid, visible, measured, clean.intervals, clean.facts, p))
    return Sweep(p, grid, visible, measured, found, measures, assess.assess(measured, found, measures, p, samples, grid if every else None))


def _lookback(p: Profile) -> int:
    return max(p.evidence_h + p.baseline_h, p.lab_h)


def sweep(clean: Clean, p: Profile, samples: bool = False) -> Sweep:
    """Assess every patient at every instant of the decision grid; with ``samples``, channels keep those of their evidence."""
    encounter = stored(asof.encounters(clean.observations), "encounters")  # a row a patient
    visible, windows = _seen(clean, encounter, p)
    return _decide(clean, visible, windows, asof.decision_grid(encounter, p), p, samples)


def _seen(clean: Clean, encounter: DataFrame, p: Profile) -> tuple[DataFrame, DataFrame]:
    """What is visible at each instant of the grid, and the windows of the channels."""
    back = _lookback(p)
    rows = asof.dealt(asof.usable_series(clean.observations), encounter, p, back)
    own = [c for c in clean.observations.columns if c not in ("patient_id", "variable_code")]
    return asof.ticked(rows, p, back).select("patient_id", "variable_code", "stretch", "t", *own), channels.grid_windows(rows, p, back)


def sweeps(clean: Clean, named: list[tuple[str, Profile]]) -> dict[str, Sweep]:
    """Sweeps under profiles that differ in switches only: windows and their statistics are worked out once and written."""
    (_, base), *_ = named
    encounter = stored(asof.encounters(clean.observations), "encounters")
    visible, windows = _seen(clean, encounter, base)
    s = _decide(clean, visible, windows, asof.decision_grid(encounter, base), base)
    statistics = stored(channels.statistics(windows, base).drop("evidence", "baseline", "z"), "statistics")
    labs, measures, out = stored(s.labs, "labs"), {}, {}
    for name, p in named:
        measured = channels.scored(statistics, p)
        wanted = rules.measured(rules.Seen(s.grid, s.visible, measured, clean.intervals, clean.facts, p))
        measures |= {rule: stored(rows, rule) for rule, rows in wanted.items() if rule not in measures}
        out[name] = Sweep(p, s.grid, s.visible, measured, labs, measures, assess.assess(measured, labs, measures, p))
    return out


def decide(clean: Clean, instants: DataFrame, p: Profile, every: bool = False) -> Sweep:
    """Assess a few given instants (patient_id, t) live, channels with their samples; the patient filter reaches the scan.

    Instants at which no channel takes part have an assessment only with ``every``.
    """
    visible = asof.at_instants(asof.usable_series(clean.observations), instants, _lookback(p))
    return _decide(clean, visible, channels.windows(visible, p), instants, p, samples=True, every=every)


def snapshot(clean: Clean, instants: DataFrame, p: Profile) -> dict[str, DataFrame]:
    """All that was known at the instants (patient_id, t): observations, intervals, facts, and rows set aside; raises if anything came later."""
    back = p.evidence_h + p.baseline_h
    spans = asof.meeting(clean.intervals, F.greatest("available_time", "start_time"), F.expr(f"end_time + make_dt_interval(0, {back})"), instants.select("patient_id", "t"), max(back, 24))
    parts = {"observations": asof.at_instants(asof.usable_series(clean.observations), instants, back).drop("stretch"), "intervals": spans}
    if clean.facts is not None:
        parts["facts"] = asof.facts_at(clean.facts, instants)
    parts["set_aside"] = asof.at_instants(asof.excluded(clean.observations), instants, back).drop("stretch")
    asof.assert_causal(*parts.values())
    return parts


def written(s: Sweep) -> Sweep:
    """The same sweep with its channels, laboratories and assessments written once, for plans that read them several times."""
    measured, labs = stored(s.channels, "channels"), stored(s.labs, "labs")
    return replace(s, channels=measured, labs=labs, assessments=stored(assess.assess(measured, labs, s.measures, s.profile), "assessments"))


def signals(s: Sweep) -> DataFrame:
    """Emitted assessments as output rows."""
    names = F.concat_ws(",", F.transform("rules", lambda r: r["rule"])).alias("suppressions")
    wanted = s.assessments.select("patient_id", "t", "band", "risk", "raw", "rules", "priority", "confidence", "k", names, assess.explanation(s.profile).alias("explanation"))
    start = F.expr(f"t - make_dt_interval(0, {s.profile.evidence_h})")
    return events.eventize(wanted, s.profile).select(
        events.signal_id().alias("signal_id"), "patient_id", F.col("t").alias("decision_time"), start.alias("evidence_start"), F.col("t").alias("evidence_end"),
        "priority", F.round("risk", 6).alias("risk"), F.round("confidence", 6).alias("confidence"), "k", "suppressions", "demoted", "explanation", F.lit(s.profile.version).alias("model_version"),
    )


def evidence(s: Sweep, clean: Clean) -> DataFrame:
    """Citations of the emitted assessments."""
    p, key = s.profile, ["patient_id", "t"]
    emitted = stored(events.eventize(s.assessments.select(*key, "band", "risk", "raw", "rules"), p).select(*key, events.signal_id().alias("signal_id"), F.transform("rules", lambda r: r["rule"]).alias("rules")), "emitted")
    of = lambda df, instants: df.join(instants.select(*key), key, "left_semi")
    held = lambda rule: emitted.where(F.arrays_overlap("rules", F.array(*[F.lit(o.name) for o in rule.outcomes]))).select(*key)
    seen = rules.Seen(emitted.select(*key), of(s.visible, emitted), s.channels, clean.intervals, clean.facts, p)
    cited = [rule.cite(seen, held(rule)) for rule in rules.of(p) if rule.cite]
    excluded = asof.at_instants(asof.excluded(clean.observations), emitted, p.evidence_h)
    around = rules.overlapping(clean.intervals, emitted, p, "ENCOUNTER", p.evidence_h + p.baseline_h)
    return citations.citations(of(s.channels, emitted), of(s.labs, emitted), cited, excluded, around, p).join(emitted.drop("rules"), key)
