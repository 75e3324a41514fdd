"""Rules that weigh an assessment against what else is known; a profile names those that apply, in their order.

A rule says what rows it looks at (``ground``), what it makes of them at each instant (``measures``), which of its outcomes holds, and what it
cites.  ``register`` adds one; nothing else needs to know it: scores, priorities, explanations and evidence follow from the registry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.config import Profile
from tideline.functions.scalars import percent, text
from tideline.operators.asof import meeting

KEY = ["patient_id", "t"]


@dataclass(frozen=True)
class Seen:
    """What a rule may look at: the instants, what was visible at each, the participating channels, and the clean intervals and facts."""

    instants: DataFrame
    visible: DataFrame
    channels: DataFrame
    intervals: DataFrame
    facts: DataFrame | None
    profile: Profile


@dataclass(frozen=True)
class Outcome:
    """One way in which a rule can hold: condition and ground in words over an assessment's columns, and the share of the score that it takes away.

    One that ``limits`` keeps the priority from the highest band whatever it takes away.
    """

    name: str
    when: Callable[[Profile], Column]
    why: Callable[[Profile], Column]
    strength: Callable[[Profile], float] = lambda p: 0.0
    limits: bool = False


@dataclass(frozen=True)
class Rule:
    """``ground`` gives rows with patient_id and t; ``measures`` are aggregates over those of an instant, with what they are where there are none.

    ``cite`` gives the evidence, rows as of ``citations.plain``, at instants (patient_id, t) where an outcome of the rule holds.
    """

    name: str
    outcomes: tuple[Outcome, ...]
    ground: Callable[[Seen], DataFrame] | None = None
    measures: dict[str, tuple[Callable[[], Column], object]] = field(default_factory=dict)
    cite: Callable[[Seen, DataFrame], DataFrame] | None = None


RULES: dict[str, Rule] = {}


def register(rule: Rule) -> Rule:
    """Make a rule known by its name; a profile that names it applies it.  Names of rules and outcomes are given once."""
    taken = {o.name for r in RULES.values() if r.name != rule.name for o in r.outcomes}
    if rule.name in RULES and RULES[rule.name] is not rule or taken & {o.name for o in rule.outcomes}:
        raise ValueError(f"rule {rule.name} or an outcome of it is registered already")
    RULES[rule.name] = rule
    return rule


def unregister(name: str) -> None:
    RULES.pop(name, None)


def of(p: Profile) -> list[Rule]:
    """The rules of a profile, in its order; none where rules are off."""
    if unknown := [n for n in p.rules if n not in RULES]:
        raise ValueError(f"rules that are not registered: {unknown}")
    return [RULES[n] for n in p.rules] if p.rules_on else []


def outcomes(p: Profile) -> list[Outcome]:
    return [o for r in of(p) for o in r.outcomes]


def measured(seen: Seen) -> dict[str, DataFrame]:
    """For each rule that measures something: (patient_id, t, measures), a row for each instant with ground."""
    return {r.name: r.ground(seen).groupBy(*KEY).agg(*[m().alias(name) for name, (m, _) in r.measures.items()]) for r in of(seen.profile) if r.ground and r.measures}


def applied(assessments: DataFrame, measures: dict[str, DataFrame], p: Profile) -> DataFrame:
    """``assessments`` with the measures of the rules, and ``rules``: the outcomes that hold, in order, as structs of rule and strength."""
    for rows in (measures[r.name] for r in of(p) if r.name in measures):
        assessments = assessments.join(rows, KEY, "left")
    otherwise = {name: value for r in of(p) for name, (_, value) in r.measures.items()}
    for name, value in otherwise.items():
        assessments = assessments.withColumn(name, F.coalesce(name, F.lit(value)) if name in assessments.columns else F.lit(value))
    one = lambda o: F.struct(F.lit(o.name).alias("rule"), F.lit(float(o.strength(p))).alias("strength"))

    def first(rule: Rule) -> Column:
        held = F.when(F.lit(False), one(rule.outcomes[0]))
        for o in rule.outcomes:
            held = held.when(o.when(p), one(o))
        return held

    none = F.expr("cast(array() as array<struct<rule:string,strength:double>>)")
    return assessments.withColumn("rules", F.array_compact(F.array(*[first(r) for r in of(p)])) if of(p) else none)


def holding(p: Profile) -> Column:
    """Whether a rule that holds keeps the priority from the highest band."""
    limits = [o.name for o in outcomes(p) if o.limits]
    return F.exists("rules", lambda r: (r["strength"] > 0) | r["rule"].isin(*limits) if limits else r["strength"] > 0)


def said(p: Profile) -> Column:
    """A sentence for each rule that holds: its name, what it did, and its ground."""

    def one(r: Column) -> Column:
        why, limited = F.lit(""), F.lit(False)
        for o in outcomes(p):
            why, limited = F.when(r["rule"] == o.name, o.why(p)).otherwise(why), limited | ((r["rule"] == o.name) & F.lit(o.limits))
        effect = F.when(r["strength"] > 0, text("score reduced by ", percent(r["strength"]))).when(limited, F.lit("priority limited")).otherwise(F.lit("score kept"))
        return text("rule ", r["rule"], ", ", effect, ": ", why)

    return F.transform("rules", one)


def overlapping(intervals: DataFrame, instants: DataFrame, p: Profile, kind: str, hours: int | None = None) -> DataFrame:
    """Intervals of a kind that were known at t and reach into the last ``hours`` (the evidence window); their end is not known beyond t."""
    span = p.evidence_h if hours is None else hours
    own = intervals.where(F.col("kind") == kind)
    return meeting(own, F.greatest("available_time", "start_time"), F.expr(f"end_time + make_dt_interval(0, {span})"), instants.select(*KEY), max(span, 24))


def activity_context(seen: Seen) -> DataFrame:
    rows = overlapping(seen.intervals, seen.instants, seen.profile, "CONTEXT")
    return rows.where("subtype = 'RECOVERY_PHASE' or (subtype = 'PHYSICAL_ACTIVITY' and value_text in ('HIGH', 'MODERATE'))")


def _at(rows: DataFrame, instants: DataFrame) -> DataFrame:
    return rows.join(instants.select(*KEY), KEY, "left_semi")


def _implausible(seen: Seen, instants: DataFrame) -> DataFrame:
    """Of the bad samples of the participating channels eight, in the order of channels."""
    from tideline.operators.citations import plain

    bad = seen.visible.where(~F.col("is_plausible")).where(F.expr(f"event_time >= t - make_dt_interval(0, {seen.profile.evidence_h})"))
    bad = _at(bad, instants).join(seen.channels.select(*KEY, "variable_code", F.col("place").alias("channel")), [*KEY, "variable_code"])
    return plain(bad, "QUALITY", first=("channel",)).where("place <= 8")


def _leading(seen: Seen, instants: DataFrame) -> DataFrame:
    """The samples of the leading channel once more, as what the rule on transient deviations looked at."""
    from tideline.operators.citations import channel_citations

    lead = channel_citations(_at(seen.channels, instants)).where("role = 'PRIMARY'")
    return lead.drop("part").withColumn("role", F.lit("QUALITY")).withColumn("contribution", F.lit(0.0))


def _intervals_cited(rows: DataFrame, role: str) -> DataFrame:
    from tideline.operators.citations import plain

    return plain(rows, role, "intervals", "start_time")


def _share() -> Column:
    return F.when(F.col("score_sum") > 0, F.col("lead_score") / F.col("score_sum")).otherwise(0.0)


def _bad_share() -> Column:
    return F.try_divide(F.col("bad"), F.col("bad") + F.col("good"))


def _samples(p: Profile) -> Column:
    return text(F.col("bad").cast("string"), " of ", (F.col("bad") + F.col("good")).cast("string"), " samples implausible")


register(
    Rule(
        "activity",
        (
            Outcome("activity", lambda p: F.col("active") & (_share() >= p.activity[1]), lambda p: text(f"{p.lead_channel} carries ", percent(_share()), " of the score beside known activity"), lambda p: p.activity[0]),
            Outcome("activity_considered", lambda p: F.col("active"), lambda p: text(f"{p.lead_channel} carries only ", percent(_share()), " of the score beside known activity")),
        ),
        activity_context,
        {"active": (lambda: F.count("*") > 0, False)},
        lambda seen, instants: _intervals_cited(_at(activity_context(seen), instants), "CONTEXT"),
    )
)
register(
    Rule(
        "quality",
        (
            Outcome("quality", lambda p: (F.col("bad") > 0) & (_bad_share() >= p.quality[1]), _samples, lambda p: p.quality[0]),
            Outcome("quality_noted", lambda p: F.col("bad") > 0, _samples),
        ),
        cite=_implausible,
    )
)
register(
    Rule(
        "transient",
        (Outcome("transient", lambda p: F.col("persistence_max") < p.transient[1], lambda p: text("longest run reaches ", percent(F.col("persistence_max")), " of its goal"), lambda p: p.transient[0]),),
        cite=_leading,
    )
)
register(
    Rule(
        "coverage",
        (Outcome("coverage", lambda p: F.col("live_coverage") < p.coverage_below, lambda p: text("window covered to ", percent(F.col("live_coverage"))), limits=True),),
        cite=lambda seen, instants: _intervals_cited(overlapping(seen.intervals, instants, seen.profile, "CONNECTIVITY"), "QUALITY"),
    )
)
