"""Typed settings: windows, channels, thresholds.  Variants are made with ``dataclasses.replace``."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Channel:
    code: str
    direction: int
    weight: float
    floor: float
    nominal_min: int


@dataclass(frozen=True)
class Profile:
    """All constants of scoring, rules, priority and events.  The defaults of the thresholds are fixed values of the method."""

    channels: tuple[Channel, ...]
    evidence_h: int = 6
    baseline_h: int = 48
    # participation
    baseline_cover: float = 0.25
    evidence_cover: float = 0.40
    evidence_samples: int = 3
    slope_samples: int = 5
    # channel score
    ceiling: float = 6.0
    no_slope_factor: float = 0.5
    level_weight: float = 0.5
    slope_weight: float = 0.5
    streak_above: float = 0.5
    streak_min: int = 60
    use_streak: bool = True
    use_ceiling: bool = True
    # combination
    concordance: tuple[float, ...] = (0.40, 0.80, 1.15, 1.40)
    use_concordance: bool = True
    concordant_from: float = 1.0
    k0: float = 12.0
    # corroboration
    labs: tuple[tuple[str, float | None, float | None], ...] = ()  # code, and the bounds of rows that have none of their own
    lab_h: int = 24
    lab_most: int = 2
    lab_weight: float = 1.0
    # rules
    rules_on: bool = True
    rules: tuple[str, ...] = ("activity", "quality", "transient", "coverage")  # names in operators.rules, in their order
    lead_channel: str = "HR"
    activity: tuple[float, float] = (0.70, 0.55)
    quality: tuple[float, float] = (0.90, 0.30)
    transient: tuple[float, float] = (0.80, 0.50)
    coverage_below: float = 0.50
    # priority: risk, k, persistence, coverage
    critical: tuple[float, int, float, float] = (0.85, 3, 0.60, 0.70)
    high: tuple[float, int] = (0.65, 2)
    medium: float = 0.40
    fresh_min: float = 120.0
    # events
    cadence_h: int = 1
    warmup_h: int = 54
    refractory_h: int = 12
    re_emit: float = 0.10
    floor_band: int = 1
    citations: int = 32
    version: str = "tideline-2"

    def expected(self, c: Channel, hours: int) -> float:
        return hours * 60 / c.nominal_min

    def baseline_least(self, c: Channel) -> float:
        return max(3, self.expected(c, self.baseline_h) * self.baseline_cover)

    def evidence_least(self, c: Channel) -> float:
        most = max(1.0, self.expected(c, self.evidence_h))
        return min(max(self.evidence_samples, most * self.evidence_cover), most)

    def streak_goal(self, c: Channel) -> int:
        return max(2, math.ceil(self.streak_min / c.nominal_min))


BANDS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def profile_of(settings: dict) -> Profile:
    """A profile from plain settings, as a YAML file gives them; unknown names are refused."""
    known = {f.name for f in fields(Profile)}
    if extra := set(settings) - known:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    given = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in settings.items()}
    given["channels"] = tuple(c if isinstance(c, Channel) else Channel(**c) for c in settings["channels"])
    return Profile(**given)


#: The clinical profile.  Fixed values of the method: channels in order with direction, weight, least dispersion and nominal minutes.
CLINICAL = Profile(
    channels=(
        Channel("HR", 1, 1.0, 2.82, 20),
        Channel("RR", 1, 1.0, 0.70, 20),
        Channel("TEMP", 1, 1.0, 0.12, 60),
        Channel("SpO2", -1, 1.0, 0.34, 20),
        Channel("SBP", -1, 0.5, 2.36, 120),
        Channel("DBP", -1, 0.5, 1.63, 120),
    ),
    labs=(("LAB_A", None, None), ("LAB_B", None, None), ("LAB_C", None, None), ("LAB_D", None, None)),
)

#: The profile for the sparse ``events`` table: windows of days, a decision a day.
EVENTS = Profile(
    channels=tuple(Channel(code, direction, weight, 12.0, 2880) for code, direction, weight in (("click", 1, 1.0), ("error", 1, 1.0), ("purchase", 1, 1.0), ("signup", -1, 0.5), ("view", -1, 0.5))),
    evidence_h=192,
    baseline_h=384,
    streak_min=5760,
    labs=(("signup", None, None), ("view", None, None)),
    lab_h=192,
    lead_channel="click",
    fresh_min=2880.0,
    cadence_h=24,
    warmup_h=576,
    refractory_h=72,
)

#: The same with windows of one sample and a long goal for runs: thin and short-lived deviations take part, and rules on them have something to say.
THIN = replace(EVENTS, streak_min=14400, evidence_samples=1, evidence_cover=0.25)


def variants(base: Profile) -> list[tuple[str, Profile]]:
    """The ablation ladder: magnitude alone, then ceiling, persistence, concordance and suppression are added."""
    v0 = replace(base, use_ceiling=False, use_streak=False, use_concordance=False, rules_on=False)
    v1 = replace(v0, use_ceiling=True)
    v2 = replace(v1, use_streak=True)
    v3 = replace(v2, use_concordance=True)
    return [("0_magnitude", v0), ("1_ceiling", v1), ("2_persistence", v2), ("3_concordance", v3), ("4_suppression", base)]
