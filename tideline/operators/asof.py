"""What was known about whom at which instant.

A row is visible at T if it was available by T and happened within the lookback.  On a regular grid, the instants
that see a row follow from its own time by arithmetic, so rows are dealt to stretches of instants of their
entity, two at most, and meet no others.  Rows meet given instants by cells of time (``meeting``).  Either way there is no join of all rows of an entity
with all its instants, and an entity with most rows is still shared out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.config import Profile
from tideline.functions.scalars import seconds, tasks

#: The least number of instants of a stretch.
STRETCH = 24
#: The level of what has no end: one cell for all time.
TOP = 40


def encounters(observations: DataFrame) -> DataFrame:
    """First to last event of each patient."""
    return observations.groupBy("patient_id").agg(F.min("event_time").alias("start_time"), F.max("event_time").alias("end_time"))


def _from(start: str, hours: str) -> str:
    return f"{start} + make_dt_interval(0, cast({hours} as int))"


def decision_grid(encounter: DataFrame, p: Profile) -> DataFrame:
    """(patient_id, k, t): instants from start + warmup to the end at the cadence; none where the warmup is not over."""
    first = F.expr(_from("start_time", str(p.warmup_h)))
    open_ = encounter.withColumn("first", first).where("first <= end_time")
    steps = F.floor(F.timestamp_diff("MICROSECOND", F.col("first"), F.col("end_time")) / (p.cadence_h * 3.6e9))
    ticks = open_.select("patient_id", "first", F.explode(F.sequence(F.lit(0).cast("long"), steps)).alias("k"))
    return ticks.select("patient_id", "k", F.expr(_from("first", f"k * {p.cadence_h}")).alias("t"))


def history_grid(start: str, end: str, cadence_min: int) -> str:
    """SQL for the array of instants from start to end at the cadence, the end always among them."""
    if cadence_min <= 0:
        raise ValueError("the cadence must be positive")
    return f"array_distinct(concat(sequence({start}, {end}, make_dt_interval(0, 0, {cadence_min})), array({end})))"


def stretch_of(p: Profile, lookback_h: int) -> int:
    """Instants of a stretch: no fewer than see a row one after the other, so that no row is in more than two."""
    return max(STRETCH, math.ceil(lookback_h / p.cadence_h))


def dealt(rows: DataFrame, encounter: DataFrame, p: Profile, lookback_h: int) -> DataFrame:
    """Each row of ``rows(patient_id, variable_code, event_time, available_time, ...)`` in each stretch with a grid instant that sees it, two at most.

    ``lo`` to ``hi`` are the numbers of the instants that see it, ``first`` is the grid's first, ``since`` the microseconds from there to the event; rows are
    dealt out by patient, variable and stretch.
    """
    step, length = p.cadence_h * 3.6e9, stretch_of(p, lookback_h)
    from_first = lambda c: F.timestamp_diff("MICROSECOND", F.col("first"), F.col(c))
    span = encounter.withColumn("first", F.expr(_from("start_time", str(p.warmup_h)))).where("first <= end_time").select("patient_id", "first", F.floor(from_first("end_time") / step).alias("last"))
    seen = rows.join(span, "patient_id").withColumn("since", from_first("event_time")).withColumn("known", from_first("available_time"))
    seen = seen.withColumn("lo", F.greatest(F.lit(0).cast("long"), F.ceil(F.greatest("since", "known") / step))).withColumn("hi", F.least(F.floor((F.col("since") + lookback_h * 3_600_000_000) / step), "last"))
    stretches = F.expr(f"if(lo <= hi, sequence(lo div {length}, hi div {length}), array())")  # not a filter, which would work out both ends once more
    return seen.drop("known", "last").withColumn("stretch", F.explode(stretches)).repartition(tasks(rows), "patient_id", "variable_code", "stretch")


def ticked(rows: DataFrame, p: Profile, lookback_h: int) -> DataFrame:
    """Rows of a stretch, with its ``lo``, ``hi`` and ``first``, at each of their instants: number ``k`` and time ``t``."""
    length = stretch_of(p, lookback_h)
    ticks = F.explode(F.expr(f"sequence(greatest(lo, stretch * {length}), least(hi, stretch * {length} + {length - 1}))"))
    return rows.withColumn("k", ticks).withColumn("t", F.expr(_from("first", f"k * {p.cadence_h}")))


def on_grid(rows: DataFrame, encounter: DataFrame, p: Profile, lookback_h: int) -> DataFrame:
    """Each row of ``rows`` at every grid instant t that sees it."""
    seen = ticked(dealt(rows, encounter, p, lookback_h), p, lookback_h)
    return seen.select("patient_id", "variable_code", "stretch", "t", *[c for c in rows.columns if c not in ("patient_id", "variable_code")])


def _width(lo: Column, hi: Column, cell_h: int) -> Column:
    """The level of a stretch of time: the least whose cells, 2^level times ``cell_h`` hours, are as long as it is; TOP where it has no end."""
    cells = (seconds(hi) - seconds(lo)) / (cell_h * 3600)
    return F.when(hi.isNull(), TOP).otherwise(F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(cells, F.lit(1.0)))))).cast("int")


def _levels(rows: DataFrame) -> list[int]:
    """The levels that occur in ``rows(_level)``, few numbers."""
    return sorted(r[0] for r in rows.select("_level").distinct().collect())


def meeting(rows: DataFrame, lo: Column, hi: Column, instants: DataFrame, cell_h: int, at: str = "t", since: str | None = None, bounded: bool = False) -> DataFrame:
    """``rows(patient_id, ...)`` beside each of ``instants(patient_id, at, ...)`` of its patient whose stretch meets the row's.

    A row lasts from ``lo`` to ``hi`` (null: for ever), an instant from ``since`` (by default itself) to ``at``, all ends included.  Each stretch
    of time has a level by its own length, and lies in two cells of it at most, however long it is.  A pair meets at the higher of its two levels:
    each side is dealt to cells of its own level and of the higher ones that the other side has, and joined by patient, level and cell; of the cells that a
    pair shares, the first gives it.  ``bounded`` says that no row is longer than a cell, which saves looking.
    """
    cell = lambda c, level: F.floor(seconds(c) / (cell_h * 3600 * F.pow(F.lit(2.0), level)))
    own = rows.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi or _lo is not null and _hi is null")
    own = own.withColumn("_level", F.lit(0) if bounded else _width(F.col("_lo"), F.col("_hi"), cell_h))
    met = instants.withColumn("_since", F.col(since or at)).withColumn("_until", F.col(at)).withColumn("_other", _width(F.col("_since"), F.col("_until"), cell_h) if since else F.lit(0))
    above = [0] if bounded else _levels(own)
    beyond = _levels(met.select(F.col("_other").alias("_level"))) if since else [0]

    def dealt_to(df: DataFrame, level: str, others: list[int], first: str, last: str) -> DataFrame:
        all_ = F.array_distinct(F.array(F.col(level), *[F.lit(o) for o in others if o > 0]))
        df = df.withColumn("_at", F.explode(F.filter(all_, lambda o: o >= F.col(level)))) if any(o > 0 for o in others) else df.withColumn("_at", F.col(level))
        cells = F.when(F.col("_at") == TOP, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(cell(F.col(first), F.col("_at")), cell(F.coalesce(F.col(last), F.col(first)), F.col("_at"))))
        return df.withColumn("_cell", F.explode(cells))

    pairs = dealt_to(own, "_level", beyond, "_lo", "_hi").join(dealt_to(met, "_other", above, "_since", "_until"), ["patient_id", "_at", "_cell"])
    pairs = pairs.where(F.col("_at") == F.greatest("_level", "_other")).where("_lo <= _until and (_hi is null or _hi >= _since)")
    first = F.when(F.col("_at") == TOP, F.lit(0)).otherwise(F.greatest(cell(F.col("_lo"), F.col("_at")), cell(F.col("_since"), F.col("_at"))))
    return pairs.where(F.col("_cell") == first).drop("_lo", "_hi", "_level", "_since", "_until", "_other", "_at", "_cell")


def at_instants(rows: DataFrame, instants: DataFrame, lookback_h: int) -> DataFrame:
    """The same for any given instants (patient_id, t)."""
    seen = meeting(rows, F.greatest("available_time", "event_time"), F.expr(_from("event_time", str(lookback_h))), instants.select("patient_id", "t"), lookback_h, bounded=True)
    return seen.withColumn("stretch", F.lit(0).cast("long"))


def usable_series(observations: DataFrame) -> DataFrame:
    """Rows that may enter a series: neither duplicate nor of unknown availability."""
    return observations.where("not is_duplicate and is_availability_known")


def excluded(observations: DataFrame) -> DataFrame:
    """Rows that may not, with the reason; unknown availability goes first."""
    return observations.where("is_duplicate or not is_availability_known").withColumn("reason", F.when(~F.col("is_availability_known"), "AVAILABILITY_UNKNOWN").otherwise("DUPLICATE"))


def hidden(observations: DataFrame, encounter: DataFrame, p: Profile) -> DataFrame:
    """Each row at every grid instant t at which it had happened but was not known, by arithmetic as in ``on_grid``; duplicates left out."""
    span = encounter.withColumn("first", F.expr(_from("start_time", str(p.warmup_h)))).where("first <= end_time").select("patient_id", "first", "end_time")
    step = p.cadence_h * 3.6e9
    place = lambda c: F.timestamp_diff("MICROSECOND", F.col("first"), F.col(c)) / step
    rows = observations.where("not is_duplicate").join(span, "patient_id")
    rows = rows.withColumn("lo", F.greatest(F.lit(0).cast("long"), F.ceil(place("event_time")))).withColumn("hi", F.least(F.ceil(place("available_time")) - 1, F.floor(place("end_time"))))
    ticks = rows.where("lo <= hi").withColumn("k", F.explode(F.sequence("lo", "hi")))
    return ticks.withColumn("t", F.expr(_from("first", f"k * {p.cadence_h}"))).select("patient_id", "t", *[c for c in observations.columns if c != "patient_id"])


class CausalityError(AssertionError):
    """A snapshot holds what was not known at its instant."""


def assert_causal(*parts: DataFrame) -> None:
    """Raise if any of the snapshot's ``parts(patient_id, t, record_id, available_time, ...)`` has a row that became known after t."""
    late = [rows.where("available_time > t").select("patient_id", "t", "record_id", "available_time") for rows in parts]
    if found := reduce(DataFrame.unionByName, late).limit(3).collect():
        raise CausalityError(f"known only after the decision: {found}")


def facts_at(facts: DataFrame, instants: DataFrame) -> DataFrame:
    """Facts that were recorded by t.  They have no end, so a fact meets all later instants of its patient, and no cell of time parts it from one."""
    return meeting(facts, F.col("available_time"), F.lit(None).cast("timestamp_ntz"), instants.select("patient_id", "t"), 24)


def nearest(left: DataFrame, right: DataFrame, within_min: int) -> DataFrame:
    """For each row of ``left`` the nearest row in time of ``right`` of its patient, at most ``within_min`` away; the earlier of two.

    Rows are dealt to cells as wide as the tolerance, so a row meets only its own and the two cells beside it.
    """
    width = within_min * 60
    cell = lambda c: F.floor(seconds(F.col(c)) / width)
    near = right.select("patient_id", F.col("event_time").alias("other_time"), F.col("record_id").alias("other_id"), F.col("value_num").alias("other_value"))
    near = near.withColumn("cell", F.explode(F.array(cell("other_time") - 1, cell("other_time"), cell("other_time") + 1)))
    met = left.withColumn("cell", cell("event_time")).join(near, ["patient_id", "cell"])
    away = F.abs(F.timestamp_diff("MICROSECOND", F.col("event_time"), F.col("other_time")))
    best = F.min(F.struct(away.alias("away"), F.col("other_time"), F.col("other_id"), F.col("other_value"))).alias("best")
    return met.where(away <= width * 1_000_000).groupBy("patient_id", "record_id", "event_time").agg(best).select("patient_id", "record_id", "event_time", "best.*")
