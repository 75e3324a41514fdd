"""Assessments folded into events, and the history of one entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.config import Profile
from tideline.functions.scalars import seconds
from tideline.operators.assess import band_by_risk
from tideline.sources.stored import stored

#: One step of the fold.  It never looks at more than the state and one assessment, so it needs no Python.
_STEP = """(s, a) -> case
  when a.band >= {floor} then named_struct(
    'band', greatest(s.band, a.band), 'n', s.n + 1,
    'last', if({emit}, a.t, s.last), 'risk', if({emit}, a.risk, s.risk),
    'out', if({emit}, array_append(s.out, named_struct('at', s.n, 'demoted', false)), s.out))
  else named_struct(
    'band', a.band, 'n', s.n + 1,
    'last', if({demoted}, a.t, s.last), 'risk', if({demoted}, a.risk, s.risk),
    'out', if({demoted}, array_append(s.out, named_struct('at', s.n, 'demoted', true)), s.out)) end"""


def _fold(p: Profile) -> str:
    rested = f"timestampdiff(MICROSECOND, s.last, a.t) >= {p.refractory_h * 3_600_000_000}"
    emit = f"(a.band > s.band or (a.band = s.band and s.last is not null and {rested} and a.risk - s.risk >= {p.re_emit}D))"
    demoted = f"(a.noted and a.raw > 0 and a.raw_band > a.band and a.raw_band >= {p.floor_band} and (s.last is null or {rested}))"
    start = "named_struct('band', 0, 'n', 0, 'last', cast(null as timestamp_ntz), 'risk', 0.0D, 'out', cast(array() as array<struct<at:int,demoted:boolean>>))"
    return f"aggregate(steps, {start}, {_STEP.format(floor=p.floor_band, emit=emit, demoted=demoted)}).out"


def _courses(steps: DataFrame, p: Profile) -> DataFrame:
    """``steps`` with ``course``: when the last rise from below the lowest emitted band was, null before the first.

    Such a rise is emitted whatever came before and is all that the fold remembers then, so courses are folded on their own.
    """
    calm_before = F.coalesce(F.lag("band").over(Window.partitionBy("patient_id").orderBy("t")) < p.floor_band, F.lit(True))
    rows = steps.withColumn("rise", F.when((F.col("band") >= p.floor_band) & calm_before, F.col("t")))
    upto = Window.partitionBy("patient_id").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("course", F.last("rise", True).over(upto)).drop("rise")


def _courses_in_blocks(steps: DataFrame, p: Profile, block_h: int) -> DataFrame:
    """The same where an entity's steps are dealt out to blocks of time: a row a block tells the next ones its last band and its last rise."""
    rows = stored(steps.withColumn("block", F.floor(seconds(F.col("t")) / (block_h * 3600))), "steps")
    own = Window.partitionBy("patient_id", "block").orderBy("t")
    before = Window.partitionBy("patient_id").orderBy("block")
    ends = rows.groupBy("patient_id", "block").agg(F.max_by("band", "t").alias("end_band")).withColumn("band_before", F.lag("end_band").over(before)).drop("end_band")
    calm_before = F.coalesce(F.coalesce(F.lag("band").over(own), F.col("band_before")) < p.floor_band, F.lit(True))
    marked = rows.join(ends, ["patient_id", "block"]).withColumn("rise", F.when((F.col("band") >= p.floor_band) & calm_before, F.col("t")))
    rises = marked.groupBy("patient_id", "block").agg(F.max("rise").alias("last_rise"))
    rises = rises.withColumn("rise_before", F.last("last_rise", True).over(before.rowsBetween(Window.unboundedPreceding, -1))).drop("last_rise")
    within = F.last("rise", True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.join(rises, ["patient_id", "block"]).withColumn("course", F.coalesce(within, F.col("rise_before"))).drop("rise", "rise_before", "band_before", "block")


def eventize(assessments: DataFrame, p: Profile, block_h: int | None = None) -> DataFrame:
    """The assessments that are emitted, with ``demoted``.

    An entity's assessments are folded in time order: a rise of band is emitted at once, an unchanged band only after
    the refractory time and a rise of risk; a low one whose score without rules would have had a higher band than its own is emitted as
    demoted, after the refractory time.  Rows are carried through the fold, so pass only the columns that are wanted.

    The fold starts anew with each rise from calm, and rows that can neither be emitted nor change what is (calm ones without a rule that lowered
    them, those below the highest band of their course) never enter it: an array holds the rest of one course.  With ``block_h`` even the
    search for rises is spread over blocks of so many hours, for entities whose assessments are too many for one task.
    """
    raw_risk = F.when(F.col("raw") > 0, 1 - F.exp(-F.col("raw") / p.k0)).otherwise(0.0)
    rest = [c for c in assessments.columns if c not in ("patient_id", "t", "band", "risk", "raw")]
    steps = assessments.select("patient_id", "t", "band", "risk", "raw", (F.size("rules") > 0).alias("noted"), band_by_risk(raw_risk, p).alias("raw_band"), F.struct(*rest).alias("rest"))
    steps = _courses(steps, p) if block_h is None else _courses_in_blocks(steps, p, block_h)
    highest = F.max("band").over(Window.partitionBy("patient_id", "course").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lowered = F.col("noted") & (F.col("raw") > 0) & (F.col("raw_band") > F.col("band")) & (F.col("raw_band") >= p.floor_band)
    kept = steps.withColumn("highest", highest).where(F.when(F.col("band") >= p.floor_band, F.col("band") == F.col("highest")).otherwise(lowered))
    step = F.struct("t", "band", "risk", "raw", "noted", "raw_band", "rest")
    folded = kept.groupBy("patient_id", "course").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    emitted = folded.select("patient_id", F.explode(F.expr(f"transform({_fold(p)}, e -> named_struct('a', steps[e.at], 'demoted', e.demoted))")).alias("e"))
    return emitted.select("patient_id", "e.a.t", "e.a.band", "e.a.risk", "e.a.raw", "e.a.rest.*", "e.demoted")


def signal_id(prefix: str = "HS"):
    return F.concat(F.lit(f"{prefix}-"), F.regexp_replace("patient_id", "^PAT-", ""), F.lit("-"), F.date_format("t", "yyyyMMdd'T'HHmm"))


def transitions(assessments: DataFrame) -> DataFrame:
    """The instants whose priority is not that of the instant before."""
    before = F.lag("priority").over(Window.partitionBy("patient_id").orderBy("t"))
    return assessments.withColumn("before", before).where("before is null or before <> priority").drop("before")


def history(assessments: DataFrame, grid: DataFrame) -> DataFrame:
    """Per patient: the peak by (priority, risk, time), counts by priority, instants without a baseline, and the first that had one."""
    peak = F.max(F.struct("band", "risk", "t", "priority")).alias("peak")
    counts = [F.count_if(F.col("priority") == b).alias(f"n_{b.lower()}") for b in ("LOW", "MEDIUM", "HIGH", "CRITICAL")]
    seen = assessments.groupBy("patient_id").agg(peak, *counts, F.count("*").alias("evaluable"), F.min("t").alias("first_evaluable"))
    asked = grid.groupBy("patient_id").agg(F.count("*").alias("asked"), F.max("t").alias("last_t"))
    return asked.join(seen, "patient_id", "left").withColumn("skipped", F.col("asked") - F.coalesce("evaluable", F.lit(0)))


def percentile_by_index(df: DataFrame, column: str, share: float) -> DataFrame:
    """The value at index int(n * share) of the sorted column: nearest rank, no interpolation; null of no values.

    Distinct values are dealt out by range; the sizes of the ranges (a row a task) tell which one holds the index, and only that one is sorted.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    dealt = stored(counts.repartitionByRange(column).withColumn("part", F.spark_partition_id()), "values")
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = dealt.groupBy("part").agg(F.sum("n").alias("size")).withColumn("upto", F.sum("size").over(along)).withColumn("all", F.sum("size").over(Window.partitionBy(F.lit(1))))
    at = F.least(F.floor(F.col("all") * share), F.col("all") - 1)
    held = sizes.where((F.col("upto") - F.col("size") <= at) & (at < F.col("upto"))).select("part", (at - F.col("upto") + F.col("size")).alias("skip"))
    within = Window.partitionBy("part").orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.join(F.broadcast(held), "part").withColumn("seen", F.sum("n").over(within))  # one row is broadcast
    return seen.where("seen > skip").agg(F.min(column).alias(column))
