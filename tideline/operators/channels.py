"""Robust statistics of a channel against its own baseline, and the channel's score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.config import Profile
from tideline.functions.scalars import deviation_sql, literal_table, median_sql, seconds, settled
from tideline.operators.asof import ticked
from tideline.operators.ranges import quantiles
from tideline.operators.slopes import with_slopes

MAD_TO_SIGMA = 1.4826


def channel_table(spark, p: Profile) -> DataFrame:
    rows = [(c.code, i, c.direction, c.weight, c.floor, float(p.baseline_least(c)), float(p.evidence_least(c)), float(p.expected(c, p.evidence_h)), p.streak_goal(c)) for i, c in enumerate(p.channels)]
    return literal_table(spark, rows, "variable_code string, place int, direction int, weight double, floor double, baseline_least double, evidence_least double, evidence_expected double, streak_goal int")


def windows(visible: DataFrame, p: Profile) -> DataFrame:
    """Per (patient_id, t, channel): sorted evidence samples, sorted baseline values, and counts of bad samples.

    Both windows are closed, so a sample on their common border is in both.
    """
    border = F.expr(f"t - make_dt_interval(0, {p.evidence_h})")
    start = F.expr(f"t - make_dt_interval(0, {p.evidence_h + p.baseline_h})")
    usable = F.col("is_plausible") & F.col("value_num").isNotNull()
    in_evidence, in_baseline = F.col("event_time") >= border, (F.col("event_time") <= border) & (F.col("event_time") >= start)
    sample = F.struct("event_time", "record_id", F.col("value_num").alias("value"), "available_time", "source_file")
    codes = [c.code for c in p.channels]
    return (
        visible.where(F.col("variable_code").isin(codes))
        .groupBy("patient_id", "variable_code", "stretch", "t")
        .agg(
            F.sort_array(F.collect_list(F.when(usable & in_evidence, sample))).alias("evidence"),
            F.sort_array(F.collect_list(F.when(usable & in_baseline, F.col("value_num")))).alias("baseline"),
            F.count_if(in_evidence & ~F.col("is_plausible")).alias("bad"),
        )
    )


_SAMPLE = "named_struct('event_time', s.event_time, 'record_id', s.record_id, 'value', s.value, 'available_time', s.available_time, 'source_file', s.source_file)"


def grid_windows(rows: DataFrame, p: Profile, lookback_h: int) -> DataFrame:
    """``windows`` at every instant of a grid, from rows as ``asof.dealt`` gives them.

    A stretch's samples are collected once, in order of time, and once more in order of value.  The numbers of the instants that have a sample in either
    window follow from its time by arithmetic, once a sample.  Each instant cuts its windows out of the two by these numbers: a part of a sorted
    array is sorted, so no window is collected or sorted anew, and no time is compared or copied sample by sample.
    """
    place = lambda hours: (F.col("since") + hours * 3_600_000_000) / (p.cadence_h * 3.6e9)
    border, start = place(p.evidence_h), place(p.evidence_h + p.baseline_h)
    rows = rows.where(F.col("variable_code").isin([c.code for c in p.channels]))
    rows = rows.withColumn("upto", F.least("hi", F.floor(border))).withColumn("base_lo", F.greatest("lo", F.ceil(border))).withColumn("base_hi", F.least("hi", F.floor(start)))
    sample = F.struct("event_time", "record_id", F.col("value_num").alias("value"), "available_time", "source_file", (F.col("is_plausible") & F.col("value_num").isNotNull()).alias("usable"), F.col("is_plausible").alias("plausible"), "lo", "upto", "base_lo", "base_hi")
    found = rows.groupBy("patient_id", "variable_code", "stretch").agg(F.sort_array(F.collect_list(sample)).alias("samples"), F.first("first").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = found.withColumn("used", F.expr("filter(samples, s -> s.usable)")).withColumn("bad", F.expr("filter(samples, s -> not s.plausible)"))
    found = found.withColumn("by_value", F.expr("sort_array(transform(used, s -> named_struct('value', s.value, 'lo', s.base_lo, 'hi', s.base_hi)))"))
    found = found.select(
        "patient_id", "variable_code", "stretch", "first", "lo", "hi",
        F.expr(f"transform(used, s -> {_SAMPLE})").alias("samples"), F.col("used.lo").alias("from_k"), F.col("used.upto").alias("to_k"),
        F.col("by_value.value").alias("values"), F.col("by_value.lo").alias("base_from"), F.col("by_value.hi").alias("base_to"), F.col("bad.lo").alias("bad_from"), F.col("bad.upto").alias("bad_to"),
    )
    within = lambda lo, hi: f"(s, i) -> {lo}[i] <= k and k <= {hi}[i]"
    return ticked(settled(found), p, lookback_h).select(
        "patient_id", "variable_code", "stretch", "t",
        F.expr(f"filter(samples, {within('from_k', 'to_k')})").alias("evidence"),
        F.expr(f"filter(values, {within('base_from', 'base_to')})").alias("baseline"),
        F.expr(f"cast(size(filter(bad_from, {within('bad_from', 'bad_to')})) as bigint)").alias("bad"),
    )


#: Samples that a channel's window may hold by its nominal rate for its slopes to be listed pair by pair; beyond, their median is selected.
LISTED_SAMPLES = 256
_SLOPES = """sort_array(flatten(transform(sequence(1, n_evidence - 1), i -> transform(filter(sequence(i + 1, n_evidence), j -> hours[j - 1] <> hours[i - 1]),
  j -> (z[j - 1] - z[i - 1]) / (hours[j - 1] - hours[i - 1])))))"""
_STREAK = "aggregate(z, named_struct('now', 0, 'best', 0), (s, x) -> named_struct('now', if(x > {above}, s.now + 1, 0), 'best', greatest(s.best, if(x > {above}, s.now + 1, 0)))).best"


def with_slope(rows: DataFrame, p: Profile) -> DataFrame:
    """``rows(hours, z, n_evidence)`` with ``slope`` over the evidence window: the median over all pairs of samples, 0 for too few of them.

    The pairs of a channel with up to LISTED_SAMPLES samples a window are an array; those of denser channels are never listed (``slopes``).
    """
    dense = [c.code for c in p.channels if p.expected(c, p.evidence_h) > LISTED_SAMPLES]
    listed = rows.where(~F.col("variable_code").isin(dense)) if dense else rows
    listed = listed.withColumn("slopes", F.expr(f"if(n_evidence >= {max(2, p.slope_samples)}, {_SLOPES}, cast(array() as array<double>))"))
    out = listed.withColumn("slope", F.coalesce(F.expr(median_sql("slopes")), F.lit(0.0))).drop("slopes")
    if dense:
        some = rows.where(F.col("variable_code").isin(dense))
        out = out.unionByName(some.mapInArrow(with_slopes(p.slope_samples), T.StructType([*some.schema.fields, T.StructField("slope", T.DoubleType())])))
    return out.withColumn("slope", F.col("slope") * float(p.evidence_h))


def statistics(window: DataFrame, p: Profile) -> DataFrame:
    """Participating channels with centre, scale, z, level, slope and longest streak: what no switch of the profile changes."""
    rows = window.join(F.broadcast(channel_table(window.sparkSession, p)), "variable_code")
    rows = rows.withColumn("n_evidence", F.size("evidence")).withColumn("n_baseline", F.size("baseline"))
    rows = rows.where("n_baseline >= baseline_least and n_evidence >= evidence_least")
    rows = rows.withColumn("centre", F.expr(median_sql("baseline")))
    rows = rows.withColumn("scale", F.greatest(F.expr(deviation_sql("baseline", "centre")) * MAD_TO_SIGMA, "floor"))
    rows = rows.withColumn("z", F.expr("transform(evidence, e -> (e.value - centre) / scale * direction)"))
    hours = "transform(evidence, e -> timestampdiff(MICROSECOND, evidence[0].event_time, e.event_time) / 3.6e9D)"
    rows = rows.withColumn("hours", F.expr(f"if(n_evidence >= {p.slope_samples}, {hours}, cast(array() as array<double>))"))  # no slope is taken of fewer
    rows = rows.withColumn("tail", F.expr("sort_array(slice(z, -greatest(1, n_evidence div 3), greatest(1, n_evidence div 3)))"))
    rows = rows.withColumn("level", F.expr(median_sql("tail")))
    rows = with_slope(rows, p)
    rows = rows.withColumn("run", F.expr(_STREAK.format(above=f"{p.streak_above}D")).cast("int"))
    rows = rows.withColumn("coverage", F.least(F.lit(1.0), F.col("n_evidence") / F.col("evidence_expected")))
    rows = rows.withColumn("newest", F.array_max(F.transform("evidence", lambda e: e["available_time"]))).withColumn("latest", F.expr("evidence[n_evidence - 1].value"))
    return settled(rows.drop("tail", "hours"))


def scored(rows: DataFrame, p: Profile) -> DataFrame:
    """``statistics`` with streak, persistence and score, under the profile's switches."""
    rows = rows.withColumn("streak", F.col("run") if p.use_streak else F.col("n_evidence")).withColumn("persistence", F.least(F.lit(1.0), F.col("streak") / F.col("streak_goal")))
    ceiling = p.ceiling if p.use_ceiling else 1e9
    sloped = F.col("n_evidence") >= p.slope_samples
    raw = F.when(sloped, F.col("level") * p.level_weight + F.col("slope") * p.slope_weight).otherwise(F.col("level"))
    top = F.when(sloped, ceiling).otherwise(ceiling * p.no_slope_factor)
    return rows.withColumn("score", F.greatest(F.lit(0.0), F.least(raw * F.col("persistence"), top)))


def measured(window: DataFrame, p: Profile) -> DataFrame:
    """Participating channels with centre, scale, level, slope, streak, persistence, coverage and score."""
    return scored(statistics(window, p), p)


def dispersion_floors(observations: DataFrame, window_h: int = 24, least: int = 3, share: float = 0.05) -> DataFrame:
    """(variable_code, windows, floor): a low quantile, over all patients' windows of ``window_h`` hours, of the scale within a window.

    Windows with fewer than ``least`` values say nothing.  Medians come from counts of values dealt out by range, so no patient's or
    variable's values are gathered in one task.
    """
    window = F.floor(seconds(F.col("event_time")) / (window_h * 3600)).alias("window")
    rows = observations.where("is_plausible and value_num is not null").select("patient_id", "variable_code", window, "value_num")
    key = ("patient_id", "variable_code", "window")
    centres = quantiles(rows, key, "value_num", (0.5,), "centres").where(F.col("count") >= least).select(*key, F.col("q0").alias("centre"))
    away = rows.join(centres, list(key)).select(*key, F.abs(F.col("value_num") - F.col("centre")).alias("away"))
    scales = quantiles(away, key, "away", (0.5,), "scales").select("variable_code", (F.col("q0") * MAD_TO_SIGMA).alias("scale"))
    return quantiles(scales, ("variable_code",), "scale", (share,), "floors").select("variable_code", F.col("count").alias("windows"), F.col("q0").alias("floor"))
