"""From channel scores to one assessment per patient and instant: concordance, corroboration, rules, risk, confidence, priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.config import BANDS, Profile
from tideline.functions.scalars import percent, settled, text
from tideline.operators import rules

KEY = ["patient_id", "t"]


def combined(channels: DataFrame, p: Profile, samples: bool = False) -> DataFrame:
    """Per instant: the channels in order (with their ``samples``, if wanted), concordant count, weighted sum, and what rules and confidence need."""
    live = F.col("score") > 0
    one = F.struct("place", "variable_code", "score", "weight", "persistence", "coverage", "level", "slope", "n_evidence", "n_baseline", "centre", "scale", "latest", *["evidence"] * samples)
    rows = channels.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(one)).alias("channels"),
        F.count_if(F.col("score") >= p.concordant_from).alias("k"),
        F.max(F.when(live, F.col("persistence"))).alias("persistence_max"),
        F.sum("bad").alias("bad"),
        F.sum("n_evidence").alias("good"),
        F.max("newest").alias("newest"),
    )
    total = lambda expr: F.aggregate("channels", F.lit(0.0), lambda s, c: s + expr(c))
    rows = rows.withColumn("weighted", total(lambda c: c["weight"] * c["score"])).withColumn("score_sum", total(lambda c: c["score"]))
    rows = rows.withColumn("lead_score", total(lambda c: F.when(c["variable_code"] == p.lead_channel, c["score"]).otherwise(0.0)))
    rows = rows.withColumn("coverage", total(lambda c: c["coverage"]) / F.size("channels"))
    alive = F.filter("channels", lambda c: c["score"] > 0)
    of = F.when(F.size(alive) > 0, alive).otherwise(F.col("channels"))
    return rows.withColumn("live_coverage", F.aggregate(of, F.lit(0.0), lambda s, c: s + c["coverage"]) / F.size(of))


def out_of_range(value: Column, low: Column, high: Column) -> Column:
    """Whether a value lies outside its reference range; false where either bound is missing."""
    return F.coalesce(low.isNotNull() & high.isNotNull() & ((value < low) | (value > high)), F.lit(False))


def labs(visible: DataFrame, p: Profile) -> DataFrame:
    """The latest usable value of each laboratory variable within its window (of equal times the least record_id), and whether it is out of range.

    Each row's own ``ref_low`` and ``ref_high`` hold; the profile's bounds, if any, stand in for those that a row lacks.
    """
    bounds = F.create_map(*[x for code, low, high in p.labs for x in (F.lit(code), F.struct(F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high")))])
    own = lambda c: F.col(c) if c in visible.columns else F.lit(None).cast("double")
    recent = visible.where(F.col("variable_code").isin([code for code, *_ in p.labs])).where("is_plausible and value_num is not null")
    recent = recent.where(F.expr(f"event_time >= t - make_dt_interval(0, {p.lab_h})")).withColumn("low", own("ref_low")).withColumn("high", own("ref_high"))
    early = -F.unix_micros(F.col("event_time").cast("timestamp"))
    latest = F.min(F.struct(early.alias("early"), "record_id", "source_file", "value_num", "event_time", "available_time", "low", "high")).alias("lab")
    rows = recent.groupBy(*KEY, "variable_code", "stretch").agg(latest)  # as the rows are dealt, so without another exchange
    bound = F.element_at(bounds, F.col("variable_code")) if p.labs else F.lit(None).cast("struct<low:double,high:double>")
    abnormal = out_of_range(F.col("lab.value_num"), F.coalesce("lab.low", bound["low"]), F.coalesce("lab.high", bound["high"]))
    return rows.select(*KEY, "variable_code", *[f"lab.{c}" for c in ("record_id", "source_file", "value_num", "event_time", "available_time")], abnormal.alias("abnormal"))


def priority(p: Profile) -> Column:
    risk, k, persistence, coverage = p.critical
    critical = (F.col("risk") >= risk) & (F.col("k") >= k) & (F.coalesce("persistence_max", F.lit(0.0)) >= persistence) & (F.col("coverage") >= coverage) & ~rules.holding(p)
    return F.when(critical, "CRITICAL").when((F.col("risk") >= p.high[0]) & (F.col("k") >= p.high[1]), "HIGH").when(F.col("risk") >= p.medium, "MEDIUM").otherwise("LOW")


def band_of(priority_: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(b) for b in BANDS]), priority_) - 1).cast("int")


def band_by_risk(risk: Column, p: Profile) -> Column:
    """The band that risk alone gives, without gates."""
    return F.when(risk >= p.critical[0], 3).when(risk >= p.high[0], 2).when(risk >= p.medium, 1).otherwise(0)


def assess(channels: DataFrame, labs_: DataFrame, measures: dict[str, DataFrame], p: Profile, samples: bool = False, instants: DataFrame | None = None) -> DataFrame:
    """One row per instant with a participating channel, weighed by the profile's rules from their ``measures``; with ``samples``, each channel keeps those of its evidence.

    With ``instants(patient_id, t)`` there is a row for each of them; where no channel takes part, its channels are empty, and risk and confidence 0.
    """
    counted = labs_.groupBy(*KEY).agg(F.least(F.count_if("abnormal"), F.lit(p.lab_most)).alias("lab_n"))
    rows = combined(channels, p, samples)
    if instants is not None:
        nothing = {c: 0 for c in ("k", "bad", "good")} | {c: 0.0 for c in ("weighted", "score_sum", "lead_score", "coverage")}
        rows = instants.select(*KEY).join(rows, KEY, "left").na.fill(nothing).withColumn("channels", F.coalesce("channels", F.array().cast(rows.schema["channels"].dataType)))
    rows = rows.join(counted, KEY, "left").na.fill({"lab_n": 0})
    if p.use_concordance:
        steps = F.array(F.lit(0.0), *[F.lit(c) for c in p.concordance])
        factor = F.coalesce(F.get(steps, F.col("k").cast("int")), F.lit(p.concordance[-1]))
    else:
        factor = F.when(F.col("k") > 0, 1.0).otherwise(0.0)
    lab = F.col("lab_n") * p.lab_weight
    rows = rows.withColumn("multisource", lab).withColumn("raw", F.col("weighted") * factor + F.when(F.col("k") >= 1, lab).otherwise(0.0))
    rows = rules.applied(rows, measures, p).withColumn("final", F.aggregate("rules", F.col("raw"), lambda s, r: s * (1 - r["strength"])))
    rows = rows.withColumn("risk", F.when(F.col("final") > 0, 1 - F.exp(-F.col("final") / p.k0)).otherwise(0.0))
    age = F.timestamp_diff("MICROSECOND", F.col("newest"), F.col("t")) / 6e7
    fresh = F.greatest(F.lit(0.3), F.least(F.lit(1.0), 1 - age / p.fresh_min))
    sound = F.try_divide(F.col("good"), F.col("good") + F.col("bad"))
    rows = rows.withColumn("confidence", F.when(F.size("channels") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("coverage") * sound * fresh))).otherwise(0.0))
    return settled(rows.withColumn("priority", priority(p)).withColumn("band", band_of(F.col("priority"))))


def explanation(p: Profile) -> Column:
    """What was found and why, from the numbers of the assessment alone: top channels, laboratories, each rule with its grounds, and totals."""
    number = lambda c, n: F.format_number(c, n)
    ranked = F.expr("array_sort(filter(channels, c -> c.score > 0), (a, b) -> case when a.score > b.score then -1 when a.score < b.score then 1 else a.place - b.place end)")
    tops = F.array_join(F.transform(F.slice(ranked, 1, 4), lambda c: text(c["variable_code"], " level ", number(c["level"], 1), " drift ", number(c["slope"], 1), " persistence ", percent(c["persistence"]))), ", ")
    nothing = text(f"no deviation in {p.evidence_h} hours over ", F.size("channels").cast("string"), " channels")
    found = text(F.col("k").cast("string"), " of ", F.size("channels").cast("string"), f" channels concordant in {p.evidence_h} hours: ", tops)
    parts = F.array(F.when(F.col("lab_n") > 0, text(F.col("lab_n").cast("string"), " laboratories out of range")))
    totals = text("risk ", number(F.col("risk"), 2), ", confidence ", number(F.col("confidence"), 2), ", priority ", F.col("priority"))
    whole = F.concat_ws(". ", F.array(found), F.array_compact(parts), rules.said(p), F.array(totals))
    return F.when(F.size(ranked) == 0, nothing).otherwise(whole)
