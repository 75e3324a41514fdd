"""From staged text to clean observations: types, units, plausibility, rejection, availability, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import blank_to_null, parse_date, parse_number, parse_time, settled, small, tasks
from tideline.operators.asof import meeting

RETRANSMIT = "RETRANSMIT"


def typed(staged: DataFrame, units: DataFrame, variables: DataFrame) -> DataFrame:
    """Parsed columns beside the text, with ``reject_reason``: the first that holds, null for rows that load.

    Catalogues are keyed by code and broadcast after a count of their rows, so that no observation moves for them; one that is too large is
    joined by a shuffle.
    """
    value = blank_to_null(F.col("value"))
    rows = staged.join(small(units), staged["unit"] == F.col("unit_code"), "left").join(small(variables), "variable_code", "left")
    rows = rows.withColumn("et", parse_time(F.col("event_time"))).withColumn("av", parse_time(F.col("available_time"))).withColumn("number", parse_number(value)).withColumn("value_given", value)
    reason = (
        F.when(blank_to_null(F.col("record_id")).isNull(), "NO_RECORD_ID")
        .when(blank_to_null(F.col("patient_id")).isNull(), "NO_PATIENT")
        .when(F.col("et").isNull(), "BAD_EVENT_TIME")
        .when(F.col("av").isNull(), "BAD_AVAILABLE_TIME")
        .when(F.col("av") < F.col("et"), "TIME_ORDER")
        .when(blank_to_null(F.col("unit")).isNotNull() & F.col("unit_code").isNull(), "UNIT_UNKNOWN")
        .when(value.isNull(), "NO_VALUE")
    )
    return settled(rows.withColumn("reject_reason", reason), "reject_reason")


def canonical(number: str = "number") -> Column:
    """The value in its canonical unit; null where the value or the factor is missing."""
    return F.col(number) * F.col("factor") + F.coalesce("unit_offset", F.lit(0.0))


def plausible(value: Column) -> Column:
    """True for values that are no numbers and where a bound is missing, else whether the value lies within the bounds."""
    open_ = value.isNull() | F.col("plausible_min").isNull() | F.col("plausible_max").isNull()
    return F.when(open_, True).otherwise(value.between(F.col("plausible_min"), F.col("plausible_max")))


def accepted(rows: DataFrame) -> DataFrame:
    """Observations of ``typed`` rows without a reject reason."""
    value = canonical()
    return rows.where("reject_reason is null").select(
        "source_file", "record_id", "domain", "patient_id", blank_to_null(F.col("device_id")).alias("device_id"), "variable_code",
        F.col("et").alias("event_time"), F.col("av").alias("available_time"), value.alias("value_num"),
        F.when(F.col("number").isNull(), F.col("value_given")).alias("value_text"), F.col("number").alias("value_raw"), F.col("unit").alias("unit_raw"),
        blank_to_null(F.col("quality_flag")).alias("quality_flag"), F.col("source_system"), plausible(value).alias("is_plausible"),
        F.coalesce(F.col("source_system") == RETRANSMIT, F.lit(False)).alias("is_retransmit"),
        parse_number(blank_to_null(F.col("ref_low"))).alias("ref_low"), parse_number(blank_to_null(F.col("ref_high"))).alias("ref_high"),
    )


def quarantined(rows: DataFrame) -> DataFrame:
    """Rejected rows with reason and detail."""
    shown = lambda name, c: F.concat(F.lit(f"{name}="), F.coalesce(c, F.lit("<null>")))
    detail = F.concat_ws(" | ", shown("event", F.col("event_time")), shown("available", F.col("available_time")), shown("value", F.col("value")), shown("unit", F.col("unit")))
    return rows.where("reject_reason is not null").select("source_file", "record_id", "patient_id", "reject_reason", detail.alias("detail"))


def valid_intervals(raw: DataFrame, extras: tuple[str, ...] = ("delayed_records",)) -> DataFrame:
    """Typed intervals with ``reject_reason`` and the ``extras`` as JSON, nulls kept.  Without an available_time they are known from their start."""
    given = set(raw.columns)
    raw = raw.withColumn("_start", parse_time(F.col("start_time"))).withColumn("_end", parse_time(F.col("end_time")))
    raw = raw.withColumn("_known", parse_time(F.col("available_time")) if "available_time" in given else F.col("_start"))
    start, end, known = F.col("_start"), F.col("_end"), F.col("_known")
    reason = (
        F.when(blank_to_null(F.col("record_id")).isNull(), "NO_RECORD_ID")
        .when(blank_to_null(F.col("patient_id")).isNull(), "NO_PATIENT")
        .when(start.isNull(), "BAD_EVENT_TIME")
        .when(known.isNull(), "BAD_AVAILABLE_TIME")
        .when(end.isNull() | (end < start), "TIME_ORDER")
    )
    extra = F.to_json(F.struct(*extras), {"ignoreNullFields": "false"}) if extras else F.lit(None).cast("string")
    source = [c for c in ("source_file", "device_id") if c in given]
    rows = raw.select(
        *source, "record_id", "patient_id", "kind", "subtype", "value_text", start.alias("start_time"), end.alias("end_time"), known.alias("available_time"),
        *[parse_number(F.col("confidence")).alias("confidence")] * ("confidence" in given), extra.alias("extra_json"), reason.alias("reject_reason"),
    )
    return settled(rows, "reject_reason")


def quarantined_as(rows: DataFrame, detail: str) -> DataFrame:
    """Rejected intervals or facts in the layout of the quarantine."""
    source = F.col("source_file") if "source_file" in rows.columns else F.lit(None).cast("string")
    return rows.where("reject_reason is not null").select(source.alias("source_file"), "record_id", "patient_id", "reject_reason", F.lit(detail).alias("detail"))


def valid_facts(raw: DataFrame) -> DataFrame:
    """Typed facts ``(source_file, record_id, patient_id, category, onset, available_time, status, severity, source_system)`` with ``reject_reason``.

    A fact counts from its recording, whatever its onset; one whose recording cannot be read is rejected.
    """
    raw, known = raw.withColumn("_known", parse_time(F.col("available_time"))), F.col("_known")
    reason = F.when(blank_to_null(F.col("record_id")).isNull(), "NO_RECORD_ID").when(blank_to_null(F.col("patient_id")).isNull(), "NO_PATIENT").when(known.isNull(), "BAD_AVAILABLE_TIME")
    rows = raw.select("source_file", "record_id", "patient_id", "category", parse_date(F.col("onset")).alias("onset_date"), known.alias("available_time"), "status", "severity", "source_system", reason.alias("reject_reason"))
    return settled(rows, "reject_reason")


def resolve_availability(observations: DataFrame, intervals: DataFrame) -> DataFrame:
    """Retransmitted rows are known when the latest connectivity interval around them ends; without one, nobody knows when.

    Only retransmitted rows meet the intervals, by cells of time; the rest never leaves its place.
    """
    sent = observations.where("is_retransmit")
    links = intervals.where("kind = 'CONNECTIVITY'").select("patient_id", F.col("start_time").alias("from_time"), F.col("end_time").alias("to_time"))
    ends = meeting(links, F.col("from_time"), F.col("to_time"), sent.select("patient_id", "source_file", "record_id", "event_time"), 24, at="event_time").groupBy("source_file", "record_id").agg(F.max("to_time").alias("link_end"))
    fixed = sent.join(ends, ["source_file", "record_id"], "left").withColumn("is_availability_known", F.col("link_end").isNotNull())
    fixed = fixed.withColumn("available_time", F.greatest("available_time", "link_end")).drop("link_end")
    return observations.where("not is_retransmit").withColumn("is_availability_known", F.lit(True)).unionByName(fixed)


def mark_duplicates(observations: DataFrame) -> DataFrame:
    """All but the first known of equal (patient, variable, event time) are duplicates, whatever their source."""
    key = ("patient_id", "variable_code", "event_time")
    w = Window.partitionBy(*key).orderBy("available_time", "is_retransmit", "record_id")
    return observations.repartition(tasks(observations), *key).withColumn("is_duplicate", F.row_number().over(w) > 1)


def clean(staged: DataFrame, units: DataFrame, variables: DataFrame, intervals: DataFrame) -> DataFrame:
    """Observations; availability is resolved before duplicates are told apart, as the order of the two matters."""
    return mark_duplicates(resolve_availability(accepted(typed(staged, units, variables)), intervals))
