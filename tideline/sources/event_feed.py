"""The ``events`` table as two text feeds with the faults that real feeds have, by rule.

Feed ``monitor`` holds even event ids, feed ``wearable`` odd ones, each under names of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalars import literal_table
from tideline.sources.adapters import Adapter, stage

MONITOR = Adapter("monitor", "VITAL", {"record_id": "observation_id", "patient_id": "patient_id", "device_id": "device_id", "event_time": "timestamp", "available_time": "known_at", "variable_code": "variable_code", "value": "value", "unit": "unit", "quality_flag": "quality_flag", "source_system": "source_system", "ref_low": "low", "ref_high": "high"})
WEARABLE = Adapter("wearable", "WEARABLE", {"record_id": "sample_id", "patient_id": "wearer", "event_time": "measured_at", "available_time": "synced_at", "variable_code": "metric", "value": "reading", "unit": "unit", "quality_flag": "measurement_quality", "source_system": "gateway", "ref_low": "range_from", "ref_high": "range_to"})
#: unit_code, factor, offset
UNITS = (("raw", 1.0, 0.0), ("x10", 0.1, 0.0), ("shift", 1.0, 5.0))
#: variable_code, plausible from, to
VARIABLES = (("click", 0.0, 224.0), ("error", 0.0, 224.0), ("purchase", 0.0, 224.0), ("signup", 0.0, 224.0), ("view", 0.0, None))


def _text(events: DataFrame) -> DataFrame:
    """The faults of the feed, by event id; times to the hour."""
    return events.selectExpr(
        "event_id AS e",
        "if(event_id % 199 = 0, '', cast(event_id as string)) AS record_id",
        "if(event_id % 211 = 0, '', concat('U', cast(user_id as string))) AS patient_id",
        "if(event_id % 223 = 0, 'soon', date_format(date_trunc('HOUR', ts), 'yyyy-MM-dd HH:mm:ss')) AS event_time",
        """case when event_id % 229 = 0 then 'later' when event_id % 227 = 0 then date_format(date_trunc('HOUR', ts) - make_dt_interval(0, 1), 'yyyy-MM-dd HH:mm:ss')
           else date_format(date_trunc('HOUR', ts) + make_dt_interval(0, 0, cast((event_id * 7) % 31 as int)), 'yyyy-MM-dd HH:mm:ss') end AS available_time""",
        "event_type AS variable_code",
        """case when event_id % 233 = 0 then '' when event_id % 31 = 0 then 'LOW' when event_id % 5 = 0 then cast(cast(value * 10 as decimal(18,4)) as string)
           when event_id % 5 = 1 then cast(cast(value - 5 as decimal(18,4)) as string) else cast(cast(value as decimal(18,4)) as string) end AS value""",
        "case when event_id % 239 = 0 then 'zz' when event_id % 5 = 0 then 'x10' when event_id % 5 = 1 then 'shift' else 'raw' end AS unit",
        "if(event_id % 37 = 0, 'LOW_SIGNAL', 'OK') AS quality_flag",
        "if(event_id % 41 = 0, 'RETRANSMIT', 'DIRECT') AS source_system",
        "if(event_type in ('signup', 'view') and event_id % 7 <> 0, cast(event_id % 4 + 3 as string), null) AS ref_low",
        "if(event_type in ('signup', 'view') and event_id % 13 <> 0, cast(event_id % 11 + 75 as string), null) AS ref_high",
    )


def feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Both feeds under their own column names."""
    rows = _text(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("device_id", F.lit("D1"))
    parts = ((MONITOR, "e % 2 = 0"), (WEARABLE, "e % 2 = 1"))
    return {a.source_file: rows.where(part).select(*[F.col(f).alias(c) for f, c in a.columns.items()]) for a, part in parts}


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(feeds(spark, sf_dir), [MONITOR, WEARABLE])


def units(spark: SparkSession) -> DataFrame:
    return literal_table(spark, list(UNITS), "unit_code string, factor double, unit_offset double")


def variables(spark: SparkSession) -> DataFrame:
    return literal_table(spark, list(VARIABLES), "variable_code string, plausible_min double, plausible_max double")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases open six hours of activity, errors six hours of bad connection, as text; some intervals are broken."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type in ('purchase', 'error')")
    return events.selectExpr(
        "cast(event_id as string) AS record_id",
        "concat('U', cast(user_id as string)) AS patient_id",
        "if(event_type = 'purchase', 'CONTEXT', 'CONNECTIVITY') AS kind",
        "case when event_type = 'error' then 'LINK_LOSS' when event_id % 4 = 0 then 'RECOVERY_PHASE' else 'PHYSICAL_ACTIVITY' end AS subtype",
        "element_at(array('LOW', 'MODERATE', 'HIGH'), cast(event_id % 3 + 1 as int)) AS value_text",
        "if(event_id % 223 = 0, 'soon', date_format(date_trunc('HOUR', ts), 'yyyy-MM-dd HH:mm:ss')) AS start_time",
        "date_format(date_trunc('HOUR', ts) + make_dt_interval(0, if(event_id % 53 = 0, -1, 6)), 'yyyy-MM-dd HH:mm:ss') AS end_time",
        "get_json_object(props, '$.k') AS delayed_records",
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as facts about the patients of their number, as text: some without a readable recording, some recorded within the study."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "'customers' AS source_file",
        "concat('F', cast(c_custkey as string)) AS record_id",
        "concat('U', cast(c_custkey as string)) AS patient_id",
        "c_mktsegment AS category",
        "'2020-01-01' AS onset",
        "case when c_custkey % 17 = 0 then 'unknown' else concat('2024-01-', lpad(cast(c_custkey % 28 + 1 as string), 2, '0'), ' 00:00:00') end AS available_time",
        "'ACTIVE' AS status",
        "cast(null as string) AS severity",
        "'EHR' AS source_system",
    )
