"""What an ingestion report tells of the clean tables; every part is a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import iso
from tideline.operators.ranges import quantiles


def ingest_report(observations: DataFrame, intervals: DataFrame) -> dict[str, DataFrame]:
    """Latency by domain, unit conversions, implausible rows by flag, retransmissions, volume, study window, and keys that are still repeated."""
    r2 = lambda c: F.round(c, 2) + F.lit(0.0)
    minutes = F.timestamp_diff("MICROSECOND", F.col("event_time"), F.col("available_time")) / 6e7
    n = F.count("*").alias("n")
    usable = observations.where("is_plausible and not is_duplicate")
    span = lambda df, name, lo, hi: df.agg(iso(F.min(lo)).alias("first"), iso(F.max(hi)).alias("last")).select(F.lit(name).alias("table"), "first", "last")
    return {
        "latency": quantiles(observations.withColumn("minutes", minutes), ("domain",), "minutes", (0.0, 0.5, 0.95, 1.0), "minutes").select("domain", F.col("count").alias("n"), r2("q0").alias("least"), r2("q1").alias("median"), r2("q2").alias("p95"), r2("q3").alias("most")),
        "units": observations.where("value_num is not null").groupBy("variable_code", "unit_raw").agg(n, r2(F.min("value_num")).alias("least"), r2(F.max("value_num")).alias("most")),
        "implausible": observations.where("not is_plausible").groupBy("variable_code", F.coalesce("quality_flag", F.lit("<null>")).alias("flag")).agg(n),
        "retransmissions": observations.where("is_duplicate or not is_availability_known").groupBy("source_system", "quality_flag", "is_duplicate", "is_availability_known").agg(n, F.countDistinct("patient_id").alias("patients")),
        "volume": usable.groupBy("domain", "variable_code").agg(n, F.countDistinct("patient_id").alias("patients")).unionByName(
            intervals.groupBy("kind").agg(n, F.countDistinct("patient_id").alias("patients")).select(F.lit("INTERVAL").alias("domain"), F.col("kind").alias("variable_code"), "n", "patients")
        ),
        "study_window": span(observations, "observations", "event_time", "event_time").unionByName(span(intervals, "intervals", "start_time", "end_time")),
        "repeated": observations.where("not is_duplicate").groupBy("patient_id", "variable_code", "event_time").agg(n).where("n > 1"),
    }
