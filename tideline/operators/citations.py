"""Row-level evidence of an assessment, in order of weight, each row once for each role."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.config import Profile

_KEY = ["patient_id", "t"]
_FIELDS = ["source_file", "record_id", "variable_code", "event_time", "available_time", "role", "contribution"]


def representative(z_size: str = "size(z)", argmax: str = "array_position(z, array_max(z)) - 1") -> str:
    """SQL for the sorted indices of first, last, greatest and, from six samples on, middle sample."""
    return f"array_sort(array_distinct(concat(array(0, {z_size} - 1, cast({argmax} as int)), if({z_size} >= 6, array({z_size} div 2), cast(array() as array<int>)))))"


def channel_citations(channels: DataFrame) -> DataFrame:
    """Samples of live channels: those of the highest score are PRIMARY, others SUPPORTING."""
    live = channels.where("score > 0").withColumn("chosen", F.expr(f"transform({representative()}, i -> evidence[cast(i as int)])"))
    w = Window.partitionBy(*_KEY).orderBy(F.desc("score"), "place")
    ranked = live.withColumn("rank", F.row_number().over(w))
    rows = ranked.select(*_KEY, F.posexplode("chosen").alias("at", "s"), "variable_code", "rank", "score")
    role = F.when(F.col("rank") == 1, "PRIMARY").otherwise("SUPPORTING")
    return rows.select(*_KEY, F.lit(0).alias("part"), (F.col("rank") * 100 + F.col("at")).alias("place"), "s.source_file", "s.record_id", "variable_code", "s.event_time", "s.available_time", role.alias("role"), F.round("score", 4).alias("contribution"))


def lab_citations(labs: DataFrame) -> DataFrame:
    w = Window.partitionBy(*_KEY).orderBy("variable_code")
    role = F.when(F.col("abnormal"), "SUPPORTING").otherwise("CONTEXT")
    return labs.select(*_KEY, F.lit(1).alias("part"), F.row_number().over(w).alias("place"), "source_file", "record_id", "variable_code", "event_time", "available_time", role.alias("role"), F.col("abnormal").cast("double").alias("contribution"))


def plain(rows: DataFrame, role: str, source: str | None = None, time: str = "event_time", first: tuple[str, ...] = ()) -> DataFrame:
    """Rows with patient_id and t as evidence of one role, in order of ``first``, time and record."""
    w = Window.partitionBy(*_KEY).orderBy(*first, time, "record_id")
    code = F.col("variable_code") if "variable_code" in rows.columns else F.lit(None).cast("string")
    file = F.lit(source) if source else F.col("source_file")
    return rows.select(*_KEY, F.row_number().over(w).alias("place"), file.alias("source_file"), "record_id", code.alias("variable_code"), F.col(time).alias("event_time"), "available_time", F.lit(role).alias("role"), F.lit(0.0).alias("contribution"))


def citations(channels: DataFrame, labs: DataFrame, cited: list[DataFrame], excluded: DataFrame, encounters: DataFrame, p: Profile) -> DataFrame:
    """All evidence in order: channels, laboratories, what each rule cites where it holds, excluded rows, and the encounter where nothing else
    tells of context; each (source, record, role) once, ``p.citations`` at most.  All parts are rows with patient_id and t of what an assessment rests on."""
    later = [*cited, plain(excluded, "QUALITY"), plain(encounters, "CONTEXT", "intervals", "start_time").where("place = 1")]
    parts = [channel_citations(channels), lab_citations(labs), *[rows.withColumn("part", F.lit(2 + i)) for i, rows in enumerate(later)]]
    last = 1 + len(later)
    rows = reduce(DataFrame.unionByName, parts)
    told = F.max((F.col("role") == "CONTEXT") & (F.col("part") < last)).over(Window.partitionBy(*_KEY))
    rows = rows.withColumn("told", told).where((F.col("part") < last) | ~F.col("told"))
    once = Window.partitionBy(*_KEY, "source_file", "record_id", "role").orderBy("part", "place")
    rows = rows.withColumn("first", F.row_number().over(once)).where("first = 1")
    order = Window.partitionBy(*_KEY).orderBy("part", "place")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= p.citations).select(*_KEY, "n", *_FIELDS)
