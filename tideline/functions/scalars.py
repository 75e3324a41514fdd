"""Safe parsing and small numeric expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))


def parse_time(c: Column) -> Column:
    """A timestamp without zone; null unless the text is a full date and time."""
    text = F.trim(c)
    return F.when(text.rlike(_TIME), text.try_cast("timestamp_ntz"))


def parse_number(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_date(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def iso(c: Column) -> Column:
    """Text of a time, without offset."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def seconds(c: Column) -> Column:
    """Whole seconds of a time without zone since 1970, whatever the session's zone."""
    return F.unix_timestamp(c.cast("timestamp_ntz"))  # of a time without zone, so read as it stands; a difference of times builds two calendar times


def hours_between(a: Column, b: Column) -> Column:
    """Hours from ``a`` to ``b``."""
    return F.timestamp_diff("MICROSECOND", a, b) / 3.6e9


def text(*parts: Column | str) -> Column:
    """The parts in a row, null if one is."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def percent(c: Column) -> Column:
    return F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))


def median_sql(sorted_array: str) -> str:
    """SQL for the median of a sorted array; null where it is empty."""
    a = sorted_array
    return f"case when size({a}) > 0 then (get({a}, cast((size({a}) - 1) div 2 as int)) + get({a}, cast(size({a}) div 2 as int))) / 2 end"


def deviation_sql(sorted_array: str, centre: str) -> str:
    """SQL for the median of the distances from ``centre`` of a sorted array; null where it is empty.

    The r-th least distance is the least radius around the centre that holds r values in a row, so nothing is sorted again.
    """
    a = sorted_array
    least = lambda r: f"array_min(transform(sequence(0, size({a}) - 1 - ({r})), i -> greatest({centre} - {a}[i], {a}[i + ({r})] - {centre})))"
    low, high = f"cast((size({a}) - 1) div 2 as int)", f"cast(size({a}) div 2 as int)"
    return f"case when size({a}) % 2 = 1 then {least(low)} when size({a}) > 0 then ({least(low)} + {least(high)}) / 2 end"


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of literals with a schema such as ``"code string, factor double"``; it needs no Python worker, as rows handed over from Python would."""
    fields = [f.split() for f in schema.split(", ")]
    one = lambda row: F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields, strict=True)])
    return spark.range(1).select(F.inline(F.array(*map(one, rows))))


#: Rows of a catalogue that may be broadcast.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows, which are counted; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def settled(df: DataFrame, *only: str) -> DataFrame:
    """``df`` as it is, but later filters stay above it; with ``only`` those on these columns, while filters on others pass.

    Spark pushes a filter through a projection by copying the projected expression into it; for long chains of array
    expressions that multiplies the work.  It does not push filters on generated columns through the generator.
    """
    return df.select(*[c for c in df.columns if only and c not in only], F.inline(F.array(F.struct(*(only or df.columns)))))


def tasks(df: DataFrame) -> int:
    """How many parts a heavy step is dealt out to: those of a shuffle, named so that they are not merged into one more than there are cores, which takes two rounds."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
