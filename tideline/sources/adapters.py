"""Declared sources: a new source is a new entry, no code.

Every source is read as text and laid out alike (``LAYOUT``); typing, units and rejection come after.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT = ("record_id", "patient_id", "encounter_id", "device_id", "event_time", "available_time", "variable_code", "value", "unit", "quality_flag", "source_system", "ref_low", "ref_high")


@dataclass(frozen=True)
class Adapter:
    """Which column of a source holds which field of the layout; fields that are not named are null."""

    source_file: str
    domain: str
    columns: dict[str, str]

    def __hash__(self) -> int:
        return hash(self.source_file)


INTERVAL_FIELDS = ("record_id", "patient_id", "device_id", "subtype", "value_text", "start_time", "end_time", "available_time", "confidence")
FACT_FIELDS = ("record_id", "patient_id", "category", "onset", "available_time", "status", "severity", "source_system")


@dataclass(frozen=True)
class IntervalAdapter:
    """The same for a source of intervals of one kind; ``extra`` columns are kept as JSON."""

    source_file: str
    kind: str
    columns: dict[str, str]
    extra: tuple[str, ...] = ()

    def __hash__(self) -> int:
        return hash(self.source_file)


@dataclass(frozen=True)
class FactAdapter:
    source_file: str
    columns: dict[str, str]

    def __hash__(self) -> int:
        return hash(self.source_file)


@dataclass(frozen=True)
class Registry:
    """All declared sources.  ``catalogs`` and ``dimensions`` are mirrored as views by name; those named units and variables serve typing."""

    observations: tuple[Adapter, ...] = ()
    intervals: tuple[IntervalAdapter, ...] = ()
    facts: tuple[FactAdapter, ...] = ()
    catalogs: dict[str, str] = field(default_factory=dict)
    dimensions: dict[str, str] = field(default_factory=dict)

    def source_files(self) -> list[str]:
        return [a.source_file for a in (*self.observations, *self.intervals, *self.facts)] + [*self.catalogs.values(), *self.dimensions.values()]


def registry_of(settings: dict) -> Registry:
    """A registry from plain settings: sections ``observations``, ``intervals``, ``facts``, ``catalogs``, ``dimensions``; unknown names are refused."""
    if extra := set(settings) - {"observations", "intervals", "facts", "catalogs", "dimensions"}:
        raise ValueError(f"unknown sections: {sorted(extra)}")

    def columns(entry: dict, fields: tuple[str, ...], *own: str) -> dict[str, str]:
        if bad := set(entry) - set(fields) - {"source_file", *own}:
            raise ValueError(f"unknown fields of {entry['source_file']}: {sorted(bad)}")
        return {f: entry[f] for f in fields if entry.get(f) is not None}

    return Registry(
        tuple(Adapter(e["source_file"], e["domain"], columns(e, LAYOUT, "domain")) for e in settings.get("observations", [])),
        tuple(IntervalAdapter(e["source_file"], e["kind"], columns(e, INTERVAL_FIELDS, "kind", "extra"), tuple(e.get("extra") or ())) for e in settings.get("intervals", [])),
        tuple(FactAdapter(e["source_file"], columns(e, FACT_FIELDS)) for e in settings.get("facts", [])),
        dict(settings.get("catalogs", {})),
        dict(settings.get("dimensions", {})),
    )


def read_registry(path: str) -> Registry:
    """``registry_of`` a JSON file."""
    with open(path, encoding="utf-8") as f:
        return registry_of(json.load(f))


def project_intervals(source: DataFrame, a: IntervalAdapter) -> DataFrame:
    """Text columns of one kind, its extras kept by name for ``valid_intervals``."""
    fields = [optional(a.columns.get(f)).alias(f) for f in INTERVAL_FIELDS]
    return source.select(F.lit(a.source_file).alias("source_file"), F.lit(a.kind).alias("kind"), *fields, *[optional(c).alias(c) for c in a.extra])


def project_facts(source: DataFrame, a: FactAdapter) -> DataFrame:
    return source.select(F.lit(a.source_file).alias("source_file"), *[optional(a.columns.get(f)).alias(f) for f in FACT_FIELDS])


def migrated(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """``df`` with the columns that a table written before them lacks, at their defaults; present columns stay, but nulls in them are filled."""
    return df.withColumns({name: F.coalesce(F.col(name), default) if name in df.columns else default for name, default in added.items()})


def optional(name: str | None) -> Column:
    return F.lit(None).cast("string") if name is None else F.col(name).cast("string")


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text, by the header's names; a byte-order mark is no part of a name."""
    df = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False, encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def project(source: DataFrame, adapter: Adapter) -> DataFrame:
    fields = [optional(adapter.columns.get(f)).alias(f) for f in LAYOUT]
    return source.select(F.lit(adapter.source_file).alias("source_file"), F.lit(adapter.domain).alias("domain"), *fields)


def stage(sources: dict[str, DataFrame], adapters: list[Adapter]) -> DataFrame:
    """All sources in one layout, as text."""
    return reduce(DataFrame.unionByName, [project(sources[a.source_file], a) for a in adapters])


def mirror(spark: SparkSession, paths: dict[str, str]) -> dict[str, int]:
    """Register catalogues and dimensions as views of text columns; returns their row counts."""
    counts = {}
    for name, path in paths.items():
        df = read_text_csv(spark, path)
        df.createOrReplaceTempView(name)
        counts[name] = df.count()
    return counts


def source_row(spark: SparkSession, path: str, record_id: str, allowed: set[str], source_file: str) -> DataFrame:
    """The original row of a record, by the file's first column; files that are not loaded are refused."""
    if source_file not in allowed:
        raise ValueError(f"not a loaded source: {source_file}")
    df = read_text_csv(spark, path)
    return df.where(F.col(df.columns[0]) == record_id).limit(1)
