"""Ingestion end to end: verify files, read them as text, clean, write, record the run."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalars import literal_table, parse_date, parse_time
from tideline.operators import quality
from tideline.plans import constraints
from tideline.plans.audit import repeated_keys, require_none
from tideline.sources import integrity
from tideline.sources.adapters import FACT_FIELDS, Adapter, FactAdapter, IntervalAdapter, Registry, mirror, optional, project_facts, project_intervals, read_text_csv, stage
from tideline.sources.stored import stored


@dataclass(frozen=True)
class Layout:
    """Where a warehouse keeps its tables: in place, or with ``versions`` each run's in a folder of their own, of which a layout that is ``opened`` holds one."""

    root: str
    versions: bool = False
    version: int | None = None

    def table(self, name: str) -> str:
        folder = f"_versions/{self.version:012d}/" if self.version is not None else ""
        return f"{self.root.rstrip('/')}/{folder}{name}"


class CommitError(RuntimeError):
    """Another run was faster."""


def clinical_facts(source: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Facts with an availability, and those without one, which go to quarantine."""
    text = source.select(*[optional(columns.get(f)).alias(f) for f in ("record_id", "patient_id", "code", "onset", "recorded")])
    rows = text.select("record_id", "patient_id", "code", parse_date(F.col("onset")).alias("onset_date"), parse_time(F.col("recorded")).alias("available_time"))
    rejected = rows.where("available_time is null").select("record_id", "patient_id", F.lit("BAD_AVAILABLE_TIME").alias("reject_reason"), F.lit("fact").alias("detail"))
    return rows.where("available_time is not null"), rejected


def publish(spark: SparkSession, layout: Layout, tables: dict[str, DataFrame], step: Callable[[str], None] = lambda _: None) -> Layout:
    """Write all tables so that a run counts as a whole or not at all; returns the layout that holds them.  ``step`` hears of each step that is done.

    With versions they are written to a new folder, and a commit named by its number is renamed into place at the end, which one run alone
    can do; who has opened an older version goes on reading that.  Without, they are written beside the old ones and swapped in; ``recover``
    finishes a swap that was cut off.
    """
    if not layout.versions:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(layout.table(f"_next/{name}"))
            step(name)
        files, path = _files(spark, layout.table("_next/_ready"))
        files.create(path, True).close()
        step("ready")
        recover(spark, layout)
        return layout
    number = max(_commits(spark, layout), default=0) + 1
    new = replace(layout, version=number)
    files, folder = _files(spark, new.table(""))
    files.delete(folder, True)  # of a run that ended before its commit
    for name, df in tables.items():
        df.write.parquet(new.table(name))
        step(name)
    plain = replace(layout, version=None)
    _, waiting = _files(spark, plain.table(f"_commits/_{uuid.uuid4().hex}"))
    _, commit = _files(spark, plain.table(f"_commits/{number:012d}"))
    files.create(waiting, True).close()
    step("waiting")
    if files.exists(commit) or not files.rename(waiting, commit):
        raise CommitError(f"version {number} is there already")
    step("committed")
    return new


def _commits(spark: SparkSession, layout: Layout) -> list[int]:
    files, there = _files(spark, replace(layout, version=None).table("_commits"))
    names = [s.getPath().getName() for s in files.listStatus(there)] if files.exists(there) else []
    return [int(n) for n in names if n.isdigit()]


def opened(spark: SparkSession, layout: Layout) -> Layout:
    """The layout as a reader should take it: its last version, held for as long as it is used, or the tables in place with a swap finished."""
    if not layout.versions:
        recover(spark, layout)
        return layout
    if not (commits := _commits(spark, layout)):
        raise FileNotFoundError(f"no version of {layout.root} has been committed")
    return replace(layout, version=max(commits))


def forget(spark: SparkSession, layout: Layout, keep: int = 2) -> None:
    """Delete all but the last ``keep`` versions, commit first."""
    for number in sorted(_commits(spark, layout))[:-keep]:
        for path in (f"_commits/{number:012d}", f"_versions/{number:012d}"):
            files, there = _files(spark, replace(layout, version=None).table(path))
            files.delete(there, True)


def recover(spark: SparkSession, layout: Layout) -> None:
    """Swap in the tables of a run that wrote all of them; those of one that did not are dropped."""
    files, ready = _files(spark, layout.table("_next/_ready"))
    _, waiting = _files(spark, layout.table("_next"))
    if files.exists(ready):
        for status in files.listStatus(waiting):
            name = status.getPath().getName()
            if name != "_ready":
                _, target = _files(spark, layout.table(name))
                files.delete(target, True)
                files.rename(status.getPath(), target)
    files.delete(waiting, True)


def _files(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    files, there = _files(spark, path)
    return spark.read.schema(integrity.MANIFEST).parquet(path) if files.exists(there) else spark.createDataFrame([], integrity.MANIFEST)


def _counted(rows: DataFrame, sources: list[str], table: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows(source_file, reject_reason, ...)`` written, and (source_file, rows_read, rows_loaded, rows_quarantined, target_table), counted as they were written."""
    seen, good = Observation(f"{name}-{uuid.uuid4().hex}"), F.col("reject_reason").isNull()
    of = [F.col("source_file") == source for source in sources]
    counts = [c.alias(f"{kind}{i}") for i, own in enumerate(of) for kind, c in (("n", F.count_if(own)), ("bad", F.count_if(own & ~good)))]
    table_rows = stored(rows.observe(seen, *counts), name)
    got = seen.get
    found = [(source, n, n - bad, bad, table) for i, source in enumerate(sources) for n, bad in [(got[f"n{i}"], got[f"bad{i}"])]]
    return table_rows, literal_table(rows.sparkSession, found, "source_file string, rows_read long, rows_loaded long, rows_quarantined long, target_table string")


def ingest(
    spark: SparkSession, folder: str, adapters: list[Adapter], units: DataFrame, variables: DataFrame, intervals: DataFrame | tuple[IntervalAdapter, ...], official: DataFrame, layout: Layout, run_id: str, at: str,
    facts: tuple[FactAdapter, ...] = (), more_files: tuple[str, ...] = (),
) -> list[dict]:
    """Read the adapters' CSV files under ``folder`` and rebuild the clean tables; returns the verdicts.

    Nothing is read where a file was modified, is missing, or is new and not on the official list.  Observations, intervals, facts (none
    where the run has none), quarantine and the manifest, which only grows, are published together, after their keys and checks.  ``intervals`` come as adapters or as a finished table;
    availability is resolved after they are loaded and before duplicates are marked, as the order matters.
    """
    known_runs = _manifest(spark, opened(spark, layout).table("ingest_manifest")) if not layout.versions or _commits(spark, layout) else spark.createDataFrame([], integrity.MANIFEST)
    previous = integrity.last_state(known_runs)
    current = stored(integrity.file_hashes(spark, folder, "*.csv", previous), "hashes")
    spans = () if isinstance(intervals, DataFrame) else tuple(intervals)
    report = integrity.verify(current, previous, official, [a.source_file for a in (*adapters, *spans, *facts)] + list(more_files))
    if bad := integrity.first_ingest_mismatches(report):
        raise integrity.IntegrityError(f"not on the official list: {bad}")
    read = lambda a: read_text_csv(spark, f"{folder}/{a.source_file}")
    rows, n = _counted(quality.typed(stage({a.source_file: read(a) for a in adapters}, adapters), units, variables), [a.source_file for a in adapters], "observations", "typed")
    rejected, counts = [quality.quarantined(rows)], [n]
    if spans:
        typed = [quality.valid_intervals(project_intervals(read(a), a), a.extra) for a in spans]
        both, n = _counted(reduce(DataFrame.unionByName, typed), [a.source_file for a in spans], "intervals", "intervals")
        rejected.append(quality.quarantined_as(both, "interval"))
        counts.append(n)
        intervals = both.where("reject_reason is null").drop("reject_reason")
    tables = {"intervals": intervals}
    if facts:
        known, n = _counted(quality.valid_facts(reduce(DataFrame.unionByName, [project_facts(read(a), a) for a in facts])), [a.source_file for a in facts], "clinical_facts", "facts")
        rejected.append(quality.quarantined_as(known, "fact"))
        counts.append(n)
        tables["clinical_facts"] = known.where("reject_reason is null").drop("reject_reason")
    else:  # none are left of an earlier run
        none = spark.createDataFrame([], ", ".join(f"{c} string" for c in ("source_file", *FACT_FIELDS)))
        tables["clinical_facts"] = quality.valid_facts(none).drop("reject_reason")
    observations = stored(quality.mark_duplicates(quality.resolve_availability(quality.accepted(rows), intervals)), "observations")
    hashes = integrity.classify(current, previous, official)
    run = integrity.manifest_rows(hashes, reduce(DataFrame.unionByName, counts), run_id, at)
    tables |= {"observations": observations, "quarantine": reduce(DataFrame.unionByName, rejected), "ingest_manifest": known_runs.unionByName(run)}
    constraints.require(tables)
    publish(spark, layout, tables)
    return report


def ingest_registry(spark: SparkSession, folder: str, registry: Registry, official: DataFrame, layout: Layout, run_id: str, at: str) -> list[dict]:
    """``ingest`` of all that a registry declares; its catalogues ``units`` and ``variables`` type the observations, and all are mirrored as views."""
    catalogs = {**registry.catalogs, **registry.dimensions}
    mirror(spark, {name: f"{folder}/{file}" for name, file in catalogs.items()})
    number = lambda c: F.col(c).try_cast("double").alias(c)
    units = spark.table("units").select("unit_code", number("factor"), number("unit_offset"))
    variables = spark.table("variables").select("variable_code", number("plausible_min"), number("plausible_max"))
    for name, keys in (("units", repeated_keys(units, ["unit_code"])), ("variables", repeated_keys(variables, ["variable_code"]))):
        require_none(keys, f"repeated keys of {name}")
    return ingest(spark, folder, list(registry.observations), units, variables, registry.intervals, official, layout, run_id, at, registry.facts, tuple(catalogs.values()))
