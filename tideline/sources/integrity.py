"""Integrity and lineage of source files: hashes, verdicts against the last run and the official list, the cumulative manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib import metadata

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run_id string, ingested_at timestamp_ntz, source_file string, bytes long, sha256 string, verdict string, rows_read long, rows_loaded long, rows_quarantined long, official_sha string, target_table string, code_version string"
#: Bytes of a file that a task holds.
PIECE = 1 << 20
NEW, SAME, APPENDED, NEW_VERSION, MODIFIED = "NEW", "IDENTICAL", "APPENDED", "NEW_VERSION", "MODIFIED"


class IntegrityError(ValueError):
    """A source changed in a way that nobody announced."""


def official_list(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(source_file, official_bytes, official_sha) of the lines ``path | bytes | sha256`` of a text; other lines are left out."""
    pattern = r"^\s*(.+?)\s*\|\s*([\d,]+)\s*\|\s*([0-9a-fA-F]{64})\s*$"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    part = lambda n: F.regexp_extract("value", pattern, n)
    name = part(1)
    cut = F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 10_000)).otherwise(name) if prefix else name
    return lines.select(cut.alias("source_file"), F.regexp_replace(part(2), ",", "").cast("long").alias("official_bytes"), F.lower(part(3)).alias("official_sha"))


_HASHES = "source_file string, bytes long, sha256 string, prefix_sha256 string"


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file is streamed once, a piece at a time; the hash of its first ``before`` bytes is taken on the way."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            files, path = fs.FileSystem.from_uri(r["uri"])
            whole, head, seen = hashlib.sha256(), None, 0
            with files.open_input_stream(path, compression=None) as stream:
                while True:
                    left = None if r["before"] is None else r["before"] - seen
                    if left == 0:
                        head = whole.hexdigest()
                    data = stream.read(PIECE if not left or left < 0 else min(PIECE, left))
                    if not data:
                        break
                    whole.update(data)
                    seen += len(data)
            rows.append({"source_file": r["source_file"], "bytes": seen, "sha256": whole.hexdigest(), "prefix_sha256": head})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("source_file", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("prefix_sha256", pa.string())]))


def file_hashes(spark: SparkSession, folder: str, pattern: str, previous: DataFrame) -> DataFrame:
    """(source_file, bytes, sha256, prefix_sha256): hashes of whole files and of as many first bytes as ``previous(source_file, bytes)`` had.

    Spark lists the files and deals them out; a task streams its files, so their size does not matter.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    root = F.regexp_replace(F.lit(folder.rstrip("/")), "^file:/*", "/")
    name = F.substring(F.regexp_replace("path", "^file:/*", "/"), F.length(root) + 2, F.lit(10_000))
    uri = F.regexp_replace("path", "^file:/*", "file:///")
    before = previous.select("source_file", F.col("bytes").alias("before"))
    rows = files.select(name.alias("source_file"), uri.alias("uri")).join(before, "source_file", "left")
    return rows.repartition("source_file").mapInArrow(_hash_files, _HASHES)


def last_state(manifest: DataFrame) -> DataFrame:
    """(source_file, bytes, sha256) as the last run of the manifest left them."""
    last = F.max_by(F.struct("bytes", "sha256"), F.struct("ingested_at", "run_id")).alias("s")
    return manifest.groupBy("source_file").agg(last).select("source_file", "s.*")


def verdict() -> Column:
    """New, identical, appended to (what was there is untouched), a new version that the official list knows, or modified; the first that holds."""
    return (
        F.when(F.col("previous_sha").isNull(), NEW)
        .when(F.col("sha256") == F.col("previous_sha"), SAME)
        .when((F.col("bytes") > F.col("previous_bytes")) & (F.col("prefix_sha256") == F.col("previous_sha")), APPENDED)
        .when(F.col("sha256") == F.col("official_sha"), NEW_VERSION)
        .otherwise(MODIFIED)
    )


def classify(current: DataFrame, previous: DataFrame, official: DataFrame) -> DataFrame:
    """``current`` files with their verdict; a file that the last run had and that is gone is in ``missing``."""
    was = previous.select("source_file", F.col("bytes").alias("previous_bytes"), F.col("sha256").alias("previous_sha"))
    rows = current.join(was, "source_file", "left").join(official, "source_file", "left")
    return rows.withColumn("verdict", verdict()).withColumn("listed", F.col("sha256").eqNullSafe(F.col("official_sha")))


def verify(current: DataFrame, previous: DataFrame, official: DataFrame, expected: list[str], strict: bool = True) -> list[dict]:
    """The verdicts as rows (one a source file); missing files and, where ``strict``, modified ones raise before anything is read."""
    report = [r.asDict() for r in classify(current, previous, official).orderBy("source_file").collect()]
    if missing := sorted(set(expected) - {r["source_file"] for r in report}):
        raise IntegrityError(f"missing: {missing}")
    if strict and (bad := [r["source_file"] for r in report if r["verdict"] == MODIFIED]):
        raise IntegrityError(f"modified: {bad}")
    return report


def first_ingest_mismatches(report: list[dict]) -> list[str]:
    """New files whose hash the official list does not give."""
    return [r["source_file"] for r in report if r["verdict"] == NEW and not r["listed"]]


def code_version() -> str:
    """The version of this package as installed, else ``unversioned``."""
    try:
        return metadata.version("tideline")
    except metadata.PackageNotFoundError:
        return "unversioned"


def manifest_rows(report: DataFrame, counts: DataFrame, run_id: str, at: str, version: str | None = None) -> DataFrame:
    """What a run adds to the manifest: hashes and verdicts with the rows read, loaded and quarantined, and the table, of ``counts``."""
    rows = report.join(counts, "source_file", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    target = F.col("target_table") if "target_table" in counts.columns else F.lit(None).cast("string")
    return rows.select(F.lit(run_id).alias("run_id"), F.lit(at).cast("timestamp_ntz").alias("ingested_at"), "source_file", "bytes", "sha256", "verdict", n("rows_read"), n("rows_loaded"), n("rows_quarantined"), "official_sha", target.alias("target_table"), F.lit(version or code_version()).alias("code_version"))


def append_manifest(rows: DataFrame, path: str) -> None:
    """The manifest only ever grows; rebuilding the clean tables leaves it alone."""
    rows.write.mode("append").parquet(path)
