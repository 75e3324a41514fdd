"""Signals and evidence as sorted CSV files, and as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import iso
from tideline.plans import constraints
from tideline.plans.audit import late_evidence, orphans, require_none
from tideline.plans.ingest import Layout, _files, publish
from tideline.sources.stored import new_folder

#: Columns of the exported files, in order.
COLUMNS = {
    "signals": ("signal_id", "patient_id", "decision_time", "risk", "priority", "confidence", "evidence_start", "evidence_end", "explanation", "model_version", "k", "suppressions"),
    "evidence": ("signal_id", "source_file", "record_id", "variable_code", "event_time", "available_time", "role", "contribution"),
}
EXPORTS = {"signals": ("signal_id",), "evidence": ("signal_id", "role", "record_id")}


def persist(signals: DataFrame, evidence: DataFrame, folder: str) -> None:
    """Replace the result tables by one swap, after the checks that they must pass."""
    constraints.require({"signals": signals, "evidence": evidence})
    require_none(late_evidence(evidence), "late evidence")
    require_none(orphans(signals, evidence), "orphans")
    publish(signals.sparkSession, Layout(folder), {"signals": signals, "evidence": evidence.withColumn("contribution", F.round("contribution", 6))})


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies the parts of a file, in order, behind its header, a piece at a time; the name is given at the end."""
    for batch in batches:
        for r in batch.to_pylist():
            files, folder = fs.FileSystem.from_uri(r["parts"])
            _, target = fs.FileSystem.from_uri(r["target"])
            parts = sorted(f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-"))
            size = 0
            with files.open_output_stream(f"{target}.part") as out:
                out.write(r["header"].encode())
                for part in parts:
                    with files.open_input_stream(part) as stream:
                        while data := stream.read(1 << 20):
                            size += out.write(data)
            files.move(f"{target}.part", target)
            yield pa.record_batch({"file": [r["target"]], "bytes": pa.array([size], pa.int64())})


def export_csv(df: DataFrame, name: str, folder: str) -> str:
    """The ``COLUMNS`` that ``df`` has as one sorted CSV file ``folder/name/name.csv`` with header; times without offset.  Returns ``folder/name``.

    Rows are dealt out by range and sorted in parts; one task then joins the parts as streams, so none sorts or holds all.
    """
    df = df.select(*[c for c in COLUMNS[name] if c in df.columns])
    times = {c: iso(F.col(c)) for c, kind in df.dtypes if kind.startswith("timestamp")}
    path = f"{folder}/{name}"
    spark, parts = df.sparkSession, new_folder(df.sparkSession, "csv")
    df.withColumns(times).repartitionByRange(*EXPORTS[name]).sortWithinPartitions(*EXPORTS[name]).write.csv(parts)
    files, there = _files(spark, path)
    files.delete(there, True)
    files.mkdirs(there)
    whole = lambda p: p if ":/" in p else f"file://{p}"
    row = [F.lit(v).alias(c) for c, v in {"parts": whole(parts), "target": f"{whole(path)}/{name}.csv", "header": ",".join(df.columns) + "\n"}.items()]
    spark.range(1).coalesce(1).select(*row).mapInArrow(_joined, "file string, bytes long").collect()
    files, there = _files(spark, parts)
    files.delete(there, True)
    return path


def discard_exports(spark, folder: str) -> list[str]:
    """Delete earlier exports of the known names, and nothing else; returns what was there."""
    gone = []
    for name in EXPORTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path):
            files.delete(path, True)
            gone.append(name)
    return gone
