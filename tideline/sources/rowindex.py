"""Original rows of CSV files by record, through a stored index of byte ranges instead of a scan.

Files are read once, in blocks that tasks share: each line goes to the block that its first byte is in.  The index has a row a line, sorted by source and
record, so that a look at one record reads the part of the index around it by its statistics, and then the bytes of that line.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.stored import stored

#: Bytes that a task holds, and what a line may run beyond them at a time.
BLOCK, MORE = 16 << 20, 1 << 16
_INDEX = "source_file string, uri string, record_id string, start long, length long"


def _field(line: bytes) -> str:
    return next(csv.reader([line.decode("utf-8", "replace")]), [""])[0]


def _block(file: pa.NativeFile, size: int, at: int, block: int) -> tuple[bytes, int]:
    """The lines whose first byte is in the block at ``at``, and where they start; a line that runs out of the block is read to its end."""
    file.seek(max(0, at - 1))
    data = file.read(min(block, size - at) + (at > 0))
    if at > 0:  # the first line of the block begins behind the first line feed, that before the block included
        cut = data.find(b"\n") + 1
        if not cut:
            return b"", at
        data, at = data[cut:], at - 1 + cut
    while data and not data.endswith(b"\n") and (more := file.read(MORE)):
        cut = more.find(b"\n") + 1
        data += more[:cut] if cut else more
        if cut:
            break
    return data, at


def _lines(block: int):
    """(source_file, uri, record_id, start, length) of the lines of each block; a file's header is the line at 0."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                files, path = fs.FileSystem.from_uri(r["uri"])
                with files.open_input_file(path) as file:
                    data, first = _block(file, r["bytes"], r["at"], block)
                raw = np.frombuffer(data, np.uint8)
                ends = np.flatnonzero(raw == 10)
                ends = np.append(ends, len(raw)) if len(raw) and raw[-1] != 10 else ends
                starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[: len(ends)]
                commas = np.append(np.flatnonzero(raw == 44), len(raw))
                stop = np.minimum(commas[np.searchsorted(commas, starts)], ends)
                ids = [_field(data[a:e]) if data[a : a + 1] == b'"' else data[a:s].decode("utf-8", "replace").rstrip("\r") for a, s, e in zip(starts.tolist(), stop.tolist(), ends.tolist(), strict=True)]
                n = len(ids)
                yield pa.record_batch({"source_file": pa.array([r["source_file"]] * n, pa.string()), "uri": pa.array([r["uri"]] * n, pa.string()), "record_id": pa.array(ids, pa.string()), "start": pa.array(first + starts, pa.int64()), "length": pa.array(ends - starts, pa.int64())})

    return lines


def index_rows(spark: SparkSession, files: dict[str, str], path: str | None = None) -> DataFrame:
    """The index of ``files`` (URI by source), written to ``path`` or beside the other stored tables.

    Records are named by a file's first column, as ``read_text_csv`` reads it: a line is a row.  Empty lines are in it under an empty record.
    """
    sizes = [(name, uri, spark._jvm.org.apache.hadoop.fs.Path(uri).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(uri)).getLen()) for name, uri in files.items()]
    listed = spark.createDataFrame(sizes, "source_file string, uri string, bytes long")
    blocks = listed.where("bytes > 0").withColumn("at", F.explode(F.expr(f"sequence(0L, bytes - 1, {BLOCK}L)"))).repartition("source_file", "at")
    rows = blocks.mapInArrow(_lines(BLOCK), _INDEX).repartitionByRange("source_file", "record_id").sortWithinPartitions("source_file", "record_id", "start")
    if path is None:
        return stored(rows, "rows")
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(_INDEX).parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            files, path = fs.FileSystem.from_uri(r["uri"])
            with files.open_input_file(path) as file:
                header, _ = _block(file, 1, 0, 1)
                file.seek(r["start"])
                line = file.read(r["length"])
            names = next(csv.reader([header.decode("utf-8-sig").rstrip("\r\n")]))
            cells = next(csv.reader([line.decode("utf-8", "replace").rstrip("\r")]))
            row = [[(n, c if c else None) for n, c in zip(names, cells, strict=False)]]
            yield pa.record_batch({"source_file": pa.array([r["source_file"]]), "cells": pa.array(row, pa.map_(pa.string(), pa.string()))})


def indexed_row(index: DataFrame, record_id: str, source_file: str, allowed: set[str]) -> DataFrame:
    """(source_file, cells): the original row of a record, the first of equal ones, as text by column name; files that are not loaded are refused."""
    if source_file not in allowed:
        raise ValueError(f"not a loaded source: {source_file}")
    found = index.where((F.col("source_file") == source_file) & (F.col("record_id") == record_id) & (F.col("start") > 0)).orderBy("start").limit(1)
    return found.mapInArrow(_read, "source_file string, cells map<string,string>")
