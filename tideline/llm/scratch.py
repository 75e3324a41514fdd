"""Tables written to the cluster's shared folder, so that a lost executor never costs the lineage."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that no scope owns: they stay until ``drop``, ``clean`` or the driver's end.
_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []
#: The innermost scope of this thread of control.
_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)
#: Spark deletes a query's shuffle files once it has run; nothing but the written table is needed of it.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of an Arrow batch.  Whole texts differ by orders of magnitude in size, so batches go by bytes rather than rows.
BATCH_BYTES = 8 << 20
#: Row numbers that may be broadcast (some 64 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary folder for a local session (tests) and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tideline-"))
        root = _own[0]
    return root.rstrip("/")


class Scope:
    """The scratch tables that one call has made and not yet dropped, its calls' kept ones among them."""

    def __init__(self) -> None:
        self.tables: list[tuple[SparkSession, str]] = []
        self._kept: set[str] = set()

    def keep(self, *tables: DataFrame) -> None:
        """Hand these tables to the scope around this one when it ends."""
        self._kept |= {df.written_to for df in tables}

    def end(self, to: list[tuple[SparkSession, str]]) -> None:
        for spark, path in self.tables:
            if path in self._kept:
                to.append((spark, path))
            else:
                delete(spark, path)


@contextmanager
def scope() -> Iterator[Scope]:
    """Within, tables that this thread makes belong to the scope; at its end, also by an error, those that were not kept are deleted.

    No other call's tables are touched: a scope knows its own alone, and threads have scopes of their own.
    """
    around, own = _scope.get(), Scope()
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)
        own.end(_made if around is None else around.tables)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for a scratch table, deleted with its scope; outside of any, by ``drop``, ``clean`` or when the driver ends."""
    atexit.unregister(_at_exit)
    atexit.register(_at_exit)
    path = f"{shared_folder(spark)}/tideline/{name}-{uuid.uuid4().hex}"
    owner = _scope.get()
    (_made if owner is None else owner.tables).append((spark, path))
    return path


_held: dict[tuple[int, str], tuple[str, int]] = {}
_lock = threading.Lock()


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within, a setting of the session has a value; the last of several threads that are within puts back what was there."""
    at = (id(spark), key)
    with _lock:
        given, n = _held.get(at, (spark.conf.get(key), 0))
        _held[at] = (given, n + 1)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _lock:
            given, n = _held.pop(at)
            if n > 1:
                _held[at] = (given, n - 1)
            else:
                spark.conf.set(key, given)


@contextmanager
def batches_by_bytes(spark: SparkSession) -> Iterator[None]:
    """Within, Arrow batches are bounded by BATCH_BYTES, unless a lower bound is set; the session is left as it was."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= BATCH_BYTES and (id(spark), key) not in _held:
        yield
        return
    with _setting(spark, key, str(BATCH_BYTES)):
        yield


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut in the lineage."""
    path = new_folder(df.sparkSession, name)
    with batches_by_bytes(df.sparkSession), _setting(df.sparkSession, _CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def numbered(docs: DataFrame) -> DataFrame:
    """(row_id, row): the rows of ``docs``, each with a number of its own; written, so that both stay what they are."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct("*").alias("row")), "rows")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows(row_id, ...)`` but those whose number is in the written table ``gone(row_id)``.

    Up to BROADCAST_ROWS numbers are broadcast, so that no row moves; more are joined by a shuffle.
    """
    few = gone.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, "row_id", "left_anti")


def delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` returned in this scope and nothing needs any more."""
    owner = _scope.get()
    for df in tables:
        delete(df.sparkSession, df.written_to)
        for made in (_made, [] if owner is None else owner.tables):
            made[:] = [m for m in made if m[1] != df.written_to]


def clean(spark: SparkSession | None = None) -> None:
    """Delete every scratch table of this driver that no running scope owns (of ``spark`` alone, if given); results that still read them become unusable."""
    for of, path in [m for m in _made if spark is None or m[0] is spark]:
        delete(of, path)
        _made.remove((of, path))


def _at_exit() -> None:
    """What is left when the driver ends; a session whose JVM is gone already leaves its files to the folder's owner."""
    try:
        clean()
    except Exception:  # noqa: BLE001  nobody can be told any more
        pass
