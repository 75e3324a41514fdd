"""Tables written to the cluster's shared folder: a cut in the lineage that outlives a lost executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Tables that no scope owns: they stay until ``clean`` or the driver's end.
_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []
#: The tables of the innermost scope of this thread of control.
_scope: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("tables", default=None)


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder for a local session (tests) and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tideline-"))
        root = _own[0]
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own, deleted with its scope; outside of any, by ``clean`` or when the driver ends."""
    atexit.unregister(_at_exit)
    atexit.register(_at_exit)
    path = f"{_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    owner = _scope.get()
    (_made if owner is None else owner).append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under spark.checkpoint.dir and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


@contextmanager
def scope() -> Iterator[set[str]]:
    """Within, tables that this thread stores belong to the scope; at its end, also by an error, all are deleted but those whose ``written_to`` is in
    the set, which go to the scope around.  Other calls' tables are never touched."""
    around, own, kept = _scope.get(), [], set()
    token = _scope.set(own)
    try:
        yield kept
    finally:
        _scope.reset(token)
        for spark, path in own:
            if path in kept:
                (_made if around is None else around).append((spark, path))
            else:
                _delete(spark, path)


def written(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query with its result stored and all that it stored for it deleted: one folder is left while somebody may read the result."""

    @wraps(query)
    def run(*args, **given) -> DataFrame:
        with scope() as kept:
            result = query(*args, **given)
            result = result if hasattr(result, "written_to") else stored(result, getattr(query, "__name__", "result"))
            kept.add(result.written_to)
        return result

    return run


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def clean(spark: SparkSession | None = None) -> None:
    """Delete the stored tables of this driver that no running scope owns (of ``spark`` alone, if given); results that still read them become unusable."""
    for of, path in [m for m in _made if spark is None or m[0] is spark]:
        _delete(of, path)
        _made.remove((of, path))


def _at_exit() -> None:
    try:
        clean()
    except Exception:  # noqa: BLE001  the session is gone and nobody can be told any more
        pass
