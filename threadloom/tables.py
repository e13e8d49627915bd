"""Tables that a piece of work writes for itself, in the folder that all machines share: lineage ends there, and a lost executor costs no
recomputation.

Work that begins and ends in one call opens a `scope`: what is stored inside it belongs to it, and goes when it ends, but for what is handed
on (`Scope.release`).  Without a scope a table belongs to the application, whose results may still read it, and goes when the process ends."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where none is named, a session on one machine takes one in its warehouse; on a
    cluster that is an error, as the warehouse may be a folder of the driver's own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    return at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_threadloom"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scope:
    """The stored tables of one piece of work."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, set()

    def new_path(self, like: str = "t") -> str:
        path = f"{shared_dir(self.spark).rstrip('/')}/{like}-{uuid.uuid4().hex}"
        self.paths.add(path)
        return path

    def release(self, table: DataFrame) -> DataFrame:
        """Hands a stored table on to the scope around, or to the application."""
        self.paths.discard(table.stored_at)
        around = _outer(self)
        (around or _application(self.spark)).paths.add(table.stored_at)
        return table

    def drop(self, path: str) -> None:
        self.paths.discard(path)
        delete(self.spark, path)

    def clean(self) -> None:
        while self.paths:
            delete(self.spark, self.paths.pop())


_OPEN: ContextVar[tuple[Scope, ...]] = ContextVar("scopes", default=())
_APPLICATIONS: dict[str, Scope] = {}


def _outer(inner: Scope) -> Scope | None:
    before = _OPEN.get()[: _OPEN.get().index(inner)] if inner in _OPEN.get() else _OPEN.get()
    return before[-1] if before else None


def _application(spark: SparkSession) -> Scope:
    return _APPLICATIONS.setdefault(spark.sparkContext.applicationId, Scope(spark))


@atexit.register
def _clean_all() -> None:
    for scope in _APPLICATIONS.values():
        # the session may be gone by now
        with contextlib.suppress(Exception):
            scope.clean()


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    own = Scope(spark)
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield own
    finally:
        _OPEN.reset(token)
        own.clean()


def current(spark: SparkSession) -> Scope:
    return _OPEN.get()[-1] if _OPEN.get() else _application(spark)


#: Parquet's dictionaries and runs make label maps and links some twenty times smaller than their rows are in a join's table.
PACKED = 20


def _bytes(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def _most_broadcast(spark: SparkSession) -> int:
    named = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return 0 if named.startswith("-") else int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(named))


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there.  The table stays until `forget`, or the end of its scope.

    Spark would judge by the files' size whether a join may broadcast a table.  One that is over the threshold when unpacked asks to be merged, so
    the driver never holds it."""
    spark = df.sparkSession
    path = current(spark).new_path()
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _bytes(spark, path) * PACKED > _most_broadcast(spark):
        out = out.hint("merge")
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        for s in (*_OPEN.get(), _application(df.sparkSession)):
            s.paths.discard(df.stored_at)
        delete(df.sparkSession, df.stored_at)
