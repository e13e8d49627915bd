"""Edits of designs as a stream: a design is compiled again once no edit has come for a while, and forgotten after that.

State with timers: each design keeps the number of its edits, the first and the last, and a timer WAIT after the last one by event time.  An
edit sets the timer anew; when the watermark passes it, the design's row leaves and its state is dropped, so state is as large as what
is being edited just now and not as all designs that ever were."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadloom.tables import shared_dir

#: Milliseconds without an edit after which a design is compiled, and after which it is saved.
WAIT, SAVE = 250, 400
DUE = "design_id long, first_edit timestamp, last_edit timestamp, edits long, due timestamp"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, edits long")

    def _row(self, key: tuple, first: int, last: int, edits: int) -> pd.DataFrame:
        at = lambda us: pd.Timestamp(us, unit="us")
        return pd.DataFrame({"design_id": [key[0]], "first_edit": [at(first)], "last_edit": [at(last)], "edits": [edits], "due": [at(last + 1000 * self.wait)]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        own = [tuple(map(int, v)) for v in [self.open.get()] if v is not None] if self.open.exists() else []
        # what comes may be late, or lie more than a wait apart
        spans = sorted([*own, *((t, t, 1) for pdf in rows for t in pdf["us"].tolist())])
        held = []
        for first, last, n in spans:
            if held and first - held[-1][1] <= 1000 * self.wait:
                held[-1] = (held[-1][0], max(last, held[-1][1]), held[-1][2] + n)
            else:
                held.append((first, last, n))
        for span in held[:-1]:
            yield self._row(key, *span)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.open.update(held[-1])
        # the watermark has to be past the wait
        self.handle.registerTimer(held[-1][1] // 1000 + self.wait + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        if self.open.exists():
            first, last, edits = (int(v) for v in self.open.get())
            self.open.clear()
            yield self._row(key, first, last, edits)

    def close(self) -> None:
        pass


def due(edits: DataFrame, wait_ms: int = WAIT, late: str = "0 seconds") -> DataFrame:
    """A streaming DataFrame of edits (design_id, at) to one of designs that are due.  Needs the state store `with_timers` sets."""
    e = edits.select("design_id", "at", F.unix_micros("at").alias("us")).withWatermark("at", late)
    return e.groupBy("design_id").transformWithStateInPandas(Debounce(wait_ms), DUE, "append", "eventTime")


def with_timers(spark: SparkSession) -> None:
    """Timers need a state store that keeps more than one column family."""
    spark.conf.set(_STORE, _ROCKS)


def run_stream(spark: SparkSession, folder: str, edits, wait_ms: int, files: str = "*.parquet", late: str = "0 seconds") -> DataFrame:
    """Runs the files of a folder through `due` until they are used up (`edits` makes a table of edits of the files' rows), and reads what
    came out.  What is still being edited at the end stays in the stream's state."""
    at = f"{shared_dir(spark).rstrip('/')}/recompile-{uuid.uuid4().hex}"
    schema = spark.read.option("pathGlobFilter", files).parquet(f"{folder}/{files}").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", 1).parquet(folder)
    store = spark.conf.get(_STORE)
    with_timers(spark)
    try:
        q = due(edits(source), wait_ms, late).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(_STORE, store)
    return spark.read.schema(DUE).parquet(f"{at}/out")
