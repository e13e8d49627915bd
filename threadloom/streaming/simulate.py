"""The player's state machine over streams of machine operations.

Batch: islands between stitches (operators.machine.frames).  Streaming: an arbitrary-state operator keyed by design keeps what is
pending (jump, trim, colour changes) and the running numbers, so a frame leaves with the micro-batch of its stitch.
Structured Streaming over machine operations is an extension of ours.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAMES = "design_id long, stitch_no long, x int, y int, color_index long, from_jump boolean, after_trim boolean, color_changed boolean"
STATE = "stitch_no long, color_index long, jump boolean, trim boolean, change boolean"


def event_ops(events: DataFrame) -> DataFrame:
    """A user's events as an op stream: design_id, op_seq, kind, x, y."""
    k = F.col("event_id") % 7
    kind = F.when(k == 0, "jump").when(k == 3, "trim").when(k == 5, "colorChange").otherwise("stitch")
    return events.select(F.col("user_id").alias("design_id"), F.col("event_id").alias("op_seq"), kind.alias("kind"), ((F.col("event_id") % 1000).cast("int") - 500).alias("x"), ((F.col("event_id") % 777).cast("int") - 388).alias("y"))


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Frames of the ops that have come for one design, and what is left pending."""
    n, color, jump, trim, change = state.get if state.exists else (0, 0, False, False, False)
    # ops of one design come in order of op_seq from batch to batch; within one they are sorted here
    ops = pd.concat(list(batches)).sort_values("op_seq", kind="stable")
    is_stitch = (ops["kind"] == "stitch").to_numpy()
    # an op belongs to the stitch that comes next: islands between stitches, of which only the first one inherits what was pending
    island = np.cumsum(is_stitch) - is_stitch
    m = int(is_stitch.sum())
    each = {k: np.bincount(island[(ops["kind"] == k).to_numpy()], minlength=m + 1) for k in ("jump", "trim", "colorChange")}
    flags = {k: v > 0 for k, v in each.items()}
    for k, pending in (("jump", jump), ("trim", trim), ("colorChange", change)):
        flags[k][0] |= pending
    colors = color + np.cumsum(each["colorChange"])
    last = {k: bool(v[m]) for k, v in flags.items()}
    state.update((n + m, int(colors[m]), last["jump"], last["trim"], last["colorChange"]))
    sewn = ops[is_stitch]
    yield pd.DataFrame({"design_id": key[0], "stitch_no": n + 1 + np.arange(m), "x": sewn["x"].to_numpy(), "y": sewn["y"].to_numpy(), "color_index": colors[:m], "from_jump": flags["jump"][:m], "after_trim": flags["trim"][:m], "color_changed": flags["colorChange"][:m]})


def stream_frames(ops: DataFrame) -> DataFrame:
    """A streaming DataFrame of ops to one of frames."""
    return ops.groupBy("design_id").applyInPandasWithState(advance, FRAMES, STATE, "append", GroupStateTimeout.NoTimeout)


def run_stream(spark: SparkSession, folder: str, files: str = "*.parquet") -> DataFrame:
    """Runs the event files of a folder through the stream until they are used up, and reads what came out."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        base = spark.conf.get("spark.sql.warehouse.dir")
    at = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = spark.read.option("pathGlobFilter", files).parquet(f"{folder}/{files}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    q = stream_frames(event_ops(events)).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(FRAMES).parquet(f"{at}/out")
