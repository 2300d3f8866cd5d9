"""Streaming forms of the ordered operators.  All use event time, a watermark and append mode, so late rows past
the watermark are dropped, and state goes with it: windows and sessions when they are closed, the state of a key that went quiet
after IDLE.  Each has a batch twin in operators/.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.operators import tracking
from tracelake.sources import sinks, staging

LATE, IDLE = "10 seconds", "1 day"


def source(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """A file stream of Parquet."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], value: str, late: str = LATE) -> DataFrame:
    """Count and sum per window and key."""
    rows = events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, key: str, late: str = LATE) -> DataFrame:
    """Sessions of a key's rows: start, end (last row plus gap) and size."""
    rows = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"), F.max(at).alias("last"))
    return rows.select(key, F.col("session_window.start").alias("start"), "last", "n")


def red_phases(lights: DataFrame, at: str, gap: str, key: str, late: str = LATE) -> DataFrame:
    """Continuous red phases of each key.  Time moves on with red rows only: the filter runs before the watermark."""
    return sessions(lights.where("state = 'red'"), at, gap, key, late).select(key, F.col("start").alias("phase_start"), F.col("last").alias("phase_end"))


def _in_order(frames: DataFrame, key: str, at: str, order: list[str], late: str, idle: str, advance: Callable, fresh: Callable, kinds: str) -> DataFrame:
    """Stateful step over each key's rows in order of time: advance(state, rows) returns the rows to give out.

    Rows wait in the state until the watermark has passed them, so that rows of later triggers still find their place; after `idle`
    without rows a key's state is given up, and a key that comes back begins anew."""
    columns = frames.columns
    spare = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting, last = pickle.loads(state.get[0]) if state.exists else (fresh(), None, None)
        got = [] if state.hasTimedOut else list(parts)
        rows = pd.concat([waiting, *got] if waiting is not None else got) if got else waiting
        mark = state.getCurrentWatermarkMs()
        if rows is None or rows.empty:
            state.remove()  # only a key that went quiet times out without rows that wait
            return
        time = rows[at].astype("datetime64[ms]").astype("int64").to_numpy()
        rows, time = rows.iloc[np.argsort(time, kind="stable")], np.sort(time)
        done = int(np.searchsorted(time, mark))
        # a pause of more than `idle` parts what is before from what comes after
        parted = np.flatnonzero(np.diff(time[:done], prepend=time[0] if last is None else last) > spare)
        for a, b in zip([0, *parted.tolist()], [*parted.tolist(), done], strict=True):
            held = fresh() if a in parted else held
            if b > a:
                yield advance(group, held, rows.iloc[a:b].sort_values(order, kind="stable"))
        last, waiting = (int(time[done - 1]) if done else last), rows.iloc[done:]
        state.update((pickle.dumps((held, waiting if len(waiting) else None, last)),))
        state.setTimeoutTimestamp(max(int(time[done]) if len(waiting) else last + spare, mark + 1))

    return frames.select(columns).withWatermark(at, late).groupBy(key).applyInPandasWithState(step, kinds, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def retained(frames: DataFrame, key: str, index: str, hit: str, at: str, keep: int = 60, late: str = LATE, idle: str = IDLE) -> DataFrame:
    """Frames at most `keep` after a hit, in order of index among the frames that the watermark has passed.

    The state of a key is its count of frames, its last hit and the frames that still wait."""

    def advance(group: tuple, held: dict, rows: pd.DataFrame) -> pd.DataFrame:
        number = held["seen"] + 1 + np.arange(len(rows))
        last = np.maximum.accumulate(np.where(rows[hit].to_numpy(bool), number, held["last"]))
        held["seen"], held["last"] = int(number[-1]), int(last[-1])
        return rows[(last > 0) & (number - last <= keep)][[key, index]].assign(**{key: group[0]})

    kinds = dict(frames.dtypes)
    rows = frames.select(*dict.fromkeys([key, index, hit, at]))
    return _in_order(rows, key, at, [index], late, idle, advance, lambda: {"seen": 0, "last": 0}, f"{key} {kinds[key]}, {index} {kinds[index]}")


def tracked(detections: DataFrame, at: str, late: str = LATE, idle: str = IDLE) -> DataFrame:
    """Track points of a stream of detections (tracking.tracked's columns and an event time `at`).

    The state of a video is its open tracks and the frames that the watermark has not passed yet, so a frame may come in several triggers."""

    def advance(group: tuple, held: tracking.Tracker, rows: pd.DataFrame) -> pd.DataFrame:
        return held.advance(rows)

    return _in_order(detections, "video_id", at, ["t", "frame_path"], late, idle, advance, tracking.Tracker, tracking.SCHEMA)


def upsert_into(path: str):
    """foreachBatch sink: replaces the partitions of the videos in each batch, so a repeated batch changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        sinks.write_layer(batch, path)

    return write


def drained(stream: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now into Parquet files of the shared folder, and read those."""
    spark = stream.sparkSession
    path = staging.new_path(spark, f"stream-{name}")
    writer = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", checkpoint or f"{path}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
