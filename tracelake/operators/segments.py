"""Search segments: event groups and fallback windows, their text, numbering and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text
from tracelake.operators import intervals


def event_segments(events: DataFrame) -> DataFrame:
    """One row per run of touching events of a video, with everything the events hold."""
    rows = intervals.merged_intervals(events, ["video_id"], "start_ts", "end_ts", "event_id")
    order = F.struct("start_ts", "end_ts", "event_id", "event_type", "description", "track_id", "evidence")
    grouped = rows.groupBy("video_id", "island").agg(F.min("start_ts").alias("start"), F.max("end_ts").alias("end"), F.sort_array(F.collect_list(order)).alias("e"))
    told = F.filter("e.description", lambda d: d.isNotNull() & (d != ""))
    return grouped.select(
        "video_id", F.round("start", 2).alias("start_ts"), F.round("end", 2).alias("end_ts"),
        F.array_distinct(F.flatten(F.filter("e.evidence", lambda x: x.isNotNull()))).alias("frame_paths"),
        F.col("e.event_type").alias("events"), F.col("e.event_id").alias("event_ids"),
        F.array_sort(F.array_distinct(F.filter("e.track_id", lambda t: t.isNotNull()))).alias("tracks"),
        text.segment_text("video_id", "start", F.array_join(told, "；")).alias("text"), F.lit("事件描述模板").alias("text_source"),
    )


def fallback_segments(events: DataFrame, durations: DataFrame | None = None, frames: DataFrame | None = None, width: float = intervals.SEGMENT_SECONDS, whole_if_none: bool = False) -> DataFrame:
    """Fixed windows in the time no event covers.

    durations (video_id, duration) adds windows after the last event and videos without events; a video without any window
    gets [0, duration] when it has no event (with whole_if_none: even when events cover it).  frames
    (video_id, ts, path) gives each window its first three frames."""
    rows = intervals.gap_windows(events, "video_id", "start_ts", "end_ts", "event_id", width)
    if durations is not None:
        rows = rows.unionByName(intervals.tail_windows(events, "video_id", "end_ts", durations, width))
        bare = durations.where("duration > 0").join(rows.select("video_id").distinct(), "video_id", "left_anti")
        if not whole_if_none:
            bare = bare.join(events.select("video_id").distinct(), "video_id", "left_anti")
        rows = rows.unionByName(bare.select("video_id", F.lit(0.0).alias("start_ts"), F.col("duration").cast("double").alias("end_ts")))
    rows = rows.withColumn("start_ts", F.round("start_ts", 2)).withColumn("end_ts", F.round("end_ts", 2))
    none = F.array().cast("array<string>")
    if frames is None:
        rows = rows.withColumn("frame_paths", none)
    else:
        lane = F.explode(F.array_distinct(F.array(F.floor(F.col("start_ts") / width), F.floor((F.col("end_ts") + intervals.EPS) / width))))
        cut = rows.withColumn("_b", lane)
        own = frames.select(F.col("video_id").alias("_v"), F.col("ts").alias("_t"), F.col("path").alias("_p"), F.explode(F.array(F.floor(F.col("ts") / width), F.floor(F.col("ts") / width) - 1)).alias("_fb"))
        inside = (F.col("_t") >= F.col("start_ts") - intervals.EPS) & (F.col("_t") <= F.col("end_ts") + intervals.EPS)
        met = cut.join(own, (F.col("video_id") == F.col("_v")) & (F.col("_b") == F.col("_fb")) & inside, "left")
        near = F.sort_array(F.collect_set(F.when(F.col("_p").isNotNull(), F.struct("_t", "_p"))))
        rows = met.groupBy("video_id", "start_ts", "end_ts").agg(F.slice(near["_p"], 1, 3).alias("frame_paths"))
    return rows.select("video_id", "start_ts", "end_ts", "frame_paths", none.alias("events"), none.alias("event_ids"), none.alias("tracks"), text.segment_text("video_id", "start_ts", F.lit("")).alias("text"), F.lit("时间窗兜底").alias("text_source"))


def build(events: DataFrame, durations: DataFrame | None = None, frames: DataFrame | None = None, width: float = intervals.SEGMENT_SECONDS) -> DataFrame:
    """All segments, numbered events first, then windows; segment_id is {video_id}_segNNN."""
    own = event_segments(events).withColumn("_kind", F.lit(0))
    rest = fallback_segments(events, durations, frames, width).withColumn("_kind", F.lit(1))
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("_kind", "start_ts", "end_ts"))
    return own.unionByName(rest).withColumn("segment_id", text.segment_id("video_id", number)).drop("_kind")


def status(videos: DataFrame, events: DataFrame, segments: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """video_id and where segment building stands: no_events, build_failed, empty_segments, pipeline_failed or built.

    failures (video_id, stage): the stage that raised, `build` or anything after it."""
    has_event = events.select("video_id").distinct().withColumn("_e", F.lit(True))
    has_segment = segments.select("video_id").distinct().withColumn("_s", F.lit(True))
    rows = videos.select("video_id").distinct().join(has_event, "video_id", "left").join(has_segment, "video_id", "left")
    if failures is None:
        rows = rows.withColumn("_f", F.lit(None).cast("string"))
    else:
        rows = rows.join(failures.groupBy("video_id").agg(F.min(F.when(F.col("stage") == "build", F.lit("build")).otherwise("later")).alias("_f")), "video_id", "left")
    state = (
        F.when(F.col("_e").isNull(), F.lit("no_events")).when(F.col("_f") == "build", F.lit("build_failed")).when(F.col("_s").isNull(), F.lit("empty_segments"))
        .when(F.col("_f") == "later", F.lit("pipeline_failed")).otherwise("built")
    )
    return rows.select("video_id", state.alias("status"))
