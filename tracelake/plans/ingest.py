"""The ingest chain as DataFrame stages: detections to tracks to events to segments.

Each stage is idempotent by video_id (sinks.write_layer) and is used alike in batch and in foreachBatch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import text
from tracelake.operators import rules, segments, tracking, tracks
from tracelake.sources import sinks, staging


def track_points(detections: DataFrame) -> DataFrame:
    """Tracked points with box, centre and a unique tie column."""
    flat = detections.select("video_id", "label", F.col("ts").alias("t"), "frame_path", "box.*", F.col("confidence").alias("conf"))
    rows = tracking.tracked(flat)
    return rows.select(
        "video_id", "track_id", "label", "t", "frame_path", "conf", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"),
        F.struct("x1", "y1", "x2", "y2").alias("box"), F.concat_ws("|", "track_id", F.col("t").cast("string"), "frame_path").alias("pid"),
    )


def track_table(points: DataFrame) -> DataFrame:
    """Track summaries in the layout of the trajectory layer."""
    best = points.select("video_id", "track_id", "pid", F.col("frame_path").alias("representative_frame"))
    rows = tracks.summaries(points, ["video_id", "track_id", "label"], "t", "pid")
    rows = rows.join(best.withColumnRenamed("pid", "best_point"), ["video_id", "track_id", "best_point"])
    return rows.select(
        "video_id", "track_id", "label", "start_ts", "end_ts", F.col("duration").alias("duration_sec"), F.col("n_points").cast("int").alias("frame_count"),
        F.col("avg_conf").alias("avg_confidence"), F.col("max_conf").alias("max_confidence"), "direction", "representative_frame",
    )


def run(spark: SparkSession, detections: DataFrame, lights: DataFrame, configs: dict[str, dict], durations: DataFrame | None = None, path: str | None = None, frames: DataFrame | None = None) -> dict[str, DataFrame]:
    """All layers derived from detections (sources.layers.detections).

    Points and events are written (below `path`, or as intermediate tables) before anything is built on them, so that tracking runs once."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        if path is None:
            return staging.staged(df, f"ingest-{name}")
        sinks.write_layer(df, f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}").select(df.columns)

    points = kept(track_points(detections), "points")
    events = kept(rules.run(spark, points, lights, configs), "events")
    built = kept(segments.build(events, durations, frames), "segments")
    return {"points": points, "tracks": kept(track_table(points), "tracks"), "events": events, "segments": built, "status": segments.status(detections, events, built)}


#: The classes that the detection layer keeps.
TRAFFIC_LABELS = ("car", "truck", "bus", "motorcycle", "person", "traffic light")


def traffic_only(detections: DataFrame) -> DataFrame:
    """Detections of the classes the layer keeps."""
    return detections.where(text.normal_label("label").isin(*TRAFFIC_LABELS))


def with_class_labels(detections: DataFrame, classes: DataFrame) -> DataFrame:
    """Labels by class_id within a frame: classes (frame_path, class_id, label, position), of a class given twice the last one counts."""
    last = classes.groupBy("frame_path", "class_id").agg(F.max_by("label", "position").alias("_label"))
    return detections.join(last, ["frame_path", "class_id"], "left").withColumn("label", F.coalesce("_label", "label")).drop("_label")


def with_files(frames: DataFrame, files: DataFrame, column: str = "frame_path") -> DataFrame:
    """Frames whose file is in the listing (path)."""
    there = files.select(text.normal_path("path").alias("_there")).distinct()
    return frames.withColumn("_own", text.normal_path(column)).join(there, F.col("_own") == F.col("_there"), "left_semi").drop("_own")


def tracks_in_order(rows: DataFrame) -> DataFrame:
    """Tracks as the trajectory layer lists them."""
    return rows.orderBy("video_id", "label", "start_ts", "track_id")


def named_videos(detections: DataFrame, sources: DataFrame) -> DataFrame:
    """Detections with the canonical name and path of their video; videos without a source are left out."""
    names = sources.select(text.folded_stem("path").alias("_s"), F.col("path").alias("_path"), text.base_name("path").alias("_name"))
    rows = detections.withColumn("_s", text.folded_stem("video_name")).join(names, "_s")
    return rows.withColumn("video_path", F.col("_path")).withColumn("video_name", F.col("_name")).drop("_s", "_path", "_name")
