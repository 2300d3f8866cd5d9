"""Scans of the per-video JSON layers and their flat (silver) tables.

A document that does not parse is left out and can be listed with `bad_documents`.  Each document is one
Spark row; `explode` keeps the video's columns, so no later lookup of a frame's video is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_BAD = "_corrupt_record"


def _documents(spark: SparkSession, path: str, schema: T.StructType, pattern: str) -> DataFrame:
    """One row per file: file, its text, and the parsed document with the text again if it does not parse."""
    with_bad = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).withColumn("file", F.input_file_name())
    return files.withColumn("doc", F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}))


def scan(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.json") -> DataFrame:
    """Valid documents of a layer with the file they come from."""
    good = F.col("doc").isNotNull() & F.col(f"doc.{_BAD}").isNull()
    return _documents(spark, path, schema, pattern).where(good).select("doc.*", "file").drop(_BAD)


def bad_documents(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.json") -> DataFrame:
    bad = F.col("doc").isNull() | F.col(f"doc.{_BAD}").isNotNull()
    return _documents(spark, path, schema, pattern).where(bad).select("file", F.col("value").alias("document"))


def box(c: Column) -> Column:
    """struct(x1, y1, x2, y2) of a four-number array; nulls for any other array."""
    good = F.size(c) == 4
    return F.struct(*[F.when(good, F.try_element_at(c, F.lit(i + 1))).alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))])


def detections(docs: DataFrame) -> DataFrame:
    """One row per detection."""
    frames = docs.select("file", "video_id", "video_name", "video_path", F.posexplode("frames").alias("frame_no", "frame"))
    rows = frames.select("file", "video_id", "video_name", "video_path", "frame_no", F.col("frame.frame_path").alias("frame_path"), F.col("frame.timestamp").alias("ts"), F.posexplode("frame.detections").alias("det_no", "d"))
    label = F.coalesce(F.col("d.label"), F.col("d.class"), F.lit(""))
    return rows.select("file", "video_id", "video_name", "video_path", "frame_no", "frame_path", "ts", "det_no", label.alias("label"), F.coalesce("d.confidence", F.lit(0.0)).alias("confidence"), F.col("d.class_id").alias("class_id"), box(F.col("d.bbox")).alias("box"))


def tracks(docs: DataFrame) -> DataFrame:
    """One row per track, points nested in order."""
    return docs.select("video_id", "video_name", "video_path", F.explode("tracks").alias("t")).select("video_id", "video_name", "video_path", "t.*")


def track_points(track_rows: DataFrame) -> DataFrame:
    """One row per point with its position in the track."""
    rows = track_rows.select("video_id", "track_id", "label", F.posexplode("points").alias("i", "p"))
    return rows.select("video_id", "track_id", "label", "i", F.col("p.timestamp").alias("t"), F.col("p.center_x").alias("cx"), F.col("p.center_y").alias("cy"), F.col("p.confidence").alias("conf"), F.col("p.frame_path").alias("frame_path"), box(F.col("p.bbox")).alias("box"))


def events(docs: DataFrame) -> DataFrame:
    """One row per event; the event's own video columns win over the document's."""
    rows = docs.select(F.col("video_id").alias("_v"), F.col("video_name").alias("_n"), F.col("video_path").alias("_p"), "segment_built", F.explode("events").alias("e")).select("*", "e.*").drop("e")
    for own, other in (("video_id", "_v"), ("video_name", "_n"), ("video_path", "_p")):
        rows = rows.withColumn(own, F.coalesce(F.nullif(F.col(own), F.lit("")), F.col(other))).drop(other)
    return rows


def ocr_texts(docs: DataFrame) -> DataFrame:
    """One row per recognised text; null texts and malformed polygons are left out."""
    frames = docs.select("video_name", F.posexplode("frames").alias("frame_no", "f"))
    rows = frames.select("video_name", "frame_no", F.col("f.frame_path").alias("frame_path"), F.col("f.timestamp_sec").alias("ts"), F.col("f.display_time").alias("display_time"), F.posexplode("f.ocr_results").alias("text_no", "r"))
    sound = F.coalesce(F.forall("r.bbox", lambda p: F.size(p) == 2), F.lit(True))
    return rows.where(F.col("r.text").isNotNull() & sound).select("video_name", "frame_no", "frame_path", "ts", "display_time", "text_no", F.col("r.text").alias("text"), F.coalesce("r.score", F.lit(0.0)).alias("score"))


def segments(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.explode("segments").alias("s")).select("s.*")
    return rows.withColumn("start_ts", F.col("time_range.start")).withColumn("end_ts", F.col("time_range.end")).drop("time_range")


def video_of_frame(detection_rows: DataFrame) -> DataFrame:
    """frame_path to the video of the first file (by name) that holds it."""
    return detection_rows.groupBy("frame_path").agg(F.min_by("video_id", "file").alias("video_id"))


def frames_by_video(frames: DataFrame) -> DataFrame:
    """video_id with its frames (ts, frame_path) in order of time.  One row holds one video's frames."""
    return frames.groupBy("video_id").agg(F.sort_array(F.collect_set(F.struct("ts", "frame_path"))).alias("frames"))


class LayerCache:
    """Flat layers kept in memory while their files are unchanged; over `most` entries everything is let go."""

    def __init__(self, most: int = 1024):
        self.most, self.held = most, {}

    def read(self, spark: SparkSession, path: str, schema: T.StructType, flatten, pattern: str = "*.json") -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
        state = files.agg(F.count("*"), F.max("modificationTime"), F.sum("length")).first()
        key = (path, flatten)
        if key in self.held and self.held[key][0] == state:
            return self.held[key][1]
        if key in self.held:
            self.held.pop(key)[1].unpersist()
        if len(self.held) >= self.most:
            for _, df in self.held.values():
                df.unpersist()
            self.held.clear()
        self.held[key] = (state, flatten(scan(spark, path, schema, pattern)).cache())
        return self.held[key][1]
