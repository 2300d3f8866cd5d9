"""Listings, importers and array bundles: file sources that are not JSON layers.

Listings read file names only (`binaryFile` without its content column), so they scale with the number of
files, not their size.
"""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import text

VIDEO_PATTERN = r"(?i)\.(mp4|avi)$"


def _listing(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def videos(spark: SparkSession, path: str) -> DataFrame:
    """Video files below a folder, each once."""
    found = _listing(spark, path).where(F.col("path").rlike(VIDEO_PATTERN)).dropDuplicates(["path"])
    return found.select("path", "length", text.asset_id("path").alias("video_id"), text.stem("path").alias("video_name"))


def sampling_step(fps: float, interval_sec: float, frame_step: int | None = None) -> int:
    """Every how many frames one is taken: the given step, else the interval in frames, at least 1."""
    return max(1, int(frame_step) if frame_step else round(fps * interval_sec))


def sampled_frames(frames: DataFrame, fps: float, step: int) -> DataFrame:
    """frames (video_id, frame_index) that sampling keeps, with their time."""
    return frames.where(F.col("frame_index") % step == 0).withColumn("ts", F.round(F.col("frame_index") / F.lit(float(fps)), 2))


def image_sequences(spark: SparkSession, path: str, fps: float, step: int = 1, names: tuple[str, ...] = (), limit: int | None = None, first_index: int = 0) -> DataFrame:
    """Image folders as videos: the folder names the video, the file's last number less first_index is the frame.

    Every step-th frame in frame order; ts = frame / fps to three places; `limit` keeps the first frames of a video."""
    files = _listing(spark, path).where(F.col("path").rlike(r"(?i)\.(jpg|jpeg|png|npz)$"))
    name = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    index = F.regexp_extract("path", r"(\d+)\D*\.[^.]+$", 1).try_cast("long")
    rows = files.select("path", name.alias("video_name"), index.alias("frame_index")).where("frame_index is not null")
    rows = rows.withColumn("frame_index", F.col("frame_index") - first_index)
    if names:
        rows = rows.where(F.col("video_name").isin(*names))
    order = F.row_number().over(Window.partitionBy("video_name").orderBy("frame_index", "path")) - 1
    rows = rows.withColumn("ordinal", order).where(F.col("ordinal") % max(1, step) == 0)
    if limit is not None:
        rows = rows.where(F.col("ordinal") < limit * max(1, step))
    return rows.withColumn("ts", F.round(F.col("frame_index") / F.lit(float(fps)), 3))


def archive_frames(spark: SparkSession, path: str, fps: float, step: int = 1, limit: int | None = None) -> DataFrame:
    """Frames held in .npz archives (path, video_name, frame, frame_index, ts): each archive is a video, its arrays are frames by the last number
    of their names.  Only the archives' directories are read; every step-th frame in order stays, `limit` of a video at most."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path)

    def names(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    held = [n.removesuffix(".npy") for n in zipfile.ZipFile(io.BytesIO(content)).namelist()]
                except zipfile.BadZipFile:
                    continue
                yield pd.DataFrame({"path": name, "frame": held})

    rows = files.select("path", "content").mapInPandas(names, "path string, frame string")
    rows = rows.withColumn("frame_index", F.regexp_extract("frame", r"(\d+)\D*$", 1).try_cast("long")).where("frame_index is not null")
    order = F.row_number().over(Window.partitionBy("path").orderBy("frame_index", "frame")) - 1
    rows = rows.withColumn("_n", order).where(F.col("_n") % max(1, step) == 0)
    if limit is not None:
        rows = rows.where(F.col("_n") < limit * max(1, step))
    return rows.select("path", text.stem("path").alias("video_name"), "frame", "frame_index", F.round(F.col("frame_index") / F.lit(float(fps)), 3).alias("ts"))


#: Names of the positional fields of an accident meta file's first line.
META_FIELDS = (
    "weather", "ego_agent_id", "ego_agent_type", "other_agent_id", "other_agent_type", "collision_distance", "spawn_side",
    "collision_position", "collision_frame",
)


def accident_meta(spark: SparkSession, path: str, fields: tuple[str, ...] = META_FIELDS) -> DataFrame:
    """file, meta MAP<STRING,STRING>: the first line by position (eight tokens at least), then `key: value` lines."""
    docs = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = F.split("value", r"\r?\n")
    first = F.split(F.trim(F.element_at(lines, 1)), r"\s+")
    positional = F.map_from_arrays(
        F.slice(F.array(*[F.lit(f) for f in fields]), 1, F.least(F.size(first), F.lit(len(fields)))),
        F.slice(first, 1, F.least(F.size(first), F.lit(len(fields)))),
    )
    pairs = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: x.contains(":"))
    keyed = F.transform(pairs, lambda x: F.struct(F.regexp_replace(F.trim(F.substring_index(x, ":", 1)), r"\s+", "_").alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    # the last of equal keys wins: keep those with no later one of the same name
    last = F.filter(keyed, lambda p, i: ~F.exists(F.slice(keyed, i + 2, F.size(keyed)), lambda q: q["k"] == p["k"]))
    named = F.map_from_entries(last)
    merged = F.map_concat(F.map_filter(positional, lambda k, v: ~F.map_contains_key(named, k)), named)
    return docs.where(F.size(first) >= 8).select("file", merged.alias("meta"))


def array_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the .npy matrices below a folder: file, position, vec.  Files that are not 2-d are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)

    def rows(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    matrix = np.load(io.BytesIO(content), allow_pickle=False)
                except (ValueError, EOFError):
                    continue
                if matrix.ndim == 2:
                    yield pd.DataFrame({"file": name, "position": np.arange(len(matrix)), "vec": list(matrix.astype(np.float32))})

    return files.select("path", "content").mapInPandas(rows, "file string, position long, vec array<float>")


def bundle_vectors(spark: SparkSession, path: str, meta_schema) -> DataFrame:
    """.npy rows joined by position with the list in the .json of the same stem; files of unequal length are left out."""
    vectors = array_bundle(spark, path).withColumn("bundle", text.stem("file"))
    docs = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    docs = docs.select(text.stem(F.input_file_name()).alias("bundle"), F.from_json("value", f"array<{meta_schema}>").alias("items"))
    meta = docs.select("bundle", F.size("items").alias("n"), F.posexplode("items").alias("position", "meta"))
    sized = vectors.groupBy("bundle").agg(F.count("*").alias("rows"))
    good = meta.join(sized, "bundle").where("n = rows").drop("n", "rows")
    return vectors.join(good, ["bundle", "position"]).select("bundle", "position", "vec", "meta.*")


def legacy_index(spark: SparkSession, path: str, meta_schema: str) -> DataFrame:
    """Metadata of an index in its old form, one JSON list: the place in the list is the vector's id (ext_id)."""
    docs = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return docs.select(F.posexplode(F.from_json("value", f"array<{meta_schema}>")).alias("ext_id", "meta")).select(F.col("ext_id").cast("long"), "meta.*")
