"""Writes: per-video overwrite of layer tables, latest-wins maps, status flags and id migrations.

Layer tables are Parquet partitioned by video_id and overwritten dynamically: a rerun of some videos replaces
exactly their partitions, through Spark's commit protocol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text
from tracelake.sources import staging


def write_layer(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """Replace the partitions of the videos in df; without overwrite an existing table is an error."""
    writer = df.write.partitionBy("video_id").option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def append_layer(df: DataFrame, path: str) -> None:
    df.write.partitionBy("video_id").mode("append").parquet(path)


def latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def mark_segments_built(events: DataFrame, built: DataFrame) -> DataFrame:
    """Set segment_built for the videos in built."""
    done = built.select("video_id").distinct().withColumn("_done", F.lit(True))
    flag = F.coalesce("_done", "segment_built", F.lit(False))
    return events.join(done, "video_id", "left").withColumn("segment_built", flag).drop("_done")


def migrated_event_ids(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with short ids, and the mapping old to new."""
    new = text.short_event_id("event_id")
    mapping = events.select(F.col("event_id").alias("old"), new.alias("new")).where("old <> new").distinct()
    return events.withColumn("event_id", new), mapping


def remapped_paths(frames: DataFrame, listing: DataFrame, column: str = "frame_path") -> DataFrame:
    """Paths replaced by the listed file of the same name, if there is one (the first by path)."""
    files = listing.groupBy(text.base_name("path").alias("_name")).agg(F.min("path").alias("_path"))
    joined = frames.withColumn("_name", text.base_name(column)).join(files, "_name", "left")
    return joined.withColumn(column, F.coalesce("_path", column)).drop("_name", "_path")


def numbered(df: DataFrame, order: list[str], start: int = 0, per: str | None = None) -> DataFrame:
    """ext_id from start on, in this order (within `per` when given).

    Without `per` the rows are sorted over all partitions and written; a row's number is its place in its partition plus the sizes of
    those before, so that no task sees more than its own."""
    if per:
        return df.withColumn("ext_id", F.row_number().over(Window.partitionBy(per).orderBy(*order)) - 1 + start)
    part, place = "_part", "_place"
    rows = staging.staged(df.orderBy(*order).withColumn(part, F.spark_partition_id()), "numbered")
    sizes = {r[part]: r["count"] for r in rows.groupBy(part).count().collect()}  # one row per partition
    before, at = {}, start
    for p in sorted(sizes):
        before[p], at = at, at + sizes[p]
    if not before:
        return rows.drop(part).withColumn("ext_id", F.lit(None).cast("long"))
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for p in before.items() for x in p]), F.col(part).cast("long"))
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    return rows.withColumn("ext_id", offset + F.col(place)).drop(part, place)


def next_id(table: DataFrame, column: str = "ext_id") -> int:
    """The number after the largest that was given."""
    largest = table.agg(F.max(column)).first()[0]
    return 0 if largest is None else largest + 1


def write_segments(segments: DataFrame, embeddings: DataFrame, path: str) -> None:
    """The two tables of the segment layer: segments, and what is known of each segment's vector."""
    write_layer(segments, f"{path}/segments")
    write_layer(embeddings, f"{path}/embeddings")


def split_vectors(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Vectors and their metadata as two tables with the same keys (position within a video, or segment)."""
    return rows.select("video_id", *keys, "vec"), rows.drop("vec")


def write_vectors(rows: DataFrame, path: str, keys: list[str]) -> None:
    """A matrix table and a metadata table, both replaced video by video."""
    matrix, meta = split_vectors(rows, keys)
    write_layer(matrix, f"{path}/matrix")
    write_layer(meta, f"{path}/meta")


def read_vectors(spark, path: str, keys: list[str]) -> DataFrame:
    """What write_vectors wrote, joined again."""
    return spark.read.parquet(f"{path}/matrix").join(spark.read.parquet(f"{path}/meta"), ["video_id", *keys])
