"""The driver's tables as layers of the engine (expressions that any SQL engine computes alike).

events: a user is a track, an event type a label, value and the number in props the position, a user's last digit the
video; 'error' rows are red lights, 'view' rows green ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = ((100.0, 0.0), (100.0, 99.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, track, video, label, t (seconds), day, cx, cy, conf."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("track"), (F.col("user_id") % 10).alias("video"), F.col("event_type").alias("label"), (micros / 1e6).alias("t"),
        F.floor(micros / 86_400_000_000).cast("long").alias("day"), F.col("value").alias("cx"), F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("cy"),
        (F.col("value") / 500).alias("conf"),
    )


def boxed(obs: DataFrame, half: float = 5.0) -> DataFrame:
    box = F.struct((F.col("cx") - half).alias("x1"), (F.col("cy") - half).alias("y1"), (F.col("cx") + half).alias("x2"), (F.col("cy") + half).alias("y2"))
    return obs.withColumn("box", box)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as track points of the rules."""
    obs = boxed(observations(spark, sf_dir))
    return obs.select(
        F.col("video").cast("string").alias("video_id"), F.col("track").cast("string").alias("track_id"), F.lit("car").alias("label"), "t", "cx", "cy", "box", "conf",
        F.format_string("f_%012d.jpg", "event_id").alias("frame_path"), F.col("event_id").alias("pid"),
    )


def lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).where(F.col("label").isin("error", "view"))
    return rows.select(
        F.col("video").cast("string").alias("video_id"), "t", F.when(F.col("label") == "error", F.lit("red")).otherwise("green").alias("state"), "conf",
        F.format_string("l_%012d.jpg", "event_id").alias("frame_path"),
    )


#: The same adapters in SQL, for oracles.
OBS = """obs AS (SELECT event_id, user_id AS track, user_id % 10 AS video, event_type AS label,
    (epoch_us(ts) - 1704067200000000) / 1e6 AS t, CAST(floor((epoch_us(ts) - 1704067200000000) / 86400000000) AS BIGINT) AS day,
    value AS cx, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS cy, value / 500 AS conf FROM events)"""
