"""The vector table: build, upsert, remove, statistics.  Rows carry vector and metadata together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import vectors


def checked(rows: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Rows fit for the table (unit vectors, times to two places), and the rejected ones with a reason."""
    reason = (
        F.when(F.col("vec").isNull() | (F.size("vec") != dimension), F.lit("dimension"))
        .when(F.exists("vec", lambda x: x.isNull() | F.isnan(x)), F.lit("not a number"))
        .when((F.col("kind") == "frame") & (F.coalesce("frame_path", F.lit("")) == ""), F.lit("no frame path"))
        .when((F.col("kind") == "segment") & (F.coalesce("segment_id", F.lit("")) == ""), F.lit("no segment id"))
    )
    marked = rows.withColumn("_reason", reason)
    at = F.when(F.col("kind") == "segment", (F.col("start_ts") + F.col("end_ts")) / 2).otherwise(F.col("timestamp_seconds"))
    good = marked.where("_reason is null").drop("_reason").withColumn("vec", vectors.normalised(F.col("vec"))).withColumn("timestamp_seconds", F.round(at, 2))
    return good, marked.where("_reason is not null").withColumnRenamed("_reason", "reason")


def built(rows: DataFrame, order: list[str], key: str = "frame_id") -> DataFrame:
    """The first row of each key, in `order`; rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    keyed = rows.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return keyed.unionByName(rows.where(F.coalesce(F.col(key), F.lit("")) == ""))


def upserted(table: DataFrame, new: DataFrame, overwrite: bool = True, key: str = "video_id") -> DataFrame:
    """table with the rows of new; overwrite drops what it holds of the same videos."""
    kept = table.join(new.select(key).distinct(), key, "left_anti").select(table.columns) if overwrite else table
    return kept.unionByName(new)


def removed(table: DataFrame, video: str, key: str = "video_id") -> DataFrame:
    return table.where(~F.col(key).eqNullSafe(F.lit(video)))


def statistics(table: DataFrame, key: str = "video_id", approximate: bool = False) -> DataFrame:
    """Number of vectors and of videos."""
    videos = F.approx_count_distinct(key) if approximate else F.count_distinct(F.col(key))
    return table.agg(F.count("*").alias("n_vectors"), videos.alias("n_videos"))


def is_stale(table: DataFrame, needed: tuple[str, ...] = ("frame_id", "segment_id")) -> bool:
    """A table without the columns of the present layout must be rebuilt."""
    return not set(needed) <= set(table.columns)


def encoded(rows: DataFrame, encode, column: str, dimension: int, batch: int = 8) -> DataFrame:
    """rows with `vec` from an injected encoder of lists (loaded once per worker, `batch` values at a time)."""
    @F.pandas_udf("array<float>")
    def run(parts: pd.Series) -> pd.Series:
        values = parts.tolist()
        made = [v for at in range(0, len(values), batch) for v in np.asarray(encode(values[at : at + batch]), np.float32).reshape(-1, dimension)]
        return pd.Series([v / (np.linalg.norm(v) or 1.0) for v in made])

    return rows.withColumn("vec", run(F.col(column)))
