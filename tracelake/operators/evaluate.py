"""Retrieval quality: precision and recall on spans, hit rates and reciprocal rank by category, event boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text


def precision_recall(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per query: hits, precision_at_k (over k) and recall (over expected spans).

    results: query_id, rank, video_name, start_ts, end_ts; expected: query_id, number, video_name, start_ts, end_ts.
    A result hits the first expected span of its video (by number) that it overlaps."""
    own = results.where(F.col("rank") <= k).withColumn("_stem", text.folded_stem("video_name"))
    want = expected.select(
        F.col("query_id").alias("_q"), "number", text.folded_stem("video_name").alias("_s"), F.col("start_ts").alias("_a"), F.col("end_ts").alias("_b")
    )
    meet = (F.col("query_id") == F.col("_q")) & (F.col("_stem") == F.col("_s"))
    meet = meet & (F.greatest("start_ts", "_a") <= F.least("end_ts", "_b"))
    first = own.join(want, meet).groupBy("query_id", "rank").agg(F.min("number").alias("number"))
    met = first.groupBy("query_id").agg(F.count("*").alias("hits"), F.count_distinct("number").alias("matched"))
    total = expected.groupBy("query_id").agg(F.count("*").alias("expected"))
    asked = results.select("query_id").union(expected.select("query_id")).distinct()
    joined = asked.join(met, "query_id", "left").join(total, "query_id", "left").fillna(0, ["hits", "matched", "expected"])
    recall = F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).otherwise(0.0)
    return joined.select("query_id", "hits", (F.col("hits") / F.lit(k)).alias("precision_at_k"), recall.alias("recall"))


def by_mode(reports: DataFrame, places: int = 4) -> DataFrame:
    """Macro means per mode of the queries' precision and recall (mode, precision_at_k, recall)."""
    return reports.groupBy("mode").agg(
        F.count("*").alias("n_queries"), F.round(F.avg("precision_at_k"), places).alias("precision_at_k"), F.round(F.avg("recall"), places).alias("recall")
    )


def first_relevant(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query the first rank (0: none) whose video is expected, and whether it is at 1 or up to 5."""
    own = results.select("query_id", "rank", text.folded_stem("video_name").alias("_s"))
    want = expected.select("query_id", text.folded_stem("video_name").alias("_s")).distinct()
    found = own.join(want, ["query_id", "_s"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    rows = results.select("query_id").union(expected.select("query_id")).distinct().join(found, "query_id", "left").fillna(0, ["first_rank"])
    return rows.select("query_id", "first_rank", (F.col("first_rank") == 1).alias("hit_at_1"), F.col("first_rank").between(1, 5).alias("hit_at_5"))


def by_category(reports: DataFrame, places: int = 4) -> DataFrame:
    """R@1, R@5 and MRR per (category, subcategory), per category and in all: one rollup."""
    reciprocal = F.when(F.col("first_rank") > 0, 1 / F.col("first_rank")).otherwise(0.0)
    return reports.rollup("category", "subcategory").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("hit_at_1").cast("double")), places).alias("recall_at_1"),
        F.round(F.avg(F.col("hit_at_5").cast("double")), places).alias("recall_at_5"),
        F.round(F.avg(reciprocal), places).alias("mrr"),
    )


def best_per_video(results: DataFrame, k: int, group: list[str] | None = None) -> DataFrame:
    """The best result of each video, then the k best of those, ranked (per group if given)."""
    group = group or []
    w = Window.partitionBy(*group, "_s").orderBy(F.desc("score"), "video_name")
    best = results.withColumn("_s", text.folded_stem("video_name")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "_s"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).drop("_s")


def boosted(clip: DataFrame, events: DataFrame, boost: float, floor: float = 0.60, alone: float = 0.35) -> DataFrame:
    """Vector results (video_name, score) lifted by event confidence, plus videos that only the events name."""
    sure = events.groupBy(text.folded_stem("video_name").alias("_s")).agg(F.max("confidence").alias("_e"), F.min("video_name").alias("_name"))
    own = clip.withColumn("_s", text.folded_stem("video_name"))
    lifted = own.join(sure.drop("_name"), "_s", "left").withColumn("_e", F.coalesce("_e", F.lit(0.0)))
    plus = F.col("score") + boost * F.col("_e")
    lifted = lifted.select("video_name", F.when(F.col("_e") > 0, F.greatest(plus, floor * F.col("_e"))).otherwise(plus).alias("score"), F.col("_e").alias("event_confidence"))
    only = sure.join(own.select("_s").distinct(), "_s", "left_anti")
    only = only.select(F.col("_name").alias("video_name"), F.greatest(alone + boost * F.col("_e"), floor * F.col("_e")).alias("score"), F.col("_e").alias("event_confidence"))
    return lifted.unionByName(only)


def event_counts(events: DataFrame) -> DataFrame:
    """Events per video and the distinct types among them."""
    return events.groupBy("video_id").agg(F.count("*").alias("n_events"), F.array_sort(F.collect_set("event_type")).alias("event_types"))


def ingest_totals(rows: DataFrame, nested: str, key: str = "video_id") -> DataFrame:
    """Videos and elements of a nested layer column in all."""
    return rows.agg(F.count_distinct(key).alias("n_videos"), F.coalesce(F.sum(F.size(nested)), F.lit(0)).alias("n_items"))
