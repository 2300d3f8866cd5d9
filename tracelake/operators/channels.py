"""Retrieval channels: each returns hits of one schema (sources.schemas.HIT), at most k of them.

A channel is pruned when the plan is built: an intent that a channel can't serve adds no scan.  Every order ends in a
unique column, so results do not depend on file or partition order.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import fuzzy, geometry, text, vectors
from tracelake.plans import intent as intents
from tracelake.plans import vocabulary
from tracelake.sources import schemas

OCR_CUTOFF = 60.0


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.HIT)


def hits(df: DataFrame, channel: str | Column, **columns: Column) -> DataFrame:
    """df in the hit schema; unnamed columns are null."""
    columns["channel"] = F.lit(channel)
    kinds = {f.name: f.dataType for f in schemas.HIT.fields}
    return df.select(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])


def top(df: DataFrame, k: int, *order) -> DataFrame:
    if k < 1:
        raise ValueError("top_k must be at least 1")
    return df.orderBy(*order).limit(k)


# ---- detections ------------------------------------------------------------------------------------------------------


def frames_where(primary: DataFrame, context: DataFrame, relation: str | None, frame: list[str]) -> DataFrame:
    """Primary detections of frames in which some primary and some context detection stand in the relation.

    One semi join on the frame with the relation as its residual; then a semi join on the frames found.  Without a
    relation the two need only occur together."""
    if relation is None:
        return primary.join(context.select(*frame).distinct(), frame, "left_semi")
    other = context.select(*[F.col(c).alias(f"_c_{c}") for c in frame], F.col("box").alias("_c_box"))
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_c_{c}") for c in frame])
    found = primary.join(other, same & geometry.RELATIONS[relation](F.col("box"), F.col("_c_box")), "left_semi")
    return primary.join(found.select(*frame).distinct(), frame, "left_semi")


def detection_rows(detections: DataFrame, intent: intents.Intent) -> DataFrame | None:
    """Detections that answer the intent, or None if it names nothing to detect."""
    if intent.query_type == "event" or not intent.primary:
        return None
    wanted = [e.replace("_", " ") for e in intent.primary]
    label = text.normal_label("label")
    primary = detections.where(label.isin(*wanted))
    seen = [e.replace("_", " ") for e in intent.context if e in vocabulary.DETECTABLE]
    if not seen:
        return primary
    relation = next((r for r in geometry.RELATIONS if r in intent.relations), None)
    return frames_where(primary, detections.where(label.isin(*seen)), relation, ["video_id", "frame_path"])


def detection(detections: DataFrame, intent: intents.Intent, k: int) -> DataFrame:
    """Detections (sources.layers.detections) by confidence."""
    rows = detection_rows(detections, intent)
    if rows is None:
        return empty(detections.sparkSession)
    best = top(rows, k, F.desc("confidence"), "video_name", "ts", "frame_path", "frame_no", "det_no")
    return hits(
        best, "detection", score=F.col("confidence"), video_id=F.col("video_id"), video_name=F.col("video_name"), video_path=F.col("video_path"),
        frame_id=F.concat(F.lit("detection::"), "frame_path"), frame_path=F.col("frame_path"), start_ts=F.col("ts"), end_ts=F.col("ts"), ts=F.col("ts"),
        label=F.col("label"),
    )


# ---- trajectories ----------------------------------------------------------------------------------------------------


def trajectory(tracks: DataFrame, intent: intents.Intent, k: int, direction: str | None = None, min_duration: float | None = None) -> DataFrame:
    """Tracks by mean confidence, then duration.  An unknown direction is no filter."""
    if intent.query_type == "event" or not intent.primary:
        return empty(tracks.sparkSession)
    rows = tracks.where(text.normal_label("label").isin(*[e.replace("_", " ") for e in intent.primary]))
    wanted = "_".join((direction or intent.direction).casefold().replace("-", " ").split())
    if wanted in text.DIRECTIONS:
        rows = rows.where(text.normal_direction("direction") == wanted)
    if min_duration is not None:
        rows = rows.where(F.col("duration_sec") >= min_duration)
    best = top(rows, k, F.desc("avg_confidence"), F.desc("duration_sec"), "video_name", "start_ts", "track_id")
    frame = F.col("representative_frame")
    return hits(
        best, "trajectory", score=F.col("avg_confidence"), video_id=F.substring_index("track_id", ":", 1), video_name=F.col("video_name"),
        video_path=F.col("video_path"), frame_id=F.concat(F.lit("trajectory::"), "track_id"), frame_path=frame, start_ts=F.col("start_ts"),
        end_ts=F.col("end_ts"), ts=F.col("start_ts"), label=F.col("label"), direction=F.col("direction"), track_id=F.col("track_id"),
    )


# ---- events ----------------------------------------------------------------------------------------------------------


def event(events: DataFrame, query: str, k: int) -> DataFrame:
    """Events of the query's types by confidence."""
    types = intents.event_types(query)
    if not types:
        return empty(events.sparkSession)
    rows = events.where(text.normal_event_type("event_type").isin(*types))
    best = top(rows, k, F.desc("confidence"), "video_name", "start_ts", "event_type", "event_id")
    return hits(
        best, "event", score=F.col("confidence"), video_id=F.substring_index("event_id", ":", 1), video_name=F.col("video_name"),
        video_path=F.col("video_path"), frame_id=F.concat(F.lit("event::"), "event_id"), frame_path=F.col("representative_frame"),
        start_ts=F.col("start_ts"), end_ts=F.col("end_ts"), ts=F.col("start_ts"), label=F.try_element_at("attributes", F.lit("label")),
        event_type=F.col("event_type"), track_id=F.try_element_at("track_ids", F.lit(1)), event_id=F.col("event_id"), snapshots=F.col("key_snapshots"),
    )


# ---- recognised text -------------------------------------------------------------------------------------------------


def scored_texts(texts: DataFrame, query: str, column: str = "text") -> DataFrame:
    """Rows whose text holds the query (100) or is similar to it (OCR_CUTOFF at least).

    Containment is decided in the JVM, as is whether enough of the query's characters occur at all (a similarity of s needs
    s / (200 - s) of the shorter text's); only the rows that are left pass the Pandas UDF."""
    wanted = "".join(query.casefold().split())
    rows = texts.withColumn("_t", text.normal_text(column)).where("_t <> ''")
    if not wanted:
        return rows.where("false").withColumn("similarity", F.lit(0.0)).drop("_t")
    held = rows.where(F.col("_t").contains(wanted)).withColumn("similarity", F.lit(100.0))
    letters = Counter(wanted)
    met = reduce(lambda a, b: a + b, [F.when(F.col("_t").contains(c), F.lit(n)).otherwise(0) for c, n in letters.items()])
    least = OCR_CUTOFF / (200 - OCR_CUTOFF) * F.least(F.lit(len(wanted)), F.length("_t"))
    near = rows.where(~F.col("_t").contains(wanted) & (met >= least))
    rest = near.withColumn("similarity", fuzzy.similarity_to(wanted, F.col("_t")))
    return held.unionByName(rest.where(F.col("similarity") >= OCR_CUTOFF)).drop("_t")


def ocr(texts: DataFrame, query: str, k: int) -> DataFrame:
    best = top(scored_texts(texts, query), k, F.desc("similarity"), "video_name", "ts", "frame_path", "text_no")
    return hits(
        best, "ocr", score=F.col("similarity") / 100, video_id=F.concat(F.lit("ocr::"), text.normal_text("video_name")), video_name=F.col("video_name"),
        video_path=F.lit(""), frame_id=F.concat_ws("::", F.lit("ocr"), "video_name", F.col("ts").cast("string"), "frame_path"), frame_path=F.col("frame_path"),
        start_ts=F.col("ts"), end_ts=F.col("ts"), ts=F.col("ts"), text=F.col("text"),
    )


# ---- vectors ---------------------------------------------------------------------------------------------------------


def nearest(table: DataFrame, query, k: int, tie: str, column: str = "vec", normalise: bool = True) -> DataFrame:
    """The k rows of largest inner product with the query vector (unit length), exact."""
    size = sum(float(x) ** 2 for x in query) ** 0.5 or 1.0
    unit = [float(x) / size for x in query] if normalise else [float(x) for x in query]
    return top(table.withColumn("score", vectors.dot(F.col(column), vectors.literal(unit))), k, F.desc("score"), tie)


def nearest_variants(table: DataFrame, queries: list, k: int, tie: str, over: int = 3, column: str = "vec") -> DataFrame:
    """Best score of each row over several query vectors, `over` * k candidates of each; one scan for all.

    All scores of a row are one array; the best of each variant are kept per partition before anything is shuffled."""
    if not queries:
        raise ValueError("at least one query vector is needed")
    unit = []
    for q in queries:
        size = sum(float(x) ** 2 for x in q) ** 0.5 or 1.0
        unit.append([float(x) / size for x in q])
    scores = F.transform(vectors.literal_rows(unit), lambda q: vectors.dot(F.col(column), q))
    rest = [c for c in table.columns if c != column]
    scored = table.select(*rest, F.posexplode(scores).alias("_variant", "score"))
    place = F.row_number().over(Window.partitionBy("_variant").orderBy(F.desc("score"), tie))
    some = scored.withColumn("_n", place).where(F.col("_n") <= over * k).drop("_n")
    best = some.withColumn("_n", F.row_number().over(Window.partitionBy(tie).orderBy(F.desc("score"), "_variant"))).where("_n = 1")
    return top(best.drop("_n", "_variant"), over * k, F.desc("score"), tie)


def vector(table: DataFrame, queries: list, k: int, segments: bool = True, parity: bool = False) -> DataFrame:
    """Frame and segment vectors near any of the query vectors.

    A frame hit spans its own time; with parity it starts and ends at 0, as the described system has it."""
    rows = table if segments else table.where("coalesce(segment_id, '') = ''")
    best = nearest_variants(rows, queries, k, "ext_id")
    framed = F.coalesce("segment_id", F.lit("")) == ""
    at = F.coalesce("timestamp_seconds", F.lit(0.0))
    start = F.when(framed, F.lit(0.0) if parity else at).otherwise(F.coalesce("start_ts", F.lit(0.0)))
    end = F.when(framed, F.lit(0.0) if parity else at).otherwise(F.coalesce("end_ts", F.lit(0.0)))
    return hits(
        best, "clip", score=F.col("score"), video_id=F.col("video_id"), video_name=F.col("video_name"), video_path=F.col("video_path"), frame_id=F.col("frame_id"),
        frame_path=F.col("frame_path"), segment_id=F.nullif(F.col("segment_id"), F.lit("")), start_ts=start, end_ts=end, ts=at,
    )
