"""Named queries of the layers, the search over them, segments and ingest, each with the SQL that must give the same rows.

The driver's events become JSON layers in the shared folder (a user is a video, a day a frame), which are read as any layer is.
"""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import text
from tracelake.operators import channels, evaluate, fusion, index, intervals, rules, segments, tracks
from tracelake.plans import adapters, hybrid, ingest, intent, vocabulary
from tracelake.plans.adapters import OBS, observations, table
from tracelake.plans.catalog import PLACED
from tracelake.sources import files, layers, schemas, sinks, staging
from tracelake.streaming import streams

DAY = 86400.0
TEXT = "*.txt"
WITH_OBS = f"WITH {OBS}"

# ---- layers ----------------------------------------------------------------------------------------------------------


def _video():
    return F.concat(F.lit("u"), F.col("track").cast("string"))


def _paths(df: DataFrame) -> DataFrame:
    return df.withColumn("video_name", F.concat("video_id", F.lit(".mp4"))).withColumn("video_path", F.concat(F.lit("/d/"), "video_id", F.lit(".mp4")))


def _written(docs: DataFrame, label: str) -> str:
    """One JSON file per row of docs (video_id and the document's columns), and one that does not parse."""
    spark = docs.sparkSession
    path = staging.new_path(spark, label)
    rows = docs.select(F.col("video_id").alias("file_of"), F.to_json(F.struct(*docs.columns)).alias("value"))
    rows.repartition("file_of").write.partitionBy("file_of").text(path)
    staging.put(spark, f"{path}/bad.txt", '{"video_id": "x", "frames": [')
    return path


def _detections(spark, sf_dir) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("video_id", _video())
    seen = F.when(F.col("label") == "click", F.lit("car")).when(F.col("label") == "error", F.lit(" Traffic  Light")).when(F.col("label") == "view", F.lit("person"))
    whole = F.array("cx", "cy", F.col("cx") + 10, F.col("cy") + 10)
    found = F.struct(
        seen.alias("label"), F.when(F.col("label") == "purchase", F.lit("bus")).alias("class"), F.when(F.col("label") != "view", F.col("conf")).alias("confidence"),
        F.when(F.col("label") == "signup", F.array().cast("array<double>")).otherwise(whole).alias("bbox"),
    )
    frames = rows.groupBy("video_id", "day").agg(F.sort_array(F.collect_list(F.struct("event_id", found.alias("d")))).alias("d"))
    frame = F.struct("day", F.concat(F.lit("d"), F.col("day").cast("string"), F.lit(".jpg")).alias("frame_path"), F.col("day").cast("double").alias("timestamp"), F.col("d.d").alias("detections"))
    docs = _paths(frames.groupBy("video_id").agg(F.sort_array(F.collect_list(frame)).alias("frames")))
    return layers.detections(layers.scan(spark, _written(docs, "detections"), schemas.DETECTIONS, TEXT))


def _tracks(spark, sf_dir) -> DataFrame:
    rows = tracks.summaries(observations(spark, sf_dir), ["track", "label"], "t", "event_id").withColumn("video_id", _video())
    points = observations(spark, sf_dir).groupBy("track", "label").agg(F.sort_array(F.collect_list(F.struct(F.col("t").alias("timestamp"), F.col("cx").alias("center_x"), F.col("cy").alias("center_y"), "conf"))).alias("points"))
    kind = F.when(F.col("label") == "click", F.lit("Car")).when(F.col("label") == "view", F.lit("person")).otherwise(F.col("label"))
    own = F.struct(
        F.concat_ws(":", "video_id", "label").alias("track_id"), kind.alias("label"), "start_ts", "end_ts", F.col("duration").alias("duration_sec"),
        F.round(F.col("avg_conf") + 1e-9, 6).alias("avg_confidence"), "direction", F.concat(F.lit("f"), F.col("best_point").cast("string")).alias("representative_frame"), "points",
    )
    docs = _paths(rows.join(points, ["track", "label"]).groupBy("video_id").agg(F.sort_array(F.collect_list(own)).alias("tracks")))
    return layers.tracks(layers.scan(spark, _written(docs, "tracks"), schemas.TRAJECTORIES, TEXT))


#: Event types of the event layer by what the driver's event says.
KINDS = {"error": "red_light_violation", "purchase": "Wrong Way  Driving", "click": "vehicle_crosses_line"}


def _events(spark, sf_dir) -> DataFrame:
    rows = observations(spark, sf_dir).where(F.col("label").isin(*KINDS)).withColumn("video_id", _video())
    kind = F.element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("label"))
    at = F.floor("t").cast("double")
    own = F.struct(
        F.format_string("%s:%s:%012d", "video_id", "label", "event_id").alias("event_id"), kind.alias("event_type"), at.alias("start_ts"), (at + 3).alias("end_ts"),
        F.col("conf").alias("confidence"), F.array(F.concat("video_id", F.lit(":1"))).alias("track_ids"), F.create_map(F.lit("label"), F.lit("car")).alias("attributes"),
        F.when(F.col("label") == "error", F.lit("other")).otherwise(F.lit("")).alias("video_id"),
    )
    docs = _paths(rows.groupBy("video_id").agg(F.collect_list(own).alias("events")))
    return layers.events(layers.scan(spark, _written(docs, "events"), schemas.EVENTS, TEXT))


def _texts(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("video_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    good = F.struct(F.col("text"), (F.col("turn") / 10).cast("double").alias("score"), F.array(F.array(F.lit(0), F.lit(0)), F.array(F.lit(1), F.lit(1))).alias("bbox"))
    odd = F.struct(F.concat(F.lit("odd "), "text").alias("text"), F.lit(None).cast("double").alias("score"), F.array(F.array(F.lit(0))).alias("bbox"))
    none = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0.5).alias("score"), F.array().cast("array<array<int>>").alias("bbox"))
    frame = F.struct("turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("frame_path"), F.col("turn").cast("double").alias("timestamp_sec"), F.array(good, odd, none).alias("ocr_results"))
    docs = _paths(rows.groupBy("video_id").agg(F.sort_array(F.collect_list(frame)).alias("frames")))
    return layers.ocr_texts(layers.scan(spark, _written(docs, "texts"), schemas.OCR, TEXT))


def json_detections(spark, sf_dir):
    rows = _detections(spark, sf_dir)
    return rows.select("video_id", "video_path", "frame_path", "ts", "frame_no", "det_no", "label", "confidence", F.col("box.x1").alias("x1"), F.col("box.y2").alias("y2"))


def json_tracks(spark, sf_dir):
    rows = _tracks(spark, sf_dir)
    first = layers.track_points(rows).where("i = 0").select("track_id", F.col("cx").alias("first_cx"))
    return rows.join(first, "track_id").select("video_id", "track_id", "label", "start_ts", "duration_sec", "avg_confidence", "direction", F.size("points").cast("long").alias("n_points"), "first_cx")


def json_events(spark, sf_dir):
    return _events(spark, sf_dir).select("video_id", "video_name", "event_id", "event_type", "start_ts", "end_ts", "confidence")


def json_texts(spark, sf_dir):
    return _texts(spark, sf_dir).select("video_name", "frame_path", "ts", "text_no", "text", "score")


def bad_layer_files(spark, sf_dir):
    """Documents that do not parse are listed, not lost."""
    docs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("video_id"), F.array().cast("array<string>").alias("tracks"))
    return layers.bad_documents(spark, _written(docs, "odd"), schemas.TRAJECTORIES, TEXT).select("document")


def cached_layer(spark, sf_dir):
    """A layer read twice through the cache, a file added in between."""
    docs = table(spark, sf_dir, "region").select(F.col("r_name").alias("video_id"), F.array(F.struct(F.col("r_name").alias("track_id"))).alias("tracks"))
    path, cache = _written(docs, "cached"), layers.LayerCache()
    before = cache.read(spark, path, schemas.TRAJECTORIES, layers.tracks, TEXT)
    same = cache.read(spark, path, schemas.TRAJECTORIES, layers.tracks, TEXT) is before
    count = before.count()
    staging.put(spark, f"{path}/more.txt", '{"video_id": "more", "tracks": [{"track_id": "more"}]}')
    after = cache.read(spark, path, schemas.TRAJECTORIES, layers.tracks, TEXT)
    return after.select("track_id").withColumn("before", F.lit(count).cast("long")).withColumn("reused", F.lit(same))


def frame_videos(spark, sf_dir):
    """Each frame path with the video of the first file that holds it."""
    return layers.video_of_frame(_detections(spark, sf_dir))


# ---- channels --------------------------------------------------------------------------------------------------------


def search_detections(spark, sf_dir):
    found = channels.detection(_detections(spark, sf_dir), intent.parse("红绿灯附近的车"), 40)
    return found.select("frame_id", "video_id", "ts", "label", F.round("score", 6).alias("score"))


def search_detections_alone(spark, sf_dir):
    """Context that no detector can see does not constrain the frames."""
    found = channels.detection(_detections(spark, sf_dir), intent.parse("停止线附近的行人"), 40)
    return found.select("frame_id", "video_id", "label", F.round("score", 6).alias("score"))


def search_tracks(spark, sf_dir):
    found = channels.trajectory(_tracks(spark, sf_dir), intent.parse("从左到右的汽车"), 30, min_duration=DAY)
    return found.select("frame_id", "video_id", "track_id", "label", "direction", "start_ts", "end_ts", "score")


def search_events(spark, sf_dir):
    found = channels.event(_events(spark, sf_dir), "逆行", 30)
    return found.select("frame_id", "video_id", "label", "event_type", "track_id", "start_ts", F.round("score", 6).alias("score"))


def search_texts(spark, sf_dir):
    """Texts that hold the query come before all that are like it."""
    found = channels.ocr(_texts(spark, sf_dir), "The OF", 25)
    return found.where("score = 1").select("video_id", "video_name", "frame_id", "ts", "score")


def _vectors(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    video = F.concat(F.lit("u"), (F.col("vec_id") % 12).cast("string"))
    at = (F.col("vec_id") * 37 % 2000).cast("double") * 100
    segment = F.when(F.col("vec_id") % 3 == 0, F.concat(video, F.lit("_seg"), F.col("vec_id").cast("string"))).otherwise("")
    own = {
        "ext_id": F.col("vec_id"), "video_id": video, "kind": F.when(segment == "", F.lit("frame")).otherwise("segment"), "vec": F.col("embedding"), "video_name": F.concat(video, F.lit(".mp4")),
        "video_path": F.concat(F.lit("/d/"), video, F.lit(".mp4")), "frame_path": F.concat(F.lit("p"), F.col("vec_id").cast("string")), "timestamp_seconds": at,
        "frame_id": F.concat(F.lit("v"), F.col("vec_id").cast("string")), "segment_id": segment, "start_ts": at, "end_ts": at + 4,
    }
    return rows.select(*[own[f.name].cast(f.dataType).alias(f.name) for f in schemas.VECTORS.fields])


def _encoder(spark, sf_dir):
    query = list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])  # one given row
    return lambda text: query


def search_vectors(spark, sf_dir):
    """Frame and segment vectors near the encoded variants of a query, with their metadata."""
    found = channels.vector(_vectors(spark, sf_dir), [_encoder(spark, sf_dir)(v) for v in intent.rewrite("白色汽车")], 10)
    return found.select("frame_id", "video_id", "segment_id", "start_ts", "end_ts", "ts", F.round("score", 4).alias("score"))


def search_hybrid(spark, sf_dir):
    """One query through parsing, all channels, fusion, scoring and aggregation, with links to clips."""
    tables = hybrid.Tables(detections=_detections(spark, sf_dir), tracks=_tracks(spark, sf_dir), events=_events(spark, sf_dir), texts=_texts(spark, sf_dir), vectors=_vectors(spark, sf_dir), encode=_encoder(spark, sf_dir))
    there = spark.range(6).select(F.concat(F.lit("/d/u"), F.col("id").cast("string"), F.lit(".mp4")).alias("path"))
    found = hybrid.search(spark, tables, "红绿灯附近的车", 15, enabled=frozenset(("clip", "detection", "trajectory", "event")), files=there)
    return found.select("key", "video_id", "start_ts", "end_ts", F.array_join("matched_by", ",").alias("matched_by"), F.round("best_score", 4).alias("best_score"), "clip_url", "clip_available")


def search_without_a_channel(spark, sf_dir):
    """A channel that fails is left out; the others answer."""

    def broken(text):
        raise RuntimeError("no encoder")

    tables = hybrid.Tables(detections=_detections(spark, sf_dir), vectors=_vectors(spark, sf_dir), encode=broken)
    found = hybrid.search(spark, tables, "car", 20)
    return found.select("video_id", "start_ts", "end_ts", F.array_join("matched_by", ",").alias("matched_by"), "label", F.round("best_score", 4).alias("best_score"))


def search_speech(spark, sf_dir):
    """A further channel, spoken text, alone."""
    spoken = _texts(spark, sf_dir).where("score >= 0.3")
    tables = hybrid.Tables(detections=_detections(spark, sf_dir), more={"speech": hybrid.speech(spoken)})
    (only,) = hybrid.channel_plans(tables, "The OF", intent.parse("The OF"), 12, frozenset())
    return only.where("score = 1").select("channel", "frame_id", "video_name", "ts", "score")


def fused_segments(spark, sf_dir):
    """Hits with a segment are one per segment; of a window's hits the best stays and shares the channels of its ties."""
    rows = observations(spark, sf_dir)
    of = F.when(F.col("label") == "view", F.lit("clip")).when(F.col("label") == "click", F.lit("detection")).otherwise(F.lit("event"))
    hits = channels.hits(
        rows, of, score=F.floor(F.col("conf") * 4) / 4, video_id=F.col("video").cast("string"), video_name=F.col("video").cast("string"), frame_id=F.format_string("%012d", "event_id"),
        segment_id=F.when(F.col("label") == "view", F.concat_ws("_", F.lit("s"), "track", "day")), start_ts=F.floor("t").cast("double"), end_ts=F.floor("t").cast("double") + 2, ts=F.floor("t").cast("double"),
    )
    fused = fusion.fuse(hits, 60.0).withColumn("best_score", F.greatest("clip_score", "detection_score", "event_score"))
    found = fusion.grouped(fused, 0.25, 3600.0)
    return found.select("key", "best_score", "start_ts", "end_ts", F.array_join("matched_by", ",").alias("matched_by"))


# ---- intents ---------------------------------------------------------------------------------------------------------

#: Query, type, primary, context, relations, directions, motions, events, light, route, confidence, candidates, weights: what the described system's tests say of these queries.
PARSED = (
    ("从左到右的行人", "motion", "person", "", "", "left_to_right", "", "", "", "clip_only", 0.0, 1, "vague"),
    ("红绿灯附近的车", "relational", "car", "traffic_light", "near", "", "", "", "", "clip_only", 0.0, 1, "vague"),
    ("路口左转的货车", "composite", "truck", "intersection", "", "", "turn_left", "", "", "clip_only", 0.0, 1, "attributes of entities"),
    ("靠近停止线的车辆", "relational", "car,truck,bus,motorcycle", "stop_line", "near", "", "", "", "", "clip_only", 0.0, 1, "vague"),
    ("逆行", "event", "", "", "", "", "", "wrong_way_driving", "", "event_primary", 1.0, 1, "sure event"),
    ("压线", "event", "", "", "", "", "", "vehicle_crosses_line", "", "event_primary", 1.0, 1, "sure event"),
    ("car", "object", "car", "", "", "", "", "", "", "clip_only", 0.0, 1, "vague"),
    ("车辆违规", "object", "car,truck,bus,motorcycle", "", "", "", "", "", "", "vague_event", 0.0, 2, "vague"),
    ("", "general", "", "", "", "", "", "", "", "clip_only", 0.0, 0, "vague"),
)


def intents_parsed(spark, sf_dir):
    """Queries through the compiler: parts, route and channel weights."""
    rows = []
    for n, (query, *_) in enumerate(PARSED):
        i = intent.parse(query)
        parts = [",".join(p) for p in (i.primary, i.context, i.relations, i.directions, i.motions, i.events)]
        rows.append((n, query, i.query_type, *parts, i.attributes.get("light_state", ""), intent.route(i)["route"], i.event_confidence, len(i.candidates), *[float(w) for w in intent.channel_weights(i).values()]))
    names = ["n long", *(f"{c} string" for c in ("query", "query_type", "primary_entities", "context", "relations", "directions", "motions", "events", "light", "route"))]
    return spark.createDataFrame(rows, ", ".join([*names, "confidence double", "n_candidates long", *(f"w_{c} double" for c in vocabulary.CHANNELS)]))


def intent_rewrites(spark, sf_dir):
    """English variants for the vector channel, in order."""
    asked = ("白色汽车", " red car ", "逆行", "")
    rows = [(q, n, v) for q in asked for n, v in enumerate(intent.rewrite(q)[:2])]
    return spark.createDataFrame(rows, "query string, n long, variant string")


def english_queries(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 8).alias("q"))
    return rows.select("doc_id", text.is_ascii_query("q").alias("english"))


# ---- rules -----------------------------------------------------------------------------------------------------------


def rule_events(spark, sf_dir):
    """Rules from a folder of configurations: one is broken JSON, one not an object, one unknown."""
    path = staging.new_path(spark, "rules")
    staging.put(spark, f"{path}/vehicle_crosses_line.json", json.dumps({"line": [list(p) for p in adapters.LINE], "min_displacement_px": 10}))
    staging.put(spark, f"{path}/red_light_violation.json", '{"line": [[0, 0')
    staging.put(spark, f"{path}/wrong_way_driving.json", "[1, 2]")
    wanted = ["vehicle_crosses_line", "red_light_violation", "no_such_rule"]
    found = rules.run(spark, adapters.points(spark, sf_dir), adapters.lights(spark, sf_dir), rules.configs(spark, path, wanted), wanted)
    return found.groupBy("event_type", "video_id").agg(F.count("*").alias("n"), F.min("representative_frame").alias("first_frame"), F.max("description").alias("description"))


def wrong_way_in_region(spark, sf_dir):
    """Tracks against the direction with most of their points in a region."""
    config = {"allowed_direction": [1.0, 0.0], "max_direction_dot": 0.2, "roi_polygon": [[0.5, -0.5], [300.5, -0.5], [300.5, 60.5], [0.5, 60.5]], "min_roi_ratio": 0.35}
    found = rules.wrong_way(adapters.points(spark, sf_dir), adapters.lights(spark, sf_dir), config)
    return found.select("event_id", F.round("score", 6).alias("dot"), F.size("snapshots").cast("long").alias("n_snapshots"))


def frame_lights(spark, sf_dir):
    """One light state a frame: that of its surest light."""
    rows = observations(spark, sf_dir).where("label in ('error', 'view')")
    states = rows.select(F.col("video").cast("string").alias("video_id"), F.floor(F.col("t") / 7200).cast("double").alias("t"), F.when(F.col("label") == "error", F.lit("red")).otherwise("green").alias("state"), "conf", F.format_string("%012d", "event_id").alias("frame_path"), F.col("cy").alias("det_conf"))
    return rules.frame_light_states(states).select("video_id", "t", "state", "conf")


def python_rule_events(spark, sf_dir):
    """A rule written in Python, registered beside the others."""

    def longest(points: pd.DataFrame, lights: pd.DataFrame, config: dict) -> pd.DataFrame:
        names = [c.split()[0] for c in rules.EVENT_SCHEMA.split(", ")]
        if points.empty:
            return pd.DataFrame(columns=names)
        best = points.groupby("track_id")["t"].count().sort_index().sort_values(ascending=False, kind="stable").index[0]
        row = dict.fromkeys(names) | {"event_id": f"{points['video_id'].iloc[0]}:longest:{best}", "event_type": "longest", "video_id": points["video_id"].iloc[0], "track_id": best, "confidence": float(len(lights) > 0)}
        return pd.DataFrame([row], columns=names)

    rules.register("longest", rules.python_rule(longest))
    try:
        found = rules.run(spark, adapters.points(spark, sf_dir), adapters.lights(spark, sf_dir), {}, ["longest"])
    finally:
        rules._RULES.pop("longest")
    return found.select("event_id", "track_id", "confidence")


# ---- segments --------------------------------------------------------------------------------------------------------


def _spans(spark, sf_dir) -> DataFrame:
    rows = intervals.gap_islands(observations(spark, sf_dir).where("track % 3 = 0"), ["track"], "t", 21600.0, "event_id")
    rows = rows.groupBy("track", "island").agg(F.min("t").alias("start_ts"), F.max("t").alias("end_ts"), F.min("event_id").alias("first_id"), F.max("label").alias("event_type"), F.array_sort(F.collect_set(F.format_string("f_%012d.jpg", "event_id"))).alias("evidence"))
    told = F.when(F.col("event_type") == "view", F.concat(F.lit("seen "), F.col("first_id").cast("string")))
    return rows.select(_video().alias("video_id"), "start_ts", "end_ts", F.format_string("%012d", "first_id").alias("event_id"), "event_type", told.alias("description"), F.concat(_video(), F.lit(":1")).alias("track_id"), "evidence")


def _durations(spark, sf_dir) -> DataFrame:
    return observations(spark, sf_dir).groupBy("track").agg((F.floor(F.max("t")) + 100_000.0).alias("duration")).select(_video().alias("video_id"), "duration")


def segments_numbered(spark, sf_dir):
    """Segments of every video: event groups, then windows between them, after them, and for videos without events."""
    built = segments.build(_spans(spark, sf_dir), _durations(spark, sf_dir), width=21600.0)
    by = built.groupBy("video_id").agg(F.count("*").alias("n"), F.count_if(F.col("text_source") == "时间窗兜底").alias("n_windows"), F.max("segment_id").alias("last_id"), F.round(F.max("end_ts"), 1).alias("last_end"), F.max("text").alias("last_text"))
    return by


def segment_groups(spark, sf_dir):
    """Event segments with their number, text, events and frames."""
    built = segments.build(_spans(spark, sf_dir), width=21600.0).where("size(events) > 0")
    return built.select("segment_id", "video_id", F.round("start_ts", 1).alias("start_ts"), F.round("end_ts", 1).alias("end_ts"), F.array_join("events", ",").alias("events"), F.size("frame_paths").cast("long").alias("n_frames"), F.array_join("tracks", ",").alias("tracks"), "text")


def window_frames(spark, sf_dir):
    """Fallback windows with their first three frames."""
    spans = _spans(spark, sf_dir).where("video_id in ('u0', 'u3', 'u6', 'u9')")
    frames = observations(spark, sf_dir).select(_video().alias("video_id"), F.col("t").alias("ts"), F.format_string("%012d", "event_id").alias("path"))
    built = segments.fallback_segments(spans, frames=frames, width=21600.0)
    return built.select("video_id", F.round("start_ts", 1).alias("start_ts"), F.array_join("frame_paths", ",").alias("frames"))


def segment_states(spark, sf_dir):
    """All five states of building segments."""
    users = observations(spark, sf_dir).select("track").distinct()
    videos = users.select(_video().alias("video_id"))
    events = users.where("track % 5 <> 0").select(_video().alias("video_id"))
    built = users.where("track % 5 in (3, 4)").select(_video().alias("video_id"))
    failed = users.where("track % 5 in (1, 4)").select(_video().alias("video_id"), F.when(F.col("track") % 5 == 1, F.lit("build")).otherwise("embed").alias("stage"))
    return segments.status(videos, events, built, failed)


def segment_tables(spark, sf_dir):
    """The two tables of the segment layer, one video built again."""
    path = staging.new_path(spark, "segments")
    rows = segments.build(_spans(spark, sf_dir).where("video_id in ('u0', 'u3', 'u6')"), width=3600.0)
    vectors = rows.select("video_id", "segment_id", F.lit("m").alias("model"), F.lit(64).alias("dimension"), "text_source")
    sinks.write_segments(rows, vectors, path)
    again = rows.where("video_id = 'u3' and size(events) > 0")
    sinks.write_segments(again, vectors.join(again.select("segment_id"), "segment_id", "left_semi"), path)
    own, meta = spark.read.parquet(f"{path}/segments"), spark.read.parquet(f"{path}/embeddings")
    return own.join(meta.drop("video_id", "text_source"), "segment_id", "left").groupBy("video_id").agg(F.count("*").alias("n"), F.count("model").alias("n_vectors"), F.count_if(F.size("events") > 0).alias("n_event_segments"))


def segment_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    made = text.segment_text(F.col("p_partkey"), F.col("p_retailprice"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")), F.when(F.col("p_partkey") % 3 == 1, text.label_zh(F.when(F.col("p_partkey") % 2 == 0, F.lit("bus")).otherwise("boat"))), F.when(F.col("p_partkey") % 4 == 1, F.col("p_brand")))
    path = F.concat(F.lit("/v/n_"), F.col("p_size").cast("string"), F.lit(".5.jpg"))
    return rows.select("p_partkey", F.when(F.col("p_partkey") % 3 == 2, F.substring(made, 1, 5)).otherwise(made).alias("text"), text.timestamp_text(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")), path).alias("at"))


def safe_names(spark, sf_dir):
    """Names fit for files, and messages without the paths they speak of."""
    rows = table(spark, sf_dir, "part")
    said = F.concat(F.lit("bad /v/"), F.col("p_brand"), F.lit(".mp4 near /v/"), F.col("p_brand"), F.lit(".mp4"))
    return rows.select("p_partkey", text.safe_stem(F.concat(F.lit("._ "), "p_name", F.lit("/é"))).alias("safe"), text.without_paths(said, F.concat(F.lit("/v/"), "p_brand", F.lit(".mp4"))).alias("message"))


def clip_links(spark, sf_dir):
    """Download links of at least a second, and whether the file is there."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("/d/a b/"), "c_custkey", F.lit(".mp4")).alias("video_path"), F.col("c_nationkey").cast("double").alias("start_ts"), (F.col("c_nationkey") % 3 * 10).cast("double").alias("end_ts"), F.when(F.col("c_custkey") % 2 == 0, F.lit("wrong_way_driving")).alias("event_type"))
    there = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/d/a b/"), "s_suppkey", F.lit(".mp4")).alias("path"))
    return fusion.with_links(rows, there).select("video_path", "clip_url", "clip_available")


# ---- vectors, sinks, files -------------------------------------------------------------------------------------------


def vectors_checked(spark, sf_dir):
    """Vectors fit for the index, with the times of frames and segments, and what was rejected."""
    rows = _vectors(spark, sf_dir).withColumn("vec", F.when(F.col("ext_id") % 7 == 0, F.slice("vec", 1, 5)).otherwise(F.col("vec")))
    rows = rows.withColumn("vec", F.when(F.col("ext_id") % 11 == 1, F.transform("vec", lambda x, i: F.when(i == 0, F.lit(float("nan"))).otherwise(x).cast("float"))).otherwise(F.col("vec")))
    rows = rows.withColumn("frame_path", F.when(F.col("ext_id") % 5 != 0, F.col("frame_path"))).withColumn("timestamp_seconds", F.col("timestamp_seconds") + 0.126)
    good, bad = index.checked(rows, 64)
    return good.select("ext_id", F.lit("").alias("reason"), "timestamp_seconds").unionByName(bad.select("ext_id", "reason", F.lit(None).cast("double").alias("timestamp_seconds")))


def vectors_numbered(spark, sf_dir):
    """Ids go on after the largest given one, in order over all partitions."""
    old = sinks.numbered(table(spark, sf_dir, "supplier").select("s_name"), ["s_name"])
    new = sinks.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").repartition(7), ["o_totalprice", "o_orderkey"], sinks.next_id(old))
    return new.select("o_orderkey", "ext_id")


def vector_tables(spark, sf_dir):
    """Matrix and metadata tables written, one video replaced, and joined again."""
    path, keys = staging.new_path(spark, "vectors"), ["frame_id"]
    rows = _vectors(spark, sf_dir).select("video_id", "frame_id", "vec", "timestamp_seconds")
    sinks.write_vectors(rows, path, keys)
    sinks.write_vectors(rows.where("video_id = 'u1'").withColumn("timestamp_seconds", F.lit(0.0)), path, keys)
    return sinks.read_vectors(spark, path, keys).select("video_id", "frame_id", "timestamp_seconds", F.size("vec").cast("long").alias("dimension"))


def vector_bundle(spark, sf_dir):
    """A .npy matrix with the JSON list beside it, and an index in its old list form."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id < 20").orderBy("vec_id").collect()  # a fixture of twenty rows
    path, body = staging.new_path(spark, "bundle"), io.BytesIO()
    np.save(body, np.array([r["embedding"] for r in rows], np.float32))
    staging.put(spark, f"{path}/b.npy", body.getvalue())
    staging.put(spark, f"{path}/b.json", json.dumps([{"frame_id": f"v{r['vec_id']}"} for r in rows]))
    found = files.bundle_vectors(spark, path, "struct<frame_id:string>")
    old = files.legacy_index(spark, path, "struct<frame_id:string>").withColumnRenamed("frame_id", "old_id")
    return found.join(old, F.col("position") == F.col("ext_id")).select("ext_id", "frame_id", "old_id", F.round(F.element_at("vec", 1).cast("double"), 5).alias("first"))


def encoded_names(spark, sf_dir):
    """Vectors from an injected encoder, of unit length; a table without the columns of today is stale."""
    rows = index.encoded(table(spark, sf_dir, "nation").select("n_name"), lambda names: [[float(len(n)), 1.0] for n in names], "n_name", 2, 4)
    return rows.select("n_name", F.round(F.element_at("vec", 1).cast("double"), 5).alias("x"), F.lit(index.is_stale(rows)).alias("stale"))


def layer_rewritten(spark, sf_dir):
    """A layer partitioned by video; some videos written again replace exactly theirs, others are appended."""
    path = staging.new_path(spark, "layer")
    rows = observations(spark, sf_dir).select(F.col("video").cast("string").alias("video_id"), "event_id", "label")
    sinks.write_layer(rows.where("video_id <> '9'"), path)
    sinks.write_layer(rows.where("video_id in ('1', '2') and label = 'view'"), path)
    sinks.append_layer(rows.where("video_id = '9'"), path)
    return spark.read.schema("event_id long, label string, video_id string").parquet(path).groupBy("video_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def listed_videos(spark, sf_dir):
    """Video files of a folder, whatever the case of their extension, and the frames sampling keeps of them."""
    path = staging.new_path(spark, "media")
    for name in ("a.MP4", "deep/b.avi", "c.txt", "d.mp4.part"):
        staging.put(spark, f"{path}/{name}", "x")
    step = files.sampling_step(25.0, 0.2)
    frames = files.videos(spark, path).select(F.col("video_name").alias("video_id"), F.explode(F.sequence(F.lit(0), F.lit(12))).alias("frame_index"))
    return files.sampled_frames(frames, 25.0, step).select("video_id", "frame_index", "ts")


def imported_sequences(spark, sf_dir):
    """Image folders as videos (jpg and npz frames), and the meta file of an accident."""
    path = staging.new_path(spark, "scenes")
    for i in range(1, 8):
        staging.put(spark, f"{path}/Train/scene/img_{i:03d}.jpg", "x")
        staging.put(spark, f"{path}/Test/crash/part{i}.npz", "x")
    staging.put(spark, f"{path}/meta/crash.txt", "clear 1 car 2 bus 3.5 left front 77\nroad type: wet\nno pair\nweather: rain\n")
    rows = files.image_sequences(spark, f"{path}/Train", 15.0, step=3, first_index=1).unionByName(files.image_sequences(spark, f"{path}/Test", 20.0, step=2, limit=2, first_index=1))
    meta = files.accident_meta(spark, f"{path}/meta").select(text.stem("file").alias("video_name"), F.col("meta")["weather"].alias("weather"), F.col("meta")["road_type"].alias("road"), F.col("meta")["collision_frame"].alias("frame"))
    return rows.join(meta, "video_name", "left").select("video_name", "frame_index", "ts", "weather", "road", "frame")


def archived_frames(spark, sf_dir):
    """Frames in archives of arrays, in order of their numbers; a broken archive is left out."""
    path, body = staging.new_path(spark, "archives"), io.BytesIO()
    np.savez(body, **{f"arr_{i}": np.zeros(1) for i in (10, 2, 0, 7, 33)}, note=np.zeros(1))
    staging.put(spark, f"{path}/crash.npz", body.getvalue())
    staging.put(spark, f"{path}/broken.npz", "no archive")
    return files.archive_frames(spark, path, 20.0, step=2).select("video_name", "frame", "frame_index", "ts")


def ingest_chain(spark, sf_dir):
    """Detections to points, tracks, events, segments and status: ten vehicles a video that drive over the line."""
    of = F.concat(F.lit("r"), (F.col("id") % 5).cast("string"))
    rows = spark.range(0, 5 * 10 * 40).select(of.alias("video_id"), (F.floor(F.col("id") / 5) % 10).alias("lane"), F.floor(F.col("id") / 50).cast("double").alias("ts"))
    x, y = F.col("ts") * 4.0, F.col("lane") * 100.0
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + 50).alias("x2"), (y + 40).alias("y2"))
    rows = _paths(rows).select("video_id", "video_name", "video_path", F.lit("car").alias("label"), "ts", F.format_string("f_%.2f.jpg", "ts").alias("frame_path"), F.lit(0.9).alias("confidence"), box.alias("box"))
    lights = spark.createDataFrame([], "video_id string, t double, state string, conf double, frame_path string")
    durations = rows.groupBy("video_id").agg(F.lit(60.0).alias("duration"))
    made = ingest.run(spark, rows, lights, {"vehicle_crosses_line": {"line": [[100.0, -10.0], [100.0, 2000.0]]}}, durations, staging.new_path(spark, "ingest"))
    n = {name: made[name].groupBy("video_id").agg(F.count("*").alias(f"n_{name}")) for name in ("points", "tracks", "events", "segments")}
    out = made["status"]
    for df in n.values():
        out = out.join(df, "video_id")
    way = made["tracks"].groupBy("video_id").agg(F.max("direction").alias("direction"), F.max("duration_sec").alias("duration"))
    return out.join(way, "video_id").select("video_id", "status", *[f"n_{name}" for name in n], "direction", "duration")


def named_sources(spark, sf_dir):
    """Detections with the canonical name and path of their source; without a source they are left out, as are classes the layer does not keep."""
    rows = ingest.traffic_only(_detections(spark, sf_dir))
    sources = spark.range(0, 1500, 2).select(F.concat(F.lit("/src/U"), F.col("id").cast("string"), F.lit(".AVI")).alias("path"))
    return ingest.named_videos(rows, sources).groupBy("video_name", "video_path").agg(F.count("*").alias("n"), F.count_distinct("label").alias("n_labels"))


def class_labels(spark, sf_dir):
    """Labels by class id within a frame, the last one given counting, of frames whose file is there."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("frame_path"), (F.col("l_linenumber") % 2).cast("int").alias("class_id"), "l_linenumber", F.lit("").alias("label"))
    classes = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4").select(F.col("l_orderkey").cast("string").alias("frame_path"), (F.col("l_linenumber") % 2).cast("int").alias("class_id"), F.col("l_returnflag").alias("label"), (F.col("l_linenumber") * 1e9 + F.col("l_extendedprice")).alias("position"))
    there = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("path"))
    return ingest.with_files(ingest.with_class_labels(rows, classes), there).select("frame_path", "l_linenumber", "label")


def layers_in_order(spark, sf_dir):
    """The first tracks and events as their layers list them."""
    first = ingest.tracks_in_order(_tracks(spark, sf_dir)).limit(20).select(F.lit("track").alias("kind"), F.col("track_id").alias("id"))
    rows = rules.in_order(_events(spark, sf_dir).where("video_id <> 'other'")).limit(20)
    return first.unionByName(rows.select(F.lit("event").alias("kind"), F.col("event_id").alias("id")))


def moved_frames(spark, sf_dir):
    """Frame paths replaced by the listed file of the same name, and the flag of videos whose segments are built."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("/old/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("frame_path"), F.col("o_custkey").cast("string").alias("video_id"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(False)).alias("segment_built"))
    listing = table(spark, sf_dir, "part").select(F.concat(F.lit("/new/"), (F.col("p_partkey") % 2).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"))
    done = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("video_id"))
    return sinks.mark_segments_built(sinks.remapped_paths(rows, listing), done)


def eval_by_mode(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("mode"), (F.col("o_orderkey") % 5 / 4).alias("precision_at_k"), (F.col("o_custkey") % 3 / 2).alias("recall"))
    return evaluate.by_mode(rows)


def right_of_frames(spark, sf_dir):
    rows = adapters.boxed(observations(spark, sf_dir))
    return channels.frames_where(rows.where("label = 'click'"), rows.where("label = 'error'"), "right_of", ["track", "day"]).select("event_id")


def stream_upserted(spark, sf_dir):
    """Batches of a stream replace the partitions of their videos; a batch that comes again changes nothing."""
    path = staging.new_path(spark, "upserts")
    rows = observations(spark, sf_dir).select(F.col("video").cast("string").alias("video_id"), "event_id")
    write = streams.upsert_into(path)
    for epoch, part in enumerate((rows, rows.where("video_id < '5' and event_id % 2 = 0"), rows.where("video_id < '5' and event_id % 2 = 0"))):
        write(part, epoch)
    return spark.read.schema("event_id long, video_id string").parquet(path).groupBy("video_id").agg(F.count("*").alias("n"))


def stream_tracks(spark, sf_dir):
    """Boxes that move steadily, tracked as a stream: one track for each, whole up to the watermark."""
    of = F.concat(F.lit("r"), (F.col("id") % 5).cast("string"))
    rows = spark.range(0, 5 * 10 * 40).select(of.alias("video_id"), (F.floor(F.col("id") / 5) % 10).alias("lane"), F.floor(F.col("id") / 50).alias("k"))
    x, y = F.col("k") * 4.0, F.col("lane") * 100.0
    rows = rows.select("video_id", F.lit("car").alias("label"), F.col("k").cast("double").alias("t"), F.format_string("f%04d", "k").alias("frame_path"), x.alias("x1"), y.alias("y1"), (x + 50).alias("x2"), (y + 40).alias("y2"), F.lit(0.9).alias("conf"), F.timestamp_seconds(F.col("k") + 1000).alias("at"))
    path = staging.new_path(spark, "boxes")
    rows.coalesce(2).write.parquet(path)
    done = streams.drained(streams.tracked(streams.source(spark, path, rows.schema), "at"), "tracks")
    return done.groupBy("video_id", "track_id").agg(F.count("*").alias("n"), F.count_distinct("y1").alias("lanes"), F.min("t").alias("first"), F.max("t").alias("last"))


QUERIES = {
    f.__name__: f
    for f in (
        json_detections, json_tracks, json_events, json_texts, bad_layer_files, cached_layer, frame_videos, search_detections, search_detections_alone, search_tracks, search_events,
        search_texts, search_vectors, search_hybrid, search_speech, search_without_a_channel, fused_segments, intents_parsed, intent_rewrites, english_queries, rule_events, wrong_way_in_region,
        frame_lights, python_rule_events, segments_numbered, segment_groups, window_frames, segment_states, segment_tables, segment_texts, safe_names, clip_links, vectors_checked,
        vectors_numbered, vector_tables, vector_bundle, encoded_names, layer_rewritten, listed_videos, imported_sequences, archived_frames, ingest_chain, named_sources, class_labels, layers_in_order,
        moved_frames, eval_by_mode, right_of_frames, stream_upserted, stream_tracks,
    )
}

# ---- SQL -------------------------------------------------------------------------------------------------------------

_DETECTIONS = f"""{OBS},
  fr AS (SELECT *, 'u' || track AS video_id, dense_rank() OVER (PARTITION BY track ORDER BY day) - 1 AS frame_no, row_number() OVER (PARTITION BY track, day ORDER BY event_id) - 1 AS det_no FROM obs),
  det AS (SELECT video_id, '/d/' || video_id || '.mp4' AS video_path, video_id || '.mp4' AS video_name, 'd' || day || '.jpg' AS frame_path, day::DOUBLE AS ts, frame_no, det_no,
                 CASE label WHEN 'click' THEN 'car' WHEN 'error' THEN ' Traffic  Light' WHEN 'view' THEN 'person' WHEN 'purchase' THEN 'bus' ELSE '' END AS label,
                 CASE WHEN label = 'view' THEN 0 ELSE conf END AS confidence, CASE WHEN label <> 'signup' THEN cx END AS x1, CASE WHEN label <> 'signup' THEN cy END AS y1,
                 CASE WHEN label <> 'signup' THEN cy + 10 END AS y2 FROM fr)"""

_TRACKS = f"""{OBS},
  s AS (SELECT track, label AS own, min(t) AS start_ts, max(t) AS end_ts, max(t) - min(t) AS duration_sec, round(avg(conf) + 1e-9::DOUBLE, 6) AS avg_confidence, count(*) AS n_points, arg_min(cx, (t, event_id)) AS first_cx,
               arg_max(cx, (t, event_id)) - arg_min(cx, (t, event_id)) AS dx, arg_max(cy, (t, event_id)) - arg_min(cy, (t, event_id)) AS dy FROM obs GROUP BY track, label),
  tr AS (SELECT 'u' || track AS video_id, 'u' || track || '.mp4' AS video_name, 'u' || track || ':' || own AS track_id, CASE own WHEN 'click' THEN 'Car' WHEN 'view' THEN 'person' ELSE own END AS label, start_ts, end_ts,
                duration_sec, avg_confidence, n_points, first_cx,
                CASE WHEN n_points < 2 THEN 'unknown' WHEN abs(dx) < 20 AND abs(dy) < 20 THEN 'stationary' WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx > 0 THEN 'left_to_right' ELSE 'right_to_left' END
                     ELSE CASE WHEN dy > 0 THEN 'top_to_bottom' ELSE 'bottom_to_top' END END AS direction FROM s)"""

_EVENTS = f"""{OBS},
  ev AS (SELECT CASE WHEN label = 'error' THEN 'other' ELSE 'u' || track END AS video_id, 'u' || track || '.mp4' AS video_name, 'u' || track || ':' || label || ':' || lpad(event_id::VARCHAR, 12, '0') AS event_id,
                CASE label WHEN 'error' THEN 'red_light_violation' WHEN 'purchase' THEN 'Wrong Way  Driving' ELSE 'vehicle_crosses_line' END AS event_type, floor(t) AS start_ts, floor(t) + 3 AS end_ts, conf AS confidence, track
         FROM obs WHERE label IN ('error', 'purchase', 'click'))"""

_VECTORS = """vec AS (SELECT vec_id, 'u' || (vec_id % 12) AS video_id, (vec_id * 37 % 2000)::DOUBLE * 100 AS tm, vec_id % 3 = 0 AS isseg,
                CASE WHEN vec_id % 3 = 0 THEN 'u' || (vec_id % 12) || '_seg' || vec_id END AS segment_id,
                list_dot_product(embedding::DOUBLE[], q.e::DOUBLE[]) / sqrt(list_dot_product(q.e::DOUBLE[], q.e::DOUBLE[])) AS score
         FROM embeddings, (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) q)"""

_BEST_DETECTIONS = """carframes AS (SELECT DISTINCT p.video_id, p.frame_path FROM det p JOIN det c ON c.video_id = p.video_id AND c.frame_path = p.frame_path
                WHERE p.label = 'car' AND c.label = ' Traffic  Light' AND (p.x1 - c.x1)^2 + (p.y1 - c.y1)^2 <= 625),
  bestdet AS (SELECT det.* FROM det JOIN carframes USING (video_id, frame_path) WHERE label = 'car' ORDER BY confidence DESC, video_name, ts, frame_path, frame_no, det_no LIMIT {k})"""

_WINDOWS = f"""{OBS},
  g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600 THEN 0 ELSE 1 END AS opens FROM obs WHERE track % 3 = 0 WINDOW w AS (PARTITION BY track ORDER BY t, event_id)),
  s AS (SELECT *, sum(opens) OVER (PARTITION BY track ORDER BY t, event_id) AS island FROM g),
  spans AS (SELECT track, 'u' || track AS video_id, island, min(t) AS start_ts, max(t) AS end_ts, min(event_id) AS first_id, max(label) AS event_type, count(*) AS n_frames FROM s GROUP BY track, island),
  o AS (SELECT *, CASE WHEN start_ts <= max(end_ts) OVER w + 1e-6 THEN 0 ELSE 1 END AS starts,
               greatest(0, coalesce(max(end_ts) OVER w, 0)) AS base FROM spans WINDOW w AS (PARTITION BY track ORDER BY start_ts, end_ts, first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  i AS (SELECT *, sum(starts) OVER (PARTITION BY track ORDER BY start_ts, end_ts, first_id) AS grp FROM o),
  own AS (SELECT video_id, grp, round(min(start_ts), 2) AS start_ts, round(max(end_ts), 2) AS end_ts, string_agg(event_type, ',' ORDER BY start_ts, end_ts, first_id) AS events, sum(n_frames) AS n_frames,
                 string_agg(CASE WHEN event_type = 'view' THEN 'seen ' || first_id END, '；' ORDER BY start_ts, end_ts, first_id) AS told, min(start_ts) AS raw FROM i GROUP BY video_id, grp)"""


def _values(rows) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows)


_PARSED = _values([(n, *r[:-1], *vocabulary.WEIGHTS[r[-1]]) for n, r in enumerate(PARSED)])

ORACLE_SQL = {
    "json_detections": f"WITH {_DETECTIONS} SELECT video_id, video_path, frame_path, ts, frame_no::INT AS frame_no, det_no::INT AS det_no, label, confidence, x1, y2 FROM det",
    "json_tracks": f"WITH {_TRACKS} SELECT video_id, track_id, label, start_ts, duration_sec, avg_confidence, direction, n_points, first_cx FROM tr",
    "json_events": f"WITH {_EVENTS} SELECT video_id, video_name, event_id, event_type, start_ts, end_ts, confidence FROM ev",
    "json_texts": "SELECT 'c' || conv_id || '.mp4' AS video_name, 't' || turn AS frame_path, turn::DOUBLE AS ts, 0 AS text_no, text, turn / 10 AS score FROM conversations",
    "bad_layer_files": """SELECT '{"video_id": "x", "frames": [' AS document""",
    "cached_layer": "SELECT r_name AS track_id, (SELECT count(*) FROM region) AS before, true AS reused FROM region UNION ALL SELECT 'more', (SELECT count(*) FROM region), true",
    "frame_videos": f"WITH {_DETECTIONS} SELECT frame_path, min(video_id) AS video_id FROM det GROUP BY frame_path",
    "search_detections": f"WITH {_DETECTIONS}, {_BEST_DETECTIONS.format(k=40)} SELECT 'detection::' || frame_path AS frame_id, video_id, ts, label, round(confidence, 6) AS score FROM bestdet",
    "search_detections_alone": f"WITH {_DETECTIONS} SELECT 'detection::' || frame_path AS frame_id, video_id, label, round(confidence, 6) AS score FROM det WHERE label = 'person' ORDER BY confidence DESC, video_name, ts, frame_path, frame_no, det_no LIMIT 40",
    "search_tracks": f"""WITH {_TRACKS} SELECT 'trajectory::' || track_id AS frame_id, video_id, track_id, label, direction, start_ts, end_ts, avg_confidence AS score FROM tr
        WHERE label = 'Car' AND direction = 'left_to_right' AND duration_sec >= 86400 ORDER BY avg_confidence DESC, duration_sec DESC, video_name, start_ts, track_id LIMIT 30""",
    "search_events": f"""WITH {_EVENTS} SELECT 'event::' || event_id AS frame_id, split_part(event_id, ':', 1) AS video_id, 'car' AS label, event_type, 'u' || track || ':1' AS track_id, start_ts, round(confidence, 6) AS score
        FROM ev WHERE event_type = 'Wrong Way  Driving' ORDER BY ev.confidence DESC, video_name, start_ts, event_type, event_id LIMIT 30""",
    "search_texts": r"""SELECT 'ocr::c' || conv_id || '.mp4' AS video_id, 'c' || conv_id || '.mp4' AS video_name, 'ocr::c' || conv_id || '.mp4::' || turn || '.0::t' || turn AS frame_id, turn::DOUBLE AS ts, 1.0::DOUBLE AS score
        FROM conversations WHERE contains(regexp_replace(lower(text), '\s+', '', 'g'), 'theof') ORDER BY video_name, turn LIMIT 25""",
    "search_speech": r"""SELECT 'ocr' AS channel, 'ocr::c' || conv_id || '.mp4::' || turn || '.0::t' || turn AS frame_id, 'c' || conv_id || '.mp4' AS video_name, turn::DOUBLE AS ts, 1.0::DOUBLE AS score
        FROM conversations WHERE turn >= 3 AND contains(regexp_replace(lower(text), '\s+', '', 'g'), 'theof') ORDER BY video_name, turn LIMIT 12""",
    "search_vectors": f"""WITH {_VECTORS} SELECT 'v' || vec_id AS frame_id, video_id, segment_id, tm AS start_ts, CASE WHEN isseg THEN tm + 4 ELSE tm END AS end_ts, tm AS ts, round(score, 4) AS score
        FROM vec ORDER BY vec.score DESC, vec_id LIMIT 30""",
    "search_hybrid": f"""WITH {_DETECTIONS}, {_TRACKS.replace(OBS + ",", "").strip()}, {_VECTORS}, {_BEST_DETECTIONS.format(k=45)},
        besttr AS (SELECT * FROM tr WHERE label = 'Car' ORDER BY avg_confidence DESC, duration_sec DESC, video_name, start_ts, track_id LIMIT 45),
        bestvec AS (SELECT * FROM vec ORDER BY score DESC, vec_id LIMIT 135),
        hits AS (
          SELECT 0 AS c, 'clip' AS channel, score, video_id, segment_id, tm AS a, CASE WHEN isseg THEN tm + 4 ELSE tm END AS b, tm AS ts, NULL AS label FROM bestvec
          UNION ALL SELECT 1, 'detection', confidence, video_id, NULL, ts, ts, ts, label FROM bestdet
          UNION ALL SELECT 2, 'trajectory', avg_confidence, video_id, NULL, start_ts, end_ts, start_ts, label FROM besttr),
        keyed AS (SELECT *, CASE WHEN segment_id IS NOT NULL THEN 'seg:' || segment_id ELSE video_id || ':' || CAST(floor(ts / 5) AS BIGINT) END AS key FROM hits),
        fused AS (SELECT key, any_value(video_id) AS video_id, any_value(segment_id) AS segment_id, min(a) AS start_ts, max(b) AS end_ts, min(ts) AS ts, string_agg(DISTINCT channel, ',' ORDER BY channel) AS matched_by,
                         coalesce(max(score) FILTER (c = 0), 0) AS s0, coalesce(max(score) FILTER (c = 1), 0) AS s1, coalesce(max(score) FILTER (c = 2), 0) AS s2,
                         coalesce(arg_min(label, (c, -score, a)) FILTER (label IS NOT NULL), '') AS label FROM keyed GROUP BY key),
        cal AS (SELECT *, least(greatest(s0, 0) / 0.35::DOUBLE, 1) AS c0, least(s1, 1) AS c1, least(s2, 1) AS c2 FROM fused),
        sc AS (SELECT *, least(least(0.35::DOUBLE * c0 + 0.20::DOUBLE * c1 + 0.15::DOUBLE * c2, 1)
                 + least(greatest((c0 > 0)::INT + (c1 > 0)::INT + (c2 > 0)::INT - 1, 0) * 0.05::DOUBLE + CASE WHEN label = 'car' THEN 0.03::DOUBLE ELSE 0 END, 0.10::DOUBLE), 1) AS best FROM cal),
        good AS (SELECT *, CASE WHEN end_ts <= start_ts THEN start_ts + 1 ELSE end_ts END AS stop, coalesce('s:' || segment_id, 'w:' || video_id || ':' || CAST(floor(ts / 5) AS BIGINT)) AS w FROM sc WHERE best >= 0.2),
        one AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY w ORDER BY best DESC, start_ts, key) = 1)
        SELECT key, video_id, start_ts, stop AS end_ts, matched_by, round(best, 4) AS best_score,
               '/api/search/download_clip?video_path=%2Fd%2F' || video_id || '.mp4&start_ts=' || start_ts || '&end_ts=' || greatest(stop, start_ts + 1) || '&output_name=clip_' || start_ts || 's' AS clip_url,
               substr(video_id, 2)::BIGINT < 6 AS clip_available FROM one ORDER BY best DESC, video_id || '.mp4', start_ts, key LIMIT 15""",
    "search_without_a_channel": f"""WITH {_DETECTIONS},
        best AS (SELECT * FROM det WHERE label = 'car' ORDER BY confidence DESC, video_name, ts, frame_path, frame_no, det_no LIMIT 60),
        f AS (SELECT video_id, video_name, min(ts) AS start_ts, max(ts) AS end_ts, 0.20::DOUBLE * least(max(confidence), 1) + 0.03::DOUBLE AS score FROM best GROUP BY video_id, video_name, floor(ts / 5))
        SELECT video_id, start_ts, CASE WHEN end_ts <= start_ts THEN start_ts + 1 ELSE end_ts END AS end_ts, 'detection' AS matched_by, 'car' AS label, round(score, 4) AS best_score FROM f WHERE score >= 0.2
        ORDER BY score DESC, video_name, start_ts LIMIT 20""",
    "fused_segments": f"""{WITH_OBS},
        h AS (SELECT floor(conf * 4) / 4 AS score, video::VARCHAR AS v, CASE label WHEN 'view' THEN 'clip' WHEN 'click' THEN 'detection' ELSE 'event' END AS channel, CASE WHEN label = 'view' THEN 's_' || track || '_' || day END AS seg, floor(t) AS a FROM obs),
        k AS (SELECT *, CASE WHEN seg IS NOT NULL THEN 'seg:' || seg ELSE v || ':' || CAST(floor(a / 60) AS BIGINT) END AS key FROM h),
        f AS (SELECT key, any_value(v) AS v, any_value(seg) AS seg, min(a) AS start_ts, max(a) + 2 AS end_ts, max(score) AS best_score, list_sort(list(DISTINCT channel)) AS m FROM k GROUP BY key),
        g AS (SELECT *, coalesce('s:' || seg, 'w:' || v || ':' || CAST(floor(start_ts / 3600) AS BIGINT)) AS w FROM f WHERE best_score >= 0.25),
        t AS (SELECT *, max(best_score) OVER (PARTITION BY w) AS top FROM g),
        u AS (SELECT w, list_sort(list_distinct(flatten(list(m)))) AS shared FROM t WHERE best_score = top GROUP BY w)
        SELECT key, best_score, start_ts, end_ts, array_to_string(shared, ',') AS matched_by FROM t JOIN u USING (w) QUALIFY row_number() OVER (PARTITION BY w ORDER BY best_score DESC, start_ts, key) = 1""",
    "intents_parsed": f"""SELECT n::BIGINT AS n, query, query_type, primary_entities, context, relations, directions, motions, events, light, route, confidence::DOUBLE AS confidence, n_candidates::BIGINT AS n_candidates, w_clip::DOUBLE AS w_clip, w_detection::DOUBLE AS w_detection, w_trajectory::DOUBLE AS w_trajectory,
        w_event::DOUBLE AS w_event, w_ocr::DOUBLE AS w_ocr
        FROM (VALUES {_PARSED}) AS p(n, query, query_type, primary_entities, context, relations, directions, motions, events, light, route, confidence, n_candidates, w_clip, w_detection, w_trajectory, w_event, w_ocr)""",
    "intent_rewrites": "SELECT query, n::BIGINT AS n, variant FROM (VALUES ('白色汽车', 0, 'white car'), ('白色汽车', 1, 'white sedan'), (' red car ', 0, 'red car'), ('逆行', 0, '逆行'), ('逆行', 1, 'wrong_way_driving')) AS p(query, n, variant)",
    "english_queries": r"SELECT doc_id, regexp_matches(regexp_replace(substr(text, 1, 8), '[\s_\-]+', '', 'g'), '^[\x00-\x7F]+$') AS english FROM documents",
    "rule_events": f"""WITH {PLACED}
        SELECT 'vehicle_crosses_line' AS event_type, contact.video::VARCHAR AS video_id, count(*) AS n, min('f_' || lpad(event_id::VARCHAR, 12, '0') || '.jpg') AS first_frame, '汽车越过车道线（压线）' AS description
        FROM contact JOIN p ON p.track = contact.track AND p.i = greatest(contact_i - 1, 0) GROUP BY contact.video""",
    "wrong_way_in_region": f"""WITH {PLACED},
        ix AS (SELECT *, round_even((n - 1) * 0.25, 0) AS lo, round_even((n - 1) * 0.75, 0) AS hi FROM p),
        jx AS (SELECT *, CASE WHEN hi <= lo THEN least(lo + 1, n - 1) ELSE hi END AS h2 FROM ix WHERE n >= 3),
        ab AS (SELECT track, any_value(video) AS video, max(cx) FILTER (i = lo) AS ax, max(cy) FILTER (i = lo) AS ay, max(cx) FILTER (i = h2) AS bx, max(cy) FILTER (i = h2) AS yb, any_value(lx - fx) AS dx, any_value(ly - fy) AS dy,
                      max(t) - min(t) AS span, avg((cx BETWEEN 0.5 AND 300.5 AND cy <= 60.5)::INT) AS roi FROM jx GROUP BY track),
        u AS (SELECT *, CASE WHEN sqrt((bx - ax)^2 + (yb - ay)^2) > 1e-9 THEN (bx - ax) / sqrt((bx - ax)^2 + (yb - ay)^2) WHEN sqrt(dx^2 + dy^2) > 1e-9 THEN dx / sqrt(dx^2 + dy^2) END AS d
              FROM ab WHERE span >= 1 AND sqrt(dx^2 + dy^2) >= 20 AND roi >= 0.35)
        SELECT video || ':wrong_way_driving:' || track AS event_id, round(d, 6) AS dot, 3::BIGINT AS n_snapshots FROM u WHERE d <= 0.2""",
    "frame_lights": f"""{WITH_OBS} SELECT video::VARCHAR AS video_id, floor(t / 7200) AS t, arg_max(CASE WHEN label = 'error' THEN 'red' ELSE 'green' END, (cy, event_id)) AS state, arg_max(conf, (cy, event_id)) AS conf
        FROM obs WHERE label IN ('error', 'view') GROUP BY video, floor(t / 7200)""",
    "python_rule_events": f"""{WITH_OBS}, n AS (SELECT video, track::VARCHAR AS track, count(*) AS n FROM obs GROUP BY ALL),
        b AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY n DESC, track) AS r FROM n)
        SELECT video || ':longest:' || track AS event_id, track AS track_id, (video IN (SELECT video FROM obs WHERE label IN ('error', 'view')))::INT::DOUBLE AS confidence FROM b WHERE r = 1""",
    "segment_groups": f"""WITH {_WINDOWS}
        SELECT video_id || '_seg' || lpad((row_number() OVER (PARTITION BY video_id ORDER BY start_ts, end_ts))::VARCHAR, 3, '0') AS segment_id, video_id, round(start_ts, 1) AS start_ts, round(end_ts, 1) AS end_ts, events,
               n_frames::BIGINT AS n_frames, video_id || ':1' AS tracks, coalesce(told, '视频片段_' || video_id || '_' || raw) AS text FROM own""",
    "segments_numbered": f"""WITH {_WINDOWS},
        d AS (SELECT 'u' || track AS video_id, floor(max(t)) + 100000 AS duration FROM obs GROUP BY track),
        n1 AS (SELECT video_id, base, floor((start_ts - base + 1e-6) / 21600)::BIGINT AS n FROM o),
        w1 AS (SELECT video_id, base + k * 21600 AS a, base + (k + 1) * 21600 AS b FROM n1, unnest(range(n)) AS u(k) WHERE n >= 1),
        l AS (SELECT d.video_id, duration, greatest(0, coalesce(max(end_ts), 0)) AS base FROM d LEFT JOIN spans USING (video_id) GROUP BY d.video_id, duration),
        w2 AS (SELECT video_id, base + k * 21600 AS a, base + (k + 1) * 21600 AS b FROM l, unnest(range(floor((duration - base + 1e-6) / 21600)::BIGINT)) AS u(k)),
        every AS (SELECT video_id, 0 AS kind, start_ts, end_ts, coalesce(told, '视频片段_' || video_id || '_' || raw) AS text FROM own
                  UNION ALL SELECT video_id, 1, round(a, 2), round(b, 2), '视频片段_' || video_id || '_' || round(a, 2) FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2)),
        num AS (SELECT *, video_id || '_seg' || CASE WHEN row_number() OVER w < 1000 THEN lpad((row_number() OVER w)::VARCHAR, 3, '0') ELSE (row_number() OVER w)::VARCHAR END AS segment_id FROM every WINDOW w AS (PARTITION BY video_id ORDER BY kind, start_ts, end_ts))
        SELECT video_id, count(*) AS n, count(*) FILTER (kind = 1) AS n_windows, max(segment_id) AS last_id, round(max(end_ts), 1) AS last_end, max(text) AS last_text FROM num GROUP BY video_id""",
    "window_frames": f"""WITH {_WINDOWS}, ws AS (SELECT video_id, track, round(base + k * 21600, 2) AS a, round(base + (k + 1) * 21600, 2) AS b FROM (SELECT video_id, track, base, floor((start_ts - base + 1e-6) / 21600)::BIGINT AS n FROM o WHERE track IN (0, 3, 6, 9)), unnest(range(n)) AS u(k) WHERE n >= 1),
        m AS (SELECT ws.video_id, a, b, t, event_id FROM ws LEFT JOIN obs ON obs.track = ws.track AND t >= a - 1e-6 AND t <= b + 1e-6)
        SELECT video_id, round(a, 1) AS start_ts, coalesce(array_to_string(list_slice(list(lpad(event_id::VARCHAR, 12, '0') ORDER BY t, event_id) FILTER (t IS NOT NULL), 1, 3), ','), '') AS frames FROM m GROUP BY video_id, a, b""",
    "segment_states": f"""{WITH_OBS} SELECT DISTINCT 'u' || track AS video_id, CASE track % 5 WHEN 0 THEN 'no_events' WHEN 1 THEN 'build_failed' WHEN 2 THEN 'empty_segments' WHEN 3 THEN 'built' ELSE 'pipeline_failed' END AS status FROM obs""",
    "segment_tables": f"""WITH {_WINDOWS},
        w AS (SELECT video_id, floor((start_ts - base + 1e-6) / 3600)::BIGINT AS n FROM o),
        e AS (SELECT video_id, count(*) AS n FROM own GROUP BY video_id), f AS (SELECT video_id, sum(greatest(n, 0)) AS n FROM w GROUP BY video_id)
        SELECT video_id, (e.n + CASE WHEN video_id = 'u3' THEN 0 ELSE f.n END)::BIGINT AS n, (e.n + CASE WHEN video_id = 'u3' THEN 0 ELSE f.n END)::BIGINT AS n_vectors, e.n AS n_event_segments
        FROM e JOIN f USING (video_id) WHERE video_id IN ('u0', 'u3', 'u6')""",
    "segment_texts": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '检测到 ' || CASE WHEN p_partkey % 2 = 0 THEN '公交车' ELSE 'boat' END || CASE WHEN p_partkey % 4 = 1 THEN '，识别到文本 ' || p_brand ELSE '' END
          ELSE CASE WHEN p_partkey % 4 = 1 THEN '识别到文本' ELSE '视频片段_' END END AS text,
        CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE ELSE p_size + 0.5 END::VARCHAR AS at FROM part""",
    "safe_names": r"""SELECT p_partkey, substr(regexp_replace(regexp_replace('._ ' || p_name || '/é', '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 80) AS safe, 'bad <path> near <path>' AS message FROM part""",
    "clip_links": """SELECT '/d/a b/' || c_custkey || '.mp4' AS video_path,
        '/api/search/download_clip?video_path=%2Fd%2Fa%20b%2F' || c_custkey || '.mp4&start_ts=' || c_nationkey || '.0&end_ts=' || greatest(c_nationkey % 3 * 10, c_nationkey + 1) || '.0&output_name='
          || CASE WHEN c_custkey % 2 = 0 THEN 'wrong_way_driving' ELSE 'clip' END || '_' || c_nationkey || '.0s' AS clip_url,
        c_custkey IN (SELECT s_suppkey FROM supplier) AS clip_available FROM customer""",
    "vectors_checked": """WITH v AS (SELECT vec_id, (vec_id * 37 % 2000)::DOUBLE * 100 AS tm,
          CASE WHEN vec_id % 7 = 0 THEN 'dimension' WHEN vec_id % 11 = 1 THEN 'not a number' WHEN vec_id % 3 <> 0 AND vec_id % 5 = 0 THEN 'no frame path' ELSE '' END AS reason FROM embeddings)
        SELECT vec_id AS ext_id, reason, CASE WHEN reason = '' THEN round(CASE WHEN vec_id % 3 = 0 THEN tm + 2 ELSE tm + 0.126 END, 2) END AS timestamp_seconds FROM v""",
    "vectors_numbered": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 + (SELECT count(*) FROM supplier) AS ext_id FROM orders",
    "vector_tables": "SELECT 'u' || (vec_id % 12) AS video_id, 'v' || vec_id AS frame_id, CASE WHEN vec_id % 12 = 1 THEN 0 ELSE (vec_id * 37 % 2000)::DOUBLE * 100 END AS timestamp_seconds, 64::BIGINT AS dimension FROM embeddings",
    "vector_bundle": "SELECT vec_id AS ext_id, 'v' || vec_id AS frame_id, 'v' || vec_id AS old_id, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings WHERE vec_id < 20",
    "encoded_names": "SELECT n_name, round((length(n_name) / sqrt(length(n_name)^2 + 1))::FLOAT::DOUBLE, 5) AS x, true AS stale FROM nation",
    "layer_rewritten": f"""{WITH_OBS} SELECT video::VARCHAR AS video_id, count(*) AS n, min(event_id) AS first FROM obs WHERE video NOT IN (1, 2) OR label = 'view' GROUP BY video""",
    "listed_videos": "SELECT v AS video_id, i::INT AS frame_index, round(i / 25.0, 2)::DOUBLE AS ts FROM (VALUES ('a'), ('b')) AS x(v), unnest([0, 5, 10]) AS u(i)",
    "imported_sequences": """SELECT 'scene' AS video_name, i::BIGINT AS frame_index, round(i / 15.0, 3)::DOUBLE AS ts, NULL AS weather, NULL AS road, NULL AS frame FROM unnest([0, 3, 6]) AS u(i)
        UNION ALL SELECT 'crash', i, round(i / 20.0, 3)::DOUBLE, 'rain', 'wet', '77' FROM unnest([0, 2]) AS u(i)""",
    "archived_frames": "SELECT 'crash' AS video_name, 'arr_' || i AS frame, i::BIGINT AS frame_index, round(i / 20.0, 3)::DOUBLE AS ts FROM unnest([0, 7, 33]) AS u(i)",
    "ingest_chain": """SELECT 'r' || v AS video_id, 'built' AS status, 400::BIGINT AS n_points, 10::BIGINT AS n_tracks, 10::BIGINT AS n_events, 5::BIGINT AS n_segments, 'left_to_right' AS direction, 39.0::DOUBLE AS duration
        FROM unnest(range(5)) AS a(v)""",
    "named_sources": f"""WITH {_DETECTIONS} SELECT 'U' || substr(video_id, 2) || '.AVI' AS video_name, '/src/U' || substr(video_id, 2) || '.AVI' AS video_path, count(*) AS n, count(DISTINCT label) AS n_labels
        FROM det WHERE label <> '' AND substr(video_id, 2)::BIGINT % 2 = 0 AND substr(video_id, 2)::BIGINT < 1500 GROUP BY video_id""",
    "class_labels": """WITH c AS (SELECT l_orderkey, l_linenumber % 2 AS k, arg_max(l_returnflag, l_linenumber * 1e9 + l_extendedprice) AS label FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL)
        SELECT l.l_orderkey::VARCHAR AS frame_path, l_linenumber, coalesce(c.label, '') AS label FROM lineitem l LEFT JOIN c ON c.l_orderkey = l.l_orderkey AND c.k = l_linenumber % 2
        WHERE l.l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)""",
    "layers_in_order": f"""WITH {_TRACKS}, {_EVENTS.replace(OBS + ",", "").strip()},
        a AS (SELECT 'track' AS kind, track_id AS id FROM tr ORDER BY video_id, label, start_ts, track_id LIMIT 20),
        b AS (SELECT 'event' AS kind, event_id AS id FROM ev WHERE video_id <> 'other' ORDER BY video_id, start_ts, end_ts, event_type, event_id LIMIT 20) SELECT * FROM a UNION ALL SELECT * FROM b""",
    "moved_frames": """SELECT CASE WHEN o_orderkey IN (SELECT p_partkey FROM part) THEN '/new/' || (o_orderkey % 2) || '/' || o_orderkey || '.jpg' ELSE '/old/' || o_orderkey || '.jpg' END AS frame_path, o_custkey::VARCHAR AS video_id,
        o_custkey IN (SELECT s_suppkey FROM supplier) AS segment_built FROM orders""",
    "eval_by_mode": "SELECT o_orderstatus AS mode, count(*) AS n_queries, round(avg(o_orderkey % 5 / 4), 4) AS precision_at_k, round(avg(o_custkey % 3 / 2), 4) AS recall FROM orders GROUP BY o_orderstatus",
    "right_of_frames": f"""{WITH_OBS} SELECT event_id FROM obs p WHERE label = 'click' AND EXISTS (SELECT 1 FROM obs a JOIN obs b ON a.track = b.track AND a.day = b.day
        WHERE a.label = 'click' AND b.label = 'error' AND a.track = p.track AND a.day = p.day AND a.cx > b.cx)""",
    "stream_upserted": f"{WITH_OBS} SELECT video::VARCHAR AS video_id, count(*) AS n FROM obs WHERE video >= 5 OR event_id % 2 = 0 GROUP BY video",
    "stream_tracks": "SELECT 'r' || v AS video_id, 'r' || v || ':' || (l + 1) AS track_id, 29::BIGINT AS n, 1::BIGINT AS lanes, 0::DOUBLE AS first, 28::DOUBLE AS last FROM unnest(range(5)) AS a(v), unnest(range(10)) AS b(l)",
}
