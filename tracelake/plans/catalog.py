"""Named queries over the driver's tables, one per operator, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import geometry, text, vectors
from tracelake.operators import channels, evaluate, fusion, index, intervals, rules, segments, tracking, tracks
from tracelake.plans import adapters, intent
from tracelake.plans.adapters import LINE, OBS, observations, table
from tracelake.plans.vocabulary import EVENT_TIERS, EVENT_WORDS
from tracelake.sources import layers, sinks
from tracelake.streaming import streams

SESSION_GAP, DAY = 21600.0, 86400.0
WITH_OBS = f"WITH {OBS}"
WITH_OBS_MORE = f"WITH {OBS}, "


# ---- filters, top-k, relations ---------------------------------------------------------------------------------------


def detection_topk(spark, sf_dir):
    obs = observations(spark, sf_dir).where("label in ('click', 'view')")
    return channels.top(obs, 50, F.desc("conf"), "track", "t", "event_id").select("event_id", "track", "label", F.round("conf", 6).alias("conf"))


def _relation(spark, sf_dir, name, half=25.0):
    rows = adapters.boxed(observations(spark, sf_dir), half / geometry.NEAR_WIDTHS / 2).withColumn("frame", F.struct("track", "day"))
    primary, context = rows.where("label = 'click'"), rows.where("label = 'error'")
    return channels.frames_where(primary, context, name, ["track", "day"]).select("event_id", "track", "day")


def detection_relation_near(spark, sf_dir):
    return _relation(spark, sf_dir, "near")


def detection_relation_left_of(spark, sf_dir):
    return _relation(spark, sf_dir, "left_of")


def detection_relation_inside(spark, sf_dir):
    rows = observations(spark, sf_dir)
    box = lambda df, half: adapters.boxed(df, half)
    return channels.frames_where(box(rows.where("label = 'click'"), 5.0), box(rows.where("label = 'view'"), 80.0), "inside", ["track", "day"]).select("event_id", "track", "day")


def detection_cooccurrence(spark, sf_dir):
    return _relation(spark, sf_dir, None)


def trajectory_topk(spark, sf_dir):
    rows = tracks.summaries(observations(spark, sf_dir), ["track"], "t", "event_id")
    rows = rows.where((F.col("direction") == "left_to_right") & (F.col("duration") >= DAY))
    best = channels.top(rows.withColumn("avg_conf", F.round("avg_conf", 6)), 25, F.desc("avg_conf"), F.desc("duration"), "track")
    return best.select("track", "avg_conf", "duration", "direction")


# ---- tracks ----------------------------------------------------------------------------------------------------------


def track_summary(spark, sf_dir):
    rows = tracks.summaries(observations(spark, sf_dir), ["track"], "t", "event_id")
    return rows.select("track", "start_ts", "end_ts", "n_points", F.round("avg_conf", 6).alias("avg_conf"), "max_conf", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"), "direction", "best_point")


def point_dedup(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("bucket", F.floor(F.col("cx") / 50))
    return tracks.without_repeats(rows, ["track"], "t", "event_id", ["label", "bucket"]).select("event_id", "track", "label")


def frame_rate_estimate(spark, sf_dir):
    rows = tracks.frame_rates(observations(spark, sf_dir), ["video"], "t")
    return rows.select("video", F.round("median_step", 6).alias("median_step"), "rate")


def line_contact(spark, sf_dir):
    placed = tracks.positioned(adapters.points(spark, sf_dir), rules.KEY, "t", "pid")
    rows = tracks.line_contacts(placed, rules.KEY, "t", LINE, 10.0)
    return rows.select("video_id", "track_id", "contact_i", "contact_t", "mode")


def line_contact_center_path(spark, sf_dir):
    """Contacts of the centre's path alone: boxes are left out."""
    box = F.struct(*[F.lit(None).cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")])
    placed = tracks.positioned(adapters.points(spark, sf_dir).withColumn("box", box), rules.KEY, "t", "pid")
    return tracks.line_contacts(placed, rules.KEY, "t", LINE, 10.0).select("video_id", "track_id", "contact_i", "contact_t", "mode")


def event_crosses_line(spark, sf_dir):
    found = rules.crosses_line(adapters.points(spark, sf_dir), adapters.lights(spark, sf_dir), {"line": [list(p) for p in LINE]})
    return found.select("event_id", "event_type", "start_ts", "end_ts", F.round("confidence", 6).alias("confidence"), "cross_ts", "mode", F.array_join("evidence", ",").alias("evidence"))


def wrong_way(spark, sf_dir):
    found = rules.wrong_way(adapters.points(spark, sf_dir), adapters.lights(spark, sf_dir), {"allowed_direction": [1.0, 0.0], "max_direction_dot": -0.3})
    return found.select("event_id", "start_ts", "end_ts", F.round("score", 6).alias("dot"), F.round("confidence", 6).alias("confidence"))


def red_intervals(spark, sf_dir):
    reds = adapters.lights(spark, sf_dir).where("state = 'red'")
    return intervals.phase_intervals(reds, "video_id", "t", 7200.0, "frame_path")


def red_light_crossing(spark, sf_dir):
    config = {"line": [list(p) for p in LINE], "state_window_sec": 7200.0, "red_merge_gap_sec": 7200.0, "min_red_duration_sec": 1800.0}
    found = rules.red_light(adapters.points(spark, sf_dir), adapters.lights(spark, sf_dir), config)
    return found.select("event_id", "start_ts", "end_ts", "cross_ts", F.round("confidence", 6).alias("confidence"), F.round("score", 6).alias("light_conf"))


def three_snapshots(spark, sf_dir):
    """Nearest frames before, at and after the line, of tracks that touch it."""
    found = rules.crosses_line(adapters.points(spark, sf_dir), adapters.lights(spark, sf_dir), {"line": [[100.0, 50.0], [400.0, 50.0]]})
    return found.select("event_id", F.size("snapshots").cast("long").alias("n_snapshots"), F.element_at("snapshots", 1).alias("before"))


# ---- sessions, segments ----------------------------------------------------------------------------------------------


def _spans(spark, sf_dir) -> DataFrame:
    """Sessions of a track as events of its video."""
    rows = intervals.gap_islands(observations(spark, sf_dir), ["track"], "t", SESSION_GAP, "event_id")
    rows = rows.groupBy("track", "island").agg(F.min("t").alias("start_ts"), F.max("t").alias("end_ts"), F.min("event_id").alias("first_id"), F.max("label").alias("event_type"))
    return rows.select(
        F.col("track").cast("string").alias("video_id"), "start_ts", "end_ts", F.format_string("%012d", "first_id").alias("event_id"), "event_type",
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("track_id"), F.array().cast("array<string>").alias("evidence"),
    )


def frame_sessions(spark, sf_dir):
    return intervals.frame_sessions(observations(spark, sf_dir), "track", "t", SESSION_GAP, "event_id").drop("island")


def segments_events(spark, sf_dir):
    """Runs of touching sessions of all tracks of a video."""
    rows = _spans(spark, sf_dir).withColumn("video_id", (F.col("video_id").cast("long") % 10).cast("string"))
    found = intervals.merged_intervals(rows, ["video_id"], "start_ts", "end_ts", "event_id")
    return found.groupBy("video_id", "island").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("n_events"))


def segments_fallback(spark, sf_dir):
    rows = intervals.gap_windows(_spans(spark, sf_dir), "video_id", "start_ts", "end_ts", "event_id", DAY)
    return rows.groupBy("video_id").agg(F.count("*").alias("n_windows"), F.round(F.min("start_ts"), 4).alias("first_start"), F.round(F.max("end_ts"), 4).alias("last_end"))


def segments_all(spark, sf_dir):
    """Numbered segments of every track: event groups first, then day windows between them."""
    spans = _spans(spark, sf_dir)
    own = segments.event_segments(spans).select("video_id", "start_ts", "end_ts", F.size("events").cast("long").alias("n_events"))
    return own.withColumn("start_ts", F.round("start_ts", 1)).withColumn("end_ts", F.round("end_ts", 1))


def retain_window(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return intervals.retained(rows, "video", "event_id", F.col("label") == "purchase", 5).select("event_id", "video", "label")


def activity_filter(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return intervals.activity_retained(rows, "video", "event_id", F.col("label") == "click", 30, 60).select("event_id", "video")


def nearest_light(spark, sf_dir):
    """As-of join: each purchase with the light state nearest in time, within two hours."""
    rows = observations(spark, sf_dir).where("label = 'purchase'").select(F.col("video").cast("string").alias("video_id"), "event_id", "t")
    found = intervals.nearest_state(rows, "video_id", "t", "event_id", adapters.lights(spark, sf_dir), "t", [-F.col("conf"), F.col("frame_path")], 7200.0, ["state"])
    return found.select("event_id", "state_state", "state_at")


def points_in_red(spark, sf_dir):
    rows = observations(spark, sf_dir).select(F.col("video").cast("string").alias("video_id"), "event_id", "t")
    reds = intervals.phase_intervals(adapters.lights(spark, sf_dir).where("state = 'red'"), "video_id", "t", 7200.0, "frame_path")
    return intervals.points_in_intervals(rows, "video_id", "t", reds, "phase_start", "phase_end", DAY).select("event_id", "video_id")


# ---- vectors ---------------------------------------------------------------------------------------------------------


def _query_vectors(spark, sf_dir, ids=(0, 1, 2)) -> list[list[float]]:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*ids)).orderBy("vec_id").collect()  # a few given query rows
    return [list(r["embedding"]) for r in rows]


def vector_topk(spark, sf_dir):
    (query,) = _query_vectors(spark, sf_dir, (0,))
    rows = channels.nearest(table(spark, sf_dir, "embeddings"), query, 20, "vec_id", "embedding", normalise=False)
    return rows.select("vec_id", "label", F.round("score", 4).alias("score"))


def vector_variants(spark, sf_dir):
    rows = channels.nearest_variants(table(spark, sf_dir, "embeddings"), _query_vectors(spark, sf_dir), 10, "vec_id", 3, "embedding")
    return rows.select("vec_id", F.round("score", 4).alias("score"))


def vector_normalised(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("unit", vectors.normalised(F.transform("embedding", lambda x: x * 3)))
    return rows.select("vec_id", F.round(vectors.norm(F.col("unit")), 4).alias("norm"), F.round(F.element_at("unit", 2).cast("double"), 3).alias("second"))


def _table_and_new(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("video_id"), F.col("embedding").alias("vec"))
    return rows, rows.where("video_id in (1, 2) and vec_id % 2 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), "video_id", F.reverse("vec").alias("vec"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", "video_id", F.round(F.element_at("vec", 1).cast("double"), 4).alias("first"))


def vector_upsert_overwrite(spark, sf_dir):
    return _shown(index.upserted(*_table_and_new(spark, sf_dir)))


def vector_upsert_append(spark, sf_dir):
    return _shown(index.upserted(*_table_and_new(spark, sf_dir), overwrite=False))


def vector_remove(spark, sf_dir):
    return _shown(index.removed(_table_and_new(spark, sf_dir)[0], 3))


def index_build(spark, sf_dir):
    """First vector of each key, in order of id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("k"), (F.col("vec_id") % 97).cast("string")).alias("frame_id"))
    return index.built(rows, ["vec_id"])


def index_stats(spark, sf_dir):
    return index.statistics(table(spark, sf_dir, "embeddings"), "label")


# ---- text ------------------------------------------------------------------------------------------------------------


def text_contains_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where(text.normal_text("text").contains("theof"))
    return channels.top(rows.withColumn("size", F.length("text")), 30, F.desc("size"), "conv_id", "turn", "text").select("conv_id", "turn", "role", "size")


def text_fuzzy_topk(spark, sf_dir):
    """The benchmark items most similar to a fixed phrase."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = channels.scored_texts(rows, "that and onesen erblest", "text")
    return channels.top(found, 10, F.desc("similarity"), "item_id").select("item_id", F.round("similarity", 4).alias("similarity"))


def identifiers(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", text.asset_id("url").alias("asset"), text.frame_id("url", F.col("page_id") / 7).alias("frame"), text.folded_stem("url").alias("stem"))


def display_times(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return rows.select("event_id", text.display_time("t").alias("shown"))


def frame_names(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("name", F.concat(F.lit("/v/cam "), "video", F.lit("_"), F.format_string("%.2f", F.round("cx", 2)), F.lit(".jpg")))
    rows = obs.select("event_id", text.frame_name_parts("name").alias("p"), text.frame_file_name(text.stem("name"), F.lit(1.5)).alias("safe"))
    return rows.select("event_id", "p.name", "p.seconds", "safe")


def clip_urls(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", text.percent_encoded(F.concat(F.lit("/v 1/"), F.col("page_id").cast("string"), F.lit("é&.mp4"))).alias("encoded"))
    return rows


def normal_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return rows.select(
        "p_partkey", text.normal_label(F.concat(F.lit("  "), "p_name", F.lit("\t x "))).alias("label"), text.normal_event_type("p_type").alias("event_type"),
        text.normal_entity(F.translate("p_type", " ", "_")).alias("entity"), text.normal_text("p_name").alias("text"),
        text.normal_direction(F.when(F.col("p_partkey") % 2 == 0, F.lit("Left-To Right")).otherwise(F.lit("up"))).alias("direction"),
    )


# ---- intent, fusion, evaluation --------------------------------------------------------------------------------------

QUERIES_TEXT = ("逆行的车辆", "闯红灯的白色汽车", "红灯时通过路口的公交车", "压线行驶的货车", "开错方向的车", "路口左转的货车", "车道偏离", "红绿灯附近的车")


def intent_events_batch(spark, sf_dir):
    asked = spark.createDataFrame(list(enumerate(QUERIES_TEXT)), "query_id long, query string")
    return intent.batch_events(asked, intent.event_alias_table(spark))


def _sql_values(rows) -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows)


def _channel_hits(spark, sf_dir) -> DataFrame:
    """Observations as hits: views are vector hits, clicks detections, purchases tracks, errors events, signups texts."""
    of = {"view": "clip", "click": "detection", "purchase": "trajectory", "error": "event", "signup": "ocr"}
    names = F.create_map(*[F.lit(x) for p in of.items() for x in p])
    rows = observations(spark, sf_dir).withColumn("channel", F.element_at(names, F.col("label")))
    at = F.floor(F.col("t")).cast("double")
    score = F.when(F.col("channel") == "clip", F.col("conf") * 0.5).otherwise(F.col("conf"))
    return channels.hits(
        rows, F.col("channel"), score=score, video_id=F.col("track").cast("string"), video_name=F.col("track").cast("string"),
        frame_id=F.col("event_id").cast("string"), start_ts=at, end_ts=at + F.when(F.col("channel") == "event", 10.0).otherwise(0.0), ts=at,
        label=F.when(F.col("channel") == "detection", F.lit("car")), event_type=F.when(F.col("channel") == "event", F.lit("red_light_violation")),
    )


def fuse_channels(spark, sf_dir):
    rows = fusion.fuse(_channel_hits(spark, sf_dir), DAY)
    scores = [F.round(f"{c}_score", 6).alias(f"{c}_score") for c in fusion.vocabulary.CHANNELS]
    return rows.select("key", "start_ts", "end_ts", F.array_join("matched_by", ",").alias("matched_by"), *scores, "label", "event_type", "frame_id")


def hybrid_score(spark, sf_dir):
    rows = fusion.scored(fusion.fuse(_channel_hits(spark, sf_dir), DAY), intent.parse("闯红灯的汽车"))
    return rows.select("key", F.round("best_score", 6).alias("best_score"))


def hybrid_topk(spark, sf_dir):
    rows = fusion.scored(fusion.fuse(_channel_hits(spark, sf_dir), DAY), intent.parse("闯红灯的汽车"))
    found = fusion.aggregate(rows.withColumn("best_score", F.round("best_score", 6)), 40, 0.2, DAY)
    return found.select("key", "best_score", "start_ts", "end_ts", F.array_join("matched_by", ",").alias("matched_by"))


def _results(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Sessions of the first labels as ranked results of queries, and some sessions as what was expected."""
    spans = _spans(spark, sf_dir).withColumn("query_id", F.length("event_type")).withColumn("video_name", F.concat("video_id", F.lit(".AVI")))
    results = evaluate.best_per_video(spans.withColumn("score", F.round(F.col("end_ts") - F.col("start_ts"), 3)), 10, ["query_id"])
    wanted = spans.where(F.col("video_id").cast("long") % 3 == 0).withColumn("video_name", F.concat("video_id", F.lit(".mp4")))
    return results, wanted.select("query_id", F.col("event_id").alias("number"), "video_name", "start_ts", "end_ts")


def eval_precision_recall(spark, sf_dir):
    rows = evaluate.precision_recall(*_results(spark, sf_dir), 10)
    return rows.select("query_id", "hits", F.round("precision_at_k", 6).alias("precision_at_k"), F.round("recall", 6).alias("recall"))


def eval_mrr_rollup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    reports = orders.select(
        F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("subcategory"), (F.col("o_orderkey") % 8).alias("first_rank"),
        (F.col("o_orderkey") % 8 == 1).alias("hit_at_1"), (F.col("o_orderkey") % 8).between(1, 5).alias("hit_at_5"),
    )
    return evaluate.by_category(reports)


def eval_event_boost(spark, sf_dir):
    clip = table(spark, sf_dir, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".mp4")).alias("video_name"), (F.col("s_acctbal") / 20000).alias("score"))
    events = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".AVI")).alias("video_name"), (F.abs(F.col("c_acctbal")) / 10000).alias("confidence"))
    rows = evaluate.boosted(clip, events, 0.15)
    return rows.select("video_name", F.round("score", 6).alias("score"), F.round("event_confidence", 6).alias("event_confidence"))


def event_counts(spark, sf_dir):
    rows = observations(spark, sf_dir).select(F.col("video").alias("video_id"), F.col("label").alias("event_type"))
    return evaluate.event_counts(rows).withColumn("event_types", F.array_join("event_types", ","))


def event_topk(spark, sf_dir):
    """Events of two types by confidence, through the event channel's order."""
    rows = observations(spark, sf_dir).where(text.normal_event_type("label").isin("error", "purchase"))
    return channels.top(rows, 40, F.desc("conf"), "track", "t", "label", "event_id").select("event_id", "label", F.round("conf", 6).alias("conf"))


def light_states(spark, sf_dir):
    """State of lights from colour shares and heights (here: tax, discount and quantity of lines)."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_tax") * 2).alias("red_ratio"), F.col("l_discount").alias("yellow_ratio"), (F.col("l_quantity") / 500).alias("green_ratio"),
        (F.col("l_quantity") / 50).alias("red_centroid"), (F.col("l_discount") * 10).alias("yellow_centroid"), (1 - F.col("l_quantity") / 50).alias("green_centroid"),
    )
    return rules.light_scores(rows, 0.01).select("l_orderkey", "l_linenumber", "state", F.round("conf", 6).alias("conf"))


# ---- ingest, sinks, status -------------------------------------------------------------------------------------------


def frames_by_video(spark, sf_dir):
    rows = observations(spark, sf_dir).select(F.col("video").cast("string").alias("video_id"), F.col("day").alias("ts"), F.col("label").alias("frame_path"))
    return layers.frames_by_video(rows).select("video_id", F.size("frames").cast("long").alias("n_frames"), F.element_at("frames", 1)["frame_path"].alias("first"), F.element_at("frames", -1)["frame_path"].alias("last"))


def ingest_totals(spark, sf_dir):
    rows = observations(spark, sf_dir).groupBy("video", "track", "day").agg(F.collect_list("event_id").alias("items"))
    return evaluate.ingest_totals(rows, "items", "video")


def event_id_migration(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.concat_ws(":", F.concat(F.lit("v"), "o_custkey"), F.lit("rule"), F.concat(F.lit("v"), "o_custkey"), F.col("o_orderkey").cast("string")).alias("event_id"))
    return sinks.migrated_event_ids(old)[1]


def source_map_upsert(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("video_name"), F.col("n_regionkey").cast("long").alias("source"))
    return sinks.latest(nation, nation.where("source = 2").withColumn("source", F.col("source") + 100), "video_name")


def segment_status(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    videos = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("video_id"))
    built = spans.where("event_type = 'view'").select("video_id")
    return segments.status(videos, spans, built)


def clip_checks(spark, sf_dir):
    rows = observations(spark, sf_dir).select("event_id", text.valid_clip("cy", F.col("cx")).alias("valid"), text.under_roots(F.concat(F.lit("/Data/"), "label", F.lit("/x.mp4")), ["/data/view", "/data/err"]).alias("allowed"))
    return rows


def best_of_each_video(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit(".mp4")).alias("video_name"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("mode"))
    return evaluate.best_per_video(rows, 5, ["mode"]).select("mode", "video_name", "score", "rank")


def first_relevant(spark, sf_dir):
    results, wanted = _results(spark, sf_dir)
    return evaluate.first_relevant(results, wanted)


def tracked_detections(spark, sf_dir):
    """Tracks of boxes made of all observations (sequential; no SQL, held to a plain run of the tracker on a small table)."""
    rows = adapters.boxed(observations(spark, sf_dir)).select(F.col("track").cast("string").alias("video_id"), F.lit("car").alias("label"), F.floor("t").cast("double").alias("t"), F.format_string("f_%012d.jpg", "event_id").alias("frame_path"), "box.*", F.lit(0.9).alias("conf"))
    return tracking.tracked(rows).groupBy("video_id").agg(F.count_distinct("track_id").alias("n_tracks"), F.count("*").alias("n_points"))


# ---- streams ---------------------------------------------------------------------------------------------------------


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = T.StructType([T.StructField(n, t) for n, t in (("event_id", T.LongType()), ("ts", T.TimestampNTZType()), ("user_id", T.LongType()), ("event_type", T.StringType()), ("value", T.DoubleType()), ("props", T.StringType()))])
    rows = streams.source(spark, sf_dir, schema, pattern="events.parquet")
    return rows.withColumn("at", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"))


def _once(stream: DataFrame, name: str) -> DataFrame:
    return streams.drained(stream, f"{name}_{id(stream)}")


def stream_tumbling(spark, sf_dir):
    """Six-hour windows that the watermark has closed."""
    rows = streams.tumbling(_event_stream(spark, sf_dir), "at", "6 hours", ["event_type"], "value")
    done = _once(rows, "tumbling")
    return done.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark, sf_dir):
    done = _once(streams.sessions(_event_stream(spark, sf_dir), "at", "6 hours", "user_id"), "sessions")
    return done.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "n")


def stream_red_phases(spark, sf_dir):
    """Red phases of every video that the watermark has closed."""
    rows = _event_stream(spark, sf_dir).withColumn("video", F.col("user_id") % 10).withColumn("state", F.when(F.col("event_type") == "error", F.lit("red")).otherwise("other"))
    done = _once(streams.red_phases(rows, "at", "2 hours", "video"), "red_phases")
    return done.select("video", F.unix_micros("phase_start").alias("phase_start"), F.unix_micros("phase_end").alias("phase_end"))


def stream_retained(spark, sf_dir):
    """Rows at most five after a purchase, kept by a state per video."""
    rows = _event_stream(spark, sf_dir).select((F.col("user_id") % 10).alias("video"), "event_id", (F.col("event_type") == "purchase").alias("hit"), "at")
    return _once(streams.retained(rows, "video", "event_id", "hit", "at", 5, idle="365 days"), "retained")


QUERIES = {
    f.__name__: f
    for f in (
        detection_topk, detection_relation_near, detection_relation_left_of, detection_relation_inside, detection_cooccurrence, trajectory_topk, track_summary,
        point_dedup, frame_rate_estimate, line_contact, line_contact_center_path, event_crosses_line, wrong_way, red_intervals, red_light_crossing, three_snapshots,
        frame_sessions, segments_events, segments_fallback, segments_all, retain_window, activity_filter, nearest_light, points_in_red, vector_topk, vector_variants,
        vector_normalised, vector_upsert_overwrite, vector_upsert_append, vector_remove, index_build, index_stats, text_contains_topk, text_fuzzy_topk, identifiers,
        display_times, frame_names, clip_urls, normal_labels, intent_events_batch, fuse_channels, hybrid_score, hybrid_topk, eval_precision_recall, eval_mrr_rollup,
        eval_event_boost, event_counts, event_topk, light_states, frames_by_video, ingest_totals, event_id_migration, source_map_upsert,
        segment_status, clip_checks, best_of_each_video, first_relevant, tracked_detections, stream_tumbling, stream_sessions, stream_red_phases, stream_retained,
    )
}

# ---- SQL -------------------------------------------------------------------------------------------------------------

_SPANS = f"""{OBS},
  g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600 THEN 0 ELSE 1 END AS opens FROM obs WINDOW w AS (PARTITION BY track ORDER BY t, event_id)),
  s AS (SELECT *, sum(opens) OVER (PARTITION BY track ORDER BY t, event_id) AS island FROM g),
  spans AS (SELECT track, island, min(t) AS start_ts, max(t) AS end_ts, min(event_id) AS first_id, max(label) AS event_type FROM s GROUP BY track, island)"""

PLACED = f"""{OBS},
  p AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY track) AS n, lag(cx) OVER w AS px, lag(cy) OVER w AS py,
               first_value(cx) OVER w AS fx, first_value(cy) OVER w AS fy,
               last_value(cx) OVER (PARTITION BY track ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lx,
               last_value(cy) OVER (PARTITION BY track ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ly
        FROM obs WINDOW w AS (PARTITION BY track ORDER BY t, event_id)),
  q AS (SELECT *, (cx - 5 - 1e-6 <= 100 AND cx + 5 + 1e-6 >= 100 AND cy - 5 - 1e-6 <= 99 AND cy + 5 + 1e-6 >= 0) AS bybox,
               coalesce(least(px, cx) <= 100 AND greatest(px, cx) >= 100
                 AND CASE WHEN px = cx THEN greatest(py, cy) >= 0 AND least(py, cy) <= 99
                          ELSE py + (100 - px) * (cy - py) / (cx - px) BETWEEN 0 AND 99 END, false) AS bypath FROM p),
  c AS (SELECT track, any_value(video) AS video, any_value(n) AS n, any_value(sqrt((lx - fx)^2 + (ly - fy)^2)) AS moved,
               min(i) FILTER (bybox) AS bi, min(t) FILTER (bybox) AS bt, min(i) FILTER (bypath AND i > 0) AS ci, min(t) FILTER (bypath AND i > 0) AS ct FROM q GROUP BY track),
  contact AS (SELECT track, video, n, coalesce(bi, ci) AS contact_i, CASE WHEN bi IS NOT NULL THEN bt ELSE ct END AS contact_t,
                     CASE WHEN bi IS NOT NULL THEN 'vehicle_bbox' ELSE 'trajectory_center' END AS mode
              FROM c WHERE n >= 2 AND moved >= 10 AND coalesce(bi, ci) IS NOT NULL)"""

_LIGHTS = """lights AS (SELECT video, t, CASE WHEN label = 'error' THEN 'red' ELSE 'green' END AS state, conf, event_id FROM obs WHERE label IN ('error', 'view')),
  rg AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 7200 THEN 0 ELSE 1 END AS opens FROM lights WHERE state = 'red' WINDOW w AS (PARTITION BY video ORDER BY t, event_id)),
  ri AS (SELECT *, sum(opens) OVER (PARTITION BY video ORDER BY t, event_id) AS island FROM rg),
  reds AS (SELECT video, min(t) AS phase_start, max(t) AS phase_end FROM ri GROUP BY video, island)"""

_RELATION = """SELECT event_id, track, day FROM obs p WHERE label = 'click' AND EXISTS (
    SELECT 1 FROM obs a JOIN obs b ON a.track = b.track AND a.day = b.day
    WHERE a.label = 'click' AND b.label = '{other}' AND a.track = p.track AND a.day = p.day AND {test})"""

_HITS = f"""{OBS},
  hits AS (SELECT CASE label WHEN 'view' THEN 'clip' WHEN 'click' THEN 'detection' WHEN 'purchase' THEN 'trajectory' WHEN 'error' THEN 'event' ELSE 'ocr' END AS channel,
                  CASE label WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS c,
                  CASE WHEN label = 'view' THEN conf * 0.5::DOUBLE ELSE conf END AS score, track, event_id, floor(t) AS a,
                  floor(t) + CASE WHEN label = 'error' THEN 10 ELSE 0 END AS b, CAST(floor(floor(t) / 86400) AS BIGINT) AS bucket FROM obs),
  fused AS (SELECT track || ':' || bucket AS key, min(a) AS start_ts, max(b) AS end_ts, min(a) AS ts, string_agg(DISTINCT channel, ',' ORDER BY channel) AS matched_by,
                   coalesce(max(score) FILTER (c = 0), 0) AS clip_score, coalesce(max(score) FILTER (c = 1), 0) AS detection_score,
                   coalesce(max(score) FILTER (c = 2), 0) AS trajectory_score, coalesce(max(score) FILTER (c = 3), 0) AS event_score,
                   coalesce(max(score) FILTER (c = 4), 0) AS ocr_score, CASE WHEN bool_or(c = 1) THEN 'car' ELSE '' END AS label,
                   CASE WHEN bool_or(c = 3) THEN 'red_light_violation' ELSE '' END AS event_type,
                   arg_min(event_id::VARCHAR, (c, -score, a, event_id::VARCHAR)) AS frame_id, track, bucket FROM hits GROUP BY track, bucket),
  norm AS (SELECT *, least(greatest(clip_score, 0) / 0.35::DOUBLE, 1) AS s0, least(detection_score, 1) AS s1, least(trajectory_score, 1) AS s2,
                  least(event_score, 1) AS s3, least(ocr_score, 1) AS s4 FROM fused),
  scored AS (SELECT *, least(least(0.35::DOUBLE * s0 + 0.10::DOUBLE * s1 + 0.10::DOUBLE * s2 + 0.35::DOUBLE * s3 + 0.10::DOUBLE * s4, 1)
      + least(greatest((s0 > 0)::INT + (s1 > 0)::INT + (s2 > 0)::INT + (s3 > 0)::INT + (s4 > 0)::INT - 1, 0) * 0.05::DOUBLE
              + CASE WHEN label = 'car' THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN event_type <> '' THEN 0.04::DOUBLE ELSE 0 END, 0.10::DOUBLE), 1) AS best_score FROM norm)"""

_RANKED = f"""{_SPANS},
  e AS (SELECT *, length(event_type) AS query_id, end_ts - start_ts AS raw FROM spans),
  one AS (SELECT *, round(raw, 3) AS score FROM e QUALIFY row_number() OVER (PARTITION BY query_id, track ORDER BY round(raw, 3) DESC, first_id) = 1),
  res AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, track::VARCHAR) AS rank FROM one QUALIFY rank <= 10)"""

_ALIASES = _sql_values([(w, e, EVENT_TIERS[t]) for e, tiers in EVENT_WORDS.items() for t, words in tiers.items() for w in words])
ORACLE_SQL = {
    "detection_topk": f"{WITH_OBS} SELECT event_id, track, label, round(conf, 6) AS conf FROM obs WHERE label IN ('click', 'view') ORDER BY obs.conf DESC, track, t, event_id LIMIT 50",
    "detection_relation_near": f"{WITH_OBS} " + _RELATION.format(other="error", test="(a.cx - b.cx)^2 + (a.cy - b.cy)^2 <= 625"),
    "detection_relation_left_of": f"{WITH_OBS} " + _RELATION.format(other="error", test="a.cx < b.cx"),
    "detection_relation_inside": f"{WITH_OBS} " + _RELATION.format(other="view", test="a.cx - 5 >= b.cx - 80 AND a.cx + 5 <= b.cx + 80 AND a.cy - 5 >= b.cy - 80 AND a.cy + 5 <= b.cy + 80"),
    "detection_cooccurrence": f"{WITH_OBS} " + _RELATION.format(other="error", test="true"),
    "track_summary": f"""{WITH_OBS_MORE}
        s AS (SELECT track, min(t) AS start_ts, max(t) AS end_ts, count(*) AS n_points, avg(conf) AS avg_conf, max(conf) AS max_conf,
                     arg_max(cx, (t, event_id)) - arg_min(cx, (t, event_id)) AS dx, arg_max(cy, (t, event_id)) - arg_min(cy, (t, event_id)) AS dy,
                     arg_min(event_id, (-conf, t, event_id)) AS best_point FROM obs GROUP BY track)
        SELECT track, start_ts, end_ts, n_points, round(avg_conf, 6) AS avg_conf, max_conf, round(dx, 6) AS dx, round(dy, 6) AS dy,
               CASE WHEN n_points < 2 THEN 'unknown' WHEN abs(s.dx) < 20 AND abs(s.dy) < 20 THEN 'stationary'
                    WHEN abs(s.dx) >= abs(s.dy) THEN CASE WHEN s.dx > 0 THEN 'left_to_right' ELSE 'right_to_left' END
                    ELSE CASE WHEN s.dy > 0 THEN 'top_to_bottom' ELSE 'bottom_to_top' END END AS direction, best_point FROM s""",
    "trajectory_topk": f"""{WITH_OBS_MORE}
        s AS (SELECT track, round(avg(conf), 6) AS avg_conf, max(t) - min(t) AS duration, count(*) AS n,
                     arg_max(cx, (t, event_id)) - arg_min(cx, (t, event_id)) AS dx, arg_max(cy, (t, event_id)) - arg_min(cy, (t, event_id)) AS dy FROM obs GROUP BY track)
        SELECT track, avg_conf, duration, 'left_to_right' AS direction FROM s
        WHERE n >= 2 AND dx > 0 AND abs(dx) >= abs(dy) AND NOT (abs(dx) < 20 AND abs(dy) < 20) AND duration >= 86400 ORDER BY avg_conf DESC, duration DESC, track LIMIT 25""",
    "point_dedup": f"""{WITH_OBS_MORE} b AS (SELECT *, floor(cx / 50) AS bucket FROM obs)
        SELECT event_id, track, label FROM b WINDOW w AS (PARTITION BY track ORDER BY t, event_id)
        QUALIFY row_number() OVER w = 1 OR label IS DISTINCT FROM lag(label) OVER w OR bucket IS DISTINCT FROM lag(bucket) OVER w""",
    "frame_rate_estimate": f"""{WITH_OBS_MORE} d AS (SELECT DISTINCT video, t FROM obs),
        s AS (SELECT video, t - lag(t) OVER (PARTITION BY video ORDER BY t) AS step FROM d),
        m AS (SELECT video, list_sort(list(step))[len(list(step)) // 2 + 1] AS median_step FROM s WHERE step > 0 GROUP BY video)
        SELECT video, round(median_step, 6) AS median_step, greatest(round_even(1 / m.median_step, 0), 1) AS rate FROM m""",
    "line_contact": f"WITH {PLACED} SELECT video::VARCHAR AS video_id, track::VARCHAR AS track_id, contact_i, contact_t, mode FROM contact",
    "line_contact_center_path": f"""WITH {PLACED} SELECT video::VARCHAR AS video_id, track::VARCHAR AS track_id, ci AS contact_i, ct AS contact_t, 'trajectory_center' AS mode
        FROM c WHERE n >= 2 AND moved >= 10 AND ci IS NOT NULL""",
    "event_crosses_line": f"""WITH {PLACED},
        s AS (SELECT track, min(t) AS start_ts, max(t) AS end_ts, avg(conf) AS avg_conf FROM obs GROUP BY track),
        ev AS (SELECT p.track, string_agg('f_' || lpad(event_id::VARCHAR, 12, '0') || '.jpg', ',' ORDER BY p.i) AS evidence
               FROM p JOIN contact USING (track) WHERE p.i BETWEEN contact_i - 1 AND contact_i + 1 GROUP BY p.track)
        SELECT video || ':vehicle_crosses_line:' || track AS event_id, 'vehicle_crosses_line' AS event_type, start_ts, end_ts,
               round(least(avg_conf, 1), 6) AS confidence, contact_t AS cross_ts, mode, evidence FROM contact JOIN s USING (track) JOIN ev USING (track)""",
    "wrong_way": f"""WITH {PLACED},
        ix AS (SELECT *, round_even((n - 1) * 0.25, 0) AS lo, round_even((n - 1) * 0.75, 0) AS hi FROM p),
        jx AS (SELECT *, CASE WHEN hi <= lo THEN least(lo + 1, n - 1) ELSE hi END AS h2 FROM ix WHERE n >= 3),
        ab AS (SELECT track, any_value(video) AS video, max(cx) FILTER (i = lo) AS ax, max(cy) FILTER (i = lo) AS ay, max(cx) FILTER (i = h2) AS bx, max(cy) FILTER (i = h2) AS yb,
                      any_value(lx - fx) AS dx, any_value(ly - fy) AS dy, min(t) AS start_ts, max(t) AS end_ts, avg(conf) AS avg_conf FROM jx GROUP BY track),
        u AS (SELECT *, CASE WHEN sqrt((bx - ax)^2 + (yb - ay)^2) > 1e-9 THEN (bx - ax) / sqrt((bx - ax)^2 + (yb - ay)^2)
                             WHEN sqrt(dx^2 + dy^2) > 1e-9 THEN dx / sqrt(dx^2 + dy^2) END AS d FROM ab
              WHERE end_ts - start_ts >= 1 AND sqrt(dx^2 + dy^2) >= 20)
        SELECT video || ':wrong_way_driving:' || track AS event_id, start_ts, end_ts, round(d, 6) AS dot,
               round(least(1, avg_conf * (1 + least(abs(d), 1)) / 2), 6) AS confidence FROM u WHERE d <= -0.3""",
    "red_intervals": f"{WITH_OBS_MORE} {_LIGHTS} SELECT video::VARCHAR AS video_id, phase_start, phase_end FROM reds",
    "red_light_crossing": f"""WITH {PLACED}, {_LIGHTS},
        af AS (SELECT p.track, count(*) - 1 AS after, arg_min(cx, i) AS ax, arg_min(cy, i) AS ay, arg_max(cx, i) AS bx, arg_max(cy, i) AS yb
               FROM p JOIN contact USING (track) WHERE i >= contact_i GROUP BY p.track),
        ok AS (SELECT contact.* FROM contact JOIN af USING (track) WHERE after >= 2 AND sqrt((bx - ax)^2 + (yb - ay)^2) >= 15),
        ls AS (SELECT ok.*, l.state, l.conf AS lconf FROM ok JOIN lights l ON l.video = ok.video AND abs(l.t - contact_t) <= 7200
               QUALIFY row_number() OVER (PARTITION BY ok.track ORDER BY abs(l.t - contact_t), -l.conf, l.event_id) = 1),
        inr AS (SELECT * FROM ls WHERE state = 'red' AND EXISTS (SELECT 1 FROM reds WHERE reds.video = ls.video AND phase_start <= contact_t
                AND contact_t <= phase_end + 1e-6 AND phase_end - phase_start >= 1800)),
        s AS (SELECT track, min(t) AS a, max(t) AS b, avg(conf) AS avg_conf FROM obs GROUP BY track)
        SELECT video || ':red_light_violation:' || track AS event_id, greatest(contact_t - 1, a) AS start_ts, least(contact_t + 1, b) AS end_ts, contact_t AS cross_ts,
               round(least(1, avg_conf * 0.6::DOUBLE + lconf * 0.4::DOUBLE), 6) AS confidence, round(lconf, 6) AS light_conf FROM inr JOIN s USING (track)""",
    "frame_sessions": f"WITH {_SPANS} SELECT track, start_ts AS start_time, end_ts AS end_time, n AS n_frames FROM spans JOIN (SELECT track, island, count(*) AS n FROM s GROUP BY track, island) USING (track, island)",
    "segments_events": f"""WITH {_SPANS}, v AS (SELECT (track % 10)::VARCHAR AS video_id, * FROM spans),
        o AS (SELECT *, CASE WHEN start_ts <= max(end_ts) OVER (PARTITION BY video_id ORDER BY start_ts, end_ts, first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-6
              THEN 0 ELSE 1 END AS opens FROM v),
        i AS (SELECT * EXCLUDE (island), sum(opens) OVER (PARTITION BY video_id ORDER BY start_ts, end_ts, first_id) AS island FROM o)
        SELECT video_id, island::BIGINT AS island, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n_events FROM i GROUP BY video_id, island""",
    "segments_fallback": f"""WITH {_SPANS},
        f AS (SELECT track, start_ts, greatest(0, coalesce(max(end_ts) OVER (PARTITION BY track ORDER BY start_ts, end_ts, first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS base FROM spans),
        n AS (SELECT track, base, floor((start_ts - base + 1e-6) / 86400)::BIGINT AS n FROM f),
        w AS (SELECT track, base + k * 86400 AS a, base + (k + 1) * 86400 AS b FROM n, unnest(range(n)) AS u(k) WHERE n >= 1)
        SELECT track::VARCHAR AS video_id, count(*) AS n_windows, round(min(a), 4) AS first_start, round(max(b), 4) AS last_end FROM w GROUP BY track""",
    "segments_all": f"""WITH {_SPANS},
        o AS (SELECT *, CASE WHEN start_ts <= max(end_ts) OVER (PARTITION BY track ORDER BY start_ts, end_ts, first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-6
              THEN 0 ELSE 1 END AS opens FROM spans),
        i AS (SELECT *, sum(opens) OVER (PARTITION BY track ORDER BY start_ts, end_ts, first_id) AS grp FROM o)
        SELECT track::VARCHAR AS video_id, round(round(min(start_ts), 2), 1) AS start_ts, round(round(max(end_ts), 2), 1) AS end_ts, count(*) AS n_events FROM i GROUP BY track, grp""",
    "retain_window": f"""{WITH_OBS_MORE} n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY event_id) AS n FROM obs),
        h AS (SELECT *, last_value(CASE WHEN label = 'purchase' THEN n END IGNORE NULLS) OVER (PARTITION BY video ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS hit FROM n)
        SELECT event_id, video, label FROM h WHERE n - hit <= 5""",
    "activity_filter": f"""{WITH_OBS_MORE} n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY event_id) AS n FROM obs),
        h AS (SELECT *, last_value(CASE WHEN label = 'click' AND (n - 1) % 30 = 0 THEN n END IGNORE NULLS) OVER (PARTITION BY video ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS hit FROM n)
        SELECT event_id, video FROM h WHERE n - hit <= 60""",
    "nearest_light": f"""{WITH_OBS_MORE} {_LIGHTS}
        SELECT p.event_id, l.state AS state_state, l.t AS state_at FROM obs p JOIN lights l ON l.video = p.video AND abs(l.t - p.t) <= 7200
        WHERE p.label = 'purchase' QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY abs(l.t - p.t), -l.conf, l.event_id) = 1""",
    "points_in_red": f"""{WITH_OBS_MORE} {_LIGHTS}
        SELECT event_id, video::VARCHAR AS video_id FROM obs WHERE EXISTS (SELECT 1 FROM reds WHERE reds.video = obs.video AND phase_start <= t AND t <= phase_end + 1e-6)""",
    "vector_topk": """SELECT e.vec_id, e.label, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 20""",
    "vector_variants": """WITH q AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id IN (0, 1, 2)),
        s AS (SELECT qid, e.vec_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS score FROM embeddings e, q),
        t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 30),
        m AS (SELECT vec_id, max(score) AS score FROM t GROUP BY vec_id)
        SELECT vec_id, round(score, 4) AS score FROM m ORDER BY m.score DESC, vec_id LIMIT 30""",
    "vector_normalised": """SELECT vec_id, round(CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 THEN 0 ELSE 1 END::DOUBLE, 4) AS norm,
        round(embedding[2] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 3) AS second FROM embeddings""",
    "vector_upsert_overwrite": """SELECT vec_id, label AS video_id, round(embedding[1]::DOUBLE, 4) AS first FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings WHERE label IN (1, 2) AND vec_id % 2 = 0)
        UNION ALL SELECT vec_id + 1000000, label, round(embedding[-1]::DOUBLE, 4) FROM embeddings WHERE label IN (1, 2) AND vec_id % 2 = 0""",
    "vector_upsert_append": """SELECT vec_id, label AS video_id, round(embedding[1]::DOUBLE, 4) AS first FROM embeddings
        UNION ALL SELECT vec_id + 1000000, label, round(embedding[-1]::DOUBLE, 4) FROM embeddings WHERE label IN (1, 2) AND vec_id % 2 = 0""",
    "vector_remove": "SELECT vec_id, label AS video_id, round(embedding[1]::DOUBLE, 4) AS first FROM embeddings WHERE label <> 3",
    "index_build": "SELECT min(vec_id) AS vec_id, 'k' || (vec_id % 97) AS frame_id FROM embeddings GROUP BY vec_id % 97",
    "index_stats": "SELECT count(*) AS n_vectors, count(DISTINCT label) AS n_videos FROM embeddings",
    "text_contains_topk": r"""SELECT conv_id, turn, role, length(text)::INT AS size FROM conversations WHERE contains(regexp_replace(lower(text), '\s+', '', 'g'), 'theof')
        ORDER BY length(text) DESC, conv_id, turn, text LIMIT 30""",
    "display_times": f"""{WITH_OBS_MORE} w AS (SELECT event_id, floor(t)::BIGINT AS s FROM obs)
        SELECT event_id, CASE WHEN s >= 3600 THEN lpad((s // 3600)::VARCHAR, greatest(2, length((s // 3600)::VARCHAR))::INT, '0') || ':' ELSE '' END
               || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS shown FROM w""",
    "identifiers": r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages),
        s AS (SELECT *, CASE WHEN length(base) > 1 AND strpos(substr(base, 2), '.') > 0 THEN regexp_replace(base, '^(.+)\.[^.]*$', '\1') ELSE base END AS stem FROM p),
        f AS (SELECT *, regexp_replace(regexp_replace(stem, '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM s)
        SELECT page_id, CASE WHEN safe = '' THEN 'video' ELSE safe END || '_' || substr(sha1(lower(url)), 1, 10) AS asset,
               sha1(lower(url) || '_' || round_even(page_id / 7 * 1000, 0)::BIGINT) AS frame, lower(stem) AS stem FROM f""",
    "frame_names": f"""{WITH_OBS} SELECT event_id, 'cam ' || video AS name, round(cx, 2) AS seconds, 'cam_' || video || '_' || replace(printf('%.2f', round(cx, 2)), '.', '_') || '_1.50.jpg' AS safe FROM obs""",
    "clip_urls": "SELECT page_id, '%2Fv%201%2F' || page_id || '%C3%A9%26.mp4' AS encoded FROM pages",
    "normal_labels": r"""SELECT p_partkey, regexp_replace(lower(trim(p_name)), '\s+', ' ', 'g') || ' x' AS label, replace(regexp_replace(lower(trim(p_type)), '\s+', ' ', 'g'), ' ', '_') AS event_type,
        regexp_replace(lower(trim(p_type)), '\s+', ' ', 'g') AS entity, regexp_replace(lower(p_name), '\s+', '', 'g') AS text,
        CASE WHEN p_partkey % 2 = 0 THEN 'left_to_right' ELSE '' END AS direction FROM part""",
    "intent_events_batch": f"""WITH a(alias, event_type, confidence) AS (VALUES {_ALIASES}), q(query_id, query) AS (VALUES {_sql_values(list(enumerate(QUERIES_TEXT)))})
        SELECT query_id::BIGINT AS query_id, event_type, max(confidence)::DOUBLE AS confidence FROM q JOIN a ON contains(query, alias) GROUP BY query_id, event_type""",
    "fuse_channels": f"""WITH {_HITS} SELECT key, start_ts, end_ts, matched_by, round(clip_score, 6) AS clip_score, round(detection_score, 6) AS detection_score,
        round(trajectory_score, 6) AS trajectory_score, round(event_score, 6) AS event_score, round(ocr_score, 6) AS ocr_score, label, event_type, frame_id FROM fused""",
    "hybrid_score": f"WITH {_HITS} SELECT key, round(best_score, 6) AS best_score FROM scored",
    "hybrid_topk": f"""WITH {_HITS}, r AS (SELECT key, round(best_score, 6) AS best_score, start_ts, CASE WHEN end_ts <= start_ts THEN start_ts + 1 ELSE end_ts END AS end_ts, matched_by, track FROM scored)
        SELECT key, best_score, start_ts, end_ts, matched_by FROM r WHERE best_score >= 0.2 ORDER BY best_score DESC, track::VARCHAR, start_ts, key LIMIT 40""",
    "eval_precision_recall": f"""WITH {_RANKED},
        met AS (SELECT r.query_id, r.track, min(x.first_id) AS number FROM res r JOIN e x ON x.query_id = r.query_id AND x.track = r.track AND x.track % 3 = 0
                AND greatest(r.start_ts, x.start_ts) <= least(r.end_ts, x.end_ts) GROUP BY r.query_id, r.track),
        m AS (SELECT query_id, count(*) AS hits, count(DISTINCT number) AS matched FROM met GROUP BY query_id),
        w AS (SELECT query_id, count(*) AS expected FROM e WHERE track % 3 = 0 GROUP BY query_id),
        q AS (SELECT DISTINCT query_id FROM e)
        SELECT query_id::INT AS query_id, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / 10, 6) AS precision_at_k,
               round(CASE WHEN expected > 0 THEN coalesce(matched, 0) / expected ELSE 0 END, 6) AS recall FROM q LEFT JOIN m USING (query_id) LEFT JOIN w USING (query_id)""",
    "eval_mrr_rollup": """WITH r AS (SELECT o_orderpriority AS category, o_orderstatus AS subcategory, o_orderkey % 8 AS first_rank FROM orders)
        SELECT category, subcategory, count(*) AS n, round(avg((first_rank = 1)::INT), 4) AS recall_at_1, round(avg((first_rank BETWEEN 1 AND 5)::INT), 4) AS recall_at_5,
               round(avg(CASE WHEN first_rank > 0 THEN 1.0::DOUBLE / first_rank ELSE 0 END), 4) AS mrr FROM r GROUP BY ROLLUP (category, subcategory)""",
    "eval_event_boost": """WITH c AS (SELECT s_suppkey::VARCHAR AS s, s_acctbal / 20000 AS score FROM supplier),
        e AS (SELECT c_custkey::VARCHAR AS s, abs(c_acctbal) / 10000 AS conf FROM customer WHERE c_nationkey < 5)
        SELECT c.s || '.mp4' AS video_name, round(CASE WHEN coalesce(conf, 0) > 0 THEN greatest(score + 0.15::DOUBLE * conf, 0.6::DOUBLE * conf) ELSE score END, 6) AS score,
               round(coalesce(conf, 0), 6) AS event_confidence FROM c LEFT JOIN e USING (s)
        UNION ALL SELECT s || '.AVI', round(greatest(0.35::DOUBLE + 0.15::DOUBLE * conf, 0.6::DOUBLE * conf), 6), round(conf, 6) FROM e WHERE s NOT IN (SELECT s FROM c)""",
    "event_counts": f"{WITH_OBS} SELECT video AS video_id, count(*) AS n_events, string_agg(DISTINCT label, ',' ORDER BY label) AS event_types FROM obs GROUP BY video",
    "event_topk": f"{WITH_OBS} SELECT event_id, label, round(conf, 6) AS conf FROM obs WHERE label IN ('error', 'purchase') ORDER BY obs.conf DESC, track, t, label, event_id LIMIT 40",
    "light_states": """WITH r AS (SELECT l_orderkey, l_linenumber, l_tax * 2 * (0.5 + 0.5 * greatest(0, 1 - 2 * abs(l_quantity / 50 - 0))) AS red,
          l_discount * (0.5 + 0.5 * greatest(0, 1 - 2 * abs(l_discount * 10 - 0.5))) AS yellow,
          l_quantity / 500 * (0.5 + 0.5 * greatest(0, 1 - 2 * abs(1 - l_quantity / 50 - 1))) AS green FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN red >= yellow AND red >= green THEN 'red' WHEN yellow >= green THEN 'yellow' ELSE 'green' END AS state,
               round(least(sqrt(greatest(red, yellow, green)) * 1.4, 1), 6) AS conf FROM r WHERE greatest(red, yellow, green) >= 0.01""",
    "stream_tumbling": """WITH m AS (SELECT max(epoch_us(ts)) - 10000000 AS mark FROM events),
        w AS (SELECT epoch_us(ts) // 21600000000 * 21600 AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
        SELECT window_start::BIGINT AS window_start, event_type, n, total FROM w, m WHERE (window_start + 21600) * 1000000 <= mark""",
    "stream_sessions": """WITH m AS (SELECT max(epoch_us(ts)) - 10000000 AS mark FROM events),
        g AS (SELECT user_id, epoch_us(ts) AS u, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 21600000000 THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY u ROWS UNBOUNDED PRECEDING) AS island FROM g)
        SELECT user_id, min(u) AS start, max(u) AS last, count(*) AS n FROM i, m GROUP BY user_id, island, mark HAVING max(u) + 21600000000 <= mark""",
    "first_relevant": f"""WITH {_RANKED},
        h AS (SELECT query_id, min(rank) AS r FROM res WHERE track % 3 = 0 AND EXISTS (SELECT 1 FROM e WHERE e.query_id = res.query_id AND e.track = res.track) GROUP BY query_id)
        SELECT DISTINCT e.query_id::INT AS query_id, coalesce(r, 0)::INT AS first_rank, coalesce(r, 0) = 1 AS hit_at_1, coalesce(r, 0) BETWEEN 1 AND 5 AS hit_at_5 FROM e LEFT JOIN h USING (query_id)""",
    "three_snapshots": f"""WITH {OBS},
        p AS (SELECT *, row_number() OVER w - 1 AS i, lag(cx) OVER w AS px, lag(cy) OVER w AS py, count(*) OVER (PARTITION BY track) AS n FROM obs WINDOW w AS (PARTITION BY track ORDER BY t, event_id)),
        q AS (SELECT *, cx + 5 + 1e-6 >= 100 AND cx - 5 - 1e-6 <= 400 AND cy - 5 - 1e-6 <= 50 AND cy + 5 + 1e-6 >= 50 AS bybox,
                     coalesce(least(py, cy) <= 50 AND greatest(py, cy) >= 50 AND CASE WHEN py = cy THEN greatest(px, cx) >= 100 AND least(px, cx) <= 400
                       ELSE px + (50 - py) * (cx - px) / (cy - py) BETWEEN 100 AND 400 END, false) AND i > 0 AS bypath FROM p),
        c AS (SELECT track, any_value(video) AS video, any_value(n) AS n, arg_min(cx, i) AS ax, arg_min(cy, i) AS ay, arg_max(cx, i) AS bx, arg_max(cy, i) AS yb,
                     coalesce(min(i) FILTER (bybox), min(i) FILTER (bypath)) AS contact_i FROM q GROUP BY track),
        k AS (SELECT c.*, p.t AS contact_t FROM c JOIN p ON p.track = c.track AND p.i = contact_i WHERE c.n >= 2 AND sqrt((bx - ax)^2 + (yb - ay)^2) >= 10),
        d AS (SELECT p.*, contact_i, contact_t, k.n AS kn, sqrt((cx - greatest(100, least(400, cx)))^2 + (cy - 50)^2) AS gap FROM p JOIN k USING (track)),
        s AS (SELECT track, any_value(video) AS video, arg_min(event_id, (gap, i)) FILTER (gap > 5 AND cy < 50 AND t <= contact_t) AS b, arg_min(event_id, (gap, i)) FILTER (gap <= 5) AS a,
                     arg_min(event_id, (gap, i)) FILTER (gap > 5 AND cy > 50 AND t >= contact_t) AS f,
                     list(event_id ORDER BY event_id) FILTER (i BETWEEN contact_i - 1 AND contact_i + 1) AS ev FROM d GROUP BY track),
        u AS (SELECT track, video, ev, coalesce(b, ev[1]) AS x, coalesce(a, ev[len(ev) // 2 + 1]) AS y, coalesce(f, ev[len(ev)]) AS z FROM s)
        SELECT video || ':vehicle_crosses_line:' || track AS event_id, least(greatest(3, len(list_distinct([x, y, z]))), len(list_distinct(list_concat([x, y, z], ev))))::BIGINT AS n_snapshots,
               'f_' || lpad(x::VARCHAR, 12, '0') || '.jpg' AS before FROM u""",
    "frames_by_video": f"""{WITH_OBS_MORE} d AS (SELECT DISTINCT video, day, label FROM obs)
        SELECT video::VARCHAR AS video_id, count(*) AS n_frames, arg_min(label, (day, label)) AS first, arg_max(label, (day, label)) AS last FROM d GROUP BY video""",
    "ingest_totals": f"{WITH_OBS} SELECT count(DISTINCT video) AS n_videos, count(*) AS n_items FROM obs",
    "event_id_migration": "SELECT 'v' || o_custkey || ':rule:v' || o_custkey || ':' || o_orderkey AS old, 'v' || o_custkey || ':rule:' || o_orderkey AS new FROM orders",
    "source_map_upsert": "SELECT n_name AS video_name, CASE WHEN n_regionkey = 2 THEN 102 ELSE n_regionkey END::BIGINT AS source FROM nation",
    "segment_status": f"""WITH {_SPANS}, b AS (SELECT track, bool_or(event_type = 'view') AS built FROM spans GROUP BY track)
        SELECT DISTINCT c_custkey::VARCHAR AS video_id, CASE WHEN track IS NULL THEN 'no_events' WHEN NOT built THEN 'empty_segments' ELSE 'built' END AS status FROM customer LEFT JOIN b ON track = c_custkey""",
    "clip_checks": f"{WITH_OBS} SELECT event_id, cy >= 0 AND cx > cy AND cx - cy <= 60 AS valid, label = 'view' AS allowed FROM obs",
    "best_of_each_video": """WITH b AS (SELECT o_orderstatus AS mode, o_custkey || '.mp4' AS video_name, max(o_totalprice) AS score FROM orders GROUP BY o_orderstatus, o_custkey)
        SELECT mode, video_name, score, row_number() OVER (PARTITION BY mode ORDER BY score DESC, replace(video_name, '.mp4', '')) AS rank FROM b QUALIFY rank <= 5""",
    "stream_red_phases": """WITH m AS (SELECT max(epoch_us(ts)) - 10000000 AS mark FROM events WHERE event_type = 'error'),
        r AS (SELECT user_id % 10 AS video, epoch_us(ts) AS u FROM events WHERE event_type = 'error'),
        g AS (SELECT video, u, CASE WHEN u - lag(u) OVER (PARTITION BY video ORDER BY u) <= 7200000000 THEN 0 ELSE 1 END AS opens FROM r),
        i AS (SELECT *, sum(opens) OVER (PARTITION BY video ORDER BY u ROWS UNBOUNDED PRECEDING) AS island FROM g)
        SELECT video, min(u) AS phase_start, max(u) AS phase_end FROM i, m GROUP BY video, island, mark HAVING max(u) + 7200000000 <= mark""",
    "stream_retained": """WITH m AS (SELECT epoch_ms(max(ts)) - 10000 AS mark FROM events), n AS (SELECT event_id, ts, user_id % 10 AS video, event_type, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS n FROM events),
        h AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN n END IGNORE NULLS) OVER (PARTITION BY video ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS hit FROM n)
        SELECT video, event_id FROM h, m WHERE n - hit <= 5 AND epoch_ms(ts) < mark""",
}
