"""Intent goldens, layer scans, channels and hybrid search over JSON layers, ingest, streams."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import channels, intervals, tracking
from tracelake.plans import hybrid, ingest, intent
from tracelake.sources import files, layers, schemas, sinks
from tracelake.streaming import streams


@pytest.mark.parametrize(
    "query,kind,primary,context,more",
    [
        ("从左到右的行人", "motion", ("person",), (), {"directions": ("left_to_right",)}),
        ("红绿灯附近的车", "relational", ("car",), ("traffic_light",), {"relations": ("near",)}),
        ("路口左转的货车", "composite", ("truck",), ("intersection",), {"motions": ("turn_left",)}),
        ("红灯时穿过停止线的汽车", "event", ("car",), ("traffic_light", "stop_line"), {"relations": ("cross",)}),
        ("靠近停止线的车辆", "relational", ("car", "truck", "bus", "motorcycle"), ("stop_line",), {"relations": ("near",)}),
        ("", "general", (), (), {}),
        ("长时间", "attribute", (), (), {"attributes": {"duration": "long"}}),
        ("vehicle_crosses_line", "event", ("car", "truck", "bus", "motorcycle"), (), {"events": ("vehicle_crosses_line",), "event_confidence": 0.5}),
    ],
)
def test_intents(query, kind, primary, context, more):
    found = intent.parse(query)
    assert (found.query_type, found.primary, found.context) == (kind, primary, context)
    for name, want in more.items():
        assert getattr(found, name) == want


def test_rewrites_weights_routes():
    assert intent.rewrite("白色汽车") == ("white car", "white sedan", "white vehicle", "car")
    assert intent.rewrite(" red car ") == ("red car",) and intent.rewrite(" ") == ()
    assert "红灯" in intent.parse("红灯的汽车", chinese=True).rewrites
    assert intent.event_types("wrong way driving") == ("wrong_way_driving",) and intent.event_types("odd thing") == ("odd_thing",)
    for query in ("逆行", "闯红灯的白色汽车", "开错方向的车", "红色汽车", "something"):
        assert sum(intent.channel_weights(intent.parse(query)).values()) == pytest.approx(1.0)
    assert intent.channel_weights(intent.parse("逆行"))["event"] == 0.65
    assert intent.route(intent.parse("闯红灯"))["route"] == "event_primary" and intent.route(intent.parse("车辆违规"))["route"] == "vague_event"
    assert intent.best_event("压线行驶") == ("vehicle_crosses_line", 1.0) and intent.best_event("x") == ("", 0.0)


@pytest.fixture
def store(tmp_path):
    def put(layer, name, doc):
        folder = tmp_path / layer
        folder.mkdir(exist_ok=True)
        (folder / f"{name}.json").write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=1, ensure_ascii=False))
        return str(folder)

    return put


def detection_layer(store):
    light = {"label": "traffic light", "class": "traffic light", "confidence": 0.8, "bbox": [100, 100, 120, 140]}
    frames = [
        {"video_name": "v.mp4", "frame_path": "v_1.00.jpg", "timestamp": 1.0, "detections": [light, {"label": "car", "confidence": 0.9, "bbox": [110, 140, 180, 200], "class_id": 2}]},
        {"video_name": "v.mp4", "frame_path": "v_2.00.jpg", "timestamp": 2.0, "detections": [{"label": "car", "confidence": 0.95, "bbox": [600, 140, 680, 200]}]},
        {"video_name": "v.mp4", "frame_path": "v_3.00.jpg", "timestamp": 3.0, "detections": [{"class": "bus", "confidence": 0.7, "bbox": []}]},
    ]
    store("detections", "bad", '{"video_id": "x", "frames": [')
    return store("detections", "v", {"video_id": "v", "video_name": "v.mp4", "video_path": "/d/v.mp4", "frames": frames})


def test_detection_channel(spark, store):
    path = detection_layer(store)
    rows = layers.detections(layers.scan(spark, path, schemas.DETECTIONS)).drop("x")
    assert layers.bad_documents(spark, path, schemas.DETECTIONS).count() == 1
    found = channels.detection(rows, intent.parse("红绿灯附近的车"), 5).collect()
    assert [(r["ts"], r["label"], r["video_id"]) for r in found] == [(1.0, "car", "v")]
    assert [r["ts"] for r in channels.detection(rows, intent.parse("汽车"), 5).collect()] == [2.0, 1.0]
    assert channels.detection(rows, intent.parse("逆行"), 5).count() == 0
    bus = rows.where("ts = 3.0").first()
    assert bus["label"] == "" or bus["label"] == "bus"


def test_trajectory_event_and_text_channels(spark, store):
    def track(n, label, direction, conf):
        point = {"timestamp": 1.0, "frame_path": "f", "bbox": [0, 0, 2, 2], "center_x": 1, "center_y": 1, "confidence": conf}
        return {"track_id": f"video-1:{n}", "label": label, "start_ts": 1.0, "end_ts": 4.0, "duration_sec": 3.0, "avg_confidence": conf, "direction": direction, "representative_frame": "f", "points": [point]}

    path = store("tracks", "v", {"video_id": "video-1", "video_name": "v.mp4", "video_path": "p", "tracks": [track(1, "car", "left_to_right", 0.9), track(2, "person", "right_to_left", 0.8)]})
    rows = layers.tracks(layers.scan(spark, path, schemas.TRAJECTORIES))
    ask = lambda q, **o: [r["track_id"] for r in channels.trajectory(rows, intent.parse(q), 5, **o).collect()]
    assert ask("car") == ["video-1:1"] and ask("person", direction="right-to-left") == ["video-1:2"] and ask("person", direction="left_to_right") == []
    assert ask("汽车从左到右") == ["video-1:1"] and ask("car", direction="sideways") == ["video-1:1"] and ask("car", min_duration=9.0) == []
    assert layers.track_points(rows).count() == 2
    event = {"event_id": "v:wrong_way_driving:1", "event_type": "wrong_way_driving", "start_ts": 1.0, "end_ts": 2.0, "confidence": 0.7, "track_ids": ["v:1"], "key_snapshots": ["a"], "attributes": {"label": "car"}}
    rows = layers.events(layers.scan(spark, store("events", "v", {"video_id": "v", "video_name": "n", "video_path": "p", "events": [event]}), schemas.EVENTS))
    (found,) = channels.event(rows, "wrong way driving", 5).collect()
    assert (found["video_id"], found["label"], found["track_id"], found["snapshots"], found["video_name"]) == ("v", "car", "v:1", ["a"], "n")
    ocr = {"video_name": "N V", "frames": [{"frame_path": "f", "timestamp_sec": 2.0, "display_time": "00:02", "ocr_results": [{"text": "STOP Here", "score": 0.9, "bbox": [[0, 0], [1, 1]]}, {"text": None}, {"text": "zzz", "bbox": [[1]]}]}]}
    rows = layers.ocr_texts(layers.scan(spark, store("ocr", "v", ocr), schemas.OCR))
    assert rows.count() == 1
    assert [r["score"] for r in channels.ocr(rows, "stop  here", 5).collect()] == [1.0]
    assert channels.ocr(rows, "stophera", 5).first()["score"] > 0.8 and channels.ocr(rows, "qqqq", 5).count() == 0


def test_hybrid_search(spark, store):
    detections = layers.detections(layers.scan(spark, detection_layer(store), schemas.DETECTIONS))
    vectors = spark.createDataFrame([(0, "v", "frame", [1.0, 0.0], "v.mp4", "/d/v.mp4", "v_1.00.jpg", 1.0, "f1", None, None, None), (1, "w", "frame", [0.0, 1.0], "w.mp4", "/d/w.mp4", "w", 9.0, "f2", None, None, None)], schemas.VECTORS)
    tables = hybrid.Tables(detections=detections, vectors=vectors, encode=lambda text: [1.0, 0.0])
    rows = hybrid.search(spark, tables, "红绿灯附近的车", 5, files=spark.createDataFrame([("/d/v.mp4",)], "path string")).collect()
    assert rows[0]["video_id"] == "v" and rows[0]["matched_by"] == ["clip", "detection"] and rows[0]["clip_available"] and "download_clip" in rows[0]["clip_url"]
    assert hybrid.search(spark, hybrid.Tables(), "汽车", 5).collect() == []

    def fails(text):
        raise RuntimeError("no model")

    tables.encode = fails
    assert hybrid.search(spark, tables, "汽车", 5).count() > 0
    for query, k in (("", 5), ("x", 0), ("x", 201)):
        with pytest.raises(ValueError):
            hybrid.search(spark, tables, query, k)


def test_ingest_chain(spark):
    rows = [("v", "v.mp4", "/d/v.mp4", "car", float(t), f"v_{t:.2f}.jpg", 0.9, (90.0 - 12 * t, 10.0, 130.0 - 12 * t, 40.0)) for t in range(8)]
    df = spark.createDataFrame(rows, "video_id string, video_name string, video_path string, label string, ts double, frame_path string, confidence double, box struct<x1:double,y1:double,x2:double,y2:double>")
    lights = spark.createDataFrame([], "video_id string, t double, state string, conf double, frame_path string")
    out = ingest.run(spark, df, lights, {"wrong_way_driving": {"allowed_direction": [1, 0]}, "vehicle_crosses_line": {"line": [[60, 0], [60, 90]]}}, spark.createDataFrame([("v", 20.0)], "video_id string, duration double"))
    assert sorted(r["event_type"] for r in out["events"].collect()) == ["vehicle_crosses_line", "wrong_way_driving"]
    assert out["tracks"].first()["direction"] == "right_to_left"
    assert [(r["start_ts"], r["end_ts"]) for r in out["segments"].orderBy("segment_id").collect()] == [(0.0, 7.0), (7.0, 12.0), (12.0, 17.0)]
    assert out["status"].first()["status"] == "built"
    named = ingest.named_videos(df, spark.createDataFrame([("/src/V.AVI",)], "path string"))
    assert {(r["video_name"], r["video_path"]) for r in named.collect()} == {("V.AVI", "/src/V.AVI")}


def test_file_sources(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for name in ("a.MP4", "b.avi", "c.txt"):
        (tmp_path / "m" / name).write_bytes(b"x")
    assert {r["video_name"] for r in files.videos(spark, str(tmp_path / "m")).collect()} == {"a", "b"}
    seq = tmp_path / "s" / "Train" / "scene"
    seq.mkdir(parents=True)
    for i in range(7):
        (seq / f"img_{i + 1}.jpg").write_bytes(b"x")
    rows = files.image_sequences(spark, str(tmp_path / "s"), 15.0, step=3, first_index=1).orderBy("frame_index").collect()
    assert [(r["video_name"], r["frame_index"], r["ts"]) for r in rows] == [("scene", 0, 0.0), ("scene", 3, 0.2), ("scene", 6, 0.4)]
    assert files.sampling_step(25.0, 2.0) == 50 and files.sampling_step(25.0, 2.0, 3) == 3 and files.sampling_step(0.1, 0.1) == 1
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "x.txt").write_text("clear 1 car 2 bus 3.5 left front 77\nroad type: wet\nno pair\nweather: rain\n")
    (tmp_path / "meta" / "y.txt").write_text("too short\n")
    (meta,) = files.accident_meta(spark, str(tmp_path / "meta")).collect()
    assert meta["meta"]["weather"] == "rain" and meta["meta"]["road_type"] == "wet" and meta["meta"]["collision_frame"] == "77"
    (tmp_path / "n").mkdir()
    np.save(tmp_path / "n" / "v.npy", np.eye(3, dtype=np.float32))
    np.save(tmp_path / "n" / "w.npy", np.eye(2, dtype=np.float32))
    (tmp_path / "n" / "v.json").write_text(json.dumps([{"frame_id": f"f{i}"} for i in range(3)]))
    (tmp_path / "n" / "w.json").write_text(json.dumps([{"frame_id": "only"}]))
    rows = files.bundle_vectors(spark, str(tmp_path / "n"), "struct<frame_id:string>").orderBy("position").collect()
    assert [(r["bundle"], r["frame_id"], list(r["vec"])) for r in rows] == [("v", "f0", [1, 0, 0]), ("v", "f1", [0, 1, 0]), ("v", "f2", [0, 0, 1])]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "layer")
    make = lambda *rows: spark.createDataFrame(list(rows), "video_id string, x int")
    sinks.write_layer(make(("a", 1), ("b", 1)), path)
    sinks.write_layer(make(("a", 2)), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("video_id", "x").collect()) == [("a", 2), ("b", 1)]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_layer(make(("a", 3)), path, overwrite=False)
    assert sorted(map(tuple, sinks.latest(make(("a", 1), ("b", 1)), make(("b", 2), ("c", 3)), "video_id").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    events, mapping = sinks.migrated_event_ids(spark.createDataFrame([("v:t:v:1",), ("v:t:2",)], "event_id string"))
    assert sorted(r["event_id"] for r in events.collect()) == ["v:t:1", "v:t:2"] and [tuple(r) for r in mapping.collect()] == [("v:t:v:1", "v:t:1")]
    flags = sinks.mark_segments_built(spark.createDataFrame([("a", False), ("b", None)], "video_id string, segment_built boolean"), make(("a", 1)))
    assert {r["video_id"]: r["segment_built"] for r in flags.collect()} == {"a": True, "b": False}
    moved = sinks.remapped_paths(spark.createDataFrame([("/old/x.jpg",), ("/old/y.jpg",)], "frame_path string"), spark.createDataFrame([("/new/x.jpg",)], "path string"))
    assert sorted(r["frame_path"] for r in moved.collect()) == ["/new/x.jpg", "/old/y.jpg"]


def test_stream_twins(spark, tmp_path):
    rng = random.Random(9)
    rows = [("v" if i % 3 else "w", i, rng.random() < 0.1, i * 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "video_id string, i long, hit boolean, s double").withColumn("at", F.timestamp_seconds("s"))
    for part in range(2):
        df.where((F.col("i") < 100) if part == 0 else (F.col("i") >= 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.source(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    got = streams.drained(streams.retained(stream, "video_id", "i", "hit", "at", 5), "retained_twin")
    want = intervals.retained(df, "video_id", "i", F.col("hit"), 5).where("i < 189").select("video_id", "i")  # what the watermark has passed
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    reds = df.withColumn("state", F.when(F.col("hit"), F.lit("red")).otherwise(F.lit("green")))
    reds.coalesce(1).write.parquet(str(tmp_path / "red"))
    found = streams.drained(streams.red_phases(streams.source(spark, str(tmp_path / "red"), reds.schema), "at", "8 seconds", "video_id"), "red_twin")
    batch = intervals.phase_intervals(reds.where("hit").withColumn("t", F.col("s")), "video_id", "t", 8.0, "i")
    ends = {(r["video_id"], r["phase_start"], r["phase_end"]) for r in batch.collect()}
    assert found.count() and {(r["video_id"], r["phase_start"].timestamp(), r["phase_end"].timestamp()) for r in found.collect()} <= ends
    table_path = str(tmp_path / "table")
    write = streams.upsert_into(table_path)
    small = spark.createDataFrame([("a", 1)], "video_id string, x int")
    for epoch in (0, 0, 1):
        write(small, epoch)
    assert spark.read.parquet(table_path).count() == 1


def test_rows_out_of_order_over_several_triggers(spark, tmp_path):
    """Frames that come late, but before the watermark, are judged in their place; a quiet key begins anew."""
    order = [0, 1, 5, 3, 2, 4, 9, 7, 6, 8, 12, 10, 11, 13, 30, 31]
    rows = [("v", i, i in (2, 12), float(i)) for i in order] + [("z", 0, False, 500_000.0), ("v", 40, False, 400_000.0), ("v", 41, True, 400_001.0), ("z", 1, False, 900_000.0)]
    for n in range(0, len(rows), 4):
        part = spark.createDataFrame(rows[n : n + 4], "video_id string, i long, hit boolean, s double").withColumn("at", F.timestamp_seconds("s"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        schema = part.schema
    got = streams.drained(streams.retained(streams.source(spark, str(tmp_path / "in"), schema, 1), "video_id", "i", "hit", "at", 4), "late")
    assert sorted(r["i"] for r in got.collect()) == [2, 3, 4, 5, 6, 12, 13, 30, 31, 41]


def test_tracking_stream_twin(spark, tmp_path):
    rows = [(v, "car", float(t), f"f{t:02d}", 10.0 + 5 * t + off, 10.0, 50.0 + 5 * t + off, 50.0, 0.9) for v in "ab" for t in range(12) for off in (0.0, 300.0)]
    df = spark.createDataFrame(rows, "video_id string, label string, t double, frame_path string, x1 double, y1 double, x2 double, y2 double, conf double")
    end = spark.createDataFrame([("z", "car", 9000.0, "f", 0.0, 0.0, 9.0, 9.0, 0.9)], df.schema)
    late = (F.col("t") >= 6) | ((F.col("t") == 3) & (F.col("x1") > 200))  # half a frame comes in the next trigger
    for part, own in enumerate((df.where(~late), df.where(late).union(end))):
        own.withColumn("at", F.timestamp_seconds(F.col("t") + 1000)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = df.withColumn("at", F.timestamp_seconds(F.col("t") + 1000))
    got = streams.drained(streams.tracked(streams.source(spark, str(tmp_path / "in"), df.schema, 1), "at"), "tracked_twin")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tracking.tracked(df).collect()))
    assert {r["track_id"] for r in got.collect()} == {"a:1", "a:2", "b:1", "b:2"}
