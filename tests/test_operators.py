"""Interval, track and rule operators against plain Python statements of the rules, and hand-made goldens."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import evaluate, fusion, index, intervals, rules, segments, tracking, tracks
from tracelake.plans import intent


def spans(spark, rows):
    return spark.createDataFrame([("v", float(a), float(b), f"e{i:03d}") for i, (a, b) in enumerate(rows)], "video_id string, start_ts double, end_ts double, event_id string")


def test_merged_intervals(spark):
    rng = random.Random(4)
    rows = [(a := rng.randrange(0, 200), a + rng.randrange(0, 9)) for _ in range(60)]
    got = intervals.merged_intervals(spans(spark, rows), ["video_id"], "start_ts", "end_ts", "event_id")
    got = sorted((r["a"], r["b"]) for r in got.groupBy("island").agg(F.min("start_ts").alias("a"), F.max("end_ts").alias("b")).collect())
    want = []
    for a, b in sorted(rows):
        if want and a <= want[-1][1] + 1e-6:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    assert got == [tuple(map(float, w)) for w in want]


def windows_by_hand(rows, width, duration=None):
    cursor, out = 0.0, []
    for a, b in sorted(rows):
        while cursor + width <= a + 1e-6:
            out.append((cursor, cursor + width))
            cursor += width
        cursor = max(cursor, b)
    while duration is not None and cursor + width <= duration + 1e-6:
        out.append((cursor, cursor + width))
        cursor += width
    return sorted(out)


def test_gap_windows(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = [(a := rng.randrange(0, 300), a + rng.randrange(0, 40)) for _ in range(8)]
        df = spans(spark, rows)
        got = intervals.gap_windows(df, "video_id", "start_ts", "end_ts", "event_id").select("start_ts", "end_ts")
        tail = intervals.tail_windows(df, "video_id", "end_ts", spark.createDataFrame([("v", 400.0)], "video_id string, duration double"))
        assert sorted(map(tuple, got.collect())) == windows_by_hand(rows, 5.0)
        assert sorted(map(tuple, got.union(tail.select("start_ts", "end_ts")).collect())) == windows_by_hand(rows, 5.0, 400.0)


def test_segments_golden(spark):
    events = spans(spark, [(12.0, 15.6)]).selectExpr("*", "'t' as event_type", "'d' as description", "'v:1' as track_id", "array('a', 'b', 'a') as evidence")
    rows = segments.build(events).orderBy("segment_id").collect()
    assert [(r["segment_id"], r["start_ts"], r["end_ts"]) for r in rows] == [("v_seg001", 12.0, 15.6), ("v_seg002", 0.0, 5.0), ("v_seg003", 5.0, 10.0)]
    assert rows[0]["text"] == "d" and rows[0]["frame_paths"] == ["a", "b"] and rows[1]["text"] == "视频片段_v_0.0"
    short = segments.fallback_segments(events.where("false"), spark.createDataFrame([("s", 3.0)], "video_id string, duration double"))
    assert [(r["start_ts"], r["end_ts"]) for r in short.collect()] == [(0.0, 3.0)]
    frames = spark.createDataFrame([("v", float(t), f"f{t}") for t in range(12)], "video_id string, ts double, path string")
    got = {r["start_ts"]: r["frame_paths"] for r in segments.fallback_segments(events, frames=frames).collect()}
    assert got == {0.0: ["f0", "f1", "f2"], 5.0: ["f5", "f6", "f7"]}


def test_retained(spark):
    rng = random.Random(6)
    hits = [rng.random() < 0.1 for _ in range(300)]
    df = spark.createDataFrame([("v", i, h) for i, h in enumerate(hits)], "v string, i long, hit boolean")
    left, want = 0, []
    for i, h in enumerate(hits):
        left = 7 if h else left
        if left:
            want.append(i)
            left -= 0 if h else 1
    got = sorted(r["i"] for r in intervals.retained(df, "v", "i", F.col("hit"), 7).collect())
    assert got == [i for i in range(300) if any(hits[max(0, i - 7) : i + 1])]
    assert set(want) <= set(got)
    probed = intervals.activity_retained(df, "v", "i", F.col("hit"), 30, 60, available=False)
    assert sorted(r["i"] for r in probed.collect()) == list(range(0, 300, 30))


def test_as_of_and_intervals(spark):
    rng = random.Random(7)
    points = [(i, "ab"[i % 2], rng.randrange(0, 100) / 2) for i in range(80)]
    states = [("ab"[i % 2], rng.randrange(0, 100) / 2, rng.choice("rg"), rng.randrange(5) / 5, f"s{i:03d}") for i in range(60)]
    p = spark.createDataFrame(points, "id long, video_id string, t double")
    s = spark.createDataFrame(states, "video_id string, t double, state string, conf double, name string")
    got = {r["id"]: (r["state_at"], r["state_state"]) for r in intervals.nearest_state(p, "video_id", "t", "id", s, "t", [-F.col("conf"), F.col("name")], 1.5, ["state"]).collect()}
    want = {}
    for i, v, t in points:
        near = [(abs(x[1] - t), -x[3], x[4], x[1], x[2]) for x in states if x[0] == v and abs(x[1] - t) <= 1.5]
        if near:
            want[i] = min(near)[3:]
    assert got == want
    cover = spark.createDataFrame([("a", 3.0, 9.0), ("a", 20.0, 20.0), ("b", 0.0, 41.0)], "video_id string, s double, e double")
    inside = intervals.points_in_intervals(p, "video_id", "t", cover, "s", "e", 4.0)
    rule = {"a": [(3, 9), (20, 20)], "b": [(0, 41)]}
    assert {r["id"] for r in inside.collect()} == {i for i, v, t in points if any(a <= t <= b + 1e-6 for a, b in rule[v])}


POINT = "video_id string, track_id string, label string, t double, cx double, cy double, conf double, frame_path string, pid long"


def path(spark, places, label="car", half=1.0, box=True):
    rows = [("v", "v:1", label, float(t), float(x), float(y), 0.9, f"f_{t:.2f}.jpg", i) for i, (t, x, y) in enumerate(places)]
    df = spark.createDataFrame(rows, POINT)
    number = lambda e: F.expr(e) if box else F.lit(None).cast("double")
    return df.withColumn("box", F.struct(number(f"cx - {half}").alias("x1"), number(f"cy - {half}").alias("y1"), number(f"cx + {half}").alias("x2"), number(f"cy + {half}").alias("y2")))


def lights(spark, states):
    return spark.createDataFrame([("v", float(t), s, 0.8, f"l_{t:.2f}.jpg") for t, s in states], "video_id string, t double, state string, conf double, frame_path string")


@pytest.mark.parametrize(
    "places,line,config,mode",
    [
        ([(1, 0, 10), (2, 10, 10)], [[5, -2], [5, 2]], {}, None),
        ([(1, 5, 0), (2, 5, 0)], [[5, -2], [5, 2]], {"min_displacement_px": 0}, "vehicle_bbox"),
        ([(1, 0, 0), (2, 20, 0)], [[10, -5], [10, 5]], {}, "trajectory_center"),
        ([(1, 0, 0), (2, 4, 0)], [[2, -5], [2, 5]], {}, None),
    ],
)
def test_line_rule(spark, places, line, config, mode):
    found = rules.crosses_line(path(spark, places), lights(spark, [(0, "red")]), {"line": line, **config}).collect()
    assert [r["mode"] for r in found] == ([mode] if mode else [])


def test_box_contact_wins_over_an_earlier_crossing(spark):
    places = [(1, 0, 0), (2, 20, 0), (3, 10, 4)]
    (event,) = rules.crosses_line(path(spark, places), lights(spark, [(0, "red")]), {"line": [[10, -5], [10, 5]]}).collect()
    assert (event["mode"], event["cross_ts"], event["event_id"]) == ("vehicle_bbox", 3.0, "v:vehicle_crosses_line:1")


@pytest.mark.parametrize("xs,found", [((100, 70, 40), 1), ((40, 70, 100), 0)])
def test_wrong_way_rule(spark, xs, found):
    rows = rules.wrong_way(path(spark, [(t, x, 0) for t, x in enumerate(xs)]), lights(spark, [(0, "red")]), {"allowed_direction": [1, 0], "max_direction_dot": 0}).collect()
    assert len(rows) == found and all(r["score"] < 0 for r in rows)
    away = {"allowed_direction": [1, 0], "roi_polygon": [[500, 500], [600, 500], [600, 600]]}
    assert rules.wrong_way(path(spark, [(t, x, 0) for t, x in enumerate(xs)]), lights(spark, [(0, "red")]), away).count() == 0


GOES = [(1, 0, 0), (2, 5, 0), (3, 15, 0), (4, 25, 0), (5, 35, 0)]


@pytest.mark.parametrize(
    "places,states,found",
    [
        (GOES, [(1, "red"), (2, "red"), (3, "red"), (4, "red")], 1),
        (GOES, [(1, "green"), (2, "green"), (3, "green"), (4, "green")], 0),
        (GOES, [(2.9, "red")], 0),
        (GOES, [(1.5, "red"), (2, "red"), (2.5, "red"), (3, "red")], 1),
        ([(t, x, 0) for t, x in enumerate((0, 5, 10, 15, 16, 17))], [(0, "red"), (1, "red"), (2, "red"), (3, "red")], 0),
    ],
)
def test_red_light_rule(spark, places, states, found):
    rows = rules.red_light(path(spark, places, box=False), lights(spark, states), {"line": [[12.5, -5], [12.5, 5]]}).collect()
    assert len(rows) == found
    if rows:
        assert rows[0]["evidence"][0].startswith("l_") and rows[0]["confidence"] == pytest.approx(0.9 * 0.6 + 0.8 * 0.4)
        assert rows[0]["start_ts"] == 2.0 and rows[0]["end_ts"] == 4.0


def test_snapshots(spark):
    places = [(1, 0, 0), (2, 0, 30), (3, 0, 50), (4, 0, 70), (5, 0, 99)]
    (event,) = rules.crosses_line(path(spark, places, half=2), lights(spark, [(0, "red")]), {"line": [[-10, 50], [10, 50]]}).collect()
    assert event["snapshots"] == ["f_2.00.jpg", "f_3.00.jpg", "f_4.00.jpg"] and event["representative_frame"] == "f_2.00.jpg"


def test_runner_isolates_rules(spark):
    def broken(points, lights, config):
        raise RuntimeError("no plan")

    rules.register("broken", broken)
    try:
        out = rules.run(spark, path(spark, GOES), lights(spark, [(1, "red")]), {"vehicle_crosses_line": {"line": [[10, -5], [10, 5]]}}, ["broken", "unknown", "vehicle_crosses_line"])
        assert [r["event_type"] for r in out.collect()] == ["vehicle_crosses_line"]
    finally:
        rules._RULES.pop("broken")


def test_python_rule(spark):
    import pandas as pd

    def each(points, light, config):
        columns = [c.split()[0] for c in rules.EVENT_SCHEMA.split(", ")]
        return pd.DataFrame([{c: None for c in columns} | {"event_id": "e", "video_id": points["video_id"][0], "confidence": float(len(light))}], columns=columns)

    out = rules.python_rule(each)(path(spark, GOES), lights(spark, [(1, "red"), (2, "red")]), {}).collect()
    assert [(r["event_id"], r["confidence"]) for r in out] == [("e", 2.0)]


def test_light_scores(spark):
    rows = [(0.5, 0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.3, 1.0), (0.001, 0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.2, 0.5, 0.0, 0.0)]
    names = [f"{c}_{k} double" for c in ("red", "yellow", "green") for k in ("ratio", "centroid")]
    got = [(r["state"], round(r["conf"], 3)) for r in rules.light_scores(spark.createDataFrame(rows, ", ".join(names))).collect()]
    assert got == [("red", 0.99), ("green", 0.767), ("yellow", 0.626)]


def test_tracks_and_tracking(spark):
    rows = [("v", "car", float(t), f"f{t}", 10.0 + 40 * t, 10.0, 30.0 + 40 * t, 30.0, 0.9) for t in range(2)]
    df = spark.createDataFrame(rows + [("v", "car", 0.0, "f0", None, None, None, None, 0.9)], "video_id string, label string, t double, frame_path string, x1 double, y1 double, x2 double, y2 double, conf double")
    slow = [("w", "car", float(t), f"f{t}", 10.0 + 5 * t, 10.0, 50.0 + 5 * t, 50.0, 0.9) for t in range(6)] + [("w", "bus", float(t), f"f{t}", 300.0, 10.0, 350.0, 50.0, 0.8) for t in range(6)]
    out = tracking.tracked(df.union(spark.createDataFrame(slow, df.schema))).collect()
    assert {r["track_id"] for r in out if r["video_id"] == "w"} == {"w:1", "w:2"} and sum(r["video_id"] == "w" for r in out) == 12
    places = path(spark, [(1, 20, 0), (2, 60, 0)])
    summary = tracks.summaries(places, ["video_id", "track_id"], "t", "pid").first()
    assert summary["direction"] == "left_to_right" and summary["n_points"] == 2 and summary["duration"] == 1.0


def test_index_counts(spark):
    def vectors(video, n):
        return spark.createDataFrame([(f"{video}{i}", video) for i in range(n)], "id string, video_id string")

    table = vectors("v1", 3)
    table = index.upserted(table, vectors("v2", 2))
    assert table.count() == 5
    table = index.upserted(table, vectors("v1", 4))
    assert table.count() == 6
    assert index.removed(table, "v2").count() == 4 and index.upserted(table, vectors("v2", 2), overwrite=False).count() == 8
    rows = [("frame", [3.0, 4.0], "p", None, 1.234), ("frame", [1.0], "p", None, 1.0), ("segment", [1.0, 0.0], None, None, 1.0), ("frame", [float("nan"), 0.0], "p", None, 1.0)]
    df = spark.createDataFrame(rows, "kind string, vec array<float>, frame_path string, segment_id string, timestamp_seconds double").withColumn("start_ts", F.lit(1.0)).withColumn("end_ts", F.lit(2.0))
    good, bad = index.checked(df, 2)
    assert [r["timestamp_seconds"] for r in good.collect()] == [1.23] and sorted(r["reason"] for r in bad.collect()) == ["dimension", "no segment id", "not a number"]
    encoded = index.encoded(spark.createDataFrame([("ab",), ("c",)], "s string"), lambda texts: [[len(t), 0.0] for t in texts], "s", 2)
    assert [r["vec"] for r in encoded.collect()] == [[1.0, 0.0]] * 2


def hit(channel, score, video="v", start=10.0, end=10.0, **more):
    base = dict.fromkeys(["video_name", "video_path", "frame_id", "frame_path", "segment_id", "label", "direction", "event_type", "track_id", "event_id", "text"])
    return {"channel": channel, "score": score, "video_id": video, "start_ts": start, "end_ts": end, "ts": start, "snapshots": None, **base, **more}


def hits(spark, *rows):
    from tracelake.sources import schemas

    return spark.createDataFrame([tuple(r[f.name] for f in schemas.HIT.fields) for r in rows], schemas.HIT)


def test_fusion_golden(spark):
    found = hits(spark, hit("clip", 0.55), hit("detection", 0.72, label="car"), hit("trajectory", 0.81, end=15.0), hit("event", 0.88, event_type="e", snapshots=["a"]))
    (row,) = fusion.fuse(found).collect()
    assert (row["start_ts"], row["end_ts"], row["matched_by"]) == (10.0, 15.0, ["clip", "detection", "event", "trajectory"])
    assert row["snapshots"] == ["a"] and row["event_type"] == "e"
    sure = intent.parse("逆行")
    (scored,) = fusion.scored(fusion.fuse(hits(spark, hit("clip", 0.10), hit("event", 0.90))), sure).collect()
    assert scored["best_score"] > 0.5
    frames = hits(spark, *[hit("clip", s, start=t, end=t, frame_id=f"frame-{i}") for i, (t, s) in enumerate([(1.0, 0.31), (4.0, 0.45), (8.0, 0.5)], 1)])
    ranked = fusion.aggregate(fusion.fuse(frames).withColumn("best_score", F.col("clip_score")), 5).collect()
    assert [r["frame_id"] for r in ranked] == ["frame-3", "frame-2"]
    (point,) = fusion.aggregate(fusion.fuse(hits(spark, hit("clip", 0.5, start=22.8, end=22.8))).withColumn("best_score", F.lit(0.5)), 5).collect()
    assert point["end_ts"] == 23.8
    lowest = fusion.fuse(hits(spark, hit("clip", 0.5), hit("clip", 0.2)), last_clip=True).first()
    assert lowest["clip_score"] == 0.2


def test_ties_share_their_channels(spark):
    rows = fusion.fuse(hits(spark, hit("clip", 0.5, start=1.0, end=1.0), hit("event", 0.5, start=6.0, end=6.0)))
    same = rows.withColumn("best_score", F.lit(0.5)).withColumn("ts", F.lit(1.0))
    (one,) = fusion.aggregate(same, 5).collect()
    assert one["matched_by"] == ["clip", "event"]


def test_evaluation(spark):
    results = spark.createDataFrame([(1, 1, "a.avi", 0.0, 5.0), (1, 2, "a.mp4", 8.0, 9.0), (1, 3, "b.mp4", 0.0, 9.0), (2, 1, "c.mp4", 0.0, 1.0)], "query_id long, rank int, video_name string, start_ts double, end_ts double")
    expected = spark.createDataFrame([(1, 0, "A.MP4", 5.0, 6.0), (1, 1, "a.mp4", 8.5, 8.6), (1, 2, "z.mp4", 0.0, 1.0), (3, 0, "q.mp4", 0.0, 1.0)], "query_id long, number int, video_name string, start_ts double, end_ts double")
    got = {r["query_id"]: (r["hits"], r["precision_at_k"], round(r["recall"], 4)) for r in evaluate.precision_recall(results, expected, 2).collect()}
    assert got == {1: (2, 1.0, 0.6667), 2: (0, 0.0, 0.0), 3: (0, 0.0, 0.0)}
    first = {r["query_id"]: (r["first_rank"], r["hit_at_1"], r["hit_at_5"]) for r in evaluate.first_relevant(results, expected).collect()}
    assert first == {1: (1, True, True), 2: (0, False, False), 3: (0, False, False)}
