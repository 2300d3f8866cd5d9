import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import fuzzy, geometry, text, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "made,want",
    [
        (lambda: text.normal_label(F.lit("  Traffic \t LIGHT ")), "traffic light"),
        (lambda: text.normal_label(F.lit(None)), ""),
        (lambda: text.normal_entity(F.lit("Stop_Line")), "stop line"),
        (lambda: text.normal_event_type(F.lit(" Wrong Way  Driving")), "wrong_way_driving"),
        (lambda: text.normal_text(F.lit(" A b\nC ")), "abc"),
        (lambda: text.normal_direction(F.lit("Left-to right")), "left_to_right"),
        (lambda: text.normal_direction(F.lit("up")), ""),
        (lambda: text.display_time(F.lit(3725.9)), "01:02:05"),
        (lambda: text.display_time(F.lit(65.0)), "01:05"),
        (lambda: text.frame_file_name(F.lit("a b.c"), F.lit(3)), "a_b_c_3.00.jpg"),
        (lambda: text.short_event_id(F.lit("v:t:v:7")), "v:t:7"),
        (lambda: text.short_event_id(F.lit("v:t:w:7")), "v:t:w:7"),
        (lambda: text.short_event_id(F.lit("v:t:7")), "v:t:7"),
        (lambda: text.segment_id(F.lit("v"), F.lit(7)), "v_seg007"),
        (lambda: text.event_id(F.lit("v"), "rule", F.lit("v:3")), "v:rule:3"),
        (lambda: text.folded_stem(F.lit("/a/B.C.MP4")), "b.c"),
        (lambda: text.label_zh(F.lit("car")), "汽车"),
        (lambda: text.label_zh(F.lit("tram")), "tram"),
        (lambda: text.segment_text(F.lit("v"), F.lit(1.0), F.lit(" d ")), "d"),
        (lambda: text.segment_text(F.lit("v"), F.lit(1.0), F.lit(""), F.lit("car"), F.lit("STOP")), "检测到 car，识别到文本 STOP"),
        (lambda: text.segment_text(F.lit("v"), F.lit(1.0), F.lit(None)), "视频片段_v_1.0"),
        (lambda: text.clip_url(F.lit("/v 1.mp4"), F.lit(2.0), F.lit(2.0), F.lit("")), "/api/search/download_clip?video_path=%2Fv%201.mp4&start_ts=2.0&end_ts=3.0&output_name=clip_2.0s"),
        (lambda: text.is_ascii_query(F.lit("a_b c")), True),
        (lambda: text.is_ascii_query(F.lit("红 a")), False),
        (lambda: text.is_ascii_query(F.lit(" _-")), False),
        (lambda: text.asset_id(F.lit("/x/ü.mp4")), "video_" + hashlib.sha1("/x/ü.mp4".encode()).hexdigest()[:10]),
        (lambda: text.asset_id(F.lit("/x/a b.mp4")), "a_b_" + hashlib.sha1(b"/x/a b.mp4").hexdigest()[:10]),
    ],
)
def test_text(spark, made, want):
    assert value(spark, made()) == want


def test_frame_names(spark):
    parts = {n: tuple(value(spark, text.frame_name_parts(F.lit(n)))) for n in ("/a/cam_1_2.50.jpg", "cam.jpg", "cam_x.jpg")}
    assert parts == {"/a/cam_1_2.50.jpg": ("cam_1", 2.5), "cam.jpg": ("cam", 0.0), "cam_x.jpg": ("cam", 0.0)}


def lines_meet(a, b, c, d):
    """Exact on a small integer grid."""

    def turn(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def within(p, q, r):
        return min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])

    t = (turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b))
    if t[0] * t[1] < 0 and t[2] * t[3] < 0:
        return True
    return any(x == 0 and within(p, q, r) for x, p, q, r in zip(t, (a, a, c, c), (b, b, d, d), (c, d, a, b), strict=True))


def test_segments_and_boxes(spark):
    rng = random.Random(1)
    rows = [tuple(float(rng.randrange(6)) for _ in range(8)) for _ in range(400)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double, cx double, cy double, dx double, dy double")
    pair = lambda p: (F.col(p + "x"), F.col(p + "y"))
    got = [r["v"] for r in df.select(geometry.segments_touch(*map(pair, "abcd")).alias("v")).collect()]
    assert got == [lines_meet(r[:2], r[2:4], r[4:6], r[6:8]) for r in rows]
    for line in (((2.0, 0.0), (2.0, 3.0)), ((0.0, 5.0), (4.0, 1.0)), ((1.0, 1.0), (1.0, 1.0))):
        found = df.select(geometry.box_touches_line(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), line).alias("v")).collect()
        for r, v in zip(rows, found, strict=True):
            x1, x2, y1, y2 = min(r[0], r[2]), max(r[0], r[2]), min(r[1], r[3]), max(r[1], r[3])
            corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
            ends = any(x1 <= x <= x2 and y1 <= y <= y2 for x, y in line)
            assert v["v"] == (ends or any(lines_meet(corners[i], corners[(i + 1) % 4], *line) for i in range(4)))


def test_points_polygons_directions(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert value(spark, geometry.in_polygon(F.lit(2.0), F.lit(2.0), square)) and not value(spark, geometry.in_polygon(F.lit(5.0), F.lit(2.0), square))
    assert not value(spark, geometry.in_polygon(F.lit(1.0), F.lit(1.0), square[:2]))
    assert value(spark, geometry.line_distance(F.lit(3.0), F.lit(4.0), ((0, 0), (0, 0)))) == 5.0
    assert value(spark, geometry.line_distance(F.lit(5.0), F.lit(1.0), ((0, 0), (4, 0)))) == pytest.approx(math.sqrt(2))
    cases = {(40, 0, 2): "left_to_right", (-40, 3, 2): "right_to_left", (3, 40, 2): "top_to_bottom", (3, -40, 2): "bottom_to_top", (5, 5, 2): "stationary", (90, 0, 1): "unknown"}
    for (dx, dy, n), want in cases.items():
        assert value(spark, geometry.direction_label(F.lit(dx), F.lit(dy), F.lit(n))) == want
    assert value(spark, geometry.unit(F.lit(0.0), F.lit(0.0))[0]) is None


def test_vectors(spark):
    v = F.array(*[F.lit(x).cast("float") for x in (3.0, 4.0)])
    assert value(spark, vectors.norm(v)) == 5.0
    assert value(spark, vectors.dot(v, vectors.literal([1, 2]))) == 11.0
    assert value(spark, vectors.normalised(v)) == pytest.approx([0.6, 0.8])
    zero = F.array(F.lit(0.0).cast("float"))
    assert value(spark, vectors.normalised(zero)) == [0.0]


def common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_fuzzy():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(2))
        want = 200 * common(a, b) / (len(a) + len(b)) if a and b else 0.0
        assert fuzzy.ratio(a, b) == pytest.approx(want)
        short, long = sorted((a, b), key=len)
        if short:
            pieces = [long[max(0, e - len(short)) : e] for e in range(1, len(long) + len(short))]
            assert fuzzy.partial_ratio(a, b) == pytest.approx(max((200 * common(short, p) / (len(short) + len(p)) for p in pieces if p), default=0.0))
    assert fuzzy.similarity("abc", "xxabcxx") == 100.0 and fuzzy.similarity("", "a") == 0.0
