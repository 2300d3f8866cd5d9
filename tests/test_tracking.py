"""Multi-object tracking: the assignment against all permutations, and tracks through gaps, crossings and noise."""

import itertools

import numpy as np
import pandas as pd

from tests.conftest import SMALL
from tracelake.operators import tracking
from tracelake.plans import adapters, catalog


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, m = (int(x) for x in rng.integers(1, 6, 2))
        cost = rng.integers(0, 9, (n, m)).astype(float)
        found = tracking.assignment(cost)
        pairs = [(i, int(j)) for i, j in enumerate(found) if j >= 0]
        small = cost if n <= m else cost.T
        best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert len(pairs) == len({j for _, j in pairs}) == min(n, m) and sum(cost[p] for p in pairs) == best


def frames(tracks, **conf):
    """Rows of boxes: tracks maps a name to {frame: (x, y)}."""
    rows = [("v", "car", float(t), f"f{t:03d}", x, y, x + 40.0, y + 30.0, conf.get(f"{name}{t}", 0.9), name) for name, places in tracks.items() for t, (x, y) in places.items()]
    return pd.DataFrame(rows, columns=["video_id", "label", "t", "frame_path", "x1", "y1", "x2", "y2", "conf", "name"])


def names_of(rows):
    """Track ids by true object."""
    out = tracking.track_video(rows).merge(rows, on=["t", "x1", "y1"], suffixes=("", "_r"))
    return out.groupby("name")["track_id"].agg(lambda s: sorted(set(s))).to_dict()


def test_objects_that_pass_each_other_keep_their_tracks():
    a = {t: (10.0 + 8 * t, 50.0) for t in range(40)}
    b = {t: (330.0 - 8 * t, 62.0) for t in range(40)}
    assert names_of(frames({"a": a, "b": b})) == {"a": ["v:1"], "b": ["v:2"]}


def test_a_gap_is_bridged_by_prediction():
    a = {t: (10.0 + 9 * t, 50.0) for t in range(50) if not 20 <= t < 28}
    assert names_of(frames({"a": a, "b": {t: (600.0, 300.0) for t in range(50)}}))["a"] == ["v:1"]
    late = {t: (10.0 + 9 * t, 50.0) for t in range(90) if not 20 <= t < 60}
    assert len(names_of(frames({"a": late, "b": {t: (600.0, 300.0) for t in range(90)}}))["a"]) == 2


def test_weak_detections_go_on_but_do_not_start():
    a = {t: (10.0 + 2 * t, 50.0) for t in range(20)}
    weak = {f"a{t}": 0.15 for t in range(5, 10)}
    assert names_of(frames({"a": a}, **weak)) == {"a": ["v:1"]}
    assert names_of(frames({"a": a, "n": {3: (300.0, 300.0), 9: (500.0, 10.0)}})) == {"a": ["v:1"]}  # seen once, later than the first frame
    assert tracking.track_video(frames({"a": a}, **{f"a{t}": 0.2 for t in range(20)})).empty


def test_steps_give_the_same_as_the_whole():
    rng = np.random.default_rng(3)
    rows = frames({k: {t: (100.0 * i + 3 * t + rng.normal(), 40.0 * i + rng.normal()) for t in range(30) if rng.random() > 0.1} for i, k in enumerate("abcd")})
    tracker = tracking.Tracker()
    parts = pd.concat([tracker.advance(rows[(rows["t"] >= a) & (rows["t"] < a + 7)]) for a in range(0, 30, 7)])
    pd.testing.assert_frame_equal(parts.reset_index(drop=True), tracking.Tracker().advance(rows).reset_index(drop=True))


def test_rows_without_a_box_and_empty_input():
    rows = frames({"a": {t: (10.0, 10.0) for t in range(3)}})
    rows.loc[1, "x1"] = np.nan
    assert len(tracking.track_video(rows)) == 2 and tracking.track_video(rows[:0]).empty


def test_the_tracking_query_against_a_plain_run(spark):
    rows = adapters.boxed(adapters.observations(spark, SMALL)).select("track", "t", "event_id", "box.*").toPandas()
    rows = rows.assign(video_id=rows["track"].astype(str), label="car", t=np.floor(rows["t"]), frame_path=rows["event_id"].map("f_{:012d}.jpg".format), conf=0.9)
    want = {}
    for video, own in rows.groupby("video_id"):
        found = tracking.track_video(own)
        if len(found):
            want[video] = (found["track_id"].nunique(), len(found))
    got = {r["video_id"]: (r["n_tracks"], r["n_points"]) for r in catalog.tracked_detections(spark, SMALL).collect()}
    assert got == want and got
