"""Catalog queries against their SQL on tables larger or denser than the smallest scale."""

import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import canonical, collected
from tracelake.operators import intervals


def compared(spark, folder, name, events):
    """Rows of the query and of its SQL over a table of events (event_id, ts, user_id, event_type, value)."""
    path = f"{folder}/events.parquet"
    events.selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "cast(value as double) as value", "'{\"k\": 7}' as props").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{path}/*.parquet'")
    got, want = collected(__spark_entry__.queries()[name](spark, str(folder))), con.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    return canonical(got), canonical(want)


def test_fused_segments_are_all_there(spark, tmp_path):
    views = spark.range(100_050).selectExpr("id as event_id", "timestamp_seconds(1704067200 + id % 86400) as ts", "id as user_id", "'view' as event_type", "125 + id % 300 as value")
    got, want = compared(spark, tmp_path, "fused_segments", views)
    assert len(want) == 100_050 and got == want


def most_rows(spark):
    """The most rows that one operator of the last execution gave out."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    values, metrics = store.executionMetrics(last.executionId()), last.metrics()
    ids = [metrics.apply(i).accumulatorId() for i in range(metrics.size()) if metrics.apply(i).name() == "number of output rows"]
    return max(int(values.apply(i).replace(",", "")) for i in ids if values.contains(i))


def test_nearest_light_makes_no_pairs(spark, tmp_path):
    """4000 events of one video in two hours: purchases and lights by turns, of which some share their time."""
    kind = "case when id % 2 = 0 then 'purchase' when id % 3 = 0 then 'error' else 'view' end as event_type"
    events = spark.range(4000).selectExpr("id as event_id", "timestamp_seconds(1704067200 + id * 7919 % 1200 * 6) as ts", "id * 10 as user_id", kind, "id * 31 % 500 as value")
    got, want = compared(spark, tmp_path, "nearest_light", events)
    assert len(want) == 2000 and got == want
    assert most_rows(spark) <= 20_000


def test_nearest_state_at_the_edges(spark):
    """Lanes without states, negative and unknown times, unknown keys, ties on both sides, repeated row ids."""
    rng = random.Random(8)
    inf, nan = float("inf"), float("nan")
    times = lambda n, step: [rng.randrange(-200, 200) * step for _ in range(n)] + [None, nan, inf, -inf]
    for step, within in ((1.0, 7.0), (0.25, 1.5), (9.0, 30.0)):
        points = [(i % 150, rng.choice(["a", "b", None]), t, [f"p{i}"]) for i, t in enumerate(times(200, step))]
        states = [(rng.choice(["a", "b", "c", None]), t, rng.randrange(3) / 2, f"s{i:03d}") for i, t in enumerate(times(90, step))]
        p = spark.createDataFrame(points, "id long, video_id string, t double, more array<string>")
        s = spark.createDataFrame(states, "video_id string, t double, conf double, name string")
        found = intervals.nearest_state(p, "video_id", "t", "id", s, "t", [-F.col("conf"), F.col("name")], within, ["name"])
        assert found.columns == ["id", "video_id", "t", "more", "state_name", "state_at"]
        got = {(r["video_id"], r["id"]): (abs(r["state_at"] - r["t"]), r["state_name"]) for r in found.collect()}
        assert found.count() == len(got)
        want = {}
        for i, v, t, _ in points:
            near = [(abs(x[1] - t), -x[2], x[3]) for x in states if v and t is not None and x[1] is not None and x[0] == v and abs(x[1] - t) <= within]
            if near:
                want[v, i] = min([min(near), *([want[v, i]] if (v, i) in want else [])])
        assert got == {k: (gap, name) for k, (gap, _, name) in want.items()}
