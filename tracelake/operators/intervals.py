"""Ordered and interval operators: islands, retain windows, as-of and interval joins, segment windows.

Joins on time always carry an equality (a video) and, where intervals meet points, a time bucket, so they are
hash or merge joins; no plan here has a nested loop.  The as-of join is no join but two ordered passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6
SEGMENT_SECONDS = 5.0


def _order(df: DataFrame, key: list[str], order: list) -> Window:
    return Window.partitionBy(*key).orderBy(*order)


def gap_islands(df: DataFrame, key: list[str], at: str, gap: float, tie: str, name: str = "island") -> DataFrame:
    """Number the runs of rows whose step from the previous one is at most gap."""
    w = _order(df, key, [at, tie])
    starts = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_starts", starts).withColumn(name, F.sum("_starts").over(w)).drop("_starts")


def merged_intervals(df: DataFrame, key: list[str], start: str, end: str, tie: str, name: str = "island", eps: float = EPS) -> DataFrame:
    """Number the runs of intervals that touch or overlap (within eps) what came before."""
    w = _order(df, key, [start, end, tie])
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col(start) <= reach + eps, 0).otherwise(1)
    return df.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(w)).drop("_opens")


def frame_sessions(frames: DataFrame, key: str, at: str, gap: float, tie: str) -> DataFrame:
    """One row per session of frames: start, end, number of frames."""
    rows = gap_islands(frames, [key], at, gap, tie)
    return rows.groupBy(key, "island").agg(F.min(at).alias("start_time"), F.max(at).alias("end_time"), F.count("*").alias("n_frames"))


def retained(frames: DataFrame, key: str, index: str, hit: Column, keep: int = 60) -> DataFrame:
    """Rows at most `keep` rows after a hit (the hit itself included)."""
    w = _order(frames, [key], [index])
    rows = frames.withColumn("_n", F.row_number().over(w)).withColumn("_hit", F.when(hit, F.col("_n")))
    last = F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_last", last).where(F.col("_n") - F.col("_last") <= keep).drop("_n", "_hit", "_last")


def activity_retained(frames: DataFrame, key: str, index: str, hit: Column, probe_every: int = 30, keep: int = 60, available: bool = True) -> DataFrame:
    """Only every probe_every-th row is looked at; a hit there opens the window.  Without a detector only the probed rows stay."""
    w = _order(frames, [key], [index])
    rows = frames.withColumn("_p", (F.row_number().over(w) - 1) % probe_every == 0)
    kept = retained(rows, key, index, F.col("_p") & hit, keep) if available else rows.where("_p")
    return kept.drop("_p")


def phase_intervals(states: DataFrame, key: str, at: str, gap: float, tie: str) -> DataFrame:
    """Continuous phases: start, end of runs with steps of at most gap."""
    rows = gap_islands(states, [key], at, gap, tie)
    return rows.groupBy(key, "island").agg(F.min(at).alias("phase_start"), F.max(at).alias("phase_end")).drop("island")


def points_in_intervals(points: DataFrame, key: str, at: str, intervals: DataFrame, start: str, end: str, bucket: float, eps: float = EPS) -> DataFrame:
    """Points inside an interval of the same key (left semi): start <= at <= end + eps.

    Long intervals are cut into buckets of time, so the join key is (key, bucket)."""
    lanes = F.sequence(F.floor(F.col(start) / bucket).cast("long"), F.floor((F.col(end) + eps) / bucket).cast("long"))
    cut = intervals.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(lanes).alias("_lane_of"))
    own = points.withColumn("_lane", F.floor(F.col(at) / bucket).cast("long"))
    inside = (F.col(at) >= F.col("_s")) & (F.col(at) <= F.col("_e") + eps)
    return own.join(cut, (F.col(key) == F.col("_k")) & (F.col("_lane") == F.col("_lane_of")) & inside, "left_semi").drop("_lane")


def nearest_state(points: DataFrame, key: str, at: str, row_id: str, states: DataFrame, state_at: str, rank: list, within: float, columns: list[str]) -> DataFrame:
    """As-of join, both sides: each point with the state nearest in time, at most `within` away; ties by rank.  row_id names a point within its key.

    No pairs are made: points and states of one key and lane of time (`within` wide) are sorted together, and a point meets the last
    state up to it and the first one from it on.  A lane also holds the last state of the lane before it and the first of the one after
    it, as nothing farther is near enough.  Points without a state go."""
    lane = lambda c: F.floor(F.col(c) / within).cast("long")
    timed = lambda df, c: df.where(F.col(key).isNotNull() & (F.abs(F.col(c)) < float("inf")))
    order = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])
    told = F.struct(*[F.col(c).alias(f"state_{c}") for c in columns], F.col(state_at).alias("state_at"))
    state = F.struct(F.col(state_at).alias("at"), order.alias("rank"), told.alias("state"))
    near = timed(states, state_at).select(F.col(key).alias("_k"), lane(state_at).alias("_lane"), state.alias("_s"))
    ends = near.groupBy("_k", "_lane").agg(F.min_by("_s", F.struct("_s.at", "_s.rank")).alias("first"), F.min_by("_s", F.struct(-F.col("_s.at"), "_s.rank")).alias("last"))
    beside = ends.select("_k", F.inline(F.array(*[F.struct((F.col("_lane") + step).alias("_lane"), F.col(end).alias("_s")) for step, end in ((-1, "first"), (1, "last"))])))
    own = timed(points, at).select(F.col(key).alias("_k"), lane(at).alias("_lane"), F.col(at).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_p"))
    rows = near.unionByName(beside).withColumn("_t", F.col("_s.at")).unionByName(own, allowMissingColumns=True)

    def last(time: Column) -> Column:  # of one time the states come before the points, the best of them last
        w = _order(rows, ["_k", "_lane"], [time, F.col("_p").isNotNull(), F.desc("_s.rank")])
        return F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    met = rows.withColumn("_near", F.array(last(F.col("_t")), last(F.desc("_t")))).where("_p is not null")
    met = met.select("_k", "_t", "_p", F.explode("_near").alias("_s")).withColumn("_gap", F.abs(F.col("_s.at") - F.col("_t"))).where(F.col("_gap") <= within)
    best = F.min_by(F.struct("_p", "_s.state"), F.struct("_gap", "_s.rank")).alias("_b")
    return met.groupBy("_k", F.col("_p").getField(row_id).alias("_id")).agg(best).select("_b._p.*", "_b.state.*")


def overlapping(a: DataFrame, b: DataFrame, key: str, a_span: tuple[str, str], b_span: tuple[str, str], how: str = "inner") -> DataFrame:
    """Rows of a and b of one key whose closed spans overlap; b's key column must be named `b_<key>`."""
    meet = F.greatest(F.col(a_span[0]), F.col(b_span[0])) <= F.least(F.col(a_span[1]), F.col(b_span[1]))
    return a.join(b, (F.col(key) == F.col(f"b_{key}")) & meet, how)


def gap_windows(events: DataFrame, key: str, start: str, end: str, tie: str, width: float = SEGMENT_SECONDS, eps: float = EPS) -> DataFrame:
    """Full windows of `width` in the uncovered time before each interval: key, start_ts, end_ts.

    Windows count from the end of what is covered so far (0 at first); a rest shorter than width is left out."""
    w = _order(events, [key], [start, end, tie])
    reach = F.greatest(F.lit(0.0), F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = events.select(key, F.col(start).alias("_to"), reach.alias("_from"))
    count = F.floor((F.col("_to") - F.col("_from") + eps) / width).cast("int")
    rows = rows.withColumn("_n", count).where("_n >= 1")  # sequence(0, -1) would count down
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.select(key, (F.col("_from") + F.col("_i") * width).alias("start_ts"), (F.col("_from") + (F.col("_i") + 1) * width).alias("end_ts"))


def tail_windows(covered: DataFrame, key: str, end: str, durations: DataFrame, width: float = SEGMENT_SECONDS, eps: float = EPS) -> DataFrame:
    """Full windows after the last interval up to the video's duration: durations has key and duration."""
    last = covered.groupBy(key).agg(F.max(end).alias("_from"))
    rows = durations.join(last, key, "left").withColumn("_from", F.greatest(F.lit(0.0), F.coalesce("_from", F.lit(0.0))))
    rows = rows.withColumn("_n", F.floor((F.col("duration") - F.col("_from") + eps) / width).cast("int")).where("_n >= 1")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.select(key, (F.col("_from") + F.col("_i") * width).alias("start_ts"), (F.col("_from") + (F.col("_i") + 1) * width).alias("end_ts"))
