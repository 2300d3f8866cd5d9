"""Track summaries from a table of points (track, t, cx, cy, conf, ...).

Everything that needs only the ends of a track is one pre-aggregated group-by; windows over a track are
used only where a rule looks at neighbours or at a position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import geometry


def summaries(points: DataFrame, key: list[str], t: str, tie: str, still: float = geometry.STILL_PX) -> DataFrame:
    """Per track: start, end, duration, number of points, mean and largest confidence, ends, direction, best point."""
    first, last = F.struct(t, tie), F.struct(t, tie)
    ends = points.groupBy(*key).agg(
        F.min(t).alias("start_ts"),
        F.max(t).alias("end_ts"),
        F.count("*").alias("n_points"),
        F.avg("conf").alias("avg_conf"),
        F.max("conf").alias("max_conf"),
        F.min_by(F.struct("cx", "cy"), first).alias("_a"),
        F.max_by(F.struct("cx", "cy"), last).alias("_b"),
        F.min_by(F.col(tie), F.struct(-F.col("conf"), F.col(t), F.col(tie))).alias("best_point"),
    )
    dx, dy = F.col("_b.cx") - F.col("_a.cx"), F.col("_b.cy") - F.col("_a.cy")
    return ends.select(
        *key, "start_ts", "end_ts", (F.col("end_ts") - F.col("start_ts")).alias("duration"), "n_points", "avg_conf", "max_conf",
        dx.alias("dx"), dy.alias("dy"), geometry.direction_label(dx, dy, F.col("n_points"), still).alias("direction"), "best_point",
    )


def without_repeats(points: DataFrame, key: list[str], t: str, tie: str, same: list[str]) -> DataFrame:
    """Points that differ from the one before in any of the columns `same`."""
    w = Window.partitionBy(*key).orderBy(t, tie)
    repeat = F.lit(True)
    for c in same:
        repeat = repeat & F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return points.withColumn("_repeat", repeat & ~first).where(~F.col("_repeat")).drop("_repeat")


def frame_rates(points: DataFrame, key: list[str], t: str) -> DataFrame:
    """Upper median of the positive steps between distinct times, and the rate it means (1 at least)."""
    w = Window.partitionBy(*key).orderBy(t)
    steps = points.select(*key, t).distinct().withColumn("step", F.col(t) - F.lag(t).over(w)).where("step > 0")
    place = Window.partitionBy(*key).orderBy("step")
    ranked = steps.withColumn("_i", F.row_number().over(place) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    middle = ranked.where(F.col("_i") == F.floor(F.col("_n") / 2)).select(*key, F.col("step").alias("median_step"))
    return middle.withColumn("rate", F.greatest(F.bround(1 / F.col("median_step")), F.lit(1.0)))


def positioned(points: DataFrame, key: list[str], t: str, tie: str) -> DataFrame:
    """Points with their place i (from 0) and the track's size n."""
    w = Window.partitionBy(*key).orderBy(t, tie)
    return points.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*key)))


def middle_stretch(start: float = 0.25, end: float = 0.75) -> tuple[Column, Column]:
    """First and last place of the middle stretch of a placed track: half-even rounded fractions, one step at least."""
    last = F.col("n") - 1
    low, high = (F.bround(last * min(max(f, 0.0), 1.0)) for f in (start, end))
    return low, F.when(high <= low, F.least(low + 1, last)).otherwise(high)


def marked_contacts(placed: DataFrame, key: list[str], line) -> DataFrame:
    """placed with by_box (the box touches the line) and by_path (the centre's step here crosses it)."""
    w = Window.partitionBy(*key).orderBy("i")
    (ax, ay), (bx, by) = line
    crossed = geometry.segments_touch((F.lag("cx").over(w), F.lag("cy").over(w)), (F.col("cx"), F.col("cy")), (ax, ay), (bx, by))
    boxed = geometry.box_touches_line(*(F.col(f"box.{k}") for k in ("x1", "y1", "x2", "y2")), line)
    return placed.withColumn("by_box", boxed).withColumn("by_path", F.coalesce(crossed & (F.col("i") > 0), F.lit(False)))


def line_contacts(placed: DataFrame, key: list[str], t: str, line, min_displacement: float = 10.0) -> DataFrame:
    """First contact of each track with a line: contact_i, contact_t, mode.

    A box that touches the line counts before any crossing of the centre's path, wherever it is in the track."""
    here = F.struct(F.col("i"), F.col(t).alias("t"))
    found = marked_contacts(placed, key, line).groupBy(*key).agg(
        F.min(F.when(F.col("by_box"), here)).alias("_box"),
        F.min(F.when(F.col("by_path"), here)).alias("_path"),
        F.min_by(F.struct("cx", "cy"), "i").alias("a"),
        F.max_by(F.struct("cx", "cy"), "i").alias("b"),
        F.max("n").alias("n"),
    )
    moved = F.hypot(F.col("b.cx") - F.col("a.cx"), F.col("b.cy") - F.col("a.cy"))
    found = found.where((F.col("n") >= 2) & (moved >= max(min_displacement, 0.0)) & F.coalesce("_box", "_path").isNotNull())
    mode = F.when(F.col("_box").isNotNull(), F.lit("vehicle_bbox")).otherwise("trajectory_center")
    hit = F.coalesce("_box", "_path")
    return found.select(*key, hit["i"].alias("contact_i"), hit["t"].alias("contact_t"), mode.alias("mode"))
