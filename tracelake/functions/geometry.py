"""Plane geometry as Column expressions.  Lines and polygons are literals, points and boxes are columns.

Because a line is known when the plan is built, a box test is a clip of the line against the box: one
interval of the line's parameter, no loop over edges.  EPS is the tolerance of every touch test.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
STILL_PX = 20.0
NEAR_WIDTHS = 2.5


def turn(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of a, b, c."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _overlap(a1, a2, b1, b2) -> Column:
    return F.greatest(F.least(a1, a2), F.least(b1, b2)) <= F.least(F.greatest(a1, a2), F.greatest(b1, b2)) + F.lit(EPS)


def segments_touch(a, b, c, d) -> Column:
    """Whether the finite segments ab and cd meet; each end is a pair of numbers or columns."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = (tuple(v if isinstance(v, Column) else F.lit(float(v)) for v in p) for p in (a, b, c, d))
    sides = (turn(ax, ay, bx, by, cx, cy), turn(ax, ay, bx, by, dx, dy), turn(cx, cy, dx, dy, ax, ay), turn(cx, cy, dx, dy, bx, by))

    def apart(p, q):
        return (F.least(p, q) > EPS) | (F.greatest(p, q) < -EPS)

    flat = reduce(lambda x, y: x & y, [F.abs(s) <= EPS for s in sides])
    return F.when(flat, _overlap(ax, bx, cx, dx) & _overlap(ay, by, cy, dy)).otherwise(~apart(sides[0], sides[1]) & ~apart(sides[2], sides[3]))


def box_touches_line(x1, y1, x2, y2, line) -> Column:
    """Whether the literal segment has a point in the box (Liang-Barsky clip); a null box touches nothing."""
    (px, py), (qx, qy) = ((float(a), float(b)) for a, b in line)
    low, high, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for start, step, near, far in ((px, qx - px, F.least(x1, x2), F.greatest(x1, x2)), (py, qy - py, F.least(y1, y2), F.greatest(y1, y2))):
        if step == 0.0:
            inside = inside & (near - EPS <= start) & (far + EPS >= start)
            continue
        enter, leave = (near - EPS - start) / step, (far + EPS - start) / step
        low, high = F.greatest(low, F.least(enter, leave)), F.least(high, F.greatest(enter, leave))
    boxed = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return F.coalesce(boxed & inside & (low <= high), F.lit(False))


def foot_on_line(x, y, line) -> tuple[Column, Column]:
    """The point of the literal segment nearest to (x, y)."""
    (px, py), (qx, qy) = ((float(a), float(b)) for a, b in line)
    dx, dy = qx - px, qy - py
    size = dx * dx + dy * dy
    if size <= 1e-12:
        return F.lit(px), F.lit(py)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - px) * dx + (y - py) * dy) / size))
    return px + t * dx, py + t * dy


def line_distance(x, y, line) -> Column:
    fx, fy = foot_on_line(x, y, line)
    return F.hypot(x - fx, y - fy)


def in_polygon(x, y, polygon) -> Column:
    """Even-odd rule; fewer than three corners hold nothing."""
    if len(polygon) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        ax, ay, bx, by = float(ax), float(ay), float(bx), float(by)
        if ay != by:
            level = (F.lit(ay) > y) != (F.lit(by) > y)
            crossings = crossings + F.when(level & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
    return crossings % 2 == 1


def unit(dx, dy) -> tuple[Column, Column]:
    """The direction of (dx, dy); null for no direction."""
    size = F.hypot(dx, dy)
    size = F.when(size > 1e-9, size)
    return dx / size, dy / size


def direction_label(dx, dy, points, still: float = STILL_PX) -> Column:
    across = F.when(dx > 0, F.lit("left_to_right")).otherwise("right_to_left")
    down = F.when(dy > 0, F.lit("top_to_bottom")).otherwise("bottom_to_top")
    return (
        F.when(points < 2, F.lit("unknown"))
        .when((F.abs(dx) < still) & (F.abs(dy) < still), F.lit("stationary"))
        .when(F.abs(dx) >= F.abs(dy), across)
        .otherwise(down)
    )


# Relations of two boxes given as structs or prefixes of columns x1, y1, x2, y2.


def _box(b) -> tuple[Column, ...]:
    return tuple(b[k] for k in ("x1", "y1", "x2", "y2"))


def _missing(*boxes) -> Column:
    return reduce(lambda x, y: x | y, [v.isNull() for b in boxes for v in _box(b)])


def near(p, c, widths: float = NEAR_WIDTHS) -> Column:
    """Centres within `widths` times the wider box; a missing box does not exclude."""
    px1, py1, px2, py2 = _box(p)
    cx1, cy1, cx2, cy2 = _box(c)
    reach = widths * F.greatest(px2 - px1, cx2 - cx1, F.lit(1.0))
    dx, dy = (px1 + px2 - cx1 - cx2) / 2, (py1 + py2 - cy1 - cy2) / 2
    return _missing(p, c) | (dx * dx + dy * dy <= reach * reach)


def left_of(p, c) -> Column:
    return ~_missing(p, c) & (p["x1"] + p["x2"] < c["x1"] + c["x2"])


def right_of(p, c) -> Column:
    return ~_missing(p, c) & (p["x1"] + p["x2"] > c["x1"] + c["x2"])


def inside(p, c) -> Column:
    return ~_missing(p, c) & (p["x1"] >= c["x1"]) & (p["y1"] >= c["y1"]) & (p["x2"] <= c["x2"]) & (p["y2"] <= c["y2"])


#: In order of precedence when a query names several.
RELATIONS = {"near": near, "left_of": left_of, "right_of": right_of, "inside": inside}
