"""Polylines clipped to a box and simplified within a tolerance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

POINTS = "array<struct<x: double, y: double>>"


def clipped_share(ax, ay, bx, by, bounds: tuple[float, float, float, float]) -> Column:
    """Struct (t0, t1) of the part of a segment inside the box (least x, least y, most x, most y), as shares of the way from a to b; null if there is none, or a point only."""
    x0, y0, x1, y1 = bounds
    enter, leave, outside = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    # a segment passes each side of the box once: coming in where its direction is against the side's, going out where it is along it
    for step, room in ((ax - bx, ax - x0), (bx - ax, x1 - ax), (ay - by, ay - y0), (by - ay, y1 - ay)):
        t = room / F.when(step != 0, step)
        enter.append(F.when(step < 0, t).otherwise(0.0))
        leave.append(F.when(step > 0, t).otherwise(1.0))
        outside |= (step == 0) & (room < 0)
    t0, t1 = F.greatest(*enter), F.least(*leave)
    return F.when(~outside & (t0 < t1), F.struct(t0.alias("t0"), t1.alias("t1")))


def clip(lines: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """The fragments of lines (line_id, points) inside the box: line_id, fragment (from 0, along the line), points, cut_start, cut_end (whether the box cuts it there).

    A line that leaves the box and comes back has several. Lines outside have no row. Null points are left out. The bounds' least values are below the most.
    """
    if not (bounds[0] < bounds[2] and bounds[1] < bounds[3]):
        raise ValueError("the box's least values must be below its most")
    whole = lines.select("line_id", F.filter("points", lambda p: p.isNotNull()).alias("points"))
    hops = whole.select("line_id", F.size("points").alias("n"), F.posexplode(F.arrays_zip(F.slice("points", F.lit(1), F.greatest(F.size("points") - 1, F.lit(0))).alias("a"), F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))).alias("b"))).alias("pos", "s"))
    a, b = (tuple(F.col(f"s.{e}.{k}").cast("double") for k in "xy") for e in "ab")
    x = hops.withColumn("t", clipped_share(*a, *b, bounds)).where("t IS NOT NULL")
    at = lambda t: F.struct(*[(p + F.col(f"t.{t}") * (q - p)).alias(k) for k, p, q in zip("xy", a, b, strict=True)])
    start = F.when(F.col("t.t0") == 0, F.struct(a[0].alias("x"), a[1].alias("y"))).otherwise(at("t0"))
    end = F.when(F.col("t.t1") == 1, F.struct(b[0].alias("x"), b[1].alias("y"))).otherwise(at("t1"))
    x = x.select("line_id", "pos", start.alias("start"), end.alias("end"), (F.col("t.t0") > 0).alias("in_"), (F.col("t.t1") < 1).alias("out_"))
    w = Window.partitionBy("line_id").orderBy("pos")
    # a segment goes on with the fragment before if that ended where it starts, inside the box
    goes_on = (F.lag("pos").over(w) == F.col("pos") - 1) & ~F.lag("out_").over(w) & ~F.col("in_")
    x = x.withColumn("fragment", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    row = F.array_sort(F.collect_list(F.struct("pos", "start", "end", "in_", "out_"))).alias("r")
    out = x.groupBy("line_id", "fragment").agg(row)
    points = F.concat(F.array(F.col("r")[0]["start"]), F.transform("r", lambda s: s["end"]))
    return out.select("line_id", F.col("fragment").cast("int").alias("fragment"), points.alias("points"), F.col("r")[0]["in_"].alias("cut_start"), F.element_at("r", -1)["out_"].alias("cut_end"))


def kept_points(points: np.ndarray, tolerance: float) -> list[int]:
    """Places of the points to keep: both ends, and of each stretch the farthest point from its chord if that is beyond the tolerance."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, chord, between = points[i], points[j] - points[i], points[i + 1 : j] - points[i]
        length2 = float(chord @ chord)
        along = np.clip(between @ chord / length2, 0, 1) if length2 else np.zeros(len(between))
        away = np.hypot(*(points[i + 1 : j] - a - along[:, None] * chord).T)
        k = int(np.argmax(away))
        if away[k] > tolerance:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return sorted(keep)


def simplify(lines: DataFrame, tolerance: float) -> DataFrame:
    """lines (with a column points) whose points are thinned out: no point that goes is farther than the tolerance from what is left. 0: as they are. A negative tolerance: ValueError."""
    if not tolerance >= 0:
        raise ValueError("the tolerance is at least 0")
    if not tolerance:
        return lines

    @F.pandas_udf(POINTS)
    def thin(points: pd.Series) -> pd.Series:
        def one(line):
            if line is None or len(line) < 3:
                return line
            xy = np.array([(p["x"], p["y"]) for p in line], float)
            return [line[k] for k in kept_points(xy, tolerance)]

        return points.map(one)

    return lines.withColumn("points", thin(F.col("points").cast(POINTS)))
