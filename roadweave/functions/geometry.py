"""Column functions of plane geometry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6_371_008.8


def bearing(dx, dy) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def bearing_bin(degrees) -> Column:
    """One of 36 bins of ten degrees, the first around north."""
    return F.floor(F.pmod(degrees + 5, F.lit(360.0)) / 10).cast("int")


def deflection(in_dx, in_dy, out_dx, out_dy) -> Column:
    """Signed turn in degrees, left positive, above -180 up to 180."""
    d = F.degrees(F.atan2(out_dy, out_dx) - F.atan2(in_dy, in_dx))
    return F.lit(180.0) - F.pmod(F.lit(180.0) - d, F.lit(360.0))


def turn_class(reversal, from_class, to_class, signed, tolerance: float = 30.0) -> Column:
    return (
        F.when(reversal, "u_turn_forbidden")
        .when((from_class != "ramp") & (to_class == "ramp"), "ramp_on")
        .when((from_class == "ramp") & (to_class != "ramp"), "ramp_off")
        .when(F.abs(signed) <= tolerance, "through")
        .when(signed > 0, "left")
        .otherwise("right")
    )


def unwrapped_longitude(longitude, anchor) -> Column:
    return anchor + (F.pmod(longitude - anchor + 180, F.lit(360.0)) - 180)


def project(longitude, latitude, origin_longitude, origin_latitude) -> Column:
    """Struct (x, y) in metres, equirectangular around the origin."""
    return F.struct(
        (EARTH_RADIUS_M * F.radians(longitude - origin_longitude) * F.cos(F.radians(origin_latitude))).alias("x"),
        (EARTH_RADIUS_M * F.radians(latitude - origin_latitude)).alias("y"),
    )


def line_length(points) -> Column:
    """Length of an array of (x, y) structs."""
    hops = F.zip_with(points, F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(F.filter(hops, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)


def polygon_area(points) -> Column:
    """Area of a closed ring, its first point not repeated."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def in_polygon(x, y, points) -> Column:
    """Whether a point lies in a ring or on its boundary."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    edge = F.zip_with(points, following, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    def touches(e):
        cross = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
        return (F.abs(cross) <= 1e-9) & (x >= F.least(e["ax"], e["bx"])) & (x <= F.greatest(e["ax"], e["bx"])) & (y >= F.least(e["ay"], e["by"])) & (y <= F.greatest(e["ay"], e["by"]))

    def crosses(e):
        return ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.when(e["by"] != e["ay"], e["by"] - e["ay"]) + e["ax"])

    return F.exists(edge, touches) | (F.size(F.filter(edge, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1)


def crossing(ax, ay, bx, by, cx, cy, dx, dy, tolerance: float = 1e-9) -> Column:
    """Struct (t, u) of two segments that cross inside both, else null."""
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    safe = F.when(F.abs(det) > tolerance, det)
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / safe
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / safe
    inside = (t > tolerance) & (t < 1 - tolerance) & (u > tolerance) & (u < 1 - tolerance)
    return F.when(inside, F.struct(t.alias("t"), u.alias("u")))
