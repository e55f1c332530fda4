"""Shape of a street network: convex hull, density, continuity, degrees, presence in cells; the gate on them; and a structural audit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from roadweave.functions import geometry as G
from roadweave.operators import forest
from roadweave.operators.graph import weak_components
from roadweave.operators.planar import _side
from roadweave.operators.spatial import segment_cells
from roadweave.plans.loops import cut

#: Cells a side of the hull's box for streets and for junctions, and how near a junction must be, in diagonals of a cell.
STREET_CELLS, JUNCTION_CELLS, JUNCTION_RADIUS = 24, 12, 0.5
#: Thresholds of the gate.
THRESHOLDS = {
    "minimum_street_density_km_per_km2": 5.951,
    "maximum_street_density_km_per_km2": 21.323,
    "minimum_block_continuity": 0.85,
    "maximum_dead_end_share": 0.15,
    "minimum_district_quadrant_presence_share": 0.90,
    "maximum_mixed_grid_four_way_share": 0.62,
    "maximum_river_dead_end_share": 0.13,
    "minimum_river_block_continuity": 0.87,
    "minimum_global_local_street_cell_presence_share": 0.40,
    "minimum_global_local_junction_proximity_share": 0.40,
}


def _ring(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The convex hull, counter-clockwise from the least point, without points on its sides."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    sides = []
    for line in (points, points[::-1]):
        side: list = []
        for p in line:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        sides += side[:-1]
    return sides


def hull(points: DataFrame) -> DataFrame:
    """One row: ring, the corners (x, y) of the convex hull of the points (x, y), counter-clockwise from the least; empty for none.

    A hull of hulls is the hull: each partition keeps the corners of what it has read, batch by batch, then fewer partitions those of the others'.
    Corners are few: of whole-number points in a square of side s at most about 3 * s^(2/3).
    """

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ring: list = []
        for pdf in batches:
            ring = _ring(ring + list(zip(pdf["x"], pdf["y"], strict=True)))
        yield pd.DataFrame(ring, columns=["x", "y"])

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ring: list = []
        for pdf in batches:
            ring = _ring(ring + list(zip(pdf["x"], pdf["y"], strict=True)))
        yield pd.DataFrame({"ring": [[{"x": x, "y": y} for x, y in ring]]})

    kind = "x double, y double"
    part = points.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("x").cast("double"), F.col("y").cast("double")).mapInPandas(corners, kind)
    return part.repartition(16).mapInPandas(corners, kind).repartition(1).mapInPandas(one, "ring array<struct<x: double, y: double>>")


def _cells(box: DataFrame, n: int) -> DataFrame:
    """(cx, cy, x, y) of the cells of the box whose centre lies in the hull. box: one row with ring, x0, y0, w, h."""
    x = box.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("cx")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("cy"))
    x = x.withColumn("x", F.col("x0") + (F.col("cx") + 0.5) * F.col("w") / n).withColumn("y", F.col("y0") + (F.col("cy") + 0.5) * F.col("h") / n)
    return x.where(G.in_polygon(F.col("x"), F.col("y"), F.col("ring"))).select("cx", "cy", "x", "y")


def _index(value: Column, low: Column, size: Column, n: int) -> Column:
    """The cell of a coordinate, those beyond the box in its last ones."""
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), ((value - low) / size).cast("int")))


def _share_of(hit: DataFrame, all_: DataFrame, name: str) -> DataFrame:
    return all_.join(hit, ["cx", "cy"], "left").agg(F.coalesce(F.avg(F.col("hit").isNotNull().cast("double")), F.lit(0.0)).alias(name))


def _street_presence(edges: DataFrame, box: DataFrame, cells: DataFrame, name: str) -> DataFrame:
    """Share of the cells with a point of a street; points are half a cell apart or less."""
    n = STREET_CELLS
    x = edges.join(F.broadcast(box.select("x0", "y0", (F.col("w") / n).alias("w"), (F.col("h") / n).alias("h"))), F.lit(True))  # one row
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")) / F.col("w"), F.abs(F.col("by") - F.col("ay")) / F.col("h")) * 2.0).cast("int"))
    x = x.withColumn("n", steps).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("share", F.col("share") / F.col("n"))
    at = lambda a, b, low, size: _index(F.col(a) + (F.col(b) - F.col(a)) * F.col("share"), F.col(low), F.col(size), n)
    hit = x.select(at("ax", "bx", "x0", "w").alias("cx"), at("ay", "by", "y0", "h").alias("cy")).distinct().withColumn("hit", F.lit(True))
    return _share_of(hit, cells, name)


def _junction_proximity(local: DataFrame, nodes: DataFrame, box: DataFrame) -> DataFrame:
    """Share of the cells whose centre has a junction of three or more local streets within the radius."""
    n = JUNCTION_CELLS
    ends = local.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("d")).where("d >= 3")
    size = F.broadcast(box.select("x0", "y0", (F.col("w") / n).alias("w"), (F.col("h") / n).alias("h")))
    j = nodes.join(ends, "node_id", "left_semi").join(size, F.lit(True))  # one row
    # cells that the radius can reach: a few either way, the whole of the box at most
    reach = lambda c, size: F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - F.ceil(F.col("d") / F.col(size)).cast("int")), F.least(F.lit(n - 1), F.col(c) + F.ceil(F.col("d") / F.col(size)).cast("int"))))
    j = j.select(F.col("x").alias("jx"), F.col("y").alias("jy"), (F.hypot("w", "h") * JUNCTION_RADIUS).alias("d"), "w", "h", _index(F.col("x"), F.col("x0"), F.col("w"), n).alias("jc"), _index(F.col("y"), F.col("y0"), F.col("h"), n).alias("jr"))
    j = j.withColumn("cx", reach("jc", "w")).withColumn("cy", reach("jr", "h")).select("cx", "cy", "jx", "jy", "d")
    cells = _cells(box, n)
    near = cells.join(j, ["cx", "cy"]).where(F.hypot(F.col("x") - F.col("jx"), F.col("y") - F.col("jy")) <= F.col("d"))
    return _share_of(near.select("cx", "cy").distinct().withColumn("hit", F.lit(True)), cells, "global_local_junction_proximity_share")


def _district_presence(edges: DataFrame, districts: DataFrame, size: float) -> DataFrame:
    """How many of the four quadrants of a district's box hold an end or middle of a street inside it, on average. districts: district_id, ring."""
    one = lambda c, least: F.array_min(F.transform("ring", lambda p: p[c])) if least else F.array_max(F.transform("ring", lambda p: p[c]))
    d = districts.select("district_id", "ring", one("x", True).alias("x0"), one("x", False).alias("x1"), one("y", True).alias("y0"), one("y", False).alias("y1"))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    cells = d.select("*", F.explode(span("x0", "x1")).alias("cx")).select("*", F.explode(span("y0", "y1")).alias("cy"))
    middle = F.struct(((F.col("ax") + F.col("bx")) * 0.5).alias("x"), ((F.col("ay") + F.col("by")) * 0.5).alias("y"))
    p = edges.select(F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")), middle)).alias("p")).select("p.x", "p.y").distinct()
    p = p.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    quadrant = F.struct((F.col("x") >= (F.col("x0") + F.col("x1")) * 0.5).alias("e"), (F.col("y") >= (F.col("y0") + F.col("y1")) * 0.5).alias("n"))
    hit = p.join(cells, ["cx", "cy"]).where(G.in_polygon(F.col("x"), F.col("y"), F.col("ring"))).groupBy("district_id").agg(F.count_distinct(quadrant).alias("q"))
    return districts.join(hit, "district_id", "left").agg(F.coalesce(F.avg(F.coalesce("q", F.lit(0)) / 4.0), F.lit(0.0)).alias("district_quadrant_presence_share"), F.count("*").alias("district_count"))


def metrics(nodes: DataFrame, edges: DataFrame, districts: DataFrame, size: float) -> DataFrame:
    """One row of measures of the network of nodes (node_id, x, y) and streets (edge_id, u, v, ax, ay, bx, by, length, local), with districts (district_id, ring).

    Every measure is an aggregate of its own and has one row, so they are put side by side. size: cells in which districts meet streets.
    Without streets, or where the nodes span no area, the row holds nulls or zeros.
    """
    edges = cut(edges)
    nodes = cut(nodes)
    ring = cut(hull(nodes))
    low, high = (lambda c: F.array_min(F.transform("ring", lambda p: p[c]))), (lambda c: F.array_max(F.transform("ring", lambda p: p[c])))
    box = ring.where("size(ring) > 2").select("ring", low("x").alias("x0"), low("y").alias("y0"), (high("x") - low("x")).alias("w"), (high("y") - low("y")).alias("h"))
    area = ring.select(G.polygon_area(F.col("ring")).alias("convex_hull_area_m2"))
    cutting = forest.bridges(edges).withColumn("bridge", F.lit(True))
    x = edges.join(cutting, "edge_id", "left").agg(
        F.sum("length").alias("total"), F.sum(F.when(F.col("bridge"), F.col("length")).otherwise(0.0)).alias("cut"),
        F.sum(F.when(~F.col("local"), F.col("length")).otherwise(0.0)).alias("wide"), F.sum(F.when(F.col("local"), F.col("length")).otherwise(0.0)).alias("narrow"),
        F.coalesce(F.median(F.when(F.col("local"), F.col("length"))), F.lit(0.0)).alias("median_local_length_m"), F.coalesce(F.median(F.when(~F.col("local"), F.col("length"))), F.lit(0.0)).alias("median_connector_length_m"),
        F.count("*").alias("physical_segment_count"),
    )
    degree = nodes.select("node_id").join(edges.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("d")), "node_id", "left")
    share = lambda c: F.avg(c.cast("double"))
    d = F.coalesce("d", F.lit(0))
    degrees = degree.agg(*[share(d == k).alias(f"degree_{name}_share") for k, name in enumerate(("one", "two", "three", "four"), 1)], share(d >= 5).alias("degree_five_plus_share"))
    parts = weak_components(nodes.select("node_id"), edges).agg(F.count_distinct("root").alias("weak_component_count"))
    local, cells = edges.where("local"), cut(_cells(box, STREET_CELLS))
    rows = [
        area, x, degrees, parts, _street_presence(edges, box, cells, "global_street_cell_presence_share"), _street_presence(local, box, cells, "global_local_street_cell_presence_share"),
        _junction_proximity(local, nodes, box), _district_presence(edges, districts, size),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.join(F.broadcast(r), F.lit(True))  # one row each
    out = out.withColumns({
        "physical_road_length_m": F.col("total"), "street_density_km_per_km2": F.col("total") * 1000.0 / F.nullif("convex_hull_area_m2", F.lit(0.0)), "block_continuity": 1.0 - F.col("cut") / F.col("total"),
        "bridge_length_share": F.col("cut") / F.col("total"), "connector_to_local_length_ratio": F.col("wide") / F.greatest("narrow", F.lit(1e-12)),
    })
    return cut(out.drop("total", "cut", "wide", "narrow"))


def gate(measures: DataFrame, style: Column) -> DataFrame:
    """measures with style, accepted, failures and advisories: names of the rules that a style's network breaks. Too dense a network is an advisory."""
    t, c = THRESHOLDS, F.col
    river, mixed = style == "river_constrained", style.isin("polycentric_tod", "superblock_mixed")
    rules = {
        "weak_component_count": c("weak_component_count") != 1,
        "global_local_street_cell_presence_share": c("global_local_street_cell_presence_share") < t["minimum_global_local_street_cell_presence_share"],
        "global_local_junction_proximity_share": c("global_local_junction_proximity_share") < t["minimum_global_local_junction_proximity_share"],
        "street_density_km_per_km2": c("street_density_km_per_km2") < t["minimum_street_density_km_per_km2"],
        "block_continuity": c("block_continuity") < t["minimum_block_continuity"],
        "degree_one_share": c("degree_one_share") > F.when(river, t["maximum_river_dead_end_share"]).otherwise(t["maximum_dead_end_share"]),
        "district_quadrant_presence_share": (c("district_count") > 0) & (c("district_quadrant_presence_share") < t["minimum_district_quadrant_presence_share"]),
        "mixed_grid_four_way_share": mixed & (c("degree_four_share") > t["maximum_mixed_grid_four_way_share"]),
        "river_block_continuity": river & (c("block_continuity") < t["minimum_river_block_continuity"]),
    }
    failures = F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))
    dense = F.array_compact(F.array(F.when(c("street_density_km_per_km2") > t["maximum_street_density_km_per_km2"], "street_density_km_per_km2")))
    return measures.withColumn("style", style).withColumn("failures", failures).withColumn("advisories", dense).withColumn("accepted", F.size("failures") == 0)


def audit(roads: DataFrame, size: float) -> DataFrame:
    """One row: what is wrong with roads (road_id, u, v, ax, ay, bx, by as whole numbers, layer).

    Connectedness; on one layer pairs that cross inside, pairs of collinear roads that overlap, ends that lie inside another road; repeated roads
    between the same nodes; places where roads of two layers end that have no node in common. Roads meet in the grid cells along them.
    """
    roads = cut(roads)
    cells = segment_cells(roads, size).select("cx", "cy", "layer", F.struct("road_id", "ax", "ay", "bx", "by").alias("s"))
    pairs = cells.withColumnRenamed("s", "p").join(cells.withColumnRenamed("s", "q"), ["cx", "cy", "layer"]).where("p.road_id < q.road_id").select("p", "q").distinct()
    a, b, c, d = (tuple(F.col(f"{s}.{e}{k}") for k in "xy") for s, e in (("p", "a"), ("p", "b"), ("q", "a"), ("q", "b")))
    sc, sd, sa, sb = _side(*a, *b, *c), _side(*a, *b, *d), _side(*c, *d, *a), _side(*c, *d, *b)
    crosses = (F.signum(sc) * F.signum(sd) < 0) & (F.signum(sa) * F.signum(sb) < 0)
    along = lambda p: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])
    length2 = along(b)
    overlap = (sc == 0) & (sd == 0) & (F.greatest(along(c), along(d)) > 0) & (F.least(along(c), along(d)) < length2)

    def inside(side: Column, p: tuple, e: tuple, f: tuple) -> Column:
        at = (p[0] - e[0]) * (f[0] - e[0]) + (p[1] - e[1]) * (f[1] - e[1])
        return ((side == 0) & (at > 0) & (at < (f[0] - e[0]) * (f[0] - e[0]) + (f[1] - e[1]) * (f[1] - e[1]))).cast("int")

    touch = inside(sc, c, a, b) + inside(sd, d, a, b) + inside(sa, a, c, d) + inside(sb, b, c, d)
    met = pairs.agg(F.count_if(crosses).alias("proper_crossings"), F.count_if(overlap).alias("collinear_overlaps"), F.coalesce(F.sum(touch), F.lit(0)).cast("long").alias("t_touches"))
    repeated = roads.groupBy("layer", F.least("u", "v"), F.greatest("u", "v")).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("repeated_roads"))
    ends = roads.select("layer", F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("v").alias("node"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("e"))
    false = ends.groupBy("e.x", "e.y").agg(F.count_distinct("layer").alias("k"), F.count_distinct("e.node").alias("n")).agg(F.count_if((F.col("k") > 1) & (F.col("n") > 1)).alias("false_junctions"))
    nodes = roads.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    whole = weak_components(nodes, roads).agg((F.count_distinct("root") == 1).alias("is_connected"))
    return whole.join(F.broadcast(met), F.lit(True)).join(F.broadcast(repeated), F.lit(True)).join(F.broadcast(false), F.lit(True))  # one row each
