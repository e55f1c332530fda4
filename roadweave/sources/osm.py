"""OpenStreetMap XML as road nodes and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from roadweave.functions import geometry as G
from roadweave.operators.lines import clip, simplify

#: Highway classes that carry cars, with the class, lanes and speed (m/s) they stand for.
HIGHWAYS = {
    "motorway": ("arterial", 3, 27.8), "trunk": ("arterial", 2, 25.0), "primary": ("arterial", 2, 16.7), "secondary": ("collector", 2, 13.9), "tertiary": ("collector", 1, 13.9),
    "unclassified": ("local", 1, 8.3), "residential": ("local", 1, 8.3), "living_street": ("local", 1, 2.8),
}
NODE = "_id long, _lat double, _lon double"
WAY = "_id long, nd array<struct<_ref: long>>, tag array<struct<_k: string, _v: string>>"

DOCUMENT = "node array<struct<_id: bigint, _lat: double, _lon: double>>, way array<struct<_id: bigint, nd: array<struct<_ref: bigint>>, tag: array<struct<_k: string, _v: string>>>>"


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: node_id, lat, lon; ways: way_id, refs, tags) of an OSM XML file. Rows are read in parallel by tag."""
    node = spark.read.format("xml").option("rowTag", "node").schema(NODE).load(path).select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    way = spark.read.format("xml").option("rowTag", "way").schema(WAY).load(path)
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k: string, _v: string>>")), lambda x: F.struct(x["_k"], x["_v"])))
    return node, way.select(F.col("_id").alias("way_id"), F.transform("nd", lambda x: x["_ref"]).alias("refs"), tags.alias("tags"))


def parse_osm(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """The same of a text; a document type declaration is refused."""
    if "<!DOCTYPE" in text.upper():
        raise ValueError("a document type declaration isn't read")
    doc = spark.createDataFrame([(text,)], "x string").select(F.from_xml("x", DOCUMENT).alias("d"))
    node = doc.select(F.explode("d.node").alias("n")).select(F.col("n._id").alias("node_id"), F.col("n._lat").alias("lat"), F.col("n._lon").alias("lon"))
    tags = F.map_from_entries(F.transform(F.coalesce("w.tag", F.array().cast("array<struct<_k: string, _v: string>>")), lambda x: F.struct(x["_k"], x["_v"])))
    way = doc.select(F.explode("d.way").alias("w")).select(F.col("w._id").alias("way_id"), F.transform("w.nd", lambda x: x["_ref"]).alias("refs"), tags.alias("tags"))
    return node, way


def compile_roads(nodes: DataFrame, ways: DataFrame, bounds: tuple[float, float, float, float] | None = None, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(road nodes: node_id, x, y; links: link_id, way_id, u, v, road_class, lanes, speed_mps, length_m, points).

    bounds (metres around the middle: least x, least y, most x, most y): only what lies in that box is kept; where the box cuts a road there is a node of its
    own, with a negative id by its place. tolerance: roads are simplified to so many metres.

    Drivable ways are cut where they share a node or end; longitudes unwrap around the first, and places are metres around the middle. A way that isn't one-way
    gives a link each way. A way with a missing node fails the compilation.
    """
    highway = F.try_element_at("tags", F.lit("highway"))
    drivable = ways.where(highway.isin(*HIGHWAYS) & (F.size("refs") > 1)).withColumn("highway", highway)
    points = drivable.select("way_id", F.posexplode("refs").alias("pos", "node_id"), F.size("refs").alias("n"))
    missing = points.join(nodes, "node_id", "left_anti").limit(1).count()
    if missing:
        raise ValueError("a way has a node that isn't there")
    if drivable.isEmpty():
        raise ValueError("no drivable way")
    used = nodes.join(points.select("node_id").distinct(), "node_id")
    anchor = used.agg(F.min_by("lon", "node_id").alias("anchor"))
    flat = used.crossJoin(F.broadcast(anchor)).withColumn("lon", G.unwrapped_longitude(F.col("lon"), F.col("anchor")))  # one row
    middle = flat.agg(F.avg("lon").alias("lon0"), F.avg("lat").alias("lat0"))
    placed = flat.crossJoin(F.broadcast(middle)).select("node_id", G.project(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0")).alias("p"))  # one row
    joints = points.groupBy("node_id").agg(F.count("*").alias("uses"), F.bool_or((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)).alias("end")).where("uses > 1 OR end").select("node_id", F.lit(True).alias("joint"))
    x = points.join(joints, "node_id", "left").join(placed, "node_id")
    w = Window.partitionBy("way_id").orderBy("pos")
    x = x.withColumn("part", F.sum(F.coalesce(F.col("joint").cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    # a joint ends one part and begins the next
    x = x.select("way_id", "pos", "node_id", "p", F.explode(F.when(F.coalesce("joint", F.lit(False)), F.array(F.coalesce("part", F.lit(0)), F.coalesce("part", F.lit(0)) + 1)).otherwise(F.array("part"))).alias("part"))
    parts = x.groupBy("way_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "p"))).alias("s")).where("size(s) > 1")
    parts = parts.join(drivable.select("way_id", "highway", F.try_element_at("tags", F.lit("oneway")).alias("oneway")), "way_id")
    kind = lambda k: F.coalesce(*[F.when(F.col("highway") == h, v[k]) for h, v in HIGHWAYS.items()])
    line = F.transform("s", lambda q: F.struct(q["p"]["x"].alias("x"), q["p"]["y"].alias("y")))
    kept = parts.select("way_id", "part", kind(0).alias("road_class"), kind(1).alias("lanes"), kind(2).alias("speed_mps"), line.alias("points"), F.element_at("s", 1)["node_id"].alias("a"), F.element_at("s", -1)["node_id"].alias("b"), F.coalesce("oneway", F.lit("no")).alias("oneway"))
    if bounds:
        whole = kept.withColumn("line_id", F.concat_ws("-", "way_id", "part"))
        pieces = clip(whole.select("line_id", "points"), bounds).withColumnRenamed("points", "inside")
        at = lambda i: (-F.abs(F.xxhash64(F.round(F.element_at("inside", i)["x"], 6), F.round(F.element_at("inside", i)["y"], 6)) % (1 << 62)) - 1)
        kept = whole.join(pieces, "line_id").withColumn("a", F.when(F.col("cut_start"), at(1)).otherwise(F.col("a"))).withColumn("b", F.when(F.col("cut_end"), at(-1)).otherwise(F.col("b")))
        kept = kept.withColumn("points", F.col("inside")).withColumn("part", F.concat_ws(".", "part", "fragment")).drop("inside", "line_id", "fragment", "cut_start", "cut_end")
        if kept.isEmpty():
            raise ValueError("no road lies in the box")
    ends = simplify(kept, tolerance)
    ends = ends.withColumn("length_m", G.line_length(F.col("points"))).where("length_m > 0")
    ahead = F.struct(F.lit(0).alias("back"), F.col("a").alias("u"), F.col("b").alias("v"), F.col("points").alias("points"))
    behind = F.struct(F.lit(1).alias("back"), F.col("b").alias("u"), F.col("a").alias("v"), F.reverse("points").alias("points"))
    ways_of = F.when(F.col("oneway").isin("yes", "true", "1"), F.array(ahead)).when(F.col("oneway") == "-1", F.array(behind)).otherwise(F.array(ahead, behind))
    links = ends.select("way_id", "part", "road_class", "lanes", "speed_mps", "length_m", F.explode(ways_of).alias("d"))
    links = links.select(F.concat_ws("-", "way_id", "part", "d.back").alias("link_id"), "way_id", "d.u", "d.v", "road_class", "lanes", "speed_mps", "length_m", "d.points")
    tips = links.select(F.explode(F.array(F.struct(F.col("u").alias("node_id"), F.element_at("points", 1).alias("p")), F.struct(F.col("v").alias("node_id"), F.element_at("points", -1).alias("p")))).alias("t"))
    road = tips.groupBy("t.node_id").agg(F.min("t.p").alias("p")).select("node_id", "p.x", "p.y")
    return road, links
