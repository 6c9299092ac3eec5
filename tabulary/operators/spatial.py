"""Points near other points, and the regions that contain them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.functions.geo import EARTH_KM, great_circle_km, polygons, triangulate, turn_column, valid_location
from tabulary.functions.keys import number_key
from tabulary.session import table, written

TRIANGLES = "region bigint, parity boolean, ax double, ay double, bx double, by double, cx double, cy double"
#: Leaves of the hierarchy: one for so many triangles, at most MAX_LEAVES. Its split planes come from at most SPLIT_SAMPLE
#: triangles; every triangle is then sent to a leaf and the leaves' boxes are taken over all of them.
LEAF_TRIANGLES, MAX_LEAVES, SPLIT_SAMPLE = 16, 65_536, 200_000


def _triangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in TRIANGLES.split(", ")]
    for batch in batches:
        rows = []
        for region, geometry in zip(batch["region"], batch["geometry"], strict=True):
            for rings in polygons(geometry):
                triangles, parity = triangulate(rings)
                rows += [(region, parity, *a, *b, *c) for a, b, c in triangles]
        yield pd.DataFrame(rows, columns=columns)


class Hierarchy:
    """A bounding-volume hierarchy: split planes in heap order that send a triangle to its leaf, and boxes of all nodes."""

    def __init__(self, centres: np.ndarray, leaves: int):
        self.depth = max(0, math.ceil(math.log2(max(1, leaves))))
        self.planes = np.zeros(1 << self.depth)
        self.boxes = np.zeros((0, 4))
        groups = {1: centres}
        for node in range(1, 1 << self.depth):
            own, axis = groups.pop(node), (node.bit_length() - 1) % 2
            self.planes[node] = np.median(own[:, axis]) if len(own) else 0.0
            right = own[:, axis] > self.planes[node]
            groups[2 * node], groups[2 * node + 1] = own[~right], own[right]

    def leaf_of(self, centres: np.ndarray) -> np.ndarray:
        node = np.ones(len(centres), dtype=np.int64)
        for level in range(self.depth):
            node = 2 * node + (centres[:, level % 2] > self.planes[node])
        return node

    def set_boxes(self, leaves: pd.DataFrame) -> None:
        self.boxes = np.tile([np.inf, np.inf, -np.inf, -np.inf], (2 << self.depth, 1))
        self.boxes[leaves["leaf"].to_numpy()] = leaves[["x0", "y0", "x1", "y1"]].to_numpy()
        for node in range((1 << self.depth) - 1, 0, -1):
            a, b = self.boxes[2 * node], self.boxes[2 * node + 1]
            self.boxes[node] = [*np.minimum(a[:2], b[:2]), *np.maximum(a[2:], b[2:])]

    def candidates(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of point, leaf) for every leaf whose box holds the point."""
        at, node = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
        for level in range(self.depth + 1):
            box = self.boxes[node]
            inside = (x[at] >= box[:, 0]) & (y[at] >= box[:, 1]) & (x[at] <= box[:, 2]) & (y[at] <= box[:, 3])
            at, node = at[inside], node[inside]
            if level < self.depth:
                at, node = np.repeat(at, 2), np.repeat(2 * node, 2)
                node[1::2] += 1
        return at, node


def inside_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(key, region) for points (key bigint, lat, lon) and regions (region bigint, geometry GeoJSON, longitude first).

    Polygons become triangles by ear clipping; a bounding-volume hierarchy sends triangles and points to leaves, where
    they meet by an equi-join on the leaf and are tested exactly. Points and triangles may both be of any number:
    only the boxes of at most MAX_LEAVES leaves (4 MB) go to the tasks. A point in overlapping regions comes out with each; one
    that lies on nothing but boundaries counts for the lowest region among them. Null coordinates and null, empty or
    other geometries match nothing.
    """
    split = written(regions.select(F.col("region").cast("bigint").alias("region"), "geometry").where("geometry is not null").repartition("region").mapInPandas(_triangles, TRIANGLES), "triangles")
    n = split.count()
    centres = split.select(((F.col("ax") + F.col("bx") + F.col("cx")) / 3).alias("x"), ((F.col("ay") + F.col("by") + F.col("cy")) / 3).alias("y"))
    sample = (centres.sample(fraction=min(1.0, SPLIT_SAMPLE / n), seed=7) if n > SPLIT_SAMPLE else centres).limit(2 * SPLIT_SAMPLE).toPandas() if n else pd.DataFrame({"x": [], "y": []})
    tree = Hierarchy(sample[["x", "y"]].to_numpy(dtype=float), min(MAX_LEAVES, max(1, n // LEAF_TRIANGLES)))

    @F.pandas_udf("bigint")
    def leaf_of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf_of(np.column_stack([x, y])))

    placed = split.withColumn("leaf", leaf_of((F.col("ax") + F.col("bx") + F.col("cx")) / 3, (F.col("ay") + F.col("by") + F.col("cy")) / 3))
    corner = lambda f, c: f(f"a{c}", f"b{c}", f"c{c}")
    boxes = placed.groupBy("leaf").agg(F.min(corner(F.least, "x")).alias("x0"), F.min(corner(F.least, "y")).alias("y0"), F.max(corner(F.greatest, "x")).alias("x1"), F.max(corner(F.greatest, "y")).alias("y1")).toPandas()
    tree.set_boxes(boxes)

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, leaf = tree.candidates(batch["lon"].to_numpy(), batch["lat"].to_numpy())
            yield batch.iloc[at].assign(leaf=leaf)

    routed = points.where("lat is not null and lon is not null").select(F.col("key").cast("bigint").alias("key"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).mapInPandas(descend, "key bigint, lat double, lon double, leaf bigint")
    met = routed.join(placed, "leaf")
    px, py = F.col("lon"), F.col("lat")
    sides = [turn_column(F.col(f"{i}x"), F.col(f"{i}y"), F.col(f"{k}x"), F.col(f"{k}y"), px, py) for i, k in ("ab", "bc", "ca")]
    met = met.withColumn("low", F.least(*sides)).where("low >= 0")
    # ear clipping adds no points, so a point on an inner edge, and no point of the boundary, touches two triangles in the same edge
    end = lambda i: F.struct(F.col(f"{i}x").alias("x"), F.col(f"{i}y").alias("y"))
    touched = F.array(*[F.when(s == 0, F.array_sort(F.array(end(i), end(k)))) for s, (i, k) in zip(sides, ("ab", "bc", "ca"), strict=True)])
    edge = F.when(F.col("low") == 0, F.xxhash64(F.array_sort(F.array_compact(touched))))
    hits = met.select("key", "region", "parity", (F.col("low") > 0).alias("within"), edge.alias("edge"))
    per = hits.groupBy("key", "region").agg(
        F.bool_or(~F.col("parity") & F.col("within")).alias("within"), F.count_if(F.col("parity") & F.col("within")).alias("odd"),
        F.count_if(~F.col("parity") & ~F.col("within")).alias("touched"), F.count_distinct(F.when(~F.col("parity") & ~F.col("within"), F.col("edge"))).alias("edges"), F.count_if("parity").alias("fans"),
    )
    interior = F.col("within") | (F.col("odd") % 2 == 1) | (F.col("touched") > F.col("edges"))
    per = per.select("key", "region", interior.alias("interior"), ((F.col("touched") > 0) | (F.col("fans") > F.col("odd"))).alias("touch")).where("interior or touch")
    ranked = per.groupBy("key").agg(F.bool_or("interior").alias("any_interior"), F.collect_set(F.when(F.col("interior"), F.col("region"))).alias("own"), F.min(F.when(F.col("touch"), F.col("region"))).alias("lowest"))
    return ranked.select("key", F.explode(F.when(F.col("any_interior"), F.col("own")).otherwise(F.array("lowest"))).alias("region"))


def near_pairs(points: DataFrame, km: float) -> DataFrame:
    """(key_a, key_b, km) for different keys at most km apart on the earth's surface, key_a < key_b.

    points: (key, lat, lon), one row per key, all valid. Points fall into cubes of space whose edge is the chord of
    the distance, so neither the poles nor the date line are special; a pair lies in the same or in adjacent cubes,
    and each pair of cubes is joined once (14 of 27 neighbours). Points at the same place under different keys are
    pairs as well.
    """
    chord = 2 * EARTH_KM * math.sin(km / (2 * EARTH_KM)) * (1 + 1e-9)
    lat, lon = F.radians("lat"), F.radians("lon")
    cell = [F.floor(F.lit(EARTH_KM / chord) * part).cast("int") for part in (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))]
    placed = points.select("key", "lat", "lon", *[c.alias(n) for c, n in zip(cell, "xyz", strict=True)])
    half = [o for o in product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]
    offsets = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, ("dx", "dy", "dz"), strict=True)]) for o in half])
    left = placed.select(F.col("key").alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), "x", "y", "z", F.inline(offsets))
    left = left.select("a", "lat_a", "lon_a", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), (F.col("z") + F.col("dz")).alias("z"), ((F.col("dx") == 0) & (F.col("dy") == 0) & (F.col("dz") == 0)).alias("same"))
    pairs = left.join(placed, ["x", "y", "z"]).where(F.when(F.col("same"), F.col("a") < F.col("key")).otherwise(F.col("a") != F.col("key")))
    pairs = pairs.withColumn("km", great_circle_km(F.col("lat_a"), F.col("lon_a"), F.col("lat"), F.col("lon"))).where(F.col("km") <= km)
    return pairs.select(F.least("a", "key").alias("key_a"), F.greatest("a", "key").alias("key_b"), "km")


def ring_edges(regions: DataFrame) -> DataFrame:
    """(region, ord, x1, y1, x2, y2): the edges of all rings, holes too; ord is the order of the regions."""
    from tabulary.functions.geo import parts_of

    rings = regions.select("region", "ord", F.explode(F.flatten(parts_of(F.col("geometry")))).alias("ring"))
    pairs = rings.select("region", "ord", F.explode(F.arrays_zip(F.col("ring").alias("a"), F.concat(F.slice("ring", 2, 1 << 30), F.slice("ring", 1, 1)).alias("b"))).alias("e"))
    return pairs.select("region", "ord", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def nearest_region(points: DataFrame, regions: DataFrame, within_km: float, cell: float = 0.5) -> DataFrame:
    """(key, region, km): for each point (key, lat, lon) the region with the nearest edge within a distance, the first in order among equals.

    Edges and points meet in cells of `cell` degrees. An edge is entered in every cell its box, widened by the
    distance, touches; so a point finds in its own cell all edges that can be near enough. Close to a pole an edge is entered
    all the way round; points close to the date line are looked up from both of its sides.
    """
    from tabulary.functions.geo import segment_km

    degrees = within_km / 110.57
    reach = lambda lat: F.least(F.lit(360.0), F.lit(degrees) / F.cos(F.radians(F.least(F.lit(89.99), lat + degrees))))
    widen = reach(F.greatest(F.abs("y1"), F.abs("y2")))
    span = lambda a, b, w: F.sequence(F.floor((F.least(a, b) - w) / cell), F.floor((F.greatest(a, b) + w) / cell))
    edges = ring_edges(regions).withColumn("cx", F.explode(span(F.col("x1"), F.col("x2"), widen))).withColumn("cy", F.explode(span(F.col("y1"), F.col("y2"), F.lit(degrees))))
    seen = F.array_compact(F.array("lon", F.when(F.col("lon") > 180 - reach(F.abs("lat")), F.col("lon") - 360), F.when(F.col("lon") < reach(F.abs("lat")) - 180, F.col("lon") + 360)))
    placed = points.select("key", "lat", F.explode(seen).alias("lon")).select("key", "lat", "lon", F.floor(F.col("lon") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy"))
    km = segment_km(F.col("lon"), F.col("lat"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    met = placed.join(edges, ["cx", "cy"]).withColumn("km", km).where(F.col("km") <= within_km)
    return met.groupBy("key").agg(F.min(F.struct("km", "ord", "region")).alias("b")).select("key", "b.region", "b.km")


def located_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, lat, lon) of every pleiadesId with a valid location in some row; the lowest where rows disagree."""
    lat, lon = F.col("latitude"), F.col("longitude")
    rows = table(spark, sf_dir, "place_conflict_context").select(number_key("pleiadesId").alias("key"), lat.alias("lat"), lon.alias("lon")).where("key is not null").where(valid_location(F.col("lat"), F.col("lon")))
    return rows.groupBy("key").agg(F.min(F.struct("lat", "lon")).alias("p")).select("key", "p.lat", "p.lon")


def found(spark: SparkSession, sf_dir: str, km: float = 0.2) -> DataFrame:
    places = written(located_places(spark, sf_dir), "places")
    regions = table(spark, sf_dir, "province_polygon").select(F.col("geojsonId").alias("region"), "geometry")
    near = near_pairs(places, km).select(F.lit("near").alias("relation"), "key_a", "key_b")
    return near.unionByName(inside_regions(places, regions).select(F.lit("inside").alias("relation"), F.col("key").alias("key_a"), F.col("region").alias("key_b")))


FOUND_SQL = """
WITH p AS (
  SELECT TRY_CAST(TRY_CAST(trim(pleiadesId) AS DOUBLE) AS BIGINT) AS key, min(latitude) AS lat, min(longitude) AS lon FROM place_conflict_context
  WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0) AND TRY_CAST(trim(pleiadesId) AS DOUBLE) IS NOT NULL GROUP BY 1),
near AS (
  SELECT 'near' AS relation, a.key AS key_a, b.key AS key_b FROM p a JOIN p b ON a.key < b.key AND abs(a.lat - b.lat) < 0.01
  WHERE 2 * 6371.0088 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) <= 0.2),
rings AS (
  SELECT geojsonId, unnest(CAST(json_extract(geometry, '$.coordinates') AS DOUBLE[][][])) AS ring FROM province_polygon WHERE geometry IS NOT NULL AND json_extract_string(geometry, '$.type') = 'Polygon'
  UNION ALL
  SELECT geojsonId, unnest(part) FROM (SELECT geojsonId, unnest(CAST(json_extract(geometry, '$.coordinates') AS DOUBLE[][][][])) AS part FROM province_polygon WHERE json_extract_string(geometry, '$.type') = 'MultiPolygon')),
edges AS (SELECT geojsonId, ring[i][1] AS x1, ring[i][2] AS y1, ring[i + 1][1] AS x2, ring[i + 1][2] AS y2 FROM (SELECT geojsonId, ring, unnest(range(1, len(ring))) AS i FROM rings)),
inside AS (
  SELECT 'inside' AS relation, p.key AS key_a, e.geojsonId AS key_b FROM p JOIN edges e ON (e.y1 > p.lat) <> (e.y2 > p.lat)
  WHERE p.lon < e.x1 + (p.lat - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) GROUP BY 2, 3 HAVING count(*) % 2 = 1)
SELECT * FROM near UNION ALL SELECT * FROM inside
"""
