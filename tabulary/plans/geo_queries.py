"""Points, regions and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.functions.geo import in_geometry, parts_of, valid_location
from tabulary.operators.spatial import FOUND_SQL, inside_regions, located_places, nearest_region
from tabulary.session import table, written

_EDGES = FOUND_SQL.split("near AS (")[0].rstrip().rstrip(",") + ", rings AS (" + FOUND_SQL.split("rings AS (", 1)[1].split("inside AS (")[0].rstrip().rstrip(",")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "province_polygon").select(F.col("geojsonId").alias("region"), F.col("geojsonId").alias("ord"), "geometry").where("geometry is not null")


def geo_pip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment by the even-odd test of every ring, behind a join on boxes in cells of a degree; geometries are joined to the pairs left, never copied into cells."""
    cells = lambda lo, hi: F.sequence(F.floor(lo), F.floor(hi))
    shapes = _regions(spark, sf_dir).withColumn("parts", parts_of(F.col("geometry"))).withColumn("points", F.flatten(F.flatten("parts")))
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    boxed = shapes.select("region", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    tiled = boxed.withColumn("cx", F.explode(cells(F.col("x0"), F.col("x1")))).withColumn("cy", F.explode(cells(F.col("y0"), F.col("y1"))))
    places = located_places(spark, sf_dir).withColumn("cx", F.floor("lon")).withColumn("cy", F.floor("lat"))
    met = places.join(tiled, ["cx", "cy"]).where("lon between x0 and x1 and lat between y0 and y1")
    met = met.select("key", "lat", "lon", "region").join(shapes.select("region", "parts"), "region")
    return met.where(in_geometry(F.col("lon"), F.col("lat"), F.col("parts"))).select("key", "region")


GEO_PIP_SQL = _EDGES + " SELECT p.key, e.geojsonId AS region FROM p JOIN edges e ON (e.y1 > p.lat) <> (e.y2 > p.lat) WHERE p.lon < e.x1 + (p.lat - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) GROUP BY 1, 2 HAVING count(*) % 2 = 1"


def geo_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For places in no region, the region with the nearest edge within 15 km."""
    places = written(located_places(spark, sf_dir), "places")
    outside = places.join(inside_regions(places, _regions(spark, sf_dir)), "key", "left_anti")
    return nearest_region(outside, _regions(spark, sf_dir), 15.0).select("key", "region", F.round("km", 4).alias("km"))


GEO_NEAREST_SQL = _EDGES + """
, outside AS (SELECT * FROM p WHERE key NOT IN (SELECT p.key FROM p JOIN edges e ON (e.y1 > p.lat) <> (e.y2 > p.lat) WHERE p.lon < e.x1 + (p.lat - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) GROUP BY p.key, e.geojsonId HAVING count(*) % 2 = 1)),
v AS (SELECT key, geojsonId, 111.32 * cos(radians(lat)) * (x1 - lon) AS ax, 110.57 * (y1 - lat) AS ay, 111.32 * cos(radians(lat)) * (x2 - lon) AS bx, 110.57 * (y2 - lat) AS b_y FROM outside, edges),
t AS (SELECT *, CASE WHEN (bx - ax) ** 2 + (b_y - ay) ** 2 = 0 THEN 0 ELSE greatest(0, least(1, -(ax * (bx - ax) + ay * (b_y - ay)) / ((bx - ax) ** 2 + (b_y - ay) ** 2))) END AS f FROM v),
d AS (SELECT key, geojsonId, min(sqrt((ax + f * (bx - ax)) ** 2 + (ay + f * (b_y - ay)) ** 2)) AS km FROM t GROUP BY 1, 2)
SELECT key, geojsonId AS region, round(km, 4) AS km FROM d WHERE km <= 15.0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY km, geojsonId) = 1
"""


def geo_places_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places per region and how many stand at distinct points."""
    places = written(located_places(spark, sf_dir), "places")
    inside = inside_regions(places, _regions(spark, sf_dir)).join(places, "key")
    return inside.groupBy("region").agg(F.count("*").alias("places"), F.count_distinct("lat", "lon").alias("points"))


GEO_PLACES_SQL = GEO_PIP_SQL.replace("SELECT p.key, e.geojsonId AS region FROM p JOIN", ", i AS (SELECT p.key, p.lat, p.lon, e.geojsonId AS region FROM p JOIN").replace("GROUP BY 1, 2 HAVING", "GROUP BY ALL HAVING") + ") SELECT region, count(*) AS places, count(DISTINCT (lat, lon)) AS points FROM i GROUP BY 1"


def geo_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "place_conflict_context").where(valid_location(F.col("latitude"), F.col("longitude")))
    return rows.groupBy("gisProvince").agg(F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east"))


def coord_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "place_conflict_context").dropDuplicates(["rowId"])
    return once.groupBy(valid_location(F.col("latitude"), F.col("longitude")).alias("valid")).agg(F.count("*").alias("n"))


_VALID = "coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0), false)"
QUERIES = {"geo_pip": geo_pip, "geo_nearest": geo_nearest, "geo_places_in_region": geo_places_in_region, "geo_bounds": geo_bounds, "coord_guard": coord_guard}
SQL = {
    "geo_pip": GEO_PIP_SQL, "geo_nearest": GEO_NEAREST_SQL, "geo_places_in_region": GEO_PLACES_SQL, "geo_bounds": f"SELECT gisProvince, min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east FROM place_conflict_context WHERE {_VALID} GROUP BY 1",
    "coord_guard": f"SELECT {_VALID} AS valid, count(*) AS n FROM (SELECT DISTINCT rowId, latitude, longitude FROM place_conflict_context) GROUP BY 1",
}
