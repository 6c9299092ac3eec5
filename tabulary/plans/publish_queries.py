"""Published tables of the linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.functions.keys import number_key
from tabulary.operators import publish
from tabulary.operators.multivalue import packed_fields, split_values
from tabulary.operators.multivalue import FOUND_SQL as SPLIT_SQL
from tabulary.operators.pages import destination
from tabulary.operators.relational import keep_one
from tabulary.plans.text_queries import _CLEAN
from tabulary.session import table

_ONCE = "(SELECT DISTINCT * EXCLUDE (loadedAt) FROM place_conflict_context)"


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "place_conflict_context").dropDuplicates(["rowId"])


def _mention_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _context(spark, sf_dir).select("document", F.col("sourceLine").alias("line"), F.col("pleiadesName").alias("literal"), F.col("placeSource").alias("source"), "chapter", "office", "unit", F.col("declaredProvince").alias("direct"), F.col("hardProvince").alias("hard"), F.col("softProvince").alias("soft"), "region", F.array_compact(F.array("chapter", "region")).alias("titles"), "tier", "rowId")
    return keep_one(rows.where("literal is not null"), publish.KEY, F.asc("rowId"))


def build_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _mention_places(spark, sf_dir)
    mentions = places.select(*publish.KEY, (F.col("tier") < 2).alias("eligible"))
    return publish.occurrences(mentions, places).select("occurrence_id", "document", "line", "literal", "source", "expected", "context")


_EXPLICIT = _CLEAN(f"regexp_extract({_CLEAN('pleiadesName')}, '\\bin\\s+(.+)$', 1)")
OCCURRENCES_SQL = f"""
WITH k AS (SELECT * FROM {_ONCE} WHERE pleiadesName IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document, sourceLine, pleiadesName, placeSource ORDER BY rowId) = 1)
SELECT printf('OCC%06d', row_number() OVER (ORDER BY document, sourceLine, pleiadesName, placeSource)) AS occurrence_id, document, sourceLine AS line, pleiadesName AS literal, placeSource AS source,
  coalesce(CASE WHEN regexp_matches({_EXPLICIT}, '^\\p{{Lu}}') AND NOT regexp_matches({_EXPLICIT}, '(?i)\\b(castello|castris|barbarico)\\b') THEN {_EXPLICIT} END, nullif(trim(declaredProvince), ''), nullif(trim(hardProvince), ''), nullif(trim(softProvince), ''), '') AS expected, concat_ws(' / ', nullif(chapter, ''), nullif(region, '')) AS context
FROM k WHERE tier < 2 AND pleiadesName <> '' AND document IS NOT NULL AND sourceLine IS NOT NULL AND placeSource IS NOT NULL
"""


def publish_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = _context(spark, sf_dir).select(F.col("rowId").alias("ord"), F.col("pleiadesName").alias("place_name"), number_key("pleiadesId").alias("place_id"), "latitude", "longitude", F.col("featureType").alias("feature_type"), F.when(F.col("contextStatus").endswith("_MATCH"), "X").alias("match_type"))
    places = keep_one(table(spark, sf_dir, "pleiades_place").withColumn("place_id", number_key("pleiadesId")), ["place_id"], F.desc("createdAt"), F.desc("rowId")).select("place_id", "title", "latitude", "longitude", F.col("featureType").alias("feature_type"), "description", "uri")
    return publish.gazetteer(matches, places)


GAZETTEER_SQL = f"""
WITH m AS (SELECT *, TRY_CAST(TRY_CAST(trim(pleiadesId) AS DOUBLE) AS BIGINT) AS place_id FROM {_ONCE} WHERE TRY_CAST(trim(pleiadesId) AS DOUBLE) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pleiadesName, place_id ORDER BY rowId) = 1),
p AS (SELECT * FROM (SELECT *, CAST(pleiadesId AS BIGINT) AS place_id FROM (SELECT DISTINCT * EXCLUDE (loadedAt) FROM pleiades_place)) QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY createdAt DESC, rowId DESC) = 1),
j AS (SELECT trim(regexp_replace(m.pleiadesName, '\\s+', ' ', 'g'), ' ') AS place_name, m.place_id, coalesce(nullif(trim(title, ' '), ''), '') AS title, coalesce(m.latitude, p.latitude) AS latitude, coalesce(m.longitude, p.longitude) AS longitude,
  coalesce(nullif(trim(m.featureType), ''), nullif(trim(p.featureType), ''), '') AS feature_type, coalesce(nullif(trim(p.description), ''), '') AS description, coalesce(nullif(trim(uri), ''), '') AS uri, CASE WHEN contextStatus LIKE '%\\_MATCH' ESCAPE '\\' THEN 'confirmed' ELSE 'provisional' END AS confidence FROM m LEFT JOIN p USING (place_id))
SELECT *, printf('GAZ%05d', row_number() OVER (ORDER BY lower(place_name) NULLS FIRST, place_name NULLS FIRST, place_id, latitude NULLS FIRST)) AS gazetteer_id FROM j
"""


def publish_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _context(spark, sf_dir)
    matches = rows.where("occurrenceId is not null").select(F.col("rowId").alias("ord"), F.col("occurrenceId").alias("occurrence_id"), "document", F.col("sourceLine").alias("line"), "latitude", "longitude", number_key("pleiadesId").alias("place_id"))
    nodes = rows.select("document", F.col("sourceLine").alias("line"), F.col("rowId").cast("string").alias("node_id"), F.when(F.col("tier") == 0, "entry").otherwise("group").alias("node_type"), F.col("rowId").alias("ord"))
    return publish.confirmed(matches, nodes).select("occurrence_id", "place_id", "latitude", "longitude", "node_id")


CONFIRMED_SQL = f"""
WITH n AS (SELECT document, sourceLine AS line, arg_max(CAST(rowId AS VARCHAR), rowId) FILTER (tier = 0) AS pref, arg_min(CAST(rowId AS VARCHAR), rowId) AS first FROM {_ONCE} GROUP BY 1, 2),
f AS (SELECT * FROM {_ONCE} WHERE occurrenceId IS NOT NULL QUALIFY row_number() OVER (PARTITION BY occurrenceId ORDER BY rowId) = 1)
SELECT occurrenceId AS occurrence_id, TRY_CAST(TRY_CAST(trim(pleiadesId) AS DOUBLE) AS BIGINT) AS place_id, latitude, longitude, coalesce(pref, first, '') AS node_id FROM f LEFT JOIN n ON n.document = f.document AND n.line = f.sourceLine WHERE latitude IS NOT NULL AND longitude IS NOT NULL
"""


def governed_provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(1, "secunda", "second", "A; B", ""), (2, "maior", "greater", "C", "by size"), (3, "dux", "border", "D", "")], "priority int, pattern string, label string, provinces string, note string")
    return publish.governed(_context(spark, sf_dir).select(F.col("rowId").alias("id"), F.col("chapter").alias("text")), rules)


GOVERNED_SQL = f"""
SELECT id, r['label'] AS label, r['provinces'] AS provinces, r['note'] AS note FROM (SELECT rowId AS id, CASE WHEN contains(lower(chapter), 'secunda') THEN {{'label': 'second', 'provinces': 'A; B', 'note': ''}} WHEN contains(lower(chapter), 'maior') THEN {{'label': 'greater', 'provinces': 'C', 'note': 'by size'}}
  WHEN contains(lower(chapter), 'dux') THEN {{'label': 'border', 'provinces': 'D', 'note': ''}} END AS r FROM {_ONCE}) WHERE r IS NOT NULL
"""


def region_provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    polygons = table(spark, sf_dir, "province_polygon")
    regions = polygons.select(F.col("diocese").alias("region"), F.col("gisProvince").alias("province")).where("region is not null and province is not null")
    return publish.region_provinces(regions, polygons.where("geometry is not null").select(F.col("gisProvince").alias("province"))).select("region", F.array_join("provinces", "|").alias("provinces"), "mapped", "unresolved")


REGION_SQL = """
SELECT diocese AS region, string_agg(DISTINCT gisProvince, '|' ORDER BY gisProvince) AS provinces, count(DISTINCT gisProvince) FILTER (gisProvince IN (SELECT gisProvince FROM province_polygon WHERE geometry IS NOT NULL)) AS mapped,
  count(DISTINCT gisProvince) FILTER (gisProvince NOT IN (SELECT gisProvince FROM province_polygon WHERE geometry IS NOT NULL AND gisProvince IS NOT NULL)) AS unresolved FROM province_polygon WHERE diocese IS NOT NULL AND gisProvince IS NOT NULL GROUP BY 1
"""


def province_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per name packed in geojsonNames, at its position; a row without any has one, at position 0."""
    packed = packed_fields(table(spark, sf_dir, "province_gazetteer"), ["geojsonNames"]).select(F.col("row_id").alias("id"))
    named = split_values(packed_fields(table(spark, sf_dir, "province_gazetteer"), ["geojsonNames"])).select(F.col("row_id").alias("id"), "position", F.col("value").alias("name"))
    references = packed.join(named, "id", "left").select("id", F.coalesce("position", F.lit(0)).alias("position"), "name")
    matches = table(spark, sf_dir, "province_polygon").select(F.col("geojsonId").alias("ord"), F.col("gisProvince").alias("name"), F.col("geojsonId").cast("string").alias("polygon"))
    return publish.province_status(references.withColumn("id", F.struct("id", "position")), matches).select("id.id", "id.position", "polygon", "status")


_CR = lambda x: f"lower(trim(regexp_replace(regexp_replace(trim(coalesce({x}, ''), ' '), '[.:]+$', ''), '\\s+', ' ', 'g'), ' '))"
REFERENCES_SQL = f"""
WITH m AS (SELECT {_CR('gisProvince')} AS k, max(geojsonId) AS p FROM province_polygon GROUP BY 1), r AS (SELECT DISTINCT rowId AS id, {_CR("regexp_extract(geojsonNames, '^([^|;,]*)', 1)")} AS k, geojsonNames IS NULL AS none FROM province_gazetteer)
SELECT id, CASE WHEN none OR p IS NULL THEN '' ELSE CAST(p AS VARCHAR) END AS polygon, CASE WHEN none OR p IS NULL THEN 'UNMATCHED' ELSE 'MATCH' END AS status FROM r LEFT JOIN m USING (k)
"""


def province_references_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """province_references with its position as a plain column: the query that EACH_SQL checks."""
    return province_references(spark, sf_dir).select("id", F.col("position").cast("int").alias("position"), "polygon", "status")


EACH_SQL = f"""
WITH names AS (SELECT row_id, position, value FROM ({SPLIT_SQL}) WHERE field = 'geojsonNames'), m AS (SELECT {_CR('gisProvince')} AS k, max(geojsonId) AS p FROM province_polygon GROUP BY 1),
r AS (SELECT DISTINCT g.rowId AS id, coalesce(n.position, 0) AS position, CASE WHEN n.value IS NOT NULL THEN {_CR('n.value')} END AS k FROM province_gazetteer g LEFT JOIN names n ON n.row_id = g.rowId)
SELECT id, CAST(position AS INTEGER) AS position, coalesce(CAST(p AS VARCHAR), '') AS polygon, CASE WHEN p IS NULL THEN 'UNMATCHED' ELSE 'MATCH' END AS status FROM r LEFT JOIN m USING (k)
"""


def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _context(spark, sf_dir)
    return rows.select(F.col("rowId").alias("row_id"), destination(F.when(F.col("office") == "Comes", F.col("chapter")), F.when(F.col("tier") == 2, F.col("region")), F.when(F.col("tier") == 1, F.col("hardProvince")), F.coalesce("candidateRank", F.lit(0))).alias("leads_to"))


NAVIGATION_SQL = f"""
SELECT rowId AS row_id, CASE WHEN office = 'Comes' AND coalesce(chapter, '') <> '' THEN 'jurisdiction:' || chapter WHEN tier = 2 AND coalesce(region, '') <> '' THEN 'region:' || region WHEN tier = 1 AND coalesce(hardProvince, '') <> '' THEN 'province:' || hardProvince
  WHEN candidateRank > 1 THEN 'places' WHEN candidateRank = 1 THEN 'place' ELSE 'clear' END AS leads_to FROM {_ONCE}
"""


QUERIES = {
    "build_occurrences": build_occurrences, "publish_gazetteer": publish_gazetteer, "publish_confirmed": publish_confirmed, "governed_provinces": governed_provinces, "region_provinces": region_provinces, "province_references": province_references, "province_references_each": province_references_each, "navigation_destination": navigation,
}
SQL = {
    "build_occurrences": OCCURRENCES_SQL, "publish_gazetteer": GAZETTEER_SQL, "publish_confirmed": CONFIRMED_SQL, "governed_provinces": GOVERNED_SQL, "region_provinces": REGION_SQL, "province_references": REFERENCES_SQL, "province_references_each": EACH_SQL, "navigation_destination": NAVIGATION_SQL,
}
