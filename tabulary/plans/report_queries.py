"""Aggregates, order, sets, rendering, audits, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.functions import rules as R
from tabulary.functions.text import norm_name
from tabulary.operators import audit, relational, render
from tabulary.session import scratch_path, table
from tabulary.sources import readers, writers

_ONCE = "(SELECT DISTINCT * EXCLUDE (loadedAt) FROM place_conflict_context)"


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "place_conflict_context").dropDuplicates(["rowId"])


def agg_count_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicates(table(spark, sf_dir, "orders"), "o_custkey")


def agg_first_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min_by("props", "event_id").alias("example"))


def agg_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("s"), F.count_distinct("l_suppkey").alias("suppliers"))
    return joined.select("l_orderkey", F.array_join(F.array_sort("s"), " | ").alias("flags"), "suppliers")


def agg_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("contextStatus")
    return _context(spark, sf_dir).groupBy("document").agg(F.count_if(status.endswith("MISMATCH")).alias("mismatches"), F.count_if(status.contains("NEAR")).alias("near"), F.coalesce(F.bool_or(F.col("tier") == 2), F.lit(False)).alias("any_second"), F.round(F.avg("nameSimilarity"), 6).alias("mean"))


def agg_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _context(spark, sf_dir).where("occurrenceId is not null").select(F.col("occurrenceId").alias("occ_id"), F.coalesce("contextStatus", F.lit("")).alias("context_status"), "latitude", "longitude", F.col("nameSimilarity").alias("similarity"))
    return audit.ambiguity_report(rows)


AMBIGUITY_SQL = f"""
SELECT occurrenceId AS occ_id, CASE WHEN count(*) FILTER (contextStatus IN ('HARD_MATCH', 'HARD_NEAR_MATCH')) > 0 THEN 'MULTIPLE_HARD_MATCH' WHEN count(*) FILTER (contextStatus IN ('SOFT_MATCH', 'SOFT_NEAR_MATCH')) > 0 THEN 'MULTIPLE_SOFT_MATCH'
  WHEN count(*) FILTER (nameSimilarity >= 0.999) >= 2 THEN 'MULTIPLE_EXACT_NAMES' WHEN count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) = 0 THEN 'NO_COORDINATES'
  WHEN count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) = 1 THEN 'ONE_COORDINATED_CANDIDATE' ELSE 'MULTIPLE_COORDINATED_CANDIDATES' END AS category, count(*) AS candidates
FROM {_ONCE} WHERE occurrenceId IS NOT NULL GROUP BY 1
"""


def top5_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.top_n(table(spark, sf_dir, "lineitem"), ["l_suppkey"], 5, F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")).select("l_suppkey", "rank", "l_orderkey", "l_linenumber")


def top_n_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.frequency(_context(spark, sf_dir), "chapter", 20, "rowId")


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.sequential_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "GAZ%07d", "gazetteer_id", F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "gazetteer_id")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keep_one(table(spark, sf_dir, "place_conflict_context"), ["pleiadesName", "latitude", "longitude"], F.asc("rowId"), F.asc("loadedAt")).select(F.col("rowId").alias("row_id"))


def multi_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of places in a case-blind order with numbers behind, lines without number last."""
    rows = _context(spark, sf_dir).select("document", F.col("rowId").alias("row_id"), F.lower(F.coalesce("pleiadesName", F.lit(""))).alias("name"), F.coalesce("sourceLine", F.lit(999_999)).alias("line"))
    return relational.positions(rows, ["document"], F.asc("name"), F.asc("line"), F.asc("row_id")).select("document", "row_id", "position")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _context(spark, sf_dir).select(norm_name(F.col("pleiadesName")).alias("name")), _context(spark, sf_dir).select(norm_name(F.col("candidate")).alias("name"))
    tag = lambda df, t: df.withColumn("part", F.lit(t))
    return tag(a.distinct().intersect(b.distinct()), "both").unionByName(tag(a.distinct().exceptAll(b.distinct()), "names only")).unionByName(tag(b.distinct().exceptAll(a.distinct()), "candidates only"))


_N = lambda x: f"trim(regexp_replace(lower(regexp_replace(regexp_replace(trim(regexp_replace(replace(replace(strip_accents(coalesce({x}, '')), 'æ', 'ae'), 'Æ', 'Ae'), '\\s+', ' ', 'g')), '^[ .,;:()\\[\\]-]+', ''), '[ .,;:()\\[\\]-]+$', '')), '[^a-z0-9]+', ' ', 'g'))"
SET_SQL = f"""
WITH a AS (SELECT DISTINCT {_N('pleiadesName')} AS name FROM place_conflict_context), b AS (SELECT DISTINCT {_N('candidate')} AS name FROM place_conflict_context)
SELECT name, 'both' AS part FROM a WHERE name IN (FROM b) UNION ALL SELECT name, 'names only' FROM a WHERE name NOT IN (FROM b) UNION ALL SELECT name, 'candidates only' FROM b WHERE name NOT IN (FROM a)
"""


def render_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English for composed workshop descriptors, one per part."""
    words = list(render.TERMS)
    pick = lambda shift: F.get(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") + shift) % len(words))
    descriptor = F.when(F.col("p_size") % 4 == 0, pick(0)).when(F.col("p_size") % 4 == 1, F.concat(pick(0), F.lit(" et "), pick(3))).when(F.col("p_size") % 4 == 2, F.concat(pick(0), F.lit(", "), pick(2), F.lit(" et "), F.lower("p_brand"))).otherwise("armorum omnium.")
    phrase = render.factory_phrase(descriptor)
    return table(spark, sf_dir, "part").select("p_partkey", phrase["phrase"].alias("phrase"), F.array_join(phrase["unresolved"], "|").alias("unresolved"))


_W = ", ".join(f"'{w}'" for w in render.TERMS)
_T = ", ".join(f"'{w}'" for w in render.TERMS.values())
RENDER_SQL = f"""
WITH p AS (SELECT p_partkey, p_size % 4 AS k, lower(p_brand) AS b, [{_T}][1 + p_partkey % {len(render.TERMS)}] AS a0, [{_T}][1 + (p_partkey + 3) % {len(render.TERMS)}] AS a3, [{_T}][1 + (p_partkey + 2) % {len(render.TERMS)}] AS a2 FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN a0 || ' factory' WHEN 1 THEN a0 || ' and ' || a3 || ' factory' WHEN 2 THEN a0 || ', ' || a2 || ' and ' || b || ' factory' ELSE 'factory for all kinds of arms' END AS phrase, CASE WHEN k = 2 THEN b ELSE '' END AS unresolved FROM p
"""


def render_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workshop and treasury entries merged by key, treasuries over workshops."""
    rows = _context(spark, sf_dir).withColumn("n", F.row_number().over(_by_key()))
    once = rows.where("n = 1")
    factories = render.factory_entries(once.select("document", F.col("sourceLine").alias("line"), F.concat_ws(" ", F.regexp_replace("placeName", "[.]$", ""), F.lit("scutaria")).alias("unit"), F.regexp_replace("placeName", "[.]$", "").alias("source_place"), F.when(F.col("tier") == 0, F.col("pleiadesName")).alias("place_name"), F.lit(None).cast("string").alias("pleiades_name"), F.col("declaredProvince").alias("province")))
    treasuries = once.where("office = 'Praepositus'").select("document", F.col("sourceLine").alias("line"), "office", F.col("pleiadesName").alias("place"), F.col("declaredProvince").alias("province"))
    overrides = spark.createDataFrame([("Augusta", "London")], "place string, english_place string")
    return render.upsert(factories, render.treasury_entries(treasuries, overrides)).select("entry_key", "status", F.array_join("notes", "; ").alias("notes"))


def _by_key():
    from pyspark.sql import Window as W

    return W.partitionBy("document", "sourceLine").orderBy("rowId")


RENDER_STATUS_SQL = f"""
WITH o AS (SELECT * FROM {_ONCE} QUALIFY row_number() OVER (PARTITION BY document, sourceLine ORDER BY rowId) = 1)
SELECT concat_ws(':', document, sourceLine) AS entry_key, CASE WHEN office = 'Praepositus' OR (tier = 0 AND pleiadesName <> '') THEN 'ok' WHEN coalesce(declaredProvince, '') <> '' THEN 'inferred_from_context' ELSE 'ok' END AS status,
  CASE WHEN office = 'Praepositus' OR (tier = 0 AND pleiadesName <> '') THEN '' ELSE 'place not in gazetteer' END AS notes FROM o
"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = R.eligibility_issues(F.col("office") == "Princeps", F.col("placeName"), F.col("contextText"), ["castra", "portus", "aquae"])
    return _context(spark, sf_dir).select("rowId", "document", F.col("sourceLine").alias("line"), F.col("placeName").alias("literal"), F.col("placeSource").alias("source"), issues.alias("issues")).withColumn("eligible", F.size("issues") == 0)


def audit_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.mention_report(_mentions(spark, sf_dir))


_MENTIONS = f"""
WITH m AS (SELECT rowId, document, sourceLine AS line, placeName AS literal, placeSource AS source, lower(trim(coalesce(placeName, ''), ' ')) AS lit, lower(coalesce(contextText, '')) AS src, coalesce(office = 'Princeps', false) AS staff FROM {_ONCE}),
i AS (SELECT *, list_filter([CASE WHEN staff THEN 'PLACE_INSIDE_OFFICIUM' END, CASE WHEN lit = '' THEN 'EMPTY_PLACE' END, CASE WHEN lit <> '' AND src <> '' AND NOT contains(src, lit) THEN 'LITERAL_NOT_IN_SOURCE' END,
  CASE WHEN list_has_any(regexp_extract_all(lit, '[a-z]+'), ['castra', 'portus', 'aquae']) THEN 'ADMIN_WORD_IN_PLACE' END], lambda x: x IS NOT NULL) AS issues FROM m)
"""
AUDIT_SQL = _MENTIONS + """
SELECT 'total' AS section, 'mentions' AS key, count(*) AS value FROM i UNION ALL SELECT 'total', 'literal forms', count(DISTINCT literal) FROM i UNION ALL SELECT 'total', 'eligible', count(*) FILTER (len(issues) = 0) FROM i UNION ALL SELECT 'total', 'under review', count(*) FILTER (len(issues) > 0) FROM i
UNION ALL SELECT 'total', 'lines with several mentions', count(*) FROM (SELECT 1 FROM i GROUP BY document, line HAVING count(*) > 1)
UNION ALL SELECT 'document', document, count(*) FROM i GROUP BY document UNION ALL SELECT 'source', source, count(*) FROM i GROUP BY source UNION ALL SELECT 'issue', x, count(*) FROM (SELECT unnest(issues) AS x FROM i) GROUP BY x
"""


def audit_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir).select(F.col("rowId").alias("row_id"), F.coalesce(F.get(F.reverse("issues"), F.lit(0)), F.lit("")).alias("issue"))


def audit_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.geography_report(_context(spark, sf_dir), "placeSource", "contextStatus")


def audit_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.keyword_rows(_context(spark, sf_dir), ["secunda", "salutaris"], ["chapter", "region"], ["rowId"]).select(F.col("rowId").alias("row_id"))


def audit_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulary.plans.link_queries import join_update_blanks

    return audit.before_after(_context(spark, sf_dir), join_update_blanks(spark, sf_dir), "latitude")


def assert_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = relational.assert_unique(table(spark, sf_dir, "orders"), ["o_orderkey"])
    return relational.missing_keys(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), orders, ["o_custkey"])


def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, and the row of one key: what an id lookup and a full listing give."""
    docs = table(spark, sf_dir, "documents")
    first = docs.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("all_rows"))
    return docs.join(F.broadcast(first), "doc_id").select("doc_id", "source", "all_rows")


def filter_array_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.split(F.coalesce("geoObjectIds", F.lit("")), r"[;,|\s]+")
    return table(spark, sf_dir, "province_gazetteer").dropDuplicates(["rowId"]).where(F.arrays_overlap(ids, F.array(F.lit("1"), F.lit("22"), F.lit("34")))).select(F.col("rowId").alias("row_id"))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gazetteer written as ; delimited text with quotes and line breaks, and read back with a sniffed delimiter."""
    rows = table(spark, sf_dir, "province_gazetteer").dropDuplicates(["rowId"])
    path = scratch_path(spark, "csv")
    writers.write_delimited(rows, path, ["rowId", "canonicalName", "notitiaForms", "geojsonNames"], sep=";")
    back = readers.read_delimited(spark, path)
    return back.select(F.col("rowId").cast("bigint").alias("row_id"), F.coalesce("canonicalName", F.lit("")).alias("name"), F.length(F.coalesce("notitiaForms", F.lit(""))).alias("forms"), F.md5(F.coalesce("geojsonNames", F.lit(""))).alias("names"))


def json_graph_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events packed as JSON graphs, a graph per user, and taken apart again."""
    graphs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("title"))).alias("@graph"))).alias("text"))
    records = readers.graph_records(graphs)
    return records.select(F.try_variant_get("record", "$.id", "bigint").alias("id"), F.try_variant_get("record", "$.title", "string").alias("title"))


def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "province_polygon")
    feature = F.concat(F.lit('{"type":"Feature","properties":{"PROV_NAME":"'), F.coalesce("gisProvince", F.lit("")), F.lit('","OBJECTID":"'), F.col("geojsonId").cast("string"), F.lit('"},"geometry":'), F.coalesce("geometry", F.lit("null")), F.lit("}"))
    texts = rows.groupBy("diocese").agg(F.concat(F.lit('{"features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("text"))
    from tabulary.functions.geo import first_property

    found = readers.geo_features(texts)
    return found.select(first_property(F.col("properties"), "geojsonId", "OBJECTID").cast("bigint").alias("region"), first_property(F.col("properties"), "NAME", "PROV_NAME").alias("name"), F.get_json_object("geometry", "$.type").alias("kind"))


def json_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "place_name_list").select(F.col("name_id").cast("string").alias("key"), F.col("canonical_name").alias("name"))
    out = writers.json_entries(rows, "key", {"version": "1"})
    parsed = out.select(F.from_json("value", "key string, entry struct<name:string>, metadata map<string,string>").alias("j"))
    return parsed.select("j.key", F.coalesce("j.entry.name", F.concat(F.lit("version "), F.col("j.metadata")["version"])).alias("name"))


QUERIES = {
    "agg_count_having": agg_count_having, "agg_first_example": agg_first_example, "agg_set_join": agg_set_join, "agg_conditional": agg_conditional, "agg_ambiguity": agg_ambiguity, "top5_per_group": top5_per_group, "top_n_frequency": top_n_frequency, "stable_ids": stable_ids,
    "dedup_first_last": dedup_first, "multi_key_order": multi_key_order, "set_distinct_union_except": set_operations, "render_phrase": render_phrase, "render_status": render_status, "audit_mentions": audit_mentions, "audit_eligibility": audit_eligibility, "audit_geography": audit_geography,
    "audit_keywords": audit_keywords, "audit_before_after": audit_before_after, "assert_complete": assert_complete, "key_lookup": key_lookup, "filter_array_overlap": filter_array_overlap, "csv_roundtrip": csv_roundtrip, "json_graph_explode": json_graph_explode,
    "geojson_features": geojson_features, "json_entries": json_entries,
}
SQL = {
    "agg_count_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1", "agg_first_example": "SELECT event_type, count(*) AS n, arg_min(props, event_id) AS example FROM events GROUP BY 1",
    "agg_set_join": "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ' | ' ORDER BY l_returnflag) AS flags, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
    "agg_conditional": f"SELECT document, count(*) FILTER (contextStatus LIKE '%MISMATCH') AS mismatches, count(*) FILTER (contains(contextStatus, 'NEAR')) AS near, coalesce(bool_or(tier = 2), false) AS any_second, round(avg(nameSimilarity), 6) AS mean FROM {_ONCE} GROUP BY 1",
    "agg_ambiguity": AMBIGUITY_SQL,
    "top5_per_group": "SELECT l_suppkey, CAST(row_number() OVER w AS INTEGER) AS rank, l_orderkey, l_linenumber FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) QUALIFY row_number() OVER w <= 5",
    "top_n_frequency": f"SELECT chapter, count(*) AS count, min(rowId) AS first FROM {_ONCE} WHERE chapter IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT 20", "stable_ids": "SELECT o_orderkey, printf('GAZ%07d', row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)) AS gazetteer_id FROM orders",
    "dedup_first_last": "SELECT min(rowId) AS row_id FROM place_conflict_context GROUP BY pleiadesName, latitude, longitude", "multi_key_order": f"SELECT document, rowId AS row_id, row_number() OVER (PARTITION BY document ORDER BY lower(coalesce(pleiadesName, '')), coalesce(sourceLine, 999999), rowId) AS position FROM {_ONCE}",
    "set_distinct_union_except": SET_SQL, "render_phrase": RENDER_SQL, "render_status": RENDER_STATUS_SQL, "audit_mentions": AUDIT_SQL, "audit_eligibility": _MENTIONS + "SELECT rowId AS row_id, coalesce(issues[-1], '') AS issue FROM i",
    "audit_geography": f"SELECT placeSource, contextStatus, count(*) AS n FROM {_ONCE} GROUP BY ROLLUP (placeSource, contextStatus)", "audit_keywords": f"SELECT rowId AS row_id FROM {_ONCE} WHERE contains({_N('concat_ws(chr(32), chapter, region)')}, 'secunda') OR contains({_N('concat_ws(chr(32), chapter, region)')}, 'salutaris')",
    "audit_before_after": f"WITH s AS (SELECT CAST(pleiadesId AS BIGINT) AS key, latitude FROM (SELECT DISTINCT * EXCLUDE (loadedAt) FROM pleiades_place) QUALIFY row_number() OVER (PARTITION BY CAST(pleiadesId AS BIGINT) ORDER BY createdAt DESC, rowId DESC) = 1) SELECT 'before' AS stage, count(*) FILTER (latitude IS NULL) AS missing FROM {_ONCE} UNION ALL SELECT 'after', count(*) FILTER (coalesce(t.latitude, s.latitude) IS NULL) FROM {_ONCE} t LEFT JOIN s ON s.key = TRY_CAST(TRY_CAST(trim(t.pleiadesId) AS DOUBLE) AS BIGINT)",
    "assert_complete": "SELECT c_custkey AS o_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "key_lookup": "SELECT doc_id, source, (SELECT count(*) FROM documents) AS all_rows FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)",
    "filter_array_overlap": "SELECT DISTINCT rowId AS row_id FROM province_gazetteer WHERE list_has_any(string_split_regex(coalesce(geoObjectIds, ''), '[;,|\\s]+'), ['1', '22', '34'])",
    "csv_roundtrip": "SELECT DISTINCT rowId AS row_id, coalesce(canonicalName, '') AS name, CAST(length(coalesce(notitiaForms, '')) AS INTEGER) AS forms, md5(coalesce(geojsonNames, '')) AS names FROM province_gazetteer", "json_graph_explode": "SELECT event_id AS id, event_type AS title FROM events",
    "geojson_features": "SELECT geojsonId AS region, coalesce(gisProvince, '') AS name, json_extract_string(geometry, '$.type') AS kind FROM province_polygon WHERE geometry IS NOT NULL", "json_entries": "SELECT CAST(name_id AS VARCHAR) AS key, canonical_name AS name FROM place_name_list UNION ALL SELECT NULL, 'version 1'",
}
