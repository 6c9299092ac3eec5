"""References to records that do not exist or were not in force, and what hangs on the records that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.functions.keys import number_key, period
from tabulary.operators.multivalue import packed_fields, split_values
from tabulary.session import table, written


def direct_orphans(references: DataFrame, targets: DataFrame) -> DataFrame:
    """The references (source_table, row_id, field, target, ref_key, at) with no row in force in targets (target, key, created, ended).

    In force: created at or before `at` and not ended at or before it; a null end is none. A null ref_key is no
    reference. With a null `at`, or a target row without creation time, nothing is in force. Empty targets make
    every reference an orphan. One anti-join over all tables; a hot key only splits the left side.
    """
    lives = targets.select(F.col("target").alias("_target"), F.col("key").alias("_key"), "created", "ended").where("key is not null and created is not null").distinct()
    on = (F.col("target") == F.col("_target")) & (F.col("ref_key") == F.col("_key")) & (F.col("created") <= F.col("at")) & (F.col("ended").isNull() | (F.col("ended") > F.col("at")))
    return references.where("ref_key is not null").join(lives, on, "left_anti")


def cascade(direct: DataFrame, records: DataFrame, links: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Orphaned records with their distance from a broken reference: (source_table, row_id, level), 0 being direct.

    records: (source_table, row_id, own_key), links: (source_table, row_id, parent_table, parent_key). Each round the
    children of the records orphaned last are semi-joined by parent key; records already known drop out, so cycles
    end. Every round is written to the shared folder, which cuts lineage. max_rounds only guards against links that
    are deeper; it raises, and never returns part of the result.
    """
    keyed = records.where("own_key is not null")
    frontier = written(direct.select("source_table", "row_id").distinct().withColumn("level", F.lit(0)), "orphans")
    known = frontier
    for level in range(1, max_rounds + 1):
        keys = keyed.join(frontier, ["source_table", "row_id"], "left_semi").select(F.col("source_table").alias("parent_table"), F.col("own_key").alias("parent_key")).distinct()
        reached = links.join(keys, ["parent_table", "parent_key"], "left_semi").select("source_table", "row_id").distinct()
        frontier = written(reached.join(known, ["source_table", "row_id"], "left_anti").withColumn("level", F.lit(level)), "orphans")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
    raise ValueError(f"the cascade has more than {max_rounds} rounds")


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = table(spark, sf_dir, "place_conflict_context").select("rowId", "pleiadesId", "geojsonId", "extractedAt").dropDuplicates(["rowId"])
    gazetteer = table(spark, sf_dir, "province_gazetteer")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("target"), number_key(f).alias("ref_key")) for f, t in (("pleiadesId", "pleiades_place"), ("geojsonId", "province_polygon"))])
    own = context.select(F.lit("place_conflict_context").alias("source_table"), F.col("rowId").alias("row_id"), F.inline(pairs), F.col("extractedAt").alias("at"))
    at = gazetteer.select(F.col("rowId").alias("row_id"), F.col("extractedAt").alias("at")).dropDuplicates(["row_id"])
    packed = split_values(packed_fields(gazetteer, ["geoObjectIds"])).join(at, "row_id")
    packed = packed.select(F.lit("province_gazetteer").alias("source_table"), "row_id", "field", F.lit("province_polygon").alias("target"), number_key("value").alias("ref_key"), "at")
    return own.unionByName(packed)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = table(spark, sf_dir, "pleiades_place").select(F.lit("pleiades_place").alias("target"), number_key("pleiadesId").alias("key"), F.col("createdAt").alias("created"), F.col("deletedAt").alias("ended"))
    polygon = table(spark, sf_dir, "province_polygon").select(F.lit("province_polygon").alias("target"), F.col("geojsonId").cast("bigint").alias("key"), F.col("createdAt").alias("created"), F.col("retiredAt").alias("ended"))
    return place.unionByName(polygon)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    orphans = direct_orphans(_references(spark, sf_dir), _targets(spark, sf_dir))
    return orphans.select("source_table", "row_id", "field", "ref_key", period("at").alias("period"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans per table and month: rows that name an orphaned gazetteer province inherit."""
    direct = direct_orphans(_references(spark, sf_dir), _targets(spark, sf_dir)).select("source_table", "row_id")
    context = table(spark, sf_dir, "place_conflict_context").select("rowId", "expectedProvince", "extractedAt").dropDuplicates(["rowId"])
    gazetteer = table(spark, sf_dir, "province_gazetteer").select("rowId", "canonicalName", "extractedAt").dropDuplicates(["rowId"])
    match = table(spark, sf_dir, "province_pleiades_match").select("rowId", "provinceName", "extractedAt").dropDuplicates(["rowId"])
    records = gazetteer.select(F.lit("province_gazetteer").alias("source_table"), F.col("rowId").alias("row_id"), F.col("canonicalName").alias("own_key"))
    link = lambda df, name, key: df.where(F.col(key).isNotNull()).select(F.lit(name).alias("source_table"), F.col("rowId").alias("row_id"), F.lit("province_gazetteer").alias("parent_table"), F.col(key).alias("parent_key"))
    links = link(context, "place_conflict_context", "expectedProvince").unionByName(link(match, "province_pleiades_match", "provinceName"))
    months = None
    for df, name in ((context, "place_conflict_context"), (gazetteer, "province_gazetteer"), (match, "province_pleiades_match")):
        own = df.select(F.lit(name).alias("source_table"), F.col("rowId").alias("row_id"), period("extractedAt").alias("period"))
        months = own if months is None else months.unionByName(own)
    levels = cascade(direct, records, links)
    return levels.join(months, ["source_table", "row_id"]).groupBy("source_table", "period").agg(F.count_if(F.col("level") == 0).alias("direct"), F.count_if(F.col("level") > 0).alias("inherited"))


def inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, level, n): how many records of each table are orphaned directly (0) or at how many steps from a broken reference.

    The key graph: match and context rows hang on the gazetteer's provinces, context rows also on match rows by place,
    and gazetteer provinces on context rows that declare them, so the graph has a cycle and chains of any length.
    """
    direct = direct_orphans(_references(spark, sf_dir), _targets(spark, sf_dir)).select("source_table", "row_id")
    once = {n: table(spark, sf_dir, n).dropDuplicates(["rowId"]) for n in ("place_conflict_context", "province_gazetteer", "province_pleiades_match")}
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), c.cast("string") if not isinstance(c, str) else F.col(c))
    record = lambda name, k: once[name].select(F.lit(name).alias("source_table"), F.col("rowId").alias("row_id"), k.alias("own_key"))
    link = lambda name, parent, k: once[name].select(F.lit(name).alias("source_table"), F.col("rowId").alias("row_id"), F.lit(parent).alias("parent_table"), k.alias("parent_key")).where("parent_key is not null")
    gazetteer, match, context = "province_gazetteer", "province_pleiades_match", "place_conflict_context"
    records = record(gazetteer, key("name", "canonicalName")).unionByName(record(match, key("place", number_key("pleiadesId")))).unionByName(record(context, key("name", "declaredProvince")))
    links = [
        link(match, gazetteer, key("name", "provinceName")), link(context, gazetteer, key("name", "expectedProvince")), link(context, match, key("place", number_key("pleiadesId"))), link(gazetteer, context, key("name", "canonicalName")),
    ]
    levels = cascade(direct, records, links[0].unionByName(links[1]).unionByName(links[2]).unionByName(links[3]))
    return levels.groupBy("source_table", "level").agg(F.count("*").alias("n"))


_ORPHANS_SQL = """
WITH refs AS (
  SELECT DISTINCT 'place_conflict_context' AS source_table, rowId AS row_id, 'pleiadesId' AS field, 'pleiades_place' AS target, 0 AS pos,
         TRY_CAST(TRY_CAST(trim(pleiadesId) AS DOUBLE) AS BIGINT) AS ref_key, extractedAt AS seen_at FROM place_conflict_context
  UNION ALL
  SELECT DISTINCT 'place_conflict_context', rowId, 'geojsonId', 'province_polygon', 0, TRY_CAST(TRY_CAST(trim(geojsonId) AS DOUBLE) AS BIGINT), extractedAt FROM place_conflict_context
  UNION ALL
  SELECT 'province_gazetteer', row_id, 'geoObjectIds', 'province_polygon', generate_subscripts(ids, 1), CAST(unnest(ids) AS BIGINT), seen_at
  FROM (SELECT DISTINCT rowId AS row_id, regexp_extract_all(geoObjectIds, '[0-9]+') AS ids, extractedAt AS seen_at FROM province_gazetteer WHERE geoObjectIds IS NOT NULL)),
lives AS (
  SELECT 'pleiades_place' AS target, CAST(pleiadesId AS BIGINT) AS key, createdAt AS created, deletedAt AS ended FROM pleiades_place
  UNION ALL SELECT 'province_polygon', geojsonId, createdAt, retiredAt FROM province_polygon),
orphans AS (
  SELECT r.* FROM refs r WHERE ref_key IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM lives l WHERE l.target = r.target AND l.key = r.ref_key AND l.created <= r.seen_at AND (l.ended IS NULL OR l.ended > r.seen_at)))
"""
FOUND_SQL = _ORPHANS_SQL + "SELECT source_table, row_id, field, ref_key, strftime(seen_at, '%Y-%m') AS period FROM orphans"
REPORT_SQL = _ORPHANS_SQL + """, d AS (SELECT DISTINCT source_table, row_id FROM orphans),
bad AS (SELECT DISTINCT canonicalName AS name FROM province_gazetteer g JOIN d ON d.source_table = 'province_gazetteer' AND d.row_id = g.rowId WHERE canonicalName IS NOT NULL),
all_rows AS (
  SELECT DISTINCT 'place_conflict_context' AS source_table, rowId AS row_id, expectedProvince AS name, extractedAt AS seen_at FROM place_conflict_context
  UNION ALL SELECT DISTINCT 'province_pleiades_match', rowId, provinceName, extractedAt FROM province_pleiades_match
  UNION ALL SELECT DISTINCT 'province_gazetteer', rowId, NULL, extractedAt FROM province_gazetteer),
marked AS (
  SELECT a.source_table, strftime(a.seen_at, '%Y-%m') AS period, EXISTS (SELECT 1 FROM d WHERE d.source_table = a.source_table AND d.row_id = a.row_id) AS is_direct,
         a.name IN (SELECT name FROM bad) AS is_child FROM all_rows a)
SELECT source_table, period, count(*) FILTER (is_direct) AS direct, count(*) FILTER (NOT is_direct AND is_child) AS inherited
FROM marked WHERE is_direct OR is_child GROUP BY 1, 2
"""
INHERITED_SQL = _ORPHANS_SQL.replace("WITH refs", "WITH RECURSIVE refs", 1) + """, d AS (SELECT DISTINCT source_table, row_id FROM orphans),
own AS (SELECT DISTINCT 'province_gazetteer' AS t, rowId AS r, 'name:' || canonicalName AS k FROM province_gazetteer UNION ALL SELECT DISTINCT 'province_pleiades_match', rowId, 'place:' || TRY_CAST(TRY_CAST(trim(pleiadesId) AS DOUBLE) AS BIGINT) FROM province_pleiades_match
  UNION ALL SELECT DISTINCT 'place_conflict_context', rowId, 'name:' || declaredProvince FROM place_conflict_context),
up AS (SELECT DISTINCT 'province_pleiades_match' AS t, rowId AS r, 'province_gazetteer' AS pt, 'name:' || provinceName AS pk FROM province_pleiades_match UNION SELECT 'place_conflict_context', rowId, 'province_gazetteer', 'name:' || expectedProvince FROM place_conflict_context
  UNION SELECT 'place_conflict_context', rowId, 'province_pleiades_match', 'place:' || TRY_CAST(TRY_CAST(trim(pleiadesId) AS DOUBLE) AS BIGINT) FROM place_conflict_context UNION SELECT 'province_gazetteer', rowId, 'place_conflict_context', 'name:' || canonicalName FROM province_gazetteer),
ok AS (SELECT DISTINCT t, k FROM own WHERE k IS NOT NULL),
kids AS (SELECT DISTINCT up.pt, up.pk, c.t, c.k FROM up JOIN own c ON c.t = up.t AND c.r = up.r WHERE up.pk IS NOT NULL AND c.k IS NOT NULL),
bad AS (SELECT DISTINCT o.t, o.k, 0 AS level FROM own o JOIN d ON d.source_table = o.t AND d.row_id = o.r WHERE o.k IS NOT NULL
  UNION SELECT kids.t, kids.k, level + 1 FROM bad JOIN kids ON kids.pt = bad.t AND kids.pk = bad.k WHERE level < 12),
keys AS (SELECT t, k, min(level) AS level FROM bad GROUP BY 1, 2),
met AS (SELECT source_table AS t, row_id AS r, 0 AS level FROM d UNION ALL SELECT up.t, up.r, min(keys.level) + 1 FROM up JOIN keys ON keys.t = up.pt AND keys.k = up.pk GROUP BY 1, 2),
least AS (SELECT t, r, min(level) AS level FROM met GROUP BY 1, 2)
SELECT t AS source_table, CAST(level AS INTEGER) AS level, count(*) AS n FROM least GROUP BY 1, 2
"""
