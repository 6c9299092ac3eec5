"""Joins, similarity and resolution over the gazetteer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.functions import rules as R
from tabulary.functions import similarity as Z
from tabulary.functions import text as X
from tabulary.functions.keys import number_key
from tabulary.functions.morphology import GAZETTEER_FORMS, WORD_FORMS, gazetteer_variants
from tabulary.operators import linkage, multivalue, relational, resolve
from tabulary.operators.pages import by_any_column, entity_page, keep_all_if_empty, mapped_places, stations
from tabulary.plans.text_queries import MORPH_CANDIDATES_SQL, _FEATURE, _LOW, _NORM, _key, _rule_sql
from tabulary.session import table, written

_PLACE = "(SELECT DISTINCT * EXCLUDE (loadedAt) FROM pleiades_place)"
_ONCE = "(SELECT DISTINCT * EXCLUDE (loadedAt) FROM place_conflict_context)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pleiades_place").dropDuplicates(["rowId"])


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "place_conflict_context").dropDuplicates(["rowId"])


def join_exact_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = _context(spark, sf_dir).select(F.col("rowId").alias("context_row"), X.norm_name(F.col("candidate")).alias("k"))
    places = _places(spark, sf_dir).select(F.col("rowId").alias("place_row"), X.norm_name(F.col("title")).alias("k"))
    return context.where("k <> ''").join(places, "k").select("context_row", "place_row")


JOIN_EXACT_SQL = f"""
SELECT m.row_id AS context_row, g.row_id AS place_row FROM (SELECT rowId AS row_id, {_NORM('candidate')} AS k FROM {_ONCE}) m
JOIN (SELECT rowId AS row_id, {_NORM('title')} AS k FROM {_PLACE}) g USING (k) WHERE k <> ''
"""


def join_multimap_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.multimap(_places(spark, sf_dir), "title", "pleiadesId", F.asc("rowId"))


def join_exact_then_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("canonical_name")
    left = table(spark, sf_dir, "place_name_list").select(F.col("name_id").alias("id"), X.norm_gazetteer(c).alias("exact"), gazetteer_variants(c).alias("variants"))
    right = _places(spark, sf_dir).select(F.col("pleiadesId").alias("place_id"), F.col("title").alias("name"), X.norm_gazetteer(F.col("title")).alias("key")).distinct()
    return relational.match_status(left, relational.exact_then_variant(left, right, "exact", "variants", "key"))


_GAZ = lambda x: f"regexp_replace(regexp_replace({_LOW(x)}, '[.,;:()\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g')"
JOIN_VARIANT_SQL = f"""
WITH l AS (SELECT name_id AS row_id, {_GAZ('canonical_name')} AS word FROM place_name_list), p AS (SELECT DISTINCT pleiadesId, title, {_GAZ('title')} AS k FROM pleiades_place),
w AS (SELECT row_id, word FROM l), e AS (SELECT row_id, pleiadesId, title FROM l JOIN p ON word = k),
v AS (SELECT DISTINCT row_id, pleiadesId, title FROM ({_rule_sql('word', GAZETTEER_FORMS)}) f JOIN w USING (row_id) JOIN p ON f.form = p.k WHERE f.form <> w.word AND row_id NOT IN (SELECT row_id FROM e)),
m AS (SELECT *, 'EXACT' AS method FROM e UNION ALL SELECT *, 'LATIN_VARIANT' FROM v)
SELECT l.row_id AS id, CASE WHEN count(pleiadesId) = 0 THEN 'UNMATCHED' WHEN count(DISTINCT pleiadesId) > 1 THEN 'AMBIGUOUS' ELSE 'MATCH' END AS status, coalesce(max(method), '') AS method,
  coalesce(string_agg(DISTINCT pleiadesId, ' | ' ORDER BY pleiadesId), '') AS place_ids, coalesce(string_agg(DISTINCT title, ' | ' ORDER BY title), '') AS names, count(DISTINCT pleiadesId) AS match_count
FROM l LEFT JOIN m USING (row_id) GROUP BY 1
"""


def join_prefix_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(i, p, v) for i, (p, v) in enumerate(R.CHAPTERS + R.UNITS)], "priority int, pattern string, value string")
    rows = _context(spark, sf_dir).select(F.col("rowId").alias("row_id"), "chapter")
    return relational.first_rule(rows, "chapter", rules).select("row_id", "priority", "value")


_RULES = ", ".join(f"({i}, '{p}', '{v}')" for i, (p, v) in enumerate(R.CHAPTERS + R.UNITS))
JOIN_PREFIX_SQL = f"""
SELECT row_id, b.priority, b.value FROM (SELECT rowId AS row_id, arg_min({{'priority': priority, 'value': value}}, priority) AS b FROM {_ONCE} LEFT JOIN (VALUES {_RULES}) r(priority, pattern, value) ON starts_with(chapter, pattern) GROUP BY rowId)
"""


def join_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = relational.keep_one(table(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


def join_update_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = relational.keep_one(_places(spark, sf_dir).withColumn("key", number_key("pleiadesId")).where("key is not null"), ["key"], F.desc("createdAt"), F.desc("rowId")).select("key", "latitude", "longitude", "featureType")
    target = _context(spark, sf_dir).select(F.col("rowId").alias("row_id"), number_key("pleiadesId").alias("key"), "latitude", "longitude", "featureType")
    return relational.update_blanks(target, source, "key", ["latitude", "longitude", "featureType"]).select("row_id", "latitude", "longitude", "featureType")


JOIN_UPDATE_SQL = f"""
WITH s AS (SELECT CAST(pleiadesId AS BIGINT) AS key, latitude, longitude, featureType FROM {_PLACE} QUALIFY row_number() OVER (PARTITION BY CAST(pleiadesId AS BIGINT) ORDER BY createdAt DESC, rowId DESC) = 1)
SELECT t.rowId AS row_id, coalesce(t.latitude, s.latitude) AS latitude, coalesce(t.longitude, s.longitude) AS longitude, coalesce(nullif(trim(t.featureType), ''), s.featureType) AS featureType
FROM {_ONCE} t LEFT JOIN s ON s.key = TRY_CAST(TRY_CAST(trim(t.pleiadesId) AS DOUBLE) AS BIGINT)
"""


def join_alias_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All provinces and regions tied to the first province by shared mentions."""
    context = _context(spark, sf_dir).select(X.norm_name(F.col("declaredProvince")).alias("a"), F.col("region").alias("b")).where("a <> ''").distinct()
    seeds = context.groupBy().agg(F.min("a").alias("node"))
    return relational.closure(context, seeds)


JOIN_CLOSURE_SQL = f"""
WITH RECURSIVE e AS (SELECT DISTINCT {_NORM('declaredProvince')} AS a, region AS b FROM place_conflict_context WHERE {_NORM('declaredProvince')} <> '' AND region IS NOT NULL),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT min(a) AS node FROM e UNION SELECT g.b FROM r JOIN g ON g.a = r.node) SELECT node FROM r
"""


def join_scored_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best order line per order: returned lines before others, then price, then line number."""
    score = F.when(F.col("l_returnflag") == "R", 4).otherwise(0) + F.when(F.col("l_linestatus") == "O", 2).otherwise(0)
    return relational.scored_pick(table(spark, sf_dir, "lineitem"), ["l_orderkey"], score, F.desc("l_extendedprice"), F.asc("l_linenumber")).select("l_orderkey", "l_linenumber", "score")


def join_unique_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.unique_or_null(_places(spark, sf_dir), "title", "pleiadesId")


def join_fuzzy_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _context(spark, sf_dir).select(F.col("rowId").alias("id"), X.latin_key(F.col("candidate")).alias("form"))
    right = table(spark, sf_dir, "place_name_list").select(F.col("name_id").alias("place_id"), X.latin_key(F.col("canonical_name")).alias("name_key"))
    return linkage.blocked_fuzzy_join(left, right).select("id", "place_id", F.round("similarity", 6).alias("similarity"))


JOIN_FUZZY_SQL = f"""
WITH l AS (SELECT rowId AS id, {_key('candidate')} AS f FROM {_ONCE}), r AS (SELECT name_id AS place_id, {_key('canonical_name')} AS k FROM place_name_list),
d AS (SELECT f, k, 1.0 - levenshtein(f, k) / greatest(length(f), length(k))::DOUBLE AS s FROM (SELECT DISTINCT f FROM l WHERE f <> '') JOIN (SELECT DISTINCT k FROM r WHERE k <> '') ON left(f, 1) = left(k, 1) AND abs(length(f) - length(k)) <= 2 WHERE levenshtein(f, k) <= 2)
SELECT id, place_id, round(s, 6) AS similarity FROM l JOIN d USING (f) JOIN r USING (k) WHERE s >= 0.86
"""


def sim_token_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _context(spark, sf_dir).select("declaredProvince", "gisProvince").where("declaredProvince is not null and gisProvince is not null").distinct()
    forms = lambda c, f: pairs.select(c).distinct().select(c, Z.name_forms(F.col(c)).alias(f))
    both = pairs.join(forms("declaredProvince", "e"), "declaredProvince").join(forms("gisProvince", "a"), "gisProvince")
    return both.select("declaredProvince", "gisProvince", F.round(Z.forms_likeness(F.col("e"), F.col("a")), 6).alias("likeness"), F.round(Z.similarity(F.col("declaredProvince"), F.col("gisProvince")), 6).alias("whole"))


_STOP = ", ".join(f"'{w}'" for w in X.TITLE_STOPWORDS)
_TOK = lambda x: f"list_filter(string_split({_NORM(x)}, ' '), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))"
SIM_TOKEN_SQL = f"""
WITH p AS (SELECT DISTINCT declaredProvince, gisProvince, {_TOK('declaredProvince')} AS es, {_TOK('gisProvince')} AS az FROM place_conflict_context WHERE declaredProvince IS NOT NULL AND gisProvince IS NOT NULL),
w AS (SELECT DISTINCT word AS row_id, word FROM (SELECT unnest(es) AS word FROM p UNION ALL SELECT unnest(az) FROM p)),
f AS (SELECT DISTINCT row_id AS word, {_key('form')} AS k FROM (SELECT row_id, word AS form FROM w UNION ALL SELECT row_id, form FROM ({_rule_sql('word', WORD_FORMS)})) WHERE {_key('form')} <> ''),
t AS (SELECT DISTINCT e, unnest(az) AS a FROM (SELECT unnest(es) AS e, az FROM p)),
s AS (SELECT e, a, max(1.0 - levenshtein(x.k, y.k) / greatest(length(x.k), length(y.k))::DOUBLE) AS v FROM t JOIN f x ON x.word = e JOIN f y ON y.word = a GROUP BY 1, 2),
q AS (SELECT declaredProvince, gisProvince, i, es[i] AS te, unnest(az) AS ta FROM (SELECT declaredProvince, gisProvince, unnest(range(1, len(es) + 1)) AS i, es, az FROM p)),
b AS (SELECT declaredProvince, gisProvince, i, max(v) AS best FROM q JOIN s ON s.e = te AND s.a = ta GROUP BY 1, 2, 3)
SELECT p.declaredProvince, p.gisProvince, round(coalesce((SELECT avg(best) FROM b WHERE b.declaredProvince = p.declaredProvince AND b.gisProvince = p.gisProvince), 0.0), 6) AS likeness,
  round(1.0 - levenshtein({_key('p.declaredProvince')}, {_key('p.gisProvince')}) / greatest(length({_key('p.declaredProvince')}), length({_key('p.gisProvince')}))::DOUBLE, 6) AS whole FROM p
"""


def sim_top2_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the polygon's name fits the text around a mention, per distinct pair."""
    pairs = _context(spark, sf_dir).select("gisProvince", "region").where("gisProvince is not null and region is not null").distinct()
    return pairs.select("gisProvince", "region", F.round(Z.actual_to_context(F.col("gisProvince"), F.col("region")), 6).alias("score"), Z.stem_score(F.col("region"), F.col("gisProvince")).alias("stems"), Z.provinces_compatible(F.col("region"), F.col("gisProvince")).alias("compatible"))


def sim_ratio_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likest polygons and reference names of every name of the list."""
    provinces = table(spark, sf_dir, "place_name_list").select(F.col("canonical_name").alias("province")).where("province is not null").distinct()
    polygons = table(spark, sf_dir, "province_polygon").select((F.col("geojsonId") + 1_000_000).alias("place_id"), F.col("gisProvince").alias("name"))
    names = table(spark, sf_dir, "place_name_list").select(F.col("name_id").alias("place_id"), F.col("canonical_name").alias("name")).unionByName(polygons).where("name is not null").distinct()
    return linkage.province_candidates(provinces, names)


def sim_probe_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likest reference names of every name of a polygon or province."""
    provinces = table(spark, sf_dir, "province_gazetteer").select((F.col("rowId") + 1_000_000).alias("id"), F.col("canonicalName").alias("place_name"))
    polygons = table(spark, sf_dir, "province_polygon").select(F.col("geojsonId").alias("id"), F.col("gisProvince").alias("place_name"))
    targets = provinces.unionByName(polygons).where("place_name is not null").groupBy("place_name").agg(F.min("id").alias("id")).select("id", "place_name")
    names = table(spark, sf_dir, "place_name_list").select(F.col("name_id").alias("place_id"), F.col("canonical_name").alias("name")).where("name is not null").distinct()
    return linkage.probe_unmatched(targets, names)


def _ratio_sql(pairs: str, least: float) -> str:
    """CTEs that take (a, b) of `pairs` to score(a, b, s): the longest common block first, then left and right of it, over and over."""
    common = "list_sum(list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789 ', ''), lambda c: least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, '')))))"
    return f"""may AS (SELECT DISTINCT a, b FROM {pairs} WHERE a <> '' AND b <> '' AND 2.0 * least(length(a), length(b)) >= {least} * (length(a) + length(b)) AND 2.0 * {common} >= {least} * (length(a) + length(b)) - 1e-9),
part AS (SELECT a, b, a AS x, b AS y, 0 AS k FROM may
  UNION ALL SELECT a, b, side.x, side.y, side.k FROM (
    SELECT a, b, unnest([{{'x': x[1:i - 1], 'y': y[1:instr(y, x[i:i + n - 1]) - 1], 'k': n}}, {{'x': x[i + n:], 'y': y[instr(y, x[i:i + n - 1]) + n:], 'k': 0}}]) AS side FROM (
      SELECT a, b, x, y, best[2] AS i, -best[1] AS n FROM (
        SELECT a, b, x, y, list_min(list_filter(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, length(x) - i + 2), lambda n: [-n, i]))), lambda p: contains(y, x[p[2]:p[2] - p[1] - 1]))) AS best
        FROM part WHERE x <> '' AND y <> '') WHERE best IS NOT NULL))),
score AS (SELECT a, b, 2.0 * sum(k) / (length(a) + length(b)) AS s FROM part GROUP BY a, b HAVING s >= {least})"""


_PROVINCE_KEY = lambda x: f"regexp_replace(regexp_replace(replace(replace(replace({_LOW(x)}, 'ph', 'f'), 'y', 'i'), 'v', 'u'), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')"
_PROBE_KEY = lambda x: f"""regexp_replace(regexp_replace(replace(replace({_LOW(x)}, 'j', 'i'), 'u', 'v'), '[.,;:()\\[\\]{{}}''’"*/?]', ' ', 'g'), '\\s+', ' ', 'g')"""
# fixed values of the rules, written out a second time: ending, least length, what is cut and added
_PROVINCE_CASES = "[{'e': 'iae', 'c': 3, 'a': 'ia'}, {'e': 'ae', 'c': 2, 'a': 'a'}, {'e': 'arum', 'c': 4, 'a': 'a'}, {'e': 'orum', 'c': 4, 'a': 'um'}, {'e': 'ensis', 'c': 5, 'a': 'ensis'}, {'e': 'enses', 'c': 5, 'a': 'ensis'}, {'e': 'i', 'c': 1, 'a': 'us'}]"
_PROBE_CASES = "[{'e': 'o', 'l': 4, 'c': 1, 'a': 'um'}, {'e': 'ae', 'l': 5, 'c': 2, 'a': 'a'}, {'e': 'ae', 'l': 5, 'c': 2, 'a': 'um'}, {'e': 'i', 'l': 5, 'c': 1, 'a': 'um'}, {'e': 'i', 'l': 5, 'c': 1, 'a': 'us'}, {'e': 'is', 'l': 6, 'c': 2, 'a': 'um'}, {'e': 'is', 'l': 6, 'c': 2, 'a': 'a'}, {'e': 'a', 'l': 6, 'c': 1, 'a': 'um'}]"
SIM_RATIO_SQL = f"""
WITH RECURSIVE keyed AS (SELECT name_id AS place_id, canonical_name AS name, {_PROVINCE_KEY('canonical_name')} AS key FROM place_name_list UNION SELECT geojsonId + 1000000, gisProvince, {_PROVINCE_KEY('gisProvince')} FROM province_polygon WHERE gisProvince IS NOT NULL),
p AS (SELECT DISTINCT canonical_name AS province, {_PROVINCE_KEY('canonical_name')} AS base FROM place_name_list WHERE canonical_name IS NOT NULL),
rules AS (SELECT unnest({_PROVINCE_CASES}) AS r),
variants AS (SELECT province, base AS variant FROM p UNION SELECT province, trim(left(trim(base), length(trim(base)) - r.c) || r.a) FROM p, rules WHERE ends_with(trim(base), r.e)),
pairs AS (SELECT v.variant AS a, k.key AS b FROM variants v, keyed k),
{_ratio_sql('pairs', 0.7)},
best AS (SELECT province, place_id, name, s FROM (SELECT province, place_id, name, s, row_number() OVER (PARTITION BY province, place_id ORDER BY s DESC, name) AS n FROM variants JOIN score ON a = variant JOIN keyed ON key = b) WHERE n = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY province ORDER BY s DESC, place_id) AS k FROM best)
SELECT province, CAST(k AS INTEGER) AS rank, printf('%.3f', s) AS score, CASE WHEN s = 1.0 THEN 'NORMALIZED' ELSE 'SIMILAR' END AS method, place_id, name AS matched_name FROM ranked WHERE k <= 5
"""
SIM_PROBE_SQL = f"""
WITH RECURSIVE keyed AS (SELECT DISTINCT name_id AS place_id, canonical_name AS name, {_PROBE_KEY('canonical_name')} AS key FROM place_name_list WHERE canonical_name IS NOT NULL),
t AS (SELECT min(id) AS id, place_name, {_PROBE_KEY('place_name')} AS search FROM (SELECT rowId + 1000000 AS id, canonicalName AS place_name FROM province_gazetteer UNION ALL SELECT geojsonId, gisProvince FROM province_polygon) WHERE place_name IS NOT NULL GROUP BY place_name),
rules AS (SELECT unnest({_PROBE_CASES}) AS r),
hits AS (SELECT DISTINCT id, key AS form, place_id, name, 0 AS stage, 1.0::DOUBLE AS s FROM t, rules JOIN keyed ON key = left(search, length(search) - r.c) || r.a WHERE ends_with(search, r.e) AND length(search) >= r.l AND key <> search),
pairs AS (SELECT k.key AS a, search AS b FROM (SELECT DISTINCT search FROM t) q, (SELECT DISTINCT key FROM keyed) k),
{_ratio_sql('pairs', 0.55)},
near AS (SELECT a AS key, b AS search, s FROM score QUALIFY row_number() OVER (PARTITION BY b ORDER BY s DESC, a) <= 30),
u AS (SELECT * FROM hits UNION ALL SELECT id, search, place_id, name, 1, s FROM t JOIN near USING (search) JOIN keyed USING (key)),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id, place_id ORDER BY stage, s DESC, form, name) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stage, s DESC, place_id) AS k FROM o)
SELECT id, CAST(k AS INTEGER) AS rank, CASE WHEN stage = 0 THEN 'VARIANT_EXACT' ELSE 'NEAR' END AS method, printf('%.3f', s) AS score, form, place_id, name AS matched_name FROM ranked WHERE k <= 5
"""


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir).where("occurrenceId is not null").groupBy(F.col("occurrenceId").alias("occ_id")).agg(F.min_by("placeName", "rowId").alias("place_name"), F.min_by("placeSource", "rowId").alias("place_source"))


def resolve_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _places(spark, sf_dir).select(F.col("pleiadesId").alias("place_id"), F.col("title").alias("name")).where("name is not null").distinct()
    return resolve.candidates(_occurrences(spark, sf_dir), names)


RESOLVE_CANDIDATES_SQL = f"""
WITH v AS (SELECT placeName AS pn, placeSource AS ps, ord, value AS candidate, rule, tier, {_NORM('value')} AS norm, {_key('value')} AS form FROM ({MORPH_CANDIDATES_SQL})),
g AS (SELECT DISTINCT pleiadesId AS place_id, title AS name, {_NORM('title')} AS norm, {_key('title')} AS k FROM {_PLACE} WHERE title IS NOT NULL),
exact AS (SELECT pn, ps, place_id, name, candidate, rule, tier, 1.0::DOUBLE AS similarity, 'EXACT' AS method, 1 AS stage FROM v JOIN g USING (norm) WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY pn, ps, place_id ORDER BY tier, length(candidate), ord, name) = 1),
rest AS (SELECT v.* FROM v ANTI JOIN exact USING (pn, ps)),
d AS (SELECT f, k, 1.0 - levenshtein(f, k) / greatest(length(f), length(k))::DOUBLE AS s FROM (SELECT DISTINCT form AS f FROM rest WHERE form <> '') JOIN (SELECT DISTINCT k FROM g WHERE k <> '') ON left(f, 1) = left(k, 1) AND abs(length(f) - length(k)) <= 2 WHERE levenshtein(f, k) <= 2),
near AS (SELECT pn, ps, place_id, name, candidate, rule, tier, s, 'FUZZY', 2 FROM rest JOIN d ON f = form JOIN g USING (k) WHERE s >= 0.86 QUALIFY row_number() OVER (PARTITION BY pn, ps, place_id ORDER BY s DESC, tier, ord, name) = 1),
occ AS (SELECT occurrenceId AS occ_id, coalesce(placeName, '') AS pn, coalesce(placeSource, '') AS ps FROM {_ONCE} WHERE occurrenceId IS NOT NULL QUALIFY row_number() OVER (PARTITION BY occurrenceId ORDER BY rowId) = 1)
SELECT occ_id, place_id, name, candidate, rule, tier, similarity, method, stage FROM occ JOIN (SELECT * FROM exact UNION ALL SELECT * FROM near) USING (pn, ps)
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _context(spark, sf_dir).select(
        F.col("rowId").alias("place_id"), F.col("occurrenceId").alias("occ_id"), F.col("hardProvince").alias("hard"), F.col("softProvince").alias("soft"), F.upper("region").alias("region"), F.col("gisProvince").alias("actual"), F.col("nearestProvince").alias("nearest"), F.col("nearestKm").alias("nearest_km"),
        F.col("contextText").alias("context_text"), F.coalesce("tier", F.lit(0)).alias("tier"), F.col("nameSimilarity").alias("similarity"), F.col("featureType").alias("feature_type"), "unit", "chapter", F.col("placeSource").alias("place_source"), F.col("contextStatus").alias("context_status"), F.col("contextScore").alias("context_score"),
    )
    return resolve.with_feature_score(rows).withColumn("method", F.when(F.col("similarity") >= 0.999, "EXACT").otherwise("FUZZY"))


def _province_targets(spark: SparkSession, sf_dir: str, expected: DataFrame) -> DataFrame:
    """(expected, targets), with the fixed forms and every name the gazetteer packs for a province as aliases."""
    polygons = table(spark, sf_dir, "province_polygon").select(F.col("gisProvince").alias("name")).where("name is not null").distinct()
    gazetteer = table(spark, sf_dir, "province_gazetteer").dropDuplicates(["rowId"])
    named = multivalue.split_values(multivalue.packed_fields(gazetteer, ["geojsonNames"])).select("row_id", F.col("value").alias("name"))
    aliases = gazetteer.select(F.col("rowId").alias("row_id"), X.norm_name(F.col("canonicalName")).alias("alias")).join(named, "row_id").select("alias", "name")
    fixed = spark.createDataFrame([(alias, name) for name, alias in resolve.PROVINCE_ALIASES], "alias string, name string")
    return resolve.province_targets(expected, polygons, aliases.unionByName(fixed).distinct())


def resolve_context_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every candidate; targets are the polygons that the expected name may stand for."""
    rows = _scored(spark, sf_dir).drop("context_status", "context_score")
    targets = written(_province_targets(spark, sf_dir, rows.select("hard").unionByName(rows.select(F.col("soft").alias("hard"))).select(F.col("hard").alias("expected")).distinct()), "targets")
    for name in ("hard", "soft"):
        rows = rows.join(targets.select(F.col("expected").alias(name), F.col("targets").alias(f"{name}_targets")), name, "left")
    polygons = table(spark, sf_dir, "province_polygon").select(F.col("gisProvince").alias("name")).where("name is not null")
    regions = written(rows.select("region").where("region is not null").distinct().withColumn("region_targets", resolve.region_targets(F.col("region"))), "regions")
    chapters = written(resolve.geographic_chapters(rows.select("chapter"), polygons).withColumn("chapter_geography", F.lit(True)), "chapters")
    rows = rows.join(regions, "region", "left").join(chapters, "chapter", "left")
    return resolve.context_status(rows).select(F.col("place_id").alias("row_id"), "context_status", F.when(F.col("context_score") == 1.0, 1).otherwise(0).alias("full_score"))


RESOLVE_STATUS_SQL = f"""
WITH o AS (SELECT rowId, upper(hardProvince) AS h, upper(softProvince) AS s, coalesce(gisProvince, '') AS a, coalesce(nearestProvince, '') AS n, coalesce(nearestKm <= 15.0, false) AND coalesce(nearestProvince, '') <> '' AS near FROM {_ONCE}),
t AS (SELECT *, CASE WHEN h IS NOT NULL THEN 'HARD' WHEN s IS NOT NULL THEN 'SOFT' END AS k, coalesce(h, s) AS target FROM o)
SELECT rowId AS row_id, CASE WHEN k IS NULL THEN CASE WHEN a = '' THEN 'NO_POLYGON' ELSE 'NO_CONTEXT' END WHEN a <> '' THEN k || CASE WHEN a = target THEN '_MATCH' ELSE '_MISMATCH' END
  WHEN near THEN k || CASE WHEN n = target THEN '_NEAR_MATCH' ELSE '_NEAR_MISMATCH' END ELSE k || '_UNVERIFIED' END AS context_status,
  CASE WHEN k IS NOT NULL AND ((a <> '' AND a = target) OR (a = '' AND near AND n = target)) THEN 1 ELSE 0 END AS full_score
FROM t
"""


def resolve_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).where("occ_id is not null")
    return resolve.rank_candidates(rows).select("occ_id", F.col("place_id").alias("row_id"), "candidate_rank")


RESOLVE_RANK_SQL = f"""
SELECT occurrenceId AS occ_id, rowId AS row_id, CAST(row_number() OVER (PARTITION BY occurrenceId ORDER BY CASE contextStatus WHEN 'HARD_MATCH' THEN 7 WHEN 'HARD_NEAR_MATCH' THEN 6 WHEN 'SOFT_MATCH' THEN 5 WHEN 'SOFT_NEAR_MATCH' THEN 4 WHEN 'REGION_MATCH' THEN 3 WHEN 'REGION_NEAR_MATCH' THEN 2 ELSE 0 END DESC,
  contextScore DESC NULLS LAST, nameSimilarity DESC, {_FEATURE} DESC, coalesce(tier, 0), rowId) AS INTEGER) AS candidate_rank FROM {_ONCE} WHERE occurrenceId IS NOT NULL
"""


def resolve_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).where("occ_id is not null").withColumn("has_hard", F.col("hard").isNotNull()).withColumn("context_status", F.coalesce("context_status", F.lit("NO_CONTEXT")))
    return resolve.decide(rows)


_DECISION_SQL = f"""
WITH c AS (SELECT occurrenceId AS occ_id, rowId AS place_id, CASE WHEN nameSimilarity >= 0.999 THEN 'EXACT' ELSE 'FUZZY' END AS method, coalesce(nameSimilarity, 0) AS sim, coalesce(tier, 0) AS tier,
    coalesce(contextStatus, 'NO_CONTEXT') AS st, {_FEATURE} AS fs, coalesce(placeSource, '') AS src, hardProvince IS NOT NULL AS h FROM {_ONCE} WHERE occurrenceId IS NOT NULL),
n AS (SELECT occ_id, count(*) AS n, bool_or(h) AS h, count_if(st = 'HARD_MATCH') AS hd, count_if(st = 'HARD_NEAR_MATCH') AS hn, count_if(st = 'SOFT_MATCH') AS sd, count_if(st = 'SOFT_NEAR_MATCH') AS sn,
    count_if(st = 'REGION_MATCH') AS rd, count_if(st = 'REGION_NEAR_MATCH') AS rn, count_if(st IN ('HARD_MISMATCH', 'HARD_NEAR_MISMATCH')) AS miss, count_if(st = 'HARD_UNVERIFIED') AS unv FROM c GROUP BY occ_id),
p AS (
  SELECT 1 AS pool, c.* FROM c JOIN n USING (occ_id) WHERE (n.h AND st = CASE WHEN hd > 0 THEN 'HARD_MATCH' ELSE 'HARD_NEAR_MATCH' END)
    OR (NOT n.h AND sd + sn > 0 AND st = CASE WHEN sd > 0 THEN 'SOFT_MATCH' ELSE 'SOFT_NEAR_MATCH' END) OR (NOT n.h AND sd + sn = 0 AND st = CASE WHEN rd > 0 THEN 'REGION_MATCH' ELSE 'REGION_NEAR_MATCH' END)
  UNION ALL SELECT 2, c.* FROM c JOIN n USING (occ_id) WHERE CASE WHEN hd + hn > 0 THEN st IN ('HARD_MATCH', 'HARD_NEAR_MATCH') WHEN sd + sn > 0 THEN st IN ('SOFT_MATCH', 'SOFT_NEAR_MATCH')
    WHEN rd + rn > 0 THEN st IN ('REGION_MATCH', 'REGION_NEAR_MATCH') ELSE NOT ends_with(st, 'MISMATCH') END
  UNION ALL SELECT 3, c.* FROM c),
r AS (SELECT *, row_number() OVER w AS k, lead(fs) OVER w AS second, count(*) OVER (PARTITION BY occ_id, pool) AS size FROM p WINDOW w AS (PARTITION BY occ_id, pool ORDER BY fs DESC, sim DESC, tier, place_id)),
b AS (SELECT *, CASE WHEN method = 'EXACT' THEN 'EXACT' WHEN sim >= 0.90 THEN 'FUZZY' ELSE '' END AS sure FROM r WHERE k = 1),
f AS (SELECT *, size >= 2 AND fs > second AND ((fs >= 4 AND fs - second >= 2) OR (fs >= 2 AND second < 0)) AND sure <> '' AS stands_out FROM b),
d AS (SELECT n.*, n.h AND hd + hn = 0 AND miss > 0 AND unv = 0 AS is_conflict, o.place_id AS p1, o.size AS s1, o.sure AS u1, o.st AS t1, coalesce(o.stands_out, false) AS f1, w.place_id AS p2, w.sure AS u2, coalesce(w.stands_out, false) AS f2,
    a.place_id AS p3, a.sure AS u3, a.st AS t3, a.src AS src FROM n LEFT JOIN (SELECT * FROM f WHERE pool = 1) o USING (occ_id) LEFT JOIN (SELECT * FROM f WHERE pool = 2) w USING (occ_id) JOIN (SELECT * FROM f WHERE pool = 3) a USING (occ_id)),
x AS (SELECT occ_id, is_conflict, CASE WHEN s1 = 1 THEN {{'id': p1, 't': CASE WHEN u1 = '' THEN '' ELSE CASE WHEN starts_with(t1, 'REGION') THEN 'REGION_' ELSE 'CONTEXT_' END || CASE WHEN contains(t1, 'NEAR') THEN 'NEAR_' ELSE '' END || u1 END}}
    WHEN is_conflict AND n = 1 AND u3 <> '' THEN {{'id': p3, 't': 'CONTEXT_CONFLICT_' || u3}} WHEN f1 THEN {{'id': p1, 't': 'FEATURE_' || u1}} WHEN f2 THEN {{'id': p2, 't': 'FEATURE_' || u2}}
    WHEN n = 1 AND NOT ends_with(t3, 'MISMATCH') AND (u3 = 'EXACT' OR (u3 = 'FUZZY' AND src <> 'limes')) THEN {{'id': p3, 't': u3 || '_NO_CONTEXT'}} END AS choice FROM d)
"""
RESOLVE_DECISION_SQL = _DECISION_SQL + "SELECT occ_id, CASE WHEN choice IS NULL THEN 'AMBIGUOUS' ELSE 'MATCH' END AS outcome, choice.id AS place_id, choice.t AS match_type, is_conflict FROM x"


def resolve_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five candidates of every occurrence in conflict or ambiguous."""
    rows = _scored(spark, sf_dir).where("occ_id is not null")
    return resolve.decision_rows(rows, resolve_decision(spark, sf_dir)).select("occ_id", "report", "candidate_rank", F.col("place_id").alias("row_id"))


RESOLVE_REPORTS_SQL = (
    _DECISION_SQL
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY occ_id ORDER BY CASE contextStatus WHEN 'HARD_MATCH' THEN 7 WHEN 'HARD_NEAR_MATCH' THEN 6 WHEN 'SOFT_MATCH' THEN 5 WHEN 'SOFT_NEAR_MATCH' THEN 4 WHEN 'REGION_MATCH' THEN 3 WHEN 'REGION_NEAR_MATCH' THEN 2 ELSE 0 END DESC,
  contextScore DESC NULLS LAST, nameSimilarity DESC NULLS LAST, fs DESC, tier, place_id) AS k FROM (SELECT c.*, o.contextStatus, o.contextScore, o.nameSimilarity FROM c JOIN """
    + _ONCE
    + """ o ON o.rowId = c.place_id))
SELECT occ_id, report, CAST(k AS INTEGER) AS candidate_rank, place_id AS row_id FROM ranked JOIN (SELECT occ_id, 'CONFLICT' AS report FROM x WHERE is_conflict UNION ALL SELECT occ_id, 'AMBIGUOUS' FROM x WHERE choice IS NULL) USING (occ_id) WHERE k <= 5
"""
)


def resolve_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).where("occ_id is not null").withColumn("expected", F.col("hard")).withColumn("province", F.col("actual")).withColumn("has_coordinates", F.col("actual").isNotNull() | F.col("nearest").isNotNull())
    return resolve.decide_local(rows)


_TOKENS = lambda x: f"list_filter(string_split({_NORM(x)}, ' '), lambda w: length(w) > 2 AND w NOT IN ('et', 'in', 'provincia', 'provinciae', 'pars', 'prima', 'primae', 'secunda', 'secundae', 'superior', 'superioris', 'inferior', 'inferioris'))"
RESOLVE_LOCAL_SQL = f"""
WITH c AS (SELECT occurrenceId AS occ_id, rowId AS place_id, CASE WHEN nameSimilarity >= 0.999 THEN 'EXACT' ELSE 'FUZZY' END AS method, nameSimilarity AS sim, coalesce(tier, 0) AS tier, coalesce(hardProvince, '') AS e, coalesce(gisProvince, '') AS a, gisProvince IS NOT NULL OR nearestProvince IS NOT NULL AS has,
    len(list_filter(string_split({_NORM('featureType')}, ' '), lambda w: w IN ('river', 'island', 'mountain', 'road', 'region', 'province', 'sea', 'water'))) > 0 AS no_point FROM {_ONCE} WHERE occurrenceId IS NOT NULL),
p AS (SELECT DISTINCT e, a, {_key('e')} AS ke, {_key('a')} AS ka, {_NORM('e')} AS ne, {_NORM('a')} AS na, {_TOKENS('e')} AS te, {_TOKENS('a')} AS ta FROM c WHERE e <> '' AND a <> ''),
w AS (SELECT DISTINCT e, a, x, unnest(ta) AS y FROM (SELECT e, a, unnest(te) AS x, ta FROM p)),
l AS (SELECT DISTINCT e, a FROM w WHERE contains(x, y) OR contains(y, x) OR ({_key('x')} <> '' AND {_key('y')} <> '' AND 1.0 - levenshtein({_key('x')}, {_key('y')}) / greatest(length({_key('x')}), length({_key('y')}))::DOUBLE >= 0.82)),
ok AS (SELECT e, a FROM p WHERE contains(ne, na) OR contains(na, ne) OR (ke <> '' AND ka <> '' AND 1.0 - levenshtein(ke, ka) / greatest(length(ke), length(ka))::DOUBLE >= 0.80) UNION SELECT e, a FROM l),
t AS (SELECT c.*, CASE WHEN c.e = '' THEN 'NO_CONTEXT' WHEN NOT has THEN 'NO_COORDS' WHEN c.a = '' THEN 'OUTSIDE_POLYGONS' WHEN ok.e IS NOT NULL THEN 'INSIDE' ELSE 'OUTSIDE' END AS st FROM c LEFT JOIN ok ON ok.e = c.e AND ok.a = c.a),
v AS (SELECT *, st <> 'OUTSIDE' AND NOT no_point AS viable, st = 'INSIDE' AND NOT no_point AS inside FROM t),
n AS (SELECT *, count(*) OVER o AS n_all, count_if(inside) OVER o AS n_in, count_if(viable) OVER o AS n_ok, lead(CASE WHEN inside THEN sim END) OVER r AS second, row_number() OVER r AS k FROM v
  WINDOW o AS (PARTITION BY occ_id), r AS (PARTITION BY occ_id ORDER BY CASE WHEN inside THEN 0 WHEN viable THEN 1 ELSE 2 END, sim DESC NULLS LAST, tier, place_id)),
m AS (SELECT *, CASE WHEN e <> '' AND n_in = 1 THEN 'CONTEXT_' || method WHEN e <> '' AND n_in > 1 AND method <> 'EXACT' AND sim >= 0.90 AND sim - second >= 0.06 THEN 'CONTEXT_FUZZY' WHEN e = '' AND n_ok = 1 AND (method = 'EXACT' OR sim >= 0.90) THEN method || '_NO_CONTEXT' END AS kind FROM n WHERE k = 1)
SELECT occ_id, CASE WHEN kind IS NOT NULL THEN 'MATCH' WHEN e <> '' AND n_all = 1 AND st = 'OUTSIDE' THEN 'REJECTED' ELSE 'AMBIGUOUS' END AS outcome, CASE WHEN kind IS NOT NULL THEN place_id END AS place_id, coalesce(kind, '') AS match_type FROM m
"""


def resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons that each declared province may stand for, with every name the gazetteer packs for it as alias."""
    expected = _context(spark, sf_dir).select(F.col("declaredProvince").alias("expected")).where("expected is not null").distinct()
    found = _province_targets(spark, sf_dir, expected)
    return found.select("expected", F.array_join("targets", " | ").alias("targets"))


_FIXED = ", ".join(f"('{alias}', '{name}')" for name, alias in resolve.PROVINCE_ALIASES)
RESOLVE_TARGETS_SQL = f"""
WITH names AS (SELECT row_id, value FROM ({multivalue.FOUND_SQL}) WHERE field = 'geojsonNames'),
poly AS (SELECT DISTINCT gisProvince AS name FROM province_polygon WHERE gisProvince IS NOT NULL),
alias AS (SELECT DISTINCT {_NORM('canonicalName')} AS alias, value AS name FROM province_gazetteer JOIN names ON row_id = rowId UNION SELECT * FROM (VALUES {_FIXED}) f(alias, name)),
e AS (SELECT DISTINCT declaredProvince AS expected FROM place_conflict_context WHERE declaredProvince <> ''),
part AS (SELECT expected, expected AS part FROM e UNION SELECT expected, trim(unnest(string_split_regex(expected, '(?i)\\bet\\b')), ' ') FROM e),
pt AS (SELECT DISTINCT part, {_TOK('part')} AS es FROM part WHERE part <> ''), nt AS (SELECT name, {_TOK('name')} AS az FROM poly),
w AS (SELECT DISTINCT word AS row_id, word FROM (SELECT unnest(es) AS word FROM pt UNION ALL SELECT unnest(az) FROM nt)),
f AS (SELECT DISTINCT row_id AS word, {_key('form')} AS k FROM (SELECT row_id, word AS form FROM w UNION ALL SELECT row_id, form FROM ({_rule_sql('word', WORD_FORMS)})) WHERE {_key('form')} <> ''),
te AS (SELECT DISTINCT unnest(es) AS e FROM pt), ta AS (SELECT DISTINCT unnest(az) AS a FROM nt),
sim AS (SELECT e, a, max(1.0 - levenshtein(x.k, y.k) / greatest(length(x.k), length(y.k))::DOUBLE) AS v FROM te, ta JOIN f x ON x.word = e JOIN f y ON y.word = a GROUP BY 1, 2),
best AS (SELECT part, name, i, max(coalesce(v, 0)) AS b FROM (SELECT part, unnest(es) AS e, generate_subscripts(es, 1) AS i FROM pt) q, (SELECT name, unnest(az) AS a FROM nt) n LEFT JOIN sim ON sim.e = q.e AND sim.a = n.a GROUP BY 1, 2, 3),
alike AS (SELECT part, name FROM best GROUP BY 1, 2 HAVING avg(b) >= 0.82 - 1e-12),
hits AS (SELECT expected, name FROM part JOIN alias ON alias.alias = {_NORM('part')} SEMI JOIN poly USING (name) UNION SELECT expected, name FROM part JOIN alike USING (part))
SELECT expected, string_agg(name, ' | ' ORDER BY name) AS targets FROM hits GROUP BY expected
"""


def resolve_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = _context(spark, sf_dir).select(F.col("rowId").alias("id"), number_key("pleiadesId").alias("place_id"), F.col("pleiadesName").alias("place_name"))
    gazetteer = _places(spark, sf_dir).select(number_key("pleiadesId").alias("place_id"), F.col("title").alias("name"))
    return resolve.strict(mentions, gazetteer)


RESOLVE_STRICT_SQL = f"""
WITH g AS (SELECT CAST(pleiadesId AS BIGINT) AS p, lower(trim(title, ' ')) AS k FROM {_PLACE}), n AS (SELECT k, count(DISTINCT p) AS c, min(p) AS one FROM g GROUP BY k),
m AS (SELECT rowId AS id, TRY_CAST(TRY_CAST(trim(pleiadesId) AS DOUBLE) AS BIGINT) AS own, lower(trim(pleiadesName, ' ')) AS k FROM {_ONCE})
SELECT id, CASE WHEN own IN (SELECT p FROM g) THEN 'ID' WHEN c = 1 THEN 'UNIQUE' WHEN c > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS status, CASE WHEN own IN (SELECT p FROM g) THEN own WHEN c = 1 THEN one END AS place_id
FROM m LEFT JOIN n USING (k)
"""


def resolve_first_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = _context(spark, sf_dir).select(F.col("rowId").alias("id"), F.col("candidate").alias("place_name"))
    gazetteer = _places(spark, sf_dir).select(F.col("pleiadesId").alias("place_id"), "title", F.lower("title").alias("low"), F.col("rowId").alias("ord"))
    return resolve.first_by_names(mentions, gazetteer, ["title", "low"], "ord")


RESOLVE_FIRST_SQL = f"""
SELECT m.rowId AS id, f.place_id FROM {_ONCE} m JOIN (SELECT lower(trim(title, ' ')) AS k, arg_min(pleiadesId, rowId) AS place_id FROM {_PLACE} GROUP BY 1) f ON lower(trim(m.candidate, ' ')) = f.k
"""


def resolve_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gazetteer row of every candidate by line and confidence; rows loaded twice change nothing."""
    rows = table(spark, sf_dir, "place_conflict_context")
    mentions = rows.select(F.col("rowId").alias("id"), F.col("candidate").alias("place_name"), F.col("sourceLine").alias("line"), F.lit("").alias("qualifier"))
    gazetteer = rows.select(F.col("pleiadesId").alias("place_id"), F.col("pleiadesName").alias("name"), F.col("sourceLine").alias("line"), F.lit("").alias("qualifier"), F.when(F.col("tier") == 0, "accepted").when(F.col("tier") == 1, "confirmed").otherwise("hold").alias("confidence"), F.col("rowId").alias("ord"))
    return resolve.scored(mentions, gazetteer).select("id", "place_id", "score")


RESOLVE_SCORED_SQL = f"""
WITH p AS (SELECT m.rowId AS id, g.pleiadesId AS place_id, g.rowId AS ord, (CASE WHEN m.sourceLine = g.sourceLine THEN 250 ELSE 0 END) + (CASE WHEN g.tier = 0 THEN 5 WHEN g.tier = 1 THEN 3 ELSE -20 END) AS score
  FROM {_ONCE} m JOIN {_ONCE} g ON lower(trim(m.candidate, ' ')) = lower(trim(g.pleiadesName, ' ')))
SELECT id, place_id, score FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY greatest(score, 0) DESC, ord) = 1
"""


def entity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = _context(spark, sf_dir).select(F.col("rowId").alias("id"), F.col("sourceLine").alias("line"), "office", "unit", number_key("pleiadesId").alias("place_id"))
    return entity_page(mentions).select("place_id", "position", "id", "label")


ENTITY_SQL = f"""
SELECT place_id, row_number() OVER (PARTITION BY place_id ORDER BY sourceLine NULLS FIRST, rowId) AS position, rowId AS id, trim(regexp_replace(concat_ws(' ', office, unit), '\\s+', ' ', 'g')) AS label
FROM (SELECT *, TRY_CAST(TRY_CAST(trim(pleiadesId) AS DOUBLE) AS BIGINT) AS place_id FROM {_ONCE}) WHERE place_id IS NOT NULL
"""


def command_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = _context(spark, sf_dir)
    resolved = resolve_strict(spark, sf_dir).join(context.select(F.col("rowId").alias("id"), F.col("latitude").isNotNull().alias("has_coordinates")), "id")
    return stations(context.select(F.col("rowId").alias("id"), "chapter"), resolved.select("id", "status", "has_coordinates"))


STATIONS_SQL = f"""
WITH s AS ({RESOLVE_STRICT_SQL.strip().replace('WITH g AS', 'SELECT * FROM (WITH g AS', 1)}))
SELECT chapter, count(*) FILTER (status IN ('ID', 'UNIQUE') AND latitude IS NOT NULL) AS identified, count(*) FILTER (status = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (status = 'UNRESOLVED') AS unresolved,
  count(*) FILTER (status IN ('ID', 'UNIQUE') AND latitude IS NULL) AS no_coordinates FROM {_ONCE} m JOIN s ON s.id = m.rowId GROUP BY chapter
"""


def result_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _context(spark, sf_dir).select(number_key("pleiadesId").alias("place_id"))
    places = _places(spark, sf_dir).select(number_key("pleiadesId").alias("place_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return mapped_places(hits, places)


RESULT_PLACES_SQL = f"""
WITH h AS (SELECT DISTINCT TRY_CAST(TRY_CAST(trim(pleiadesId) AS DOUBLE) AS BIGINT) AS p FROM place_conflict_context WHERE TRY_CAST(trim(pleiadesId) AS DOUBLE) IS NOT NULL),
t AS (SELECT p, coalesce(bool_or(latitude IS NOT NULL AND longitude IS NOT NULL), false) AS there FROM h LEFT JOIN {_PLACE} ON CAST(pleiadesId AS BIGINT) = p GROUP BY p)
SELECT count(*) FILTER (there) AS mapped, count(*) FILTER (NOT there) AS missing FROM t
"""


def filter_any_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "place_conflict_context").agg(F.max_by("declaredProvince", "rowId")).scalar()
    return by_any_column(_context(spark, sf_dir), ["declaredProvince", "hardProvince", "softProvince", "expectedProvince"], wanted).select(F.col("rowId").alias("row_id"))


def filter_keep_all_if_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_all_if_empty(_context(spark, sf_dir), "occurrenceId", F.col("featureType") == "fort").select(F.col("rowId").alias("row_id"))


QUERIES = {
    "join_exact_multimap": join_exact_multimap, "join_multimap_lists": join_multimap_lists, "join_exact_then_variant": join_exact_then_variant, "join_prefix_rule": join_prefix_rule, "join_keep_last": join_keep_last, "join_update_blanks": join_update_blanks,
    "join_alias_closure": join_alias_closure, "join_scored_pick": join_scored_pick, "join_unique_or_null": join_unique_or_null, "join_fuzzy_blocked": join_fuzzy_blocked, "sim_token_best": sim_token_best, "sim_top2_blend": sim_top2_blend, "sim_ratio_candidates": sim_ratio_candidates,
    "sim_probe_unmatched": sim_probe_unmatched, "resolve_candidates": resolve_candidates, "resolve_context_status": resolve_context_status, "resolve_rank": resolve_rank, "resolve_decision": resolve_decision, "resolve_reports": resolve_reports, "resolve_local": resolve_local, "resolve_targets": resolve_targets,
    "resolve_strict": resolve_strict, "resolve_first_name": resolve_first_name, "resolve_scored": resolve_scored, "entity_page": entity_pages, "command_stations": command_stations, "result_places": result_places, "filter_any_province": filter_any_province,
    "filter_keep_all_if_empty": filter_keep_all_if_empty,
}
SQL = {
    "join_exact_multimap": JOIN_EXACT_SQL, "join_multimap_lists": f"SELECT title, row_number() OVER (PARTITION BY title ORDER BY rowId) AS position, pleiadesId FROM {_PLACE} WHERE title IS NOT NULL", "join_exact_then_variant": JOIN_VARIANT_SQL, "join_prefix_rule": JOIN_PREFIX_SQL,
    "join_keep_last": "SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", "join_update_blanks": JOIN_UPDATE_SQL, "join_alias_closure": JOIN_CLOSURE_SQL,
    "join_scored_pick": "SELECT l_orderkey, l_linenumber, (CASE WHEN l_returnflag = 'R' THEN 4 ELSE 0 END) + (CASE WHEN l_linestatus = 'O' THEN 2 ELSE 0 END) AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_extendedprice DESC, l_linenumber) = 1",
    "join_unique_or_null": "SELECT title, min(pleiadesId) AS pleiadesId FROM pleiades_place GROUP BY title HAVING count(DISTINCT pleiadesId) = 1", "join_fuzzy_blocked": JOIN_FUZZY_SQL, "sim_token_best": SIM_TOKEN_SQL, "sim_ratio_candidates": SIM_RATIO_SQL, "sim_probe_unmatched": SIM_PROBE_SQL, "resolve_context_status": RESOLVE_STATUS_SQL,
    "resolve_rank": RESOLVE_RANK_SQL, "resolve_decision": RESOLVE_DECISION_SQL, "resolve_local": RESOLVE_LOCAL_SQL, "resolve_targets": RESOLVE_TARGETS_SQL, "resolve_candidates": RESOLVE_CANDIDATES_SQL, "resolve_reports": RESOLVE_REPORTS_SQL, "resolve_strict": RESOLVE_STRICT_SQL, "resolve_first_name": RESOLVE_FIRST_SQL, "resolve_scored": RESOLVE_SCORED_SQL, "entity_page": ENTITY_SQL, "command_stations": STATIONS_SQL, "result_places": RESULT_PLACES_SQL,
    "filter_any_province": f"WITH f AS (SELECT arg_max(declaredProvince, rowId) AS p FROM place_conflict_context) SELECT DISTINCT rowId AS row_id FROM place_conflict_context, f WHERE declaredProvince = p OR hardProvince = p OR softProvince = p OR expectedProvince = p",
    "filter_keep_all_if_empty": f"SELECT rowId AS row_id FROM (SELECT *, max(CASE WHEN featureType = 'fort' THEN 1 ELSE 0 END) OVER (PARTITION BY occurrenceId) AS any_fort FROM {_ONCE}) WHERE featureType = 'fort' OR any_fort = 0",
}
