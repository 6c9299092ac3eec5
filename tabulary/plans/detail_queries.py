"""Single functions and lookups over the tables: kinds of blocks, details of lines, selections, overrides, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.functions import morphology as M
from tabulary.functions import rules as R
from tabulary.functions import similarity as Z
from tabulary.functions import text as X
from tabulary.functions.keys import number_key
from tabulary.operators import audit, extract, pages, publish, relational, render, resolve, search
from tabulary.operators import tree as T
from tabulary.plans.text_queries import _CLEAN, _LOW, _NORM, _SQ, _key
from tabulary.plans.tree_queries import _LINES, _STAR, _lines, _star, laid_out
from tabulary.session import scratch_path, table
from tabulary.sources import readers, writers

_ONCE = "(SELECT DISTINCT * EXCLUDE (loadedAt) FROM place_conflict_context)"
_ROWS = "rowId AS row_id"


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "place_conflict_context").dropDuplicates(["rowId"])


def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks read off region (its first word), unit and chapter: kind of block, kind of heading, and what is left as captions."""
    texts = _once(spark, sf_dir).select(F.explode(F.array(F.element_at(F.split("region", " "), 1), F.element_at(F.split("unit", " "), 1), F.col("chapter"), F.col("unit"))).alias("block")).where("block is not null").distinct()
    return texts.select("block", F.inline(F.array(R.block_kind(F.col("block")))), R.heading_kind(F.col("block")).alias("heading"))


BLOCK_SQL = f"""
WITH t AS (SELECT DISTINCT block FROM (SELECT unnest([string_split(region, ' ')[1], string_split(unit, ' ')[1], chapter, unit]) AS block FROM {_ONCE}) WHERE block IS NOT NULL)
SELECT block, CASE WHEN block IN ('Sub dispositione', 'Officium', 'Item', 'Sub cura', 'Sub iurisdictione', 'Extenditur') THEN 'structure' WHEN block IN ('Per', 'Intra', 'In', 'In provincia') THEN 'geography'
    WHEN block IN ('Vicarii', 'Comites rei militaris', 'Duces', 'Consulares', 'Correctores', 'Praesides', 'Magistri scriniorum') THEN 'administration'
    WHEN block IN ('Legiones palatinae', 'Legiones comitatenses', 'Auxilia', 'Pseudocomitatenses', 'Vexillationes palatinae', 'Vexillationes comitatenses', 'Limitanei') THEN 'military'
    WHEN block = 'Fabricae' THEN 'production' WHEN block = 'Rationales' OR starts_with(block, 'Procuratores') OR starts_with(block, 'Praepositi') THEN 'finance' ELSE 'unknown' END AS category,
  CASE block WHEN 'Sub dispositione' THEN 'office' WHEN 'Officium' THEN 'staff' WHEN 'Per' THEN 'region' WHEN 'Intra' THEN 'region' WHEN 'In' THEN 'region' WHEN 'In provincia' THEN 'province' WHEN 'Item' THEN 'continuation' WHEN 'Sub cura' THEN 'supervision'
    WHEN 'Sub iurisdictione' THEN 'jurisdiction' WHEN 'Extenditur' THEN 'note' WHEN 'Fabricae' THEN 'factoryGroup' ELSE CASE category WHEN 'administration' THEN 'officeGroup' WHEN 'finance' THEN 'officeGroup' WHEN 'military' THEN 'unitGroup' ELSE 'unknown' END END AS kind,
  category <> 'unknown' AND block <> 'Extenditur' AS container,
  CASE WHEN regexp_matches(block, '^(Sub dispositione|Officium|Per|Intra|In provincia|In |Item|Sub cura|Sub iurisdictione|Extenditur)') THEN '' WHEN regexp_matches(block, '^(Vicarii|Comites rei militaris|Duces|Consulares|Correctores|Praesides|Magistri scriniorum)') THEN 'officeGroup'
    WHEN regexp_matches(block, '^(Legiones|Auxilia|Pseudocomitatenses|Vexillationes|Limitanei)') THEN 'unitGroup' WHEN starts_with(block, 'Fabricae') THEN 'factoryGroup' WHEN regexp_matches(block, '^(Rationales|Procuratores|Praepositi)') THEN 'financeGroup' ELSE 'caption' END AS heading
FROM t
"""


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block texts that are neither structure nor a heading, each once."""
    return block_kinds(spark, sf_dir).where("heading = 'caption'").select("block").distinct()


def _index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index per document of the tables: chapter I lists offices and, under 'Per ..', regions with their places; chapter II follows."""
    rows = _once(spark, sf_dir).where("document is not null and chapter is not null").select(X.document_key(F.col("document")).alias("document"), "chapter", "region", "candidate", "rowId")
    part = rows.groupBy("document", "chapter", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("rowId", F.coalesce("candidate", F.lit("?")).alias("c")))), lambda s: F.concat(F.lit("          "), F.regexp_replace(s["c"], r"[.:\s]+", " "), F.lit("."))).alias("entries"))
    lines = part.select("document", "chapter", "region", F.concat(F.array(F.concat(F.lit("     Per "), F.regexp_replace(F.coalesce("region", F.lit("terras")), "^In ", ""), F.lit(":"))), "entries").alias("ls"))
    chapter = lines.groupBy("document", "chapter").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("region", F.lit("")).alias("r"), "ls"))).alias("p"))
    body = chapter.select("document", "chapter", F.concat(F.array(F.concat("chapter", F.lit(":"))), F.flatten(F.transform("p", lambda s: s["ls"]))).alias("ls"))
    whole = body.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("chapter", "ls"))).alias("p"))
    return whole.select("document", F.array_join(F.concat(F.array(F.lit("I. Index."), F.lit("Ante omnia.")), F.flatten(F.transform("p", lambda s: s["ls"])), F.array(F.lit("II. Dux."), F.lit("Ala."))), "\n").alias("text"))


def index_navigator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of each document as a tree of groups, regions and entries."""
    return T.index_navigator(T.with_chapters(T.lines_of(_index_text(spark, sf_dir))), R.INDEX_GROUPS)


def province_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the index below blocks of governors, with the region block that holds them."""
    nodes = T.parse_chapters(T.with_chapters(T.lines_of(_index_text(spark, sf_dir))), R.HEADINGS, R.UNITS)
    return T.province_references(nodes, [("Consularis", "Consulares"), ("Corrector", "Correctores"), ("Praeses", "Praesides"), ("Dux", "Duces")])


PROVINCE_ENTRIES_SQL = f"""
SELECT CASE WHEN contains(dk, 'occident') OR dk = 'occidens' THEN 'occidentis' WHEN contains(dk, 'orient') OR dk = 'oriens' THEN 'orientis' ELSE {_SQ('dk')} END AS document,
  CASE WHEN regexp_matches(chapter, '(?i)\\bConsularis\\b') THEN 'Consulares' WHEN regexp_matches(chapter, '(?i)\\bCorrector\\b') THEN 'Correctores' WHEN regexp_matches(chapter, '(?i)\\bPraeses\\b') THEN 'Praesides' WHEN regexp_matches(chapter, '(?i)\\bDux\\b') THEN 'Duces' END AS source_class,
  count(*) AS entries FROM (SELECT *, lower(replace(replace(trim(coalesce(document, '')), '_', ' '), '-', ' ')) AS dk FROM {_ONCE} WHERE document IS NOT NULL AND chapter IS NOT NULL) GROUP BY 1, 2 HAVING source_class IS NOT NULL
"""


def province_entry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries each class of governors has in each document's index."""
    return province_entries(spark, sf_dir).groupBy("document", "source_class").agg(F.count("*").alias("entries"))


def node_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of every node of the star schema as a tree: ids on the way up to the region, names of suppliers below them, and its own text."""
    nodes = _star(spark, sf_dir).withColumnRenamed("kind", "tag").withColumns({"ord": F.lit(1), "marks": F.array("node_id")})
    return T.context_text(nodes)


NODE_CONTEXT_SQL = _STAR.replace("WITH n", "WITH RECURSIVE n", 1) + f"""
, kids AS (SELECT parent_id AS id, array_to_string(list(trim(text, ' ') ORDER BY node_id), ' ') AS k FROM n WHERE kind = 'title' AND trim(text, ' ') <> '' GROUP BY 1),
part AS (SELECT n.node_id, parent_id, kind, text, n.node_id || coalesce(' ' || k, '') AS p FROM n LEFT JOIN kids ON kids.id = n.node_id),
up AS (SELECT node_id, p || ' ' || trim(coalesce(text, ''), ' ') AS c, parent_id AS nxt, kind FROM part WHERE parent_id IS NULL OR left(parent_id, 1) <> 'X'
  UNION ALL SELECT up.node_id, up.c || ' ' || part.p, part.parent_id, part.kind FROM up JOIN part ON part.node_id = up.nxt WHERE up.kind <> 'chapter')
SELECT node_id, trim(regexp_replace(lower(strip_accents(c)), '[^a-z0-9]+', ' ', 'g')) AS context FROM up WHERE kind = 'chapter'
"""


def chapter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer rows as chapters with the link of their chapter, by a delimited file written and read back."""
    rows = table(spark, sf_dir, "province_gazetteer").dropDuplicates(["rowId"]).select(X.document_key(F.col("document")).alias("document"), (F.col("rowId") % 90).cast("int").alias("chapter"), "rowId", "evidenceUrl")
    path = scratch_path(spark, "urls")
    writers.write_delimited(rows.orderBy("rowId").coalesce(1).select("document", "chapter", F.col("rowId").alias("start_folio"), F.col("evidenceUrl").alias("url")), path, ["document", "chapter", "title", "start_folio", "url", "status"])
    return readers.with_urls(rows.select("document", "chapter", F.col("rowId").alias("row_id")), readers.read_chapter_urls(spark, path)).select("row_id", "document", "chapter", "folio", "url")


CHAPTER_URLS_SQL = f"""
WITH g AS (SELECT DISTINCT rowId, evidenceUrl, CAST(rowId % 90 AS INTEGER) AS chapter, lower(replace(replace(trim(coalesce(document, '')), '_', ' '), '-', ' ')) AS dk FROM province_gazetteer),
d AS (SELECT *, CASE WHEN contains(dk, 'occident') OR dk = 'occidens' THEN 'occidentis' WHEN contains(dk, 'orient') OR dk = 'oriens' THEN 'orientis' ELSE {_SQ('dk')} END AS document FROM g),
u AS (SELECT document, chapter, max(rowId) AS folio, arg_max(trim(evidenceUrl, ' '), rowId) AS url FROM d WHERE document <> '' AND chapter <> 0 AND trim(evidenceUrl, ' ') <> '' GROUP BY 1, 2)
SELECT rowId AS row_id, d.document, d.chapter, CAST(folio AS VARCHAR) AS folio, url FROM d LEFT JOIN u ON u.document = d.document AND u.chapter = d.chapter
"""


def selected_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each candidate name, with its document as qualifier, the mentions by pleiadesName that are shown and the selected one."""
    once = _once(spark, sf_dir)
    clicks = once.select(F.col("rowId").alias("id"), F.col("candidate").alias("name"), F.col("featureType").alias("qualifier"), F.col("sourceLine").alias("line"))
    mentions = once.select(F.col("rowId").alias("mention_id"), F.col("pleiadesName").alias("name"), F.col("featureType").alias("qualifier"), F.col("sourceLine").alias("line"))
    return pages.selected_mentions(clicks, mentions)


SELECTED_SQL = f"""
WITH m AS (SELECT rowId, lower({_SQ("coalesce(pleiadesName, '')")}) AS k, lower({_SQ("coalesce(featureType, '')")}) AS q, sourceLine AS l FROM {_ONCE}),
c AS (SELECT rowId AS id, lower({_SQ("coalesce(candidate, '')")}) AS k, lower({_SQ("coalesce(featureType, '')")}) AS q, sourceLine AS l FROM {_ONCE}),
p AS (SELECT id, m.rowId, c.q <> '' AND m.q = c.q AS same, m.l = c.l AS on_line FROM c JOIN m ON m.k = c.k AND c.k <> ''),
f AS (SELECT *, bool_or(same) OVER (PARTITION BY id) AS any_same FROM p),
s AS (SELECT id, count(*) AS n, min(rowId) AS one, min(CASE WHEN on_line THEN rowId END) AS lined FROM f WHERE same OR NOT any_same GROUP BY id)
SELECT c.id, coalesce(n, 0) AS shown, coalesce(lined, CASE WHEN n = 1 THEN one END) AS selected FROM c LEFT JOIN s USING (id)
"""


def picked_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row the other mention of its names that shares document, chapter, unit and office best; rows loaded twice change nothing."""
    rows = table(spark, sf_dir, "place_conflict_context")
    keys = ["document", "chapter", "unit", "office"]
    places = rows.select(F.col("rowId").alias("id"), F.array("candidate", "pleiadesName").alias("names"), *keys)
    occurrences = rows.select(F.col("rowId").alias("occurrence_id"), F.col("rowId").alias("ord"), F.col("placeName").alias("name"), *keys)
    return pages.picked_occurrences(places, occurrences)


PICKED_SQL = f"""
WITH o AS (SELECT rowId, {', '.join(f"lower({_SQ(f'''coalesce({c}, '')''')}) AS {c}" for c in ('placeName', 'candidate', 'pleiadesName', 'document', 'chapter', 'unit', 'office'))} FROM {_ONCE}),
p AS (SELECT a.rowId AS id, b.rowId AS occurrence_id, CASE WHEN a.document <> '' AND a.document = b.document THEN 4 ELSE 0 END + CASE WHEN a.chapter <> '' AND a.chapter = b.chapter THEN 4 ELSE 0 END + CASE WHEN a.unit <> '' AND a.unit = b.unit THEN 3 ELSE 0 END
    + CASE WHEN a.office <> '' AND a.office = b.office THEN 2 ELSE 0 END AS score FROM (SELECT *, unnest(list_distinct([candidate, pleiadesName])) AS name FROM o) a JOIN o b ON b.placeName = a.name AND a.name <> '')
SELECT id, occurrence_id, score FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, occurrence_id) = 1
"""


def easy_wins(spark: SparkSession, sf_dir: str, limit: int = 30) -> DataFrame:
    """The first 30 occurrences that are ambiguous for a reason easy to settle, with their first five candidates: a report of 30, hence the limit."""
    once = _once(spark, sf_dir).where("occurrenceId is not null")
    count = lambda c: F.count_if(c)
    facts = once.groupBy("occurrenceId").agg(count(F.col("contextStatus") == "HARD_MATCH").alias("h"), count(F.col("contextStatus") == "SOFT_MATCH").alias("s"), count(F.col("nameSimilarity") >= 0.999).alias("x"), count(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("l"))
    easy = facts.withColumn("category", R.ambiguity_category(F.col("h"), F.col("s"), F.col("x"), F.col("l"))).where(F.col("category").isin("ONE_COORDINATED_CANDIDATE", "MULTIPLE_HARD_MATCH", "MULTIPLE_SOFT_MATCH"))
    first = easy.select("occurrenceId", "category").orderBy("occurrenceId").limit(limit)
    return relational.top_n(once.join(first, "occurrenceId"), ["occurrenceId"], 5, F.asc("rowId")).select("occurrenceId", "category", "rank", F.col("rowId").alias("row_id"))


EASY_SQL = f"""
WITH f AS (SELECT occurrenceId, count_if(contextStatus = 'HARD_MATCH') AS h, count_if(contextStatus = 'SOFT_MATCH') AS s, count_if(nameSimilarity >= 0.999) AS x, count_if(latitude IS NOT NULL AND longitude IS NOT NULL) AS l FROM {_ONCE} WHERE occurrenceId IS NOT NULL GROUP BY 1),
e AS (SELECT occurrenceId, CASE WHEN h > 0 THEN 'MULTIPLE_HARD_MATCH' WHEN s > 0 THEN 'MULTIPLE_SOFT_MATCH' WHEN x >= 2 OR l <> 1 THEN '' ELSE 'ONE_COORDINATED_CANDIDATE' END AS category FROM f),
t AS (SELECT * FROM e WHERE category <> '' ORDER BY occurrenceId LIMIT 30)
SELECT occurrenceId, category, CAST(k AS INTEGER) AS rank, row_id FROM (SELECT occurrenceId, category, rowId AS row_id, row_number() OVER (PARTITION BY occurrenceId ORDER BY rowId) AS k FROM {_ONCE} JOIN t USING (occurrenceId)) WHERE k <= 5
"""


def line_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the second line of every document, '' where there is none."""
    wanted = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document"), F.lit(2).alias("line"))
    return T.line_text(T.lines_of(laid_out(spark, sf_dir)), wanted).select("document", "line", "source_text")


LINE_SQL = _LINES + f"SELECT CAST(doc_id AS VARCHAR) AS document, 2 AS line, coalesce({_SQ('l.raw')}, '') AS source_text FROM documents LEFT JOIN l ON l.document = CAST(doc_id AS VARCHAR) AND l.line = 2"


def combined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in one text, each after a line that names it."""
    return readers.combined(T.lines_of(laid_out(spark, sf_dir))).select("document", "line", F.trim("raw").alias("raw"))


COMBINED_SQL = _LINES + "SELECT document, line, trim(raw, ' ') AS raw FROM l UNION ALL SELECT DISTINCT document, 0, 'DOCUMENT: ' || document FROM l"


def own_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's own text: the names of its suppliers by kind, not those of its customers."""
    nodes = _star(spark, sf_dir)
    kids = T.children_text(nodes.select(F.col("parent_id").alias("parent"), F.when(F.col("kind") == "title", "office").otherwise("client").alias("tag"), "text", F.col("node_id").alias("ord")))
    joined = nodes.where("kind = 'block' and node_id like 'N%'").join(kids, F.col("node_id") == F.col("parent"), "left")
    return joined.select("node_id", T.own_text(F.lit(""), F.col("texts"), F.col("text")).alias("own"), F.coalesce(F.size("texts.client"), F.lit(0)).alias("clients"))


OWN_SQL = _STAR + """
SELECT n.node_id, coalesce(nullif(max(s.t), ''), CASE WHEN max(s.t) IS NULL AND max(c.k) IS NULL THEN n.text ELSE '' END) AS own, coalesce(max(c.k), 0)::INTEGER AS clients FROM n
LEFT JOIN (SELECT parent_id, string_agg(text, ' ' ORDER BY node_id) AS t FROM n WHERE kind = 'title' GROUP BY 1) s ON s.parent_id = n.node_id LEFT JOIN (SELECT parent_id, count(*) AS k FROM n WHERE kind <> 'title' AND parent_id IS NOT NULL GROUP BY 1) c ON c.parent_id = n.node_id
WHERE n.node_id LIKE 'N%' GROUP BY n.node_id, n.text
"""


def workshop_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workshop lines composed of every placeName: production first with its place, or the place first."""
    names = _once(spark, sf_dir).where("trim(candidate) <> '' and candidate not like '%,%'").select(X.squeeze(F.regexp_replace("candidate", r"[^\p{L} ]", "")).alias("p")).where("p <> ''").distinct()
    lines = names.select(F.explode(F.array(F.concat(F.lit("Scutaria, "), "p", F.lit(".")), F.concat("p", F.lit(" scutaria.")))).alias("text"))
    return extract.factory_geography(lines, ["africae"]).select("text", "unit", F.inline_outer("geo")).select("text", F.coalesce("unit", F.lit("")).alias("made"), "tag", "value", "source")


def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of every place: its title and descriptions as attested and romanised forms."""
    places = table(spark, sf_dir, "pleiades_place").dropDuplicates(["rowId"])
    record = places.select("rowId", F.struct("title", F.array(F.struct(F.col("featureType").alias("attested"), F.concat_ws(", ", "title", F.upper("title")).alias("romanized"))).alias("names")).alias("r"))
    return record.select(F.col("rowId").alias("row_id"), F.array_join(extract.names_of_place(), "|").alias("names"))


def single_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of single texts: production, the place before it, kind of a tail, prefixes, qualifiers, numbers."""
    unit, region = F.coalesce("unit", F.lit("")), F.coalesce("region", F.lit(""))
    made = F.concat(F.coalesce("candidate", F.lit("")), F.lit(" scutaria"))
    return _once(spark, sf_dir).select(
        F.col("rowId").alias("row_id"), R.starts_production(F.concat(F.lit(";scutaria "), unit)).alias("production"), R.starts_production(unit).alias("no_production"), R.factory_place(made).alias("factory_place"),
        R.geo_tail_type(F.coalesce("unit", F.lit("x")), ["africae"]).alias("tail"), X.strip_admin_prefix(F.concat(F.lit("provinciae "), region)).alias("bare"), extract.number_or_zero(F.col("pleiadesId")).alias("number"),
        F.array_join(M.qualifier_variants(F.concat(F.coalesce("candidate", F.lit("")), F.lit(" (Raetia ii)"))), "|").alias("qualifiers"),
        X.key_contains(X.stem_key(F.concat_ws(" ", "chapter", "region")), X.stem_key(F.col("chapter"))).alias("contains"),
        Z.bounded_edits(X.latin_key(F.col("candidate")), X.latin_key(F.col("pleiadesName")), 2).alias("edits"),
    )


SINGLE_SQL = f"""
SELECT {_ROWS}, true AS production, false AS no_production, regexp_replace(trim(coalesce(candidate, ''), ' '), '[.]+$', '') AS factory_place,
  CASE WHEN list_has_any(string_split(regexp_replace(lower(regexp_replace({_SQ("coalesce(unit, 'x')")}, '[.]$', '')), '\\s+', ' ', 'g'), ' '), ['officium', 'officiales', 'milites', 'equites', 'cohors', 'cohortis', 'ala', 'alae', 'legio', 'legionis', 'scutaria']) THEN 'none' ELSE 'place' END AS tail,
  regexp_replace({_SQ("coalesce(region, '')")}, '[.]$', '') AS bare, coalesce(TRY_CAST(pleiadesId AS DOUBLE), 0.0) AS number, 'raetia ii|raetia secunda' AS qualifiers, true AS contains,
  CASE WHEN levenshtein({_key('candidate')}, {_key('pleiadesName')}) > 2 THEN 3 ELSE levenshtein({_key('candidate')}, {_key('pleiadesName')}) END AS edits
FROM {_ONCE}
"""


def place_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one type of all mentions of a place, or mixed."""
    once = _once(spark, sf_dir).withColumn("k", number_key("pleiadesId")).where("k is not null")
    types = once.groupBy("k").agg(F.collect_set(R.mention_type(F.col("unit"), F.col("office"), F.col("placeSource"))).alias("types"))
    return types.select(F.col("k").alias("place_id"), R.place_type(F.col("types")).alias("place_type"))


PLACE_TYPES_SQL = f"""
WITH m AS (SELECT TRY_CAST(TRY_CAST(trim(pleiadesId) AS DOUBLE) AS BIGINT) AS place_id, CASE WHEN lower(placeSource) = 'factory' THEN 'factory' WHEN regexp_matches(lower(concat_ws(' ', office, unit)), '\\btribun') THEN 'tribune' WHEN regexp_matches(lower(concat_ws(' ', office, unit)), '\\bequit') THEN 'cavalry'
    WHEN regexp_matches(lower(concat_ws(' ', office, unit)), '\\b(dux|ducis)\\b') THEN 'dux' WHEN regexp_matches(lower(concat_ws(' ', office, unit)), '\\bcom(es|itis)\\b') THEN 'comes' WHEN coalesce(office, '') <> '' THEN 'office' ELSE 'other' END AS t FROM {_ONCE})
SELECT place_id, CASE WHEN count(DISTINCT t) > 1 THEN 'mixed' ELSE min(t) END AS place_type FROM m WHERE place_id IS NOT NULL GROUP BY 1
"""


def gazetteer_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gazetteer row of every reference name by any of three names, the source name before the others."""
    once = _once(spark, sf_dir)
    units = table(spark, sf_dir, "place_name_list").select(F.col("name_id").alias("id"), F.col("canonical_name").alias("source_place"))
    rows = once.select(F.col("rowId").alias("ord"), F.col("candidate").alias("source_name"), F.col("placeName").alias("place_name"), F.col("pleiadesName").alias("pleiades_name"), F.when(F.col("tier") == 0, "confirmed").otherwise("hold").alias("confidence"), F.col("pleiadesId").alias("place_id"))
    return render.gazetteer_choice(units, rows).select("id", F.col("ord").alias("row_id"))


_REND = lambda x: f"regexp_replace(lower({_SQ(f'''coalesce({x}, '')''')}), '[.,;:]+$', '')"
CHOICES_SQL = f"""
WITH u AS (SELECT name_id AS id, {_REND('canonical_name')} AS k FROM place_name_list), g AS (SELECT rowId, {_REND('candidate')} AS a, {_REND('placeName')} AS b, {_REND('pleiadesName')} AS c, coalesce(tier = 0, false) AS sure FROM {_ONCE})
SELECT id, rowId AS row_id FROM u JOIN g ON k <> '' AND (k = a OR k = b OR k = c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY (k = a) DESC, sure DESC, rowId) = 1
"""


def scored_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored lookup with qualifiers, and with a table of overrides that decides for a third of the names; rows loaded twice change nothing."""
    rows = table(spark, sf_dir, "place_conflict_context")
    mentions = rows.select(F.col("rowId").alias("id"), F.col("candidate").alias("place_name"), F.col("sourceLine").alias("line"), F.coalesce("featureType", F.lit("")).alias("qualifier"))
    gazetteer = rows.select(F.col("pleiadesId").alias("place_id"), F.col("pleiadesName").alias("name"), F.col("sourceLine").alias("line"), F.coalesce("featureType", F.lit("")).alias("qualifier"), F.when(F.col("tier") == 0, "accepted").otherwise("hold").alias("confidence"), F.col("rowId").alias("ord"))
    overrides = table(spark, sf_dir, "place_name_list").where("name_id % 3 = 0").select(F.col("canonical_name").alias("place_name"), F.concat(F.lit("L"), "name_id").alias("place_id")).dropDuplicates(["place_name"])
    return resolve.scored(mentions, gazetteer, overrides).select("id", "place_id", "score")


OVERRIDES_SQL = f"""
WITH o AS (SELECT canonical_name, 'L' || name_id AS place_id FROM place_name_list WHERE name_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY canonical_name ORDER BY name_id) = 1),
p AS (SELECT m.rowId AS id, g.pleiadesId AS place_id, g.rowId AS ord, coalesce(CASE WHEN m.sourceLine = g.sourceLine THEN 250 ELSE 0 END, 0) + (CASE WHEN coalesce(m.featureType, '') <> '' AND lower(m.featureType) = lower(g.featureType) THEN 25 ELSE 0 END) + (CASE WHEN g.tier = 0 THEN 5 ELSE -20 END) AS score
  FROM {_ONCE} m JOIN {_ONCE} g ON lower(trim(m.candidate, ' ')) = lower(trim(g.pleiadesName, ' '))),
b AS (SELECT id, place_id, score FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY greatest(score, 0) DESC, ord) = 1)
SELECT m.rowId AS id, coalesce(o.place_id, b.place_id) AS place_id, CASE WHEN o.place_id IS NOT NULL THEN 1000 ELSE b.score END AS score FROM {_ONCE} m LEFT JOIN o ON o.canonical_name = m.candidate LEFT JOIN b ON b.id = m.rowId WHERE o.place_id IS NOT NULL OR b.id IS NOT NULL
"""


def search_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best hits for a word of the tables, with their place in the order by score and line: a report of twenty, hence the limit."""
    once = _once(spark, sf_dir)
    fields = (search.Field("unit", 140), search.Field("chapter", 80, "context"))
    index = search.index(once.select(F.col("rowId").alias("id"), "unit", "chapter", F.col("sourceLine").alias("line")), fields)
    hits = search.search(index, "cohors", fields).select("id", "score").join(once.select(F.col("rowId").alias("id"), F.col("sourceLine").alias("line")), "id")
    best = hits.orderBy(F.desc("score"), F.asc_nulls_first("line"), F.asc("id")).limit(20)
    return relational.positions(best, [], F.desc("score"), F.asc_nulls_first("line"), F.asc("id")).select("position", "id")


SEARCH_ORDER_SQL = f"""
WITH h AS (SELECT rowId, sourceLine, CASE WHEN regexp_matches(' ' || {_NORM('unit')} || ' ', ' cohors ') THEN 1 ELSE 0 END AS hit, {_LOW('unit')} = 'cohors' AS exact FROM {_ONCE} WHERE contains({_LOW('unit')}, 'cohors'))
SELECT row_number() OVER (ORDER BY exact DESC, hit DESC, sourceLine NULLS FIRST, rowId) AS position, rowId AS id FROM h QUALIFY position <= 20
"""


def document_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged shape of the JSON in events.props."""
    return readers.shape(table(spark, sf_dir, "events").select(F.col("props").alias("text")).where("props is not null"))


def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as one JSON array a file and read back member by member."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    path = scratch_path(spark, "graph")
    packed = events.groupBy((F.col("event_id") % 4).alias("f")).agg(F.to_json(F.struct(F.collect_list(F.struct("event_id", "event_type")).alias("@graph"))).alias("value"))
    packed.write.partitionBy("f").text(path)
    files = spark.read.text(path).inputFiles()
    return readers.json_array(spark, files).select(F.get_json_object("item", "$.event_id").cast("bigint").alias("event_id"), F.get_json_object("item", "$.event_type").alias("event_type"))


def xml_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put into XML without escaping that do not parse."""
    texts = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("document"), F.concat(F.lit("<t>"), F.when(F.col("doc_id") % 2 == 0, F.lit("a < b")).otherwise("plain"), F.lit("</t>")).alias("text"))
    return readers.xml_errors(texts).select("document", F.col("error").contains("not well-formed").alias("malformed"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit report written as lines of text and read back."""
    report = _once(spark, sf_dir).groupBy("placeSource").agg(F.count("*").alias("value")).select(F.lit("source").alias("section"), F.coalesce("placeSource", F.lit("-")).alias("key"), "value")
    path = scratch_path(spark, "report")
    writers.write_report(report, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer ids of the context that no place has, in force or not: keys that a completeness check reports."""
    keys = _once(spark, sf_dir).select(number_key("pleiadesId").alias("k")).where("k is not null").distinct()
    return keys.join(table(spark, sf_dir, "pleiades_place").select(number_key("pleiadesId").alias("k")), "k", "left_anti")


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer ids with more than one period, which a check for unique keys reports."""
    return audit.duplicates(table(spark, sf_dir, "pleiades_place").where("pleiadesId is not null").dropDuplicates(["rowId"]), "pleiadesId")


def alias_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose unit carries an alias that the gazetteer of the table gives for their chapter."""
    once = _once(spark, sf_dir)
    aliases = once.where("tier = 0 and unit is not null").groupBy("chapter", F.col("unit").alias("alias")).agg(F.min("region").alias("region"))
    return publish.region_of(once.select(F.col("rowId").alias("id"), "chapter", F.col("unit").alias("text")), aliases.where("region is not null"))


ALIAS_SQL = f"""
WITH k AS (SELECT *, lower({_SQ("regexp_replace(trim(nfc_normalize(coalesce(unit, ''))), '[.?:;,]+$', '')")}) AS a FROM {_ONCE}), s AS (SELECT chapter, unit, min(region) AS region FROM k WHERE tier = 0 AND unit IS NOT NULL GROUP BY 1, 2),
r AS (SELECT DISTINCT chapter, lower({_SQ("regexp_replace(trim(nfc_normalize(unit)), '[.?:;,]+$', '')")}) AS a, region FROM s WHERE region IS NOT NULL)
SELECT rowId AS id, r.region FROM k JOIN r ON r.chapter = k.chapter AND r.a = k.a
"""


def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table itself once its required columns are there; a missing one raises."""
    places = table(spark, sf_dir, "pleiades_place")
    audit.require_columns(places, ["pleiadesId", "title", "latitude", "longitude"])
    return places.agg(F.count("*").alias("n"))


QUERIES = {
    "block_kinds": block_kinds, "captions": captions, "index_navigator": index_navigator, "province_entries": province_entries, "province_entry_counts": province_entry_counts, "node_context": node_context, "chapter_urls": chapter_urls, "selected_mentions": selected_mentions,
    "picked_occurrences": picked_occurrences, "easy_wins": easy_wins, "line_lookup": line_lookup, "combined_lines": combined_lines, "own_texts": own_texts, "workshop_lines": workshop_lines, "place_names": place_names, "single_rules": single_rules, "place_types": place_types,
    "gazetteer_choices": gazetteer_choices, "scored_overrides": scored_overrides, "search_order": search_order, "document_shape": document_shape, "json_members": json_members, "xml_problems": xml_problems, "report_lines": report_lines, "missing_references": missing_references,
    "duplicate_keys": duplicate_keys, "alias_regions": alias_regions, "required_columns": required_columns,
}
SQL = {
    "block_kinds": BLOCK_SQL, "captions": f"SELECT block FROM ({BLOCK_SQL}) WHERE heading = 'caption'", "province_entry_counts": PROVINCE_ENTRIES_SQL, "node_context": NODE_CONTEXT_SQL, "chapter_urls": CHAPTER_URLS_SQL, "selected_mentions": SELECTED_SQL, "picked_occurrences": PICKED_SQL,
    "easy_wins": EASY_SQL, "line_lookup": LINE_SQL, "combined_lines": COMBINED_SQL, "own_texts": OWN_SQL, "single_rules": SINGLE_SQL, "place_types": PLACE_TYPES_SQL, "gazetteer_choices": CHOICES_SQL, "scored_overrides": OVERRIDES_SQL, "search_order": SEARCH_ORDER_SQL,
    "json_members": "SELECT event_id, event_type FROM events", "xml_problems": "SELECT CAST(doc_id AS VARCHAR) AS document, true AS malformed FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0",
    "report_lines": f"SELECT 'source' || chr(9) || coalesce(placeSource, '-') || chr(9) || CAST(count(*) AS VARCHAR) AS line FROM {_ONCE} GROUP BY placeSource",
    "missing_references": "SELECT DISTINCT TRY_CAST(TRY_CAST(trim(pleiadesId) AS DOUBLE) AS BIGINT) AS k FROM place_conflict_context WHERE k IS NOT NULL AND k NOT IN (SELECT CAST(pleiadesId AS BIGINT) FROM pleiades_place)",
    "duplicate_keys": "SELECT pleiadesId, count(*) AS n FROM (SELECT DISTINCT rowId, pleiadesId FROM pleiades_place) WHERE pleiadesId IS NOT NULL GROUP BY 1 HAVING n > 1", "alias_regions": ALIAS_SQL, "required_columns": "SELECT count(*) AS n FROM pleiades_place",
}
