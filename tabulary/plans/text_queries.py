"""Normalisers, morphology, classification and extraction over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.functions import morphology as M
from tabulary.functions import rules as R
from tabulary.functions import text as X
from tabulary.operators import extract as E
from tabulary.operators.multivalue import packed_fields, split_values
from tabulary.session import table


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "place_conflict_context").dropDuplicates(["rowId"])
    return once.select(F.col("rowId").alias("row_id"), "placeName", "pleiadesName", "candidate", "office", "unit", "chapter", "region", "document", "placeSource", "contextText", "featureType", "latitude", "longitude")


def text_norm_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("pleiadesName")
    return _places(spark, sf_dir).select(
        "row_id", X.clean_name(c).alias("clean"), X.norm_name(c).alias("norm"), X.latin_key(c).alias("latin_key"), X.norm_gazetteer(c).alias("gazetteer"), X.norm_province(c).alias("province"), X.norm_probe(c).alias("probe"),
        X.norm_search(c).alias("search"), X.norm_place_text(c).alias("place_text"), X.search_stem(c).alias("stem6"), X.clean_name_local(c).alias("local"),
    )


_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^[ .,;:()\\[\\]-]+', ''), '[ .,;:()\\[\\]-]+$', '')"
_SQ = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_CLEAN = lambda x: _STRIP(_SQ(f"replace(replace(strip_accents(coalesce({x}, '')), 'æ', 'ae'), 'Æ', 'Ae')"))
_NORM = lambda x: f"trim(regexp_replace(lower({_CLEAN(x)}), '[^a-z0-9]+', ' ', 'g'))"


def _key(x: str) -> str:
    sql = _NORM(x)
    for a, b in (("j", "i"), ("v", "u"), ("y", "i"), ("ph", "f"), ("th", "t"), ("ch", "c"), ("ae", "e"), ("oe", "e"), (" ", "")):
        sql = f"replace({sql}, '{a}', '{b}')"
    return sql


_ONCE = "(SELECT DISTINCT * EXCLUDE (loadedAt) FROM place_conflict_context)"
_LOW = lambda x: f"trim(lower(strip_accents(coalesce({x}, ''))))"
TEXT_NORM_SQL = f"""
SELECT rowId AS row_id, {_CLEAN('pleiadesName')} AS clean, {_NORM('pleiadesName')} AS norm, {_key('pleiadesName')} AS latin_key,
  regexp_replace(regexp_replace({_LOW('pleiadesName')}, '[.,;:()\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g') AS gazetteer,
  regexp_replace(regexp_replace(replace(replace(replace({_LOW('pleiadesName')}, 'ph', 'f'), 'y', 'i'), 'v', 'u'), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g') AS province,
  regexp_replace(regexp_replace(replace(replace({_LOW('pleiadesName')}, 'j', 'i'), 'u', 'v'), '[.,;:()\\[\\]{{}}''’"*/?]', ' ', 'g'), '\\s+', ' ', 'g') AS probe,
  lower(strip_accents({_SQ("coalesce(pleiadesName, '')")})) AS search, trim(regexp_replace(lower(strip_accents(coalesce(pleiadesName, ''))), '[^a-z0-9]+', ' ', 'g')) AS place_text,
  left(replace(trim(regexp_replace(lower(strip_accents(coalesce(pleiadesName, ''))), '[^a-z0-9]+', ' ', 'g')), ' ', ''), 6) AS stem6,
  {_STRIP(_SQ("regexp_replace(regexp_replace(strip_accents(coalesce(pleiadesName, '')), '^[(].*?[)]\\s*', ''), '^[.]+\\s*', '')"))} AS local
FROM {_ONCE}
"""


def text_fold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("unit")
    return _places(spark, sf_dir).select(
        "row_id", X.clean_line(c).alias("line"), X.folded_line(c).alias("folded"), X.folded_mention(c).alias("mention"), X.norm_rendering(c).alias("rendering"), X.norm_form(c).alias("form"), X.norm_label(c).alias("label"),
        X.norm_jurisdiction(c).alias("jurisdiction"), X.norm_place_name(c).alias("name"), X.norm_display(c).alias("display"), X.clean_report(c).alias("report"), X.document_key(F.col("document")).alias("document"), X.strip_editorial(F.col("candidate")).alias("no_notes"),
        X.html_escaped(F.col("candidate")).alias("html"), X.unquoted(F.col("candidate")).alias("unquoted"),
    )


_U = "coalesce(unit, '')"
TEXT_FOLD_SQL = f"""
WITH o AS (SELECT *, trim({_U}) AS u, lower(replace(replace(trim(coalesce(document, '')), '_', ' '), '-', ' ')) AS dk FROM {_ONCE}),
l AS (SELECT *, CASE WHEN u LIKE '%.' AND NOT regexp_matches(u, '[,:;]') THEN left(u, length(u) - 1) ELSE u END AS line FROM o)
SELECT rowId AS row_id, line, regexp_replace(lower(line), '\\s+', ' ', 'g') AS folded, lower({_SQ(_U)}) AS mention, regexp_replace(lower({_SQ(_U)}), '[.,;:]+$', '') AS rendering,
  lower({_SQ("regexp_replace(u, '[.?:;,]+$', '')")}) AS form, lower(trim(regexp_replace({_SQ(_U)}, '[.]$', ''))) AS label, lower(trim(regexp_replace({_SQ(_U)}, '[.:;]+$', ''))) AS jurisdiction,
  lower(u) AS name, lower({_SQ(_U)}) AS display, {_SQ("regexp_replace(u, '[.:]+$', '')")} AS report,
  CASE WHEN contains(dk, 'occident') OR dk = 'occidens' THEN 'occidentis' WHEN contains(dk, 'orient') OR dk = 'oriens' THEN 'orientis' ELSE {_SQ('dk')} END AS document,
  {_SQ("regexp_replace(coalesce(candidate, ''), '[[][^]]*[]]', '', 'g')")} AS no_notes,
  replace(replace(replace(replace(replace(coalesce(candidate, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
  CASE WHEN regexp_matches(trim(coalesce(candidate, '')), '^".*"$') THEN replace(trim(coalesce(candidate, ''))[2:-2], '""', '"') ELSE replace(trim(coalesce(candidate, '')), '""', '"') END AS unquoted
FROM l
"""


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("chapter")
    return _places(spark, sf_dir).select("row_id", F.array_join(X.meaningful_tokens(c), " ").alias("meaningful"), F.array_join(X.province_tokens(F.col("region")), " ").alias("province"), F.array_join(X.stem_key(c), " ").alias("stems"), X.block_type(c).alias("block"), F.array_join(X.place_phrase(F.col("region")), "|").alias("phrase"))


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_STEM_CASE = "CASE " + " ".join(f"WHEN w = '{word}' THEN '{s}'" for word, s in X.STEMS.items()) + " " + " ".join(f"WHEN w LIKE '%{e}' AND length(w) >= {len(e) + 4} THEN left(w, length(w) - {len(e)})" for e in X.STEM_ENDINGS) + " ELSE w END"
_HEADS = "CASE " + " ".join(f"WHEN starts_with(t, '{h}') THEN '{h.strip()}'" for h in X.BLOCK_HEADS)
_CUTS = "CASE " + " ".join(f"WHEN len(bw) >= 2 AND bw[1] = '{w}' THEN array_to_string(bw[1:{n}], ' ')" for w, n in X.BLOCK_WORDS.items()) + " ELSE plain END"
TEXT_TOKENS_SQL = f"""
WITH o AS (SELECT rowId, chapter, region, trim(coalesce(chapter, '')) AS t, {_NORM('chapter')} AS n, {_NORM('region')} AS r FROM {_ONCE}),
b AS (SELECT *, {_SQ("regexp_replace(t, '(?i)\\b(" + "|".join(X.NUMERALS) + ")\\b', '', 'g')")} AS plain FROM o),
c AS (SELECT *, string_split(plain, ' ') AS bw,
  list_filter(string_split(trim(regexp_replace(regexp_replace(lower({_SQ("coalesce(chapter, '')")}), '\\bin\\s+praesenti\\b', 'praesentalis', 'g'), '[^a-z]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({_in(X.STEM_STOPWORDS)})) AS sw FROM b)
SELECT rowId AS row_id, array_to_string(list_filter(string_split(n, ' '), lambda w: length(w) >= 3 AND w NOT IN ({_in(X.TITLE_STOPWORDS)})), ' ') AS meaningful,
  array_to_string(list_filter(string_split(r, ' '), lambda w: length(w) > 2 AND w NOT IN ({_in(X.PROVINCE_STOPWORDS)})), ' ') AS province,
  array_to_string(list_transform(sw, lambda w: {_STEM_CASE}), ' ') AS stems, {_HEADS} ELSE {_CUTS} END AS block,
  array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(trim(coalesce(region, '')), '(?i)^(urbis|civitatis)\\s+', ''), '(?i)\\s+et\\s+'), lambda p: trim(p)), lambda p: p <> ''), '|') AS phrase
FROM c
"""


def _rule_sql(word: str, rules: list[M.Rule]) -> str:
    """UNION ALL of the forms of `word` in table w(row_id, word), one branch per rule."""
    return " UNION ALL ".join(f"SELECT row_id, {i} AS o, left({word}, length({word}) - {cut}) || '{add}' AS form FROM w WHERE lower({word}) LIKE '%{end}' AND length({word}) >= {least}" for i, (end, least, cut, add) in enumerate(rules, 1))


def morph_case_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "place_name_list")
    return once.select(F.col("name_id").alias("row_id"), F.posexplode(M.case_variants(F.col("canonical_name"))).alias("ord", "form"))


MORPH_CASE_SQL = f"""
WITH n AS (SELECT name_id AS row_id, {_CLEAN('canonical_name')} AS clean FROM place_name_list),
w AS (SELECT row_id, clean, string_split(clean, ' ')[-1] AS word, array_to_string(string_split(clean, ' ')[:-2], ' ') AS head FROM n),
f AS (SELECT row_id, 0 AS o, clean AS form FROM n UNION ALL SELECT f.row_id, f.o, trim(w.head || ' ' || f.form) FROM ({_rule_sql('word', M.CASE_FORMS)}) f JOIN w USING (row_id)),
d AS (SELECT row_id, form, min(o) AS o FROM f GROUP BY row_id, form)
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY o) - 1 AS INTEGER) AS ord, form FROM d
"""


def morph_gazetteer_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "province_gazetteer").dropDuplicates(["rowId"])
    return once.select(F.col("rowId").alias("row_id"), F.array_join(F.array_sort(M.gazetteer_variants(F.col("canonicalName"))), "|").alias("gazetteer"), F.array_join(F.array_sort(M.probe_variants(F.col("canonicalName"))), "|").alias("probe"))


MORPH_GAZETTEER_SQL = f"""
WITH n AS (SELECT DISTINCT rowId AS row_id, {_LOW('canonicalName')} AS low FROM province_gazetteer),
g AS (SELECT row_id, regexp_replace(regexp_replace(low, '[.,;:()\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g') AS word, regexp_replace(regexp_replace(replace(replace(low, 'j', 'i'), 'u', 'v'), '[.,;:()\\[\\]{{}}''’"*/?]', ' ', 'g'), '\\s+', ' ', 'g') AS pword FROM n),
a AS (WITH w AS (SELECT row_id, word FROM g) SELECT row_id, word AS form FROM w UNION SELECT row_id, form FROM ({_rule_sql('word', M.GAZETTEER_FORMS)})),
p AS (WITH w AS (SELECT row_id, pword AS word FROM g) SELECT row_id, word AS form FROM w UNION SELECT row_id, form FROM ({_rule_sql('word', M.PROBE_FORMS)}))
SELECT row_id, (SELECT string_agg(form, '|' ORDER BY form) FROM a WHERE a.row_id = g.row_id) AS gazetteer, (SELECT string_agg(form, '|' ORDER BY form) FROM p WHERE p.row_id = g.row_id) AS probe FROM g
"""


def morph_toponymic(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "province_gazetteer").dropDuplicates(["rowId"])
    return once.select(F.col("rowId").alias("row_id"), F.inline(M.toponymic_variants(F.element_at(F.split("canonicalName", " "), 1))))


_TOPO = " UNION ALL ".join(f"SELECT row_id, {i} AS o, left(word, length(word) - {len(s)}) || e AS value, 'toponymic_{s}' || CASE WHEN e = '' THEN '_stem' ELSE '' END AS rule FROM w, (VALUES {', '.join(f'({chr(39)}{e}{chr(39)})' for e in ['', *ends])}) v(e) WHERE lower(word) LIKE '%{s}' AND length(word) > {len(s) + 2}" for i, (s, ends) in enumerate(M.TOPONYMIC))
MORPH_TOPONYMIC_SQL = f"""
WITH w AS (SELECT DISTINCT rowId AS row_id, {_CLEAN("string_split(canonicalName, ' ')[1]")} AS word FROM province_gazetteer), t AS ({_TOPO}),
f AS (SELECT *, min(o) OVER (PARTITION BY row_id) AS first FROM t)
SELECT f.row_id, value, rule FROM f JOIN w USING (row_id) WHERE o = first AND {_NORM('value')} <> {_NORM('word')}
"""


def morph_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate form of every distinct place name with its rule and tier."""
    names = _places(spark, sf_dir).select(F.col("placeName").alias("place_name"), F.col("placeSource").alias("place_source"))
    return M.variant_rows(names.na.fill("")).withColumnsRenamed({"place_name": "placeName", "place_source": "placeSource"})


def _derived_sql(source: str) -> str:
    """(id, place, j, form, rule): what is derived from the values of a table (id, place, value): case forms of the last word, then places behind an adjective."""
    places = ", ".join(f"({i}, '{suffix}', {j}, '{ending}')" for i, (suffix, endings) in enumerate(M.TOPONYMIC) for j, ending in enumerate(["", *endings]))
    return f"""(WITH x AS (SELECT id, place, value, row_number() OVER (ORDER BY id, place) AS row_id FROM {source}),
      w AS (SELECT row_id, string_split(value, ' ')[-1] AS word FROM x), h AS (SELECT row_id, array_to_string(string_split(value, ' ')[:-2], ' ') AS head FROM x),
      c AS (SELECT f.row_id, f.o AS j, trim(h.head || ' ' || f.form, ' ') AS form, '_case' AS rule FROM ({_rule_sql('word', M.CASE_FORMS)}) f JOIN h USING (row_id)),
      t AS (SELECT row_id, i, 1000 + j AS j, left(value, length(value) - length(s)) || e AS form, 'toponymic_' || s || CASE WHEN e = '' THEN '_stem' ELSE '' END AS rule, min(i) OVER (PARTITION BY row_id) AS first, value
            FROM x, (VALUES {places}) v(i, s, j, e) WHERE NOT contains(value, ' ') AND lower(value) LIKE '%' || s AND length(value) > length(s) + 2),
      u AS (SELECT * FROM c UNION ALL SELECT row_id, j, form, rule FROM t WHERE i = first AND {_NORM('form')} <> {_NORM('value')})
      SELECT x.id, x.place, j, form, rule FROM u JOIN x USING (row_id))"""


_FACTORY = ", ".join(f"('{k}', {i}, '{a}')" for k, aliases in M.FACTORY_ALIASES.items() for i, a in enumerate(aliases))
_ALIAS = ", ".join(f"('{k}', '{a}')" for k, a in M.PLACE_ALIASES.items())
_WIDTHS = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'", "''"), "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_PLAIN = f"translate(regexp_replace(value, '[\u00a0\u2000-\u200a\u202f\u205f\u3000]', ' ', 'g'), '{_WIDTHS[0]}', '{_WIDTHS[1]}')"
for _joined, _letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
    _PLAIN = f"replace({_PLAIN}, '{_joined}', '{_letters}')"
_FIRST = lambda source: f"SELECT id, clean AS value, {_NORM('clean')} AS key, place, rule, tier, known FROM (SELECT *, {_CLEAN(_PLAIN)} AS clean FROM {source}) WHERE {_NORM('clean')} <> '' QUALIFY row_number() OVER (PARTITION BY id, {_NORM('clean')} ORDER BY place) = 1"
MORPH_CANDIDATES_SQL = f"""
WITH n AS (SELECT *, coalesce(placeName, '') AS name, row_number() OVER (ORDER BY placeName, placeSource) AS id FROM (SELECT DISTINCT placeName, placeSource FROM place_conflict_context)),
f AS (SELECT id, i, a FROM n JOIN (VALUES {_FACTORY}) v(k, i, a) ON placeSource = 'factory' AND k = {_NORM('name')}),
k AS (SELECT n.*, id IN (SELECT id FROM f) AS known FROM n),
read AS (
  SELECT id, known, [0, 0] AS place, name AS value, 'original' AS rule, 0 AS tier FROM k UNION ALL SELECT id, known, [0, 1], 'Limes ' || name, 'limes_title', 0 FROM k WHERE placeSource = 'limes'
  UNION ALL SELECT f.id, true, [0, 2 + i], a, 'factory_alias', 0 FROM f UNION ALL SELECT id, known, [0, 10], a, 'toponymic_alias', 0 FROM k JOIN (VALUES {_ALIAS}) v(al, a) ON al = {_NORM('name')} WHERE NOT known
  UNION ALL SELECT id, known, [0, 11], regexp_extract(name, '(?i)\\bin\\s+castello\\s+(.+)$', 1), 'in_castello', 0 FROM k WHERE NOT known AND regexp_matches(name, '(?i)\\bin\\s+castello\\s+(.+)$')
  UNION ALL SELECT id, known, [0, 12], 'Castra ' || regexp_extract(name, '(?i)\\bin\\s+castris\\s+(.+)$', 1), 'in_castris', 0 FROM k WHERE NOT known AND regexp_matches(name, '(?i)\\bin\\s+castris\\s+(.+)$')
  UNION ALL SELECT id, known, [0, 13], regexp_extract(name, '(?i)\\bin\\s+castris\\s+(.+)$', 1), 'in_castris_name', 1 FROM k WHERE NOT known AND regexp_matches(name, '(?i)\\bin\\s+castris\\s+(.+)$')
  UNION ALL SELECT id, known, [0, 14], regexp_extract(name, '(?i)^(?:apud|ad|contra|prope|iuxta)\\s+(.+)$', 1), 'strip_preposition', 0 FROM k WHERE NOT known AND regexp_matches(name, '(?i)^(?:apud|ad|contra|prope|iuxta)\\s+(.+)$')
  UNION ALL SELECT id, known, [0, 15], regexp_extract(name, '(?i)^(.+?)\\s+in\\s+.+$', 1), 'before_in', 0 FROM k WHERE NOT known AND regexp_matches(name, '(?i)^(.+?)\\s+in\\s+.+$')
  UNION ALL SELECT id, known, [0, 100 * a + j], parts[j], 'alias', 0 FROM (SELECT id, known, a, parts, unnest(range(1, len(parts) + 1)) AS j FROM (
    SELECT id, known, a, string_split_regex(name, pat) AS parts FROM k, (VALUES (1, '(?i)\\s+siue\\s+'), (2, '(?i)\\s+sive\\s+'), (3, '\\s+-\\s+')) p(a, pat) WHERE NOT known AND regexp_matches(name, pat)))),
b AS ({_FIRST('read')}),
d AS (SELECT z.id, false AS known, [1] || z.place || [z.j] AS place, z.form AS value, CASE WHEN z.rule = '_case' THEN b.rule || '_case' ELSE z.rule END AS rule, CASE WHEN z.rule = '_case' THEN b.tier ELSE b.tier + 1 END AS tier
  FROM {_derived_sql('(SELECT id, place, value FROM b WHERE NOT known)')} z JOIN b ON b.id = z.id AND b.place = z.place),
two AS ({_FIRST('(SELECT id, known, place, value, rule, tier FROM b UNION ALL SELECT * FROM d)')}),
fw AS (SELECT id, place, {_CLEAN("string_split(value, ' ')[1]")} AS value FROM two WHERE NOT known AND contains(value, ' ')),
e AS (SELECT id, false AS known, [2] || place || [-1] AS place, value, 'first_word' AS rule, 1 AS tier FROM fw
  UNION ALL SELECT id, false, [2] || place || [j], form, CASE WHEN rule = '_case' THEN 'first_word_case' ELSE 'first_word_' || rule END, CASE WHEN rule = '_case' THEN 1 ELSE 2 END FROM {_derived_sql('fw')}),
three AS ({_FIRST('(SELECT id, known, place, value, rule, tier FROM two UNION ALL SELECT * FROM e)')})
SELECT coalesce(placeName, '') AS placeName, coalesce(placeSource, '') AS placeSource, CAST(row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS INTEGER) AS ord, value, rule, tier FROM three JOIN n USING (id)
"""


def morph_candidates_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without aliases and adjectives."""
    names = _places(spark, sf_dir).select(F.col("placeName").alias("place_name"), F.lit("").alias("place_source"))
    return M.variant_rows(names, full=False).select("place_name", "ord", "value", "rule", "tier")


def classify_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).select(
        "row_id", R.first_prefix(F.coalesce("chapter", F.lit("")), R.CHAPTERS).alias("chapter_type"), R.first_prefix(F.coalesce("unit", F.lit("")), R.UNITS).alias("unit_type"), R.first_prefix(F.coalesce("region", F.lit("")), R.HEADINGS).alias("heading_type"),
        R.office_type(F.coalesce("office", F.lit(""))).alias("office_type"), R.mention_type(F.col("unit"), F.col("office"), F.col("placeSource")).alias("mention_type"), R.station_bearing(F.col("unit"), F.lower("office")).alias("station"),
        R.feature_score(F.col("featureType"), F.col("unit"), F.col("chapter")).alias("feature_score"), F.coalesce(R.non_point(F.col("featureType")), F.lit(False)).alias("non_point"),
    )


def _prefix_sql(x: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(coalesce({x}, ''), '{p}') THEN '{v}'" for p, v in rules) + " ELSE 'unknown' END"


_MIL = f"(trim(coalesce(unit, '')) <> '' OR regexp_matches({_NORM('chapter')}, '^(dux |comes limitis |comes britann|comes tractus )'))"
_FEATURE = f"""CASE WHEN {_NORM('featureType')} = '' THEN 0 WHEN {_MIL} AND regexp_matches({_NORM('featureType')}, '{"|".join(R.MILITARY_WORDS)}') THEN 4 WHEN regexp_matches({_NORM('featureType')}, '{"|".join(R.SITE_WORDS)}') THEN 2
    WHEN regexp_matches({_NORM('featureType')}, '{"|".join(R.NON_SITE_WORDS)}') THEN -2 ELSE 0 END"""
CLASSIFY_SQL = f"""
SELECT rowId AS row_id, {_prefix_sql('chapter', R.CHAPTERS)} AS chapter_type, {_prefix_sql('unit', R.UNITS)} AS unit_type, {_prefix_sql('region', R.HEADINGS)} AS heading_type,
  {_prefix_sql("string_split_regex(coalesce(office, ''), '\\s+')[1]", R.OFFICES)} AS office_type,
  CASE WHEN lower(placeSource) = 'factory' THEN 'factory' WHEN regexp_matches(lower(concat_ws(' ', office, unit)), '\\btribun') THEN 'tribune' WHEN regexp_matches(lower(concat_ws(' ', office, unit)), '\\bequit') THEN 'cavalry'
    WHEN regexp_matches(lower(concat_ws(' ', office, unit)), '\\b(dux|ducis)\\b') THEN 'dux' WHEN regexp_matches(lower(concat_ws(' ', office, unit)), '\\bcom(es|itis)\\b') THEN 'comes' WHEN coalesce(office, '') <> '' THEN 'office' ELSE 'other' END AS mention_type,
  (regexp_matches(lower({_SQ("coalesce(unit, '')")}), '^({"|".join(R.STATION_WORDS)})( |$)') OR regexp_matches(lower(coalesce(unit, '')), '\\bclassis\\b')
    OR (lower(office) IN ('praefectus', 'tribunus', 'praepositus') AND regexp_matches(lower(coalesce(unit, '')), '\\b({"|".join(R.STATION_WORDS)})\\b'))) AS station,
  {_FEATURE} AS feature_score,
  list_has_any(string_split({_NORM('featureType')}, ' '), [{_in(R.NON_POINT_TYPES)}]) AS non_point
FROM {_ONCE}
"""


def classify_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit("")
    return _places(spark, sf_dir).select("row_id", R.macro_region(F.col("region"), none).alias("macro"), R.soft_province(F.col("chapter")).alias("soft"), R.hard_province(F.concat(F.lit("In provincia "), F.coalesce("region", F.lit(""))), none).alias("hard"), R.explicit_province(F.col("region")).alias("explicit"))


_CAP = lambda x, ps: "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '(?i){p}', 1), '')" for p in ps) + ", '')"
CLASSIFY_REGEX_SQL = f"""
WITH o AS (SELECT rowId, {_CLEAN('region')} AS r, {_NORM('region')} AS rn, {_CLEAN('chapter')} AS c, {_CLEAN("'In provincia ' || coalesce(region, '')")} AS x FROM {_ONCE}),
h AS (SELECT *, {_CAP('x', R.HARD_PROVINCE)} AS named, regexp_extract(x, '(?i)^in\\s+(.+)$', 1) AS within, {_CLEAN("regexp_extract(r, '\\bin\\s+(.+)$', 1)")} AS e FROM o)
SELECT rowId AS row_id, CASE WHEN r = '' THEN '' {' '.join(f"WHEN regexp_matches(rn, '{p}') THEN '{v}'" for p, v in R.ADMIN_REGIONS)} WHEN regexp_matches(r, '(?i)^intra\\s+') THEN r ELSE '' END AS macro,
  {_CLEAN(_CAP('c', R.SOFT_PROVINCE))} AS soft,
  {_CLEAN("CASE WHEN named <> '' THEN named WHEN within <> '' AND NOT regexp_matches(within, '(?i)\\b(castello|castris|barbarico|litore|lineam)\\b') THEN within ELSE '' END")} AS hard,
  CASE WHEN regexp_matches(e, '(?i)\\b(castello|castris|barbarico)\\b') OR NOT regexp_matches(e, '^\\p{{Lu}}') THEN '' ELSE e END AS explicit
FROM h
"""


def extract_unit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _places(spark, sf_dir).withColumn("text", F.concat(F.concat_ws(" ", "office", "unit"), F.lit(", "), F.coalesce("region", F.lit("")), F.lit(".")))
    return lines.select("row_id", *[c.alias(n) for n, c in E.unit_fields(F.col("text")).items()])


EXTRACT_UNIT_SQL = f"""
WITH o AS (SELECT rowId, {_SQ("regexp_replace(concat_ws(' ', office, unit) || ', ' || coalesce(region, '') || '.', '[[][^]]*[]]', '', 'g')")} AS t FROM {_ONCE}),
p AS (SELECT rowId, trim(left(t, strpos(t, ',') - 1)) AS l, trim(substr(t, strpos(t, ',') + 1)) AS tl FROM o),
q AS (SELECT rowId, l, CASE WHEN tl LIKE '%.' AND NOT regexp_matches(tl, '[,:;]') THEN left(tl, length(tl) - 1) ELSE tl END AS tail, CASE WHEN l LIKE '%.' AND NOT regexp_matches(l, '[,:;]') THEN left(l, length(l) - 1) ELSE l END AS lf FROM p),
r AS (SELECT rowId, lf, tail, string_split_regex(lf, '\\s+')[1] AS w, {_prefix_sql("string_split_regex(lf, '\\s+')[1]", R.OFFICES)} AS k FROM q)
SELECT rowId AS row_id, CASE WHEN k <> 'unknown' THEN w ELSE '' END AS office, k AS office_type, {_SQ("CASE WHEN k <> 'unknown' THEN substr(lf, length(w) + 1) ELSE lf END")} AS unit, tail FROM r
"""


def extract_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).select(
        "row_id", E.coordinate(F.col("latitude")).alias("lat"), E.coordinate(F.col("longitude")).alias("lon"), E.qualifier(F.col("candidate")).alias("qualifier"), E.without_qualifier(F.coalesce("candidate", F.lit(""))).alias("bare"), E.entry_place(F.coalesce("candidate", F.lit(""))).alias("entry"),
        E.first_non_empty(F.col("pleiadesName"), F.col("candidate"), F.col("placeName")).alias("shown"), E.context_blob(F.col("office"), F.col("unit"), F.col("chapter")).alias("blob"), E.transfer_target(F.coalesce("contextText", F.lit(""))).alias("transfer"),
    )


EXTRACT_REFS_SQL = f"""
SELECT rowId AS row_id, CASE WHEN isfinite(latitude) THEN latitude END AS lat, CASE WHEN isfinite(longitude) THEN longitude END AS lon,
  trim(regexp_extract(candidate, '[(]([^()]*)[)]\\s*$', 1)) AS qualifier, trim(regexp_replace(coalesce(candidate, ''), '\\s*[(][^()]*[)]\\s*$', '')) AS bare,
  trim(regexp_replace(string_split(coalesce(candidate, ''), ',')[-1], '[.]$', '')) AS entry, coalesce(nullif(trim(pleiadesName), ''), nullif(trim(candidate), ''), nullif(trim(placeName), ''), '') AS shown,
  {_SQ("concat_ws(' ', office, unit, chapter)")} AS blob,
  CASE WHEN lower(x) = 'anhelat' THEN '' ELSE x END AS transfer
FROM (SELECT *, trim(regexp_replace(regexp_extract(coalesce(contextText, ''), '(?i)\\btranslat[ai]\\s+(.+)$', 1), '^([^,:;]*)[.]$', '\\1')) AS x FROM {_ONCE})
"""


def extract_pipe_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "province_gazetteer").dropDuplicates(["rowId"])
    return once.select(F.col("rowId").alias("row_id"), F.array_join(E.pipe_list(F.col("notitiaForms")), "¶").alias("forms"), F.coalesce(F.aggregate(E.pipe_numbers(F.col("geoObjectIds")), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)).alias("id_sum"))


EXTRACT_PIPE_SQL = """
SELECT DISTINCT rowId AS row_id, array_to_string(list_filter(list_transform(string_split(coalesce(notitiaForms, ''), '|'), lambda v: trim(v)), lambda v: v <> ''), '¶') AS forms,
  CAST(coalesce(list_sum(list_filter(list_transform(string_split(coalesce(geoObjectIds, ''), '|'), lambda v: TRY_CAST(trim(v) AS BIGINT)), lambda v: v IS NOT NULL)), 0) AS BIGINT) AS id_sum
FROM province_gazetteer
"""


def _province_forms(spark: SparkSession, sf_dir: str) -> list[str]:
    """The fixed forms, and the names and forms of provinces in the tables: up to 1,000,000, checked."""
    gazetteer = table(spark, sf_dir, "province_gazetteer")
    names = gazetteer.select(F.col("canonicalName").alias("name")).union(table(spark, sf_dir, "province_polygon").select("gisProvince")).union(split_values(packed_fields(gazetteer, ["notitiaForms"])).select("value"))
    forms = [r["form"] for r in names.select(X.folded_line(F.col("name")).alias("form")).where("form <> ''").distinct().limit(1_000_001).collect()]
    if len(forms) > 1_000_000:
        raise ValueError("more than 1,000,000 forms of provinces")
    return sorted({*R.PROVINCE_FORMS, *forms})


def extract_tail_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed places of composed unit lines: recursive phrases, an Arrow UDF over distinct lines."""
    lines = _places(spark, sf_dir).select(F.coalesce("unit", F.lit("")).alias("unit"), F.lower(F.coalesce("office", F.lit(""))).alias("office_type"), F.concat_ws(" in ", "placeName", "region").alias("tail")).distinct()
    lines = lines.withColumn("bears_station", R.station_bearing(F.col("unit"), F.col("office_type")))
    return E.line_geography(lines, _province_forms(spark, sf_dir)).select("unit", "tail", F.posexplode("geo").alias("ord", "g")).select("unit", "tail", "ord", "g.tag", "g.value", "g.source")


def extract_longest_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["prima", "secunda", "tertia", "maior", "minor", "salutaris", "ripensis prima"]
    return _places(spark, sf_dir).select("row_id", E.longest_suffix(F.coalesce("region", F.lit("")), forms).alias("suffix"))


LONGEST_SUFFIX_SQL = f"SELECT rowId AS row_id, regexp_extract(lower({_SQ('coalesce(region, chr(32))')}), '(^| )(ripensis prima|prima|secunda|tertia|maior|minor|salutaris)$', 2) AS suffix FROM {_ONCE}"

QUERIES = {
    "text_norm_names": text_norm_names, "text_fold_lines": text_fold_lines, "text_tokens": text_tokens, "morph_case_variants": morph_case_variants, "morph_gazetteer_variants": morph_gazetteer_variants, "morph_toponymic": morph_toponymic, "morph_candidates": morph_candidates, "morph_candidates_local": morph_candidates_local,
    "classify_prefix": classify_prefix, "classify_regex": classify_regex, "extract_unit_fields": extract_unit_fields, "extract_refs": extract_refs, "extract_pipe_lists": extract_pipe_lists, "extract_tail_geo": extract_tail_geo, "extract_longest_suffix": extract_longest_suffix,
}
SQL = {
    "text_norm_names": TEXT_NORM_SQL, "text_fold_lines": TEXT_FOLD_SQL, "text_tokens": TEXT_TOKENS_SQL, "morph_case_variants": MORPH_CASE_SQL, "morph_gazetteer_variants": MORPH_GAZETTEER_SQL, "morph_toponymic": MORPH_TOPONYMIC_SQL, "classify_prefix": CLASSIFY_SQL, "morph_candidates": MORPH_CANDIDATES_SQL, "classify_regex": CLASSIFY_REGEX_SQL,
    "extract_unit_fields": EXTRACT_UNIT_SQL, "extract_refs": EXTRACT_REFS_SQL, "extract_pipe_lists": EXTRACT_PIPE_SQL, "extract_longest_suffix": LONGEST_SUFFIX_SQL,
}
