"""Mapping of freely entered values to a reference list by a partition-based pigeonhole join, in SQL only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tabulary.session import table, written

# Letters that look like Latin ones, and the Latin ones, place by place; both cases.
LOOKALIKE = "АВЕЅІЈКМНОРСТХУаеѕіјорсхуԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορ"
LOOKS_LIKE = "ABESIJKMHOPCTXYaesijopcxydhqwABEZHIKMNOPTYXvop"
# Letters written as one that stand for two.
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE"}
# Generic words that are added to names of sites, and those that names themselves may hold.
GENERIC = ("ad", "in", "apud", "civitas", "oppidum", "opp", "urbs", "vicus", "vic", "mansio", "mans", "castellum", "municipium", "mun", "statio", "pagus", "villa", "locus")
ALSO_IN_NAMES = ("aquae", "castra", "castrum", "colonia", "col", "forum", "pons", "portus")

EDITS = 2
#: Full-width full stop, digits and letters; other full-width marks part words as they are.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if chr(c - 0xFEE0).isalnum() or c == 0xFF0E)
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def folded_sql(column: str) -> str:
    """SQL for a value in lower case, without accents and unseen characters, in Latin letters of normal width."""
    sql = f"reflect('org.apache.commons.lang3.StringUtils', 'stripAccents', {column})"
    sql = f"translate(regexp_replace({sql}, r'[\\pM\\p{{{{Cf}}}}]', ''), {_text(LOOKALIKE + WIDE)}, {_text(LOOKS_LIKE + NARROW)})"
    for joined, letters in JOINED.items():
        sql = f"replace({sql}, '{joined}', '{letters}')"
    return f"lower({sql})"


WORDS = r"filter(split({0}, r'[^\pL\pN]+'), w -> w <> '')"

ORDERS = """
CASE size({0})
  WHEN 0 THEN array()
  WHEN 1 THEN array({0}[0])
  WHEN 2 THEN array(concat({0}[0], {0}[1]), concat({0}[1], {0}[0]))
  ELSE transform(sequence(0, size({0}) - 1), i -> array_join(concat(slice({0}, i + 1, size({0})), slice({0}, 1, i)), ''))
       || IF(size({0}) = 3, transform(sequence(0, 2), i -> concat({0}[(i + 1) % 3], {0}[i], {0}[(i + 2) % 3])), array())
END"""

def _segment_size(n: str, i: str, edits: int) -> str:
    """SQL for the letters of segment i of edits + 1 in a reference of n letters: the last n % (edits + 1) segments are one letter longer."""
    return f"({n} div {edits + 1} + IF({i} > {edits + 1} - {n} % {edits + 1}, 1, 0))"


def _segment_start(n: str, i: str, edits: int) -> str:
    return f"(1 + ({i} - 1) * ({n} div {edits + 1}) + greatest(0, {i} - 1 - ({edits + 1} - {n} % {edits + 1})))"


def _list(words: Sequence[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def map_values(values: DataFrame, references: DataFrame, generic: Sequence[str] = GENERIC, also_in_names: Sequence[str] = ALSO_IN_NAMES, edits: int = EDITS) -> DataFrame:
    """(value, name_id) for distinct values (value) and references (name_id, name); 0 for a value that matches none.

    Values and names are compared without case, accents, look-alike characters, blanks and punctuation, a value also
    in other orders of its words and without generic words (generic: those that are added; also_in_names: those that names
    may hold themselves), in every combination of the generic words it holds, up to six of them. Orders are all for up
    to three words; beyond, rotations, and any order at all where the words are the same. Equal
    forms match; else a form at most `edits` letters away: the name is cut into edits + 1 segments, one of which a form
    within these edits must contain near its place, so the join is an equality join on (length, segment, substring), and only
    its pairs are verified by levenshtein. Else a value that ends in a full stop matches the one name that begins
    with it. Nearest wins, the lowest name_id among equals. Tables that grow with the values meet by sort-merge joins,
    none is broadcast. Null values are out; empty ones match none. Names
    without letters or digits match nothing, and an empty list maps every value to 0.
    """
    spark = values.sparkSession
    worded = spark.sql(f"SELECT DISTINCT name_id, {WORDS.format(folded_sql('name'))} AS words FROM {{refs}} WHERE name IS NOT NULL", refs=references)
    names = spark.sql("SELECT name_id, array_join(words, '') AS form FROM {w} WHERE size(words) > 0", w=worded)
    folded = spark.sql(f"SELECT DISTINCT value, {folded_sql('value')} AS folded FROM {{v}} WHERE value IS NOT NULL", v=values)
    words = spark.sql(f"SELECT value, folded, {WORDS.format('folded')} AS words FROM {{v}}", v=folded)
    added, any_generic = _list(generic) or "''", _list([*generic, *also_in_names]) or "''"
    places = f"slice(filter(sequence(0, size(words) - 1), i -> words[i] IN ({any_generic})), 1, 6)"  # of the generic words
    subsets = f"aggregate({places}, array(CAST(array() AS ARRAY<INT>)), (acc, p) -> concat(acc, transform(acc, s -> concat(s, array(p)))))"
    choices = f"""IF(size(words) = 0, array(words), array_distinct(concat(array(words, filter(words, w -> w NOT IN ({added})), filter(words, w -> w NOT IN ({any_generic}))),
      transform({subsets}, s -> filter(words, (w, i) -> NOT array_contains(s, i))))))"""
    # any order of four words or more: both sides also carry their sorted words, marked so that they only meet each other
    bag = "IF(size({0}) >= 4, array(concat('|', array_join(array_sort({0}), '|'))), array())"
    forms = written(
        spark.sql(f"SELECT value, rtrim(folded) LIKE '%.' AS cut, array_join(words, '') AS stem, array_distinct(flatten(transform({choices}, c -> {ORDERS.format('c')} || {bag.format('c')}))) AS forms FROM {{v}}", v=words),
        "forms",
    )
    spread = spark.sql("SELECT value, explode(forms) AS form FROM {f}", f=forms)
    whole = spark.sql("SELECT name_id, form FROM {n} UNION ALL SELECT name_id, explode(" + bag.format("words") + ") FROM {w}", n=names, w=worded)
    equal = written(spark.sql("SELECT /*+ MERGE(n) */ value, min(name_id) AS name_id FROM {s} s JOIN {n} n USING (form) GROUP BY value", s=spread, n=whole), "equal")
    rest = spark.sql("SELECT /*+ MERGE(e) */ s.* FROM {s} s LEFT ANTI JOIN {e} e USING (value) WHERE NOT startswith(form, '|')", s=spread, e=equal)
    pieces = spark.sql(f"SELECT name_id, form, length(form) AS n, i, substring(form, {_segment_start('length(form)', 'i', edits)}, {_segment_size('length(form)', 'i', edits)}) AS piece FROM {{n}} LATERAL VIEW explode(sequence(1, {edits + 1})) AS i", n=names)
    probes = spark.sql(
        f"""SELECT DISTINCT form, n, i, substring(form, start, size) AS piece FROM (
              SELECT form, n, i, {_segment_start('n', 'i', edits)} + d AS start, {_segment_size('n', 'i', edits)} AS size, length(form) AS m
              FROM (SELECT DISTINCT form FROM {{r}})
              LATERAL VIEW explode(sequence(greatest(1, length(form) - {edits}), length(form) + {edits})) AS n
              LATERAL VIEW explode(sequence(1, {edits + 1})) AS i
              LATERAL VIEW explode(sequence(-{edits}, {edits})) AS d
              WHERE abs(d) <= i - 1 AND abs(d - (length(form) - n)) <= {edits + 1} - i)
            WHERE start >= 1 AND start + size - 1 <= m""",
        r=rest,
    )
    close = spark.sql(
        f"""SELECT form, min(struct(levenshtein(form, name, {edits}) AS d, name_id)) AS best FROM (
              SELECT /*+ MERGE(q) */ DISTINCT p.form, q.form AS name, q.name_id FROM {{p}} p JOIN {{q}} q ON p.n = q.n AND p.i = q.i AND p.piece = q.piece)
            WHERE levenshtein(form, name, {edits}) >= 0 GROUP BY form""",
        p=probes, q=pieces,
    )
    near = spark.sql("SELECT /*+ MERGE(c) */ value, min(best).name_id AS name_id FROM {r} r JOIN {c} c USING (form) GROUP BY value", r=rest, c=close)
    begins = spark.sql("SELECT stem, min(name_id) AS name_id FROM (SELECT name_id, form, explode(transform(sequence(1, length(form)), i -> left(form, i))) AS stem FROM {n}) GROUP BY stem HAVING count(DISTINCT form) = 1", n=names)
    short = spark.sql("SELECT /*+ MERGE(b) */ f.value, b.name_id FROM {f} f JOIN {b} b ON f.stem = b.stem WHERE f.cut", f=forms, b=begins)
    ranked = spark.sql("SELECT value, min(struct(how, name_id)).name_id AS name_id FROM (SELECT *, 0 AS how FROM {e} UNION ALL SELECT *, 1 FROM {c} UNION ALL SELECT *, 2 FROM {s}) GROUP BY value", e=equal, c=near, s=short)
    matched = written(ranked, "matched")
    return spark.sql("SELECT value, name_id FROM {m} UNION ALL SELECT /*+ MERGE(m2) */ f.value, CAST(0 AS BIGINT) FROM {f} f LEFT ANTI JOIN {m2} m2 USING (value)", m=matched, m2=matched, f=forms)


def _entered(spark: SparkSession, sf_dir: str) -> DataFrame:
    context, match = table(spark, sf_dir, "place_conflict_context"), table(spark, sf_dir, "province_pleiades_match")
    return spark.sql(
        """SELECT source_table, field, row_id, value FROM (
             SELECT 'place_conflict_context' AS source_table, row_id, stack(3, 'placeName', placeName, 'pleiadesName', pleiadesName, 'candidate', candidate) AS (field, value)
             FROM (SELECT rowId AS row_id, first(placeName) AS placeName, first(pleiadesName) AS pleiadesName, first(candidate) AS candidate FROM {c} GROUP BY rowId)
             UNION ALL
             SELECT 'province_pleiades_match', row_id, 'matchedName', value FROM (SELECT rowId AS row_id, first(matchedName) AS value FROM {m} GROUP BY rowId))
           WHERE value IS NOT NULL""",
        c=context, m=match,
    )


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-null value with its entry; the hot values only split the left side of the last join."""
    references = spark.sql("SELECT name_id, canonical_name AS name FROM {t}", t=table(spark, sf_dir, "place_name_list"))
    rows = _entered(spark, sf_dir)
    mapping = map_values(spark.sql("SELECT DISTINCT value FROM {r}", r=rows), references)
    return spark.sql("SELECT /*+ MERGE(m) */ r.source_table, r.field, r.row_id, m.name_id FROM {r} r JOIN {m} m ON r.value = m.value", r=rows, m=mapping)


_UNSEEN = "[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]"
_FOLD_SQL = f"translate(strip_accents(regexp_replace(regexp_replace({{0}}, '[\u0300-\u036f]', '', 'g'), '{_UNSEEN}', '', 'g')), '{LOOKALIKE + WIDE}', '{LOOKS_LIKE + NARROW}')"
for _joined, _letters in JOINED.items():
    _FOLD_SQL = f"replace({_FOLD_SQL}, '{_joined}', '{_letters}')"
FOUND_SQL = f"""
WITH entered AS (
  SELECT DISTINCT 'place_conflict_context' AS source_table, 'placeName' AS field, rowId AS row_id, placeName AS value FROM place_conflict_context WHERE placeName IS NOT NULL
  UNION ALL SELECT DISTINCT 'place_conflict_context', 'pleiadesName', rowId, pleiadesName FROM place_conflict_context WHERE pleiadesName IS NOT NULL
  UNION ALL SELECT DISTINCT 'place_conflict_context', 'candidate', rowId, candidate FROM place_conflict_context WHERE candidate IS NOT NULL
  UNION ALL SELECT DISTINCT 'province_pleiades_match', 'matchedName', rowId, matchedName FROM province_pleiades_match WHERE matchedName IS NOT NULL),
names AS (SELECT name_id, regexp_replace(lower({_FOLD_SQL.format('canonical_name')}), '[^a-z0-9]', '', 'g') AS form FROM place_name_list),
folded AS (SELECT value, lower({_FOLD_SQL.format('value')}) AS f FROM (SELECT DISTINCT value FROM entered)),
words AS (SELECT value, f, regexp_extract_all(f, '[a-z0-9]+') AS w FROM folded),
choices AS (
  SELECT value, w FROM words
  UNION SELECT value, list_filter(w, lambda x: x NOT IN ({_list(GENERIC)})) FROM words
  UNION SELECT value, list_filter(w, lambda x: x NOT IN ({_list(GENERIC + ALSO_IN_NAMES)})) FROM words
  UNION SELECT value, w[:i - 1] || w[i + 1:] FROM (SELECT value, w, unnest(range(1, len(w) + 1)) AS i FROM words) WHERE w[i] IN ({_list(GENERIC + ALSO_IN_NAMES)})),
forms AS (
  SELECT value, array_to_string(w, '') AS form FROM choices
  UNION SELECT value, array_to_string(list_reverse(w), '') FROM choices
  UNION SELECT value, array_to_string(w[2:] || w[:1], '') FROM choices
  UNION SELECT value, array_to_string(w[3:] || w[:2], '') FROM choices
  UNION SELECT value, array_to_string([w[2], w[1], w[3]], '') FROM choices WHERE len(w) = 3
  UNION SELECT value, array_to_string([w[1], w[3], w[2]], '') FROM choices WHERE len(w) = 3),
close AS (SELECT value, min([levenshtein(x.form, n.form), name_id])[2] AS name_id FROM forms x JOIN names n ON levenshtein(x.form, n.form) <= {EDITS} WHERE x.form <> '' GROUP BY value),
short AS (SELECT value, min(name_id) AS name_id FROM words JOIN names n ON starts_with(n.form, array_to_string(w, '')) WHERE len(w) > 0 AND rtrim(f) LIKE '%.' GROUP BY value HAVING count(DISTINCT n.form) = 1)
SELECT e.source_table, e.field, e.row_id, CAST(coalesce(c.name_id, s.name_id, 0) AS BIGINT) AS name_id FROM entered e LEFT JOIN close c USING (value) LEFT JOIN short s USING (value)
"""
