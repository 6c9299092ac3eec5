"""Ranked search over documents and over the records of the conflict table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.functions.text import highlighted
from tabulary.operators import search as S
from tabulary.session import table

DOCUMENT_FIELDS = (S.Field("text", 140), S.Field("work_id", 100), S.Field("source", 80, "context"), S.Field("lang", 50, "context"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "work_id", "source", "lang"), DOCUMENT_FIELDS)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conflict table as search records, a repeated row once."""
    once = table(spark, sf_dir, "place_conflict_context").dropDuplicates(["rowId"])
    return S.index(once.select(
        F.col("rowId").alias("id"), F.col("sourceLine").alias("line"), F.concat_ws(" ", "office", "unit", "placeName").alias("text"), F.lit("").alias("title"), "office", "unit", F.array_compact(F.array("placeName")).alias("places"),
        F.array_compact(F.array("placeSource")).alias("place_sources"), "chapter", F.array_compact(F.array("region", "declaredProvince")).alias("context"), F.array_compact(F.array("expectedProvince")).alias("structure"), F.lower("office").alias("office_type"), F.lit("").alias("owner_office"), "document",
    ))


def _documents(query: str):
    return lambda spark, sf_dir: S.search(documents(spark, sf_dir), query, DOCUMENT_FIELDS).select(F.col("id").alias("doc_id"), "score", "matched_terms")


def _records(query: str):
    return lambda spark, sf_dir: S.search(records(spark, sf_dir), query).select(F.col("id").alias("row_id"), "score", "matched_terms")


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = table(spark, sf_dir, "documents"), records(spark, sf_dir)
    parts = [S.facet(docs, "source").withColumn("facet", F.lit("source")), S.facet(docs, "lang").withColumn("facet", F.lit("lang")), S.facet(own, "place_sources").withColumn("facet", F.lit("place_source")), S.facet(own, "office").withColumn("facet", F.lit("office"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array_compact(F.array("source", "lang", "work_id")).alias("context"))
    return S.evidence(docs, ["render", "castellum", "WK"], "text", "context").select("doc_id", "term", "evidence")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = S.display_terms("castellum AND (legio OR road)")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(highlighted(F.col("text"), terms)).alias("marked"), F.size(F.regexp_extract_all(highlighted(F.col("text"), terms), F.lit("<mark>"), F.lit(0))).alias("marks"))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "place_conflict_context").dropDuplicates(["rowId"])
    return once.select(F.col("rowId").alias("row_id"), S.detail("office", "unit", "placeName", "region").alias("detail"))


# The oracle: the same scores from the description of the language, in SQL.
def _fold(x: str) -> str:
    return f"lower(strip_accents(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))))"


def _score(x: str, term: str, base: int) -> str:
    word = f"(^|[^a-z0-9]){term}"
    return f"CASE WHEN {x} = '{term}' THEN {1000 + base} WHEN regexp_matches({x}, '{word}($|[^a-z0-9])') THEN {750 + base} WHEN regexp_matches({x}, '{word}') THEN {550 + base} WHEN contains({x}, '{term}') THEN {350 + base} END"


class _Oracle:
    def __init__(self, source: str, key: str, fields: list[tuple[str, str, int, bool]]):
        self.key, self.fields = key, fields
        self.base = f"WITH r AS (SELECT {key}, {', '.join(f'{_fold(x)} AS {n}' for n, x, _, _ in fields)} FROM {source})"

    def terms(self, words: list[str], scope: str = "all") -> tuple[str, str]:
        best, direct = [], []
        for w in words:
            cells = [(_score(n, w, weight - (0 if own else 120)), own) for n, _, weight, own in self.fields if scope == "all" or (scope == "direct") == own]
            best.append(f"greatest({', '.join(c for c, _ in cells)})" if len(cells) > 1 else cells[0][0])
            own = [c for c, o in cells if o]
            direct.append(f"(coalesce({', '.join(own)}) IS NOT NULL)::INT" if own else "0")
        matched = " AND ".join(f"{b} IS NOT NULL" for b in best)
        return f"({matched})", f"(({' + '.join(direct)}) * 1000000000::BIGINT + least({', '.join([*best, best[0]])}) * 1000 + {' + '.join(best)})"

    def query(self, matched: str, score: str) -> str:
        return f"{self.base} SELECT {self.key}, CAST({score} AS BIGINT) AS score, 1 AS matched_terms FROM r WHERE {matched}"

    def single(self, word: str) -> str:
        strong = " OR ".join(f"coalesce({_score(n, word, weight - (0 if own else 120))} = b AND b - {weight - (0 if own else 120)} >= 750, false)" for n, _, weight, own in self.fields)
        matched, score = self.terms([word])
        best = f"greatest({', '.join(_score(n, word, weight - (0 if own else 120)) for n, _, weight, own in self.fields)})"
        return f"SELECT {self.key}, score FROM (SELECT *, bool_or(strong) OVER () AS any_strong FROM (SELECT *, {strong} AS strong FROM (SELECT {self.key}, {', '.join(n for n, *_ in self.fields)}, {best} AS b, CAST({score} AS BIGINT) AS score FROM r WHERE {matched}))) WHERE strong OR NOT any_strong"


_D = _Oracle("documents", "doc_id", [("text", "text", 140, True), ("work_id", "work_id", 100, True), ("source", "source", 80, False), ("lang", "lang", 50, False)])
_R = _Oracle(
    "(SELECT DISTINCT * EXCLUDE (loadedAt, rowId), rowId AS row_id FROM place_conflict_context)", "row_id",
    [("text", "concat_ws(' ', office, unit, placeName)", 140, True), ("f_office", "office", 120, True), ("f_unit", "unit", 120, True), ("f_places", "placeName", 110, True), ("f_sources", "placeSource", 100, True), ("f_chapter", "chapter", 80, False),
     ("f_context", "concat_ws(' ', region, declaredProvince)", 50, False), ("f_structure", "expectedProvince", 45, False), ("f_type", "lower(office)", 35, False), ("f_document", "document", 20, False)],
)


def _boolean(oracle: _Oracle, kind: str, left: tuple[str, str], right: tuple[str, str]) -> tuple[str, str]:
    (lm, ls), (rm, rs) = left, right
    if kind == "or":
        return f"(({lm}) OR ({rm}))", f"CASE WHEN ({lm}) AND ({rm}) THEN greatest({ls}, {rs}) + 1000 WHEN {lm} THEN {ls} ELSE {rs} END"
    if kind == "not_in":
        return f"(({lm}) AND NOT ({rm}))", ls
    return f"(({lm}) AND ({rm}))", f"({ls} + {rs}{' + 5000' if kind == 'in' else ''})"


QUERIES = {
    "ranked_search_term": _documents("castellum"), "search_prefix_fallback": _documents("castel"), "search_and": _documents("cohors castellum"), "search_simple_and": _documents("sheet and border"), "search_or_merge": _documents("kartbladet or shelfmark"),
    "search_in_context": _documents("montani IN english_render"), "search_not_in": _documents("montani NOT IN notitia_latin"), "search_grouped": _documents("(cohors OR classis) AND paludani"), "search_chained_plain": _documents("road and river and through"),
    "search_records_in": _records("Princeps IN Dux"), "search_records_grouped": _records("(Dux OR Tribunus) IN Oriens"), "search_records_term": _records("castello"),
    "search_facets": facets, "search_evidence": evidence, "snippet_highlight": snippets, "result_detail": details,
}
SQL = {
    "ranked_search_term": f"{_D.base} SELECT *, 1 AS matched_terms FROM ({_D.single('castellum')})",
    "search_prefix_fallback": f"{_D.base} SELECT *, 1 AS matched_terms FROM ({_D.single('castel')})",
    "search_and": _D.query(*_D.terms(["cohors", "castellum"])),
    "search_simple_and": _D.query(*_D.terms(["sheet", "border"])),
    "search_or_merge": f"{_D.base} SELECT doc_id, max(score) AS score, CAST(count(*) AS INTEGER) AS matched_terms FROM (SELECT * FROM ({_D.single('kartbladet')}) UNION ALL SELECT * FROM ({_D.single('shelfmark')})) GROUP BY doc_id",
    "search_in_context": _D.query(*_boolean(_D, "in", _D.terms(["montani"], "direct"), _D.terms(["english_render"], "context"))),
    "search_not_in": _D.query(*_boolean(_D, "not_in", _D.terms(["montani"], "direct"), _D.terms(["notitia_latin"], "context"))),
    "search_grouped": _D.query(*_boolean(_D, "and", _boolean(_D, "or", _D.terms(["cohors"]), _D.terms(["classis"])), _D.terms(["paludani"]))),
    "search_chained_plain": _D.query(*_D.terms(["road", "and", "river", "and", "through"])),
    "search_records_in": _R.query(*_boolean(_R, "in", _R.terms(["princeps"], "direct"), _R.terms(["dux"], "context"))),
    "search_records_grouped": _R.query(*_boolean(_R, "in", _boolean(_R, "or", _R.terms(["dux"], "direct"), _R.terms(["tribunus"], "direct")), _R.terms(["oriens"], "context"))),
    "search_records_term": f"{_R.base} SELECT *, 1 AS matched_terms FROM ({_R.single('castello')})",
    "search_facets": "SELECT DISTINCT 'source' AS facet, source AS value FROM documents WHERE source <> '' UNION ALL SELECT DISTINCT 'lang', lang FROM documents WHERE lang <> '' UNION ALL SELECT DISTINCT 'place_source', placeSource FROM place_conflict_context WHERE placeSource <> '' UNION ALL SELECT DISTINCT 'office', office FROM place_conflict_context WHERE office <> ''",
    "search_evidence": f"""WITH d AS (SELECT doc_id, {_fold('text')} AS t, list_filter([source, lang, work_id], lambda x: x IS NOT NULL) AS ctx FROM documents),
        x AS (SELECT doc_id, ctx, term FROM d, (VALUES ('render'), ('castellum'), ('wk')) v(term) WHERE NOT contains(t, term))
        SELECT doc_id, term, list_filter(ctx, lambda c: contains(lower(strip_accents(c)), term)) AS held, NULL AS evidence FROM x""",
    "snippet_highlight": "WITH m AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '(castellum|legio|road)', '<mark>\\1</mark>', 'gi') AS t FROM documents) SELECT doc_id, md5(t) AS marked, CAST((length(t) - length(replace(t, '<mark>', ''))) / 6 AS INTEGER) AS marks FROM m",
    "result_detail": "SELECT DISTINCT rowId AS row_id, concat_ws(' · ', nullif(trim(office, ' '), ''), nullif(trim(unit, ' '), ''), nullif(trim(placeName, ' '), ''), nullif(trim(region, ' '), '')) AS detail FROM place_conflict_context",
}
SQL["search_evidence"] = SQL["search_evidence"].replace("SELECT doc_id, term, list_filter(ctx, lambda c: contains(lower(strip_accents(c)), term)) AS held, NULL AS evidence FROM x", "SELECT doc_id, term, list_sort(list_transform(list_filter(ctx, lambda c: contains(lower(strip_accents(c)), term)), lambda c: {'n': length(c), 'v': c}))[1]['v'] AS evidence FROM x")
