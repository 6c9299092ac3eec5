"""Lines, chapters, headings, trees and checks, over documents laid out as indented text and over the star schema as a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.functions import rules as R
from tabulary.operators import tree as T
from tabulary.operators.pages import container_page, line_page
from tabulary.session import table
from tabulary.sources import readers


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as indented text: a line per sentence, five blanks a level (length mod 4), ':' after each fifth, a chapter at each eleventh."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document"), F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), r"[.] ").alias("s"))
    n = lambda s: F.length(s)
    line = lambda s, i: F.when(s == "", "").when(n(s) % 11 == 0, F.concat(T.roman(i + 1), F.lit(". "), s)).otherwise(F.concat(F.repeat(F.lit("     "), n(s) % 4), F.regexp_replace(s, ":$", ""), F.when(n(s) % 5 == 0, ":").otherwise("")))
    return docs.select("document", F.array_join(F.transform("s", line), "\n").alias("text"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_chapters(T.lines_of(laid_out(spark, sf_dir)))


_ROMAN = "(['', 'M', 'MM', 'MMM'][1 + n // 1000] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][1 + n // 100 % 10] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][1 + n // 10 % 10] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][1 + n % 10])"
_LINES = f"""
WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS document, unnest(string_split(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '. ')) AS s, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '. '), 1) AS n FROM documents),
raw AS (SELECT document, n AS line, rtrim(CASE WHEN length(s) % 11 = 0 THEN {_ROMAN} || '. ' || s ELSE repeat('     ', length(s) % 4) || regexp_replace(s, ':$', '') || CASE WHEN length(s) % 5 = 0 THEN ':' ELSE '' END END, ' ') AS raw FROM s WHERE s <> ''),
l AS (SELECT document, line, raw, CAST((length(raw) - length(ltrim(raw, ' '))) // 5 AS INTEGER) AS level, trim(raw, ' ') AS label FROM raw WHERE raw <> ''),
c AS (SELECT *, regexp_matches(label, '^[IVXLCDM]+[.]\\s*') AS is_chapter FROM l),
k AS (SELECT *, CAST(sum(is_chapter::INT) OVER (PARTITION BY document ORDER BY line) AS INTEGER) AS chapter_no FROM c)
"""


def lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lines_of(laid_out(spark, sf_dir)).select("document", "line", "level", "label")


def chapter_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("document", "line", F.col("chapter_no").cast("int").alias("chapter_no"), F.coalesce("chapter_roman", F.lit("")).alias("chapter_roman"))


def chapter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chapter_ranges(T.lines_of(laid_out(spark, sf_dir))).select("document", F.col("chapter_no").cast("int").alias("chapter_no"), "line_start", "line_end")


def join_range_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.lines_of(laid_out(spark, sf_dir))
    return T.lines_in_ranges(lines, T.chapter_ranges(lines)).select("document", "line", F.col("chapter_no").cast("int").alias("chapter_no"))


def running_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.headings_by_indent(_lines(spark, sf_dir)).select("document", "line", "is_block", "parent_line")


RUNNING_SQL = _LINES + """
, b AS (SELECT *, label LIKE '%:' AS is_block FROM k)
SELECT x.document, x.line, x.is_block, max(o.line) AS parent_line FROM b x LEFT JOIN b o ON o.document = x.document AND o.chapter_no = x.chapter_no AND o.line < x.line AND o.is_block AND o.level < x.level
  AND NOT EXISTS (SELECT 1 FROM b y WHERE y.document = o.document AND y.chapter_no = o.chapter_no AND y.line > o.line AND y.line < x.line AND y.level <= o.level)
GROUP BY ALL
"""


def flat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(10, "In ", "heading", "Y"), (20, "Item", "block", "Y"), (20, "The ", "block", "Y"), (90, "Se ", "block", ""), (5, "I ", "heading", "Y")], "priority int, pattern string, node_type string, container string")
    body = _lines(spark, sf_dir).where("chapter_no > 0 and not is_chapter")
    return T.flat_blocks(body, rules).select("document", "line", "kind", "parent_line", "depth")


FLAT_SQL = _LINES + """
, r(priority, pattern, node_type, container) AS (VALUES (10, 'In ', 'heading', 'Y'), (20, 'Item', 'block', 'Y'), (20, 'The ', 'block', 'Y'), (90, 'Se ', 'block', ''), (5, 'I ', 'heading', 'Y')),
m AS (SELECT k.document, k.line, k.chapter_no, arg_min({'t': node_type, 'c': container}, (priority, pattern)) AS r FROM k LEFT JOIN r ON starts_with(label, pattern) WHERE chapter_no > 0 AND NOT is_chapter GROUP BY ALL),
w AS (SELECT *, max(CASE WHEN r['c'] = 'Y' THEN line END) OVER (PARTITION BY document, chapter_no ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM m)
SELECT document, line, coalesce(r['t'], 'entry') AS kind, CASE WHEN r['t'] IS NULL THEN cur END AS parent_line, CASE WHEN r['t'] IS NULL AND cur IS NOT NULL THEN 3 ELSE 2 END AS depth FROM w
"""


def indent_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by the heading stack with its modes, a chapter a group."""
    return T.parse_chapters(_lines(spark, sf_dir), R.HEADINGS, R.UNITS).select("document", "chapter_no", "line", "parent_line", "tag", "type", "level", F.size("path").alias("depth"))


def adjacency_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.adjacency(_lines(spark, sf_dir))


ADJACENCY_SQL = _LINES + """
, b AS (SELECT document, chapter_no, line, length(raw) - length(ltrim(raw, ' ')) AS ind, label LIKE '%:' AS block, label FROM k WHERE chapter_no > 0 AND NOT is_chapter),
deeper AS (SELECT o.document, o.chapter_no, o.line, o.ind, min(z.line) AS first FROM b o LEFT JOIN b z ON z.document = o.document AND z.chapter_no = o.chapter_no AND z.line > o.line AND z.ind > o.ind WHERE o.block GROUP BY ALL),
held AS (SELECT o.document, o.chapter_no, o.line, min(y.line) AS closed FROM deeper o LEFT JOIN b y ON y.document = o.document AND y.chapter_no = o.chapter_no AND y.line > o.line
  AND CASE WHEN y.block THEN y.ind <= o.ind ELSE y.ind < o.ind OR (y.ind = o.ind AND coalesce(o.first < y.line, false)) END GROUP BY ALL)
SELECT x.document, x.chapter_no, x.line, max(o.line) AS parent_line, CAST(2 + count(o.line) AS INTEGER) AS level, CASE WHEN x.block THEN 'block' ELSE 'entry' END AS kind, CASE WHEN x.block THEN trim(left(x.label, length(x.label) - 1), ' ') ELSE rtrim(x.label, '.') END AS text
FROM b x LEFT JOIN held o ON o.document = x.document AND o.chapter_no = x.chapter_no AND o.line < x.line AND (o.closed IS NULL OR o.closed > x.line) GROUP BY x.document, x.chapter_no, x.line, x.block, x.label
"""


def owner_offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "place_conflict_context").dropDuplicates(["rowId"])
    return once.select(F.col("rowId").alias("row_id"), R.owner_office(F.col("chapter"), F.coalesce("unit", F.lit("")), R.OWNER_OFFICES).alias("owner"))


OWNER_SQL = """SELECT rowId AS row_id, regexp_replace(trim(chapter, ' '), '[.]$', '') AS owner FROM (SELECT DISTINCT * EXCLUDE (loadedAt) FROM place_conflict_context)"""


def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "place_conflict_context").select(F.col("sourceLine").alias("n")).where("n between 1 and 3999").distinct()
    numeral = n.withColumn("numeral", T.roman(F.col("n")))
    return numeral.withColumn("back", T.roman_number(F.col("numeral")))


def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and suppliers as a tree; suppliers lie a level too deep, parts hang on nothing."""
    node = lambda df, i, p, level, kind, text: df.select(i.alias("node_id"), p.alias("parent_id"), F.lit(level).alias("level"), F.lit(kind).alias("kind"), F.col(text).alias("text"))
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    t = lambda name: table(spark, sf_dir, name)
    parts = [
        node(t("region"), tag("R", "r_regionkey"), F.lit(None).cast("string"), 0, "chapter", "r_name"), node(t("nation"), tag("N", "n_nationkey"), tag("R", "n_regionkey"), 1, "block", "n_name"), node(t("customer"), tag("C", "c_custkey"), tag("N", "c_nationkey"), 2, "entry", "c_name"),
        node(t("supplier"), tag("S", "s_suppkey"), tag("N", "s_nationkey"), 3, "title", "s_name"), node(t("part"), tag("P", "p_partkey"), tag("X", "p_size"), 1, "block", "p_name"),
    ]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


_STAR = """
WITH n AS (SELECT 'R' || r_regionkey AS node_id, NULL AS parent_id, 0 AS level, 'chapter' AS kind, r_name AS text FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 1, 'block', n_name FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 2, 'entry', c_name FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 3, 'title', s_name FROM supplier UNION ALL SELECT 'P' || p_partkey, 'X' || p_size, 1, 'block', p_name FROM part)
"""


def tree_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.check_tree(_star(spark, sf_dir))


VALIDATE_SQL = _STAR + """
, c AS (SELECT parent_id AS node_id, count(*) AS n, count(*) FILTER (kind = 'title') AS t FROM n WHERE parent_id IS NOT NULL GROUP BY 1),
j AS (SELECT n.*, p.node_id AS pid, p.level AS plevel, coalesce(c.n, 0) AS kids, coalesce(c.t, 0) AS titles FROM n LEFT JOIN n p ON n.parent_id = p.node_id LEFT JOIN c ON c.node_id = n.node_id)
SELECT node_id, 'MISSING_PARENT' AS problem FROM j WHERE parent_id IS NOT NULL AND pid IS NULL UNION ALL SELECT node_id, 'SELF_PARENT' FROM j WHERE parent_id = node_id UNION ALL SELECT node_id, 'LEVEL' FROM j WHERE level <> plevel + 1
UNION ALL SELECT node_id, 'CHAPTER_TITLE' FROM j WHERE kind = 'chapter' AND titles <> 1 UNION ALL SELECT node_id, 'EMPTY_BLOCK' FROM j WHERE kind IN ('block', 'heading') AND kids = 0
"""


def tree_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.unreachable(_star(spark, sf_dir).select("node_id", "parent_id"))


def node_path_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.paths(_star(spark, sf_dir), "node_id", "parent_id", "text")
    ids = F.col("ids")
    return found.select(F.col("node").alias("node_id"), F.array_join("path", " > ").alias("path"), T.nearest(ids, lambda i: i.startswith("N")).alias("nation"), T.visible_parent(F.transform(ids, lambda i: F.left(i, F.lit(1))), ["N"]).alias("visible"))


PATH_SQL = _STAR.replace("WITH n", "WITH RECURSIVE n", 1) + """
, u AS (SELECT node_id, [text] AS path, [node_id] AS ids FROM n WHERE parent_id IS NULL UNION ALL SELECT n.node_id, list_append(u.path, n.text), list_append(u.ids, n.node_id) FROM u JOIN n ON n.parent_id = u.node_id)
SELECT node_id, array_to_string(path, ' > ') AS path, list_filter(ids, lambda i: starts_with(i, 'N'))[-1] AS nation, list_filter(list_transform(ids[:-2], lambda i: left(i, 1)), lambda t: t <> 'N')[-1] AS visible FROM u
"""


def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes lie below each nation."""
    found = T.paths(_star(spark, sf_dir), "node_id", "parent_id", "text")
    return found.select(F.explode(F.slice("ids", F.lit(1), F.size("ids") - 1)).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("below"))


DESCENDANTS_SQL = PATH_SQL.split("SELECT node_id, array_to_string")[0] + "SELECT unnest(ids[:-2]) AS node_id, count(*) AS below FROM u GROUP BY 1"


def parallel_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders aligned with their lines as if these were another language of the same tree: path and tag, else line, else own text."""
    left = table(spark, sf_dir, "orders").select(F.lit("D").alias("document"), F.concat(F.lit("/"), F.col("o_custkey").cast("string")).alias("index_path"), F.col("o_orderpriority").alias("tag"), F.col("o_orderkey").alias("line"), F.col("o_orderstatus").alias("text"))
    right = table(spark, sf_dir, "customer").select(F.lit("D").alias("document"), F.concat(F.lit("/"), F.col("c_custkey").cast("string")).alias("index_path"), F.lit("1-URGENT").alias("tag"), F.when(F.col("c_nationkey") > 5, F.col("c_custkey")).alias("line"), F.col("c_name").alias("text"))
    return T.aligned(left, right).select("line", "parallel")


PARALLEL_SQL = """
SELECT o_orderkey AS line, coalesce(a.c_name, (SELECT arg_min(c_name, '/' || c_custkey) FROM customer b WHERE b.c_custkey = o_orderkey AND b.c_nationkey > 5), o_orderstatus) AS parallel
FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey AND o_orderpriority = '1-URGENT'
"""


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "place_conflict_context").dropDuplicates(["rowId"]).withColumnRenamed("rowId", "row_id")
    return line_page(once, ["office", "unit", "placeName", "declaredProvince", "region"], ["document", "chapter"]).select("row_id", "body", "path")


_P = lambda c: f"nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g'), ' '), '')"
LINE_PAGE_SQL = f"SELECT rowId AS row_id, concat_ws(' / ', {', '.join(map(_P, ['office', 'unit', 'placeName', 'declaredProvince', 'region']))}) AS body, concat_ws(' > ', {_P('document')}, {_P('chapter')}) AS path FROM (SELECT DISTINCT * EXCLUDE (loadedAt) FROM place_conflict_context)"


def container_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_page(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey")


def xml_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as XML trees and back to rows: every sentence an entry under its document."""
    esc = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, r"\s+", " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document"), F.concat(F.lit("<document>"), F.array_join(F.transform(F.split(esc(F.coalesce("text", F.lit(""))), r"[.] "), lambda s: F.concat(F.lit("<entry>"), s, F.lit("</entry>"))), ""), F.lit("</document>")).alias("text"))
    return readers.xml_tree(docs).groupBy("document", "tag").agg(F.count("*").alias("nodes"), F.sum(F.length("text")).alias("letters"))


XML_SQL = """
WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS document, unnest(string_split(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '. ')) AS s FROM documents)
SELECT document, 'entry' AS tag, count(*) AS nodes, CAST(sum(length(trim(s, ' ' || chr(160)))) AS BIGINT) AS letters FROM s GROUP BY 1 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'document', 1, 0 FROM documents
"""


def short_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "place_conflict_context").dropDuplicates(["rowId"])
    return once.select(F.col("rowId").alias("row_id"), T.short_title(F.coalesce("chapter", F.lit(""))).alias("short"))


SHORT_SQL = "SELECT rowId AS row_id, CASE WHEN len(w) > 2 THEN w[1] || ' ' || w[-1] ELSE array_to_string(w, ' ') END AS short FROM (SELECT DISTINCT rowId, list_filter(string_split_regex(coalesce(chapter, ''), '\\s+'), lambda x: x <> '') AS w FROM place_conflict_context)"

QUERIES = {
    "lines_scan": lines_scan, "chapter_ordinal": chapter_ordinal, "chapter_ranges": chapter_ranges, "join_range_lines": join_range_lines, "running_heading": running_heading, "flat_blocks": flat_blocks, "indent_tree": indent_tree, "adjacency_tree": adjacency_tree,
    "owner_offices": owner_offices, "roman_numerals": roman_numerals, "tree_validate": tree_validate, "tree_orphans": tree_orphans, "node_path_context": node_path_context, "descendants": descendants, "language_coalesce": parallel_tree, "line_page": line_pages,
    "container_page": container_pages, "xml_flatten": xml_flatten, "short_titles": short_titles,
}
SQL = {
    "lines_scan": _LINES + "SELECT document, CAST(line AS INTEGER) AS line, level, label FROM l", "chapter_ordinal": _LINES + "SELECT document, line, chapter_no, coalesce(last_value(CASE WHEN is_chapter THEN regexp_extract(label, '^([IVXLCDM]+)', 1) END IGNORE NULLS) OVER (PARTITION BY document ORDER BY line), '') AS chapter_roman FROM k",
    "chapter_ranges": _LINES + "SELECT document, chapter_no, line AS line_start, coalesce(lead(line) OVER (PARTITION BY document ORDER BY line) - 1, (SELECT max(line) FROM k z WHERE z.document = k.document)) AS line_end FROM k WHERE is_chapter",
    "join_range_lines": _LINES + "SELECT document, line, chapter_no FROM k WHERE chapter_no > 0 AND NOT is_chapter", "running_heading": RUNNING_SQL, "flat_blocks": FLAT_SQL, "owner_offices": OWNER_SQL, "adjacency_tree": ADJACENCY_SQL,
    "roman_numerals": f"SELECT n, {_ROMAN} AS numeral, n AS back FROM (SELECT DISTINCT sourceLine AS n FROM place_conflict_context WHERE sourceLine BETWEEN 1 AND 3999)", "tree_validate": VALIDATE_SQL,
    "tree_orphans": _STAR + "SELECT node_id, parent_id FROM n WHERE node_id LIKE 'P%'", "node_path_context": PATH_SQL, "descendants": DESCENDANTS_SQL, "language_coalesce": PARALLEL_SQL, "line_page": LINE_PAGE_SQL,
    "container_page": "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS position, l_returnflag FROM lineitem", "xml_flatten": XML_SQL, "short_titles": SHORT_SQL,
}
