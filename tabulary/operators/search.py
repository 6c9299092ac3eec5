"""Ranked search: a small query language, parsed on the driver and compiled to column expressions over an index."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulary.functions.text import norm_search


@dataclass(frozen=True)
class Field:
    """A searchable column (text or array of text) with its weight; direct fields are the record's own, context fields its surroundings."""

    column: str
    weight: int
    scope: str = "direct"


# The twelve fields of a record.
FIELDS = (
    Field("text", 140), Field("title", 130), Field("office", 120), Field("unit", 120), Field("places", 110), Field("place_sources", 100), Field("chapter", 80, "context"), Field("context", 50, "context"),
    Field("structure", 45, "context"), Field("office_type", 35, "context"), Field("owner_office", 35, "context"), Field("document", 20, "context"),
)
CONTEXT_PENALTY, DIRECT_WEIGHT, WEAKEST_WEIGHT, IN_BONUS, OR_BONUS = 120, 10**9, 10**3, 5000, 1000
NO_LINE = 2**53 - 1


@dataclass(frozen=True)
class Node:
    kind: str
    left: Node | None = None
    right: Node | None = None
    value: str = ""


def fold(text: str) -> str:
    """norm_search for a Python string."""
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", " ".join(text.split())) if not 0x300 <= ord(c) <= 0x36F)
    return plain.lower()


OPERATORS = (("not_in", re.compile(r"NOT\s+IN\b")), ("in", re.compile(r"IN\b")), ("and", re.compile(r"AND\b", re.I)), ("or", re.compile(r"OR\b", re.I)))


def tokens(query: str) -> list[tuple[str, str]]:
    """Tokens of an advanced query. Operators in capitals count at any place of a word; and / or in small letters only after a blank."""
    found: list[tuple[str, str]] = []
    at, start = 0, 0

    def term(until: int) -> None:
        if value := fold(query[start:until]).strip():
            found.append(("term", value))

    while at < len(query):
        kind, end = (query[at], at + 1) if query[at] in "()" else ("", at)
        for name, pattern in () if kind else OPERATORS:
            match = pattern.match(query, at)
            if match and (match[0] == match[0].upper() or at == 0 or query[at - 1].isspace()):
                kind, end = name, match.end()
                break
        if kind:
            term(at)
            found.append((kind, ""))
            start = end
        at = max(end, at + 1)
    term(len(query))
    return found


def parse(query: str) -> Node | None:
    """The tree of an advanced query, or over and over in / not in (left first); None when it does not parse to its end."""
    rest = tokens(query)[::-1]
    peek = lambda: rest[-1][0] if rest else ""

    def chain(kinds: Sequence[str], below):
        node = below()
        while node and peek() in kinds:
            kind = rest.pop()[0]
            right = below()
            node = Node(kind, node, right) if right else None
        return node

    def primary() -> Node | None:
        kind, value = rest.pop() if rest else ("", "")
        if kind == "term":
            return Node("term", value=value)
        if kind == "(":
            node = either()
            return node if node and rest and rest.pop()[0] == ")" else None
        return None

    def scoped():
        return chain(("in", "not_in"), primary)

    def both():
        return chain(("and",), scoped)

    def either():
        return chain(("or",), both)

    node = either()
    return node if node and not rest else None


def is_advanced(query: str) -> bool:
    return bool(re.search(r"[()]|\bIN\b|\bNOT\s+IN\b", query))


def simple_boolean(query: str) -> tuple[str, str, str] | None:
    """(left, operator, right) of a folded query with exactly one and / or; chained operators are no Boolean query."""
    match = re.fullmatch(r"(.+?)\s+(and|or)\s+(.+)", query)
    if not match or any(re.search(r"\s+(?:and|or)\s+", part) for part in (match[1], match[3])):
        return None
    return match[1], match[2], match[3]


def _quoted(term: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", term)


def field_score(value: Column, term: str, field: Field) -> Column:
    """1000 for the whole field, 750 for whole words, 550 for the beginning of a word, 350 within; plus weight, less 120 for context; null else."""
    q, base = _quoted(term), field.weight - (CONTEXT_PENALTY if field.scope == "context" else 0)
    return (
        F.when(value == "", F.lit(None)).when(value == term, 1000 + base).when(~value.contains(term), F.lit(None))
        .when(value.rlike(f"(?:^|[^a-z0-9]){q}(?:$|[^a-z0-9])"), 750 + base).when(value.rlike(f"(?:^|[^a-z0-9]){q}"), 550 + base).otherwise(350 + base).cast("bigint")
    )


class Compiler:
    """Compiles terms and trees to (matched, score) columns over the folded fields of an index.

    Each term gets one column, the array of its scores by field, so every field is tested once however the query uses it.
    """

    def __init__(self, fields: Sequence[Field]):
        self.fields, self.terms = fields, {}

    def scores(self, term: str) -> Column:
        return F.col(self.terms.setdefault(term, f"_term{len(self.terms)}"))

    def scored(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: F.array(*[field_score(F.col(f"_{f.column}"), term, f) for f in self.fields]) for term, name in self.terms.items()})

    def best(self, term: str, scope: str) -> Column:
        if scope == "all":
            return F.array_max(self.scores(term))
        return F.array_max(F.array(*[F.get(self.scores(term), F.lit(i)) for i, f in enumerate(self.fields) if f.scope == scope] or [F.lit(None).cast("bigint")]))

    def strong(self, term: str) -> Column:
        """Whether the term's best field holds it as a whole or as whole words."""
        whole = F.array(*[F.lit(750 + f.weight - (CONTEXT_PENALTY if f.scope == "context" else 0)) for f in self.fields])
        best = self.best(term, "all")
        return F.exists(F.zip_with(self.scores(term), whole, lambda s, w: (s == best) & (s >= w)), lambda x: F.coalesce(x, F.lit(False)))

    def all_terms(self, terms: Sequence[str], scope: str = "all") -> tuple[Column, Column]:
        bests = [self.best(t, scope) for t in terms]
        matched = reduce(lambda a, b: a & b, [b.isNotNull() for b in bests])
        direct = [(self.best(t, "direct").isNotNull() if scope != "context" else F.lit(False)).cast("bigint") for t in terms]
        total = lambda cs: reduce(lambda a, b: a + b, cs)
        weakest = F.least(*bests) if len(bests) > 1 else bests[0]
        return matched, (total(direct) * DIRECT_WEIGHT + weakest * WEAKEST_WEIGHT + total(bests)).cast("bigint")

    def tree(self, node: Node, scope: str = "all") -> tuple[Column, Column]:
        if node.kind == "term":
            return self.all_terms(node.value.split(), scope)
        inner = node.kind in ("in", "not_in")
        (lm, ls), (rm, rs) = self.tree(node.left, "direct" if inner else scope), self.tree(node.right, "context" if inner else scope)
        if node.kind == "not_in":
            return lm & ~rm, ls
        if node.kind == "or":
            return lm | rm, F.when(lm & rm, F.greatest(ls, rs) + OR_BONUS).when(lm, ls).otherwise(rs)
        return lm & rm, ls + rs + (IN_BONUS if inner else 0)

    def hits(self, df: DataFrame, matched: Column, score: Column) -> DataFrame:
        return self.scored(df).withColumn("score", score).where(matched)


def index(df: DataFrame, fields: Sequence[Field] = FIELDS) -> DataFrame:
    """df with a folded column _name for each field; arrays are joined by blanks, missing columns are empty. Keep it for many queries."""
    kinds = dict(df.dtypes)
    folded = {f"_{f.column}": norm_search(F.array_join(f.column, " ") if kinds.get(f.column, "").startswith("array") else F.col(f.column) if f.column in kinds else F.lit("")) for f in fields}
    return df.withColumns(folded)


def _single(df: DataFrame, term: str, compiler: Compiler) -> DataFrame:
    """Records for one term; where any matches as exact or whole words in its best field, only such records."""
    matched, score = compiler.all_terms([term])
    strong = compiler.strong(term)
    hits = compiler.hits(df, matched, score).withColumn("_strong", strong)
    any_strong = hits.agg(F.coalesce(F.bool_or("_strong"), F.lit(False))).scalar()
    return hits.where(F.col("_strong") | ~any_strong).drop("_strong", *compiler.terms.values())


def search(df: DataFrame, query: str, fields: Sequence[Field] = FIELDS, key: str = "id") -> DataFrame:
    """The matching records of an index with `score` (and matched_terms), unordered; see `ranked`.

    One word: records that hold it, only whole words if there are any. Several words, or `a and b`: all must match.
    `a or b`: records of either, with the better score. IN, NOT IN and brackets: an expression whose left side is
    sought in the record itself and whose right side in its surroundings. An empty query finds nothing.
    """
    compiler = Compiler(fields)
    found, own = fold(query).strip(), [f"_{f.column}" for f in fields]
    one = F.lit(1).alias("matched_terms")
    if not found:
        return df.where(F.lit(False)).select("*", F.lit(0).cast("bigint").alias("score"), one).drop(*own)
    if is_advanced(query) and (tree := parse(query)):
        matched, score = compiler.tree(tree)
        return compiler.hits(df, matched, score).select("*", one).drop(*own, *compiler.terms.values())
    boolean = simple_boolean(found)
    if boolean and boolean[1] == "or":
        parts = [_single(df, t, Compiler(fields)).select("*", one).withColumn("_t", F.lit(t)) for t in (boolean[0], boolean[2])]
        merged = parts[0].unionByName(parts[1]) if boolean[0] != boolean[2] else parts[0]
        w = W.partitionBy(key)
        ranked_ = merged.withColumn("matched_terms", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), "_t"))).where("_n = 1")
        return ranked_.withColumn("matched_terms", F.col("matched_terms").cast("int")).drop("_n", "_t", *own)
    terms = [boolean[0], boolean[2]] if boolean else found.split(" ")
    if len(terms) == 1:
        return _single(df, terms[0], compiler).select("*", one).drop(*own)
    matched, score = compiler.all_terms(terms)
    return compiler.hits(df, matched, score).select("*", one).drop(*own, *compiler.terms.values())


def ranked(hits: DataFrame, line: str = "line", key: str = "id") -> DataFrame:
    """Hits in their order: more matched terms, higher score, lower line (none last), then key."""
    return hits.orderBy(F.desc("matched_terms"), F.desc("score"), F.coalesce(F.col(line).try_cast("bigint"), F.lit(NO_LINE)), key)


def facet(df: DataFrame, column: str) -> DataFrame:
    """The distinct non-empty values of a column or array column, sorted without regard to accents and case."""
    value = F.explode(column) if dict(df.dtypes)[column].startswith("array") else F.col(column)
    distinct = df.select(value.alias("value")).where("value <> ''").distinct()
    return distinct.orderBy(norm_search(F.col("value")), "value")


def evidence(hits: DataFrame, terms: Sequence[str], text: str, context: str) -> DataFrame:
    """(.., term, evidence): for every term not visible in text, the shortest context item that holds it, null when none does."""
    folded = norm_search(F.col(text))
    absent = F.array_compact(F.array(*[F.when(~folded.contains(t), t) for t in (fold(t).strip() for t in terms)]))
    spread = hits.withColumn("term", F.explode(absent))
    held = F.filter(F.col(context), lambda c: norm_search(c).contains(F.col("term")))
    return spread.withColumn("evidence", F.array_min(F.transform(held, lambda c: F.struct(F.length(c).alias("n"), c.alias("v"))))["v"])


def display_terms(query: str) -> list[str]:
    """The words of a query to be marked in results, without operators and brackets."""
    plain = re.sub(r"[()]|\bNOT\s+IN\b|\bIN\b|\b(?:AND|OR|and|or)\b", " ", query)
    return list(dict.fromkeys(fold(plain).split()))


def detail(*columns: str) -> Column:
    """The non-empty parts of a result joined by ' · '."""
    return F.concat_ws(" · ", *[F.nullif(F.trim(c), F.lit("")) for c in columns])
