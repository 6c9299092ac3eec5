"""Several values packed in one field: the dialect is chosen by minimum description length."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Collection, Iterable, Iterator, Sequence
from math import log2

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.session import table, written

# Marks that never set values apart, besides letters, digits and blanks.
BELONGING = ":：()（）.'’‘`´@%?!*§°ʼ[]"
QUOTES = {'"': '"', "“": "”", "„": "“”", "”": "”", "«": "»", "‘": "’", "'": "'"}
#: The chance, before anything is counted, that a mark sets values apart.
SEPARATES = 0.95
CHARACTER_BITS, STRAY_BITS, PLAIN_BITS = 5.0, 20.0, 4.0
#: Fields that hold nothing that could set values apart or protect them: they are one value, and never leave the JVM.
ALONE = r"\A[\p{L}\p{M}\p{N} :.()-]*\z"
SPECIAL = re.compile(r"[^\w ]|_")
LETTER, NO_LETTER = re.compile(r"[^\W_]"), re.compile(r"[\W_]+")
OTHER = regex.compile(r"[^\p{L}\p{M}\p{N} :()-]")
SPANS = "row_id bigint, field string, several boolean, plain boolean, need string, inner string, code bigint, spelled double, extra double, letters int, prior double, n int"
VALUES = "row_id bigint, field string, position int, value string"


@functools.cache
def separates(ch: str) -> bool:
    """Whether a character may set values apart: control characters and punctuation, save what belongs to values."""
    kind = unicodedata.category(ch)
    return kind in ("Cc", "Zl", "Zp") or (kind[0] in "PS" and kind != "Pd" and ch not in BELONGING and ch not in "\"“”„«»-" and not unicodedata.combining(ch))


def scan(text: str, quoting: bool = True) -> list[tuple[str, str]]:
    """The text as pieces ('v', unquoted text), ('q', what quotation marks protect) and ('d', one separating mark)."""
    pieces: list[tuple[str, str]] = []
    run, open_ended = 0, set()

    def put(end: int) -> None:
        if text[run:end].strip():
            pieces.append(("v", text[run:end]))

    for match in SPECIAL.finditer(text):
        at, ch = match.start(), match[0]
        if at < run:
            continue
        if quoting and ch in QUOTES and ch not in open_ended and not text[run:at].strip():
            end = _closing(text, at)
            if end >= 0:
                inner = text[at + 1 : end]
                pieces.append(("q", inner.replace('""', '"') if ch == '"' else inner))
                run = end + 1
                continue
            if '""' not in text:
                open_ended.add(ch)
        if separates(ch):
            put(at)
            pieces.append(("d", ch))
            run = at + 1
    put(len(text))
    return pieces


def _closing(text: str, start: int) -> int:
    """Where the quotation that opens at start closes: before a separating mark or the end, blanks aside; -1 for nowhere."""
    ch, end, size = text[start], start + 1, len(text)
    while end < size:
        if text[end] in QUOTES[ch]:
            if ch == '"' and text[end + 1 : end + 2] == '"':
                end += 2
                continue
            after = end + 1
            while after < size and text[after] in " \u00a0":
                after += 1
            if after == size or separates(text[after]):
                return end
        end += 1
    return -1


def body_of(text: str | None) -> str:
    """A field without the blanks around it and the square brackets around the whole of it."""
    body = (text or "").strip()
    return body[1:-1].strip() if re.fullmatch(r"\[.*\]", body, re.S) else body


class Regions:
    """A field cut at every mark: regions of text with the mark after each, from which any dialect's values are joined."""

    def __init__(self, pieces: Sequence[tuple[str, str]]):
        self.marks: list[str] = []
        self.bounds, self.quoted, parts, at, start, quoted = [], [], [], 0, 0, False
        for kind, part in [*pieces, ("d", "")]:
            if kind == "d":
                self.bounds.append((start, at))
                self.quoted.append(quoted)
                self.marks.append(part)
                start, quoted = at + len(part), False
            quoted |= kind == "q"
            parts.append(part)
            at += len(part)
        self.raw = "".join(parts)

    def value(self, first: int, last: int) -> str:
        """The value that regions first to last make together, '' when it is none: bare marks are no value."""
        value = self.raw[self.bounds[first][0] : self.bounds[last][1]].strip()
        return value if value and (LETTER.search(value) or any(self.quoted[first : last + 1])) else ""

    def values(self, marks: Collection[str]) -> list[str]:
        """The values when only the given marks separate; other marks stay inside their value."""
        found, first = [], 0
        for last, mark in enumerate(self.marks):
            if not mark or mark in marks:
                found.append(self.value(first, last))
                first = last + 1
        return [v for v in found if v]

    def spans(self) -> Iterator[tuple[str, str, str]]:
        """(marks that bound it, marks inside it, value) of every value that some dialect has, each place once.

        A value between marks a and b holds neither, so from each region it is enough to go on to the next a and to
        stop at the first of every other mark: at most regions times marks, whatever the number of dialects.
        """
        left, count = "", len(self.marks)
        if count == 1:
            if value := self.value(0, 0):
                yield "", "", value
            return
        for first in range(count):
            inside = ""
            for last in range(first, count):
                right = self.marks[last]
                if right not in inside or not right:
                    if value := self.value(first, last):
                        yield left if left == right else left + right if left < right else right + left, inside, value
                if not right or right == left:
                    break
                if right not in inside:
                    inside = "".join(sorted(inside + right))
            left = self.marks[first]


def spelled_bits(value: str) -> float:
    """The length of a value written letter by letter."""
    others = 0 if value.isascii() and value.isalnum() else len(OTHER.findall(value))
    return (len(value) - others) * CHARACTER_BITS + others * STRAY_BITS + CHARACTER_BITS


def sole_mark(body: str) -> str:
    """The mark of a text that holds a single kind of mark and no quotation marks, '' for any other."""
    special = set(SPECIAL.findall(body))
    marks = [ch for ch in special if separates(ch)]
    return marks[0] if len(marks) == 1 and special.isdisjoint(QUOTES) else ""


def cut(body: str, mark: str) -> list[str]:
    """What one mark sets apart, where quotation marks play no part."""
    return [v for v in map(str.strip, body.split(mark)) if LETTER.search(v)]


def readings(text: str | None) -> list[tuple[bool, Regions]]:
    """(whether quotation marks are plain characters, regions): one or two readings of a field."""
    body = body_of(text)
    quoted = scan(body)
    plain = scan(body, False) if any(q in body for q in QUOTES) else quoted
    return [(False, Regions(quoted))] + ([(True, Regions(plain))] if plain != quoted else [])


def field_spans(text: str | None) -> list[tuple]:
    """Rows of SPANS without row_id and field: the distinct values of all dialects of a field and how likely each is.

    The prior of a value is the chance that a dialect of the field has it, so the code book is not taken from one
    parse: a mark separates with the chance SEPARATES. A reading that takes paired quotation marks as plain characters
    adds nothing to the book.
    """
    body = body_of(text)
    if mark := sole_mark(body):  # the common case, without the machinery for the others
        ways = [(False, Counter([("", mark, body.strip())] * bool(LETTER.search(body)) + [(mark, "", v) for v in cut(body, mark)]))]
        several = True
    else:
        ways = [(plain, Counter(regions.spans())) for plain, regions in readings(text)]
        several = len(ways) > 1 or any(need for _, counts in ways for need, _, _ in counts)
    rows = []
    for plain, counts in ways:
        for (need, inner, value), n in counts.items():
            extra = STRAY_BITS * sum(value.count(q) for q in '"“”') if plain else 0.0
            prior = n * SEPARATES ** len(need) * (1 - SEPARATES) ** len(inner) * (not plain)
            code = xxhash.xxh64_intdigest(value, 42)
            rows.append((several, plain, need, inner, code - (1 << 64 if code >> 63 else 0), spelled_bits(value), extra, len(NO_LETTER.sub("", value)), prior, n))
    return rows


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SPANS.split(", ")]
    for batch in batches:
        rows = []
        for row_id, field, text in zip(batch["row_id"].tolist(), batch["field"].tolist(), batch["text"].tolist(), strict=True):
            rows += [(row_id, field, *span) for span in field_spans(text)]
            if len(rows) > 100_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)


def cheapest(spans: Iterable[tuple[str, str, float, int, int]]) -> tuple[float, str]:
    """(cost, marks) of the cheapest dialect of one reading, of (need, inner, bits, letters, n) of its values.

    A value counts when all marks that bound it separate and none inside it does. The order of the separating marks is
    coded by their frequencies. Branch and bound over the marks: what is settled, and for the letters not yet covered
    the lowest bits a letter among values still possible, bound the cost from below, so the search is exact for any
    number of marks. On a tie more marks win.
    """
    spans = list(spans)
    if len(kinds := {(need, inner) for need, inner, *_ in spans}) == 2 and len(marks := "".join(sorted({m for k in kinds for m in k if m}))) == 1:
        whole, apart = (sum(bits for need, _, bits, *_ in spans if bool(need) == split) for split in (False, True))
        costs = round(whole - log2(1 - SEPARATES), 6), round(apart - log2(SEPARATES), 6)
        return (costs[0], "") if costs[0] < costs[1] else (costs[1], marks)
    marks = sorted({m for need, inner, *_ in spans for m in need + inner})
    bit = {m: 1 << i for i, m in enumerate(marks)}
    rows: dict[tuple[int, int], list] = {}
    times = {m: max(0, sum(n for need, _, _, _, n in spans if need == m) - 1) for m in marks}  # of the values that m alone sets apart
    for need, inner, bits, letters, n in spans:
        row = rows.setdefault((sum(bit[m] for m in need), sum(bit[m] for m in inner)), [0.0, 0, float("inf")])
        row[0] += bits
        row[1] += letters
        row[2] = min(row[2], bits / letters) if letters else row[2]
    facts = [(need, inner, *row) for (need, inner), row in rows.items()]
    whole = sum(letters for need, _, _, letters, _ in facts if not need)
    best: list = [float("inf"), 0]

    def search(level: int, chosen: int, refused: int, used: int, orders: float, live: list) -> None:
        cost, covered, rate = (used * log2(used) if used else 0.0) - orders, 0, float("inf")
        cost -= chosen.bit_count() * log2(SEPARATES) + refused.bit_count() * log2(1 - SEPARATES)
        for need, inner, bits, letters, low in live:
            if need & chosen == need and inner & refused == inner:
                cost, covered = cost + bits, covered + letters
            elif low < rate:
                rate = low
        if whole > covered and rate < float("inf"):
            cost += (whole - covered) * rate
        cost = round(cost, 6)
        if cost > best[0] or (cost == best[0] and chosen.bit_count() + len(marks) - level <= best[1].bit_count()):
            return
        if level == len(marks):
            best[:] = cost, chosen
            return
        mark, n = 1 << level, times[marks[level]]
        search(level + 1, chosen | mark, refused, used + n, orders + n * log2(max(n, 1)), [f for f in live if not f[1] & mark])
        search(level + 1, chosen, refused | mark, used, orders, [f for f in live if not f[0] & mark])

    search(0, 0, 0, 0, 0.0, facts)
    return best[0], "".join(m for m in marks if bit[m] & best[1])


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["plain", "need", "inner", "bits", "letters", "n"]
    for batch in batches:
        chosen = []
        for row in zip(*[batch[c] for c in columns], strict=True):
            options = []
            for reading in sorted(set(row[0])):
                cost, marks = cheapest((need, inner, bits, letters, n) for plain, need, inner, bits, letters, n in zip(*row, strict=True) if plain == reading)
                options.append((cost + reading * PLAIN_BITS, reading, marks))
            chosen.append(min(options))
        yield pd.DataFrame({"row_id": batch["row_id"], "field": batch["field"], "as_plain": [c[1] for c in chosen], "marks": [c[2] for c in chosen]})


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row_id, field, text, plain, marks in zip(*[batch[c] for c in ("row_id", "field", "text", "as_plain", "marks")], strict=True):
            body = body_of(text)
            if mark := sole_mark(body):
                values = cut(body, mark) if mark in (marks or "") else [body]
            else:
                values = Regions(scan(body, plain is not True)).values(marks or "")
            rows += [(row_id, field, i, v) for i, v in enumerate(values, 1)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in VALUES.split(", ")])


def split_values(rows: DataFrame) -> DataFrame:
    """rows (row_id, field, text) -> (row_id, field, position, value).

    Each field takes the cheapest of all its dialects: which of its marks separate, and whether quotation marks
    protect. A dialect costs its marks, their order, and each value's code: by its expected frequency
    among the values of the field over the whole table and all dialects, with its part of the entry in the code book,
    or letter by letter where that is shorter. No parse is written out: the values that any dialect can have are listed once with a hash to look their codes up by, and
    the search over the marks is exact for any number of them. On a tie the dialect with more marks is taken. row_id
    is one per row; a null, empty or mark-only field has no values; position counts from 1.
    """
    rows = written(rows.select(F.col("row_id").cast("bigint").alias("row_id"), "field", "text").where("text is not null"), "fields")
    alone, marked = rows.where(F.col("text").rlike(ALONE)).withColumn("text", F.trim("text")), rows.where(~F.col("text").rlike(ALONE))
    single = alone.where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    sure = {"several": F.lit(False), "plain": F.lit(False), "need": F.lit(""), "inner": F.lit(""), "code": F.xxhash64("text"), "spelled": F.lit(0.0), "extra": F.lit(0.0), "letters": F.lit(0), "prior": F.lit(1.0), "n": F.lit(1)}
    names = [c.split()[0] for c in SPANS.split(", ")]
    spans = written(marked.mapInPandas(_spans, SPANS).unionByName(single.withColumns(sure).select(*names)), "multivalue")
    counted = spans.where("prior > 0").groupBy("field", "code").agg(F.sum("prior").alias("n"))
    totals = counted.groupBy("field").agg(F.sum("n").alias("total"))
    codes = counted.join(totals, "field").select("field", "code", (F.log2(F.col("total") / F.col("n")) + 1).alias("coded"), F.col("n").alias("uses"))
    coded = F.least(F.col("coded") + F.col("spelled") / F.col("uses"), "spelled") + F.col("extra")
    costs = spans.where("several").join(codes, ["field", "code"], "left").withColumn("bits", F.col("n") * coded)
    own = ["row_id", "field"]
    lists = costs.withColumn("letters", F.col("letters") * F.col("n")).groupBy(*own).agg(*[F.collect_list(c).alias(c) for c in ("plain", "need", "inner", "bits", "letters", "n")])
    dialects = lists.mapInPandas(_choose, "row_id bigint, field string, as_plain boolean, marks string")
    parted = marked.join(dialects, own, "left").mapInPandas(_split, VALUES)
    return parted.unionByName(single.select(*own, F.lit(1).alias("position"), F.col("text").alias("value")))


FIELDS = ("notitiaForms", "sourceRefs", "geoObjectIds", "geojsonNames")


def packed_fields(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(row_id, field, text) of the packed fields; a row that was delivered again counts once."""
    once = df.select("rowId", *fields).dropDuplicates(["rowId"])
    return once.select(F.col("rowId").alias("row_id"), F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", "text"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_values(packed_fields(table(spark, sf_dir, "province_gazetteer")))


FOUND_SQL = r"""
WITH f AS (SELECT DISTINCT rowId AS row_id, unnest([{'f': 'notitiaForms', 't': notitiaForms}, {'f': 'sourceRefs', 't': sourceRefs}, {'f': 'geoObjectIds', 't': geoObjectIds}, {'f': 'geojsonNames', 't': geojsonNames}]) AS x FROM province_gazetteer),
b AS (SELECT row_id, x.f AS field, trim(regexp_replace(regexp_replace(x.t, '^\s+|\s+$', '', 'g'), '^\[((?s:.*))\]$', '\1')) AS t FROM f WHERE x.t IS NOT NULL),
v AS (SELECT row_id, field, list_filter(list_transform(regexp_extract_all(t, '\s*("(?:[^"]|"")*"|“[^”]*”|[^|;,/\n\t｜；¦]+)', 1), lambda p: CASE WHEN starts_with(p, '"') AND length(trim(p)) > 1 THEN replace(substr(trim(p), 2, length(trim(p)) - 2), '""', '"')
    WHEN starts_with(p, '“') THEN substr(trim(p), 2, length(trim(p)) - 2) ELSE p END), lambda p: regexp_matches(p, '[\p{L}\p{N}]')) AS vs FROM b)
SELECT row_id, field, CAST(unnest(range(1, len(vs) + 1)) AS INTEGER) AS position, regexp_replace(unnest(vs), '^\s+|\s+$', '', 'g') AS value FROM v
"""
