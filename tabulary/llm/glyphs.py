"""One consistent form for text that looks the same but differs in its characters."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Mapping

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.session import table, written

# Letters and marks that look like others, and what they look like, place by place.
LOOKALIKE = "АВЕЅІЈКМНОРСТХУаеѕіјорсхуԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορϲϳ‐‑"
LOOKS_LIKE = "ABESIJKMHOPCTXYaesijopcxydhqwABEZHIKMNOPTYXvopcj--"
# Further letters of that kind, by script: Armenian, Cherokee, Coptic, Lisu and letters of phonetic script.
MORE_LOOKALIKE = "օՕոսհցՏᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃⲞⲟⲤⲥⲢⲣꓐꓚꓓꓰꓖꓧꓙꓗꓡꓟꓠꓳꓑꓢꓔꓦꓪꓫꓬꓜɡıοᴏᴄᴠᴡᴢꜱ"
MORE_LOOKS_LIKE = "oOnuhgSABCDEHJKLMPSTVWZOoCcPpBCDEGHJKLMNOPSTVWXYZgıoocvwzs"
#: Kinds of Unicode compatibility forms that differ in width, style or place in a word only; circled, raised or squared forms look different.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Marks whose clusters are compiled in advance; clusters of other or of more than two marks are composed before the pass.
ABOVE, BELOW = [chr(c) for c in (*range(0x300, 0x30D), 0x30F, 0x311, 0x313, 0x314)], [chr(c) for c in (0x31B, 0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330, 0x331)]
RARE = regex.compile(rf"\p{{M}}{{3}}|[^\P{{M}}{''.join(ABOVE + BELOW)}\u034f\ufe00-\ufe0f]")
#: What does not show: format characters and variation selectors, save joiners and selectors where they do show.
UNSEEN = regex.compile(
    r"(?:(?<![\p{Arabic}\p{Syriac}\p{Mongolian}\p{Nko}])\u200c|\u200c(?![\p{Arabic}\p{Syriac}\p{Mongolian}\p{Nko}])|(?<![\p{Extended_Pictographic}\ufe0f\p{Emoji_Modifier}\p{Arabic}\p{Ccc=Virama}])\u200d|\u200d(?![\p{Extended_Pictographic}\p{Arabic}\p{L}])"
    r"|(?<!\p{Extended_Pictographic})[\ufe00-\ufe0f]|(?![\u200c\u200d\U000e0020-\U000e007f])\p{Cf}|\u034f)+"
)
MAY_BE_UNSEEN = regex.compile(r"[\p{Cf}\u034f\ufe00-\ufe0f]")
#: Text of this form is already consistent and passes through untouched.
CONSISTENT = r"^(?:[!-~À-ıĴ-ĿŁ-ňŊ-ǃǍ-ǰǴ-ɏΆ-ώ–—‘’“”…]+(?: [!-~À-ıĴ-ĿŁ-ňŊ-ǃǍ-ǰǴ-ɏΆ-ώ–—‘’“”…]+)*)?$"


def confusables(lines: Iterable[str]) -> dict[str, str]:
    """The mapping in a file of Unicode's confusables format, `source ; target ; kind # comment` in hexadecimal; one character to one or more."""
    pairs = {}
    for line in lines:
        parts = line.split("#")[0].split(";")
        if len(parts) >= 2:
            source, target = ("".join(chr(int(c, 16)) for c in p.split()) for p in parts[:2])
            pairs[source] = target
    return pairs


class Transducer:
    """A mapping of grapheme clusters, compiled into one automaton that takes the longest match at each place in one pass.

    The mapping is computed when it is built: look-alikes (table: the fixed ones, or any other passed as data), the
    compatibility forms that look the same, letters that Unicode writes in two ways, and clusters of each letter with one or two
    marks in every order and composition. Building fails when one sequence would get two outputs, or when any output
    would itself be changed, so one pass reaches a form that a second leaves alone.
    """

    def __init__(self, table: Mapping[str, str] | None = None) -> None:
        self.map: dict[str, str] = {}
        self.table = dict(zip(LOOKALIKE + MORE_LOOKALIKE, LOOKS_LIKE + MORE_LOOKS_LIKE, strict=True)) if table is None else dict(table)
        self.table = {a: b for a, b in self.table.items() if a != b}
        for a, b in self.table.items():
            self.add(a, b)
        self._same_look()
        for base in sorted({unicodedata.normalize("NFD", chr(c))[0] for c in (*range(0x41, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000))} | {a for a in self.table if len(a) == 1}):
            if unicodedata.category(base)[0] == "L":
                self._clusters(base)
        for high in ABOVE:
            for low in BELOW:
                self.add(high + low, low + high)
        self.automaton = ahocorasick.Automaton()
        for sequence, out in self.map.items():
            self.automaton.add_word(sequence, (len(sequence), out))
        self.automaton.make_automaton()
        self.back = {script: {b: a for a, b in zip(LOOKALIKE, LOOKS_LIKE, strict=True) if lo <= a <= hi} for script, lo, hi in (("Cyrillic", "\u0400", "\u052f"), ("Greek", "\u0370", "\u03ff"))} if table is None else {}
        for out in set(self.map.values()):
            if self.one_pass(out)[0] != out:
                raise ValueError(f"the output {out!r} is itself mapped to {self.one_pass(out)[0]!r}")

    def add(self, sequence: str, out: str) -> None:
        if self.map.setdefault(sequence, out) != out:
            raise ValueError(f"{sequence!r} would become both {self.map[sequence]!r} and {out!r}")

    def _letters(self, text: str) -> str:
        """text with its letters replaced by what they look like, composed."""
        return unicodedata.normalize("NFC", "".join(self.table.get(c, c) for c in unicodedata.normalize("NFD", text)))

    def _same_look(self) -> None:
        for code in range(0xA0, 0x20000):
            char = chr(code)
            kind, *_ = unicodedata.decomposition(char).split(" ") or [""]
            joined = kind == "<compat>" and unicodedata.category(char)[0] in "LN" and char not in "ſ" and not 0x370 <= code < 0x400 and not 0x2070 <= code < 0x20A0 or char == "µ"
            if char in self.table or not kind or unicodedata.category(char)[0] in "ZM":
                continue
            if kind in SAME_LOOK or joined or not kind.startswith("<"):
                out = self._letters(unicodedata.normalize("NFKC" if kind.startswith("<") else "NFC", char))
                if out != char and not any(unicodedata.category(c)[0] in "ZM" and kind.startswith("<") for c in out):
                    self.add(char, out)

        for code in range(0xFF66, 0xFF9E):
            for mark in "\uff9e\uff9f":
                if len(out := unicodedata.normalize("NFKC", chr(code) + mark)) == 1:
                    self.add(chr(code) + mark, out)

    def _clusters(self, base: str) -> None:
        marks = ABOVE + BELOW
        own = [m for m in marks if len(unicodedata.normalize("NFC", base + m)) == 1 or base in self.table and len(self._letters(base + m)) == 1]
        for first in marks:
            self._ways(base, first)
        for first in own:
            for second in marks:
                if second != first:
                    self._ways(base, first, second)
                    if unicodedata.combining(first) != unicodedata.combining(second):
                        self._ways(base, second, first)

    def _ways(self, base: str, *marks: str) -> None:
        out = self._letters(base + "".join(marks))
        for sequence in {base + "".join(marks), *([unicodedata.normalize("NFC", base + marks[0]) + marks[1]] if len(marks) > 1 else [])}:
            if sequence != out:
                self.add(sequence, out)

    def one_pass(self, text: str) -> tuple[str, bool]:
        """The text with every longest match replaced, and whether a mark follows a replaced character that has no cluster with it."""
        parts, at, again = [], 0, False
        for last, (size, out) in self.automaton.iter_long(text):
            parts += (text[at : last + 1 - size], out)
            at = last + 1
            again |= at < len(text) and unicodedata.combining(text[at]) > 0
        return "".join([*parts, text[at:]]) if at else text, again

    def _own_script(self, word: str) -> str:
        """A Cyrillic or Greek word whole in its script: one with letters only that script has, and none that only Latin has."""
        for script, back in self.back.items():
            if SCRIPT[script].search(word):
                parts = unicodedata.normalize("NFD", word)
                if not any(c.isalpha() and c not in back and not SCRIPT[script].match(c) for c in parts):
                    return unicodedata.normalize("NFC", "".join(back.get(c, c) for c in parts))
        return word

    def __call__(self, text: str) -> str:
        if MAY_BE_UNSEEN.search(text):
            text = UNSEEN.sub("", text)
        if RARE.search(text):
            text = unicodedata.normalize("NFC", text)
        text, again = self.one_pass(text)
        if again:
            text = self.one_pass(unicodedata.normalize("NFC", text))[0]
        words = text.split()
        if self.back and OTHER_SCRIPT.search(text):
            words = [self._own_script(w) for w in words]
        return " ".join(words)


SCRIPT = {"Cyrillic": regex.compile(r"\p{Cyrillic}"), "Greek": regex.compile(r"\p{Greek}")}
OTHER_SCRIPT = regex.compile(r"[\p{Cyrillic}\p{Greek}]")


@functools.cache
def compiled() -> Transducer:
    """The transducer of the fixed table, built once in the driver and sent to the tasks as it is."""
    return Transducer()


def one_form(text: str | None) -> str | None:
    """The consistent form of one text; null stays null."""
    return None if text is None else compiled()(text)


def consistent(column: Column | str, table: Mapping[str, str] | None = None) -> Column:
    """The consistent form of a text column: normal width, precomposed accents, Latin letters for look-alikes, single blanks.

    Case, accents, letters and punctuation stay; words with letters that only Cyrillic or Greek has stay in that script whole. Joiners
    stay where they show (emoji, Arabic and Indic words). Only texts that hold something to change go through Python;
    text that looks the same gets the same form, whatever it consists of. Null stays null, and text of blanks becomes
    empty. table: other look-alikes than the fixed ones, as `confusables` reads them.
    """
    text = F.col(column) if isinstance(column, str) else column
    transducer = compiled() if table is None else Transducer(table)

    @F.pandas_udf(T.StringType())
    def formed(texts: pd.Series) -> pd.Series:
        return texts.map(transducer, na_action="ignore")

    latin = text.rlike(CONSISTENT) & ~text.rlike("[ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορΆΈΉΊΌΎΪΫό]") if table is None else F.lit(False)
    return F.when(latin, text).otherwise(formed(F.when(~latin, text)))


def look_alikes(rows: DataFrame) -> DataFrame:
    """(field, row_id_a, row_id_b) of rows (group_key, field, row_id, value) of one group whose values look alike but differ.

    Groups of one form whose values are all the same characters are dropped after a pre-aggregation and never
    expanded; only forms with two or more spellings are joined with themselves, by a hash of the form that is then verified. The forms are
    written once, so no text is brought into form twice. The result holds every pair of a group and form, so it grows
    with the square of the rows that share both: of an occurrence some dozens, never of the table. Null groups or
    values are out.
    """
    formed = written(rows.where("group_key is not null and value is not null").withColumn("form", consistent("value")).withColumn("h", F.xxhash64("group_key", "field", "form")), "forms")
    mixed = formed.groupBy("h").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select("h")
    kept = formed.join(mixed, "h", "left_semi")
    a, b = (kept.select("h", *[F.col(c).alias(f"{c}_{side}") for c in ("group_key", "field", "form", "row_id", "value")]) for side in "ab")
    same = (F.col("group_key_a") == F.col("group_key_b")) & (F.col("field_a") == F.col("field_b")) & (F.col("form_a") == F.col("form_b"))
    return a.join(b, "h").where(same & (F.col("row_id_a") < F.col("row_id_b")) & (F.col("value_a") != F.col("value_b"))).select(F.col("field_a").alias("field"), "row_id_a", "row_id_b")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "place_conflict_context").select("rowId", "occurrenceId", "placeName", "contextText").dropDuplicates(["rowId"])
    return once.select(F.col("occurrenceId").alias("group_key"), F.col("rowId").alias("row_id"), F.expr("stack(2, 'placeName', placeName, 'contextText', contextText) as (field, value)"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alikes(_rows(spark, sf_dir))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-null placeName and contextText in its consistent form."""
    return _rows(spark, sf_dir).where("value is not null").select("row_id", "field", consistent("value").alias("form"))


_WIDE, _NARROW = ("".join(chr(c - d) for c in range(0xFF01, 0xFF5F)).replace("'", "''") for d in (0, 0xFEE0))
_FORM_SQL = (
    "trim(regexp_replace(nfc_normalize(translate(nfc_normalize(regexp_replace({0}, '[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]', '', 'g')), '"
    + _WIDE + LOOKALIKE + "', '" + _NARROW + LOOKS_LIKE + "')), '[\\s\u00a0\u2000-\u200a\u202f\u205f\u3000]+', ' ', 'g'))"
)
for _a, _b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("Ά", "Á"), ("Έ", "É"), ("Ί", "Í"), ("Ό", "Ó"), ("Ύ", "Ý"), ("ό", "ó")):
    _FORM_SQL = f"replace({_FORM_SQL}, '{_a}', '{_b}')"
FOUND_SQL = f"""
WITH once AS (SELECT DISTINCT rowId, occurrenceId, placeName, contextText FROM place_conflict_context WHERE occurrenceId IS NOT NULL),
v AS (SELECT 'placeName' AS field, rowId, occurrenceId, placeName AS value FROM once WHERE placeName IS NOT NULL
      UNION ALL SELECT 'contextText', rowId, occurrenceId, contextText FROM once WHERE contextText IS NOT NULL),
f AS (SELECT *, {_FORM_SQL.replace('{0}', 'value')} AS form FROM v)
SELECT a.field, a.rowId AS row_id_a, b.rowId AS row_id_b FROM f a JOIN f b ON a.field = b.field AND a.occurrenceId = b.occurrenceId AND a.form = b.form AND a.rowId < b.rowId AND a.value <> b.value
"""
_WORD_SQL = """CASE WHEN regexp_matches(w, '[Ͱ-Ͽἀ-῿]') AND NOT regexp_matches(w, '[CDFGJLQRSUVWabdefghiklmnqrstuwxyz]')
  THEN translate(w, 'ABEZHIKMNOPTYXvopcjÁÉÍÓÝó', 'ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορϲϳΆΈΊΌΎό') ELSE w END"""
NORMALIZED_SQL = f"""
WITH once AS (SELECT DISTINCT rowId, placeName, contextText FROM place_conflict_context),
v AS (SELECT 'placeName' AS field, rowId AS row_id, placeName AS value FROM once WHERE placeName IS NOT NULL UNION ALL SELECT 'contextText', rowId, contextText FROM once WHERE contextText IS NOT NULL),
f AS (SELECT row_id, field, {_FORM_SQL.replace('{0}', 'value')} AS form FROM v)
SELECT row_id, field, array_to_string(list_transform(string_split(form, ' '), lambda w: {_WORD_SQL}), ' ') AS form FROM f
"""
