"""Text normalisers as column expressions. They differ on purpose; each keeps its own steps under its own name."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words without weight of their own in administrative titles.
TITLE_STOPWORDS = [
    "dux", "comes", "comitis", "vicarius", "praeses", "praesidis", "consularis", "corrector", "proconsul", "magister", "praefectus", "praefecti", "praepositus", "vir",
    "viri", "viro", "spectabilis", "spectabili", "illustris", "clarissimus", "clarissimi", "perfectissimus", "sub", "dispositione", "iurisdictione", "per", "in",
    "intra", "provincia", "provinciae", "item", "et", "cum", "rei", "militaris", "officium", "habet", "idem", "autem", "hoc", "modo",
]
PROVINCE_STOPWORDS = [
    "et", "in", "provincia", "provinciae", "pars", "prima", "primae", "secunda", "secundae", "superior", "superioris", "inferior", "inferioris",
]
STEM_STOPWORDS = [
    "insignia", "viri", "vir", "illustris", "spectabilis", "clarissimi", "perfectissimi", "sub", "dispositione", "iurisdictione", "per", "in", "de", "ex", "et", "sunt",
    "autem", "officium", "suprascripti", "suprascriptae", "habet", "habent", "ad", "item", "dioceses", "dioceseos", "provinciae", "provincia", "infrascriptae",
    "infrascriptas", "rerum",
]
# Words with a stem of their own.
STEMS = {
    "praefectus": "praefect", "praefecti": "praefect", "praefecto": "praefect", "praefectum": "praefect", "magistri": "magistr", "magister": "magistr",
    "magistrum": "magistr", "magisteriae": "magistr", "comes": "com", "comitis": "com", "comite": "com", "comitem": "com", "quaestor": "quaest", "quaestoris": "quaest",
    "proconsul": "procons", "proconsulis": "procons", "vicarius": "vicar", "vicarii": "vicar", "vicario": "vicar", "dux": "duc", "ducis": "duc",
    "primicerius": "primicer", "primicerii": "primicer", "praepositus": "praeposit", "praepositi": "praeposit", "consularis": "consular", "consulares": "consular",
    "corrector": "correct", "correctores": "correct", "praeses": "praesid", "praesidis": "praesid", "praesides": "praesid", "praesenti": "praesent",
    "praesentalis": "praesent", "praesentalem": "praesent", "praesentales": "praesent", "praesentali": "praesent", "praesentis": "praesent", "mauretaniae": "mauritan",
    "mauretania": "mauritan", "mauritaniae": "mauritan", "mauritania": "mauritan",
}
STEM_ENDINGS = [
    "arum", "orum", "ibus", "ium", "iae", "iam", "ias", "ae", "am", "as", "is", "um", "us", "i", "o", "a", "e",
]
ADMIN_PREFIX = r"(?i)^(?:provinciae?|in\s+provincia)\s+"
EDGE = r"[ .,;:()\[\]-]"


def _replace(column: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, column)


def _blank(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def squeeze(column: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def strip_accents(column: Column) -> Column:
    """Without combining accents, and compatibility forms as their plain letters, on the JVM; joined letters such as æ stay."""
    return F.reflect(F.lit("org.apache.commons.lang3.StringUtils"), F.lit("stripAccents"), column)


@F.pandas_udf(T.StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), na_action="ignore")


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def compatible(column: Column, exact: bool = True) -> Column:
    """NFKD without combining characters. exact: also compatibility forms, through an Arrow UDF that only sees text beyond ASCII."""
    if not exact:
        return strip_accents(column)
    plain = column.rlike(r"^\p{ASCII}*$")
    return F.when(plain, column).otherwise(_decomposed(F.when(~plain, column)))


def _edges(column: Column) -> Column:
    return F.regexp_replace(column, f"^{EDGE}+|{EDGE}+$", "")


def clean_name(column: Column, exact: bool = False) -> Column:
    """A name without accents, with æ as ae, single blanks and no marks at the ends."""
    return _edges(squeeze(_replace(compatible(_blank(column), exact), ("æ", "ae"), ("Æ", "Ae"))))


def clean_name_local(column: Column, exact: bool = False) -> Column:
    """clean_name that also drops a leading bracket and leading dots first. Not for numbers: it takes the minus sign."""
    text = _replace(compatible(_blank(column), exact), ("æ", "ae"), ("Æ", "Ae"))
    return _edges(squeeze(F.regexp_replace(F.regexp_replace(text, r"^\(.*?\)\s*", ""), r"^\.+\s*", "")))


def _words(column: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", " "))


def norm_name(column: Column) -> Column:
    """Lower-case ASCII words of a cleaned name."""
    return _words(clean_name(column))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def latin_key(column: Column) -> Column:
    """A spelling-blind key: j v y as i u i, ph th ch as f t c, ae oe as e, no blanks."""
    return spelling_key(norm_name(column))


def spelling_key(words: Column) -> Column:
    """latin_key of words that are in norm_name's form already."""
    return _replace(words, ("j", "i"), ("v", "u"), ("y", "i"), ("ph", "f"), ("th", "t"), ("ch", "c"), ("ae", "e"), ("oe", "e"), (" ", ""))


def clean_line(column: Column) -> Column:
    """A source line trimmed, without its final full stop when no , : ; occurs in it."""
    text = F.regexp_replace(_blank(column), r"^\s+|\s+$", "")
    return F.when(text.endswith(".") & ~text.rlike("[,:;]"), F.regexp_replace(text, r"\.$", "")).otherwise(text)


def folded_line(column: Column) -> Column:
    return F.regexp_replace(F.lower(clean_line(column)), r"\s+", " ")


def folded_mention(column: Column) -> Column:
    """Audit form of a mention: squeezed and lower case."""
    return F.lower(squeeze(_blank(column)))


def norm_rendering(column: Column) -> Column:
    """Rendering key: squeezed, lower case, no . , ; : at the end."""
    return F.regexp_replace(folded_mention(column), "[.,;:]+$", "")


def norm_gazetteer(column: Column, exact: bool = False) -> Column:
    """Place list key: no accents, lower case, . , ; : ( ) [ ] as blanks, blanks squeezed but not trimmed again."""
    text = F.trim(F.lower(compatible(_blank(column), exact)))
    return F.regexp_replace(F.regexp_replace(text, r"[.,;:()\[\]]", " "), r"\s+", " ")


def norm_province(column: Column, exact: bool = False) -> Column:
    """Province key: no accents, lower case, ph y v as f i u, everything but a-z 0-9 as blanks."""
    text = _replace(F.trim(F.lower(compatible(_blank(column), exact))), ("ph", "f"), ("y", "i"), ("v", "u"))
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9 ]", " "), r"\s+", " ")


def norm_probe(column: Column, exact: bool = False) -> Column:
    """Probe key: no accents, lower case, j as i, u as v, a wide set of marks as blanks."""
    text = _replace(F.trim(F.lower(compatible(_blank(column), exact))), ("j", "i"), ("u", "v"))
    return F.regexp_replace(F.regexp_replace(text, r"""[.,;:()\[\]{}'’"*/?]""", " "), r"\s+", " ")


def norm_search(column: Column) -> Column:
    """Search form: squeezed, no accents, lower case; punctuation stays."""
    return F.lower(strip_accents(squeeze(_blank(column))))


def norm_form(column: Column) -> Column:
    """Province form key: NFKC, trimmed, no . ? : ; , at the end, squeezed, lower case."""
    text = _blank(column)
    plain = text.rlike(r"^\p{ASCII}*$")
    text = F.when(plain, text).otherwise(_composed(F.when(~plain, text)))
    return F.lower(squeeze(F.regexp_replace(F.trim(text), r"[.?:;,]+$", "")))


def norm_label(column: Column) -> Column:
    """Map label key: squeezed, one final full stop dropped, lower case."""
    return F.lower(F.trim(F.regexp_replace(squeeze(_blank(column)), r"\.$", "")))


def norm_place_text(column: Column) -> Column:
    """No accents, lower case, everything but a-z 0-9 as single blanks."""
    return _words(strip_accents(_blank(column)))


def norm_jurisdiction(column: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(squeeze(_blank(column)), "[.:;]+$", "")))


def norm_place_name(column: Column) -> Column:
    return F.lower(F.trim(_blank(column)))


def norm_display(column: Column) -> Column:
    """Squeezed and lower case, accents kept."""
    return F.lower(squeeze(_blank(column)))


def document_key(column: Column) -> Column:
    """One spelling for the two parts of a document: any with 'occident' or equal to occidens, any with 'orient' or equal to oriens."""
    text = F.regexp_replace(F.lower(F.trim(_blank(column))), "[_-]", " ")
    return F.when(text.contains("occident") | (text == "occidens"), "occidentis").when(text.contains("orient") | (text == "oriens"), "orientis").otherwise(squeeze(text))


def clean_report(column: Column) -> Column:
    return squeeze(F.regexp_replace(F.trim(_blank(column)), "[.:]+$", ""))


def stem(token: Column) -> Column:
    """The stem of a lower-case word: from the table, else without the first listed ending that leaves four letters."""
    result = F.when(token.isin(list(STEMS)), F.create_map(*[F.lit(x) for pair in STEMS.items() for x in pair])[token])
    for ending in STEM_ENDINGS:
        result = result.when(token.endswith(ending) & (F.length(token) >= len(ending) + 4), F.left(token, F.length(token) - len(ending)))
    return result.otherwise(token)


def stem_key(column: Column) -> Column:
    """The stems of a title's words as an array, without stop words."""
    text = F.regexp_replace(F.lower(squeeze(_blank(column))), r"\bin\s+praesenti\b", "praesentalis")
    words = F.filter(F.split(F.regexp_replace(text, "[^a-z]+", " "), " "), lambda w: (w != "") & ~w.isin(STEM_STOPWORDS))
    return F.transform(words, stem)


def key_contains(target: Column, source: Column) -> Column:
    """Whether every stem of source is among those of target."""
    return F.size(F.array_except(source, target)) == 0


def search_stem(column: Column) -> Column:
    """The first six letters of a place text without blanks."""
    return F.left(F.replace(norm_place_text(column), F.lit(" "), F.lit("")), F.lit(6))


def strip_editorial(column: Column) -> Column:
    """Without notes in square brackets."""
    return squeeze(F.regexp_replace(_blank(column), r"\[[^\]]*\]", ""))


def meaningful_tokens(column: Column) -> Column:
    """Words of three letters or more that are no title words."""
    return F.filter(F.split(norm_name(column), " "), lambda w: (F.length(w) >= 3) & ~w.isin(TITLE_STOPWORDS))


def province_tokens(column: Column) -> Column:
    return F.filter(F.split(norm_name(column), " "), lambda w: (F.length(w) > 2) & ~w.isin(PROVINCE_STOPWORDS))


def html_escaped(column: Column) -> Column:
    return _replace(_blank(column), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def unquoted(column: Column) -> Column:
    """A description without the quotes around it and with doubled quotes as one."""
    text = F.trim(_blank(column))
    inner = F.when(text.rlike('^".*"$') & (F.length(text) >= 2), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    return F.replace(inner, F.lit('""'), F.lit('"'))


def highlighted(column: Column, terms: list[str]) -> Column:
    """The text with <mark> around every occurrence of a term, longest terms first, whatever the case."""
    quoted = ["\\Q" + t.replace("\\E", "") + "\\E" for t in sorted({t for t in terms if t}, key=lambda t: (-len(t), t))]
    return F.regexp_replace(_blank(column), f"(?iu)({'|'.join(quoted)})", "<mark>$1</mark>") if quoted else _blank(column)


def without_prefix(unit: Column, place: Column) -> Column:
    """unit without the place it begins with, whatever the case, and the blanks and commas after it."""
    unit, place = F.regexp_replace(squeeze(unit), r"\.+$", ""), F.regexp_replace(squeeze(_blank(place)), r"\.+$", "")
    rest = F.substring(unit, F.length(place) + 1, F.length(unit))
    begins = (place != "") & F.lower(unit).startswith(F.lower(place)) & ~rest.rlike(r"^\w")
    return F.when(begins, squeeze(F.regexp_replace(rest, r"^[\s,]+", ""))).otherwise(unit)


def latin_list(column: Column) -> Column:
    """The parts of a Latin enumeration, set apart by commas or 'et'."""
    text = F.regexp_replace(squeeze(_blank(column)), r"\.+$", "")
    return F.filter(F.transform(F.split(text, r"(?i)\s*,\s*|\s+et\s+"), squeeze), lambda p: p != "")


def strip_admin_prefix(column: Column) -> Column:
    return clean_line(F.regexp_replace(clean_line(column), ADMIN_PREFIX, ""))


def place_phrase(column: Column) -> Column:
    """The places of a phrase joined by 'et', without a leading urbis or civitatis."""
    text = F.regexp_replace(clean_line(column), r"(?i)^(?:urbis|civitatis)\s+", "")
    return F.filter(F.transform(F.split(text, r"(?i)\s+et\s+"), clean_line), lambda p: p != "")


# Heads of blocks that stand for the whole, and how many words of other plural heads do.
BLOCK_HEADS = ("Sub dispositione", "Officium", "Per ", "In provincia", "Intra ", "In ", "Item ", "Sub cura", "Sub iurisdictione", "Extenditur")
BLOCK_WORDS = {
    "Magistri": 2, "Comites": 3, "Legiones": 2, "Vexillationes": 2, "Procuratores": 2, "Praepositi": 2, "Vicarii": 1, "Duces": 1, "Consulares": 1, "Correctores": 1,
    "Praesides": 1, "Auxilia": 1, "Pseudocomitatenses": 1, "Rationales": 1, "Limitanei": 1, "Provinciae": 1, "Fabricae": 1,
}
NUMERALS = [
    "unus", "una", "unum", "duo", "duae", "tres", "quattuor", "quinque", "sex", "septem", "octo", "nouem", "novem", "decem", "undecim", "duodecim", "tredecim",
    "quattuordecim", "quindecim", "sedecim", "septendecim", "uiginti", "triginta", "quadraginta", "quinquaginta", "sexaginta", "LXV", "XXXII", "XVIII", "XVII", "XII",
    "VII", "VI", "V",
]


def block_type(column: Column) -> Column:
    """The type of a heading: its fixed head, else its text without numerals, cut to the first words of a plural head."""
    text = F.trim(_blank(column))
    heads = reduce(lambda c, h: c.when(text.startswith(h), h.strip()), BLOCK_HEADS[1:], F.when(text.startswith(BLOCK_HEADS[0]), BLOCK_HEADS[0]))
    plain = squeeze(F.regexp_replace(text, rf"(?i)\b({'|'.join(NUMERALS)})\b", ""))
    words = F.split(plain, " ")
    cut = F.create_map(*[F.lit(x) for pair in BLOCK_WORDS.items() for x in pair])[words[0]]
    return heads.otherwise(F.when((F.size(words) >= 2) & cut.isNotNull(), F.array_join(F.slice(words, F.lit(1), F.coalesce(cut, F.lit(1))), " ")).otherwise(plain))
