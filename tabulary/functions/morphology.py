"""Latin case and place-name variants: rule tables, applied as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulary.functions.text import clean_name, let, norm_gazetteer, norm_name, norm_probe, norm_province, spelling_key

# Fixed values. Each rule: ending, least length of the word, letters cut off, what is added instead.
Rule = tuple[str, int, int, str]
WORD_FORMS: list[Rule] = [
    ("iae", 5, 3, "ia"), ("ae", 4, 1, ""), ("iarum", 7, 3, ""), ("arum", 6, 3, ""), ("am", 4, 1, ""), ("as", 4, 1, ""), ("is", 5, 2, "e"), ("is", 5, 2, ""), ("o", 4, 1, "um"), ("o", 4, 1, "us"), ("i", 4, 1, "us"), ("i", 4, 1, "um"),
]
CASE_FORMS: list[Rule] = [
    ("iae", 5, 3, "ia"), ("ae", 4, 1, ""), ("am", 4, 1, ""), ("as", 4, 2, "ae"), ("as", 4, 1, ""), ("io", 4, 2, "ium"), ("o", 4, 1, "um"), ("o", 4, 1, "us"), ("o", 4, 1, "os"), ("i", 4, 1, "us"), ("i", 4, 1, "um"),
    ("i", 4, 0, "s"), ("i", 4, 0, "o"), ("em", 5, 2, "is"), ("em", 5, 2, "es"), ("e", 5, 1, "is"), ("is", 5, 2, "ae"), ("is", 5, 2, "es"),
]
GAZETTEER_FORMS: list[Rule] = [("ae", 0, 2, "a"), ("iae", 0, 3, "ia"), ("ii", 0, 2, "ium"), ("orum", 0, 4, "i"), ("arum", 0, 4, "a"), ("ensis", 0, 5, "ensis"), ("enses", 0, 5, "ensis")]
PROVINCE_FORMS: list[Rule] = [("iae", 0, 3, "ia"), ("ae", 0, 2, "a"), ("arum", 0, 4, "a"), ("orum", 0, 4, "um"), ("ensis", 0, 5, "ensis"), ("enses", 0, 5, "ensis"), ("i", 0, 1, "us")]
PROBE_FORMS: list[Rule] = [("o", 4, 1, "um"), ("ae", 5, 2, "a"), ("ae", 5, 2, "um"), ("i", 5, 1, "um"), ("i", 5, 1, "us"), ("is", 6, 2, "um"), ("is", 6, 2, "a"), ("a", 6, 1, "um")]
TOPONYMIC: list[tuple[str, list[str]]] = [
    ("itanorum", ["a", "um", "us", "o", "is", "e", "ia"]),
    ("ianorum", ["ia", "a", "um", "us", "o", "is", "e"]),
    ("iensium", ["ia", "a", "um", "us", "o", "is", "e", "i"]),
    ("ensium", ["um", "a", "ia", "e", "is", "us", "o", "i"]),
    ("iensis", ["ia", "a", "um", "us", "o", "is", "e"]),
    ("ensis", ["um", "a", "ia", "e", "is", "us", "o", "i"]),
    ("atis", ["a", "um", "us", "e", "is", "o", "i"]),
    ("orum", ["i", "um", "a", "ia", "us", "o", "e"]),
]
FACTORY_ALIASES = {
    "sirmensis": ["Sirmium"], "acincensis": ["Aquincum"], "cornutensis": ["Carnuntum"], "salonitana": ["Salona"], "concordensis": ["Iulia Concordia"],
    "manutuana": ["Mantua"], "ticenensis": ["Ticinum"], "suessionensis": ["Augusta Suessionum"], "ambianensis": ["Samarobriva Ambianorum"],
    "irenopolitana": ["Eirenopolis/Neronias", "Neronias"], "thessalonicensis": ["Thessalonica"], "naissatensis": ["Naissus"], "ratiarensis": ["Ratiaria"],
    "horreomargensis": ["Horreum Margi"],
}
PLACE_ALIASES = {"maccomadensis": "Macomades", "girbitani": "Girba", "girbitanus": "Girba", "syracusani": "Syracusae", "tarentini": "Tarentum", "dubris": "Portus Dubris"}
QUALIFIERS = {"i": "prima", "ii": "secunda", "iii": "tertia", "iv": "quarta"}
# Phrases that hold a name, with what is made of it: form, rule, tier.
PHRASES = [
    (r"(?i)\bin\s+castello\s+(.+)$", [("{0}", "in_castello", 0)]), (r"(?i)\bin\s+castris\s+(.+)$", [("Castra {0}", "in_castris", 0), ("{0}", "in_castris_name", 1)]),
    (r"(?i)^(?:apud|ad|contra|prope|iuxta)\s+(.+)$", [("{0}", "strip_preposition", 0)]), (r"(?i)^(.+?)\s+in\s+.+$", [("{0}", "before_in", 0)]),
]
ALTERNATIVES = [r"(?i)\s+siue\s+", r"(?i)\s+sive\s+", r"\s+-\s+"]


def forms(word: Column, rules: list[Rule], lower: Column | None = None) -> Column:
    """An array of the forms of a word under the rules that fit it, in their order."""
    low = F.lower(word) if lower is None else lower
    made = [F.when(low.endswith(end) & (F.length(word) >= least), F.concat(F.left(word, F.length(word) - cut), F.lit(add))) for end, least, cut, add in rules]
    return F.array_compact(F.array(*made))


def _last_word(text: Column, rules: list[Rule]) -> Column:
    words = F.split(text, " ")
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.transform(forms(F.element_at(words, -1), rules), lambda f: F.trim(F.concat(head, F.lit(" "), f)))


def word_forms(word: Column) -> Column:
    """The distinct spelling keys of a word and its case forms; [] for a word without letters."""
    return let(norm_name(word), normal_word_forms)


def normal_word_forms(raw: Column) -> Column:
    """word_forms of a word that is in norm_name's form already."""
    return F.array_distinct(F.filter(F.transform(F.array_prepend(forms(raw, WORD_FORMS, raw), raw), spelling_key), lambda k: k != ""))


def case_variants(text: Column) -> Column:
    """The name and the case forms of its last word, in order and without repeats."""
    none = F.array().cast("array<string>")
    return let(clean_name(text), lambda c: F.when(c == "", none).otherwise(F.array_distinct(F.array_prepend(_last_word(c, CASE_FORMS), c))))


def toponymic_variants(text: Column) -> Column:
    """array<struct<value,rule>> of the places an adjective of one word may come from: the first suffix that fits and leaves more than two letters."""
    return let(clean_name(text), _toponymic)


def _toponymic(word: Column) -> Column:
    low, result = F.lower(word), None
    for suffix, endings in TOPONYMIC:
        stem = F.left(word, F.length(word) - len(suffix))
        made = F.array(F.struct(stem.alias("value"), F.lit(f"toponymic_{suffix}_stem").alias("rule")), *[F.struct(F.concat(stem, F.lit(e)).alias("value"), F.lit(f"toponymic_{suffix}").alias("rule")) for e in endings])
        fits = low.endswith(suffix) & (F.length(word) > len(suffix) + 2) & ~word.contains(" ")
        result = F.when(fits, made) if result is None else result.when(fits, made)
    kept = F.filter(result, lambda v: norm_name(v["value"]) != norm_name(word))
    return F.coalesce(kept, F.array().cast("array<struct<value:string,rule:string>>"))


def gazetteer_variants(name: Column) -> Column:
    base = norm_gazetteer(name)
    return F.array_distinct(F.array_prepend(forms(base, GAZETTEER_FORMS, base), base))


def province_variants(name: Column) -> Column:
    base = norm_province(name)
    return F.array_distinct(F.array_prepend(_last_word(F.trim(base), PROVINCE_FORMS), base))


def probe_variants(name: Column) -> Column:
    base = norm_probe(name)
    return F.array_distinct(F.array_prepend(forms(base, PROBE_FORMS, base), base))


def qualifier_variants(name: Column) -> Column:
    """The qualifier in brackets at the end of a name and, for a Roman numeral, its ordinal; [] when there is none."""
    inner = F.lower(F.trim(F.regexp_extract(name, r"\(([^()]*)\)\s*$", 1)))
    ordinal = F.create_map(*[F.lit(x) for p in QUALIFIERS.items() for x in p])[F.element_at(F.split(inner, " "), -1)]
    named = F.when(ordinal.isNotNull(), F.regexp_replace(inner, r"\S+$", "").try_cast("string"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(inner, F.concat(named, ordinal)))))


def _tiered(value: Column, rule: Column | str, tier: Column | int) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(value.alias("value"), as_column(rule).alias("rule"), as_column(tier).cast("int").alias("tier"))


def _look_up(table: dict[str, str | list[str]], key: Column) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])[key]


def _sources(name: Column, source: Column, full: bool) -> tuple[Column, Column]:
    """The forms read off a name itself, in order of trust, and whether more may be derived from them."""
    nothing = F.array().cast("array<struct<value:string,rule:string,tier:int>>")
    known = F.when(source == "factory", _look_up(FACTORY_ALIASES, norm_name(name))) if full else F.lit(None).cast("array<string>")
    read = []
    if full:
        read.append(F.array(_tiered(_look_up(PLACE_ALIASES, norm_name(name)), "toponymic_alias", 0)))
    for pattern, outputs in PHRASES:
        held = F.regexp_extract(name, pattern, 1)
        for form, rule, tier in outputs:
            before, after = form.split("{0}")
            read.append(F.when(name.rlike(pattern), F.array(_tiered(F.concat(F.lit(before), held, F.lit(after)), rule, tier))))
    for pattern in ALTERNATIVES:
        read.append(F.when(name.rlike(pattern), F.transform(F.split(name, pattern), lambda p: _tiered(p, "alias", 0))))
    own = [F.array(_tiered(name, "original", 0))]
    if full:
        own.append(F.when(source == "limes", F.array(_tiered(F.concat(F.lit("Limes "), name), "limes_title", 0))))
    rest = F.when(known.isNotNull(), F.transform(known, lambda a: _tiered(a, "factory_alias", 0))).otherwise(F.flatten(F.array(*[F.coalesce(r, nothing) for r in read])))
    return F.flatten(F.array(*[F.coalesce(o, nothing) for o in own], rest)), known.isNull()


def _derived(value: Column, case_rule: Column, place_rule: Column, tier: Column, full: bool) -> Column:
    """The case forms of a value and, in full, the places an adjective of one word may come from, a tier lower."""
    cases = F.transform(_last_word(value, CASE_FORMS), lambda c: _tiered(c, case_rule, tier))
    return F.concat(cases, F.transform(_toponymic(value), lambda p: _tiered(p["value"], F.concat(place_rule, p["rule"]), tier + 1))) if full else cases


def _first_of_key(rows: DataFrame, own: list[str]) -> DataFrame:
    """Of variants (.., at, v) with the same key the one that comes first."""
    clean = rows.withColumn("value", clean_name(F.col("v.value"))).withColumn("key", norm_name(F.col("value"))).where("key <> ''")
    first = clean.groupBy(*own, "key").agg(F.min(F.struct("at", "value", "v.rule", "v.tier", "more")).alias("f"))
    return first.select(*own, "key", "f.*")


def variant_rows(names: DataFrame, full: bool = True) -> DataFrame:
    """(place_name, place_source, ord, value, rule, tier): the forms under which a place may stand in a gazetteer, in order of trust from 0.

    names (place_name, place_source), taken distinct. full: with aliases, limes titles and places behind adjectives;
    without it only phrases, alternatives and cases. Three sets of rules, each a column expression: forms read off the
    name, forms derived from these, and the first words of all of them with what is derived from those. A factory with a known alias has that
    alone besides its own name. Of forms with one key the first stays. Names without letters have none.
    """
    own = ["place_name", "place_source"]
    read, more = _sources(F.coalesce("place_name", F.lit("")), F.coalesce("place_source", F.lit("")), full)
    base = names.select(*own).distinct().select(*own, more.alias("more"), F.posexplode(read).alias("pos", "v")).withColumn("at", F.array(F.lit(0), F.col("pos")))
    base = _first_of_key(base.select(*own, "at", "v", "more"), own)
    place_rule = F.lit("")
    forms_ = _derived(F.col("value"), F.concat("rule", F.lit("_case")), place_rule, F.col("tier"), full)
    itself = lambda df: df.select(*own, "at", F.struct("value", "rule", "tier").alias("v"), "more")
    derived = base.where("more").select(*own, "at", "more", F.posexplode(forms_).alias("pos", "v")).withColumn("at", F.concat(F.array(F.lit(1)), "at", F.array("pos")))
    two = _first_of_key(itself(base).unionByName(derived.select(*own, "at", "v", "more")), own)
    word = clean_name(F.split("value", " ")[0])
    firsts = F.concat(F.array(_tiered(word, "first_word", 1)), _derived(word, F.lit("first_word_case"), F.lit("first_word_"), F.lit(1), full))
    spread = two.where(F.col("more") & F.col("value").contains(" ")).select(*own, "at", "more", F.posexplode(firsts).alias("pos", "v")).withColumn("at", F.concat(F.array(F.lit(2)), "at", F.array("pos")))
    three = _first_of_key(itself(two).unionByName(spread.select(*own, "at", "v", "more")), own)
    return three.withColumn("ord", F.row_number().over(W.partitionBy(*own).orderBy("at")) - 1).select(*own, "ord", "value", "rule", "tier")
