"""Controlled English for workshops and treasuries: dictionaries, joins of parts, status and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.functions.text import latin_list, norm_rendering, squeeze, without_prefix
from tabulary.operators.relational import keep_one

# What workshops make.
TERMS = {
    "sagittaria": "arrow", "scutaria": "shield", "loricaria": "armour", "arcuaria": "bow", "spatharia": "sword", "hastaria": "spear", "armorum": "arms", "armamentaria": "arms", "balistaria": "ballista",
    "clibanaria": "heavy cavalry armour", "scutorum": "shields", "scordiscorum": "saddles",
}
WHOLE = {"armorum omnium": "factory for all kinds of arms", "scutorum, scordiscorum et armorum": "factory for shields, saddles and arms"}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def enumeration(parts: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    most = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), ", ")
    return F.when(F.size(parts) <= 1, F.array_join(parts, "")).otherwise(F.concat(most, F.lit(" and "), F.element_at(parts, -1)))


def factory_phrase(descriptor: Column) -> dict[str, Column]:
    """phrase and unresolved: English for what a workshop makes; parts without a translation stay and are listed."""
    key, parts = norm_rendering(descriptor), latin_list(descriptor)
    fixed = _map(WHOLE)[key]
    english = F.transform(parts, lambda p: F.coalesce(_map(TERMS)[norm_rendering(p)], p))
    missing = F.filter(parts, lambda p: _map(TERMS)[norm_rendering(p)].isNull())
    none = F.array().cast("array<string>")
    return {"phrase": F.when(key == "", "factory").otherwise(F.coalesce(fixed, F.concat(enumeration(english), F.lit(" factory")))), "unresolved": F.when((key == "") | fixed.isNotNull(), none).otherwise(missing)}


def gazetteer_choice(units: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """units (id, source_place) with the gazetteer row found by any of its three names.

    The source name before the others, then confirmed rows, then the first by ord.
    gazetteer: (ord, source_name, place_name, pleiades_name, confidence, place_id).
    """
    keys = gazetteer.select("*", F.explode(F.array_distinct(F.filter(F.array(*[norm_rendering(F.col(c)) for c in ("source_name", "place_name", "pleiades_name")]), lambda k: k != ""))).alias("_k"))
    joined = units.withColumn("_k", norm_rendering(F.col("source_place"))).join(keys, "_k")
    exact, confirmed = norm_rendering(F.col("source_name")) == F.col("_k"), norm_rendering(F.col("confidence")) == "confirmed"
    return keep_one(joined, ["id"], F.desc(F.coalesce(exact, F.lit(False))), F.desc(F.coalesce(confirmed, F.lit(False))), F.asc("ord")).drop("_k")


def preferred_name(latin: Column, place_name: Column, pleiades_name: Column) -> Column:
    """The gazetteer's other name when its place name is only the Latin one again, else the first that is there."""
    same, other = norm_rendering(place_name) == norm_rendering(latin), norm_rendering(pleiades_name) != norm_rendering(latin)
    given = lambda c: F.nullif(squeeze(c), F.lit(""))
    return F.when(given(place_name).isNotNull() & same & given(pleiades_name).isNotNull() & other, squeeze(pleiades_name)).otherwise(F.coalesce(given(place_name), given(pleiades_name), squeeze(latin)))


def factory_entries(units: DataFrame) -> DataFrame:
    """entry_key, english, status and notes of workshops.

    units: (document, line, unit, source_place, place_name, pleiades_name, province). Status is review when a part
    has no translation, inferred_from_context when the place is known by its province only, else ok.
    """
    phrase = factory_phrase(without_prefix(F.col("unit"), F.col("source_place")))
    name = preferred_name(F.col("source_place"), F.col("place_name"), F.col("pleiades_name"))
    unknown = F.coalesce(F.nullif("place_name", F.lit("")), F.nullif("pleiades_name", F.lit(""))).isNull()
    notes = F.array_compact(F.array(F.when(F.size(phrase["unresolved"]) > 0, F.concat(F.lit("untranslated: "), F.array_join(phrase["unresolved"], ", "))), F.when(unknown, F.lit("place not in gazetteer"))))
    english = F.concat(F.upper(F.left(phrase["phrase"], F.lit(1))), F.substr(phrase["phrase"], F.lit(2)), F.when(name != "", F.concat(F.lit(" at "), name)).otherwise(""))
    status = F.when(F.size(phrase["unresolved"]) > 0, "review").when(unknown & (F.coalesce("province", F.lit("")) != ""), "inferred_from_context").otherwise("ok")
    return units.select(F.concat_ws(":", "document", "line").alias("entry_key"), "document", "line", english.alias("english"), status.alias("status"), notes.alias("notes"))


def treasury_entries(units: DataFrame, overrides: DataFrame) -> DataFrame:
    """The same for treasuries (document, line, office, place, province): 'Office of the treasury at place in province', an override (place, english_place) first."""
    place = F.coalesce("english_place", "place")
    english = F.concat(F.col("office"), F.lit(" of the treasury"), F.when(place != "", F.concat(F.lit(" at "), place)).otherwise(""), F.when(F.coalesce("province", F.lit("")) != "", F.concat(F.lit(" in "), F.col("province"))).otherwise(""))
    notes = F.array_compact(F.array(F.when(F.col("english_place").isNotNull(), "place by override")))
    return units.join(overrides, "place", "left").select(F.concat_ws(":", "document", "line").alias("entry_key"), "document", "line", english.alias("english"), F.lit("ok").alias("status"), notes.alias("notes"))


def upsert(*entries: DataFrame) -> DataFrame:
    """One entry per key; a later table wins over an earlier."""
    merged = None
    for rank, table in enumerate(entries):
        own = table.withColumn("_r", F.lit(rank))
        merged = own if merged is None else merged.unionByName(own)
    return keep_one(merged, ["entry_key"], F.desc("_r"), F.desc("line")).drop("_r")
