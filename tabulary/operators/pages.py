"""What is shown of an entity, a line or a container, and where a selection leads, as plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.functions.text import squeeze
from tabulary.operators.relational import most_shared, positions


def entity_page(mentions: DataFrame, place: str = "place_id") -> DataFrame:
    """(place, position, line, id, label): all mentions of a place in order of line, each with its office and unit; mentions (id, line, office, unit, place)."""
    label = squeeze(F.concat_ws(" ", "office", "unit"))
    rows = mentions.where(F.col(place).isNotNull()).select(place, "line", "id", label.alias("label"))
    return positions(rows, [place], F.asc_nulls_first("line"), F.asc("id"))


def line_page(lines: DataFrame, parts: Sequence[str], context: Sequence[str]) -> DataFrame:
    """lines with `body`, the non-empty parts joined by ' / ', and `path`, the non-empty context joined by ' > '."""
    joined = lambda cols, sep: F.concat_ws(sep, *[F.nullif(squeeze(F.col(c)), F.lit("")) for c in cols])
    return lines.withColumn("body", joined(parts, " / ")).withColumn("path", joined(context, " > "))


def container_page(children: DataFrame, parent: str, text: str, *order: str) -> DataFrame:
    """(parent, position, text): the texts of all children in order, a row each."""
    return positions(children.select(parent, text, *order), [parent], *[F.asc(c) for c in (*order, text)]).select(parent, "position", text)


def mapped_places(hits: DataFrame, places: DataFrame) -> DataFrame:
    """(mapped, missing): how many distinct places of the hits (place_id) have coordinates in places (place_id, lat, lon), and how many have none."""
    distinct = hits.where("place_id is not null").select("place_id").distinct().join(places, "place_id", "left").groupBy("place_id").agg(F.bool_or(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("there"))
    return distinct.agg(F.count_if("there").alias("mapped"), F.count_if(~F.col("there")).alias("missing"))


def stations(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per chapter: mentions identified, ambiguous, unresolved and without coordinates; mentions (id, chapter), resolved (id, status, has_coordinates)."""
    joined = mentions.join(resolved, "id", "left").withColumn("status", F.coalesce("status", F.lit("UNRESOLVED")))
    known = F.col("status").isin("ID", "UNIQUE")
    has = F.coalesce("has_coordinates", F.lit(False))
    return joined.groupBy("chapter").agg(F.count_if(known & has).alias("identified"), F.count_if(F.col("status") == "AMBIGUOUS").alias("ambiguous"), F.count_if(F.col("status") == "UNRESOLVED").alias("unresolved"), F.count_if(known & ~has).alias("no_coordinates"))


def destination(jurisdiction: Column, region: Column, province: Column, places: Column) -> Column:
    """Where a selection leads: its jurisdiction, else region, else province, else its places, else nothing."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(given(jurisdiction), F.concat(F.lit("jurisdiction:"), jurisdiction)).when(given(region), F.concat(F.lit("region:"), region)).when(given(province), F.concat(F.lit("province:"), province)).when(places > 1, F.lit("places")).when(places == 1, F.lit("place")).otherwise("clear")


def by_any_column(df: DataFrame, columns: Sequence[str], value: Column) -> DataFrame:
    """Rows with the value in any of the columns."""
    return df.where(F.array_contains(F.array_compact(F.array(*[F.col(c) for c in columns])), value))


def keep_all_if_empty(df: DataFrame, key: str, wanted: Column) -> DataFrame:
    """Per key the rows that fit, or all its rows when none does. The test is pre-aggregated per key."""
    any_fit = df.groupBy(key).agg(F.bool_or(F.coalesce(wanted, F.lit(False))).alias("_any"))
    return df.join(any_fit, key).where(F.coalesce(wanted, F.lit(False)) | ~F.col("_any")).drop("_any")


def selected_mentions(clicks: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, shown, selected): for each clicked place (id, name, qualifier, line) how many mentions (mention_id, name, qualifier, line) are shown, and the one that is selected.

    Shown are the mentions of the name with the click's qualifier, or all of them when none has it. Selected is the
    first of them on the click's line, else the only one there is. Mentions are counted by name, qualifier and line
    beforehand, so a click meets one row each, however often its name occurs. A null qualifier or line is none.
    """
    clean = lambda c: F.lower(squeeze(F.coalesce(F.col(c), F.lit(""))))
    m = mentions.select("mention_id", clean("name").alias("k"), clean("qualifier").alias("q"), F.col("line").alias("l")).where("k <> ''")
    count = [F.count("*").alias("n"), F.min("mention_id").alias("one")]
    counts = lambda *by: m.groupBy(*by).agg(*count)
    c = clicks.select("id", clean("name").alias("k"), clean("qualifier").alias("q"), F.col("line").alias("l"))
    for keys, tag in ((["k", "q"], "same"), (["k"], "all"), (["k", "q", "l"], "same_line"), (["k", "l"], "all_line")):
        c = c.join(counts(*keys).withColumnsRenamed({"n": f"{tag}_n", "one": f"{tag}_one"}), keys, "left")
    same = F.coalesce(F.col("same_n") > 0, F.lit(False)) & (F.col("q") != "")
    shown = F.when(same, F.col("same_n")).otherwise(F.coalesce("all_n", F.lit(0)))
    on_line, only = F.when(same, F.col("same_line_one")).otherwise(F.col("all_line_one")), F.when(same, F.col("same_one")).otherwise(F.col("all_one"))
    return c.select("id", shown.alias("shown"), F.coalesce(on_line, F.when(shown == 1, only)).alias("selected"))


EVIDENCE = {"document": 4, "chapter": 4, "unit": 3, "office": 2}


def picked_occurrences(places: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(id, occurrence_id, score): the occurrence (occurrence_id, ord, name, document, chapter, unit, office) that fits each place (id, names array, document, ..) best, by EVIDENCE; the first on a tie.

    A blank piece of evidence counts nothing. Places whose names occur nowhere are left out. No place is paired with the
    occurrences of its names, see most_shared.
    """
    clean = lambda c: F.lower(F.regexp_replace(squeeze(c), r"^\p{Zs}+|\p{Zs}+$", ""))
    filled = lambda c, to: F.nullif(clean(F.col(c)), F.lit("")).alias(to)
    keys = [filled(k, k) for k in EVIDENCE]
    wanted = places.select("id", F.explode(F.array_distinct(F.transform("names", clean))).alias("key"), *keys).where("key <> ''")
    there = occurrences.select(filled("name", "key"), *keys, F.lit(0).alias("worth"), "ord", F.col("occurrence_id").alias("offer"))
    return most_shared(wanted, there, EVIDENCE).select("id", F.col("offer").alias("occurrence_id"), "score")
