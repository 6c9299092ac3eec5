"""From mentions to published tables: occurrences, gazetteer, confirmed places, and the provinces an office governs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.functions.rules import explicit_province
from tabulary.functions.text import clean_report, document_key, norm_form, squeeze
from tabulary.operators.extract import coordinate, first_non_empty
from tabulary.operators.relational import keep_one, missing_keys, sequential_ids

KEY = ["document", "line", "literal", "source"]


def occurrences(mentions: DataFrame, places: DataFrame) -> DataFrame:
    """Eligible mentions joined with the places of the tree on document, line, literal form and source, with their provinces and context.

    mentions: KEY and eligible. places: KEY and order columns chapter, office, unit, direct, hard, soft, region, titles
    (array, outermost first). The expected province is the one written in the name, else beside it, else inherited
    (hard before soft); context is the titles joined by ' / '. Ids are dense in the order of document, line, literal.
    """
    wanted = mentions.where("eligible and literal <> ''").select(*KEY).distinct()
    named = places.join(wanted, KEY, "left_semi").withColumn("explicit", explicit_province(F.col("literal")))
    made = named.withColumns({"expected": first_non_empty(*[F.col(c) for c in ("explicit", "direct", "hard", "soft")]), "context": F.array_join(F.filter("titles", lambda t: t != ""), " / ")})
    return sequential_ids(made, "OCC%06d", "occurrence_id", F.asc("document"), F.asc("line"), F.asc("literal"), F.asc("source"))


def unplaced(mentions: DataFrame, places: DataFrame) -> DataFrame:
    """Eligible mentions the tree does not have; empty when the two agree."""
    return missing_keys(mentions.where("eligible and literal <> ''"), places, KEY)


def source_nodes(nodes: DataFrame, preferred: Sequence[str] = ("item", "entry", "unknown")) -> DataFrame:
    """(document_key, line, node_id): per line the last node of a preferred type in `ord`, else the first node."""
    known = nodes.where("node_id <> '' and line is not null").withColumn("document_key", document_key(F.col("document"))).withColumn("_p", F.lower("node_type").isin(list(preferred)))
    rank = F.when(F.col("_p"), -F.col("ord")).otherwise(F.col("ord"))
    return keep_one(known, ["document_key", "line"], F.desc("_p"), rank.asc()).select("document_key", "line", "node_id")


def gazetteer(matches: DataFrame, places: DataFrame) -> DataFrame:
    """One row per place name and place of the matches, with what the places add, numbered GAZ00001... by name and place.

    matches (ord, place_name, place_id, latitude, longitude, feature_type, match_type), places (place_id, title,
    latitude, longitude, feature_type, description, uri). A match's own value goes before the place's.
    """
    first = keep_one(matches.where("place_id is not null"), ["place_name", "place_id"], F.asc("ord"))
    own = places.select("place_id", "title", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), F.col("feature_type").alias("_type"), "description", "uri")
    joined = first.join(own, "place_id", "left").select(
        squeeze(F.col("place_name")).alias("place_name"), "place_id", first_non_empty(F.col("title")).alias("title"), F.coalesce("latitude", "_lat").alias("latitude"), F.coalesce("longitude", "_lon").alias("longitude"), first_non_empty(F.col("feature_type"), F.col("_type")).alias("feature_type"),
        first_non_empty(F.col("description")).alias("description"), first_non_empty(F.col("uri")).alias("uri"), F.when(F.coalesce("match_type", F.lit("")) == "", "provisional").otherwise("confirmed").alias("confidence"),
    )
    return sequential_ids(joined, "GAZ%05d", "gazetteer_id", F.lower("place_name").asc(), F.asc("place_name"), F.asc("place_id"), F.asc("latitude"))


def confirmed(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first match of each occurrence that has both coordinates, with its source node; matches (ord, occurrence_id, document, line, latitude, longitude, place_id)."""
    first = keep_one(matches, ["occurrence_id"], F.asc("ord"))
    located = first.withColumns({"latitude": coordinate(F.col("latitude")), "longitude": coordinate(F.col("longitude"))}).where("latitude is not null and longitude is not null")
    keyed = located.withColumn("document_key", document_key(F.col("document")))
    return keyed.join(source_nodes(nodes), ["document_key", "line"], "left").drop("document_key").fillna("", ["node_id"])


def province_status(references: DataFrame, matches: DataFrame) -> DataFrame:
    """references (id, name) with the last match (ord, name, polygon) of the same name, whatever the case; UNMATCHED when there is none."""
    last = keep_one(matches.withColumn("_k", F.lower(clean_report(F.col("name")))), ["_k"], F.desc("ord")).select("_k", "polygon")
    joined = references.join(last, F.lower(clean_report(F.col("name"))) == F.col("_k"), "left")
    return joined.select("id", F.coalesce("polygon", F.lit("")).alias("polygon"), F.when(F.col("polygon").isNull(), "UNMATCHED").otherwise("MATCH").alias("status"))


def governed(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, label, provinces, note): the first rule (priority, pattern, label, provinces, note) whose pattern the entry's text contains.

    Rules are a table of at most 1,000 rows, checked, compiled into one CASE; entries without a rule are left out.
    """
    table = rules.orderBy("priority", "pattern").limit(1001).collect()
    if len(table) > 1000:
        raise ValueError("more than 1,000 rules")
    text, chosen = norm_form(F.col("text")), F.lit(None).cast("int")
    for r in reversed(table):
        chosen = F.when(text.contains(r["pattern"]), r["priority"]).otherwise(chosen)
    return entries.withColumn("priority", chosen).join(rules, "priority").select("id", "label", "provinces", "note")


def region_of(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """entries (id, chapter, text) with the region of an alias (chapter, alias, region) they carry."""
    keyed = aliases.select("chapter", norm_form(F.col("alias")).alias("_a"), "region").distinct()
    return entries.withColumn("_a", norm_form(F.col("text"))).join(keyed, ["chapter", "_a"]).select("id", "region")


def region_provinces(regions: DataFrame, polygons: DataFrame) -> DataFrame:
    """(region, provinces, mapped, unresolved): the provinces of each region (region, province), and how many of them have a polygon (province)."""
    have = polygons.select(norm_form(F.col("province")).alias("_k")).distinct().withColumn("_there", F.lit(True))
    joined = regions.distinct().withColumn("_k", norm_form(F.col("province"))).join(have, "_k", "left")
    return joined.groupBy("region").agg(F.array_sort(F.collect_set("province")).alias("provinces"), F.count_if(F.col("_there")).alias("mapped"), F.count_if(F.col("_there").isNull()).alias("unresolved"))
