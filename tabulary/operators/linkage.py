"""Fuzzy joins of names against a gazetteer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulary.functions.morphology import probe_variants, province_variants
from tabulary.functions.similarity import MAX_EDITS, MIN_SIMILARITY, sequence_ratio
from tabulary.functions.text import norm_probe, norm_province
from tabulary.operators.relational import keep_one


def blocked_fuzzy_join(left: DataFrame, right: DataFrame, edits: int = MAX_EDITS, least: float = MIN_SIMILARITY) -> DataFrame:
    """left (id, form) and right (place_id, name_key) with the same first letter, at most `edits` apart and `least` alike.

    Distinct forms and keys only meet by equality on (first letter, length), each key offered under the lengths that
    are `edits` around its own; the distance is tested within the join with its threshold. Empty forms match nothing.
    """
    forms = left.select("form").where("form <> ''").distinct()
    keys = right.select("name_key").where("name_key <> ''").distinct().select("name_key", F.explode(F.sequence(F.length("name_key") - edits, F.length("name_key") + edits)).alias("n"))
    pairs = forms.join(keys, (F.left("form", F.lit(1)) == F.left("name_key", F.lit(1))) & (F.length("form") == F.col("n")) & (F.levenshtein("form", "name_key", edits) >= 0))
    pairs = pairs.withColumn("similarity", 1.0 - F.levenshtein("form", "name_key", edits) / F.greatest(F.length("form"), F.length("name_key"))).where(F.col("similarity") >= least).drop("n")
    return left.join(pairs, "form").join(right, "name_key")


#: Letters from rare to frequent in Latin names. Any order is right; this one makes the shared letters rare ones.
RARE_FIRST = "wkjzyxqhfgvbdpclmostnruaie "
IN_ORDER = "!#$%&'()*+,-./:;<=>?@ABCDEF"


def _tokens(text: Column) -> Column:
    """The letters of a text, each numbered among its equals, the rarest letters first."""
    letters = F.filter(F.split(F.translate(text, RARE_FIRST, IN_ORDER), ""), lambda c: c != "")
    return F.array_sort(F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, F.lit(1), i), lambda d: d == c)).cast("string"))))


def meet_by_letters(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """(a, b) of all texts (a) and (b) whose likeness 2 M / (m + n) can reach the cutoff: those with letters enough in common.

    M, the letters matched in order, is at most the letters in common, so t = cutoff (m + n) / 2 of them must be.
    With the letters of both in one order, two texts that share t of them share g among the first m - t + g and
    n - t + g, so texts meet by equality on (m, n, g of these letters), two at once where t allows: no pair is lost, and no
    frequent letter alone brings texts together. Pairs are then counted out in full. Distinct, non-empty texts only.
    """
    def keys(df: DataFrame, own: str, other: str, flip: bool) -> DataFrame:
        size = F.length(own)
        lengths = F.sequence(F.ceil(size * cutoff / (2 - cutoff) - 1e-9).cast("int"), F.floor(size * (2 - cutoff) / cutoff + 1e-9).cast("int"))
        spread = df.select(own, _tokens(F.col(own)).alias("_t"), F.explode(lengths).alias("_n"))
        need = F.ceil((size + F.col("_n")) * cutoff / 2 - 1e-9).cast("int")
        first = F.slice(F.col("_t"), F.lit(1), F.greatest(size - F.col("_need") + F.least(F.col("_need"), F.lit(2)), F.lit(0)))
        spread = spread.withColumn("_need", need).withColumn("_first", first)
        pairs = F.flatten(F.transform("_first", lambda x, i: F.transform(F.slice("_first", i + 2, F.size("_first")), lambda y: F.concat(x, F.lit("|"), y))))
        m, n = (F.col("_n"), size) if flip else (size, F.col("_n"))
        return spread.select(own, F.col("_t").alias(f"_t{own}"), m.cast("int").alias("_m"), n.cast("int").alias("_k"), F.explode(F.when(F.col("_need") < 2, F.col("_first")).otherwise(pairs)).alias("_key"))

    met = keys(left, "a", "b", False).join(keys(right, "b", "a", True), ["_m", "_k", "_key"]).groupBy("a", "b").agg(F.first("_ta").alias("_ta"), F.first("_tb").alias("_tb"))
    return met.where(2 * F.size(F.array_intersect("_ta", "_tb")) >= cutoff * (F.length("a") + F.length("b")) - 1e-9).select("a", "b")


def province_candidates(provinces: DataFrame, names: DataFrame, cutoff: float = 0.70, top: int = 5) -> DataFrame:
    """The top places per province by the best likeness of any variant to any name: (province, rank, score, method, place_id, matched_name).

    provinces (province), names (place_id, name). Equal keys score 1 as NORMALIZED; other pairs are SIMILAR. Distinct
    variants and keys meet by the letters they must share (see meet_by_letters), which loses no pair that reaches the
    cutoff; the ratio is then taken once per pair. Equal scores go by place_id and name.
    """
    variants = provinces.select("province", F.explode(province_variants(F.col("province"))).alias("variant")).where("variant <> ''").distinct()
    keyed = names.select("place_id", "name", norm_province(F.col("name")).alias("key")).where("key <> ''")
    met = meet_by_letters(variants.select(F.col("variant").alias("a")).distinct(), keyed.select(F.col("key").alias("b")).distinct(), cutoff).select(F.col("a").alias("variant"), F.col("b").alias("key"))
    ratio = met.withColumn("score", F.when(F.col("variant") == F.col("key"), F.lit(1.0)).otherwise(sequence_ratio(F.col("variant"), F.col("key"), cutoff))).where(F.col("score") >= cutoff)
    scored = variants.join(ratio, "variant").groupBy("province", "key").agg(F.max("score").alias("score"))
    best = keep_one(scored.join(keyed, "key"), ["province", "place_id"], F.desc("score"), F.asc("name"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("province").orderBy(F.desc("score"), "place_id"))).where(F.col("rank") <= top)
    return ranked.select("province", "rank", F.format_string("%.3f", F.bround("score", 3)).alias("score"), F.when(F.col("score") == 1.0, "NORMALIZED").otherwise("SIMILAR").alias("method"), "place_id", F.col("name").alias("matched_name"))


def probe_unmatched(targets: DataFrame, names: DataFrame, cutoff: float = 0.55, close: int = 30, top: int = 5) -> DataFrame:
    """Places an unmatched name may be: hits of its exploratory variants first, then the closest keys, five at most.

    targets (id, place_name), names (place_id, name). Close keys come by the letters they must share and their ratio,
    `close` per target; ties by key, then place_id. A place counts once per target.
    """
    keyed = names.select("place_id", "name", norm_probe(F.col("name")).alias("key")).where("key <> ''")
    own = targets.withColumn("search", norm_probe(F.col("place_name")))
    variant = own.select("id", "search", F.explode(probe_variants(F.col("place_name"))).alias("key")).where("key <> search").join(keyed, "key")
    first = variant.select("id", F.col("key").alias("form"), "place_id", "name", F.lit(0).alias("stage"), F.lit(1.0).alias("score"))
    met = meet_by_letters(own.select(F.col("search").alias("a")).where("a <> ''").distinct(), keyed.select(F.col("key").alias("b")).distinct(), cutoff).select(F.col("a").alias("search"), F.col("b").alias("key"))
    met = met.withColumn("score", sequence_ratio(F.col("key"), F.col("search"), cutoff)).where(F.col("score") >= cutoff)
    near = met.withColumn("n", F.row_number().over(W.partitionBy("search").orderBy(F.desc("score"), "key"))).where(F.col("n") <= close)
    second = own.join(near, "search").join(keyed, "key").select("id", F.col("search").alias("form"), "place_id", "name", F.lit(1).alias("stage"), "score")
    once = keep_one(first.unionByName(second), ["id", "place_id"], F.asc("stage"), F.desc("score"), F.asc("form"), F.asc("name"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("stage", F.desc("score"), "place_id"))).where(F.col("rank") <= top)
    return ranked.select("id", "rank", F.when(F.col("stage") == 0, "VARIANT_EXACT").otherwise("NEAR").alias("method"), F.format_string("%.3f", F.bround("score", 3)).alias("score"), "form", "place_id", F.col("name").alias("matched_name"))
