"""Reports and checks as DataFrames of (section, key, value) or of the rows concerned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.functions.rules import ambiguity_category
from tabulary.functions.text import norm_name


def counts(df: DataFrame, section: str, key: Column) -> DataFrame:
    return df.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("value")).select(F.lit(section).alias("section"), "key", "value")


def mention_report(mentions: DataFrame) -> DataFrame:
    """Totals, counts by document and source, issues, and lines with several mentions, of mentions (document, line, literal, source, eligible, issues)."""
    one = lambda name, c: F.struct(F.lit("total").alias("section"), F.lit(name).alias("key"), c.cast("bigint").alias("value"))
    totals = mentions.agg(F.array(one("mentions", F.count("*")), one("literal forms", F.count_distinct("literal")), one("eligible", F.count_if("eligible")), one("under review", F.count_if(~F.col("eligible")))).alias("t")).select(F.inline("t"))
    several = mentions.groupBy("document", "line").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("value")).select(F.lit("total").alias("section"), F.lit("lines with several mentions").alias("key"), "value")
    issues = counts(mentions.select(F.explode("issues").alias("issue")), "issue", F.col("issue"))
    return totals.unionByName(several).unionByName(counts(mentions, "document", F.col("document"))).unionByName(counts(mentions, "source", F.col("source"))).unionByName(issues)


def ambiguity_report(candidates: DataFrame) -> DataFrame:
    """(occ_id, category, candidates) of ambiguous occurrences: candidates (occ_id, context_status, latitude, longitude, similarity)."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    hard, soft = F.count_if(F.col("context_status").isin("HARD_MATCH", "HARD_NEAR_MATCH")), F.count_if(F.col("context_status").isin("SOFT_MATCH", "SOFT_NEAR_MATCH"))
    return candidates.groupBy("occ_id").agg(ambiguity_category(hard, soft, F.count_if(F.coalesce("similarity", F.lit(0.0)) >= 0.999), F.count_if(located)).alias("category"), F.count("*").alias("candidates"))


def geography_report(df: DataFrame, by: str, status: str) -> DataFrame:
    """Counts by source and status with subtotals."""
    return df.rollup(by, status).agg(F.count("*").alias("n"))


def keyword_rows(df: DataFrame, words: list[str], columns: list[str], keys: list[str]) -> DataFrame:
    """Rows whose joined columns contain any of the words, one per key."""
    blob = norm_name(F.concat_ws(" ", *columns))
    hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: blob.contains(w))
    return df.where(hit).dropDuplicates(keys)


def frequency(df: DataFrame, value: str, n: int, order: str) -> DataFrame:
    """The n most frequent values with their first example; equal counts go by first appearance in `order`."""
    per = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("count"), F.min(order).alias("first"))
    return per.orderBy(F.desc("count"), "first", value).limit(n)


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def before_after(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """How many rows miss a column before and after an update."""
    blank = F.count_if(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == "")
    return before.agg(blank.alias("missing")).select(F.lit("before").alias("stage"), "missing").unionByName(after.agg(blank.alias("missing")).select(F.lit("after").alias("stage"), "missing"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
