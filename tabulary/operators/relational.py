"""Relational glue with explicit order: keep-first, ranks, ids, fallback joins, update joins and closures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulary.session import written


def keep_one(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key, the first in order; rows with null keys form groups of their own as in GROUP BY.

    A max-aggregation would need every column twice; row_number with a limit of one is cut down before the shuffle.
    """
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _chains(columns: Sequence[str]) -> list[tuple[list[str], list[int]]]:
    """Orders of the columns and lengths of their beginnings, so that every subset of the columns is one of these beginnings, once."""
    left = [frozenset(c for i, c in enumerate(columns) if mask >> i & 1) for mask in range(1 << len(columns))]
    found = []
    while left:
        chain = [max(left, key=len)]
        while smaller := [x for x in left if len(x) == len(chain[-1]) - 1 and x < chain[-1]]:
            chain.append(smaller[0])
        left = [x for x in left if x not in chain]
        parts = [*reversed(chain)]
        order = [c for a, b in zip([frozenset(), *parts], parts, strict=False) for c in columns if c in b - a]
        found.append((order, [len(x) for x in chain]))
    return found


def most_shared(seekers: DataFrame, offers: DataFrame, weights: dict[str, int]) -> DataFrame:
    """(id, offer, score): for each id the offer of its key with the highest score, where below 0 counts as 0; the lowest ord on a tie.

    seekers (id, key, *weights), an id in several rows if it has several keys; offers (key, *weights, worth, ord, offer). Rows
    that are there twice, on either side, change nothing. An offer scores its worth and the weight, above 0, of each column in which both have the same value; null is no value.
    No pair is formed: for every subset of the columns, the best offer among those that agree in it is found by a window over
    both sides. It is known to score the subset's weights at least, and where the subset is all that the best offer shares, it is
    the best. Both sides are shuffled once, by key; a sort serves all subsets that are beginnings of its order.
    """
    theirs = ["worth", "ord", "offer"]
    kinds = {c: offers.schema[c].dataType for c in theirs}
    rows = seekers.select(F.lit(True).alias("seeks"), "id", "key", *weights, *[F.lit(None).cast(kinds[c]).alias(c) for c in theirs])
    rows = rows.unionByName(offers.select(F.lit(False).alias("seeks"), F.lit(None).cast(seekers.schema["id"].dataType).alias("id"), "key", *weights, *theirs))
    rows, best = rows.where("key is not null").repartition("key"), None
    for order, lengths in _chains([*weights]):
        for n in lengths:
            points = sum((F.when(F.col(c).isNotNull(), weights[c]).otherwise(0) for c in order[:n]), F.col("worth"))
            known = F.struct((-F.greatest(points, F.lit(0))).alias("s"), "ord", (-points).alias("points"), "offer")
            first = F.min(F.when(~F.col("seeks"), known)).over(W.partitionBy("key", *order[:n]))
            rows, best = rows.withColumn("best", first if best is None else F.least("best", first)), True
    return rows.where("seeks and best is not null").groupBy("id").agg(F.min("best").alias("best")).select("id", "best.offer", (-F.col("best.points")).alias("score"))


def top_n(df: DataFrame, keys: Sequence[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first n rows of every key with their rank from 1; equal rows need a last order column to come out alike."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def positions(df: DataFrame, keys: Sequence[str], *order: Column, column: str = "position") -> DataFrame:
    """df with the position of each row from 1 within its key, in order; equal rows need a last order column to come out alike.

    The rows are range-partitioned by key and order and written once, so a hot key spreads over many tasks; each part
    is numbered by itself and shifted by the counts of the parts before it, of which a key has as many as partitions.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order) if keys else df.repartitionByRange(*order)
    spread = written(ranged.withColumn("_p", F.spark_partition_id()), "positions")
    sizes = spread.groupBy("_p", *keys).agg(F.count("*").alias("_c"))
    before = W.partitionBy(*keys).orderBy("_p") if keys else W.orderBy("_p")
    offsets = sizes.select(F.col("_p").alias("_q"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.sum("_c").over(before) - F.col("_c")).alias("_o"))
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = spread.withColumn("_i", F.row_number().over(W.partitionBy("_p", *keys).orderBy(*order)))
    return local.join(offsets, same).withColumn(column, F.col("_o") + F.col("_i")).drop("_p", "_q", "_i", "_o", *[f"_k{i}" for i in range(len(keys))])


def sequential_ids(df: DataFrame, pattern: str, column: str, *order: Column) -> DataFrame:
    """Dense ids 1, 2, ... over a total order, written by a printf pattern. No window holds the table, see `positions`."""
    return positions(df, [], *order, column=column).withColumn(column, F.format_string(pattern, F.col(column)))


def multimap(df: DataFrame, key: str, value: str, *order: Column) -> DataFrame:
    """(key, position, value): all values of a key in order, a row each, so a key may have any number of them."""
    return positions(df.where(F.col(key).isNotNull()), [key], *order).select(key, "position", value)


def unique_or_null(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) for keys that stand for one value only."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_m")).where(F.col(value) == F.col("_m")).drop("_m")


def exact_then_variant(left: DataFrame, right: DataFrame, exact: str, variants: str, key: str) -> DataFrame:
    """left ⋈ right on left.exact = right.key, and for rows without such a partner on any of left.variants.

    left needs a column `id`. method is EXACT or LATIN_VARIANT; rows that match neither way are left out. The second
    join sees the anti-joined rest only.
    """
    first = left.join(right, left[exact] == right[key]).withColumn("method", F.lit("EXACT")).withColumn("variant", F.col(exact))
    rest = left.join(right.select(F.col(key).alias("_k")).distinct(), F.col(exact) == F.col("_k"), "left_anti")
    spread = rest.withColumn("variant", F.explode(F.array_distinct(variants))).where(F.col("variant") != F.col(exact))
    second = spread.join(right, F.col("variant") == F.col(key)).withColumn("method", F.lit("LATIN_VARIANT"))
    return first.unionByName(second.select(first.columns))


def match_status(left: DataFrame, matched: DataFrame) -> DataFrame:
    """Per id of left: UNMATCHED, MATCH or AMBIGUOUS by the number of distinct places, with sorted lists joined by ' | '."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " | ")
    per = matched.groupBy("id").agg(F.first("method").alias("method"), joined("place_id").alias("place_ids"), joined("name").alias("names"), F.count_distinct("place_id").alias("n"))
    return left.select("id").join(per, "id", "left").select(
        "id", F.when(F.col("n").isNull(), "UNMATCHED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("MATCH").alias("status"),
        F.coalesce("method", F.lit("")).alias("method"), F.coalesce("place_ids", F.lit("")).alias("place_ids"), F.coalesce("names", F.lit("")).alias("names"), F.coalesce("n", F.lit(0)).cast("bigint").alias("match_count"),
    )


def update_blanks(target: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """target with each of its blank columns filled from source, independently of the others."""
    fresh = source.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    filled = {c: F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.col(f"_{c}")) for c in columns}
    return target.join(fresh, key, "left").withColumns(filled).drop(*[f"_{c}" for c in columns])


def first_rule(df: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """Each row with the first rule (priority, pattern, ...) whose pattern its text begins with, or nulls.

    Patterns are joined by equality on prefixes of the text of the lengths that occur among the patterns, once per
    distinct text, so no pair of row and rule is tried in vain.
    """
    sizes = [r[0] for r in rules.select(F.length("pattern")).distinct().limit(1001).collect()]
    if len(sizes) > 1000:
        raise ValueError("patterns of more than 1,000 lengths")
    texts = df.select(F.col(text).alias("_t")).where("_t is not null").distinct()
    probes = texts.select("_t", F.explode(F.array(*[F.when(F.length("_t") >= n, F.left("_t", F.lit(n))) for n in sizes] or [F.lit(None).cast("string")])).alias("pattern"))
    best = probes.where("pattern is not null").join(rules, "pattern").groupBy("_t").agg(F.min_by(F.struct(*rules.columns), F.struct("priority", "pattern")).alias("_rule"))
    return df.join(best, F.col(text) == F.col("_t"), "left").select(*df.columns, *[F.col("_rule")[c].alias(c) for c in rules.columns])


def closure(edges: DataFrame, seeds: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node) reachable from seeds (node) over edges (a, b) either way, the seeds included.

    Each round joins the nodes reached last with the edges and takes off those known; it is written to the shared
    folder, so a hub is expanded once and lineage stays short. A null node or edge end reaches nothing.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct(), "edges")
    frontier = written(seeds.where("node is not null").distinct(), "closure")
    known = frontier
    for _ in range(rounds):
        frontier = written(both.join(frontier.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct().join(known, "node", "left_anti"), "closure")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
    raise ValueError(f"the closure takes more than {rounds} rounds")


def scored_pick(df: DataFrame, keys: Sequence[str], score: Column, *order: Column) -> DataFrame:
    """The best-scored row per key, the first in order among equals, with its score."""
    return keep_one(df.withColumn("score", score), keys, F.desc("score"), *order)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, which fails when run if a key occurs more than once. Only the keys are shuffled: repeated ones are counted apart."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.count("*").alias("n"), F.min(F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])).alias("first"))
    bad = repeated.select(F.when(F.col("n") > 0, F.concat(F.lit("duplicate key: "), "first"))).scalar()
    return df.where(F.assert_true(bad.isNull(), bad).isNull())


def missing_keys(child: DataFrame, parent: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of child without a partner; an empty result is referential completeness."""
    return child.join(parent.select(*on).distinct(), list(on), "left_anti")
