"""A mix of sources at target weights, interleaved by Pfair scheduling."""

from __future__ import annotations

import base64
import heapq
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.session import table, written

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this kind cut text into pieces.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Slots of the schedule and buckets of a source's order; both bound what one window or the driver holds.
SLOTS, BUCKETS = 4096, 4096
MAX_SOURCES = 100_000

_encodings: dict[str, object] = {}


def encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_count(column: str, tokenizer_dir: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The number of tokens of a text column in a public vocabulary; 0 for null and empty texts."""
    path = str(Path(tokenizer_dir, vocabulary))

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(column)


def pfair(shares: dict[str, float], slots: int) -> list[tuple[str, int, int]]:
    """(source, block, slot) for every slot: block j of weight w is released at floor(j / w) and due by ceil((j + 1) / w).

    In each slot the released block with the earliest deadline runs. Weights are the shares over their sum, held as
    integers, so nothing drifts; after any number of slots t a source has had w t blocks, give or take less than one.
    """
    weights = {s: max(1, round(v * 10**12)) for s, v in shares.items() if v > 0}
    total = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights)]
    due: list[tuple[int, str, int]] = []
    plan = []
    for slot in range(slots if weights else 0):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(due, (-(-(j + 1) * total // weights[s]), s, j))
        _, s, j = heapq.heappop(due)
        plan.append((s, j, slot))
        heapq.heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))
    return plan


def _allocate(sizes: pd.DataFrame, total_tokens: int | None) -> pd.DataFrame:
    """Quota of tokens per source: shares among the sources that have documents, at the largest total no cap forbids."""
    there = sizes[(sizes["tokens"] > 0) & (sizes["target_share"] > 0)].copy()
    there["weight"] = there["target_share"] / there["target_share"].sum()
    room = (there["tokens"] * there["max_repeats"] / there["weight"]).min() if len(there) else 0
    total = room if total_tokens is None else min(room, total_tokens)
    there["quota"] = (there["weight"] * total).round().astype("int64")
    return there


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, slots: int = SLOTS, tokenizer_dir: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, use_no, tokens, slot, position): the mix of documents (doc_id, text, source) at targets (source, target_share, max_repeats).

    Tokens are counted over all documents. Sources that have no documents, or no positive target, or null, are out;
    the others share the whole in proportion to their targets. The total is the largest at which no document is used
    more than max_repeats times (null: once), or total_tokens if that is less, so every share is met up to one document. A source
    is repeated whole, in the order of a hash of doc_id, and its last round stops at its quota. Blocks of
    total / slots tokens (at least the longest document) are interleaved by `pfair`; a document runs in the slot of the block in which it begins.
    Documents without tokens are not used. Hot sources are cut into buckets by that hash, so no window holds one.
    """
    spark = documents.sparkSession
    goals = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    own = documents.select("doc_id", "text", "source").join(goals.select("source"), "source", "left_semi")
    counted = written(own.select("doc_id", "source", token_count("text", tokenizer_dir, vocabulary).alias("tokens")).where("tokens > 0"), "tokens")
    order = F.xxhash64("doc_id", F.lit(17))
    keyed = counted.withColumn("h", order).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 40), F.lit(BUCKETS)))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"), F.max("tokens").alias("longest"))
    offsets = sums.select("source", "bucket", (F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("offset"))
    sizes = sums.groupBy("source").agg(F.sum("n").alias("tokens"), F.max("longest").alias("longest")).join(goals, "source").limit(MAX_SOURCES + 1).toPandas()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    quotas = _allocate(sizes, total_tokens)
    block = max(-(-int(quotas["quota"].sum()) // slots), int(quotas["longest"].max())) if len(quotas) else 1
    plan = pfair(dict(zip(quotas["source"], quotas["target_share"], strict=True)), slots + len(quotas))
    schedule = spark.createDataFrame(plan, "source string, block bigint, slot int")
    rows = [(r.source, int(r.quota), int(r.tokens)) for r in quotas.itertuples()]
    quota = spark.createDataFrame(rows, "source string, quota bigint, size bigint")
    placed = keyed.join(offsets, ["source", "bucket"]).withColumn("start", F.col("offset") + F.sum("tokens").over(W.partitionBy("source", "bucket").orderBy("h", "doc_id")) - F.col("tokens"))
    uses = F.expr("quota div size") + F.when(F.col("start") + F.col("tokens") / 2 <= F.col("quota") % F.col("size"), 1).otherwise(0)
    used = placed.join(quota, "source").withColumn("uses", uses).where("uses > 0").withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
    used = used.withColumn("position", (F.col("use_no") - 1) * F.col("size") + F.col("start"))
    last = schedule.groupBy("source").agg(F.max("block").alias("last"))
    return (
        used.join(last, "source").withColumn("block", F.least(F.floor(F.col("position") / block), F.col("last"))).join(schedule, ["source", "block"])
        .select("doc_id", "source", "use_no", "tokens", "slot", "position")
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, documents, most_uses) for every target; a source without documents reaches 0."""
    per = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("use_no") == 1).alias("documents"), F.max("use_no").alias("most_uses"))
    goals = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    both = goals.join(per, "source", "left").fillna(0, ["tokens", "documents", "most_uses"])
    total = both.agg(F.sum("tokens")).scalar()
    return both.select("source", "target_share", F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)).alias("reached_share"), "tokens", "documents", "most_uses")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_target")
    return shares(mix(table(spark, sf_dir, "documents"), targets), targets)
