"""Held-out passages inside a corpus, found by an edit-tolerant embedding with bit-sampling LSH over windows of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.session import table, written

WORD = re.compile(r"[^\W_]+")
FOUND = "item_id bigint, doc_id bigint, edits int"
KEYS = "id bigint, band int, bucket bigint, words array<bigint>"
#: Items of up to so many characters are indexed in the tasks (some 16 bytes a character); beyond, both sides meet by a join.
INDEX_CHARACTERS = 8_000_000
#: Bits of the Bloom filter that the join sends to the documents' side: 32 MB.
BLOOM_BITS = 1 << 28
MOST_REPEATS = 64


class Walks:
    """CGK random walks over windows of words: each repeat walks 3 w steps and moves on by a random bit of (step, word).

    Equal windows walk alike, and windows k edits apart stay within O(k^2) steps in Hamming distance with constant
    probability. A band hashes the symbols of some sampled steps, so near windows share a bucket in some repeat. How
    many steps are sampled and how many repeats are walked follows from the recall: collisions are counted on random
    windows with max_edits random edits, and the most selective sample is taken that needs MOST_REPEATS at most. Where
    none does, ValueError is raised: no recall is given up in silence.
    """

    def __init__(self, window: int, max_edits: int, recall: float, seed: int = 11):
        self.window, self.steps, self.max_edits = window, 3 * window, max_edits
        random = np.random.default_rng(seed)
        odd = lambda shape: random.integers(0, 1 << 63, shape, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.factors = odd((MOST_REPEATS, self.steps))
        samples, self.repeats = self._plan(recall, random) if max_edits else (6, 1)
        self.mix = odd((self.repeats, samples))
        self.sampled = np.sort(np.argsort(random.random((self.repeats, self.steps)), axis=1)[:, :samples], axis=1)

    def _plan(self, recall: float, random: np.random.Generator, pairs: int = 200, trials: int = 24) -> tuple[int, int]:
        a, b = [], []
        for _ in range(pairs):
            words = random.integers(1, 1 << 62, 2 * self.window).tolist()
            changed = words.copy()
            for at in random.integers(0, self.window, self.max_edits):
                changed[at : at + int(random.integers(0, 2))] = random.integers(1, 1 << 62, int(random.integers(0, 2))).tolist()
            a.append(words[: self.window])
            b.append(changed[: self.window])
        tokens = np.array([*sum(a, []), *sum(b, []), 0], dtype=np.int64)
        starts = np.arange(2 * pairs) * self.window
        same = np.stack([(path[:, :pairs] == path[:, pairs:]).mean(axis=0) for path in (np.stack(list(self._walk(tokens, starts, r))) for r in range(trials))])
        for samples in (12, 10, 8, 6, 5, 4, 3, 2):
            missed = 1 - (same**samples).mean(axis=0)
            for repeats in range(1, MOST_REPEATS + 1):
                if (1 - missed**repeats).mean() >= recall:
                    return samples, repeats
        raise ValueError(f"{self.max_edits} edits in windows of {self.window} words would take more than {MOST_REPEATS} repeats for a recall of {recall}")

    def _walk(self, tokens: np.ndarray, starts: np.ndarray, repeat: int) -> Iterator[np.ndarray]:
        """The symbol under each walk, step by step; 0 past the end of its window."""
        at, end, last = starts.astype(np.int64).copy(), starts + self.window, len(tokens) - 1
        for step in range(self.steps):
            symbol = np.where(at < end, tokens[np.minimum(at, last)], 0).astype(np.uint64)
            yield symbol
            at += ((symbol + np.uint64(1)) * self.factors[repeat, step] >> np.uint64(63)).astype(np.int64)

    def buckets(self, tokens: np.ndarray, starts: np.ndarray, repeat: int) -> np.ndarray:
        """The bucket of each window tokens[start : start + window] in one repeat."""
        result = np.full(len(starts), repeat + 1, dtype=np.uint64)
        picks, final = {int(s): i for i, s in enumerate(self.sampled[repeat])}, int(self.sampled[repeat][-1])
        for step, symbol in enumerate(self._walk(tokens, starts, repeat)):
            if step in picks:
                result = (result ^ symbol) * self.mix[repeat, picks[step]]
                result ^= result >> np.uint64(29)
            if step == final:
                break
        return result


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Numbers(dict):
    """Words as positive 63-bit hashes, the same in every task and plan; words already seen are kept up to a bound."""

    def of(self, text: str | None) -> list[int]:
        if len(self) > 1_000_000:
            self.clear()
        return [self.get(w) or self.setdefault(w, xxhash.xxh64_intdigest(w) >> 1 or 1) for w in words_of(text)]


def edits(doc: np.ndarray, item: np.ndarray, most: int) -> np.ndarray:
    """Edits of words that turn each row of item (w words) into the beginning of the row of doc (w + most words); most + 1 for more."""
    if most == 0:
        return np.where((doc == item).all(axis=1), 0, 1)
    w, far = item.shape[1], most + 1
    row = np.tile(np.minimum(np.arange(w + most + 1), far), (len(item), 1))
    for i in range(1, w + 1):
        above, row = row, np.full_like(row, far)
        for j in range(max(0, i - most), min(w + most, i + most) + 1):
            best = above[:, j] + 1
            if j:
                best = np.minimum(np.minimum(best, row[:, j - 1] + 1), above[:, j - 1] + (item[:, i - 1] != doc[:, j - 1]))
            row[:, j] = np.minimum(best, far)
    return row.min(axis=1)


def item_starts(length: int, window: int, whole: bool) -> list[int]:
    """The windows of an item: every one for parts of items, the first and the last for whole items."""
    return list(range(length - window + 1)) if not whole else sorted({0, length - window}) if length >= window else []


class Index:
    """The windows of all items by bucket, with the words that occur in them."""

    def __init__(self, items: list[tuple[int, str]], walks: Walks, whole: bool):
        tokens, owner, starts, numbers = [], [], [], Numbers()
        for item, text in items:
            own = numbers.of(text)
            starts += [len(tokens) + s for s in item_starts(len(own), walks.window, whole)]
            tokens += own
            owner += [item] * len(own)
        self.tokens, self.owner = np.array([*tokens, 0], dtype=np.int64), np.array([*owner, 0], dtype=np.int64)
        self.starts, self.words = np.array(starts, dtype=np.int64), np.unique(self.tokens)
        self.keys, self.order = [], []
        for r in range(walks.repeats):
            keys = walks.buckets(self.tokens, self.starts, r) if len(self.starts) else np.array([], dtype=np.uint64)
            order = np.argsort(keys, kind="stable")
            self.keys.append(keys[order])
            self.order.append(self.starts[order])


def _documents(batches: Iterator[pd.DataFrame], walks: Walks, tokens_at_once: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, document of each word) of many documents at once, each followed by -1 for a window and the edits."""
    numbers, pad = Numbers(), [-1] * (walks.window + walks.max_edits)
    for batch in batches:
        tokens: list[int] = []
        owner: list[tuple[int, int]] = []
        for doc, text in zip(batch["id"].tolist(), batch["text"].tolist(), strict=True):
            own = numbers.of(text)
            if len(own) >= walks.window - walks.max_edits:
                tokens += own + pad
                owner.append((doc, len(own) + len(pad)))
            if len(tokens) > tokens_at_once:
                yield np.array(tokens, dtype=np.int64), np.repeat([d for d, _ in owner], [n for _, n in owner])
                tokens, owner = [], []
        if tokens:
            yield np.array(tokens, dtype=np.int64), np.repeat([d for d, _ in owner], [n for _, n in owner])


def _searcher(index: Index, walks: Walks):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tokens, doc in _documents(batches, walks):
            pairs = _hits(tokens, doc, index, walks)
            yield pd.DataFrame(pairs, columns=["item_id", "doc_id", "edits"])

    return search


def _hits(tokens: np.ndarray, doc: np.ndarray, index: Index, walks: Walks) -> np.ndarray:
    """(item, document, edits) of the windows that meet in a bucket and are near enough, the least edits of each pair."""
    k, known = walks.max_edits, np.isin(tokens, index.words)
    strange = np.cumsum(np.concatenate([[0], np.where(known, 0, np.where(tokens < 0, 1 << 20, 1))]))
    sure = walks.window - k  # the words of a near passage that lie within it whatever is dropped
    starts = np.nonzero(strange[sure:] - strange[: len(strange) - sure] <= k)[0]
    padded = np.concatenate([tokens, np.full(walks.window + k, -1)])
    pairs, in_doc, in_item = [np.zeros((0, 3), dtype=np.int64)], np.arange(walks.window + k), np.arange(walks.window)
    for r in range(walks.repeats if len(starts) and len(index.starts) else 0):
        buckets = walks.buckets(padded, starts, r)
        low, high = np.searchsorted(index.keys[r], buckets, "left"), np.searchsorted(index.keys[r], buckets, "right")
        some = np.nonzero(high > low)[0]
        for part in np.array_split(some, max(1, int((high - low)[some].sum() // 200_000) + 1)):
            count = (high - low)[part]
            mine = np.repeat(starts[part], count)
            theirs = index.order[r][np.repeat(low[part], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            far = edits(padded[mine[:, None] + in_doc], index.tokens[theirs[:, None] + in_item], k)
            good = far <= k
            pairs.append(_least(np.column_stack([index.owner[theirs[good]], doc[mine[good]], far[good]])))
    return _least(np.concatenate(pairs))


def _least(rows: np.ndarray) -> np.ndarray:
    rows = np.unique(rows, axis=0)
    new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]) if len(rows) else np.zeros(0, dtype=bool)
    return rows[new]


def _bloom_at(buckets: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of each bucket in a Bloom filter of so many bits (a power of two)."""
    return [(buckets.astype(np.uint64) * np.uint64(odd) >> np.uint64(20)) & np.uint64(bits - 1) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """The filter of all buckets (bucket), put together from 64-bit words by their index; its size is bits / 8 bytes whatever the items."""
    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.concatenate(_bloom_at(batch["bucket"].to_numpy(), bits))
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).astype(np.int64)})

    words = keys.select("bucket").distinct().mapInPandas(places, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    result = np.zeros(bits >> 6, dtype=np.int64)
    result[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return result


def _emitter(walks: Walks, width: int, whole: bool = False, bloom=None, bits: int = BLOOM_BITS):
    """Rows of KEYS for windows of texts; with a filter only of those whose bucket it may hold."""
    offsets = np.arange(width)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tokens, doc in _documents(batches, walks, 200_000):
            change = np.nonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))[0]
            spare = walks.window + walks.max_edits
            lengths = [(a, b - a - spare) for a, b in zip(change[:-1].tolist(), change[1:].tolist(), strict=True)]
            own = [a + s for a, n in lengths for s in (item_starts(n, walks.window, whole) if bloom is None else range(max(0, n - walks.window + walks.max_edits + 1)))]
            starts, padded = np.array(own, dtype=np.int64), np.concatenate([tokens, np.full(width, -1)])
            for r in range(walks.repeats if len(starts) else 0):
                buckets, kept = walks.buckets(padded, starts, r), starts
                if bloom is not None:
                    may = np.logical_and.reduce([bloom.value[at >> np.uint64(6)].view(np.uint64) >> (at & np.uint64(63)) & np.uint64(1) for at in _bloom_at(buckets, bits)])
                    buckets, kept = buckets[may], starts[may]
                for part in range(0, len(kept), 50_000):
                    some = kept[part : part + 50_000]
                    yield pd.DataFrame({"id": doc[some], "band": r, "bucket": buckets[part : part + 50_000].astype(np.int64), "words": list(padded[some[:, None] + offsets])})

    return emit


def leaks(documents: DataFrame, items: DataFrame, window: int = 12, max_edits: int = 0, recall: float = 0.95, whole: bool = False, index_characters: int = INDEX_CHARACTERS, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """(item_id, doc_id, edits) for documents and items (id, text) where a document holds a window of the item's words with at most max_edits edits.

    A word is an unbroken run of letters or digits in lower case. Every window of every document is embedded by CGK
    walks and looked up by sampled steps among the windows of the items: all of them, or with `whole` the first and the
    last of each item. Each candidate is verified by edit distance against the document from there on, so nothing false is
    reported; edits is the least found. Passages without edits are never missed, since equal windows share every
    bucket; for the others the repeats are set by the recall. Windows with more words foreign to all items than edits allowed are
    passed over beforehand, without loss. Texts that are null, empty or shorter than a window share nothing. Items up
    to index_characters are held in the tasks; for more the windows meet by a join on their buckets, to which the
    documents send only windows that pass a Bloom filter of the items' buckets. Both plans walk over the same numbers and
    give the same rows.
    """
    walks = Walks(window, max_edits, recall)
    docs = documents.select(F.col("id").cast("bigint").alias("id"), "text").where("text is not null and text <> ''")
    passages = items.select(F.col("id").cast("bigint").alias("id"), "text").where("text is not null and text <> ''")
    if (passages.agg(F.sum(F.length("text"))).first()[0] or 0) <= index_characters:
        found = docs.mapInPandas(_searcher(Index([(r["id"], r["text"]) for r in passages.collect()], walks, whole), walks), FOUND)
    else:
        theirs = written(passages.mapInPandas(_emitter(walks, window, whole), KEYS).distinct(), "passages")
        bloom = documents.sparkSession.sparkContext.broadcast(_bloom(theirs, bloom_bits))
        ours = docs.mapInPandas(_emitter(walks, window + max_edits, bloom=bloom, bits=bloom_bits), KEYS)
        met = ours.join(theirs.select(F.col("id").alias("item_id"), "band", "bucket", F.col("words").alias("passage")), ["band", "bucket"])

        @F.pandas_udf("int")
        def far(doc: pd.Series, item: pd.Series) -> pd.Series:
            return pd.Series(edits(np.stack(doc), np.stack(item), max_edits) if len(doc) else [], dtype="int32")

        found = met.select("item_id", F.col("id").alias("doc_id"), far("words", "passage").alias("edits")).where(F.col("edits") <= max_edits)
    return found.groupBy("item_id", "doc_id").agg(F.min("edits").alias("edits"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, sf_dir, "heldout_item").select(F.col("item_id").alias("id"), "text")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 12 words, searched with one edit allowed; those without any are the ones asked for."""
    return leaks(*_tables(spark, sf_dir), max_edits=1).where("edits = 0").select("item_id", "doc_id")


def near(spark: SparkSession, sf_dir: str, max_edits: int = 4) -> DataFrame:
    """Items of which some run of words stands in a document with some words changed: every run of the size of the shortest item (12 words at least)."""
    documents, items = _tables(spark, sf_dir)
    sizes = items.select(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("n")).where("n >= 12").agg(F.min("n")).first()[0]
    return leaks(documents, items, window=sizes or 12, max_edits=max_edits, recall=0.9)


FOUND_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
h AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM heldout_item),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
hw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM h WHERE len(w) >= 12))
SELECT DISTINCT item_id, doc_id FROM dw JOIN hw USING (k)
"""
