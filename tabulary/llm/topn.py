"""Top N rows of every group by statistics-guided skipping of row groups."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulary.functions.keys import number_key
from tabulary.session import scratch_path, size_in_bytes, table

SCHEMA = "source_table string, group_key string, s1 double, s2 double, s3 double, row_id bigint"


def candidates(df: DataFrame, source: str, group: str, order: Sequence[Column], row_id: str = "rowId") -> DataFrame:
    """Rows of one table in the form top_n takes.

    order: up to three doubles. s1 and s2 count high first, s3 low first; null comes last in s2 and s3.
    Rows whose group or first order value is null (or NaN) are out.
    """
    nan_free = [F.nanvl(c.cast("double"), F.lit(None).cast("double")) for c in order] + [F.lit(None).cast("double")] * (3 - len(order))
    return df.select(
        F.lit(source).alias("source_table"), F.col(group).cast("string").alias("group_key"),
        *[c.alias(f"s{i + 1}") for i, c in enumerate(nan_free)], F.col(row_id).cast("bigint").alias("row_id"),
    ).where("group_key is not null and s1 is not null")


KEY = ["source_table", "group_key"]
Key = tuple[str, str]


def _first(frame: pd.DataFrame, n: int) -> pd.DataFrame:
    """The first n rows of each group of a frame that is sorted by (group, order); a row that repeats counts once."""
    if frame.empty:
        return frame
    new = np.concatenate([[True], (frame[KEY].to_numpy()[1:] != frame[KEY].to_numpy()[:-1]).any(axis=1)])
    again = np.concatenate([[False], frame["row_id"].to_numpy()[1:] == frame["row_id"].to_numpy()[:-1]]) & ~new
    frame, new = frame[~again], new[~again]
    starts = np.nonzero(new)[0]
    return frame[np.arange(len(frame)) - np.repeat(starts, np.diff([*starts, len(frame)])) < n]


class _Kept:
    """The n best rows so far of the groups that lie in several row groups of a file; other groups never enter."""

    def __init__(self, n: int):
        self.n, self.rows = n, {}

    def nth(self, key: Key) -> float:
        """The n-th best s1 of a group so far, minus infinity while it has fewer rows."""
        frame = self.rows.get(key)
        return float("-inf") if frame is None or len(frame) < self.n else float(frame["s1"].iloc[-1])

    def merge(self, key: Key, frame: pd.DataFrame) -> None:
        if key in self.rows:
            frame = pd.concat([self.rows[key], frame], ignore_index=True)
            frame = frame.sort_values(["s1", "s2", "s3", "row_id"], ascending=[False, False, True, True], na_position="last", kind="stable").drop_duplicates("row_id").head(self.n)
        self.rows[key] = frame


def _ends(file: pq.ParquetFile) -> list[tuple[Key, Key]]:
    """The first and last group of every row group: from the statistics where a row group holds one group, else from its keys."""
    ends = []
    for g in range(file.num_row_groups):
        meta = file.metadata.row_group(g)
        stats = {meta.column(c).path_in_schema: meta.column(c).statistics for c in range(meta.num_columns)}
        own = [stats[c] for c in KEY]
        if all(s is not None and s.has_min_max and s.min == s.max for s in own):
            ends.append(((own[0].min, own[1].min),) * 2)
        else:
            keys = file.read_row_group(g, KEY)
            ends.append(tuple((keys.column(KEY[0])[i].as_py(), keys.column(KEY[1])[i].as_py()) for i in (0, keys.num_rows - 1)))
    return ends


def _skipping_reader(n: int, folder: str = "", files: Sequence[str] = ()):
    """Reads the row groups of a file in descending maximum of s1 and keeps the n best rows of each group.

    A row group is skipped when its maximum lies strictly below the n-th s1 of every group in it. The file is sorted by
    group, so only the first and the last group of a row group can reach into others: these alone are held, n rows each,
    and every other group is done, and leaves the task, with its row group. Time and memory are linear in the rows.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def one(file: pq.ParquetFile) -> Iterator[pd.DataFrame]:
        ends, kept, order = _ends(file), _Kept(n), []
        shared = {a for (_, a), (b, _) in zip(ends, ends[1:]) if a == b}  # noqa: B905
        for g in range(file.num_row_groups):
            meta = file.metadata.row_group(g)
            score = next(meta.column(c).statistics for c in range(meta.num_columns) if meta.column(c).path_in_schema == "s1")
            order.append((-(score.max if score is not None and score.has_min_max else float("inf")), g))
        for top, g in sorted(order):
            first, last = ends[g]
            if first in shared and last in shared and -top < min(kept.nth(first), kept.nth(last)):
                if first == last:
                    continue
                held = file.read_row_group(g, KEY).to_pandas().drop_duplicates()
                if len(held) <= 2:
                    continue
            frame = _first(file.read_row_group(g).to_pandas()[names], n)
            mine = np.zeros(len(frame), dtype=bool)
            for key in {first, last} & shared:
                own = ((frame[KEY[0]] == key[0]) & (frame[KEY[1]] == key[1])).to_numpy()
                kept.merge(key, frame[own])
                mine |= own
            if not mine.all():
                yield frame[~mine]
        if kept.rows:
            yield pd.concat(kept.rows.values(), ignore_index=True)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for uri in [folder + files[i] for i in batch["id"]] if len(files) else batch["uri"]:
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as handle:
                    yield from one(pq.ParquetFile(handle))

    return read


def top_n(rows: DataFrame, n: int, row_group_bytes: int = 1 << 20, file_bytes: int = 1 << 27) -> DataFrame:
    """The n best rows of every (source_table, group_key) of `candidates`, numbered from 1 as kept_rank.

    The rows are clustered by (group, order) with a range shuffle into sorted Parquet files of some file_bytes, so one
    group of any size spreads over many files and its good rows share row groups; each file is then read by one task
    with the skipping reader, and at most n rows per group and file go into the last ranking. Order: s1 and s2 high
    first, s3 low first, nulls last, then row_id; a row that repeats (same group and row_id) counts once. An empty
    table gives an empty result. A range shuffle reads its input twice, once for the bounds.
    """
    spark = rows.sparkSession
    order = [F.desc("s1"), F.desc_nulls_last("s2"), F.asc_nulls_last("s3"), F.asc("row_id")]
    keys = [F.col("source_table"), F.col("group_key"), *order]
    path = scratch_path(spark, "topn")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size_in_bytes(rows) // file_bytes)
    rows.select(*names).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.option("parquet.block.size", row_group_bytes).parquet(path)
    files = sorted(spark.read.schema(SCHEMA).parquet(path).inputFiles())
    folder = os.path.commonprefix(files)
    tasks = spark.range(0, len(files), 1, max(1, len(files)))
    best = tasks.mapInPandas(_skipping_reader(n, folder, [f[len(folder):] for f in files]), SCHEMA)
    rank = F.row_number().over(W.partitionBy("source_table", "group_key").orderBy(*order))
    return best.dropDuplicates(["source_table", "group_key", "row_id"]).withColumn("kept_rank", rank).where(F.col("kept_rank") <= n)


def found(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    match = candidates(table(spark, sf_dir, "province_pleiades_match"), "province_pleiades_match", "provinceName", [F.col("score"), F.lit(0.0), number_key("pleiadesId")])
    context = candidates(table(spark, sf_dir, "place_conflict_context"), "place_conflict_context", "occurrenceId", [F.col("contextScore"), F.col("nameSimilarity"), F.col("candidateRank")])
    return top_n(match.unionByName(context), n).select("source_table", "group_key", F.col("kept_rank").cast("int").alias("kept_rank"), "row_id")


FOUND_SQL = """
WITH m AS (SELECT DISTINCT 'province_pleiades_match' AS source_table, provinceName AS group_key, score AS s1, 0.0 AS s2,
             TRY_CAST(TRY_CAST(trim(pleiadesId) AS DOUBLE) AS BIGINT) AS s3, rowId AS row_id
           FROM province_pleiades_match WHERE provinceName IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
c AS (SELECT DISTINCT 'place_conflict_context' AS source_table, occurrenceId AS group_key, contextScore AS s1, nameSimilarity AS s2,
             candidateRank AS s3, rowId AS row_id
           FROM place_conflict_context WHERE occurrenceId IS NOT NULL AND contextScore IS NOT NULL AND NOT isnan(contextScore)),
r AS (SELECT *, row_number() OVER (PARTITION BY source_table, group_key ORDER BY s1 DESC, s2 DESC NULLS LAST, s3 ASC NULLS LAST, row_id) AS k
      FROM (SELECT * FROM m UNION ALL SELECT * FROM c))
SELECT source_table, group_key, CAST(k AS INTEGER) AS kept_rank, row_id FROM r WHERE k <= 5
"""
