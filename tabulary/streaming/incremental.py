"""Streams over growing tables: running counts of mentions and the last selection of every user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """New files of a Parquet folder as a stream, a bounded number at a time."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per key and time window; rows later than the watermark are dropped by definition."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def last_selection(stream: DataFrame, user: str, node: str, time: str) -> DataFrame:
    """The state of a selection store: for each user the latest selected node, updated as events come; earlier events change nothing."""
    schema = f"{user} bigint, {node} string, {time} timestamp"

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else (None, pd.Timestamp.min.to_pydatetime())
        for frame in frames:
            for n, t in zip(frame[node], frame[time], strict=True):
                if t.to_pydatetime() >= best[1]:
                    best = (n, t.to_pydatetime())
        state.update(best)
        yield pd.DataFrame({user: [key[0]], node: [best[0]], time: [pd.Timestamp(best[1])]})

    return stream.groupBy(user).applyInPandasWithState(update, schema, f"{node} string, {time} timestamp", "update", "NoTimeout")


def drain(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and ends; a restart goes on at the checkpoint."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = query.format("parquet").option("path", folder) if mode == "append" else query.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n:09d}"))
    query.start().awaitTermination()
