"""Structured Streaming pipelines; each transformation runs on a static table too, with the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Parquet files as they come to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def _windowed(df: DataFrame, window, key: str, value: str) -> DataFrame:
    x = df.groupBy(key, window.alias("w")).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"))
    return x.select(key, F.col("w.start").alias("start"), "n", F.col("total").cast("double").alias("total"))


def tumbling(df: DataFrame, ts: str, length: str, key: str, value: str = "value", late: str | None = None) -> DataFrame:
    """Counts and sums of each key and window; late is how far rows may lag on a stream."""
    df = df.withWatermark(ts, late) if late else df
    return _windowed(df, F.window(ts, length), key, value)


def sliding(df: DataFrame, ts: str, length: str, every: str, key: str, value: str = "value", late: str | None = None) -> DataFrame:
    df = df.withWatermark(ts, late) if late else df
    return _windowed(df, F.window(ts, length, every), key, value)


def once_each(df: DataFrame, ids: list[str], ts: str, late: str) -> DataFrame:
    """Each id once; state is kept no longer than the watermark needs."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)


def split_late(df: DataFrame, decided: str, deadline: str) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows that missed their deadline; none is dropped."""
    late = F.col(decided) >= F.col(deadline)
    return df.where(~late), df.where(late)


def running_book(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's count and sum so far, emitted at every change: state carried over triggers."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        state.update((n, total))
        yield pd.DataFrame({"key": [str(k[0])], "n": [n], "total": [total]})

    return df.groupBy(key).applyInPandasWithState(update, "key string, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def append_new(ledger_path: str, ids: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the rows whose ids the ledger doesn't have yet, so that a batch that is run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(ids)
        try:
            new = new.join(spark.read.parquet(ledger_path).select(*ids), ids, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(ledger_path)

    return write


def to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).start()
