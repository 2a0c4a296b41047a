"""Structured Streaming: event-time windows, deduplication, count batches, runs, endless sources, several sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as they come; files_per_trigger bounds a micro-batch."""
    r = spark.readStream.format(kind).schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)


def const_stream(spark: SparkSession, item, rate: int = 100) -> DataFrame:
    """An endless stream of one value."""
    return spark.readStream.format("rate").option("rowsPerSecond", rate).load().select((F.col("value") + 1).alias("_pos"), F.lit(item).alias("value"))


def _watermark(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    """Streams get a watermark, for which a time without a zone is taken as the session's."""
    if not (delay and df.isStreaming):
        return df
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(df: DataFrame, ts: str, length: str, aggs: Sequence[Column], by: Sequence[str] = (), delay: str | None = None) -> DataFrame:
    """Aggregates of windows side by side: start, end, keys, aggregates.  Works on batch and streaming tables."""
    g = _watermark(df, ts, delay).groupBy(F.window(ts, length).alias("w"), *by).agg(*aggs)
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in g.columns if c != "w"])


def sliding(df: DataFrame, ts: str, length: str, slide: str, aggs: Sequence[Column], by: Sequence[str] = (), delay: str | None = None) -> DataFrame:
    """Aggregates of overlapping windows."""
    g = _watermark(df, ts, delay).groupBy(F.window(ts, length, slide).alias("w"), *by).agg(*aggs)
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in g.columns if c != "w"])


def sessions(df: DataFrame, ts: str, gap: str, aggs: Sequence[Column], by: Sequence[str] = (), delay: str | None = None) -> DataFrame:
    """Aggregates of sessions, which end after a gap."""
    g = _watermark(df, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*aggs)
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in g.columns if c != "w"])


def deduplicated(df: DataFrame, keys: Sequence[str], ts: str | None = None, delay: str | None = None) -> DataFrame:
    """One row for each key; on streams within the watermark."""
    if df.isStreaming and ts and delay:
        return _watermark(df, ts, delay).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))


def running_mean(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """mean, dev, n so far; for output modes complete and update."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("dev"), F.count(value).alias("n"))


def count_batches(df: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """Lists of `size` values by key as rows arrive (key, _batch, items); what is left over when the query ends isn't given.

    Rows of a micro-batch are taken in the given order.
    """
    kind = dict(df.dtypes)[value]
    key_kind = dict(df.dtypes)[key]

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, kept = state.get if state.exists else (0, [])
        kept = list(kept)
        pdf = pd.concat(list(pdfs)).sort_values(order)
        kept += pdf[value].tolist()
        rows = []
        while len(kept) >= size:
            rows.append((k[0], number, kept[:size]))
            kept, number = kept[size:], number + 1
        state.update((number, kept))
        if rows:
            yield pd.DataFrame(rows, columns=[key, "_batch", "items"])

    return df.groupBy(key).applyInPandasWithState(run, f"{key} {key_kind}, _batch bigint, items array<{kind}>", f"number bigint, kept array<{kind}>", "append", GroupStateTimeout.NoTimeout)


def stream_join(left: DataFrame, right: DataFrame, on: Column, left_ts: str, right_ts: str, delay: str, how: str = "inner") -> DataFrame:
    """Join of two streams; the condition should bound the difference of their times."""
    return _watermark(left, left_ts, delay).join(_watermark(right, right_ts, delay), on, how)


def fan_out(df: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None]):
    """A query that gives each micro-batch, computed once, to several sinks."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for s in sinks:
                s(batch, epoch)
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a streaming source has now, worked off to an in-memory table; for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
