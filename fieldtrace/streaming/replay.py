"""Structured Streaming versions of the order-dependent operators.

Each takes a streaming DataFrame of observations (id, ord, ts timestamp, t_us) and gives
a streaming DataFrame; state is per key and bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.adapter import SLOWDOWN, real_us


def observation_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events as they arrive in a folder of Parquet files."""
    schema = spark.read.parquet(path).schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return e.select(F.col("event_id").alias("ord"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.floor(real_us() / SLOWDOWN).alias("t_us"), F.col("event_type").alias("kind"))


def throttled(stream: DataFrame, every_us: int) -> DataFrame:
    """Rows of an id at least ``every_us`` after the last one let through; state: that time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["t_us", "ord"])
        keep = []
        for k, t in enumerate(rows["t_us"]):
            if last is None or t - last >= every_us:
                keep.append(k)
                last = int(t)
        if last is not None:
            state.update((last,))
        yield rows.iloc[keep][["id", "t_us", "ord"]]

    return stream.select("id", "t_us", "ord").groupBy("id").applyInPandasWithState(step, "id string, t_us long, ord long", "last long", "append", GroupStateTimeout.NoTimeout)


def in_order(stream: DataFrame) -> DataFrame:
    """Drops rows of an id that are not later than one seen before (each batch in order of arrival)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ord")
        keep = []
        for k, t in enumerate(rows["t_us"]):
            if last is None or t > last:
                keep.append(k)
                last = int(t)
        state.update((last,))
        yield rows.iloc[keep][["id", "t_us", "ord"]]

    return stream.select("id", "t_us", "ord").groupBy("id").applyInPandasWithState(step, "id string, t_us long, ord long", "last long", "append", GroupStateTimeout.NoTimeout)


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Gap sessions of an id in event time; a session closes when the watermark passes it."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy("id", w.alias("session")).agg(F.count(F.lit(1)).alias("n")).select("id", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def blocks(stream: DataFrame, length: str, late: str) -> DataFrame:
    """Counts by kind in tumbling windows of event time."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def replay(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there, batch by batch, into ``sink``."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
