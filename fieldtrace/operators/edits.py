"""Merges, edit logs and histories: the latest word wins, and merges follow their chain."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The last row of each key."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("turn", turn).where("turn = 1").drop("turn")


def valid_history(points: DataFrame, edits: DataFrame, slack_us: int = 125_000) -> DataFrame:
    """Points that no later edit invalidates.

    An edit (player or '*', generation, t_us) invalidates experimental points of an
    older generation from a little before its time on.  The earliest such edit per
    player and generation decides, so the theta join is an equi-join on both.
    """
    gens = points.select(F.col("generation").alias("old")).distinct()  # generations are few
    early = edits.groupBy("player", F.col("generation").alias("g")).agg(F.min("t_us").alias("t0"))
    reach = early.join(F.broadcast(gens), F.col("g") > F.col("old")).groupBy("player", "old").agg((F.min("t0") - slack_us).alias("from_us"))
    own = reach.where("player <> '*'")
    every = F.broadcast(reach.where("player = '*'").select(F.col("old").alias("all_old"), F.col("from_us").alias("all_from")))
    j = points.join(own, (F.col("id") == F.col("player")) & (F.col("generation") == F.col("old")), "left").join(every, F.col("generation") == F.col("all_old"), "left")
    dead = F.col("experimental") & (F.col("t_us") >= F.least("from_us", "all_from"))
    return j.where(~F.coalesce(dead, F.lit(False))).drop("player", "old", "from_us", "all_old", "all_from")


def merged_points(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key: the later row wins, but an experimental one never replaces another kind."""
    both = old.withColumn("source", F.lit(0)).unionByName(new.withColumn("source", F.lit(1)))
    return latest(both, keys, F.col("experimental").cast("int"), F.desc("source"), F.desc("ord"))


def interval_replaced(old: DataFrame, new: DataFrame, start: int, end: int) -> DataFrame:
    """Keeps old rows that are confirmed or outside the interval, and adds new ones inside."""
    stays = old.where((F.col("state") == "confirmed") | ~F.col("t_us").between(start, end))
    return stays.unionByName(new.where(F.col("t_us").between(start, end)))


def resolved(merges: DataFrame) -> DataFrame:
    """(id, root): where the chain of merges of each id ends; ``merges`` has id and into.

    Pointer doubling: a chain of n merges takes log2(n) joins, whatever their number.  A
    chain that leads back to itself has no end and is an error: it is the only one longer
    than there are merges.
    """
    m = merges.select("id", F.col("into").alias("root"))
    for _ in range(merges.count().bit_length() + 1):
        hop = m.select(F.col("id").alias("root"), F.col("root").alias("far"))
        m = settled(m.join(hop, "root", "left").select("id", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if m.where("moved").isEmpty():
            return m.select("id", "root")
        m = m.select("id", "root")
    raise ValueError("resolved: a chain of merges leads back to itself")


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the folder of ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def replayed(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """``rows`` with each id replaced by the one that its chain of merges ends at."""
    return rows.join(resolved(merges), "id", "left").withColumn("id", F.coalesce("root", "id")).drop("root")


def alternating(galleries: DataFrame, size: int = 6) -> DataFrame:
    """The newest of each of two sources in turn, ``size`` in all; rows have target, source, t_us."""
    turn = F.row_number().over(Window.partitionBy("target", "source").orderBy(F.desc("t_us"), "ord"))
    place = F.row_number().over(Window.partitionBy("target").orderBy("turn", "source"))
    return galleries.withColumn("turn", turn).withColumn("place", place).where(F.col("place") <= size)


def backfilled(rows: DataFrame, within_us: int = 12_000_000) -> DataFrame:
    """Unidentified rows of a track take the next identity bound to it within the time."""
    w = Window.partitionBy("track").orderBy("t_us").rangeBetween(0, within_us)
    return rows.withColumn("filled", F.coalesce("bound", F.first("bound", ignorenulls=True).over(w)))


def throttled(rows: DataFrame, key: str, every: int) -> DataFrame:
    """The rows of a key that are at least ``every`` after the last one let through.

    Which row passes depends on all before it, so the rows of a key stream by in order of
    time with the one time carried along; no key is held whole, and keys run in parallel.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last = object(), 0
        for batch in batches:
            passed = []
            for k, t in zip(batch[key], batch["t_us"].tolist(), strict=True):
                same = k == own or (k != k and own != own)  # a null number comes as NaN; null keys are one key
                good = not same or t - last >= every
                if good:
                    own, last = k, t
                passed.append(good)
            yield batch[passed]

    r = rows.select(key, "t_us", "ord").repartition(key).sortWithinPartitions(key, "t_us", "ord")
    return r.mapInPandas(run, r.schema)
