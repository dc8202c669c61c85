"""Comparison of runs, evaluation against known people, matches with a clear lead, galleries kept over time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_count(values: DataFrame, keys: list[str], value: str, at: dict[str, Column]) -> DataFrame:
    """Values at given ranks (columns of n) of each key, by counts of distinct values; with n and total."""
    c = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("times"))
    w = Window.partitionBy(*keys)
    c = c.withColumns({"upto": F.sum("times").over(w.orderBy(value)), "n": F.sum("times").over(w)})
    picks = [F.min(F.when(F.col("upto") >= rank, F.col(value))).alias(name) for name, rank in at.items()]
    return c.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(F.col(value) * F.col("times")).alias("total"), F.max(value).alias("most"), *picks)


def clear_best(pairs: DataFrame, keys: list[str], cost: str, slack: int) -> DataFrame:
    """The cheapest candidate of each key, unless the next costs less than twice as much and ``slack``."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(cost, "name"))
    top = pairs.withColumn("turn", turn).where("turn <= 2")
    at = lambda k, c: F.max(F.when(F.col("turn") == k, F.col(c)))
    g = top.groupBy(*keys).agg(at(1, "name").alias("name"), at(1, cost).alias("first"), at(2, cost).alias("second"))
    return g.where(F.col("second").isNull() | (F.col("second") >= 2 * F.col("first") + slack))


def kept_galleries(rows: DataFrame, apart: int, alike: float, size: int = 5) -> DataFrame:
    """Samples (id, t, vec_id, unit vector v) that enter the gallery of their identity as they stream by:
    ``apart`` after the last that entered, unlike all in it; the first stays and the second goes when it is full."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, held, last = None, [], None
        for batch in batches:
            enters = []
            for k, t, v in zip(batch["id"], batch["t"], batch["v"], strict=True):
                if k != own:
                    own, held, last = k, [], None
                ok = (last is None or t - last >= apart) and all(float(np.dot(v, h)) <= alike for h in held)
                if ok:
                    held, last = held + [np.asarray(v)], t
                    if len(held) > size:
                        held.pop(1)
                enters.append(ok)
            yield batch[enters][["id", "t", "vec_id"]]

    r = rows.select("id", "t", "vec_id", "v").repartition("id").sortWithinPartitions("id", "t", "vec_id")
    return r.mapInPandas(run, "id long, t long, vec_id long")


def corner_homography(x: list[Column], y: list[Column]) -> list[Column]:
    """Nine columns of the homography that takes the unit square, corner by corner around, to four points."""
    dx1, dx2, sx = x[1] - x[2], x[3] - x[2], x[0] - x[1] + x[2] - x[3]
    dy1, dy2, sy = y[1] - y[2], y[3] - y[2], y[0] - y[1] + y[2] - y[3]
    full = dx1 * dy2 - dx2 * dy1
    g, h = (sx * dy2 - dx2 * sy) / full, (dx1 * sy - sx * dy1) / full
    return [x[1] - x[0] + g * x[1], x[3] - x[0] + h * x[3], x[0], y[1] - y[0] + g * y[1], y[3] - y[0] + h * y[3], y[0], g, h, F.lit(1.0)]
