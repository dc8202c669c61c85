"""Player analytics over samples: coverage, occupancy, averages, trails."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .samples import LENGTH, WIDTH, squared_step, track

BLOCK_US = 300_000_000


def clamp_range(spans: DataFrame, t0: int, t1: int) -> DataFrame:
    """(id, a, b): the asked range cut to each identity's first and last time; (a, a) if empty."""
    a = F.least(F.greatest(F.lit(t0).cast("long"), F.col("start")), F.col("end"))
    b = F.least(F.greatest(F.lit(t1).cast("long"), F.col("start")), F.col("end"))
    return spans.select("id", a.alias("a"), F.greatest(a, b).alias("b"))


def in_range(samples: DataFrame, t0: int, t1: int) -> DataFrame:
    """Samples in the range, both ends included; runs and weights are those of the whole track."""
    return samples.where(F.col("t_us").between(t0, t1))


def coverage(samples: DataFrame, t0: int, t1: int) -> DataFrame:
    """seconds (half microseconds, at most the interval), share, samples, low."""
    seconds = F.least(F.sum("w"), F.lit(2 * (t1 - t0)))
    g = in_range(samples, t0, t1).groupBy("id").agg(seconds.alias("half_us"), F.count(F.lit(1)).alias("samples"))
    share = F.col("half_us") / F.lit(2 * (t1 - t0))
    return g.select("id", "half_us", share.alias("share"), "samples", (share < 0.5).alias("low"))


def heat_cells(samples: DataFrame, metres: int = 1) -> DataFrame:
    """Observed time per cell of the pitch grid; positions just outside go to the border cells."""
    nx, ny = math.ceil(LENGTH / metres), math.ceil(WIDTH / metres)
    cell = lambda v, size, n: F.least(F.greatest((F.col(v) * size / (1000 * metres)).cast("int"), F.lit(0)), F.lit(n - 1))
    return samples.groupBy("id", cell("x_m", LENGTH, nx).alias("cx"), cell("y_m", WIDTH, ny).alias("cy")).agg(F.sum("w").alias("half_us"))


def kernel(sigma: float) -> list[tuple[int, int]]:
    """Gaussian taps in millionths, out to three sigmas."""
    radius = math.ceil(3 * sigma)
    taps = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [(k - radius, round(1e6 * t / sum(taps))) for k, t in enumerate(taps)]


def heat_blur(cells: DataFrame, sigma: float, metres: int = 1) -> DataFrame:
    """Separable blur of the grid, zero outside; mass is kept by total / kept per identity.

    Values are integers in units of half_us * 1e12; the two passes are joins with the
    taps, a literal table of a few rows.
    """
    spark = cells.sparkSession
    nx, ny = math.ceil(LENGTH / metres), math.ceil(WIDTH / metres)
    taps = F.broadcast(spark.createDataFrame(kernel(sigma), "step int, tap long"))
    one = cells.crossJoin(taps).select("id", (F.col("cx") + F.col("step")).alias("cx"), "cy", (F.floor(F.col("half_us") / 1000) * F.col("tap")).alias("v")).where(F.col("cx").between(0, nx - 1))
    one = one.groupBy("id", "cx", "cy").agg(F.sum("v").alias("v"))
    two = one.crossJoin(taps).select("id", "cx", (F.col("cy") + F.col("step")).alias("cy"), (F.floor(F.col("v") / 1_000_000) * F.col("tap")).alias("v")).where(F.col("cy").between(0, ny - 1))
    two = two.groupBy("id", "cx", "cy").agg(F.sum("v").alias("v"))
    total = cells.groupBy("id").agg(F.sum("half_us").alias("total"))
    left = two.groupBy("id").agg(F.sum("v").alias("kept"))
    return two.join(total, "id").join(left, "id").select("id", "cx", "cy", (F.col("v") * (F.col("total") / F.col("kept"))).alias("half_us"))


def averages(samples: DataFrame) -> DataFrame:
    """Time-weighted mean position of each identity with samples."""
    return samples.groupBy("id").agg(
        (F.sum(F.col("x_m") * F.col("w")) / F.sum("w")).alias("x"), (F.sum(F.col("y_m") * F.col("w")) / F.sum("w")).alias("y"), F.first("team").alias("team"), F.first("role").alias("role")
    )


def trail_breaks(samples: DataFrame) -> DataFrame:
    """Where the trail of an identity is broken: from, to, length and why."""
    prev = F.lag("t_us").over(track())
    return samples.select("id", prev.alias("from_us"), F.col("t_us").alias("to_us"), (F.col("t_us") - prev).alias("gap_us"), "why").where("why <> ''")


def trail_summary(samples: DataFrame) -> DataFrame:
    """segments, breaks, unseen time and metres (in tenths of millimetres) walked inside segments."""
    return trail_steps(samples).groupBy("id").agg(*trail_sums())


def trail_steps(samples: DataFrame) -> DataFrame:
    """Adds step: tenths of millimetres from the sample before in the same segment."""
    prev = {c: F.lag(c).over(Window.partitionBy("id", "run").orderBy("t_us", "ord")) for c in ("x_m", "y_m")}
    step = F.sqrt(squared_step(F.col("x_m"), F.col("y_m"), prev["x_m"], prev["y_m"]).cast("double"))
    return samples.withColumn("step", F.coalesce(F.floor(step * 10).cast("long"), F.lit(0).cast("long")))


def trail_sums() -> list[Column]:
    """What is summed over a trail; runs count from the first sample on without holes."""
    return [
        (F.max("run") - F.min("run") + 1).alias("segments"),
        F.sum(F.when(F.col("why") != "", 1).otherwise(0)).alias("breaks"),
        F.sum(F.when(F.col("why") == "unseen", F.col("dt")).otherwise(0)).alias("unseen_us"),
        F.sum("step").alias("tenth_mm"),
    ]


def identity_report(samples: DataFrame, t0: int, t1: int) -> DataFrame:
    """Coverage, average position and trail of every identity seen in the range: one grouping by identity.

    Samples come partitioned by identity from their windows, so the grouping needs no shuffle.
    """
    s = trail_steps(samples)
    inside = F.col("t_us").between(t0, t1)
    w = F.when(inside, F.col("w"))
    g = s.groupBy("id").agg(
        F.sum(w).alias("w"), F.sum(F.col("x_m") * w).alias("wx"), F.sum(F.col("y_m") * w).alias("wy"), F.count(w).alias("samples"), F.first("team").alias("team"), F.first("role").alias("role"), *trail_sums()
    ).where("samples > 0")
    half = F.least(F.col("w"), F.lit(2 * (t1 - t0)))
    share = half / (2 * (t1 - t0))
    return g.select(
        "id", half.cast("long").alias("half_us"), share.alias("share"), "samples", (share < 0.5).alias("low"), (F.col("wx") / F.col("w")).alias("x"), (F.col("wy") / F.col("w")).alias("y"), "team", "role",
        "segments", "breaks", "unseen_us", "tenth_mm",
    )


def current_block(times: DataFrame) -> DataFrame:
    """The five-minute block that holds each time."""
    block = F.floor(F.greatest(F.lit(0), F.col("t_us")) / BLOCK_US)
    return times.withColumns({"block": block, "block_start": block * BLOCK_US, "block_end": (block + 1) * BLOCK_US})


def duplicates(obs: DataFrame) -> DataFrame:
    """Identities that a frame holds more than once at a valid position."""
    near = F.col("x_m").between(-100, 1100) & F.col("y_m").between(-100, 1100)
    return obs.where(near).groupBy("frame_idx", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
