"""The observation model, derived from the driver's tables.

All positions and times are integers: t_us in microseconds of video time, x_m and y_m
in thousandths of the pitch, confidences in hundredths.  Sums of integers do not depend
on the order of rows, so any partitioning gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Real microseconds in one of video time.
SLOWDOWN = 40_000
FRAME_US = 3_600_000_000
#: People of one video, and frame numbers that a video has for itself: frames, teams and runs of
#: one video are never those of another, so what a key holds does not grow with the tables.
VIDEO_PEOPLE, VIDEO_FRAMES = 25, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def real_us() -> Column:
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: who was seen where and when, and how sure that is."""
    e, u, us = F.col("event_id"), F.col("user_id"), real_us()
    video = F.floor(u / VIDEO_PEOPLE)
    return table(spark, sf_dir, "events").select(
        e.alias("ord"),
        u.alias("user_id"),
        F.concat(F.lit("U"), u.cast("string")).alias("id"),
        F.floor(us / SLOWDOWN).alias("t_us"),
        video.alias("video"),
        (video * VIDEO_FRAMES + F.floor(us / FRAME_US)).alias("frame_idx"),
        ((u * 37) % 100 * 10 + (e * 7919) % 121 - 60).alias("x_m"),
        ((u * 53) % 100 * 10 + (e * 104729) % 121 - 60).alias("y_m"),
        F.when(F.col("event_type") == "error", "uncertain").otherwise("confirmed").alias("state"),
        ((e * 17) % 100).alias("identity_conf"),
        ((e * 31) % 100).alias("pitch_conf"),
        (e % 23 == 0).alias("clipped"),
        F.concat(F.when(u % 2 == 0, "A").otherwise("B"), video.cast("string")).alias("team"),
        F.when(u % 25 == 1, "GOALKEEPER").otherwise("PLAYER").alias("role"),
        (u % 20 != 0).alias("in_roster"),
        (u * 10 + F.floor(us / (SLOWDOWN * 10_000_000))).alias("track"),
        F.col("event_type").alias("kind"),
        F.col("value"),
        F.col("props"),
    )


#: The same model as DuckDB SQL: a common table expression named obs.
OBS_SQL = """obs as (
  select event_id as ord, user_id, concat('U', user_id) as id, us // 40000 as t_us, user_id // 25 as video, user_id // 25 * 1000000 + us // 3600000000 as frame_idx,
    (user_id * 37) % 100 * 10 + (event_id * 7919) % 121 - 60 as x_m, (user_id * 53) % 100 * 10 + (event_id * 104729) % 121 - 60 as y_m,
    case when event_type = 'error' then 'uncertain' else 'confirmed' end as state, (event_id * 17) % 100 as identity_conf,
    (event_id * 31) % 100 as pitch_conf, event_id % 23 = 0 as clipped, concat(case when user_id % 2 = 0 then 'A' else 'B' end, user_id // 25) as team,
    case when user_id % 25 = 1 then 'GOALKEEPER' else 'PLAYER' end as role, user_id % 20 <> 0 as in_roster,
    user_id * 10 + us // 400000000000 as track, event_type as kind, value, props
  from (select *, epoch_us(ts) - epoch_us(timestamp '2024-01-01') as us from events)
)"""
