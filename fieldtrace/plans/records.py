"""Queries of evaluation, of tracks from frame to frame, of lenses and stored descriptors, with DuckDB SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import optics, truth
from ..sources.adapter import VIDEO_FRAMES, observations, table
from ..streaming import tracks
from .balls import FRAME_US, HEIGHT, WIDTH


def annotated(s, d) -> DataFrame:
    """Every second event is annotated: who is where; some are referees or spectators."""
    o = observations(s, d).where("ord % 2 = 0")
    role = F.when(F.col("user_id") % 25 == 7, "REFEREE").when(F.col("user_id") % 25 == 9, "SPECTATOR").when(F.col("user_id") % 2 == 0, "PLAYER_TEAM_A").otherwise("PLAYER_TEAM_B")
    return o.select(F.col("video").alias("run"), "t_us", "ord", "id", role.alias("truth_role"), (F.col("x_m") * 1.0).alias("bx"), (F.col("y_m") * 1.0).alias("by"), F.lit(40.0).alias("bw"), F.lit(100.0).alias("bh"), (F.col("ord") % 10 != 4).alias("visible")).withColumnRenamed("id", "truth_id")


def predicted(s, d) -> DataFrame:
    """Predictions of the annotated places, a few milliseconds and pixels off, with gaps, and identities that change hands."""
    a = annotated(s, d)
    o = a.join(observations(s, d).select("ord", "track", "user_id", "identity_conf"), "ord").where("ord % 14 <> 6")
    swapped = F.when(F.col("ord") % 22 == 4, F.concat(F.lit("U"), (F.col("user_id") + 2).cast("string"))).otherwise(F.col("truth_id"))
    return o.select(
        "run", (F.col("t_us") + F.col("ord") % 5 * 10_000).alias("t_us"), "ord", F.col("track").alias("local_id"), F.when(F.col("ord") % 26 != 8, swapped).alias("global_id"), F.when(F.col("truth_role") == "SPECTATOR", "UNKNOWN").otherwise("PLAYER_TEAM_A").alias("role"),
        (F.col("identity_conf") / 100).alias("confidence"), (F.col("ord") % 34 == 2).alias("uncertain"), (F.col("bx") + F.col("ord") % 7).alias("bx"), (F.col("by") + F.col("ord") % 11).alias("by"), "bw", "bh",
    )


def _matches(s, d):
    return truth.matched(annotated(s, d), predicted(s, d))


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 9) for c in names})


def _returns(s, d):
    """Every tenth prediction stands for an accepted return of its identity."""
    found = predicted(s, d)
    events = found.where("ord % 20 = 0 and global_id is not null").select("run", "t_us", "local_id", "global_id")
    return truth.returns(_matches(s, d), events, found)


def detections(s, d) -> DataFrame:
    """Rows of frames: the first event of a user in a video marks them, the others are detections; a purchase is a cut."""
    o = observations(s, d)
    first = o.groupBy("user_id").agg(F.min(F.struct("frame_idx", "ord")).alias("f")).select("user_id", F.col("f.ord").alias("first"))
    f = F.col("frame_idx") - F.col("video") * VIDEO_FRAMES
    none = F.lit(None)
    return o.join(first, "user_id").select(
        "video", (f * FRAME_US).alias("t_us"), "ord", F.when(F.col("ord") == F.col("first"), F.col("id")).alias("seed"), F.lit("person").alias("kind"), (F.col("user_id") * 37 % 100 / 105 + F.col("ord") % 5 / 1000).alias("bx"), (F.col("user_id") * 53 % 100 / 110 + F.col("ord") % 3 / 1000).alias("by"),
        F.lit(0.02).alias("bw"), F.lit(0.06).alias("bh"), (F.col("identity_conf") / 100).alias("score"), F.array(*(F.when(F.col("user_id") % 4 == k, 1.0).otherwise(0.0) for k in range(4))).alias("appearance"), none.cast("array<double>").alias("embedding"),
        none.cast("double").alias("quality"), (F.col("ord") % 97 == 5).alias("cut"), F.lit(False).alias("reliable"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"),
    )


def _tracks(s, d):
    return _rounded(tracks.tracked(detections(s, d)), "bx", "by", "bw", "bh", "score")


def _markings(s, d):
    """Points of four lines across the picture, 120 frames at a time, bent by a lens of the video's own."""
    o = observations(s, d).where("not clipped")
    f = F.floor((F.col("frame_idx") - F.col("video") * VIDEO_FRAMES) / 120)
    line = F.col("ord") % 4
    x, y = (F.col("ord") * 7919 % 1200 + 40).cast("double"), (60 + line * 190 + (F.col("ord") * 7919 % 1200) / 24).cast("double")
    o = o.select(F.col("video").alias("video"), f.alias("frame_idx"), line.alias("line"), (x - WIDTH / 2).alias("dx"), (y - HEIGHT / 2).alias("dy"))
    k = (F.col("video") % 5 - 2) / 10
    grow = F.lit(1.0)
    for _ in range(8):  # the lens undoes itself by fixed-point steps
        grow = 1 + k * (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * grow * grow / ((WIDTH * WIDTH + HEIGHT * HEIGHT) / 4)
        o = o.withColumn("grow", grow)
        grow = F.col("grow")
    return o.select("video", "frame_idx", "line", (WIDTH / 2 + F.col("dx") * F.col("grow")).alias("x"), (HEIGHT / 2 + F.col("dy") * F.col("grow")).alias("y"))


def _lenses(s, d):
    return optics.video_lenses(optics.frame_lenses(_markings(s, d), WIDTH, HEIGHT))


def _codec(s, d):
    """Vectors as descriptors, written to text and read again: what half precision leaves of each."""
    e = table(s, d, "embeddings").where("embedding is not null")
    part = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: (k * F.col("vec_id") % 97 / 97).cast("double"))
    rows = e.select(F.col("vec_id").alias("ord"), (F.col("vec_id") % 10 / 10).cast("double").alias("quality"), part(24).alias("jersey"), part(F.when(F.col("vec_id") % 50 == 3, 11).otherwise(12)).alias("shorts"), part(8).alias("socks"), part(12).alias("layout"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    back = optics.decoded(optics.encoded(rows), 4).withColumnRenamed("embedding", "back")
    dot = F.aggregate(F.zip_with("embedding", "back", lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v)
    long = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("ord", "embedding").join(back, "ord").select("ord", F.col("jersey").isNotNull().alias("whole"), F.size("back").alias("n"), F.round(dot / long, 4).alias("cosine"))


QUERIES = {
    "truth_evaluation": lambda s, d: _rounded(truth.evaluated(_matches(s, d)), "coverage", "confidence"),
    "truth_people": lambda s, d: _rounded(truth.per_person(_matches(s, d)), "coverage", "confidence"),
    "truth_returns": _returns,
    "persistent_tracks": _tracks,
    "video_lenses": _lenses,
    "descriptor_codec": _codec,
}

ORACLE_SQL = {
    "descriptor_codec": "select vec_id as ord, vec_id % 50 <> 3 as whole, case when vec_id % 50 <> 3 then len(embedding) end as n, case when vec_id % 50 <> 3 then 1.0 end as cosine from embeddings where embedding is not null",
}
