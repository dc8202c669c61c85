"""From observations to the samples of each identity: validity, breaks, runs, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNSEEN_US = 1_000_000
SPEED, JUMP_METRES = 12, 2
SMOOTH_US = 70_000
CAP_US, STEP_US = 500_000, 40_000
LENGTH, WIDTH = 105, 68


def track() -> Window:
    """The samples of an identity in order of time."""
    return Window.partitionBy("id").orderBy("t_us", "ord")



def reason(identity: int = 30, pitch: int = 50, margin: int = 20) -> Column:
    """The first test that an observation fails, or 'kept'; a missing confidence counts as 0."""
    inside = F.col("x_m").between(-margin, 1000 + margin) & F.col("y_m").between(-margin, 1000 + margin)
    return (
        F.when(~F.col("in_roster"), "notInRoster")
        .when(~F.col("state").eqNullSafe("confirmed"), "notConfirmed")
        .when(F.coalesce("identity_conf", F.lit(0)) < identity, "lowIdentityConfidence")
        .when(~F.coalesce(inside, F.lit(False)), "offPitch")
        .when(F.coalesce("pitch_conf", F.lit(0)) < pitch, "lowPitchConfidence")
        .when(F.col("clipped"), "clipped")
        .otherwise("kept")
    )


def kept(obs: DataFrame, pitch: int = 50) -> DataFrame:
    """Valid observations, the first of an identity in each frame."""
    first = F.row_number().over(Window.partitionBy("frame_idx", "id").orderBy("ord"))
    good = obs.where(F.col("id").isNotNull()).where(reason(pitch=pitch) == "kept")
    return good.withColumn("turn", first).where("turn = 1").drop("turn")


def exclusions(obs: DataFrame) -> DataFrame:
    """Observations per reason; every observation with an identity is counted once."""
    return obs.where(F.col("id").isNotNull()).groupBy(reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def squared_step(x: Column, y: Column, x0: Column, y0: Column) -> Column:
    """Squared distance in millionths of a square metre, from thousandths of the pitch."""
    dx, dy = (x - x0) * LENGTH, (y - y0) * WIDTH
    return dx * dx + dy * dy


def with_breaks(samples: DataFrame) -> DataFrame:
    """Adds dt, square (of the step) and why: '', 'unseen' or 'jump' against the sample before."""
    before = {c: F.lag(c).over(track()) for c in ("t_us", "x_m", "y_m")}
    s = samples.withColumns({"dt": F.col("t_us") - before["t_us"], "square": squared_step(F.col("x_m"), F.col("y_m"), before["x_m"], before["y_m"])})
    dt, square = F.col("dt"), F.col("square")
    jump = (dt > 0) & (square * 1_000_000 > SPEED * SPEED * dt * dt) & (square >= JUMP_METRES * JUMP_METRES * 1_000_000)
    return s.withColumn("why", F.when(dt > UNSEEN_US, "unseen").when(jump, "jump").otherwise(""))


def with_runs(breaks: DataFrame) -> DataFrame:
    """Adds run: how many breaks an identity had up to and with this sample."""
    return breaks.withColumn("run", F.sum(F.when(F.col("why") != "", 1).otherwise(0)).over(track()))


def smoothed(runs: DataFrame) -> DataFrame:
    """Adds sum_x, sum_y and near: the samples of the run within the smoothing time."""
    w = Window.partitionBy("id", "run").orderBy("t_us").rangeBetween(-SMOOTH_US, SMOOTH_US)
    return runs.withColumns({"sum_x": F.sum("x_m").over(w), "sum_y": F.sum("y_m").over(w), "near": F.count(F.lit(1)).over(w)})


def with_weights(samples: DataFrame) -> DataFrame:
    """Adds w in half microseconds: capped half gaps to both neighbours, half a frame at the ends."""
    back = F.col("t_us") - F.lag("t_us").over(track())
    ahead = F.lead("t_us").over(track()) - F.col("t_us")
    one = lambda gap: F.when(gap.isNull(), F.lit(STEP_US)).otherwise(F.least(gap, F.lit(CAP_US)))
    return samples.withColumn("w", one(back) + one(ahead))


def samples(obs: DataFrame, pitch: int = 50) -> DataFrame:
    """Kept observations with breaks, runs and weights: one window shuffle by identity."""
    return with_weights(with_runs(with_breaks(kept(obs, pitch))))
