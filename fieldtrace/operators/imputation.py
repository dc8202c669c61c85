"""Estimates of hidden players: carried motion, the movement of the team, learned role offsets.

Cells are (id, team, step) of a grid in seconds, with x and y in metres where the identity was
seen.  Everything but one recursion is windows and groupings; the exponentially weighted offset
of an identity streams by in order of time with its state carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .edits import settled

#: Seconds and metres that the estimates must share with recorded results; fixed values.
TAU_FORMATION, MIN_OFFSET_SECONDS, MIN_VOTERS, FIRST_VOTERS, PASSES = 30.0, 10.0, 4, 7, 3
TAU_SHIFT, SHIFT_RATE, CV_RATE = 2.0, 0.8, 1.8
INTERPOLATE, MAX_SIGMA, MAX_GAP, CENTRE_FLOOR, DEFAULT_SIGMA = 1.0, 15.0, 25.0, 1.0, 1.5
VELOCITY_WINDOW = 1


def velocities(seen: DataFrame, window: int = VELOCITY_WINDOW) -> DataFrame:
    """Speed at each observation (id, step, x, y) from the farthest one within the window before it, and after it."""
    w = Window.partitionBy("id").orderBy("step")
    here = F.struct("step", "x", "y")
    far = {"back": F.first(here).over(w.rangeBetween(-window, 0)), "ahead": F.last(here).over(w.rangeBetween(0, window))}
    s = seen.withColumns(far)
    rate = lambda side, c: F.when(F.col(f"{side}.step") == F.col("step"), F.lit(0.0)).otherwise((F.col(c) - F.col(f"{side}.{c}")) / (F.col("step") - F.col(f"{side}.step")))
    return s.select("id", "step", *(rate(side, c).alias(f"{side}_{c}") for side in ("back", "ahead") for c in "xy"))


def first_centres(cells: DataFrame, voters: int = FIRST_VOTERS) -> DataFrame:
    """Mean of the seen members of a team where most of it is in view: (team, step, cx, cy, var)."""
    g = cells.where("x is not null").groupBy("team", "step").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy")).where(F.col("n") >= voters)
    return g.select("team", "step", "cx", "cy", F.lit(CENTRE_FLOOR**2).alias("var"))


def role_offsets(cells: DataFrame, centres: DataFrame, tau: float = TAU_FORMATION, least: float = MIN_OFFSET_SECONDS) -> DataFrame:
    """(id, team, step, x, y, sigma, ox, oy, ovar): the running offset of each identity from the centre
    of its team, once it has been seen for long enough."""
    rows = cells.join(centres.select("team", "step", "cx", "cy"), ["team", "step"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, ox, oy, var, seen, last = None, 0.0, 0.0, 25.0, 0.0, None
        for batch in batches:
            out = []
            for k, t, x, y, cx, cy in zip(*(batch[c].tolist() for c in ("id", "step", "x", "y", "cx", "cy")), strict=True):
                if k != own:
                    own, last = k, None
                if x == x and cx == cx:  # both are known
                    rx, ry = x - cx, y - cy
                    if last is None:
                        ox, oy, var, seen = rx, ry, 25.0, 0.0
                    else:
                        a = 1 - math.exp(-(t - last) / tau)
                        ox, oy = ox + a * (rx - ox), oy + a * (ry - oy)
                        var = (1 - a) * var + a * ((rx - ox) ** 2 + (ry - oy) ** 2) / 2
                        seen += t - last
                    last = t
                out.append((ox, oy, max(var, 1.0)) if last is not None and seen >= least else (None, None, None))
            batch[["ox", "oy", "ovar"]] = pd.DataFrame(out, columns=["ox", "oy", "ovar"], index=batch.index, dtype=float)
            yield batch

    rows = rows.select("id", "team", "step", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "sigma", "cx", "cy")
    rows = rows.repartition("id").sortWithinPartitions("id", "step")
    return rows.mapInPandas(run, "id string, team string, step long, x double, y double, sigma double, cx double, cy double, ox double, oy double, ovar double").drop("cx", "cy").replace(float("nan"), None)


def voted_centres(offsets: DataFrame, least: int = MIN_VOTERS) -> DataFrame:
    """Team centre of each step by the votes of seen members with an offset, weighted by certainty."""
    sigma = F.coalesce("sigma", F.lit(DEFAULT_SIGMA))
    w = 1 / (F.col("ovar") + sigma * sigma)
    v = offsets.where("x is not null and ox is not null").withColumn("w", w)
    g = v.groupBy("team", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"), F.sum((F.col("x") - F.col("ox")) * F.col("w")).alias("sx"), F.sum((F.col("y") - F.col("oy")) * F.col("w")).alias("sy"))
    g = g.where(F.col("n") >= least)
    return g.select("team", "step", (F.col("sx") / F.col("weight")).alias("cx"), (F.col("sy") / F.col("weight")).alias("cy"), F.greatest(F.lit(CENTRE_FLOOR**2), 1 / F.col("weight")).alias("var"))


def learned_centres(cells: DataFrame, passes: int = PASSES, first: int = FIRST_VOTERS, least: int = MIN_VOTERS) -> DataFrame:
    """Centres after so many passes from offsets to centres and back, so that the bias of the view cancels."""
    centres = first_centres(cells, first)
    for _ in range(passes):
        centres = settled(voted_centres(role_offsets(cells, centres), least))
    return centres


def one_sided(cells: DataFrame, centres: DataFrame, forward: bool = True) -> DataFrame:
    """Estimates of each cell from the nearest observation on one side: held, and shifted with the team.

    (id, step, age, held_x, held_y, held_s, shift_x, shift_y, shift_s); the observation itself at age 0.
    The team's movement comes in gradually; without a centre at both ends the position is held.
    """
    order = F.col("step") if forward else F.desc("step")
    w = Window.partitionBy("id").orderBy(order)
    c = cells.join(centres.select("team", "step", "cx", "cy", "var"), ["team", "step"], "left")
    sigma = F.coalesce("sigma", F.lit(DEFAULT_SIGMA))
    seen = F.when(F.col("x").isNotNull(), F.struct("step", "x", "y", sigma.alias("s"), "cx", "cy", "var"))
    c = c.withColumn("p", F.last(seen, ignorenulls=True).over(w))
    age = F.abs(F.col("step") - F.col("p.step")).cast("double")
    c = c.withColumn("age", age).where(F.col("p").isNotNull() & (F.col("age") <= MAX_GAP))
    ramp = 1 - F.exp(-F.col("age") / TAU_SHIFT)
    moves = F.col("p.cx").isNotNull() & F.col("cx").isNotNull()
    held = F.sqrt(F.col("p.s") * F.col("p.s") + CV_RATE**2 * F.col("age") * F.col("age"))
    shifted = F.sqrt(F.col("p.s") * F.col("p.s") + ramp * (F.col("var") + F.col("p.var")) + SHIFT_RATE**2 * F.col("age") * F.col("age"))
    at = lambda k: F.when(moves, F.col(f"p.{k}") + ramp * (F.col(f"c{k}") - F.col(f"p.c{k}"))).otherwise(F.col(f"p.{k}"))
    return c.select(
        "id", "step", "age", F.col("p.x").cast("double").alias("held_x"), F.col("p.y").cast("double").alias("held_y"), held.alias("held_s"),
        at("x").cast("double").alias("shift_x"), at("y").cast("double").alias("shift_y"), F.when(F.col("age") == 0, F.col("p.s")).when(moves, shifted).otherwise(held).alias("shift_s"),
    )


def estimated(cells: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, step, kind, x, y, sigma, age) of every cell: O observed, I over a short gap, P predicted, U unknown.

    Between two observations the held positions are blended by age; with one side only the
    shifted one counts.  A prediction that is too uncertain or too old is unknown.
    """
    f, b = (one_sided(cells, centres, side).select("id", "step", *(F.col(c).alias(f"{name}_{c}") for c in ("age", "held_x", "held_y", "held_s", "shift_x", "shift_y", "shift_s"))) for side, name in ((True, "f"), (False, "b")))
    j = cells.join(f, ["id", "step"], "left").join(b, ["id", "step"], "left")
    fa, ba = F.col("f_age"), F.col("b_age")
    both = fa.isNotNull() & ba.isNotNull()
    gap = fa + ba
    u = F.when(gap > 0, fa / gap).otherwise(0.5)
    blend = lambda c: (1 - u) * F.col(f"f_held_{c}") + u * F.col(f"b_held_{c}")
    spread = F.sqrt(((1 - u) * F.col("f_held_s")) * ((1 - u) * F.col("f_held_s")) + (u * F.col("b_held_s")) * (u * F.col("b_held_s")))
    side = lambda c: F.coalesce(f"f_shift_{c}", f"b_shift_{c}")
    known = F.col("x").isNotNull()
    pick = lambda own, two, one: F.when(known, own).when(both, two).otherwise(one)
    sigma = pick(F.coalesce("sigma", F.lit(DEFAULT_SIGMA)), spread + F.when(gap <= INTERPOLATE, 0.5 * F.sqrt(gap)).otherwise(0.0), side("s"))
    kind = F.when(known, "O").when(both & (gap <= INTERPOLATE), "I").when(fa.isNotNull() | ba.isNotNull(), "P").otherwise("U")
    age = F.when(known, F.lit(0.0)).otherwise(F.least(fa, ba))
    e = j.select("id", "step", kind.alias("kind"), pick(F.col("x").cast("double"), blend("x"), side("x")).alias("x"), pick(F.col("y").cast("double"), blend("y"), side("y")).alias("y"), sigma.alias("sigma"), age.alias("age"))
    lost = (F.col("kind") == "U") | ((F.col("kind") == "P") & ((F.col("sigma") > MAX_SIGMA) | (F.col("age") > MAX_GAP)))
    none: Column = F.lit(None).cast("double")
    return e.select("id", "step", F.when(lost, "U").otherwise(F.col("kind")).alias("kind"), *(F.when(lost, none).otherwise(F.col(c)).alias(c) for c in ("x", "y", "sigma", "age")))
