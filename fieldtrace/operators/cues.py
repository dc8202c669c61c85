"""Evidence within frames and between identities: positions, neighbours, slots, spans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deepest(people: DataFrame, least: int = 4, gap: int = 150) -> DataFrame:
    """Per frame of at least ``least`` people the one nearest each goal line, when the second
    is clearly farther from it."""
    left = Window.partitionBy("frame_idx").orderBy("x_m", "ord")
    right = Window.partitionBy("frame_idx").orderBy(F.desc("x_m"), "ord")
    p = people.withColumns({"l": F.row_number().over(left), "r": F.row_number().over(right), "n": F.count(F.lit(1)).over(Window.partitionBy("frame_idx"))})
    at = lambda side, k, c: F.max(F.when(F.col(side) == k, F.col(c)))
    g = p.where((F.col("n") >= least) & ((F.col("l") <= 2) | (F.col("r") <= 2))).groupBy("frame_idx").agg(
        at("l", 1, "id").alias("left_id"), (at("l", 2, "x_m") - at("l", 1, "x_m")).alias("left_gap"), at("r", 1, "id").alias("right_id"), (at("r", 1, "x_m") - at("r", 2, "x_m")).alias("right_gap")
    )
    clear = lambda s: F.when(F.col(f"{s}_gap") >= gap, F.col(f"{s}_id")).alias(f"{s}_id")
    return g.select("frame_idx", clear("left"), clear("right"))


def defended_side(people: DataFrame) -> DataFrame:
    """Votes of the two deepest people of each side: their team, when they agree."""
    both = None
    for side, order in (("left", F.col("x_m")), ("right", F.desc("x_m"))):
        turn = F.row_number().over(Window.partitionBy("frame_idx").orderBy(order, "ord"))
        top = people.withColumn("turn", turn).where("turn <= 2").groupBy("frame_idx").agg(F.min("team").alias("a"), F.max("team").alias("b"), F.count(F.lit(1)).alias("n"))
        votes = top.where("n = 2 and a = b").select(F.lit(side).alias("side"), F.col("a").alias("team"))
        both = votes if both is None else both.unionByName(votes)
    return both.groupBy("side", "team").agg(F.count(F.lit(1)).alias("votes"))


def from_team(people: DataFrame, least: int = 3) -> DataFrame:
    """Distance of each person to the mean of the other members of the team in the frame."""
    w = Window.partitionBy("frame_idx", "team")
    p = people.withColumns({"n": F.count(F.lit(1)).over(w) - 1, "sx": F.sum("x_m").over(w) - F.col("x_m"), "sy": F.sum("y_m").over(w) - F.col("y_m")})
    dx, dy = F.col("x_m") * F.col("n") - F.col("sx"), F.col("y_m") * F.col("n") - F.col("sy")
    return p.where(F.col("n") >= least).select("frame_idx", "ord", "n", (F.sqrt((dx * dx + dy * dy).cast("double")) / F.col("n")).alias("apart"))


def together(people: DataFrame) -> DataFrame:
    """Pairs of identities that a frame shows at once, with the number of such frames."""
    p = people.select("frame_idx", "team", "user_id").distinct()
    a, b = p.select("frame_idx", F.col("team"), F.col("user_id").alias("a")), p.select("frame_idx", "team", F.col("user_id").alias("b"))
    return a.join(b, ["frame_idx", "team"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("frames"))


def slot_holder(people: DataFrame) -> DataFrame:
    """The goalkeeper of each team: visible last, then seen last."""
    k = people.where("role = 'GOALKEEPER'").groupBy("team", "user_id").agg(F.max("t_us").alias("last_seen"), F.max_by("state", F.struct("t_us", "ord")).alias("state"))
    turn = F.row_number().over(Window.partitionBy("team").orderBy(F.desc(F.col("state") == "confirmed"), F.desc("last_seen"), "user_id"))
    return k.withColumn("turn", turn).where("turn = 1").drop("turn")


def crowds(people: DataFrame, reach: int, least: int) -> DataFrame:
    """People with at least ``least`` others of the frame within reach, by grid cells of that size."""
    p = people.select("frame_idx", "ord", "x_m", "y_m", F.floor(F.col("x_m") / reach).alias("cx"), F.floor(F.col("y_m") / reach).alias("cy"))
    q = p.select("frame_idx", F.col("ord").alias("o"), F.col("x_m").alias("x"), F.col("y_m").alias("y"), F.explode(F.expr("transform(array(-1, 0, 1), k -> cx + k)")).alias("cx"), "cy")
    q = q.select("frame_idx", "o", "x", "y", "cx", F.explode(F.expr("transform(array(-1, 0, 1), k -> cy + k)")).alias("cy"))
    j = p.join(q, ["frame_idx", "cx", "cy"]).where((F.col("ord") != F.col("o")) & (F.abs(F.col("x_m") - F.col("x")) <= reach) & (F.abs(F.col("y_m") - F.col("y")) <= reach))
    return j.groupBy("frame_idx", "ord").agg(F.count(F.lit(1)).alias("near")).where(F.col("near") >= least)


def mean_vectors(vectors: DataFrame) -> DataFrame:
    """Element-wise mean of the vectors of each identity."""
    e = vectors.select("id", F.posexplode("q").alias("k", "v"))
    g = e.groupBy("id", "k").agg((F.sum("v") / F.count(F.lit(1))).alias("m"))
    return g.select("id", F.col("k").cast("long").alias("k"), "m")


def velocity(people: DataFrame, gate_us: int = 1_500_000) -> DataFrame:
    """Running velocity 0.6 old + 0.4 new, in order; gaps beyond the gate leave it as it is.

    The sightings of an identity stream by in order with the last one and its velocity
    carried along; no identity is held whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, t0, x0, v = None, 0, 0, 0.0
        for batch in batches:
            done = []
            for k, t, x in zip(batch["id"], batch["t_us"].tolist(), batch["x_m"].tolist(), strict=True):
                if k != own:
                    if own is not None:
                        done.append((own, v))
                    own, v = k, 0.0
                elif 1000 < t - t0 <= gate_us:
                    v = 0.6 * v + 0.4 * ((x - x0) / (t - t0) * 1_000_000)
                t0, x0 = t, x
            yield pd.DataFrame(done, columns=["id", "velocity"])
        yield pd.DataFrame([(own, v)] if own is not None else [], columns=["id", "velocity"])

    rows = people.where("id is not null").select("id", "t_us", "x_m", "ord").repartition("id").sortWithinPartitions("id", "t_us", "ord")
    return rows.mapInPandas(run, "id string, velocity double").withColumn("velocity", F.round("velocity", 6))


def overlapping(points: DataFrame, segments: DataFrame, slack: int, width: int) -> DataFrame:
    """Segments [from_us, to_us] of its video that each point touches, with slack; buckets make it an equi-join."""
    s = segments.withColumn("b", F.explode(F.sequence(F.floor((F.col("from_us") - slack) / width), F.floor((F.col("to_us") + slack) / width))))
    p = points.withColumn("b", F.floor(F.col("t_us") / width))
    return p.join(s, ["video", "b"]).where((F.col("from_us") <= F.col("t_us") + slack) & (F.col("to_us") >= F.col("t_us") - slack)).drop("b")


def sighting_around(fragments: DataFrame, sightings: DataFrame) -> DataFrame:
    """The last sighting of an identity before a fragment and the first one after it."""
    f = fragments.select("id", "frag", F.col("t0").alias("t_us"), F.lit(1).alias("side")).unionByName(fragments.select("id", "frag", F.col("t1").alias("t_us"), F.lit(2).alias("side")))
    s = sightings.select("id", F.lit(None).cast("long").alias("frag"), "t_us", F.lit(0).alias("side"))
    seen = F.when(F.col("side") == 0, F.col("t_us"))
    w = Window.partitionBy("id").orderBy("t_us")
    both = f.unionByName(s).withColumns({
        "before": F.last(seen, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -1)),
        "after": F.first(seen, ignorenulls=True).over(w.rangeBetween(1, Window.unboundedFollowing)),
    })
    return both.where("side > 0").groupBy("id", "frag").agg(F.max(F.when(F.col("side") == 1, F.col("before"))).alias("before_us"), F.max(F.when(F.col("side") == 2, F.col("after"))).alias("after_us"))


def apart_spans(spans: DataFrame) -> DataFrame:
    """Pairs of identities of a team whose spans do not meet: candidates for one person."""
    a = spans.select("team", F.col("user_id").alias("a"), F.col("t0").alias("a0"), F.col("t1").alias("a1"))
    b = spans.select("team", F.col("user_id").alias("b"), F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    j = a.join(b, "team").where("a < b")
    return j.where("a1 < b0 or b1 < a0").select("team", "a", "b", F.greatest(F.col("b0") - F.col("a1"), F.col("a0") - F.col("b1")).alias("gap_us"))


def tiles(frames: DataFrame, size: int, stride: int) -> DataFrame:
    """Tiles that cover each frame: every stride, and one flush with the far end."""
    along = lambda c: F.array_distinct(F.concat(F.when(F.col(c) > size, F.sequence(F.lit(0).cast("long"), F.col(c) - size, F.lit(stride).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))), F.array(F.greatest(F.lit(0).cast("long"), F.col(c) - size))))
    return frames.select("key", F.explode(along("width")).alias("x"), "height").select("key", "x", F.explode(along("height")).alias("y"))
