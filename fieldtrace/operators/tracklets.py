"""Tracklets: where a track stops looking like itself, and which identity a fragment without one is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .edits import settled, throttled
from .matching import assignment

# Cosines across and within the sides of a cut, crops a side, seconds between cuts.
CROSS, WITHIN, SIDE, SPACED_US = 0.55, 0.6, 3, 1_000_000
# Score to accept and its lead, appearance floor, seconds; weights of what is known.
ACCEPT, LEAD, LOOKS, LEAST_US, MOTION_ONLY_S, MOST_GAP_S, ROUNDS, SLACK_US = 0.6, 0.1, 0.5, 400_000, 3.0, 10.0, 5, 50_000
WEIGHTS = {"appearance": 0.35, "spatial": 0.3, "temporal": 0.1}


def cosines(crops: DataFrame) -> DataFrame:
    """Crops (track, t_us, ord, v: unit vector or null) with c1 .. c5: cosines to the crops that many before on the track."""
    w = Window.partitionBy("track").orderBy("t_us", "ord")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return crops.withColumns({f"c{k}": dot(F.col("v"), F.lag("v", k).over(w)) for k in range(1, 2 * SIDE)})


def change_points(crops: DataFrame) -> DataFrame:
    """Crops that look unlike the ones before: (track, t_us, ord, cross), t_us halfway to the crop before.

    The mean cosine between up to three crops before and three from here on is under CROSS, and neither side has a pair
    under WITHIN.  Each pair's cosine is computed once; windows of one partitioning bring them together.
    """
    w = Window.partitionBy("track").orderBy("t_us", "ord")
    at = lambda k, ahead: F.lead(f"c{k}", ahead).over(w) if ahead > 0 else F.lag(f"c{k}", -ahead).over(w) if ahead < 0 else F.col(f"c{k}")
    across = [at(a + b, b) for b in range(SIDE) for a in range(1, SIDE + 1)]
    inside = [at(1, -1), at(1, -2), at(2, -1), at(1, 1), at(1, 2), at(2, 2)]
    c = cosines(crops).withColumns({
        "place": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("track")), "before_us": F.lag("t_us").over(w),
        "across": F.filter(F.array(*across), lambda x: x.isNotNull()), "inside": F.array_min(F.filter(F.array(*inside), lambda x: x.isNotNull())),
    })
    mean = F.when(F.size("across") > 0, F.aggregate("across", F.lit(0.0), lambda s, x: s + x) / F.size("across"))
    c = c.withColumn("cross", mean).where((F.col("place") >= 2) & (F.col("place") <= F.col("n") - 2) & (F.col("cross") < CROSS) & (F.coalesce("inside", F.lit(1.0)) >= WITHIN))
    return c.select("track", F.floor((F.col("before_us") + F.col("t_us")) / 2).alias("t_us"), "ord", "cross")


def appearance_cuts(crops: DataFrame) -> DataFrame:
    """``change_points`` more than a second after the last one kept on the track: (track, t_us, ord)."""
    return throttled(change_points(crops), "track", SPACED_US + 1)


def cut_points(points: DataFrame, cuts: DataFrame) -> DataFrame:
    """``points`` (track, t_us, ord, ...) with is_cut on the first at or after each cut (track, t_us): as-of, by union and window."""
    rows = points.withColumn("side", F.lit(1)).unionByName(cuts.select("track", "t_us", F.lit(0).alias("side")), allowMissingColumns=True)
    w = Window.partitionBy("track").orderBy("t_us", "side", "ord")
    return rows.withColumn("is_cut", F.coalesce(F.lag("side").over(w) == 0, F.lit(False))).where("side = 1").drop("side")


def scored(candidates: DataFrame, fragments: DataFrame, sightings: DataFrame, looks: DataFrame) -> DataFrame:
    """(frag, video, team, id, score, appearance) of candidates (frag, id): appearance, nearest sighting before and after, and gap.

    What is not known does not weigh.  Without appearance only gaps of a few seconds count; under the appearance floor, nothing does.
    Metres fit a gap by a bell that widens over its first two seconds; a cut of the camera in between (another ``camera``) or a long gap ends it.
    """
    f = fragments.select("frag", "video", "team", "t0", "t1", "x0", "y0", "x1", "y1", "camera0", "camera1")
    c = candidates.join(f, "frag")
    none = {"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double"), "camera": F.lit(None).cast("long")}
    asked = c.select("id", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("t0").alias("t_us")), F.struct(F.lit(2).alias("side"), F.col("t1").alias("t_us")))).alias("q"), "frag").select("id", "q.side", "q.t_us", "frag").withColumns(none)
    rows = asked.unionByName(sightings.select("id", F.lit(0).alias("side"), "t_us", "x", "y", "camera"), allowMissingColumns=True)
    seen = F.when(F.col("side") == 0, F.struct("t_us", "x", "y", "camera"))
    w = Window.partitionBy("id").orderBy("t_us").rangeBetween(Window.unboundedPreceding, -1)
    v = Window.partitionBy("id").orderBy("t_us").rangeBetween(1, Window.unboundedFollowing)
    rows = rows.withColumns({"before": F.last(seen, ignorenulls=True).over(w), "after": F.first(seen, ignorenulls=True).over(v)}).where("side > 0")
    near = rows.groupBy("frag", "id").agg(F.max(F.when(F.col("side") == 1, F.col("before"))).alias("before"), F.max(F.when(F.col("side") == 2, F.col("after"))).alias("after"))
    j = c.join(near, ["frag", "id"]).join(looks, ["frag", "id"], "left")

    def side(name: str, t: str, x: str, y: str, camera: str) -> tuple[Column, Column]:
        gap = F.abs(F.col(t) - F.col(f"{name}.t_us")) / 1e6
        sigma = 3 + 7 * F.least(gap, F.lit(2.0))
        metres = F.hypot(F.col(x) - F.col(f"{name}.x"), F.col(y) - F.col(f"{name}.y"))
        return F.when((gap <= MOST_GAP_S) & F.col(camera).eqNullSafe(F.col(f"{name}.camera")), F.exp(-0.5 * metres * metres / (sigma * sigma))), gap

    (fwd, gap_f), (bwd, gap_b) = side("before", "t0", "x0", "y0", "camera0"), side("after", "t1", "x1", "y1", "camera1")
    j = j.withColumns({"spatial": F.greatest(fwd, bwd), "gap": F.least(gap_f, gap_b)}).where("spatial is not null")
    j = j.where(F.coalesce(F.col("appearance") >= LOOKS, F.col("gap") <= MOTION_ONLY_S))
    j = j.withColumn("temporal", F.least(F.lit(1.0), F.greatest(F.lit(0.2), F.exp(-F.col("gap") / 30))))
    top = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in WEIGHTS.items()), F.lit(0.0))
    return j.select("frag", "video", "team", "id", (top / sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))).alias("score"), "appearance")


def free_identities(fragments: DataFrame, members: DataFrame, sightings: DataFrame) -> DataFrame:
    """(frag, id): identities of a fragment's video and team that were not seen during it, nor within SLACK_US of it."""
    c = fragments.select("frag", "video", "team", "t0", "t1").join(members.select("video", "team", "id"), ["video", "team"])
    asked = c.select("id", (F.col("t0") - SLACK_US).alias("t_us"), F.lit(0).alias("side"), "frag", "t1")
    rows = asked.unionByName(sightings.select("id", "t_us", F.lit(1).alias("side")), allowMissingColumns=True)
    w = Window.partitionBy("id").orderBy("t_us").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("then", F.min(F.when(F.col("side") == 1, F.col("t_us"))).over(w)).where("side = 0")
    return rows.where(F.coalesce(F.col("then") > F.col("t1") + SLACK_US, F.lit(True))).select("frag", "id")


def best_pairs(pairs: DataFrame, accept: float = ACCEPT, lead: float = LEAD) -> DataFrame:
    """(frag, id, score): pairs of the best one-to-one assignment of each team that are good and clearly ahead of every
    other of their fragment and of their identity."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        frags, ids = np.unique(rows["frag"]), np.unique(rows["id"])
        s = np.zeros((len(frags), len(ids)))
        s[np.searchsorted(frags, rows["frag"]), np.searchsorted(ids, rows["id"])] = rows["score"]
        at = np.array([(i, j) for i, j in enumerate(assignment(1 - s)) if j >= 0 and s[i, j] >= accept], int).reshape(-1, 2)
        # The best other of the row and of the column, by the two greatest of each.
        def rival(m: np.ndarray, own: np.ndarray) -> np.ndarray:
            two = np.sort(np.concatenate([m, np.zeros((len(m), 2))], axis=1), axis=1)[:, -2:]
            return np.where(own >= two[:, 1], two[:, 0], two[:, 1])

        own = s[at[:, 0], at[:, 1]]
        clear = own - np.maximum(rival(s[at[:, 0]], own), rival(s[:, at[:, 1]].T, own)) >= lead
        return pd.DataFrame({"frag": frags[at[clear, 0]], "id": ids[at[clear, 1]], "score": own[clear]})

    return pairs.groupBy("video", "team").applyInPandas(solve, "frag string, id string, score double")


def assigned_fragments(fragments: DataFrame, rows: DataFrame, members: DataFrame, sightings: DataFrame, looks: DataFrame) -> DataFrame:
    """(frag, id, score, round): identities of fragments that had none.

    ``fragments`` (frag, video, team, t0, t1, x0, y0, x1, y1, camera0, camera1: ends, in metres) and their ``rows`` (frag, t_us, x, y,
    camera); ``members`` (video, team, id); ``sightings`` (id, t_us, x, y, camera); ``looks`` (frag, id, appearance).  In a round, what is open meets the identities of
    its team that were not seen meanwhile; accepted fragments become sightings of their identity, and who was seen is
    asked anew, so no identity is ever in two places.  It ends with a round that accepts none, or after ROUNDS.
    """
    open_ = settled(fragments.where(F.col("t1") - F.col("t0") >= LEAST_US))
    found = None
    for turn in range(1, ROUNDS + 1):
        pairs = scored(free_identities(open_, members, sightings), open_, sightings, looks)
        new = settled(best_pairs(pairs).withColumn("round", F.lit(turn)))
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        if turn < ROUNDS:
            sightings = settled(sightings.select("id", "t_us", "x", "y", "camera").unionByName(rows.join(new.select("frag", "id"), "frag").select("id", "t_us", "x", "y", "camera")))
            open_ = settled(open_.join(new, "frag", "left_anti"))
    return found if found is not None else open_.select("frag", F.lit("").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("round")).where("false")
