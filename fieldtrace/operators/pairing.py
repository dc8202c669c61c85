"""Joins of rows of one frame, team or track: suppression, association, candidates, nearest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as fv


def uncovered(extra: DataFrame, people: DataFrame, most: float) -> DataFrame:
    """Extra boxes of a frame that no box of a person covers: none has an IoU of ``most`` or more."""
    p = people.select("frame_idx", *(F.col(c).alias(f"p_{c}") for c in ("bx", "by", "bw", "bh")))
    e = extra.select("frame_idx", "ord", *(F.col(c).alias(f"e_{c}") for c in ("bx", "by", "bw", "bh")))
    hit = e.join(p, "frame_idx").where(fv.iou("e_", "p_") >= most).select("ord").distinct()
    return extra.join(hit, "ord", "left_anti")


def associated(tracks: DataFrame, found: DataFrame, dearest: float = 0.83, lead: float = 0.12, gate: int = 75) -> DataFrame:
    """Tracks and detections of a frame that are each other's only clear choice.

    Cost is distance by the gate and missing overlap; a track takes its cheapest detection if
    that is cheap and clearly ahead of the next, and if no other track's cheapest is the same.
    """
    side = lambda df, p: df.select("frame_idx", F.col("ord").alias(f"{p}ord"), *(F.col(c).alias(f"{p}{c}") for c in ("bx", "by", "bw", "bh")))
    j = side(tracks, "a_").join(side(found, "b_"), "frame_idx")
    dx, dy = (2 * F.col(f"b_b{p}") + F.col(f"b_b{s}") - 2 * F.col(f"a_b{p}") - F.col(f"a_b{s}") for p, s in (("x", "w"), ("y", "h")))
    distance = F.sqrt((dx * dx + dy * dy).cast("double")) / 2
    big, small = F.col("b_bw") * F.col("b_bh"), F.col("a_bw") * F.col("a_bh")
    cost = distance / gate * 0.65 + (1 - fv.iou("a_", "b_")) * 0.35
    j = j.where((distance <= gate) & (big * 10 >= small * 3) & (big * 10 <= small * 33)).select("frame_idx", "a_ord", "b_ord", cost.alias("cost"))
    w = Window.partitionBy("frame_idx", "a_ord").orderBy("cost", "b_ord")
    best = j.withColumns({"turn": F.row_number().over(w), "next": F.lead("cost").over(w)}).where("turn = 1")
    rivals = F.count(F.lit(1)).over(Window.partitionBy("frame_idx", "b_ord"))
    best = best.withColumn("rivals", rivals)
    clear = F.col("next").isNull() | (F.col("next") - F.col("cost") >= lead)
    return best.where((F.col("cost") <= dearest) & clear & (F.col("rivals") == 1)).select("frame_idx", "a_ord", "b_ord", "cost")


def fragment_candidates(fragments: DataFrame, members: DataFrame, seen: DataFrame, slack_us: int = 50_000) -> DataFrame:
    """Identities of the team of a fragment (frag, team, t0, t1) that are not seen during it.

    The first sighting from the beginning on decides: sightings and asked beginnings of an
    identity meet in one union and one window, so there is no range join.
    """
    c = fragments.join(members.select("team", "id"), "team")
    asked = c.select("id", (F.col("t0") - slack_us).alias("t_us"), F.lit(0).alias("side"), "frag", "t1")
    rows = asked.unionByName(seen.select("id", "t_us", F.lit(1).alias("side")), allowMissingColumns=True)
    w = Window.partitionBy("id").orderBy("t_us", "side").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("then", F.first(F.when(F.col("side") == 1, F.col("t_us")), ignorenulls=True).over(w)).where("side = 0")
    free = F.coalesce(F.col("then") > F.col("t1") + slack_us, F.lit(True))
    return rows.where(free).select("frag", "id")


def nearest_person(points: DataFrame, people: DataFrame, reach: int) -> DataFrame:
    """The person of the frame nearest to each point, within reach both ways."""
    p = people.select("frame_idx", F.col("ord").alias("person"), F.col("x_m").alias("px"), F.col("y_m").alias("py"))
    j = points.select("frame_idx", "ord", "x_m", "y_m").join(p, "frame_idx").where((F.col("ord") != F.col("person")) & (F.abs(F.col("px") - F.col("x_m")) <= reach) & (F.abs(F.col("py") - F.col("y_m")) <= reach))
    dx, dy = (F.col("px") - F.col("x_m")) * 105, (F.col("py") - F.col("y_m")) * 68
    j = j.withColumn("square", dx * dx + dy * dy)
    return j.groupBy("frame_idx", "ord").agg(F.min(F.struct("square", "person")).alias("m"), F.count(F.lit(1)).alias("within")).select("frame_idx", "ord", "m.person", "m.square", "within")


def knn_mean(pairs: DataFrame, keys: list[str], value: str, k: int = 3) -> DataFrame:
    """Mean of the ``k`` smallest values of each key."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return pairs.withColumn("turn", turn).where(F.col("turn") <= k).groupBy(*keys).agg((F.sum(value) / F.count(F.lit(1))).alias("mean"))


def kit_suggestions(distances: DataFrame, most: float = 0.22, gap: float = 0.12) -> DataFrame:
    """Side of each candidate (vec_id, side, distance to an example), where the nearer one is near and clearly nearer."""
    g = distances.groupBy("vec_id").agg(F.min(F.when(F.col("side") == "A", F.col("distance"))).alias("a"), F.min(F.when(F.col("side") == "B", F.col("distance"))).alias("b"))
    near = F.least("a", "b")
    return g.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (near <= most) & (F.abs(F.col("a") - F.col("b")) >= gap)).select("vec_id", F.when(F.col("a") < F.col("b"), "A").otherwise("B").alias("side"), near.alias("distance"))


def reid_candidates(pairs: DataFrame) -> DataFrame:
    """Confidence and rejection of each candidate: trajectory before displacement, then the first of
    state, team, role and appearance that objects.

    ``pairs`` has appearance, jersey, gap_s, same_team, both_teams, same_role, gone, metres (null
    without positions) and moved (null without a steady camera).
    """
    c, clamp = F.col, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    seconds = F.greatest(F.lit(0.2), c("gap_s"))
    spatial = F.when(c("metres").isNull(), 0.5).otherwise(clamp(1 - c("metres") / (13 * seconds + 8)))
    steady = c("moved").isNotNull() & (c("gap_s") <= 2)
    path = F.when(steady, clamp(1 - c("moved") / (0.04 + c("gap_s") * 0.1))).otherwise(0.5)
    reason = (
        F.when(steady & (c("gap_s") < 1) & (c("moved") > 0.1 + c("gap_s") * 0.15), "trajectory")
        .when(c("metres") > 13 * seconds + 4, "displacement")
        .when(c("gone"), "substituted")
        .when(c("both_teams") & ~c("same_team"), "team")
        .when(~c("same_role"), "role")
        .when(c("appearance") < F.when(c("gap_s") > 120, 0.88).otherwise(0.82), "appearance")
        .otherwise("")
    )
    sure = clamp(0.76 * c("appearance") + 0.1 * c("jersey") + 0.06 * spatial + 0.03 * path + 0.05 * F.when(c("same_team"), 1.0).otherwise(0.5))
    return pairs.select("vec_id", "candidate", sure.alias("confidence"), reason.alias("reason"))


def unlike(a: Column, b: Column) -> Column:
    """How unlike two appearance histograms are; a quarter where one is empty."""
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * F.coalesce(y, F.lit(0.0)))), F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 1 - shared).otherwise(0.25)


def remaining_player(unlabelled: DataFrame, labelled: DataFrame, candidates: DataFrame, own: int = 10, others: int = 3, most: float = 0.2, gap: float = 0.12) -> DataFrame:
    """(video, team, id, ord): the one player of a team without a label, and the one detection that can only be them.

    ``unlabelled`` has (video, team, id), ``labelled`` (video, team, ord, appearance), ``candidates`` (video, ord, score, appearance).  A team asks if
    exactly one is left, ``own`` of it and at least ``others`` of the rest are known.  A detection of 0.5 or more fits if the mean of its
    three smallest distances to the team is under ``most`` and by more than ``gap`` under that to the rest; two that fit are none.
    """
    left = unlabelled.groupBy("video", "team").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    known = labelled.where("size(appearance) > 0")
    sizes = known.groupBy("video").agg(F.count(F.lit(1)).alias("all")).join(known.groupBy("video", "team").agg(F.count(F.lit(1)).alias("own")), "video")
    asks = left.join(sizes, ["video", "team"]).where((F.col("own") == own) & (F.col("all") - F.col("own") >= others)).select("video", "team", "id")
    c = candidates.where("score >= 0.5 and size(appearance) > 0").select("video", "ord", F.col("appearance").alias("seen"))
    j = asks.join(c, "video").join(known.select("video", F.col("team").alias("of"), "appearance"), "video").withColumn("side", F.when(F.col("of") == F.col("team"), 0).otherwise(1))
    j = knn_mean(j.withColumn("d", unlike(F.col("seen"), F.col("appearance"))), ["video", "team", "id", "ord", "side"], "d")
    at = lambda k: F.max(F.when(F.col("side") == k, F.col("mean")))
    fits = j.groupBy("video", "team", "id", "ord").agg(at(0).alias("near"), at(1).alias("far")).where((F.col("near") < most) & (F.col("far") - F.col("near") > gap))
    return fits.groupBy("video", "team", "id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord")).where("n = 1").drop("n")
