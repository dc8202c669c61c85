"""Track and identity summaries: rosters, fragments, participation, labels, visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def track_summary(obs: DataFrame) -> DataFrame:
    """First, last and number of observations of each local track, and how many by state."""
    per = obs.groupBy("track", "state").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))
    states = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "state", F.col("n").cast("string")))), ",")
    return per.groupBy("track").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n"), states.alias("states"))


def roster_observations(obs: DataFrame) -> DataFrame:
    """Frames and tracks of each identity, with its first and last time."""
    return obs.groupBy("id").agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count_distinct("frame_idx").alias("frames"), F.count_distinct("track").alias("tracks"))


def fragments(obs: DataFrame) -> DataFrame:
    """Gaps and islands: consecutive frames in which an identity was uncertain."""
    u = obs.where("state = 'uncertain'").select("user_id", "frame_idx").distinct()
    island = F.col("frame_idx") - F.row_number().over(Window.partitionBy("user_id").orderBy("frame_idx"))
    return u.withColumn("island", island).groupBy("user_id", "island").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count(F.lit(1)).alias("frames")).drop("island")


def roster_status(obs: DataFrame, cap: int, last_frame_share: float = 0.9) -> DataFrame:
    """Per team: identities, those still seen late in their video, and how many are over the cap."""
    end = obs.groupBy("video").agg(F.min("frame_idx").alias("start"), F.max("frame_idx").alias("end"))
    per = obs.where("in_roster").groupBy("video", "team", "id").agg(F.max("frame_idx").alias("last")).join(end, "video")
    late = (F.col("last") - F.col("start")) * 100 >= (F.col("end") - F.col("start")) * int(last_frame_share * 100)
    g = per.groupBy("team").agg(F.count(F.lit(1)).alias("identities"), F.count(F.when(late, 1)).alias("active"))
    return g.withColumn("over_cap", F.greatest(F.lit(0).cast("long"), F.col("identities") - cap))


def participation(obs: DataFrame) -> DataFrame:
    """Frames of each identity, frames near an edge of the pitch, and the most team mates in view."""
    x, y = F.col("x_m"), F.col("y_m")
    edge = (x < 40) | (x > 960) | (y < 40) | (y > 960)
    per = obs.groupBy("frame_idx", "team", "id").agg(F.max(F.when(edge, 1).otherwise(0)).alias("edge"))
    per = per.withColumn("mates", F.count(F.lit(1)).over(Window.partitionBy("frame_idx", "team")))
    j = per.groupBy("id").agg(F.count(F.lit(1)).alias("frames"), F.sum("edge").alias("edge_frames"), F.max("mates").alias("most_mates"))
    return j.withColumn("edge_share", F.col("edge_frames") / F.col("frames"))


def labels(obs: DataFrame, slots: int = 10) -> DataFrame:
    """Numbers without gaps for the identities of a team: most frames first, in steps of two,
    then by creation; beyond the slots there is only a question mark."""
    per = obs.where("in_roster").groupBy("team", "id").agg(F.count_distinct("frame_idx").alias("presence"), F.min("ord").alias("created"))
    rank = F.row_number().over(Window.partitionBy("team").orderBy(F.desc(F.floor(F.col("presence") / 2)), "created"))
    text = F.when(rank <= slots, F.concat("team", F.lit("-"), F.lpad(rank.cast("string"), 2, "0"))).otherwise(F.concat("team", F.lit("-?")))
    return per.select("team", "id", "presence", text.alias("label"))


def relabelled(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, old_label, new_label) of the identities whose label changes, comes or goes, from two results of ``labels``."""
    o, n = old.select("id", F.col("label").alias("old_label")), new.select("id", F.col("label").alias("new_label"))
    return o.join(n, "id", "full").where(~F.col("old_label").eqNullSafe(F.col("new_label")))


def shown_labels(rows: DataFrame, labels_of: DataFrame) -> DataFrame:
    """``rows`` (id, role, display, ...) with the label of each player; others, and players without one, keep their display."""
    r = rows.join(labels_of.select("id", "label"), "id", "left")
    return r.withColumn("display", F.when(F.col("role") == "PLAYER", F.coalesce("label", "display")).otherwise(F.col("display"))).drop("label").select(rows.columns)


def visibility_shares(obs: DataFrame, frames_of: DataFrame) -> DataFrame:
    """Per identity and class the number of its frames: observed (O), uncertain (S), or
    unseen in a frame in which its team was seen (U)."""
    seen = obs.groupBy("id", "team", "frame_idx").agg(F.max(F.when(F.col("state") == "confirmed", 1).otherwise(0)).alias("sure"))
    of_id = seen.groupBy("id", "team").agg(F.sum("sure").alias("O"), F.sum(1 - F.col("sure")).alias("S"))
    # Unseen frames are those of the team less the seen ones: no table of identities by frames.
    of_id = of_id.join(frames_of.groupBy("team").agg(F.count_distinct("frame_idx").alias("all")), "team").withColumn("U", F.col("all") - F.col("O") - F.col("S"))
    shares = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(c).alias("frames")) for c in "OSU"))).alias("c")
    return of_id.select("id", shares).select("id", "c.*").where("frames > 0")


def majority(votes: DataFrame, key: str, value: str, least: int = 15, percent: int = 75) -> DataFrame:
    """The winning value of each key, or null below the quorum or the share."""
    per = votes.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy(key).agg(F.sum("n").alias("total"), F.max(F.struct("n", F.col(value))).alias("top"))
    ok = (F.col("total") >= least) & (F.col("top.n") * 100 >= F.col("total") * percent)
    return g.select(key, "total", F.when(ok, F.col("top")[value]).alias("winner"))


def substitution_state(points: DataFrame, changes: DataFrame) -> DataFrame:
    """As-of: whether an identity is active at a point, by the last change up to then.

    ``changes`` has id, t_us, seq and active; without a change an identity is active.
    Both sides meet in one union and one window, so no range join is needed.
    """
    p = points.select("id", "t_us", "ord", F.lit(1).alias("side"), F.lit(None).cast("boolean").alias("active"))
    c = changes.select("id", "t_us", F.col("seq").alias("ord"), F.lit(0).alias("side"), "active")
    w = Window.partitionBy("id").orderBy("t_us", "side", "ord")
    both = p.unionByName(c).withColumn("is_active", F.coalesce(F.last("active", ignorenulls=True).over(w), F.lit(True)))
    return both.where("side = 1").select("id", "t_us", "ord", "is_active")
