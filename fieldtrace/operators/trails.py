"""Trails, sections and fragments: neighbours in time, runs of conditions, cuts along a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .samples import squared_step


def _by(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("t_us", "ord")


def own_speed(points: DataFrame, within_us: int) -> DataFrame:
    """Metres a second at each sighting, between the nearest earlier and later ones within the time."""
    w = _by("id")
    here = F.struct("t_us", "x_m", "y_m")
    back, ahead = F.lag(here).over(w), F.lead(here).over(w)
    p = points.withColumns({"here": here, "back": back, "ahead": ahead})
    a = F.when(F.col("t_us") - F.col("back.t_us") <= within_us, F.col("back")).otherwise(F.col("here"))
    b = F.when(F.col("ahead.t_us") - F.col("t_us") <= within_us, F.col("ahead")).otherwise(F.col("here"))
    p = p.select("id", "ord", a.alias("a"), b.alias("b")).where("b.t_us > a.t_us")
    metres = F.sqrt(squared_step(F.col("b.x_m"), F.col("b.y_m"), F.col("a.x_m"), F.col("a.y_m")).cast("double")) / 1000
    return p.select("id", "ord", (metres / F.greatest(F.lit(0.001), (F.col("b.t_us") - F.col("a.t_us")) / 1e6)).alias("speed"))


def attached(points: DataFrame, short_us: int, long_us: int, reach: int) -> DataFrame:
    """Sightings whose predecessors of the last while all lie within reach of them, with how many
    older ones do.  Rows of an identity meet those of its neighbouring time buckets only."""
    p = points.select("id", "ord", "t_us", "x_m", "y_m", F.floor(F.col("t_us") / long_us).alias("b"))
    q = points.select("id", F.col("t_us").alias("t"), F.col("x_m").alias("x"), F.col("y_m").alias("y"), F.explode(F.array(F.floor(F.col("t_us") / long_us), F.floor(F.col("t_us") / long_us) + 1)).alias("b"))
    j = p.join(q, ["id", "b"]).where((F.col("t") < F.col("t_us")) & (F.col("t") >= F.col("t_us") - long_us))
    recent = F.col("t") >= F.col("t_us") - short_us
    still = (F.abs(F.col("x") - F.col("x_m")) <= reach) & (F.abs(F.col("y") - F.col("y_m")) <= reach)
    n = lambda c: F.count(F.when(c, 1))
    g = j.groupBy("id", "ord").agg(n(recent).alias("recent"), n(recent & still).alias("still"), n(~recent & still).alias("older"))
    return g.where("recent >= 1 and still = recent").select("id", "ord", "recent", "older")


def runs_of(rows: DataFrame, new: Column, key: str, name: str) -> DataFrame:
    """Adds ``name``: how many rows of the key up to this one begin a run."""
    return rows.withColumn("_new", F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).withColumn(name, F.sum("_new").over(_by(key))).drop("_new")


def sections(points: DataFrame, near_us: int, far_us: int) -> DataFrame:
    """Sections of a video: points at most ``near_us`` apart, or ``far_us`` while their kind goes on."""
    gap = F.col("t_us") - F.lag("t_us").over(_by("video"))
    goes_on = (gap <= near_us) | ((gap <= far_us) & (F.col("kind") == F.lag("kind").over(_by("video"))))
    s = runs_of(points, ~goes_on, "video", "section")
    return s.groupBy("video", "section").agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count(F.lit(1)).alias("n")).drop("section")


def trail(points: DataFrame, now_us: int, span_us: int, gap_us: int, least: int = 30) -> DataFrame:
    """Drawn segments of the last ``span_us``: doubtful points and gaps break them, a stale trail is
    empty, and a segment has two points at least."""
    p = points.where(F.col("t_us").between(now_us - span_us, now_us))
    p = p.withColumn("last_us", F.max("t_us").over(Window.partitionBy("id"))).where(F.col("last_us") >= now_us - gap_us)
    ok = (F.col("state") == "confirmed") & (F.col("identity_conf") >= least)
    gap = F.coalesce(F.col("t_us") - F.lag("t_us").over(_by("id")) > gap_us, F.lit(False))
    s = runs_of(p.withColumn("ok", ok), ~ok | gap, "id", "segment").where("ok")
    g = s.groupBy("id", "segment").agg(F.count(F.lit(1)).alias("points"), F.min("t_us").alias("from_us"), F.max("t_us").alias("to_us"))
    return g.where("points > 1")


def confirmed_after(points: DataFrame, hit: str, times: int) -> DataFrame:
    """Per identity when a condition first held so many times in a row, and how often it did so."""
    p = points.withColumn("hit", F.expr(hit))
    p = p.withColumn("island", F.row_number().over(_by("id")) - F.row_number().over(_by("id", "hit")))
    p = p.withColumn("run", F.row_number().over(_by("id", "hit", "island")))
    return p.where((F.col("run") == times) & F.col("hit")).groupBy("id").agg(F.min("t_us").alias("first_us"), F.count(F.lit(1)).alias("times"))


def label_segments(points: DataFrame, cut: str) -> DataFrame:
    """Fragments of each track: cut where its label changes and where a cut (``cut``, or a purchase) falls."""
    is_cut = F.col(cut) if cut in points.columns else F.col("kind") == "purchase"
    p = points.withColumn("segment", F.sum(F.when(is_cut, 1).otherwise(0)).over(_by("track")))
    w = _by("track")
    same = F.col("state").eqNullSafe(F.lag("state").over(w)) & F.col("segment").eqNullSafe(F.lag("segment").over(w))
    f = runs_of(p, ~same, "track", "frag")
    return f.groupBy("track", "frag").agg(F.first("state").alias("label"), F.first("segment").alias("segment"), F.min("t_us").alias("t0"), F.max("t_us").alias("t1"), F.count(F.lit(1)).alias("n"))


def scene_changes(cuts: DataFrame, within_us: int, tracks: int) -> DataFrame:
    """Cuts (video, track, t_us, ord) that so many tracks of the video make within the time: a change of
    scene, no swap.  Buckets of the time make it an equi-join."""
    a = cuts.select("video", "track", "ord", "t_us", F.floor(F.col("t_us") / within_us).alias("b"))
    b = cuts.select("video", F.col("track").alias("other"), F.col("t_us").alias("t"), F.explode(F.expr(f"transform(array(-1, 0, 1), k -> floor(t_us / {within_us}) + k)")).alias("b"))
    j = a.join(b, ["video", "b"]).where(F.abs(F.col("t") - F.col("t_us")) <= within_us)
    return j.groupBy("video", "track", "ord").agg(F.count_distinct("other").alias("tracks")).where(F.col("tracks") >= tracks)


def neighbours(fragments: DataFrame, within_us: int) -> DataFrame:
    """The fragments before and after on the same track and segment, at most so far away."""
    w = Window.partitionBy("track").orderBy("t0", "frag")
    back, ahead = F.lag(F.struct("frag", "t1", "segment")).over(w), F.lead(F.struct("frag", "t0", "segment")).over(w)
    f = fragments.withColumns({"back": back, "ahead": ahead})
    before = F.when((F.col("back.segment") == F.col("segment")) & (F.col("t0") - F.col("back.t1") <= within_us), F.col("back.frag"))
    after = F.when((F.col("ahead.segment") == F.col("segment")) & (F.col("ahead.t0") - F.col("t1") <= within_us), F.col("ahead.frag"))
    return f.select("track", "frag", before.alias("before"), after.alias("after")).where("before is not null or after is not null")
