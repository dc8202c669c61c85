"""Queries of cameras: timelines of homographies, views of the pitch, calibration, with DuckDB SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import pitch, planes, polygons
from ..operators import calibration, timeline, viewing
from ..sources.adapter import OBS_SQL, VIDEO_FRAMES, observations
from .balls import FRAME_US, HEIGHT, WIDTH, frames

#: A camera beside the pitch, by the places of the corners in its picture.
CORNERS = [((0.0, 0.0), (200.0, 150.0)), ((105.0, 0.0), (1080.0, 150.0)), ((105.0, 68.0), (1580.0, 650.0)), ((0.0, 68.0), (-300.0, 650.0))]


def _camera():
    import numpy as np

    ground, px = (np.array([c[k] for c in CORNERS]) for k in (0, 1))
    return planes.oriented(planes.solved(ground, px)[None], WIDTH, HEIGHT)[0].ravel().tolist()


def _moved(dx):
    """The camera with its picture moved by ``dx`` pixels."""
    h = _camera()
    return F.array(*(F.lit(v) + dx * F.lit(h[6 + k]) if k < 3 else F.lit(v) for k, v in enumerate(h)))


def log(s, d) -> DataFrame:
    quality = F.when(~F.col("reliable"), "none").when(F.col("frame_idx") % 90 < 20, "coarse").otherwise("flow")
    return frames(s, d).select("run", "frame_idx", "t_us", F.lit(FRAME_US).cast("long").alias("dt_us"), "m", "reliable", "cut", quality.alias("quality"))


def anchors(s, d) -> DataFrame:
    """Every 40th event is a calibration of its frame, as sure as its identity, off by a few pixels."""
    o = observations(s, d).where("ord % 40 = 7")
    f = F.col("frame_idx") - F.col("video") * VIDEO_FRAMES
    dx = F.sum((f % 7 - 3).cast("double")).over(Window.partitionBy("ord"))  # close to the pan so far, which comes back every seven frames
    return o.select(F.col("video").alias("run"), f.alias("frame_idx"), "ord", _moved(dx + F.col("ord") % 9).alias("h"), F.greatest(F.lit(0.15), F.col("identity_conf") / 100).alias("observability"), F.when(F.col("ord") % 3 == 0, "paint").otherwise("landmarks").alias("source"))


def _timeline(s, d):
    return timeline.timeline(log(s, d), anchors(s, d), WIDTH, HEIGHT)


def _holdout(s, d):
    """Each video's anchors, left out one at a time: how many others reach, and how far off they are."""
    h = timeline.held_out(log(s, d), anchors(s, d), WIDTH, HEIGHT)
    upper = lambda share: F.get(F.sort_array(F.collect_list("metres")), F.least(F.floor(F.count("metres") * share), F.count("metres") - 1).cast("int"))
    g = h.groupBy("run").agg(F.count(F.lit(1)).alias("anchors"), F.count("metres").alias("reached"), F.avg("metres").alias("mean"), upper(0.5).alias("median"), upper(0.95).alias("p95"), F.max("metres").alias("most"))
    return g.withColumns({c: F.round(c, 4) for c in ("mean", "median", "p95", "most")})


def _rounded(h):
    """Nine numbers scaled to the last, so that they can be compared."""
    return F.transform(h, lambda v: F.round(v / F.get(h, F.lit(8)), 6))


def _timeline_rows(s, d):
    return _timeline(s, d).withColumn("h", _rounded(F.col("h")))


def _propagated(s, d):
    """Every video as if only frames with their own anchor had a homography."""
    t = _timeline(s, d).select("run", "frame_idx", F.when(F.col("source").isin("paint", "landmarks"), F.col("h")).alias("h"), "confidence")
    return timeline.propagated(log(s, d).join(t, ["run", "frame_idx"]), WIDTH, HEIGHT).withColumn("h", _rounded(F.col("h")))


def _views(s, d):
    """What each frame shows of the pitch, by its homography, and how much of it."""
    t = _timeline(s, d).where("confidence >= 0.2").select("run", "frame_idx", polygons.view(F.col("h"), WIDTH, HEIGHT).alias("view")).where("view is not null")
    return t.select("run", "frame_idx", "view", F.round(polygons.area(F.col("view")), 6).alias("area"), polygons.centroid(F.col("view")).alias("centre"))


def _visibility(s, d):
    """Identities that a frame does not show: concealed, off the screen or unknown, from where they were last, by the frame's view."""
    f = F.col("frame_idx") - F.col("video") * VIDEO_FRAMES
    x, y = F.col("x_m") / 1000 * 105, F.col("y_m") / 1000 * 68
    o = observations(s, d).where("state = 'confirmed'").groupBy(F.col("video").alias("run"), f.alias("frame_idx"), "id").agg(F.max(F.struct(x.alias("x"), y.alias("y"))).alias("at"))
    v = _views(s, d).select("run", "frame_idx", F.transform("view", lambda p: p["x"] * 105).alias("vx"), F.transform("view", lambda p: p["y"] * 68).alias("vy"))
    return viewing.unseen(frames(s, d), o.select("run", "frame_idx", "id", "at.x", "at.y"), v, FRAME_US / 1e6)


def _hulls(s, d):
    """Convex hull of the people of each frame, its area, and the part of it in the left half of the pitch."""
    p = observations(s, d).groupBy("frame_idx").agg(F.collect_list(polygons.point(F.col("x_m"), F.col("y_m"))).alias("p"))
    p = p.withColumn("hull", polygons.hull(F.col("p")))
    left = polygons.clipped_to_side(F.col("hull"), polygons.point(500.0, 0.0), polygons.point(500.0, 1000.0), polygons.point(0.0, 500.0))
    return p.select("frame_idx", F.size("hull").cast("long").alias("corners"), F.round(polygons.area(F.col("hull")), 3).alias("area"), F.round(polygons.area(left), 6).alias("left_area"), F.round(polygons.centroid(F.col("hull"))["x"], 6).alias("centre_x"))


def keyframes(s, d) -> DataFrame:
    """Every user's events are clicks on landmarks of a keyframe, some of them wrong."""
    marks = pitch.landmarks(s, 105.0, 68.0)
    named = marks.withColumn("k", F.row_number().over(Window.orderBy("name")) - 1)  # 29 rows
    e = observations(s, d).groupBy("user_id", (F.col("ord") % 29).alias("k")).agg(F.min("ord").alias("ord")).join(F.broadcast(named), "k")
    h = _camera()
    x, y = geo.projected([F.lit(v) for v in h], F.col("lx"), F.col("ly"))
    wrong = (F.col("ord") % 97 == 0).cast("double") * 90
    return e.select(F.col("user_id").alias("keyframe"), "name", (x + F.col("ord") % 3 - 1 + wrong).alias("x"), (y + F.col("ord") % 5 - 2 + wrong).alias("y"), "lx", "ly")


def _calibrated(s, d):
    """A camera for each keyframe, and how certain its geometry is."""
    k = keyframes(s, d)
    solved = calibration.solved(k.drop("lx", "ly"), pitch.landmarks(s, 105.0, 68.0))
    marks = k.groupBy("keyframe").agg(F.collect_list(F.struct("name", "x", "y", "lx", "ly")).alias("all"))
    e = solved.join(marks, "keyframe").withColumn("marks", F.transform(F.filter("all", lambda m: F.array_contains("inliers", m["name"])), lambda m: F.struct(*(m[c].alias(c) for c in ("x", "y", "lx", "ly")))))
    none = {"lines": "array<string>", "circle": "array<struct<x: double, y: double>>", "rms_px": "double", "condition": "double"}
    e = e.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}).withColumns({"back": F.col("h"), "rms_m": F.col("rms")})
    o = calibration.observability(e, WIDTH, HEIGHT)
    return o.select("keyframe", F.size("inliers").alias("used"), "outliers", F.round("rms", 4).alias("rms"), "problem", F.round("score", 4).alias("score"))


def _points_scores(s, d):
    """How well the landmarks of each keyframe fix a camera, before any is solved."""
    k = keyframes(s, d).groupBy("keyframe").agg(F.collect_list(F.struct("x", "y", "lx", "ly")).alias("marks"))
    return k.select("keyframe", F.size("marks").cast("long").alias("n"), F.round(calibration.points_score(F.col("marks"), WIDTH, HEIGHT), 6).alias("score"))


def _bridged(s, d):
    """Gaps of the shown ball filled on a line: one ball a frame, the surest view or click."""
    o = observations(s, d).where("kind in ('view', 'click')")
    f = (F.col("frame_idx") - F.col("video") * VIDEO_FRAMES).alias("frame_idx")
    best = o.groupBy(F.col("video").alias("run"), f).agg(F.max(F.struct("identity_conf", "ord")).alias("c"))
    b = frames(s, d).select("run", "frame_idx", "t_us").join(best, ["run", "frame_idx"], "left")
    seen = F.col("c").isNotNull()
    b = b.select(
        "run", "frame_idx", "t_us", F.when(seen, F.when(F.col("c.ord") % 4 == 0, "MISSING").otherwise("TRACKED")).otherwise("UNKNOWN").alias("state"), F.when(seen, F.floor(F.col("frame_idx") / 100)).alias("track"),
        F.when(seen, F.col("frame_idx") * 5 % 1000 / 1000).alias("x"), F.when(seen, F.col("frame_idx") * 3 % 700 / 1000).alias("y"), (F.col("c.identity_conf") / 100).alias("confidence"),
    )
    return timeline.bridged_ball(b).drop("t_us").withColumns({c: F.round(c, 9) for c in ("x", "y")})


QUERIES = {
    "homography_timeline": _timeline_rows, "homography_propagated": _propagated, "homography_holdout": _holdout, "view_polygons": _views, "view_classes_by_frame": _visibility, "frame_hulls": _hulls, "landmark_calibration": _calibrated, "landmark_scores": _points_scores, "ball_bridged": _bridged,
}

ORACLE_SQL = {
    "ball_bridged": f"""with {OBS_SQL}, spans as (
  select video as run, unnest(range(min(frame_idx - video * {VIDEO_FRAMES}), max(frame_idx - video * {VIDEO_FRAMES}) + 1)) as frame_idx from obs group by 1
), best as (
  select video as run, frame_idx - video * {VIDEO_FRAMES} as frame_idx, arg_max(ord, (identity_conf, ord)) as ord, max(identity_conf) as conf from obs where kind in ('view', 'click') group by 1, 2
), b as (
  select s.run, s.frame_idx, case when ord is null then 'UNKNOWN' when ord % 4 = 0 then 'MISSING' else 'TRACKED' end as state, case when ord is not null then s.frame_idx // 100 end as track,
    case when ord is not null then s.frame_idx * 5 % 1000 / 1000 end as x, case when ord is not null then s.frame_idx * 3 % 700 / 1000 end as y, conf / 100 as confidence
  from spans s left join best t on t.run = s.run and t.frame_idx = s.frame_idx
), pairs as (
  select run, frame_idx as f0, track, x as x0, y as y0, confidence as c0, lead(frame_idx) over w as f1, lead(track) over w as t1, lead(x) over w as x1, lead(y) over w as y1, lead(confidence) over w as c1
  from b where track is not null window w as (partition by run order by frame_idx)
), gaps as (
  select * from pairs where f1 - f0 > 1 and t1 = track and (f1 - f0) * {FRAME_US} <= 500000 and sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / ((f1 - f0) * {FRAME_US} / 1e6) <= 0.6
)
select b.run, b.frame_idx, case when f0 is not null then 'MISSING' else b.state end as state,
  case when f0 is not null then 'INTERPOLATED' when b.state = 'TRACKED' then 'DETECTED' when b.state = 'MISSING' then 'PREDICTED' end as source, case when f0 is not null then g.track else b.track end as track,
  round(case when f0 is not null then x0 + (x1 - x0) * ((b.frame_idx - f0) / (f1 - f0)) else x end, 9) as x, round(case when f0 is not null then y0 + (y1 - y0) * ((b.frame_idx - f0) / (f1 - f0)) else y end, 9) as y,
  case when f0 is not null then round(0.8 * least(c0, c1), 3) else b.confidence end as confidence
from b left join gaps g on g.run = b.run and b.frame_idx > g.f0 and b.frame_idx < g.f1""",
    "frame_hulls": f"""with {OBS_SQL}, p as (
  select distinct frame_idx, x_m::double as x, y_m::double as y from obs
), edges as (
  select a.frame_idx, a.x, a.y, b.x as bx, b.y as by_ from p a join p b on a.frame_idx = b.frame_idx and (a.x <> b.x or a.y <> b.y)
  where not exists (select 1 from p c where c.frame_idx = a.frame_idx and ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
    or ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) and not (c.x between least(a.x, b.x) and greatest(a.x, b.x) and c.y between least(a.y, b.y) and greatest(a.y, b.y)))))
), clipped as (
  select frame_idx, x, y, bx, by_, case when x <= 500 then x else bx end as lx, x <= 500 as a_in, bx <= 500 as b_in, y + (by_ - y) * (500 - x) / (case when bx = x then 1 else bx - x end) as ty from edges
), halves as (
  select frame_idx, sum(x * by_ - bx * y) as whole,
    sum(case when a_in and b_in then x * by_ - bx * y when a_in then x * ty - 500 * y when b_in then 500 * by_ - bx * ty else 0 end) as part,
    coalesce(max(case when a_in and not b_in then ty end), 0) as leaves, coalesce(max(case when b_in and not a_in then ty end), 0) as enters, count(*) as n
  from clipped group by 1
), few as (
  select frame_idx, count(*) as n, avg(x) as mx from p group by 1
), corners as (
  select frame_idx, count(*) as n, avg(x) as mx from (select distinct frame_idx, x, y from edges) group by 1
)
select f.frame_idx, case when f.n < 3 then f.n else c.n end as corners, round(case when f.n < 3 then 0 else abs(h.whole) / 2 end, 3) as area,
  round(case when f.n < 3 then 0 else abs(h.part + 500 * enters - 500 * leaves) / 2 end, 6) as left_area, round(case when f.n < 3 then f.mx else c.mx end, 6) as centre_x
from few f left join halves h on h.frame_idx = f.frame_idx left join corners c on c.frame_idx = f.frame_idx""",
}
