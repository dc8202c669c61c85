"""Queries of the ball's trajectory, with DuckDB SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ballfilter, balltrack
from ..sources.adapter import OBS_SQL, VIDEO_FRAMES, observations

#: The adapted videos: picture, frames a second (an hour of events is 90 ms of video), pixels a metre.
WIDTH, HEIGHT, FPS, FRAME_US, PXM = 1280.0, 720.0, 1000 / 90, 90_000, 40.0


def _frame():
    return F.col("frame_idx") - F.col("video") * VIDEO_FRAMES


def frames(s, d) -> DataFrame:
    """Every frame between the first and last of a video; the camera pans, is unsure every 50th frame and cut every 300th.

    Spark takes these rows for as few as the videos they are made from, and would send all of them through the driver to
    broadcast them; joins with them merge instead.
    """
    span = observations(s, d).groupBy("video").agg(F.min(_frame()).alias("a"), F.max(_frame()).alias("b"))
    f = span.select(F.col("video").alias("run"), F.explode(F.sequence("a", "b")).alias("frame_idx")).hint("merge")
    pan = (F.col("frame_idx") % 7 - 3).cast("double")
    one = lambda v: F.lit(float(v))
    return f.select(
        "run", "frame_idx", (F.col("frame_idx") * FRAME_US).alias("t_us"), F.array(one(1), one(0), pan, one(0), one(1), one(0), one(0), one(0), one(1)).alias("m"),
        (F.col("frame_idx") % 50 != 0).alias("reliable"), (F.col("frame_idx") % 300 == 299).alias("cut"),
    )


def people(s, d) -> DataFrame:
    """Boxes of the people of a frame, 72 pixels tall; those in doubt are not people of the match.

    Corners are quotients of integers, the doubles nearest to them, as decimals give: what lies on the edge of a body stays on it.
    """
    o = observations(s, d).where("state = 'confirmed'")
    x, y = (F.col("x_m") * 128 - 1350) / 100, (F.col("y_m") * 72 - 7200) / 100
    return o.select(F.col("video").alias("run"), _frame().alias("frame_idx"), F.col("user_id").alias("track"), x.alias("bx"), y.alias("by"), F.lit(27.0).alias("bw"), F.lit(72.0).alias("bh"))


def candidates(s, d) -> DataFrame:
    """White things: for two minutes of three, views and clicks roll across the picture; in the third, one thing
    stands still, of which the first pass ruled out a part.  Other events stay where their user is."""
    o = observations(s, d)
    f = _frame()
    third = F.floor(f / 60) % 3 == 2
    rolls, stands = F.col("kind").isin("view", "click") & ~third, ~F.col("kind").isin("view", "click") & third
    x = F.when(rolls, f * 6 % 1200 + F.col("ord") % 5).when(stands, 700 + f * 3 % 5).otherwise(F.col("user_id") * 37 % 100 * 12 + F.col("ord") % 3).cast("double")
    y = F.when(rolls, f * 2 % 640 + F.col("ord") % 3).when(stands, F.lit(300)).otherwise(F.col("user_id") * 53 % 100 * 7 + F.col("ord") % 2).cast("double")
    share = lambda c: (F.col(c) / 100).cast("double")
    none = F.lit(None).cast("double")
    return o.select(
        F.col("video").alias("run"), f.alias("frame_idx"), "ord", x.alias("x"), y.alias("y"), F.lit(8.0).alias("w"), F.lit(8.0).alias("h"), (0.3 + share("identity_conf") * 0.6).alias("det"),
        F.when(F.col("kind") == "view", "ball").when(F.col("kind") == "error", "rejected").otherwise("candidate").alias("status"),
        F.when(F.col("kind") == "error", "JUMP").when(F.col("clipped"), "SIZE").alias("reason"), F.when(rolls, F.col("video")).when(stands, 500 + F.floor(f / 60)).otherwise(F.col("user_id") + 1000).alias("tracklet"),
        F.when(F.col("ord") % 3 != 0, F.lit(PXM)).alias("pxm"), none.alias("visual"), F.lit(0.9).alias("size"), share("pitch_conf").alias("shape"), F.lit(0.9).alias("isolation"), F.lit(1.0).alias("field"),
        F.when(F.col("ord") % 11 == 0, 0.5).alias("line"), F.when(F.col("kind") == "purchase", 0.4).alias("attach"), F.when(F.col("kind") == "signup", 0.3).alias("static"), (F.col("ord") % 13 == 0).alias("other"),
        (F.col("x_m") / 1000).alias("pitch_x"), (F.col("y_m") / 1000).alias("pitch_y"),
    )


def _path(s, d):
    return balltrack.trajectory(balltrack.nodes(candidates(s, d), people(s, d), frames(s, d), FPS, HEIGHT), FPS)


def _likeness(s, d):
    n = balltrack.likeness(candidates(s, d), people(s, d), HEIGHT)
    return n.select("run", "frame_idx", "ord", F.round("q", 12).alias("q"), "pid", "near", F.round("pxm", 6).alias("pxm"), "marking")


def _told(s, d):
    return balltrack.told(_path(s, d)[0], frames(s, d), FPS, WIDTH, HEIGHT)


def _reviews(s, d):
    return _path(s, d)[1].select("run", "round", "kind", "first", "last", "sightings", "strong", "against", "marking", F.round("det", 4).alias("det"), F.round("q", 4).alias("q"))


def _followed(s, d):
    """The ball frame by frame, as it could have been followed while the video ran."""
    n = balltrack.likeness(candidates(s, d), people(s, d), HEIGHT)
    f = ballfilter.followed(n.select("run", "frame_idx", "ord", "x", "y", "d", "q", "pxm"), frames(s, d))
    return f.withColumns({c: F.round(c, 4) for c in ("x", "y", "speed", "distance")})


def _first_pass(s, d):
    """The best candidate of each frame that was taken for the ball, as it was shown."""
    best = candidates(s, d).where("status = 'ball'").groupBy("run", "frame_idx").agg(F.max(F.struct("det", "ord", "x", "y")).alias("c"))
    f = frames(s, d).select("run", "frame_idx", "t_us").join(best, ["run", "frame_idx"], "left")
    return f.select("run", "frame_idx", "t_us", F.when(F.col("c").isNull(), "UNKNOWN").otherwise("TRACKED").alias("state"), (F.col("c.x") / WIDTH).alias("x"), (F.col("c.y") / HEIGHT).alias("y"))


def _jumps(s, d):
    return balltrack.shown_jumps(_first_pass(s, d), people(s, d), WIDTH, HEIGHT)


QUERIES = {"ball_likeness": _likeness, "ball_trajectory": _told, "ball_reviews": _reviews, "ball_followed": _followed, "ball_jumps": _jumps}

_THINGS = f"""{OBS_SQL}, people as (
  select video as run, frame_idx - video * {VIDEO_FRAMES} as frame_idx, user_id as track, x_m * 1.28 - 13.5 as bx, y_m * 0.72 - 72.0 as by_, 27.0 as bw, 72.0 as bh
  from obs where state = 'confirmed'
), things as (
  select video as run, frame_idx - video * {VIDEO_FRAMES} as frame_idx, ord, kind, clipped, identity_conf, pitch_conf, x_m, y_m, user_id,
    (case when kind in ('view', 'click') and not third then f * 6 % 1200 + ord % 5 when kind not in ('view', 'click') and third then 700 + f * 3 % 5 else user_id * 37 % 100 * 12 + ord % 3 end)::double as x,
    (case when kind in ('view', 'click') and not third then f * 2 % 640 + ord % 3 when kind not in ('view', 'click') and third then 300 else user_id * 53 % 100 * 7 + ord % 2 end)::double as y,
    0.3 + identity_conf / 100 * 0.6 as det, kind = 'view' as ball
  from (select *, frame_idx - video * {VIDEO_FRAMES} as f, (frame_idx - video * {VIDEO_FRAMES}) // 60 % 3 = 2 as third from obs)
)"""

ORACLE_SQL = {
    "ball_likeness": f"""with {_THINGS}, good as (
  select * from things where kind = 'error' or not clipped
), pairs as (
  select c.*, p.track, p.bw, (c.x - p.bx) / p.bw as u, (c.y - p.by_) / p.bh as v, c.x - p.bx - p.bw / 2 as fx, 2 * (c.y - p.by_ - p.bh) as fy, abs(p.by_ + p.bh - c.y) < 180 as level, p.bh as tall
  from good c left join people p on p.run = c.run and p.frame_idx = c.frame_idx
), scaled as (
  select run, frame_idx, ord, coalesce(case when any_value(ord) % 3 <> 0 then 40.0 end, list_sort(list(tall) filter (level))[count(*) filter (level) // 2 + 1] / 1.8, 36.0) as pxm
  from pairs group by 1, 2, 3
), held as (
  select p.run, p.frame_idx, p.ord, any_value(s.pxm)::double as pxm,
    arg_min(p.track, (abs(p.u - 0.5), p.track)) filter (p.u between -0.1 and 1.1 and p.v between 0.6 and 1.08) as pid,
    arg_min(p.track, (sqrt(p.fx * p.fx + p.fy * p.fy), p.track)) filter (sqrt(p.fx * p.fx + p.fy * p.fy) / s.pxm <= 1.5) as reach
  from pairs p join scaled s on s.run = p.run and s.frame_idx = p.frame_idx and s.ord = p.ord group by 1, 2, 3
), scored as (
  select c.*, h.pxm, h.pid, coalesce(h.pid, h.reach) as near,
    (0.4 * least(1, greatest(0, (det - 0.08) / 0.45)) + 0.2 * 0.9 + 0.15 * pitch_conf / 100 + 0.15 * 0.9 + 0.1)
    * (1 - 0.5 * case when c.ord % 11 = 0 then 0.5 else 0 end) * (1 - 0.7 * case when kind = 'purchase' then 0.4 else 0 end)
    * (1 - 0.6 * case when kind = 'signup' then 0.3 else 0 end) * case when c.ord % 13 = 0 then 0.2 else 1 end as q0,
    not ball and least(sqrt(((x_m / 1000 - 11.0 / 105) * 105) ** 2 + ((y_m / 1000 - 0.5) * 68) ** 2), sqrt(((x_m / 1000 - 94.0 / 105) * 105) ** 2 + ((y_m / 1000 - 0.5) * 68) ** 2),
      sqrt(((x_m / 1000 - 0.5) * 105) ** 2 + ((y_m / 1000 - 0.5) * 68) ** 2)) <= 1 as marking
  from good c join held h on h.run = c.run and h.frame_idx = c.frame_idx and h.ord = c.ord
)
select run, frame_idx, ord, round(greatest(case when ball then least(1, q0 * 1.15) else q0 end * case when marking then 0.4 else 1 end, 0.001), 12) as q, pid, near, round(pxm, 6) as pxm, marking from scored""",
    "ball_jumps": f"""with {_THINGS}, spans as (
  select run, unnest(range(min(frame_idx), max(frame_idx) + 1)) as frame_idx from things group by 1
), best as (
  select run, frame_idx, arg_max(x, (det, ord)) as x, arg_max(y, (det, ord)) as y from things where ball group by 1, 2
), shown as (
  select s.run, s.frame_idx, (b.x / 1280.0) * 1280.0 as x, (b.y / 720.0) * 720.0 as y from spans s left join best b on b.run = s.run and b.frame_idx = s.frame_idx
), pairs as (
  select c.*, p.track, (c.x - p.bx) / p.bw as u, (c.y - p.by_) / p.bh as v, abs(p.by_ + p.bh - c.y) < 180 as level, p.bh as tall
  from shown c left join people p on p.run = c.run and p.frame_idx = c.frame_idx
), held as (
  select run, frame_idx, any_value(x) as x, any_value(y) as y, coalesce(list_sort(list(tall) filter (level))[count(*) filter (level) // 2 + 1] / 1.8, 36.0) as pxm,
    arg_min(track, (abs(u - 0.5), track)) filter (u between -0.1 and 1.1 and v between 0.6 and 1.08) as pid
  from pairs group by 1, 2
), steps as (
  select run, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) / pxm as metres, pid, lag(pid) over w as before from held window w as (partition by run order by frame_idx)
)
select run, count(*) filter (metres / 0.09 > 40) as teleports, count(*) filter (pid <> before and metres > 1) as foot_switches from steps group by 1""",
}
