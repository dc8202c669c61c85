"""Queries that compare runs, evaluate, and match with a lead, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pitch
from ..functions import vectors as fv
from ..functions.geometry import projected
from ..operators import comparing as cp
from ..operators import tracklets
from ..sources.adapter import OBS_SQL, observations
from .matches import _BOXES, _GREEDY, _IOU, _boxes, _greedy, _vectors
from .rules import _MARKS


def _o(s, d):
    return observations(s, d)


def _half(n):
    return F.floor(n / 2) + 1


def _comparison(s, d):
    """People and confirmed people a frame by distance band, the two runs beside each other."""
    band = F.when(F.col("y_m") >= 660, "near").when(F.col("y_m") >= 330, "middle").otherwise("far")
    o = _o(s, d).withColumns({"band": band, "run": F.col("ord") % 2})
    frames = o.groupBy("video").agg(*(F.count_distinct(F.when(F.col("run") == k, F.col("frame_idx"))).alias(f"frames{k}") for k in (0, 1)))
    n = lambda k, c: F.count(F.when((F.col("run") == k) & c, 1))
    g = o.groupBy("video", "band").agg(*(n(k, F.lit(True)).alias(f"n{k}") for k in (0, 1)), *(n(k, F.col("state") == "confirmed").alias(f"sure{k}") for k in (0, 1))).join(frames, "video")
    per = lambda c, k: (F.col(f"{c}{k}") / F.greatest(F.lit(1), F.col(f"frames{k}"))).alias(f"{c}_a_frame{k}")
    return g.select("video", "band", *(per(c, k) for c in ("n", "sure") for k in (0, 1)))


def _ratios(s, d):
    """Of two runs: shares of matched rows, of pairs with like labels, and the overlap of each pair of identities (Dice)."""
    g = _greedy(s, d).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("both"))
    of = lambda k, name: _o(s, d).where(F.col("ord") % 2 == k).groupBy(F.col("id").alias(name)).agg(F.count(F.lit(1)).alias(f"{name}_rows"))
    j = g.join(of(0, "a_id"), "a_id").join(of(1, "b_id"), "b_id")
    return j.select("a_id", "b_id", "both", (2 * F.col("both") / (F.col("a_id_rows") + F.col("b_id_rows"))).alias("dice"), (F.col("both") / F.col("a_id_rows")).alias("mapped"))


def _holdout(s, d):
    """Distances of each video's sightings to the one before: mean, most, upper median and 95th."""
    w = Window.partitionBy("id").orderBy("t_us", "ord")
    o = _o(s, d).withColumn("err", F.abs(F.col("x_m") - F.lag("x_m").over(w)) + F.abs(F.col("y_m") - F.lag("y_m").over(w))).where("err is not null")
    q = cp.by_count(o, ["video"], "err", {"median": _half(F.col("n")), "p95": F.greatest(F.lit(1), F.floor(F.col("n") * 95 / 100))})
    return q.select("video", "n", (F.col("total") / F.col("n")).alias("mean"), "most", "median", "p95")


def _lens(s, d):
    """Upper median of a signed measure over clear frames, and how many agree with its sign."""
    o = _o(s, d).where("pitch_conf >= 40").select("video", (F.col("x_m") - 500).alias("k"))
    q = cp.by_count(o, ["video"], "k", {"median": _half(F.col("n"))})
    return o.join(q.select("video", "n", "median"), "video").groupBy("video", "n", "median").agg((F.count(F.when(F.signum("k") == F.signum("median"), 1)) / F.first("n")).alias("agree"))


def _loss(s, d):
    """Per video and day the share of mapped rows a frame: upper median, in thousandths."""
    f = _o(s, d).groupBy("video", "frame_idx").agg(F.floor(F.count(F.when(F.col("pitch_conf") >= 60, 1)) * 1000 / F.count(F.lit(1))).alias("share"))
    return cp.by_count(f, ["video"], "share", {"median": _half(F.col("n"))}).select("video", "n", "median")


def _jumps(s, d):
    """Sightings farther from the oldest one of the last second than a sprint allows."""
    w = Window.partitionBy("id").orderBy("t_us").rangeBetween(-1_000_000, 0)
    o = _o(s, d).withColumns({"old": F.min(F.struct("t_us", "ord", "x_m", "y_m")).over(w)})
    dt = F.col("t_us") - F.col("old.t_us")
    dx, dy = (F.col("x_m") - F.col("old.x_m")) * 105, (F.col("y_m") - F.col("old.y_m")) * 68
    fast = (dt > 0) & ((dx * dx + dy * dy) * 1_000_000 > 144 * dt * dt)
    return o.groupBy("video", "kind").agg(F.count(F.when(dt > 0, 1)).alias("steps"), F.count(F.when(fast, 1)).alias("jumps"))


def _evaluation(s, d):
    """Against known people: switches of track, tracks, shares of confirmed rows, rows doubled in a frame."""
    w = Window.partitionBy("user_id").orderBy("t_us", "ord")
    o = _o(s, d).withColumns({"before": F.lag("track").over(w), "twice": F.row_number().over(Window.partitionBy("user_id", "frame_idx").orderBy("ord"))})
    return o.groupBy("user_id").agg(F.count(F.when(F.col("before") != F.col("track"), 1)).alias("switches"), F.count_distinct("track").alias("tracks"), (F.count(F.when(F.col("state") == "confirmed", 1)) / F.count(F.lit(1))).alias("coverage"), F.count(F.when(F.col("twice") > 1, 1)).alias("doubled"))


def _marks(s, d):
    o = _o(s, d).where("kind = 'click'").select("ord", (F.col("x_m") * 105).alias("x"), (F.col("y_m") * 68).alias("y"))
    m = F.broadcast(pitch.landmarks(s, 105.0, 68.0))  # 29 rows
    cost = F.floor(F.sqrt((F.col("lx") * 1000 - F.col("x")) * (F.col("lx") * 1000 - F.col("x")) + (F.col("ly") * 1000 - F.col("y")) * (F.col("ly") * 1000 - F.col("y"))))
    j = o.crossJoin(m).withColumn("cost", cost)
    return cp.clear_best(j, ["ord"], "cost", 2000)


def _hints(s, d):
    """At each sighting the goal hint in force: the freshest goal line of the last 30 seconds of the video, else the freshest box."""
    at = lambda k: F.when(F.col("kind") == k, F.struct("t_us", "ord"))
    o = _o(s, d).where("kind in ('purchase', 'click', 'error')")
    w = Window.partitionBy("video").orderBy("t_us", "ord")
    o = o.withColumns({"line": F.last(at("purchase"), ignorenulls=True).over(w), "box": F.last(at("click"), ignorenulls=True).over(w)})
    fresh = F.col("t_us") - F.col("line.t_us") <= 30_000_000
    return o.where("kind = 'error'").select("ord", F.when(fresh, "line").when(F.col("box").isNotNull(), "box").alias("hint"), F.when(fresh, F.col("line.ord")).otherwise(F.col("box.ord")).alias("source"))


def _occluded(s, d):
    """Boxes that another of the frame overlaps, or whose centre is close to another's."""
    b = _boxes(s, d).select("frame_idx", "ord", "bx", "by", "bw", "bh")
    p, q = (b.select("frame_idx", F.col("ord").alias(f"{k}ord"), *(F.col(c).alias(f"{k}{c}") for c in ("bx", "by", "bw", "bh"))) for k in ("p_", "q_"))
    j = p.join(q, "frame_idx").where("p_ord <> q_ord")
    dx, dy = (F.abs(2 * F.col(f"p_{a}") + F.col(f"p_{z}") - 2 * F.col(f"q_{a}") - F.col(f"q_{z}")) for a, z in (("bx", "bw"), ("by", "bh")))
    close = (dx * dx + dy * dy) * 100 < 36 * (F.col("p_bw") + F.col("q_bw")) * (F.col("p_bw") + F.col("q_bw"))
    return j.groupBy("frame_idx", F.col("p_ord").alias("ord")).agg(F.max(fv.iou("p_", "q_")).alias("covered"), F.max(close).alias("close")).where("covered > 0.02 or close")


def _corners(s, d):
    """The homography of a unit square to four points near the corners of the picture, and where it puts the middle."""
    u, v = F.col("x_m"), F.col("y_m")
    x = [(F.lit(0) + u / 10), (F.lit(1900) - v / 10), (F.lit(1800) + u / 20), (F.lit(50) - v / 50)]
    y = [(F.lit(100) - v / 20), (F.lit(50) + u / 50), (F.lit(1000) - u / 40), (F.lit(900) + v / 30)]
    h = cp.corner_homography(x, y)
    mx, my = projected(h, F.lit(0.5), F.lit(0.5))
    return _o(s, d).select("ord", F.round(mx, 6).alias("mid_x"), F.round(my, 6).alias("mid_y"), F.round(h[6], 9).alias("g"), F.round(h[7], 9).alias("h"))


def _lead(s, d):
    """Unsure fragments of a team and the identities not seen meanwhile, by where these were before and after; a video is its own
    camera, and looks are those of the crops with the numbers of the track and the identity."""
    o = _o(s, d).select("video", "team", "id", "user_id", "track", "t_us", "ord", (F.col("x_m") * 0.105).alias("x"), (F.col("y_m") * 0.068).alias("y"), "state")
    w = Window.partitionBy("track").orderBy("t_us", "ord")
    new = F.when(F.col("state") == F.lag("state").over(w), 0).otherwise(1)
    rows = o.withColumn("new", new).withColumn("part", F.sum("new").over(w)).where("state = 'uncertain'")
    rows = rows.select(F.concat_ws(":", F.col("track").cast("string"), F.col("part").cast("string")).alias("frag"), "video", "team", "user_id", "t_us", "ord", "x", "y", F.col("video").alias("camera"))
    end = F.struct("t_us", "ord", "x", "y")
    f = rows.groupBy("frag", "video", "team").agg(F.min(end).alias("a"), F.max(end).alias("b"), F.min("user_id").alias("user_id"))
    f = f.select("frag", "video", "team", "user_id", F.col("a.t_us").alias("t0"), F.col("b.t_us").alias("t1"), F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), F.col("video").alias("camera0"), F.col("video").alias("camera1"))
    seen = o.where("state = 'confirmed'").select("id", "t_us", "x", "y", F.col("video").alias("camera"))
    members = o.select("video", "team", "id").distinct()
    looks = f.join(o.select("video", "team", "id", F.col("user_id").alias("who")).distinct(), ["video", "team"]).select("frag", "id", (1 - F.least(F.abs(F.col("user_id") - F.col("who")), F.lit(10)) / 12).alias("appearance"))
    return tracklets.assigned_fragments(f, rows, members, seen, looks)


def _gallery_stream(s, d):
    v = _vectors(s, d)
    norm = F.sqrt(fv.dot(F.col("q"), F.col("q")).cast("double"))
    v = v.select(F.col("id").cast("long").alias("id"), (F.col("vec_id") * 7919 % 100_003).alias("t"), F.col("vec_id").cast("long").alias("vec_id"), F.transform("q", lambda x: x / norm).alias("v"))
    return cp.kept_galleries(v, 1_000, 0.3)


QUERIES = {
    "run_comparison": _comparison,
    "identity_overlap": _ratios,
    "holdout": _holdout,
    "lens_summary": _lens,
    "mapped_share": _loss,
    "look_back_jumps": _jumps,
    "evaluation": _evaluation,
    "marking_matches": _marks,
    "goal_hints": _hints,
    "occluded": _occluded,
    "corner_homography": _corners,
    "fragments_assigned": _lead,
    "gallery_stream": _gallery_stream,
}

_X, _Y = ("x_m / 10", "1900 - y_m / 10", "1800 + x_m / 20", "50 - y_m / 50"), ("100 - y_m / 20", "50 + x_m / 50", "1000 - x_m / 40", "900 + y_m / 30")

ORACLE_SQL = {
    "run_comparison": f"with {OBS_SQL}, o as (select *, case when y_m >= 660 then 'near' when y_m >= 330 then 'middle' else 'far' end as band from obs), f as (select video, count(distinct frame_idx) filter (ord % 2 = 0) as f0, count(distinct frame_idx) filter (ord % 2 = 1) as f1 from o group by 1) select o.video, band, count(*) filter (ord % 2 = 0) / greatest(1, any_value(f0)) as n_a_frame0, count(*) filter (ord % 2 = 1) / greatest(1, any_value(f1)) as n_a_frame1, count(*) filter (ord % 2 = 0 and state = 'confirmed') / greatest(1, any_value(f0)) as sure_a_frame0, count(*) filter (ord % 2 = 1 and state = 'confirmed') / greatest(1, any_value(f1)) as sure_a_frame1 from o join f on f.video = o.video group by 1, 2",
    "identity_overlap": f"{_GREEDY}, n as (select a_id, b_id, count(*) as both_ from chosen group by 1, 2), r as (select id, count(*) filter (ord % 2 = 0) as ra, count(*) filter (ord % 2 = 1) as rb from obs group by 1) select a_id, b_id, both_ as \"both\", 2 * both_ / (a.ra + b.rb) as dice, both_ / a.ra as mapped from n join r a on a.id = a_id join r b on b.id = b_id",
    "holdout": f"with {OBS_SQL}, e as (select video, abs(x_m - lag(x_m) over w) + abs(y_m - lag(y_m) over w) as err from obs window w as (partition by id order by t_us, ord)), r as (select *, row_number() over (partition by video order by err) as k, count(*) over (partition by video) as n from e where err is not null) select video, max(n) as n, sum(err) / count(*) as mean, max(err) as most, max(err) filter (k = n // 2 + 1) as median, max(err) filter (k = greatest(1, n * 95 // 100)) as p95 from r group by 1",
    "lens_summary": f"with {OBS_SQL}, o as (select video, x_m - 500 as k from obs where pitch_conf >= 40), r as (select *, row_number() over (partition by video order by k) as turn, count(*) over (partition by video) as n from o), m as (select video, max(n) as n, max(k) filter (turn = n // 2 + 1) as median from r group by 1) select m.video, n, median, count(*) filter (sign(k) = sign(median)) / n as agree from m join o on o.video = m.video group by 1, 2, 3",
    "mapped_share": f"with {OBS_SQL}, f as (select video, frame_idx, count(*) filter (pitch_conf >= 60) * 1000 // count(*) as share from obs group by 1, 2), r as (select *, row_number() over (partition by video order by share) as k, count(*) over (partition by video) as n from f) select video, max(n) as n, max(share) filter (k = n // 2 + 1) as median from r group by 1",
    "look_back_jumps": f"with {OBS_SQL}, o as (select video, kind, t_us, x_m, y_m, min({{'t': t_us, 'o': ord, 'x': x_m, 'y': y_m}}) over (partition by id order by t_us range between 1000000 preceding and current row) as p from obs), e as (select video, kind, t_us - p.t as dt, (x_m - p.x) * 105 * ((x_m - p.x) * 105) + (y_m - p.y) * 68 * ((y_m - p.y) * 68) as square from o) select video, kind, count(*) filter (dt > 0) as steps, count(*) filter (dt > 0 and square * 1000000 > 144 * dt * dt) as jumps from e group by 1, 2",
    "evaluation": f"with {OBS_SQL}, o as (select *, lag(track) over (partition by user_id order by t_us, ord) as before, row_number() over (partition by user_id, frame_idx order by ord) as twice from obs) select user_id, count(*) filter (before <> track) as switches, count(distinct track) as tracks, count(*) filter (state = 'confirmed') / count(*) as coverage, count(*) filter (twice > 1) as doubled from o group by 1",
    "marking_matches": f"with {OBS_SQL}, {_MARKS}, j as (select ord, name, floor(sqrt((lx * 1000 - x_m * 105) * (lx * 1000 - x_m * 105) + (ly * 1000 - y_m * 68) * (ly * 1000 - y_m * 68)))::bigint as cost from obs, marks where kind = 'click'), r as (select *, row_number() over (partition by ord order by cost, name) as turn from j), g as (select ord, max(name) filter (turn = 1) as name, max(cost) filter (turn = 1) as first, max(cost) filter (turn = 2) as second from r where turn <= 2 group by 1) select * from g where second is null or second >= 2 * first + 2000",
    "goal_hints": f"with {OBS_SQL}, o as (select *, last_value(case when kind = 'purchase' then {{'t': t_us, 'o': ord}} end ignore nulls) over w as line, last_value(case when kind = 'click' then {{'t': t_us, 'o': ord}} end ignore nulls) over w as box from obs where kind in ('purchase', 'click', 'error') window w as (partition by video order by t_us, ord rows unbounded preceding)) select ord, case when t_us - line.t <= 30000000 then 'line' when box is not null then 'box' end as hint, case when t_us - line.t <= 30000000 then line.o else box.o end as source from o where kind = 'error'",
    "occluded": f"with {_BOXES}, j as (select a.frame_idx, a.ord, {_IOU('a', 'b')} as iou, (power(abs(2 * a.bx + a.bw - 2 * b.bx - b.bw), 2) + power(abs(2 * a.by_ + a.bh - 2 * b.by_ - b.bh), 2)) * 100 < 36 * (a.bw + b.bw) * (a.bw + b.bw) as close from boxes a join boxes b on a.frame_idx = b.frame_idx and a.ord <> b.ord), g as (select frame_idx, ord, max(iou) as covered, bool_or(close) as close from j group by 1, 2) select * from g where covered > 0.02 or close",
    "corner_homography": f"""with {OBS_SQL}, c as (select ord, {', '.join(f'({e})::double as x{k}' for k, e in enumerate(_X))}, {', '.join(f'({e})::double as y{k}' for k, e in enumerate(_Y))} from obs
), d as (select *, x1 - x2 as dx1, x3 - x2 as dx2, x0 - x1 + x2 - x3 as sx, y1 - y2 as dy1, y3 - y2 as dy2, y0 - y1 + y2 - y3 as sy from c
), g as (select *, (sx * dy2 - dx2 * sy) / (dx1 * dy2 - dx2 * dy1) as g, (dx1 * sy - sx * dy1) / (dx1 * dy2 - dx2 * dy1) as h from d)
select ord, round(((x1 - x0 + g * x1) * 0.5e0 + (x3 - x0 + h * x3) * 0.5e0 + x0) / (g * 0.5e0 + h * 0.5e0 + 1e0), 6) as mid_x, round(((y1 - y0 + g * y1) * 0.5e0 + (y3 - y0 + h * y3) * 0.5e0 + y0) / (g * 0.5e0 + h * 0.5e0 + 1e0), 6) as mid_y, round(g, 9) as g, round(h, 9) as h from g""",
}
