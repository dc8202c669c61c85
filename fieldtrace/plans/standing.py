"""Queries of decisions that ticks in a row bring about, of gates and of crops, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import matching, standing
from ..sources.adapter import OBS_SQL, VIDEO_FRAMES, observations
from . import matches
from .matches import _BEST, _COS, _V


def _round(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _non_targets(s, d):
    o = observations(s, d).select("track", "t_us", "ord", (F.col("kind") == "error").alias("marks"), (F.col("identity_conf") >= 20).alias("clear"))
    return standing.non_targets(o).select("track", "ord", "ignored", "streak")


def _checks(s, d):
    """Vectors of an identity in turn, each against the galleries of the others of its team and its own."""
    v = matches._vectors(s, d).select("vec_id", F.col("id").alias("track"), F.col("vec_id").alias("t_us"), F.col("vec_id").alias("ord"))
    best = matching.top_two_gap(matches._probe_scores(s, d), "vec_id", "candidate", "cos")
    return v.join(best, "vec_id").withColumns({"person": F.col("best"), "rival": F.col("score") - F.col("lead"), "held": F.col("vec_id") % 2 == 0})


def _released(s, d):
    v = matches._vectors(s, d).select("vec_id", F.col("id").alias("candidate"))
    own = matches._probe_scores(s, d).join(v, ["vec_id", "candidate"])
    c = own.select("vec_id", F.col("candidate").alias("track"), F.col("vec_id").alias("t_us"), F.col("vec_id").alias("ord"), F.col("cos").alias("score"))
    return standing.released(c).select("vec_id", "track", "doubts", "released")


def _strikes(s, d):
    inside = F.col("x_m").between(100, 900) & F.col("y_m").between(100, 900)
    f = observations(s, d).groupBy("video", "frame_idx").agg(F.count(F.lit(1)).alias("people"), F.count(F.when(inside, 1)).alias("inside"))
    f = f.select(F.col("video").alias("key"), F.col("frame_idx").alias("t_us"), F.col("frame_idx").alias("ord"), "people", "inside", (F.col("frame_idx") % 50 == 0).alias("anchored"))
    return standing.outside_strikes(f).select(F.col("key").alias("video"), F.col("ord").alias("frame_idx"), "people", "inside", "strikes", "doubt")


def _team_votes(s, d):
    mostly = F.col("kind").isin("view", "click")
    o = observations(s, d).select("track", "t_us", "ord", F.when(mostly, F.col("identity_conf")).alias("a"), F.when(~mostly, F.col("pitch_conf")).alias("b"))
    return _round(standing.team_by_votes(o), "confidence").select("track", "ord", "decided", "confidence")


def _recovered(s, d):
    o = observations(s, d).select(
        F.col("id").alias("person"), F.floor(F.col("t_us") / 50).alias("t_us"), "ord", F.floor(F.col("x_m") / 20).alias("x_m"), F.floor(F.col("y_m") / 20).alias("y_m"), (F.col("state") == "confirmed").alias("found"), F.col("clipped").alias("long"), (F.col("pitch_conf") < 3).alias("cut")
    )
    return standing.recovered(o).select("person", "ord", "hits", "restored")


def _sizes(s, d):
    x, y, e = F.col("x_m"), F.col("y_m"), F.col("ord")
    o = observations(s, d).select(
        "ord", ((20 + (e * 131) % 300) / 1000).alias("height"), F.greatest((20 + (e * 131) % 300) / 1000, (e * 17) % 300 / 1000).alias("long_axis"), F.when(y.between(0, 1000), F.lit(0.1) + y / 10000).alias("expected"),
        F.when(x.between(-20, 1020) & y.between(-20, 1020), "inside").otherwise("outside").alias("zone"), (y < -40).alias("audience"), (F.col("kind") == "view").alias("official"), (F.col("state") == "confirmed").alias("tracked"), (F.col("identity_conf") / 100).alias("score"),
    )
    return _round(standing.size_gate(o), "ratio").select("ord", "verdict", "reason", "ratio")


def _touchline(s, d):
    """Edges and velocities in millimetres: how far beyond the nearest edge, and the part of the velocity along it."""
    w = Window.partitionBy("id").orderBy("t_us", "ord")
    x, y = F.col("x_m") * 105, F.col("y_m") * 68
    o = observations(s, d).select("id", "t_us", "ord", x.alias("x"), y.alias("y"), (F.greatest(-y, y - 68000, -x, x - 105000)).alias("beyond"))
    o = o.withColumn("side", F.when(F.col("beyond") == -F.col("y"), "far").when(F.col("beyond") == F.col("y") - 68000, "near").when(F.col("beyond") == -F.col("x"), "left").otherwise("right"))
    s_ = (F.col("t_us") - F.lag("t_us").over(w)) / F.lit(10.0)
    o = o.withColumns({"vx": F.try_divide(F.col("x") - F.lag("x").over(w), s_), "vy": F.try_divide(F.col("y") - F.lag("y").over(w), s_)})
    along = F.abs(F.when(F.col("side").isin("far", "near"), F.col("vx")).otherwise(F.col("vy")))
    r = o.select("id", "t_us", "ord", "side", (F.col("beyond") / 1000).alias("metres"), along.alias("along"), F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).alias("speed"), F.col("beyond").between(-2000, 2000).alias("boundary"))
    return _round(standing.touchline(r), "score", "time", "parallel", digits=6)


def _crops(s, d):
    o = matches._boxes(s, d).withColumns({"bw": F.floor(F.col("bw") / 4), "bh": F.floor(F.col("bh") / 4), "score": F.col("pitch_conf")})
    return standing.refinement_crops(o, 1920, 1080)


def _grid(s, d):
    o = observations(s, d)
    return standing.sampling_grid(o.groupBy(F.col("track").alias("key")).agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us")), o.where("kind = 'error'").select(F.col("track").alias("key"), "t_us"))


def _crossings(s, d):
    """Pairs of people in every frame of a video, a fifth of a second apart."""
    b = matches._boxes(s, d)
    j = matching.frame_pairs(b, b, 0.0).where("a_id < b_id")
    video = F.floor(F.col("frame_idx") / VIDEO_FRAMES)
    p = j.select(F.concat_ws("-", "a_id", "b_id").alias("pair"), ((F.col("frame_idx") - video * VIDEO_FRAMES) * 200_000).alias("t_us"), (F.col("a_ord") * 2 + F.col("b_ord")).alias("ord"), F.col("iou").alias("overlap"), (F.col("iou") > 0.3).alias("close"), (F.col("a_ord") % 7 > 0).alias("seen"), (F.col("b_ord") % 3 > 0).alias("clean"), F.lit(True).alias("valid"))
    return standing.crossings(p)


QUERIES = {
    "non_targets": _non_targets,
    "recognised": lambda s, d: standing.recognised(_checks(s, d)).select("vec_id", "person", "hits", "decided"),
    "released": _released,
    "outside_strikes": _strikes,
    "team_by_votes": _team_votes,
    "recovered": _recovered,
    "size_gate": _sizes,
    "touchline": _touchline,
    "refinement_crops": _crops,
    "sampling_grid": _grid,
    "crossings": _crossings,
}


def _runs(rows: str, key: str) -> str:
    """Length of the run of good rows that ends at each: islands between rows that break."""
    return f"""(select *, case when good then sum(case when good then 1 else 0 end) over (partition by {key}, island order by t_us, ord rows unbounded preceding) else 0 end::bigint as run
  from (select *, sum(case when not good or fresh then 1 else 0 end) over (partition by {key} order by t_us, ord rows unbounded preceding) as island from ({rows})))"""


_SCORES = f"{_V}, sc as {_BEST('vec_id, candidate', f'select v.vec_id, g.id as candidate, {_COS("v.q", "g.q")} as cos from v join g on g.team = v.team and g.vec_id <> v.vec_id')}"
_BEST_TWO = "best as (select vec_id, max(candidate) filter (turn = 1) as person, max(cos) filter (turn = 1) as score, max(cos) filter (turn = 1) - max(cos) filter (turn = 2) as lead from (select *, row_number() over (partition by vec_id order by cos desc, candidate) as turn from sc) where turn <= 2 group by vec_id)"
_HIT = "select v.id as track, vec_id, vec_id as t_us, vec_id as ord, person, score >= 0.7e0 and score >= coalesce(score - lead, 0e0) + 0.15e0 as good, person is distinct from lag(person) over (partition by v.id order by vec_id) as fresh from v join best using (vec_id)"
_NEAR = "t_us - lag(t_us) over w <= 350000 and (x_m - lag(x_m) over w) * (x_m - lag(x_m) over w) + (y_m - lag(y_m) over w) * (y_m - lag(y_m) over w) < 1600"

ORACLE_SQL = {
    "non_targets": f"""with {OBS_SQL}, r as {_runs("select track, t_us, ord, kind = 'error' as marks, identity_conf >= 20 and kind <> 'error' as good, false as fresh from obs", 'track')},
  i as (select *, coalesce(last_value(case when marks then true when run >= 10 then false end ignore nulls) over (partition by track order by t_us, ord rows unbounded preceding), false) as ignored from r)
select track, ord, ignored, case when ignored then run else 0 end as streak from i""",
    "recognised": f"with {_SCORES}, {_BEST_TWO} select vec_id, person, run as hits, run >= case when vec_id % 2 = 0 then 3 else 2 end as decided from {_runs(_HIT, 'track')}",
    "released": f"with {_SCORES} select vec_id, track, run % 3 as doubts, run > 0 and run % 3 = 0 as released from {_runs('select vec_id, v.id as track, vec_id as t_us, vec_id as ord, cos < 0.45e0 as good, false as fresh from sc join v using (vec_id) where candidate = v.id', 'track')}",
    "outside_strikes": f"with {OBS_SQL}, f as (select video, frame_idx, count(*) as people, count(*) filter (x_m between 100 and 900 and y_m between 100 and 900) as inside from obs group by 1, 2 having count(*) >= 4) select video, frame_idx, people, inside, run as strikes, run >= 3 as doubt from {_runs('select *, frame_idx as t_us, frame_idx as ord, inside / people < 0.5e0 as good, frame_idx % 50 = 0 as fresh from f', 'video')}",
    "team_by_votes": f"""with {OBS_SQL}, c as (select track, t_us, ord, sum(case when kind in ('view', 'click') then identity_conf else 0 end) over w as a, sum(case when kind in ('view', 'click') then 0 else pitch_conf end) over w as b from obs window w as (partition by track order by t_us, ord rows unbounded preceding)),
  m as (select *, case when a >= b then 'A' else 'B' end as leader, a + b >= 400 and greatest(a, b) > (a + b)::double * 0.85e0 as settles, a + b > 2000 and greatest(a, b) > (a + b)::double * 0.97e0 as overturns from c)
select track, ord, coalesce(last_value(case when overturns then leader end ignore nulls) over w, first_value(case when settles then leader end ignore nulls) over w) as decided, round(last_value(case when settles then greatest(a, b) / (a + b)::double end ignore nulls) over w, 9) as confidence
from m window w as (partition by track order by t_us, ord rows unbounded preceding)""",
    "recovered": f"with {OBS_SQL}, o as (select id as person, t_us // 50 as t_us, ord, floor(x_m / 20)::bigint as x_m, floor(y_m / 20)::bigint as y_m, state = 'confirmed' and pitch_conf >= 3 as good, clipped from obs) select person, ord, run as hits, run >= case when clipped then 5 else 3 end as restored from {_runs(f'select *, not coalesce({_NEAR}, false) as fresh from o window w as (partition by person order by t_us, ord)', 'person')}",
    "size_gate": f"""with {OBS_SQL}, p as (select ord, (20 + (ord * 131) % 300) / 1000 as height, greatest((20 + (ord * 131) % 300) / 1000, (ord * 17) % 300 / 1000) as long_axis, case when y_m between 0 and 1000 then 0.1e0 + y_m / 10000 end as expected,
    not (x_m between -20 and 1020 and y_m between -20 and 1020) as outside, y_m < -40 as audience, kind = 'view' as official, state = 'confirmed' as tracked, identity_conf / 100 as score from obs
), r as (select *, case when height / expected < 0.4e0 and long_axis / expected >= 0.6e0 then long_axis / expected else height / expected end as ratio from p
), w as (select *, case when outside and audience then 'audience' when outside and not official then 'outside-pitch'
    when ratio is not null and (ratio > 2.2e0 or ratio < case when expected * 1080 < 36 then 0.28e0 else 0.4e0 end) and not (tracked and height * 1080 < 36) then 'implausible-size' when score < 0.1e0 then 'low-confidence' end as reason from r)
select ord, case when reason is null then 'accepted' when reason = 'outside-pitch' then 'continuation' else 'rejected' end as verdict, reason, round(ratio, 9) as ratio from w""",
    "touchline": f"""with {OBS_SQL}, a as (select id, t_us, ord, x_m * 105 as x, y_m * 68 as y, greatest(-y_m * 68, y_m * 68 - 68000, -x_m * 105, x_m * 105 - 105000) as beyond from obs
), b as (select *, case when beyond = -y then 'far' when beyond = y - 68000 then 'near' when beyond = -x then 'left' else 'right' end as side, (x - lag(x) over w) / nullif((t_us - lag(t_us) over w) / 10e0, 0) as vx, (y - lag(y) over w) / nullif((t_us - lag(t_us) over w) / 10e0, 0) as vy,
    row_number() over (partition by id order by t_us desc, ord desc) as turn from a window w as (partition by id order by t_us, ord)
), r as (select *, beyond between -1000 and 4000 as inside, abs(case when side in ('far', 'near') then vx else vy end) as along, sqrt(vx * vx + vy * vy) as speed from b where turn <= 50
), sides as (select id, side, count(*) as here, row_number() over (partition by id order by count(*) desc, max(turn) desc) as place from r where inside group by 1, 2
), t as (select id, count(*) as n, count(*) filter (inside) as c, sum(along) filter (inside and speed >= 0.3e0) as al, sum(sqrt(greatest(0e0, speed * speed - along * along))) filter (inside and speed >= 0.3e0) as ac from r group by id
), j as (select t.*, sides.side, here, case when al + ac > 0 then al / (al + ac) end as parallel from t left join sides on sides.id = t.id and place = 1)
select id, round(c / n * coalesce(here / c, 0e0) * (0.4e0 + 0.6e0 * coalesce(parallel, 0.5e0)), 6) as score, round(c / n, 6) as time, round(parallel, 6) as parallel, side from j""",
    "sampling_grid": f"with {OBS_SQL}, s as (select track as key, min(t_us) as a, max(t_us) as b from obs group by 1) select key, unnest(range(a, b + 1, 100000)) as t_us from s union select track as key, t_us from obs where kind = 'error'",
}
