"""Queries of rosters, as-of positions and gaps, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gaps, roster
from ..operators import samples as sm
from ..sources.adapter import OBS_SQL, observations, table
from .reports import PITCH, _with

GRID_US = 1_000_000


def _obs(s, d):
    return observations(s, d)


def _samples(s, d):
    return sm.samples(observations(s, d), PITCH)


def _asked(s, d):
    """Times asked of each identity: up to a virtual second after each event of it."""
    return _obs(s, d).select("id", (F.col("t_us") + (F.col("ord") % 7) * 150_000).alias("t_us")).distinct()


def _frames_of(s, d):
    return _obs(s, d).select("team", "frame_idx").distinct()


def _changes(s, d):
    """Substitutions from orders: a customer that is also an identity goes off, or comes on."""
    o = table(s, d, "orders")
    return o.select(F.concat(F.lit("U"), (F.col("o_custkey") % 150).cast("string")).alias("id"), ((F.col("o_orderkey") * 7919) % 65_000_000).cast("long").alias("t_us"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 3 != 0).alias("active"))


def _cells(s, d):
    k = _samples(s, d).withColumn("step", F.floor(F.col("t_us") / GRID_US))
    k = k.groupBy("id", "team", "step").agg(F.max_by("x_m", F.struct("t_us", "ord")).alias("x_m"), F.max_by("y_m", F.struct("t_us", "ord")).alias("y_m"))
    # Every step between the first and the last that any member of the team has.
    grid = k.groupBy("team").agg(F.explode(F.sequence(F.min("step"), F.max("step"))).alias("step"))
    return gaps.on_grid(k, grid)


def _aged(s, d):
    c = gaps.carried(_cells(s, d)).where("age > 0 and n is not null")
    err = F.abs(F.col("n.x_m") - F.col("p.x_m")) + F.abs(F.col("n.y_m") - F.col("p.y_m"))
    return c.select(gaps.age_bucket(F.col("age")).alias("bucket"), err.alias("err"))


def _standing(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("track").orderBy("t_us", "ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    o = _obs(s, d)
    o = o.withColumn("square", sm.squared_step(F.col("x_m"), F.col("y_m"), F.first("x_m").over(w), F.first("y_m").over(w)))
    g = o.groupBy("track").agg(F.count(F.lit(1)).alias("hits"), (F.max("t_us") - F.min("t_us")).alias("span_us"), F.max("square").alias("far"))
    return g.where("hits >= 3 and span_us >= 2000000").select("track", "hits", "span_us", (F.col("far") <= 4_000_000).alias("standing"))


def _longest(s, d):
    from pyspark.sql import Window

    w, v = Window.partitionBy("user_id").orderBy("t_us", "ord"), Window.partitionBy("user_id", "kind").orderBy("t_us", "ord")
    o = _obs(s, d).withColumn("island", F.row_number().over(w) - F.row_number().over(v))
    g = o.groupBy("user_id", "kind", "island").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("kind").agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("runs"))


QUERIES = {
    "track_summary": lambda s, d: roster.track_summary(_obs(s, d)),
    "roster_obs": lambda s, d: roster.roster_observations(_obs(s, d)),
    "anon_fragments": lambda s, d: roster.fragments(_obs(s, d)),
    "roster_status": lambda s, d: roster.roster_status(_obs(s, d), 11),
    "participation": lambda s, d: roster.participation(_obs(s, d)),
    "labels": lambda s, d: roster.labels(_obs(s, d)),
    "label_changes": lambda s, d: roster.relabelled(roster.labels(_obs(s, d).where("ord % 3 > 0")), roster.labels(_obs(s, d))),
    "visibility_shares": lambda s, d: roster.visibility_shares(_obs(s, d), _frames_of(s, d)),
    "goal_majority": lambda s, d: roster.majority(_obs(s, d).withColumn("side", F.when(F.col("x_m") < 400, "left").otherwise("right")), "id", "side", 15, 75),
    "active_at": lambda s, d: roster.substitution_state(_obs(s, d), _changes(s, d)),
    "positions_at": lambda s, d: gaps.positions_at(_samples(s, d), _asked(s, d)),
    "nearest_point": lambda s, d: gaps.nearest(_obs(s, d), _asked(s, d).withColumnRenamed("t_us", "q_us"), 125_000),
    "bridge_gaps": lambda s, d: gaps.bridged(_samples(s, d), 500_000, 40_000),
    "carry_forward": lambda s, d: gaps.carried(_cells(s, d)).select("id", "step", F.col("p.x_m").alias("x"), F.col("p.y_m").alias("y"), "age", "until"),
    "imputed": lambda s, d: gaps.imputed(_cells(s, d)),
    "timeline_kinds": lambda s, d: gaps.imputed(_cells(s, d)).groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n")),
    "age_buckets": lambda s, d: gaps.upper_quantiles(_aged(s, d), "bucket", "err"),
    "jump_counts": lambda s, d: gaps.jumps(_samples(s, d)),
    "team_centre": lambda s, d: gaps.centres(_obs(s, d)),
    "teleports": lambda s, d: gaps.teleports(_obs(s, d).withColumn("track_key", F.col("user_id")), 2_000_000, 40),
    "standing": _standing,
    "longest_run": _longest,
    "quantiles": lambda s, d: gaps.upper_quantiles(_obs(s, d), "kind", "pitch_conf"),
}

_CELLS = _with(""", cells0 as (
  select id, team, t_us // 1000000 as step, arg_max(x_m, (t_us, ord)) as x_m, arg_max(y_m, (t_us, ord)) as y_m from s group by 1, 2, 3
), cells as (
  select i.id, g.step, c.x_m, c.y_m from (select distinct id, team from s) i join (select team, unnest(range(min(step), max(step) + 1)) as step from cells0 group by team) g using (team) left join cells0 c on c.id = i.id and c.step = g.step
), carried as (
  select *, last_value(case when x_m is not null then step end ignore nulls) over w as ps, last_value(x_m ignore nulls) over w as px, last_value(y_m ignore nulls) over w as py,
    first_value(case when x_m is not null then step end ignore nulls) over v as ns, first_value(x_m ignore nulls) over v as nx, first_value(y_m ignore nulls) over v as ny
  from cells window w as (partition by id order by step rows between unbounded preceding and current row), v as (partition by id order by step rows between current row and unbounded following)
), aged as (select *, step - ps as age, ns - step as until, least(coalesce(step - ps, 1073741824), coalesce(ns - step, 1073741824)) as near from carried
), kinds as (select *, case when age = 0 then 'O' when age + until <= 2 then 'I' when near <= 25 then 'P' else 'U' end as kind from aged)
""")
_ASKED = "asked as (select distinct id, t_us + (ord % 7) * 150000 as t_us from obs)"

ORACLE_SQL = {
    "track_summary": f"with {OBS_SQL} select track, min(a) as first_us, max(b) as last_us, sum(n)::bigint as n, string_agg(concat(state, ':', n), ',' order by concat(state, ':', n)) as states from (select track, state, count(*) as n, min(t_us) as a, max(t_us) as b from obs group by 1, 2) group by track",
    "roster_obs": f"with {OBS_SQL} select id, min(t_us) as first_us, max(t_us) as last_us, count(distinct frame_idx) as frames, count(distinct track) as tracks from obs group by id",
    "anon_fragments": f"with {OBS_SQL} select user_id, min(frame_idx) as first_frame, max(frame_idx) as last_frame, count(*) as frames from (select *, frame_idx - row_number() over (partition by user_id order by frame_idx) as island from (select distinct user_id, frame_idx from obs where state = 'uncertain')) group by user_id, island",
    "roster_status": f"with {OBS_SQL}, ends as (select video, min(frame_idx) as a, max(frame_idx) as b from obs group by 1), per as (select video, team, id, max(frame_idx) as last from obs where in_roster group by 1, 2, 3) select team, count(*) as identities, count(*) filter ((last - a) * 100 >= (b - a) * 90) as active, greatest(0, count(*) - 11) as over_cap from per join ends using (video) group by team",
    "participation": f"with {OBS_SQL}, per as (select frame_idx, team, id, max(case when x_m < 40 or x_m > 960 or y_m < 40 or y_m > 960 then 1 else 0 end) as edge from obs group by 1, 2, 3), mates as (select frame_idx, team, count(*) as mates from per group by 1, 2) select id, count(*) as frames, sum(edge)::bigint as edge_frames, max(mates) as most_mates, sum(edge)::double / count(*) as edge_share from per join mates using (frame_idx, team) group by id",
    "label_changes": f"with {OBS_SQL}, per as (select k, team, id, count(distinct frame_idx) as presence, min(ord) as created from obs, (values (0), (1)) v(k) where in_roster and (k = 1 or ord % 3 > 0) group by 1, 2, 3), ranked as (select *, row_number() over (partition by k, team order by presence // 2 desc, created) as r from per), named as (select k, id, case when r <= 10 then concat(team, '-', lpad(r::varchar, 2, '0')) else concat(team, '-?') end as label from ranked) select coalesce(o.id, n.id) as id, o.label as old_label, n.label as new_label from (select * from named where k = 0) o full join (select * from named where k = 1) n on n.id = o.id where o.label is distinct from n.label",
    "labels": f"with {OBS_SQL}, per as (select team, id, count(distinct frame_idx) as presence, min(ord) as created from obs where in_roster group by 1, 2), ranked as (select *, row_number() over (partition by team order by presence // 2 desc, created) as r from per) select team, id, presence, case when r <= 10 then concat(team, '-', lpad(r::varchar, 2, '0')) else concat(team, '-?') end as label from ranked",
    "visibility_shares": f"with {OBS_SQL}, o as (select * from obs), seen as (select id, team, frame_idx, max(case when state = 'confirmed' then 1 else 0 end) as sure from o group by 1, 2, 3) select i.id, case when sure = 1 then 'O' when sure = 0 then 'S' else 'U' end as class, count(*) as frames from (select distinct id, team from o) i join (select distinct team, frame_idx from o) f on f.team = i.team left join seen s on s.id = i.id and s.frame_idx = f.frame_idx group by 1, 2",
    "goal_majority": f"with {OBS_SQL}, per as (select id, case when x_m < 400 then 'left' else 'right' end as side, count(*) as n from obs group by 1, 2), top as (select id, sum(n)::bigint as total, max(n) as best, arg_max(side, (n, side)) as side from per group by id) select id, total, case when total >= 15 and best * 100 >= total * 75 then side end as winner from top",
    "active_at": f"with {OBS_SQL}, changes as (select concat('U', o_custkey % 150) as id, (o_orderkey * 7919) % 65000000 as t_us, o_orderkey as seq, o_orderkey % 3 <> 0 as active from orders), one as (select id, t_us, arg_max(active, seq) as active from changes group by 1, 2), last as (select o.ord, c.active from obs o asof join one c on c.id = o.id and c.t_us <= o.t_us) select id, t_us, ord, coalesce(active, true) as is_active from obs left join last using (ord)",
    "positions_at": _with(f""", {_ASKED}, near as (
  select a.id, a.t_us, p.t_us as pt, p.x_m as px, p.y_m as py, (select min(n.t_us) from s n where n.id = a.id and n.t_us > a.t_us) as nt
  from asked a asof left join s p on p.id = a.id and p.t_us <= a.t_us
), full_near as (select q.*, n.x_m as nx, n.y_m as ny from near q left join s n on n.id = q.id and n.t_us = q.nt
), kinds as (select *, case when t_us - pt <= 10000 then 1 when nt - t_us <= 10000 then 2 when nt - pt <= 1000000 then 3 when t_us - pt <= 600000 then 4 end as k from full_near)
select id, t_us, case when k in (1, 2) then 'OBSERVED' when k = 3 then 'INTERPOLATED' when k = 4 then 'HELD' end as kind,
  case when k in (1, 4) then px::double when k = 2 then nx::double when k = 3 then px + (nx - px) * ((t_us - pt) / (nt - pt)) end as x,
  case when k in (1, 4) then py::double when k = 2 then ny::double when k = 3 then py + (ny - py) * ((t_us - pt) / (nt - pt)) end as y from kinds"""),
    "nearest_point": f"with {OBS_SQL}, {_ASKED} select a.id, a.t_us as q_us, o.ord, o.t_us, abs(o.t_us - a.t_us) as off from asked a join obs o on o.id = a.id and abs(o.t_us - a.t_us) <= 125000 qualify row_number() over (partition by a.id, a.t_us order by abs(o.t_us - a.t_us), o.ord desc) = 1",
    "bridge_gaps": _with("""select id, t_us + k * 40000 as t_us, x_m + (x1 - x_m) * (k * 40000 / (t1 - t_us)) as x, y_m + (y1 - y_m) * (k * 40000 / (t1 - t_us)) as y
from (select *, unnest(range(1, (t1 - t_us - 1) // 40000 + 1)) as k from (select id, t_us, x_m, y_m, lead(t_us) over w as t1, lead(x_m) over w as x1, lead(y_m) over w as y1 from s window w as (partition by id order by t_us, ord)) where t1 - t_us <= 500000 and t1 - t_us > 40000)"""),
    "carry_forward": _CELLS + "select id, step, px as x, py as y, age, until from aged",
    "imputed": _CELLS
    + "select id, step, kind, case when kind <> 'U' then case when age = 0 then px::double when ps is not null and ns is not null then (px * until + nx * age) / (age + until) else coalesce(px, nx)::double end end as x, case when kind <> 'U' then case when age = 0 then py::double when ps is not null and ns is not null then (py * until + ny * age) / (age + until) else coalesce(py, ny)::double end end as y, case when kind <> 'U' then near end as near from kinds",
    "timeline_kinds": _CELLS + "select id, kind, count(*) as n from kinds group by 1, 2",
    "age_buckets": _CELLS
    + ", errs as (select case when age < 1 then '0-1' when age < 3 then '1-3' when age < 8 then '3-8' when age < 20 then '8-20' else '>20' end as bucket, abs(nx - px) + abs(ny - py) as err from aged where age > 0 and ns is not null), r as (select *, row_number() over (partition by bucket order by err) as rank, count(*) over (partition by bucket) as n from errs) select bucket, max(n) as n, max(err) filter (rank = n // 2 + 1) as median, max(err) filter (rank = greatest(1, n * 9 // 10)) as p90 from r group by bucket",
    "jump_counts": _with("select before, kind, count(*) as steps, count(*) filter (square * 1000000 > 144 * dt * dt) as fast from (select *, lag(kind) over (partition by id order by t_us, ord) as before from s) where before is not null and dt > 0 group by 1, 2"),
    "team_centre": f"with {OBS_SQL} select team, frame_idx, count(*) as voters, sum(x_m * pitch_conf * pitch_conf)::double / sum(pitch_conf * pitch_conf)::double as x, sum(y_m * pitch_conf * pitch_conf)::double / sum(pitch_conf * pitch_conf)::double as y from obs where pitch_conf > 0 group by 1, 2 having count(*) >= 4",
    "teleports": f"with {OBS_SQL}, i as (select *, sum(case when state = 'uncertain' then 1 else 0 end) over (partition by user_id order by t_us, ord rows unbounded preceding) as island from obs), st as (select user_id, t_us - lag(t_us) over w as dt, ((x_m - lag(x_m) over w) * 105) ** 2 + ((y_m - lag(y_m) over w) * 68) ** 2 as square from i where state <> 'uncertain' window w as (partition by user_id, island order by t_us, ord)) select user_id as track_key, count(*) filter (dt > 0 and dt <= 2000000 and square * 1000000 > 1600 * dt * dt) as teleports, count(*) as shown from st group by 1",
    "standing": f"with {OBS_SQL}, f as (select *, first_value(x_m) over w as fx, first_value(y_m) over w as fy from obs window w as (partition by track order by t_us, ord)) select track, count(*) as hits, max(t_us) - min(t_us) as span_us, max(((x_m - fx) * 105) * ((x_m - fx) * 105) + ((y_m - fy) * 68) * ((y_m - fy) * 68)) <= 4000000 as standing from f group by track having count(*) >= 3 and max(t_us) - min(t_us) >= 2000000",
    "longest_run": f"with {OBS_SQL}, i as (select user_id, kind, row_number() over (partition by user_id order by t_us, ord) - row_number() over (partition by user_id, kind order by t_us, ord) as island from obs), g as (select user_id, kind, island, count(*) as n from i group by 1, 2, 3) select kind, max(n) as longest, count(*) as runs from g group by kind",
    "quantiles": f"with {OBS_SQL}, r as (select kind, pitch_conf, row_number() over (partition by kind order by pitch_conf) as rank, count(*) over (partition by kind) as n from obs) select kind, max(n) as n, max(pitch_conf) filter (rank = n // 2 + 1) as median, max(pitch_conf) filter (rank = greatest(1, n * 9 // 10)) as p90 from r group by kind",
}
