"""Queries of motion, hidden players, trails and fragments, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gaps, trails
from ..operators import imputation as im
from ..operators import samples as sm
from ..sources.adapter import OBS_SQL, observations
from .reports import PITCH, _with
from .tracks import _ASKED, _asked


def _cells(s, d):
    """The first sample of each identity in each virtual second, in metres, on the grid of its team."""
    k = sm.samples(observations(s, d), PITCH).withColumn("step", F.floor(F.col("t_us") / 1_000_000))
    first = F.struct("t_us", "ord")
    k = k.groupBy("id", "team", "step").agg(F.min_by("x_m", first).alias("x_m"), F.min_by("y_m", first).alias("y_m"), F.min_by("pitch_conf", first).alias("conf"))
    # A third of the seconds is hidden, so that there is something to estimate.
    k = k.where("(step + ascii(substring(id, -1))) % 3 <> 0 or step % 10 = 0")
    grid = k.groupBy("team").agg(F.explode(F.sequence(F.min("step"), F.max("step"))).alias("step"))
    c = k.select("id", "team").distinct().join(grid, "team").join(k, ["id", "team", "step"], "left")
    return c.select("id", "team", "step", (F.col("x_m") * 0.105).alias("x"), (F.col("y_m") * 0.068).alias("y"), F.when(F.col("conf").isNotNull(), 0.5 + (100 - F.col("conf")) / 50.0).alias("sigma"))


def _centres(s, d):
    return im.first_centres(_cells(s, d), 4)


def _estimated(s, d):
    return im.estimated(_cells(s, d), _centres(s, d))


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _sampled(s, d):
    k = sm.samples(observations(s, d), PITCH)
    k = k.withColumns({"kind": F.when(F.col("identity_conf") < 50, "P").otherwise("O"), "sigma": F.when(F.col("identity_conf") < 50, (100 - F.col("identity_conf")) / 10.0)})
    return gaps.sampled(k, _asked(s, d))


def _learned(s, d):
    """Offsets and centres in turn, three times; two in view are enough in these thin tables."""
    return im.learned_centres(_cells(s, d), first=2, least=2)


QUERIES = {
    "velocity_window": lambda s, d: _rounded(im.velocities(_cells(s, d).where("x is not null")), "back_x", "back_y", "ahead_x", "ahead_y"),
    "team_shift": lambda s, d: _rounded(im.one_sided(_cells(s, d), _centres(s, d)), "held_s", "shift_x", "shift_y", "shift_s").select("id", "step", "age", "held_s", "shift_x", "shift_y", "shift_s"),
    "estimated": lambda s, d: _rounded(_estimated(s, d), "x", "y", "sigma"),
    "estimate_kinds": lambda s, d: _estimated(s, d).groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n")),
    "role_offsets": lambda s, d: _rounded(im.role_offsets(_cells(s, d), _centres(s, d)).where("ox is not null"), "ox", "oy", "ovar").select("id", "step", "ox", "oy", "ovar"),
    "voted_centres": lambda s, d: _rounded(_learned(s, d), "cx", "cy", "var"),
    "sampled_at": _sampled,
    "drawn_at": lambda s, d: _sampled(s, d).where("kind <> 'P' or sigma <= 8").groupBy("id", "source").agg(F.count(F.lit(1)).alias("n")),
    "own_speed": lambda s, d: _rounded(trails.own_speed(observations(s, d), 300_000), "speed"),
    "attachment": lambda s, d: trails.attached(observations(s, d), 400_000, 1_200_000, 60),
    "issue_sections": lambda s, d: trails.sections(observations(s, d).where("pitch_conf < 20"), 400_000, 1_200_000),
    "trail_segments": lambda s, d: trails.trail(observations(s, d), 30_000_000, 20_000_000, 2_500_000),
    "spaced_hits": lambda s, d: trails.confirmed_after(observations(s, d), "identity_conf >= 50", 3),
    "downsampled": lambda s, d: observations(s, d).withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("t_us", "ord"))).where("(k - 1) % 5 = 0").select("id", "ord", "t_us"),
    "label_segments": lambda s, d: trails.label_segments(observations(s, d), "event_kind_cut"),
    "scene_changes": lambda s, d: trails.scene_changes(observations(s, d).where("kind = 'error'"), 100_000, 3),
    "same_track_neighbours": lambda s, d: trails.neighbours(trails.label_segments(observations(s, d), "event_kind_cut"), 1_000_000),
}

_CELLS = _with(""", c0 as (
  select id, team, t_us // 1000000 as step, arg_min(x_m, (t_us, ord)) as x_m, arg_min(y_m, (t_us, ord)) as y_m, arg_min(pitch_conf, (t_us, ord)) as conf from s group by 1, 2, 3
), c1 as (select * from c0 where (step + ascii(right(id, 1))) % 3 <> 0 or step % 10 = 0
), cells as (
  select i.id, i.team, g.step, c.x_m * 0.105e0 as x, c.y_m * 0.068e0 as y, case when conf is not null then 0.5e0 + (100 - conf) / 50e0 end as sigma
  from (select distinct id, team from c1) i join (select team, unnest(range(min(step), max(step) + 1)) as step from c1 group by 1) g using (team) left join c1 c on c.id = i.id and c.step = g.step
), centres as (select team, step, avg(x) as cx, avg(y) as cy, 1e0 as var from cells where x is not null group by 1, 2 having count(*) >= 4
), both_ways as (select c.*, cx, cy, var from cells c left join centres using (team, step)
)""")


def _side(name: str, order: str) -> str:
    """One-sided estimates of all cells as a table expression."""
    ramp = "(1 - exp(-age / 2e0))"
    return f"""{name}0 as (select *, last_value(case when x is not null then {{'step': step, 'x': x, 'y': y, 's': sigma, 'cx': cx, 'cy': cy, 'var': var}} end ignore nulls) over (partition by id order by {order} rows unbounded preceding) as p from both_ways
), {name}1 as (select *, abs(step - p.step)::double as age from {name}0 where p is not null
), {name} as (select id, step, age, p.x as held_x, p.y as held_y, sqrt(p.s * p.s + 3.24e0 * age * age) as held_s,
    case when p.cx is not null and cx is not null then p.x + {ramp} * (cx - p.cx) else p.x end as shift_x, case when p.cy is not null and cy is not null then p.y + {ramp} * (cy - p.cy) else p.y end as shift_y,
    case when age = 0 then p.s when p.cx is not null and cx is not null then sqrt(p.s * p.s + {ramp} * (var + p.var) + 0.64e0 * age * age) else sqrt(p.s * p.s + 3.24e0 * age * age) end as shift_s from {name}1 where age <= 25
)"""


_EST = f"""{_CELLS}, {_side('f', 'step')}, {_side('b', 'step desc')}, j as (
  select c.id, c.step, c.x, c.y, c.sigma, f.age as fa, b.age as ba, f.age + b.age as gap, case when f.age + b.age > 0 then f.age / (f.age + b.age) else 0.5e0 end as u,
    f.held_x as fx, f.held_y as fy, f.held_s as fs, b.held_x as bx, b.held_y as by_, b.held_s as bs, coalesce(f.shift_x, b.shift_x) as sx, coalesce(f.shift_y, b.shift_y) as sy, coalesce(f.shift_s, b.shift_s) as ss
  from cells c left join f on f.id = c.id and f.step = c.step left join b on b.id = c.id and b.step = c.step
), e as (select id, step, case when x is not null then 'O' when gap <= 1 then 'I' when fa is not null or ba is not null then 'P' else 'U' end as kind,
    case when x is not null then x when gap is not null then (1 - u) * fx + u * bx else sx end as x, case when x is not null then y when gap is not null then (1 - u) * fy + u * by_ else sy end as y,
    case when x is not null then sigma when gap is not null then sqrt((1 - u) * fs * ((1 - u) * fs) + u * bs * (u * bs)) + case when gap <= 1 then 0.5e0 * sqrt(gap) else 0 end else ss end as sigma,
    case when x is not null then 0e0 else least(fa, ba) end as age from j
), est as (select id, step, case when lost then 'U' else kind end as kind, case when not lost then x end as x, case when not lost then y end as y, case when not lost then sigma end as sigma, case when not lost then age end as age
  from (select *, kind = 'U' or (kind = 'P' and (sigma > 15 or age > 25)) as lost from e))
"""
_SAMPLED = _with(f""", k as (select id, t_us, ord, x_m, y_m, identity_conf / 100e0 as c, pitch_conf / 100e0 as q, case when identity_conf < 50 then 'P' else 'O' end as kind, case when identity_conf < 50 then (100 - identity_conf) / 10e0 end as sigma from s qualify row_number() over (partition by id, t_us order by ord desc) = 1
), {_ASKED}, near as (select a.id, a.t_us, p.t_us as pt, p.x_m as px, p.y_m as py, p.c as pc, p.q as pq, p.kind as pk, p.sigma as ps, (select min(n.t_us) from k n where n.id = a.id and n.t_us > a.t_us) as nt from asked a asof left join k p on p.id = a.id and p.t_us <= a.t_us
), w as (select q.*, n.x_m as nx, n.y_m as ny, n.c as nc, n.q as nq, n.kind as nk, n.sigma as ns from near q left join k n on n.id = q.id and n.t_us = q.nt
), m as (select *, case when t_us - pt <= 10000 then 1 when nt - t_us <= 10000 then 2 when nt - pt <= 1000000 then 3 when t_us - pt <= 600000 then 4 end as how, (t_us - pt) / (nt - pt) as u, (t_us - pt) / 600000e0 as h from w
), sampled as (select id, t_us,
  case when how = 1 then pk when how = 2 then nk when how = 3 then case when pk = 'P' or nk = 'P' then 'P' else 'I' end when how = 4 then pk end as kind,
  case how when 1 then case when pk = 'P' then 'PREDICTED' else 'OBSERVED' end when 2 then case when nk = 'P' then 'PREDICTED' else 'OBSERVED' end when 3 then case when pk = 'P' or nk = 'P' then 'PREDICTED' else 'INTERPOLATED' end when 4 then 'HELD' end as source,
  case how when 2 then nx::double when 3 then px + (nx - px) * u else px::double end as x, case how when 2 then ny::double when 3 then py + (ny - py) * u else py::double end as y,
  case how when 1 then pc when 2 then nc when 3 then least(pc, nc) else pc * (1 - h) end as confidence,
  case how when 1 then ps when 2 then ns when 3 then nullif(greatest(coalesce(ps, 0), coalesce(ns, 0)), 0) else ps end as sigma,
  case how when 4 then 1 - 0.7e0 * h else 1 end as alpha, case how when 2 then nq when 3 then least(pq, nq) else pq end as quality from m where how is not null)
""")
_CUT = "segs as (select *, sum(cut) over (partition by track order by t_us, ord rows unbounded preceding)::bigint as segment from (select *, case when kind = 'purchase' then 1 else 0 end as cut from obs))"
_FRAG = f"{_CUT}, flagged as (select *, case when lag(state) over w is distinct from state or lag(segment) over w is distinct from segment then 1 else 0 end as new from segs window w as (partition by track order by t_us, ord)), frags as (select track, frag, any_value(state) as label, any_value(segment) as segment, min(t_us) as t0, max(t_us) as t1, count(*) as n from (select *, sum(new) over (partition by track order by t_us, ord rows unbounded preceding)::bigint as frag from flagged) group by 1, 2)"

ORACLE_SQL = {
    "velocity_window": f"""{_CELLS}, seen as (select * from cells where x is not null) select id, step, round(case when bs = step then 0e0 else (x - bx) / (step - bs) end, 6) as back_x, round(case when bs = step then 0e0 else (y - by_) / (step - bs) end, 6) as back_y,
  round(case when a_s = step then 0e0 else (x - ax) / (step - a_s) end, 6) as ahead_x, round(case when a_s = step then 0e0 else (y - ay) / (step - a_s) end, 6) as ahead_y
from (select *, first_value(step) over b as bs, first_value(x) over b as bx, first_value(y) over b as by_, last_value(step) over a as a_s, last_value(x) over a as ax, last_value(y) over a as ay from seen window b as (partition by id order by step range between 1 preceding and current row), a as (partition by id order by step range between current row and 1 following))""",
    "team_shift": f"{_CELLS}, {_side('f', 'step')} select id, step, age, round(held_s, 6) as held_s, round(shift_x, 6) as shift_x, round(shift_y, 6) as shift_y, round(shift_s, 6) as shift_s from f",
    "estimated": f"{_EST} select id, step, kind, round(x, 6) as x, round(y, 6) as y, round(sigma, 6) as sigma, age from est",
    "estimate_kinds": f"{_EST} select id, kind, count(*) as n from est group by 1, 2",
    "sampled_at": f"{_SAMPLED} select * from sampled",
    "drawn_at": f"{_SAMPLED} select id, source, count(*) as n from sampled where kind <> 'P' or sigma <= 8 group by 1, 2",
    "own_speed": f"with {OBS_SQL}, n as (select id, ord, t_us, first_value(t_us) over b as t0, first_value(x_m) over b as x0, first_value(y_m) over b as y0, first_value(ord) over b as o0, last_value(t_us) over b as t1, last_value(x_m) over b as x1, last_value(y_m) over b as y1 from obs window b as (partition by id order by t_us, ord rows between 1 preceding and 1 following)), near as (select o.id, o.ord, lag(o.t_us) over w as pt, lag(o.x_m) over w as px, lag(o.y_m) over w as py, o.t_us, o.x_m, o.y_m, lead(o.t_us) over w as nt, lead(o.x_m) over w as nx, lead(o.y_m) over w as ny from obs o window w as (partition by id order by t_us, ord)), pick as (select id, ord, case when t_us - pt <= 300000 then pt else t_us end as a, case when t_us - pt <= 300000 then px else x_m end as ax, case when t_us - pt <= 300000 then py else y_m end as ay, case when nt - t_us <= 300000 then nt else t_us end as b, case when nt - t_us <= 300000 then nx else x_m end as bx, case when nt - t_us <= 300000 then ny else y_m end as by_ from near) select id, ord, round(sqrt(((bx - ax) * 105 * ((bx - ax) * 105) + (by_ - ay) * 68 * ((by_ - ay) * 68))::double) / 1000 / greatest(0.001e0, (b - a) / 1e6), 6) as speed from pick where b > a",
    "attachment": f"with {OBS_SQL}, r as (select o.id, o.ord, count(m.ord) filter (m.t_us >= o.t_us - 400000) as recent, count(m.ord) filter (m.t_us >= o.t_us - 400000 and abs(m.x_m - o.x_m) <= 60 and abs(m.y_m - o.y_m) <= 60) as still, count(m.ord) filter (m.t_us < o.t_us - 400000 and abs(m.x_m - o.x_m) <= 60 and abs(m.y_m - o.y_m) <= 60) as older from obs o join obs m on m.id = o.id and m.t_us < o.t_us and m.t_us >= o.t_us - 1200000 group by 1, 2) select id, ord, recent, older from r where recent >= 1 and still = recent",
    "issue_sections": f"with {OBS_SQL}, o as (select * from obs where pitch_conf < 20), st as (select video, t_us, case when t_us - lag(t_us) over w <= 400000 then 0 when t_us - lag(t_us) over w <= 1200000 and kind = lag(kind) over w then 0 else 1 end as new from o window w as (partition by video order by t_us, ord)), g as (select video, t_us, sum(new) over (partition by video order by t_us rows unbounded preceding) as k from st) select video, min(t_us) as start_us, max(t_us) as end_us, count(*) as n from (select *, sum(new) over (partition by video order by t_us, ord rows unbounded preceding)::bigint as section from (select video, ord, t_us, case when t_us - lag(t_us) over w <= 400000 then 0 when t_us - lag(t_us) over w <= 1200000 and kind = lag(kind) over w then 0 else 1 end as new from o window w as (partition by video order by t_us, ord))) group by video, section",
    "trail_segments": f"with {OBS_SQL}, p as (select * from obs where t_us between 10000000 and 30000000), live as (select id from p group by id having max(t_us) >= 27500000), st as (select p.id, p.ord, p.t_us, p.x_m, p.state = 'confirmed' and p.identity_conf >= 30 as ok, case when p.t_us - lag(p.t_us) over w > 2500000 then 1 else 0 end as gap from p join live using (id) window w as (partition by id order by t_us, ord)), g as (select *, sum(case when not ok or gap = 1 then 1 else 0 end) over (partition by id order by t_us, ord rows unbounded preceding)::bigint as seg from st) select id, seg as segment, count(*) as points, min(t_us) as from_us, max(t_us) as to_us from g where ok group by 1, 2 having count(*) > 1",
    "spaced_hits": f"with {OBS_SQL}, i as (select id, t_us, ord, identity_conf >= 50 as hit, row_number() over w - row_number() over (partition by id, identity_conf >= 50 order by t_us, ord) as island from obs window w as (partition by id order by t_us, ord)), r as (select *, row_number() over (partition by id, hit, island order by t_us, ord) as run from i) select id, min(t_us) as first_us, count(*) as times from r where hit and run = 3 group by id",
    "downsampled": f"with {OBS_SQL} select id, ord, t_us from obs qualify (row_number() over (partition by id order by t_us, ord) - 1) % 5 = 0",
    "label_segments": f"with {OBS_SQL}, {_FRAG} select * from frags",
    "scene_changes": f"with {OBS_SQL}, c as (select video, track, t_us, ord from obs where kind = 'error'), n as (select a.video, a.track, a.ord, count(distinct b.track) as tracks from c a join c b on b.video = a.video and abs(b.t_us - a.t_us) <= 100000 group by 1, 2, 3) select video, track, ord, tracks from n where tracks >= 3",
    "same_track_neighbours": f"with {OBS_SQL}, {_FRAG}, near as (select *, lag(frag) over w as before, lag(t1) over w as before_us, lag(segment) over w as bs, lead(frag) over w as after, lead(t0) over w as after_us, lead(segment) over w as a_s from frags window w as (partition by track order by t0, frag)) select track, frag, case when bs = segment and t0 - before_us <= 1000000 then before end as before, case when a_s = segment and after_us - t1 <= 1000000 then after end as after from near where (bs = segment and t0 - before_us <= 1000000) or (a_s = segment and after_us - t1 <= 1000000)",
}
