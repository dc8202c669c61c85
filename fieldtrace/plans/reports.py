"""Queries of samples and player reports, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as an
from ..operators import samples as sm
from ..sources.adapter import OBS_SQL, observations

T0, T1 = 10_000_000, 50_000_000
#: Lower bar for pitch confidence, in hundredths, at which tracks of the adapted data have runs.
PITCH = 20
SIGMA = 2.5


def _samples(spark, d):
    return sm.samples(observations(spark, d), PITCH)


QUERIES = {
    "samples_kept": lambda s, d: sm.kept(observations(s, d)).select("id", "frame_idx", "ord", "t_us", "x_m", "y_m", "team", "role"),
    "exclusion_counts": lambda s, d: sm.exclusions(observations(s, d)),
    "track_breaks": lambda s, d: _samples(s, d).select("id", "ord", "t_us", "dt", "square", "why"),
    "runs": lambda s, d: _samples(s, d).groupBy("id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us")),
    "smoothed": lambda s, d: sm.smoothed(_samples(s, d)).select("id", "ord", (F.col("sum_x") / F.col("near")).alias("x"), (F.col("sum_y") / F.col("near")).alias("y"), "near"),
    "weights": lambda s, d: _samples(s, d).select("id", "ord", "w"),
    "coverage": lambda s, d: an.coverage(_samples(s, d), T0, T1),
    "average_position": lambda s, d: an.averages(an.in_range(_samples(s, d), T0, T1)).select("id", "x", "y"),
    "trail_summary": lambda s, d: an.trail_summary(_samples(s, d)),
    "trail_breaks": lambda s, d: an.trail_breaks(_samples(s, d)),
    "identity_report": lambda s, d: an.identity_report(_samples(s, d), T0, T1),
    "heat_cells": lambda s, d: an.heat_cells(an.in_range(_samples(s, d), T0, T1)),
    "heat_blur": lambda s, d: an.heat_blur(an.heat_cells(_samples(s, d), 5), SIGMA, 5),
    "team_averages": lambda s, d: an.averages(an.in_range(_samples(s, d), T0, T1)).orderBy("team", F.col("role") != "PLAYER", "id"),
    "clamped_range": lambda s, d: an.clamp_range(_samples(s, d).groupBy("id").agg(F.min("t_us").alias("start"), F.max("t_us").alias("end")), T0, T1),
    "current_block": lambda s, d: an.current_block(observations(s, d).select("ord", (F.col("t_us") * 20).alias("t_us"))),
    "duplicates_per_frame": lambda s, d: an.duplicates(observations(s, d)),
}


def _with(body: str, pitch: int = PITCH) -> str:
    return f"""with {OBS_SQL}, judged as (
  select *, case when not in_roster then 'notInRoster' when state <> 'confirmed' then 'notConfirmed' when identity_conf < 30 then 'lowIdentityConfidence'
    when x_m < -20 or x_m > 1020 or y_m < -20 or y_m > 1020 then 'offPitch' when pitch_conf < {pitch} then 'lowPitchConfidence' when clipped then 'clipped' else 'kept' end as reason
  from obs
), kept as (
  select * from judged where reason = 'kept' qualify row_number() over (partition by frame_idx, id order by ord) = 1
), steps as (
  select *, t_us - lag(t_us) over w as dt, lead(t_us) over w - t_us as ahead,
    ((x_m - lag(x_m) over w) * 105) * ((x_m - lag(x_m) over w) * 105) + ((y_m - lag(y_m) over w) * 68) * ((y_m - lag(y_m) over w) * 68) as square
  from kept window w as (partition by id order by t_us, ord)
), broken as (
  select *, case when dt > 1000000 then 'unseen' when dt > 0 and square * 1000000 > 144 * dt * dt and square >= 4000000 then 'jump' else '' end as why,
    case when dt is null then 40000 else least(dt, 500000) end + case when ahead is null then 40000 else least(ahead, 500000) end as w
  from steps
), s as (
  select *, sum(case when why <> '' then 1 else 0 end) over (partition by id order by t_us, ord rows unbounded preceding)::bigint as run from broken
), cut as (select * from s where t_us between {T0} and {T1})
{body}""".replace(")\n, ", "),\n")


_COVER = f"select id, least(sum(w), {2 * (T1 - T0)})::bigint as half_us, least(sum(w), {2 * (T1 - T0)}) / {2 * (T1 - T0)} as share, count(*) as samples, least(sum(w), {2 * (T1 - T0)}) / {2 * (T1 - T0)} < 0.5 as low from cut group by id"
_AVERAGE = "select id, sum(x_m * w)::double / sum(w)::double as x, sum(y_m * w)::double / sum(w)::double as y, any_value(team) as team, any_value(role) as role from cut group by id"
_TRAIL = """select id, count(distinct run) as segments, sum(case when why <> '' then 1 else 0 end)::bigint as breaks, sum(case when why = 'unseen' then dt else 0 end)::bigint as unseen_us,
  sum(coalesce(floor(sqrt(step::double) * 10)::bigint, 0))::bigint as tenth_mm
from (select *, ((x_m - lag(x_m) over v) * 105) ** 2 + ((y_m - lag(y_m) over v) * 68) ** 2 as step from s window v as (partition by id, run order by t_us, ord)) group by id"""
_TAPS = ", ".join(f"({a}, {b})" for a, b in an.kernel(SIGMA))
_CELL = lambda n: f"select id, least(greatest(trunc(x_m * 105 / {1000e0 * n})::int, 0), {105 // n - 1}) as cx, least(greatest(trunc(y_m * 68 / {1000e0 * n})::int, 0), {-(-68 // n) - 1}) as cy, sum(w)::bigint as half_us"

ORACLE_SQL = {
    "samples_kept": _with("select id, frame_idx, ord, t_us, x_m, y_m, team, role from kept", 50),
    "exclusion_counts": _with("select reason, count(*) as n from judged group by reason", 50),
    "track_breaks": _with("select id, ord, t_us, dt, square, why from s"),
    "runs": _with("select id, run, count(*) as n, min(t_us) as start_us, max(t_us) as end_us from s group by id, run"),
    "smoothed": _with(
        "select id, ord, (sum(x_m) over n)::double / count(*) over n as x, (sum(y_m) over n)::double / count(*) over n as y, count(*) over n as near from s window n as (partition by id, run order by t_us range between 70000 preceding and 70000 following)"
    ),
    "weights": _with("select id, ord, w from s"),
    "coverage": _with(_COVER),
    "average_position": _with(f"select id, x, y from ({_AVERAGE})"),
    "trail_summary": _with(_TRAIL),
    "trail_breaks": _with("select id, t_us - dt as from_us, t_us as to_us, dt as gap_us, why from s where why <> ''"),
    "identity_report": _with(f"select * from ({_COVER}) join ({_AVERAGE}) using (id) join ({_TRAIL}) using (id)"),
    "heat_cells": _with(f"{_CELL(1)} from cut group by 1, 2, 3"),
    "heat_blur": _with(
        f""", cells as ({_CELL(5)} from s group by 1, 2, 3), taps(step, tap) as (values {_TAPS}),
one as (select id, cx + step as cx, cy, sum(half_us // 1000 * tap)::bigint as v from cells, taps where cx + step between 0 and 20 group by 1, 2, 3),
two as (select id, cx, cy + step as cy, sum(v // 1000000 * tap)::bigint as v from one, taps where cy + step between 0 and 13 group by 1, 2, 3)
select id, cx, cy, v * (total / kept) as half_us from two join (select id, sum(half_us)::bigint as total from cells group by 1) using (id) join (select id, sum(v)::bigint as kept from two group by 1) using (id)"""
    ),
    "team_averages": _with(_AVERAGE),
    "clamped_range": _with(f"select id, least(greatest({T0}, lo), hi) as a, greatest(least(greatest({T0}, lo), hi), least(greatest({T1}, lo), hi)) as b from (select id, min(t_us) as lo, max(t_us) as hi from s group by id)"),
    "current_block": _with("select ord, t_us * 20 as t_us, t_us * 20 // 300000000 as block, t_us * 20 // 300000000 * 300000000 as block_start, (t_us * 20 // 300000000 + 1) * 300000000 as block_end from obs"),
    "duplicates_per_frame": _with("select frame_idx, id, count(*) as n from obs where x_m between -100 and 1100 and y_m between -100 and 1100 group by 1, 2 having count(*) > 1"),
}
