"""Queries of evidence within frames and between identities, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cues
from ..sources.adapter import OBS_SQL, observations, table
from .matches import _V, _vectors


def _o(s, d):
    return observations(s, d)


def _segments(s, d):
    o = _o(s, d).where("kind = 'signup'")
    return o.select("video", F.col("ord").alias("segment"), F.col("t_us").alias("from_us"), (F.col("t_us") + (F.col("ord") % 50) * 1000).alias("to_us"))


def _fragments(s, d):
    return _o(s, d).groupBy("id", "track").agg(F.min("t_us").alias("t0"), F.max("t_us").alias("t1")).withColumnRenamed("track", "frag")


def _spans(s, d):
    """Days of activity: spans of each identity within its busiest track."""
    t = _o(s, d).groupBy("team", "user_id", "track").agg(F.min("t_us").alias("t0"), F.max("t_us").alias("t1"), F.count(F.lit(1)).alias("n"))
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "track"))
    return t.withColumn("turn", turn).where("turn = 1")


def _nearest_event(s, d):
    """Per identity the event nearest to the middle of the recording."""
    o = _o(s, d)
    return o.groupBy("id").agg(F.min_by("ord", F.struct(F.abs(F.col("t_us") - 32_400_000), "ord")).alias("ord"))


def _aligned(s, d):
    """Rows of two runs of a video that fall on the same hundredth of a second; of one run the last per key."""
    o = _o(s, d).withColumn("key", F.floor(F.col("t_us") / 10_000))
    side = lambda k: o.where(F.col("ord") % 2 == k).groupBy("video", "key").agg(F.max_by("ord", F.struct("t_us", "ord")).alias(f"ord{k}"))
    return side(0).join(side(1), ["video", "key"])


def _review_times(s, d):
    """The first forty distinct fifths of a second that hold an uncertain sighting."""
    return _o(s, d).where("state = 'uncertain'").select((F.floor(F.col("t_us") / 200_000) * 200_000).alias("at_us")).distinct().orderBy("at_us").limit(40)


def _last_events(s, d):
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("t_us"), F.desc("ord")))
    return _o(s, d).withColumn("turn", turn).where("turn <= 5").select("id", "turn", "ord")


QUERIES = {
    "position_cues": lambda s, d: cues.deepest(_o(s, d)),
    "defended_side": lambda s, d: cues.defended_side(_o(s, d)),
    "behaviour_cues": lambda s, d: cues.from_team(_o(s, d)),
    "together_pairs": lambda s, d: cues.together(_o(s, d)),
    "team_slots": lambda s, d: cues.slot_holder(_o(s, d)),
    "crowds": lambda s, d: cues.crowds(_o(s, d), 120, 1),
    "mean_vectors": lambda s, d: cues.mean_vectors(_vectors(s, d)),
    "velocity": lambda s, d: cues.velocity(_o(s, d)),
    "interval_overlap": lambda s, d: cues.overlapping(_o(s, d).select("video", "ord", "t_us"), _segments(s, d), 2_000, 100_000).select("ord", "segment"),
    "sightings_around": lambda s, d: cues.sighting_around(_fragments(s, d), _o(s, d)),
    "span_pairs": lambda s, d: cues.apart_spans(_spans(s, d)),
    "tiles": lambda s, d: cues.tiles(table(s, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") * 60).cast("long").alias("width"), (F.col("p_size") * 34).cast("long").alias("height")), 640, 512),
    "nearest_event": _nearest_event,
    "frame_alignment": _aligned,
    "review_times": _review_times,
    "last_events": _last_events,
}

_TOP2 = lambda side, order: f"select '{side}' as side, min(team) as team from (select *, row_number() over (partition by frame_idx order by {order}, ord) as turn from obs) where turn <= 2 group by frame_idx having count(*) = 2 and min(team) = max(team)"
_ALONG = lambda c: f"list_distinct(list_append(case when {c} > 640 then range(0, {c} - 640 + 1, 512) else [0] end, greatest(0, {c} - 640)))"

ORACLE_SQL = {
    "position_cues": f"with {OBS_SQL}, p as (select *, row_number() over (partition by frame_idx order by x_m, ord) as l, row_number() over (partition by frame_idx order by x_m desc, ord) as r, count(*) over (partition by frame_idx) as n from obs), g as (select frame_idx, max(id) filter (l = 1) as li, max(x_m) filter (l = 2) - max(x_m) filter (l = 1) as lg, max(id) filter (r = 1) as ri, max(x_m) filter (r = 1) - max(x_m) filter (r = 2) as rg from p where n >= 4 group by 1) select frame_idx, case when lg >= 150 then li end as left_id, case when rg >= 150 then ri end as right_id from g",
    "defended_side": f"with {OBS_SQL}, v as ({_TOP2('left', 'x_m')} union all {_TOP2('right', 'x_m desc')}) select side, team, count(*) as votes from v group by 1, 2",
    "behaviour_cues": f"with {OBS_SQL}, p as (select *, count(*) over w - 1 as n, (sum(x_m) over w - x_m)::bigint as sx, (sum(y_m) over w - y_m)::bigint as sy from obs window w as (partition by frame_idx, team)) select frame_idx, ord, n, sqrt(((x_m * n - sx) * (x_m * n - sx) + (y_m * n - sy) * (y_m * n - sy))::double) / n as apart from p where n >= 3",
    "together_pairs": f"with {OBS_SQL}, p as (select distinct frame_idx, team, user_id from obs) select x.user_id as a, y.user_id as b, count(*) as frames from p x join p y on x.frame_idx = y.frame_idx and x.team = y.team and x.user_id < y.user_id group by 1, 2",
    "team_slots": f"with {OBS_SQL}, k as (select team, user_id, max(t_us) as last_seen, arg_max(state, (t_us, ord)) as state from obs where role = 'GOALKEEPER' group by 1, 2) select * from k qualify row_number() over (partition by team order by (state = 'confirmed') desc, last_seen desc, user_id) = 1",
    "crowds": f"with {OBS_SQL} select a.frame_idx, a.ord, count(*) as near from obs a join obs b on a.frame_idx = b.frame_idx and a.ord <> b.ord and abs(a.x_m - b.x_m) <= 120 and abs(a.y_m - b.y_m) <= 120 group by 1, 2",
    "mean_vectors": f"with {_V}, e as (select id, generate_subscripts(q, 1) - 1 as k, unnest(q) as v from v) select id, k, sum(v)::double / count(*) as m from e group by 1, 2",
    "velocity": f"with recursive {OBS_SQL}, r as (select id, t_us, x_m, row_number() over (partition by id order by t_us, ord) as k from obs), walk(id, k, t, x, v) as (select id, k, t_us, x_m, 0e0 from r where k = 1 union all select w.id, r.k, r.t_us, r.x_m, case when r.t_us - w.t > 1000 and r.t_us - w.t <= 1500000 then 0.6e0 * w.v + 0.4e0 * ((r.x_m - w.x) / (r.t_us - w.t)::double * 1000000) else w.v end from walk w join r on r.id = w.id and r.k = w.k + 1) select id, round(arg_max(v, k), 6) as velocity from walk group by id",
    "interval_overlap": f"with {OBS_SQL}, g as (select video, ord as segment, t_us as from_us, t_us + (ord % 50) * 1000 as to_us from obs where kind = 'signup') select o.ord, g.segment from obs o join g on g.video = o.video and g.from_us <= o.t_us + 2000 and g.to_us >= o.t_us - 2000",
    "sightings_around": f"with {OBS_SQL}, f as (select id, track as frag, min(t_us) as t0, max(t_us) as t1 from obs group by 1, 2) select id, frag, (select max(t_us) from obs o where o.id = f.id and o.t_us < f.t0) as before_us, (select min(t_us) from obs o where o.id = f.id and o.t_us > f.t1) as after_us from f",
    "span_pairs": f"with {OBS_SQL}, t as (select team, user_id, track, min(t_us) as t0, max(t_us) as t1, count(*) as n from obs group by 1, 2, 3), s as (select * from t qualify row_number() over (partition by user_id order by n desc, track) = 1) select a.team, a.user_id as a, b.user_id as b, greatest(b.t0 - a.t1, a.t0 - b.t1) as gap_us from s a join s b on a.team = b.team and a.user_id < b.user_id where a.t1 < b.t0 or b.t1 < a.t0",
    "tiles": f"with f as (select p_partkey as key, p_size * 60 as width, p_size * 34 as height from part), x as (select key, unnest({_ALONG('width')}) as x, height from f) select key, x, unnest({_ALONG('height')}) as y from x",
    "nearest_event": f"with {OBS_SQL} select id, arg_min(ord, (abs(t_us - 32400000), ord)) as ord from obs group by id",
    "frame_alignment": f"with {OBS_SQL}, k as (select video, t_us // 10000 as key, ord % 2 as side, arg_max(ord, (t_us, ord)) as ord from obs group by 1, 2, 3) select a.video, a.key, a.ord as ord0, b.ord as ord1 from k a join k b on a.video = b.video and a.key = b.key and a.side = 0 and b.side = 1",
    "review_times": f"with {OBS_SQL} select distinct t_us // 200000 * 200000 as at_us from obs where state = 'uncertain' order by 1 limit 40",
    "last_events": f"with {OBS_SQL} select id, row_number() over (partition by id order by t_us desc, ord desc) as turn, ord from obs qualify turn <= 5",
}
