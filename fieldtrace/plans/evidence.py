"""Queries of geometry, registration, ball, votes, metrics and text, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text as tx
from ..functions import vectors as fv
from ..operators import ballpath, edits, matching, registration
from ..sources.adapter import OBS_SQL, observations, table
from .matches import _COS, _V, _vectors

#: A view polygon in thousandths of the pitch, and a homography of the adapted frames.
VIEW = [(100, 50), (900, 150), (850, 950), (450, 700), (150, 900)]
H = [0.8, 0.1, 20.0, -0.05, 0.9, 35.0, 0.0001, 0.0002, 1.0]


def _o(s, d):
    return observations(s, d)


def _homography(s, d):
    x, y = geo.projected(F.array(*(F.lit(v) for v in H)), F.col("x_m"), F.col("y_m"))
    return _o(s, d).select("ord", x.alias("x"), y.alias("y"))


def _sigma(s, d):
    """Position with the spread that one unit of image error causes, by finite differences."""
    h = F.array(*(F.lit(v) for v in H))
    x, y = geo.projected(h, F.col("x_m"), F.col("y_m"))
    xr, yr = geo.projected(h, F.col("x_m") + 1, F.col("y_m"))
    xd, yd = geo.projected(h, F.col("x_m"), F.col("y_m") + 1)
    sx, sy = F.sqrt((xr - x) * (xr - x) + (xd - x) * (xd - x)), F.sqrt((yr - y) * (yr - y) + (yd - y) * (yd - y))
    return _o(s, d).select("ord", F.round(sx, 9).alias("sigma_x"), F.round(sy, 9).alias("sigma_y"))


def _mapped(s, d):
    return _o(s, d).groupBy((F.col("user_id") % 5).alias("run"), "frame_idx").agg(F.count(F.lit(1)).alias("tracks"), F.count(F.when(F.col("pitch_conf") >= 60, 1)).alias("mapped"))


def _steps(s, d):
    c = lambda v: v.cast("double")
    m = F.array(*(c(v) for v in (F.lit(1), F.lit(0), F.col("x_m") / 1000, F.lit(0), F.lit(1), F.col("y_m") / 1000, F.lit(0), F.lit(0), F.lit(1))))
    return _o(s, d).select(F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("t_us", "ord")).cast("long").alias("idx"), m.alias("m"), (F.col("kind") == "error").alias("cut"))


def _chain(s, d):
    """The translation part of the chains, in thousandths; products of translations are sums."""
    c = registration.motion_chain(_steps(s, d))
    return c.select("run", "idx", F.round(F.get("chain", 2) * 1000).cast("long").alias("x"), F.round(F.get("chain", 5) * 1000).cast("long").alias("y"))


def _votes(s, d):
    w = Window.partitionBy("id").orderBy("t_us", "ord").rowsBetween(-14, 0)
    other = F.when(F.col("kind").isin("click", "view"), 1).otherwise(0)
    v = _o(s, d).withColumns({"votes": F.count(F.lit(1)).over(w), "other": F.sum(other).over(w)})
    return v.select("id", "ord", "votes", "other", ((F.col("votes") == 15) & (F.col("other") * 100 >= F.col("votes") * 80)).alias("release"))


def _roles(s, d):
    """Shares of the last 50 detections of each identity, and the role that rules give."""
    w = Window.partitionBy("id").orderBy("t_us", "ord").rowsBetween(-49, 0)
    part = lambda k: F.sum(F.when(F.col("kind") == k, F.col("identity_conf")).otherwise(0)).over(w)
    v = _o(s, d).withColumns({"total": F.sum("identity_conf").over(w), "keeper": part("purchase"), "referee": part("signup"), "n": F.count(F.lit(1)).over(w)})
    role = F.when(F.col("n") < 15, "UNDECIDED").when(F.col("keeper") * 100 >= F.col("total") * 40, "GOALKEEPER").when(F.col("referee") * 100 >= F.col("total") * 30, "REFEREE").otherwise("PLAYER")
    return v.select("id", "ord", "n", "total", "keeper", "referee", role.alias("decided"))


def _kits(s, d):
    """Votes of the vectors of an identity by their distances to the nearest examples of two kits: near
    enough, and clearly nearer than the other.  Even and odd identities of a team wear the kits."""
    v = _vectors(s, d)
    g = matching.gallery(v).select("team", (F.col("id") % 2).alias("kit"), F.col("q").alias("gq"), F.col("norm").alias("g_norm"), F.col("vec_id").alias("g_vec"))
    j = v.join(g, "team").where("vec_id <> g_vec").withColumn("apart", 1 - fv.cosine(F.col("q"), F.col("gq"), F.col("norm"), F.col("g_norm")))
    near = lambda k: F.min(F.when(F.col("kit") == k, F.col("apart")))
    j = j.groupBy("id", "vec_id").agg(near(0).alias("a"), near(1).alias("b"))
    a, b = F.col("a"), F.col("b")
    vote = F.when(F.least(a, b) > 0.75, "NONE").when(F.abs(a - b) < 0.02, "UNSURE").when(a < b, "A").otherwise("B")
    return j.groupBy("id", vote.alias("vote")).agg(F.count(F.lit(1)).alias("n"))


def _reid(s, d):
    """Of the last ten scores of an identity: their mean, and whether enough are good."""
    w = Window.partitionBy("id").orderBy("t_us", "ord").rowsBetween(-9, 0)
    score = (F.col("identity_conf") * 76 + F.col("pitch_conf") * 24).alias("score")
    v = _o(s, d).select("id", "t_us", "ord", score)
    v = v.withColumns({"n": F.count(F.lit(1)).over(w), "total": F.sum("score").over(w), "good": F.sum(F.when(F.col("score") >= 7200, 1).otherwise(0)).over(w)})
    return v.select("id", "ord", "n", (F.col("total") / F.col("n")).alias("mean"), ((F.col("n") >= 5) & (F.col("good") * 5 >= F.col("n") * 3)).alias("accepted"))


def _run_metrics(s, d):
    h = F.col("y_m")
    bucket = F.when(h < 300, "0-30").when(h < 400, "30-40").when(h < 600, "40-60").when(h < 900, "60-90").otherwise(">90")
    return _o(s, d).groupBy(bucket.alias("height")).agg(F.count(F.lit(1)).alias("people"), F.count(F.when(F.col("state") == "confirmed", 1)).alias("confirmed"), F.count_distinct("frame_idx").alias("frames"))


def _kinds(s, d):
    return _o(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("people"), F.count(F.when(F.get_json_object("props", "$.k").cast("int") >= 50, 1)).alias("high"))


def _identity_metrics(s, d):
    """Track switches of an identity, and changes of state between neighbouring sightings."""
    w = Window.partitionBy("id").orderBy("t_us", "ord")
    o = _o(s, d).withColumn("before", F.lag("state").over(w))
    return o.groupBy("id").agg((F.count_distinct("track") - 1).alias("switches"), F.count(F.when((F.col("before") == "confirmed") & (F.col("state") == "uncertain"), 1)).alias("lost"), F.count(F.lit(1)).alias("n"))


def _recall(s, d):
    """Rows tracked against the people that a frame holds, each counted once: recall and over-count."""
    per = _o(s, d).groupBy("frame_idx").agg(F.count(F.when(F.col("state") == "confirmed", 1)).alias("tracked"), F.count_distinct("user_id").alias("counted"))
    return per.select("frame_idx", "tracked", "counted", F.least(F.lit(1.0), F.col("tracked") / F.greatest(F.lit(1), F.col("counted"))).alias("recall"), F.greatest(F.lit(0), F.col("tracked") - F.col("counted") - 1).alias("over"))


def _sessions(s, d):
    """Gap sessions of an identity: as session windows would make, on exact integers."""
    w = Window.partitionBy("id").orderBy("t_us", "ord")
    o = _o(s, d).withColumn("new", F.when(F.col("t_us") - F.lag("t_us").over(w) < 500_000, 0).otherwise(1))
    o = o.withColumn("session", F.sum("new").over(w))
    return o.groupBy("id", "session").agg(F.min("t_us").alias("start_us"), (F.max("t_us") + 500_000).alias("end_us"), F.count(F.lit(1)).alias("n"))


def _far(s, d):
    """Detections seen near the same place twice more within half a second before: confirmed."""
    o = _o(s, d).select("user_id", "ord", "t_us", "x_m", "y_m", F.floor(F.col("t_us") / 500_000).alias("b"))
    p = o.select("user_id", F.col("ord").alias("o1"), F.col("t_us").alias("t1"), F.col("x_m").alias("x1"), F.col("y_m").alias("y1"), F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"))
    j = o.join(p, ["user_id", "b"]).where((F.col("t1") < F.col("t_us")) & (F.col("t_us") - F.col("t1") <= 500_000) & (F.abs(F.col("x_m") - F.col("x1")) <= 60))
    return j.groupBy("ord").agg(F.count_distinct("o1").alias("earlier")).select("ord", "earlier", (F.col("earlier") >= 2).alias("confirmed"))


def _ball(s, d):
    return _o(s, d).select(
        F.col("user_id").alias("run"), "ord", F.floor(F.col("t_us") / 500_000).alias("frame_idx"), "t_us", (F.col("x_m") * 0.105).alias("x"), (F.col("y_m") * 0.068).alias("y"), (F.col("pitch_conf") / 100).alias("score")
    )


def _unpivot(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", F.expr("stack(2, 'size', cast(p_size as double), 'price', cast(p_retailprice as double)) as (name, value)"))


def _late(s, d):
    """Rows not later than the greatest time that came before them, in order of arrival, are dropped."""
    w = Window.partitionBy("id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    o = _o(s, d).withColumn("seen", F.max("t_us").over(w))
    return o.groupBy("id").agg(F.count(F.when(F.coalesce(F.col("t_us") > F.col("seen"), F.lit(True)), 1)).alias("kept"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    "homography_apply": _homography,
    "pitch_position_sigma": _sigma,
    "point_in_polygon": lambda s, d: _o(s, d).select("ord", geo.inside_polygon(VIEW, F.col("x_m"), F.col("y_m")).alias("inside")),
    "signed_distance": lambda s, d: _o(s, d).select("ord", F.round(geo.signed_distance(VIEW, F.col("x_m"), F.col("y_m")), 6).alias("distance")),
    "view_classes": lambda s, d: _o(s, d).groupBy("id", geo.view_class(geo.signed_distance(VIEW, F.col("x_m"), F.col("y_m")), F.col("identity_conf") * 1.0).alias("class")).agg(F.count(F.lit(1)).alias("n")),
    "mapping_loss": lambda s, d: registration.loss_spans(_mapped(s, d), 2),
    "theil_sen": lambda s, d: registration.theil_sen(_o(s, d), "frame_idx", "x_m", "y_m", 30),
    "motion_chain": _chain,
    "confidence_levels": lambda s, d: registration.decayed(_mapped(s, d).withColumns({"anchored": F.col("tracks") >= 3, "conf": F.least(F.lit(100).cast("long"), F.col("mapped") * 30)}), 3),
    "ball_shares": lambda s, d: _o(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("state") == "confirmed", F.col("pitch_conf"))).alias("confidence")),
    "viterbi_path": lambda s, d: ballpath.ball_path(_ball(s, d), "run long, ord long, frame_idx long, t_us long, x double, y double, score double"),
    "vote_window": _votes,
    "role_rules": _roles,
    "kit_vote": _kits,
    "reid_decision": _reid,
    "run_metrics": _run_metrics,
    "event_kinds": _kinds,
    "identity_metrics": _identity_metrics,
    "count_recall": _recall,
    "session_expiry": _sessions,
    "far_confirm": _far,
    "tick_filter": lambda s, d: edits.throttled(_o(s, d), "track", 200_000),
    "late_drop": _late,
    "cut_segments": lambda s, d: _steps(s, d).withColumn("segment", F.sum(F.col("cut").cast("int")).over(Window.partitionBy("run").orderBy("idx"))).groupBy("run", "segment").agg(F.count(F.lit(1)).alias("n")),
    "kv_latest": lambda s, d: edits.latest(table(s, d, "orders"), ["o_custkey", "o_orderstatus"], F.desc("o_orderkey")).select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice"),
    "json_path": lambda s, d: _o(s, d).select("ord", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")),
    "keyword_router": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", tx.topic(F.col("text")).alias("topic")),
    "event_search": lambda s, d: _o(s, d).join(_o(s, d).where("kind = 'error'").select("frame_idx", "team").distinct(), ["frame_idx", "team"], "left_anti").where(F.lower("kind").contains("ew")).select("ord", "kind", "frame_idx"),
    "format_clock": lambda s, d: _o(s, d).select("ord", tx.clock(F.col("t_us")).alias("clock")),
    "long_ids": lambda s, d: _o(s, d).select("user_id", tx.long_id(F.col("role"), F.col("team"), F.col("user_id")).alias("name")).distinct().select("user_id", "name", tx.parsed_id(F.col("name"))[0].alias("prefix"), tx.parsed_id(F.col("name"))[1].alias("number")),
    "next_id": lambda s, d: _o(s, d).select(tx.parsed_id(tx.long_id(F.col("role"), F.col("team"), F.col("user_id")))[0].alias("prefix"), "user_id").groupBy("prefix").agg((F.max("user_id") + 1).alias("next")),
    "unpivot_wide": _unpivot,
}

_X = lambda x, y: f"({H[0]}e0 * {x} + {H[1]}e0 * {y} + {H[2]}e0) / ({H[6]:.4f}e0 * {x} + {H[7]:.4f}e0 * {y} + {H[8]}e0)"
_Y = lambda x, y: f"({H[3]}e0 * {x} + {H[4]}e0 * {y} + {H[5]}e0) / ({H[6]:.4f}e0 * {x} + {H[7]:.4f}e0 * {y} + {H[8]}e0)"
_EDGES = list(zip(VIEW, VIEW[1:] + VIEW[:1], strict=True))
_INSIDE = "(" + " + ".join(f"case when ({a[1]} > y_m) <> ({b[1]} > y_m) and (x_m - {a[0]}) * ({b[1]} - {a[1]}) - (y_m - {a[1]}) * ({b[0]} - {a[0]}) {'<' if b[1] > a[1] else '>'} 0 then 1 else 0 end" for a, b in _EDGES) + ") % 2 = 1"


def _square(a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = f"least(1e0, greatest(0e0, ((x_m - {a[0]}) * ({dx}) + (y_m - {a[1]}) * ({dy})) / {dx * dx + dy * dy}e0))"
    return f"(x_m - {a[0]} - {t} * ({dx})) ** 2 + (y_m - {a[1]} - {t} * ({dy})) ** 2"


_DISTANCE = f"(case when {_INSIDE} then -1 else 1 end * sqrt(least({', '.join(_square(a, b) for a, b in _EDGES)})))"
_MAPPED = f"{OBS_SQL}, mapped as (select user_id % 5 as run, frame_idx, count(*) as tracks, count(*) filter (pitch_conf >= 60) as mapped from obs group by 1, 2)"
_NAME = "case when role = 'GOALKEEPER' then concat('GK-', user_id) else concat(team, '-', case when len(user_id::varchar) > 2 then user_id::varchar else lpad(user_id::varchar, 2, '0') end) end"
_LAST = lambda n: f"(partition by id order by t_us, ord rows between {n} preceding and current row)"

ORACLE_SQL = {
    "homography_apply": f"with {OBS_SQL} select ord, {_X('x_m', 'y_m')} as x, {_Y('x_m', 'y_m')} as y from obs",
    "pitch_position_sigma": f"with {OBS_SQL}, p as (select ord, {_X('x_m', 'y_m')} as x, {_Y('x_m', 'y_m')} as y, {_X('(x_m + 1)', 'y_m')} as xr, {_Y('(x_m + 1)', 'y_m')} as yr, {_X('x_m', '(y_m + 1)')} as xd, {_Y('x_m', '(y_m + 1)')} as yd from obs) select ord, round(sqrt((xr - x) * (xr - x) + (xd - x) * (xd - x)), 9) as sigma_x, round(sqrt((yr - y) * (yr - y) + (yd - y) * (yd - y)), 9) as sigma_y from p",
    "point_in_polygon": f"with {OBS_SQL} select ord, {_INSIDE} as inside from obs",
    "signed_distance": f"with {OBS_SQL} select ord, round({_DISTANCE}, 6) as distance from obs",
    "view_classes": f"with {OBS_SQL}, p as (select id, {_DISTANCE} as d, greatest(1e0, identity_conf) as s from obs) select id, case when d <= -s then 'C' when d >= s then 'S' else 'U' end as class, count(*) as n from p group by 1, 2",
    "mapping_loss": f"with {_MAPPED}, b as (select *, frame_idx - row_number() over (partition by run order by frame_idx) as island from mapped where mapped * 2 < tracks) select run, min(frame_idx) as first, max(frame_idx) + 1 as end, min(mapped / tracks) as share, arg_min(frame_idx, (mapped / tracks, frame_idx)) as worst_frame from b group by run, island having max(frame_idx) + 1 - min(frame_idx) >= 2",
    "theil_sen": f"with {OBS_SQL}, m as (select a.frame_idx, greatest(0e0, median((b.y_m - a.y_m) / (b.x_m - a.x_m))) as slope from obs a join obs b on a.frame_idx = b.frame_idx and a.ord < b.ord and abs(b.x_m - a.x_m) >= 30 group by 1) select frame_idx, any_value(slope) as slope, median(y_m - slope * x_m) as intercept from obs join m using (frame_idx) group by 1",
    "motion_chain": f"with {OBS_SQL}, o as (select *, row_number() over w as idx, sum(case when kind = 'error' then 1 else 0 end) over w as seg from obs window w as (partition by user_id order by t_us, ord)) select user_id as run, idx, (sum(x_m) over v)::bigint as x, (sum(y_m) over v)::bigint as y from o window v as (partition by user_id, seg order by idx)",
    "confidence_levels": f"with {_MAPPED}, a as (select run, frame_idx, last_value(case when tracks >= 3 then frame_idx end ignore nulls) over w as af, last_value(case when tracks >= 3 then least(100, mapped * 30) end ignore nulls) over w as ac from mapped window w as (partition by run order by frame_idx)), c as (select run, frame_idx, greatest(0, ac - 3 * (frame_idx - af)) as confidence, ac from a) select run, frame_idx, case when ac is null then 0 else confidence end as confidence, case when coalesce(confidence, 0) >= 70 then 'HIGH' when coalesce(confidence, 0) >= 35 then 'MEDIUM' else 'LOW' end as level from c",
    "ball_shares": f"with {OBS_SQL} select kind, count(*) as n, avg(case when state = 'confirmed' then pitch_conf end) as confidence from obs group by kind",
    "vote_window": f"with {OBS_SQL}, v as (select id, ord, count(*) over w as votes, (sum(case when kind in ('click', 'view') then 1 else 0 end) over w)::bigint as other from obs window w as {_LAST(14)}) select *, votes = 15 and other * 100 >= votes * 80 as release from v",
    "role_rules": f"with {OBS_SQL}, v as (select id, ord, count(*) over w as n, (sum(identity_conf) over w)::bigint as total, (sum(case when kind = 'purchase' then identity_conf else 0 end) over w)::bigint as keeper, (sum(case when kind = 'signup' then identity_conf else 0 end) over w)::bigint as referee from obs window w as {_LAST(49)}) select *, case when n < 15 then 'UNDECIDED' when keeper * 100 >= total * 40 then 'GOALKEEPER' when referee * 100 >= total * 30 then 'REFEREE' else 'PLAYER' end as decided from v",
    "kit_vote": f"with {_V}, k as (select v.id, v.vec_id, min(1 - {_COS('v.q', 'g.q')}) filter (g.id % 2 = 0) as a, min(1 - {_COS('v.q', 'g.q')}) filter (g.id % 2 = 1) as b from v join g on g.team = v.team and g.vec_id <> v.vec_id group by 1, 2) select id, case when least(a, b) > 0.75 then 'NONE' when abs(a - b) < 0.02 then 'UNSURE' when a < b then 'A' else 'B' end as vote, count(*) as n from k group by 1, 2",
    "reid_decision": f"with {OBS_SQL}, r as (select id, t_us, ord, identity_conf * 76 + pitch_conf * 24 as score from obs), v as (select id, ord, count(*) over w as n, (sum(score) over w)::bigint as total, sum(case when score >= 7200 then 1 else 0 end) over w as good from r window w as {_LAST(9)}) select id, ord, n, total / n as mean, n >= 5 and good * 5 >= n * 3 as accepted from v",
    "run_metrics": f"with {OBS_SQL} select case when y_m < 300 then '0-30' when y_m < 400 then '30-40' when y_m < 600 then '40-60' when y_m < 900 then '60-90' else '>90' end as height, count(*) as people, count(*) filter (state = 'confirmed') as confirmed, count(distinct frame_idx) as frames from obs group by 1",
    "event_kinds": f"with {OBS_SQL} select kind, count(*) as n, count(distinct user_id) as people, count(*) filter (json_extract_string(props, '$.k')::int >= 50) as high from obs group by kind",
    "identity_metrics": f"with {OBS_SQL}, o as (select *, lag(state) over (partition by id order by t_us, ord) as before from obs) select id, count(distinct track) - 1 as switches, count(*) filter (before = 'confirmed' and state = 'uncertain') as lost, count(*) as n from o group by id",
    "count_recall": f"with {OBS_SQL}, p as (select frame_idx, count(*) filter (state = 'confirmed') as tracked, count(distinct user_id) as counted from obs group by 1) select *, least(1e0, tracked / greatest(1, counted)) as recall, greatest(0, tracked - counted - 1) as over from p",
    "session_expiry": f"with {OBS_SQL}, o as (select *, case when t_us - lag(t_us) over w < 500000 then 0 else 1 end as new_ from obs window w as (partition by id order by t_us, ord)), g as (select *, (sum(new_) over (partition by id order by t_us, ord rows unbounded preceding))::bigint as session from o) select id, session, min(t_us) as start_us, max(t_us) + 500000 as end_us, count(*) as n from g group by 1, 2",
    "far_confirm": f"with {OBS_SQL} select a.ord, count(distinct b.ord) as earlier, count(distinct b.ord) >= 2 as confirmed from obs a join obs b on a.user_id = b.user_id and b.t_us < a.t_us and a.t_us - b.t_us <= 500000 and abs(a.x_m - b.x_m) <= 60 group by 1",
    "tick_filter": f"with recursive {OBS_SQL}, r as (select track, t_us, ord, row_number() over (partition by track order by t_us, ord) as k from obs), walk(track, k, t_us, ord, last_us, hit) as (select track, k, t_us, ord, t_us, true from r where k = 1 union all select w.track, r.k, r.t_us, r.ord, case when r.t_us - w.last_us >= 200000 then r.t_us else w.last_us end, r.t_us - w.last_us >= 200000 from walk w join r on r.track = w.track and r.k = w.k + 1) select track, t_us, ord from walk where hit",
    "late_drop": f"with {OBS_SQL}, o as (select *, max(t_us) over (partition by id order by ord rows between unbounded preceding and 1 preceding) as seen from obs) select id, count(*) filter (seen is null or t_us > seen) as kept, count(*) as n from o group by id",
    "cut_segments": f"with {OBS_SQL}, o as (select user_id as run, (sum(case when kind = 'error' then 1 else 0 end) over (partition by user_id order by t_us, ord rows unbounded preceding))::bigint as segment from obs) select run, segment, count(*) as n from o group by 1, 2",
    "kv_latest": "select o_custkey, o_orderstatus, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey desc) = 1",
    "json_path": f"with {OBS_SQL} select json_extract_string(props, '$.k')::bigint as k, count(*) as n from obs group by 1",
    "keyword_router": "select conv_id, turn, " + "case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{n}'" for n, p in tx.ROUTES) + " else 'other' end as topic from conversations",
    "event_search": f"with {OBS_SQL} select ord, kind, frame_idx from obs o where lower(kind) like '%ew%' and not exists (select 1 from obs e where e.kind = 'error' and e.frame_idx = o.frame_idx and e.team = o.team)",
    "format_clock": f"with {OBS_SQL} select ord, concat(lpad((t_us // 60000000)::varchar, 2, '0'), ':', lpad((t_us // 1000000 % 60)::varchar, 2, '0'), '.', lpad((t_us // 10000 % 100)::varchar, 2, '0')) as clock from obs",
    "long_ids": f"with {OBS_SQL}, n as (select distinct user_id, {_NAME} as name from obs) select user_id, name, nullif(regexp_extract(name, '^(REF|GK|A|B)-(\\d+)$', 1), '') as prefix, nullif(regexp_extract(name, '^(REF|GK|A|B)-(\\d+)$', 2), '')::bigint as number from n",
    "next_id": f"with {OBS_SQL} select nullif(regexp_extract({_NAME}, '^(REF|GK|A|B)-(\\d+)$', 1), '') as prefix, max(user_id) + 1 as next from obs group by 1",
    "unpivot_wide": "select p_partkey, 'size' as name, p_size::double as value from part union all select p_partkey, 'price', p_retailprice::double from part",
}
