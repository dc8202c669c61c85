"""Queries of pairing, pitch rules, summaries and verdict tables, with their DuckDB SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pitch, planes
from ..functions import vectors as fv
from ..operators import cues, edits, matching, pairing, standing, trails
from ..sources.adapter import OBS_SQL, observations, table
from .matches import _BOXES, _COS, _IOU, _V, _boxes, _vectors
from .matches import _SCORES as _GALLERY_SCORES
from .matches import _scores as _gallery_scores
from .motion import _FRAG

H1 = [0.052, 0.004, 2.0, -0.003, 0.06, 1.0, 0.00001, 0.00002, 1.0]


def _o(s, d):
    return observations(s, d)


def _round(c, n=9):
    return F.round(c, n)


def _team_frags(s, d):
    f = trails.label_segments(_o(s, d), "event_kind_cut").where("label = 'uncertain' and n >= 2")
    team = _o(s, d).groupBy("track").agg(F.min("team").alias("team"))
    return f.join(team, "track").select(F.concat_ws(":", F.col("track").cast("string"), F.col("frag").cast("string")).alias("frag"), "team", "t0", "t1")


def _gallery_pairs(s, d):
    v = _vectors(s, d)
    g = matching.gallery(v).select("team", F.col("id").alias("candidate"), F.col("q").alias("gq"), F.col("norm").alias("g_norm"), F.col("vec_id").alias("g_vec"))
    return v.join(g, "team").where("vec_id <> g_vec").select("vec_id", "candidate", "g_vec", fv.cosine(F.col("q"), F.col("gq"), F.col("norm"), F.col("g_norm")).alias("cos"))


def _reid(s, d):
    p = _gallery_pairs(s, d).groupBy("vec_id", "candidate").agg(F.max("cos").alias("cos"))
    v, c = F.col("vec_id"), F.col("candidate").cast("long")
    p = p.select(
        "vec_id", "candidate", F.greatest(F.lit(0.0), F.col("cos")).alias("appearance"), ((v * 7 + c * 3) % 100 / 100.0).alias("jersey"), ((v * 13 + c) % 2000 / 10.0).alias("gap_s"), ((v + c) % 5 > 0).alias("same_team"), ((v + c) % 7 > 0).alias("both_teams"),
        ((v * 3 + c) % 11 > 0).alias("same_role"), ((v + 2 * c) % 13 == 0).alias("gone"), F.when((v + c) % 3 > 0, ((v * 31 + c * 17) % 400).cast("double")).alias("metres"), F.when((v + c) % 4 > 0, (v * 41 + c * 19) % 300 / 1000.0).alias("moved"),
    )
    return pairing.reid_candidates(p).withColumn("confidence", _round(F.col("confidence")))


def _layouts(s, d):
    v = _vectors(s, d)
    a = F.transform("q", lambda x: F.when(x < -100, -1.0).otherwise(x / 127.0))
    b = F.transform(F.reverse("q"), lambda x: F.when(x < -100, -1.0).otherwise(x / 127.0))
    return v.select("vec_id", _round(pitch.layout_distance(a, b)).alias("distance"))


def _keepers(s, d):
    """Evidence of each identity over its frames, as shares, and the verdict on it as a goalkeeper."""
    o = _o(s, d)
    share = lambda c: F.count(F.when(c, 1)) / F.count(F.lit(1))
    x, y = F.col("x_m"), F.col("y_m")
    g = o.groupBy("id").agg(
        F.count(F.lit(1)).alias("records"), share((y < 0) | (y > 1000)).alias("off"), share((y < 40) | (y > 960)).alias("touch"), share((x < 160) | (x > 840)).alias("near"), share((x < 200) | (x > 800)).alias("deep"),
        share(F.col("kind") == "view").alias("alone"), share(F.col("role") == "GOALKEEPER").alias("det"), share(F.col("clipped")).alias("kit"), (F.sum("identity_conf") / F.count(F.lit(1)) / 100).alias("sure"),
    )
    c = F.col
    route = F.when(c("near") >= 0.5, "area").when((c("deep") >= 0.6) & ((c("alone") >= 0.5) | (c("det") >= 0.5) | (c("kit") >= 0.6)), "deepest").when((c("det") >= 0.75) & (c("kit") >= 0.6) & ((c("deep") >= 0.3) | (c("near") >= 0.2)), "detector")
    reason = F.when(c("off") > 0.2, "veto: off the pitch").when(c("touch") >= 0.3, "veto: touchline").when(route.isNull(), "no place").when(c("records") < 15, "few records").when(c("sure") < 0.5, "low confidence").otherwise("confirmed")
    return g.select("id", "records", reason.alias("reason"), F.when(reason == "confirmed", route).alias("route"))


def _sanity(s, d):
    """What a video's registry should not show: teams over the cap, two keepers, players of a team who look alike (0.93) and were never seen together, at most three a video."""
    o = _o(s, d)
    ids = o.groupBy("team", "id", "user_id").agg(F.max("role").alias("role"))
    over = ids.groupBy("team").agg(F.count(F.lit(1)).alias("n")).where("n > 12").select(F.lit("over_cap").alias("rule"), F.col("team").alias("key"), F.col("n").alias("value"))
    keepers = ids.where("role = 'GOALKEEPER'").groupBy("team").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("keepers").alias("rule"), F.col("team").alias("key"), F.col("n").alias("value"))
    # Galleries are those of the embeddings whose label is the person.
    who = o.select("user_id", "video", "team", "role").distinct().where("role = 'PLAYER'")
    scores = _gallery_scores(s, d).join(who.select(F.col("user_id").alias("a"), "video", "team"), "a").join(who.select(F.col("user_id").alias("b"), "team"), ["b", "team"])
    alike = standing.look_alikes(scores, cues.together(o), "video")
    apart = alike.select(F.lit("look_alike").alias("rule"), F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("key"), F.floor(F.col("cos") * 100).alias("value"))
    return over.unionByName(keepers).unionByName(apart)


def _invariants(s, d):
    """How many rows break each rule of a recorded document: one pass, and one shuffle by identity."""
    w = Window.partitionBy("id").orderBy("ord")
    o = _o(s, d).withColumns({"before": F.lag("t_us").over(w), "again": F.row_number().over(Window.partitionBy("id", "t_us").orderBy("ord"))})
    rules = {
        "duplicate time": F.col("again") == 2, "time goes back": F.col("t_us") < F.col("before"), "outside the picture": F.expr("x_m < -50 or x_m > 1050 or y_m < -50 or y_m > 1050"),
        "confidence without state": F.expr("identity_conf >= 90 and state <> 'confirmed'"), "no team": F.col("team").isNull(),
    }
    n = o.agg(*(F.count(F.when(c, 1)).alias(name) for name, c in rules.items()))
    return n.select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("n")) for name in rules))).alias("r")).select("r.*")


def _height_scale(s, d):
    """Pixels to a metre at each person: the upper median height of those near its row, 1.8 m tall."""
    b = _boxes(s, d).withColumn("foot", F.col("by") + F.col("bh"))
    p = b.select("frame_idx", "ord", "foot")
    q = b.select("frame_idx", F.col("foot").alias("f"), F.col("bh").alias("h"))
    g = p.join(q, "frame_idx").where(F.abs(F.col("f") - F.col("foot")) < 250).groupBy("frame_idx", "ord").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    return g.select("frame_idx", "ord", (F.get("hs", F.floor(F.size("hs") / 2).cast("int")) / 1.8).alias("scale"))


def _bands(s, d):
    """Expected height at each observation's row, between the medians of bands of the video."""
    b = _o(s, d).select("video", "ord", "y_m", (F.lit(300) + F.col("ord") % 110).alias("h")).where("y_m between 0 and 999")
    m = b.groupBy("video", F.floor(F.col("y_m") / 100).alias("band"), "h").agg(F.count(F.lit(1)).alias("times"))
    w = Window.partitionBy("video", "band")
    m = m.withColumns({"upto": F.sum("times").over(w.orderBy("h")), "n": F.sum("times").over(w)})
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("h")))
    m = m.groupBy("video", "band").agg(((at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2).alias("h"))
    x = b.select("video", "ord", "y_m", F.floor((F.col("y_m") - 50) / 100).alias("low"))
    x = x.join(m.select("video", F.col("band").alias("low"), F.col("h").alias("h0")), ["video", "low"], "left").join(m.select("video", (F.col("band") - 1).alias("low"), F.col("h").alias("h1")), ["video", "low"], "left")
    u = (F.col("y_m") - (F.col("low") * 100 + 50)) / 100
    return x.select("video", "ord", F.when(F.col("h0").isNull(), F.col("h1")).when(F.col("h1").isNull(), F.col("h0")).otherwise(F.col("h0") + (F.col("h1") - F.col("h0")) * u).alias("height"))


def _registration(s, d):
    """Shares and means of each video's registration, with its sources counted."""
    o = _o(s, d)
    n = F.count(F.lit(1))
    source = F.when(F.col("pitch_conf") < 10, "none").when(F.col("pitch_conf") < 40, "carried").otherwise("anchor")
    g = o.withColumn("source", source).groupBy("video").agg(
        n.alias("frames"), F.count(F.when(F.col("source") != "none", 1)).alias("known"), F.bround(F.count(F.when(F.col("source") != "none", 1)) / n, 3).alias("share"), F.bround(F.count(F.when(F.col("pitch_conf") >= 50, 1)) / n, 3).alias("confident"),
        F.round(F.sum("pitch_conf") / n / 100, 6).alias("mean_confidence"), *(F.count(F.when(F.col("source") == k, 1)).alias(k) for k in ("anchor", "carried")),
    )
    return g


def _disagreement(s, d):
    """What a homography and one that is shifted by the place of a sighting make of the picture: all grid points of a batch at once."""

    def run(batches):
        for t in batches:
            shifted = np.tile(np.array(H1, float), (len(t), 1))
            shifted[:, 2] += t["x_m"].to_numpy() / 200
            shifted[:, 5] += t["y_m"].to_numpy() / 200
            same = np.broadcast_to(np.array(H1, float).reshape(1, 3, 3), (len(t), 3, 3))
            yield pd.DataFrame({"ord": t["ord"], "metres": planes.grid_distance(same, shifted.reshape(-1, 3, 3), 1920.0, 1080.0)})

    return _o(s, d).select("ord", "x_m", "y_m").mapInPandas(run, "ord long, metres double").select("ord", _round(F.nanvl("metres", F.lit(None)), 6).alias("metres"))


def _area(s, d):
    """Area that the sightings of an identity in one track span in order, in millionths of the pitch."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("t_us", "ord", F.col("x_m").alias("x"), F.col("y_m").alias("y")))), lambda p: F.struct(p["x"].cast("long").alias("x"), p["y"].cast("long").alias("y")))
    return _o(s, d).groupBy("track").agg(points.alias("p")).select("track", pitch.polygon_area(F.col("p")).alias("area"))


def _landmark(s, d):
    o = _o(s, d).select("ord", (F.col("x_m") * 0.105).alias("x"), (F.col("y_m") * 0.068).alias("y"))
    marks = F.broadcast(pitch.landmarks(s, 105.0, 68.0))  # 29 rows
    dx, dy = F.col("lx") - F.col("x"), F.col("ly") - F.col("y")
    j = o.crossJoin(marks).withColumn("square", F.round(dx * dx + dy * dy, 6))
    return j.groupBy("ord").agg(F.min(F.struct("square", "name")).alias("m")).select("ord", "m.name", "m.square")


def _swapped(s, d):
    """Pairs of a team that cross (adjacent ids, an error in a frame of both) exchange their ids from then on."""
    o = _o(s, d)
    mate = F.floor(F.col("user_id") / 2) * 2
    at = o.where("kind = 'error' and ord % 3 = 0").groupBy(mate.alias("pair")).agg(F.min("t_us").alias("at_us"))
    j = o.withColumn("pair", mate).join(at, "pair", "left")
    other = F.when(F.col("user_id") % 2 == 0, F.col("user_id") + 1).otherwise(F.col("user_id") - 1)
    return j.select("ord", F.when(F.col("t_us") >= F.col("at_us"), F.concat(F.lit("U"), other.cast("string"))).otherwise(F.col("id")).alias("id"))


def _timing(s, d):
    """Milliseconds a frame that each kind of event takes, by video."""
    return _o(s, d).groupBy("video").agg(F.count_distinct("frame_idx").alias("frames"), *(F.bround(F.sum(F.when(F.col("kind") == k, F.col("pitch_conf")).otherwise(0)) / F.count_distinct("frame_idx"), 1).alias(f"{k}_ms") for k in ("view", "click", "purchase", "error")))


def _scores(s, d):
    w = Window.partitionBy("id").orderBy("t_us", "ord")
    o = _o(s, d).withColumns({"gap": (F.col("t_us") - F.lag("t_us").over(w)) / 1e6, "dx": (F.col("x_m") - F.lag("x_m").over(w)) * 0.105, "dy": (F.col("y_m") - F.lag("y_m").over(w)) * 0.068}).where("gap is not null")
    metres = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    vx, vy = (F.col("ord") % 31 - 15).cast("double"), (F.col("ord") % 17 - 8).cast("double")
    return o.select("ord", _round(pitch.near_score(metres, F.col("gap"))).alias("spatial"), _round(pitch.time_score(F.col("gap"))).alias("temporal"), _round(pitch.reach(F.col("dx"), F.col("dy"), vx, vy, F.col("gap")), 6).alias("reach"))


def _zone(s, d):
    x, y = F.col("x_m"), F.col("y_m")
    auto = F.when(F.col("pitch_conf") < 10, "unknown").when(x.between(0, 1000), "inside").when(x.between(-40, 1040), "boundary").otherwise("outside")
    user = F.when(F.col("ord") % 3 == 0, None).when(y.between(20, 980), "inside").otherwise("outside")
    return _o(s, d).groupBy(pitch.stricter_zone(auto, user).alias("zone"), F.col("clipped")).agg(F.count(F.lit(1)).alias("n"))


def _edges(s, d):
    b = _boxes(s, d)
    edge = pitch.edge_of(F.col("bx"), F.col("by"), F.col("bw"), F.col("bh"), 1000, 4)
    return b.select("ord", edge.alias("edge"), (F.col("bx") + F.col("bw") / 2).alias("foot_x"), (F.col("by") + F.col("bh")).alias("foot_y"), (F.col("by") + F.col("bh") >= 996).alias("cut_below"))


def _review(s, d):
    """Each purchase with the latest review of it, or none."""
    r = edits.latest(table(s, d, "orders").select((F.col("o_orderkey") % 5000).alias("event"), "o_orderstatus", "o_orderdate", "o_orderkey"), ["event"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return _o(s, d).where("kind = 'purchase'").join(r, F.col("ord") == F.col("event"), "left").select("ord", F.col("o_orderstatus").alias("review"))


def _calibration(s, d):
    at = F.round(F.col("t_us") / 1000).cast("long").alias("at")
    k = _o(s, d).where("kind = 'signup'").select("video", "ord", at)
    log = _o(s, d).where("kind = 'click'").groupBy("video", at).agg(F.max("ord").alias("log"))
    return k.join(log, ["video", "at"], "left").select("ord", "log")


def _kit(s, d):
    p = _gallery_pairs(s, d).where("vec_id % 3 = 0")
    return pairing.kit_suggestions(p.select("vec_id", F.when(F.col("candidate") % 2 == 0, "A").otherwise("B").alias("side"), (1 - F.col("cos")).alias("distance")), 0.6, 0.05).withColumn("distance", _round(F.col("distance")))


QUERIES = {
    "uncovered_boxes": lambda s, d: pairing.uncovered(_boxes(s, d).where("ord % 5 = 0"), _boxes(s, d).where("ord % 5 <> 0"), 0.5).select("frame_idx", "ord"),
    "associated": lambda s, d: pairing.associated(_boxes(s, d).where("ord % 2 = 0"), _boxes(s, d).where("ord % 2 = 1")).withColumn("cost", _round(F.col("cost"))),
    "fragment_candidates": lambda s, d: pairing.fragment_candidates(_team_frags(s, d), _o(s, d).select("team", "id").distinct(), _o(s, d).where("state = 'confirmed'")),
    "nearest_person": lambda s, d: pairing.nearest_person(_o(s, d).where("kind = 'signup'"), _o(s, d), 200),
    "knn_mean": lambda s, d: pairing.knn_mean(_gallery_pairs(s, d).withColumn("distance", 1 - F.col("cos")), ["vec_id", "candidate"], "distance").withColumn("mean", _round(F.col("mean"))),
    "kit_suggestions": _kit,
    "reid_candidates": _reid,
    "in_roster": lambda s, d: _o(s, d).select("id", F.floor(F.col("t_us") / 1_000_000).alias("step")).distinct().join(_o(s, d).where("in_roster").select("id").distinct(), "id", "left_semi"),
    "review_status": _review,
    "calibration_log": _calibration,
    "zones": _zone,
    "edges": _edges,
    "score_terms": _scores,
    "motion_classes": lambda s, d: trails.own_speed(_o(s, d), 2_000_000).groupBy(pitch.motion_class(F.col("speed")).alias("motion")).agg(F.count(F.lit(1)).alias("n")),
    "nearest_landmark": _landmark,
    "polygon_area": _area,
    "height_scale": _height_scale,
    "height_bands": _bands,
    "hue_only": lambda s, d: _vectors(s, d).select("vec_id", F.posexplode(pitch.hue_only(F.transform(F.slice("q", 1, 24), F.abs))).alias("k", "v")),
    "layout_distance": _layouts,
    "keeper_verdicts": _keepers,
    "sanity": _sanity,
    "invariants": _invariants,
    "registration_summary": _registration,
    "disagreement": _disagreement,
    "people_per_frame": lambda s, d: _o(s, d).groupBy("video", "frame_idx").agg(F.count(F.lit(1)).alias("n")).groupBy("video").agg(F.sum("n").alias("people"), F.count(F.lit(1)).alias("frames"), (F.sum("n") / F.count(F.lit(1))).alias("average")),
    "stage_timing": _timing,
    "swapped_ids": _swapped,
    "best_in_frame": lambda s, d: edits.latest(_o(s, d), ["frame_idx"], F.desc("pitch_conf"), "ord").select("frame_idx", "ord", "pitch_conf"),
    "most_common": lambda s, d: _o(s, d).groupBy("video", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).withColumn("place", F.row_number().over(Window.partitionBy("video").orderBy(F.desc("n"), "first"))),
    "heaviest_samples": lambda s, d: _vectors(s, d).withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("quality"), "vec_id"))).where("turn <= 32").select("id", "turn", "vec_id"),
    "event_messages": lambda s, d: _o(s, d).where("kind = 'error'").select("ord", F.concat_ws("\n", F.upper("kind"), F.concat(F.lit("Global ID: "), F.col("id")), F.concat(F.lit("Now: "), pitch.described(F.col("role"), F.when(F.col("ord") % 4 > 0, F.col("team"))))).alias("message")),
}

_PAIRS = f"{_V}, gp as (select v.vec_id, g.id as candidate, g.vec_id as g_vec, {_COS('v.q', 'g.q')} as cos from v join g on g.team = v.team and g.vec_id <> v.vec_id)"
_B = lambda a, s: f"({a}.bx * 2 + {a}.bw)" if s == "x" else f"({a}.by_ * 2 + {a}.bh)"
_DIST = f"sqrt(({_B('b', 'x')} - {_B('a', 'x')}) * ({_B('b', 'x')} - {_B('a', 'x')}) + ({_B('b', 'y')} - {_B('a', 'y')}) * ({_B('b', 'y')} - {_B('a', 'y')})::double) / 2"
_MARKS = """marks as (select * from (values ('corner-far-left', 0e0, 0e0), ('corner-far-right', 105e0, 0e0), ('corner-near-left', 0e0, 68e0), ('corner-near-right', 105e0, 68e0), ('halfway-far', 52.5e0, 0e0), ('halfway-near', 52.5e0, 68e0), ('centre-spot', 52.5e0, 34e0),
  ('centre-circle-far', 52.5e0, 24.85e0), ('centre-circle-near', 52.5e0, 43.15e0), ('centre-circle-left', 43.35e0, 34e0), ('centre-circle-right', 61.65e0, 34e0)) m(name, lx, ly)
  union all select concat(e, '-', b, '-', p, '-', n), x + i * (case when p = 'front' then depth else 0 end), 34e0 + k * half from (values ('left', 0e0, 1), ('right', 105e0, -1)) t(e, x, i), (values ('penalty-box', 16.5e0, 20.16e0), ('goal-box', 5.5e0, 9.16e0)) u(b, depth, half), (values ('goal-line'), ('front')) v(p), (values ('far', -1), ('near', 1)) w(n, k)
  union all select 'left-penalty-spot', 11e0, 34e0 union all select 'right-penalty-spot', 94e0, 34e0)"""
_GRID = "(select 1920e0 * (0.08e0 + 0.84e0 * i / 5) as gx, 1080e0 * (0.12e0 + 0.85e0 * j / 4) as gy from range(6) a(i), range(5) b(j))"
_P = lambda k, sx, sy: f"(({H1[3 * k]!r}e0 * gx + {H1[3 * k + 1]!r}e0 * gy + {H1[3 * k + 2]!r}e0{sx if k == 0 else sy}) / (1e-5 * gx + 2e-5 * gy + 1e0))"

ORACLE_SQL = {
    "uncovered_boxes": f"with {_BOXES} select frame_idx, ord from boxes a where ord % 5 = 0 and not exists (select 1 from boxes b where b.frame_idx = a.frame_idx and b.ord % 5 <> 0 and {_IOU('a', 'b')} >= 0.5)",
    "associated": f"with {_BOXES}, c as (select a.frame_idx, a.ord as a_ord, b.ord as b_ord, {_DIST} / 75 * 0.65e0 + (1 - {_IOU('a', 'b')}) * 0.35e0 as cost from boxes a join boxes b on a.frame_idx = b.frame_idx and a.ord % 2 = 0 and b.ord % 2 = 1 where {_DIST} <= 75 and b.bw * b.bh * 10 >= a.bw * a.bh * 3 and b.bw * b.bh * 10 <= a.bw * a.bh * 33), r as (select *, row_number() over w as turn, lead(cost) over w as nxt from c window w as (partition by frame_idx, a_ord order by cost, b_ord)), best as (select *, count(*) over (partition by frame_idx, b_ord) as rivals from r where turn = 1) select frame_idx, a_ord, b_ord, round(cost, 9) as cost from best where cost <= 0.83 and (nxt is null or nxt - cost >= 0.12) and rivals = 1",
    "fragment_candidates": f"with {OBS_SQL}, {_FRAG}, f as (select concat(track, ':', frag) as frag, team, t0, t1 from frags join (select track, min(team) as team from obs group by 1) using (track) where label = 'uncertain' and n >= 2) select f.frag, m.id from f join (select distinct team, id from obs) m using (team) where not exists (select 1 from obs o where o.id = m.id and o.state = 'confirmed' and o.t_us between f.t0 - 50000 and f.t1 + 50000)",
    "nearest_person": f"with {OBS_SQL}, j as (select a.frame_idx, a.ord, b.ord as person, (b.x_m - a.x_m) * 105 * ((b.x_m - a.x_m) * 105) + (b.y_m - a.y_m) * 68 * ((b.y_m - a.y_m) * 68) as square from obs a join obs b on a.frame_idx = b.frame_idx and a.ord <> b.ord and a.kind = 'signup' and abs(a.x_m - b.x_m) <= 200 and abs(a.y_m - b.y_m) <= 200) select frame_idx, ord, arg_min(person, (square, person)) as person, min(square) as square, count(*) as within from j group by 1, 2",
    "knn_mean": f"with {_PAIRS}, r as (select *, row_number() over (partition by vec_id, candidate order by 1 - cos) as turn from gp) select vec_id, candidate, round(sum(1 - cos) / count(*), 9) as mean from r where turn <= 3 group by 1, 2",
    "kit_suggestions": f"with {_PAIRS}, m as (select vec_id, min(1 - cos) filter (candidate % 2 = 0) as a, min(1 - cos) filter (candidate % 2 = 1) as b from gp where vec_id % 3 = 0 group by 1) select vec_id, case when a < b then 'A' else 'B' end as side, round(least(a, b), 9) as distance from m where a is not null and b is not null and least(a, b) <= 0.6 and abs(a - b) >= 0.05",
    "reid_candidates": f"""with {_PAIRS}, p as (select vec_id, candidate, greatest(0, max(cos)) as appearance, (vec_id * 7 + candidate * 3) % 100 / 100e0 as jersey, (vec_id * 13 + candidate) % 2000 / 10e0 as gap_s, (vec_id + candidate) % 5 > 0 as same_team, (vec_id + candidate) % 7 > 0 as both_teams, (vec_id * 3 + candidate) % 11 > 0 as same_role,
    (vec_id + 2 * candidate) % 13 = 0 as gone, case when (vec_id + candidate) % 3 > 0 then ((vec_id * 31 + candidate * 17) % 400)::double end as metres, case when (vec_id + candidate) % 4 > 0 then (vec_id * 41 + candidate * 19) % 300 / 1000e0 end as moved from gp group by vec_id, candidate
), t as (select *, greatest(0.2e0, gap_s) as seconds, moved is not null and gap_s <= 2 as steady from p)
select vec_id, candidate, round(least(greatest(0.76e0 * appearance + 0.1e0 * jersey + 0.06e0 * case when metres is null then 0.5e0 else least(greatest(1 - metres / (13 * seconds + 8), 0), 1) end + 0.03e0 * case when steady then least(greatest(1 - moved / (0.04e0 + gap_s * 0.1e0), 0), 1) else 0.5e0 end + 0.05e0 * case when same_team then 1e0 else 0.5e0 end, 0), 1), 9) as confidence,
  case when steady and gap_s < 1 and moved > 0.1e0 + gap_s * 0.15e0 then 'trajectory' when metres > 13 * seconds + 4 then 'displacement' when gone then 'substituted' when both_teams and not same_team then 'team' when not same_role then 'role' when appearance < case when gap_s > 120 then 0.88e0 else 0.82e0 end then 'appearance' else '' end as reason from t""",
    "in_roster": f"with {OBS_SQL} select distinct id, t_us // 1000000 as step from obs where id in (select id from obs where in_roster)",
    "review_status": f"with {OBS_SQL}, r as (select o_orderkey % 5000 as event, o_orderstatus from orders qualify row_number() over (partition by o_orderkey % 5000 order by o_orderdate desc, o_orderkey desc) = 1) select ord, o_orderstatus as review from obs left join r on r.event = obs.ord where kind = 'purchase'",
    "calibration_log": f"with {OBS_SQL}, k as (select video, ord, round(t_us / 1000)::bigint as at_ from obs where kind = 'signup'), l as (select video, round(t_us / 1000)::bigint as at_, max(ord) as log from obs where kind = 'click' group by 1, 2) select ord, log from k left join l using (video, at_)",
    "zones": f"with {OBS_SQL}, z as (select clipped, case when pitch_conf < 10 then 'unknown' when x_m between 0 and 1000 then 'inside' when x_m between -40 and 1040 then 'boundary' else 'outside' end as auto, case when ord % 3 = 0 then null when y_m between 20 and 980 then 'inside' else 'outside' end as usr from obs), r as (select clipped, auto, usr, list_position(['inside', 'unknown', 'boundary', 'outside'], auto) as a, list_position(['inside', 'unknown', 'boundary', 'outside'], usr) as u from z) select case when usr is null then auto when auto = 'unknown' then usr when a >= u then auto else usr end as zone, clipped, count(*) as n from r group by 1, 2",
    "edges": f"with {_BOXES} select ord, case when bx <= 4 then 'left' when bx + bw >= 996 then 'right' when by_ <= 4 then 'top' when by_ + bh >= 996 then 'bottom' else '' end as edge, bx + bw / 2 as foot_x, by_ + bh as foot_y, by_ + bh >= 996 as cut_below from boxes",
    "score_terms": f"""with {OBS_SQL}, g as (select ord, (t_us - lag(t_us) over w) / 1e6 as gap, (x_m - lag(x_m) over w) * 0.105e0 as dx, (y_m - lag(y_m) over w) * 0.068e0 as dy, (ord % 31 - 15)::double as vx, (ord % 17 - 8)::double as vy from obs window w as (partition by id order by t_us, ord)
), m as (select *, sqrt(dx * dx + dy * dy) as metres, 3 + 7 * least(gap, 2e0) as sigma, case when sqrt(vx * vx + vy * vy) > 9 then 9e0 / sqrt(vx * vx + vy * vy) else 1e0 end as cap from g where gap is not null)
select ord, round(exp(-0.5e0 * (metres / sigma) * (metres / sigma)), 9) as spatial, round(least(greatest(exp(-gap / 30), 0.2e0), 1e0), 9) as temporal, round(least(sqrt((dx - vx * cap * gap) * (dx - vx * cap * gap) + (dy - vy * cap * gap) * (dy - vy * cap * gap)), metres), 6) as reach from m""",
    "motion_classes": f"with {OBS_SQL}, near as (select id, ord, lag(t_us) over w as pt, lag(x_m) over w as px, lag(y_m) over w as py, t_us, x_m, y_m, lead(t_us) over w as nt, lead(x_m) over w as nx, lead(y_m) over w as ny from obs window w as (partition by id order by t_us, ord)), pick as (select case when t_us - pt <= 2000000 then pt else t_us end as a, case when t_us - pt <= 2000000 then px else x_m end as ax, case when t_us - pt <= 2000000 then py else y_m end as ay, case when nt - t_us <= 2000000 then nt else t_us end as b, case when nt - t_us <= 2000000 then nx else x_m end as bx, case when nt - t_us <= 2000000 then ny else y_m end as by_ from near), v as (select sqrt(((bx - ax) * 105 * ((bx - ax) * 105) + (by_ - ay) * 68 * ((by_ - ay) * 68))::double) / 1000 / greatest(0.001e0, (b - a) / 1e6) as speed from pick where b > a) select case when speed < 1 then 'STATIONARY' when speed < 8 then 'ROLLING' else 'FAST' end as motion, count(*) as n from v group by 1",
    "nearest_landmark": f"with {OBS_SQL}, {_MARKS}, j as (select ord, name, round((lx - x_m * 0.105e0) * (lx - x_m * 0.105e0) + (ly - y_m * 0.068e0) * (ly - y_m * 0.068e0), 6) as square from obs, marks) select ord, arg_min(name, (square, name)) as name, min(square) as square from j group by 1",
    "polygon_area": f"with {OBS_SQL}, p as (select track, x_m, y_m, coalesce(lead(x_m) over w, first_value(x_m) over w) as nx, coalesce(lead(y_m) over w, first_value(y_m) over w) as ny from obs window w as (partition by track order by t_us, ord)) select track, abs(sum(x_m * ny - nx * y_m)) / 2 as area from p group by 1",
    "height_scale": f"with {_BOXES}, g as (select a.frame_idx, a.ord, list_sort(list(b.bh)) as hs from boxes a join boxes b on a.frame_idx = b.frame_idx and abs(b.by_ + b.bh - a.by_ - a.bh) < 250 group by 1, 2) select frame_idx, ord, hs[len(hs) // 2 + 1] / 1.8e0 as scale from g",
    "height_bands": f"with {OBS_SQL}, b as (select video, ord, y_m, 300 + ord % 110 as h from obs where y_m between 0 and 999), m as (select video, y_m // 100 as band, median(h) as h from b group by 1, 2), x as (select video, ord, y_m, floor((y_m - 50) / 100)::bigint as low from b) select x.video, ord, case when a.h is null then c.h when c.h is null then a.h else a.h + (c.h - a.h) * ((y_m - (low * 100 + 50)) / 100) end as height from x left join m a on a.video = x.video and a.band = low left join m c on c.video = x.video and c.band = low + 1",
    "hue_only": f"with {_V}, e as (select vec_id, list_transform(q[1:24], lambda x: abs(x)) as q from v), h as (select vec_id, list_concat(q[1:4], list_transform(range(10), lambda k: q[5 + 2 * k] + q[6 + 2 * k])) as h from e) select vec_id, unnest(range(14)) as k, unnest(h) as v from h",
    "layout_distance": f"with {_V}, e as (select vec_id, list_transform(q, lambda x: case when x < -100 then -1e0 else x / 127e0 end) as a, list_transform(list_reverse(q), lambda x: case when x < -100 then -1e0 else x / 127e0 end) as b from v), c as (select vec_id, a, b, unnest(range(len(a) // 3)) as k from e), o as (select vec_id, case when a[3 * k + 1] >= 0 and b[3 * k + 1] >= 0 then least(1e0, sqrt((a[3 * k + 1] - b[3 * k + 1]) ** 2 + (a[3 * k + 2] - b[3 * k + 2]) ** 2 + (a[3 * k + 3] - b[3 * k + 3]) ** 2) / 0.5e0) end as x from c) select vec_id, round(avg(x), 9) as distance from o group by 1",
    "keeper_verdicts": f"""with {OBS_SQL}, g as (select id, count(*) as records, count(*) filter (y_m < 0 or y_m > 1000) / count(*) as off, count(*) filter (y_m < 40 or y_m > 960) / count(*) as touch, count(*) filter (x_m < 160 or x_m > 840) / count(*) as near, count(*) filter (x_m < 200 or x_m > 800) / count(*) as deep,
  count(*) filter (kind = 'view') / count(*) as alone, count(*) filter (role = 'GOALKEEPER') / count(*) as det, count(*) filter (clipped) / count(*) as kit, sum(identity_conf) / count(*) / 100 as sure from obs group by 1
), r as (select *, case when near >= 0.5 then 'area' when deep >= 0.6 and (alone >= 0.5 or det >= 0.5 or kit >= 0.6) then 'deepest' when det >= 0.75 and kit >= 0.6 and (deep >= 0.3 or near >= 0.2) then 'detector' end as way from g
), v as (select *, case when off > 0.2 then 'veto: off the pitch' when touch >= 0.3 then 'veto: touchline' when way is null then 'no place' when records < 15 then 'few records' when sure < 0.5 then 'low confidence' else 'confirmed' end as reason from r) select id, records, reason, case when reason = 'confirmed' then way end as route from v""",
    "sanity": f"""{_GALLERY_SCORES}, {OBS_SQL}, ids as (select team, id, user_id, max(role) as role from obs group by 1, 2, 3), seen as (select distinct frame_idx, user_id from obs), who as (select distinct user_id, video, team from obs where role = 'PLAYER'
), alike as (select a.video, s.a, s.b, s.cos from scores s join who a on a.user_id = s.a join who b on b.user_id = s.b and b.team = a.team where s.cos >= 0.93e0 and not exists (select 1 from seen x join seen y using (frame_idx) where x.user_id = s.a and y.user_id = s.b) qualify row_number() over (partition by a.video order by cos desc, s.a desc, s.b desc) <= 3)
select 'over_cap' as rule, team as key, count(*) as value from ids group by team having count(*) > 12 union all select 'keepers', team, count(*) from ids where role = 'GOALKEEPER' group by team having count(*) > 1 union all select 'look_alike', concat(a, '-', b), floor(cos * 100)::bigint from alike""",
    "invariants": f"with {OBS_SQL} select 'duplicate time' as rule, count(*) as n from (select 1 from obs group by id, t_us having count(*) > 1) union all select 'time goes back', count(*) from (select t_us, lag(t_us) over (partition by id order by ord) as b from obs) where t_us < b union all select 'outside the picture', count(*) from obs where x_m < -50 or x_m > 1050 or y_m < -50 or y_m > 1050 union all select 'confidence without state', count(*) from obs where identity_conf >= 90 and state <> 'confirmed' union all select 'no team', count(*) from obs where team is null",
    "registration_summary": f"with {OBS_SQL}, s as (select *, case when pitch_conf < 10 then 'none' when pitch_conf < 40 then 'carried' else 'anchor' end as source from obs) select video, count(*) as frames, count(*) filter (source <> 'none') as known, round_even(count(*) filter (source <> 'none') / count(*), 3) as share, round_even(count(*) filter (pitch_conf >= 50) / count(*), 3) as confident, round(sum(pitch_conf) / count(*) / 100, 6) as mean_confidence, count(*) filter (source = 'anchor') as anchor, count(*) filter (source = 'carried') as carried from s group by 1",
    "disagreement": f"""with {OBS_SQL}, grid as {_GRID}, p as (select ord, {_P(0, '', '')} as ax, {_P(1, '', '')} as ay, {_P(0, ' + x_m / 200', '')} as bx, {_P(1, '', ' + y_m / 200')} as by_ from obs, grid
), q as (select ord, sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) as d, ax between -5 and 110 and ay between -5 and 73 as on_ from p) select ord, round(case when count(*) filter (on_) >= 4 then median(d) filter (on_) else median(d) end, 6) as metres from q group by 1""",
    "people_per_frame": f"with {OBS_SQL}, f as (select video, frame_idx, count(*) as n from obs group by 1, 2) select video, sum(n)::bigint as people, count(*) as frames, sum(n) / count(*) as average from f group by 1",
    "stage_timing": f"with {OBS_SQL} select video, count(distinct frame_idx) as frames, " + ", ".join(f"round_even(sum(case when kind = '{k}' then pitch_conf else 0 end) / count(distinct frame_idx), 1) as {k}_ms" for k in ("view", "click", "purchase", "error")) + " from obs group by 1",
    "swapped_ids": f"with {OBS_SQL}, a as (select user_id // 2 * 2 as pair, min(t_us) as at_us from obs where kind = 'error' and ord % 3 = 0 group by 1) select ord, case when t_us >= at_us then concat('U', case when user_id % 2 = 0 then user_id + 1 else user_id - 1 end) else id end as id from obs left join a on a.pair = user_id // 2 * 2",
    "best_in_frame": f"with {OBS_SQL} select frame_idx, ord, pitch_conf from obs qualify row_number() over (partition by frame_idx order by pitch_conf desc, ord) = 1",
    "most_common": f"with {OBS_SQL}, c as (select video, kind, count(*) as n, min(ord) as first from obs group by 1, 2) select *, row_number() over (partition by video order by n desc, first) as place from c",
    "heaviest_samples": f"with {_V} select id, row_number() over (partition by id order by quality desc, vec_id) as turn, vec_id from v qualify turn <= 32",
    "event_messages": f"with {OBS_SQL}, e as (select *, case when ord % 4 > 0 then team end as t from obs where kind = 'error') select ord, concat(upper(kind), chr(10), 'Global ID: ', id, chr(10), 'Now: ', case when role = 'PLAYER' then case when t is not null then concat('team ', t, ' player') else 'player (team unknown)' end else case when t is not null then concat('goalkeeper (team ', t, ')') else 'goalkeeper (team unknown)' end end) as message from e",
}
