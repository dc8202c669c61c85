"""Queries of similarity, assignment, merges and edits, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as fv
from ..operators import edits, matching
from ..sources.adapter import OBS_SQL, observations, table


def _vectors(s, d):
    # Ten identities are a team, so a team's vectors and galleries do not grow with the table's identities.
    v = table(s, d, "embeddings").select("vec_id", F.col("label").alias("id"), F.floor(F.col("label") / 10).alias("team"), fv.quantized(F.col("embedding")).alias("q"))
    return v.withColumns({"quality": (F.col("vec_id") * 7919) % 1000, "norm": fv.norm(F.col("q"))})


def _scores(s, d):
    return matching.best_two(matching.gallery_pairs(matching.gallery(_vectors(s, d)), "team"), ["a", "b"], "cos")


def _probe_scores(s, d):
    v = _vectors(s, d)
    g = matching.gallery(v).select("team", F.col("id").alias("candidate"), F.col("q").alias("gq"), F.col("norm").alias("g_norm"), F.col("vec_id").alias("g_vec"))
    j = v.join(g, "team").where("vec_id <> g_vec").select("vec_id", "candidate", fv.cosine(F.col("q"), F.col("gq"), F.col("norm"), F.col("g_norm")).alias("cos"))
    return matching.best_two(j, ["vec_id", "candidate"], "cos")


def _boxes(s, d):
    o = observations(s, d)
    return o.select("frame_idx", "ord", "id", "pitch_conf", *matching.boxes(o))


def _pairs(s, d):
    b = _boxes(s, d)
    return matching.frame_pairs(b.where("ord % 2 = 0"), b.where("ord % 2 = 1"), 0.3)


_PAIR = "frame_idx long, a_ord long, b_ord long, a_id string, b_id string, iou double"


def _greedy(s, d):
    return matching.greedy(_pairs(s, d), "frame_idx", _PAIR)


def _agreement(s, d):
    g = _greedy(s, d).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("matched"), F.sum(F.when(F.col("a_id") == F.col("b_id"), F.col("n")).otherwise(0)).alias("same_id"), F.count(F.lit(1)).alias("id_pairs"))


def _points(s, d):
    return observations(s, d).select("ord", "id", "t_us", "frame_idx", "state", F.floor(F.col("t_us") / 10_000_000).alias("generation"), (F.col("kind") == "view").alias("experimental"), "x_m", "y_m")


def _history_edits(s, d):
    e = observations(s, d).where("kind = 'error'")
    return e.select(F.when(F.col("ord") % 500 == 0, "*").otherwise(F.col("id")).alias("player"), (F.col("t_us") * 13 % 65_000_000).alias("t_us"), (F.col("ord") % 7).alias("generation"))


def _merges(s, d):
    c = table(s, d, "customer")
    return c.where("c_custkey % 3 <> 1 and c_custkey > 1").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 2).alias("into"))


def _galleries(s, d):
    v = table(s, d, "embeddings")
    return v.select(F.floor(F.col("label") / 5).alias("target"), (F.col("label") % 5).alias("source"), ((F.col("vec_id") * 104729) % 10007).alias("t_us"), F.col("vec_id").alias("ord"))


def _conflicts(s, d):
    o = observations(s, d).select("user_id", "frame_idx").distinct()
    a = o.select("user_id", "frame_idx")
    b = o.select((F.col("user_id") - 12).alias("user_id"), "frame_idx")
    return a.intersect(b).groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"))


def _known(s, d):
    c = lambda name, k: F.when(F.col("ord") % k != 0, F.col(name))
    parts = [(c("identity_conf", 3), 35), (c("pitch_conf", 5), 10), (c("x_m", 7), 30), (c("y_m", 11), 15), (c("user_id", 2), 10)]
    return observations(s, d).select("ord", fv.known_mean(parts).alias("mean"))


def _hellinger(s, d):
    v = _vectors(s, d)
    proto = v.select("id", F.posexplode("q").alias("k", "x")).groupBy("id", "k").agg(F.sum(F.abs("x")).alias("m"))
    proto = proto.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("p"))
    return v.join(proto, "id").select("vec_id", F.round(fv.hellinger(F.col("q"), F.col("p")), 9).alias("distance"))


QUERIES = {
    "gallery_top": lambda s, d: matching.gallery(_vectors(s, d)).select("id", "turn", "vec_id", "quality"),
    "cosine_pairs": lambda s, d: _scores(s, d).select("a", "b", "cos", fv.similarity(F.col("cos")).alias("similarity")),
    "mutual_best": lambda s, d: matching.mutual_best(_scores(s, d)),
    "knn_top2_gap": lambda s, d: matching.top_two_gap(_probe_scores(s, d), "vec_id", "candidate", "cos"),
    "hellinger": _hellinger,
    "known_mean": _known,
    "iou_pairs": _pairs,
    "greedy_match": lambda s, d: _greedy(s, d).select("frame_idx", "a_ord", "b_ord", "iou"),
    "nms": lambda s, d: matching.suppressed(_boxes(s, d).withColumn("score", F.col("pitch_conf")), 0.3),
    "assignment": lambda s, d: matching.assigned(_pairs(s, d)),
    "cooccurrence": lambda s, d: _greedy(s, d).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("n")),
    "agreement": _agreement,
    "history_valid": lambda s, d: edits.valid_history(_points(s, d), _history_edits(s, d)).select("ord", "id", "t_us", "generation"),
    "merge_points": lambda s, d: edits.merged_points(_points(s, d).where("ord % 2 = 0"), _points(s, d).where("ord % 2 = 1"), ["id", "frame_idx"]).select("id", "frame_idx", "ord", "source"),
    "interval_replace": lambda s, d: edits.interval_replaced(_points(s, d).where("ord % 2 = 0"), _points(s, d).where("ord % 2 = 1"), 20_000_000, 40_000_000).select("ord", "id", "t_us", "state"),
    "edit_closure": lambda s, d: edits.resolved(_merges(s, d)),
    "edit_replay": lambda s, d: edits.replayed(table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id")), _merges(s, d)).groupBy("id").agg(F.count(F.lit(1)).alias("orders")),
    "seeds_latest": lambda s, d: edits.latest(table(s, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus"),
    "gallery_merge": lambda s, d: edits.alternating(_galleries(s, d)).select("target", "place", "source", "t_us", "ord"),
    "conflict_frames": _conflicts,
    "backfill_ids": lambda s, d: edits.backfilled(observations(s, d).select("track", "t_us", "ord", F.when(F.col("identity_conf") >= 50, F.col("ord") % 4).alias("bound"))).groupBy("track", "filled").agg(F.count(F.lit(1)).alias("n")),
    "throttle": lambda s, d: edits.throttled(observations(s, d), "id", 800_000),
    "latest_in_frame": lambda s, d: edits.latest(observations(s, d), ["frame_idx", "kind"], F.desc("t_us"), F.desc("ord")).select("frame_idx", "kind", "ord"),
}

_V = """v as (select vec_id, label as id, label // 10 as team, (vec_id * 7919) % 1000 as quality,
  list_transform(embedding, lambda x: round(x::double / list_max(list_transform(embedding, lambda y: abs(y::double))) * 127)::bigint) as q from embeddings
), g as (select *, row_number() over (partition by id order by quality desc, vec_id) as turn from v qualify turn <= 6)"""
_COS = lambda a, b: f"list_dot_product({a}::double[], {b}::double[]) / (sqrt(list_dot_product({a}::double[], {a}::double[])) * sqrt(list_dot_product({b}::double[], {b}::double[])))"
_BEST = lambda keys, rows: f"(select {keys}, (max(cos) filter (turn = 1) + coalesce(max(cos) filter (turn = 2), max(cos) filter (turn = 1))) / 2 as cos from (select *, row_number() over (partition by {keys} order by cos desc) as turn from ({rows})) where turn <= 2 group by {keys})"
_SCORES = f"with {_V}, scores as {_BEST('a, b', f'select x.id as a, y.id as b, {_COS("x.q", "y.q")} as cos from g x join g y on x.team = y.team and x.id < y.id')}"
_BOXES = f"{OBS_SQL}, boxes as (select frame_idx, ord, id, pitch_conf, x_m as bx, y_m as by_, 200 + ord % 90 as bw, 300 + ord % 110 as bh from obs)"
_INTER = lambda a, b: f"(greatest(0, least({a}.bx + {a}.bw, {b}.bx + {b}.bw) - greatest({a}.bx, {b}.bx)) * greatest(0, least({a}.by_ + {a}.bh, {b}.by_ + {b}.bh) - greatest({a}.by_, {b}.by_)))"
_IOU = lambda a, b: f"({_INTER(a, b)} / ({a}.bw * {a}.bh + {b}.bw * {b}.bh - {_INTER(a, b)}))"
_PAIRS = f"{_BOXES}, pairs as (select a.frame_idx, a.ord as a_ord, b.ord as b_ord, a.id as a_id, b.id as b_id, {_IOU('a', 'b')} as iou from boxes a join boxes b on a.frame_idx = b.frame_idx and a.ord % 2 = 0 and b.ord % 2 = 1 where {_IOU('a', 'b')} >= 0.3)"
_GREEDY = f"""with recursive {_PAIRS}, ranked as (select *, row_number() over (partition by frame_idx order by iou desc, a_ord, b_ord) as r from pairs
), walk(frame_idx, r, la, lb, hit) as (
  select frame_idx, 1::bigint, [a_ord], [b_ord], true from ranked where r = 1
  union all
  select w.frame_idx, w.r + 1, case when list_contains(w.la, p.a_ord) or list_contains(w.lb, p.b_ord) then w.la else list_append(w.la, p.a_ord) end,
    case when list_contains(w.la, p.a_ord) or list_contains(w.lb, p.b_ord) then w.lb else list_append(w.lb, p.b_ord) end,
    not (list_contains(w.la, p.a_ord) or list_contains(w.lb, p.b_ord))
  from walk w join ranked p on p.frame_idx = w.frame_idx and p.r = w.r + 1
), chosen as (select p.* from ranked p join walk w on w.frame_idx = p.frame_idx and w.r = p.r where w.hit)
"""
_POINTS = f"{OBS_SQL}, points as (select ord, id, t_us, frame_idx, state, t_us // 10000000 as generation, kind = 'view' as experimental from obs)"
_ROOTS = """recursive merges as (select c_custkey as id, c_custkey // 2 as into_ from customer where c_custkey % 3 <> 1 and c_custkey > 1
), chain(id, root, depth) as (select id, into_, 1 from merges union all select c.id, m.into_, c.depth + 1 from chain c join merges m on m.id = c.root
), roots as (select id, arg_max(root, depth) as root from chain group by id)"""

ORACLE_SQL = {
    "gallery_top": f"with {_V} select id, turn, vec_id, quality from g",
    "cosine_pairs": f"{_SCORES} select a, b, cos, least(greatest((cos - 0.6e0) / 0.35e0, 0), 1) as similarity from scores",
    "mutual_best": f"{_SCORES}, both_ways as (select a, b, cos from scores union all select b, a, cos from scores), best as (select a, b, cos from both_ways qualify row_number() over (partition by a order by cos desc, b) = 1) select x.a, x.b, x.cos from best x join best y on y.a = x.b and y.b = x.a where x.a < x.b",
    "knn_top2_gap": f"with {_V}, sc as {_BEST('vec_id, candidate', f'select v.vec_id, g.id as candidate, {_COS("v.q", "g.q")} as cos from v join g on g.team = v.team and g.vec_id <> v.vec_id')}, r as (select *, row_number() over (partition by vec_id order by cos desc, candidate) as turn from sc) select vec_id, max(candidate) filter (turn = 1) as best, max(cos) filter (turn = 1) as score, max(cos) filter (turn = 1) - max(cos) filter (turn = 2) as lead from r where turn <= 2 group by vec_id",
    "hellinger": f"with {_V}, e as (select vec_id, id, generate_subscripts(q, 1) as k, unnest(q) as x from v), p as (select id, k, sum(abs(x))::bigint as m from e group by 1, 2), s as (select e.vec_id, sum(floor(sqrt((abs(e.x) * p.m)::double) * 1000000)::bigint)::bigint as o, sum(abs(e.x))::bigint as a, sum(p.m)::bigint as b from e join p on p.id = e.id and p.k = e.k group by 1) select vec_id, round(sqrt(greatest(0, 1 - o / 1e6 / sqrt((a * b)::double))), 9) as distance from s",
    "known_mean": f"with {OBS_SQL} select ord, (case when ord % 3 <> 0 then identity_conf * 35 else 0 end + case when ord % 5 <> 0 then pitch_conf * 10 else 0 end + case when ord % 7 <> 0 then x_m * 30 else 0 end + case when ord % 11 <> 0 then y_m * 15 else 0 end + case when ord % 2 <> 0 then user_id * 10 else 0 end) / nullif(case when ord % 3 <> 0 then 35 else 0 end + case when ord % 5 <> 0 then 10 else 0 end + case when ord % 7 <> 0 then 30 else 0 end + case when ord % 11 <> 0 then 15 else 0 end + case when ord % 2 <> 0 then 10 else 0 end, 0) as mean from obs",
    "iou_pairs": f"with {_PAIRS} select * from pairs",
    "greedy_match": f"{_GREEDY} select frame_idx, a_ord, b_ord, iou from chosen",
    "cooccurrence": f"{_GREEDY} select a_id, b_id, count(*) as n from chosen group by 1, 2",
    "agreement": f"{_GREEDY} select count(*) as matched, count(*) filter (a_id = b_id) as same_id, count(distinct (a_id, b_id)) as id_pairs from chosen",
    "nms": f"""with recursive {_BOXES}, ranked as (select *, row_number() over (partition by frame_idx order by pitch_conf desc, ord) as r from boxes
), walk(frame_idx, r, kept, hit) as (
  select frame_idx, 1::bigint, [{{'bx': bx, 'by_': by_, 'bw': bw, 'bh': bh}}], true from ranked where r = 1
  union all
  select w.frame_idx, w.r + 1, case when len(list_filter(w.kept, lambda k: {_IOU('k', 'p')} > 0.3)) = 0 then list_append(w.kept, {{'bx': p.bx, 'by_': p.by_, 'bw': p.bw, 'bh': p.bh}}) else w.kept end,
    len(list_filter(w.kept, lambda k: {_IOU('k', 'p')} > 0.3)) = 0
  from walk w join ranked p on p.frame_idx = w.frame_idx and p.r = w.r + 1
) select p.frame_idx, p.ord, p.pitch_conf as score from ranked p join walk w on w.frame_idx = p.frame_idx and w.r = p.r where w.hit""",
    "history_valid": f"with {_POINTS}, hist as (select case when ord % 500 = 0 then '*' else id end as player, t_us * 13 % 65000000 as t_us, ord % 7 as generation from obs where kind = 'error') select ord, id, t_us, generation from points p where not exists (select 1 from hist e where (e.player = '*' or e.player = p.id) and e.generation > p.generation and p.experimental and p.t_us >= e.t_us - 125000)",
    "merge_points": f"with {_POINTS} select id, frame_idx, ord, (ord % 2)::int as source from points qualify row_number() over (partition by id, frame_idx order by experimental::int, ord % 2 desc, ord desc) = 1",
    "interval_replace": f"with {_POINTS} select ord, id, t_us, state from points where (ord % 2 = 0 and (state = 'confirmed' or t_us not between 20000000 and 40000000)) or (ord % 2 = 1 and t_us between 20000000 and 40000000)",
    "edit_closure": f"with {_ROOTS} select id, root from roots",
    "edit_replay": f"with {_ROOTS} select coalesce(r.root, o.o_custkey) as id, count(*) as orders from orders o left join roots r on r.id = o.o_custkey group by 1",
    "seeds_latest": "select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    "gallery_merge": "with g as (select label // 5 as target, label % 5 as source, (vec_id * 104729) % 10007 as t_us, vec_id as ord from embeddings), t as (select *, row_number() over (partition by target, source order by t_us desc, ord) as turn from g), p as (select *, row_number() over (partition by target order by turn, source) as place from t) select target, place, source, t_us, ord from p where place <= 6",
    "conflict_frames": f"with {OBS_SQL} select user_id, count(*) as frames from (select user_id, frame_idx from obs intersect select user_id - 12, frame_idx from obs) group by 1",
    "backfill_ids": f"with {OBS_SQL}, b as (select track, t_us, ord, case when identity_conf >= 50 then ord % 4 end as bound from obs), f as (select track, coalesce(bound, first_value(bound ignore nulls) over (partition by track order by t_us range between current row and 12000000 following)) as filled from b) select track, filled, count(*) as n from f group by 1, 2",
    "throttle": f"with recursive {OBS_SQL}, r as (select id, t_us, ord, row_number() over (partition by id order by t_us, ord) as k from obs), walk(id, k, t_us, ord, last_us, hit) as (select id, k, t_us, ord, t_us, true from r where k = 1 union all select w.id, r.k, r.t_us, r.ord, case when r.t_us - w.last_us >= 800000 then r.t_us else w.last_us end, r.t_us - w.last_us >= 800000 from walk w join r on r.id = w.id and r.k = w.k + 1) select id, t_us, ord from walk where hit",
    "latest_in_frame": f"with {OBS_SQL} select frame_idx, kind, ord from obs qualify row_number() over (partition by frame_idx, kind order by t_us desc, ord desc) = 1",
}
