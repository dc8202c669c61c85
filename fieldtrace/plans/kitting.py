"""Queries of kits and of tracklets' appearance, with DuckDB SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import kits, pairing, tracklets, trails
from ..sources.adapter import OBS_SQL, observations, table


def _hist(first, share, bins=24):
    """A histogram with ``share`` in one bin and the rest in the next."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.when(k == first, share).when(k == first + 1, 1 - share).otherwise(0.0))


def samples(s, d) -> DataFrame:
    """Crops of the people: teams wear two kits, keepers and every tenth person others, in changing light."""
    o = observations(s, d)
    odd = F.col("user_id") % 10 == 3
    first = F.when(F.col("role") == "GOALKEEPER", 20).when(odd, 8).when(F.col("user_id") % 2 == 0, 4).otherwise(16)
    light = 0.55 + (F.col("ord") % 10) / 50
    shorts = _hist(F.when(F.col("user_id") % 2 == 0, 2).otherwise(7), F.lit(0.8), 12)
    player = F.when(odd, 0.3).otherwise(0.7 + (F.col("ord") % 3) / 10)
    return o.select(
        "video", "ord", "track", "frame_idx", "t_us", _hist(first, light).alias("jersey"), F.when(F.col("ord") % 4 > 0, shorts).alias("shorts"), (F.col("identity_conf") / 100).alias("weight"), (F.col("t_us") / 1e6).alias("born"),
        player.alias("player_share"), (F.col("identity_conf") / 100).alias("quality"), F.when(F.col("clipped"), "outside").otherwise("inside").alias("zone"), "state",
    )


def _learned(s, d):
    return kits.learned_kits(kits.kit_samples(samples(s, d)))


def _rounded(c):
    return F.transform(c, lambda x: F.round(x, 4)).alias(c)


def _models(s, d):
    m = _learned(s, d)
    return m.select("video", "ready", "samples", *(_rounded(c) for c in ("a", "b", "shorts_a", "shorts_b")), *(F.round(c, 4).alias(c) for c in ("spread", "spread_a", "spread_b")))


def _votes(s, d):
    """What each crop wears by the kits of its video, a referee's and a keeper's; counted."""
    m = _learned(s, d).withColumns({"referee": _hist(F.lit(8), F.lit(0.6)), "referee_shorts": _hist(F.lit(10), F.lit(0.8), 12), "keepers": F.array(F.struct(F.lit("A").alias("team"), _hist(F.lit(20), F.lit(0.6)).alias("jersey")))})
    return kits.kit_votes(samples(s, d), m).groupBy("video", "team", "outlier", "ref_like", "keeper_like", "shorts_mismatch").agg(F.count(F.lit(1)).alias("n"), F.avg("margin").alias("margin"))


def _detections(s, d):
    """Detections of ten frames at a time; a feature is the crop's histogram over its 24 bins."""
    x = samples(s, d)
    return x.select("video", F.floor(F.col("frame_idx") / 10).alias("frame_idx"), "ord", F.when(F.col("zone") == "inside", 0.9).otherwise(0.2).alias("field"), (F.col("quality") + 0.3).alias("score"), F.col("jersey").alias("feature"))


def _discovered(s, d):
    return kits.discovered(_detections(s, d))


def _classified(s, d):
    """Teams of all crops by the uniforms that were discovered first."""
    f, found = _detections(s, d), _discovered(s, d)
    pick = lambda k: found.select("video", F.col(k).alias("ord")).join(f.select("video", "ord", F.col("feature").alias(f"{k}_")), ["video", "ord"]).drop("ord")
    centres = pick("a").join(pick("b"), "video").withColumnsRenamed({"a_": "a", "b_": "b"})
    return kits.classified(f, centres).groupBy("video", "team").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def _remaining(s, d):
    """In each video ten of a side are labelled, and some of the other; the last one of the side, and who it may be among the crops of the first frames."""
    o = observations(s, d)
    ids = o.groupBy("video", "team", "id", "user_id").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("video", "team").orderBy("user_id"))
    ids = ids.withColumn("place", place)
    look = samples(s, d).select("ord", "jersey")
    labelled = ids.where("place <= 10").join(look, "ord").select("video", "team", "ord", F.col("jersey").alias("appearance"))
    first = o.withColumn("turn", F.row_number().over(Window.partitionBy("video").orderBy("t_us", "ord"))).where("turn <= 3").join(look, "ord")
    return pairing.remaining_player(ids.where("place = 11").select("video", "team", "id"), labelled, first.select("video", "ord", (F.col("identity_conf") / 100).alias("score"), F.col("jersey").alias("appearance")))


def crops(s, d) -> DataFrame:
    """Vectors as crops: 200 are a track, which shows one label after the other, ten seconds each; a label draws its crops its own way."""
    e = table(s, d, "embeddings").where("embedding is not null and label is not null")
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    e = e.withColumn("v", F.transform("embedding", lambda x: x.cast("double"))).withColumn("long", length("v"))
    e = e.withColumn("v", F.transform("v", lambda x, k: x / F.col("long") + F.when(k == F.col("label"), 4.0).otherwise(0.0))).withColumn("long", length("v"))
    return e.select(F.floor(F.col("vec_id") / 200).alias("track"), (F.col("label") * 10_000_000 + F.col("vec_id") % 200 * 40_000).cast("long").alias("t_us"), F.col("vec_id").alias("ord"), F.transform("v", lambda x: x / F.col("long")).alias("v"), F.concat(F.lit("L"), F.floor(F.col("label") / 5).cast("string")).alias("state"))


def _changes(s, d):
    return tracklets.change_points(crops(s, d)).withColumn("cross", F.round("cross", 9))


def _cuts(s, d):
    return tracklets.appearance_cuts(crops(s, d))


def _fragments(s, d):
    """Tracks cut where their label changes and where they stop looking like themselves."""
    points = tracklets.cut_points(crops(s, d).drop("v"), _cuts(s, d))
    return trails.label_segments(points, "is_cut")


QUERIES = {"kit_models": _models, "kit_rule_votes": _votes, "team_discovery": _discovered, "team_classes": _classified, "remaining_player": _remaining, "appearance_changes": _changes, "appearance_cuts": _cuts, "crop_fragments": _fragments}

_CROPS = """crops as (
  select vec_id // 200 as track, label * 10000000::bigint + vec_id % 200 * 40000 as t_us, vec_id as ord, label,
    list_transform(embedding, lambda x, k: x::double / sqrt(list_inner_product(embedding::double[], embedding::double[])) + case when k - 1 = label then 4 else 0 end) as e from embeddings where embedding is not null and label is not null
), placed as (
  select *, row_number() over (partition by track order by t_us, ord) - 1 as place, count(*) over (partition by track) as n from crops
), across as (
  select a.track, a.place, avg(list_cosine_similarity(b.e, c.e)) as cross_
  from placed a join placed b on b.track = a.track and b.place between a.place - 3 and a.place - 1 join placed c on c.track = a.track and c.place between a.place and a.place + 2 group by 1, 2
), sides as (
  select a.track, a.place, min(list_cosine_similarity(b.e, c.e)) as inner_
  from placed a join placed b on b.track = a.track and b.place between a.place - 3 and a.place + 2
  join placed c on c.track = a.track and c.place between a.place - 3 and a.place + 2 and c.place > b.place and (b.place < a.place) = (c.place < a.place) group by 1, 2
), changes as (
  select p.track, (q.t_us + p.t_us) // 2 as t_us, p.ord, a.cross_ from placed p join placed q on q.track = p.track and q.place = p.place - 1
  join across a on a.track = p.track and a.place = p.place left join sides s on s.track = p.track and s.place = p.place
  where p.place >= 2 and p.place <= p.n - 2 and a.cross_ < 0.55 and coalesce(s.inner_, 1) >= 0.6
), cuts as (
  select track, min(t_us) as t_us, arg_min(ord, (t_us, ord)) as ord from changes group by track
  union all
  select c.track, c.t_us, c.ord from (select k.track, min(n.t_us) as t_us, arg_min(n.ord, (n.t_us, n.ord)) as ord from cuts k join changes n on n.track = k.track and n.t_us > k.t_us + 1000000 group by k.track) c
)"""

ORACLE_SQL = {
    "appearance_changes": f"with recursive {_CROPS} select track, t_us, ord, round(cross_, 9) as \"cross\" from changes",
    "appearance_cuts": f"with recursive {_CROPS} select track, t_us, ord from cuts",
    "crop_fragments": f"""with recursive {_CROPS}, points as (
  select p.track, p.t_us, p.ord, concat('L', p.label // 5) as state, (select count(distinct q.t_us) from (select track, (select min(x.t_us) from crops x where x.track = k.track and x.t_us >= k.t_us) as t_us from cuts k) q where q.track = p.track and q.t_us <= p.t_us) as segment from crops p
), marks as (
  select *, case when state = lag(state) over w and segment = lag(segment) over w then 0 else 1 end as new from points window w as (partition by track order by t_us, ord)
), parts as (
  select *, sum(new) over (partition by track order by t_us, ord) as frag from marks
)
select track, frag::bigint as frag, any_value(state) as label, any_value(segment) as segment, min(t_us) as t0, max(t_us) as t1, count(*) as n from parts group by 1, 2""",
    "remaining_player": f"""with {OBS_SQL}, looks as (
  select *, case when role = 'GOALKEEPER' then 20 when user_id % 10 = 3 then 8 when user_id % 2 = 0 then 4 else 16 end as bin, 0.55 + ord % 10 / 50 as light from obs
), ids as (
  select video, team, id, user_id, min(ord) as ord, row_number() over (partition by video, team order by user_id) as place from obs group by 1, 2, 3, 4
), known as (
  select i.video, i.team, l.bin, l.light from ids i join looks l on l.ord = i.ord where place <= 10
), asks as (
  select i.video, i.team, any_value(i.id) as id from ids i where place = 11 and (select count(*) from known k where k.video = i.video and k.team = i.team) = 10 and (select count(*) from known k where k.video = i.video and k.team <> i.team) >= 3 group by 1, 2 having count(*) = 1
), seen as (
  select * from (select *, row_number() over (partition by video order by t_us, ord) as turn from looks) where turn <= 3 and identity_conf >= 50
), pairs as (
  select a.video, a.team, a.id, c.ord, k.team = a.team as own, 1 - case when c.bin = k.bin then sqrt(c.light * k.light) + sqrt((1 - c.light) * (1 - k.light)) else 0 end as d
  from asks a join seen c on c.video = a.video join known k on k.video = a.video
), nearest as (
  select video, team, id, ord, own, avg(d) as mean from (select *, row_number() over (partition by video, team, id, ord, own order by d) as turn from pairs) where turn <= 3 group by all
), fits as (
  select video, team, id, ord from nearest group by all having max(mean) filter (own) < 0.2 and max(mean) filter (not own) - max(mean) filter (own) > 0.12
)
select video, team, id, min(ord) as ord from fits group by 1, 2, 3 having count(*) = 1""",
    "team_discovery": f"""with {OBS_SQL}, f as (
  select video, frame_idx // 10 as frame_idx, ord, case when role = 'GOALKEEPER' then 20 when user_id % 10 = 3 then 8 when user_id % 2 = 0 then 4 else 16 end as bin, 0.55 + ord % 10 / 50 as light
  from obs where not clipped and identity_conf / 100 + 0.3 > 0.5
), g as (
  select * from f qualify count(*) over (partition by video, frame_idx) >= 6
), pairs as (
  select a.video, a.frame_idx, a.ord, b.ord as o_ord, 1 - case when a.bin = b.bin then sqrt(a.light * b.light) + sqrt((1 - a.light) * (1 - b.light)) else 0 end as d from g a join g b on b.video = a.video and b.frame_idx = a.frame_idx
), groups as (
  select video, frame_idx, ord, count(*) filter (d < 0.16) as members from pairs group by 1, 2, 3
), first as (
  select video, frame_idx, arg_min(ord, (-members, ord)) as a from groups group by 1, 2 having max(members) >= 3
), second as (
  select p.video, p.frame_idx, f.a, arg_min(p.o_ord, (-g.members, p.o_ord)) as b from first f join pairs p on p.video = f.video and p.frame_idx = f.frame_idx and p.ord = f.a and p.d > 0.35
  join groups g on g.video = p.video and g.frame_idx = p.frame_idx and g.ord = p.o_ord and g.members >= 3 group by 1, 2, 3
)
select video, min(frame_idx) as frame_idx, arg_min(a, frame_idx) as a, arg_min(b, frame_idx) as b from second group by 1""",
}
