"""Queries of correction logs, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corrections as co
from ..sources.adapter import OBS_SQL, observations, table

KINDS = ("player", "goalkeeper", "excluded", "left", "referee")


def _people(s, d):
    """Observations; an uncertain one has no id yet."""
    o = observations(s, d)
    return o.select("video", "frame_idx", "ord", "t_us", F.when(F.col("state") == "confirmed", F.col("id")).alias("id"), "track", "team", "role", "state")


def _log(s, d):
    """One order in sixteen is a correction of the customer's identity, or of a track of it."""
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    o = table(s, d, "orders").where("o_orderkey % 16 < 2")
    kind = F.element_at(F.array(*(F.lit(x) for x in KINDS)), (F.floor(k / 16) % 5 + 1).cast("int"))
    by_track = (k % 7 == 0) & ~kind.isin("left")
    into = (kind == "player") & (k % 3 != 0) & ~by_track
    mate = F.floor(u / 25) * 25 + (u + 7) % 25
    new = F.when(into, F.concat(F.lit("U"), mate.cast("string"))).when(~kind.isin("excluded", "left"), F.concat(F.lit("N"), k.cast("string")))
    return o.select(
        k.cast("long").alias("seq"), F.floor(u / 25).alias("video"), kind.alias("kind"), F.when(~by_track, F.concat(F.lit("U"), u.cast("string"))).alias("target_id"), F.when(by_track, u * 10 + k % 6).cast("long").alias("target_track"),
        F.concat(F.when(k % 2 == 0, "A").otherwise("B"), F.floor(u / 25).cast("string")).alias("team"), new.alias("new_id"), into.alias("into"), (k * 7919 % 65_000_000).cast("long").alias("t_us"),
    )


def _registry(s, d):
    return observations(s, d).select("video", "id").distinct().withColumn("status", F.lit("here"))


def _remembered(s, d):
    return table(s, d, "customer").where("c_custkey % 4 = 0").select(F.floor(F.col("c_custkey") / 25).alias("video"), F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("id"))


def _groups(s, d):
    o = observations(s, d)
    pick = lambda c: o.where(c).groupBy("video", "id").agg(F.max("t_us").alias("last_us"))
    return [pick("role = 'GOALKEEPER'"), pick("state = 'confirmed' and clipped"), pick("state = 'uncertain'")]


def _points(s, d):
    return observations(s, d).select("id", "ord", "t_us", (F.col("kind") == "view").alias("experimental"))


def _edit(s, d):
    """The latest purchase of each identity is taken as an edited point."""
    o = observations(s, d).where("kind = 'purchase'")
    return o.groupBy("id").agg(F.max(F.struct("t_us", "ord")).alias("m")).select("id", F.col("m.ord").alias("ord"), F.col("m.t_us").alias("t_us"))


QUERIES = {
    "corrections_replay": lambda s, d: co.corrected(_people(s, d), _log(s, d)).groupBy("video", "id", "team", "role", "state", "excluded_id", "correction").agg(F.count(F.lit(1)).alias("n")),
    "corrections_applied": lambda s, d: co.applied(_people(s, d), _log(s, d)),
    "corrected_roster": lambda s, d: co.roster(_people(s, d), _log(s, d)),
    "recount": lambda s, d: co.recount(_people(s, d), _log(s, d)),
    "corrections_undone": lambda s, d: co.corrected(_people(s, d), _log(s, d).where("seq < 0")).select("video", "ord", "id", "team", "role", "state"),
    "registry_status": lambda s, d: co.registry_status(_registry(s, d), _log(s, d)),
    "id_counters": lambda s, d: co.id_counters(_registry(s, d), _log(s, d)),
    "event_insertion": lambda s, d: co.inserted(observations(s, d).where("kind = 'signup'").select("video", "t_us", F.col("ord").alias("seq")), _log(s, d)),
    "first_entry": lambda s, d: co.first_entry(_groups(s, d)),
    "remembered_ids": lambda s, d: co.with_remembered(_registry(s, d), _remembered(s, d)),
    "corrected_points": lambda s, d: co.corrected_points(_points(s, d), _edit(s, d)),
    "carried_over": lambda s, d: co.carried_over(_points(s, d).where("ord % 2 = 0"), _points(s, d).where("ord % 2 = 1"), 20_000_000, 40_000_000),
}

_LOG = """log as (
  select seq, u // 25 as video, kind, case when not by_track then concat('U', u) end as target_id, case when by_track then u * 10 + seq % 6 end as target_track,
    concat(case when seq % 2 = 0 then 'A' else 'B' end, u // 25) as team,
    case when into_ then concat('U', u // 25 * 25 + (u + 7) % 25) when kind not in ('excluded', 'left') then concat('N', seq) end as new_id, into_, seq * 7919 % 65000000 as t_us
  from (select *, kind = 'player' and seq % 3 <> 0 and not by_track as into_ from (
    select o_orderkey as seq, o_custkey as u, ['player', 'goalkeeper', 'excluded', 'left', 'referee'][o_orderkey // 16 % 5 + 1] as kind, o_orderkey % 7 = 0 and o_orderkey // 16 % 5 <> 3 as by_track
    from orders where o_orderkey % 16 < 2))
)"""
_PEOPLE = f"{OBS_SQL}, {_LOG}, people as (select video, frame_idx, ord, t_us, case when state = 'confirmed' then id end as id, track, team, role, state from obs)"
_WALK = f"""with recursive {_PEOPLE}, turns as (select *, row_number() over (partition by video order by seq) as k from log where kind <> 'left'
), keys as (select video, id, track, team, role, state, count(*) as n, min(t_us) as first_us, max(t_us) as last_us from people group by all
), base as (select row_number() over () as key, * from keys
), walk(key, video, track, k, id, team, role, state, excluded_id, correction, mine) as (
  select key, video, track, 0::bigint, id, team, role, state, null::varchar, null::bigint, false from base
  union all
  select w.key, w.video, w.track, c.k, case when hit then c.new_id else w.id end, case when hit then case when c.kind not in ('excluded', 'referee') then c.team end else w.team end,
    case when hit then case when c.kind = 'excluded' then 'UNKNOWN' else upper(c.kind) end else w.role end, case when hit and c.kind = 'excluded' then 'rejected' else w.state end,
    case when hit and c.kind = 'excluded' then c.target_id else w.excluded_id end, case when hit then c.seq else w.correction end, own
  from (select w.*, c.k as ck, coalesce(case when c.target_id is not null then w.id = c.target_id else w.id is null and w.track = c.target_track end, false) as own,
      coalesce(case when c.target_id is not null then w.id = c.target_id else w.id is null and w.track = c.target_track end, false)
      or coalesce(c.into_ and w.id = c.new_id, false) as hit
    from walk w join turns c on c.video = w.video and c.k = w.k + 1) w join turns c on c.video = w.video and c.k = w.ck
), last as (select key, arg_max(id, k) as id from (select key, k, coalesce(id, '') as id from walk) group by key
), final as (select w.* from walk w join (select key, max(k) as k from walk group by 1) m on m.key = w.key and m.k = w.k
), hits as (select c.seq, sum(b.n)::bigint as hits from walk w join turns c on c.video = w.video and c.k = w.k join base b on b.key = w.key where w.mine group by 1
), listing as (select l.seq, l.video, l.kind, l.target_id, l.new_id, coalesce(h.hits, 0) as hits, case when l.kind = 'left' then exists (select 1 from people p where p.video = l.video and p.id = l.target_id) else h.hits is not null end as applied from log l left join hits h on h.seq = l.seq
), rost as (select f.video, f.id, arg_max(f.team, (b.last_us, f.team)) as team, arg_max(f.role, (b.last_us, f.role)) as role, sum(b.n)::bigint as observations, min(b.first_us) as first_us, max(b.last_us) as last_us, max(f.correction) as correction from final f join base b on b.key = f.key where f.id is not null group by 1, 2)
"""

ORACLE_SQL = {
    "corrections_replay": f"{_WALK} select f.video, f.id, f.team, f.role, f.state, f.excluded_id, f.correction, sum(b.n)::bigint as n from final f join base b on b.key = f.key group by all",
    "corrections_applied": f"{_WALK} select * from listing",
    "corrected_roster": f"{_WALK} select * from rost",
    "recount": f"""{_WALK} select video, count(*) filter (role = 'PLAYER' and team[1] = 'A') as team_a, count(*) filter (role = 'PLAYER' and team[1] = 'B') as team_b, count(*) filter (role = 'GOALKEEPER') as goalkeepers, count(*) filter (role = 'REFEREE') as referees,
  first(id order by coalesce(correction, -1) desc, id) filter (role = 'GOALKEEPER' and team[1] = 'A') as slot_a, first(id order by coalesce(correction, -1) desc, id) filter (role = 'GOALKEEPER' and team[1] = 'B') as slot_b,
  coalesce(any_value(a.applied), 0) as applied, coalesce(any_value(a.excluded), 0) as excluded, coalesce(any_value(a.merged), 0) as merged
from rost left join (select video, count(*) as applied, count(*) filter (kind = 'excluded') as excluded, count(*) filter (kind not in ('excluded', 'left') and target_id is not null) as merged from listing where applied group by 1) a using (video) group by video""",
    "corrections_undone": f"with {_PEOPLE} select video, ord, id, team, role, state from people",
    "registry_status": f"""with {_PEOPLE}, word as (select video, target_id as id, seq, case kind when 'excluded' then 'unknown' when 'left' then 'substituted' else 'retired' end as to_ from log where target_id is not null union all select video, new_id, seq, null from log where into_ and target_id is not null
), g as (select video, id, last(to_ order by seq, to_ nulls first) as latest, last(to_ order by seq) filter (to_ is not null) as word, count(*) as n from word group by 1, 2)
select r.video, r.id, case when n is null then 'here' when latest is not null then latest when word in ('retired', 'unknown') then 'missing' else coalesce(word, 'here') end as status from (select distinct video, id from obs) r left join g using (video, id)""",
    "id_counters": f"with {_PEOPLE}, ids as (select distinct video, id from obs union all select video, new_id from log where new_id is not null) select video, regexp_extract(id, '^([A-Z]+)-?(\\d+)$', 1) as prefix, max(regexp_extract(id, '^([A-Z]+)-?(\\d+)$', 2)::bigint) as counter from ids group by 1, 2",
    "event_insertion": f"with {_PEOPLE}, both_ as (select video, t_us, ord as seq, 0 as is_new from obs where kind = 'signup' union all select video, t_us, seq, 1 from log) select *, row_number() over (partition by video order by t_us, is_new, seq) as place from both_",
    "first_entry": f"with {OBS_SQL}, e as (select video, id, max(t_us) as last_us, 0 as grp from obs where role = 'GOALKEEPER' group by 1, 2 union all select video, id, max(t_us), 1 from obs where state = 'confirmed' and clipped group by 1, 2 union all select video, id, max(t_us), 2 from obs where state = 'uncertain' group by 1, 2) select video, id, last_us, grp from e qualify row_number() over (partition by video, id order by grp) = 1",
    "remembered_ids": f"with {OBS_SQL}, r as (select distinct video, id from obs) select video, id, true as seen from r union all select c_custkey // 25, concat('U', c_custkey), false from customer where c_custkey % 4 = 0 and concat('U', c_custkey) not in (select id from r)",
    "corrected_points": f"with {OBS_SQL}, e as (select id, max(t_us) as at_us, arg_max(ord, (t_us, ord)) as ord from obs where kind = 'purchase' group by 1) select o.id, o.ord, o.t_us, o.kind = 'view' as experimental from obs o left join e on e.id = o.id where not coalesce(case when o.kind = 'view' then o.t_us >= at_us - 125000 else abs(o.t_us - at_us) <= 125000 end, false) union all select id, ord, at_us, false from e",
    "carried_over": f"with {OBS_SQL}, p as (select id, ord, t_us, kind = 'view' as experimental from obs) select id, ord, t_us, 0 as source from p where ord % 2 = 0 and (not experimental or t_us not between 20000000 and 40000000) union all select id, ord, t_us, 1 from p r where ord % 2 = 1 and not exists (select 1 from p q where q.ord % 2 = 0 and not q.experimental and q.id = r.id and abs(q.t_us - r.t_us) < 50000)",
}
