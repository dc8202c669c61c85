"""Replay of a log of corrections over people, registry and events.

A person row is corrected by what its (video, id, track) says alone, so the log of a video is
folded once per such key and joined back to the rows; the rows of a video are never walked.
The base is never changed: an empty log gives it back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("video", "id", "track")


def _folded(keys: DataFrame, log: DataFrame) -> DataFrame:
    """``keys`` (video, id, track, team, role, state) with ``now``: what the log of the video makes of each.

    The log (seq, video, kind, target_id, target_track, team, new_id, into, t_us) of a video is
    what people have typed; its entries are folded in order of seq.
    """
    entry = F.struct("seq", "kind", "target_id", "target_track", F.col("team").alias("to_team"), "new_id", "into")
    logs = log.where("kind <> 'left'").groupBy("video").agg(F.array_sort(F.collect_list(entry)).alias("log"))
    start = F.struct(
        "id", "team", "role", "state", F.lit(None).cast("string").alias("excluded_id"), F.lit(None).cast("long").alias("correction"), F.array().cast("array<bigint>").alias("hits")
    )

    def step(a: Column, c: Column) -> Column:
        mine = F.when(c["target_id"].isNotNull(), a["id"].eqNullSafe(c["target_id"])).otherwise(a["id"].isNull() & F.col("track").eqNullSafe(c["target_track"]))
        joined = c["into"] & ~mine & a["id"].eqNullSafe(c["new_id"])
        out = c["kind"] == "excluded"
        new = F.struct(
            F.when(~out, c["new_id"]).alias("id"),
            F.when(~out & (c["kind"] != "referee"), c["to_team"]).alias("team"),
            F.when(out, "UNKNOWN").otherwise(F.upper(c["kind"])).alias("role"),
            F.when(out, "rejected").otherwise(a["state"]).alias("state"),
            F.when(out, c["target_id"]).otherwise(a["excluded_id"]).alias("excluded_id"),
            c["seq"].alias("correction"),
            F.when(mine, F.array_append(a["hits"], c["seq"])).otherwise(a["hits"]).alias("hits"),
        )
        return F.when(mine | joined, new).otherwise(a)

    k = keys.join(logs, "video", "left")
    return k.withColumn("now", F.aggregate(F.coalesce("log", F.array().cast(logs.schema["log"].dataType)), start, step)).drop("log")


def person_keys(people: DataFrame) -> DataFrame:
    """One row per (video, id, track) and what is said of it, with its rows and times."""
    return people.groupBy(*KEY, "team", "role", "state").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


def corrected(people: DataFrame, log: DataFrame) -> DataFrame:
    """``people`` with id, team, role and state as corrected, and the last correction that touched each row."""
    says = ["team", "role", "state"]
    now = _folded(people.select(*KEY, *says).distinct(), log).select(*(F.col(c).alias(f"k_{c}") for c in (*KEY, *says)), "now")
    same = [people[c].eqNullSafe(now[f"k_{c}"]) for c in (*KEY, *says)]
    rest = [c for c in people.columns if c not in ("id", *says)]
    j = people.join(now, [people["video"] == now["k_video"], *same[1:]])
    return j.select(*rest, "now.id", "now.team", "now.role", "now.state", "now.excluded_id", "now.correction")


def applied(people: DataFrame, log: DataFrame) -> DataFrame:
    """Every entry of the log, newest first by seq, with the rows it relabelled and whether it was applied.

    'left' is applied where the identity is seen at all; it closes a slot and touches no row.
    """
    f = _folded(person_keys(people), log)
    hits = f.select("n", F.explode("now.hits").alias("seq")).groupBy("seq").agg(F.sum("n").alias("hits"))
    seen = people.where("id is not null").select("video", F.col("id").alias("target_id")).distinct().withColumn("seen", F.lit(True))
    x = log.join(hits, "seq", "left").join(seen, ["video", "target_id"], "left")
    ok = F.when(F.col("kind") == "left", F.coalesce("seen", F.lit(False))).otherwise(F.col("hits").isNotNull())
    return x.select("seq", "video", "kind", "target_id", "new_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), ok.alias("applied"))


def roster(people: DataFrame, log: DataFrame) -> DataFrame:
    """Identities after the corrections: team, role, observations, first and last time, manual."""
    now = _folded(person_keys(people), log).select("video", "now.id", "now.team", "now.role", "now.correction", "n", "first_us", "last_us").where("id is not null")
    return now.groupBy("video", "id").agg(
        F.max_by("team", F.struct("last_us", "team")).alias("team"),
        F.max_by("role", F.struct("last_us", "role")).alias("role"),
        F.sum("n").alias("observations"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.max("correction").alias("correction"),
    )


def recount(people: DataFrame, log: DataFrame) -> DataFrame:
    """Counts of each video after the corrections, and the goalkeeper slots of its teams: the keeper
    corrected last holds the slot, else the first by id."""
    r = roster(people, log).withColumn("side", F.substring("team", 1, 1))
    role = lambda x: F.col("role") == x
    n = lambda c: F.count(F.when(c, 1))
    slot = lambda s: F.max_by("id", F.when(role("GOALKEEPER") & (F.col("side") == s), F.struct(F.coalesce("correction", F.lit(-1).cast("long")), F.col("turn")))).alias(f"slot_{s.lower()}")
    r = r.withColumn("turn", -F.row_number().over(Window.partitionBy("video").orderBy("id")))
    people_of = r.groupBy("video").agg(
        n(role("PLAYER") & (F.col("side") == "A")).alias("team_a"), n(role("PLAYER") & (F.col("side") == "B")).alias("team_b"), n(role("GOALKEEPER")).alias("goalkeepers"), n(role("REFEREE")).alias("referees"), slot("A"), slot("B")
    )
    a = applied(people, log).where("applied").groupBy("video").agg(
        F.count(F.lit(1)).alias("applied"), n((F.col("kind") == "excluded")).alias("excluded"), n(~F.col("kind").isin("excluded", "left") & F.col("target_id").isNotNull()).alias("merged")
    )
    zero = ["applied", "excluded", "merged"]
    return people_of.join(a, "video", "left").na.fill(0, zero)


def registry_status(registry: DataFrame, log: DataFrame) -> DataFrame:
    """Status of each saved identity (video, id, status) after the log.

    A corrected identity is retired into its new one, unknown when excluded, substituted when
    it left; one that another is merged into is only missing again if it was given up before.
    """
    own = log.where("target_id is not null").select("video", F.col("target_id").alias("id"), "seq", F.when(F.col("kind") == "excluded", "unknown").when(F.col("kind") == "left", "substituted").otherwise("retired").alias("to"))
    into = log.where("into and target_id is not null").select("video", F.col("new_id").alias("id"), "seq", F.lit(None).cast("string").alias("to"))
    g = own.unionByName(into).groupBy("video", "id").agg(F.max(F.struct("seq", "to")).alias("last"), F.max(F.when(F.col("to").isNotNull(), F.struct("seq", "to"))).alias("word"))
    j = registry.join(g, ["video", "id"], "left")
    back = F.when(F.col("word.to").isin("retired", "unknown"), "missing").otherwise(F.coalesce("word.to", "status"))
    status = F.when(F.col("last").isNull(), F.col("status")).when(F.col("last.to").isNotNull(), F.col("last.to")).otherwise(back)
    return j.select("video", "id", status.alias("status"))


def id_counters(registry: DataFrame, log: DataFrame) -> DataFrame:
    """The largest number used under each prefix, in the registry and by new ids of the log."""
    ids = registry.select("video", "id").unionByName(log.where("new_id is not null").select("video", F.col("new_id").alias("id")))
    parts = ids.select("video", F.regexp_extract("id", r"^([A-Z]+)-?(\d+)$", 1).alias("prefix"), F.regexp_extract("id", r"^([A-Z]+)-?(\d+)$", 2).cast("long").alias("number"))
    return parts.where("prefix <> ''").groupBy("video", "prefix").agg(F.max("number").alias("counter"))


def inserted(events: DataFrame, new: DataFrame) -> DataFrame:
    """Events of a video in order, each new one after all that are not later than it."""
    both = events.select("video", "t_us", "seq", F.lit(0).alias("is_new")).unionByName(new.select("video", "t_us", "seq", F.lit(1).alias("is_new")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("video").orderBy("t_us", "is_new", "seq")))


def first_entry(groups: list[DataFrame]) -> DataFrame:
    """Of each (video, id) the entry of the first group, in the order given, that has it."""
    both = None
    for k, g in enumerate(groups):
        g = g.withColumn("grp", F.lit(k))
        both = g if both is None else both.unionByName(g)
    turn = F.row_number().over(Window.partitionBy("video", "id").orderBy("grp", "last_us"))
    return both.withColumn("turn", turn).where("turn = 1").drop("turn")


def with_remembered(roster: DataFrame, remembered: DataFrame) -> DataFrame:
    """The identities of a video and those remembered from before that it lacks."""
    return roster.select("video", "id", F.lit(True).alias("seen")).unionByName(remembered.join(roster, ["video", "id"], "left_anti").select("video", "id", F.lit(False).alias("seen")))


def corrected_points(points: DataFrame, edit: DataFrame, slack_us: int = 125_000) -> DataFrame:
    """Points after one edited point per player: later tracked points go, set ones within the slack go, the edit comes.

    ``edit`` has ord, id and t_us, one row per id; ``points`` also experimental.
    """
    e = edit.select("id", F.col("t_us").alias("at_us"))
    gone = F.when(F.col("experimental"), F.col("t_us") >= F.col("at_us") - slack_us).otherwise(F.abs(F.col("t_us") - F.col("at_us")) <= slack_us)
    stays = points.join(e, "id", "left").where(~F.coalesce(gone, F.lit(False))).drop("at_us")
    return stays.select("id", "ord", "t_us", "experimental").unionByName(edit.select("id", "ord", "t_us", F.lit(False).alias("experimental")))


def carried_over(old: DataFrame, result: DataFrame, start: int, end: int, slack_us: int = 50_000) -> DataFrame:
    """Old points that are confirmed or outside the processed time, and result points that no confirmed one is near.

    Times are put in buckets of the slack, so that nearness is an equi-join.
    """
    sure = old.where("not experimental")
    stays = old.where(~F.col("experimental") | ~F.col("t_us").between(start, end)).select("id", "ord", "t_us", F.lit(0).alias("source"))
    near = sure.select("id", F.col("t_us").alias("q_us"), F.floor(F.col("t_us") / slack_us).alias("b"))
    r = result.select("id", "ord", "t_us").withColumn("b", F.explode(F.expr(f"transform(array(-1, 0, 1), k -> floor(t_us / {slack_us}) + k)")))
    hit = r.join(near, ["id", "b"]).where(F.abs(F.col("t_us") - F.col("q_us")) < slack_us).select("id", "ord").distinct()
    return stays.unionByName(result.join(hit, ["id", "ord"], "left_anti").select("id", "ord", "t_us", F.lit(1).alias("source")))
