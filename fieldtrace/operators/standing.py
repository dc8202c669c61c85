"""Decisions that ticks in a row bring about and undo, mostly as windows over sorted keys.

A tick is a row with its key, ``t_us`` and ``ord``.  What a state machine would carry is a
run of good ticks (`with_streak`) or the last event that changed the state, so each rule is
one shuffle by the key; a null condition counts as false, a null key is a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Evidence ticks without doubt that end "not a target".
CLEAR_TICKS = 10
#: Fixed values of recognition by appearance: least likeness, least lead, and likeness that lets go.
MATCH, LEAD, LOST = 0.7, 0.15, 0.45
#: Fixed values of votes: total and share that settle a team, and those that overturn it.
SETTLED, OVERTURNED = (4.0, 0.85), (20.0, 0.97)
#: Fixed values of recovery: microseconds and thousandths of the picture between sightings in a row.
HIT_US, HIT_STEP = 350_000, 40
#: Fixed values of the size gate.
LEAST_SCORE, LEAST_SIZE, MOST_SIZE, LYING, SMALL_PX, LEAST_SMALL = 0.1, 0.4, 2.2, 0.6, 36, 0.28
#: Fixed values of officials: ticks looked at, metres from the edge, metres from the ball, shares of weight.
RECORDS, CORRIDOR, FOLLOWING, PLAYING = 50, (-1.0, 4.0), 25.0, 1.5


def _ticks(key: str) -> Window:
    return Window.partitionBy(key).orderBy("t_us", "ord")


def with_streak(rows: DataFrame, good: Column, key: str, name: str, fresh: Column | None = None) -> DataFrame:
    """``rows`` with the length of the run of good ticks that ends at each, 0 at others.

    A run also begins anew where ``fresh`` holds, which may look at the tick before.
    """
    w, n = _ticks(key), F.col("_n")
    anew = F.lit(False) if fresh is None else F.coalesce(fresh, F.lit(False))
    r = rows.withColumns({"_n": F.row_number().over(w), "_good": F.coalesce(good, F.lit(False)), "_fresh": anew})
    start = F.max(F.when(~F.col("_good"), n + 1).when(F.col("_fresh"), n)).over(w)
    r = r.withColumn("_start", start).withColumn(name, F.when(F.col("_good"), n - F.coalesce("_start", F.lit(1)) + 1).otherwise(0).cast("long"))
    return r.drop("_n", "_good", "_fresh", "_start")


def non_targets(ticks: DataFrame, need: int = CLEAR_TICKS) -> DataFrame:
    """Who is ignored: ``marks`` makes a track one, ``need`` ticks in a row that are ``clear`` make it a candidate again.

    Adds ``ignored`` and ``streak``, the clear ticks so far of one that is ignored.
    """
    marks = F.coalesce("marks", F.lit(False))
    r = with_streak(ticks, F.col("clear") & ~marks, "track", "_run")
    last = F.last(F.when(marks, True).when(F.col("_run") >= need, False), ignorenulls=True).over(_ticks("track"))
    r = r.withColumn("ignored", F.coalesce(last, F.lit(False)))
    return r.withColumn("streak", F.when(F.col("ignored"), F.col("_run")).otherwise(0)).drop("_run")


def recognised(checks: DataFrame) -> DataFrame:
    """Checks of a track against people named by hand: ``person``, ``score``, ``rival`` (null: none), ``held``.

    A hit is like the person and clearly less like any other; ``hits`` counts hits in a row for
    one person, and two of them, or three if the track is held by an identity, decide.
    """
    hit = (F.col("score") >= MATCH) & (F.col("score") >= F.coalesce("rival", F.lit(0.0)) + LEAD)
    other = ~F.lag("person").over(_ticks("track")).eqNullSafe(F.col("person"))
    r = with_streak(checks, hit & F.col("person").isNotNull(), "track", "hits", other)
    return r.withColumn("decided", F.col("hits") >= F.when(F.col("held"), 3).otherwise(2))


def released(checks: DataFrame) -> DataFrame:
    """``doubts`` in a row about the one a track carries; every third lets go, and doubting begins anew."""
    r = with_streak(checks, F.col("score") < LOST, "track", "_run")
    return r.withColumn("released", (F.col("_run") > 0) & (F.col("_run") % 3 == 0)).withColumn("doubts", F.col("_run") % 3).drop("_run")


def outside_strikes(frames: DataFrame, least: float = 0.5, strikes: int = 3) -> DataFrame:
    """Frames of a key in which most people stand off the predicted pitch.

    ``people`` and ``inside`` are counts; frames of fewer than four say nothing and are left
    out.  ``anchored`` begins anew.  ``doubt`` is set from the third strike in a row.
    """
    known = frames.where("people >= 4")
    bad = F.col("inside") / F.col("people") < least
    r = with_streak(known, bad, "key", "strikes", F.col("anchored"))
    return r.withColumn("doubt", F.col("strikes") >= strikes)


def team_by_votes(votes: DataFrame) -> DataFrame:
    """Team of each track after each tick of votes ``a`` and ``b`` (hundredths, null: none).

    It is settled by the first clear majority and overturned only by a much clearer one;
    ``confidence`` is the share at the last tick with a clear majority.
    """
    w = _ticks("track")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(w)
    r = votes.withColumns({"_a": total("a"), "_b": total("b")})
    mass, most = F.col("_a") + F.col("_b"), F.greatest("_a", "_b")
    beyond = lambda at, strict: ((mass > at[0] * 100) if strict else (mass >= at[0] * 100)) & (most > mass * F.lit(at[1]))
    leader = F.when(F.col("_a") >= F.col("_b"), "A").otherwise("B")
    r = r.withColumns({"_settles": F.when(beyond(SETTLED, False), leader), "_overturns": F.when(beyond(OVERTURNED, True), leader), "_share": F.when(beyond(SETTLED, False), most / mass)})
    team = F.coalesce(F.last("_overturns", ignorenulls=True).over(w), F.first("_settles", ignorenulls=True).over(w))
    return r.withColumns({"decided": team, "confidence": F.last("_share", ignorenulls=True).over(w)}).drop("_a", "_b", "_settles", "_overturns", "_share")


def recovery_candidates(options: DataFrame) -> DataFrame:
    """Best detection of each missing person at a time, if it is its own and has a lead of 0.08.

    ``options``: t_us, person, detection, distance, appearance, ratio (of areas), same_edge,
    distinctive, supported (ten team mates seen, one missing), long (away over 12 s or place unknown).
    """
    long, d, a, ratio = (F.col(c) for c in ("long", "distance", "appearance", "ratio"))
    near = F.when(long, F.col("distinctive")).otherwise((d < 0.08) | (F.col("same_edge") & (d < 0.25)))
    sized = F.when(long, (ratio > 0.2) & (ratio < 5)).otherwise((ratio > 0.45) & (ratio < 2.2))
    alike = a < F.when(long, 0.12).when(F.col("supported"), 0.25).otherwise(0.18)
    cost = F.when(long, a).otherwise(a * 0.7 + F.least(F.lit(1.0), d / 0.15) * 0.3)
    r = options.where(near & sized & alike).withColumn("cost", cost)
    w = Window.partitionBy("t_us", "person").orderBy("cost", "detection")
    best = r.withColumns({"turn": F.row_number().over(w), "next_cost": F.lead("cost").over(w)}).where("turn = 1")
    rivals = F.count(F.lit(1)).over(Window.partitionBy("t_us", "detection"))
    return best.withColumn("rivals", rivals).where((F.col("rivals") == 1) & (F.col("next_cost").isNull() | (F.col("next_cost") - F.col("cost") >= 0.08))).drop("turn", "next_cost", "rivals")


def recovered(sightings: DataFrame) -> DataFrame:
    """``hits``: sightings in a row of one missing person, near in time and place; three bring it back, five after long.

    ``found`` says that there is a candidate at this tick, at ``x_m``, ``y_m``; ``cut`` begins anew.
    """
    w = _ticks("person")
    dx, dy = F.col("x_m") - F.lag("x_m").over(w), F.col("y_m") - F.lag("y_m").over(w)
    near = (F.col("t_us") - F.lag("t_us").over(w) <= HIT_US) & (dx * dx + dy * dy < HIT_STEP * HIT_STEP)
    r = with_streak(sightings, F.col("found") & ~F.coalesce("cut", F.lit(False)), "person", "hits", ~F.coalesce(near, F.lit(False)))
    return r.withColumn("restored", F.col("hits") >= F.when(F.col("long"), 5).otherwise(3))


def size_gate(people: DataFrame, picture_px: int = 1080) -> DataFrame:
    """accepted, continuation or rejected, and why.

    ``height``, ``long_axis`` and ``expected`` are shares of the picture's height (expected null:
    no model); ``zone``, ``audience``, ``official``, ``tracked`` and ``score`` are known.  Someone
    lying is measured along the body; small people get a wider gate, and stay if they were tracked.
    """
    h, e = F.col("height"), F.when(F.col("expected") > 0.004, F.col("expected"))
    ratio = F.when((h / e < LEAST_SIZE) & (F.col("long_axis") / e >= LYING), F.col("long_axis") / e).otherwise(h / e)
    r = people.withColumn("ratio", ratio)
    low = F.when(F.col("expected") * picture_px < SMALL_PX, LEAST_SMALL).otherwise(LEAST_SIZE)
    outside = (F.col("zone") == "outside") & ~(F.col("official") & ~F.col("audience"))
    odd = F.col("ratio").isNotNull() & ~F.col("ratio").between(low, F.lit(MOST_SIZE)) & ~(F.col("tracked") & (h * picture_px < SMALL_PX))
    reason = F.when(outside & F.col("audience"), "audience").when(outside, "outside-pitch").when(odd, "implausible-size").when(F.col("score") < LEAST_SCORE, "low-confidence")
    r = r.withColumn("reason", reason)
    return r.withColumn("verdict", F.when(F.col("reason").isNull(), "accepted").when(F.col("reason") == "outside-pitch", "continuation").otherwise("rejected"))


def _latest(records: DataFrame) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("t_us"), F.desc("ord")))
    return records.withColumn("turn", turn).where(F.col("turn") <= RECORDS)


def touchline(records: DataFrame) -> DataFrame:
    """How much each id moves like an official at the line, over its last 50 records.

    ``side`` and ``metres`` beyond the nearest edge (null: unknown), ``along`` and ``speed`` in
    metres a second, ``boundary``: stands in the zone of the line.  Without any edge the share
    of ``boundary`` stands in.  Of sides seen equally often the one seen first counts.
    """
    r = _latest(records)
    inside = F.col("side").isNotNull() & F.col("metres").between(*CORRIDOR)
    moves = inside & (F.col("speed") >= 0.3)
    one = r.groupBy("id", F.when(inside, F.col("side")).alias("side")).agg(
        F.count(F.lit(1)).alias("n"), F.count("side").alias("edges"), F.count(F.when(F.col("boundary"), 1)).alias("at_line"), F.count(F.when(inside, 1)).alias("here"), F.max(F.when(inside, F.col("turn"))).alias("since"),
        F.sum(F.when(moves, F.col("along"))).alias("along"), F.sum(F.when(moves, F.sqrt(F.greatest(F.lit(0.0), F.col("speed") * F.col("speed") - F.col("along") * F.col("along"))))).alias("across"),
    )
    best = F.max(F.when(F.col("here") > 0, F.struct("here", "since", "side")))
    g = one.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("n", "edges", "at_line", "along", "across")), F.sum("here").alias("in_corridor"), best.alias("best"))
    time, boundary = F.col("in_corridor") / F.col("n"), F.col("at_line") / F.col("n")
    parallel = F.when(F.col("along") + F.col("across") > 0, F.col("along") / (F.col("along") + F.col("across")))
    same = F.coalesce(F.col("best.here") / F.col("in_corridor"), F.lit(0.0))
    known = F.col("edges") > 0
    return g.select(
        "id", F.when(known, time * same * (0.4 + 0.6 * F.coalesce(parallel, F.lit(0.5)))).otherwise(0.7 * boundary).alias("score"), F.when(known, time).otherwise(boundary).alias("time"), F.when(known, parallel).alias("parallel"), F.when(known, F.col("best.side")).alias("side")
    )


def central(records: DataFrame) -> DataFrame:
    """How much each id follows play like a referee, over its last 50 records.

    ``ball_m``: metres from the ball, ``formation``: spread within the team's shape, ``moves``:
    agreement with the team's movement (null: unknown).  Ten of the first two and five of the
    last make a part; the score is their weighted mean over the parts there are, else null.
    """
    c = F.col
    known = lambda x, least: F.count(x) >= least
    share = lambda x, test: F.count(F.when(test, 1)) / F.count(x)
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    g = _latest(records).groupBy("id").agg(
        F.when(known("ball_m", 10), share("ball_m", c("ball_m") <= FOLLOWING) * (1 - clamp(share("ball_m", c("ball_m") <= PLAYING) / 0.1))).alias("ball"),
        F.when(known("formation", 10), share("formation", c("formation") <= 1.3)).alias("formation"), F.when(known("moves", 5), clamp(F.sum("moves") / F.count("moves"))).alias("moves"),
    )
    parts = [(1 - c("formation"), 0.5), (c("ball"), 0.3), (1 - c("moves"), 0.2)]
    top = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts), F.lit(0.0))
    return g.withColumn("score", F.try_divide(top, sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts), F.lit(0.0))))


def refinement_crops(people: DataFrame, width: int, height: int, most: int = 6) -> DataFrame:
    """Crops of dense groups of small people of each frame: frame_idx, rank, x, y, size in pixels.

    ``bx``, ``by``, ``bw``, ``bh`` are thousandths of the picture, ``score`` is in hundredths.
    The densest come first, then the smaller, then by place; a crop is left out that is near one taken.  The
    limit of six crops is the rule's; a frame holds what one picture shows.
    """
    size = min(256, width, height)
    p = people.where("score >= 18 and bh < 120").withColumns({"cx": (F.col("bx") + F.col("bw") / 2) * (width / 1000), "cy": (F.col("by") + F.col("bh") / 2) * (height / 1000)})
    o = p.select("frame_idx", F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    near = (F.col("cx") - F.col("ox")) ** 2 + (F.col("cy") - F.col("oy")) ** 2 < (size * 0.6) ** 2
    dense = p.join(o, "frame_idx").where(near).groupBy("frame_idx", "ord", "bx", "by", "bw", "bh").agg(F.count(F.lit(1)).alias("density")).where("density >= 2")
    at = lambda c, span: F.round(F.greatest(F.lit(0.0), F.least(F.lit(float(span - size)), c - size / 2))).cast("long")
    crop = F.struct((-F.col("density")).alias("density"), "bh", "ord", at((F.col("bx") + F.col("bw") / 2) * (width / 1000), width).alias("x"), at((F.col("by") + F.col("bh") * 0.75) * (height / 1000), height).alias("y"))
    ranked = dense.groupBy("frame_idx").agg(F.array_sort(F.collect_list(crop)).alias("ranked"))
    far = lambda a, b: (a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 >= (size * 0.65) ** 2
    none = F.expr("cast(array() as array<struct<x: bigint, y: bigint>>)")
    take = lambda done, c: F.when((F.size(done) < most) & F.forall(done, lambda t: far(c, t)), F.array_append(done, F.struct(c["x"].alias("x"), c["y"].alias("y")))).otherwise(done)
    taken = ranked.select("frame_idx", F.posexplode(F.aggregate("ranked", none, take)).alias("rank", "crop"))
    return taken.select("frame_idx", F.col("rank").cast("long"), "crop.x", "crop.y", F.lit(size).cast("long").alias("size"))


def sampling_grid(spans: DataFrame, keyframes: DataFrame, step_us: int = 100_000) -> DataFrame:
    """Times of each key: every tenth of a second from start to end, and its keyframes within, each once."""
    grid = spans.select("key", F.explode(F.sequence("start_us", "end_us", F.lit(step_us))).alias("t_us"))
    marks = keyframes.join(spans, "key").where("t_us between start_us and end_us").select("key", "t_us")
    return grid.unionByName(marks).distinct()


#: Fixed values of crossings: overlaps that begin, harden and end one, ticks apart that end it seen well or not, longest time.
TOUCH, HARD, APART, TICKS_CLEAN, TICKS_ANY, LONGEST_US = 0.15, 0.4, 0.05, 2, 6, 6_000_000
CROSSING = "pair string, start_us long, end_us long, hard boolean, clean boolean, outcome string"


def crossings(pairs: DataFrame) -> DataFrame:
    """Times at which two tracks met: pair, start_us, end_us, hard (one hid the other), clean, outcome.

    ``pairs``: pair, t_us, ord, overlap, close (centres), seen (both), clean (both), valid (both
    still hold the identities that they had).  A meeting begins with a touch and ends separated,
    two ticks apart if both are seen clean, six otherwise; after six seconds it ends unjudged, and
    one that is no longer valid or still open leaves no row.  When one begins depends on when the
    last ended, so the rows of a pair stream by in order of time with one state carried along.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, start, hard, apart = object(), None, False, 0
        for batch in batches:
            out = []
            for pair, t, overlap, close, seen, clean, valid in zip(*(batch[c].tolist() for c in ("pair", "t_us", "overlap", "close", "seen", "clean", "valid")), strict=True):
                if pair != own:
                    own, start = pair, None
                if start is not None:
                    if t - start > LONGEST_US:
                        out.append((pair, start, t, hard, bool(clean), "unjudged"))
                        start = None
                    elif not valid:
                        start = None
                    elif not seen:
                        hard, apart = True, 0
                    else:
                        hard = hard or overlap > HARD
                        apart = apart + 1 if overlap < APART and not close else 0
                        if apart >= TICKS_ANY or (apart >= TICKS_CLEAN and clean):
                            out.append((pair, start, t, hard, bool(clean), "separated"))
                            start = None
                if start is None and seen and valid and (overlap > TOUCH or close):
                    start, hard, apart = t, overlap > HARD, 0
            yield pd.DataFrame(out, columns=["pair", "start_us", "end_us", "hard", "clean", "outcome"])

    known = [F.coalesce("overlap", F.lit(0.0)).alias("overlap"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("close", "seen", "clean", "valid"))]
    r = pairs.select(F.coalesce("pair", F.lit("")).alias("pair"), "t_us", "ord", *known)
    return r.repartition("pair").sortWithinPartitions("pair", "t_us", "ord").mapInPandas(run, CROSSING)


def crossing_verdict(look: Column, path: Column, hard: Column) -> Column:
    """swap, doubt or keep: appearance must favour a swap, paths alone never swap.

    ``look`` (null: not seen clean) and ``path`` in metres are positive where they favour keeping.
    """
    against = F.coalesce(look <= -0.2, F.lit(False))
    similar = F.coalesce(F.abs(look) < 0.2, F.lit(True))
    swap = F.coalesce(look <= -0.5, F.lit(False)) | (against & (path < 4))
    return F.when(swap, "swap").when((similar & (hard | (path < 2))) | against, "doubt").otherwise("keep")


def look_alikes(scores: DataFrame, together: DataFrame, scope: str, least: float = 0.93, most: int = 3) -> DataFrame:
    """Pairs of one team that look alike and were never in one frame: the ``most`` likeliest of each scope.

    ``scores``: scope, a, b (a < b), cos; ``together``: a, b.
    """
    apart = scores.where(F.col("cos") >= least).join(together.select("a", "b").distinct(), ["a", "b"], "left_anti")
    turn = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("cos"), F.desc("a"), F.desc("b")))
    return apart.withColumn("turn", turn).where(F.col("turn") <= most).select(scope, "a", "b", "cos")


def special_role(people: DataFrame, examples: DataFrame) -> DataFrame:
    """Role of each person by the kits of confirmed officials and keepers: video, key, role, cost.

    ``people``: video, key, kit; ``examples``: video, role, kit, the few of a match confirmed by hand.
    A kit is three histograms of 50 numbers, compared by one less their overlap and weighed .55,
    .3 and .15.  The nearest counts below .15, if no other role is within .08; else the role is
    null, as it is without examples or with a kit of another length.
    """
    part = lambda k: F.lit(1.0) - F.aggregate(F.zip_with(F.slice("kit", 1 + 50 * k, 50), F.slice("other", 1 + 50 * k, 50), lambda a, b: F.sqrt(a * b)), F.lit(0.0), lambda s, x: s + x)
    e = examples.where("size(kit) = 150").select("video", "role", F.col("kit").alias("other"))
    p = people.select("video", "key", F.when(F.size("kit") == 150, F.col("kit")).alias("kit")).join(e, "video", "left")
    c = p.withColumn("cost", part(0) * 0.55 + part(1) * 0.3 + part(2) * 0.15)
    w = Window.partitionBy("video", "key").orderBy(F.col("cost").asc_nulls_last(), "role")
    best = c.withColumns({"turn": F.row_number().over(w), "next_role": F.lead("role").over(w), "next_cost": F.lead("cost").over(w)}).where("turn = 1")
    sure = (F.col("cost") < 0.15) & (F.col("next_role").isNull() | (F.col("next_role") == F.col("role")) | (F.col("next_cost") - F.col("cost") > 0.08))
    return best.select("video", "key", F.when(sure, F.col("role")).alias("role"), "cost")
