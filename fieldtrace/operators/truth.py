"""Evaluation of tracked people against annotated frames: one-to-one matches in space, then switches, gaps and returns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import assignment

#: Microseconds around a frame in which an observation counts, and the cost (1 - IoU) of no match.
NEAR_US, UNMATCHED = 105_000, 0.7
MATCH = "run long, t_us long, ord long, truth_id string, truth_role string, local_id long, seen_us long, global_id string, role string, confidence double, uncertain boolean"


def tactical() -> Column:
    """Whether a prediction says that this is a player of the match."""
    return F.coalesce(F.col("global_id").isNotNull() & ~F.coalesce("uncertain", F.lit(False)) & (F.col("role").startswith("PLAYER_") | F.col("role").startswith("GOALKEEPER")), F.lit(False))


def candidates(truth: DataFrame, found: DataFrame, near_us: int = NEAR_US) -> DataFrame:
    """For each annotated time the nearest observation of each local track, the later row of two that are as near.

    Times meet in buckets of ``near_us`` and the two beside them: an equi-join.
    """
    times = truth.select("run", F.col("t_us").alias("at_us")).distinct()
    times = times.withColumn("bucket", F.explode(F.expr(f"transform(array(-1, 0, 1), k -> floor(at_us / {near_us}) + k)")))
    j = found.withColumn("bucket", F.floor(F.col("t_us") / near_us)).join(times, ["run", "bucket"]).where(F.abs(F.col("t_us") - F.col("at_us")) <= near_us)
    turn = F.row_number().over(Window.partitionBy("run", "at_us", "local_id").orderBy(F.abs(F.col("t_us") - F.col("at_us")), F.desc("ord")))
    return j.withColumn("turn", turn).where("turn = 1").drop("turn", "bucket")


def matched(truth: DataFrame, found: DataFrame, near_us: int = NEAR_US) -> DataFrame:
    """Every visible annotated person with the observation that is theirs, if any, and every observation that is nobody's.

    ``truth`` has (run, t_us, ord, truth_id, truth_role, bx, by, bw, bh, visible), ``found`` (run, t_us, ord, local_id,
    global_id, role, confidence, uncertain, bx, by, bw, bh).  Matches are the cheapest one-to-one assignment by 1 - IoU, none
    at UNMATCHED or more.  A time is a row of two arrays, solved on its own.
    """
    box = ["bx", "by", "bw", "bh"]
    people = truth.where(F.coalesce("visible", F.lit(True))).groupBy("run", "t_us").agg(F.sort_array(F.collect_list(F.struct("ord", "truth_id", "truth_role", *box))).alias("people"))
    seen = candidates(truth, found, near_us).groupBy("run", F.col("at_us").alias("t_us")).agg(F.sort_array(F.collect_list(F.struct("local_id", F.col("t_us").alias("seen_us"), "global_id", "role", "confidence", "uncertain", *box))).alias("seen"))
    times = truth.select("run", "t_us").distinct().join(people, ["run", "t_us"], "left").join(seen, ["run", "t_us"], "left")
    names = [c.split()[0] for c in MATCH.split(", ")]

    def boxes(rows: list) -> np.ndarray:
        return np.array([[r[c] for c in box] for r in rows], float).reshape(-1, 4)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for run, t_us, people, seen in zip(b["run"], b["t_us"], b["people"], b["seen"], strict=True):
                p, q = ([] if v is None or isinstance(v, float) else list(v) for v in (people, seen))
                x, y = boxes(p), boxes(q)
                lo, hi = np.maximum(x[:, None, :2], y[None, :, :2]), np.minimum(x[:, None, :2] + x[:, None, 2:], y[None, :, :2] + y[None, :, 2:])
                both = np.maximum(hi - lo, 0).prod(axis=2)
                union = x[:, None, 2:].prod(axis=2) + y[None, :, 2:].prod(axis=2) - both
                cost = 1 - np.divide(both, union, out=np.zeros_like(both), where=union > 0)
                pick = assignment(np.concatenate([cost, np.full((len(p), len(p)), UNMATCHED)], axis=1)) if len(p) else []
                pick = [j if 0 <= j < len(q) and cost[i, j] < UNMATCHED else -1 for i, j in enumerate(pick)]
                mine = lambda j: (None,) * 6 if j < 0 else tuple(q[j][c] for c in ("local_id", "seen_us", "global_id", "role", "confidence", "uncertain"))  # noqa: B023, E731
                out += [(run, t_us, r["ord"], r["truth_id"], r["truth_role"], *mine(j)) for r, j in zip(p, pick, strict=True)]
                out += [(run, t_us, None, None, None, *mine(j)) for j in sorted(set(range(len(q))) - set(pick))]
            t = pd.DataFrame(out, columns=names)
            yield t.astype({"ord": "Int64", "local_id": "Int64", "seen_us": "Int64", "uncertain": "boolean"})

    return times.mapInPandas(solve, MATCH)


def per_person(matches: DataFrame) -> DataFrame:
    """Each annotated player: frames visible and tracked, coverage, switches of identity, returns after a gap, identities.

    A switch compares with the identity last tracked, however long ago; a return is a tracked frame after one that was not, once tracked.
    """
    m = matches.where("truth_id is not null and truth_role not in ('SPECTATOR', 'REFEREE')").withColumn("hit", tactical())
    w = Window.partitionBy("run", "truth_id").orderBy("t_us", "ord")
    old = F.last(F.when(F.col("hit"), F.col("global_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumns({"old": old, "was": F.lag("hit").over(w)})
    return m.groupBy("run", "truth_id").agg(
        F.count(F.lit(1)).alias("visible"), F.count(F.when(F.col("hit"), 1)).alias("tracked"), (F.count(F.when(F.col("hit"), 1)) / F.count(F.lit(1))).alias("coverage"),
        F.count(F.when(F.col("hit") & (F.col("old") != F.col("global_id")), 1)).alias("switches"), F.count(F.when(F.col("hit") & F.col("old").isNotNull() & ~F.col("was"), 1)).alias("fragments"),
        F.count_distinct(F.when(F.col("hit"), F.col("global_id"))).alias("identities"), F.sum(F.when(F.col("hit"), F.col("confidence"))).alias("confidence"),
    )


def evaluated(matches: DataFrame) -> DataFrame:
    """One row a run: errors, switches, fragments, duplicate identities, coverage, mean confidence, and players that nobody annotated."""
    p = per_person(matches).groupBy("run").agg(
        F.sum("switches").alias("id_switches"), F.sum("fragments").alias("fragments"), F.sum(F.greatest(F.lit(0), F.col("identities") - 1)).alias("duplicates"), (F.sum("tracked") / F.sum("visible")).alias("coverage"), F.try_divide(F.sum("confidence"), F.sum("tracked")).alias("confidence")
    )
    n = lambda c: F.count(F.when(tactical() & c, 1))
    e = matches.groupBy("run").agg(n(F.col("truth_role") == "SPECTATOR").alias("spectators"), n(F.col("truth_role") == "REFEREE").alias("referees"), n(F.col("truth_id").isNull()).alias("unmatched"))
    zero = {c: 0 for c in ("id_switches", "fragments", "duplicates")} | {"coverage": 0.0, "confidence": 0.0}
    return e.join(p, "run", "left").fillna(zero)


def returns(matches: DataFrame, events: DataFrame, found: DataFrame) -> DataFrame:
    """One row a run: accepted re-identifications (run, t_us, local_id, global_id) that were right, wrong, or not to be scored.

    An identity stands for the annotated person it most often was matched to (the first in a tie, by name); an event is right if its
    observation is that person's.
    """
    was = matches.where("truth_id is not null and local_id is not null").groupBy("run", "local_id", F.col("seen_us").alias("t_us")).agg(F.max_by("truth_id", F.struct("t_us", "ord")).alias("truth_id"))
    votes = found.where("global_id is not null").join(was, ["run", "local_id", "t_us"]).groupBy("run", "global_id", "truth_id").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("run", "global_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "truth_id")).alias("b")).select("run", "global_id", F.col("b.truth_id").alias("expected"))
    e = events.join(was, ["run", "local_id", "t_us"], "left").join(best, ["run", "global_id"], "left")
    n = lambda c: F.count(F.when(c, 1))
    known = F.col("truth_id").isNotNull() & F.col("expected").isNotNull()
    return e.groupBy("run").agg(n(known & (F.col("truth_id") == F.col("expected"))).alias("right"), n(known & (F.col("truth_id") != F.col("expected"))).alias("wrong"), n(~known).alias("unscored"))
