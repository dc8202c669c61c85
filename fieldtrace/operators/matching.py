"""Similarity joins and one-to-one assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as fv


def gallery(vectors: DataFrame, size: int = 6) -> DataFrame:
    """The ``size`` best vectors of each identity, by quality."""
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("quality"), "vec_id"))
    return vectors.withColumn("turn", turn).where(F.col("turn") <= size)


def best_two(pairs: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean of the two best scores of each group; of one, that one."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score)))
    top = pairs.withColumn("turn", turn).where("turn <= 2").groupBy(*keys)
    one, two = F.max(F.when(F.col("turn") == 1, F.col(score))), F.max(F.when(F.col("turn") == 2, F.col(score)))
    return top.agg(((one + F.coalesce(two, one)) / 2).alias(score))


def gallery_pairs(g: DataFrame, block: str) -> DataFrame:
    """Cosines between the galleries of identities of one block; a gallery is of bounded size."""
    g = g.withColumn("norm", fv.norm(F.col("q")))
    a = g.select(block, F.col("id").alias("a"), F.col("q").alias("qa"), F.col("norm").alias("na"))
    b = g.select(block, F.col("id").alias("b"), F.col("q").alias("qb"), F.col("norm").alias("nb"))
    return a.join(b, block).where("a < b").select("a", "b", fv.cosine(F.col("qa"), F.col("qb"), F.col("na"), F.col("nb")).alias("cos"))


def mutual_best(scores: DataFrame) -> DataFrame:
    """Pairs (a < b) that are each other's best."""
    both = scores.select("a", "b", "cos").unionByName(scores.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    best = both.groupBy("a").agg(F.max(F.struct("cos", (-F.col("b")).alias("nb"))).alias("top")).select("a", (-F.col("top.nb")).alias("b"), "top.cos")
    back = best.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return best.where("a < b").join(back, ["a", "b"], "left_semi")


def top_two_gap(scores: DataFrame, probe: str, candidate: str, score: str) -> DataFrame:
    """Best candidate of each probe with its lead over the second."""
    turn = F.row_number().over(Window.partitionBy(probe).orderBy(F.desc(score), candidate))
    top = scores.withColumn("turn", turn).where("turn <= 2").groupBy(probe)
    first, second = F.max(F.when(F.col("turn") == 1, F.col(score))), F.max(F.when(F.col("turn") == 2, F.col(score)))
    return top.agg(F.max(F.when(F.col("turn") == 1, F.col(candidate))).alias("best"), first.alias("score"), (first - second).alias("lead"))


def frame_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Overlapping boxes of two sets in the same frame; the frame is the equi-key."""
    rename = lambda d, p: d.select("frame_idx", *(F.col(c).alias(p + c) for c in ("ord", "id", "bx", "by", "bw", "bh")))
    j = rename(a, "a_").join(rename(b, "b_"), "frame_idx").withColumn("iou", fv.iou("a_", "b_"))
    return j.where(F.col("iou") >= least).select("frame_idx", "a_ord", "b_ord", "a_id", "b_id", "iou")


def greedy(pairs: DataFrame, group: str, schema: str) -> DataFrame:
    """One-to-one pairs of each group in order of falling score; ties by the ids."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, keep = set(), set(), []
        rows = rows.sort_values(["iou", "a_ord", "b_ord"], ascending=[False, True, True])
        for k, (a, b) in enumerate(zip(rows["a_ord"], rows["b_ord"], strict=True)):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                keep.append(k)
        return rows.iloc[keep]

    return pairs.groupBy(group).applyInPandas(pick, schema)


def suppressed(boxes: DataFrame, most: float = 0.45) -> DataFrame:
    """Non-maximum suppression in each frame: best score first, none that overlaps a kept one more.

    The boxes of a frame are one sorted array, walked with those kept so far; most frames have few, so that a
    Python group for each would cost more than the boxes do.
    """
    order = (F.col("score").isNull().alias("unknown"), (-F.col("score")).alias("turn"), F.col("ord").isNull().alias("nameless"))
    found = boxes.groupBy("frame_idx").agg(F.sort_array(F.collect_list(F.struct(*order, "ord", "score", "bx", "by", "bw", "bh"))).alias("found"))
    kept = F.slice("found", 1, 1)
    rest = F.slice("found", F.lit(2), F.greatest(F.size("found") - 1, F.lit(0)))
    kept = F.aggregate(rest, kept, lambda own, p: F.when(F.exists(own, lambda k: fv.iou(k, p) > most), own).otherwise(F.concat(own, F.array(p))))
    return found.select("frame_idx", F.inline(kept)).select("frame_idx", "ord", "score")


def assignment(cost: np.ndarray) -> np.ndarray:
    """Least-cost one-to-one assignment: column of each row, by shortest augmenting paths."""
    n, m = cost.shape
    if n > m:
        back = assignment(cost.T)
        out = np.full(n, -1)
        out[back[back >= 0]] = np.flatnonzero(back >= 0)
        return out
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[at] = True
            row = owner[at]
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[row - 1, free - 1] - u[row] - v[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], at
            nxt = free[least[free].argmin()]
            delta = least[nxt]
            u[owner[used]] += delta
            v[used] -= delta
            least[free] -= delta
            at = nxt
            if not owner[at]:
                break
        while at:
            owner[at], at = owner[way[at]], way[at]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def assigned(pairs: DataFrame, unmatched: float = 0.78) -> DataFrame:
    """Optimal one-to-one pairs of each frame by cost 1 - IoU; dearer pairs than ``unmatched`` stay apart."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = np.unique(rows["a_ord"]), np.unique(rows["b_ord"])
        cost = np.full((len(a), len(b) + len(a)), 2.0)
        cost[:, len(b) :] = unmatched
        cost[np.searchsorted(a, rows["a_ord"]), np.searchsorted(b, rows["b_ord"])] = 1 - rows["iou"]
        column = assignment(cost)
        hit = column < len(b)
        return pd.DataFrame({"frame_idx": rows["frame_idx"].iloc[0], "a_ord": a[hit], "b_ord": b[column[hit]], "cost": cost[np.flatnonzero(hit), column[hit]]})

    return pairs.groupBy("frame_idx").applyInPandas(solve, "frame_idx long, a_ord long, b_ord long, cost double")


def boxes(obs: DataFrame) -> tuple[Column, ...]:
    """Boxes of the adapted observations, in thousandths of the picture."""
    return (F.col("x_m").alias("bx"), F.col("y_m").alias("by"), (F.lit(200) + F.col("ord") % 90).alias("bw"), (F.lit(300) + F.col("ord") % 110).alias("bh"))
