"""The ball's path: dynamic programming over candidates, and its runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the path, in the units of a candidate's score: no ball, per frame; starting or
#: ending a run; a skipped frame; metres per second beyond which a step is impossible.
NONE, START, SKIP, MOST_SPEED = 0.45, 0.8, 0.12, 40.0
LOOK_BACK = 6
#: Sections of a run that one task solves together, as most are short.
SECTIONS = 512


def viterbi(frame: np.ndarray, seconds: np.ndarray, x: np.ndarray, y: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Chosen candidates, one per frame at most, that minimise the total cost.

    Node costs are 1 - score; a frame without a choice costs NONE, whether it has candidates
    or not.  A step joins nodes up to LOOK_BACK frames apart at a speed up to MOST_SPEED, and
    costs the square of its relative speed and SKIP per frame left out; starting a run costs START.
    """
    order = np.lexsort((score, frame))
    frames, first = np.unique(frame[order], return_index=True)
    ends = np.append(first[1:], len(order))
    idle = 0.0  # cheapest way to have seen all frames before, in no run
    idle_from = -1
    cost, back = np.full(len(order), np.inf), np.full(len(order), -2)
    for k, (lo, hi) in enumerate(zip(first, ends, strict=True)):
        now = order[lo:hi]
        if k:
            idle += NONE * (frames[k] - frames[k - 1] - 1)
        node = 1 - score[now]
        best, who = np.full(len(now), idle + START), np.full(len(now), idle_from)
        # All candidates within reach at once; of equal costs the earliest counts.
        at = np.arange(first[np.searchsorted(frames, frames[k] - LOOK_BACK)], lo)
        if len(at):
            old = order[at]
            dt = np.maximum(seconds[now][:, None] - seconds[old][None, :], 1e-6)
            v = np.hypot(x[now][:, None] - x[old], y[now][:, None] - y[old]) / dt / MOST_SPEED
            step = np.where(v <= 1, v * v, np.inf) + (frames[k] - frame[old] - 1) * (SKIP + NONE) + cost[at]
            pick = step.argmin(axis=1)
            better = step[np.arange(len(now)), pick] < best
            best[better], who[better] = step[np.arange(len(now)), pick][better], at[pick[better]]
        cost[lo:hi], back[lo:hi] = best + node, who
        # Leaving the frame empty, or ending a run at the last frame's best node.
        last = int(cost[lo:hi].argmin()) + lo
        ways = [(idle + NONE, idle_from), (cost[last], last)]
        idle, idle_from = min(ways)
    chosen = []
    at = idle_from
    while at >= 0:
        chosen.append(order[at])
        at = back[at]
    return np.array(chosen[::-1], int)


def ball_path(candidates: DataFrame, schema: str) -> DataFrame:
    """The path of each run (columns run, ord, frame_idx, t_us, x, y, score): rows on it.

    No step crosses more than LOOK_BACK frames, so a run is cut where candidates are farther
    apart; SECTIONS neighbouring sections are a group, and do not touch each other.
    """
    w = Window.partitionBy("run").orderBy("frame_idx", "ord")
    new = F.when(F.col("frame_idx") - F.lag("frame_idx").over(w) <= LOOK_BACK, 0).otherwise(1)
    cut = candidates.withColumn("new", new).withColumn("section", F.floor(F.sum("new").over(w) / SECTIONS)).drop("new")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame_idx", "ord"]).reset_index(drop=True)
        at = viterbi(rows["frame_idx"].to_numpy(), rows["t_us"].to_numpy() / 1e6, rows["x"].to_numpy(), rows["y"].to_numpy(), rows["score"].to_numpy())
        return rows.iloc[at].drop(columns="section")

    return cut.groupBy("run", "section").applyInPandas(solve, schema)
