"""Where people are that a frame does not show, by the frame's view of the pitch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds after which nothing is known; metres of uncertainty at once, and more of them a second.
KNOWN_S, SPREAD, SPREAD_S = 10.0, 2.0, 1.5
#: Frames times people that are looked at together.
TOGETHER = 250_000
UNSEEN = "run long, id string, class string, frames long"


def distances(vx: list[np.ndarray], vy: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[rows, points]: distance of each row's points to the nearest edge of its polygon, negative inside; rows without one are NaN."""
    size = np.array([len(v) for v in vx])
    most = int(size.max(initial=0))
    if not most:
        return np.full(x.shape, np.nan)
    real = np.arange(most) < size[:, None]
    ax, ay = np.zeros(real.shape), np.zeros(real.shape)
    ax[real], ay[real] = np.concatenate(vx), np.concatenate(vy)
    after = np.where(np.arange(most) + 1 < size[:, None], np.arange(most) + 1, 0)
    dx, dy = np.take_along_axis(ax, after, 1) - ax, np.take_along_axis(ay, after, 1) - ay
    near, odd = np.full(x.shape, np.inf), np.zeros(x.shape, bool)
    with np.errstate(invalid="ignore"):
        for k in range(most):
            a, b, u, v, some = (c[:, k : k + 1] for c in (ax, ay, dx, dy, real))
            long = u * u + v * v
            t = np.where(long > 0, np.clip(((x - a) * u + (y - b) * v) / np.where(long > 0, long, 1.0), 0.0, 1.0), 0.0)
            near = np.where(some, np.minimum(near, np.hypot(x - a - t * u, y - b - t * v)), near)
            end = np.take_along_axis(ay, after[:, k : k + 1], 1)
            crosses = ((b > y) != (end > y)) & (x < u * (y - b) / np.where(b == end, 1.0, end - b) + a)
            odd ^= some & crosses
    return np.where(size[:, None] > 0, np.where(odd, -near, near), np.nan)


def unseen(frames: DataFrame, sightings: DataFrame, views: DataFrame, frame_s: float) -> DataFrame:
    """(run, id, class, frames): in how many of a run's frames that do not show a person of the run they are concealed (C), off the
    screen (S) or unknown (U), from where they were last: off or in view by more than what they may have moved, and at least a metre.

    ``frames`` has (run, frame_idx), one row a frame, ``sightings`` (run, frame_idx, id, x, y), once a frame at most, ``views``
    (run, frame_idx, vx, vy), corners in the same unit.  Frames stream by in order with the last sightings of a run's
    people carried along, so no row is made for a person and a frame.
    """
    own = sightings.groupBy("run", "frame_idx").agg(F.collect_list(F.struct("id", "x", "y")).alias("s"))
    own = own.select("run", "frame_idx", *(F.col(f"s.{c}").alias(name) for c, name in (("id", "ids"), ("x", "xs"), ("y", "ys"))))
    rows = frames.select("run", "frame_idx").join(own, ["run", "frame_idx"], "left").join(views.select("run", "frame_idx", "vx", "vy"), ["run", "frame_idx"], "left")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, people, before = None, {}, 0  # people: place of each id; before: frames of the run so far
        last = np.empty((3, 0))  # frame, x and y of the last sighting of each
        out: list[tuple] = []

        def look(b: pd.DataFrame) -> None:
            nonlocal last, before
            frame, n = b["frame_idx"].to_numpy(float), len(b)
            row = [k for k, ids in enumerate(b["ids"]) if ids is not None for _ in ids]
            names = [i for ids in b["ids"] if ids is not None for i in ids]
            for i in names:
                if i not in people:
                    people[i] = len(people)
                    out.append((run, i, "U", before))
            at = np.array([people[i] for i in names], int)
            # The first of n + 1 rows is what is carried.
            known = np.full((3, n + 1, len(people)), np.nan)
            known[:, 0, : last.shape[1]] = last
            if names:
                own = np.array(row) + 1
                known[0, own, at], known[1, own, at], known[2, own, at] = frame[own - 1], *(np.concatenate([v for v in b[c] if v is not None]) for c in ("xs", "ys"))
            hit = ~np.isnan(known[0])
            place = np.maximum.accumulate(np.where(hit, np.arange(n + 1)[:, None], 0), axis=0)
            known = np.take_along_axis(known, np.broadcast_to(place, known.shape), 1)
            last, before = known[:, -1].copy(), before + n
            age = (frame[:, None] - known[0, 1:]) * frame_s
            empty = np.empty(0)
            vx, vy = ([empty if v is None else v for v in b[c]] for c in ("vx", "vy"))
            away = distances(vx, vy, known[1, 1:], known[2, 1:])
            with np.errstate(invalid="ignore"):
                away = np.where(age <= KNOWN_S, away, np.nan)
                spread = np.maximum(1.0, SPREAD + SPREAD_S * age)
                missing, inside, outside = ~hit[1:], away <= -spread, away >= spread
            counts = [(missing & m).sum(axis=0).tolist() for m in (inside, outside, ~inside & ~outside)]
            for i, *each in zip(people, *counts, strict=True):
                out.extend((run, i, c, k) for c, k in zip("CSU", each, strict=True))

        for b in batches:
            of = b["run"].to_numpy()
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(b) else []
            for lo, hi in zip(first, [*first[1:], len(b)], strict=False):
                if of[lo] != run:
                    run, people, before, last = int(of[lo]), {}, 0, np.empty((3, 0))
                while lo < hi:
                    end = min(hi, lo + max(1, TOGETHER // (len(people) + 250)))
                    look(b.iloc[lo:end])
                    lo = end  # noqa: PLW2901
            told = pd.DataFrame(out, columns=["run", "id", "class", "frames"])
            out.clear()
            yield told[told["frames"] > 0]

    parts = rows.repartition("run").sortWithinPartitions("run", "frame_idx").mapInPandas(walk, UNSEEN)
    return parts.groupBy("run", "id", "class").agg(F.sum("frames").alias("frames"))
