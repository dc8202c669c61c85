"""The ball followed frame by frame: a constant-velocity filter with a gate, and a choice that resists switching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metres, metres per second (squared), seconds, scores.
GATE, ACCELERATION, START_SPEED, MOST_SPEED, LOST_S = 0.45, 30.0, 10.0, 40.0, 3.0
ACCEPT, RESIST, NEAR_ENOUGH, BEGIN = 0.45, 0.25, 9.0, 0.6
TOLD = "run long, frame_idx long, state string, ord long, x double, y double, speed double, distance double, track long, jumps long, off_path long"

_SEEN = np.eye(2, 4)


class Filter:
    """Position and velocity in pixels, and how sure they are."""

    def __init__(self, x: float, y: float, size: float, pxm: float) -> None:
        self.state, self.pxm = np.array([x, y, 0.0, 0.0]), pxm
        self.cov = np.diag([size**2, size**2, (START_SPEED * pxm) ** 2, (START_SPEED * pxm) ** 2])

    def moved(self, m: np.ndarray) -> None:
        """Along with the camera: places by the matrix, velocities by its linear part."""
        p = m @ np.array([*self.state[:2], 1.0])
        j = np.kron(np.eye(2), m[:2, :2])
        self.state = np.concatenate([p[:2] / p[2], m[:2, :2] @ self.state[2:]])
        self.cov = j @ self.cov @ j.T

    def predicted(self, dt: float) -> None:
        f = np.eye(4) + dt * np.eye(4, k=2)
        g = np.concatenate([np.eye(2) * dt * dt / 2, np.eye(2) * dt])
        self.state = f @ self.state
        self.cov = f @ self.cov @ f.T + g @ g.T * (ACCELERATION * self.pxm) ** 2

    def off(self, z: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of places in pixels, and squared in units of what is uncertain."""
        d = z - self.state[:2]
        s = self.cov[:2, :2] + np.eye(2) * (sigma**2)[:, None, None]
        return np.hypot(*d.T), np.einsum("ni,nij,nj->n", d, np.linalg.inv(s), d)

    def updated(self, z: np.ndarray, sigma: float) -> None:
        k = self.cov @ _SEEN.T @ np.linalg.inv(self.cov[:2, :2] + np.eye(2) * sigma**2)
        self.state = self.state + k @ (z - self.state[:2])
        self.cov = (np.eye(4) - k @ _SEEN) @ self.cov


def choice(f: Filter, at: np.ndarray, size: np.ndarray, q: np.ndarray, gap: float, dt: float, last: float) -> tuple[int, float, int, int]:
    """(candidate or -1, its distance squared, jumps, others off the path) of one frame.

    The gate is what the ball may have moved, wider the longer it was not seen.  The candidate nearest to the prediction
    stays unless another is better by RESIST.
    """
    speed = float(np.hypot(*f.state[2:]))
    gate = max(GATE * f.pxm, 2 * last) + 0.3 * speed * dt
    if gap > dt * 1.5:
        gate = max(gate, (GATE + 6 * gap) * f.pxm)
    err, m2 = f.off(at, np.maximum(1.0, size / 4))
    near = (err <= gate) | ((m2 <= NEAR_ENOUGH) & (err <= 1.5 * gate))
    jumps = ~near & (err / f.pxm / max(gap, 1e-3) > MOST_SPEED)
    if not near.any():
        return -1, np.nan, int(jumps.sum()), int((~near & ~jumps).sum())
    score = 0.5 * np.exp(-m2 / 18) * np.where(err > gate, 0.7, 1.0) + 0.1 * np.exp(-((err / max(gate, 1.0)) ** 2)) + 0.4 * q
    there, score = np.flatnonzero(near), np.where(near, score, -np.inf)
    own, best = int(there[m2[there].argmin()]), int(score.argmax())
    pick = own if best != own and score[own] >= ACCEPT - 0.1 and score[best] < score[own] + RESIST else best
    need = ACCEPT if err[pick] <= gate else max(ACCEPT, 0.6)
    return (pick if score[pick] >= need else -1), float(m2[pick]), int(jumps.sum()), int((~near & ~jumps).sum())


def followed(candidates: DataFrame, frames: DataFrame) -> DataFrame:
    """One row a frame (columns of TOLD): TRACKED with the candidate chosen, HIDDEN with a prediction, or SEARCHING.

    ``candidates`` has (run, frame_idx, ord, x, y, d, q, pxm) in pixels, ``frames`` (run, frame_idx, t_us, m, reliable, cut).  A
    track begins with the likeliest candidate of BEGIN or more, and ends at a cut or LOST_S after it was last seen.  Frames stream by
    in order, with one filter carried along; the few candidates of a frame are one array.
    """
    own = candidates.groupBy("run", "frame_idx").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y", "d", "q", "pxm"))).alias("found"))
    rows = frames.select("run", "frame_idx", "t_us", "m", F.coalesce("reliable", F.lit(False)).alias("reliable"), F.coalesce("cut", F.lit(False)).alias("cut")).join(own, ["run", "frame_idx"], "left")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, f, t, seen, last, track = None, None, 0.0, 0.0, 0.0, 0
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                now = r.t_us / 1e6
                if r.run != run:
                    run, f, t, track = r.run, None, now, 0
                dt, t = max(1e-3, now - t), now
                found = [] if r.found is None or isinstance(r.found, float) else list(r.found)
                at = np.array([[c["x"], c["y"], c["d"], c["q"], c["pxm"]] for c in found], float).reshape(-1, 5)
                if f is not None and (r.cut or now - seen > LOST_S):
                    f = None
                pick, m2, jumps, off = -1, np.nan, 0, 0
                if f is not None:
                    if r.reliable and r.m is not None:
                        f.moved(np.asarray(r.m, float).reshape(3, 3))
                    f.predicted(dt)
                    if len(at):
                        pick, m2, jumps, off = choice(f, at[:, :2], at[:, 2], at[:, 3], max(dt, now - seen), dt, last)
                elif len(at) and at[:, 3].max() >= BEGIN:
                    pick = int(at[:, 3].argmax())
                    f, track = Filter(*at[pick, [0, 1, 2, 4]]), track + 1
                if pick >= 0:
                    f.updated(at[pick, :2], max(1.0, at[pick, 2] / 4))
                    f.pxm, seen, last = at[pick, 4], now, at[pick, 2]
                state = "SEARCHING" if f is None else "TRACKED" if pick >= 0 else "HIDDEN"
                place = (None,) * 3 if f is None else (*map(float, f.state[:2]), float(np.hypot(*f.state[2:]) / f.pxm))
                out.append((run, r.frame_idx, state, found[pick]["ord"] if pick >= 0 else None, *place, m2 if pick >= 0 and m2 == m2 else None, track if f is not None else None, jumps, off))
            told = pd.DataFrame(out, columns=[c.split()[0] for c in TOLD.split(", ")])
            yield told.astype({"ord": "Int64", "track": "Int64"})

    return rows.repartition("run").sortWithinPartitions("run", "frame_idx").mapInPandas(walk, TOLD)
