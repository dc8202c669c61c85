"""Homographies of all frames from a few anchors.

Anchors are carried forward and backward through the camera's motion, each direction as one sorted
stream with one matrix carried along; where both reach a frame they are blended by how sure they are
and how far they agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import planes

# Certainty lost a second by flow, by a coarse estimate, without any; frames without any; floors.
FADE, FADE_COARSE, FADE_LOOSE, STILL_FRAMES = 0.03, 0.12, 0.5, 3
LEAST, MEDIUM, AGREE_METRES = 0.05, 0.35, 8.0

CARRIED = "run long, frame_idx long, h array<double>, temporal double, anchor long, anchor_us long, observability double, source string"
TIMELINE = "run long, frame_idx long, h array<double>, confidence double, temporal double, observability double, source string, direction string, anchor long, age double, disagreement double"


def certainty(temporal: float | np.ndarray, observability: float | np.ndarray) -> float | np.ndarray:
    """How sure a carried anchor is: its time's certainty scaled by its geometry's."""
    return np.maximum(0.0, temporal) * (0.25 + 0.75 * np.clip(observability, 0, 1))


def _stream(rows: DataFrame, forward: bool, width: float, height: float, held: bool = False) -> DataFrame:
    """Anchors carried one way; rows are frames with their anchor, if any, in anchor_h.  ``held`` gives, for the
    frames that have one, what would be known there without it."""

    names = ["run", "frame_idx", "t_us", "dt", "m", "cut", "quality", "anchor_h", "observability", "source"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, h, temporal, still, anchor, step = None, None, 0.0, 0, None, None
        share = lambda o: 0.25 + 0.75 * min(max(o, 0.0), 1.0)  # noqa: E731  of ``certainty``
        for b in batches:
            out = []
            for own_run, frame, t_us, dt, m, cut, quality, anchor_h, observability, source in zip(*(b[c].tolist() for c in names), strict=True):
                if own_run != run:
                    run, h, anchor, step = own_run, None, None, None
                here = dt, m, cut, quality
                if h is not None:
                    dt, m, cut, quality = here if forward else step  # the motion between this frame and the one before in the stream
                    if cut:
                        h = None
                    elif m is None or quality == "none":
                        still, temporal = still + 1, temporal - FADE_LOOSE * dt
                        h = None if still > STILL_FRAMES else h
                    else:
                        m = m.tolist() if forward else planes.undone(m.tolist())
                        h = None if m is None else planes.faced(planes.product(m, h), width, height)
                        still, temporal = 0, temporal - (FADE_COARSE if quality == "coarse" else FADE) * dt
                told = h, temporal, anchor
                if anchor_h is not None and (h is None or share(observability) >= max(0.0, temporal) * share(anchor[2])):
                    h, temporal, still, anchor = anchor_h.tolist(), 1.0, 0, (frame, t_us, observability, source)
                if h is not None and max(0.0, temporal) * share(anchor[2]) < LEAST:
                    h = None
                if not held:
                    told = h, temporal, anchor
                if told[0] is not None and (anchor_h is not None or not held) and max(0.0, told[1]) * share(told[2][2]) >= LEAST:
                    out.append((run, frame, told[0], told[1], *told[2]))
                step = here
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CARRIED.split(", ")])

    order = F.col("frame_idx") if forward else F.desc("frame_idx")
    return rows.repartition("run").sortWithinPartitions("run", order).mapInPandas(walk, CARRIED)


def _with_anchors(log: DataFrame, anchors: DataFrame) -> DataFrame:
    """Frames with the best anchor of each: the most observable, the first of equal ones."""
    best = anchors.groupBy("run", "frame_idx").agg(F.min(F.struct((-F.col("observability")).alias("o"), "ord", "h", "observability", "source")).alias("a"))
    quality = F.coalesce("quality", F.when(F.col("reliable"), "flow").otherwise("none"))
    rows = log.join(best, ["run", "frame_idx"], "left").select(
        "run", "frame_idx", "t_us", F.greatest(F.lit(0.0), F.coalesce(F.col("dt_us") / 1e6, F.lit(0.0))).alias("dt"), "m", F.coalesce("cut", F.lit(False)).alias("cut"), quality.alias("quality"),
        F.col("a.h").alias("anchor_h"), F.col("a.observability").alias("observability"), F.col("a.source").alias("source"),
    )
    return rows


def timeline(log: DataFrame, anchors: DataFrame, width: float, height: float) -> DataFrame:
    """A homography for every frame that an anchor reaches, with how sure it is and where it comes from.

    ``log`` has (run, frame_idx, t_us, dt_us, m, reliable, cut, quality), one row a frame: m is the
    motion from the frame before, quality flow, coarse, none or null; ``anchors`` (run, frame_idx, ord, h,
    observability, source).  An anchor is carried until a cut, a motion that cannot be undone, more than
    STILL_FRAMES frames without motion, or too little certainty; a surer anchor takes over.  Frames that none reaches
    have source 'none' and confidence 0.
    """
    return _blended(log, _with_anchors(log, anchors), width, height, False)


def held_out(log: DataFrame, anchors: DataFrame, width: float, height: float) -> DataFrame:
    """(run, frame_idx, metres, confidence, direction): how far each anchor is from what the others make of its frame.

    Leaving an anchor out changes nothing before it in either direction, so both streams tell, in one pass, what they carry into the
    frame.  metres is the median over the pitch in view, null where no other anchor reaches the frame.
    """
    rows = _with_anchors(log, anchors)
    own = rows.where("anchor_h is not null")
    j = own.select("run", "frame_idx", "anchor_h").join(_blended(own, rows, width, height, True), ["run", "frame_idx"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            known = x["h"].notna().to_numpy()
            metres = np.full(len(x), np.nan)
            if known.any():
                metres[known] = planes.disagreement(planes.matrices(x["anchor_h"][known]), planes.matrices(x["h"][known]), width, height)
            yield x[["run", "frame_idx", "confidence", "direction"]].assign(metres=[float(m) if np.isfinite(m) else None for m in metres])

    return j.mapInPandas(compare, "run long, frame_idx long, confidence double, direction string, metres double")


def _blended(frames: DataFrame, rows: DataFrame, width: float, height: float, held: bool) -> DataFrame:
    """Both directions over ``rows`` brought together at ``frames`` (columns of TIMELINE)."""
    ways = [_stream(rows, way, width, height, held).select("run", "frame_idx", F.struct("h", "temporal", "anchor", "anchor_us", "observability", "source").alias(name)) for way, name in ((True, "f"), (False, "b"))]
    both = frames.select("run", "frame_idx", "t_us").join(ways[0], ["run", "frame_idx"], "left").join(ways[1], ["run", "frame_idx"], "left")
    # An anchor that reaches a frame from both sides is its own frame's: one estimate.
    both = both.withColumn("b", F.when(F.col("f.anchor").isNull() | (F.col("f.anchor") != F.col("b.anchor")), F.col("b")))
    flat = both.select("run", "frame_idx", "t_us", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "fb" for c in ("h", "temporal", "anchor", "anchor_us", "observability", "source")))

    def blend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            hf, hb = planes.matrices(x["f_h"]), planes.matrices(x["b_h"])
            num = lambda c: x[c].astype(float).to_numpy()  # noqa: E731,B023
            tf, tb, of, ob = num("f_temporal"), num("b_temporal"), num("f_observability"), num("b_observability")
            cf, cb = certainty(tf, of), certainty(tb, ob)
            has_f, has_b = ~np.isnan(tf), ~np.isnan(tb)
            pair = has_f & has_b
            d, h = np.full(len(x), np.nan), np.where(has_f[:, None, None], hf, hb)
            w = np.where(pair, cf / np.where(pair, cf + cb, 1.0), has_f.astype(float))
            if pair.any():
                d[pair] = planes.disagreement(hf[pair], hb[pair], width, height)
                nf, nb = (m[pair] / np.linalg.norm(m[pair], axis=(1, 2))[:, None, None] for m in (hf, hb))
                nb = nb * np.where((nf * nb).sum(axis=(1, 2)) < 0, -1.0, 1.0)[:, None, None]
                own = w[pair][:, None, None]
                mixed = planes.oriented(own * nf + (1 - own) * nb, width, height)
                lost = np.isnan(mixed).any(axis=(1, 2))
                h[pair] = np.where(lost[:, None, None], np.where((cf >= cb)[pair][:, None, None], hf[pair], hb[pair]), mixed)
            agree = np.where(pair, np.where(np.isfinite(d), np.exp(-np.where(np.isfinite(d), d, 0) / AGREE_METRES), 0.0), 1.0)
            near_f = np.where(pair, w >= 0.5, has_f)
            pick = lambda c: np.where(near_f, x[f"f_{c}"], x[f"b_{c}"])  # noqa: E731,B023
            anchor, some = pick("anchor"), has_f | has_b
            at = np.array([a is not None and not pd.isna(a) and int(a) == f for a, f in zip(anchor, x["frame_idx"], strict=True)])
            age = np.abs(x["t_us"].to_numpy(float) - pick("anchor_us").astype(float)) / 1e6
            best = lambda p, q: np.where(pair, np.fmax(p, q) * agree, np.where(has_f, p, q))  # noqa: E731,B023
            rounded = lambda v: np.round(np.clip(np.nan_to_num(v), 0, 1), 3)
            source = np.where(~some, "none", np.where(pair, "interpolated", np.where(at, pick("source"), "carried")))
            direction = np.where(pair, "both", np.where(at | ~some, None, np.where(has_f, "forward", "backward")))
            yield pd.DataFrame({
                "run": x["run"], "frame_idx": x["frame_idx"], "h": [m.ravel().tolist() if s else None for m, s in zip(h, some, strict=True)],
                "confidence": rounded(best(cf, cb)), "temporal": rounded(best(tf, tb)), "observability": np.nan_to_num(pick("observability").astype(float)), "source": source, "direction": direction,
                "anchor": pd.array([int(a) if s else None for a, s in zip(anchor, some, strict=True)], "Int64"), "age": [round(a, 3) if s else None for a, s in zip(age, some, strict=True)],
                "disagreement": [round(v, 2) if np.isfinite(v) else None for v in d],
            })

    return flat.mapInPandas(blend, TIMELINE)


def propagated(log: DataFrame, width: float, height: float) -> DataFrame:
    """Frames (run, frame_idx, h, confidence, filled) with gaps filled backwards from the next homography.

    ``log`` has (run, frame_idx, dt_us, m, reliable, cut, h, confidence).  A frame without a homography takes that of
    the next frame, moved back, while motion is reliable and not cut, certainty stays MEDIUM and the view plausible.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, h, conf, after = None, None, 0.0, None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.run != run:
                    run, h, after = r.run, None, None
                filled = False
                if r.h is not None:
                    h, conf = np.asarray(r.h, float).reshape(3, 3), r.confidence
                elif h is not None:
                    conf = conf - FADE * after.dt
                    if not after.reliable or after.cut or after.m is None or conf < MEDIUM:
                        h = None
                    else:
                        back = planes.inverses(np.asarray(after.m, float).reshape(1, 3, 3))
                        moved = planes.oriented(back @ h[None], width, height)
                        h, filled = (None, False) if np.isnan(moved).any() or planes.implausible(moved, width, height)[0] else (moved[0], True)
                out.append((r.run, r.frame_idx, None if h is None else h.ravel().tolist(), conf if h is not None else r.confidence, filled))
                after = r
            yield pd.DataFrame(out, columns=["run", "frame_idx", "h", "confidence", "filled"])

    rows = log.select("run", "frame_idx", F.greatest(F.lit(0.0), F.coalesce(F.col("dt_us") / 1e6, F.lit(0.0))).alias("dt"), "m", F.coalesce("reliable", F.lit(False)).alias("reliable"), F.coalesce("cut", F.lit(False)).alias("cut"), "h", "confidence")
    return rows.repartition("run").sortWithinPartitions("run", F.desc("frame_idx")).mapInPandas(walk, "run long, frame_idx long, h array<double>, confidence double, filled boolean")


def bridged_ball(balls: DataFrame, most_us: int = 500_000, speed: float = 0.6) -> DataFrame:
    """``balls`` (run, frame_idx, t_us, state, track, x, y, confidence) with short gaps of a track filled on a line.

    x and y are shares of the picture.  Frames between neighbouring known positions (TRACKED or MISSING) of one track at most
    ``most_us`` apart, at no more than ``speed`` picture widths a second, become MISSING, INTERPOLATED, with
    0.8 of the lesser confidence; what they held before is replaced.
    """
    known = balls.where("state in ('TRACKED', 'MISSING') and track is not null and x is not null")
    w = Window.partitionBy("run").orderBy("frame_idx")
    at = F.struct("frame_idx", "t_us", "track", "x", "y", "confidence")
    pairs = known.select("run", at.alias("a"), F.lead(at).over(w).alias("b"))
    dt = (F.col("b.t_us") - F.col("a.t_us")) / 1e6
    pairs = pairs.where((F.col("b.frame_idx") - F.col("a.frame_idx") > 1) & (F.col("a.track") == F.col("b.track")) & (dt > 0) & (F.col("b.t_us") - F.col("a.t_us") <= most_us))
    pairs = pairs.where(F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")) / dt <= speed)
    gaps = pairs.select("run", "a", "b", F.explode(F.sequence(F.col("a.frame_idx") + 1, F.col("b.frame_idx") - 1)).alias("frame_idx"))
    j = balls.join(gaps, ["run", "frame_idx"], "left")
    u = (F.col("t_us") - F.col("a.t_us")) / (F.col("b.t_us") - F.col("a.t_us"))
    fill = lambda c: F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * u
    gap = F.col("a").isNotNull()
    source = F.when(gap, "INTERPOLATED").when(F.col("state") == "TRACKED", "DETECTED").when(F.col("state") == "MISSING", "PREDICTED")
    return j.select(
        "run", "frame_idx", "t_us", F.when(gap, "MISSING").otherwise(F.col("state")).alias("state"), source.alias("source"), F.when(gap, F.col("a.track")).otherwise(F.col("track")).alias("track"),
        F.when(gap, fill("x")).otherwise(F.col("x")).alias("x"), F.when(gap, fill("y")).otherwise(F.col("y")).alias("y"),
        F.when(gap, F.round(0.8 * F.least("a.confidence", "b.confidence"), 3)).otherwise(F.col("confidence")).alias("confidence"),
    )
