"""Lenses of videos from the markings of their frames, and stored descriptors of people."""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lens

#: Lengths of a descriptor's parts.
PARTS = {"jersey": ("j", 24), "shorts": ("s", 12), "socks": ("k", 8), "layout": ("l", 0)}
DESCRIPTOR = "ord long, quality double, jersey array<double>, shorts array<double>, socks array<double>, layout array<double>, embedding array<double>"


def frame_lenses(points: DataFrame, width: float, height: float) -> DataFrame:
    """(video, frame_idx, k, gain, off, lines) of frames whose markings (video, frame_idx, line, x, y) bend and can be straightened."""
    lines = points.groupBy("video", "frame_idx", "line").agg(F.collect_list(F.array("x", "y")).alias("p"))
    frames = lines.groupBy("video", "frame_idx").agg(F.collect_list("p").alias("lines"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for video, frame, own in zip(b["video"], b["frame_idx"], b["lines"], strict=True):
                found = lens.coefficient([np.stack(list(p)) for p in own], width, height)
                if found is not None:
                    out.append((video, frame, *found))
            yield pd.DataFrame(out, columns=["video", "frame_idx", "k", "gain", "off", "lines"])

    return frames.mapInPandas(run, "video long, frame_idx long, k double, gain double, off double, lines long")


def video_lenses(frames: DataFrame) -> DataFrame:
    """(video, k, gain, frames, agreement): upper medians over a video's frames, and how many bend the same way."""
    upper = lambda c: F.get(F.sort_array(F.collect_list(c)), F.floor(F.count(F.lit(1)) / 2).cast("int"))
    v = frames.groupBy("video").agg(upper("k").alias("k"), upper("gain").alias("gain"), F.count(F.lit(1)).alias("frames"))
    same = frames.select("video", F.col("k").alias("own")).join(v.select("video", "k"), "video").groupBy("video").agg(F.avg((F.signum("own") == F.signum("k")).cast("double")).alias("agreement"))
    return v.join(same, "video")


def decoded(rows: DataFrame, cells: int) -> DataFrame:
    """Descriptors (columns of DESCRIPTOR) from (ord, q, j, s, k, l, e): e is base64 of half-precision numbers.

    The embedding is brought to unit length; without e, or if it is zero, it is null.  A row with a part that is missing or of the wrong
    length, or whose e is no such code, has nulls throughout.  ``cells`` is the number of cells of a layout, three values each.
    """

    def vector(code: str | None) -> tuple[bool, list | None]:
        if not code:
            return True, None
        try:
            v = np.frombuffer(base64.b64decode(code, validate=True), "<f2").astype(float)
        except (binascii.Error, ValueError):
            return False, None
        full = np.linalg.norm(v)
        return True, (v / full).tolist() if np.isfinite(full) and full > 0 else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok, e = zip(*(vector(c if isinstance(c, str) else None) for c in b["e"]), strict=True) if len(b) else ((), ())
            out = {"ord": b["ord"]}
            good = np.array(ok, bool) & b["q"].notna().to_numpy()
            for key, n in PARTS.values():
                good &= np.array([v is not None and not isinstance(v, float) and len(v) == (n or 3 * cells) for v in b[key]], bool)
            for name, (key, _) in PARTS.items():
                out[name] = [list(v) if g else None for v, g in zip(b[key], good, strict=True)]
            out["quality"] = b["q"].clip(0, 1).where(good)
            out["embedding"] = [v if g else None for v, g in zip(e, good, strict=True)]
            yield pd.DataFrame(out)[[c.split()[0] for c in DESCRIPTOR.split(", ")]]

    return rows.select("ord", "q", "j", "s", "k", "l", "e").mapInPandas(run, DESCRIPTOR)


def encoded(rows: DataFrame) -> DataFrame:
    """``decoded`` undone: rounded parts, and the embedding in half precision as base64."""

    @F.pandas_udf("string")
    def code(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else base64.b64encode(np.asarray(x, "<f2").tobytes()).decode() for x in v], dtype=object)

    r = lambda c, n: F.transform(c, lambda v: F.round(v, n))
    return rows.select("ord", F.round("quality", 3).alias("q"), r("jersey", 4).alias("j"), r("shorts", 4).alias("s"), r("socks", 4).alias("k"), r("layout", 3).alias("l"), code("embedding").alias("e"))
