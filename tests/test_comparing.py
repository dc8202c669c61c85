"""Galleries kept over time and assignment with a lead, against plain loops."""

from __future__ import annotations

import itertools

import numpy as np
from fieldtrace.operators import comparing, tracklets


def test_galleries_equal_the_loop(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(200):
        v = rng.normal(size=4)
        rows.append((k % 3, int(rng.integers(0, 5000)), k, [float(x) for x in v / np.linalg.norm(v)]))
    want = set()
    for own in range(3):
        held, last = [], None
        for _, t, vec, v in sorted((r for r in rows if r[0] == own), key=lambda r: (r[1], r[2])):
            if (last is None or t - last >= 40) and all(np.dot(v, h) <= 0.5 for h in held):
                held.append(np.array(v))
                last = t
                want.add(vec)
                if len(held) > 5:
                    del held[1]
    got = comparing.kept_galleries(spark.createDataFrame(rows, "id long, t long, vec_id long, v array<double>").repartition(3), 40, 0.5).collect()
    assert {r["vec_id"] for r in got} == want and len(want) > 10


def test_assignment_needs_a_lead_both_ways(spark):
    s = [("f1", "a", 0.9), ("f1", "b", 0.3), ("f2", "a", 0.4), ("f2", "b", 0.8), ("f3", "c", 0.85), ("f4", "c", 0.84), ("f5", "d", 0.5)]
    got = tracklets.best_pairs(spark.createDataFrame([(0, "T", *r) for r in s], "video long, team string, frag string, id string, score double"), 0.6, 0.1).collect()
    assert {(r["frag"], r["id"]) for r in got} == {("f1", "a"), ("f2", "b")}


def test_corners_map_to_their_points(spark):
    from fieldtrace.functions.geometry import projected
    from pyspark.sql import functions as F

    x, y = [10.0, 190.0, 170.0, 20.0], [5.0, 15.0, 120.0, 90.0]
    h = comparing.corner_homography([F.lit(v) for v in x], [F.lit(v) for v in y])
    flat = itertools.chain.from_iterable(projected(h, F.lit(float(u)), F.lit(float(v))) for u, v in ((0, 0), (1, 0), (1, 1), (0, 1)))
    r = spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(flat))).first()
    assert np.allclose(list(r), [v for p in zip(x, y, strict=True) for v in p])
