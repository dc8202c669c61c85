"""Evaluation against annotated people, the archive, lenses and stored descriptors."""

import math
import random

import numpy as np
import pytest
from fieldtrace.functions import lens
from fieldtrace.operators import optics, truth
from fieldtrace.sources import archive

TRUTH = "run long, t_us long, ord long, truth_id string, truth_role string, bx double, by double, bw double, bh double, visible boolean"
FOUND = "run long, t_us long, ord long, local_id long, global_id string, role string, confidence double, uncertain boolean, bx double, by double, bw double, bh double"
S = 1_000_000


def test_known_switches_gaps_and_errors(spark):
    box = lambda x: (float(x), 0.0, 10.0, 20.0)
    annotated, seen, n = [], [], 0
    # p1: tracked as A, lost at 2 and 3, back as B at 4; p2 tracked throughout; a referee taken for a player; a spectator that is not.
    for t in range(6):
        annotated += [(0, t * S, 4 * t + k, who, role, *box(50 * k), True) for k, (who, role) in enumerate((("p1", "PLAYER_TEAM_A"), ("p2", "PLAYER_TEAM_B"), ("r", "REFEREE"), ("s", "SPECTATOR")))]
        rows = [(1, "A" if t < 2 else "B", 0)] if t not in (2, 3) else []
        rows += [(2, "C", 52), (3, "D", 101), (9, "X", 400)]
        for local, name, x in rows:
            for late in (60_000, 20_000, 200_000):  # the nearest of the track counts, and none beyond a tenth of a second
                seen.append((0, t * S + late, n, local, name if late == 20_000 else "wrong", "PLAYER_TEAM_A", 0.8, False, *box(x)))
                n += 1
        seen.append((0, t * S, n, 4, None, "UNKNOWN", 0.1, True, *box(150)))
        n += 1
    annotated.append((0, 0, 99, "hidden", "PLAYER_TEAM_A", *box(400), False))
    t, f = spark.createDataFrame(annotated, TRUTH), spark.createDataFrame(seen, FOUND)
    m = truth.matched(t, f).cache()
    r = truth.evaluated(m).collect()[0].asDict()
    assert r.pop("confidence") == pytest.approx(0.8)
    assert r == {"run": 0, "spectators": 0, "referees": 6, "unmatched": 6, "id_switches": 1, "fragments": 1, "duplicates": 1, "coverage": 10 / 12}
    p = {x["truth_id"]: x for x in truth.per_person(m).collect()}
    assert (p["p1"]["visible"], p["p1"]["tracked"], p["p1"]["identities"], p["p2"]["coverage"]) == (6, 4, 2, 1.0)
    events = spark.createDataFrame([(0, 4 * S + 20_000, 1, "B"), (0, 20_000, 2, "B"), (0, 7 * S, 1, "B")], "run long, t_us long, local_id long, global_id string")
    assert truth.returns(m, events, f).collect()[0].asDict() == {"run": 0, "right": 1, "wrong": 1, "unscored": 1}
    assert truth.matched(t.where("false"), f).count() == 0 and truth.matched(t, f.where("false")).where("local_id is null").count() == 24


def test_matches_are_the_best_assignment(spark):
    import itertools

    r = random.Random(4)
    annotated, seen = [], []
    for t in range(30):
        annotated += [(0, t * S, 10 * t + k, f"p{k}", "PLAYER_TEAM_A", r.uniform(0, 20), r.uniform(0, 20), 10.0, 10.0, True) for k in range(r.randint(0, 4))]
        seen += [(0, t * S, 10 * t + k, k, f"g{k}", "PLAYER_TEAM_A", 0.5, False, r.uniform(0, 20), r.uniform(0, 20), 10.0, 10.0) for k in range(r.randint(0, 4))]

    def cost(a, b):
        w = [min(a[5 + k] + 10, b[8 + k] + 10) - max(a[5 + k], b[8 + k]) for k in (0, 1)]
        both = max(w[0], 0) * max(w[1], 0)
        return 1 - both / (200 - both)

    got = {}
    for x in truth.matched(spark.createDataFrame(annotated, TRUTH), spark.createDataFrame(seen, FOUND)).where("truth_id is not null").collect():
        got.setdefault(x["t_us"], {})[x["truth_id"]] = x["local_id"]
    for t in range(30):
        p, q = [a for a in annotated if a[1] == t * S], [b for b in seen if b[1] == t * S]
        best = min((sum(cost(a, b) if b else 0.7 for a, b in zip(p, pick, strict=True)) for pick in itertools.permutations(q + [None] * len(p), len(p))), default=0)
        mine = sum(cost(a, next(b for b in q if b[3] == got[t * S][a[3]])) if got[t * S][a[3]] is not None else 0.7 for a in p)
        assert mine == pytest.approx(best)


def test_archive_reads_only_overlapping_segments(spark, tmp_path):
    path, put = str(tmp_path / "archive"), archive.writer(str(tmp_path / "archive"))
    assert not archive.exists(spark, path)
    batch = lambda k: spark.createDataFrame([(v, k * 5 * S + i * S, v * 1000 + k * 5 + i) for v in (0, 1) for i in range(5)], "video long, t_us long, ord long")
    for k in range(6):
        put(batch(k), k)
    rows = archive.interval(spark, path, 1, 11 * S, 14 * S)
    assert sorted(r["ord"] for r in rows.collect()) == [1011, 1012, 1013, 1014]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(segment" in plan and "(segment" in plan and " = 2)" in plan
    files = {f.rsplit("segment=", 1)[1].split("/")[0] for f in rows.inputFiles()}
    assert files <= {"0", "1", "2", "3", "4", "5"} and archive.manifest(spark, path).count() == 12
    before = sorted(map(tuple, spark.read.parquet(f"{path}/rows").collect()))
    put(batch(3), 3)  # the batch comes again after a failure
    assert sorted(map(tuple, spark.read.parquet(f"{path}/rows").collect())) == before and archive.manifest(spark, path).count() == 12
    assert archive.interval(spark, path, 1, 90 * S, 95 * S).count() == 0 and archive.interval(spark, path, 7, 0, 95 * S).count() == 0


def test_bent_lines_give_back_the_coefficient(spark):
    rows = []
    straight = [np.c_[np.linspace(50, 1230, 60), np.linspace(y, y + 60, 60)] for y in (40, 200, 600)] + [np.c_[np.full(40, 900.0), np.linspace(20, 700, 40)]]
    for video, k in ((0, -0.2), (1, 0.15), (2, 0.0)):
        for frame in range(3):
            for n, line in enumerate(straight):
                bent = lens.bent(line, k, 1280, 720)
                assert np.allclose(lens.straightened(bent, k, 1280, 720), line, atol=0.05)
                rows += [(video, frame, n, float(x), float(y)) for x, y in bent[: 20 if frame == 2 else None]]
    frames = optics.frame_lenses(spark.createDataFrame(rows, "video long, frame_idx long, line long, x double, y double"), 1280, 720).cache()
    assert {(r["video"], r["frame_idx"]) for r in frames.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    got = {r["video"]: r for r in optics.video_lenses(frames).collect()}
    assert got[0]["k"] == pytest.approx(-0.2, abs=0.005) and got[1]["k"] == pytest.approx(0.15, abs=0.005) and got[0]["frames"] == 2 and got[0]["agreement"] == 1.0


def test_descriptors_survive_a_round_trip_and_broken_ones_are_null(spark):
    r = random.Random(1)
    part = lambda n: [round(r.random(), 3) for _ in range(n)]
    v = np.array([r.gauss(0, 1) for _ in range(64)])
    v /= np.linalg.norm(v)
    rows = [(0, 0.5, part(24), part(12), part(8), part(12), v.tolist()), (1, 1.7, part(24), part(12), part(8), part(12), None), (2, 0.5, part(24), part(12), part(8), part(12), [0.0] * 64)]
    names = "ord long, quality double, jersey array<double>, shorts array<double>, socks array<double>, layout array<double>, embedding array<double>"
    coded = optics.encoded(spark.createDataFrame(rows, names))
    back = {x["ord"]: x for x in optics.decoded(coded, 4).collect()}
    assert back[0]["jersey"] == rows[0][2] and np.allclose(back[0]["embedding"], v, atol=1e-3) and math.isclose(np.linalg.norm(back[0]["embedding"]), 1)
    assert back[1]["embedding"] is None and back[1]["quality"] == 1.0 and back[2]["embedding"] is None and back[2]["socks"] == rows[2][4]
    bad = [(0, 0.5, part(23), part(12), part(8), part(12), None), (1, 0.5, part(24), part(12), None, part(12), None), (2, None, part(24), part(12), part(8), part(12), None), (3, 0.5, part(24), part(12), part(8), part(12), "no code!"), (4, 0.5, part(24), part(12), part(8), part(12), "AAA=")]
    df = spark.createDataFrame([(*x[:6], x[6]) for x in bad], "ord long, q double, j array<double>, s array<double>, k array<double>, l array<double>, e string")
    got = {x["ord"]: x for x in optics.decoded(df, 4).collect()}
    assert all(got[k]["jersey"] is None and got[k]["quality"] is None for k in range(4)) and got[4]["embedding"] is None
