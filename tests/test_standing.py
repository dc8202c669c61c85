"""Decisions that stand: windows against the plain state machines that they replace."""

from __future__ import annotations

import json
import random

import pytest
from fieldtrace.operators import standing as st
from fieldtrace.sources import result
from pyspark.sql import functions as F


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def by_key(rows):
    out: dict = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_ignored_until_ten_clear_ticks(spark):
    r = random.Random(1)
    rows = [(k % 4 if k % 4 else None, k // 4, k, r.random() < 0.06, r.choice([True, True, True, True, True, True, True, True, True, False, None])) for k in range(600)]
    got = {x["ord"]: (x["ignored"], x["streak"]) for x in st.non_targets(frame(spark, rows, "track long, t_us long, ord long, marks boolean, clear boolean")).collect()}
    for ticks in by_key(rows).values():
        ignored, streak = False, 0
        for _, _, o, marks, clear in ticks:
            if marks:
                ignored, streak = True, 0
            elif ignored:
                streak = streak + 1 if clear else 0
                if streak >= st.CLEAR_TICKS:
                    ignored, streak = False, 0
            assert got[o] == (ignored, streak), o
    assert {x for x, _ in got.values()} == {True, False}


def test_recognition_needs_hits_in_a_row_for_one_person(spark):
    r = random.Random(2)
    rows = [(k % 3, k // 3, k, r.choice(["P1", "P1", "P1", "P2", None]), r.choice([0.9, 0.9, 0.8, 0.5]), r.choice([None, 0.1, 0.6, 0.7]), k % 3 == 0) for k in range(300)]
    got = {x["ord"]: (x["hits"], x["decided"]) for x in st.recognised(frame(spark, rows, "track long, t_us long, ord long, person string, score double, rival double, held boolean")).collect()}
    for ticks in by_key(rows).values():
        hits, person = 0, None
        for _, _, o, p, score, rival, held in ticks:
            if p is None or score < 0.7 or score < (rival or 0.0) + 0.15:
                hits, person = 0, None
            else:
                hits, person = (hits + 1 if p == person else 1), p
            assert got[o] == (hits, hits >= (3 if held else 2))
    assert {x for _, x in got.values()} == {True, False}


def test_release_after_three_doubts(spark):
    rows = [("a", k, k, s) for k, s in enumerate([0.4, 0.4, 0.5, 0.1, 0.1, 0.1, 0.2, 0.2, 0.44, None, 0.1])]
    got = sorted((x["ord"], x["doubts"], x["released"]) for x in st.released(frame(spark, rows, "track string, t_us long, ord long, score double")).collect())
    assert [d for _, d, _ in got] == [1, 2, 0, 1, 2, 0, 1, 2, 0, 0, 1] and [o for o, _, x in got if x] == [5, 8]


def test_strikes_skip_thin_frames_and_start_anew_at_anchors(spark):
    seen = [(10, 4), (10, 4), (3, 0), (10, 2), (10, 5), (8, 1), (8, 1), (8, 1), (8, 1)]
    rows = [("v", k, k, p, i, k == 7) for k, (p, i) in enumerate(seen)]
    got = sorted((x["ord"], x["strikes"], x["doubt"]) for x in st.outside_strikes(frame(spark, rows, "key string, t_us long, ord long, people long, inside long, anchored boolean")).collect())
    assert got == [(0, 1, False), (1, 2, False), (3, 3, True), (4, 0, False), (5, 1, False), (6, 2, False), (7, 1, False), (8, 2, False)]


def test_votes_settle_and_are_overturned(spark):
    r = random.Random(4)
    rows = []
    for track in range(6):
        lean = [0.95, 0.05, 0.5, 0.9, 0.99, None][track]
        for k in range(120):
            a = r.random() < lean if lean is not None else k < 5 or k > 500
            v = r.randint(40, 99)
            rows.append((track, k, track * 1000 + k, v if a else None, None if a else v))
    rows += [(9, k, 9000 + k, 100 if k < 5 else None, None if k < 5 else 100) for k in range(400)]  # B overtakes A, at last by 97 %
    got = {x["ord"]: (x["decided"], x["confidence"]) for x in st.team_by_votes(frame(spark, rows, "track long, t_us long, ord long, a long, b long")).collect()}
    changes = 0
    for ticks in by_key(rows).values():
        votes, team, sure = [0, 0], None, None
        for _, _, o, a, b in ticks:
            votes[0] += a or 0
            votes[1] += b or 0
            total, best = sum(votes), 0 if votes[0] >= votes[1] else 1
            if total >= 400 and votes[best] > total * 0.85:
                new = "AB"[best]
                if team in (None, new) or (total > 2000 and votes[best] > total * 0.97):
                    changes += team not in (None, new)
                    team = new
                sure = votes[best] / total
            assert got[o][0] == team and got[o][1] == pytest.approx(sure)
    assert changes


def test_recovery_takes_one_clear_candidate(spark):
    base = dict(distance=0.05, appearance=0.1, ratio=1.0, same_edge=False, distinctive=False, supported=False, long=False)
    cases = [
        (1, "p", "d1", {}), (1, "p", "d2", {"distance": 0.07, "appearance": 0.15}),  # a lead of 0.075: none
        (2, "p", "d1", {}), (2, "p", "d2", {"distance": 0.079, "appearance": 0.179}),
        (3, "p", "d1", {}), (3, "q", "d1", {}),  # contested
        (4, "p", "d1", {"distance": 0.2, "same_edge": True}), (5, "p", "d1", {"distance": 0.2}),
        (6, "p", "d1", {"long": True, "distinctive": True, "distance": 9.0}), (7, "p", "d1", {"long": True}), (8, "p", "d1", {"supported": True, "appearance": 0.24}), (9, "p", "d1", {"appearance": 0.24}), (10, "p", "d1", {"ratio": 2.3}),
    ]
    names = list(base)
    rows = [(t, p, d, *({**base, **more}[n] for n in names)) for t, p, d, more in cases]
    types = {k: "double" for k in ("distance", "appearance", "ratio")}
    got = {x["t_us"] for x in st.recovery_candidates(frame(spark, rows, "t_us long, person string, detection string, " + ", ".join(f"{n} {types.get(n, 'boolean')}" for n in names))).collect()}
    assert got == {2, 4, 6, 8}


def test_three_sightings_bring_back_five_after_long(spark):
    path = [(0, 10, True, False), (300_000, 20, True, False), (600_000, 30, True, False), (1_000_000, 40, True, False), (1_300_000, 90, True, False), (1_500_000, 95, False, False), (1_600_000, 95, True, False), (1_700_000, 95, True, True), (1_800_000, 95, True, False)]
    rows = [(p, t, k, x, 5, found, cut, p == "late") for p in ("soon", "late") for k, (t, x, found, cut) in enumerate(path)]
    rows += [("late", 5_000_000 + k, 100 + k, 0, 0, True, None, True) for k in range(5)]
    got = sorted((x["person"], x["ord"], x["hits"], x["restored"]) for x in st.recovered(frame(spark, rows, "person string, t_us long, ord long, x_m long, y_m long, found boolean, cut boolean, long boolean")).collect())
    assert [h for p, _, h, _ in got if p == "soon"] == [1, 2, 3, 1, 1, 0, 1, 0, 1]
    assert [(p, o) for p, o, _, back in got if back] == [("late", 104), ("soon", 2)]


def test_size_gate(spark):
    base = dict(height=0.1, long_axis=0.1, expected=0.1, zone="inside", audience=False, official=False, tracked=False, score=0.5)
    cases = {
        "accepted None": [{}, {"expected": None, "height": 0.9}, {"height": 0.03, "long_axis": 0.07}, {"zone": "outside", "official": True}, {"height": 0.009, "long_axis": 0.009, "expected": 0.03}, {"height": 0.03, "long_axis": 0.03, "tracked": True}],
        "rejected implausible-size": [{"height": 0.23}, {"height": 0.03, "long_axis": 0.05}, {"height": 0.035, "long_axis": 0.035, "tracked": True}, {"height": 0.008, "long_axis": 0.008, "expected": 0.03}],
        "rejected audience": [{"zone": "outside", "audience": True, "official": True}], "continuation outside-pitch": [{"zone": "outside"}], "rejected low-confidence": [{"score": 0.09}],
    }
    rows = [(want, *({**base, **more}.values())) for want, made in cases.items() for more in made]
    got = st.size_gate(frame(spark, rows, "want string, height double, long_axis double, expected double, zone string, audience boolean, official boolean, tracked boolean, score double"))
    assert [(x["want"], x["verdict"], x["reason"]) for x in got.collect() if x["want"] != f"{x['verdict']} {x['reason']}"] == []


def test_officials_by_their_last_fifty_ticks(spark):
    r = random.Random(8)
    rows = []
    for i in range(5):
        for k in range([70, 50, 12, 3, 60][i]):
            known = i != 3
            speed = r.choice([None, 0.1, 1.0, 3.0])
            rows.append((i, k, i * 100 + k, r.choice(["near", "near", "far"]) if known and r.random() < 0.9 else None, r.uniform(-2, 6), None if speed is None else speed * r.random(), speed, r.random() < 0.5, r.choice([None, 0.9, 10.0, 40.0]), r.choice([None, 1.0, 2.0]), r.choice([None, -0.2, 0.8])))
    d = frame(spark, rows, "id long, t_us long, ord long, side string, metres double, along double, speed double, boundary boolean, ball_m double, formation double, moves double")
    lines = {x["id"]: x for x in st.touchline(d).collect()}
    middles = {x["id"]: x for x in st.central(d).collect()}
    for i, ticks in by_key(rows).items():
        ticks = ticks[-50:]
        n, edges = len(ticks), [t for t in ticks if t[3]]
        got = lines[i]
        if not edges:
            share = sum(t[7] for t in ticks) / n
            assert (got["score"], got["time"], got["parallel"], got["side"]) == (pytest.approx(0.7 * share), pytest.approx(share), None, None)
        else:
            corridor = [t for t in edges if -1 <= t[4] <= 4]
            sides = {}
            for t in corridor:
                sides[t[3]] = sides.get(t[3], 0) + 1
            side = max(sides, key=sides.get)
            moving = [t for t in corridor if t[6] is not None and t[6] >= 0.3]
            al, ac = sum(t[5] for t in moving), sum((t[6] ** 2 - t[5] ** 2) ** 0.5 for t in moving)
            parallel = al / (al + ac) if al + ac else None
            assert got["side"] == side and (got["parallel"] is None) == (parallel is None)
            assert got["score"] == pytest.approx(len(corridor) / n * sides[side] / len(corridor) * (0.4 + 0.6 * (0.5 if parallel is None else parallel)))
        balls, zs, ms = ([t[c] for t in ticks if t[c] is not None] for c in (8, 9, 10))
        ball = sum(b <= 25 for b in balls) / len(balls) * (1 - min(1, sum(b <= 1.5 for b in balls) / len(balls) / 0.1)) if len(balls) >= 10 else None
        shape = sum(z <= 1.3 for z in zs) / len(zs) if len(zs) >= 10 else None
        move = min(1, max(0, sum(ms) / len(ms))) if len(ms) >= 5 else None
        parts = [(v, w) for v, w in ((None if shape is None else 1 - shape, 0.5), (ball, 0.3), (None if move is None else 1 - move, 0.2)) if v is not None]
        score = sum(v * w for v, w in parts) / sum(w for _, w in parts) if parts else None
        assert middles[i]["score"] == (None if score is None else pytest.approx(score))


def test_crops_are_dense_apart_and_six_at_most(spark):
    r = random.Random(5)
    rows = [(f, f * 1000 + k, r.randrange(0, 980), r.randrange(0, 850), r.randrange(8, 40), r.randrange(40, 130), r.randrange(10, 99)) for f in range(8) for k in range([0, 1, 2, 20, 60, 120, 30, 15][f])]
    got = {}
    for x in st.refinement_crops(frame(spark, rows, "frame_idx long, ord long, bx long, by long, bw long, bh long, score long"), 1920, 1080).collect():
        got.setdefault(x["frame_idx"], []).append((x["rank"], x["x"], x["y"], x["size"]))
    for f in range(8):
        people = [p for p in rows if p[0] == f and p[6] >= 18 and p[5] < 120]
        at = lambda p: ((p[2] + p[4] / 2) * 1.92, (p[3] + p[5] / 2) * 1.08)
        dense = lambda p: sum((at(p)[0] - at(q)[0]) ** 2 + (at(p)[1] - at(q)[1]) ** 2 < (256 * 0.6) ** 2 for q in people)
        want = []
        for p in sorted(people, key=lambda p: (-dense(p), p[5], p[1])):
            if dense(p) < 2 or len(want) == 6:
                continue
            x = int(max(0, min(1920 - 256, (p[2] + p[4] / 2) * 1.92 - 128)) + 0.5)
            y = int(max(0, min(1080 - 256, (p[3] + p[5] * 0.75) * 1.08 - 128)) + 0.5)
            if all((x - a) ** 2 + (y - b) ** 2 >= (256 * 0.65) ** 2 for a, b in want):
                want.append((x, y))
        assert [(x, y) for _, x, y, _ in sorted(got.get(f, []))] == want


def test_crossings_end_two_clean_ticks_apart(spark):
    row = lambda pair, k, overlap, close=False, seen=True, clean=True, valid=True: (pair, k * 200_000, k, float(overlap), close, seen, clean, valid)
    rows = [row("plain", k, o) for k, o in enumerate([0, 0.2, 0.1, 0.0, 0.0, 0.0, 0.3, 0.0])]
    rows += [row("hidden", k, o, seen=k != 2) for k, o in enumerate([0.16, 0.1, 0.0, 0.0, 0.0])]
    rows += [row("blurred", k, o, clean=False) for k, o in enumerate([0.5, 0, 0, 0, 0, 0, 0, 0])]
    rows += [row("long", k, 0.2) for k in range(33)] + [row("long", 33, 0.0), row("long", 34, 0.0)]
    rows += [row("lost", k, o, valid=k != 1) for k, o in enumerate([0.2, 0.2, 0.0, 0.0])]
    rows += [row("close", k, 0.0, close=k < 2) for k in range(4)]
    d = frame(spark, rows, "pair string, t_us long, ord long, overlap double, close boolean, seen boolean, clean boolean, valid boolean")
    got = sorted((x["pair"], x["start_us"] // 200_000, x["end_us"] // 200_000, x["hard"], x["outcome"]) for x in st.crossings(d).collect())
    assert got == [
        ("blurred", 0, 6, True, "separated"), ("close", 0, 3, False, "separated"), ("hidden", 0, 4, True, "separated"), ("long", 0, 31, False, "unjudged"), ("long", 31, 34, False, "separated"), ("plain", 1, 4, False, "separated"),
    ]
    cases = [(-0.6, 9.0, False, "swap"), (-0.3, 3.0, False, "swap"), (-0.3, 5.0, False, "doubt"), (None, 1.0, False, "doubt"), (None, 5.0, True, "doubt"), (None, 5.0, False, "keep"), (0.1, -1.0, False, "doubt"), (0.3, -9.0, True, "keep")]
    v = spark.createDataFrame(cases, "look double, path double, hard boolean, want string").withColumn("got", st.crossing_verdict(F.col("look"), F.col("path"), F.col("hard")))
    assert all(x["want"] == x["got"] for x in v.collect())


def test_look_alikes_were_never_together(spark):
    scores = spark.createDataFrame([("v", 1, 2, 0.99), ("v", 1, 3, 0.95), ("v", 2, 3, 0.92), ("v", 4, 5, 0.94), ("v", 4, 6, 0.96), ("v", 5, 6, 0.97), ("w", 7, 8, 0.93)], "video string, a long, b long, cos double")
    got = st.look_alikes(scores, spark.createDataFrame([(1, 2), (1, 2)], "a long, b long"), "video").collect()
    assert sorted((x["a"], x["b"]) for x in got) == [(1, 3), (4, 6), (5, 6), (7, 8)]


def test_special_roles_need_a_lead(spark):
    def kit(*peaks):
        return [1.0 if k == p else 0.0 for p in peaks for k in range(50)]

    half = [0.5 if k in (1, 2) else 0.0 for k in range(50)]
    people = [("v", 1, kit(1, 1, 1)), ("v", 2, kit(1, 1, 2)), ("v", 3, kit(9, 9, 9)), ("v", 4, half + kit(1, 1)), ("v", 5, [0.1]), ("w", 1, kit(1, 1, 1)), ("v", 6, None)]
    examples = [("v", "REFEREE", kit(1, 1, 1)), ("v", "REFEREE", kit(1, 1, 1)), ("v", "GOALKEEPER_A", kit(2, 1, 2)), ("v", "BROKEN", [1.0])]
    schema = "video string, {} kit array<double>"
    got = {(x["video"], x["key"]): (x["role"], x["cost"]) for x in st.special_role(frame(spark, people, schema.format("key long,")), frame(spark, examples, schema.format("role string,"))).collect()}
    assert got["v", 1] == ("REFEREE", 0.0) and got["v", 2][0] is None and got["v", 2][1] == pytest.approx(0.15) and got["v", 3][0] is None
    assert got["v", 4][0] is None and got["v", 5] == (None, None) and got["w", 1] == (None, None) and got["v", 6] == (None, None)


def test_records_of_registration_motion_and_candidates(spark, tmp_path):
    flat, nested = [1, 0, 0.5, 0, 1, 0, 0, 0, 1], [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    for run, frames in {"a": [{"motion": [1, 2, 3, 4, 5, 6], "cameraReliable": True, "cut": False}, {"motion": None, "cameraReliable": True, "cut": True}], "b": [{"motion": None}, {}]}.items():
        (tmp_path / run).mkdir()
        boxes = [{"box": [0.1, 0.1, 0.1, 0.1], "det": 0.6, "status": "ball"}, {"box": [0.2, 0.1, 0.1, 0.1], "det": 0.7, "reason": "SIZE"}, {"box": [0.3, 0.1, 0.1, 0.1], "det": 0.4}, {"box": [0.4, 0.1, 0.1, 0.1], "det": 0.5, "reason": ""}]
        frames = [{"time": k / 25, "frame": k, "ballCandidates": boxes, "ball": {"state": "TRACKED", "observed": True, "box": [0, 0, 1, 1], "visual": 0.8}, **f} for k, f in enumerate(frames)]
        (tmp_path / run / "result.json").write_text(json.dumps({"frames": frames}))
    (tmp_path / "a" / "registration.json").write_text(json.dumps({"anchors": [{"index": 3, "time": 0.1, "H": flat, "observability": 0.9, "source": "user", "details": {"n": 4}}, {"index": 5, "time": 0.2, "H": nested, "observability": 0.5, "source": "auto", "root": 3}], "frames": [{"t": 0.0, "dt": 0.0, "M": None, "reliable": False, "cut": True}, {"t": 0.04, "dt": 0.04, "M": nested, "reliable": True, "cut": False, "quality": "good"}, {"t": 0.08, "dt": 0.04, "M": [1, 2], "reliable": True, "cut": False, "quality": ""}]}))
    a = sorted(result.registration_anchors(spark, str(tmp_path)).collect(), key=lambda x: x["index"])
    assert [(x["run"], x["index"], x["root"], x["H"][2], x["details"]) for x in a] == [("a", 3, 3, 0.5, '{"n":4}'), ("a", 5, 3, 0.0, "{}")]
    log = sorted(result.registration_log(spark, str(tmp_path)).collect(), key=lambda x: x["frame_idx"])
    assert [(x["M"] is not None, x["reliable"], x["cut"], x["quality"]) for x in log] == [(False, False, True, "none"), (True, True, False, "good"), (False, True, False, "none")]
    motion = sorted(result.recorded_motion(spark, str(tmp_path)).collect(), key=lambda x: x["frame_idx"])
    assert [(x["run"], x["M"], x["reliable"], x["cut"]) for x in motion] == [("a", [1, 2, 3, 4, 5, 6, 0, 0, 1], True, False), ("a", None, False, True)]
    n = result.ball_negatives(spark, str(tmp_path)).where("run = 'a'").collect()
    assert sorted((x["frame_idx"], x["reason"], x["det"]) for x in n) == [(0, "SIZE", 0.7), (0, "candidate", 0.5), (0, "positives", 0.8)]


def test_empty_tables_and_clashing_names(spark):
    d = spark.createDataFrame([], "track long, t_us long, ord long, marks boolean, clear boolean, n long, start long")
    assert st.non_targets(d).count() == 0 and st.non_targets(d).columns[-2:] == ["ignored", "streak"]
    g = st.sampling_grid(spark.createDataFrame([("a", 0, 250_000)], "key string, start_us long, end_us long"), spark.createDataFrame([("a", 100_000), ("a", 130_000), ("a", 130_000), ("a", 300_000), ("b", 1)], "key string, t_us long"))
    assert sorted(x["t_us"] for x in g.collect()) == [0, 100_000, 130_000, 200_000]
    assert g.select(F.max("t_us")).first()[0] == 200_000
