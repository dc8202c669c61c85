"""Timelines of homographies, polygons and calibration: known cases, and loops over single matrices."""

import math
import random

import numpy as np
import pytest
from fieldtrace.functions import planes, polygons
from fieldtrace.functions.pitch import landmarks
from fieldtrace.operators import calibration, timeline
from pyspark.sql import functions as F

W, H = 1280.0, 720.0
GROUND = np.array([(0, 0), (105, 0), (105, 68), (0, 68)], float)
CAMERA = planes.oriented(planes.solved(GROUND, np.array([(200, 150), (1080, 150), (1580, 650), (-300, 650)], float))[None], W, H)[0]
#: Looks along the pitch, with the horizon in the picture.
END_CAMERA = planes.oriented(planes.solved(GROUND, np.array([(-0.3 * W, 1.4 * H), (0.52 * W, 0.300 * H), (0.528 * W, 0.303 * H), (1.5 * W, 1.6 * H)]))[None], W, H)[0]
LOG = "run long, frame_idx long, t_us long, dt_us long, m array<double>, reliable boolean, cut boolean, quality string"
ANCHOR = "run long, frame_idx long, ord long, h array<double>, observability double, source string"


def shift(x):
    return np.array([[1, 0, x], [0, 1, 0], [0, 0, 1]], float)


def log(run, n, x=5.0, cut=None, quality="flow", still=()):
    return [(run, i, i * 40_000, 40_000, None if i in still else shift(x).ravel().tolist(), True, i == cut, "none" if i in still else quality) for i in range(n)]


def anchor(run, i, observability=0.8, off=0.0, x=5.0, source="landmarks"):
    return (run, i, i, (shift(off) @ np.linalg.matrix_power(shift(x), i) @ CAMERA).ravel().tolist(), observability, source)


RUNS = [
    (log(0, 40, cut=10), [anchor(0, 25)]), (log(1, 20), [anchor(1, 10, 0.2)]), (log(2, 20), [anchor(2, 10, 0.9)]), (log(3, 40), [anchor(3, 5), anchor(3, 35)]), (log(4, 40), [anchor(4, 5), anchor(4, 35, 0.6, 60.0, source="paint")]),
    (log(5, 60), [anchor(5, 0)]), (log(6, 60, quality="coarse"), [anchor(6, 0)]), (log(7, 30, still=range(10, 20)), [anchor(7, 0)]), (log(8, 30, still=range(10, 13)), [anchor(8, 0)]), (log(9, 5), []),
    (log(10, 50, cut=30), [anchor(10, 3, 0.3), anchor(10, 12, 0.9), anchor(10, 13, 0.1), (10, 12, 99, *anchor(10, 12, 0.9, 7.0)[3:]), anchor(10, 40, 0.5)]),
]


@pytest.fixture(scope="module")
def lines(spark):
    logs, anchors = (spark.createDataFrame([r for run in RUNS for r in run[k]], s) for k, s in ((0, LOG), (1, ANCHOR)))
    out = {}
    for r in timeline.timeline(logs.repartition(5), anchors, W, H).orderBy("run", "frame_idx").collect():
        out.setdefault(r["run"], []).append(r)
    return out


def walked(log, anchors):
    """One frame after the other, both ways, with single matrices."""
    best = {}
    for a in anchors:
        if a[1] not in best or a[4] > best[a[1]][4]:
            best[a[1]] = a
    sure = lambda t, a: max(0.0, t) * (0.25 + 0.75 * a[4])
    ways = []
    for forward in (True, False):
        state, out = None, {}
        for i in range(len(log)) if forward else range(len(log) - 1, -1, -1):
            if state:
                step = log[i] if forward else log[i + 1]
                h, t, still, a = state
                if step[6]:
                    state = None
                elif step[4] is None:
                    state = (h, t - 0.5 * step[3] / 1e6, still + 1, a) if still < 3 else None
                else:
                    m = np.array(step[4]).reshape(3, 3)
                    state = ((m if forward else np.linalg.inv(m)) @ h, t - (0.12 if step[7] == "coarse" else 0.03) * step[3] / 1e6, 0, a)
            if i in best and (state is None or sure(1.0, best[i]) >= sure(state[1], state[3])):
                state = (np.array(best[i][3]).reshape(3, 3), 1.0, 0, best[i])
            if state and sure(state[1], state[3]) < 0.05:
                state = None
            out[i] = state
        ways.append(out)
    return ways, sure


def apart(a, b):
    """Median over the grid points that both see and the first puts on the pitch, point by point."""
    ia, ib = np.linalg.inv(a), np.linalg.inv(b)
    all_, on = [], []
    for x, y in planes.GRID * [W, H]:
        p, q = ia @ [x, y, 1], ib @ [x, y, 1]
        if p[2] > 1e-9 and q[2] > 1e-9:
            p, q = p[:2] / p[2], q[:2] / q[2]
            all_.append(math.hypot(*(p - q)))
            if -5 <= p[0] <= 110 and -5 <= p[1] <= 73:
                on.append(all_[-1])
    return float(np.median(on if len(on) >= 4 else all_))


@pytest.mark.parametrize("run", range(len(RUNS)))
def test_timeline_equals_a_walk(lines, run):
    (f, b), sure = walked(*RUNS[run])
    for i, r in enumerate(lines[run]):
        one, two = f[i], b[i]
        if one and two and one[3] is two[3]:
            two = None
        if not one and not two:
            assert (r["source"], r["h"], r["confidence"]) == ("none", None, 0.0)
            continue
        if one and two:
            ca, cb, d = sure(one[1], one[3]), sure(two[1], two[3]), apart(one[0], two[0])
            w = ca / (ca + cb)
            h = w * one[0] / np.linalg.norm(one[0]) + (1 - w) * two[0] / np.linalg.norm(two[0])
            assert (r["source"], r["direction"]) == ("interpolated", "both") and r["disagreement"] == pytest.approx(d, abs=0.006)
            assert r["confidence"] == pytest.approx(max(ca, cb) * math.exp(-d / 8), abs=0.001) and r["anchor"] == (one if w >= 0.5 else two)[3][1]
        else:
            h, t, _, a = one or two
            assert r["confidence"] == pytest.approx(sure(t, a), abs=0.001) and (r["anchor"], r["observability"]) == (a[1], a[4])
            assert (r["source"], r["direction"]) == ((a[5], None) if a[1] == i else ("carried", "forward" if one else "backward"))
            assert r["age"] == pytest.approx(abs(i - a[1]) * 0.04)
        assert np.allclose(np.array(r["h"]) / np.linalg.norm(r["h"]), h.ravel() / np.linalg.norm(h), atol=1e-9)


def test_timeline_known_cases(lines):
    assert all(r["source"] == "none" for r in lines[0][:10]) and lines[0][12]["direction"] == "backward" and lines[0][33]["direction"] == "forward"
    assert lines[1][10]["confidence"] < 0.45 and lines[2][10]["confidence"] > 0.9
    assert lines[3][20]["disagreement"] < 0.3 and lines[4][20]["disagreement"] > 2 and lines[4][20]["confidence"] < lines[3][20]["confidence"] - 0.15
    assert lines[6][59]["confidence"] < lines[5][59]["confidence"]
    assert lines[7][12]["source"] == "carried" and lines[7][13]["source"] == "none" and lines[8][29]["source"] == "carried"
    centre = planes.moved(np.array(lines[0][31]["h"]).reshape(1, 3, 3), np.array([(52.5, 34.0)]))[0, 0]
    assert np.allclose(centre, planes.moved((np.linalg.matrix_power(shift(5.0), 31) @ CAMERA)[None], np.array([(52.5, 34.0)]))[0, 0])


def test_anchors_left_out_equal_timelines_without_them(spark):
    logs, anchors = (spark.createDataFrame([r for run in RUNS for r in run[k]], x) for k, x in ((0, LOG), (1, ANCHOR)))
    got = {(r["run"], r["frame_idx"]): r for r in timeline.held_out(logs.repartition(3), anchors, W, H).collect()}
    want = {}
    for log_, own in RUNS:
        for frame in {a[1] for a in own}:
            best = max((a for a in own if a[1] == frame), key=lambda a: (a[4], -a[2]))
            (f, b), sure = walked(log_, [a for a in own if a[1] != frame])
            ways = [w[frame] for w in (f, b) if w[frame]]
            if len(ways) == 2:
                w = sure(ways[0][1], ways[0][3]) / (sure(ways[0][1], ways[0][3]) + sure(ways[1][1], ways[1][3]))
                h = w * ways[0][0] / np.linalg.norm(ways[0][0]) + (1 - w) * ways[1][0] / np.linalg.norm(ways[1][0])
            want[log_[0][0], frame] = apart(np.array(best[3]).reshape(3, 3), h if len(ways) == 2 else ways[0][0]) if ways else None
    assert got.keys() == want.keys()
    for key, metres in want.items():
        assert got[key]["metres"] == (None if metres is None else pytest.approx(metres, abs=1e-6))
    assert want[3, 5] < 0.01 and want[4, 5] > 2 and want[2, 10] is None


def test_gaps_are_filled_backwards_while_that_is_sure(spark):
    rows = []
    for run, (conf, cut) in enumerate(((0.9, None), (0.352, None), (0.9, 5), (0.9, None))):
        for i in range(10):
            h = (np.linalg.matrix_power(shift(5.0), i) @ CAMERA).ravel().tolist() if i >= 7 else None
            if run == 3:
                h = (np.diag([1.0, -1, 1]) @ CAMERA).ravel().tolist() if i >= 7 else None  # no view of a pitch
            rows.append((run, i, 40_000, shift(5.0).ravel().tolist(), True, i == cut, h, conf if h else 0.0))
    df = spark.createDataFrame(rows, "run long, frame_idx long, dt_us long, m array<double>, reliable boolean, cut boolean, h array<double>, confidence double")
    got = {(r["run"], r["frame_idx"]): r for r in timeline.propagated(df.repartition(3), W, H).collect()}
    assert [i for i in range(10) if got[0, i]["filled"]] == list(range(7)) and got[0, 0]["confidence"] == pytest.approx(0.9 - 7 * 0.0012)
    assert np.allclose(np.array(got[0, 2]["h"]).reshape(3, 3), np.linalg.matrix_power(shift(5.0), 2) @ CAMERA)
    assert [i for i in range(10) if got[1, i]["filled"]] == [6] and [i for i in range(10) if got[2, i]["filled"]] == [5, 6]
    assert not any(got[3, i]["filled"] for i in range(10))


def test_ball_gaps_are_bridged_when_short_slow_and_of_one_track(spark):
    ball = lambda run, i, x, track=1: (run, i, i * 100_000, "TRACKED", track, x, 0.5, 0.9)
    rows = [ball(0, 0, 0.1), ball(0, 4, 0.2), ball(1, 0, 0.1), ball(1, 6, 0.2), ball(2, 0, 0.1), ball(2, 3, 0.9), ball(3, 0, 0.1), ball(3, 3, 0.2, 2)]
    known = {(r[0], r[1]) for r in rows}
    rows += [(run, i, i * 100_000, "UNKNOWN", None, None, None, 0.0) for run in range(4) for i in range(7) if (run, i) not in known]
    got = timeline.bridged_ball(spark.createDataFrame(rows, "run long, frame_idx long, t_us long, state string, track long, x double, y double, confidence double")).where("source = 'INTERPOLATED'").orderBy("frame_idx").collect()
    assert [(r["run"], r["frame_idx"], round(r["x"], 6), r["confidence"]) for r in got] == [(0, 1, 0.125, 0.72), (0, 2, 0.15, 0.72), (0, 3, 0.175, 0.72)]


# Polygons


def tuples(points):
    return None if points is None else [(p["x"], p["y"]) for p in points]


def chain_hull(points):
    """Hull by walking around: from each corner to the point that all others are left of."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    out, at = [], pts[0]
    while True:
        out.append(at)
        nxt = next(p for p in pts if p != at)
        for p in pts:
            turn = (nxt[0] - at[0]) * (p[1] - at[1]) - (nxt[1] - at[1]) * (p[0] - at[0])
            if p != at and (turn < -1e-12 or (abs(turn) <= 1e-12 and math.dist(at, p) > math.dist(at, nxt))):
                nxt = p
        at = nxt
        if at == pts[0]:
            return out


def cut(points, f):
    out = []
    for p, q in zip(points, points[1:] + points[:1], strict=True):
        if f(p) >= 0:
            out.append(p)
        if (f(p) >= 0) != (f(q) >= 0):
            t = f(p) / (f(p) - f(q))
            out.append((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))
    return out


def seen(h):
    """The view polygon with plain numbers."""
    inv = np.linalg.inv(h)
    depth = lambda p: float(inv[2] @ [*p, 1.0])
    corners = [(0.0, 0.0), (W, 0.0), (W, H), (0.0, H)]
    if min(map(depth, corners)) <= 0:
        level = 0.02 * max(map(depth, corners))
        corners = cut(corners, lambda p: depth(p) - level)
    ground = [tuple((inv @ [*p, 1.0])[:2] / depth(p)) for p in corners]
    for f in (lambda p: p[1] + 5, lambda p: 110 - p[0], lambda p: 73 - p[1], lambda p: p[0] + 5):
        ground = cut(ground, f)
    return [(x / 105, y / 68) for x, y in ground]


def test_hulls_clips_and_areas_equal_loops(spark):
    r = random.Random(3)
    sets = [[(float(r.randint(0, 6)), float(r.randint(0, 6))) for _ in range(r.randint(0, 14))] for _ in range(60)] + [[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], [(1.0, 1.0)] * 3]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "k int, p array<struct<x: double, y: double>>")
    hull = polygons.hull(F.col("p"))
    a, b, keep = (polygons.point(float(x), float(y)) for x, y in ((1, 0), (5, 6), (0, 5)))
    rows = df.select("k", hull.alias("hull"), polygons.area(hull).alias("area"), polygons.centroid(hull).alias("c"), polygons.clipped_to_side(hull, a, b, keep).alias("cut"), polygons.distance(hull, polygons.point(2.5, 3.1)).alias("d")).collect()
    for r_ in rows:
        want = chain_hull(sets[r_["k"]])
        if len(want) < 3 and len(set(sets[r_["k"]])) >= 3:
            want = [want[0], want[-1]]
        assert tuples(r_["hull"]) == want
        assert r_["area"] == pytest.approx(abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(want, want[1:] + want[:1], strict=True))) / 2)
        side = lambda p: 4 * p[1] - 6 * (p[0] - 1)
        assert np.allclose(tuples(r_["cut"]) or np.zeros((0, 2)), cut(want, side) or np.zeros((0, 2)))
        assert (r_["c"] is None) == (not want)


def test_views_equal_loops_and_stop_at_the_horizon(spark):
    cameras = [CAMERA, END_CAMERA, shift(300.0) @ CAMERA, shift(-900.0) @ CAMERA, None, np.zeros((3, 3))]
    df = spark.createDataFrame([(k, None if c is None else c.ravel().tolist()) for k, c in enumerate(cameras)], "k int, h array<double>")
    view = polygons.view(F.col("h"), W, H)
    spot = lambda x, y: polygons.inside(view, polygons.point(x, y))
    rows = df.select("k", view.alias("v"), spot(0.5, 0.5).alias("centre"), spot(1.0, 0.5).alias("goal"), spot(1.3, 0.5).alias("beyond")).orderBy("k").collect()
    for r, c in zip(rows[:4], cameras, strict=False):
        assert np.allclose(tuples(r["v"]), seen(c), atol=6e-5)
    assert rows[0]["centre"] and not rows[0]["beyond"] and not rows[1]["goal"] and rows[4]["v"] is None and rows[5]["v"] is None


# Calibration


def test_cameras_are_recovered_and_a_wrong_landmark_is_left_out(spark):
    marks = landmarks(spark, 105.0, 68.0)
    names = {r["name"]: (r["lx"], r["ly"]) for r in marks.collect()}
    wide = ["corner-far-left", "corner-far-right", "halfway-far", "halfway-near", "centre-spot", "left-penalty-box-front-far", "right-penalty-box-front-near"]
    px = lambda n: planes.moved(CAMERA[None], np.array([names[n]]))[0, 0]
    rows = [(0, n, *px(n)) for n in wide] + [(1, n, *(px(n) + ([180.0, 90.0] if n == "centre-spot" else [0, 0]))) for n in wide]
    rows += [(2, n, *px(n)) for n in wide[:3]] + [(3, n, *px(n)) for n in ("halfway-far", "centre-circle-far", "centre-spot", "centre-circle-near", "halfway-near")]
    rows += [(4, n, W - px(n)[0], px(n)[1]) for n in wide] + [(0, "no such mark", 1.0, 1.0)]
    points = spark.createDataFrame([(k, n, float(x), float(y)) for k, n, x, y in rows], "keyframe long, name string, x double, y double")
    got = {r["keyframe"]: r for r in calibration.solved(points, marks).collect()}
    for k in (0, 1):
        back = np.array(got[k]["h"]).reshape(1, 3, 3)
        assert np.allclose(planes.moved(back, np.array([px(n) for n in wide]))[0], [names[n] for n in wide], atol=1e-6) and got[k]["problem"] is None
    assert got[0]["outliers"] == [] and got[1]["outliers"] == ["centre-spot"] and got[1]["rms"] < 1e-6
    assert [got[k]["problem"] for k in (2, 3, 4)] == ["too few landmarks", "landmarks on one line", "mirrored"]
    assert calibration.solved(points.where("false"), marks).count() == 0


def test_observability_needs_both_axes(spark):
    marks = {r["name"]: (r["lx"], r["ly"]) for r in landmarks(spark, 105.0, 68.0).collect()}
    seen_ = lambda ns: [(*map(float, planes.moved(CAMERA[None], np.array([marks[n]]))[0, 0]), *marks[n]) for n in ns]
    circle = [tuple(map(float, planes.moved(CAMERA[None], np.array([(52.5 + 9.15 * math.cos(a), 34 + 9.15 * math.sin(a))]))[0, 0])) for a in np.linspace(0, 2 * math.pi, 48)]
    back = np.linalg.inv(CAMERA).ravel().tolist()
    wide = ["corner-far-left", "corner-far-right", "halfway-far", "halfway-near", "centre-spot", "left-penalty-box-front-far", "right-penalty-box-front-near"]
    rows = [
        (0, seen_(wide), None, None, None, 0.2, None, None), (1, seen_(["halfway-far", "centre-circle-far", "centre-spot", "centre-circle-near", "halfway-near"]), None, None, None, 0.2, None, None),
        (2, None, ["far touchline", "near touchline"], None, None, None, None, None), (3, None, ["far touchline", "near touchline", "halfway line", "left penalty area front"], None, None, None, None, None),
        (4, None, ["far touchline", "halfway line"], None, None, None, None, None), (5, None, ["far touchline", "halfway line"], circle, back, None, None, None),
        (6, None, ["far touchline", "near touchline", "halfway line", "left penalty area front"], None, None, None, None, 1e6), (7, None, None, None, None, None, None, None),
    ]
    schema = "k int, marks array<struct<x: double, y: double, lx: double, ly: double>>, lines array<string>, circle array<struct<x: double, y: double>>, back array<double>, rms_m double, rms_px double, condition double"
    s = [r["score"] for r in calibration.observability(spark.createDataFrame(rows, schema), W, H).orderBy("k").collect()]
    assert s[0] > 0.7 and s[1] < 0.15 and s[2] <= 0.1 and s[3] > 0.7 and s[5] > s[4] + 0.3 and s[3] > s[6] + 0.5 and s[7] == 0


def test_frames_are_not_broadcast(spark, data):
    """Spark takes frames for as few as the videos; sent through the driver they would fill its memory."""
    from fieldtrace.operators import balltrack
    from fieldtrace.plans import balls

    f = balls.frames(spark, data)
    some = f.select("run", "frame_idx").where("frame_idx % 7 = 1")
    for df in (some.join(f, ["run", "frame_idx"]), some.join(balltrack.camera(f), ["run", "frame_idx"])):
        assert len(df.collect())
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_single_matrices_as_arrays_of_one():
    r = np.random.default_rng(4)
    for _ in range(300):
        a, b = r.normal(size=(2, 9))
        if r.random() < 0.1:
            a[6:] = a[3:6]
        m = a.reshape(1, 3, 3)
        back, seen = planes.inverses(m)[0], planes.oriented(m, 1280.0, 720.0)[0]
        if abs(np.linalg.det(m[0])) > 1e-12:
            assert np.allclose(planes.undone(a.tolist()), back.ravel()) and planes.faced(a.tolist(), 1280.0, 720.0) == seen.ravel().tolist()
        else:
            assert planes.faced(a.tolist(), 1280.0, 720.0) is None and np.isnan(seen).all()
        assert np.allclose(planes.product(a.tolist(), b.tolist()), (m[0] @ b.reshape(3, 3)).ravel())
    assert planes.undone([0.0] * 9) is None and planes.undone([float("nan")] * 9) is None and planes.faced([float("nan")] * 9, 1.0, 1.0) is None


def test_distances_as_the_column_expression(spark):
    from fieldtrace.operators import viewing

    r = random.Random(7)
    shapes = [[(r.uniform(0, 30) + 40 * math.cos(t), r.uniform(0, 30) + 40 * math.sin(t)) for t in sorted(r.uniform(0, 6.28) for _ in range(n))] for n in (3, 4, 7, 3, 12)]
    points = [[(r.uniform(-60, 90), r.uniform(-60, 90)) for _ in range(40)] for _ in shapes]
    got = viewing.distances([np.array([p[0] for p in s]) for s in shapes] + [np.empty(0)], [np.array([p[1] for p in s]) for s in shapes] + [np.empty(0)], *(np.array([[p[k] for p in q] for q in [*points, points[0]]]) for k in (0, 1)))
    df = spark.createDataFrame([(i, j, s, p) for i, (s, q) in enumerate(zip(shapes, points, strict=True)) for j, p in enumerate(q)], "i long, j long, s array<struct<x: double, y: double>>, p struct<x: double, y: double>")
    want = {(x.i, x.j): x.d for x in df.select("i", "j", polygons.distance(F.col("s"), F.col("p")).alias("d")).collect()}
    assert all(math.isclose(got[k], d, rel_tol=1e-12, abs_tol=1e-12) for k, d in want.items()) and np.isnan(got[-1]).all()


def test_unseen_people_stream_by(spark):
    """Against a loop over all people of a frame; a person is unknown from the run's first frame on, over small batches too."""
    from fieldtrace.operators import viewing

    r = random.Random(9)
    frames = [(run, f) for run in range(3) for f in range(run, 60)]
    seen = {(run, f, f"p{k}"): (r.uniform(0, 105), r.uniform(0, 68)) for run, f in frames for k in range(4) if r.random() < (0.08 if f > 10 * k else 0) and (run, k) != (2, 3)}
    views = {at: [(a, 0.0), (a + 40.0, 0.0), (a + 40.0, 68.0), (a, 68.0)] for at in frames if r.random() < 0.8 for a in [r.uniform(-20, 70)]}
    want: dict = {}
    for run, i in sorted({(k[0], k[2]) for k in seen}):
        last = None
        for f in (f for own, f in frames if own == run):
            if (run, f, i) in seen:
                last = (f, *seen[run, f, i])
                continue
            c = "U"
            if last and (run, f) in views and (f - last[0]) * 0.5 <= 10:
                (a, _), (b, _) = views[run, f][:2]
                inside = a <= last[1] <= b
                edge = min(abs(last[1] - a), abs(last[1] - b), last[2], 68 - last[2]) if inside else min(abs(last[1] - a), abs(last[1] - b))
                sigma = max(1.0, 2 + 1.5 * (f - last[0]) * 0.5)
                c = "C" if inside and edge >= sigma else "S" if not inside and edge >= sigma else "U"
            want[run, i, c] = want.get((run, i, c), 0) + 1
    f = spark.createDataFrame(frames, "run long, frame_idx long")
    s = spark.createDataFrame([(*k, *v) for k, v in seen.items()], "run long, frame_idx long, id string, x double, y double")
    v = spark.createDataFrame([(*k, [p[0] for p in q], [p[1] for p in q]) for k, q in views.items()], "run long, frame_idx long, vx array<double>, vy array<double>")
    for rows in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            out = viewing.unseen(f, s, v, 0.5).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {(x["run"], x["id"], x["class"]): x["frames"] for x in out} == want
    assert {k[2] for k in want} == {"C", "S", "U"}


def test_view_classes_make_no_row_for_a_person_and_a_frame(spark, data):
    from fieldtrace.queries import QUERIES

    plan = QUERIES["view_classes_by_frame"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join Inner, (run" in x and "AND" not in x]
