"""The ball's trajectory: known paths in one table of many runs, and the decoder against enumeration."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from fieldtrace.operators import balltrack as bt

W, H, FPS, PXM = 1280, 720, 25.0, 40.0
CANDIDATE = "run long, frame_idx long, ord long, x double, y double, w double, h double, det double, status string, reason string, tracklet long, pxm double, visual double, size double, shape double, isolation double, field double, line double, attach double, static double, other boolean, pitch_x double, pitch_y double"
FRAME = "run long, frame_idx long, t_us long, m array<double>, reliable boolean, cut boolean"
PERSON = "run long, frame_idx long, track long, bx double, by double, bw double, bh double"


class Scene:
    """Frames of one run: balls, other things and players."""

    def __init__(self, n, pan=0.0):
        self.n, self.pan, self.things, self.people = n, pan, [], []

    def ball(self, i, x, y, det=0.6):
        return self.thing(i, x, y, det, "ball", None, 1)

    def thing(self, i, x, y, det=0.6, status="candidate", reason=None, tracklet=None):
        self.things.append((i, x, y, det, status, reason, tracklet))
        return self

    def person(self, i, track, x, y, h=72.0):
        self.people.append((i, track, x - h * 0.19, y - h, h * 0.38, h))
        return self


def rolling():
    s = Scene(40)
    for i in range(40):
        if not 15 <= i < 21:
            s.ball(i, 300 + 8 * i, 400 + 2 * i)
    return s


def boot():
    s = Scene(60)
    for i in range(60):
        s.person(i, 1, 700, 500).person(i, 2, 940 - i, 500)
        if i < 15:
            s.ball(i, 520 + 12 * i, 500)
        elif i >= 30:
            s.ball(i, 700 + 5 * (i - 30), 500)
        if 18 <= i < 28:
            s.thing(i, 934 - 2 * i + i, 496, 0.7, "ball", None, 7)
    return s


def visible_pass():
    s = Scene(50)
    for i in range(50):
        s.person(i, 1, 400, 500).person(i, 2, 900, 500)
        s.ball(i, *((408, 496) if i < 10 else (408 + 484 * (i - 10) / 25, 480) if i < 35 else (892, 496)))
    return s


def foot_teleport():
    s = Scene(50)
    for i in range(50):
        s.person(i, 1, 400, 500).person(i, 2, 720, 500)
        if 20 <= i < 25:
            s.ball(i, 714, 496)
        elif not 25 <= i < 28:
            s.ball(i, 408 + i % 3, 496)
    return s


def resting():
    s = Scene(50)
    for i in range(50):
        s.ball(i, 640, 420)
    return s.thing(30, 200, 300, 0.9, tracklet=9)


def panned():
    s = Scene(20, pan=-30.0)
    for i in range(20):
        s.ball(i, 640 - 30 * i, 420)
    return s


def hidden_at_player():
    s = Scene(160)
    for i in range(160):
        s.person(i, 1, 304, 406)
        if i <= 50:
            s.ball(i, 300, 400)
        elif i > 110:
            s.ball(i, 303 + 10 * (i - 111), 396 - 3 * (i - 111))
        elif 60 <= i <= 108:
            s.thing(i, 860, 520, 0.35, "rejected", "JUMP", 100)
    return s


def stayed():
    s = Scene(220)
    for i in range(220):
        if i <= 30:
            s.ball(i, 500, 300)
        elif i > 140:
            s.ball(i, 502 + 6 * (i - 140), 301 + (i - 140))
        elif i > 100:
            s.ball(i, 502, 301)
    return s


def two_things():
    s = Scene(120)
    for i in range(120):
        if i <= 30:
            s.ball(i, 300, 400)
        elif i >= 56:
            s.thing(i, 860, 520 + 1.2 * (i - 56), 0.7, tracklet=7)
    return s


def fast():
    s = Scene(60)
    for i in range(60):
        if not 25 <= i < 33:
            s.ball(i, 100 + 24 * i, 400 - 2 * i)
    return s


def stops():
    s = Scene(120)
    for i in range(120):
        s.ball(i, *((200 + 8 * i, 400) if i < 40 else (520, 400) if i < 80 else (520 + 5 * (i - 80), 400 - 2 * (i - 80))))
    return s


def still_thing():
    s = Scene(80)
    for i in range(80):
        if i < 50:
            s.thing(i, 700, 300, 0.9, *(("rejected", "OTHER_OBJECT") if i >= 10 else ("candidate", None)), 5)
        if i >= 30:
            s.ball(i, 100 + 6 * (i - 30), 500, 0.12 if i == 40 else 0.6)
    return s


def lone():
    return Scene(30).thing(12, 500, 400, 0.95, tracklet=3)


SCENES = [rolling, boot, visible_pass, foot_teleport, resting, panned, hidden_at_player, stayed, two_things, fast, stops, still_thing, lone]


@pytest.fixture(scope="module")
def told(spark):
    candidates, frames, people = [], [], []
    for run, make in enumerate(SCENES):
        s = make()
        frames += [(run, i, i * 40_000, [1.0, 0.0, s.pan, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], True, False) for i in range(s.n)]
        people += [(run, *p) for p in s.people]
        for ord_, (i, x, y, det, status, reason, tracklet) in enumerate(s.things):
            candidates.append((run, i, ord_, float(x), float(y), 8.0, 8.0, det, status, reason, tracklet, PXM, None, 0.9, 0.8, 0.9, 1.0, 0.0, 0.0, 0.0, False, None, None))
    c, f, p = spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(frames, FRAME), spark.createDataFrame(people, PERSON)
    path, reviews = bt.trajectory(bt.nodes(c, p, f, FPS, H), FPS)
    shown = bt.told(path, f, FPS, W, H)
    rows = {}
    for r in shown.orderBy("run", "frame_idx").collect():
        rows.setdefault(SCENES[r["run"]].__name__, []).append(r)
    t = f.select("run", "frame_idx", "t_us")
    jumps = {SCENES[r["run"]].__name__: r for r in bt.shown_jumps(shown.join(t, ["run", "frame_idx"]), p, W, H).collect()}
    reviewed = {}
    for r in reviews.collect():
        reviewed.setdefault(SCENES[r["run"]].__name__, []).append(r)
    runs = {SCENES[r["run"]].__name__: r["count"] for r in bt.runs_of(path).groupBy("run").count().collect()}
    return rows, reviewed, runs, jumps


def states(rows, a=0, b=None):
    return {r["state"] for r in rows[a:b]}


def test_gaps_are_bridged_on_the_line(told):
    rows, _, runs, jumps = told
    r = rows["rolling"]
    assert states(r, 15, 21) == {"MISSING"} and states(r[:15] + r[21:]) == {"TRACKED"} and runs["rolling"] == 1
    assert abs(r[18]["x"] * W - 444) < 3 and jumps["rolling"]["teleports"] == 0
    r = rows["fast"]
    assert runs["fast"] == 1 and states(r, 25, 33) == {"MISSING"} and abs(r[29]["x"] * W - 796) < 4
    assert {x["motion"] for x in r[5:25]} == {"FAST"}
    r = rows["stayed"]
    assert runs["stayed"] == 1 and states(r, 31, 101) == {"MISSING"} and all(abs(x["x"] * W - 501) < 4 for x in r[31:101])
    assert {x["motion"] for x in r[101:141]} == {"STATIONARY"} and {x["motion"] for x in r[150:]} <= {"ROLLING", "FAST"}


def test_boots_and_blips_are_not_the_ball(told):
    rows, _, _, jumps = told
    assert states(rows["boot"], 15, 30) <= {"MISSING", "UNKNOWN"} and states(rows["boot"], 30) == {"TRACKED"}
    assert "TRACKED" not in states(rows["foot_teleport"], 20, 25) and jumps["foot_teleport"]["foot_switches"] == 0
    assert states(rows["visible_pass"]) == {"TRACKED"} and jumps["visible_pass"]["foot_switches"] == 0
    assert states(rows["resting"]) == {"TRACKED"} and all(abs(r["x"] * W - 640) < 2 for r in rows["resting"])
    assert states(rows["lone"]) == {"UNKNOWN"}


def test_camera_motion_is_undone(told):
    rows = told[0]["panned"]
    assert states(rows) == {"TRACKED"} and max(r["speed"] or 0 for r in rows) < 1


def test_things_that_stand_are_cut_and_the_rest_decoded_again(told):
    rows, reviewed, runs, _ = told
    r = rows["hidden_at_player"]
    assert runs["hidden_at_player"] == 1 and len(reviewed["hidden_at_player"]) == 1 and reviewed["hidden_at_player"][0]["kind"] == "still"
    assert states(r, 51, 111) == {"MISSING"} and all(math.hypot(x["x"] * W - 300, x["y"] * H - 400) < 12 for x in r[51:111])
    r = rows["still_thing"]
    assert states(r, 0, 30) == {"UNKNOWN"} and states(r, 30) == {"TRACKED"} and len(reviewed["still_thing"]) == 1
    assert r[40]["origin"] == "WEAK_DETECTION" and r[41]["origin"] == "OBSERVATION"


def test_unseen_flights_are_not_made_up(told):
    rows, _, runs, _ = told
    assert runs["two_things"] == 2 and states(rows["two_things"], 31, 56) == {"UNKNOWN"}
    r = rows["stops"]
    assert runs["stops"] == 1 and states(r) == {"TRACKED"}
    assert {x["motion"] for x in r[2:40]} == {"ROLLING"} and {x["motion"] for x in r[42:80]} == {"STATIONARY"} and {x["motion"] for x in r[82:]} == {"ROLLING"}


def cheapest(s, frames, goes_on):
    """Least cost of all ways to choose a node or nothing in each frame, and to link or not."""
    by = [[-1, *np.flatnonzero(s.frame == f)] for f in frames]
    best = math.inf
    for choice in itertools.product(*by):
        at, cost, old = None, 0.0, None
        ways = {("none", None): 0.0}
        for k, node in enumerate(choice):
            new = {}
            for (kind, last), c in ways.items():
                if node < 0:
                    for nxt in {(kind if kind != "on" else "on", last)}:
                        new[nxt] = min(new.get(nxt, math.inf), c + (0 if kind == "on" else bt.UNSEEN))
                    if kind == "on":  # the trajectory may end here
                        skipped = frames[k] - s.frame[last] - 1
                        if skipped == 0:
                            new[("none", None)] = min(new.get(("none", None), math.inf), c + bt.END + bt.UNSEEN)
                    continue
                if kind == "on":
                    own, _, _ = s.links(np.array([last]), slice(int(np.flatnonzero(s.frame == s.frame[node])[0]), int(np.flatnonzero(s.frame == s.frame[node])[-1]) + 1))
                    step = own[0, node - int(np.flatnonzero(s.frame == s.frame[node])[0])]
                    reach = s.frame[node] - s.frame[last] <= round(bt.STILL_LINK_S * s.fps)
                    if np.isfinite(step) and reach and s.cuts[node] == s.cuts[last]:
                        new[("on", node)] = min(new.get(("on", node), math.inf), c + step - math.log(s.q[node]))
                else:
                    new[("on", node)] = min(new.get(("on", node), math.inf), c + bt.BEGIN + (bt.BEGIN_AT_FOOT if s.pid[node] >= 0 else 0) - math.log(s.q[node]))
            ways = new
        for (kind, last), c in ways.items():
            if kind == "on":
                if frames[-1] != s.frame[last]:
                    continue  # unseen frames at the end belong to no link
                c += bt.END + bt.UNSEEN if goes_on else 0
            else:
                c += bt.UNSEEN if goes_on else 0
            best = min(best, c)
    return best


def cost_of(s, path, frames, goes_on):
    total, at = 0.0, frames[0] - 1
    for node, came, _, _ in path:
        lo = int(np.searchsorted(s.frame, s.frame[node]))
        if came >= 0:
            total += s.links(np.array([came]), slice(lo, int(np.searchsorted(s.frame, s.frame[node], "right"))))[0][0, node - lo]
        else:
            total += (bt.END if at >= frames[0] else 0) + (s.frame[node] - at - 1) * bt.UNSEEN + bt.BEGIN + (bt.BEGIN_AT_FOOT if s.pid[node] >= 0 else 0)
        total -= math.log(s.q[node])
        at = s.frame[node]
    last = frames[-1] + goes_on
    return total + ((bt.END if at >= frames[0] else 0) + (last - at) * bt.UNSEEN if last > at else 0)


def test_decoder_equals_enumeration():
    rnd = random.Random(7)
    for _ in range(150):
        fps = 5.0
        rows = []
        frames = list(range(7))
        for f in frames:
            for _ in range(rnd.choice([0, 1, 1, 2])):
                near = rnd.choice([None, None, 1, 2])
                rows.append({
                    "frame_idx": f, "ord": len(rows), "t": f / fps, "x": rnd.choice([100.0, 110.0, 130.0, 400.0]), "y": 200.0, "q": rnd.choice([0.2, 0.6, 0.9, 0.99]), "pid": near if rnd.random() < 0.5 else None, "near": near,
                    "pxm": 40.0, "tracklet": rnd.choice([None, 1, 2]), "own_speed": rnd.choice([None, 0.1, 5.0]), "cuts": 0 if f < 5 else rnd.choice([0]), "shaky": f // 3, "chain": np.eye(3).ravel().tolist(),
                })
        if not rows:
            continue
        pdf = pd.DataFrame(rows)
        pdf["origin"] = [[r["x"], r["y"], 1.0] for r in rows]
        s = bt.Section(pdf, fps)
        frames = list(range(int(s.frame[0]), int(s.frame[-1]) + 1))
        for goes_on in (True, False):
            path = s.decode(goes_on)
            assert cost_of(s, path, frames, goes_on) == pytest.approx(cheapest(s, frames, goes_on), abs=1e-9)


def test_islands_are_found_between_trajectories(spark):
    """A short trajectory that no ball could have come to or left, and the same where one could."""
    eye = np.eye(3).ravel().tolist()
    rows = []
    for run, far in ((0, 900.0), (1, 4.0)):
        for traj, (a, x) in enumerate(((0, 0.0), (12, far), (24, 0.0))):
            for i in range(a, a + 8):
                rows.append((run, 0, len(rows), i, i / 25, x, 0.0, 8.0, 0.9, None, None, 1.0, None, 0.9, None, "ball", False, None, [x, 0.0, 1.0], eye, 0, 0, False, traj, None, None, None, None, None, None))
    runs = bt.runs_of(spark.createDataFrame(rows, f"{bt.NODE}, {bt.STEP}")).collect()
    assert sorted((r["run"], r["traj"]) for r in runs if r["island"]) == [(0, 1)]


def test_sections_are_cut_where_no_link_can_cross(spark):
    """A ball seen again where it was after 3 s is one trajectory; after longer, another section, with the same rows decoded."""
    frames = spark.createDataFrame([(0, i, i * 40_000, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], True, False) for i in range(300)], FRAME)
    usual = (8.0, 8.0, 0.6, "ball", None, 1, PXM, None, 0.9, 0.8, 0.9, 1.0, 0.0, 0.0, 0.0, False, None, None)
    rows = [(0, i, i, 500.0, 300.0, *usual) for i in (*range(10), *range(84, 100), *range(190, 200))]
    found = bt.nodes(spark.createDataFrame(rows, CANDIDATE), spark.createDataFrame([], PERSON), frames, FPS, H)
    path, _ = bt.trajectory(found, FPS)
    assert sorted((r["section"], r["sightings"]) for r in bt.runs_of(path).collect()) == [(0, 26), (1, 10)]
    assert bt.trajectory(found.where("false"), FPS)[0].count() == 0


#: Events of five frames of larger tables, in which a thing lies on the edge of a body.
ON_AN_EDGE = [
    (56382, "2024-01-17 21:31:21.844657", 222, "signup"), (56398, "2024-01-17 21:36:57.590659", 212, "purchase"), (56424, "2024-01-17 21:53:47.776541", 204, "view"), (56440, "2024-01-17 21:59:51.657713", 220, "purchase"),
    (15222, "2024-01-05 14:25:20.446431", 466, "view"), (15253, "2024-01-05 14:35:44.418848", 469, "signup"), (15255, "2024-01-05 14:35:53.774103", 469, "error"),
    (18957, "2024-01-06 17:16:19.186136", 756, "signup"), (18976, "2024-01-06 17:22:16.548983", 761, "purchase"), (18995, "2024-01-06 17:28:29.837658", 750, "purchase"), (19044, "2024-01-06 17:52:20.482201", 773, "error"),
]


def as_sql(spark, tmp_path, events, name):
    """Rows of a query over ``events`` (event_id, ts, user_id, event_type) and of its SQL."""
    import duckdb
    from fieldtrace.queries import ORACLE_SQL, QUERIES

    e = pd.DataFrame(events, columns=["event_id", "ts", "user_id", "event_type"]).assign(value=1.0, props="{}")
    with duckdb.connect() as db:
        db.sql(f"copy (select event_id, ts::timestamp as ts, user_id, event_type, value, props from e) to '{tmp_path}/events.parquet' (format parquet)")
        db.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
        return [f[sorted(f.columns)].sort_values(sorted(f.columns)).reset_index(drop=True) for f in (QUERIES[name](spark, str(tmp_path)).toPandas(), db.sql(ORACLE_SQL[name]).df())]


def test_a_thing_on_the_edge_of_a_body_is_held_as_by_the_sql(spark, tmp_path):
    got, want = as_sql(spark, tmp_path, ON_AN_EDGE, "ball_likeness")
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-12)


def test_the_ball_on_the_edge_of_a_body_is_no_switch(spark, tmp_path):
    events = [
        (2724522, "2024-01-08 09:14:32.946907", 40955, "signup"), (2724648, "2024-01-08 10:21:06.898861", 40964, "click"), (2724682, "2024-01-08 10:35:51.469270", 40960, "purchase"), (2724685, "2024-01-08 10:36:18.018587", 40969, "view"), (2724838, "2024-01-08 11:40:32.144819", 40969, "click"), (2724864, "2024-01-08 11:48:34.154445", 40972, "view"), (2724876, "2024-01-08 11:51:28.876866", 40974, "view"),
        (3571757, "2024-01-22 13:14:28.128176", 53455, "view"), (3571927, "2024-01-22 14:27:08.607920", 53469, "view"), (3571960, "2024-01-22 14:41:47.090431", 53450, "click"), (3572096, "2024-01-22 15:36:17.061300", 53471, "view"), (3572124, "2024-01-22 15:49:40.719793", 53458, "view"),
    ]
    got, want = as_sql(spark, tmp_path, events, "ball_jumps")
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_the_told_ball_is_not_joined_through_the_driver(spark, data):
    """Spark takes the frames of a video for one row; joined by frame they must not be broadcast."""
    import re

    from fieldtrace.plans import balls

    told = balls._told(spark, data)
    assert len(told.collect()) == balls.frames(spark, data).count()
    plan = told._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    joins = re.findall(r"(\w+Join) \[run#\w+, frame_idx#\w+\]", plan)
    assert len(joins) >= 2 and set(joins) == {"SortMergeJoin"}
