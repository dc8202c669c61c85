"""The ball's filter against information-form updates, and what the gate and the choice let pass."""

import numpy as np
import pytest
from fieldtrace.operators import ballfilter

PXM = 40.0
CANDIDATE = "run long, frame_idx long, ord long, x double, y double, d double, q double, pxm double"
FRAME = "run long, frame_idx long, t_us long, m array<double>, reliable boolean, cut boolean"


def shift(x):
    return [1.0, 0.0, x, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def scenes():
    """(candidates (frame, x, y, q), pan, cut) by run; balls move 8 px a frame."""
    roll = lambda n, gaps=(): [(i, 100 + 8.0 * i, 300.0, 0.8) for i in range(n) if i not in gaps]
    return {
        0: (roll(40, range(20, 26)), 0.0, None),
        1: (roll(30) + [(15, 1100.0, 300.0, 1.0), (16, 1100.0, 300.0, 1.0)], 0.0, None),  # a flash far away
        2: (roll(30) + [(i, 104 + 8.0 * i, 306.0, 0.9) for i in range(10, 30)], 0.0, None),  # a little better, off the path
        3: ([(i, 100.0, 300.0, 0.01 if i >= 10 else 0.8) for i in range(20)] + [(i, 103.0, 300.0, 1.0) for i in range(10, 20)], 0.0, None),  # clearly better beside it
        4: ([(i, 700 - 30.0 * i, 300.0, 0.8) for i in range(20)], -30.0, None),  # at rest while the camera pans
        5: (roll(30), 0.0, 15),
        6: ([(i, 100.0, 300.0, 0.8) for i in range(5)] + [(i, 900.0, 300.0, 0.8) for i in range(90, 95)], 0.0, None),  # lost, and found elsewhere
        7: ([(i, 100.0, 300.0, 0.5) for i in range(10)], 0.0, None),  # never likely enough to begin
    }


@pytest.fixture(scope="module")
def told(spark):
    c = [(run, f, 100 * f + n, x, y, 8.0, q, PXM) for run, (rows, _, _) in scenes().items() for n, (f, x, y, q) in enumerate(rows)]
    f = [(run, i, i * 40_000, shift(pan), True, i == cut) for run, (_, pan, cut) in scenes().items() for i in range(100)]
    out = {}
    for r in ballfilter.followed(spark.createDataFrame(c, CANDIDATE).repartition(3), spark.createDataFrame(f, FRAME)).orderBy("run", "frame_idx").collect():
        out.setdefault(r["run"], []).append(r)
    return out


def test_states_and_choices(told):
    states = lambda run, a, b: {r["state"] for r in told[run][a:b]}
    assert states(0, 0, 20) == states(0, 26, 40) == {"TRACKED"} and states(0, 20, 26) == {"HIDDEN"} and {r["track"] for r in told[0][:40]} == {1}
    assert abs(told[0][25]["x"] - 300) < 4 and told[0][39]["speed"] == pytest.approx(5.0, abs=0.2)
    assert told[1][15]["jumps"] == 1 and abs(told[1][16]["x"] - 228) < 3
    assert all(abs(r["y"] - 300) < 2 for r in told[2][10:30])
    assert told[3][19]["x"] > 102
    assert max(r["speed"] for r in told[4][2:20]) < 1.0 and states(4, 0, 20) == {"TRACKED"}
    assert [r["track"] for r in told[5][13:17]] == [1, 1, 2, 2]
    assert states(6, 5, 79) == {"HIDDEN"} and states(6, 81, 90) == {"SEARCHING"} and {r["track"] for r in told[6][90:95]} == {2}
    assert states(7, 0, 100) == {"SEARCHING"}


def test_filter_equals_information_form(told):
    """The same numbers by inverse covariances, from the single candidate of each frame."""
    state, cov = np.array([100.0, 300.0, 0, 0]), np.diag([64.0, 64.0, (10 * PXM) ** 2, (10 * PXM) ** 2])
    h, noise = np.eye(2, 4), np.eye(2) * 4.0
    for i in range(20):
        if i:
            f = np.array([[1, 0, 0.04, 0], [0, 1, 0, 0.04], [0, 0, 1, 0], [0, 0, 0, 1]])
            g = np.array([[0.0008, 0], [0, 0.0008], [0.04, 0], [0, 0.04]])
            state, cov = f @ state, f @ cov @ f.T + g @ g.T * (30 * PXM) ** 2
        info = np.linalg.inv(cov) + h.T @ np.linalg.inv(noise) @ h
        state = np.linalg.solve(info, np.linalg.inv(cov) @ state + h.T @ np.linalg.inv(noise) @ np.array([100 + 8.0 * i, 300.0]))
        cov = np.linalg.inv(info)
        r = told[0][i]
        assert (r["x"], r["y"], r["speed"]) == pytest.approx((state[0], state[1], np.hypot(*state[2:]) / PXM), abs=1e-6)
