"""Operators on small inputs with known answers."""

import collections
import datetime
import itertools
import json

import numpy as np
import pytest
from fieldtrace.functions import geometry, text
from fieldtrace.operators import analytics, ballpath, edits, gaps, matching, roster, samples
from fieldtrace.queries import QUERIES
from fieldtrace.sources import result
from fieldtrace.streaming import replay
from pyspark.sql import functions as F


def person(pid, where, **more):
    return {"track": 1, "id": pid, "team": pid[0], "role": "PLAYER", "state": "confirmed", "identityConfidence": 0.9, "pitch": list(where), "pitchConfidence": 0.8} | more


def document(path, frames, ids=("A-01", "A-02"), fps=30.0):
    doc = {"version": 3, "video": {"width": 1920, "height": 1080, "fps": fps}, "frames": frames, "match": {"players": [{"id": i, "team": i[0], "role": "PLAYER"} for i in ids], "goalkeepers": []}, "tactical": {"pitchSize": {"length": 105.0, "width": 68.0}}}
    path.mkdir()
    (path / "result.json").write_text(json.dumps(doc))
    return str(path)


def regular(pid, t0, t1, where, fps=25, **more):
    n = round((t1 - t0) * fps)
    return [{"time": t0 + k / fps, "frame": k, "calibrated": True, "people": [person(pid, where, **more)]} for k in range(n)]


def load(spark, path):
    return result.observations(result.result_documents(spark, path))


def test_occupancy_follows_time(spark, tmp_path):
    s = samples.samples(load(spark, document(tmp_path / "r", regular("A-01", 0, 6, (0.2, 0.2)) + regular("A-01", 6.5, 8.5, (0.21, 0.2)))))
    cov = analytics.coverage(s, 0, 8_500_000).first()
    assert abs(cov["half_us"] / 2e6 - 8) < 0.6
    cells = analytics.heat_cells(s).collect()
    assert sum(c["half_us"] for c in cells) == s.agg(F.sum("w")).first()[0]
    avg = analytics.averages(s).first()
    assert abs(avg["x"] - 202.5) < 3


def test_unseen_time_is_not_counted(spark, tmp_path):
    s = samples.samples(load(spark, document(tmp_path / "r", regular("A-01", 0, 3, (0.2, 0.2)) + regular("A-01", 18, 21, (0.2, 0.2)))))
    cov = analytics.coverage(s, 0, 21_000_000).first()
    assert abs(cov["half_us"] / 2e6 - 6.5) < 0.3 and cov["low"]
    trail = analytics.trail_summary(s).first()
    assert (trail["segments"], trail["breaks"]) == (2, 1) and trail["unseen_us"] > 14_000_000


def test_each_exclusion_is_counted_once(spark, tmp_path):
    bad = [person("A-01", (1.4, 0.5)), person("A-01", (0.5, 0.5), pitchConfidence=0.3), person("A-01", (0.5, 0.5), pitchClipped=True), person("A-01", (0.5, 0.5), identityConfidence=0.1), person("A-01", (0.5, 0.5), state="uncertain"), person("B-09", (0.5, 0.5))]
    frames = regular("A-01", 0, 2, (0.5, 0.5), 30) + [{"time": 3 + k, "frame": 100 + k, "calibrated": True, "people": [p]} for k, p in enumerate(bad)]
    counts = {r["reason"]: r["n"] for r in samples.exclusions(load(spark, document(tmp_path / "r", frames))).collect()}
    assert counts == {"kept": 60, "offPitch": 1, "lowPitchConfidence": 1, "clipped": 1, "lowIdentityConfidence": 1, "notConfirmed": 1, "notInRoster": 1}


def test_first_row_of_an_identity_in_a_frame_wins(spark, tmp_path):
    frames = [{"time": 0.0, "frame": 0, "calibrated": True, "people": [person("A-01", (0.1, 0.1)), person("A-01", (0.9, 0.9))]}]
    assert [r["x_m"] for r in samples.kept(load(spark, document(tmp_path / "r", frames))).collect()] == [100]


def test_empty_and_broken_documents(spark, tmp_path):
    path = document(tmp_path / "r", [])
    (tmp_path / "r" / "broken.json").write_text("{")
    o = load(spark, path)
    assert o.count() == 0 and samples.samples(o).count() == 0
    assert result.result_documents(spark, path).cache().where("_corrupt_record is not null").count() == 1


def test_wide_csv_time_goes_on(spark, tmp_path):
    lines = [",,,Home,,Home,", ",,,1,,2,", "Period,Frame,Time,P1,,P2,", "1,1,0.04,0.1,0.2,NaN,NaN", "1,2,0.08,0.2,0.2,,", "2,3,0.04,0.3,0.2,0.5,0.5"]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    rows = result.wide_tracking(spark, str(tmp_path / "t.csv"), ["P1", "P2"]).orderBy("frame", "player").collect()
    assert len(rows) == 6 and rows[1]["x"] is None and rows[3]["x"] is None
    times = [round(r["time"], 9) for r in rows[::2]]
    assert times == [0.04, 0.08, 0.12]


def test_hand_counts_skip_notes(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"_note": "x", "v": {"10.0": {"count": 12, "uncertainty": 1}}}))
    assert [tuple(r) for r in result.annotation_counts(spark, str(tmp_path / "c.json")).collect()] == [("v", 10.0, 12, 1)]


def test_records(spark):
    r = spark.createDataFrame([("a", "me", "note", '{"revision": 2}', 1), ("b", "me", "tracking", "{}", 2), ("c", "you", "note", "{}", 3)], "id string, owner string, kind string, data string, created long")
    assert [x["id"] for x in result.kv_rows(r, "me").collect()] == ["a"]
    assert result.at_revision(r, 2).count() == 1
    new = spark.createDataFrame([("a", "me", "note", "{}", 9), ("c", "me", "note", "{}", 9)], r.schema)
    assert {x["id"]: x["created"] for x in result.upserted(r, new).collect()} == {"a": 9, "b": 2, "c": 3}
    nested = spark.createDataFrame([((1, (2,)),)], "a struct<b: int, c: struct<d: int>>")
    assert result.flattened(nested).columns == ["a.b", "a.c.d"]


def test_assignment_is_optimal():
    assert matching.assignment(np.array([[0.1, 0.2], [0.15, 0.7]])).tolist() == [1, 0]
    rng = np.random.default_rng(3)
    for _ in range(20):
        c = rng.random((4, 5))
        best = min(sum(c[i, p[i]] for i in range(4)) for p in itertools.permutations(range(5), 4))
        assert sum(c[i, j] for i, j in enumerate(matching.assignment(c))) == pytest.approx(best)


def test_ball_path_is_the_cheapest():
    frame = np.repeat(np.arange(4), 2)
    sec, x = frame / 25.0, np.array([0, 50, 0.5, 49, 1.0, 10, 1.5, 90.0])
    score = np.array([0.9, 0.5, 0.8, 0.5, 0.9, 0.9, 0.8, 0.2])
    assert ballpath.viterbi(frame, sec, x, np.zeros(8), score).tolist() == [0, 2, 4, 6]
    assert ballpath.viterbi(frame[:2], sec[:2], x[:2], np.zeros(2), np.array([0.0, 0.0])).tolist() == []


def test_substitution_intervals(spark):
    p = spark.createDataFrame([("a", 5, 1), ("a", 12, 2), ("a", 22, 3), ("b", 1, 4)], "id string, t_us long, ord long")
    c = spark.createDataFrame([("a", 10, 1, False), ("a", 20, 2, True)], "id string, t_us long, seq long, active boolean")
    assert {r["ord"]: r["is_active"] for r in roster.substitution_state(p, c).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_history_generations(spark):
    p = spark.createDataFrame([(1, "a", 500_000, 0, True), (2, "a", 500_000, 2, True), (3, "a", 500_000, 0, False), (4, "b", 500_000, 0, True)], "ord long, id string, t_us long, generation long, experimental boolean")
    e = spark.createDataFrame([("a", 600_000, 1)], "player string, t_us long, generation long")
    assert sorted(r["ord"] for r in edits.valid_history(p, e).collect()) == [2, 3, 4]
    everyone = spark.createDataFrame([("*", 0, 1)], e.schema)
    assert sorted(r["ord"] for r in edits.valid_history(p, everyone).collect()) == [2, 3]


def test_merge_chains_and_interval_import(spark):
    m = spark.createDataFrame([(k, k - 1) for k in range(2, 40)], "id long, into long")
    assert {r["root"] for r in edits.resolved(m).collect()} == {1}
    old = spark.createDataFrame([(1, 5, "confirmed"), (2, 5, "uncertain"), (3, 50, "uncertain")], "ord long, t_us long, state string")
    new = spark.createDataFrame([(9, 6, "uncertain")], old.schema)
    once = edits.interval_replaced(old, new, 0, 10)
    assert sorted(r["ord"] for r in once.collect()) == [1, 3, 9]
    assert sorted(r["ord"] for r in edits.interval_replaced(once, new, 0, 10).collect()) == [1, 3, 9]


def test_positions_between_samples(spark):
    s = spark.createDataFrame([("a", 0, 0, 0), ("a", 800_000, 80, 0), ("a", 9_000_000, 500, 0)], "id string, t_us long, x_m long, y_m long")
    q = spark.createDataFrame([("a", 5_000), ("a", 400_000), ("a", 1_300_000), ("a", 5_000_000)], "id string, t_us long")
    got = {r["t_us"]: (r["kind"], r["x"]) for r in gaps.positions_at(s, q).collect()}
    assert got == {5_000: ("OBSERVED", 0.0), 400_000: ("INTERPOLATED", 40.0), 1_300_000: ("HELD", 80.0), 5_000_000: (None, None)}


def test_polygon_and_text(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    r = spark.createDataFrame([(5, 5), (15, 5)], "x long, y long").select(geometry.inside_polygon(square, F.col("x"), F.col("y")).alias("i"), geometry.signed_distance(square, F.col("x"), F.col("y")).alias("d")).collect()
    assert [tuple(x) for x in r] == [(True, -5.0), (False, 5.0)]
    t = spark.range(1).select(text.clock(F.lit(65_430_000)).alias("c"), text.topic(F.lit("Who pressed the MOST, on the run?")).alias("t"), text.topic(F.lit(None).cast("string")).alias("n")).first()
    assert tuple(t) == ("01:05.43", "distance", "other")


def test_streams_equal_batches(spark, data, tmp_path):
    from fieldtrace.sources.adapter import observations

    src = str(tmp_path / "events")
    spark.read.parquet(f"{data}/events.parquet").repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(src)
    stream = replay.observation_stream(spark, src, 3)
    got: list = []
    replay.replay(replay.throttled(stream, 800_000), lambda df, _: got.extend(map(tuple, df.collect())), str(tmp_path / "c1"))
    want = edits.throttled(observations(spark, data), "id", 800_000)
    assert sorted(got) == sorted(map(tuple, want.select("id", "t_us", "ord").collect()))
    got.clear()
    replay.replay(replay.in_order(stream), lambda df, _: got.extend(map(tuple, df.collect())), str(tmp_path / "c2"))
    late = {r["id"]: r["kept"] for r in QUERIES["late_drop"](spark, data).collect()}
    assert collections.Counter(r[0] for r in got) == late
    got.clear()
    replay.replay(replay.sessions(stream, "6 hours", "1 hour"), lambda df, _: got.extend(map(tuple, df.collect())), str(tmp_path / "c3"))
    batch = spark.read.parquet(src).select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    batch = batch.groupBy("id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("id", "w.start", "w.end", "n")
    every = sorted(map(tuple, batch.collect()))
    # Sessions still open when the stream ends are not given; all others are, as they are.
    end = max(r[2] for r in every) - datetime.timedelta(hours=7)
    assert set(got) <= set(every) and {r for r in every if r[2] < end} <= set(got)
    got.clear()
    replay.replay(replay.blocks(stream, "5 days", "1 hour"), lambda df, _: got.extend(map(tuple, df.collect())), str(tmp_path / "c4"), "update")
    last = {}
    for start, kind, n in got:
        last[start, kind] = max(n, last.get((start, kind), 0))
    want = spark.read.parquet(src).groupBy(F.window(F.col("ts").cast("timestamp"), "5 days").alias("w"), F.col("event_type").alias("kind")).count().select("w.start", "kind", "count").collect()
    assert last == {(r[0], r[1]): r[2] for r in want}


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_suppression_needs_no_python_group_for_a_frame(spark):
    import random

    from fieldtrace.operators import matching

    rnd = random.Random(3)
    rows = [(f, 1000 * f + k, rnd.randrange(40), rnd.randrange(900), rnd.randrange(900), 200 + rnd.randrange(90), 300 + rnd.randrange(110)) for f in range(40) for k in range(rnd.choice((1, 2, 3, 60)))]
    df = spark.createDataFrame(rows, "frame_idx long, ord long, score long, bx long, by long, bw long, bh long")
    want = set()
    for f in range(40):
        kept = []
        for _, o, s, x, y, w, h in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[2], r[1])):
            shared = [max(0, min(x + w, a + c) - max(x, a)) * max(0, min(y + h, b + d) - max(y, b)) for a, b, c, d in kept]
            if not any(i / (w * h + k[2] * k[3] - i) > 0.3 for i, k in zip(shared, kept, strict=True)):
                kept.append((x, y, w, h))
                want.add((f, o, s))
    out = matching.suppressed(df, 0.3)
    assert "InPandas" not in planned(out)
    assert {tuple(r) for r in out.collect()} == want


def test_chains_stream_and_segments_go_on_over_batches(spark):
    import random

    import numpy as np
    from fieldtrace.operators import registration

    rnd = random.Random(5)
    rows = [(run, k, [1 + rnd.random() / 9, rnd.random() / 9, rnd.random(), rnd.random() / 9, 1.0, rnd.random(), rnd.random() / 99, rnd.random() / 99, 1 + rnd.random() / 9], rnd.random() < (0.3 if run else 0.0)) for run in range(4) for k in range(1, 60)]
    want = {}
    for run, k, m, cut in rows:
        before = np.eye(3) if cut or k == 1 else want[run, k - 1]
        want[run, k] = np.array(m).reshape(3, 3) @ before
        want[run, k] = want[run, k] / want[run, k][2, 2]
    df = spark.createDataFrame(rows, "run long, idx long, m array<double>, cut boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = registration.motion_chain(df)
        assert "InPandas" not in planned(out)
        got = {(r["run"], r["idx"]): np.array(r["chain"]).reshape(3, 3) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-12, atol=0) for k in want)
