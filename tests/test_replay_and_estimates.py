"""Correction logs, estimates of hidden players, sections of the ball path, records and sinks."""

from __future__ import annotations

import math

import numpy as np
import pytest
from fieldtrace.operators import ballpath, corrections, edits, imputation
from fieldtrace.sources import result
from pyspark.sql import functions as F

PEOPLE = "video long, frame_idx long, ord long, t_us long, id string, track long, team string, role string, state string"
LOG = "seq long, video long, kind string, target_id string, target_track long, team string, new_id string, `into` boolean, t_us long"


@pytest.fixture(scope="module")
def people(spark):
    rows = [(0, k, k, k * 1000, "a" if k < 6 else "b", k % 2, "A0", "PLAYER", "confirmed") for k in range(10)]
    rows += [(0, 20, 20, 20_000, None, 7, "B0", "PLAYER", "uncertain"), (1, 0, 30, 0, "a", 0, "A1", "PLAYER", "confirmed")]
    return spark.createDataFrame(rows, PEOPLE)


def after(spark, people, *log):
    return corrections.corrected(people, spark.createDataFrame(list(log), LOG))


def test_an_empty_log_restores_the_base(spark, people):
    got = after(spark, people).select(*people.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, people.collect()), key=str)
    assert after(spark, people).where("correction is not null or excluded_id is not null").count() == 0


def test_corrections_follow_one_another(spark, people):
    log = [
        (1, 0, "player", "a", None, "B0", "n1", False, 0),  # a becomes n1 of the other team
        (2, 0, "player", "n1", None, "B0", "b", True, 0),  # which is b, who so joins that team
        (3, 0, "player", None, 7, "B0", "c", False, 0),  # the track without id is c
        (4, 0, "excluded", "c", None, None, None, False, 0),
        (5, 0, "left", "b", None, None, None, False, 0),
        (6, 0, "player", "gone", None, "A0", "x", False, 0),  # nobody
    ]
    got = {tuple(r) for r in after(spark, people, *log).select("video", "id", "team", "role", "state", "excluded_id", "correction").collect()}
    assert got == {(0, "b", "B0", "PLAYER", "confirmed", None, 2), (0, None, None, "UNKNOWN", "rejected", "c", 4), (1, "a", "A1", "PLAYER", "confirmed", None, None)}
    listing = {r["seq"]: (r["hits"], r["applied"]) for r in corrections.applied(people, spark.createDataFrame(log, LOG)).collect()}
    assert listing == {1: (6, True), 2: (6, True), 3: (1, True), 4: (1, True), 5: (0, True), 6: (0, False)}
    count = {r["video"]: r for r in corrections.recount(people, spark.createDataFrame(log, LOG)).collect()}
    assert (count[0]["team_b"], count[0]["team_a"], count[0]["merged"], count[0]["excluded"], count[0]["applied"]) == (1, 0, 2, 1, 5)


def test_cycles_of_merges_are_refused(spark):
    with pytest.raises(ValueError):
        edits.resolved(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, into long"))


def brute_offsets(cells, centre):
    """(id, step) -> offset and variance, by the recursion as written."""
    out = {}
    for i in {k for k, _ in cells}:
        o, var, seen, last = None, 25.0, 0.0, None
        for t in sorted(s for k, s in cells if k == i):
            x, y, _ = cells[i, t]
            if x is not None and t in centre:
                r = np.array([x, y]) - centre[t][:2]
                if o is None:
                    o, var, seen = r, 25.0, 0.0
                else:
                    a = 1 - math.exp(-(t - last) / 30)
                    o = o + a * (r - o)
                    var = (1 - a) * var + a * float(((r - o) ** 2).sum()) / 2
                    seen += t - last
                last = t
            if o is not None and seen >= 10:
                out[i, t] = (*o, max(var, 1.0))
    return out


def test_offsets_and_voted_centres_equal_the_recursion(spark):
    rng = np.random.default_rng(4)
    cells = {}
    for i in range(8):
        for t in range(60):
            hidden = rng.random() < 0.3
            x, y = (None, None) if hidden else (float(10 * i + 0.2 * t + rng.normal()), float(5 * i + rng.normal()))
            cells[f"p{i}", t] = (x, y, None if hidden else 1.0 + i / 10)
    df = spark.createDataFrame([(i, "T", t, *v) for (i, t), v in cells.items()], "id string, team string, step long, x double, y double, sigma double").repartition(3)
    centre = {}
    for t in range(60):
        seen = [v for (_, s), v in cells.items() if s == t and v[0] is not None]
        if len(seen) >= 7:
            centre[t] = (*np.mean([v[:2] for v in seen], axis=0), 1.0)
    for _ in range(3):
        offsets = brute_offsets(cells, centre)
        centre = {}
        for t in range(60):
            votes = [(np.array(cells[i, t][:2]) - o[:2], 1 / (o[2] + cells[i, t][2] ** 2)) for (i, s), o in offsets.items() if s == t and cells[i, t][0] is not None]
            if len(votes) >= 4:
                w = sum(v for _, v in votes)
                centre[t] = (*(sum(p * v for p, v in votes) / w), max(1.0, 1 / w))
    got = {r["step"]: (r["cx"], r["cy"], r["var"]) for r in imputation.learned_centres(df).collect()}
    assert set(got) == set(centre) and centre
    for t, v in centre.items():
        assert got[t] == pytest.approx(v)
    held = imputation.estimated(df, imputation.learned_centres(df)).groupBy("kind").count().collect()
    kinds = {r["kind"]: r["count"] for r in held}
    assert kinds["O"] == sum(v[0] is not None for v in cells.values()) and sum(kinds.values()) == len(cells) and "P" in kinds


def test_ball_path_sections_equal_the_whole(spark):
    rng = np.random.default_rng(2)
    rows = []
    frame = 0
    for k in range(120):
        frame += int(rng.choice([1, 1, 1, 2, 3, 9]))
        for c in range(int(rng.integers(1, 3))):
            rows.append((1, 10 * k + c, frame, frame * 40_000, float(0.2 * rng.normal() + 0.1 * k), 0.0, float(0.4 + 0.6 * rng.random())))
    schema = "run long, ord long, frame_idx long, t_us long, x double, y double, score double"
    whole = sorted(rows, key=lambda r: (r[2], r[1]))
    a = np.array(whole)
    want = {whole[i][1] for i in ballpath.viterbi(a[:, 2].astype(int), a[:, 3] / 1e6, a[:, 4], a[:, 5], a[:, 6])}
    got = {r["ord"] for r in ballpath.ball_path(spark.createDataFrame(rows, schema), schema).collect()}
    assert got == want and len(got) > 20


def test_records_and_sinks(spark, tmp_path):
    r = spark.createDataFrame([("a", "me", "note", '{"revision": 2}', 1), ("a", "me", "note", '{"revision": 3}', 2), ("c", "you", "note", "{}", 3)], "id string, owner string, kind string, data string, created long")
    assert [x["created"] for x in result.kv_get(r, "a", "me", "note").collect()] == [2]
    new = spark.createDataFrame([("c", "me", "note", "{}", 9), ("d", "me", "note", "{}", 9)], r.schema)
    assert sorted(x["id"] for x in result.inserted_or_ignored(r, new).collect()) == ["a", "a", "c", "d"]
    one = r.where("created = 2")
    for expected, created in ((3, 7), (2, 2)):
        offer = spark.createDataFrame([("a", "me", "note", '{"revision": 4}', 7)], new.schema).withColumn("expected", F.lit(expected))
        assert [x["created"] for x in result.replaced_at(one, offer).collect()] == [created]
    assert sorted(x["owner"] for x in result.deleted(r, "me", r.select("id")).collect()) == ["you"]
    for kind in ("parquet", "json"):
        at = str(tmp_path / kind)
        result.write_result(one, at, ["owner"], kind)
        result.write_result(one, at, ["owner"], kind, append=True)
        assert spark.read.format(kind).load(at).count() == 2
        result.write_result(one, at, None, kind)
        assert spark.read.format(kind).load(at).count() == 1


def test_exports_keep_the_last_chunk(spark):
    chunk = lambda v: spark.createDataFrame([(1, 10, v), (2, 10 + v, v)], "local_id long, t_us long, v long")
    assert sorted(map(tuple, result.exported([chunk(1), chunk(2)]).collect())) == [(1, 10, 2), (2, 11, 1), (2, 12, 2)]


def test_run_folders_and_uploads(spark, tmp_path):
    for run, text in (("r1", '{"fps": 25}'), ("r2", None)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "result.json").write_text('{"n": 1}')
        if text:
            (tmp_path / run / "registration.json").write_text(text)
    assert [tuple(r) for r in result.run_documents(spark, str(tmp_path), "registration.json", "fps int").collect()] == [("r1", 25)]
    assert result.run_documents(spark, str(tmp_path), "none.json", "fps int").count() == 0
    names = result.uploads(spark, str(tmp_path / "r1"), "*.json").select("name", F.col("bytes").cast("int")).collect()
    assert sorted(map(tuple, names)) == [("registration.json", 11), ("result.json", 8)]
