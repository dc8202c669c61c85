"""Rows that repeat an id with other texts or vectors stay rows of their own."""

from __future__ import annotations

import collections
import random
import zlib

import public_tokenizers

from fieldtrace.llm import jaccard, language_model, metric_join, packing

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"


def test_packing_of_equal_ids_under_one_doc_id(spark):
    rows = [(1, "Hello world"), (1, "hello  world"), (1, "other words"), (None, "hello world"), (None, "HELLO WORLD"), (None, None)]
    got = packing.pack(spark.createDataFrame(rows, DOCS), WORD_TOKENIZER).collect()
    spots = collections.Counter((r["sequence_id"], r["offset"]) for r in got)
    assert set(spots.values()) == {1}
    size = lambda t: len(packing.WordIds(WORD_TOKENIZER).tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in got) == sum(size(t) for _, t in rows)
    whole = collections.Counter()
    for r in got:
        whole[r["doc_id"]] += r["length"]
    assert whole == {1: 3 + 3 + 3, None: 3 + 3 + 1}


def test_vectors_that_repeat_an_id(spark):
    rows = [(1, [1.0, 0.0], 0, "x"), (1, [0.0, 1.0], 0, "x"), (2, [1.0, 0.0], 0, "x"), (3, None, 0, "x"), (3, [0.0, 2.0], 0, "x"), (None, [1.0, 0.0], 0, "x"), (4, [1.0, 0.0], None, "x")]
    got = metric_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (3, 1, 1, False), (None, 0, None, None), (4, 0, 4, True)], key=str)


def test_scores_of_rows_that_repeat_an_id(spark):
    rows = [(7, "ab zz zz"), (7, "ba zz zz"), (1, "ab zz"), (-1, "x"), (None, "x"), (7, "ab zz zz")]
    for parts in (1, 4):
        got = language_model.scores(spark.createDataFrame(rows, DOCS).repartition(parts)).collect()
        train = [t.split() + [None] for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
        known = {w for t in train for w in t}
        want = sorted((i is not None, i or 0, sum(w in known for w in t.split() + [None])) for i, t in rows)
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_known"]) for r in got) == want
    assert language_model.scores(spark.createDataFrame([], DOCS)).count() == 0


def test_jaccard_takes_texts_of_one_doc_id_as_one_vertex(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(0, text("x"), 1), (1, text("x"), 1), (1, text("y"), 1), (2, text("y"), 1), (1, None, 1), (None, text("x"), 1), (5, "", 1)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS + ", node int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(0, 36, 0), (1, 36, 0), (1, 36, 0), (2, 36, 0), (1, 0, 0), (None, 36, None), (5, 0, 5)], key=str)
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_jaccard_of_large_clusters_cut_into_blocks(spark, monkeypatch):
    """Many variants of one text, in small tiles and blocks, against all pairs."""
    for name, value in {"TILE": 8, "BLOCK_SETS": 8, "SHARD": 16, "RUN": 64, "CELLS": 64, "ROUNDS": 1}.items():
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(70):
        t = list(base)
        for _ in range(r.randint(0, 3)):
            t[r.randrange(60)] = f"c{r.randrange(1000)}"
        rows.append((k, " ".join(t[: r.randint(48, 60)])))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}
    for _ in range(80):
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == root and 1 < len(set(root.values())) < 60
