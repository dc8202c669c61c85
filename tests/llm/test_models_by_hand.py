"""Scores of the trained models against plain loops over their parameters."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest
from fieldtrace.llm import common, language_model, quality, toxicity

DOCS = "doc_id long, text string"


def network(p, text):
    """The convolutional network, one window and one chunk at a time."""
    halves = max(2, -(-len(text) // quality.HALF))
    padded = text + bytes(halves * quality.HALF - len(text))
    x = p["embed"].astype(float)[list(padded)].reshape(-1, quality.GROUP * quality.EMBED)
    seen = []
    for k in range(len(x)):
        y = x[k] @ p["here"] + (x[k + 1] @ p["next"] if k + 1 < len(x) else 0) + p["bias"]
        seen.append(np.maximum(y, 0))
    per = quality.HALF // quality.GROUP
    top = np.full(quality.HIDDEN, -np.inf)
    for c in range(halves - 1):
        mean = np.mean(seen[c * per : (c + 2) * per], axis=0)
        top = np.maximum(top, np.maximum(mean @ p["hidden"] + p["hidden_bias"], 0))
    return 1 / (1 + math.exp(-float(top @ p["out"] + p["out_bias"][0])))


def test_network_equals_its_loops(spark):
    r = random.Random(1)
    texts = ["", "a", "x" * 255, "y" * 256, "z" * 257, "é😀" * 70, " ".join(r.choice(["good", "bad", "words"]) for _ in range(300))]
    p = {k: v + np.float32(0.1) for k, v in quality.start_params(3).items()}
    got = quality.quality_scores(spark.createDataFrame(list(enumerate(texts)), DOCS), p).collect()
    for x in got:
        assert x["score"] == pytest.approx(network(p, texts[x["doc_id"]].encode()), rel=1e-4)
        assert x["predicted"] == int(x["score"] >= 0.3)


def test_language_model_score_equals_its_loops(spark):
    r = random.Random(2)
    common = [f"w{k}ing" for k in range(40)]
    texts = [" ".join(r.choice(common) if r.random() < 0.9 else f"rare{r.randrange(500)}ed" for _ in range(60)) for _ in range(300)] + ["", "unseen words here"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    model, counts = language_model.train(docs)
    times = {row["h"]: row["n"] for row in counts.collect()}
    table = language_model.WordTable(model.units.hashes)

    def score(text):
        data = np.frombuffer(text.encode(), np.uint8)
        seq, at, h, _ = language_model.unit_sequence(model.units, table, data, np.array([0, len(data)]))
        total = 0.0
        for before, unit in zip(seq[:-1], seq[1:], strict=True):
            total += model.step[model.cls[before], model.cls[unit]] + model.share[unit]
        for k, word in enumerate(h):
            if at[k] < 0 or model.units.word_unit[at[k]] < 0:  # by its ending: its share of the unit
                total += math.log10(times.get(int(word.view(np.int64)), 0) + language_model.SMOOTH)
        return total

    got = {x["doc_id"]: x["score"] for x in language_model.scores(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(score(t), rel=1e-9)
    # What is left of a class after its units, and of a unit after its words, is smoothing only.
    units = collections.defaultdict(float)
    for u, c in enumerate(model.cls):
        if u < language_model.WORD_UNITS or u >= language_model.UNITS:
            units[c] += 10 ** model.share[u]
    assert all(v <= 1 + 1e-9 for v in units.values())
    assert np.allclose((10**model.step).sum(axis=1), 1)


def test_long_texts_are_scored_in_parts():
    """Any number of chunks at a time gives the score of the whole text; ends that fill no chunk included."""
    p = {k: v + np.float32(0.1) for k, v in quality.start_params(5).items()}
    r = np.random.default_rng(1)
    for size in (0, 1, 127, 128, 129, 256, 257, 5_000, 5_120, 20_001):
        data = r.integers(0, 256, size, dtype=np.uint8)
        whole = quality.forward(p, *quality.laid_out(data, np.array([0, size])))[0]
        for part in (1, 2, 7, 40, 1000):
            assert np.allclose(quality.long_forward(p, data, part), whole, atol=1e-6)


def hashed(word, extra=0):
    """A word's hash with whole numbers of Python."""
    h = extra
    for i, b in enumerate(word):
        h += int(common._BYTE_CODE_LOWER[b]) * pow(int(common._BASE), i, 1 << 64)
    return int(common.mix(np.array([h & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


def terms(text):
    """Counts of the hashes of a text's words and of their beginnings."""
    out = collections.Counter()
    for w in (text or "").encode().split():
        out[hashed(w)] += 1
        for k in toxicity.PREFIXES:
            if len(w) >= k:
                out[hashed(w[:k], k)] += 1
    return out


def test_toxicity_chain_equals_loops(spark):
    """Features by counting texts, and probabilities of every category by plain sums over the chain's weights."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    usual = [word() for _ in range(150)]
    rows, labels = [], []
    for i in range(260):
        toxic, poor = i % 5 == 0, i % 4 == 0
        text = [r.choice(usual) for _ in range(r.randint(5, 30))] + (["Vileness", "vilest"] * r.randint(1, 2) if toxic else []) + (["lorem", "ipsumly"] if poor and r.random() < 0.9 else [])
        r.shuffle(text)
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(not poor), int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], DOCS)
    chain = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text_of = dict(rows)
    for k, marked in enumerate(({i for i, q, _ in labels if not q}, {i for i, _, t in labels if t})):
        inside, outside = collections.Counter(), collections.Counter()
        for i, _, _ in labels:
            (inside if i in marked else outside).update(set(terms(text_of[i])))
        n, m = len(marked), len(labels) - len(marked)
        want = {h for h, c in inside.items() if c >= toxicity.LEAST_TEXTS and (c + 0.5) * (m + 1) >= toxicity.LEAST_RATIO * (outside[h] + 0.5) * (n + 1)}
        assert {int(h) for h, w in zip(chain.features, chain.weights[k], strict=False) if w} == want and want
    got = {x["doc_id"]: x for x in toxicity.score(docs, chain).collect()}
    for i, text in [*rows, (900, None), (901, "")]:
        count, seen = terms(text), []
        for w in chain.weights:
            z = w[-1] + sum(a * b for a, b in zip(w[len(chain.features) :], seen, strict=False))
            z += sum(math.log1p(count[int(h)]) * w[c] for c, h in enumerate(chain.features) if int(h) in count)
            seen.append(1 / (1 + math.exp(-z)))
        assert (got[i]["p_poor"], got[i]["p_toxic"]) == pytest.approx(tuple(seen), abs=1e-9) and got[i]["is_toxic"] == (seen[-1] >= toxicity.THRESHOLD)
    assert sum(got[i]["is_toxic"] for i, _ in rows) == 52


def test_logistic_fit_is_the_optimum():
    """No step from the weights found lowers the loss by more than a trace, against Newton steps on dense matrices."""
    r = np.random.default_rng(2)
    dense = (r.random((80, 6)) < 0.3) * r.random((80, 6))
    y = (dense @ np.array([4, -3, 2, 0, 1, -2.0]) + r.normal(0, 1, 80) > 0.3).astype(float)
    row, column = np.nonzero(dense)
    w = toxicity.fit_logistic(toxicity.Sparse(row, column, dense[row, column], 80, 6), np.ones((80, 1)), y, rounds=4000)
    x, v, ridge = np.hstack([dense, np.ones((80, 1))]), np.zeros(7), np.diag([1e-4] * 6 + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ v))
        v -= np.linalg.solve(x.T * (p * (1 - p)) @ x / 80 + ridge, x.T @ (p - y) / 80 + ridge @ v)
    assert np.allclose(w, v, atol=0.02)
