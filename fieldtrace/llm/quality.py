"""Operator 6: quality by a byte-level convolutional network in numpy.

Bytes are embedded; learned filters run over them at overlapping windows; their
activations are averaged in overlapping chunks that cover the whole document; a hidden
layer looks at each chunk, its units are max-pooled over the chunks, and a logistic
unit combines them into the probability of label 1.  The text is the only input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks

#: The network is fitted on about so many labelled rows, chosen by a hash of their id,
#: each read whole, and on about so many bytes of text at most; a text that is a
#: sixteenth of these bytes or more is scored, but not learnt from.
SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 64 << 20
GROUP = 4  # bytes between the starts of neighbouring windows, which are twice as long
HALF = 128  # bytes between the starts of neighbouring chunks, which are twice as long
EMBED, FILTERS, HIDDEN = 4, 32, 24
EPOCHS, BATCH, RATE = 12, 48, 4e-3
#: Steps that a small sample gets at least, by more epochs.
LEAST_STEPS = 700
THRESHOLD = 0.3
#: Chunks of a long text that are looked at together; texts of more are scored in such parts.
PART = 1 << 12
Params = dict[str, np.ndarray]


def start_params(seed: int = 7) -> Params:
    r = np.random.default_rng(seed)
    f32 = np.float32
    return {
        "embed": r.normal(0, 0.5, (256, EMBED)).astype(f32),
        "here": r.normal(0, 0.35, (GROUP * EMBED, FILTERS)).astype(f32),
        "next": r.normal(0, 0.35, (GROUP * EMBED, FILTERS)).astype(f32),
        "bias": np.zeros(FILTERS, f32),
        "hidden": r.normal(0, 0.4, (FILTERS, HIDDEN)).astype(f32),
        "hidden_bias": np.zeros(HIDDEN, f32),
        "out": r.normal(0, 0.2, HIDDEN).astype(f32),
        "out_bias": np.zeros(1, f32),
    }


def laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with zero bytes to whole half chunks, two at least, and the halves' offsets."""
    sizes = np.diff(offsets)
    halves = np.maximum(2, -(-sizes // HALF))
    first = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(first[-1] * HALF, np.uint8)
    shift = first[:-1] * HALF - offsets[:-1]
    out[np.arange(len(data)) + np.repeat(shift, sizes)] = data
    return out, first


def probability(p: Params, top: np.ndarray) -> np.ndarray:
    """Of label 1, from the pooled hidden units of each text."""
    return 1 / (1 + np.exp(-np.clip((top @ p["out"] + p["out_bias"]).astype(float), -30, 30)))


def long_forward(p: Params, data: np.ndarray, part: int = PART) -> np.ndarray:
    """``forward`` of one text of any length: chunks in parts of bounded size, and the running maximum of their units."""
    halves = max(2, -(-len(data) // HALF))
    top = np.full((1, HIDDEN), -np.inf, np.float32)
    for a in range(0, halves - 1, part):
        b = min(a + part + 2, halves)  # a half more than the chunks have: the last window of the last chunk reaches into it
        own = np.zeros((b - a) * HALF, np.uint8)
        own[: len(data[a * HALF : b * HALF])] = data[a * HALF : b * HALF]
        top = np.maximum(top, forward(p, own, np.array([0, b - a]), keep=True)[1]["h"][:part].max(axis=0, keepdims=True))
    return probability(p, top)


def forward(p: Params, padded: np.ndarray, first: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    """Probabilities of label 1 and, if asked, what the backward pass needs."""
    x = p["embed"][padded].reshape(-1, GROUP * EMBED)
    after = x @ p["next"]
    y = x @ p["here"]
    y[:-1] += after[1:]
    edge = first[1:-1] * (HALF // GROUP)
    y[edge - 1] -= after[edge]  # a window ends with its text
    y += p["bias"]
    np.maximum(y, 0, out=y)
    mean = y.reshape(-1, HALF // GROUP, FILTERS).mean(axis=1)
    # A chunk is two neighbouring halves of one text; the last half ends the last chunk.
    inside = np.ones(len(mean), bool)
    inside[first[1:] - 1] = False
    chunk = (mean[:-1] + mean[1:])[inside[:-1]] * np.float32(0.5)
    at = first - np.arange(len(first))
    h = np.maximum(chunk @ p["hidden"] + p["hidden_bias"], 0)
    top = np.maximum.reduceat(h, at[:-1], axis=0)
    return probability(p, top), {"x": x, "y": y, "inside": inside, "chunk": chunk, "h": h, "top": top, "at": at} if keep else {}


def gradients(p: Params, padded: np.ndarray, first: np.ndarray, target: np.ndarray, weight: np.ndarray) -> Params:
    prob, c = forward(p, padded, first, keep=True)
    dz = ((prob - target) * weight / weight.sum()).astype(np.float32)
    g: Params = {"out": c["top"].T @ dz, "out_bias": dz.sum(keepdims=True)}
    dtop = dz[:, None] * p["out"]
    texts = np.repeat(np.arange(len(first) - 1), np.diff(c["at"]))
    best = (c["h"] == c["top"][texts]) & (c["h"] > 0)
    seen = np.add.reduceat(best.astype(np.float32), c["at"][:-1], axis=0)
    dh = best * (dtop / np.maximum(seen, 1))[texts]
    g["hidden"], g["hidden_bias"] = c["chunk"].T @ dh, dh.sum(axis=0)
    dchunk = (dh @ p["hidden"].T) * np.float32(0.5)
    dmean = np.zeros((len(c["inside"]), FILTERS), np.float32)
    left = np.flatnonzero(c["inside"])
    dmean[left] += dchunk
    dmean[left + 1] += dchunk
    dy = np.repeat(dmean / np.float32(HALF // GROUP), HALF // GROUP, axis=0) * (c["y"] > 0)
    g["bias"] = dy.sum(axis=0)
    g["here"] = c["x"].T @ dy
    before = np.zeros_like(dy)
    before[1:] = dy[:-1]
    before[first[1:-1] * (HALF // GROUP)] = 0
    g["next"] = c["x"].T @ before
    dx = (dy @ p["here"].T + before @ p["next"].T).reshape(-1, EMBED)
    g["embed"] = np.stack([np.bincount(padded, dx[:, k], 256) for k in range(EMBED)], axis=1).astype(np.float32)
    return g


def fit(texts: list[bytes], target: np.ndarray, seed: int = 7) -> Params:
    """Adam over batches of whole texts; both classes weigh the same."""
    p = start_params(seed)
    if not len(texts) or target.min() == target.max():
        p["out"][:] = 0
        p["out_bias"][:] = 3.0 if not len(texts) or target[0] else -3.0
        return p
    share = target.mean()
    weight = np.where(target > 0, 0.5 / share, 0.5 / (1 - share))
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    r, t = np.random.default_rng(seed), 0
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, -(-len(texts) // BATCH))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = r.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])])
            padded, first = laid_out(np.frombuffer(b"".join(texts[i] for i in rows), np.uint8), offsets)
            t += 1
            for k, g in gradients(p, padded, first, target[rows], weight[rows]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    # Balanced classes were for learning; the probability is brought back to the base rate.
    p["out_bias"] += np.float32(np.log(share / (1 - share)))
    return p


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from: crc32 of the id as text is 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Params:
    """Fit the network on ``labels`` (doc_id, quality) of ``docs`` that are not held out.

    Rows without doc_id or label are left out; texts that repeat a doc_id are learnt from each.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    n = known.count()
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    turn = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000))
    chosen = known.where(turn < int(share * 1_000_000))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.where(F.octet_length("text") * 16 < SAMPLE_BYTES)
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    if size > SAMPLE_BYTES:
        rows = rows.where(turn < int(share * 1_000_000 * SAMPLE_BYTES / size))
    rows = sorted(((r["doc_id"], bytes(r["text"]), r["quality"]) for r in rows.toLocalIterator()), key=lambda r: r[0])
    return fit([r[1] for r in rows], np.array([r[2] for r in rows], float))


def quality_scores(docs: DataFrame, params: Params) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of every whole text of ``docs``.

    A null or empty text is scored as zero bytes.  A null doc_id is carried along and
    not held out; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1), 1 << 19):
                prob = long_forward(params, data) if hi - lo == 1 and len(data) > PART * HALF else forward(params, *laid_out(data, offsets))[0]
                ids = batch.column(0).slice(lo, hi - lo)
                held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(prob), pa.array((prob >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
