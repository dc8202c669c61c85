"""Operator 7: toxicity by a classifier chain.

Linear models predict the labelled categories one after another; each later one also sees
the probabilities of the earlier ones, and in training these are out-of-fold predictions:
a fold is scored by models, and with features, that have seen none of its labels.  The
categories are those that the labels hold (poor quality, then toxic); a table without the
label of a category gives a shorter chain.  Features are words and word beginnings, so
that inflected forms count.  Every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, _BYTE_CODE_LOWER, block_words, mix, powers, settle, signed, text_blocks

#: The chain is fitted on about so many labelled rows, chosen by a hash of their id.  What the
#: driver holds is bounded by them: a few features of each text.
SAMPLE_ROWS = 20_000
#: A feature is in at least so many texts of a category, and at least so many times as likely in them as in others.
LEAST_TEXTS, LEAST_RATIO = 5, 6.0
PREFIXES = (4, 5, 6)
#: Categories in the order of the chain: name, the column of labels, and its value that marks them.
CATEGORIES = (("poor", "quality", 0), ("toxic", "toxic", 1))
FOLDS = 5
THRESHOLD = 0.5


def feature_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of each word and of its first 4, 5 and 6 bytes."""
    starts, ends, where = block_words(data, offsets)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE_LOWER[data] * up[:-1], out=total[1:])
    hashes, owners = [mix((total[ends] - total[starts]) * down[starts])], [where]
    for k in PREFIXES:
        fits = ends - starts >= k
        s = starts[fits]
        hashes.append(mix((total[s + k] - total[s]) * down[s] + np.uint64(k)))
        owners.append(where[fits])
    return np.concatenate(hashes), np.concatenate(owners)


class Lookup:
    """Positions of hashes in a small sorted list, behind a table of their top bits."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.sort(hashes)
        self.flags = np.zeros(1 << 16, bool)
        self.flags[(self.sorted >> np.uint64(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices into ``h``, positions in the list) of those that are in it."""
        maybe = np.flatnonzero(self.flags[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, h[maybe]), max(len(self.sorted) - 1, 0))
        sure = self.sorted[at] == h[maybe] if len(self.sorted) else np.zeros(0, bool)
        return maybe[sure], at[sure]


@dataclass
class Sparse:
    """Rows of a few features: entries (row, column, value), and dense columns beside them."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    rows: int
    width: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.rows)

    def transposed_times(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * x[self.row], self.width)

    def only(self, rows: np.ndarray, columns: np.ndarray) -> Sparse:
        """The chosen rows, renumbered, and entries of the chosen columns; both are flags."""
        keep = rows[self.row] & columns[self.column]
        return Sparse((np.cumsum(rows) - 1)[self.row[keep]], self.column[keep], self.value[keep], int(rows.sum()), self.width)


@dataclass
class Chain:
    features: np.ndarray
    names: tuple[str, ...]
    weights: list[np.ndarray]  # per category: features, then earlier categories, then bias
    held_out: dict[str, tuple[int, int, int, int]] = field(default_factory=dict)  # rows of it, those found, other rows, those marked; out of fold

    def predict(self, x: Sparse) -> np.ndarray:
        out = np.zeros((x.rows, 0))
        for w in self.weights:
            z = x.times(w[: x.width]) + np.hstack([out, np.ones((x.rows, 1))]) @ w[x.width :]
            out = np.column_stack([out, _sigmoid(z)])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: Sparse, dense: np.ndarray, y: np.ndarray, rounds: int = 400, decay: float = 1e-4) -> np.ndarray:
    """L2-regularised logistic regression by accelerated gradient steps; the last dense column is 1."""
    n, w = max(len(y), 1), np.zeros(x.width + dense.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    v, top = w.copy(), np.ones(len(w))
    for _ in range(20):  # the largest curvature, by power iteration
        curve = x.times(top[: x.width]) + dense @ top[x.width :]
        top = np.concatenate([x.transposed_times(curve), dense.T @ curve]) / (4 * n)
        size = np.sqrt((top * top).sum())
        top = top / max(size, 1e-12)
    step = 0.9 / (size + decay)
    for t in range(rounds):
        miss = _sigmoid(x.times(v[: x.width]) + dense @ v[x.width :]) - y
        g = np.concatenate([x.transposed_times(miss), dense.T @ miss]) / n
        g[:-1] += decay * v[:-1]
        new = v - step * g
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def fit_chain(x: Sparse, labels: np.ndarray, features: np.ndarray, chosen: np.ndarray, folds: np.ndarray, names: tuple[str, ...]) -> Chain:
    """Fit the models in the order of ``labels``' columns, on out-of-fold earlier predictions.

    ``chosen[category, fold]`` flags the features that the other folds choose, and
    ``chosen[category, FOLDS]`` those that all rows choose.
    """
    chain, seen = Chain(features, names, []), np.zeros((x.rows, 0))
    every = np.ones(x.rows, bool)
    for k, name in enumerate(names):
        dense, y = np.hstack([seen, np.ones((x.rows, 1))]), labels[:, k].astype(float)
        held = np.zeros(x.rows)
        for f in range(FOLDS):
            out = folds == f
            if out.any() and not out.all():
                columns = chosen[k, f]
                w = fit_logistic(x.only(~out, columns), dense[~out], y[~out])
                held[out] = _sigmoid(x.only(out, columns).times(w[: x.width]) + dense[out] @ w[x.width :])
        chain.weights.append(fit_logistic(x.only(every, chosen[k, FOLDS]), dense, y))
        chain.held_out[name] = (int(y.sum()), int((held[y == 1] >= THRESHOLD).sum()), int((y == 0).sum()), int((held[y == 0] >= THRESHOLD).sum()))
        seen = np.hstack([seen, held[:, None]])
    return chain


def _strong(hits: Column, others: Column, n_hits: int, n_others: int) -> Column:
    """Whether a feature in so many texts of a category, and so many others, is one of it."""
    return (hits >= LEAST_TEXTS) & ((hits + 0.5) * (n_others + 1) >= LEAST_RATIO * (others + 0.5) * (n_hits + 1))


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """Fit the chain on ``labels`` (doc_id, toxic and perhaps quality) of ``docs``.

    Rows without doc_id or toxic label are left out; of rows that repeat a doc_id one text
    is taken, with the label of the category if any of its rows has it.  Without rows of a
    category its model says 0.
    """
    categories = [c for c in CATEGORIES if c[1] in labels.columns]
    names = tuple(c[0] for c in categories)
    marks = [F.max(F.coalesce(F.col(c) == v, F.lit(False)).cast("int")).alias(f"is_{name}") for name, c, v in categories]
    known = labels.where(f"doc_id is not null and {categories[-1][1]} is not null").groupBy("doc_id").agg(*marks)
    known = known.select("doc_id", reduce(lambda a, b: a + b, (F.col(f"is_{name}") * (1 << k) for k, name in enumerate(names))).alias("mask"))
    n = known.count()
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    texts = settle(texts.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")))
    sizes = np.zeros((FOLDS, 1 << len(names)), np.int64)
    for r in texts.groupBy("fold", "mask").count().collect():  # FOLDS * 2 ** categories rows at most
        sizes[r["fold"], r["mask"]] = r["count"]
    of = np.array([[m >> k & 1 for m in range(1 << len(names))] for k in range(len(names))])  # masks of each category

    def in_marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                h, owner = feature_hashes(data, offsets)
                pairs = np.unique(np.stack([owner.astype(np.uint64), h]), axis=1)[1] if len(h) else h
                one, n = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.ascontiguousarray(one))), pa.array(n)], ["h", "n"])

    often = texts.where("mask > 0").select("text").mapInArrow(in_marked, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    hashes = np.sort(often.select("h").toArrow().column("h").to_numpy().view(np.uint64))  # in LEAST_TEXTS texts of the sample each
    if not len(hashes):
        return Chain(hashes, names, [np.array([0.0] * k + [-10.0]) for k in range(len(names))])
    shared = docs.sparkSession.sparkContext.broadcast(hashes)
    cells = FOLDS * (1 << len(names))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Lookup(shared.value)
        width = len(found.sorted)
        counts = np.zeros(cells * width, np.int32)
        for batch in batches:
            cell = batch.column(1).to_numpy().astype(np.int64) * (cells // FOLDS) + batch.column(2).to_numpy()
            for lo, _, data, offsets in text_blocks(batch.column(0)):
                h, owner = feature_hashes(data, offsets)
                k, at = found.find(h)
                both = np.unique(owner[k] * width + at)
                np.add.at(counts, cell[lo + both // width] * width + both % width, 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(signed(found.sorted[used % width])), pa.array((used // width).astype(np.int32)), pa.array(counts[used])], ["h", "cell", "n"])

    counts = texts.select("text", "fold", "mask").mapInArrow(counted, "h long, cell int, n int").groupBy("h").pivot("cell", list(range(cells))).agg(F.sum("n")).na.fill(0)
    tests = []
    for k in range(len(names)):
        for f in range(FOLDS + 1):
            rest = [(g, m) for g in range(FOLDS) for m in range(1 << len(names)) if g != f]
            hits, others = ([(g, m) for g, m in rest if of[k, m] == side] for side in (1, 0))
            total = lambda at: reduce(lambda a, b: a + b, (F.col(f"`{g * (cells // FOLDS) + m}`") for g, m in at))
            tests.append(_strong(total(hits), total(others), int(sum(sizes[g, m] for g, m in hits)), int(sum(sizes[g, m] for g, m in others))))
    flags = counts.select("h", F.array(*tests).alias("flags")).where(F.exists("flags", lambda x: x)).orderBy("h").toArrow()
    features = flags.column("h").to_numpy().view(np.uint64)
    taken = np.array(flags.column("flags").to_pylist(), bool).reshape(len(features), len(names), FOLDS + 1).transpose(1, 2, 0)
    order = np.argsort(features)
    features, taken = features[order], taken[:, :, order]
    rows = encoded(texts, features).toArrow()  # a row per text of the sample
    at, sums = (rows.column(c).combine_chunks() for c in ("at", "n"))
    count = np.diff(at.offsets.to_numpy())
    x = Sparse(np.repeat(np.arange(len(count)), count), at.flatten().to_numpy().astype(np.int64), np.log1p(sums.flatten().to_numpy()), len(count), len(features))
    mask = rows.column("mask").to_numpy()
    return fit_chain(x, (mask[:, None] >> np.arange(len(names)) & 1).astype(int), features, taken, rows.column("fold").to_numpy(), names)


def encoded(rows: DataFrame, features: np.ndarray) -> DataFrame:
    """mask, fold, and the positions and counts of the features in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Lookup(features)
        for batch in batches:
            for lo, hi, x in counts_of(batch.column(0), found):
                ends = np.searchsorted(x.row, np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (x.column, np.rint(np.expm1(x.value)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *lists], ["mask", "fold", "at", "n"])

    return rows.select("text", F.col("mask").cast("int").alias("mask"), "fold").mapInArrow(run, "mask int, fold int, at array<long>, n array<long>")


def counts_of(column: pa.Array, found: Lookup) -> Iterator[tuple[int, int, Sparse]]:
    """(first row, end row, log1p of the counts of the features) block by block, sorted by row."""
    width = len(found.sorted)
    for lo, hi, data, offsets in text_blocks(column, BLOCK_BYTES):
        h, owner = feature_hashes(data, offsets)
        k, at = found.find(h)
        code, n = np.unique(owner[k] * width + at, return_counts=True)
        yield lo, hi, Sparse(code // max(width, 1), code % max(width, 1), np.log1p(n), hi - lo, width)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, a probability per category, and is_toxic, for every row of ``docs``.

    A null or empty text holds no term and gets the probabilities of that; rows that are
    equal or repeat a doc_id are rows each; a null doc_id is carried along; other columns
    are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Lookup(chain.features)
        for batch in batches:
            for lo, hi, x in counts_of(batch.column(1), found):
                p = chain.predict(x)
                columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= THRESHOLD)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"p_{c}" for c in chain.names), "is_toxic"])

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.names) + ", is_toxic boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, with all their columns.

    Rows of null or empty text, and all rows that repeat others, are judged by their own text.
    """
    chain = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Lookup(chain.features)
        for batch in batches:
            for lo, hi, x in counts_of(batch.column(at), found):
                yield batch.slice(lo, hi - lo).filter(pa.array(chain.predict(x)[:, -1] < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
