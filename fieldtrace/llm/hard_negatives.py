"""Operator 11: hard negatives by slots of the score axis.

An anchor's positives are its best rows of the same label.  A positive's negatives are the
best rows of other labels whose score lies in a window that ends at the positive's score.
The upper limits of the windows cut the score axis into disjoint slots.  Anchors and rows
meet in tiles, each streamed by one task, which keeps the best few rows of each slot of each
anchor; so do the merges of the tiles.  Going down the slots, the best of a slot and of all
below it are those of a window that is open below, and its lower limit cuts off their end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

SCALE = 256
POSITIVES, NEGATIVES, PERCENT = 5, 5, 80
#: Anchors of a block, and rows of a share: what one tile holds, and what it streams.
BLOCK, SHARE = 1 << 14, 1 << 18
#: Shares a group of rows is cut into at least, so that a small table still makes many tasks.
LEAST_SHARES = 32
#: Scores that are computed at a time.
CELLS = 1 << 20
#: Vectors of a larger squared length take no part: their scores would leave the longs.
MOST_SQUARE = float(1 << 55)


def whole_vectors(vectors: DataFrame, anchor: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, anchor, dim, v): usable rows with components floor(scale * x), equal rows once."""
    e = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.select("vec_id", "label", F.coalesce(anchor, F.lit(False)).alias("anchor"), "embedding")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    small = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) <= MOST_SQUARE
    rows = rows.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    rows = rows.select("vec_id", F.col("label").cast("long").alias("label"), "anchor", F.size("embedding").alias("dim"), e.alias("v"))
    return rows.where(small).select("vec_id", "label", "anchor", "dim", F.transform("v", lambda x: x.cast("long")).alias("v")).distinct()


def best_in_slots(anchors: DataFrame, rows: DataFrame, keys: list[str], same_label: bool, most: int) -> DataFrame:
    """(anchor, slot, vec_id, score): the first ``most`` rows of each slot of each anchor of ``anchors``.

    Anchors are (node, vec_id, label, dim, v, limits, floors): slot k takes scores up to
    limits[k] that are over limits[k + 1] and not under floors[k]; without limits there is
    one slot of all scores.  Anchors and rows meet where ``keys`` are equal.
    """
    shares = rows.groupBy(*keys).agg(F.greatest(F.lit(LEAST_SHARES), F.ceil(F.count(F.lit(1)) / SHARE)).cast("int").alias("shares"))
    blocks = anchors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cut = settle(shares.join(blocks, keys))
    each = [*keys, "block", "share"]
    none = F.lit(None)
    left = anchors.join(cut, keys).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = left.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    left = left.select(F.xxhash64(*each).alias("tile"), F.lit(0).alias("side"), "node", "vec_id", "label", "v", "limits", "floors")
    right = rows.join(cut, keys).withColumn("share", F.pmod(F.xxhash64("vec_id", "v"), F.col("shares")).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.select(F.xxhash64(*each).alias("tile"), F.lit(1).alias("side"), none.cast("long").alias("node"), "vec_id", "label", "v", none.cast("array<long>").alias("limits"), none.cast("array<long>").alias("floors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for batch in batches:
            marks = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]])[: len(marks)])
            for lo, hi in zip(cuts, np.append(cuts[1:], len(marks)), strict=True):
                if tile is None or tile.mark != marks[lo]:
                    if tile is not None:
                        yield from tile.best()
                    tile = _Tile(int(marks[lo]), same_label, most)
                tile.add(batch.slice(lo, hi - lo))
        if tile is not None:
            yield from tile.best()

    both = left.unionByName(right).repartition("tile").sortWithinPartitions("tile", "side")
    found = both.mapInArrow(run, "node long, slot int, vec_id long, score long")
    first = Window.partitionBy("node", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= most).drop("turn")


class _Tile:
    """The anchors of a tile, and the best rows met so far of each of their slots."""

    def __init__(self, mark: int, same_label: bool, most: int) -> None:
        self.mark, self.same_label, self.most = mark, same_label, most
        self.sides: list[pa.RecordBatch] = []
        self.node = None
        self.found = np.zeros((4, 0), np.int64)  # row of the anchor, slot, score, vec_id

    def add(self, batch: pa.RecordBatch) -> None:
        first = int(np.searchsorted(batch.column(1).to_numpy(), 1))
        if first:
            self.sides.append(batch.slice(0, first))
        if first < len(batch) and self.sides:
            if self.node is None:
                self._open()
            self._meet(batch.slice(first))

    def _open(self) -> None:
        own = pa.Table.from_batches(self.sides).combine_chunks()
        self.node, self.vec_id, self.label = (own.column(c).to_numpy() for c in ("node", "vec_id", "label"))
        self.v = _matrix(own.column("v"))
        slots = [x or [None] for x in own.column("limits").to_pylist()]
        floors = [x or [None] for x in own.column("floors").to_pylist()]
        width = max(map(len, slots))
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        # Slots beyond an anchor's own hold no score.
        self.upper = np.array([[high if x is None else x for x in s] + [low] * (width - len(s)) for s in slots], np.int64)
        self.lower = np.array([[low if x is None else x for x in s] + [high] * (width - len(s)) for s in floors], np.int64)
        self.worst = np.full((len(self.node), width), low)  # score of the last of the best, where they are enough

    def _meet(self, batch: pa.RecordBatch) -> None:
        vec_id, label, v = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("v"))
        for a in range(0, len(self.node), CELLS >> 8):
            some = slice(a, a + (CELLS >> 8))
            step = max(1, CELLS // len(self.node[some]))
            for r in range(0, len(vec_id), step):
                part = slice(r, r + step)
                score = _products(self.v[some], v[part])
                fits = (score <= self.upper[some, :1]) & (score >= self.lower[some].min(axis=1)[:, None])
                fits &= (self.label[some, None] == label[None, part]) == self.same_label
                fits &= self.vec_id[some, None] != vec_id[None, part]
                i, j = np.nonzero(fits)
                score, i, j = score[i, j], i + a, j + r
                slot = (self.upper[i] >= score[:, None]).sum(axis=1) - 1
                good = (score >= self.lower[i, slot]) & (score >= self.worst[i, slot])
                self._keep(np.stack([i[good], slot[good], score[good], vec_id[j[good]]]))

    def _keep(self, new: np.ndarray) -> None:
        if not new.shape[1]:
            return
        x = np.concatenate([self.found, new], axis=1)
        x = x[:, np.lexsort((x[3], -x[2], x[1], x[0]))]
        start = np.flatnonzero(np.concatenate([[True], (x[:2, 1:] != x[:2, :-1]).any(axis=0)]))
        turn = np.arange(x.shape[1]) - np.repeat(start, np.diff(np.append(start, x.shape[1])))
        full = turn == self.most - 1
        self.worst[x[0, full], x[1, full]] = x[2, full]
        self.found = x[:, turn < self.most]

    def best(self) -> Iterator[pa.RecordBatch]:
        if self.found.shape[1]:
            i, slot, score, vec_id = self.found
            yield pa.RecordBatch.from_arrays([pa.array(self.node[i]), pa.array(slot, pa.int32()), pa.array(vec_id), pa.array(score)], ["node", "slot", "vec_id", "score"])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(array), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exactly: in doubles where those are exact."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if float((x * x).sum(axis=1).max(initial=0)) * float((y * y).sum(axis=1).max(initial=0)) < 2.0**104:
        return (x @ y.T).astype(np.int64)
    return a @ b.T


def hard_negatives(vectors: DataFrame, anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label; ``anchor`` says which rows are anchors, and
    all rows are searched.  A score is the inner product of floor(scale * x), exact in whole
    numbers; higher scores come first, then smaller vec_ids.  Positives are an anchor's first
    rows of its label, negatives the first rows of other labels with percent * positive_score
    <= 100 * negative_score <= 100 * positive_score, so none where the positive's score is
    negative.  Rows without vec_id or label, whose vector is null or holds a null or
    non-finite component, or is so long (a squared length over 2**55 after scaling) that
    scores would leave the longs, take no part; vectors of different length do not meet.
    Equal rows count once; rows with the anchor's own vec_id are not other rows.  Rows that
    repeat a vec_id with another label or vector are rows of their own, and anchors of their
    own.  Other columns are ignored; an empty table gives no rows.
    """
    rows = settle(whole_vectors(vectors, anchor, scale).withColumn("node", F.xxhash64("vec_id", "label", "v")))
    anchors = rows.where("anchor").drop("anchor")
    rows = rows.drop("anchor", "node")
    bare = anchors.withColumns({"limits": F.lit(None).cast("array<long>"), "floors": F.lit(None).cast("array<long>")})
    best = settle(best_in_slots(bare, rows, ["label", "dim"], True, positives).drop("slot"))

    # Slots end at the positives' different scores; a negative score has an empty window.
    limits = best.where("score >= 0").groupBy("node").agg(F.sort_array(F.collect_set("score"), asc=False).alias("limits"))
    floors = F.expr(f"transform(limits, p -> (p * {percent} + 99) div 100)")
    wanted = anchors.join(limits.withColumn("floors", floors), "node")
    found = best_in_slots(wanted, rows, ["dim"], False, negatives)

    own = found.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("order"), "vec_id"))).alias("found"))
    slot = lambda k: F.transform(F.filter("found", lambda x: x["slot"] == k), lambda x: F.struct((-x["order"]).alias("score"), x["vec_id"].alias("vec_id")))
    below = lambda acc: F.coalesce(F.get(acc, F.lit(0)), F.array().cast("array<struct<score: long, vec_id: long>>"))
    suffix = F.aggregate(
        F.sequence(F.size("limits") - 1, F.lit(0), F.lit(-1)),
        F.array().cast("array<array<struct<score: long, vec_id: long>>>"),
        lambda acc, k: F.concat(F.array(F.slice(F.concat(slot(k), below(acc)), 1, negatives)), acc),
    )
    top = own.join(limits, "node").select("node", "limits", suffix.alias("top"))
    pairs = best.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}).join(top, "node").where("positive_score >= 0")
    window = F.filter(F.element_at("top", F.array_position("limits", F.col("positive_score")).cast("int")), lambda x: x["score"] * 100 >= F.col("positive_score") * percent)
    out = pairs.join(anchors.select("node", F.col("vec_id").alias("anchor_id")), "node").select("anchor_id", "positive_id", "positive_score", F.posexplode(window).alias("at", "m"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("m.vec_id").alias("negative_id"), "positive_score", F.col("m.score").alias("negative_score"))
