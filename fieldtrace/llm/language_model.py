"""Operator 3: language-model scores by a Brown class-based bigram model.

Words are counted over all training texts.  Units are the words that occur often enough
and, for all other words, their last two bytes, so that every word, seen or not, has one.
Exchange clustering moves units between classes as long as the class bigrams gain
likelihood: first the most frequent words and the endings on the driver, then all units
in Spark, over the counts of each unit beside each class.  A token's probability is the
class transition, times the unit's share of its class, times the word's share of its unit,
each smoothed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE_CODE, block_words, mix, powers, settle, signed, stored, text_blocks, word_hashes

#: Units clustered first: frequent words, endings, one for all other endings, and the text end.
#: From UNITS on come all other words that occur ATTESTED times or more, however many.
WORD_UNITS, ENDING_UNITS = 512, 510
UNITS = WORD_UNITS + ENDING_UNITS + 2
OTHER, END = UNITS - 2, UNITS - 1
CLASSES = 48
PASSES = 8
ATTESTED = 50
#: Passes over all units in Spark, and the gain a token (in nats) from which another follows.
MOVES, LEAST_GAIN = 4, 1e-3
#: Words whose counts every task holds; counts of rarer words are joined.
COMMON_WORDS = 1 << 19
#: Units whose neighbours are gathered together, and shards at least.
UNITS_A_SHARD, LEAST_SHARDS = 1024, 63
#: Words that a task gathers before it counts them.
GATHERED = 1 << 22
SMOOTH = 0.5


def _last_two(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last two bytes of each word, A-Z lower-cased, as one number."""
    low = np.arange(256)
    low[65:91] += 32
    last = low[data[ends - 1]]
    before = np.where(ends - starts > 1, low[data[np.maximum(ends - 2, 0)]], 0)
    return (before * 256 + last).astype(np.int64)


def training(docs: DataFrame) -> DataFrame:
    """Texts that are learnt from: crc32 of the id as text is not 1 modulo 5."""
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, ending, n): every distinct word of ``docs`` by its hash, with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        tails: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, first, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            tail = np.concatenate(tails)[first]
            held.clear()
            tails.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(tail), pa.array(n)], ["h", "ending", "n"])

        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                starts, ends, _ = block_words(data, offsets)
                held.append(word_hashes(data, starts, ends))
                tails.append(_last_two(data, starts, ends).astype(np.int32))
                if sum(map(len, held)) > GATHERED:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select("text").mapInArrow(run, "h long, ending int, n long")
    return rows.groupBy("h").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))


class WordTable:
    """Index of a hash in a sorted list of hashes, or -1; found through their top bits."""

    BITS = 20

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = hashes
        tops = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.start = np.searchsorted(tops, np.arange((1 << self.BITS) + 1))
        self.longest = int(np.diff(self.start).max()) if len(hashes) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        top = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        left = np.flatnonzero(at < end)
        for _ in range(self.longest):
            if not len(left):
                break
            hit = self.sorted[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


@dataclass
class Units:
    """What every task holds: common words with their counts, and the unit of any word."""

    hashes: np.ndarray  # sorted
    counts: np.ndarray
    word_unit: np.ndarray  # unit of a common word, or -1: by its ending
    ending_unit: np.ndarray  # 65536 endings
    start: np.ndarray  # of each unit, that among the first UNITS whose class it starts in

    def of(self, table: WordTable, h: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index among the common words or -1, unit) of each word."""
        at = table.find(h)
        unit = self.ending_unit[endings]
        known = np.flatnonzero(at >= 0)
        own = self.word_unit[at[known]]
        unit[known] = np.where(own >= 0, own, unit[known])
        return at, unit


def make_units(counts: DataFrame) -> tuple[Units, np.ndarray, np.ndarray]:
    """The units, and per unit its tokens and distinct words; they grow with the words that occur ATTESTED times."""
    # The least count that at most COMMON_WORDS words reach; there are few distinct counts.
    steps = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()
    least, room = 1 << 62, COMMON_WORDS
    for r in sorted(steps, key=lambda r: -r["n"]):
        room -= r["words"]
        if room < 0:
            break
        least = r["n"]
    least = min(least, ATTESTED)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array([c.to_numpy().tobytes()], pa.binary()) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(columns, ["h", "ending", "n"])

    rows = counts.where(F.col("n") >= least).select("h", "ending", "n").mapInArrow(packed, "h binary, ending binary, n binary").collect()
    h, tail, n = (np.concatenate([np.frombuffer(bytes(r[k]), t) for r in rows]) if rows else np.zeros(0, t) for k, t in enumerate((np.uint64, np.int32, np.int64)))
    order = np.lexsort((h, -n))
    h, tail, n = h[order], tail[order].astype(np.int64), n[order]
    unit = np.full(len(h), -1, np.int32)
    first = min(WORD_UNITS, len(h))
    own = max(first, int((n >= ATTESTED).sum()))
    unit[:own] = np.concatenate([np.arange(first), UNITS + np.arange(own - first)])
    tokens, types = np.zeros(UNITS + own - first, np.int64), np.zeros(UNITS + own - first, np.int64)
    tokens[unit[:own]], types[unit[:own]] = n[:own], 1
    mass, kinds = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).toLocalIterator():  # 65536 at most
        mass[r["ending"]], kinds[r["ending"]] = r["n"], r["k"]
    ending = tail[:own]
    np.subtract.at(mass, ending, n[:own])
    np.subtract.at(kinds, ending, 1)
    ending_unit = np.full(1 << 16, OTHER, np.int64)
    best = np.argsort(-mass, kind="stable")[:ENDING_UNITS]
    best = best[mass[best] > 0]
    ending_unit[best] = WORD_UNITS + np.arange(len(best))
    np.add.at(tokens, ending_unit, mass)
    np.add.at(types, ending_unit, kinds)
    start = np.concatenate([np.arange(UNITS), ending_unit[tail[first:own]]])
    order = np.argsort(h)
    return Units(h[order], n[order], unit[order], ending_unit, start), tokens, types


def unit_texts(docs: DataFrame, units: Units) -> DataFrame:
    """seq: the units of some whole texts as 32-bit numbers, the text end before the first and after each."""
    shared = docs.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = shared.value
        table = WordTable(u.hashes)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                seq, _, _, _ = unit_sequence(u, table, data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array([seq.astype("<i4").tobytes()], pa.binary())], ["seq"])

    return docs.select("text").mapInArrow(run, "seq binary")


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for seq in batch.column(0):
            yield np.frombuffer(seq.as_buffer(), "<i4").astype(np.int64)


def grouped(texts: DataFrame, group: np.ndarray, size: int) -> np.ndarray:
    """size x size counts of neighbouring groups, from the units of texts and the group of each unit."""
    shared = texts.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, counts = shared.value, np.zeros(size * size, np.int64)
        for seq in _sequences(batches):
            at = g[seq]
            counts += np.bincount(at[:-1] * size + at[1:], minlength=size * size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["cell", "n"])

    cells = texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # size * size at most
    out = np.zeros(size * size, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return out.reshape(size, size)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers, compressed byte by byte: sorted or small ones take about a byte a row."""
    planes = [np.ascontiguousarray(c.astype("<u4")).view(np.uint8).reshape(-1, 4).T.ravel() for c in columns]
    return zlib.compress(np.concatenate(planes).tobytes(), 1)


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(columns, 4, -1)
    return [np.ascontiguousarray(p.T).view("<u4").ravel().astype(np.int64) for p in planes]


def beside_classes(texts: DataFrame, cls: np.ndarray, classes: int = CLASSES) -> DataFrame:
    """(shard, counts): for the units of a shard, packed (w, cell, n): how often each class follows
    the unit (cell = class), stands before it (classes + class), and the unit follows itself (2 * classes)."""
    shared = texts.sparkSession.sparkContext.broadcast(cls)
    width, shards = 2 * classes + 1, 1 + max(len(cls) // UNITS_A_SHARD, LEAST_SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, held = shared.value, []

        def flush() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            w = code // width
            cell, shard = code - w * width, w % shards
            order = np.argsort(shard, kind="stable")
            w, cell, n = w[order], cell[order], n[order]
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            used = np.flatnonzero(np.diff(cuts))
            blobs = [packed(np.diff(w[a:b], prepend=0), cell[a:b], n[a:b]) for a, b in zip(cuts[used], cuts[used + 1], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "counts"])

        for seq in _sequences(batches):
            u, v = seq[:-1], seq[1:]
            held += [(u * width + cls[v])[u != END], (v * width + classes + cls[u])[v != END], u[u == v] * width + 2 * classes]
            if sum(map(len, held)) > GATHERED:
                yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(run, "shard int, counts binary")


def unit_sequence(u: Units, table: WordTable, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of a block as END w w END w END ..., and for each word: common index, hash, text.

    An END stands before the first text and after each, so neighbours never join texts.
    """
    starts, ends, where = block_words(data, offsets)
    h = word_hashes(data, starts, ends)
    at, unit = u.of(table, h, _last_two(data, starts, ends))
    seq = np.full(len(h) + len(offsets), END, np.int64)
    seq[np.arange(len(h)) + where + 1] = unit
    return seq, at, h, where


def exchange_clustering(pairs: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each unit: each in turn moves to the class where class bigrams gain most."""
    n = pairs.astype(float)
    weight = n.sum(axis=0) + n.sum(axis=1)
    order = np.argsort(-weight[:END], kind="stable")
    cls = np.zeros(len(n), np.int64)
    cls[order] = np.arange(len(order)) % (classes - 1)
    cls[END] = classes - 1  # the text end keeps a class of its own
    onehot = np.zeros((len(n), classes))
    onehot[np.arange(len(n)), cls] = 1
    right, left = n @ onehot, (onehot.T @ n).T  # per unit: counts to classes, from classes
    grid = onehot.T @ right
    for _ in range(passes):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            a, own = cls[w], n[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[a] -= own
            l[a] -= own
            grid[a] -= r
            grid[:, a] -= l
            grid[a, a] -= own
            gain = _gains(grid, r, l, own)
            b = int(gain[: classes - 1].argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            grid[b] += r
            grid[:, b] += l
            grid[b, b] += own
            if b != a:
                cls[w] = b
                left[:, a] -= n[w]
                left[:, b] += n[w]
                right[:, a] -= n[:, w]
                right[:, b] += n[:, w]
                moved += 1
        if not moved:
            break
    return cls


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _gains(grid: np.ndarray, r: np.ndarray, l: np.ndarray, own: float) -> np.ndarray:
    """Gain of adding a unit to each class; ``grid``, ``r`` and ``l`` are without it."""
    f = _xlogx
    rows, cols = grid.sum(axis=1), grid.sum(axis=0)
    gain = (f(grid + r) - f(grid)).sum(axis=1) + (f(grid + l[:, None]) - f(grid)).sum(axis=0)
    d = np.diagonal(grid)
    gain += f(d + r + l + own) - f(d + r) - f(d + l) + f(d)
    # adding w also raises the column (row) totals of the classes it neighbours; the same for all
    return gain - (f(rows + r.sum() + own) - f(rows) + f(cols + l.sum() + own) - f(cols))


def _likelihood(grid: np.ndarray) -> float:
    return float(_xlogx(grid.astype(float)).sum() - _xlogx(grid.sum(axis=0).astype(float)).sum() - _xlogx(grid.sum(axis=1).astype(float)).sum())


def exchange_passes(texts: DataFrame, cls: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each unit after passes in which every unit asks for its best class.

    What stands beside a unit is counted by class and gathered with its shard, and each unit
    asks against the same class by class table.  Moves of one pass are made together if that
    gains likelihood, else a half, a quarter or an eighth of them; without a gain the passes end.
    """
    grid = grouped(texts, cls, classes)
    best = _likelihood(grid)
    for turn in range(MOVES):
        shared = texts.sparkSession.sparkContext.broadcast((cls, grid.astype(float)))

        def ask(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cls, grid = shared.value
            place, width = np.full(len(cls), -1), 2 * classes + 1
            ids, sums = np.zeros(0, np.int64), np.zeros((0, width))
            for blob in (x for batch in batches for x in batch.column(1)):
                w, cell, n = unpacked(blob.as_buffer(), 3)
                w = np.cumsum(w)
                new = np.unique(w[place[w] < 0])
                place[new] = len(ids) + np.arange(len(new))
                ids, sums = np.concatenate([ids, new]), np.concatenate([sums, np.zeros((len(new), width))])
                np.add.at(sums, (place[w], cell), n)
            unit, to = [], []
            for w, x in zip(ids, sums, strict=True):
                a, own, r, l = cls[w], x[-1], x[:classes].copy(), x[classes:-1].copy()
                r[a] -= own
                l[a] -= own
                rest = grid.copy()
                rest[a] -= r
                rest[:, a] -= l
                rest[a, a] -= own
                gain = _gains(rest, r, l, own)
                b = int(gain[: classes - 1].argmax())
                if gain[b] > gain[a] + 1e-6:
                    unit.append(w)
                    to.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(to, pa.int64())], ["w", "to"])

        moves = beside_classes(texts, cls, classes).repartition("shard").mapInArrow(ask, "w long, to long").toArrow()  # one row per unit at most
        w, to = (moves.column(k).to_numpy() for k in ("w", "to"))
        chance = mix(w.astype(np.uint64) + np.uint64(turn << 40))
        for part in (1, 2, 4, 8):
            some = chance % np.uint64(part) == 0
            trial = cls.copy()
            trial[w[some]] = to[some]
            grid_then = grouped(texts, trial, classes)
            gained = _likelihood(grid_then) - best
            if gained > 0:
                cls, grid, best = trial, grid_then, best + gained
                break
        if gained < LEAST_GAIN * grid.sum():
            break
    return cls


@dataclass
class Model:
    units: Units
    cls: np.ndarray
    step: np.ndarray  # log10 P(class | class before)
    share: np.ndarray  # log10 P(unit | class), less log10 of the unit's word total
    train_tokens: int
    base_total: float  # N + (V + 1) / 2
    end_count: int


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the counts of all training words."""
    own = training(docs)
    counts = settle(word_counts(own))
    units, tokens, types = make_units(counts)
    texts = own.count()
    tokens[END], types[END] = texts, 1 if texts else 0
    seqs = stored(unit_texts(own, units), "unit-texts")
    cls = exchange_clustering(grouped(seqs, units.start, UNITS))[units.start]
    if len(cls) > UNITS:
        cls = exchange_passes(seqs, cls)
    grid = grouped(seqs, cls, CLASSES)
    single = (grid.sum(axis=0) + SMOOTH) / (grid.sum() + SMOOTH * CLASSES)
    step = np.log10((grid + 2 * single) / (grid.sum(axis=1, keepdims=True) + 2))
    of_class = np.bincount(cls, tokens, CLASSES)
    members = np.bincount(cls, minlength=CLASSES)
    share = np.log10((tokens + SMOOTH) / (of_class + SMOOTH * members)[cls])
    by_ending = slice(WORD_UNITS, END)
    share[by_ending] -= np.log10(tokens + SMOOTH * (types + 1))[by_ending]
    n = int(tokens.sum())
    return Model(units, cls, step, share, n, n + SMOOTH * (int(types.sum()) + 1), texts), counts


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs``.

    Tokens are words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and one end per text; a
    null or empty text is the end alone.  base_score is the smoothed unigram score,
    score that of the class model.  A row without doc_id is scored, but not learnt from
    and not held out; rows that repeat a doc_id stay separate; other columns are
    ignored.  Words are told apart by 64-bit hashes.
    """
    model, counts = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        u, table = m.units, WordTable(m.units.hashes)
        base_log = np.log10((u.counts + 0.5) / m.base_total)
        word_log = np.where(u.word_unit >= 0, 0.0, np.log10(u.counts + SMOOTH))
        nothing = np.log10(0.5 / m.base_total)
        end_log = np.log10((m.end_count + 0.5) / m.base_total)
        for batch in batches:
            ids, held = batch.column(0), batch.column(2)
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                size = hi - lo
                seq, at, h, where = unit_sequence(u, table, data, offsets)
                c = m.cls[seq]
                token_log = m.step[c[:-1], c[1:]] + m.share[seq[1:]]
                owner = np.concatenate([[0], np.cumsum(seq[1:] == END)])[:-1]
                score = np.bincount(owner, token_log, size)
                common = at >= 0
                base = np.bincount(where[common], base_log[at[common]], size) + end_log
                score += np.bincount(where[common], word_log[at[common]], size)
                n = np.bincount(where, minlength=size) + 1
                known = np.bincount(where[common], minlength=size) + (m.end_count > 0)
                # A word that is not common: as unseen for now; the join adds what it is more.
                rare = ~common
                base += np.bincount(where[rare], minlength=size) * nothing
                score += np.bincount(where[rare], minlength=size) * np.log10(SMOOTH)
                row = mix(_id_hashes(ids.slice(lo, size)) ^ _text_hashes(data, offsets))
                doc = pa.StructArray.from_arrays(
                    [ids.slice(lo, size), held.slice(lo, size), pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
                )
                yield pa.RecordBatch.from_arrays([pa.array(signed(row)), pa.array(signed(mix(row ^ np.uint64(0xA5A5)))), pa.array(np.zeros(size, np.int64)), doc], ["row", "h", "times", "doc"])
                if rare.any():
                    pair, times = _distinct(row[where[rare]], where[rare], h[rare])
                    yield pa.RecordBatch.from_arrays([pa.array(signed(pair[0])), pa.array(signed(pair[1])), pa.array(times), pa.nulls(len(times), doc.type)], ["row", "h", "times", "doc"])

    doc_type = "struct<doc_id: long, held_out: boolean, n_tokens: long, n_known: long, base_score: double, score: double>"
    flagged = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)).alias("held_out"))
    parts = flagged.mapInArrow(run, f"row long, h long, times long, doc {doc_type}")
    x = parts.join(counts.select("h", "n"), "h", "left").where("doc is not null or n is not null")
    more = F.coalesce(F.col("times") * F.log10((F.col("n") + 0.5) / 0.5), F.lit(0.0))
    more_score = F.coalesce(F.col("times") * F.log10((F.col("n") + SMOOTH) / SMOOTH), F.lit(0.0))
    seen = F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)
    x = x.groupBy("row").agg(F.first("doc", ignorenulls=True).alias("doc"), F.count("doc").alias("copies"), F.sum(more).alias("more"), F.sum(more_score).alias("more_score"), F.sum(seen).alias("seen"))
    # Rows that are equal in all count once here and are given back as often as they came.
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return x.select(
        "doc.doc_id",
        "doc.held_out",
        "doc.n_tokens",
        (F.col("doc.n_known") + (F.col("seen") / F.col("copies")).cast("long")).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("doc.base_score") + F.col("more") / F.col("copies")).alias("base_score"),
        (F.col("doc.score") + F.col("more_score") / F.col("copies")).alias("score"),
    )


def _id_hashes(ids: pa.Array) -> np.ndarray:
    """64-bit hashes of ids; a missing one has a hash of its own."""
    known = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(1))
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), np.uint64(0x5BD1E9955BD1E995), known)


def _text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hashes of the texts of a block, each from its own start."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[:-1], out=total[1:])
    return mix((total[offsets[1:]] - total[offsets[:-1]]) * down[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def _distinct(rows: np.ndarray, where: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs of a block and how often each occurs."""
    order = np.lexsort((h, where))
    r, x, w = rows[order], h[order], where[order]
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (x[1:] != x[:-1])])
    first = np.flatnonzero(new)
    return np.stack([r[first], x[first]]), np.diff(np.concatenate([first, [len(x)]]))
