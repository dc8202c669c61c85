"""Operator 12: phrase collocations by mergeable Misra-Gries summaries.

N-grams are dealt to hash partitions.  Every task adds up the n-grams of its texts, and the
sums of a partition are merged into one Misra-Gries summary.  Its capacity is the partition's
mass over the threshold, so what merging takes off a counter stays below the threshold, and
every n-gram that is frequent enough keeps one.  A second pass over the texts counts the
survivors exactly, by their text.  All else is joins over exact counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, BLOCK_BYTES, IdFilter, block_words, mix, settle, text_blocks, word_hashes

LONGEST, LEAST, PERCENT, TOP = 3, 10, 50, 2000
#: Mass a hash partition should have, and partitions there are at least.
MASS, LEAST_PARTS = 1 << 23, 64
#: Counters of a summary, times mass over threshold: one would do; with more, less is taken off and fewer rare n-grams survive.
ROOM = 4
#: N-grams a task gathers before it adds them up, and different phrases before it hands them on.
GATHER, PHRASES = 1 << 21, 1 << 21
#: Bits of the survivors' filter for each of them; the filter as a whole is bounded by IdFilter.
SURVIVOR_BITS = 32
#: Parts a language is ranked in before the best of the parts are.
RANK_PARTS = 32

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Words of a stretch of text: positions in ``data``, text, piece and hash of each.

    The first ``old`` of them end the stretch before, so that n-grams across the edge are met.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, piece: np.ndarray, h: np.ndarray, old: int) -> None:
        self.data, self.starts, self.ends, self.text, self.piece, self.h, self.old = data, starts, ends, text, piece, h, old

    def grams(self, size: int, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of ``size`` words that end in this stretch, and the place of their first word; ``salt`` by text."""
        count = len(self.h) - size + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.piece[:count] == self.piece[size - 1 :])
        at = at[at + size > self.old]
        g = salt[self.text[at]] + np.uint64(size)
        for k in range(size):
            g = g * _STEP + self.h[at + k]
        return mix(g), at


def stretches(column: pa.Array, longest: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, Words]]:
    """(first row, words) of the texts of a column; a text of several ``limit`` comes in several stretches."""
    for lo, _, data, offsets in text_blocks(column, limit):
        kept, pieces, begin = None, 0, 0
        while begin < len(data):
            end = len(data)
            if len(offsets) == 2 and end - begin > limit:
                gap = begin + limit
                while gap < end and not len(found := np.flatnonzero(_GAP[data[gap : gap + limit]])):
                    gap += limit
                end = gap + int(found[0]) if gap < end else end
            part = data[begin:end]
            inner = offsets if len(offsets) > 2 else np.array([0, end - begin])
            starts, ends, text = block_words(part, inner, _GAP)
            breaks = np.cumsum(_BREAK[part])
            piece = breaks[starts] + text + pieces
            new = [starts + begin, ends + begin, text, piece, word_hashes(part, starts, ends)]
            old = 0
            if kept is not None:
                old, new = len(kept[0]), [np.concatenate(x) for x in zip(kept, new, strict=True)]
            yield lo, Words(data, *new, old)
            kept = [x[max(0, len(x) - longest + 1) :] for x in new]
            pieces, begin = pieces + int(breaks[-1]), end


def _salts(langs: pa.Array) -> np.ndarray:
    """A 64-bit hash of the language of each row."""
    codes = langs.dictionary_encode()
    known = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in codes.dictionary.to_pylist()]
    return np.array(known, np.uint64)[codes.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)


def _prints(g: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition (upper half) and 32-bit fingerprint (lower half) of n-gram hashes."""
    part = (g >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return part << np.uint64(32) | g & np.uint64(0xFFFFFFFF)


def _added_up(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[start], np.diff(np.append(start, len(keys)))


_COLUMNS = ["part", "turn", "lang", "mass", "prints", "counts"]


def gram_sums(docs: DataFrame, longest: int, parts: int) -> DataFrame:
    """What the tasks find, by hash partition: its mass (turn 0), then fingerprints and counts (turn 1).

    Rows of turn 2 are numbers of words by language.
    """

    def rows(part: list[int] | np.ndarray, turn: int, lang: list, mass: np.ndarray | list, prints: list, counts: list) -> pa.RecordBatch:
        n = len(part)
        columns = [pa.array(part, pa.int32()), pa.array([turn] * n, pa.int32()), pa.array(lang, pa.string()), pa.array(mass, pa.int64()), pa.array(prints, pa.binary()), pa.array(counts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, _COLUMNS)

    def told(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = _added_up(np.concatenate(gathered))
        if not len(keys):
            return
        part = (keys >> np.uint64(32)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        none = [None] * len(start)
        yield rows(part[start], 0, none, np.add.reduceat(counts, start), none, none)
        prints, counts = keys.astype(np.uint32), counts.astype(np.uint32)
        for lo, hi in zip(start, np.append(start[1:], len(keys)), strict=True):
            yield rows(part[lo : lo + 1], 1, [None], [None], [prints[lo:hi].tobytes()], [counts[lo:hi].tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        gathered, size = [], 0
        for batch in batches:
            langs, salt = batch.column(0), _salts(batch.column(0))
            for lo, w in stretches(batch.column(1), longest):
                number = np.bincount(w.text[w.old :])
                for k in np.flatnonzero(number):
                    lang = langs[lo + int(k)].as_py()
                    words[lang] = words.get(lang, 0) + int(number[k])
                for n in range(1, longest + 1):
                    gathered.append(_prints(w.grams(n, salt[lo:])[0], parts))
                    size += len(gathered[-1])
                if size >= GATHER:
                    yield from told(gathered)
                    gathered, size = [], 0
        if gathered:
            yield from told(gathered)
        none = [None] * len(words)
        yield rows([-1] * len(words), 2, list(words), list(words.values()), none, none)

    return docs.select("lang", "text").mapInArrow(run, "part int, turn int, lang string, mass long, prints binary, counts binary")


class Summary:
    """A Misra-Gries summary of fingerprints with room for ``ROOM * mass // least`` counters.

    Each time ``lost`` rises by one, more than that many counters fall by one, and their sum
    is ``mass`` at most; so ``lost`` stays below ``least / ROOM``.
    """

    def __init__(self, mass: int, least: int) -> None:
        self.room, self.least, self.lost = ROOM * mass // least, least, 0
        self.new: list[np.ndarray] = []
        self.prints, self.counts, self.waiting = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def add(self, prints: np.ndarray, counts: np.ndarray) -> None:
        self.new.append(prints.astype(np.uint64) << np.uint64(32) | counts)
        self.waiting += len(prints)
        if self.waiting > max(self.room, 1 << 16):
            self.merge()

    def merge(self) -> None:
        both = np.sort(np.concatenate(self.new)) if self.new else np.zeros(0, np.uint64)
        fresh = (both >> np.uint64(32)).astype(np.uint32)
        start = np.flatnonzero(np.concatenate([[True], fresh[1:] != fresh[:-1]])[: len(fresh)])
        counts = np.add.reduceat((both & np.uint64(0xFFFFFFFF)).astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        fresh = fresh[start]
        at = np.minimum(np.searchsorted(self.prints, fresh), max(len(self.prints) - 1, 0))
        known = self.prints[at] == fresh if len(self.prints) else np.zeros(len(fresh), bool)
        self.counts[at[known]] += counts[known]
        prints = np.concatenate([self.prints, fresh[~known]])
        counts = np.concatenate([self.counts, counts[~known]])
        if len(prints) > self.room:
            cut = int(np.partition(counts, len(counts) - self.room - 1)[len(counts) - self.room - 1])  # the first count beyond the room
            prints, counts = prints[counts > cut], counts[counts > cut] - cut
            self.lost += cut
        order = np.argsort(prints)
        self.prints, self.counts, self.new, self.waiting = prints[order], counts[order], [], 0

    def survivors(self) -> np.ndarray:
        self.merge()
        return self.prints[self.counts + self.lost >= self.least]


def surviving_grams(sums: DataFrame, least: int) -> DataFrame:
    """(key, lang, words): fingerprints that may be of frequent n-grams; numbers of words pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mass, summary = None, 0, None

        def ended() -> Iterator[pa.RecordBatch]:
            if summary is not None:
                found = summary.survivors().astype(np.int64) | own << 32
                for k in range(0, len(found), 1 << 16):
                    key = pa.array(found[k : k + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([key, pa.nulls(len(key), pa.string()), pa.nulls(len(key), pa.int64())], ["key", "lang", "words"])

        for batch in batches:
            for part, turn, lang, m, prints, counts in zip(*(batch.column(c) for c in range(6)), strict=True):
                if turn.as_py() == 2:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([lang.as_py()], pa.string()), pa.array([m.as_py()], pa.int64())], ["key", "lang", "words"])
                    continue
                if part.as_py() != own:
                    yield from ended()
                    own, mass, summary = part.as_py(), 0, None
                if turn.as_py() == 0:
                    mass += m.as_py()
                else:
                    summary = summary or Summary(mass, least)
                    summary.add(np.frombuffer(prints.as_buffer(), np.uint32), np.frombuffer(counts.as_buffer(), np.uint32))
        yield from ended()

    return sums.repartition("part").sortWithinPartitions("part", "turn").mapInArrow(run, "key long, lang string, words long")


def exact_counts(docs: DataFrame, survivors: DataFrame, longest: int, parts: int) -> DataFrame:
    """(lang, phrase, size, f): what each task counts of n-grams that the survivors' filter lets pass."""
    passed = IdFilter(survivors, hashed=True, key_bits=SURVIVOR_BITS)
    shared, bits = docs.sparkSession.sparkContext.broadcast(passed.map), passed.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        counter = _Phrases()
        for batch in batches:
            langs, salt = batch.column(0), _salts(batch.column(0))
            for lo, w in stretches(batch.column(1), longest):
                found = []
                for size in range(1, longest + 1):
                    g, at = w.grams(size, salt[lo:])
                    if len(bitmap):
                        place = g & np.uint64(bits - 1)
                        hit = bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1
                        keep = np.flatnonzero(hit)
                        g, at = g[keep], at[keep]
                    found.append((g, at, np.full(len(g), size)))
                counter.add(w, langs, lo, *(np.concatenate(x) for x in zip(*found, strict=True)))
                if len(counter.keys) >= PHRASES:
                    yield from counter.told()
                    counter = _Phrases()
        yield from counter.told()

    return docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, size int, f long")


class _Phrases:
    """Exact counts of phrases of one task; texts of a task are told apart by 64-bit hashes."""

    def __init__(self) -> None:
        self.keys, self.row, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.texts: list[pa.Table] = []
        self.rows = 0

    def add(self, w: Words, langs: pa.Array, lo: int, g: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        keys, first, counts = np.unique(g, return_index=True, return_counts=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self.counts[self.row[place[known]]] += counts[known]
        new = np.flatnonzero(~known)
        if not len(new):
            return
        at, size = at[first[new]], size[first[new]]
        lang = langs.take(pa.array(w.text[at] + lo))
        self.texts.append(pa.table({"lang": lang, "phrase": _texts(w, at, size), "size": pa.array(size, pa.int32())}))
        row = self.rows + np.arange(len(new))
        self.rows += len(new)
        self.counts = np.concatenate([self.counts, counts[new]])
        keys, row = np.concatenate([self.keys, keys[new]]), np.concatenate([self.row, row])
        order = np.argsort(keys, kind="stable")
        self.keys, self.row = keys[order], row[order]

    def told(self) -> Iterator[pa.RecordBatch]:
        if self.texts:
            whole = pa.concat_tables(self.texts).append_column("f", pa.array(self.counts))
            yield from whole.to_batches(max_chunksize=1 << 16)


def _texts(w: Words, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """Lower-cased words ``at`` .. ``at + size - 1``, joined by spaces."""
    last = np.cumsum(size)
    word = np.repeat(at - (last - size), size) + np.arange(int(last[-1]))
    length = w.ends[word] - w.starts[word] + 1  # with the space behind it
    stop = np.cumsum(length)
    source = np.repeat(w.starts[word] - (stop - length), length) + np.arange(int(stop[-1]))
    text = _LOWER[w.data[np.minimum(source, len(w.data) - 1)]]
    text[stop - 1] = 32
    keep = np.ones(len(text), bool)
    keep[stop[last - 1] - 1] = False
    ends = np.concatenate([[0], stop[last - 1] - np.arange(1, len(at) + 1)])
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(text[keep].tobytes())).cast(pa.string())


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all n-grams of up to ``longest`` words that occur ``least`` times, and (lang, n)."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    parts = max(LEAST_PARTS, total * longest // 6 // MASS + 1)  # a word and its space take about six bytes; any number is right
    found = settle(surviving_grams(gram_sums(docs, longest, parts), least))
    words = found.where("lang is not null").groupBy("lang").agg(F.sum("words").alias("n"))
    counted = exact_counts(docs, found.where("key is not null").select("key"), longest, parts)
    counted = counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return settle(counted), words


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those at
    spaces and tabs into words.  Phrases are 2 to ``longest`` words of one piece that occur
    a >= ``least`` times in their language (null: ``und``).  A cut into a first part that
    occurs l times and a rest that occurs r times scores floor(10**6 * a * a / (l * r)); the
    lowest cut counts, the earliest of equal ones.  Phrases inside a longer phrase that
    occurs at least ``percent`` times for 100 of theirs are left out.  n is the number of
    words of the language.  Null and empty texts have no words; rows are counted each on its
    own, whether they repeat or not; other columns are ignored.  An empty table gives no rows.
    """
    counts, words = phrase_counts(docs, longest, least)
    phrases = counts.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    part = counts.select("lang", F.col("phrase").alias("part"), "f")
    cuts = phrases.where("size >= 2").select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    cuts = cuts.join(part.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"])
    cuts = cuts.join(part.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    score = "cast((1000000 * cast(a as decimal(16, 0)) * cast(a as decimal(16, 0))) div (cast(l as decimal(16, 0)) * cast(r as decimal(16, 0))) as bigint)"
    scored = cuts.withColumn("score", F.expr(score)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), s -> array_join(slice(split(phrase, ' '), s, n), ' '))))")
    longer = phrases.where("size > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True)))

    rows = open_.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
