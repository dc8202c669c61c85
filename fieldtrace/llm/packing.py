"""Operator 4: packing documents into training sequences by cutting-stock column generation.

Every document is the ids of its text followed by one end id.  A document longer
than a sequence gives whole sequences of its own and one remainder.  Remainders are
counted in a histogram of length classes; the cutting-stock linear program over
that histogram is solved by column generation (a knapsack dynamic program prices
new patterns), the solution is rounded down, and the documents of a class, ranked,
fill the slots of the patterns.  What rounding leaves over is laid out as one
stream that is cut at sequence ends, so it costs no padding.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

CAPACITY = 2048
END_ID = 1
#: Width of a length class in tokens.  The linear program has CAPACITY / UNIT rows,
#: whatever the size of the corpus.
UNIT = 8
#: Chunks of text in each of the two generations that a Python worker remembers; once the young
#: one is full it becomes the old one, whose chunks come back as they are met.
REMEMBERED = 150_000

#: ASCII marks; the tokenizer keeps a run of them apart from the letters before it.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of plain Latin letters, each one code point: they are one piece for the tokenizer's merges.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: Characters by which the tokenizer's merges know bytes: printable ones themselves, others from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}

_WORKERS: dict[str, "WordIds"] = {}


class WordIds(dict):
    """Ids of a text, through a memory of its white-space separated chunks.

    The tokenizer never forms an id across white space, so the ids of a text are
    those of its chunks in order.  The dictionary itself is the young generation.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            word = chunk.rstrip(MARKS)
            if word.isalpha():
                ids = array("I", [t.id for t in self.merges(word.decode())]).tobytes()
            elif LETTERS(text := word.decode()):
                ids = array("I", [t.id for t in self.merges(text.lower().encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()
            else:
                word, ids = b"", b""
            if len(word) < len(chunk):
                ids += self[chunk[len(word) :]] if word else array("I", self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()
        self[chunk] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a text, without the end id."""
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        return b"".join([self[c] for c in text.lower().split()])


def word_ids(path: str) -> WordIds:
    """The coder of this Python worker; kept from task to task."""
    if path not in _WORKERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _WORKERS[path] = WordIds(path)
    return _WORKERS[path]


def _encoded(batch: pa.RecordBatch, path: str) -> Iterator[tuple[int, bytes]]:
    """(row, ids with the end id) for the texts of a batch, one at a time."""
    coder, end = word_ids(path), np.array([END_ID], "<u4").tobytes()
    texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()).fill_null(b"")
    for k, text in enumerate(texts):
        yield k, coder.encode(text.as_py()) + end


def measured(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, doc_tokens, mark (64 bits of the ids), and the checksum of each piece that needs no further cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, marks, sums = [], [], []
            for _, ids in _encoded(batch, path):
                n.append(len(ids) // 4)
                marks.append(_mark(ids))
                sums.append([zlib.crc32(ids[at : at + 4 * capacity]) for at in range(0, len(ids), 4 * capacity)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(marks, pa.int64()), pa.array(sums, pa.list_(pa.int64()))],
                ["doc_id", "doc_tokens", "mark", "sums"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, doc_tokens long, mark long, sums array<long>")


def _mark(ids: bytes) -> int:
    return (zlib.crc32(ids) << 31) ^ zlib.adler32(ids)


def column_generation(demand: np.ndarray, capacity: int, max_rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Cutting stock: (patterns, multiplicities), rounded down.

    ``demand[k]`` items have the size k + 1; a pattern is a column of item counts of
    total size at most ``capacity``.  The restricted master program is kept by a
    revised simplex over equality rows; each round a knapsack program finds the
    pattern of least reduced cost.  It ends when none has a negative one, or when
    the bound that the duals give is within a half sequence.
    """
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return np.zeros((0, len(demand)), np.int64), np.zeros(0, np.int64)
    need = demand[sizes - 1].astype(float)
    columns = np.zeros((m, m))
    columns[np.arange(m), np.arange(m)] = capacity // sizes
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ need
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for _ in range(max_rounds):
        price = inverse.sum(axis=0)
        for c in range(1, capacity + 1):
            k = int(np.searchsorted(sizes, c, "right"))
            best[c], choice[c] = best[c - 1], -1
            if k:
                gain = best[c - sizes[:k]] + price[:k]
                j = int(gain.argmax())
                if gain[j] > best[c] + 1e-12:
                    best[c], choice[c] = gain[j], j
        total = x.sum()
        if best[capacity] <= 1 + 1e-9 or total - total / best[capacity] < 0.5:
            break
        pattern, c = np.zeros(m), capacity
        while c:
            if choice[c] < 0:
                c -= 1
            else:
                pattern[choice[c]] += 1
                c -= sizes[choice[c]]
        move = inverse @ pattern
        able = move > 1e-9
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, move, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x -= step * move
        x[out] = step
        inverse[out] /= move[out]
        rows = np.flatnonzero(np.abs(move) > 1e-12)
        rows = rows[rows != out]
        inverse[rows] -= move[rows, None] * inverse[out]
        columns[:, out] = pattern
    times = np.floor(np.maximum(x, 0) + 1e-7).astype(np.int64)
    patterns = np.zeros((m, len(demand)), np.int64)
    patterns[:, sizes - 1] = columns.T.astype(np.int64)
    left = demand.astype(np.int64).copy()
    for p in range(m):  # float noise must not ask for more than there is
        own = patterns[p] > 0
        times[p] = max(0, min(times[p], int((left[own] // patterns[p][own]).min()) if own.any() else 0))
        left -= times[p] * patterns[p]
    used = times > 0
    return patterns[used], times[used]


def stream_cuts(total: int, capacity: int = CAPACITY) -> np.ndarray:
    """Ends of the sequences of a stream: whole ones, then powers of two for the rest."""
    ends = list(range(capacity, total + 1, capacity))
    at = ends[-1] if ends else 0
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        ends.append(at)
    return np.array(ends, np.int64)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences; one row per piece of a document.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A null
    or empty text is a document of the end id alone; rows that repeat a doc_id are
    packed each on its own; a null doc_id is carried along; other columns are ignored;
    an empty table gives no rows.  ``path`` names the tokenizer file, read on the
    executors.
    """
    spark = docs.sparkSession
    classes = -(-capacity // unit)
    base = settle(measured(docs, path, capacity).withColumn("row", F.monotonically_increasing_id()))
    rest_of = base.withColumn("length", F.col("doc_tokens") % capacity).where("length > 0")
    rest_of = rest_of.select("row", "doc_id", "doc_tokens", "length", F.ceil(F.col("length") / unit).cast("int").alias("class"), F.element_at("sums", -1).alias("ids_crc32"), F.shiftright("row", 33).alias("part"))
    counts = rest_of.groupBy("class", "part").count()
    demand = np.zeros(classes, np.int64)
    for r in counts.groupBy("class").agg(F.sum("count").alias("n")).collect():  # at most ``classes`` rows
        demand[r["class"] - 1] = r["n"]
    patterns, times = column_generation(demand, capacity // unit)

    first_id, taken, slots = 0, np.zeros(classes, np.int64), []
    for pattern, n in zip(patterns, times, strict=True):
        for k in np.flatnonzero(pattern):
            slots.append((int(k) + 1, int(taken[k]), int(taken[k] + pattern[k] * n), int(pattern[k]), first_id))
            taken[k] += pattern[k] * n
        first_id += int(n)
    # At most classes ** 2 rows, by the number of patterns and of sizes in each.
    slot_table = F.broadcast(spark.createDataFrame(slots, "class int, lo long, hi long, each long, first long"))
    bounds = F.broadcast(spark.createDataFrame([(k + 1, int(t)) for k, t in enumerate(taken)], "class int, taken long"))

    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("class").orderBy("part")) - F.col("count")).drop("count")
    ranked = (
        rest_of.withColumn("in_part", F.row_number().over(Window.partitionBy("class", "part").orderBy(F.desc("length"), "row")) - 1)
        .join(before, ["class", "part"])
        .withColumn("rank", F.col("in_part") + F.col("before"))
        .join(bounds, "class")
    )
    ranked = settle(ranked.drop("in_part", "before", "part"))
    placed = ranked.where("rank < taken").join(slot_table, "class").where("rank >= lo and rank < hi")
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each")))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row")
    placed = placed.withColumn("offset", F.sum("length").over(order) - F.col("length"))
    placed = placed.select("doc_id", (F.col("doc_tokens") - F.col("length")).alias("start"), "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    whole = base.select("row", "doc_id", "doc_tokens", F.posexplode(F.slice("sums", F.lit(1), F.floor(F.col("doc_tokens") / capacity).cast("int"))).alias("k", "ids_crc32"))
    whole = whole.withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 61))
    whole = whole.select("doc_id", (F.col("k") * F.lit(capacity).cast("long")).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))

    # Rounding leaves at most one instance of each pattern: at most classes ** 2 documents.
    left = [(r["row"], r["length"], r["doc_tokens"]) for r in ranked.where("rank >= taken").select("row", "length", "doc_tokens").orderBy("row").collect()]
    return placed.unionByName(whole).unionByName(_streamed(docs, base, left, path, capacity, first_id))


def _streamed(docs: DataFrame, base: DataFrame, left: list[tuple[int, int, int]], path: str, capacity: int, first_id: int) -> DataFrame:
    """Pieces of the documents that rounding left over, cut where sequences of the stream end."""
    spark = docs.sparkSession
    sizes = np.array([n for _, n, _ in left], np.int64)
    at = np.cumsum(sizes) - sizes
    ends = stream_cuts(int(sizes.sum()), capacity)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    spots = F.broadcast(spark.createDataFrame([(row, int(a)) for (row, _, _), a in zip(left, at, strict=True)], "row long, at long"))
    wanted = base.select("row", "doc_id", "doc_tokens", "mark").join(spots, "row")
    wanted = F.broadcast(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("doc_tokens", "mark", "at")).alias("spots")))
    cuttable = docs.select("doc_id", "text").join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])).select(docs["doc_id"], "text", "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids_of, spots_of = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for k, ids in _encoded(batch, path):
                n, mark = len(ids) // 4, _mark(ids)
                tail = n - n % capacity
                for spot in spots_of[k]:
                    if spot["doc_tokens"] != n or spot["mark"] != mark:
                        continue
                    a, stop = spot["at"], spot["at"] + n - tail
                    j = int(np.searchsorted(ends, a, "right"))
                    while a < stop:
                        b = min(stop, int(ends[j]))
                        s = tail + a - spot["at"]
                        rows.append((ids_of[k], s, b - a, zlib.crc32(ids[4 * s : 4 * (s + b - a)]), n, first_id + j, a - int(starts[j])))
                        a, j = b, j + 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], names)

    pieces = cuttable.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    # Rows of equal ids under one doc_id each give the pieces of all their spots, which are equal.
    return pieces.dropDuplicates(["sequence_id", "offset"])
