"""Helpers shared by the training-data operators: text blocks, hashing, lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in blocks of about this many bytes, so that the numpy work
#: arrays of a task stay small whatever the size of an Arrow batch.
BLOCK_BYTES = 1 << 20
#: Bits of the filter through which texts of candidate documents are fetched again, per key and in all:
#: 16 MB at most, whatever the keys.  With more keys than that all rows pass, and the join behind it does the work.
KEY_BITS, FILTER_BITS = 8, 1 << 27

#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20
# Freed batches go back to the system and do not stay with idle Python workers.
pa.set_memory_pool(pa.system_memory_pool())

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_CODE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_CODE_LOWER = _BYTE_CODE[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only
    where that is unset (a local test) a folder of our own is used.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints; a cluster must name one, as a folder of the driver's is seen by no executor."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith(("local[", "local-")) and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Let the session hand texts to Python workers in small batches, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 3))
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, UTF-8 bytes, offsets) over a string column.

    Nulls count as empty texts.  A block holds whole texts; one text longer
    than ``limit`` makes a block of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def block_words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of the words of a block, ``[^\\x20\\x09-\\x0D]+`` if ``gaps`` doesn't say otherwise."""
    solid = ~gaps[data]
    n = len(data)
    first, last = solid.copy(), solid.copy()
    if n:
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edge = offsets[:-1][offsets[:-1] < n]
        first[edge] = solid[edge]
        edge = offsets[1:][offsets[1:] > 0] - 1
        last[edge] = solid[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased words (A-Z only)."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE_LOWER[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text of a block the sorted distinct 64-bit hashes of its word shingles.

    A text of fewer words than ``width`` has its whole word sequence as the one
    shingle; a text without words has none.
    """
    starts, ends, where = block_words(data, offsets)
    h = word_hashes(data, starts, ends)
    m = len(h) - width + 1
    grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if m > 0:
        grams = h[:m].copy()
        for k in range(1, width):
            grams = grams * _BASE + h[k : k + m]
        keep = where[:m] == where[width - 1 :]
        grams, owner = mix(grams[keep]), where[:m][keep]
    n = len(offsets) - 1
    cuts = np.searchsorted(owner, np.arange(n + 1))
    counts = np.bincount(where, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for i in range(n):
        if counts[i] >= width:
            s = np.sort(grams[cuts[i] : cuts[i + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif counts[i]:
            g = np.uint64(counts[i])
            for x in h[first[i] : first[i + 1]]:
                g = np.uint64((int(g) * int(_BASE) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([g], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


class IdFilter:
    """A bitmap over the hashes of a column, sized by the number of its rows; false positives only.

    Spark builds it; it lets scans skip most rows that no join will want.  For more rows than
    FILTER_BITS there is none, and every row passes.
    """

    def __init__(self, ids: DataFrame, hashed: bool = False, key_bits: int = KEY_BITS) -> None:
        """``hashed``: the column is a hash already, and its low bits are the position."""
        column = F.col(ids.columns[0]).cast("long")
        rows = ids.count()
        self.bits = min(FILTER_BITS, 1 << max(16, (key_bits * rows).bit_length()))
        self.map = b""
        if rows > FILTER_BITS:
            return
        at = column.bitwiseAND(self.bits - 1) if hashed else F.pmod(F.xxhash64(column), F.lit(self.bits))
        rows = ids.select((at + 1).alias("at"))  # buckets count from 1 and hold 32768 bits
        rows = rows.groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("map"))
        whole = bytearray(self.bits // 8)
        for r in rows.toLocalIterator():  # bits / 32768 rows of 4 KB
            whole[(r["bucket"] - 1) * 4096 : (r["bucket"] - 1) * 4096 + len(r["map"])] = r["map"]
        self.map = bytes(whole)

    def kept(self, rows: DataFrame, column: str, inside: bool = True) -> DataFrame:
        """``rows`` that the bitmap lets through (or, not ``inside``, those it does not).

        The bitmap comes as a broadcast table of one row, so that plans stay small.
        """
        if not self.map:
            return rows if inside else rows.where(F.lit(False))
        one = F.broadcast(rows.sparkSession.createDataFrame([(bytearray(self.map),)], "__bitmap binary"))
        at = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(self.bits))
        byte = F.substring(F.col("__bitmap"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))
        hit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(at, F.lit(8)).cast("int")) == 1
        return rows.join(one, F.coalesce(hit, F.lit(False)) == inside).drop("__bitmap")


#: Rounds and jumps that no table of 64-bit ids can need: two rounds halve what is left.
MOST_ROUNDS = 128
#: Contracted edges, both ways counted, that the driver settles itself: a fixed 1 MB whatever the input.
FEW_EDGES = 1 << 16


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: (id, component) with component = smallest reachable id.

    ``vertices`` has the column ``id``; ``edges`` has ``a`` and ``b``.  In a round every
    vertex hooks to its smallest neighbour if that is smaller, pointer doubling finds the
    roots of the trees, and the edges are contracted to edges between roots.  A root that
    no vertex hooked to has a smaller neighbour in the next round, so two rounds at least
    halve the vertices that have edges: rounds grow with the logarithm of their number,
    whatever the diameter.  Rounds end when no edge is left; the last FEW_EDGES are
    contracted on the driver, in the same way.  Vertices without edge keep their own id.
    """
    spark = edges.sparkSession
    left = edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
    left = settle(left.distinct())
    trees: list[DataFrame] = []
    while (n := left.count()) > FEW_EDGES:
        if len(trees) == MOST_ROUNDS:
            raise RuntimeError(f"components: {n} edges are left after {MOST_ROUNDS} rounds")
        trees.append(_roots(settle(left.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("root")))))
        for k in "ab":
            left = left.join(trees[-1].withColumnRenamed("id", k), k).drop(k).withColumnRenamed("root", f"root_{k}")
        left = settle(left.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).where("a <> b").distinct())
    if n:
        pairs = left.toArrow()
        trees.append(spark.createDataFrame(_small_roots(*(pairs.column(k).to_numpy() for k in "ab")), "id long, root long"))
    if not trees:
        return vertices.select("id", F.col("id").alias("component"))
    # A root of one round is a vertex of the next, unless it has no edge any more.
    label = trees.pop().withColumnRenamed("root", "component")
    while trees:
        above = label.withColumnRenamed("id", "root")
        label = trees.pop().join(above, "root", "left").select("id", F.coalesce("component", "root").alias("component"))
    return vertices.select("id").join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _roots(tree: DataFrame) -> DataFrame:
    """(id, root) of each vertex from (id, root) where ``root`` is any vertex above it, by pointer doubling."""
    for _ in range(MOST_ROUNDS):
        above = tree.select(F.col("id").alias("root"), F.col("root").alias("far"))
        new = settle(tree.join(above, "root").select("id", F.col("far").alias("root"), (F.col("far") < F.col("root")).alias("moved")))
        tree = new.select("id", "root")
        if new.where("moved").isEmpty():
            return tree
    raise RuntimeError(f"components: trees are not flat after {MOST_ROUNDS} jumps")


def _small_roots(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """(id, root) of the ends of a few edges, root = smallest reachable id."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return pa.table({"id": ids, "root": ids[root]})
