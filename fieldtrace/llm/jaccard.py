"""Operator 2: exact n-gram Jaccard join.

Documents are sets of distinct word shingles; equal sets are one class.  The keys of a set
are its first elements in one global order, rarest first (prefix filter): two sets over the
threshold share a key, so no link is lost.  Each set has a hashed bitmap whose width is that
of its size band; sets that share a key meet in tiles of one size band and the next, where
sizes and bit counts bound the overlap from above.  A tile hands on a spanning forest of the
pairs it cannot rule out, so what leaves it is linear in its members.  The trees are
clusters; within a cluster, sorted shingle arrays are intersected exactly, likeliest pairs
first and only between sets that no link joins yet.

Large clusters are cut into blocks of bounded size: each block is joined within itself and
with a few pivots of its cluster, and then only sets outside the largest component of their
cluster meet the other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, components, mix, settle, shingle_sets, signed, text_blocks

WIDTH = 5
PERCENT = 80
#: Counters of the table that orders shingles by how common they are: a fixed size
#: whatever the corpus.  Any order gives the same links; a good one gives fewer candidates.
BUCKETS = 1 << 20
#: Members of a key that meet without a cut by size band, and sets in a block of a banded tile.
TILE = 4096
#: Rows that a task takes together where tiles are small.
SHARD = 8000
#: Elements and sets in a block of a cluster: what bounds the memory of exact tiles.
BLOCK_ITEMS, BLOCK_SETS = 1 << 19, 1024
#: Words of bitmaps that are compared at a time.
CELLS = 1 << 20
#: Members of one key that a task holds at a time while it looks for shared keys.
RUN = 1 << 20


def _prefix_length(n: int, percent: int) -> int:
    """Elements of a set of n of which any set at the threshold must share one."""
    return n - (percent * n + 99) // 100 + 1


def _set_hash(s: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix(s))) if len(s) else 0


def _bitmap(s: np.ndarray) -> bytes:
    """Hashed bitmap of a set; its width is that of the set's size band."""
    flags = np.zeros(64 << max(0, len(s).bit_length() - 5), np.uint8)
    flags[((s >> np.uint64(8)) & np.uint64(len(flags) - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def set_keys(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, h1, bits) of every document, and the level of each bucket.

    h1 is the 64-bit hash of the set, bits its bitmap.  Levels come from counters of all
    shingles of all documents: each task counts its own and hands on those well above its mean.
    """
    names = ["bucket", "doc_id", "n_shingles", "h1", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                n = np.array([len(s) for s in sets], np.int64)
                h1 = np.array([_set_hash(s) for s in sets], np.uint64)
                if n.sum():
                    counts += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
                bits = pa.array([_bitmap(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(hi - lo, pa.int64()), batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(signed(h1)), bits], names)
        common = np.flatnonzero(counts >= max(16, 8 * counts.mean()))
        none = pa.nulls(len(common), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(common, pa.int64()), none, pa.array(counts[common]), none, pa.nulls(len(common), pa.binary())], names)

    both = settle(docs.select("doc_id", "text").mapInArrow(run, "bucket long, doc_id long, n_shingles long, h1 long, bits binary"))
    levels = np.zeros(BUCKETS, np.uint8)
    sums = both.where("bucket is not null").groupBy("bucket").agg(F.sum("n_shingles").alias("n"))
    known = sums.select("bucket", F.floor(F.log2("n")).cast("int").alias("level")).toArrow()  # at most BUCKETS rows
    levels[known.column("bucket").to_numpy()] = known.column("level").to_numpy()
    return both.where("bucket is null").drop("bucket"), levels


def postings(docs: DataFrame, levels: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, node): the prefix of each set, rarest first, under the hash of the set.

    A task gives each set once, so copies of a text do not crowd their keys.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                keys, nodes = [], []
                for s in shingle_sets(data, offsets, width):
                    node = _set_hash(s)
                    if not len(s) or node in seen:
                        continue
                    seen.add(node)
                    order = np.argsort(level[s >> np.uint64(44)], kind="stable")
                    keys.append(s[order[: _prefix_length(len(s), percent)]])
                    nodes.append(np.full(len(keys[-1]), node, np.uint64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(signed(np.concatenate(nodes)))], ["key", "node"])

    return docs.where("doc_id is not null").select("text").mapInArrow(run, "key long, node long")


def shared_keys(posted: DataFrame) -> DataFrame:
    """(key, node, sig) of the keys that several sets share.

    Keys with the same members have the same sig, a hash of them, and one task gives one of
    them; a key of more than RUN members has a sig of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        seen: set[int] = set()
        huge = None  # key of which more than RUN members have been met
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy().view(np.uint64)])
            node = np.concatenate([node, batch.column(1).to_numpy().view(np.uint64)])
            if not len(key):
                continue
            last = int(np.searchsorted(signed(key), signed(key)[-1]))
            if huge is not None:
                own = int(np.searchsorted(signed(key), huge, "right"))
                yield _huge(key[:own], node[:own])
                if own < len(key):
                    huge = None
                key, node, last = key[own:], node[own:], max(last - own, 0)
            yield _runs(key[:last], node[:last], seen)
            key, node = key[last:], node[last:]
            if len(key) > RUN:
                yield _huge(key, node)
                huge = signed(key)[0]
                key, node = key[:0], node[:0]
        yield _runs(key, node, seen)

    return posted.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long, sig long")


def _keyed(key: np.ndarray, node: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(x)) for x in (key, node, sig)], ["key", "node", "sig"])


def _huge(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    new = np.concatenate([[True], node[1:] != node[:-1]])[: len(key)]
    return _keyed(key[new], node[new], mix(key[new]))


def _runs(key: np.ndarray, node: np.ndarray, seen: set[int]) -> pa.RecordBatch:
    """Members of the keys with several sets, from rows sorted by key and node."""
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])[: len(key)]
    key, node = key[new], node[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    size = np.diff(np.append(start, len(key)))
    sig = np.zeros(0, np.uint64)
    if len(start):
        sig = mix(np.bitwise_xor.reduceat(mix(node), start) + size.astype(np.uint64))
    wanted = np.zeros(len(start), bool)
    for k in np.flatnonzero(size > 1):
        if (mark := int(sig[k])) not in seen:
            seen.add(mark)
            wanted[k] = True
    rows = np.repeat(wanted, size)
    return _keyed(key[rows], node[rows], np.repeat(sig, size)[rows])


def key_tiles(crowd: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(shard, tile, side, node, n, bits) from (key, node) and (node, n, bits): where the members of a key meet.

    Up to TILE members meet in one tile.  A key with more is cut by size band, with bands as
    wide as sizes that can link are apart, and each band into blocks; a set meets its own
    band, and those of the bands next to it that the key has.
    """
    step = float(np.log(101 / percent))  # a little wider than sizes that link are apart
    band = F.floor(F.log("n") / step)
    sizes = crowd.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    many = settle(sizes.where(F.col("members") > TILE).select("key", "members", F.ceil(F.col("members") / TILE).alias("blocks")))
    bands = crowd.join(many.select("key"), "key").join(classes.select("node", "n"), "node").groupBy("key").agg(F.collect_set(band).alias("bands"))
    many = settle(many.join(bands, "key"))
    shards = (crowd.count() + (many.agg(F.sum(4 * F.col("members") * F.col("blocks")).alias("n")).first()["n"] or 0)) // SHARD + 1
    x = crowd.join(many.select("key", "blocks", "bands"), "key", "left").join(classes.select("node", "n", "bits"), "node")
    few = x.where("blocks is null").select(F.xxhash64("key").alias("tile"), F.lit(0).alias("side"), "node", "n", "bits")
    x = x.where("blocks is not null").withColumn("band", band).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    meets = F.expr(
        """concat(
            transform(sequence(block, blocks - 1), t -> struct(band as a, block as i, band as b, t as j, 0 as side)),
            transform(sequence(0L, block), t -> struct(band as a, t as i, band as b, block as j, 1 as side)),
            if(array_contains(bands, band + 1), transform(sequence(0L, blocks - 1), t -> struct(band as a, block as i, band + 1 as b, t as j, 0 as side)), array()),
            if(array_contains(bands, band - 1), transform(sequence(0L, blocks - 1), t -> struct(band - 1 as a, t as i, band as b, block as j, 1 as side)), array()))"""
    )
    # A block that meets itself does so once, as side 0.
    x = x.select("key", "node", "n", "bits", F.explode(meets).alias("m")).where("not (m.a = m.b and m.i = m.j and m.side = 1)")
    whole = F.when((F.col("m.a") == F.col("m.b")) & (F.col("m.i") == F.col("m.j")), 0).otherwise(F.col("m.side") + 1)
    tiles = few.unionByName(x.select(F.xxhash64("key", "m.a", "m.i", "m.b", "m.j").alias("tile"), whole.alias("side"), "node", "n", "bits"))
    return tiles.withColumn("shard", F.pmod("tile", F.lit(shards)))


def candidate_forest(tiles: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): in each tile a forest, likeliest pairs first, that spans the pairs of sets that
    neither sizes nor bit counts rule out.  Rows of side 0 meet each other, those of 1 those of 2."""

    def meet(table: pa.Table) -> pa.Table:
        tile, side, node, n = (table.column(c).to_numpy() for c in ("tile", "side", "node", "n"))
        order = np.lexsort((n, side, tile))
        tile, side, node, n = tile[order], side[order], node[order], n[order]
        words, at = _flat(table.column("bits"), pa.large_binary(), np.uint64)
        at, width = at[:-1][order], np.diff(at)[order]
        found = []
        for i, j in _pairs(tile, side, n, percent):
            most = _most_common(words, at, width, n, i, j)
            passed = most * 100 >= (n[i] + n[j] - most) * percent
            i, j, most = i[passed], j[passed], most[passed]
            if len(found) and len(i):
                i, j, most = (np.concatenate([x, y]) for x, y in zip(found.pop(), (i, j, most), strict=True))
            if len(i):
                keep = _forest(i, j, most / (n[i] + n[j] - most), len(n))
                found.append((i[keep], j[keep], most[keep]))
        i, j = found[0][:2] if found else (np.zeros(0, np.int64),) * 2
        ends = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1)
        return pa.table({"a": ends[0], "b": ends[1]})

    return tiles.groupBy("shard").applyInArrow(meet, "a long, b long").distinct()


def _flat(column: pa.ChunkedArray, kind: pa.DataType, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of byte strings or lists, and where each row's begin."""
    array = column.combine_chunks().cast(kind)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    if pa.types.is_large_binary(kind):
        size = np.dtype(dtype).itemsize
        data = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        return np.frombuffer(data.tobytes(), dtype), (offsets - offsets[0]) // size
    return array.values.to_numpy()[offsets[0] : offsets[-1]].view(dtype), offsets - offsets[0]


def _pairs(tile: np.ndarray, side: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one tile whose sides meet and whose sizes fit, some at a time; rows are sorted by tile and side."""
    new = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])[: len(tile)])
    end = np.repeat(np.append(new[1:], len(tile)), np.diff(np.append(new, len(tile))))
    ahead = end - np.arange(len(tile)) - 1
    total = np.cumsum(ahead)
    lo = 0
    while lo < len(tile):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CELLS, "right")))
        count = ahead[lo:hi]
        i = np.repeat(np.arange(lo, hi), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        fits = ((side[i] == 0) | (side[i] != side[j])) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
        yield i[fits], j[fits]
        lo = hi


def _most_common(words: np.ndarray, at: np.ndarray, width: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap of rows i and j by their bitmaps; widths are powers of two."""
    most = np.zeros(len(i), np.int64)
    for w in np.unique(width[i]):
        for v in np.unique(width[j[width[i] == w]]):
            pair = np.flatnonzero((width[i] == w) & (width[j] == v))
            to = min(w, v)
            for part in np.array_split(pair, 1 + len(pair) * int(max(w, v)) // CELLS):
                a = words[at[i[part]][:, None] + np.arange(w)].reshape(len(part), -1, to)
                b = words[at[j[part]][:, None] + np.arange(v)].reshape(len(part), -1, to)
                a, b = (x[:, 0] if x.shape[1] == 1 else np.bitwise_or.reduce(x, axis=1) for x in (a, b))
                lost = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64)
                most[part] = np.minimum(n[i[part]] - lost[0], n[j[part]] - lost[1])
    return most


def _joined(root: np.ndarray) -> np.ndarray:
    while not np.array_equal(further := root[root], root):
        root = further
    return root


def _forest(i: np.ndarray, j: np.ndarray, likely: np.ndarray, rows: int) -> np.ndarray:
    """Positions of the pairs of a spanning forest in which likelier pairs come first."""
    order = np.argsort(-likely, kind="stable")
    rank = np.empty(len(i), np.int64)
    rank[order] = np.arange(len(i))
    root, kept = np.arange(rows), []
    while True:
        a, b = root[i], root[j]
        live = a != b
        i, j, rank, a, b = i[live], j[live], rank[live], a[live], b[live]
        if not len(i):
            return order[np.concatenate(kept)] if kept else np.zeros(0, np.int64)
        best = np.full(rows, len(order))
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        chosen = (best[a] == rank) | (best[b] == rank)
        kept.append(rank[chosen])
        # Each tree hangs on the one that its likeliest pair leads to; of two that hang on each other one stays.
        up = np.arange(rows)
        first, second = best[a] == rank, best[b] == rank
        up[a[first]] = b[first]
        up[b[second]] = np.where(first[second], b[second], a[second])
        root = _joined(up)[root]


def exact_links(tiles: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that join, in each tile, all sets that chains of links in it join.

    ``tiles`` has tile, side, node, component and the sorted items; sets of one component
    are joined already.  Sides are those of ``candidate_forest``.
    """

    def meet(table: pa.Table) -> pa.Table:
        tile, side, node, component = (table.column(c).to_numpy() for c in ("tile", "side", "node", "component"))
        items, at = _flat(table.column("items"), pa.large_list(pa.int64()), np.uint64)
        n = np.diff(at)
        order = np.lexsort((n, side, tile))
        cuts = np.flatnonzero(np.concatenate([[True], tile[order][1:] != tile[order][:-1]]))
        links = [np.zeros((2, 0), np.int64)]
        for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            own = order[lo:hi]
            sets = [items[at[r] : at[r + 1]] for r in own]
            i, j = _linked(sets, side[own], component[own], percent)
            links.append(np.stack([node[own[i]], node[own[j]]]))
        ends = np.concatenate(links, axis=1)
        return pa.table({"a": ends.min(axis=0), "b": ends.max(axis=0)})

    return tiles.groupBy("shard").applyInArrow(meet, "a long, b long")


#: Rounds in which a spanning forest of the open pairs is checked before all that are left are.
ROUNDS = 6


def _linked(sets: list[np.ndarray], side: np.ndarray, component: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that link, enough of them to join all that links join; rows are sorted by side."""
    n = np.array([len(s) for s in sets], np.int64)
    root = np.unique(component, return_inverse=True)[1]
    width = 1 << int(max(6, (4 * int(n.mean())).bit_length() - 6)) if len(sets) > 2 else 0
    if width:  # wider bitmaps than those of the keys, one width for all
        flags = np.zeros((len(sets), width * 64), np.uint8)
        for r, s in enumerate(sets):
            flags[r, ((s >> np.uint64(8)) & np.uint64(width * 64 - 1)).astype(np.int64)] = 1
        words = np.packbits(flags, axis=1, bitorder="little").view(np.uint64).ravel()
        del flags
    at, same = np.arange(len(sets)) * width, np.full(len(sets), width)
    open_i, open_j, open_most = [], [], []
    for i, j in _pairs(np.zeros(len(sets), np.int64), side, n, percent):
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        most = _most_common(words, at, same, n, i, j) if width else np.minimum(n[i], n[j])
        passed = most * 100 >= (n[i] + n[j] - most) * percent
        open_i.append(i[passed])
        open_j.append(j[passed])
        open_most.append(most[passed])
    i, j, most = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (open_i, open_j, open_most))
    found_i, found_j = [], []
    for turn in range(ROUNDS + 1):
        apart = root[i] != root[j]
        i, j, most = i[apart], j[apart], most[apart]
        if not len(i):
            break
        asked = np.arange(len(i))
        if turn < ROUNDS:
            asked = _forest(root[i], root[j], most / (n[i] + n[j] - most), int(root.max()) + 1)
        common = np.array([_common(sets[x], sets[y]) for x, y in zip(i[asked], j[asked], strict=True)], np.int64)
        good = asked[common * 100 >= (n[i[asked]] + n[j[asked]] - common) * percent]
        found_i.append(i[good])
        found_j.append(j[good])
        if len(good):
            root = _merged(root[i[good]], root[j[good]], int(root.max()) + 1)[root]
        rest = np.ones(len(i), bool)
        rest[asked] = False
        i, j, most = i[rest], j[rest], most[rest]
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, np.int64),) * 2


def _merged(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The least id that pairs join to each of ``size`` ids."""
    root = np.arange(size)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        root = _joined(root)
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def with_items(docs: DataFrame, tiles: DataFrame, width: int = WIDTH) -> DataFrame:
    """``tiles`` (rep, node, meets, component) with the sorted items of each set, a row for each tile of ``meets``.

    Only texts of wanted documents leave the scan.  A document whose id repeats with other texts gives
    the set that was asked for; one that repeats with the same text gives it once.
    """
    near = IdFilter(tiles.select("rep")).kept(docs.select("doc_id", "text"), "doc_id")
    # An inner join: Catalyst would push a semi-join below the filter, and shuffle all texts.
    rows = near.join(tiles.withColumnRenamed("rep", "doc_id"), "doc_id")
    rows = rows.groupBy("doc_id", "node", F.xxhash64("text").alias("mark")).agg(*(F.first(c).alias(c) for c in ("text", "component", "meets")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(1).to_numpy()
            for lo, hi, data, offsets in text_blocks(batch.column(0)):
                sets = shingle_sets(data, offsets, width)
                own = [k for k, s in enumerate(sets) if _set_hash(s) == int(nodes[lo + k].view(np.uint64))]
                if own:
                    rest = batch.slice(lo, hi - lo).select([1, 2, 3]).take(pa.array(own))
                    ends = np.cumsum([0] + [len(sets[k]) for k in own])
                    items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(np.concatenate([sets[k] for k in own]))))
                    yield pa.RecordBatch.from_arrays([*rest.columns, items], ["node", "component", "meets", "items"])

    meets = "array<struct<tile: long, shard: long, side: int>>"
    found = rows.select("text", "node", "component", "meets").mapInArrow(run, f"node long, component long, meets {meets}, items array<long>")
    return found.select("node", "component", "items", F.explode("meets").alias("m")).select("node", "component", "items", "m.*")


def cluster_links(docs: DataFrame, forest: DataFrame, classes: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between nodes that join all that links join, from the candidate pairs ``forest``."""
    ends = settle(forest.select(F.col("a").alias("id")).unionByName(forest.select(F.col("b").alias("id"))).distinct())
    label = components(ends, forest).withColumnRenamed("id", "node").withColumnRenamed("component", "cluster")
    nodes = settle(label.join(classes, "node").select("node", "rep", "n", "cluster"))
    sizes = nodes.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("n").alias("items"),
        F.array_distinct(F.array(F.min("node"), F.max("node"), F.min_by("node", F.xxhash64("node")))).alias("pivots"),
    )
    sizes = settle(sizes.withColumn("blocks", F.ceil(F.greatest(F.col("members") / BLOCK_SETS, F.col("items") / BLOCK_ITEMS))))
    total = sizes.agg(F.sum("items").alias("items")).first()["items"] or 0
    shards = total // BLOCK_ITEMS + 1
    where = "struct({tile} as tile, pmod({tile}, {shards}L) as shard, {side} as side)".replace("{shards}", str(shards))
    nodes = nodes.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    own = where.format(tile="xxhash64(cluster, block)", side="0")
    every = where.format(tile="xxhash64(cluster, t)", side="0")
    first = nodes.withColumn("meets", F.expr(f"if(blocks > 1 and array_contains(pivots, node), transform(sequence(0L, blocks - 1), t -> {every}), array({own}))"))
    found = settle(exact_links(with_items(docs, first.select("rep", "node", F.col("node").alias("component"), "meets"), width), percent))

    cut = nodes.where("blocks > 1")
    if cut.isEmpty():
        return found
    label = components(cut.select(F.col("node").alias("id")), found.join(cut.select(F.col("node").alias("a")), "a", "left_semi"))
    cut = settle(cut.join(label.withColumnRenamed("id", "node"), "node"))
    parts = cut.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("items"))
    main = parts.groupBy("cluster").agg(F.max_by("component", "size").alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    cut = cut.join(main, "cluster").withColumn("minor", F.col("component") != F.col("main"))
    minor = cut.where("minor").groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_ITEMS)).alias("minors"))
    cut = cut.join(minor, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("minors")))
    # Every set, by its block, meets each block of sets outside the main component.
    left = where.format(tile="xxhash64(cluster, block, t)", side="1")
    right = where.format(tile="xxhash64(cluster, t, own)", side="2")
    cut = cut.withColumn("meets", F.expr(f"concat(transform(sequence(0L, minors - 1), t -> {left}), if(minor, transform(sequence(0L, blocks - 1), t -> {right}), array()))"))
    cut = settle(cut.select("rep", "node", "component", "meets"))
    if cut.isEmpty():
        return found
    return found.unionByName(settle(exact_links(with_items(docs, cut, width), percent)))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A text of fewer words than
    ``width`` has its word sequence as its one shingle; a null text, or one without
    words, has none and links with nothing.  component_id is the smallest doc_id
    that links reach.  Shingles, and sets, are told apart by 64-bit hashes.  A row without
    doc_id gets no component and links with nothing; rows that repeat a doc_id are one
    vertex, which has the links of all their texts; other columns are ignored.
    """
    keyed, levels = set_keys(docs, width)
    real = keyed.where("doc_id is not null and n_shingles > 0")
    classes = settle(real.groupBy(F.col("h1").alias("node")).agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits")))

    crowd = settle(shared_keys(postings(docs, levels, width, percent)))
    once = crowd.groupBy("sig").agg(F.min("key").alias("key"))
    crowd = settle(crowd.join(once, ["sig", "key"]).select("key", "node"))
    forest = settle(candidate_forest(key_tiles(crowd, classes, percent), percent))
    links = cluster_links(docs, forest, classes, width, percent)

    # Texts under one doc_id are one vertex.
    twice = real.groupBy("doc_id").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("doc_id", "a")
    links = settle(links.unionByName(real.join(twice, "doc_id").select("a", F.col("h1").alias("b")).where("a <> b")).distinct())
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    label = components(ends, links).withColumnRenamed("id", "node").join(classes.select("node", "rep"), "node")
    names = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = label.join(names, "component").select("node", "component_id")
    # Nodes without links are named by their own smallest doc_id.
    label = classes.select("node", "rep").join(label, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    of_doc = real.select("doc_id", F.col("h1").alias("node")).join(label, "node").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return keyed.join(of_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` but for all of a near-duplicate group save its smallest doc_id.

    Rows without doc_id stay.  Of rows that repeat a doc_id all stay or all go.  Other columns are carried along.
    """
    found = jaccard_components(docs, width, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
