"""Operator 5: removal of repeated byte strings by deep-shallow suffix sorting.

A string of SPAN bytes that starts at two or more places is removed wherever it lies.
Each window of SPAN bytes is found through its anchor, the gram of least hash in it, so
equal windows have equal anchors at equal distances.  Windows of an anchor are taken in
short ranges of distances; all windows of a range hold the same core.  Ranges whose core
occurs once are done.  Ranges of equal core and equal surroundings are repeated as a
whole and need no sorting, so copies cost nothing.  The rest, one per distinct
surroundings, go to shards of bounded size; there the suffixes that start at the cores
are sorted, by multikey quicksort to a shallow depth and by blind tries beyond it, and
the common prefixes tell how far each pair of places agrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE_CODE, IdFilter, mix, powers, settle, signed, text_blocks

SPAN = 400
GRAM = 64
#: Distances from window start to anchor are taken in ranges of so many.
RANGE = 128
#: Places of one core that are compared in one block, and places in a shard.
BLOCK, SHARD = 256, 2000
#: Bytes that multikey quicksort orders; beyond them a blind trie does.
SHALLOW = 32


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[:-1], out=total[1:])
    return total


def _hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(total))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by running minima of blocks from both ends."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored_ranges(data: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> dict[str, np.ndarray]:
    """All windows of the texts of a block, as ranges of neighbouring windows of one anchor.

    text, at (anchor in its text), lo and hi (distances from window start to anchor),
    key (hash of the core that all windows of such distances hold), ctx (hash of all
    bytes that the windows of this range cover).
    """
    sizes = np.diff(offsets)
    none = np.zeros(0, np.int64)
    if len(data) < span or sizes.max() < span:
        return {"text": none, "at": none, "lo": none, "hi": none, "key": none.view(np.uint64), "ctx": none.view(np.uint64)}
    total = _prefix_sums(data)
    places = np.arange(len(data) - GRAM + 1)
    grams = _hashes(total, places, places + GRAM)
    keys = (grams >> np.uint64(32) << np.uint64(32)) | places.astype(np.uint64)
    least = _sliding_min(keys, span - GRAM + 1)
    starts = np.concatenate([np.arange(offsets[i], offsets[i + 1] - span + 1) for i in np.flatnonzero(sizes >= span)])
    anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    far = anchor - starts
    part = far // RANGE
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    p, hi, lo, part = anchor[first], far[first], far[last], part[first]
    least_far, most_far = part * RANGE, np.minimum(part * RANGE + RANGE - 1, span - GRAM)
    text = np.searchsorted(offsets, p, "right") - 1
    key = mix(_hashes(total, p - least_far, p - most_far + span) + part.astype(np.uint64))
    ctx = mix(_hashes(total, p - hi, p - lo + span) + (lo * 1024 + hi).astype(np.uint64))
    return {"text": text, "at": p - offsets[text], "lo": lo, "hi": hi, "key": key, "ctx": ctx}


def ranges(rows: DataFrame, wanted: bytes | None = None, span: int = SPAN) -> DataFrame:
    """(key, ctx, row, at, lo, hi) of ``rows`` (row, text); with a bitmap only keys in it."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value or b"", np.uint8)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, data, offsets in text_blocks(batch.column(1)):
                r = anchored_ranges(data, offsets, span)
                keep = slice(None)
                if len(bitmap):
                    bit = (r["key"] & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
                    keep = bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(r["key"][keep])), pa.array(signed(r["ctx"][keep])), pa.array(ids[lo + r["text"][keep]]), pa.array(r["at"][keep]), pa.array(r["lo"][keep].astype(np.int16)), pa.array(r["hi"][keep].astype(np.int16))],
                    ["key", "ctx", "row", "at", "lo", "hi"],
                )

    return rows.select("row", "text").mapInArrow(run, "key long, ctx long, row long, at long, lo short, hi short")


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the longest common prefix of two strings known to agree before ``start``."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    lo, hi = start, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Strings that agree to some depth, by the positions where they branch only.

    A string goes down by the bytes at branching positions, meets some leaf, and the
    comparison with that one leaf tells where it must branch off.
    """

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: object = None

    def insert(self, i: int, depth: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):
            at, kids = node
            node = kids.get(s[at] if at < len(s) else -1) or next(iter(kids.values()))
        other = self.strings[node[0]]
        split = common_prefix(s, other, depth)
        if split == len(s) == len(other):
            node.append(i)
            return
        parent, byte, node = None, -1, self.root
        while isinstance(node, tuple) and node[0] < split:
            parent, byte = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][byte]
        mine = s[split] if split < len(s) else -1
        if isinstance(node, tuple) and node[0] == split:
            node[1][mine] = [i]
            return
        theirs = other[split] if split < len(other) else -1
        fork = (split, {mine: [i], theirs: node})
        if parent is None:
            self.root = fork
        else:
            parent[1][byte] = fork

    def ordered(self) -> tuple[list[int], list[int]]:
        """Indices in string order, and the common prefix of each with the next."""
        order: list[int] = []
        lcp: list[int] = []
        stack: list[tuple[object, int]] = [(self.root, 0)]
        while stack:
            node, up = stack.pop()
            if isinstance(node, tuple):
                kids = sorted(node[1].items())
                for k, (_, kid) in reversed(list(enumerate(kids))):
                    stack.append((kid, node[0] if k else up))
            else:
                for j, i in enumerate(node):
                    if order:
                        lcp.append(len(self.strings[i]) if j else up)
                    order.append(i)
        return order, lcp


def multikey_groups(strings: list[bytes], shallow: int = SHALLOW) -> list[np.ndarray]:
    """Groups of equal first ``shallow`` bytes, in string order, by ternary partition on 8-byte keys."""
    words = shallow // 8
    grid = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), ">u8").reshape(len(strings), words).astype(np.uint64)
    out: list[np.ndarray] = []
    stack = [(np.arange(len(strings)), 0)]
    while stack:
        rows, depth = stack.pop()
        if not len(rows):
            continue
        if len(rows) == 1 or depth == words:
            out.append(rows)
            continue
        column = grid[rows, depth]
        pivot = column[len(column) // 2]
        stack.append((rows[column > pivot], depth))
        stack.append((rows[column == pivot], depth + 1))
        stack.append((rows[column < pivot], depth))
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> Iterator[tuple[list[int], list[int]]]:
    """Sort suffixes; yield each group that agrees to the shallow depth, ordered, with its
    common prefixes.  Groups come in string order too."""
    for rows in multikey_groups(strings, shallow):
        trie = BlindTrie(strings)
        for i in rows.tolist():
            trie.insert(i, 0)
        yield trie.ordered()


def repeated_windows(left: list[bytes], right: list[bytes], core: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, which of its ``width`` windows another place has too) for places with shared suffixes.

    Window t takes t bytes before the core and width - 1 - t bytes after it.
    """
    for order, lcp in deep_shallow(right):
        m = len(order)
        if m < 2:
            continue
        before = np.zeros((m, width), np.uint8)
        size = np.array([len(left[i]) for i in order])
        for k, i in enumerate(order):
            before[k, : len(left[i])] = np.frombuffer(left[i], np.uint8)[::-1]
        steps = np.array(lcp, np.int64)
        for k in range(m):
            reach = np.empty(m, np.int64)
            reach[k + 1 :] = np.minimum.accumulate(steps[k:]) if k < m - 1 else 0
            reach[:k] = np.minimum.accumulate(steps[:k][::-1])[::-1]
            reach[k] = 0
            partner = np.flatnonzero(reach >= core)
            if not len(partner):
                continue
            differ = before[partner] != before[k]
            back = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            back = np.minimum(back, np.minimum(size[partner], size[k]))
            lo = np.maximum(0, width - 1 - (reach[partner] - core))
            good = lo <= back
            marks = np.zeros(width + 2, np.int64)
            np.add.at(marks, lo[good], 1)
            np.add.at(marks, np.minimum(back[good], width - 1) + 1, -1)
            hit = np.cumsum(marks)[:width] > 0
            if hit.any():
                yield order[k], hit


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def sort_shard(rows: pd.DataFrame, span: int = SPAN) -> pd.DataFrame:
    """Repeated windows among the places of a shard: row, at, lo, hi.

    Of cores that need several blocks each block also gives its distinct windows, for
    the comparison between blocks: window (hash), open (not yet known as repeated).
    """
    out: list[tuple] = []
    for (_, part, _), group in rows.groupby(["key", "part", "block"], sort=False):
        least, most = part * RANGE, min(part * RANGE + RANGE - 1, span - GRAM)
        width, core = most - least + 1, span - (most - least)
        g = group.reset_index(drop=True)
        left = [c[: max(0, h - least)] for c, h in zip(g["bytes"], g["hi"], strict=True)]
        right = [c[max(0, h - least) :] for c, h in zip(g["bytes"], g["hi"], strict=True)]
        found = {i: hit for i, hit in repeated_windows(left, right, core, width)}
        blocks, seen = g["blocks"].iloc[0], set()
        for i in range(len(g)):
            r_row, r_at, lo, hi, times = g.at[i, "row"], g.at[i, "at"], g.at[i, "lo"] - least, g.at[i, "hi"] - least, g.at[i, "times"]
            hit = found.get(i, np.zeros(width, bool))
            if times == 1:
                own = hit.copy()
                own[:lo] = False
                own[hi + 1 :] = False
                out += [(r_row, r_at, a + least, b + least, None, False) for a, b in _runs(own)]
            if blocks > 1:
                data = np.frombuffer(g.at[i, "bytes"], np.uint8)
                total = _prefix_sums(data)
                t = np.arange(lo, hi + 1)
                for k, w in zip(t.tolist(), signed(_hashes(total, hi - t, hi - t + span)).tolist(), strict=True):
                    is_open = times == 1 and not hit[k]
                    if is_open or w not in seen:
                        seen.add(w)
                        out.append((r_row, r_at, k + least, k + least, w, is_open))
    return pd.DataFrame(out, columns=["row", "at", "lo", "hi", "window", "open"])


def repeated_bytes(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """(row, first, last): starts of windows of ``rows`` (row, text) that occur elsewhere too."""
    shared = settle(ranges(rows, span=span).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    some = settle(ranges(rows, IdFilter(shared, hashed=True).map, span).join(shared, "key", "left_semi"))
    same = some.groupBy("key", "ctx", "lo", "hi").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "at")).alias("one"))
    same = settle(same.select("key", "ctx", "lo", "hi", "times", "one.row", "one.at"))
    whole = some.join(same.where("times > 1").select("key", "ctx", "lo", "hi"), ["key", "ctx", "lo", "hi"], "left_semi").select("row", "at", "lo", "hi")

    mixed = same.groupBy("key").agg(F.count(F.lit(1)).alias("contexts"), F.min("times").alias("least")).where("contexts > 1 and least = 1").select("key", F.ceil(F.col("contexts") / BLOCK).alias("blocks"))
    to_sort = same.join(mixed, "key")
    place = F.struct("key", "ctx", "at", "lo", "hi", "times", "blocks")
    to_sort = settle(to_sort.groupBy("row").agg(F.collect_list(place).alias("places")))  # a text's own anchors
    near = IdFilter(to_sort.select("row")).kept(rows, "row").dropDuplicates(["row"]).join(to_sort, "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, places in enumerate(batch.column(2)):
                raw = texts[i].as_py().encode()
                p = places.as_py()
                piece = [raw[x["at"] - x["hi"] : x["at"] - x["lo"] + span] for x in p]
                columns = [pa.array([x[k] for x in p], pa.int64()) for k in ("key", "ctx", "at", "lo", "hi", "times", "blocks")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([ids[i]] * len(p), pa.int64()), pa.array(piece, pa.binary())], ["key", "ctx", "at", "lo", "hi", "times", "blocks", "row", "bytes"])

    places = near.select("row", "text", "places").mapInArrow(cut, "key long, ctx long, at long, lo long, hi long, times long, blocks long, row long, bytes binary")
    n = to_sort.agg(F.sum(F.size("places"))).first()[0] or 0
    places = places.withColumns({"part": F.floor(F.col("lo") / RANGE), "block": F.pmod("ctx", F.col("blocks"))})
    places = places.withColumn("shard", F.pmod(F.xxhash64("key", "block"), F.lit(n // SHARD + 1)))
    done = settle(places.groupBy("shard").applyInPandas(lambda r: sort_shard(r, span), "row long, at long, lo long, hi long, window long, open boolean"))
    across = done.where("window is not null").groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    late = done.where("open").join(across, "window", "left_semi").select("row", "at", "lo", "hi")
    found = whole.select("row", "at", F.col("lo").cast("long"), F.col("hi").cast("long")).unionByName(done.where("window is null").select("row", "at", "lo", "hi")).unionByName(late)
    return found.select("row", (F.col("at") - F.col("hi")).alias("first"), (F.col("at") - F.col("lo")).alias("last"))


def removed(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept for every row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes, a null one is empty; a text shorter than ``span`` loses
    nothing.  Rows that are equal, or repeat a doc_id, are texts each, so their long
    strings are repeated.  A null doc_id is carried along; other columns are ignored.
    ``kept`` is the remaining bytes.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))
    spans = repeated_bytes(rows.select("row", "text"), span).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    spans = settle(spans)
    maybe = IdFilter(spans.select("row"))
    nothing = F.array().cast("array<struct<first: long, last: long>>")
    plain = maybe.kept(rows, "row", False).select("doc_id", "text", nothing.alias("spans"))
    cut = maybe.kept(rows, "row").join(spans, "row", "left").select("doc_id", "text", F.coalesce("spans", nothing).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            texts = batch.column(1).cast(pa.large_binary())
            for i, found in enumerate(batch.column(2)):
                raw = texts[i].as_py()
                n_removed = n_spans = end = 0
                kept = []
                for s in found.as_py():
                    a, b = s["first"], s["last"] + span
                    if a > end or not n_spans:
                        kept.append(raw[end:a])
                        n_spans += 1
                        n_removed += b - a
                        end = b
                    elif b > end:
                        n_removed += b - end
                        end = b
                kept.append(raw[end:])
                rest = b"".join(kept)
                out.append((len(raw), n_removed, n_spans, hashlib.sha256(rest).hexdigest(), rest))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return plain.unionByName(cut).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
