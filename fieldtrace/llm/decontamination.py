"""Operator 1: benchmark decontamination by size-partitioned MinHash containment search.

A benchmark item is found in a document when the document holds at least 80 per cent
of the item's distinct word shingles.  Items are partitioned by the size of their
shingle set, and each partition has its own sketch length: the smallest hashes of an
item, so many that a document at the threshold must hold one of them.  Documents,
however long, probe with the hashes of all their shingles, so the search misses
nothing; candidates are verified by exact containment of the shingle texts.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, settle

WIDTH = 5
PERCENT = 80
#: Sketches of up to so many rows are broadcast; more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; null and blank texts have none."""
    trimmed = F.btrim(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def shingle_hashes(w: str, width: int) -> str:
    """SQL for the 64-bit hashes of all ``width``-word shingles of the word array ``w``."""
    rest = "".join(f", get({w}, i + {k})" for k in range(1, width))
    return f"if(size({w}) >= {width}, transform(slice({w}, 1, greatest(size({w}) - {width - 1}, 0)), (x, i) -> xxhash64(x{rest})), array())"


def shingle_texts(w: str, width: str) -> str:
    """SQL for the distinct shingles themselves; ``width`` may be a column."""
    return f"array_distinct(if(size({w}) >= {width}, transform(sequence(1, greatest(size({w}) - {width} + 1, 1)), i -> array_join(slice({w}, i, {width}), ' ')), array()))"


def _joined(rows: DataFrame, small: DataFrame, fits: bool, on: list[str]) -> DataFrame:
    return rows.join(F.broadcast(small) if fits else small, on)


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Pairs (doc_id, item_id) with n_item, n_common and containment, one per pair.

    ``docs`` has doc_id and text, ``items`` has item_id and text; other columns are
    ignored.  Words are as in :func:`words`.  An item of fewer words than ``width`` is
    sought as its one whole word sequence; an item without words, a null or empty
    document, and rows without id match nothing.  Rows that repeat an id are judged
    each by its own text, and the best is returned.  Empty tables give no rows.
    """
    it = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    it = it.withColumn("width", F.least(F.lit(width), F.size("w"))).withColumn("item_row", F.xxhash64("item_id", "w"))
    it = it.dropDuplicates(["item_id", "item_row"]).withColumn("grams", F.expr(shingle_texts("w", "width"))).withColumn("n_item", F.size("grams"))
    # Partition by size; a partition's sketch is long enough for its largest item.
    largest = F.shiftleft(F.lit(1), 1) * F.pow(2, F.floor(F.log2("n_item"))).cast("int") - 1
    it = settle(it.withColumn("sketch", F.least("n_item", largest - F.ceil(largest * percent / 100).cast("int") + 1)).drop("w"))
    hashed = "xxhash64(" + ", ".join(f"get(split(g, ' '), {k})" for k in range(width)) + ")"
    sketch = it.select("item_row", "width", F.expr("explode(slice(array_sort(transform(grams, g -> " + hashed + ")), 1, sketch))").alias("h"))
    sketch = settle(sketch.select("h", "width", "item_row"))
    n_sketch = sketch.count()
    widths = sorted(r["width"] for r in it.select("width").distinct().collect())  # 1 to ``width`` at most

    d = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("doc_row"), words(F.col("text")).alias("w"))
    # A short shingle is padded with nulls, which the hash skips, on both sides.
    probes = [F.explode(F.expr(shingle_hashes("w", k))).alias("h") for k in widths]
    hits = None
    for k, probe in zip(widths, probes, strict=True):
        found = _joined(d.select("doc_id", "doc_row", probe), sketch.where(F.col("width") == k).select("h", "item_row"), n_sketch <= BROADCAST_ROWS, ["h"]).select("doc_id", "doc_row", "item_row")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return _empty(docs, items)
    hits = settle(hits.distinct())

    of_docs = hits.select("doc_id", "doc_row").distinct()
    near = IdFilter(of_docs.select("doc_id")).kept(docs.where("doc_id is not null").select("doc_id", "text"), "doc_id")
    near = near.select("doc_id", F.xxhash64("text").alias("doc_row"), words(F.col("text")).alias("w"))
    near = near.join(of_docs, ["doc_id", "doc_row"], "left_semi").dropDuplicates(["doc_id", "doc_row"])
    grams = it.select("item_row", "width", F.explode("grams").alias("gram"))
    size = grams.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("gram")).alias("bytes")).first()
    fits = size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES
    exact = None
    for k in widths:
        own = near.select("doc_id", "doc_row", F.explode(F.expr(shingle_texts("w", str(k)))).alias("gram"))
        found = _joined(own, grams.where(F.col("width") == k).drop("width"), fits, ["gram"])
        exact = found if exact is None else exact.unionByName(found)
    common = exact.groupBy("doc_id", "doc_row", "item_row").agg(F.count(F.lit(1)).alias("n_common"))
    pairs = common.join(it.select("item_row", "item_id", F.col("n_item").cast("long").alias("n_item")), "item_row").where(F.col("n_common") * 100 >= F.col("n_item") * percent)
    best = F.max(F.struct((F.col("n_common") / F.col("n_item")).alias("containment"), "n_item", "n_common")).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_item", "best.n_common", "best.containment")


def _empty(docs: DataFrame, items: DataFrame) -> DataFrame:
    none = docs.where(F.lit(False)).select("doc_id", F.lit(0).alias("item_id").cast(items.schema["item_id"].dataType))
    return none.select("doc_id", "item_id", F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_common"), F.lit(0.0).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` in which no item is found; rows without doc_id stay."""
    return docs.join(contained_items(docs, items, width, percent).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
