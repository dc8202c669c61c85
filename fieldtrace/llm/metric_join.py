"""Operator 9: embedding near-duplicates by an exact metric range join.

Unit vectors are points of a metric space, and a cosine threshold is a distance
radius.  Pivots of each label cut its vectors into cells of nearest pivots.  A vector
is also sent, as a ghost, to each cell of a lower number that the triangle inequality
leaves within the radius; so every pair in range meets in exactly one cell, and cells
join independently, in tiles of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, settle

COSINE = 0.93
#: Vectors a cell should have, and the most pivots of one label.
PER_CELL, MOST_PIVOTS = 512, 256
#: Rows of one task's share when cells are assigned, and rows of one side of a tile.
SHARE, TILE = 4096, 1024


def _units(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable() -> Column:
    """Whether a row can link: it has an id, a label, and a finite vector that is not zero."""
    e = F.col("embedding")
    finite = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(e, lambda v: v != 0), F.lit(False))


def assign_cells(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Cells of each vector: its own (ghost false) and those it may reach (ghost true)."""
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("label", "dim", F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("n") / PER_CELL)).alias("pivots"), F.ceil(F.col("n") / SHARE).alias("shares"))
    turn = F.row_number().over(Window.partitionBy("label", "dim").orderBy("rep"))
    pivots = classes.select("label", "dim", "rep", "embedding", turn.alias("turn")).where(F.col("turn") <= MOST_PIVOTS)
    pivots = pivots.join(sizes, ["label", "dim"]).where("turn <= pivots").select("label", "dim", "turn", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    spread = classes.join(sizes, ["label", "dim"]).withColumn("share", F.pmod(F.xxhash64("rep"), F.col("shares"))).drop("pivots", "shares")
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9

    def assign(rows: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or marks.empty:
            return pd.DataFrame({"label": [], "dim": [], "cell": [], "ghost": [], "rep": [], "copies": [], "embedding": []})
        p = _units(marks.sort_values("turn")["embedding"])
        x = _units(rows["embedding"])
        square = np.maximum(0, 2 - 2 * x @ p.T)
        own = square.argmin(axis=1)
        apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[own]
        nearest = square[np.arange(len(x)), own][:, None]
        # Triangle inequality, and its sharper form for Euclidean distances: how far
        # x is from the plane between the two pivots.
        near = np.sqrt(square) - np.sqrt(nearest) <= 2 * radius
        near &= square - nearest <= 2 * apart * radius + 1e-9
        near &= np.arange(len(p))[None, :] < own[:, None]
        row, cell = np.nonzero(near)
        at = np.concatenate([np.arange(len(x)), row])
        out = rows.iloc[at][["label", "dim", "rep", "copies", "embedding"]].copy()
        out["cell"], out["ghost"] = np.concatenate([own, cell]), np.arange(len(at)) >= len(x)
        return out[["label", "dim", "cell", "ghost", "rep", "copies", "embedding"]]

    pivots = pivots.toDF(*pivots.columns)  # attributes of its own, for the cogroup
    keys = ["label", "dim", "share"]
    schema = f"label {classes.schema['label'].dataType.simpleString()}, dim int, cell int, ghost boolean, rep long, copies long, embedding array<{_element(classes)}>"
    return spread.groupBy(*keys).cogroup(pivots.groupBy(*keys)).applyInPandas(assign, schema)


def _element(df: DataFrame) -> str:
    return df.schema["embedding"].dataType.elementType.simpleString()


def tile_links(cells: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(rep, links, peer): for each vector of a tile how many vectors it links with
    there, copies counted, and the smallest of its linked group in the tile."""
    keys = ["label", "dim", "cell"]
    blocks = cells.groupBy(*keys).agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.when(~F.col("ghost"), 1)) / TILE)).alias("own_blocks"), F.ceil(F.count(F.when(F.col("ghost"), 1)) / TILE).alias("ghost_blocks")
    )
    x = cells.join(blocks, keys)
    x = x.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.when(F.col("ghost"), F.col("ghost_blocks")).otherwise(F.col("own_blocks"))))
    tiles = F.expr(
        """if(ghost,
             transform(sequence(0L, own_blocks - 1), s -> named_struct('s', s, 't', own_blocks + block, 'side', 1)),
             concat(
               transform(sequence(block, own_blocks - 1), t -> named_struct('s', block, 't', t, 'side', 0)),
               if(ghost_blocks > 0, transform(sequence(0L, greatest(ghost_blocks, 1L) - 1), g -> named_struct('s', block, 't', own_blocks + g, 'side', 0)), array()),
               if(block > 0, transform(sequence(0L, greatest(block, 1L) - 1), s -> named_struct('s', s, 't', block, 'side', 1)), array())))"""
    )
    x = x.select(*keys, "rep", "copies", "embedding", F.explode(tiles).alias("tile")).select(*keys, "rep", "copies", "embedding", "tile.*")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        left = rows[rows["side"] == 0]
        right = left if rows["s"].iloc[0] == rows["t"].iloc[0] else rows[rows["side"] == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"rep": [], "links": [], "peer": []})
        hit = _units(left["embedding"]) @ _units(right["embedding"]).T >= cosine
        a, b = left["rep"].to_numpy(), right["rep"].to_numpy()
        if right is left:
            np.fill_diagonal(hit, False)
        links_a = hit @ right["copies"].to_numpy()
        group_a, group_b = a.copy(), b.copy()
        while True:  # smallest rep that links reach inside the tile
            last_a = group_a.copy()
            group_b = np.minimum(group_b, np.where(hit, group_a[:, None], np.iinfo(np.int64).max).min(axis=0))
            group_a = np.minimum(group_a, np.where(hit, group_b[None, :], np.iinfo(np.int64).max).min(axis=1))
            if right is left:
                group_b = group_a.copy()
            if (group_a == last_a).all():
                break
        out = [pd.DataFrame({"rep": a, "links": links_a, "peer": group_a})]
        if right is not left:
            out.append(pd.DataFrame({"rep": b, "links": hit.T @ left["copies"].to_numpy(), "peer": group_b}))
        out = pd.concat(out)
        return out[out["links"] > 0]

    return x.groupBy(*keys, "s", "t").applyInPandas(join, "rep long, links long, peer long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and their cosine, in double precision, is at
    least ``cosine``.  Vectors that are null, zero or hold null or non-finite
    components, rows without label or id, and vectors of different length link with
    nothing.  Equal vectors are one class with a count from the start, so copies cost
    nothing.  Every row is a vector of its own, whatever its vec_id: rows that repeat one
    with the same vector are copies, with another vector they have links of their own.
    Classes are told apart by 64-bit hashes of label and vector.  Other columns are ignored.
    """
    rows = vectors.select("vec_id", "label", "embedding").withColumn("usable", usable())
    good = rows.where("usable")
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("copies"))
    classes = settle(classes.withColumns({"dim": F.size("embedding"), "rep": F.xxhash64("label", "embedding")}))
    links = settle(tile_links(settle(assign_cells(classes, cosine)), cosine))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(classes.select(F.col("rep").alias("id")), links.select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    label = label.withColumnRenamed("id", "rep").join(classes.select("rep", "name"), "rep")
    label = label.join(label.groupBy("component").agg(F.min("name").alias("component_id")), "component").select("rep", "component_id")
    found = classes.join(counts, "rep", "left").join(label, "rep")
    found = found.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    member = good.join(found, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    bad = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return member.unionByName(bad).withColumn("kept", F.col("vec_id") == F.col("component_id"))
