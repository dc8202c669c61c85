"""Operator 8: token counts from an exact length histogram.

Documents are aggregated by their encoded length.  Suffix sums over the histogram
answer, for every context limit, how many documents and tokens there are, what a
limit would cut off, and at which quantile of documents it stands.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Suffix sums run in blocks of so many neighbouring lengths, then over the blocks.
BLOCK = 1024

_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The byte-level encoding in the rank file ``path``; kept by the Python worker."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def encoded_lengths(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens (null or empty text: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = encoding(path)
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: at most one row per distinct length."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per context limit that is the length of a document.

    context_limit, n_docs (of just that length), docs_over and tokens_over (documents
    longer than the limit and all their tokens), total_docs, total_tokens,
    truncated_tokens (what is kept when every document is cut at the limit),
    lost_tokens, quantile (share of documents no longer than the limit).  Limits
    between two rows follow from the next larger row, as n_docs is 0 there.
    Empty input gives no rows.
    """
    h = histogram.select(F.col("n_tokens").alias("context_limit"), "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / block).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later = Window.orderBy(F.desc("block"))  # one row per block of lengths
    blocks = blocks.select(
        "block",
        (F.sum("block_docs").over(later) - F.col("block_docs")).alias("later_docs"),
        (F.sum("block_tokens").over(later) - F.col("block_tokens")).alias("later_tokens"),
        F.sum("block_docs").over(Window.partitionBy()).alias("total_docs"),
        F.sum("block_tokens").over(Window.partitionBy()).alias("total_tokens"),
    )
    inner = Window.partitionBy("block").orderBy(F.desc("context_limit"))
    x = h.join(blocks, "block").select(
        "context_limit",
        "n_docs",
        (F.sum("n_docs").over(inner) - F.col("n_docs") + F.col("later_docs")).alias("docs_over"),
        (F.sum("tokens").over(inner) - F.col("tokens") + F.col("later_tokens")).alias("tokens_over"),
        "total_docs",
        "total_tokens",
    )
    kept = F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("context_limit")
    return x.select("*", kept.alias("truncated_tokens"), (F.col("total_tokens") - kept).alias("lost_tokens"), ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("quantile"))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``suffix_sums`` of the histogram of the encoded lengths of ``docs`` (doc_id, text)."""
    return suffix_sums(settle(length_histogram(encoded_lengths(docs, path))))


def answers(sums: DataFrame, limits: list[int], shares: list[float]) -> DataFrame:
    """Totals at each of ``limits`` and the length at each quantile in ``shares``.

    kind ('limit' or 'quantile'), at (the limit or share), value (truncated tokens, or
    the smallest length that no fewer than that share of documents do not exceed).
    """
    rows = [sums.groupBy().agg(
        F.lit("limit").alias("kind"), F.lit(float(x)).alias("at"),
        F.sum(F.when(F.col("context_limit") <= x, F.col("n_docs") * F.col("context_limit")).otherwise(F.col("n_docs") * x)).alias("value")) for x in limits]
    rows += [sums.where(F.col("quantile") >= q).groupBy().agg(F.lit("quantile").alias("kind"), F.lit(float(q)).alias("at"), F.min("context_limit").alias("value")) for q in shares]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
