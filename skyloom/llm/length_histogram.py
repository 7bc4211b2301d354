"""Exact length histogram: documents by encoded length; suffix sums answer totals, quantiles and truncated totals.

Only (length, count) pairs shuffle. The running sums are taken in two levels: over ranges of ``WIDTH`` lengths, of which
there are few, and within each range, so no task sees the whole histogram.

Defined results: a null or empty text has length 0; repeated rows count each; an empty table gives an empty histogram;
columns other than the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.tokens import byte_encoder
from skyloom.session import cut

WIDTH = 64


def _lengths(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(path, pattern).encode_ordinary
        for b in batches:
            n = np.fromiter((len(encode(t)) if t else 0 for t in b.column(0).to_pylist()), np.int64, len(b))
            length, count = np.unique(n, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(count.astype(np.int64))], ["length", "n"])

    return run


def length_counts(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(length, n_docs): how many documents encode to each length."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_lengths(ranks_path, pattern), "length long, n long")
    return counted.groupBy("length").agg(F.sum("n").alias("n_docs"))


def context_totals(counts: DataFrame) -> DataFrame:
    """For a context limit at each length that occurs: docs_longer, docs_fitting, total_tokens, kept_tokens when every longer
    document is truncated to the limit, lost_tokens, and quantile, the share of documents that fit. Between two such
    limits docs_longer is constant and kept_tokens grows by docs_longer per token, so the rows answer every limit."""
    counts = cut(counts, "lengths")  # read twice below, encoded once
    own = counts.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / WIDTH).alias("range"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = own.groupBy("range").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("toks"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    every = Window.partitionBy()
    higher = ranges.select(
        "range",
        zero(F.sum("docs").over(above)).alias("docs_above"),
        zero(F.sum("toks").over(above)).alias("toks_above"),
        F.sum("docs").over(every).alias("all_docs"),
        F.sum("toks").over(every).alias("total_tokens"),
    )
    within = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    longer = own.join(higher, "range").select(
        "length",
        "n_docs",
        "all_docs",
        "total_tokens",
        (F.col("docs_above") + zero(F.sum("n_docs").over(within))).alias("docs_longer"),
        (F.col("toks_above") + zero(F.sum("tokens").over(within))).alias("longer_tokens"),
    )
    kept = F.col("total_tokens") - F.col("longer_tokens") + F.col("length") * F.col("docs_longer")
    return longer.select(
        F.col("length").alias("context"),
        "n_docs",
        "docs_longer",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_fitting"),
        "total_tokens",
        kept.alias("kept_tokens"),
        (F.col("total_tokens") - kept).alias("lost_tokens"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )
