"""Exact deduplication by two-pass Bloom filtering.

Pass 1 adds a 64-bit hash of every normalised text to a filter that tells "set once" from "set twice or more".
Pass 2 looks every row up: a row whose cells are all set twice is possibly repeated. Only those rows' keys shuffle,
to be grouped by SHA-256; every other row is certainly alone and passes straight through.

The filter is broadcast, so its size is bounded by ``filter_mb``. More rows than such a filter serves are handled in
rounds over disjoint ranges of the hash, each with a filter of its own; all of them lie in executors' memory or on their disks
until the result has been read.

Rows that may be repeated are written to the shared folder with a number each, so a lost executor can't number them anew.

Defined results: a null text counts as empty; a null id sorts after every other id; of repeated rows with one id
exactly one stays; an empty table gives an empty result; extra columns, whatever their names, pass through in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.session import cut

#: log2 of the bits in a slice of the filter, the unit in which parts of it are merged.
SLICE_BITS = 20
#: Cells that a hash sets.
PROBES = 3

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The cells of each hash (rows x PROBES) in a filter of 2**bits cells, by double hashing."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64((1 << bits) - 1)


def _set_cells(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if not parts or not sum(map(len, parts)):
            return
        cell, n = np.unique(cells(np.concatenate(parts).astype(np.int64), bits), return_counts=True)
        piece = (cell >> np.uint64(SLICE_BITS)).astype(np.int64)
        at = (cell & np.uint64((1 << SLICE_BITS) - 1)).astype(np.uint32)
        edges = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]).tolist() + [len(piece)]
        once, twice = [], []
        for a, b in zip(edges, edges[1:]):
            once.append(at[a:b][n[a:b] == 1].tobytes())
            twice.append(at[a:b][n[a:b] > 1].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece[edges[:-1]]), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["piece", "once", "twice"]
        )

    return run


def _merge_slice(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    n = np.zeros(1 << SLICE_BITS, np.uint8)
    for once, twice in zip(parts["once"], parts["twice"]):
        one = np.frombuffer(once, np.uint32)
        n[one] = np.minimum(n[one] + 1, 2)
        n[np.frombuffer(twice, np.uint32)] = 2
    return pd.DataFrame({"piece": [key[0]], "bits": [np.packbits(n > 1, bitorder="little").tobytes()]})


def repeated_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Cells set by two or more rows of the column ``h``, as packed bits; 2**bits cells, merged slice by slice on executors."""
    parts = hashes.select("h").mapInArrow(_set_cells(bits), "piece long, once binary, twice binary")
    slices = parts.groupBy("piece").applyInPandas(_merge_slice, "piece long, bits binary").collect()  # 2**bits / 8 bytes at most
    packed = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (SLICE_BITS - 3)
    for s in slices:
        packed[s["piece"] * width : (s["piece"] + 1) * width] = np.frombuffer(s["bits"], np.uint8)
    return packed


def _lookup(packed: Broadcast, bits: int):
    def maybe(h: pd.Series) -> pd.Series:
        at = cells(h.to_numpy(np.int64), bits)
        return pd.Series(((packed.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1))

    return F.pandas_udf("boolean")(maybe)


def possibly_repeated(hashed: DataFrame, filter_mb: int = 256, bits_per_row: int = 16) -> DataFrame:
    """Adds ``maybe`` to rows with a hash ``h``: false means that no other row has this hash."""
    spark = hashed.sparkSession
    rows = hashed.count()
    most = int(np.log2(filter_mb)) + 23
    bits = min(most, max(SLICE_BITS, int(np.ceil(np.log2(max(1, rows * bits_per_row))))))
    rounds = max(1, -(-rows * bits_per_row // (1 << most)))
    out = None
    for r in range(rounds):
        part = hashed if rounds == 1 else hashed.filter(F.pmod(F.xxhash64("h"), F.lit(rounds)) == r)
        packed = spark.sparkContext.broadcast(repeated_filter(part, bits))
        part = part.withColumn("maybe", _lookup(packed, bits)("h"))
        out = part if out is None else out.unionByName(part)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_mb: int = 256, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: row (the columns in keep, all by default), id, keep_id, group_size, kept, text_sha256.

    Rows with equal normalised texts form a group; the one with the smallest id stays.
    """
    text = normalised(F.col(text_col))
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in (docs.columns if keep is None else keep)])
    hashed = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("text_sha256"))
    flagged = possibly_repeated(hashed, filter_mb)
    alone = flagged.filter("not maybe").select(
        "row", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    again = cut(flagged.filter("maybe").select("row", "id", "text_sha256", F.monotonically_increasing_id().alias("uid")), "again")
    ids = again.groupBy("text_sha256", "id").agg(F.count("*").alias("n"), F.min("uid").alias("uid"))
    groups = ids.groupBy("text_sha256").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "n", "uid")).alias("first"), F.sum("n").alias("group_size"))
    groups = cut(groups, "groups")  # so that the join shuffles both sides itself, and can split a large group of copies
    only = F.col("id").eqNullSafe(F.col("first.id")) & ((F.col("first.n") == 1) | (F.col("uid") == F.col("first.uid")))  # uid decides among repeats of one id alone
    seen = again.join(groups, "text_sha256").select("row", "id", F.col("first.id").alias("keep_id"), "group_size", only.alias("kept"), "text_sha256")
    return alone.unionByName(seen)
