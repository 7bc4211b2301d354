"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, connected components.

A fingerprint has 64 bits, split into b blocks. Two that differ in at most RADIUS = 2 bits agree in all but two blocks at
most, so in one choice of b - 2 of them. Equal fingerprints are folded first, the distinct ones joined on (choice, value of
its bits), and the pairs' Hamming distance verified. Three blocks (3 choices of 21 bits) do for millions of fingerprints;
more take four (6 choices of 32 bits) or six (15 choices of 42 bits), so that groups stay small; each finds the same links.

A value that many distinct fingerprints share would give a square of pairs. Groups over GROUP members are dealt anew
instead: each member is sent to itself and to its neighbours at one bit outside the choice. Members that meet at such a
point differ in at most two bits, any two that differ in one or two bits meet at one, and no more than 44 can meet at one;
linking each to the smallest there loses no link between components and makes no pairs.

Defined results: a null or blank text has fingerprint zero; equal fingerprints are always one component; a null id takes
part but never names a component unless all its ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.components import components
from skyloom.session import cut

RADIUS = 2
#: Distinct fingerprints up to which so many blocks are used.
BLOCKS = ((16_000_000, 3), (30_000_000_000, 4), (float("inf"), 6))
#: Members of a group up to which its pairs are compared directly.
GROUP = 32
SEED = 42
#: Shingle hashes whose bits are unpacked at once.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of every word shingle; words are split at ASCII white space after lower-casing A-Z; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())]


def _majority(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes: a bit is set if it is set in over half the run."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def _fingerprint_long(hashes: np.ndarray) -> np.uint64:
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[a : a + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


def prints_of(hashes: Iterable[np.ndarray]) -> np.ndarray:
    """SimHash of each text's shingle hashes, as unsigned 64-bit integers; zero for none."""
    out: list[np.uint64] = []
    held: list[np.ndarray] = []
    rows: list[int] = []

    def flush() -> None:
        if rows:
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            for i, x in zip(rows, _majority(np.concatenate(held), np.r_[0, np.cumsum(sizes)[:-1]], sizes)):
                out[i] = x
            held.clear()
            rows.clear()

    waiting = 0
    for i, h in enumerate(hashes):
        out.append(_fingerprint_long(h) if len(h) > CHUNK else np.uint64(0))
        if 0 < len(h) <= CHUNK:
            if waiting + len(h) > CHUNK:
                flush()
                waiting = 0
            held.append(h)
            rows.append(i)
            waiting += len(h)
    flush()
    return np.array(out, np.uint64)


def fingerprints(texts: list[str | None], width: int = 3) -> np.ndarray:
    """SimHash of each text, as unsigned 64-bit integers; zero for a text without words."""
    return prints_of(np.array(shingle_hashes(t, width), np.uint64) for t in texts)


def _fingerprint_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column(1).to_pylist(), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    return run


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id long, fp long): the fingerprint of every whole text."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprint_rows(width), "id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def choices(blocks: int) -> list[int]:
    """Bit masks of every choice of all but RADIUS of the blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << z) - (1 << a) for a, z in zip(edges, edges[1:])]
    return [_signed(sum(some)) for some in combinations(masks, blocks - RADIUS)]


def near_links(distinct: DataFrame, blocks: int | None = None) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that differ in one or two bits; enough of them to connect all such pairs."""
    if blocks is None:
        n = distinct.count()
        blocks = next(b for most, b in BLOCKS if n <= most)
    fp = F.col("fp")
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), fp.bitwiseAND(F.lit(m)).alias("key")) for m in choices(blocks)])).alias("k")).select(
        "fp", "k.mask", "k.key"
    )
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keyed.join(sizes, ["mask", "key"]), "blocks")
    small = shared.filter(F.col("n") <= GROUP).select("mask", "key", "fp")
    pairs = (
        small.alias("x")
        .join(small.alias("y"), ["mask", "key"])
        .filter("x.fp < y.fp")
        .filter(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS)
        .select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v"))
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    points = (
        shared.filter(F.col("n") > GROUP)
        .select("mask", "fp", F.explode(flips).alias("flip"))
        .filter(F.col("flip").bitwiseAND(F.col("mask")) == 0)
        .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "mask")
        .agg(F.min("fp").alias("u"), F.collect_list("fp").alias("all"))
        .filter(F.size("all") > 1)
        .select("u", F.explode("all").alias("v"))
        .filter((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS))
    )
    return pairs.union(points).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, component_id) for every input row; component_id is the smallest id reachable over links of at most two bits."""
    prints = cut(fingerprint_table(docs, id_col, text_col, width), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    labels = components(near_links(distinct))
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    lowest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    owner = named.join(lowest, "label").select("fp", "component_id")
    return prints.join(owner, "fp").select("id", "fp", "component_id")
