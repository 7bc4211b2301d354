"""Token ids in binary chunks with Elias-Fano encoded document boundaries.

File format: a Parquet folder of chunks in ascending id order. A chunk is one row: shard and chunk number, the ids of the
shard before it, the concatenated token ids (16-bit where the vocabulary allows, else 32-bit, little endian), and two
Elias-Fano sequences: its documents' ids less the first, and their end offsets. Of each, ``low`` has the lower bits of every
value, ``high`` the upper bits in unary, ``marks`` the place of every 64th one-bit of ``high``, so that one value is found by
a look at ``marks`` and a short scan. Near 2 + log2(ids per document) bits a document, where a table of 64-bit offsets takes
64. Readers take offsets from select() alone.

Shards are ranges of ids, whose bounds come from quantiles of the id column. Texts are encoded where they are read; what
moves to the shards is their token ids, not the texts. Spark writes the folder, so it may lie in any store and failed tasks
leave nothing behind.

Defined results: a null text is empty and has the end id alone; null ids come first; rows with equal ids are ordered by
XXH64 of the text, and an id (or null) that fills several shards is split by it; an empty table gives an empty
store; columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.tokens import word_encoder

#: A chunk is closed once it has so many documents or token ids.
CHUNK_DOCS, CHUNK_IDS = 1 << 14, 1 << 20
#: One-bits of ``high`` between two marks.
EVERY = 64
TEXTS = 1000
#: Shards for each of Spark's shuffle partitions.
SHARDS = 4
#: The place of null ids among the bounds of shards.
LEAST = -(1 << 63)

SEQUENCE = "struct<n: int, low_bits: int, low: binary, high: binary, marks: binary>"
CHUNK = f"shard int, chunk int, before long, n_docs int, nulls int, first long, doc_ids {SEQUENCE}, n_ids long, width int, ids binary, ends {SEQUENCE}"


class EliasFano:
    """A nondecreasing sequence of integers in near-minimal space, with random access by select()."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, marks: bytes):
        self.n, self.low_bits, self.low, self.high, self.marks = n, low_bits, low, high, marks

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=values.dtype)) & values.dtype.type(1)
        ones = (values >> low_bits).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(
            n,
            low_bits,
            np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(),
            ones[::EVERY].astype("<u4").tobytes(),
        )

    def row(self) -> dict:
        """The sequence as a value of the type SEQUENCE."""
        return {"n": self.n, "low_bits": self.low_bits, "low": self.low, "high": self.high, "marks": self.marks}

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        word = int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3], "little")
        return (word >> (at & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i."""
        at = int(np.frombuffer(self.marks, "<u4", 1, i // EVERY * 4)[0])
        left = i % EVERY
        byte = at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while left >= (ones := word.bit_count()):
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def select_all(self) -> np.ndarray:
        """Every value."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return ((ones - np.arange(self.n)) << self.low_bits) + low.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))


def shards_of(ids: pa.Array, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The shard of each row, nondecreasing in (id, hash): the id's place among the bounds; an id that is several bounds has as
    many shards, and its rows are dealt by hash."""
    known = ids.fill_null(LEAST).to_numpy()
    low, high = (np.searchsorted(bounds, known, side=x) for x in ("left", "right"))
    share = hashes / 2.0**64 + 0.5
    split = np.minimum(low + np.floor(share * (high - low + 1)).astype(np.int64), high)
    return np.where((known == LEAST) & ids.is_valid().to_numpy(zero_copy_only=False), high, split)  # nulls come first


def _encode_rows(path: str, end: int, bounds: np.ndarray):
    """(id, h, text) -> (shard, id, h, ids): the bytes of the ids, each as wide as the vocabulary needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        kind = f"<u{width_of(encoder.size)}"
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            for a in range(0, len(b), TEXTS):
                some = b.slice(a, TEXTS)
                ids = [np.frombuffer(x + tail, "<u4").astype(kind).tobytes() for x in encoder.encode(some.column(2).to_pylist())]
                shard = pa.array(shards_of(some.column(0), some.column(1).to_numpy(), bounds), pa.int32())
                yield pa.RecordBatch.from_arrays([shard, some.column(0), some.column(1), pa.array(ids, pa.binary())], ["shard", "id", "h", "ids"])

    return run


def width_of(vocabulary: int) -> int:
    """Bytes of an id."""
    return 2 if vocabulary <= 1 << 16 else 4


def _write_chunks(width: int, chunk_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunk, before = -1, 0, 0
        docs: list[int | None] = []
        data: list[bytes] = []
        held = 0
        sequence = pa.struct([("n", pa.int32()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("marks", pa.binary())])
        kinds = {
            "shard": pa.int32(), "chunk": pa.int32(), "before": pa.int64(), "n_docs": pa.int32(), "nulls": pa.int32(), "first": pa.int64(),
            "doc_ids": sequence, "n_ids": pa.int64(), "width": pa.int32(), "ids": pa.binary(), "ends": sequence,
        }

        def close() -> pa.RecordBatch:
            nonlocal chunk, before, held
            ends = np.cumsum([len(x) // width for x in data])
            known = [d for d in docs if d is not None]
            first = known[0] if known else 0
            past = np.array([d - first for d in known], np.uint64)  # two ids may be further apart than a signed integer holds
            row = (shard, chunk, before, len(docs), len(docs) - len(known), first, EliasFano.encode(past).row(), int(ends[-1]), width, b"".join(data), EliasFano.encode(ends).row())
            chunk, before, held = chunk + 1, before + int(ends[-1]), 0
            docs.clear()
            data.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds.values())], list(kinds))

        for b in batches:
            for of, doc, ids in zip(*(c.to_pylist() for c in b.columns)):
                if of != shard:
                    if docs:
                        yield close()
                    shard, chunk, before = of, 0, 0
                docs.append(doc)
                data.append(ids)
                held += len(ids) // width
                if len(docs) >= chunk_docs or held >= CHUNK_IDS:
                    yield close()
        if docs:
            yield close()

    return run


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text", chunk_docs: int = CHUNK_DOCS) -> None:
    """Encode every whole text and write the store to path, in ascending id order."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    shards = SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = texts.agg(F.percentile_approx(F.coalesce("id", F.lit(LEAST)), [i / shards for i in range(1, shards)], 100 * shards).alias("b")).first()["b"]
    encoded = texts.mapInArrow(_encode_rows(tokenizer_path, end, np.array(cuts or [], np.int64)), "shard int, id long, h long, ids binary")
    ordered = encoded.repartition("shard").sortWithinPartitions("shard", "id", "h").select("shard", "id", "ids")
    ordered.mapInArrow(_write_chunks(width_of(word_encoder(tokenizer_path).size), chunk_docs), CHUNK).write.parquet(path)


def _sequence(row: dict) -> EliasFano:
    return EliasFano(row["n"], row["low_bits"], row["low"], row["high"], row["marks"])


def _read_chunks(base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, ends = _sequence(r["doc_ids"]), _sequence(r["ends"])
                docs = [None] * r["nulls"] + [r["first"] + ids.select(i) for i in range(ids.n)]
                end = [ends.select(i) for i in range(ends.n)]
                start = [0, *end[:-1]]
                tokens = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
                crc = [zlib.crc32(tokens[s:e]) for s, e in zip(start, end)]
                at = base[r["shard"]] + r["before"]
                columns = (docs, [at + s for s in start], [e - s for s, e in zip(start, end)], crc)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a store; start counts the ids of all documents before it."""
    chunks = spark.read.schema(CHUNK).parquet(path)
    base, total = {}, 0
    for s in sorted(chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()):  # a number per shard
        base[s["shard"]] = total
        total += s["n"]
    return chunks.mapInArrow(_read_chunks(base), "doc_id long, start long, n_tokens long, ids_crc32 long")
