"""Best-fit packing of documents into sequences by hierarchical residual packing.

Documents are tokenised once and cut into pieces of at most ``capacity`` tokens. Every partition packs its own pieces,
largest first, each into the fullest sequence that still takes it. Nearly full sequences are emitted; the underfull ones
become the items of the next round, dealt at random over fewer partitions, and so on up the tree. A task never holds more
than twice ``TASK_ITEMS`` items at once: where more stay underfull than that, rounds go on only while they still help.

Defined results: a null text is one end id; repeated rows and equal ids are packed each for itself; an empty table gives
an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.batches import cut_in_batches, returning_memory
from skyloom.llm.tokens import word_encoder
from skyloom.session import cut

CAPACITY = 2048
END = 0
#: Free tokens up to which a sequence counts as nearly full, round by round; the last one holds for all further rounds.
SLACK = (4, 8, 16)
#: Sequences that a round's task repacks.
TASK_ITEMS = 20_000
#: Partitions of a round that the next one's task takes.
FAN_IN = 4
#: Texts encoded at once.
TEXTS = 250

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
SEQUENCE = "sequence_id long, used int, open boolean, members array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>>"


def _cut_texts(path: str, capacity: int, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for b in batches:
            doc_ids, rows = b.column(0).to_pylist(), []
            for a in range(0, len(doc_ids), TEXTS):
                for doc, ids in zip(doc_ids[a : a + TEXTS], encoder.encode(b.column(1)[a : a + TEXTS].to_pylist())):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        some = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(some) // 4, zlib.crc32(some)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of every document: its ids, then the end id, cut every ``capacity`` ids."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(returning_memory(_cut_texts(tokenizer_path, capacity, end)), PIECE)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indexes: items from the largest, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit f is set if a bin has f free
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        fits = some >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                some ^= 1 << free
            bins[b].append(i)
        else:
            b, free = len(bins), capacity
            bins.append([i])
        by_free[free - size].append(b)
        some |= 1 << (free - size)
    return bins


def _pack(capacity: int, slack: int, level: int, last: bool):
    """Packs the partition's items, at most 2 * TASK_ITEMS at a time; each item has its members, with their offsets in it."""
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]))

    def packed(used: list[int], members: list[list], base: int) -> Iterator[pa.RecordBatch]:
        bins = best_fit(used, capacity)
        for a in range(0, len(bins), 5000):
            sums, held = [], []
            for own in bins[a : a + 5000]:
                at, inside = 0, []
                for i in own:
                    inside += [{**m, "offset": m["offset"] + at} for m in members[i]]
                    at += used[i]
                sums.append(at)
                held.append(inside)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(base + a, base + a + len(sums)), pa.int64()), pa.array(sums, pa.int32()), pa.array([not last and capacity - n > slack for n in sums], pa.bool_()), pa.array(held, kind)],
                ["sequence_id", "used", "open", "members"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        used: list[int] = []
        members: list[list] = []
        for b in batches:
            for a in range(0, len(b), TASK_ITEMS):
                some = b.slice(a, TASK_ITEMS)
                if len(used) + len(some) > 2 * TASK_ITEMS:
                    yield from packed(used, members, base)
                    base, used, members = base + len(used), [], []
                used += some.column(0).to_pylist()
                members += some.column(1).to_pylist()
        yield from packed(used, members, base)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece; sequences have no gaps."""
    member = F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset")))
    items = pieces.select(F.col("length").cast("int").alias("used"), member.alias("members"))
    rounds = [cut(items.mapInArrow(_pack(capacity, SLACK[0], 0, False), SEQUENCE), "packed")]
    parts, before = None, None
    while True:
        under = rounds[-1].filter("open")
        n = under.count()
        least = max(1, -(-n // TASK_ITEMS))
        parts = max(least, (rounds[0].rdd.getNumPartitions() if parts is None else parts) // FAN_IN)
        last = n == 0 or parts == 1 or before is not None and parts == least and n > 0.99 * before
        level = len(rounds)
        dealt = under.select("used", "members", F.xxhash64("sequence_id", F.lit(level)).alias("h")).repartition(parts, "h").select("used", "members")
        rounds.append(cut(dealt.mapInArrow(_pack(capacity, SLACK[min(level, len(SLACK) - 1)], level, last), SEQUENCE), "packed"))
        before = n
        if last:
            break
    done = rounds[0].filter("not open")
    for r in rounds[1:]:
        done = done.unionByName(r.filter("not open"))
    return done.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Tokenise, cut and pack; see pack()."""
    return pack(cut_in_batches(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end), "pieces"), capacity)
