"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Windows have a ladder of sizes. An item of w words is looked for with the largest rung b for which b + step(b) - 1 <= w:
the item's own windows of b words are indexed at every offset, a document's windows are taken every step(b) words, so
every unbroken copy of the item contains a document window that equals one of the item's.

A window's fingerprint is the 64-bit SimHash of its words. Fingerprints are looked up in BLOCKS = 4 blocks of 16 bits: of
two that differ in at most RADIUS = 7 bits, some block differs in at most one, and every key within one bit of an item's
block is in the index; so no fingerprint within the radius is missed. Each hit's Hamming distance is taken, and what is
within the radius is verified: weighted Jaccard similarity (by multiplicity) of the five-word shingles of the item and of
the best stretch of the document around the hit.

Windows miss some copies that lost an end or hold an insertion. A stretch that is SIMILARITY alike has that share of the
item's shingles at least, so one at least of any n - ceil(SIMILARITY * n) + 1 of its n; these keys, the rarest among the items,
are looked up at every word, and around each the best stretch is taken. So no stretch that is similar enough is missed.

Both ways only say where to look: hits of one item that lie near each other are verified together, once.

Items are indexed in groups of about CHARS_AT_ONCE characters, so of at most half as many words, each a broadcast of bounded
size (under 100 bytes a word and 1 MB a rung) and a pass over the documents; a group's broadcast goes once its pass is written.

Defined results: words are runs of letters, digits and underscores in lower case; an item with fewer than five words has
no shingle and is never found; null or empty texts hold nothing; a document has one row per item that it holds, with the
best similarity; repeated items count once; rows with a null id are reported under null; repeated rows are reported once each; extra columns are not
read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.batches import returning_memory
from skyloom.session import cut

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 7
BLOCKS, BLOCK_BITS = 4, 16
#: Characters of items indexed at once.
CHARS_AT_ONCE = 2_000_000
#: Bits of a shingle's key by which most words are passed over, and the factor of the key.
FILTER_BITS, TIMES = 20, np.uint64(0x9E3779B97F4A7C15)
#: The largest window of which a byte holds how many of its words have a bit.
BYTE = 255
#: Words whose windows are taken at once, and words whose hashes a task keeps.
BATCH, KEEP = 1 << 15, 200_000
WORD = re.compile(r"\w+")

FOUND = "doc_id long, item_id long, similarity double, first_word long, n_words int"


def step(b: int) -> int:
    return max(1, b // 6)


def rung_of(w: int) -> int:
    """The window size for items of w words."""
    b, best = 1, 1
    while b + step(b) - 1 <= w:
        best = b
        b = max(b + 1, b * 6 // 5)
    return best


class WordHashes(dict):
    """XXH64 of words, computed once each."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > KEEP:
            self.clear()
        words = WORD.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_prints(hashes: np.ndarray, rungs: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """SimHash of the windows of each size b that start at rungs[b]; a bit is set if it is in over half the words."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = {}
    if any(b <= BYTE for b in rungs):
        sums = np.zeros((len(hashes) + 1, 8), np.uint64)  # eight counters each; carries cancel in the differences
        np.cumsum(bits.view(np.uint64), axis=0, out=sums[1:])
    if any(b > BYTE for b in rungs):
        wide = np.zeros((len(hashes) + 1, 64), np.uint32)
        np.cumsum(bits, axis=0, dtype=np.uint32, out=wide[1:])
    for b, starts in rungs.items():
        ones = (sums[starts + b] - sums[starts]).view(np.uint8) if b <= BYTE else wide[starts + b] - wide[starts]
        out[b] = np.packbits(ones > b // 2, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


@dataclass
class Rung:
    prints: np.ndarray  # fingerprints of items' windows
    item: np.ndarray  # place of the item
    offset: np.ndarray  # of the window in the item
    first: np.ndarray  # per block and key: where its entries start, (BLOCKS, 2**16 + 1)
    entries: list[np.ndarray]  # per block: places in prints, by key


@dataclass
class Index:
    ids: list[int | None]
    hashes: list[np.ndarray]
    rungs: dict[int, Rung]
    keys: np.ndarray  # of each item's rarest shingles, sorted
    key_item: np.ndarray  # place of the item
    some: np.ndarray  # whether a key starts with these FILTER_BITS
    made: dict[int, Counter] = field(default_factory=dict)

    def shingles(self, place: int) -> Counter:
        """An item's shingles, counted when they are first asked for."""
        if place not in self.made:
            self.made[place] = shingles(self.hashes[place])
        return self.made[place]


def shingle_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key of the shingle that starts at each word but the last SHINGLE - 1."""
    n = max(0, len(hashes) - SHINGLE + 1)
    out = hashes[:n].copy()
    for i in range(1, SHINGLE):
        out *= TIMES
        out += hashes[i : i + n]
    return out ^ (out >> np.uint64(31))


def rare_keys(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places of items): so many of each item's shingles that any stretch that is similar enough has one of them."""
    counts = [Counter(shingle_keys(h).tolist()) for h in hashes]
    items_of = Counter(k for c in counts for k in c)
    keys, places = [], []
    for place, c in enumerate(counts):
        n = sum(c.values())
        need = n - math.ceil(SIMILARITY * n - 1e-9) + 1
        for k in sorted(c, key=lambda k: (items_of[k], k)):
            if need <= 0:
                break
            need -= c[k]
            keys.append(k)
            places.append(place)
    keys, places = np.array(keys, np.uint64), np.array(places, np.int64)
    order = np.argsort(keys, kind="stable")
    return keys[order], places[order]


def shingles(hashes: np.ndarray) -> Counter:
    h = hashes.tolist()
    return Counter(zip(*(h[i:] for i in range(SHINGLE))))


def build_index(items: list[tuple[int | None, str | None]]) -> Index:
    words = WordHashes()
    kept = [(i, h) for i, t in items if len(h := words.of(t)) >= SHINGLE]
    by_rung: dict[int, list] = {}
    for place, (_, h) in enumerate(kept):
        b = rung_of(len(h))
        at = np.arange(len(h) - b + 1)
        by_rung.setdefault(b, []).append((window_prints(h, {b: at})[b], np.full(len(at), place), at))
    near = np.r_[0, 1 << np.arange(BLOCK_BITS)]
    rungs = {}
    for b, parts in sorted(by_rung.items()):
        prints, item, offset = (np.concatenate(x) for x in zip(*parts))
        first, entries = np.zeros((BLOCKS, (1 << BLOCK_BITS) + 1), np.int32), []
        for k in range(BLOCKS):
            key = ((prints >> np.uint64(BLOCK_BITS * k)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            keys = (key[:, None] ^ near).ravel()
            first[k, 1:] = np.cumsum(np.bincount(keys, minlength=1 << BLOCK_BITS))
            entries.append(np.repeat(np.arange(len(prints), dtype=np.int32), len(near))[np.argsort(keys, kind="stable")])
        rungs[b] = Rung(prints, item, offset, first, entries)
    keys, key_item = rare_keys([h for _, h in kept])
    some = np.zeros(1 << FILTER_BITS, bool)
    some[keys >> np.uint64(64 - FILTER_BITS)] = True
    return Index([i for i, _ in kept], [h for _, h in kept], rungs, keys, key_item, some)


def lookup(rung: Rung, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (place in prints, place in rung) whose fingerprints differ in at most RADIUS bits."""
    found_w, found_e = [], []
    for k in range(BLOCKS):
        key = ((prints >> np.uint64(BLOCK_BITS * k)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
        n = rung.first[k][key + 1] - rung.first[k][key]
        some = np.flatnonzero(n)
        n = n[some]
        window = np.repeat(some, n)
        inner = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        entry = rung.entries[k][np.repeat(rung.first[k][key[some]], n) + inner]
        close = np.bitwise_count(prints[window] ^ rung.prints[entry]) <= RADIUS
        found_w.append(window[close])
        found_e.append(entry[close])
    return np.concatenate(found_w), np.concatenate(found_e)


def similarity(a: Counter, b: Counter) -> float:
    same = sum((a & b).values())
    return same / (sum(a.values()) + sum(b.values()) - same) if same else 0.0


def longest(w: int) -> int:
    """Shingles that a stretch may have to be similar enough to an item of w words."""
    return int((w - SHINGLE + 1) / SIMILARITY + 1e-9)


def verify(index: Index, doc: np.ndarray, item: int, low: int, high: int) -> tuple[float, int, int]:
    """Best similarity of the item to a stretch within the words from low to high, with its first word and length.

    The best stretch starts and ends with a shingle of the item, and with a whole run of them unless one is there too often."""
    own, w = index.shingles(item), len(index.hashes[item])
    n, most = w - SHINGLE + 1, longest(w)
    low = max(0, low)
    part = doc[low:high].tolist()
    there = list(zip(*(part[i:] for i in range(SHINGLE))))
    best = (0.0, low, w)
    wide = Counter(x for x in there if x in own)
    if sum(min(k, own[x]) for x, k in wide.items()) < SIMILARITY * n:
        return best  # no stretch can be similar enough
    held = [x in own for x in there]
    edge = [not h or wide[x] > own[x] for x, h in zip(there, held)]
    starts = [i for i, h in enumerate(held) if h and (i == 0 or edge[i - 1])]
    last = [h and (i + 1 == len(held) or edge[i + 1]) for i, h in enumerate(held)]
    upto = list(accumulate(held, initial=0))
    for a in starts:
        if upto[min(a + most, len(held))] - upto[a] <= best[0] * n:
            continue  # what is left holds too few to be better
        same, seen = 0, {}
        for z in range(a, min(a + most, len(held))):
            if held[z]:
                x = there[z]
                seen[x] = k = seen.get(x, 0) + 1
                same += k <= own[x]
                if last[z] and (s := same / (n + z + 1 - a - same)) > best[0]:
                    best = (s, low + a, z - a + SHINGLE)
        if best[0] == 1.0:
            break
    return best


def key_hits(index: Index, hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, place of the item) of every rare shingle of an item in parts that end at ends."""
    keys = shingle_keys(hashes)
    at = np.flatnonzero(index.some[keys >> np.uint64(64 - FILTER_BITS)])
    at = at[ends[np.searchsorted(ends, at, side="right")] - at >= SHINGLE] if len(at) else at
    first, end = (np.searchsorted(index.keys, keys[at], side=x) for x in ("left", "right"))
    n = end - first
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at, n), index.key_item[np.repeat(first, n) + inner]


def search(index: Index, docs: list[np.ndarray]) -> Iterator[tuple[int, int, float, int, int]]:
    """(place of the document, place of the item, similarity, first word, words) of every item that a document holds."""
    if not index.rungs:
        return
    overlap = max(b + step(b) for b in index.rungs)
    batch = max(BATCH, overlap)
    parts = [(d, a) for d, h in enumerate(docs) for a in range(0, max(1, len(h)), batch)]
    around: dict[tuple[int, int], set[int]] = {}
    at = 0
    while at < len(parts):
        some, n = [], 0
        while at < len(parts) and n < batch:
            d, a = parts[at]
            some.append((d, a, docs[d][a : a + batch + overlap]))
            n += len(some[-1][2])
            at += 1
        sizes = np.fromiter((len(h) for *_, h in some), np.int64, len(some))
        bases = np.cumsum(sizes) - sizes
        ends = bases + sizes
        words = np.concatenate([h for *_, h in some])

        def hit(word: int, item: int) -> None:
            part = int(np.searchsorted(ends, word, side="right"))
            d, a, _ = some[part]
            around.setdefault((d, item), set()).add(a + word - int(bases[part]))

        rungs = {}
        for b in index.rungs:
            n_win = np.maximum(0, (sizes - b) // step(b) + 1)
            inner = np.arange(n_win.sum()) - np.repeat(np.cumsum(n_win) - n_win, n_win)
            rungs[b] = np.repeat(bases, n_win) + inner * step(b)
        for b, fp in (window_prints(words, rungs) if len(words) else {}).items():
            rung = index.rungs[b]
            for win, entry in zip(*(x.tolist() for x in lookup(rung, fp))):
                first = int(rungs[b][win])
                hit(first, int(rung.item[entry]))
                hit(first + b - 1, int(rung.item[entry]))
        for word, item in zip(*(x.tolist() for x in key_hits(index, words, ends))):
            hit(word, item)
    for (d, item), places in around.items():
        best = (0.0, 0, 0)
        words, reach, at = sorted(places), longest(len(index.hashes[item])), 0
        while at < len(words) and best[0] < 1.0:
            low = high = words[at]
            while at < len(words) and words[at] - high <= 2 * reach:
                high = words[at]
                at += 1
            best = max(best, verify(index, docs[d], item, low - reach + 1, high + reach + SHINGLE - 1), key=lambda x: x[0])
        if best[0] >= SIMILARITY:
            yield (d, item, *best)


def _search_rows(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ix = WordHashes(), index.value
        for b in batches:
            for a in range(0, len(b), 256):
                some = b.slice(a, 256)
                docs = [words.of(t) for t in some.column(1).to_pylist()]
                ids = some.column(0).to_pylist()
                rows = [(ids[d], ix.ids[i], s, f, n) for d, i, s, f, n in search(ix, docs)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32()))],
                        ["doc_id", "item_id", "similarity", "first_word", "n_words"],
                    )

    return run


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) of every benchmark item that a document holds."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    items = items.distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    rounds = max(1, -(-chars // CHARS_AT_ONCE))
    out = None
    for r in range(rounds):
        part = items if rounds == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(rounds)) == r)
        index = spark.sparkContext.broadcast(build_index([tuple(x) for x in part.collect()]))  # about CHARS_AT_ONCE characters
        found = texts.mapInArrow(returning_memory(_search_rows(index)), FOUND)
        if rounds > 1:
            found = cut(found, "found")
            index.destroy()
        out = found if out is None else out.unionByName(found)
    return out
