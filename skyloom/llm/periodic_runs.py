"""Periodic runs of words: maximal stretches with smallest period q that hold at least two periods (and LEAST words).

Periods are dealt to octaves: 1 to 7, then [Q, 2Q) for Q = 8, 16, ... up to half the text. An octave cuts a text into tiles around
boundaries a step of Q words apart, each reaching 2Q words to either side of its boundary and its boundary moved by a period, so tiles
overlap. A stretch that agrees with itself q words on for at least q words crosses a boundary, and the Z-functions of the tile's
two halves give how far the agreement reaches forwards and backwards from there: a fragment [lo, hi) of agreeing words. One half
of it has to agree over Q/2 words at least, so hashes of such windows, compared for all boundaries of many texts at once, tell which
tiles and periods need their Z-functions; a hash can only propose a period, never hide one or decide. A period with a shorter one
that divides it is dropped in the tile: the fragment holds a whole period, so it decides this for the whole run.

Fragments are shuffled by (document, period) and stitched where they touch or overlap. A text of over LONG words is exploded
into one row a tile (many boundaries share it) and octave, dealt to all tasks; shorter texts, a batch of them at once, are solved where
they are read, and only fragments and the texts that have some move.

Words are runs of anything but space and the ASCII control whites (9 to 13), compared exactly. Null, empty and blank texts have no
word and no run. Rows are numbered by the operator, so null, repeated or tied ids are rows of their own; the document's columns are
kept in one struct, so their names can't clash. No row in, no row out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import cut

WORD = "[^\x20\x09-\x0d]+"
#: Words that a run has at least.
LEAST = 12
#: Periods of the first octave end here.
FIRST = 8
#: Words up to which a text is solved where it's read, of a batch solved at once, and of a tile row's own boundaries.
LONG, AT_ONCE, TILE = 1 << 18, 1 << 18, 1 << 16
FOUND = "array<struct<period:long, lo:long, hi:long>>"
SOLVED = f"n_words long, fragments {FOUND}, collapsed string"
#: Odd multipliers of the window hashes, which only propose candidates.
SPREAD, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)

_WORDS = re.compile(WORD)


def octaves(n: int) -> list[tuple[int, int]]:
    """[low, high) of the periods of each octave of n words."""
    out, low = [], 1
    while 2 * low <= n:
        high = FIRST if low == 1 else 2 * low
        out.append((low, high))
        low = high
    return out


def reach(low: int) -> int:
    """How far a tile of an octave goes to either side."""
    return max(2 * low, 2 * FIRST)


def step(low: int) -> int:
    """Words between boundaries: as many agree at least in a run of the octave (with periods under FIRST, LEAST - 6 of them)."""
    return low if low >= FIRST else LEAST // 2


def z_function(s: list[int], count: int) -> list[int]:
    """Of each of the first count places, how many elements from there on agree with the start."""
    n = len(s)
    z = [0] * count
    left = right = 0
    for i in range(1, count):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def _primes(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + [n] if n > 1 else out


def _tile(w: np.ndarray, c: int, periods: list[int], low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """Fragments (period, lo, hi) at boundary c of the periods that are smallest ones."""
    far, end = reach(low), min(len(w), c + high)
    forward = z_function(w[c : c + high + far].tolist(), high)
    head = w[max(0, c - far) : c][::-1].tolist()
    tail = w[max(0, c - far) : end][::-1].tolist()
    # what ends before c + q, read backwards, is at place end - c - q of tail
    backward = z_function([*head, -1, *tail], len(head) + 1 + end - c)
    for q in periods:
        ahead, back = min(forward[q], far), min(backward[len(head) + 1 + end - c - q], far) if head else 0
        if ahead + back < max(q, LEAST - q):
            continue
        if any(forward[q // r] >= q - q // r for r in _primes(q) if q > 1):
            continue
        yield q, c - back, c + ahead


def fragments(w: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """Fragments of the periods [low, high) in words w, numbers from 0 with different negative ones below -1 where texts end."""
    every, far = step(low), reach(low)
    m, n = every // 2, len(w)
    padded = np.concatenate([np.arange(-4 * (n + far) - m, -4 * (n + far)), w, np.arange(-2 * (n + far), -2 * (n + far) + high + m)])
    x = (padded.astype(np.uint64) + np.uint64(1)) * SPREAD
    x ^= x >> np.uint64(29)
    size, hashes = 1, x
    want, whole = m, None  # windows of m words, from those of powers of two
    while want:
        if want & 1:
            whole = hashes if whole is None else whole[: len(hashes) - (m & (size - 1))] * BASE + hashes[m & (size - 1) :][: len(whole)]
        want >>= 1
        if want:
            hashes = hashes[:-size] * BASE + (hashes[size:] ^ (hashes[size:] >> np.uint64(31)))
            size *= 2
    # whole[i]: the window that starts at word i - m; so whole[i + m] starts at i and whole[i] ends before i
    hits: dict[int, set[int]] = {}
    for shift in (m, 0):
        at = whole[shift : shift + n : every]
        moved = np.lib.stride_tricks.sliding_window_view(whole[shift + low :], high - low)[::every]
        k = min(len(at), len(moved))
        rows = max(1, (1 << 22) // (high - low))
        for i in range(0, k, rows):
            b, q = np.nonzero(moved[i : min(k, i + rows)] == at[i : min(k, i + rows), None])
            for c, p in zip(((b + i) * every).tolist(), (q + low).tolist()):
                hits.setdefault(c, set()).add(p)
    for c, periods in hits.items():
        yield from _tile(w, c, sorted(periods), low, high)


def solve(texts: list[list[str]], only: tuple[int, int] | None = None) -> list[list[tuple[int, int, int]]]:
    """Fragments (period, lo, hi) of each text; of one octave's periods only if that is given."""
    number: dict[str, int] = {}
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    parts, starts, at = [], [], 0
    for k, i in enumerate(order):
        starts.append(at)
        parts += [np.array([number.setdefault(t, len(number)) for t in texts[i]], np.int64), np.array([-2 - k])]
        at += len(texts[i]) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not parts:
        return out
    w, first = np.concatenate(parts), np.array(starts)
    size = np.array([len(texts[i]) for i in order])
    for low, high in [only] if only else octaves(int(size[0])):
        held = int(np.count_nonzero(size >= max(LEAST, 2 * low)))
        if not held:
            break
        for q, lo, hi in fragments(w[: int(first[held - 1] + size[held - 1]) + 1], low, high):
            k = int(np.searchsorted(first, lo, "right")) - 1
            out[order[k]].append((q, lo - starts[k], hi - starts[k]))
    return out


def _collapsed(words: list[str], as_digest: bool) -> str:
    text = " ".join(words)
    return hashlib.sha256(text.encode()).hexdigest() if as_digest else text


def _solver(as_digest: bool, most: int):
    def run(text: pd.Series) -> pd.DataFrame:
        out: list[tuple] = []
        held: list[list[str]] = []

        def flush() -> None:
            for words, found in zip(held, solve([w if len(w) <= most else [] for w in held])):
                long = len(words) > most
                out.append((len(words), [{"period": q, "lo": a, "hi": b} for q, a, b in found], None if found or long else _collapsed(words, as_digest)))
            held.clear()

        size = 0
        for t in text:
            held.append(_WORDS.findall(t or ""))
            size += len(held[-1])
            if size >= AT_ONCE:
                flush()
                size = 0
        flush()
        return pd.DataFrame(out, columns=["n_words", "fragments", "collapsed"]).astype({"n_words": "int64"})

    return F.pandas_udf(run, SOLVED)


def _solve_tiles(low: pd.Series, high: pd.Series, first: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([[{"period": q, "lo": a + f, "hi": b + f} for q, a, b in solve([_WORDS.findall(t)], (lo, hi))[0]] for lo, hi, f, t in zip(low, high, first, text)])


def tiles(held: DataFrame, least: int = TILE) -> DataFrame:
    """(uid, low, high, first, text): long texts as overlapping tiles per octave, in the order of first words."""
    words = held.select("uid", "n_words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    low = F.expr("transform(sequence(0, cast(floor(log2(n_words / 2)) as int)), k -> shiftleft(1L, k))")
    each = words.withColumn("low", F.explode(F.filter(low, lambda x: (x == 1) | (x >= FIRST)))).withColumn("high", F.when(F.col("low") == 1, FIRST).otherwise(2 * F.col("low")))
    own = F.greatest(F.lit(least), 4 * F.col("low"))
    at = each.withColumn("own", own).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_words") - 1) / F.col("own")))))
    far = F.greatest(2 * F.col("low"), F.lit(2 * FIRST)) + F.col("high") + 1
    begin = F.greatest(F.lit(0), F.col("t") * F.col("own") - far)
    end = F.least(F.col("n_words"), (F.col("t") + 1) * F.col("own") + 2 * far)
    return at.select("uid", "low", "high", begin.alias("first"), F.array_join(F.slice("words", begin.cast("int") + 1, (end - begin).cast("int")), " ").alias("text"))


def stitched(parts: DataFrame) -> DataFrame:
    """(uid, start, length, period): fragments (uid, period, lo, hi) of a document and period that touch or overlap, as runs."""
    order = Window.partitionBy("uid", "period").orderBy("lo", "hi")
    ahead = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.distinct().withColumn("new", F.when(F.col("lo") <= ahead, 0).otherwise(1))
    whole = marked.withColumn("island", F.sum("new").over(order)).groupBy("uid", "period", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    runs = whole.select("uid", F.col("lo").alias("start"), (F.col("hi") - F.col("lo") + F.col("period")).alias("length"), "period")
    return runs.filter((F.col("length") >= LEAST) & (F.col("length") >= 2 * F.col("period")))


def _without(as_digest: bool):
    def run(text: pd.Series, start: pd.Series, length: pd.Series, period: pd.Series) -> pd.Series:
        out = []
        for t, a, n, q in zip(text, start, length, period):
            words = _WORDS.findall(t or "")
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, np.asarray(a, int) + np.asarray(q, int), 1)
            np.add.at(edge, np.asarray(a, int) + np.asarray(n, int), -1)
            kept = np.flatnonzero(edge.cumsum()[:-1] == 0)
            out.append(_collapsed([words[i] for i in kept], as_digest))
        return pd.Series(out)

    return F.pandas_udf(run, "string")


def periodic_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, as_digest: bool = False, long: int = LONG, tile: int = TILE) -> DataFrame:
    """(row, n_words, runs, collapsed): each document (or the columns ``keep`` of it) with its runs as an array of (start, period,
    length) in that order, and its words joined by one space without those after the first period of any run; with as_digest that
    text's SHA-256 instead, which is all that is written then of texts without runs."""
    row = F.struct(*[F.col(c) for c in (keep or docs.columns)])
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), row.alias("row"), F.col(text_col).alias("text"), _solver(as_digest, long)(F.col(text_col)).alias("s"))
    again = F.col("s.collapsed").isNull()
    solved = cut(numbered.select("uid", "row", "s.*", F.when(again, F.col("text")).alias("text")), "solved")
    held = solved.filter(F.col("collapsed").isNull())
    short = held.select("uid", F.inline("fragments"))
    dealt = tiles(held.filter(F.col("n_words") > long), tile).repartition("uid", "low", "first")
    found = F.pandas_udf(_solve_tiles, FOUND)("low", "high", "first", "text")
    tiled = dealt.select("uid", found.alias("f")).select("uid", F.inline("f"))
    runs = stitched(short.unionByName(tiled)).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    none = F.array().cast("array<struct<start:long,period:long,length:long>>")
    joined = held.select("uid", "row", "n_words", "text").join(runs, "uid", "left").withColumn("runs", F.coalesce("runs", none))
    part = lambda c: F.transform("runs", lambda r: r[c])
    again = joined.select("row", "n_words", "runs", _without(as_digest)("text", part("start"), part("length"), part("period")).alias("collapsed"))
    return solved.filter(F.col("collapsed").isNotNull()).select("row", "n_words", none.alias("runs"), "collapsed").unionByName(again)


def longest(runs: str = "runs") -> Column:
    """The run of greatest length, of equal ones the one that starts first, then the smallest period; null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))
