"""Language identification by cross-parsing entropy.

Per language, a suffix automaton holds every substring of a bounded reference text made of labelled documents. A text is
cross-parsed against it: the longest match with the reference is one phrase, then parsing goes on behind it. The language
whose reference parses the text into the fewest bits wins. A phrase costs the logarithm of its own reference's length, so a
label with little text has longer parses but takes nothing from the others; it never costs less than a symbol written out.
A symbol that the reference lacks costs as much as a phrase of the longest reference, or a label of a few letters would
parse everything cheaply.

The automaton is completed into a table: a missing transition leads to where the symbol leads from the root and carries a
flag, "a new phrase starts here". Many texts walk the tables in step, so a symbol costs a few numpy operations.
To keep the lanes even, a text is walked in segments of ``SEGMENT`` symbols at once, each as if a phrase started with it; then
every segment is walked anew from the state that the one before really ends in, until both walks are in one state, which takes
a few phrases. So the phrases are those of the whole text, wherever segments end.

Defined results: ``und`` and score 0 for a text that is null or has no letter, or if there is nothing to learn from; ties
go to the first language in order of name; repeated rows are judged each for itself; an empty table gives an empty
result; columns other than the id, text and label are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.batches import returning_memory

#: Characters of a labelled row up to which it is learned from, and those of reference text per language at which no more rows
#: are taken. Bounds of the sample; rows are taken whole.
LONGEST, REFERENCE = 5_000, 20_000
#: Letters that have a symbol of their own; all others share one.
LETTERS = 250
SEGMENT = 1024
#: Symbols of text parsed at once.
BATCH = 1 << 20
OTHER, SPACE, FIRST = 0, 1, 2
#: The language of a text that has none.
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    symbols: np.ndarray  # by code point, uint8
    table: np.ndarray  # (state * width + symbol) -> state * width << 1 | a new phrase starts
    roots: np.ndarray  # the place of each language's root row
    costs: np.ndarray  # bits of a phrase, per language
    lacks: np.ndarray | None = None  # (symbol, language) -> bits more that a symbol costs that the reference lacks; None if none does


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of text; state 0 is the root."""
    nexts: list[dict[int, int]] = [{}]
    links, longest, last = [-1], [0], 0
    for c in text:
        new = len(nexts)
        nexts.append({})
        longest.append(longest[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = links[p]
        if p >= 0:
            q = nexts[p][c]
            if longest[q] == longest[p] + 1:
                links[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                longest.append(longest[p] + 1)
                links.append(links[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = links[p]
                links[q] = links[new] = copy
        last = new
    return nexts


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def symbol_table(texts: list[str]) -> np.ndarray:
    """A symbol for every code point: letters by how common their lower case is; everything else is a space."""
    common = Counter("".join(texts).lower())
    own = [c for c, _ in sorted(common.items(), key=lambda x: (-x[1], x[0])) if c.isalpha()][:LETTERS]
    place = {c: FIRST + i for i, c in enumerate(own)}
    return np.frombuffer(bytes((place.get(c.lower(), OTHER) if c.isalpha() else SPACE) for c in map(chr, range(0x110000))), np.uint8)


def symbols_of(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbols of a text, runs of spaces as one."""
    s = table[points]
    return s[(s != SPACE) | np.r_[True, s[:-1] != SPACE]]


def build_model(samples: dict[str, list[str]], one_length: bool = True) -> Model:
    """Automata of the sampled texts of each language: cut to one length so that none has more to match, or each at its own."""
    samples = {k: samples[k] for k in sorted(samples)}
    symbols = symbol_table([t for texts in samples.values() for t in texts])
    refs = {k: symbols_of(code_points(" ".join(texts)), symbols) for k, texts in samples.items()}
    refs = {k: r for k, r in refs.items() if (r != SPACE).any()}
    width = 1 + max([int(r.max()) for r in refs.values()], default=0)
    symbols = np.where(symbols < width, symbols, OTHER).astype(np.uint8)
    if one_length:
        least = min(map(len, refs.values()), default=0)
        refs = {k: r[:least] for k, r in refs.items()}
    tables, roots, at = [], [], 0
    for r in refs.values():
        nexts = suffix_automaton(r.tobytes())
        full = np.full((len(nexts), width), -1, np.int64)
        for state, row in enumerate(nexts):
            full[state, list(row)] = list(row.values())
        root = np.maximum(full[0], 0)
        missing = full < 0
        missing[0] = True  # from the root, a phrase starts with any symbol
        full = np.where(missing, root, full)
        tables.append((((at + full) * width) << 1 | missing).ravel())
        roots.append(at * width << 1)
        at += len(nexts)
    sizes = np.array([max(2, len(r)) for r in refs.values()])
    most = sizes.max(initial=2)
    costs = np.log2(sizes if sizes.min(initial=most) == most else np.maximum(sizes, min(width, most)))
    lacks = None
    if (costs < np.log2(most)).any():
        lacks = np.stack([np.where(np.bincount(r, minlength=width) == 0, np.log2(most) - c, 0.0) for r, c in zip(refs.values(), costs)], axis=1)
    kind = np.int32 if at * width < 1 << 30 else np.int64
    return Model(list(refs), symbols, np.concatenate(tables).astype(kind) if tables else np.zeros(0, kind), np.array(roots, kind), costs, lacks)


def _walk(model: Model, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last state, phrases) of every segment (columns) against each language (rows), from the roots; longest segments first."""
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0])), side="right")
    state = np.repeat(model.roots[:, None], len(starts), axis=1)
    count = np.zeros_like(state)
    for step, n in enumerate(active.tolist()):
        symbol = data[starts[:n] + step].astype(np.int32)
        moved = model.table[(state[:, :n] >> 1) + symbol]
        state[:, :n] = moved
        moved &= 1
        count[:, :n] += moved
    return state >> 1, count


def _rejoin(model: Model, data: np.ndarray, at: np.ndarray, end: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walks from the states old and new over the symbols from at to end until both meet: phrases that the new walk has more,
    whether they met, and the new walk's last state where they didn't."""
    more, met, last = np.zeros(len(at), np.int64), np.zeros(len(at), bool), new.copy()
    lane, at, old, new = np.arange(len(at)), at.copy(), old.copy(), new.copy()
    while len(lane):
        symbol = data[at].astype(np.int32)
        one, two = model.table[old + symbol], model.table[new + symbol]
        more[lane] += (two & 1) - (one & 1)
        old, new, at = one >> 1, two >> 1, at + 1
        met[lane] = old == new
        last[lane] = new
        go = (old != new) & (at < end[lane])
        lane, at, old, new = lane[go], at[go], old[go], new[go]
    return more, met, last


def phrases(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Phrases of each text's symbols (rows) against each language (columns)."""
    n_lang = len(model.languages)
    out = np.zeros((len(texts), n_lang), np.int64)
    data = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
    if not len(data):
        return out
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pieces = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), pieces)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + inner * SEGMENT
    lengths = np.minimum(SEGMENT, sizes[owner] - inner * SEGMENT)
    order = np.argsort(-lengths, kind="stable")
    final, count = (np.empty((n_lang, len(starts)), np.int64) for _ in range(2))
    final[:, order], count[:, order] = _walk(model, data, starts[order], lengths[order])
    given = np.repeat(model.roots[:, None] >> 1, len(starts), axis=1)
    follows = np.flatnonzero(inner > 0)
    while True:
        k, j = np.nonzero(final[:, follows - 1] != given[:, follows])
        if not len(k):
            break
        s = follows[j]
        want = final[k, s - 1]
        more, met, last = _rejoin(model, data, starts[s], starts[s] + lengths[s], given[k, s], want)
        count[k, s] += more
        given[k, s] = want
        final[k[~met], s[~met]] = last[~met]
    for k in range(n_lang):
        out[:, k] = np.bincount(owner, count[k], len(texts)).astype(np.int64)
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits a symbol of each text. The score is how far the winner leads, from 0 to 1."""
    known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model.languages else []
    langs, scores, rates = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    at = 0
    while at < len(known):
        some, symbols, held = [], [], 0
        while at < len(known) and held < BATCH:
            some.append(known[at])
            symbols.append(symbols_of(code_points(texts[known[at]]), model.symbols))
            held += len(symbols[-1])
            at += 1
        bits = phrases(model, symbols) * model.costs
        if model.lacks is not None:
            bits += np.stack([np.bincount(s, minlength=len(model.lacks)) for s in symbols]) @ model.lacks
        bits /= np.fromiter(map(len, symbols), np.float64, len(symbols))[:, None]
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(some)), best]
        others = bits.copy()
        others[np.arange(len(some)), best] = np.inf
        second = others.min(axis=1)
        for i, b in zip(some, best.tolist()):
            langs[i] = model.languages[b]
        scores[some] = np.where(np.isfinite(second), 1 - low / second, 1.0)
        rates[some] = low
    return langs, scores, rates


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Texts to learn from, as words: of each label, whole rows with a letter outside the held-out fifth and of at most LONGEST
    characters, first by hash of id and text, as many as REFERENCE characters take; of a label without such rows its shortest
    one. So the driver gets a bounded text per language.

    Hashes are halved until half of what is left would hold too little, so that only a bounded number of rows is sorted."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        "id is not null and lang is not null and text is not null"
    )
    learn = labelled.filter((F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0) & F.col("text").rlike(r"\p{L}"))
    words = learn.select("lang", "id", F.xxhash64("id", "text").alias("h"), F.length("text").alias("n"), "text")
    place = F.col("h") / 2.0**64 + 0.5
    words = words.withColumn("level", F.least(F.lit(60), F.floor(-F.log2(F.greatest(place, F.lit(2.0**-61)))).cast("int")))
    short = F.col("n") <= LONGEST
    held = words.groupBy("lang", "level").agg(F.sum(F.when(short, F.col("n"))).alias("symbols"), F.min(F.struct("n", "h", "id")).alias("least"))
    levels: dict[str, dict[int, tuple]] = {}
    for r in held.collect():  # at most 61 rows a language, as the model has a table each
        levels.setdefault(r["lang"], {})[r["level"]] = (r["symbols"] or 0, tuple(r["least"]))
    wanted = []
    for lang, by_level in levels.items():
        total, least = 0, None
        for level in sorted(by_level, reverse=True):
            total += by_level[level][0]
            if least is None and total >= 2 * REFERENCE:
                least = level
        single = None if total else min(x for _, x in by_level.values())
        wanted.append((lang, least or 0, single[2] if single else None, single[1] if single else None))
    samples: dict[str, list[str]] = {}
    if not wanted:
        return samples
    kind = words.schema["id"].dataType.simpleString()
    asked = docs.sparkSession.createDataFrame(wanted, f"lang string, least int, single {kind}, single_h long")
    some = words.join(F.broadcast(asked), "lang").filter((F.col("single").isNull() & (F.col("level") >= F.col("least")) & short) | (F.col("id") == F.col("single")))
    need = Window.partitionBy("lang").orderBy("h", "id", "n").rowsBetween(Window.unboundedPreceding, -1)
    first = some.withColumn("before", F.coalesce(F.sum("n").over(need), F.lit(0))).filter(F.col("before") < REFERENCE)
    for r in first.select("lang", F.regexp_replace("text", r"\P{L}+", " ").alias("text"), "h", "id").orderBy("lang", "h", "id", "text").collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    return samples


def _predict_rows(model):
    @returning_memory
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            lang, score, rate = predict(model.value, t.tolist())
            yield pd.DataFrame({"lang": lang, "score": score, "bits": rate})

    return F.pandas_udf("lang string, score double, bits double")(predicted)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    return build_model(training_sample(docs, id_col, text_col, lang_col), one_length=False)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """One row per input row: row (all input columns) and found, a struct of lang, score and bits a symbol."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # about 2 * REFERENCE rows of table per language
    return docs.select(F.struct("*").alias("row"), _predict_rows(shipped)(F.col(text_col)).alias("found"))
