"""Phrase mining in the manner of SETM: relations of occurrences, counted, semi-joined with what is frequent, and extended by a word.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends (bytes 10 to 13), and pieces into words at spaces and tabs.
The relation of length k holds every occurrence of a frequent phrase of k words, sorted by document, piece and position, and is written.
It is stored by column: a document is one array of phrase numbers in that order, 0 wherever the next occurrence isn't at the
adjacent position of the same piece. The merge-join of a relation with itself by piece and adjacent position is then one pass
over neighbours, and gives the occurrences of k + 1 words whose first and last k words are frequent. They are counted by group
(summed in the task first, so a hot phrase is a row a task), groups under ``least`` go, and the semi-join that leaves the frequent groups'
occurrences numbers them too. Numbers are exact: a phrase is the pair of its first and last k words.

The frequent groups of a length are sent to the tasks if they are at most FITS; more are joined by a shuffle on the pair, where Spark
splits hot pairs, and the relation is put together again by document. Both ways give the same relation.

A phrase's score is the least over its cuts of floor(1000 a n / (l r)), in decimals of 38 digits. A candidate is dropped where a
longer one holds it and occurs as often: one word longer is enough to look at, for what lies between the two occurs as often too.

Null text: no word. Null language: ``und``, the same as that name. Empty texts and pieces have no word; a text is one row, read whole.
Repeated rows count each. The document's id and further columns are never read, so they may be null, repeated or named anyhow. Ties of
score and count are ranked by the phrase's bytes. No row in, or nothing frequent: no row out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import cut

#: Groups of a length up to which tasks hold all of them: some 24 bytes each for pairs, 100 for words.
FITS = 1_000_000
#: Distinct words that a task counts before it hands them on.
HELD = 500_000
UNKNOWN = "und"
#: First-level groups that a language's ranking is split in.
SHARES = 64

_TOKEN = re.compile(rb"[^\t .,;:!?\n-\r]+|[.,;:!?\n-\r]+")
_ENDS = frozenset(b".,;:!?\n\x0b\x0c\r")
_RELATION = "uid long, at array<long>"


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of a text with its piece ends between them."""
    return _TOKEN.findall((text or "").encode("utf-8", "replace").lower())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def hand_on() -> pa.RecordBatch:
        langs, words, n = [], [], []
        for lang, found in held.items():
            for end in [t for t in found if t[0] in _ENDS]:
                del found[end]
            langs += [lang] * (len(found) + 1)
            words += [*(w.decode() for w in found), None]
            n += [*found.values(), sum(found.values())]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, held.values())) > HELD:
                yield hand_on()
    yield hand_on()


def _numbered(groups: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Groups written with a dense number ``id`` from 1, and how many there are. Only one count a partition comes to the driver."""
    held = cut(groups.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    sizes = sorted(tuple(r) for r in held.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    first = held.sparkSession.createDataFrame(starts, "p long, first long")
    dense = held.join(F.broadcast(first), part == F.col("p")).withColumn("id", F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return dense.drop("p", "first", "at"), total


def _rows(uid: pa.Array, ends: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """A relation's rows from the numbers v of documents that end before ``ends``, each with a 0 last: occurrences that can be
    extended no more and zeros after zeros are left out, as are documents without an occurrence."""
    on = v > 0
    near = np.zeros(len(v), bool)
    near[1:] |= on[:-1]
    kept = on & near
    kept[:-1] |= on[:-1] & on[1:]
    stay = kept.copy()
    stay[1:] |= kept[:-1]
    upto = np.concatenate([[0], stay.cumsum()])[np.concatenate([[0], ends])]
    some = np.flatnonzero(np.diff(upto))
    offsets = np.concatenate([[0], upto[some + 1]]).astype(np.int32)
    at = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.where(kept, v, 0)[stay], pa.int64()))
    return pa.RecordBatch.from_arrays([uid.take(pa.array(some)), at], ["uid", "at"])


def _named_words(words):
    """Documents to the relation of single words; words: broadcast (languages, words, numbers) of the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, dict[bytes, int]] = {}
        for lang, word, number in zip(*(c.to_pylist() for c in words.value)):
            of.setdefault(lang, {})[word.encode()] = number
        for batch in batches:
            out, ends = [], []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                get = of.get(lang, {}).get
                out += [get(t, 0) for t in tokens(text)]
                out.append(0)
                ends.append(len(out))
            yield _rows(batch.column(0), np.array(ends, np.int64), np.array(out, np.int64))

    return run


def _pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << 32 | b


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a batch's documents in one array, and where each document ends."""
    at = batch.column(1)
    v, offsets = at.values.to_numpy(), at.offsets.to_numpy()
    return v[offsets[0] : offsets[-1]], offsets[1:].astype(np.int64) - offsets[0]


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v, _ = _flat(batch)
        both = np.flatnonzero((v[:-1] > 0) & (v[1:] > 0))
        kinds, local = np.unique(v, return_inverse=True)  # a batch's own numbers fit 32 bits
        pairs, n = np.unique(_pack(local[both], local[both + 1]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds[pairs >> 32]), pa.array(kinds[pairs & 0xFFFFFFFF]), pa.array(n.astype(np.int64))], ["a", "b", "n"])


def _named_pairs(pairs):
    """A relation to the next one; pairs: broadcast (packed pairs in order, numbers) of the frequent groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, numbers = pairs.value
        for batch in batches:
            v, ends = _flat(batch)
            both = np.flatnonzero((v[:-1] > 0) & (v[1:] > 0))
            code = _pack(v[both], v[both + 1])
            place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[place] == code
            out = np.zeros(len(v), np.int64)
            out[both[hit]] = numbers[place[hit]]
            yield _rows(batch.column(0), ends, out)

    return run


def _regrouped(occurrences: DataFrame) -> DataFrame:
    """A relation from single occurrences (uid, pos, id)."""
    held = occurrences.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("o"))
    gap = "flatten(transform(o, (x, i) -> if(i = 0 or o[i - 1].pos = x.pos - 1, array(x.id), array(0L, x.id))))"
    return held.select("uid", F.expr(f"concat({gap}, array(0L))").alias("at"))


def _words_relation(docs: DataFrame, groups: DataFrame, total: int, fits: int) -> DataFrame:
    spark = docs.sparkSession
    if total <= fits:
        table = groups.select("lang", "phrase", "id").toArrow()
        words = spark.sparkContext.broadcast(tuple(table.column(c).combine_chunks() for c in ("lang", "phrase", "id")))
        return docs.mapInArrow(_named_words(words), _RELATION)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [[None if t[0] in _ENDS else t.decode() for t in tokens(x)] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], ["uid", "lang", "words"])

    each = docs.mapInArrow(split, "uid long, lang string, words array<string>").select("uid", "lang", F.posexplode("words").alias("pos", "phrase"))
    return _regrouped(each.join(groups.select("lang", "phrase", "id"), ["lang", "phrase"]).select("uid", "pos", "id"))


def _extended(relation: DataFrame, groups: DataFrame, total: int, before: int, fits: int) -> DataFrame:
    """The next relation: the occurrences of the frequent groups (a, b, id)."""
    if total <= fits and before < 1 << 31:
        table = groups.select("a", "b", "id").toArrow()
        a, b, number = (table.column(c).to_numpy() for c in ("a", "b", "id"))
        code = _pack(a, b)
        order = np.argsort(code)
        return relation.mapInArrow(_named_pairs(relation.sparkSession.sparkContext.broadcast((code[order], number[order]))), _RELATION)
    each = relation.select("uid", F.posexplode(F.arrays_zip(F.col("at").alias("a"), F.expr("slice(at, 2, size(at))").alias("b"))).alias("pos", "x"))
    return _regrouped(each.select("uid", "pos", "x.*").filter("a > 0 and b > 0").join(groups.select("a", "b", "id"), ["a", "b"]).select("uid", "pos", "id"))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang", fits: int = FITS) -> tuple[DataFrame, list[DataFrame]]:
    """(totals, groups): words (lang, n) per language and, for each length from 1, the phrases that occur at least ``least`` times:
    (id, lang, phrase, last, a, firsts, rests), with their count a and the counts of their first 1, 2, ... words and of what
    is left of them without these; lengths from 2 on also have the numbers (first, rest) of their parts a word shorter."""
    docs = docs.select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    counted = docs.select("lang", "text").mapInArrow(_count_words, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = cut(counted.filter(F.col("phrase").isNull() | (F.col("n") >= least)), "words")
    totals = words.filter("phrase is null and n > 0").select("lang", "n")
    singles, total = _numbered(words.filter("phrase is not null"), "f1")
    none = F.array().cast("array<long>")
    groups = [singles.select("id", "lang", "phrase", F.col("phrase").alias("last"), F.col("n").alias("a"), none.alias("firsts"), none.alias("rests"))]
    relation = None
    for length in range(2, longest + 1):
        if relation is None:
            relation = cut(_words_relation(docs, singles, total, fits), "r1")
        elif not total:  # nothing that could be extended
            break
        else:
            relation = cut(_extended(relation, pairs, total, before, fits), f"r{length - 1}")
        counts = relation.mapInArrow(_count_pairs, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        before = total
        pairs, total = _numbered(counts.filter(F.col("n") >= least), f"f{length}")
        part = lambda p, *c: groups[-1].select(F.col("id").alias(p), *[F.col(x).alias(f"{p}_{x}") for x in c])  # noqa: E731, B023
        both = pairs.join(part("a", "lang", "phrase", "a", "firsts"), "a").join(part("b", "last", "a", "rests"), "b")
        groups.append(
            cut(
                both.select("id", F.col("a_lang").alias("lang"), F.concat_ws(" ", "a_phrase", "b_last").alias("phrase"), F.col("b_last").alias("last"), F.col("n").alias("a"),
                    F.concat("a_firsts", F.array("a_a")).alias("firsts"), F.concat(F.array("b_a"), "b_rests").alias("rests"), F.col("a").alias("first"), F.col("b").alias("rest")),
                f"g{length}",
            )
        )
    return totals, groups


def collocations(docs: DataFrame, top: int = 2000, **mining) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two words or more."""
    totals, groups = frequent_phrases(docs, **mining)
    held = []
    for shorter, longer in zip(groups[1:], [*groups[2:], None]):
        if longer is not None:
            over = longer.select(F.explode(F.array("first", "rest")).alias("id"), F.col("a").alias("over")).groupBy("id").agg(F.max("over").alias("over"))
            shorter = shorter.join(over, "id", "left").filter("over is null or over < a")
        held.append(shorter.select("lang", "phrase", "a", "firsts", "rests"))
    each = held[0]
    for more in held[1:]:
        each = each.unionByName(more)
    cuts = "transform(arrays_zip(firsts, rests), (x, i) -> struct((cast(1000 * a as decimal(19)) * cast(n as decimal(19))) div (cast(x.firsts as decimal(19)) * cast(x.rests as decimal(19))) as score, i as k, x.firsts as l, x.rests as r))"
    scored = each.join(totals, "lang").withColumn("best", F.expr(f"array_min({cuts})")).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    some = scored.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
