"""SimHash near-deduplication by shingle similarity: blocks of fingerprints find candidates, Hamming distances sift them, and
what is left is verified.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is SIMILARITY = 0.8 or more. Every
text has operator 10's 64-bit fingerprint, of those sets. Operator 10 links fingerprints within two bits, by its pigeonhole blocks; these
links are verified first. The fingerprints of most near copies differ in about ten bits, too many for pigeonhole blocks of those bits: blocks that some
pair within 16 bits must share are under four bits wide, and join everything with everything. So, for finding, the fingerprint is widened to
BLOCKS = 16 of 64 bits, and each block is the SimHash of a sample: of the SAMPLE = 4 shingles that come first in an order of
the block's own. An edit leaves the blocks alone whose samples it doesn't touch, so long texts of similarity s share a block with
probability 1 - (1 - s**SAMPLE)**BLOCKS, 0.9998 at 0.8, and two blocks with 0.997. Blocks are joined, and whatever shares two
of them is a candidate. No candidate, wherever it comes from, is looked at any further if its 64-bit fingerprints differ in over RADIUS bits or
its sizes are too different for SIMILARITY. The others are verified on the whole sets, so nothing else is linked.

Texts of up to FEW shingles are too short for samples of four. Their samples are of one, whose SimHash is the shingle's own: of n, the first n - ceil(0.8 n) + 1 in one
order of hashes, of which a pair of similarity 0.8 shares one with certainty. Texts of up to FEW / 0.8 have both kinds.

Verification goes in steps, as comparing all pairs of a group of copies would be a square of it. First each member of a
group is compared to its representative, chosen by hash; that links most of a true group. Then,
in groups whose members aren't all linked, the pairs that no links connect are compared, directly in groups of up to GROUP. What
larger groups leave unlinked has a mere passage in common, or is near some other member. For those texts, and only for them,
shingles are counted, and pairs are compared that share one of their rarest: of n shingles, the first n - ceil(8 n / 9) + 1 of the
smaller and the first n - ceil(0.8 n) + 1 of the larger text, rarest first, of which every pair of similarity 0.8 shares one. So
no group is cut short, and a passage that is less than 8/9 of the smaller text proposes nothing.

Defined results: a text without words is a near copy of nothing; a shorter text is one shingle; ids must be unique and not
null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.batches import cut_in_batches, returning_memory
from skyloom.llm.components import components
from skyloom.llm.simhash import near_links as fingerprint_links
from skyloom.llm.simhash import prints_of, shingle_hashes
from skyloom.session import cut

WIDTH, SIMILARITY = 5, 0.8
BLOCKS, SAMPLE = 16, 4
#: Bits in which the fingerprints of near copies may differ, 6 deviations above the 9.7 that those of similarity 0.8 do on average.
RADIUS = 28
#: Blocks that two fingerprints must share for the pair to be verified.
SHARED = 2
#: Members of a group up to which its unlinked pairs are compared directly, and those that each member of a larger one is compared to.
GROUP, REPS = 32, 1
#: Shingles whose places in the blocks' orders are taken at once.
CHUNK = 1 << 12
#: Shingles up to which a text's blocks are single ones.
FEW = 80
#: Ids up to which they are broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_DRAW = np.random.default_rng(42)
_TIMES, _PLUS = (_DRAW.integers(0, 1 << 64, BLOCKS, np.uint64, endpoint=False) for _ in range(2))
_TIMES |= np.uint64(1)


def least_shared(n: int, times: int, of: int) -> int:
    """ceil(n * times / of)."""
    return -(-n * times // of)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(np.array(shingle_hashes(text, WIDTH), np.uint64))


def samples(hashes: np.ndarray) -> np.ndarray:
    """(shingle, block): the shingles of each block's sample."""
    first = hashes[:0, None].repeat(BLOCKS, axis=1)
    for a in range(0, len(hashes), CHUNK):
        some = np.concatenate([first, np.broadcast_to(hashes[a : a + CHUNK, None], (len(hashes[a : a + CHUNK]), BLOCKS))])
        if len(some) > SAMPLE:
            order = np.argpartition(some * _TIMES + _PLUS, SAMPLE - 1, axis=0)[:SAMPLE]
            some = np.take_along_axis(some, order, axis=0)
        first = some
    return first


def block_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for every block of a text's fingerprint, as signed integers; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    first = hashes[:0]
    if len(hashes) * 4 <= FEW * 5:
        first = np.sort(hashes * _TIMES[0])[: len(hashes) - least_shared(len(hashes), 4, 5) + 1]
        first = np.concatenate([first ^ _PLUS[0], first ^ _PLUS[1]])  # as two, so that one is enough to be SHARED
        if len(hashes) <= FEW:
            return first.view(np.int64)
    sample = np.ascontiguousarray(samples(hashes))
    ones = np.unpackbits(sample.view(np.uint8).reshape(*sample.shape, 8), axis=2, bitorder="little").sum(axis=0)
    prints = np.packbits(2 * ones > len(sample), axis=1, bitorder="little").view(np.uint64)[:, 0]
    blocks = prints * np.uint64(0x9E3779B97F4A7C15) + _PLUS  # blocks of different number don't meet
    return np.concatenate([first, blocks]).view(np.int64)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t) for t in b.column(1).to_pylist()]
        keys = [block_keys(s) for s in sets]
        ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        fp = pa.array(prints_of(sets).view(np.int64), mask=np.array([not len(s) for s in sets], bool))
        sizes = pa.array(list(map(len, sets)), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), fp, sizes, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "fp", "size", "keys"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, len(b), 256):
            some = b.slice(a, 256)
            sets = [shingle_set(t).tobytes() for t in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])


def similar(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of SIMILARITY or more."""
    few, many = sorted((len(one), len(other)))
    if few < SIMILARITY * many or not few:
        return False
    same = len(np.intersect1d(one, other, assume_unique=True))
    return same >= SIMILARITY * (few + many - same)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, len(b), 64):
            some = b.slice(a, 64)
            sets = [shingle_set(t).view(np.int64) for t in some.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            ids = some.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets))], ["id", "size", "token"])


def _verified_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = ([np.frombuffer(x, np.uint64) for x in b.column(i).to_pylist()] for i in (2, 3))
        near = pa.array([similar(x, y) for x, y in zip(*sets)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(near)


def _shared(keyed: DataFrame) -> DataFrame:
    """Rows of (id, label, key) whose key others have too, with n, how many, and reps, (id, label) of members chosen by hash. Most keys
    are one text's alone, so only their count is taken of all."""
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keyed.join(several, "key"), "shared")
    reps = [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), F.struct("id", "label").alias("rep")))["rep"].alias(f"r{i}") for i in range(REPS)]
    chosen = shared.groupBy("key").agg(*reps).select("key", F.array_distinct(F.array(*[f"r{i}" for i in range(REPS)])).alias("reps"))
    return cut(shared.join(chosen, "key"), "shared")


def _star_pairs(shared: DataFrame) -> DataFrame:
    """(u, v, blocks): each member with its group's representatives of other labels, one in a group of up to GROUP members, REPS in a
    larger one, and in how many groups they meet so."""
    reps = F.when(F.col("n") > GROUP, F.col("reps")).otherwise(F.slice("reps", 1, 1))
    far = shared.select("id", F.explode(F.filter(reps, lambda r: r["label"] != F.col("label"))["id"]).alias("rep"))
    return far.groupBy(F.least("id", "rep").alias("u"), F.greatest("id", "rep").alias("v")).agg(F.count("*").alias("blocks"))


def _print_pairs(prints: DataFrame) -> DataFrame:
    """(u, v): operator 10's links. Texts with equal fingerprints meet the one with the smallest id, and those meet where their fingerprints are linked."""
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    equal = prints.join(distinct, "fp").filter("id <> least").select(F.col("least").alias("u"), F.col("id").alias("v"))
    least = lambda fp, i: distinct.select(F.col("fp").alias(fp), F.col("least").alias(i))
    linked = fingerprint_links(distinct).join(least("u", "x"), "u").join(least("v", "y"), "v")
    return equal.union(linked.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")))


def _close(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs whose fingerprints differ in at most RADIUS bits, and whose sizes allow SIMILARITY."""
    side = lambda i, name: prints.select(F.col("id").alias(i), F.struct("fp", "size").alias(name))
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")
    bits = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    return cut(both.filter((bits <= RADIUS) & _sized("a", "b")).select("u", "v"), "close")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose similarity, on the whole sets, is SIMILARITY or more."""
    ids = _few_or_joined(cut(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ids"))
    sets = cut_in_batches(texts.join(ids, "id", "left_semi").mapInArrow(returning_memory(_set_rows), "id long, shingles binary"), "shingles")
    side = lambda i, s: sets.select(F.col("id").alias(i), F.col("shingles").alias(s))
    both = pairs.join(side("v", "b"), "v").join(side("u", "a"), "u")
    return cut_in_batches(both.select("u", "v", "a", "b").mapInArrow(returning_memory(_verified_rows), "u long, v long"), "verified")


def _unlinked(shared: DataFrame, links: DataFrame) -> DataFrame:
    """(key, id, n, reps, label): the members of groups that the links don't connect, with the component of each."""
    labels = cut(components(links), "labels").select(F.col("node").alias("id"), "label")
    labelled = shared.drop("label").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    return cut(labelled.join(mixed, "key"), "unlinked")


def _small_pairs(shared: DataFrame, keyed: DataFrame | None = None) -> DataFrame:
    """The pairs of other labels in groups of up to GROUP members; with keyed, those that share SHARED blocks or more."""
    small = shared.filter(F.col("n") <= GROUP).select("key", "id", "label")
    apart = (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label")) & (F.col("x.key") == F.col("y.key"))
    if keyed is not None:
        small = cut(small.join(keyed, "id"), "small")
        apart &= F.size(F.array_intersect("x.keys", "y.keys")) >= SHARED
    return small.alias("x").join(small.alias("y"), apart).select(F.col("x.id").alias("u"), F.col("y.id").alias("v"))


def _few_or_joined(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it's known to be small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _rarest(crowded: DataFrame, texts: DataFrame) -> DataFrame:
    """(token, id, label, size, own, small, rest) of each crowded text's rarest shingles that others of them have too: those that it may share with
    a smaller near copy, and whether it may share them with a larger one; own is the part of its shingles that no other has, rest how many
    there are from this one on."""
    ids = _few_or_joined(cut(crowded.select("id"), "ids"))
    tokens = cut_in_batches(texts.join(ids, "id", "left_semi").mapInArrow(returning_memory(_shingle_rows), "id long, size long, token long"), "tokens")
    counts = tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    ordered = tokens.join(counts, "token").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
    alone = F.col("size") - F.size("t")  # shingles of no other text come first
    upto = lambda times, of: F.greatest(F.lit(0), F.col("size") - F.ceil(F.col("size") * times / of) + 1 - alone).cast("int")
    first = ordered.withColumns({"large": upto(4, 5), "few": upto(8, 9)})
    each = first.select("id", "size", "few", (alone / F.col("size")).alias("own"), alone.alias("before"), F.posexplode(F.slice("t", F.lit(1), F.col("large"))).alias("pos", "t"))
    return cut(each.select("id", "size", "own", F.col("t.token").alias("token"), (F.col("pos") < F.col("few")).alias("small"), (F.col("size") - F.col("before") - F.col("pos")).alias("rest")).join(crowded, "id"), "rarest")


def _sized(u: str, v: str):
    """Whether the sizes of two texts allow SIMILARITY."""
    return (F.col(f"{u}.size") * 5 >= F.col(f"{v}.size") * 4) & (F.col(f"{v}.size") * 5 >= F.col(f"{u}.size") * 4)


def _rare_stars(rare: DataFrame) -> DataFrame:
    """(u, v): members of a rare shingle's group with the one that has least of its own, as an original has among its copies."""
    chosen = rare.groupBy("token").agg(F.min(F.struct("own", F.xxhash64("id").alias("h"), "id", "label", "size")).alias("rep"), F.count("*").alias("n")).filter("n > 1")
    met = rare.alias("x").join(chosen.select("token", "rep.id", "rep.label", "rep.size").alias("y"), "token").filter((F.col("x.label") != F.col("y.label")) & _sized("x", "y"))
    return met.select(F.least("x.id", "y.id").alias("u"), F.greatest("x.id", "y.id").alias("v")).distinct()


def _rare_pairs(rare: DataFrame) -> DataFrame:
    """(u, v): texts of different labels that share a rare shingle, the smaller one among those that it may share with a larger, and have
    enough shingles from there on to be near copies if it is the first that they share."""
    order = lambda t: F.struct(F.col(f"{t}.size"), F.col(f"{t}.id"))
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & (order("x") < order("y")) & (F.col("y.size") * 4 <= F.col("x.size") * 5)
    apart &= F.least("x.rest", "y.rest") * 9 >= (F.col("x.size") + F.col("y.size")) * 4
    met = rare.filter("small").alias("x").join(rare.alias("y"), apart)
    return met.select(F.least("x.id", "y.id").alias("u"), F.greatest("x.id", "y.id").alias("v")).distinct()


def _labelled(links: DataFrame) -> DataFrame:
    return cut(components(links), "labels").select(F.col("node").alias("id"), "label")


def near_links(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(u, v) of documents whose similarity was computed and is SIMILARITY or more; enough of them to connect all that share blocks."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = cut_in_batches(texts.mapInArrow(returning_memory(_key_rows), "id long, fp long, size long, keys array<long>"), "keys")
    prints, keys = keyed.filter("fp is not null").select("id", "fp", "size"), keyed.select("id", "keys")
    checked = lambda pairs: _verified(_close(pairs, prints), texts)
    again = lambda rows: rows.drop("label").join(_labelled(links), "id", "left").withColumn("label", F.coalesce("label", "id"))
    met = cut(_print_pairs(prints), "pairs")
    links = checked(met)
    shared = _shared(again(keys).select("id", "label", F.explode("keys").alias("key")))
    stars = _star_pairs(shared).filter(F.col("blocks") >= SHARED).select("u", "v")
    tried = cut(stars.join(met, ["u", "v"], "left_anti"), "pairs")
    links = links.union(checked(tried))
    left = _unlinked(shared, links)
    known = met.union(tried)
    direct = cut(_small_pairs(left, keys).distinct().join(known, ["u", "v"], "left_anti"), "pairs")
    links = links.union(checked(direct))
    crowded = cut(again(left.filter(F.col("n") > GROUP).select("id", "label").distinct()), "crowded")
    rare = _rarest(crowded, texts)
    known = known.union(direct)
    stars = cut(_rare_stars(rare).join(known, ["u", "v"], "left_anti"), "pairs")
    links = links.union(checked(stars))
    rest = cut(_rare_pairs(again(rare)).join(known.union(stars), ["u", "v"], "left_anti"), "pairs")
    return links.union(checked(rest))


def near_components(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, component_id) of every document that has a near copy; component_id is the smallest id reachable over near copies."""
    labels = cut(components(near_links(docs, id_col, text_col)), "labels")
    return labels.select(F.col("node").alias("id"), F.col("label").alias("component_id")).union(labels.select("label", "label").distinct())
