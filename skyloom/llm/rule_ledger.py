"""Quality rules as a ledger: every rule is evaluated once per document, policies are applied to what is stored.

ledger() makes one row a document: its measurements and ``fail_bits``, whose bit b is set if rule b of RULES failed. The ledger is
meant to be written; a policy is a version, the rules that it heeds and how many of them a document may fail, so another
policy is one ``fail_bits & mask`` per stored row and never reads a text again. ablations() pre-aggregates the ledger to distinct
failure patterns, at most 2**rules whatever the corpus, and takes what each rule removes alone from them.

Words are runs of anything but space and the ASCII control whites (9 to 13), lines are cut at ``\\n``. A word is repeated if it lies
in an 8-word window that occurs twice or more in its text, overlaps and the first occurrence included; windows are compared
exactly, by names that doubling gives to windows of 2, 4 and 8 words.

Null or blank text: no word, so all measurements are 0 and the rule on few words fails. A text is one row, measured whole and in
memory linear in its length. Every row gets a ledger row of its own, so null, repeated or tied ids need no rule; the document's
columns are kept in one struct, so their names can't clash. No row in, no row out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window whose repeats count.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
WORD = re.compile("[^\x20\x09-\x0d]+")
#: Odd multipliers of window hashes.
SPREAD, BASE_HASH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_lettered long, n_repeat_words long"


#: Name and failure, in SQL over the measurements, of each rule; a rule's place is its bit, so new ones go to the end. Whole numbers
#: only, so results are exact.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_passages", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    ("few_letters", "10 * n_lettered < 7 * n_words"),
)
#: Rules that every policy heeds.
BASE = ("few_words", "repeated_passages")


class Policy(NamedTuple):
    """A version of the corpus rules: a document is kept if it fails none of BASE and at most ``allowed`` of ``rules``."""

    version: int
    rules: tuple[str, ...]
    allowed: int = 0


POLICIES = (
    Policy(1, ("symbols", "few_letters")),
    Policy(2, ("symbols", "duplicate_lines", "word_length", "few_letters"), 1),
    Policy(3, ("symbols", "duplicate_lines", "word_length", "few_letters")),
)


def bit(name: str) -> int:
    return 1 << [n for n, _ in RULES].index(name)


def mask(names: Sequence[str]) -> int:
    return sum(bit(n) for n in set(names))


def repeated(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows (a power of two long) that occur twice or more. Equal windows have equal hashes, so texts whose hashes all
    differ are done; the others' windows get names by doubling, which are equal just where the windows are."""
    if len(ids) <= window:
        return 0
    hashes, size = (ids.astype(np.uint64) + np.uint64(1)) * SPREAD, 1
    while size < window:
        hashes = hashes[:-size] * BASE_HASH + (hashes[size:] ^ (hashes[size:] >> np.uint64(31)))
        size *= 2
    hashes.sort()
    if not (hashes[1:] == hashes[:-1]).any():
        return 0
    name, size = ids.astype(np.int64), 1
    while size < window:
        pairs = name[:-size] * (int(name.max()) + 1) + name[size:]
        name, times = np.unique(pairs, return_inverse=True, return_counts=True)[1:]
        size *= 2
    covered = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(times[name] > 1)
    covered[starts] += 1
    covered[starts + window] -= 1
    return int(np.count_nonzero(covered.cumsum()))


@lru_cache(100_000)
def _lettered(word: str) -> bool:
    return any(map(str.isalpha, word))


def measures(text: str | None) -> tuple[int, ...]:
    """The measurements of a text, in the order of MEASURES."""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    bare = {w for w in number if not (_lettered(w) if len(w) < 40 else any(map(str.isalpha, w)))}
    n_lettered = len(words) - (sum(w in bare for w in words) if bare else 0)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), n_lettered, repeated(ids)


def _measured(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measures(t) for t in text], columns=[c.split()[0] for c in MEASURES.split(", ")], dtype="int64")


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, measured, fail_bits): each document with its measurements and the bits of the rules that it fails."""
    measured = F.pandas_udf(_measured, MEASURES)
    held = docs.select(F.struct("*").alias("row"), measured(F.col(text_col)).alias("measured"))
    failed = [F.when(F.expr(re.sub(r"\b(?=n_|word_)", "measured.", rule)), 1 << i).otherwise(0) for i, (_, rule) in enumerate(RULES)]
    return held.withColumn("fail_bits", sum(failed[1:], failed[0]).cast("long"))


def fails(names: Sequence[str], bits: str = "fail_bits") -> Column:
    """How many of the named rules failed."""
    return F.bit_count(F.col(bits).bitwiseAND(F.lit(mask(names)).cast("long")))


def verdict(policy: Policy, bits: str = "fail_bits") -> Column:
    """Whether a policy keeps what has these failure bits."""
    return (fails(BASE, bits) == 0) & (fails(policy.rules, bits) <= policy.allowed)


def judge(written: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """The ledger with an array ``kept_by`` of the versions that keep each document."""
    held = [F.when(verdict(p), F.lit(p.version)) for p in policies]
    return written.withColumn("kept_by", F.array_compact(F.array(*held)) if held else F.array().cast("array<int>"))


def ablations(written: DataFrame, policies: Sequence[Policy] = POLICIES, *by: str) -> DataFrame:
    """(by, version, rule, docs, kept, failed, alone, kept_without): per policy and rule it heeds, documents, those kept, those
    failing the rule, those failing it and no other heeded rule, and those kept if the policy didn't heed it. ``any_bits`` and
    ``all_bits`` are the rules that some and that all documents of the group fail."""
    patterns = written.groupBy(*by, "fail_bits").agg(F.count("*").alias("n"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    out = []
    for p in policies:
        for rule in dict.fromkeys((*BASE, *p.rules)):
            base, rest = tuple(r for r in BASE if r != rule), tuple(r for r in p.rules if r != rule)
            less = (fails(base) == 0) & (fails(rest) <= p.allowed)
            hit = F.col("fail_bits").bitwiseAND(F.lit(bit(rule)).cast("long")) != 0
            out.append((p.version, rule, verdict(p), hit, hit & (fails((*BASE, *p.rules)) == 1), less))
    each = [F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), k.alias("k"), h.alias("h"), a.alias("a"), w.alias("w")) for v, r, k, h, a, w in out]
    fan = patterns.select(*by, "fail_bits", "n", F.inline(F.array(*each)))
    return fan.groupBy(*by, "version", "rule").agg(
        F.sum("n").alias("docs"),
        count(F.col("k"))("kept"),
        count(F.col("h"))("failed"),
        count(F.col("a"))("alone"),
        count(F.col("w"))("kept_without"),
        F.bit_or("fail_bits").alias("any_bits"),
        F.bit_and("fail_bits").alias("all_bits"),
    )
