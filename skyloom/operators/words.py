"""Word count by map-reduce, and its top words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters in lower case; partial counts before the shuffle."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"\P{L}+")).alias("word"))
    return words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def by_initial(counts: DataFrame) -> DataFrame:
    """(initial, words, keys): words in all and distinct ones by first letter."""
    return counts.groupBy(F.substring("word", 1, 1).alias("initial")).agg(F.sum("n").alias("words"), F.count("*").alias("keys"))


def top_words(counts: DataFrame, n: int = 1000) -> DataFrame:
    return counts.orderBy(F.desc("n"), F.desc("word")).limit(n)
