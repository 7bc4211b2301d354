"""A training-corpus pipeline over documents; its stages call the operators of skyloom.llm.

Language ID drops what has no language, or none that can be told, exact and near deduplication keep one document of each group (near copies: five-word
shingles 0.8 alike or more), decontamination drops documents that hold a benchmark item, and what is left is packed into
sequences of 2048 tokens.

SQL can't express the stages; tests/llm checks the whole run against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.batches import cut_in_batches
from skyloom.llm.decontaminate import leaks
from skyloom.llm.exact_dedup import exact_dedup
from skyloom.llm.language_id import UNKNOWN, fit, identify
from skyloom.llm.near_copies import near_components
from skyloom.llm.packing import pack_documents
from skyloom.session import cut, table

#: Languages that stay; all that labels teach if none is named. A text is of none of them if the winner leads the second by less than
#: CLEAR (0 to 1) and still takes FOREIGN bits a symbol, about as many as random letters.
LANGUAGES: tuple[str, ...] = ()
CLEAR, FOREIGN = 0.02, 4.0
#: Ids of dropped documents up to which they are broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def numbered(docs: DataFrame) -> DataFrame:
    """(uid, row): a unique number for every row, as doc_id may be null or repeated. Where docs are read from files it is a hash of the file and the row's
    place there, so nothing is copied; where they aren't, or two rows have the same hash, numbered rows are written."""
    try:
        place = docs.metadataColumn("_metadata")
        rows = docs.select(F.xxhash64(place["file_path"], place["row_index"]).alias("uid"), F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]).alias("row"))
        if rows.groupBy("uid").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return rows
    except AnalysisException:  # no files, or files without places of rows
        pass
    return cut(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), "numbered")


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of numbered rows whose uid isn't among the column id."""
    ids = cut_in_batches(ids.distinct(), "dropped")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return rows.join(ids, rows["uid"] == ids["id"], "left_anti").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the operator can tell, and that is among LANGUAGES: it is not ``und``, and some
    language's reference explains the text better than random letters or better than the others do. Where no label teaches a language, documents with a letter."""
    model = fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    foreign = (F.col("found.score") < CLEAR) & (F.col("found.bits") >= FOREIGN)
    told = (F.col("found.lang") != UNKNOWN) & ~foreign
    wanted = F.col("found.lang").isin(*LANGUAGES) if LANGUAGES else F.lit(True)
    rows = numbered(docs)
    found = identify(rows.select("uid", F.col("row.text").alias("text")), model)
    return without(rows, found.filter(~(told & wanted)).select(F.col("row.uid").alias("id")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs).filter("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest doc_id, null last, and of those the smallest number."""
    rows = numbered(docs)
    near = near_components(rows.select("uid", F.col("row.text").alias("text")), "uid")
    named = cut(near.join(rows.select(F.col("uid").alias("id"), F.col("row.doc_id").alias("doc_id")), "id"), "named")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "id")).alias("first"))
    return without(rows, named.join(first, "component_id").filter(F.col("id") != F.col("first.id")).select("id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = numbered(docs)
    found = leaks(rows.select("uid", F.col("row.text").alias("text")), table(spark, sf_dir, "benchmark"), id_col="uid")
    return without(rows, found.select(F.col("doc_id").alias("id")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
