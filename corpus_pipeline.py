"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

Every stage takes any rows (nulls in any column, repeated rows, an empty table) and keeps further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrec.llm import minhash, mixing, packing, quality, substrings
from lumenrec.llm.common import read, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, frequent lines of the others too. Null and empty texts are rejected, as having no words; copies of a text are judged alike."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id; texts without words all stay, and rows without doc_id are told apart by their words."""
    return minhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words or more that stand elsewhere too are cut, in very long texts as well; a document with no word left goes, one without words stays."""
    return substrings.drop_repeated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each time that a document is taken; texts without words are never taken, the null source is one source."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids and their places in sequences; a null or empty text is its closing id, a repeated row is packed again."""
    pieces = packing.pieces(docs)
    return packing.place(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Packing cannot be expressed in SQL. tests/llm hold the other stages against SQL on their own input, and packing against its invariants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
