"""Helpers that the operators of this subpackage share: staged tables, row keys, word patterns."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrec.functions.staging import Scratch, new_path, shared_dir, stage  # noqa: F401 - used through this module

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 400):
    """Jobs that run inside hand Python so many rows at a time: whole texts and sets are large rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def hidden(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns renamed to in0, in1, ..., and the new name of each: names used inside cannot clash with any of df's."""
    names = {c: f"in{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def with_columns(df: DataFrame, **defaults: str) -> DataFrame:
    """df with each named column; a missing one is added as null of the given type."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in defaults.items() if c not in df.columns})


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; the fast built-in serves pure ASCII texts."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))
