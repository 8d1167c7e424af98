"""Writers of splits, id maps, features, sequences and codebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(path: str, **splits: DataFrame) -> None:
    """One folder of JSON lines {user, history, target} a split, users in order within files."""
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    for name, df in splits.items():
        rows = df.select(F.col("user").cast("long").alias("user"), text("history").alias("history"), F.col("target").cast("string").alias("target"))
        rows.repartitionByRange("user").sortWithinPartitions("user").withColumn("user", F.col("user").cast("string")).write.json(f"{path}/{name}")


def write_id_map(ids: DataFrame, path: str, key: str = "item") -> None:
    """original, tab, index; ordered by index."""
    ids.select(key, "idx").orderBy("idx").write.option("sep", "\t").csv(path)


def write_item_features(features: DataFrame, path: str) -> None:
    features.write.json(path)


def write_sequences(sequences: DataFrame, path: str) -> None:
    sequences.write.parquet(path)


def code_text():
    """<L0_3> <L1_0> ... from codes."""
    return F.array_join(F.transform("codes", lambda v, l: F.concat(F.lit("<L"), l, F.lit("_"), v, F.lit(">"))), " ")


def write_codebook(codebook: DataFrame, path: str) -> None:
    """codes as Parquet, and their text twin as JSON lines."""
    codebook.select("item_id", "codes").write.parquet(f"{path}/codes")
    codebook.select("item_id", code_text().alias("text")).write.json(f"{path}/text")
