"""Embedding tables: encoding text, alignment with ids, PCA, fusion, collaborative vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrec.functions.staging import delete, new_path, stage, written

from .interactions import dense_ids
from .linear import in_blocks, mapped, moments, principal_components, symmetric_factors, tile_sums, tiled
from .ranges import with_previous

MISSING = "N/A"


def hashed_terms(texts: list[str], dim: int = 64) -> np.ndarray:
    """The default encoder: signed word counts by hash, of unit length."""
    import xxhash

    out = np.zeros((len(texts), dim), dtype=np.float32)
    for row, text in zip(out, texts):
        for w in text.split():
            h = xxhash.xxh64_intdigest(w.lower())
            row[h % dim] += 1 if h >> 63 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_batches(texts: DataFrame, dim: int, encoder: Callable[[list[str]], np.ndarray] = hashed_terms, batch: int = 256) -> DataFrame:
    """item_id, embedding: any batch encoder over (item_id, text); blank texts read N/A, a batch that fails is zeros."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            clean = [" ".join((t or "").split()) or MISSING for t in frame["text"]]
            for i in range(0, len(clean), batch):
                part = clean[i : i + batch]
                try:
                    vectors = np.asarray(encoder(part), dtype=np.float32).reshape(len(part), dim)
                except Exception:  # noqa: BLE001 - a batch that the encoder rejects is zeros by definition
                    vectors = np.zeros((len(part), dim), dtype=np.float32)
                yield pd.DataFrame({"item_id": frame["item_id"].iloc[i : i + batch].to_numpy(), "embedding": list(vectors)})

    return texts.select("item_id", "text").mapInPandas(run, "item_id long, embedding array<float>")


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))


def normalized(v: Column) -> Column:
    n = F.greatest(l2_norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / n)


def align_embeddings(ids: DataFrame, vectors: DataFrame, dim: int, unit: bool = False, order: str | None = None) -> DataFrame:
    """One vector for every id: zeros where none is given, others dropped; of several the last by the column order, or the greatest, number by number."""
    last = F.max_by("embedding", order) if order else F.max("embedding")
    one = vectors.groupBy("item_id").agg(last.alias("embedding"))
    rows = ids.select("item_id").distinct().join(one, "item_id", "left")
    rows = rows.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), dim)))
    return rows.withColumn("embedding", normalized(F.col("embedding"))) if unit else rows


def standardize_pca(vectors: DataFrame, pca_dim: int) -> tuple[DataFrame, float]:
    """(item_id, embedding) in pca_dim dimensions after z-scores, and the variance kept; the input where pca_dim isn't between 0 and its width, or where there is nothing to fit (vectors of several widths, fewer than two).

    Moments are sums over all rows in one pass; a constant dimension stays zero; each component's largest loading is above zero.
    """
    widths = [r[0] for r in vectors.select(F.size("embedding")).distinct().limit(2).collect()]
    if len(widths) != 1 or not 0 < pca_dim < widths[0] or vectors.limit(2).count() < 2:
        return vectors, 1.0
    mean, covariance, _ = moments(vectors, np.array(vectors.select("embedding").first()[0], dtype=float))
    std = np.sqrt(np.maximum(np.diag(covariance), 0))
    scale = np.where(std > 1e-12, std, 1.0)
    components, kept = principal_components(covariance / np.outer(scale, scale), pca_dim)
    return mapped(vectors, lambda x: (x - mean) / scale @ components), kept


def fuse_modalities(text: DataFrame, image: DataFrame, text_weight: float = 0.5, image_weight: float = 0.5, concat: bool = False) -> DataFrame:
    """Row by row a weighted sum of unit vectors, or both side by side; ids that one table lacks are an error."""
    rows = text.toDF("item_id", "t").join(image.toDF("item_id", "i"), "item_id", "full")
    missing = F.raise_error(F.concat(F.lit("no vector of one kind for item "), F.col("item_id").cast("string"))).cast("array<double>")
    t, i = normalized(F.col("t")), normalized(F.col("i"))
    fused = F.concat(t, i) if concat else F.zip_with(t, i, lambda x, y: text_weight * x + image_weight * y)
    return rows.select("item_id", F.when(F.col("t").isNull() | F.col("i").isNull(), missing).otherwise(fused).alias("embedding"))


def item_cooccurrence(rows: DataFrame, window: int = 5) -> DataFrame:
    """item_id, other, n: how often two different items stand at most window places apart in a user's order, in both directions, from rows of interactions.in_order()."""
    near = with_previous(rows, "user", "item", window, "near").select("item", F.explode("near").alias("other")).where("item <> other")
    counts = near.select(F.least("item", "other").alias("a"), F.greatest("item", "other").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    return counts.select(F.inline(F.array(F.struct(F.col("a").alias("item_id"), F.col("b").alias("other"), "n"), F.struct(F.col("b").alias("item_id"), F.col("a").alias("other"), "n"))))


def cf_item_vectors(rows: DataFrame, dim: int = 32, window: int = 5, iterations: int = 8, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """item_id, embedding, and the eigenvalues: items by how users' histories bring them together, from rows of interactions.in_order().

    The counts of item_cooccurrence() over the roots of both items' totals make a symmetric matrix with values from -1 to 1;
    vectors are the rows of the eigenvectors of its greatest values, each times the root of its value (zero where that is
    below), so that products of vectors approximate the matrix. The iteration runs on the matrix plus one on the diagonal,
    which makes the greatest values the largest. Items are rows of a table throughout; items near no other have no vector.
    """
    spark = rows.sparkSession
    ids = dense_ids(rows.where("item IS NOT NULL"), "item")
    path, numbers, ones = new_path(spark, "tiles"), new_path(spark, "numbered-rows"), new_path(spark, "ones")
    # rows without an item keep their places
    known = written(rows.join(ids, "item", "left").select("user", "part", "here", "pos", "n", "idx"), numbers)
    tiles = tiled(with_previous(known, "user", "idx", window, "near").where("idx IS NOT NULL"), path)
    delete(spark, numbers)
    # a vector of ones gives each item's total
    in_blocks(ids.select(F.col("item").alias("item_id"), "idx", F.lit(1.0).alias("scale"), F.array(F.lit(1.0)).alias("embedding")), ones)
    totals = tile_sums(tiles, ones, np.ones((1, 1))).groupBy("idx").agg(F.sum(F.get("embedding", F.lit(0))).alias("d"))
    items = stage(totals.join(ids, "idx").select(F.col("item").cast("long").alias("item_id"), "idx", (1 / F.sqrt("d")).alias("scale")), "factor-items")
    delete(spark, ones)
    if items.isEmpty():
        return rows.select(F.col("item").cast("long").alias("item_id"), F.array().cast("array<double>").alias("embedding")).limit(0), np.zeros(0)
    vectors, values = symmetric_factors(tiles, items, dim, iterations, seed=seed)
    delete(spark, path)
    return mapped(vectors, lambda x: x * np.sqrt(np.maximum(values - 1, 0))), values - 1


def train_validation_split(vectors: DataFrame, share: float = 0.05, seed: int = 42) -> DataFrame:
    """vectors with is_validation: by a hash of the id, so reruns and partitionings agree."""
    if share <= 0:
        return vectors.withColumn("is_validation", F.lit(False))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("item_id").cast("string")))
    return vectors.withColumn("is_validation", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1_000_000 < share * 1_000_000)
