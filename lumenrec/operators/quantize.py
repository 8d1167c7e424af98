"""Vector quantizers that give items their semantic ids: residual k-means, product and rotated product codes, and what is measured on codes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenrec.functions.staging import Scratch, stage

from .embeddings import l2_norm
from .linear import added, mapped, matrices, moments, summed


def _nearest(x: np.ndarray, centroids: np.ndarray, cosine: bool) -> np.ndarray:
    if cosine:
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        return (-(unit(x) @ unit(centroids).T)).argmin(axis=1)
    return ((x**2).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(axis=1)).argmin(axis=1)


def _residual_codes(x: np.ndarray, centroids: np.ndarray, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all levels and what is left."""
    codes = []
    for level in centroids:
        c = _nearest(x, level, cosine)
        x = x - level[c]
        codes.append(c)
    return (np.stack(codes, axis=1) if codes else np.zeros((len(x), 0), dtype=np.int64)), x


class Scale(NamedTuple):
    """Moments that are kept with a codebook whose vectors are scaled to mean 0 and deviation 1 before the first level."""

    mean: np.ndarray
    std: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.std


def fit_scale(vectors: DataFrame) -> Scale:
    """Means and deviations (of a sample, 1e-6 at least) of all dimensions over all rows, in one pass."""
    mean, covariance, n = moments(vectors, np.array(vectors.select("embedding").first()[0], dtype=float))
    return Scale(mean, np.maximum(np.sqrt(np.maximum(np.diag(covariance), 0) * n / max(n - 1, 1)), 1e-6))


def encode_residual(vectors: DataFrame, centroids: np.ndarray, cosine: bool = False, scale: Scale | None = None) -> DataFrame:
    """item_id, codes: level by level the nearest centroid (the first of equals), then on with the residual; with a scale, of scaled vectors."""
    schema = pa.schema([("item_id", pa.int64()), ("codes", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in matrices(batches):
            codes = _residual_codes(scale.of(x) if scale else x, centroids, cosine)[0].astype(np.int32)
            yield pa.record_batch([ids, pa.FixedSizeListArray.from_arrays(codes.ravel(), codes.shape[1]).cast(pa.list_(pa.int32()))], schema=schema)

    return vectors.select("item_id", "embedding").mapInArrow(run, "item_id long, codes array<int>")


def _sums(vectors: DataFrame, fixed: np.ndarray, now: np.ndarray, cosine: bool, slices: int = 1) -> dict:
    """{(part, code): (sum of residuals, count)}: each task sends a row a code, which are summed before the driver sees them."""
    schema = pa.schema([("part", pa.int32()), ("code", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(now.shape), np.zeros(now.shape[:2], dtype=np.int64)
        for _, x in matrices(batches):
            x = _residual_codes(x, fixed, cosine)[1]
            for m, part in enumerate(np.split(x, slices, axis=1)):
                c = _nearest(part, now[m], cosine)
                np.add.at(total[m], c, part)
                np.add.at(count[m], c, 1)
        m, c = np.nonzero(count)
        yield pa.record_batch([pa.array(m, pa.int32()), pa.array(c, pa.int32()), pa.array(count[m, c]), pa.array(list(total[m, c]), pa.list_(pa.float64()))], schema=schema)

    rows = vectors.select("item_id", "embedding").mapInArrow(run, "part int, code int, n long, total array<double>")
    return {(r["part"], r["code"]): (np.array(r["total"]), r["n"]) for r in added(rows, "part", "code").collect()}


def _seeds(sample: np.ndarray, k: int, seed: int, cosine: bool) -> np.ndarray:
    """k-means++ on the sample."""
    rng = np.random.default_rng(seed)
    chosen = [sample[rng.integers(len(sample))]]
    near = ((sample - chosen[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = near.sum()
        pick = rng.choice(len(sample), p=near / total) if total > 0 else rng.integers(len(sample))
        chosen.append(sample[pick])
        near = np.minimum(near, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def smallest_hashes(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    """The n rows with the smallest seeded hashes of their item, the same for every partitioning; all rows if there are no more.

    A histogram of the hashes' leading bits gives the bucket in which the n-th lies; only its rows are sorted, and a filter over all tasks does the rest.
    """
    rows = vectors.withColumn("_hash", F.xxhash64(F.lit(seed), "item_id"))
    counts = rows.groupBy(F.shiftright("_hash", 48).alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()  # 65,536 rows at most
    left = n
    for r in counts:
        if r["n"] >= left:
            break
        left -= r["n"]
    else:
        return vectors
    last = rows.where(F.shiftright("_hash", 48) == r["b"]).select("_hash", "item_id").orderBy("_hash", "item_id").limit(left).agg(F.max(F.struct("_hash", "item_id"))).first()[0]
    kept = rows.where((F.col("_hash") < last["_hash"]) | ((F.col("_hash") == last["_hash"]) & (F.col("item_id") <= last["item_id"])))
    return kept.select(*vectors.columns)


def _sample(vectors: DataFrame, n: int, seed: int) -> np.ndarray:
    """At most n rows, those with the smallest hashes: the same for every partitioning."""
    rows = vectors.orderBy(F.xxhash64(F.lit(seed), "item_id"), "item_id").limit(n).select("embedding").collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


def _training(vectors: DataFrame, sample: int, seed: int) -> DataFrame:
    """The rows to train on: all, or so many, written once over many partitions."""
    return stage(smallest_hashes(vectors.select("item_id", "embedding"), sample, seed), "training") if vectors.count() > sample else vectors


def _lloyd(vectors: DataFrame, fixed: np.ndarray, now: np.ndarray, cosine: bool, iterations: int, sample: np.ndarray, seed: int, slices: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed + 1)
    for _ in range(iterations):
        sums = _sums(vectors, fixed, now, cosine, slices)
        now = now.copy()
        for m in range(now.shape[0]):
            for c in range(now.shape[1]):
                total, n = sums.get((m, c), (None, 0))
                now[m, c] = total / n if n else sample[m][rng.integers(len(sample[m]))]
    return now


def fit_residual_kmeans(vectors: DataFrame, levels: int, k: int, iterations: int = 5, cosine: bool = False, sample: int = 4096, seed: int = 42, start: np.ndarray | None = None, scale: Scale | None = None) -> np.ndarray:
    """Centroids [level, code, dim], level by level by full Lloyd iterations; plain means also for cosine assignment; empty clusters start anew from the sample. With a scale, centroids of scaled vectors."""
    if scale:
        vectors = mapped(vectors, scale.of)
    left, none, books = _sample(vectors, sample, seed), np.zeros((0, k, 0)), []
    scratch = Scratch(vectors.sparkSession, "residuals")
    for level in range(levels):
        if books:  # what the last level leaves is written once; iterations then read it and encode one level
            vectors = scratch.stage(residuals(vectors, books[-1], cosine), f"level{level}")
            scratch.drop(f"level{level - 1}")
            left = _residual_codes(left, books[-1], cosine)[1]
        first = start[level] if start is not None else _seeds(left, k, seed + level, cosine)
        books.append(_lloyd(vectors, none, first[None], cosine, iterations, left[None], seed + level))
    scratch.drop(f"level{levels - 1}")
    return np.concatenate(books)


def fit_pq(vectors: DataFrame, parts: int, k: int, iterations: int = 5, sample: int = 256_000, seed: int = 42, start: np.ndarray | None = None) -> np.ndarray:
    """Centroids [part, code, dim / parts]: k-means in every sub-space, all in one pass an iteration; the training rows are a bounded sample; start gives first centroids."""
    k = 1 << max(0, int(np.ceil(np.log2(k))))
    if k > 65536:
        raise ValueError("at most 65536 codes")
    rows = _sample(vectors, min(sample, 4096), seed)
    if rows.shape[1] % parts:
        raise ValueError("parts must divide the dimension")
    training = _training(vectors, sample, seed)
    split = np.split(rows, parts, axis=1)
    now = start if start is not None else np.stack([_seeds(x, k, seed + m, False) for m, x in enumerate(split)])
    return _lloyd(training, np.zeros((0, 1, rows.shape[1])), now, False, iterations, split, seed, parts)


def _pq_words(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Each row's codewords side by side."""
    return np.concatenate([c[_nearest(p, c, False)] for p, c in zip(np.split(x, len(books), axis=1), books)], axis=1)


def encode_pq(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """item_id, codes: the nearest centroid of each part."""
    schema = pa.schema([("item_id", pa.int64()), ("codes", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in matrices(batches):
            codes = np.stack([_nearest(p, c, False) for p, c in zip(np.split(x, len(centroids), axis=1), centroids)], axis=1).astype(np.int32)
            yield pa.record_batch([ids, pa.FixedSizeListArray.from_arrays(codes.ravel(), codes.shape[1]).cast(pa.list_(pa.int32()))], schema=schema)

    return vectors.select("item_id", "embedding").mapInArrow(run, "item_id long, codes array<int>")


def residuals(vectors: DataFrame, centroids: np.ndarray, cosine: bool = False) -> DataFrame:
    """item_id, embedding: what the given levels leave of each vector."""
    return mapped(vectors, lambda x: _residual_codes(x, centroids, cosine)[1])


def apply_rotation(vectors: DataFrame, rotation: np.ndarray) -> DataFrame:
    return mapped(vectors, lambda x: x @ rotation)


def fit_opq(vectors: DataFrame, parts: int, k: int, rounds: int = 3, iterations: int = 3, seed: int = 42, sample: int = 256_000) -> tuple[np.ndarray, np.ndarray]:
    """A rotation and product centroids, in turn: codes for the rotated vectors, then the rotation that brings vectors closest to their codewords. The training rows are the bounded sample of fit_pq, rotated once a round."""
    if k & (k - 1):
        raise ValueError("the codebook size must be a power of two")
    training = _training(vectors, sample, seed)
    dim = training.select(F.size("embedding")).first()[0]
    rows, rotation = _sample(training, 4096, seed), np.eye(dim)
    centroids = fit_pq(training, parts, k, iterations, sample, seed)
    scratch = Scratch(vectors.sparkSession, "rotated")
    for _ in range(rounds):
        now, books = rotation, centroids
        m, _ = summed(training, lambda x, now=now, books=books: x.T @ _pq_words(x @ now, books))  # dim rows of dim numbers
        u, _, vt = np.linalg.svd(m)
        rotation = u @ vt
        turned = scratch.stage(apply_rotation(training, rotation), "turned")
        centroids = _lloyd(turned, np.zeros((0, 1, dim)), centroids, False, iterations, np.split(rows @ rotation, parts, axis=1), seed, parts)
        scratch.drop("turned")
    return rotation, centroids


def centroid_table(spark, centroids: np.ndarray) -> DataFrame:
    rows = [(level, code, [float(x) for x in v]) for level, book in enumerate(centroids) for code, v in enumerate(book)]
    return spark.createDataFrame(rows, "level int, code int, centroid array<double>")


def reconstruct(codebook: DataFrame, centroids: DataFrame, scale: Scale | None = None) -> DataFrame:
    """item_id, embedding: the sum of the codewords of all levels; with a scale, in the vectors' own units."""
    each = codebook.select("item_id", F.posexplode("codes").alias("level", "code")).join(centroids, ["level", "code"])
    parts = each.select("item_id", "level", F.posexplode("centroid").alias("dim", "x")).groupBy("item_id", "dim").agg(F.sum("x").alias("x"))
    found = parts.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda v: v["x"]).alias("embedding"))
    return mapped(found, lambda x: x * scale.std + scale.mean) if scale else found


def quantization_loss(vectors: DataFrame, codebook: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row: mse and l1 of the reconstruction, commitment (the mean over levels of the mean square distance to the partial sums)."""
    books = centroids.groupBy("level", "code").agg(F.first("centroid").alias("centroid"))
    each = codebook.select("item_id", F.posexplode("codes").alias("level", "code")).join(books, ["level", "code"])
    dims = each.select("item_id", "level", F.posexplode("centroid").alias("dim", "c"))
    sums = dims.withColumn("partial", F.sum("c").over(W.partitionBy("item_id", "dim").orderBy("level").rowsBetween(W.unboundedPreceding, 0)))
    x = vectors.select("item_id", F.posexplode("embedding").alias("dim", "x"))
    d = sums.join(x, ["item_id", "dim"]).withColumns({"e": F.col("x").cast("double") - F.col("partial"), "top": F.max("level").over(W.partitionBy("item_id", "dim"))})
    last = F.col("level") == F.col("top")
    return d.agg(F.avg(F.when(last, F.col("e") * F.col("e"))).alias("mse"), F.avg(F.when(last, F.abs("e"))).alias("l1"), F.avg(F.col("e") * F.col("e")).alias("commitment"))


def dedup_digit(codebook: DataFrame, vocab_size: int) -> DataFrame:
    """codebook with digit: items with equal codes numbered by id from 0, modulo the vocabulary where they are more."""
    order = W.partitionBy("codes").orderBy("item_id")
    return codebook.withColumn("digit", ((F.row_number().over(order) - 1) % vocab_size).cast("int"))


def dedup_report(codebook: DataFrame, vocab_size: int) -> DataFrame:
    counts = codebook.groupBy("codes").agg(F.count("*").alias("n"))
    return counts.agg(F.max("n").alias("max_duplicates"), F.count_if(F.col("n") > vocab_size).alias("overflow_groups"))


def code_usage(codebook: DataFrame) -> DataFrame:
    """level, code, n."""
    return codebook.select(F.posexplode("codes").alias("level", "code")).groupBy("level", "code").agg(F.count("*").alias("n"))


def code_report(usage: DataFrame, codebook_size: int) -> DataFrame:
    """level, utilization (share of codes used), entropy_gap ((ln K - H) / ln K)."""
    p = usage.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("level")))
    h = F.sum(-F.col("p") * F.ln(F.col("p") + 1e-5))
    k = F.lit(float(np.log(codebook_size)))
    return p.groupBy("level").agg((F.count("*") / F.lit(codebook_size)).alias("utilization"), ((k - h) / k).alias("entropy_gap"))


def prefix_cosine_cohesion(vectors: DataFrame, codebook: DataFrame) -> DataFrame:
    """prefix_len, prefixes, cohesion: the mean over prefixes of two items or more of their mean pairwise cosine; exact, from vector sums, without pairs."""
    norm = F.greatest(l2_norm(F.col("embedding")), F.lit(1e-12))
    rows = vectors.join(codebook, "item_id").withColumn("norm", norm)
    prefixes = F.transform(F.sequence(F.lit(1), F.size("codes")), lambda n: F.slice("codes", F.lit(1), n))
    each = rows.select("embedding", "norm", F.explode(prefixes).alias("prefix"))
    dims = each.select("prefix", F.posexplode("embedding").alias("dim", "x"), "norm").withColumn("u", F.col("x").cast("double") / F.col("norm"))
    sums = dims.groupBy("prefix", "dim").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q"), F.count("*").alias("n"))
    by = sums.groupBy("prefix").agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"), F.max("n").alias("n")).where("n > 1")
    cosine: Column = (F.col("s2") - F.col("q")) / (F.col("n") * (F.col("n") - 1))
    return by.groupBy(F.size("prefix").alias("prefix_len")).agg(F.count("*").alias("prefixes"), F.avg(cosine).alias("cohesion"))
