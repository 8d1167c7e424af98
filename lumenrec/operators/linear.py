"""Sums of matrices over tables of vectors, and what follows from them: moments, principal components, factors of a sparse matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrec.functions.staging import delete, new_path, shuffles_dropped, written


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The ids and the rows of (item_id, embedding) batches as a matrix."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def added(rows: DataFrame, *by: str) -> DataFrame:
    """by, n, total: the sums of the tasks' counts and vectors, added number by number with map-side combining; a row a key, whatever the input."""
    each = rows.select(*by, "n", F.posexplode("total").alias("dim", "x")).groupBy(*by, "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return each.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda v: v["x"]).alias("total"))


def summed(vectors: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, int]:
    """The sum over all (item_id, embedding) rows of a matrix, which `of` gives for the rows of a batch, and the number of rows.

    Each task sends its sum, a row of numbers a row of the matrix; only the whole sum reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for _, x in matrices(batches):
            part = of(x)
            total, n = part if total is None else total + part, n + len(x)
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(np.full(len(total), n)), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "n", "total"])

    with shuffles_dropped(vectors.sparkSession):
        found = added(vectors.select("item_id", "embedding").mapInArrow(run, "row int, n long, total array<double>"), "row").collect()
    found.sort(key=lambda r: r["row"])
    return np.array([r["total"] for r in found]), found[0]["n"] if found else 0


def mapped(vectors: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """item_id, embedding: every vector through a function of matrices."""
    schema = pa.schema([("item_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in matrices(batches):
            y = of(x)
            yield pa.record_batch([ids, pa.FixedSizeListArray.from_arrays(y.ravel(), y.shape[1]).cast(pa.list_(pa.float64()))], schema=schema)

    return vectors.select("item_id", "embedding").mapInArrow(run, "item_id long, embedding array<double>")


def moments(vectors: DataFrame, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, covariances (by the number of rows) and the number of rows, in one pass over sums about shift, which is to lie near the means."""

    def of(x: np.ndarray) -> np.ndarray:
        d = x - shift
        return np.vstack([d.sum(axis=0), d.T @ d])

    total, n = summed(vectors, of)
    mean = total[0] / n
    return shift + mean, total[1:] / n - np.outer(mean, mean), n


def with_fixed_signs(columns: np.ndarray) -> np.ndarray:
    """Each column with its largest entry (by size, the first of equals) above zero."""
    lead = np.abs(columns).argmax(axis=0)
    signs = np.sign(columns[lead, np.arange(columns.shape[1])])
    return columns * np.where(signs == 0, 1.0, signs)


def principal_components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """The k leading eigenvectors as columns, with fixed signs, and the share of the variance that they keep."""
    values, columns = np.linalg.eigh(covariance)
    return with_fixed_signs(columns[:, ::-1][:, :k]), float(values[::-1][:k].sum() / values.sum()) if values.sum() > 0 else 1.0


#: Items of a block; places in it take 16 bits at most.
BLOCK = 1 << 15
#: Entries of a row of tiles, pairs held before they are packed, blocks of a stripe that a task writes, blocks and rows of tiles held in a task.
_ENTRIES, _PAIRS, _GROUP, _BLOCKS, _ROWS = 4096, 1 << 20, 16, 8, 256


def _packed(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """stripe, block, size, entries of the pairs in both directions; equal ones are counted."""
    x, y = np.concatenate([a, b]), np.concatenate([b, a])
    places = (x % BLOCK) << 16 | y % BLOCK
    keys, counts = np.unique((x // BLOCK) << 47 | (y // BLOCK) << 32 | places, return_counts=True)  # 15 bits a block: 2**30 items
    tile = keys >> 32
    first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    for start, end in zip(first, np.r_[first[1:], len(keys)]):
        for i in range(start, end, _ENTRIES):
            part = keys[i : min(i + _ENTRIES, end)]
            rows = np.diff((part >> 16 & 65535).astype(np.uint16), prepend=np.uint16(0))
            raw = rows.tobytes() + (part & 65535).astype(np.uint16).tobytes() + counts[i : i + len(part)].astype(np.uint32).tobytes()
            yield int(tile[start] >> 15), int(tile[start] & 32767), len(part), pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(size: int, entries: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(entries, decompressed_size=8 * size, codec="zstd", asbytes=True)
    rows, columns = np.frombuffer(raw, np.uint16, 2 * size).reshape(2, size)
    return np.cumsum(rows, dtype=np.uint16), columns, np.frombuffer(raw, np.uint32, size, 4 * size)


def tiled(near: DataFrame, path: str) -> DataFrame:
    """stripe, block, size, entries: how often two of the numbers in (idx, near) rows stand in one row, both ways, but not a number with itself; written to path.

    An entry is two places of 16 bits in blocks of numbers and a count; rows hold a few thousand of one pair of blocks,
    those of a stripe of numbers one after the other. An entry may stand in several rows, which add up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            columns = list(zip(*_packed(*map(np.concatenate, zip(*held)))))
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["stripe", "block", "size", "entries"])

        for batch in batches:
            lists = batch.column(1)
            a = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
            b = lists.flatten().to_numpy(zero_copy_only=False)
            held.append((a[a != b], b[a != b]))
            n += len(held[-1][0])
            if n >= _PAIRS:
                yield packed()
                held, n = [], 0
        if n:
            yield packed()

    rows = near.select("idx", "near").mapInArrow(run, "stripe int, block int, size int, entries binary")
    return written(rows.repartition("stripe", F.floor(F.col("block") / _GROUP)).sortWithinPartitions("stripe", "block"), path)


def in_blocks(vectors: DataFrame, path: str) -> DataFrame:
    """(item_id, idx, scale, embedding) with block and at, written to path in a folder a block."""
    rows = vectors.withColumns({"block": F.floor(F.col("idx") / BLOCK).cast("int"), "at": (F.col("idx") % BLOCK).cast("int")})
    with shuffles_dropped(vectors.sparkSession):
        rows.repartition("block").write.partitionBy("block").parquet(path)
    return vectors.sparkSession.read.schema(rows.schema).parquet(path)


def tile_sums(tiles: DataFrame, path: str, turn: np.ndarray) -> DataFrame:
    """idx, embedding: sums over the tiles' entries of count * both scales * the vector in path (of in_blocks()) times turn; a row a stripe's number for each task that met it.

    A task reads the blocks that its tiles name, one after the other, so that neither vectors nor sums are held whole or shuffled a row an entry.
    """
    width = turn.shape[1]
    schema = pa.schema([("idx", pa.int64()), ("embedding", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def of(block: int) -> tuple[np.ndarray, np.ndarray]:
            """The scales of a block, and its scaled vectors as columns."""
            if block not in blocks:
                if len(blocks) == _BLOCKS:
                    blocks.pop(next(iter(blocks)))
                found = pq.read_table(f"{root}/block={block}", filesystem=system, partitioning=None, columns=["at", "scale", "embedding"])
                at, scale, x = found["at"].to_numpy(), np.zeros(BLOCK), np.zeros((width, BLOCK))
                scale[at] = found["scale"].to_numpy()
                x[:, at] = (found["embedding"].combine_chunks().flatten().to_numpy().reshape(len(at), -1) @ turn).T * scale[at]
                blocks[block] = scale, x
            return blocks[block]

        def summed_up() -> pa.RecordBatch:
            at = np.flatnonzero(met)
            y = (total[:, at] * of(stripe)[0][at]).T
            return pa.record_batch([pa.array(at + stripe * BLOCK), pa.FixedSizeListArray.from_arrays(y.ravel(), width).cast(pa.list_(pa.float64()))], schema=schema)

        stripe = None
        for batch in batches:
            sizes, entries = batch.column(2).to_pylist(), batch.column(3)
            tile = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
            cuts = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]).any(axis=1)]) if len(tile) else []
            for start, end in zip(cuts, [*cuts[1:], len(tile)]):
                if tile[start, 0] != stripe:
                    if stripe is not None:
                        yield summed_up()
                    stripe, total, met = int(tile[start, 0]), np.zeros((width, BLOCK)), np.zeros(BLOCK, dtype=bool)
                x = of(int(tile[start, 1]))[1]
                for i in range(start, end, _ROWS):
                    rows, columns, counts = map(np.concatenate, zip(*[_unpacked(sizes[j], entries[j].as_buffer()) for j in range(i, min(i + _ROWS, end))]))
                    rows, columns = rows.astype(np.intp), columns.astype(np.intp)
                    counts = None if counts.max() == 1 else counts
                    met[rows] = True
                    for to, c in zip(total, x):
                        values = c[columns]
                        part = np.bincount(rows, values if counts is None else values * counts)
                        to[: len(part)] += part
        if stripe is not None:
            yield summed_up()

    return tiles.mapInArrow(run, "idx long, embedding array<double>")


def symmetric_factors(tiles: DataFrame, items: DataFrame, dim: int, iterations: int = 8, extra: int = 8, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """Vectors (item_id, embedding) of the dim largest eigenvalues by size of a symmetric sparse matrix, and these values; columns have length one and fixed signs in the first vectors by id.

    The matrix is that of the tiles times the scales of both items (item_id, idx, scale), plus one on the diagonal.
    Blocked subspace iteration: the block is a table of rows by item, multiplied tile by tile, brought to unit columns by
    the Cholesky factor of its Gram matrix, which alone reaches the driver, and written once a round, when the round's before is deleted.
    extra columns are iterated besides, so that the last ones converge as well.
    """
    spark, width = items.sparkSession, dim + extra

    def round_of(vectors: DataFrame) -> tuple[str, DataFrame, np.ndarray]:
        path = new_path(spark, "factors")
        x = in_blocks(vectors, path)
        return path, x, _to_unit_columns(x)

    def product(path: str, x: DataFrame, turn: np.ndarray) -> DataFrame:
        own = mapped(x.select(F.col("idx").alias("item_id"), "embedding"), lambda m: m @ turn).withColumnRenamed("item_id", "idx")
        each = tile_sums(tiles, path, turn).unionByName(own)
        sums = each.groupBy("idx").agg(*[F.sum(F.get("embedding", F.lit(k))).alias(f"x{k}") for k in range(width)])
        return sums.select("idx", F.array(*[f"x{k}" for k in range(width)]).alias("embedding")).join(items, "idx")

    draw = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "item_id") / F.lit(float(1 << 63))
    now = round_of(items.withColumn("embedding", F.array(*[draw(k) for k in range(width)])))
    for _ in range(iterations):
        before, now = now, round_of(product(*now))
        delete(spark, before[0])
    _, x, turn = now
    y = product(*now).select("idx", F.col("embedding").alias("y"))
    both = x.join(y, "idx").select("item_id", F.concat("embedding", "y").alias("embedding"))
    cross, _ = summed(both, lambda m: (m[:, :width] @ turn).T @ m[:, width:])
    values, axes = np.linalg.eigh((cross + cross.T) / 2)
    lead = np.argsort(-np.abs(values), kind="stable")[:dim]
    found = mapped(x, lambda m: m @ turn @ axes[:, lead])
    first = found.orderBy("item_id").limit(1).collect()
    signs = np.where(np.array(first[0]["embedding"]) < 0, -1.0, 1.0) if first else np.ones(dim)
    return mapped(found, lambda m: m * signs), values[lead]


def _to_unit_columns(block: DataFrame) -> np.ndarray:
    """The inverse of the root of the block's Gram matrix: the block times it has orthonormal columns over all rows."""
    gram, _ = summed(block, lambda x: x.T @ x)
    values, columns = np.linalg.eigh(gram)
    good = values > values.max() * 1e-14  # columns that others make up become small, not noise
    return columns @ np.diag(np.where(good, 1 / np.sqrt(np.where(good, values, 1.0)), 0.0)) @ columns.T
