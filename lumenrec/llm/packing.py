"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document's ids are cut into full sequences, at most one half and a shorter rest. The histogram of lengths (in
classes of `unit` ids, so its size depends on the capacity alone) is the only thing that the driver
sees: a linear program over patterns is solved by column generation, where a knapsack dynamic
program prices new patterns; the solution is rounded down and what is left is packed best-fit.
Pieces then take their places by rank within their class, and offsets are running sums within each
sequence.

`tiktoken` computes the ids: over the same vocabulary it gives what `tokenizers` gives (the tests
hold one against the other), several times as fast.

Defined cases: a null or empty text is the single closing id; repeated rows are packed each for
itself; a null doc_id is an id like others; an empty table gives an empty table; columns beside
doc_id and text are not read by `pieces` and kept by `place`, whatever their names. A very long text is many
pieces; pieces of equal length are ranked by doc_id and start, equal ones are interchangeable.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import hidden, small_batches, stage

CAPACITY, UNIT, END = 1024, 8, 0
#: The linear program ends where its bound proves it this close to the optimum.
GAP = 2e-3
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


@functools.lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str, special: tuple[tuple[str, int], ...]):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


def default_tokenizer() -> tuple[str, str, tuple[tuple[str, int], ...]]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),)


def spans(n: int, capacity: int) -> list[tuple[int, int]]:
    """Full sequences, then half of one if the rest is longer: pieces of at most half a sequence pack almost without padding."""
    ends = list(range(capacity, n + 1, capacity))
    rest = n - n % capacity
    if n - rest > capacity // 2:
        ends.append(rest + capacity // 2)
    if not ends or ends[-1] < n:
        ends.append(n)
    return list(zip([0, *ends], ends))


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer=None) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit) of every piece."""
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*tokenizer).encode_to_numpy
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or "", allowed_special="all"), END).astype("<u4")
                for start, end in spans(len(ids), capacity):
                    piece = ids[start:end]
                    for c, v in zip(out, (doc_id, start, len(piece), len(ids), piece.tobytes())):
                        out[c].append(v)
                    held += piece.nbytes
                if held > 16 << 20:
                    yield pa.RecordBatch.from_pydict(out, schema)
                    out, held = {c: [] for c in out}, 0
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack over items in order of size: how often each is taken in the most valuable pattern."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        if n := fits[c]:
            worth = values[:n] + best[c - sizes[:n]]
            k = worth.argmax()
            best[c], took[c] = worth[k], k
        if best[c - 1] >= best[c]:
            best[c], took[c] = best[c - 1], -1
    pattern, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return pattern


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class: count}, times) that use up the demand exactly, close to the fewest sequences."""
    m = len(sizes)
    if not m:
        return []
    columns = np.diag(capacity // sizes).astype(float)
    inverse, x = np.diag(1.0 / np.diag(columns)), demand / np.diag(columns)
    least = demand @ sizes / capacity
    for step in range(40 * m):
        duals = inverse.sum(axis=0)
        pattern = best_pattern(np.maximum(duals, 0), sizes, capacity)
        pattern[duals <= 0] = 0
        # the optimum is at least the sum over the new pattern's value, and at least what the lengths add up to
        if duals @ pattern <= 1 + gap or x.sum() <= (1 + gap) * least:
            break
        u = inverse @ pattern
        rising = np.flatnonzero(u > 1e-9)
        ratios = x[rising] / u[rising]
        out = rising[ratios.argmin()]
        t = x[out] / u[out]
        x = np.maximum(x - t * u, 0)
        x[out] = t
        inverse[out] /= u[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(u[others], inverse[out])
        columns[:, out] = pattern
        if step % 100 == 99:  # rounding errors don't add up
            inverse = np.linalg.inv(columns)
            x = np.maximum(inverse @ demand, 0)
    left, plan = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        pattern = columns[:, j].astype(np.int64)
        used = pattern > 0
        times = min(int(x[j] + 1e-9), int((left[used] // pattern[used]).min()))
        if times > 0:
            left -= times * pattern
            plan.append(({int(i): int(pattern[i]) for i in np.flatnonzero(used)}, times))
    return plan + _best_fit(sizes, left, capacity)


def _best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """The rest after rounding: the largest item that still fits, repeated patterns at once."""
    plan = []
    while left.any():
        room, pattern = capacity, {}
        for i in np.argsort(-sizes):
            if n := int(min(left[i], room // sizes[i])):
                pattern[int(i)] = n
                room -= n * sizes[i]
        times = min(int(left[i] // n) for i, n in pattern.items())
        for i, n in pattern.items():
            left[i] -= times * n
        plan.append((pattern, times))
    return plan


def place(cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, salt_rows: int = 20_000) -> DataFrame:
    """The pieces (doc_id, start, length and whatever else), with sequence_id and offset, which replace columns of these names."""
    spark = cut.sparkSession
    inner, columns = hidden(cut.drop("sequence_id", "offset"))
    doc_id, start, length = (F.col(columns[c]) for c in ("doc_id", "start", "length"))
    with small_batches(spark):
        inner = stage(inner.withColumn("_class", F.ceil(length / unit).cast("int")), "pieces")
    # ranks within a class: salted by hash, so that a hot length is many small sorts
    salts = max(1, -(-inner.count() // salt_rows))
    salted = inner.withColumn("_salt", F.pmod(F.xxhash64(doc_id, start), F.lit(salts)).cast("int"))
    counts = stage(salted.groupBy("_class", "_salt").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["_class"]: r["n"] for r in counts.groupBy("_class").agg(F.sum("n").alias("n")).collect()}  # at most capacity / unit rows
    classes = sorted(histogram)
    plan = solve(np.array(classes, dtype=np.int64), np.array([histogram[c] for c in classes], dtype=float), capacity // unit)
    rows, base, used = [], 0, dict.fromkeys(classes, 0)
    for pattern, times in plan:
        for i, n in pattern.items():
            c = classes[i]
            rows.append((c, used[c], used[c] + n * times, n, base))
            used[c] += n * times
        base += times
    assert used == histogram
    places = spark.createDataFrame(rows, "_c int, _from long, _to long, _n long, _base long")  # bounded by the histogram, not by the input
    before = W.partitionBy("_class").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_class", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = W.partitionBy("_class", "_salt").orderBy(doc_id, start)
    ranked = salted.join(starts, ["_class", "_salt"]).withColumn("_rank", F.col("_first") + F.row_number().over(within) - 1)
    placed = ranked.join(F.broadcast(places), (F.col("_class") == F.col("_c")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    at = F.col("_rank") - F.col("_from")
    placed = placed.withColumns({"_sequence": F.col("_base") + F.floor(at / F.col("_n")).cast("long"), "_slot": at % F.col("_n")})
    before = W.partitionBy("_sequence").orderBy("_class", "_slot").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("_offset", F.coalesce(F.sum(length).over(before), F.lit(0)))
    return placed.select(*[F.col(c).alias(name) for name, c in columns.items()], F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset"))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer=None) -> DataFrame:
    """Every piece with its ids and its place."""
    return place(pieces(docs, capacity, tokenizer), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (concatenated), length: a group is at most one sequence long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("length"))
    return grouped.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), "length")
