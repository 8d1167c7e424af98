"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Every whole text gives STATISTICS numbers. They are standardised by moments over all documents and mapped to
cos(x W + b), whose products approximate a Gaussian kernel (Rahimi and Recht 2007). Tasks sum the normal equations of
their labelled rows; the sums are added number by number, so the driver sees features squared numbers and solves them.
Ridge scores of labelled rows that the fit didn't see are counted in BINS bins and made monotone (pool adjacent
violators), which gives a score between 0 and 1.

Rows are dealt by CRC-32 of the doc_id as text, modulo 4: 2 is held out, 3 calibrates, 0 and 1 are fitted on. Only the
labels' quality is learned; language, source and doc_id are not statistics.

Defined cases: a null text is empty, and empty texts get the score of their statistics (zeros); a null doc_id is not
held out and has no label; repeated labels of a doc_id are averaged, null ones ignored; repeated rows get equal scores;
very long texts are read whole, in batches of few rows; without labels every score is 0.5, without any to calibrate by
the ridge score is cut to [0, 1]; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage

STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "bangs", "stops", "other_punctuation", "not_ascii", "lone_symbols",
    "distinct_words", "top_word", "adjacent_repeats", "repeated_lines", "log_line_length",
)
FEATURES, RIDGE, BINS, HELD_OUT, CALIBRATE, THRESHOLD = 256, 1e-4, 512, 2, 3, 0.7
LOW, HIGH, CLIP = -0.5, 1.5, 6.0

_UPPER, _DIGIT, _LETTER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_SYMBOL, _BANG, _STOP, _OTHER, _HIGH = b"#*$%&|<>", b"!", b".,", b"?;:'\"()[]{}-_/\\+=@^~`", bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; shares as square roots, which spreads small ones."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    size, n, counts = len(raw), len(words), Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lone = sum(c for w, c in counts.items() if not w.strip(_SYMBOL))
    shares = [count(_UPPER) / max(1, count(_LETTER)), count(_DIGIT) / size, count(_SYMBOL) / size, count(_BANG) / size, count(_STOP) / size, count(_OTHER) / size, count(_HIGH) / size, lone / n]
    shares += [len(counts) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / len(lines)]
    logs = [np.log1p(size), np.log1p(n), np.log1p(size / n)]
    return [float(x) for x in [*logs, *np.sqrt(shares), np.log1p(size / len(lines))]]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    prior: float
    weights: np.ndarray
    seed: int
    knots: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0, 1.0]), np.array([0.0, 1.0])))


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, seed: int, features: int = FEATURES) -> np.ndarray:
    """Random features of statistics; the kernel's width is the root of their number, about the usual distance of two rows. The draws follow from the seed."""
    rng = np.random.default_rng(seed)
    draws, phase = rng.normal(size=(x.shape[1], features)) / np.sqrt(x.shape[1]), rng.uniform(0, 2 * np.pi, features)
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    return np.sqrt(2 / features) * np.cos(z @ draws + phase)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, dealt (CRC-32 modulo 4, null without an id), stats; written once."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "dealt", "stats"])

    rows = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4).cast("int").alias("dealt"), "text")
    with small_batches(docs.sparkSession):
        return stage(rows.mapInArrow(run, f"doc_id {kind}, dealt int, stats array<double>"), "statistics")


def _matrix(c: pa.Array, width: int) -> np.ndarray:
    return c.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def normal_equations(train: DataFrame, mean: np.ndarray, scale: np.ndarray, prior: float, seed: int, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Sums over stats and y of the products of features, and of features with y - prior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features))
        for b in batches:
            if b.num_rows:
                z = fourier(_matrix(b.column(0), len(mean)), mean, scale, seed, features)
                total[:-1] += z.T @ z
                total[-1] += (b.column(1).to_numpy(zero_copy_only=False) - prior) @ z
        yield pa.record_batch([pa.array(np.arange(features + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "total"])

    rows = train.select("stats", "y").mapInArrow(run, "row int, total array<double>")
    each = rows.select("row", F.posexplode("total").alias("at", "x")).groupBy("row", "at").agg(F.sum("x").alias("x"))
    lines = each.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("x")).collect()  # features squared numbers
    found = np.array([r["x"] for r in sorted(lines, key=lambda r: r["row"])]).reshape(-1, features)
    return found[:-1], found[-1]


def pool_adjacent_violators(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nondecreasing values closest to y."""
    blocks: list[list[float]] = []  # mean, weight, members
    for value, w in zip(y, weight):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, wv, m = blocks.pop()
            u, wu, k = blocks[-1]
            blocks[-1] = [(u * wu + v * wv) / (wu + wv), wu + wv, k + m]
    return np.concatenate([np.full(m, v) for v, _, m in blocks]) if blocks else np.zeros(0)


def _ridge_scores(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    """keep, raw: the ridge score of each row with stats."""
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = fourier(_matrix(b.column(0), len(model.mean)), model.mean, model.scale, model.seed, len(model.weights))
                yield pa.record_batch([*b.columns[1:], pa.array(model.prior + z @ model.weights)], names=[*keep, "raw"])

    return rows.select("stats", *keep).mapInArrow(run, f"{fields}, raw double")


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = 42) -> Model | None:
    """The model of document_statistics() rows and labels with doc_id, quality; None without labels."""
    d = len(STATISTICS)
    moments = [f(F.get("stats", F.lit(i))).alias(f"{name}{i}") for i in range(d) for name, f in (("mean", F.avg), ("std", F.stddev_pop))]
    seen = stats.agg(*moments).first()
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    train = stage(stats.where(F.col("dealt") != HELD_OUT).join(known, "doc_id").select("dealt", "stats", "y"), "labelled")
    prior = train.where(F.col("dealt") != CALIBRATE).agg(F.avg("y")).first()[0]
    if prior is None:
        return None
    mean = np.array([seen[f"mean{i}"] for i in range(d)])
    scale = np.array([seen[f"std{i}"] for i in range(d)])
    scale = np.where(scale > 1e-9, scale, 1.0)
    gram, cross = normal_equations(train.where(F.col("dealt") != CALIBRATE), mean, scale, prior, seed, features)
    # features have a mean square of 1 / features, so the trace is about the number of rows
    weights = np.linalg.solve(gram + max(ridge * np.trace(gram), 1e-9) * np.eye(features), cross)
    model = Model(mean, scale, prior, weights, seed)
    raw = _ridge_scores(train.where(F.col("dealt") == CALIBRATE), model, "y")
    at = F.floor((F.least(F.greatest("raw", F.lit(LOW)), F.lit(HIGH - 1e-9)) - LOW) * (BINS / (HIGH - LOW)))
    bins = raw.groupBy(at.alias("bin")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()  # BINS rows at most
    if not bins:
        return model
    x, y, n = (np.array([b[c] for b in bins], dtype=float) for c in ("x", "y", "n"))
    return Model(mean, scale, prior, weights, seed, (x, pool_adjacent_violators(y, n)))


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, dealt, score: between two calibrated bins in proportion."""
    if model is None:
        return stats.select("doc_id", "dealt", F.lit(0.5).alias("score"))
    kind, (x, y) = stats.schema["doc_id"].dataType.simpleString(), model.knots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.interp(b.column(2).to_numpy(zero_copy_only=False), x, y)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.clip(np.round(found, 6), 0.0, 1.0))], names=["doc_id", "dealt", "score"])

    return _ridge_scores(stats, model, "doc_id", "dealt").mapInArrow(run, f"doc_id {kind}, dealt int, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from the threshold on) for every row of docs."""
    stats = document_statistics(docs)
    scored = score(stats, fit(stats, labels, **options))
    held = F.coalesce(F.col("dealt") == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
