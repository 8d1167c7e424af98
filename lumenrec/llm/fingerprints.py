"""Document fingerprints: a Merkle tree over phrases, paragraphs and sections.

A paragraph is a line. A section ends after a paragraph whose hash says so, so an edit moves no later
section's bounds. Paragraph hashes cover exact bytes, section hashes their paragraphs', the root the
sections': equal roots are equal texts, and where trees differ only differing sections have to be
opened. Below the paragraphs stand their phrases (word runs that end at words chosen by hash). The
fingerprint carries the whole tree with sizes in words, and likeness is the weight of the branches that
two trees share, not a sample of them. Digests are tagged with their level, so no paragraph passes for
a section. A document meets the next one by doc_id in a stream over sorted ranges of ids: texts are
shuffled once, trees never, and each tree is computed once.

Defined cases: a null text is empty; the next document of the last is the first; nulls come before all
ids and ties in doc_id are ordered by text; a single document is its own next; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from base64 import urlsafe_b64encode
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty
from .windows import mix, word_hashes

MOST_WORDS = 16
#: Digits of 6 bits: of a section's or paragraph's hash in the fingerprint, and of a phrase.
HASH, LEAF = 11, 6
#: The largest likeness of texts that differ.
BELOW_ONE = float(np.nextafter(1.0, 0.0))
#: Ranges of ids hold about so many rows at least, where tasks would else be without work, and so many at most; a range is streamed.
RANGE_ROWS, LARGE_RANGE_ROWS = 1000, 50_000
#: Code points of text and tree that a task gathers before it hands rows on.
OUT_CHARS = 4 << 20

_POWERS = np.array([pow(0x9E3779B97F4A7C17, k, 1 << 64) for k in range(MOST_WORDS + 1)], dtype=np.uint64)


_DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", dtype="S1")
_VALUE = {c.decode(): i for i, c in enumerate(_DIGITS.tolist())}


def _short(h: bytes) -> str:
    return urlsafe_b64encode(h)[:HASH].decode()


def _digest(raw: bytes, level: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16, person=level).digest()


def tree_of(text: str) -> tuple[str, list[tuple[bytes, list[tuple[bytes, int, int]]]]]:
    """The root, and per section its hash and its paragraphs as (hash, start, end) in code points."""
    sections, paragraphs, at = [], [], 0
    lines = text.split("\n")
    for i, line in enumerate(lines):
        h = _digest(line.encode(), b"paragraph")
        paragraphs.append((h, at, at + len(line)))
        at += len(line) + 1
        if h[0] % 4 == 0 or i == len(lines) - 1:
            sections.append((_digest(b"".join(p[0] for p in paragraphs), b"section"), paragraphs))
            paragraphs = []
    return _digest(b"".join(s[0] for s in sections), b"root").hex(), sections


def leaves(lines: list[list[bytes]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The phrases of lines of words in order, LEAF digits each (32 bits of hash, 4 of its words less one), and each one's words and line.

    A phrase ends at a word with a hash divisible by 4, after 16 words, or with its line.
    """
    counts = np.array([len(x) for x in lines])
    w = word_hashes([x for line in lines for x in line])
    if not len(w):
        return "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ends = (w & np.uint64(3)) == 0
    bounds = np.cumsum(counts)
    ends[bounds[counts > 0] - 1] = True
    starts = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])
    lengths = np.diff(np.append(starts, len(w)))
    if lengths.max() > MOST_WORDS:
        starts = np.concatenate([np.arange(s, s + n, MOST_WORDS) for s, n in zip(starts, lengths)])
        lengths = np.diff(np.append(starts, len(w)))
    place = np.arange(len(w)) - np.repeat(starts, lengths)
    sums = mix(np.add.reduceat(w * _POWERS[place], starts)) >> np.uint64(32)
    codes = (sums << np.uint64(4)) | (lengths - 1).astype(np.uint64)
    digits = (codes[:, None] >> np.arange(6 * LEAF - 6, -1, -6, dtype=np.uint64)) & np.uint64(63)
    return _DIGITS[digits.astype(np.int64)].tobytes().decode(), lengths, np.searchsorted(bounds, starts, side="right")


def fingerprint_of(text: str | None) -> str:
    """The whole tree: root:section/section..., a section as hash, words and its paragraphs, a paragraph as hash, words and its phrases."""
    root, sections = tree_of(text or "")
    lines = [line.encode().split() for line in (text or "").split("\n")]
    phrases, _, line_of = leaves(lines)
    at = LEAF * np.searchsorted(line_of, np.arange(len(lines) + 1))
    out, i = [], 0
    for h, paragraphs in sections:
        parts = [f"{_short(p)}{len(lines[k])}.{phrases[at[k] : at[k + 1]]}" for k, (p, _, _) in enumerate(paragraphs, i)]
        out.append(",".join([f"{_short(h)}{sum(map(len, lines[i : i + len(paragraphs)]))}", *parts]))
        i += len(paragraphs)
    return f"{root}:{'/'.join(out)}"


def _unlike(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """What of a and b has no equal hash (the first HASH characters) on the other side."""
    n, m = Counter(x[:HASH] for x in a), Counter(x[:HASH] for x in b)
    both, rest = n & m, []
    for side in (a, b):
        left, kept = both.copy(), []
        for x in side:
            if left[x[:HASH]] > 0:
                left[x[:HASH]] -= 1
            else:
                kept.append(x)
        rest.append(kept)
    return rest[0], rest[1]


def _words_in(nodes: list[str], end: str) -> int:
    return sum(int(x[HASH:].partition(end)[0]) for x in nodes)


def likeness_of(a: str, b: str) -> float:
    """1 for equal roots, else the share of words in common branches (twice the common ones by the sum of both), below 1.

    Only sections without an equal one are opened, and in them only paragraphs without an equal one: what is compared by
    phrases is the rest. Every phrase counts, so the share is exact at any length.
    """
    ra, _, ta = a.partition(":")
    rb, _, tb = b.partition(":")
    if ra == rb:
        return 1.0
    x, y = ta.split("/"), tb.split("/")
    total = _words_in(x, ",") + _words_in(y, ",")
    if not total:
        return 0.0
    x, y = _unlike(x, y)
    x, y = _unlike([p for s in x for p in s.split(",")[1:]], [p for s in y for p in s.split(",")[1:]])
    opened = _words_in(x, ".") + _words_in(y, ".")
    p, q = (Counter(s[i : i + LEAF] for n in side for s in [n.partition(".")[2]] for i in range(0, len(s), LEAF)) for side in (x, y))
    shared = sum(n * (_VALUE[leaf[-1]] % MOST_WORDS + 1) for leaf, n in (p & q).items())
    return min((total - opened + 2 * shared) / total, BELOW_ONE)


@F.pandas_udf(T.StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    return text.map(fingerprint_of)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness_of(x, y) for x, y in zip(a, b)], dtype="float64")


NODES = "array<struct<section: int, paragraph: int, start: int, end: int, hash: string>>"


def trees(docs: DataFrame) -> DataFrame:
    """doc_id, section, paragraph (null for a section's own row), start, end (code points), hash."""

    @F.pandas_udf(NODES)
    def nodes(text: pd.Series) -> pd.Series:
        def of(t: str) -> list[dict]:
            out = []
            for k, (h, paragraphs) in enumerate(tree_of(t)[1]):
                out.append({"section": k, "paragraph": None, "start": paragraphs[0][1], "end": paragraphs[-1][2], "hash": h.hex()})
                out += [{"section": k, "paragraph": i, "start": s, "end": e, "hash": p.hex()} for i, (p, s, e) in enumerate(paragraphs)]
            return out

        return text.map(of)

    return docs.select("doc_id", F.inline(nodes(text_or_empty("text"))))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """The paragraphs of new (trees) that old lacks, by doc_id: only those of sections that old lacks are compared."""
    sections = new.where("paragraph IS NULL").join(old.where("paragraph IS NULL").select("doc_id", "hash"), ["doc_id", "hash"], "left_anti").select("doc_id", "section")
    opened = new.where("paragraph IS NOT NULL").join(sections, ["doc_id", "section"], "left_semi")
    return opened.join(old.where("paragraph IS NOT NULL").select("doc_id", "hash"), ["doc_id", "hash"], "left_anti")


def id_ranges(d: DataFrame) -> DataFrame:
    """d (doc_id, text) with part, the range of its id, and the first row of every range once more at the end (ahead = 1) of the range before it; the last range ends with the first row of all."""
    spark = d.sparkSession
    rows, nulls, least = d.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id")).first()
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, rows // LARGE_RANGE_ROWS, min(rows // RANGE_ROWS, tasks))
    cuts = d.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 10 * ranges + 100)).first()[0] if ranges > 1 else []
    bounds = np.array(sorted({c for c in cuts or [] if c > least or nulls}), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        known = doc_id.notna()
        out = np.zeros(len(doc_id), dtype=np.int32)
        out[known] = np.searchsorted(bounds, doc_id[known].astype("int64"), side="right")
        return pd.Series(out)

    heads = [(int(b), k) for k, b in enumerate(bounds)] + [(None if nulls else least, len(bounds))]  # a row for LARGE_RANGE_ROWS rows, or for a task
    heads = spark.createDataFrame(heads, "head long, part int")
    first = d.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("part").agg(F.min("text").alias("text"))
    every = d.select(range_of("doc_id").alias("part"), F.lit(0).alias("ahead"), "doc_id", "text")
    return every.unionByName(first.select("part", F.lit(1).alias("ahead"), F.lit(None).cast("long").alias("doc_id"), "text"))


PAIRS = "doc_id long, text string, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited (the last half of its code points replaced by as many of the next document's first), both fingerprints, and the likeness to the edited text's and to the next document's."""
    d = id_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")))
    names = [x.split()[0] for x in PAIRS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in PAIRS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held, chars = None, {c: [] for c in names}, 0
        for batch in batches:
            for part, ahead, doc_id, text in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
                text = text.as_py()
                tree = fingerprint_of(text)
                if before and before[0] == part:
                    _, _, own_id, own, own_tree = before
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    edited_tree = fingerprint_of(edited)
                    for c, v in zip(names, (own_id, own, edited, own_tree, edited_tree, likeness_of(own_tree, edited_tree), likeness_of(own_tree, tree))):
                        held[c].append(v)
                    chars += len(own) + len(edited) + len(own_tree) + len(edited_tree)
                    if chars >= OUT_CHARS:
                        yield pa.record_batch(held, schema=schema)
                        held, chars = {c: [] for c in names}, 0
                before = (part, ahead, doc_id, text, tree)
        yield pa.record_batch(held, schema=schema)

    return d.repartition("part").sortWithinPartitions("part", "ahead", "doc_id", "text").mapInArrow(run, PAIRS)
