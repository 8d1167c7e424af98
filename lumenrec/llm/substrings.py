"""Substring dedup: words covered by a window that also starts elsewhere are removed.

Level by level with doubled lengths, until no candidate survives or the full length is reached: 9, 18,
then the full 35 words. At the first level only anchors are looked at: in every 35-word window the
9-word window with the smallest hash. Equal windows have equal anchors at equal places, so a window
whose anchor is found once alone is unique. Anchors that repeat are extended to 18 words, to either
side; windows whose 18-word parts repeat as well become candidates at 35 words, and those found twice
or more are removed. Longer levels could not change what is removed, so the levels end there.

Every level is a count by hash with map-side combining and a join back, so a passage in a third of
all documents is neither one task nor a list. Equal texts are found first and enter the last level
once, with their number. The levels before the last only choose candidates, by hashes of 64 bits and
less; full windows and equal texts are told by 128 bits.

Defined cases: a null or empty text has no words; texts under 35 words lose nothing; a repeated row
counts as another document; rows with null doc_id are told apart by their text; an empty table gives
an empty table; columns beside doc_id and text are not read by `find` and kept by `cut`, whatever
their names, unless they carry a name of its results, which then replace them. Very long texts are read whole, in batches
of few rows; all copies of a window go, so that there is no tie to break.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hidden, small_batches, text_or_empty
from .windows import mix, window_hashes, word_hashes, words_of

LENGTH = 35


def levels(length: int) -> tuple[int, int]:
    """The two lengths before the full one: each at least half of the next."""
    half = (length + 1) // 2
    return (half + 1) // 2, half


def anchors_of(w: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the short windows, and for every full window the start of its smallest one (the first of equals)."""
    short = window_hashes(w, levels(length)[0])
    span = length - levels(length)[0] + 1
    views = np.lib.stride_tricks.sliding_window_view(short, span)
    return short, views.argmin(axis=1) + np.arange(len(views))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _in_batches(rows: Iterator[dict], schema: pa.Schema, at_least: int = 100_000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[schema.names[-1]])
        if n >= at_least:
            yield pa.record_batch({c: np.concatenate([x[c] for x in held]) if not isinstance(held[0][c], pa.Array) else pa.concat_arrays([x[c] for x in held]) for c in schema.names}, schema)
            held, n = [], 0
    if held:
        yield pa.record_batch({c: np.concatenate([x[c] for x in held]) if not isinstance(held[0][c], pa.Array) else pa.concat_arrays([x[c] for x in held]) for c in schema.names}, schema)


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("at", pa.int32()), ("seed", pa.int64()), ("ahead", pa.int32()), ("behind", pa.int32())])
    first, half = levels(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    w = word_hashes(words_of(text.as_py()))
                    if len(w) < length:
                        continue
                    short, at = anchors_of(w, length)
                    at = np.unique(at)
                    wide = window_hashes(w, half).astype(np.uint32).view(np.int32)
                    ahead, behind = at, at + first - half
                    ahead = pa.array(wide[np.minimum(ahead, len(wide) - 1)], mask=ahead >= len(wide))
                    behind = pa.array(wide[np.maximum(behind, 0)], mask=behind < 0)
                    yield {"key": np.full(len(at), key), "at": at.astype(np.int32), "seed": _signed(short[at]), "ahead": ahead, "behind": behind}

        yield from _in_batches(rows(), schema)

    return docs.mapInArrow(run, "key long, at int, seed long, ahead int, behind int")


def _repeated(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").drop("n")


def second_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """64 further bits of all windows of so many words: of words hashed again, under another base."""
    return window_hashes(mix(w ^ np.uint64(0xA0761D6478BD642F)), size, 0xD1342543DE82EF95)


def _candidates(texts: DataFrame, length: int) -> DataFrame:
    """k0, k1, at, n (copies), h0, h1 of every full window whose anchor and half-length parts repeat; texts has k0, k1, text, n, ahead, behind (the anchors that repeat to either side)."""
    schema = pa.schema([("k0", pa.int64()), ("k1", pa.int64()), ("at", pa.int32()), ("n", pa.int64()), ("h0", pa.int64()), ("h1", pa.int64())])
    first, half = levels(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for k0, k1, text, n, ahead, behind in zip(*[batch.column(i).to_pylist() for i in (0, 1)], batch.column(2), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                    w = word_hashes(words_of(text.as_py()))
                    if len(w) < length:
                        continue
                    _, anchor = anchors_of(w, length)
                    into = anchor - np.arange(len(anchor))
                    flags = np.zeros((2, len(w)), dtype=bool)
                    for flag, at in zip(flags, (ahead, behind)):
                        at = at.values.to_numpy()
                        flag[at[at < len(w)]] = True  # a text with the same k0 may be longer
                    # the half-length part ahead of the anchor lies in the window, or the one that ends with it, or both
                    open_ = (flags[0][anchor] | (into > length - half)) & (flags[1][anchor] | (into < half - first))
                    at = np.flatnonzero(open_)
                    if len(at):
                        full = lambda v: np.full(len(at), v)
                        yield {"k0": full(k0), "k1": full(k1), "at": at.astype(np.int32), "n": full(n), "h0": _signed(window_hashes(w, length)[at]), "h1": _signed(second_hashes(w, length)[at])}

        yield from _in_batches(rows(), schema)

    return texts.select("k0", "k1", "text", "n", "ahead", "behind").mapInArrow(run, "k0 long, k1 long, at int, n long, h0 long, h1 long")


def text_keys(text: str | Column) -> dict[str, Column]:
    """k0 and k1: 128 bits of a text."""
    return {"k0": F.xxhash64(text_or_empty(text)), "k1": F.xxhash64(F.lit(LENGTH), text_or_empty(text))}


def find(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """k0, k1, starts (array, in order) of the repeated windows, for texts that have any; k0 and k1 are the text's keys, [-1] stands for all windows."""
    scratch = Scratch(docs.sparkSession, "substrings")
    try:
        with small_batches(docs.sparkSession):
            return _find(docs.select("doc_id", "text"), length, scratch)
    finally:
        scratch.keep("found")


def _find(docs: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    texts = docs.withColumn("text", text_or_empty("text")).withColumns(text_keys("text"))
    once = texts.groupBy("k0", "k1", "doc_id").agg(F.count("*").alias("n")).groupBy("k0", "k1")
    once = scratch.stage(once.agg(F.sum("n").alias("n"), F.min("doc_id").alias("holder"), F.max("n").alias("most")), "texts")
    copies = once.where("n > 1").select("k0", "k1", F.array(F.lit(-1)).alias("starts"))
    open_ = _open_anchors(texts.select(F.col("k0").alias("key"), "text"), length, scratch)
    if open_ is None:
        return scratch.stage(copies, "found")
    # one document of each text that is still in question
    asked = once.join(open_.withColumnRenamed("key", "k0"), "k0").withColumnsRenamed({"k0": "a0", "k1": "a1"})
    held = texts.join(asked, (F.col("k0") == F.col("a0")) & (F.col("k1") == F.col("a1")) & F.col("doc_id").eqNullSafe(F.col("holder")))
    if not once.where("most > 1").isEmpty():
        held = held.dropDuplicates(["k0", "k1"])
    windows = scratch.stage(_candidates(held, length), "windows")
    repeated = scratch.stage(windows.groupBy("h0", "h1").agg(F.sum("n").alias("n")).where("n > 1").select("h0", "h1"), "repeated-windows")
    found = windows.where("n = 1").join(repeated, ["h0", "h1"], "left_semi").groupBy("k0", "k1").agg(F.sort_array(F.collect_set("at")).alias("starts"))
    return scratch.stage(found.unionByName(copies), "found")


def _open_anchors(texts: DataFrame, length: int, scratch: Scratch) -> DataFrame | None:
    """key, ahead, behind: the anchors of each text (key, text) that still repeat at half the length, to either side; None where no text has any."""
    anchors = scratch.stage(_anchors(texts, length), "anchors")
    seeds = scratch.stage(_repeated(anchors, "seed"), "seeds")
    if seeds.isEmpty():
        return None
    alive = scratch.stage(anchors.join(seeds, "seed", "left_semi").select("key", "at", "ahead", "behind"), "alive")
    scratch.drop("anchors", "seeds")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("ahead").alias("h")), F.struct(F.lit(1).alias("side"), F.col("behind").alias("h")))
    parts = alive.select("key", "at", F.inline(sides)).where("h IS NOT NULL")
    wide = scratch.stage(_repeated(parts, "side", "h"), "wide")
    if wide.isEmpty():
        return None
    side = lambda s: F.collect_set(F.when(F.col("side") == s, F.col("at")))
    open_ = scratch.stage(parts.join(wide, ["side", "h"], "left_semi").groupBy("key").agg(side(0).alias("ahead"), side(1).alias("behind")), "open")
    scratch.drop("alive", "wide")
    return open_


RESULTS = ("kept_text", "n_words", "n_removed")


def cut(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with kept_text (the words that stay, joined by one space), n_words, n_removed."""
    found = find(docs, length).withColumnsRenamed({"k0": "f0", "k1": "f1"})
    inner, columns = hidden(docs.drop(*RESULTS))
    text = F.col(columns["text"])
    rows = inner.withColumns(text_keys(text)).join(found, (F.col("k0") == F.col("f0")) & (F.col("k1") == F.col("f1")), "left")

    @F.pandas_udf("kept_text string, n_words long, n_removed long")
    def strip(texts, starts):
        import pandas as pd

        out = []
        for text, at in zip(texts, starts):
            words = words_of(text)
            if at is None or not len(at):
                out.append((b" ".join(words).decode(), len(words), 0))
                continue
            if at[0] < 0:
                at = np.arange(max(0, len(words) - length + 1))
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, np.asarray(at), 1)
            np.add.at(edge, np.asarray(at) + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            out.append((b" ".join(w for w, g in zip(words, gone) if not g).decode(), len(words), int(gone.sum())))
        return pd.DataFrame(out, columns=list(RESULTS))

    d = rows.withColumn("cut", strip(text, "starts"))
    return d.select(*[F.col(c).alias(name) for name, c in columns.items()], *[F.col(f"cut.{c}").alias(c) for c in RESULTS])


def drop_repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs without repeated passages, in the columns of docs: an untouched text stays as it is, n_chars is renewed for others, and documents with no word left go."""
    inner, columns = hidden(docs)
    own = {columns[c]: c for c in ("doc_id", "text")}
    d = cut(inner.withColumnsRenamed(own), length).where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    out = {name: F.col(own.get(c, c)) for name, c in columns.items()} | {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in columns:
        out["n_chars"] = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col(columns["n_chars"]))
    return d.select(*[c.alias(n) for n, c in out.items()])
