"""Interaction logs to training samples: cleaning, k-core, dense ids, sequences, splits, windows.

Interactions have (user, item, rating, ts). Ties in time are ordered by item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenrec.functions.staging import Scratch, stage

from .ranges import numbered, placed, with_previous

HISTORY = 50


def distinct_interactions(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["user", "item", "rating", "ts"])


def first_interactions(df: DataFrame) -> DataFrame:
    """Each user's first interaction with each item; an aggregate, so duplicates combine before the shuffle."""
    first = df.groupBy("user", "item").agg(F.min(F.struct("ts", "rating")).alias("f"))
    return first.select("user", "item", F.col("f.rating").alias("rating"), F.col("f.ts").alias("ts"))


def in_order(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds pos (each row's place in its user's time from 0), n (the user's rows), and the range (part, here) that a row is in.

    Rows are sorted in ranges by user and time (ranges.placed), so one user's rows may be many tasks; the sort is written once.
    """
    return placed(df, "user", "ts", "item", parts=parts).drop("line")


def filter_by_metadata(df: DataFrame, items: DataFrame) -> DataFrame:
    return df.join(items.select("item"), "item", "left_semi")


def degree_counts(df: DataFrame, unit: str) -> DataFrame:
    return df.groupBy(unit).agg(F.count("*").alias("n"))


def units_at_least(df: DataFrame, unit: str, threshold: int) -> DataFrame:
    return degree_counts(df, unit).where(F.col("n") >= threshold).select(unit)


def k_core(df: DataFrame, user_k: int = 5, item_k: int = 5, trace: list[tuple[int, int]] | None = None) -> DataFrame:
    """The largest part in which every user has user_k rows and every item item_k; rows without user or item go.

    Peeling by deltas: degrees are counted once, and a round subtracts from the neighbours of the users and items that
    fell in the round before. It reads only the buckets of edges in which these stand, and the rows are filtered once, at
    the end. trace gets (fallen, rows that they took with them) for each round.
    """
    if user_k <= 0 and item_k <= 0:
        return df
    spark = df.sparkSession
    rows = stage(df.where("user IS NOT NULL AND item IS NOT NULL"), "core")
    scratch = Scratch(spark, "peeling")
    least = lambda side: F.when(F.col(side) == 0, user_k).otherwise(item_k)
    # users and items are nodes of two sides; an edge stands at both of its ends, in a bucket of the first
    text = lambda c: F.col(c).cast("string")
    ends = F.array(F.struct(F.lit(0).alias("side"), text("user").alias("node"), text("item").alias("other")), F.struct(F.lit(1).alias("side"), text("item").alias("node"), text("user").alias("other")))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = rows.groupBy("user", "item").agg(F.count("*").alias("n")).select("n", F.inline(ends))
    edges = scratch.stage(pairs.withColumn("bucket", F.pmod(F.xxhash64("side", "node"), F.lit(buckets)).cast("int")), "edges", by="bucket")
    degrees = scratch.stage(edges.groupBy("side", "node", "bucket").agg(F.sum("n").alias("degree")), "degrees")
    fallen = scratch.stage(degrees.where(F.col("degree") < least("side")).select("side", "node", "bucket"), "fallen")
    lost, every = None, None
    # as many as there are buckets at most
    while at := [r[0] for r in fallen.select("bucket").distinct().collect()]:
        every = fallen if every is None else every.unionByName(fallen)
        near = edges.where(F.col("bucket").isin(at)).join(fallen.select("side", "node"), ["side", "node"])
        near = near.select((1 - F.col("side")).alias("side"), F.col("other").alias("node"), F.col("n").alias("now"), F.lit(0).cast("long").alias("before"))
        if lost is not None:
            near = near.unionByName(lost.select("side", "node", "now", F.col("now").alias("before")))
        lost = scratch.stage(near.groupBy("side", "node").agg(F.sum("now").alias("now"), F.sum("before").alias("before")), "lost")
        if trace is not None:
            trace.append((fallen.count(), lost.agg(F.sum(F.col("now") - F.col("before"))).first()[0]))
        down = degrees.join(lost, ["side", "node"]).where((F.col("degree") - F.col("before") >= least("side")) & (F.col("degree") - F.col("now") < least("side")))
        fallen = scratch.stage(down.select("side", "node", "bucket"), "fallen")
    if every is not None:
        for side, c in enumerate(("user", "item")):
            gone = every.where(F.col("side") == side).select(F.col("node").alias("gone"))
            rows = rows.join(gone, text(c) == F.col("gone"), "left_anti")
        rows = stage(rows, "core")
    scratch.keep()
    return rows


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """key, idx: distinct keys in order, numbered from 0."""
    return numbered(df.select(key).distinct(), key)


def with_dense_ids(df: DataFrame) -> DataFrame:
    """user and item replaced by uid and iid."""
    users, items = dense_ids(df, "user").withColumnRenamed("idx", "uid"), dense_ids(df, "item").withColumnRenamed("idx", "iid")
    return df.join(users, "user").join(items, "item").drop("user", "item")


def user_sequences(df: DataFrame) -> DataFrame:
    """user, items (array in time order), from rows with pos. A user's whole array is one value: what needs the end of a history alone takes last_items()."""
    seq = F.array_sort(F.collect_list(F.struct("pos", "item")))
    return df.groupBy("user").agg(F.transform(seq, lambda x: x["item"]).alias("items"))


def leave_two_out(sequences: DataFrame) -> DataFrame:
    """user, train, valid, test; users with fewer than three items go."""
    s = sequences.where(F.size("items") >= 3)
    return s.select("user", F.slice("items", F.lit(1), F.size("items") - 2).alias("train"), F.element_at("items", -2).alias("valid"), F.element_at("items", -1).alias("test"))


def last_n(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.lit(n))


def sliding_window_samples(df: DataFrame, history: int = HISTORY) -> DataFrame:
    """user, pos, history, target for every training position after the first, from rows of in_order(); a range of a user's rows takes what it needs from the ranges before."""
    rows = with_previous(df, "user", "item", history, "history")
    return rows.where((F.col("pos") >= 1) & (F.col("pos") < F.col("n") - 2)).select("user", "pos", "history", F.col("item").alias("target"))


def last_items(df: DataFrame, m: int, users: int = 3) -> DataFrame:
    """user, items: the last m items at most of users with so many rows at least, from rows of in_order(); only these rows are brought together."""
    return user_sequences(df.where((F.col("n") >= users) & (F.col("pos") >= F.col("n") - m)))


def last_target_samples(df: DataFrame, history: int = HISTORY) -> DataFrame:
    """user, history, target: the last training item alone, from rows of in_order(); a single one has an empty history."""
    s = last_items(df, history + 3)
    return s.select("user", last_n(F.slice("items", F.lit(1), F.size("items") - 3), history).alias("history"), F.element_at("items", -3).alias("target"))


def eval_samples(df: DataFrame, history: int = HISTORY) -> DataFrame:
    """user, split (valid or test), history, target, from rows of in_order()."""
    s = last_items(df, history + 2)
    of = lambda name, less: F.struct(F.lit(name).alias("split"), last_n(F.slice("items", F.lit(1), F.size("items") - less), history).alias("history"), F.element_at("items", -less).alias("target"))
    return s.select("user", F.inline(F.array(of("valid", 2), of("test", 1))))


def training_histories(df: DataFrame, history: int = HISTORY) -> DataFrame:
    """user, history: the last training items, from rows of in_order()."""
    s = last_items(df, history + 2)
    return s.select("user", last_n(F.slice("items", F.lit(1), F.size("items") - 2), history).alias("history"))


def pad_or_truncate(items: Column, n: int, pad: int = 0) -> Column:
    """The last n items, or pads before them up to n."""
    return F.when(F.size(items) >= n, last_n(items, n)).otherwise(F.concat(F.array_repeat(F.lit(pad).cast("long"), n - F.size(items)), items))


def item_features(ids: DataFrame, metadata: DataFrame) -> DataFrame:
    """Dense item ids with their metadata, where there is any."""
    return ids.join(metadata, "item")


def dataset_stats(df: DataFrame, items_with_meta: DataFrame | None = None) -> DataFrame:
    """One row: users, items, interactions, sparsity, and items_with_meta if metadata are given."""
    s = df.agg(F.countDistinct("user").alias("users"), F.countDistinct("item").alias("items"), F.count("*").alias("interactions"))
    s = s.withColumn("sparsity", 1 - F.col("interactions") / (F.col("users").cast("double") * F.col("items")))
    if items_with_meta is not None:
        s = s.join(df.select("item").distinct().join(items_with_meta.select("item").distinct(), "item").agg(F.count("*").alias("items_with_meta")))
    return s
