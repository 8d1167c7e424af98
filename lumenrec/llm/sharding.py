"""Two-pass external shuffle into shards, in DataFrame functions.

Pass one scatters records by seeded hashes into buckets of bounded bytes and rows, of which each task
takes a range; pass two puts a bucket's rows in the order of their hashes, shuffles them by Fisher-Yates
with draws seeded by shard and bucket, numbers them behind the buckets before it and writes them. So
shard and slot follow from the rows alone: reruns, lost tasks and other numbers of partitions give the
same. A document's shard follows from doc_id and the shard count: the shard whose seeded hash of the id
is largest, so one more shard takes rows only into itself.

Defined cases: a null text has no bytes; rows with a null doc_id share a shard and scatter over its
buckets by their text; rows equal in doc_id and text share a bucket and get slots of their own; an empty
table gives an empty table; other columns are not read. A very long text is one row like others;
before the draws rows stand by hash, doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage, text_or_empty

#: A bucket holds about so many bytes and rows at most; a shuffle takes time by the square of its rows.
BUCKET_BYTES, BUCKET_ROWS = 8 << 20, 128


def shard_of(key: Column, shards: int, seed: int = 17) -> Column:
    """The shard with the largest seeded hash of the key."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("s")) for i in range(shards)]
    return F.array_max(F.array(*scores))["s"]


def fisher_yates(draws: Column, n: Column) -> Column:
    """The numbers 0 to n - 1, shuffled: from the last place down, place k changes with place j for each (k, j) of draws."""
    swap = lambda order, d: F.transform(order, lambda x, i: F.when(i == d["k"], F.get(order, d["j"])).when(i == d["j"], F.get(order, d["k"])).otherwise(x))
    return F.aggregate(draws, F.sequence(F.lit(0), n - 1), swap)


def shard(docs: DataFrame, shards: int = 24, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text, size, shard, slot (gapless from 0 in each shard), grown_shard (with one shard more); whole ranges of buckets a task."""
    text = text_or_empty("text")
    size = (F.octet_length(text) + 8).cast("long")
    total, count = docs.agg(F.sum(size), F.count("*")).first()
    parts = max(1, -(-(total or 0) // (shards * bucket_bytes)), -(-count // (shards * bucket_rows)))
    scattered = docs.select("doc_id", "text", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", text).alias("h"), shard_of(F.col("doc_id"), shards, seed).alias("shard"))
    scattered = scattered.withColumn("bucket", F.pmod("h", F.lit(parts)).cast("int"))
    counts = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = stage(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "bucket-starts")
    ranges = scattered.repartitionByRange("shard", "bucket")
    rows = ranges.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(F.struct("h", "doc_id", "size", "text"))).alias("rows")).join(starts, ["shard", "bucket"])
    rows = rows.withColumn("n", F.size("rows"))
    draw = lambda k: F.struct(k.alias("k"), F.pmod(F.xxhash64(F.lit(seed), "shard", "bucket", k), k + 1).cast("int").alias("j"))
    rows = rows.withColumn("draws", F.when(F.col("n") > 1, F.transform(F.sequence(F.col("n") - 1, F.lit(1), F.lit(-1)), draw)).otherwise(F.array().cast("array<struct<k:int,j:int>>")))
    rows = rows.withColumn("order", fisher_yates(F.col("draws"), F.col("n")))
    dealt = rows.select("shard", "start", F.posexplode(F.transform("order", lambda place: F.get("rows", place))).alias("at", "row"))
    return dealt.select(
        F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.size").alias("size"), "shard",
        (F.col("start") + F.col("at")).cast("long").alias("slot"), _grown(F.col("row.doc_id"), F.col("shard"), shards, seed).alias("grown_shard"),
    )


def _grown(key: Column, now: Column, shards: int, seed: int) -> Column:
    return F.when(shard_of(key, shards + 1, seed) == shards, F.lit(shards)).otherwise(now)


def write_shards(sharded: DataFrame, path: str) -> DataFrame:
    """Writes one folder a shard, the rows of each file in slot order, and reads them back."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path)
