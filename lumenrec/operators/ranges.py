"""Places in ordered groups of any size: rows are cut into ranges of about equal count, so that a hot group is many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenrec.functions.staging import stage


def _split_groups(rows: DataFrame, key: str) -> DataFrame:
    """group, part, start, total: where each part of a group that several parts share begins, and the group's size.

    Each bound between two parts lies in one group at most, so this has two rows a part at most, whatever the input.
    """
    ends = rows.groupBy("part").agg(F.min(F.struct(key)).alias("lo"), F.max(F.struct(key)).alias("hi"))
    each = ends.select("part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("k"))
    shared = each.groupBy("k").agg(F.count("*").alias("parts")).where("parts > 1").select(F.col(f"k.{key}").alias("shared"))
    counts = rows.join(F.broadcast(shared), F.col(key).eqNullSafe(F.col("shared")), "left_semi").groupBy(F.col(key).alias("group"), "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("group").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return counts.select("group", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(W.partitionBy("group")).alias("total"))


def ranged(df: DataFrame, key: str, *order: str, parts: int | None = None) -> DataFrame:
    """df, written in ranges by (key, *order), with part (the range a row is in) and line (its place: lines ascend within a part, parts from one to the next).

    A range holds whole ties of (key, *order): where many rows may agree in all of these, a further column should tell them apart.
    """
    cut = df.repartitionByRange(parts, key, *order) if parts else df.repartitionByRange(key, *order)
    cut = cut.sortWithinPartitions(key, *order)
    return stage(cut.withColumns({"part": F.spark_partition_id(), "line": F.monotonically_increasing_id()}), "ranges")


def positions(rows: DataFrame, key: str) -> DataFrame:
    """rows of ranged() with pos (a row's place in its group, from 0), n (the group's size) and here (how many of the group are in this part). Groups are the values of key; null is one."""
    by = W.partitionBy(key, "part")
    local = rows.withColumns({"here": F.count("*").over(by), "pos": F.row_number().over(by.orderBy("line")).cast("long") - 1})
    split = _split_groups(rows, key).withColumnRenamed("part", "at")
    local = local.join(F.broadcast(split), F.col(key).eqNullSafe(F.col("group")) & (F.col("part") == F.col("at")), "left")
    return local.withColumns({"pos": F.col("pos") + F.coalesce("start", F.lit(0)), "n": F.coalesce("total", F.col("here"))}).select(*rows.columns, "pos", "n", "here")


def placed(df: DataFrame, key: str, *order: str, parts: int | None = None) -> DataFrame:
    """df with part, line, pos, n and here: places by the given order within each value of key."""
    return positions(ranged(df, key, *order, parts=parts), key)


def with_previous(rows: DataFrame, key: str, value: str, m: int, name: str = "previous") -> DataFrame:
    """rows of placed() with an array of the m values before each in its group, fewer at its start.

    A range sees its own rows; what the ranges before hold of the last m values is carried over the bound.
    """
    within = W.partitionBy(key, "part").orderBy("pos").rowsBetween(-m, -1)
    # the last m rows of each part of a group that goes on in another part: m values a part at most
    first = F.min("pos").over(W.partitionBy(key, "part"))
    ends = rows.where("n > here").withColumn("first", first).where(F.col("pos") >= F.col("first") + F.col("here") - m)
    tails = ends.groupBy(F.col(key).alias("group"), F.col("part").alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))), lambda x: x["v"]).alias("tail"))
    # a part has a row at least, so that m parts hold what is needed
    carried = F.flatten(F.collect_list("tail").over(W.partitionBy("group").orderBy("at").rowsBetween(-m, -1)))
    halo = tails.select("group", "at", carried.alias("halo"))
    joined = rows.withColumn(name, F.collect_list(value).over(within)).join(F.broadcast(halo), F.col(key).eqNullSafe(F.col("group")) & (F.col("part") == F.col("at")), "left")
    both = F.concat("halo", name)
    last = F.slice(both, F.greatest(F.size(both) - m + 1, F.lit(1)), F.lit(m))
    return joined.withColumn(name, F.when(F.size(name) < m, F.coalesce(last, F.col(name))).otherwise(F.col(name))).select(*rows.columns, name)


def numbered(keys: DataFrame, *order: str) -> DataFrame:
    """keys with idx: their places in the given order from 0; a range sort and offsets by range, no global window."""
    rows = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage(rows.withColumn("line", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumns({"part": F.shiftright("line", 33), "at": F.col("line").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("part").agg(F.count("*").alias("many"))  # one row a range
    starts = sizes.select("part", F.coalesce(F.sum("many").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(starts), "part").select(*keys.columns, (F.col("start") + F.col("at")).alias("idx"))
