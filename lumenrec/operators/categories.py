"""Item categories from metadata paths: dominant roots stripped, large ones split, small ones merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OTHER, JOIN = "other", " > "


def category_tokens(path: Column) -> Column:
    """A comma-joined path as trimmed tokens without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def strip_dominant_root(items: DataFrame, share: float = 0.5) -> DataFrame:
    """items (item, tokens) with stripped: without the first token if it is the most common one, in any case of letters, and that has at least this share."""
    named = items.where(F.size("tokens") > 0).select(F.get("tokens", F.lit(0)).alias("root"))
    counts = named.groupBy("root").agg(F.count("*").alias("n"))
    # one row: the most common root, if it dominates
    top = counts.agg(F.min_by("root", F.struct((-F.col("n")).alias("m"), "root")).alias("root"), F.max("n").alias("n"), F.sum("n").alias("all"))
    top = top.select(F.when(F.col("n") >= share * F.col("all"), F.col("root")).alias("dominant"))
    rest = F.slice("tokens", F.lit(2), F.greatest(F.size("tokens") - 1, F.lit(0)))
    rows = items.join(F.broadcast(top))
    return rows.withColumn("stripped", F.when(F.lower(F.get("tokens", F.lit(0))) == F.lower("dominant"), rest).otherwise(F.col("tokens")))


def _last(tokens: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens, F.greatest(F.size(tokens) - n + 1, F.lit(1)), F.lit(n)), JOIN)


def initial_category(items: DataFrame, composite: bool = True) -> DataFrame:
    """items (tokens, stripped, dominant, and maybe genres, brand, codes) with path and category; null where nothing gives one."""
    path = F.when(F.size("stripped") > 0, F.col("stripped")).otherwise(F.col("tokens"))
    found = F.when(F.size("path") > 0, _last(F.col("path"), 2 if composite else 1))
    more = []
    if "genres" in items.columns:
        more.append(F.nullif(F.trim(F.get("genres", F.lit(0))), F.lit("")))
    if "brand" in items.columns:
        more.append(F.when(F.trim("brand") != "", F.concat(F.lit("Brand: "), F.trim("brand"))))
    if "codes" in items.columns:
        code = F.concat(F.lit("Code: L0_"), F.get("codes", F.lit(0)), F.lit("|L1_"), F.get("codes", F.lit(1)))
        more.append(F.when(F.col("dominant").isNotNull(), code))
    return items.withColumn("path", path).withColumn("category", F.coalesce(found, *more))


def split_large_categories(items: DataFrame, threshold: float = 0.01, rounds: int = 3) -> DataFrame:
    """Up to three times: items of a category above the threshold move to a longer path, where theirs has one."""
    for _ in range(rounds):
        counts = items.where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))
        large = counts.withColumn("all", F.sum("n").over(W.partitionBy(F.lit(1)))).where(F.col("n") > threshold * F.col("all")).select("category", F.lit(True).alias("large"))
        longer = F.when(F.size("path") >= 3, _last(F.col("path"), 3)).when(F.size("path") == 2, _last(F.col("path"), 2)).otherwise(_last(F.col("path"), 1))
        items = items.join(large, "category", "left").withColumn("category", F.when(F.col("large") & (F.size("path") > 0), longer).otherwise(F.col("category"))).drop("large")
    return items


def merge_small_categories(items: DataFrame, least: int = 5, most: int = 0) -> DataFrame:
    """Categories under so many items, and those past the largest ones if a number is given, become other."""
    counts = items.where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))
    small = F.col("n") < least
    if most > 0:
        small = small | (F.col("r") > most)
        counts = counts.withColumn("r", F.row_number().over(W.orderBy(F.desc("n"), "category")))
    counts = counts.where(small).select("category", F.lit(True).alias("small"))
    return items.join(counts, "category", "left").withColumn("category", F.when(F.col("small"), F.lit(OTHER)).otherwise(F.col("category"))).drop("small")


def category_ids(items: DataFrame) -> DataFrame:
    """category, n, cate_id: by size, then name, from 0; one row a category."""
    counts = items.where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))
    return counts.withColumn("cate_id", (F.row_number().over(W.orderBy(F.desc("n"), "category")) - 1).cast("long"))


def category_distribution(items: DataFrame) -> DataFrame:
    counts = items.where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))
    return counts.withColumn("ratio", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))


def fill_category_from_code(categories: DataFrame, tokens: DataFrame) -> DataFrame:
    """item_id, cate_id: items without a category take their first code token."""
    rows = categories.join(tokens, "item_id", "full")
    return rows.select("item_id", F.coalesce("cate_id", F.get("tokens", F.lit(0)).cast("long")).alias("cate_id"))
