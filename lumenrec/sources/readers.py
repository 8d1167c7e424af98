"""Readers of interaction logs, item metadata, id maps, embeddings, codebooks and samples."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrec.operators.interactions import last_n, pad_or_truncate
from lumenrec.operators.text import clean_text

from .byteranges import RANGE_BYTES, MatrixSource, read_members


def _field(i: int) -> Column:
    return F.get("f", F.lit(i))


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """item,user,rating,time lines as (user, item, rating, ts); lines of another width or with values that don't cast go."""
    f = spark.read.text(path).select(F.split("value", ",", -1).alias("f")).where(F.size("f") == 4)
    rows = f.select(_field(1).alias("user"), _field(0).alias("item"), _field(2).try_cast("double").alias("rating"), _field(3).try_cast("long").alias("ts"))
    return rows.where("rating IS NOT NULL AND ts IS NOT NULL")


def read_recbole_inter(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated user, item, rating, timestamp below each file's first line, whatever it says; white space around a line goes, timestamps are truncated."""
    # the CSV source drops the first line of every file; no line holds the separator that it is given
    lines = spark.read.schema("value string").option("header", True).option("sep", "\x01").option("quote", "").option("escape", "").csv(path)
    stripped = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    f = lines.select(F.split(stripped, "\t", -1).alias("f")).where(F.size("f") == 4)
    rows = f.select(_field(0).alias("user"), _field(1).alias("item"), _field(2).try_cast("double").alias("rating"), _field(3).try_cast("double").cast("long").alias("ts"))
    return rows.where("rating IS NOT NULL AND ts IS NOT NULL")


def _in_line_order(df: DataFrame) -> DataFrame:
    return df.withColumns({"_file": F.input_file_name(), "_line": F.monotonically_increasing_id()})


def _last_of(df: DataFrame, key: str) -> DataFrame:
    """The last row of each key by line."""
    cols = [c for c in df.columns if c not in ("_file", "_line")]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("_file", "_line")).alias("r")).select("r.*")


def read_recbole_items(spark: SparkSession, path: str) -> DataFrame:
    """item_id, fields (map of the other columns; empty and 'None' values go); the last of equal ids wins."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("mode", "DROPMALFORMED").csv(path)
    df = df.toDF(*[c.split(":")[0] for c in df.columns])
    if "item_id" not in df.columns:
        raise ValueError("the header has no item_id")
    rest = [c for c in df.columns if c != "item_id"]
    pairs = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*rest)), lambda k, v: v.isNotNull() & ~v.isin("", "None"))
    rows = _in_line_order(df.where("item_id IS NOT NULL AND item_id <> ''"))
    return _last_of(rows.select("item_id", pairs.alias("fields"), "_file", "_line"), "item_id")


def extract_ratings_from_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review lines of JSON as (user, item, rating, ts), where all are given."""
    schema = "asin string, reviewerID string, overall double, unixReviewTime long"
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    df = df.select(F.col("reviewerID").alias("user"), F.col("asin").alias("item"), F.col("overall").alias("rating"), F.col("unixReviewTime").alias("ts"))
    return df.where("user <> '' AND item <> '' AND rating IS NOT NULL AND ts IS NOT NULL")


_LITERAL = T.StructType([T.StructField(c, T.StringType()) for c in ("asin", "title", "description", "brand", "image")] + [T.StructField("categories", T.ArrayType(T.StringType()))])


@F.pandas_udf(_LITERAL)
def _literal(lines: pd.Series) -> pd.DataFrame:
    """Python literals as rows; lines that are none give nulls."""

    def of(line: str) -> tuple:
        try:
            d = ast.literal_eval(line)
            text = lambda k: None if d.get(k) is None else str(d[k])
            return text("asin"), text("title"), text("description"), text("brand"), text("imUrl"), [x.strip() for x in (d.get("categories") or [[]])[0] if "</span>" not in x]
        except (ValueError, SyntaxError, TypeError, AttributeError):
            return (None,) * 6

    return pd.DataFrame([of(x) for x in lines], columns=[f.name for f in _LITERAL.fields])


def read_amazon_metadata(spark: SparkSession, path: str, version: int = 18) -> DataFrame:
    """item, title, description, brand, categories (comma-joined), images, image; version 18 is JSON, 14 Python literals; the last of equal items wins."""
    if version == 18:
        schema = "asin string, title string, description array<string>, brand string, category array<string>, imageURLHighRes array<string>"
        df = _in_line_order(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path))
        d = df.select(
            F.col("asin").alias("item"), "title", F.array_join("description", " ").alias("description"), "brand",
            F.array_join(F.transform(F.filter("category", lambda c: ~c.contains("</span>")), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), ",").alias("categories"), F.col("imageURLHighRes").alias("images"), F.lit(None).cast("string").alias("image"), "_file", "_line",
        )
    else:
        df = _in_line_order(spark.read.text(path)).withColumn("d", _literal("value"))
        d = df.select(F.col("d.asin").alias("item"), "d.title", "d.description", "d.brand", F.array_join("d.categories", ",").alias("categories"), F.lit(None).cast("array<string>").alias("images"), "d.image", "_file", "_line")
    # trimmed of any white space, as entries and brands are
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    d = d.where("item <> ''").withColumns({"categories": trimmed(F.col("categories")), "title": clean_text(F.col("title")), "description": clean_text(F.col("description")), "brand": trimmed(F.replace("brand", F.lit("by\n"), F.lit("")))})
    return _last_of(d, "item")


def read_movielens_ratings(spark: SparkSession, path: str, csv: bool = False) -> DataFrame:
    """user::movie::rating::time lines, or CSV below a header, as (user, item, rating, ts)."""
    if csv:
        df = spark.read.option("header", True).csv(path)
        f = df.select(F.array(*[F.col(c) for c in df.columns]).alias("f"))
    else:
        f = spark.read.text(path).select(F.split("value", "::").alias("f"))
    rows = f.where(F.size("f") >= 4).select(_field(0).alias("user"), _field(1).alias("item"), _field(2).try_cast("double").alias("rating"), _field(3).try_cast("long").alias("ts"))
    return rows.where("rating IS NOT NULL AND ts IS NOT NULL")


def movie_fields(raw: Column, genres: Column) -> dict[str, Column]:
    """title without its year, year, genres, description."""
    year = F.regexp_extract(raw, r"\((\d{4})\)$", 1)
    title = F.trim(F.regexp_replace(raw, r"\s*\(\d{4}\)$", ""))
    parts = F.filter(F.split(genres, r"\|"), lambda g: g != "")
    text = F.concat(title, F.when(year != "", F.concat(F.lit(" ("), year, F.lit(")"))).otherwise(""), F.when(F.size(parts) > 0, F.concat(F.lit(". Genres: "), F.array_join(parts, ", "))).otherwise(""))
    return {"title": title, "year": F.nullif(year, F.lit("")).cast("int"), "genres": parts, "description": text}


def read_movielens_movies(spark: SparkSession, path: str, csv: bool = False) -> DataFrame:
    if csv:
        df = spark.read.option("header", True).option("escape", '"').csv(path)
        f = df.select(F.array(*[F.col(c) for c in df.columns]).alias("f"))
    else:
        f = spark.read.text(path).select(F.split("value", "::").alias("f"))
    f = f.where(F.size("f") >= 3)
    return f.select(_field(0).alias("item"), *[c.alias(n) for n, c in movie_fields(F.trim(_field(1)), _field(2)).items()])


def read_item_json(spark: SparkSession, path: str, fields: str = "title string, description string, brand string, categories string", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A JSON object {id: {...}} as a row an item, read in byte ranges, so that one large file is many tasks."""
    rows = read_members(spark, path, range_bytes)
    return rows.select(F.col("name").alias("item"), F.from_json("value", fields).alias("m")).select("item", "m.*")


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """item, idx from two-column lines; an empty map is an error."""
    f = spark.read.text(path).select(F.split(F.trim("value"), "\t", -1).alias("f")).where(F.size("f") == 2)
    rows = f.select(_field(0).alias("item"), _field(1).try_cast("long").alias("idx"))
    if rows.isEmpty():
        raise ValueError("the id map is empty")
    return rows


def read_embedding_matrix(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """item_id (the row's place), embedding from a .npy file, or from all of a folder in the order of their names; ranges of rows are tasks."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("npy_matrix").option("rangeBytes", range_bytes).load(path)


def read_codebook(spark: SparkSession, path: str, width: int) -> DataFrame:
    """item_id, codes from Parquet; tuples of another width are an error."""
    wrong = F.raise_error(F.concat(F.lit("codes of another width for item "), F.col("item_id").cast("string"))).cast("array<int>")
    df = spark.read.parquet(path)
    return df.withColumn("codes", F.when(F.size("codes") == width, F.col("codes")).otherwise(wrong))


def read_samples(spark: SparkSession, path: str, max_len: int = 50) -> DataFrame:
    """JSON lines {user, history, target} with numeric ids, histories padded or cut."""
    df = spark.read.schema("user string, history array<string>, target string").json(path)
    history = F.transform("history", lambda x: x.cast("long"))
    return df.select(F.col("user").cast("long").alias("user"), pad_or_truncate(history, max_len).alias("history"), F.col("target").cast("long").alias("target"))


def read_sequence_parquet(spark: SparkSession, path: str, mode: str, max_len: int = 50) -> DataFrame:
    """history and target arrays of Parquet sequences: all prefixes for train, the last target alone for evaluation."""
    df = spark.read.parquet(path).select(F.concat("history", F.array("target")).alias("s"))
    if mode == "train":
        each = df.select("s", F.explode(F.sequence(F.lit(1), F.size("s") - 1)).alias("n")).where(F.size("s") > 1)
        return each.select(pad_or_truncate(F.slice("s", F.lit(1), F.col("n")), max_len).alias("history"), F.get("s", F.col("n")).alias("target"))
    if mode == "evaluation":
        return df.select(pad_or_truncate(F.slice("s", F.lit(1), F.size("s") - 1), max_len).alias("history"), F.element_at("s", -1).alias("target"))
    raise ValueError(f"no mode {mode!r}")
