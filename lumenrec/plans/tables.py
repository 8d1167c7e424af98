"""Logical tables of the recommendation operators, derived from the given ones, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrec.operators import interactions as I

DAY = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_interactions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    ts = (F.unix_date(F.to_date("o_orderdate")).cast("long") * DAY).alias("ts")
    return j.select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("rating"), ts, F.col("l_linenumber").alias("line"))


def interactions(spark: SparkSession, d: str) -> DataFrame:
    return raw_interactions(spark, d).drop("line")


def ordered(spark: SparkSession, d: str) -> DataFrame:
    """First interactions in each user's order."""
    return I.in_order(I.first_interactions(interactions(spark, d))).drop("rating", "ts")


def splits(spark: SparkSession, d: str) -> DataFrame:
    return I.leave_two_out(I.user_sequences(ordered(spark, d)))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """item, title, brand, categories of parts above size 5."""
    p = table(spark, d, "part").where("p_size > 5")
    path = F.concat("p_type", F.lit(","), F.replace(F.col("p_name"), F.lit(" "), F.lit(",")))
    return p.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), path.alias("categories"))


def part_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_partkey").alias("idx"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where("p_partkey % 5 <> 0")
    names = F.array(F.concat(F.lit("img_"), F.col("p_partkey").cast("string"), F.lit(".jpg")), F.concat(F.lit("alt_"), F.col("p_partkey").cast("string"), F.lit(".jpg")))
    return p.select(F.col("p_partkey").alias("item"), names.alias("files"))


def listing(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    one = p.where("p_partkey % 7 <> 0").select(F.concat(F.lit("img_"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("name"), (F.col("p_size") - 3).alias("size"))
    return one.unionByName(p.select(F.concat(F.lit("alt_"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("name"), F.lit(1).alias("size")))


def base_codes(spark: SparkSession, d: str, first: int = 4) -> DataFrame:
    brand = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("int")
    codes = F.array((F.col("p_size") % first).cast("int"), brand % 4, (F.col("p_partkey") % 3).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), codes.alias("codes"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


def truth(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """user, item_id (from 1): each user's last item; rows: ordered(), if it is there already."""
    rows = ordered(spark, d) if rows is None else rows
    return rows.where("n >= 3 AND pos = n - 1").select("user", (F.col("item") + 1).alias("item_id"))


def candidates(spark: SparkSession, d: str, true: DataFrame | None = None) -> DataFrame:
    """user, rank (from 1), item_id (from 1), score: 30 a user, the true one among them for three in four users."""
    n = table(spark, d, "part").agg(F.count("*").alias("n"))
    t = truth(spark, d) if true is None else true
    r = t.join(F.broadcast(n)).select("user", "item_id", "n", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("r"))
    made = (7 * F.col("user") + 13 * F.col("r")) % F.col("n") + 1
    item = F.when(F.col("r") == F.col("user") % 40, F.col("item_id")).otherwise(made)
    return r.select("user", (F.col("r") + 1).cast("long").alias("rank"), item.alias("item_id"), (F.lit(1.0) / (F.col("r") + 1)).alias("score"))


RAW = """SELECT o_custkey AS "user", l_partkey AS item, l_quantity AS rating, CAST(epoch(o_orderdate) AS BIGINT) AS ts, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def _first(source: str) -> str:
    return f"""SELECT "user", item, rating, ts, row_number() OVER (PARTITION BY "user" ORDER BY ts, item) - 1 AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY "user", item ORDER BY ts, rating) AS k FROM {source}) WHERE k = 1"""


#: CTEs by name; cte() puts those that a query needs before it.
CTES = {
    "raw": RAW,
    "ordered": _first("raw"),
    "seq": """SELECT "user", list(item ORDER BY pos) AS items FROM ordered GROUP BY "user" HAVING count(*) >= 3""",
    "splits": """SELECT "user", items[:len(items) - 2] AS train, items[len(items) - 1] AS valid, items[len(items)] AS test FROM seq""",
    "meta": """SELECT p_partkey AS item, p_name AS title, p_brand AS brand, p_type || ',' || replace(p_name, ' ', ',') AS categories FROM part WHERE p_size > 5""",
    "codes": """SELECT p_partkey AS item_id, [p_size % 4, CAST(replace(p_brand, 'Brand#', '') AS INT) % 4, CAST(p_partkey % 3 AS INT)] AS codes FROM part""",
    "digits": """SELECT item_id, list_append(codes, CAST((row_number() OVER (PARTITION BY codes ORDER BY item_id) - 1) % 64 AS INT)) AS codes FROM codes""",
    "tokens": """SELECT item_id + 1 AS item_id, [codes[1] + 1, codes[2] + 5, codes[3] + 9, codes[4] + 13] AS tokens FROM digits""",
    "truth": """SELECT "user", test + 1 AS item_id FROM splits""",
    "cand": """SELECT t."user", r + 1 AS rank, CASE WHEN r = t."user" % 40 THEN t.item_id ELSE (7 * t."user" + 13 * r) % (SELECT count(*) FROM part) + 1 END AS item_id, 1.0::DOUBLE / (r + 1) AS score FROM truth t, range(0, 30) x(r)""",
    "cates": """SELECT p_partkey + 1 AS item_id, p_partkey % 11 AS cate_id FROM part WHERE p_partkey % 13 <> 0""",
}
_NEEDS = {"ordered": ["raw"], "seq": ["ordered"], "splits": ["seq"], "digits": ["codes"], "tokens": ["digits"], "truth": ["splits"], "cand": ["truth"]}


def cte(*names: str, **more: str) -> str:
    """WITH and the named CTEs, those they need first; more: further ones by name."""
    order: list[str] = []

    def need(n: str) -> None:
        for x in _NEEDS.get(n, []):
            need(x)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in [*((n, CTES[n]) for n in order), *more.items()]) + "\n"
