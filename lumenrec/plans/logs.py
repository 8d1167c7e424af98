"""Queries on interaction logs, and round trips through sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenrec.functions.staging import new_path
from lumenrec.operators import interactions as I
from lumenrec.operators.tokens import padded_histories as pad_histories
from lumenrec.sources import byteranges, readers, writers

from . import tables as T
from .tables import cte

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(cte("raw") + """SELECT DISTINCT "user", item, rating, ts FROM raw""")
def distinct_interactions(spark, d):
    return I.distinct_interactions(T.interactions(spark, d))


@query(cte("ordered") + """SELECT "user", item, rating, ts, pos FROM ordered""")
def first_interactions(spark, d):
    return I.in_order(I.first_interactions(T.interactions(spark, d))).select("user", "item", "rating", "ts", "pos")


@query(cte("raw", "meta") + """SELECT DISTINCT "user", item, rating, ts FROM raw WHERE item IN (SELECT item FROM meta)""")
def filtered_interactions(spark, d):
    return I.filter_by_metadata(I.distinct_interactions(T.interactions(spark, d)), T.metadata(spark, d)).select("user", "item", "rating", "ts")


@query(cte("ordered") + """SELECT 'user' AS unit, "user" AS id, count(*) AS n FROM ordered GROUP BY "user" UNION ALL SELECT 'item', item, count(*) FROM ordered GROUP BY item""")
def degree_counts(spark, d):
    df = I.first_interactions(T.interactions(spark, d))
    return I.degree_counts(df, "user").select(F.lit("user").alias("unit"), F.col("user").alias("id"), "n").unionByName(I.degree_counts(df, "item").select(F.lit("item").alias("unit"), F.col("item").alias("id"), "n"))


def _core(rounds: int, k: int = 20) -> dict[str, str]:
    of = lambda n: "ordered" if n == 0 else f"core{n}"
    return {of(n): f"""SELECT * FROM {of(n - 1)} WHERE "user" IN (SELECT "user" FROM {of(n - 1)} GROUP BY "user" HAVING count(*) >= {k}) AND item IN (SELECT item FROM {of(n - 1)} GROUP BY item HAVING count(*) >= {k})""" for n in range(1, rounds + 1)}


@query(cte("ordered", **_core(8)) + """SELECT "user", item, rating, ts FROM core8""")
def kcore_interactions(spark, d):
    return I.k_core(I.first_interactions(T.interactions(spark, d)), 20, 20)


@query(cte("ordered", "meta") + """SELECT count(DISTINCT "user") AS users, count(DISTINCT item) AS items, count(*) AS interactions,
  1 - count(*) / (count(DISTINCT "user")::DOUBLE * count(DISTINCT item)) AS sparsity, (SELECT count(*) FROM meta WHERE item IN (SELECT item FROM ordered)) AS items_with_meta FROM ordered""")
def dataset_stats(spark, d):
    return I.dataset_stats(I.first_interactions(T.interactions(spark, d)), T.metadata(spark, d))


@query(cte("raw") + """SELECT 'user' AS unit, key, row_number() OVER (ORDER BY key) - 1 AS idx FROM (SELECT DISTINCT 'U' || "user" AS key FROM raw)
UNION ALL SELECT 'item', key, row_number() OVER (ORDER BY key) - 1 FROM (SELECT DISTINCT 'P' || item AS key FROM raw)""")
def dense_ids(spark, d):
    df = T.interactions(spark, d).select(F.concat(F.lit("U"), F.col("user").cast("string")).alias("user"), F.concat(F.lit("P"), F.col("item").cast("string")).alias("item"))
    of = lambda c: I.dense_ids(df, c).select(F.lit(c).alias("unit"), F.col(c).alias("key"), "idx")
    return of("user").unionByName(of("item"))


@query(cte("ordered") + """SELECT "user", array_to_string(list(item ORDER BY pos), ',') AS items, count(*) AS n FROM ordered GROUP BY "user" """)
def user_sequences(spark, d):
    return I.user_sequences(T.ordered(spark, d)).select("user", joined("items").alias("items"), F.size("items").cast("long").alias("n"))


@query(cte("splits") + """SELECT "user", array_to_string(train, ',') AS train, valid, test FROM splits""")
def leave_two_out(spark, d):
    return T.splits(spark, d).select("user", joined("train").alias("train"), "valid", "test")


@query(cte("ordered") + """SELECT "user", pos, history, target FROM (
  SELECT "user", pos, item AS target, count(*) OVER (PARTITION BY "user") AS n, array_to_string(list(item) OVER (PARTITION BY "user" ORDER BY pos ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), ',') AS history FROM ordered)
WHERE pos >= 1 AND pos < n - 2""")
def sliding_window_samples(spark, d):
    s = I.sliding_window_samples(T.ordered(spark, d))
    return s.select("user", "pos", joined("history").alias("history"), "target")


@query(cte("splits") + """SELECT "user", array_to_string(list_slice(train, greatest(len(train) - 50, 1), len(train) - 1), ',') AS history, train[len(train)] AS target FROM splits""")
def last_target_samples(spark, d):
    return I.last_target_samples(T.ordered(spark, d)).select("user", joined("history").alias("history"), "target")


@query(cte("splits") + """SELECT "user", 'valid' AS split, array_to_string(list_slice(train, greatest(len(train) - 49, 1), len(train)), ',') AS history, valid AS target FROM splits
UNION ALL SELECT "user", 'test', array_to_string(list_slice(list_append(train, valid), greatest(len(train) - 48, 1), len(train) + 1), ','), test FROM splits""")
def eval_samples(spark, d):
    return I.eval_samples(T.ordered(spark, d)).select("user", "split", joined("history").alias("history"), "target")


@query(cte("splits") + """SELECT "user", array_to_string(CASE WHEN len(train) >= 20 THEN list_slice(train, len(train) - 19, len(train)) ELSE list_concat(list_transform(range(0, 20 - len(train)), lambda i: 0::BIGINT), train) END, ',') AS history FROM splits""")
def padded_histories(spark, d):
    return pad_histories(I.training_histories(T.ordered(spark, d), 20), 20).select("user", joined("history").alias("history"))


@query(cte("raw", "meta") + """SELECT i.idx, m.item, m.title, m.brand, m.categories FROM (SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT item FROM raw)) i JOIN meta m ON i.item = m.item""")
def item_features(spark, d):
    return I.item_features(I.dense_ids(T.interactions(spark, d), "item"), T.metadata(spark, d))


# --- written by Spark into the shared folder and read back -----------------------------------------


@query(cte("raw") + """SELECT CAST("user" AS VARCHAR) AS "user", CAST(item AS VARCHAR) AS item, rating, ts FROM raw""")
def ratings_csv_roundtrip(spark, d):
    path = new_path(spark, "ratings")
    T.interactions(spark, d).select(F.concat_ws(",", "item", "user", "rating", "ts")).write.text(path)
    return readers.read_ratings_csv(spark, path)


@query(ORACLES["ratings_csv_roundtrip"])
def recbole_inter_roundtrip(spark, d):
    """Below a header of any wording, with tabs and blanks around some lines."""
    path = new_path(spark, "inter")
    r = T.interactions(spark, d)
    around = lambda n, m: F.when(F.col("item") % n == m, F.lit("\t")).when(F.col("item") % n == m + 1, F.lit(" ")).otherwise("")
    line = F.concat(around(3, 0), F.concat_ws("\t", "user", "item", "rating", F.col("ts").cast("double")), around(5, 1))
    r.select(line.alias("user:token\titem:token\trating:float\ttimestamp:float")).write.option("header", True).option("sep", "\x01").option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_recbole_inter(spark, path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS title, CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS brand FROM part")
def recbole_items_roundtrip(spark, d):
    path = new_path(spark, "items")
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("item_id:token"), F.col("p_name").alias("title:token_seq"), F.when(F.col("p_brand") == "Brand#1", "None").otherwise(F.col("p_brand")).alias("brand:token"))
    p.write.option("sep", "\t").option("header", True).csv(path)
    return readers.read_recbole_items(spark, path).select("item_id", F.col("fields")["title"].alias("title"), F.col("fields")["brand"].alias("brand"))


@query(ORACLES["ratings_csv_roundtrip"])
def reviews_json_roundtrip(spark, d):
    path = new_path(spark, "reviews")
    r = T.interactions(spark, d).select(F.col("item").cast("string").alias("asin"), F.col("user").cast("string").alias("reviewerID"), F.col("rating").alias("overall"), F.col("ts").alias("unixReviewTime"))
    r.write.option("compression", "gzip").json(path)
    return readers.extract_ratings_from_reviews(spark, path)


_META = """SELECT CAST(item AS VARCHAR) AS item, title, 'about ' || title AS description, brand, categories FROM meta"""


def _meta_rows(spark, d):
    m = T.metadata(spark, d)
    return m.select(F.col("item").cast("string").alias("asin"), "title", F.concat(F.lit("about "), "title").alias("about"), "brand", F.split("categories", ",").alias("path"))


@query(cte("meta") + _META)
def amazon_metadata_json_roundtrip(spark, d):
    path = new_path(spark, "meta")
    _meta_rows(spark, d).select("asin", "title", F.split("about", " ").alias("description"), F.concat(F.lit("by\n"), "brand").alias("brand"), F.concat("path", F.array(F.lit("</span>x"))).alias("category")).write.option("compression", "gzip").json(path)
    return readers.read_amazon_metadata(spark, path).select("item", "title", "description", "brand", "categories")


@query(cte("meta") + _META)
def amazon_metadata_literal_roundtrip(spark, d):
    path = new_path(spark, "meta")
    q = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    path_text = F.concat(F.lit("[['"), F.array_join("path", "', '"), F.lit("']]"))
    line = F.concat(F.lit("{'asin': "), q("asin"), F.lit(", 'title': "), q("title"), F.lit(", 'description': "), q("about"), F.lit(", 'brand': "), q("brand"), F.lit(", 'categories': "), path_text, F.lit("}"))
    _meta_rows(spark, d).select(line).write.option("compression", "gzip").text(path)
    return readers.read_amazon_metadata(spark, path, 14).select("item", "title", "description", "brand", "categories")


@query(ORACLES["ratings_csv_roundtrip"])
def movielens_ratings_roundtrip(spark, d):
    path = new_path(spark, "ratings")
    T.interactions(spark, d).select(F.concat_ws("::", "user", "item", "rating", "ts")).write.text(path)
    return readers.read_movielens_ratings(spark, path)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS item, p_name AS title, CAST(1950 + p_size AS INT) AS year, replace(p_name, ' ', '|') AS genres, p_name || ' (' || (1950 + p_size) || '). Genres: ' || replace(p_name, ' ', ', ') AS description FROM part""")
def movie_titles(spark, d):
    path = new_path(spark, "movies")
    p = T.table(spark, d, "part")
    raw = F.concat("p_name", F.lit(" ("), (F.col("p_size") + 1950).cast("string"), F.lit(")"))
    p.select(F.concat_ws("::", F.col("p_partkey").cast("string"), raw, F.replace(F.col("p_name"), F.lit(" "), F.lit("|")))).write.text(path)
    return readers.read_movielens_movies(spark, path).withColumn("genres", F.array_join("genres", "|"))


@query("SELECT 'P' || p_partkey AS item, row_number() OVER (ORDER BY 'P' || p_partkey) - 1 AS idx FROM part")
def id_map_roundtrip(spark, d):
    path = new_path(spark, "item2id")
    ids = I.dense_ids(T.table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("item")), "item")
    writers.write_id_map(ids, path)
    return readers.read_id_map(spark, path)


@query(cte("splits") + """SELECT "user", array_to_string(CASE WHEN len(train) >= 50 THEN list_slice(train, len(train) - 49, len(train)) ELSE list_concat(list_transform(range(0, 50 - len(train)), lambda i: 0::BIGINT), train) END, ',') AS history, valid AS target FROM splits""")
def splits_roundtrip(spark, d):
    path = new_path(spark, "splits")
    writers.write_splits(path, valid=I.eval_samples(T.ordered(spark, d)).where("split = 'valid'"))
    return readers.read_samples(spark, f"{path}/valid").select("user", joined("history").alias("history"), "target")


@query(cte("seq") + """SELECT array_to_string(CASE WHEN n >= 20 THEN list_slice(items, n - 19, n) ELSE list_concat(list_transform(range(0, 20 - n), lambda i: 0::BIGINT), list_slice(items, 1, n)) END, ',') AS history, items[n + 1] AS target
FROM (SELECT items, unnest(range(1, len(items))) AS n FROM seq)""")
def sequence_parquet_samples(spark, d):
    path = new_path(spark, "sequences")
    s = I.user_sequences(T.ordered(spark, d)).where(F.size("items") >= 3)
    writers.write_sequences(s.select(F.slice("items", F.lit(1), F.size("items") - 1).alias("history"), F.element_at("items", -1).alias("target")), path)
    return readers.read_sequence_parquet(spark, path, "train", 20).select(joined("history").alias("history"), "target")


@query(cte("seq") + """SELECT array_to_string(CASE WHEN n >= 20 THEN list_slice(items, n - 19, n) ELSE list_concat(list_transform(range(0, 20 - n), lambda i: 0::BIGINT), list_slice(items, 1, n)) END, ',') AS history, items[n + 1] AS target
FROM (SELECT items, len(items) - 1 AS n FROM seq)""")
def sequence_parquet_evaluation(spark, d):
    path = new_path(spark, "sequences")
    s = I.user_sequences(T.ordered(spark, d)).where(F.size("items") >= 3)
    writers.write_sequences(s.select(F.slice("items", F.lit(1), F.size("items") - 1).alias("history"), F.element_at("items", -1).alias("target")), path)
    return readers.read_sequence_parquet(spark, path, "evaluation", 20).select(joined("history").alias("history"), "target")


@query("SELECT CAST(p_partkey AS VARCHAR) AS item, p_name AS title, 'about ' || p_name AS description, p_brand AS brand, p_type AS categories FROM part")
def item_json_roundtrip(spark, d):
    """Objects of at most 500 items, one a file."""
    path = new_path(spark, "item-json")
    p = T.table(spark, d, "part")
    fields = F.struct(F.col("p_name").alias("title"), F.concat(F.lit("about "), "p_name").alias("description"), F.col("p_brand").alias("brand"), F.col("p_type").alias("categories"))
    objects = p.groupBy(F.floor(F.col("p_partkey") / 500).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), fields))).alias("m"))
    objects.select("block", F.to_json("m")).write.partitionBy("block").text(path)
    return readers.read_item_json(spark, path, range_bytes=1 << 14)


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS item_id, array_to_string(list_transform(embedding, lambda x: CAST(round(x * 1000) AS BIGINT)), ',') AS embedding FROM embeddings")
def embedding_matrix_roundtrip(spark, d):
    """Vectors as .npy files, read back in ranges of 16 KB."""
    path = new_path(spark, "matrix")
    byteranges.write_matrix(T.vectors(spark, d), path)
    rows = readers.read_embedding_matrix(spark, path, 1 << 14)
    thousand = F.lit(1000).cast("float")  # the product is single, as the numbers are: before rounding, doubles differ from it
    return rows.select("item_id", joined(F.transform("embedding", lambda x: F.round(x * thousand).cast("long"))).alias("embedding"))


@query(cte("meta") + "SELECT item AS idx, title, brand, categories FROM meta")
def item_features_roundtrip(spark, d):
    path = new_path(spark, "features")
    features = I.item_features(T.part_ids(spark, d), T.metadata(spark, d))
    writers.write_item_features(features.select("idx", "title", "brand", "categories"), path)
    return spark.read.schema("idx long, title string, brand string, categories string").json(path)
