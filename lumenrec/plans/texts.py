"""Queries on item text, images, alignment and embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenrec.operators import embeddings as E
from lumenrec.operators import linear as L
from lumenrec.operators import text as X

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


def _clean(c: str) -> str:
    return rf"""trim(replace(regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), '"', ''))"""


_ENTITIES = "html"
for _name, _char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
    _ENTITIES = f"replace({_ENTITIES}, '{_name}', '{_char}')"


@query(f"SELECT doc_id, {_clean('text')} AS text FROM documents")
def clean_text(spark, d):
    return T.table(spark, d, "documents").select("doc_id", X.clean_text(F.col("text"), entities=False).alias("text"))


@query(f"SELECT page_id, {_clean(_ENTITIES)} AS text FROM pages")
def clean_html(spark, d):
    return T.table(spark, d, "pages").select("page_id", X.clean_text(F.col("html")).alias("text"))


@query(cte("meta") + "SELECT p_partkey AS item, p_partkey AS idx, coalesce(title || ' ' || brand || ' ' || categories, 'N/A') AS text FROM part LEFT JOIN meta ON p_partkey = item")
def item_text(spark, d):
    return X.build_item_text(T.part_ids(spark, d), T.metadata(spark, d), ["title", "brand", "categories"])


@query(r"""SELECT p_partkey AS item, p_partkey AS idx, coalesce(p_name || ' & Co ' || p_type || ' & more, ' || p_brand || ', ©é ' || p_size || '<', 'N/A') AS text FROM part""")
def item_text_lists(spark, d):
    """Entities and tags in plain fields and in the entries of a list."""
    p = T.table(spark, d, "part")
    name = F.concat("p_name", F.lit(" &amp; <i>Co</i>"))
    entries = F.array(F.concat("p_type", F.lit(" &#38; more")), F.lit(" "), F.concat(F.lit("<b>"), "p_brand", F.lit("</b>")), F.concat(F.lit("&copy&eacute; "), F.col("p_size").cast("string"), F.lit("&#x3c;")))
    meta = p.select(F.col("p_partkey").alias("item"), name.alias("title"), entries.alias("categories"))
    return X.build_item_text(T.part_ids(spark, d), meta, ["title", "categories"])


@query("""SELECT page_id AS item, CASE WHEN url LIKE 'http%' THEN 1 ELSE 0 END::BIGINT AS n, CASE WHEN url LIKE 'http%' THEN right(regexp_extract(url, '([^/]*)$', 1), 200) ELSE '' END AS files FROM pages""")
def image_urls(spark, d):
    p = T.table(spark, d, "pages").select(F.col("page_id").alias("item"), F.lit(None).cast("array<string>").alias("images"), F.col("url").alias("image"))
    return X.select_image_urls(p).select("item", F.size("urls").cast("long").alias("n"), F.array_join("files", ",").alias("files"))


@query(cte("meta") + "SELECT item, title FROM meta WHERE item IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def reviewed_items(spark, d):
    reviews = T.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("item"))
    return X.reviewed_items(T.metadata(spark, d), reviews).select("item", "title")


@query("SELECT count(*) AS items, CAST(sum(CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS without, round(1 - sum(CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) / count(*), 9) AS coverage FROM part")
def image_coverage(spark, d):
    return X.image_coverage(T.part_ids(spark, d), T.manifest(spark, d)).withColumn("coverage", F.round("coverage", 9))


_ROWS = "SELECT p_partkey AS item, p_partkey AS idx, p_size > 5 AS has_meta, p_partkey % 5 <> 0 AS has_image, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS has_file FROM part"


@query(_ROWS)
def alignment_rows(spark, d):
    return X.alignment_rows(T.part_ids(spark, d), T.metadata(spark, d), T.manifest(spark, d), T.listing(spark, d))


@query(f"""SELECT count(*) AS items, count(*) FILTER (NOT has_meta) AS meta_missing, count(*) FILTER (has_image) AS image_covered, count(*) FILTER (has_image AND NOT has_file) AS file_missing,
  round(count(*) FILTER (has_file) / count(*), 9) AS coverage FROM ({_ROWS})""")
def alignment_audit(spark, d):
    return X.alignment_audit(alignment_rows(spark, d)).withColumn("coverage", F.round("coverage", 9))


@query(f"SELECT * FROM ({_ROWS}) ORDER BY md5('42|' || item), item LIMIT 5")
def alignment_sample(spark, d):
    return X.alignment_sample(alignment_rows(spark, d))


@query("SELECT p_partkey AS item, CASE WHEN p_partkey % 7 <> 0 AND p_size > 3 THEN 'img_' ELSE 'alt_' END || p_partkey || '.jpg' AS file FROM part WHERE p_partkey % 5 <> 0")
def first_image(spark, d):
    return X.first_existing_image(T.manifest(spark, d), T.listing(spark, d))


@query()
def embed_documents(spark, d):
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return E.embed_batches(docs, 64).select("item_id", F.size("embedding").alias("dim"), F.round(E.l2_norm(F.col("embedding")), 5).alias("norm"))


def letter_counts(texts):
    """An encoder that SQL can follow: how often each letter from a to z stands in a text."""
    return np.array([[t.count(chr(c)) for c in range(97, 123)] for t in texts])


@query("SELECT doc_id AS item_id, array_to_string(list_transform(range(97, 123), lambda c: len(t) - len(replace(t, chr(CAST(c AS INT)), ''))), ',') AS letters FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def letter_vectors(spark, d):
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    v = E.embed_batches(docs, 26, letter_counts)
    return v.select("item_id", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("letters"))


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12))"


@query(f"""SELECT p_partkey AS item_id, CAST(len(embedding) AS INT) AS dim, round(list_sum({_UNIT}), 6) AS total FROM (
  SELECT p_partkey, coalesce(embedding, list_transform(range(0, 64), lambda i: 0::FLOAT)) AS embedding FROM part LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 9 <> 0) ON p_partkey = vec_id)""")
def align_embeddings(spark, d):
    """Every third id has a second vector, which an earlier place keeps from counting."""
    ids = T.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    v = T.vectors(spark, d).drop("label").where("item_id % 9 <> 0").withColumn("place", F.lit(1))
    more = v.where("item_id % 3 = 0").select("item_id", F.reverse("embedding").alias("embedding"), F.lit(0).alias("place"))
    v = E.align_embeddings(ids, v.unionByName(more), 64, unit=True, order="place")
    return v.select("item_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query()
def pca_embeddings(spark, d):
    """The values of 16 components, rounded, and the variance that they keep."""
    rows, kept = E.standardize_pca(T.vectors(spark, d), 16)
    return rows.select("item_id", F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"), F.lit(round(kept, 6)).alias("kept_variance"))


@query("""SELECT CAST(i - 1 AS INT) AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round((SELECT count(*) FROM embeddings), 0)::BIGINT AS n FROM (SELECT unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY i""")
def embedding_moments(spark, d):
    v = T.vectors(spark, d)
    mean, covariance, n = L.moments(v, np.array(v.first()["embedding"], dtype=float))
    rows = [(i, round(float(m), 6), round(float(np.sqrt(c)), 6), n) for i, (m, c) in enumerate(zip(mean, np.diag(covariance)))]
    return spark.createDataFrame(rows, "dim int, mean double, std double, n long")  # a row a dimension


@query(f"""SELECT vec_id AS item_id, round(list_sum(list_transform({_UNIT}, lambda x: 0.7 * x)) + list_sum(list_transform(list_reverse({_UNIT}), lambda x: 0.3 * x)), 6) AS total FROM embeddings""")
def fused_embeddings(spark, d):
    v = T.vectors(spark, d).drop("label")
    fused = E.fuse_modalities(v, v.select("item_id", F.reverse("embedding")), 0.7, 0.3)
    return fused.select("item_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(cte("ordered", p="""SELECT a.item AS x, b.item AS y FROM ordered a JOIN ordered b ON a."user" = b."user" AND b.pos BETWEEN a.pos - 3 AND a.pos + 3 AND a.item <> b.item""") + "SELECT x AS item_id, y AS other, count(*) AS n FROM p GROUP BY x, y")
def item_cooccurrence(spark, d):
    return E.item_cooccurrence(T.ordered(spark, d), 3)


@query()
def cf_vectors(spark, d):
    """The values of 16 factors, rounded, and the share of the matrix's largest eigenvalue that the last one has."""
    v, values = E.cf_item_vectors(T.ordered(spark, d), 16)
    return v.select("item_id", F.transform("embedding", lambda x: F.round(x, 4)).alias("embedding"), F.lit(round(float(abs(values[-1] / values[0])), 3)).alias("last_by_first"))


@query("SELECT vec_id AS item_id, CAST('0x' || substr(md5('42|' || vec_id), 1, 8) AS BIGINT) % 1000000 < 50000 AS is_validation FROM embeddings")
def vector_split(spark, d):
    return E.train_validation_split(T.vectors(spark, d)).select("item_id", "is_validation")
