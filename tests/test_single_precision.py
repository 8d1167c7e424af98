"""Products of single numbers that stand between two whole ones."""

import duckdb

from lumenrec.plans import registry

from .conftest import plain


def test_matrix_rounds_single_products(spark, tmp_path):
    """-0.1335 as a single number times 1000 is -133.5, as a double -133.49999487."""
    rows = [(4, [-0.1335, 0.1925, 1.0]), (9, [-0.2765, 0.0004, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "0 AS label").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    name = "embedding_matrix_roundtrip"
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert sorted(got["embedding"]) == ["-134,193,1000", "-277,0,0"]
    assert plain(got) == plain(con.sql(registry.ORACLES[name]).df())
