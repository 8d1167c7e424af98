"""Products with the matrix of what stands together, tile by tile."""

import numpy as np

from lumenrec.functions import staging
from lumenrec.operators import embeddings as E
from lumenrec.operators import interactions as I
from lumenrec.operators import linear as L


def test_tiles_over_several_blocks(spark):
    """Numbers of three blocks, pairs that repeat, numbers that meet themselves, one with nothing near."""
    r = np.random.default_rng(5)
    n = 2 * L.BLOCK + 500
    data = [(int(i), [int(j) for j in r.integers(0, n, r.integers(0, 4))] + [int(i)]) for i in r.integers(0, n, 3000)] + [(7, [n - 1] * 40), (n - 1, [7, 7]), (9, [])]
    tiles = L.tiled(spark.createDataFrame(data, "idx long, near array<long>").repartition(5), staging.new_path(spark, "tiles"))
    x, scale, turn = r.normal(size=(n, 3)), r.uniform(0.5, 2, n), r.normal(size=(3, 2))
    vectors = spark.createDataFrame([(i + 100, i, float(scale[i]), x[i].tolist()) for i in range(n)], "item_id long, idx long, scale double, embedding array<double>")
    path = staging.new_path(spark, "x")
    L.in_blocks(vectors, path)
    want, z = np.zeros((n, 2)), (x @ turn) * scale[:, None]
    for i, near in data:
        for j in near:
            if i != j:
                want[i] += z[j]
                want[j] += z[i]
    want *= scale[:, None]
    got = np.zeros((n, 2))
    for row in L.tile_sums(tiles, path, turn).collect():
        got[row.idx] += row.embedding
    assert np.allclose(got, want) and np.abs(want[[7, n - 1]]).min() > 0


def test_collaborative_vectors_keep_one_round(spark):
    """Of the rounds' vectors one table is left, of the matrix none; rows without an item take a place and give no vector."""
    data = [(u, int(i), 1.0, t) for u in range(40) for t, i in enumerate(np.random.default_rng(u).permutation(12)[:6])] + [(1, None, 1.0, 2)]
    o = I.in_order(spark.createDataFrame(data, "user long, item long, rating double, ts long"), 2)
    with staging.staged_tables(spark):
        found, _ = E.cf_item_vectors(o, dim=2, window=2, iterations=3)
        there = [p for p in staging._collected[-1] if _there(spark, p)]
        assert found.count() == 12
        names = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in there]
        assert names.count("factors") == 1 and "tiles" not in names and "cooccurrence" not in names


def _there(spark, path):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
