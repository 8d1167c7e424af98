"""Queries on quantizers, codebooks and tokens."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenrec.functions.staging import new_path, stage
from lumenrec.operators import interactions as I
from lumenrec.operators import linear as L
from lumenrec.operators import quantize as Q
from lumenrec.operators import tokens as K
from lumenrec.sources import readers, writers

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


def _means(rows, by):
    """A matrix of mean vectors, a row a group: groups times dimensions numbers reach the driver."""
    dims = rows.select(by.alias("g"), F.posexplode("embedding").alias("dim", "x")).groupBy("g", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    found = dims.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda v: v["m"]).alias("m")).collect()
    return np.array([r["m"] for r in sorted(found, key=lambda r: r["g"])])


def fixed_codebook(spark, d, v=None):
    """Vectors, their codes under two fixed levels of centroids, and the centroids as a table."""
    v = T.vectors(spark, d) if v is None else v
    c0 = _means(v, F.col("label"))
    codes0 = Q.encode_residual(v, c0[None])
    near = Q.reconstruct(codes0, Q.centroid_table(spark, c0[None])).withColumnRenamed("embedding", "near")
    left = v.join(near, "item_id").select("item_id", F.zip_with("embedding", "near", lambda x, c: x.cast("double") - c).alias("embedding"))
    c1 = _means(left, (F.col("item_id") % 8).cast("int"))
    books = [c0, c1]
    size = max(map(len, books))
    # unequal levels: missing codes stand too far off to be chosen
    padded = np.stack([np.concatenate([b, np.full((size - len(b), b.shape[1]), 1e6)]) for b in books])
    return v, Q.encode_residual(v, padded), Q.centroid_table(spark, padded)


_NEAR = "SELECT * FROM (SELECT item_id, e, {c}.code, c, row_number() OVER (PARTITION BY item_id ORDER BY list_distance(e, c), {c}.code) AS k FROM {v}, {c}) WHERE k = 1"
_MEAN = "SELECT g AS code, list(m ORDER BY dim) AS c FROM (SELECT g, dim, avg(x) AS m FROM (SELECT {g} AS g, unnest(range(1, 65)) AS dim, unnest(e) AS x FROM {v}) GROUP BY g, dim) GROUP BY g"
_FIXED = cte(
    v="SELECT vec_id AS item_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings",
    c0=_MEAN.format(g="label", v="v"),
    a0=_NEAR.format(v="v", c="c0"),
    r="SELECT item_id, code, list_transform(range(1, 65), lambda i: e[i] - c[i]) AS e FROM a0",
    c1=_MEAN.format(g="item_id % 8", v="r"),
    a1=_NEAR.format(v="r", c="c1"),
    b="SELECT a0.item_id, a0.e, a0.code AS x, a1.code AS y, a0.c AS cx, a1.c AS cy FROM a0 JOIN a1 ON a0.item_id = a1.item_id",
)


@query(_FIXED + "SELECT item_id, x || ',' || y AS codes FROM b")
def encode_fixed_centroids(spark, d):
    return fixed_codebook(spark, d)[1].select("item_id", joined("codes").alias("codes"))


#: The same for vectors scaled to mean 0 and deviation 1.
_SCALED = _FIXED.replace("v AS MATERIALIZED (", """w AS MATERIALIZED (SELECT vec_id AS item_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS MATERIALIZED (SELECT i, avg(x) AS mean, greatest(stddev_samp(x), 1e-6) AS std FROM w GROUP BY i),
v AS MATERIALIZED (SELECT item_id, label, list((x - mean) / std ORDER BY w.i) AS e FROM w JOIN m ON w.i = m.i GROUP BY item_id, label), unscaled AS (""", 1)


@query(_SCALED + """, z AS (SELECT item_id, unnest(range(1, 65)) AS i, unnest(cx) AS p, unnest(cy) AS q, x || ',' || y AS codes FROM b)
SELECT item_id, codes, round(sum((p + q) * std + mean), 4) AS total FROM z JOIN m ON z.i = m.i GROUP BY item_id, codes""")
def encode_scaled_vectors(spark, d):
    """Two fixed levels over scaled vectors, and what their codes make up in the vectors' own units."""
    v = T.vectors(spark, d)
    scale = Q.fit_scale(v)
    scaled = L.mapped(v, scale.of).join(v.select("item_id", "label"), "item_id")
    _, codes, books = fixed_codebook(spark, d, stage(scaled, "scaled"))
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total")
    return Q.reconstruct(codes, books, scale).join(codes, "item_id").select("item_id", joined("codes").alias("codes"), total)


@query(_FIXED + "SELECT item_id, round(list_sum(cx) + list_sum(cy), 5) AS total, 64 AS dim FROM b")
def reconstruct(spark, d):
    _, codes, books = fixed_codebook(spark, d)
    rows = Q.reconstruct(codes, books)
    return rows.select("item_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size("embedding").alias("dim"))


@query(_FIXED + """SELECT round(avg(q * q), 6) AS mse, round(avg(abs(q)), 6) AS l1, round((avg(p * p) + avg(q * q)) / 2, 6) AS commitment
FROM (SELECT unnest(list_transform(range(1, 65), lambda i: e[i] - cx[i])) AS p, unnest(list_transform(range(1, 65), lambda i: e[i] - cx[i] - cy[i])) AS q FROM b)""")
def quantization_loss(spark, d):
    v, codes, books = fixed_codebook(spark, d)
    loss = Q.quantization_loss(v, codes, books)
    return loss.select(*[F.round(c, 6).alias(c) for c in ("mse", "l1", "commitment")])


def _lloyd_in_sql(v: str, start: str, out: str) -> dict[str, str]:
    """Two rounds from the centroids in start, then the codes, as CTEs of which the last is named out."""
    return {
        f"{out}1": _NEAR.format(v=v, c=start), f"{out}c1": _MEAN.format(g="code", v=f"{out}1"),
        f"{out}2": _NEAR.format(v=v, c=f"{out}c1"), f"{out}c2": _MEAN.format(g="code", v=f"{out}2"), out: _NEAR.format(v=v, c=f"{out}c2"),
    }


_VECTORS = dict(v="SELECT vec_id AS item_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings")


@query(cte(
    **_VECTORS, s0=_MEAN.format(g="label", v="v"), s1="SELECT code, list_transform(c, lambda x: x / 4) AS c FROM s0", **_lloyd_in_sql("v", "s0", "x"),
    r="SELECT item_id, list_transform(range(1, 65), lambda i: e[i] - c[i]) AS e FROM x", **_lloyd_in_sql("r", "s1", "y"),
) + "SELECT x.item_id, x.code || ',' || y.code AS codes FROM x JOIN y ON x.item_id = y.item_id")
def rkmeans_from_start(spark, d):
    """Two levels of two rounds each from the labels' mean vectors."""
    v = T.vectors(spark, d)
    means = _means(v, F.col("label"))
    books = Q.fit_residual_kmeans(v, 2, len(means), iterations=2, start=np.stack([means, means / 4]))
    return Q.encode_residual(v, books).select("item_id", joined("codes").alias("codes"))


_PART_NEAR = "SELECT * FROM (SELECT item_id, w.part, e, b.code, row_number() OVER (PARTITION BY item_id, w.part ORDER BY list_distance(e, b.c), b.code) AS k FROM w JOIN {c} b ON b.part = w.part) WHERE k = 1"
_PART_MEAN = "SELECT part, code, list(m ORDER BY dim) AS c FROM (SELECT part, code, dim, avg(x) AS m FROM (SELECT part, {g} AS code, unnest(range(1, 17)) AS dim, unnest(e) AS x FROM {v}) GROUP BY part, code, dim) GROUP BY part, code"


@query(cte(
    **_VECTORS, w="SELECT item_id, label, part, e[part * 16 + 1:part * 16 + 16] AS e FROM v, range(0, 4) p(part)", c0=_PART_MEAN.format(g="label", v="w"),
    a1=_PART_NEAR.format(c="c0"), c1=_PART_MEAN.format(g="code", v="a1"), a2=_PART_NEAR.format(c="c1"), c2=_PART_MEAN.format(g="code", v="a2"), a=_PART_NEAR.format(c="c2"),
) + "SELECT item_id, string_agg(CAST(code AS VARCHAR), ',' ORDER BY part) AS codes FROM a GROUP BY item_id")
def pq_from_start(spark, d):
    """Four parts, two rounds from the labels' mean vectors."""
    v = T.vectors(spark, d)
    means = _means(v, F.col("label"))
    books = Q.fit_pq(v, 4, len(means), iterations=2, start=np.stack(np.split(means, 4, axis=1)))
    return Q.encode_pq(v, books).select("item_id", joined("codes").alias("codes"))


@query()
def rkmeans_codes(spark, d):
    v = T.vectors(spark, d)
    return Q.encode_residual(v, Q.fit_residual_kmeans(v, 3, 16, cosine=True), cosine=True).select("item_id", joined("codes").alias("codes"))


@query()
def pq_codes(spark, d):
    v = T.vectors(spark, d)
    return Q.encode_pq(v, Q.fit_pq(v, 4, 16)).select("item_id", joined("codes").alias("codes"))


@query()
def opq_codes(spark, d):
    v = T.vectors(spark, d)
    rotation, books = Q.fit_opq(v, 4, 16, rounds=2)
    return Q.encode_pq(Q.apply_rotation(v, rotation), books).select("item_id", joined("codes").alias("codes"))


def codebook(spark, d):
    """Codes with their digit appended."""
    return Q.dedup_digit(T.base_codes(spark, d), 64).select("item_id", F.concat("codes", F.array("digit")).alias("codes"))


@query("""SELECT p_partkey AS item_id, CAST((row_number() OVER (PARTITION BY p_size % 8, CAST(replace(p_brand, 'Brand#', '') AS INT) % 4, p_partkey % 3 ORDER BY p_partkey) - 1) % 8 AS INT) AS digit FROM part""")
def dedup_digit(spark, d):
    return Q.dedup_digit(T.base_codes(spark, d, 8), 8).select("item_id", "digit")


@query(cte("codes") + "SELECT max(n) AS max_duplicates, count(*) FILTER (n > 64) AS overflow_groups FROM (SELECT codes, count(*) AS n FROM codes GROUP BY codes)")
def dedup_report(spark, d):
    return Q.dedup_report(T.base_codes(spark, d), 64)


@query(cte("digits") + "SELECT i - 1 AS level, codes[i] AS code, count(*) AS n FROM digits, range(1, 5) t(i) GROUP BY ALL")
def code_usage(spark, d):
    return Q.code_usage(codebook(spark, d)).withColumn("level", F.col("level").cast("long"))


@query(cte("codes") + """, u AS (SELECT i - 1 AS level, codes[i] AS code, count(*) AS n FROM codes, range(1, 4) t(i) GROUP BY ALL), p AS (SELECT level, n / sum(n) OVER (PARTITION BY level) AS p FROM u)
SELECT level, round(count(*) / 4.0::DOUBLE, 6) AS utilization, round((ln(4) - sum(-p * ln(p + 1e-5))) / ln(4), 6) AS entropy_gap FROM p GROUP BY level""")
def code_entropy(spark, d):
    r = Q.code_report(Q.code_usage(T.base_codes(spark, d)), 4)
    return r.select(F.col("level").cast("long").alias("level"), F.round("utilization", 6).alias("utilization"), F.round("entropy_gap", 6).alias("entropy_gap"))


@query(cte(
    v="SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings",
    u="SELECT label, vec_id % 4 AS s, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v",
    p="SELECT 1 AS prefix_len, label::VARCHAR AS p, u FROM u UNION ALL SELECT 2, label || ',' || s, u FROM u",
    dims="SELECT prefix_len, p, unnest(range(1, 65)) AS i, unnest(u) AS x FROM p",
    sums="SELECT prefix_len, p, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM dims GROUP BY ALL",
    c="SELECT prefix_len, p, (sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)) AS c FROM sums GROUP BY prefix_len, p HAVING max(n) > 1",
) + "SELECT prefix_len, count(*) AS prefixes, round(avg(c), 6) AS cohesion FROM c GROUP BY prefix_len")
def prefix_cohesion(spark, d):
    v = T.vectors(spark, d)
    codes = v.select("item_id", F.array(F.col("label").cast("int"), (F.col("item_id") % 4).cast("int")).alias("codes"))
    return Q.prefix_cosine_cohesion(v.drop("label"), codes).withColumn("cohesion", F.round("cohesion", 6))


def layout_of(book):
    return K.vocab_layout(book, 4, 3)


@query(cte("digits") + """, m AS (SELECT max(codes[4]) + 1 AS n FROM digits) SELECT CAST(12 + n + 5 AS BIGINT) AS vocab_size, CAST(12 + n + 1 AS BIGINT) AS mask, CAST(12 + n + 4 AS BIGINT) AS eos, '0,4,8,12' AS bases FROM m""")
def vocab_layout(spark, d):
    v = codebook(spark, d)
    n = v.agg(F.max(F.element_at("codes", -1)).alias("n"))
    layout = layout_of(v)
    return n.select(F.lit(layout["vocab_size"]).cast("long").alias("vocab_size"), F.lit(layout["mask"]).cast("long").alias("mask"), F.lit(layout["eos"]).cast("long").alias("eos"), F.lit(",".join(map(str, layout["bases"]))).alias("bases"))


def tokens_of(spark, d):
    book = stage(codebook(spark, d), "codebook")
    layout = layout_of(book)
    return K.item_tokens(book, layout), layout


@query(cte("tokens") + "SELECT item_id, array_to_string(tokens, ',') AS tokens FROM tokens")
def item_tokens(spark, d):
    return tokens_of(spark, d)[0].select("item_id", joined("tokens").alias("tokens"))


@query(cte("tokens") + "SELECT array_to_string(tokens, ',') AS tokens, max(item_id) AS item_id FROM tokens GROUP BY tokens")
def tokens_to_item(spark, d):
    return K.tokens_to_item(tokens_of(spark, d)[0]).select(joined("tokens").alias("tokens"), "item_id")


_EOS = "(SELECT CAST(max(codes[4]) + 17 AS INT) FROM digits)"
_PREFIX = cte("tokens", path=f"SELECT DISTINCT list_append(tokens, {_EOS}) AS t FROM tokens", pre="SELECT array_to_string(list_slice(t, 1, i), ',') AS prefix, t[i + 1] AS nxt FROM path, range(0, 5) r(i)",
              tab="SELECT prefix, array_to_string(list_sort(list(DISTINCT nxt)), ',') AS next_tokens FROM pre GROUP BY prefix")


@query(_PREFIX + "SELECT prefix, next_tokens FROM tab")
def prefix_table(spark, d):
    t, layout = tokens_of(spark, d)
    return K.prefix_table(K.token_trie(t, layout["eos"])).select(joined("prefix").alias("prefix"), joined("next_tokens").alias("next_tokens"))


@query(_PREFIX + f"SELECT p_partkey, coalesce(next_tokens, CAST({_EOS} AS VARCHAR)) AS next_tokens FROM (SELECT p_partkey, (1 + p_size % 4) || ',' || (5 + p_partkey % 4) AS prefix FROM part) q LEFT JOIN tab ON q.prefix = tab.prefix")
def allowed_next(spark, d):
    t, layout = tokens_of(spark, d)
    inputs = T.table(spark, d, "part").select("p_partkey", F.array(F.lit(0), (F.col("p_size") % 4 + 1).cast("int"), (F.col("p_partkey") % 4 + 5).cast("int")).alias("input_ids"))
    return K.allowed_next_tokens(inputs, stage(K.token_trie(t, layout["eos"]), "trie"), layout["eos"], skip_bos=1).select("p_partkey", joined("next_tokens").alias("next_tokens"))


@query(cte("tokens", p="SELECT p_partkey, (1 + p_size % 4) AS a, (5 + p_partkey % 4) AS b, (9 + p_partkey % 5) AS c FROM part", x="SELECT DISTINCT tokens[1] AS a, tokens[2] AS b, tokens[3] AS c FROM tokens")
       + "SELECT p_partkey, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.a = p.a AND x.b = p.b AND x.c = p.c) THEN 3 WHEN EXISTS (SELECT 1 FROM x WHERE x.a = p.a AND x.b = p.b) THEN 2 WHEN EXISTS (SELECT 1 FROM x WHERE x.a = p.a) THEN 1 ELSE 0 END AS steps FROM p")
def beam_steps(spark, d):
    """How many of three tokens a beam can take: each step looks its node and token up in the trie."""
    t, layout = tokens_of(spark, d)
    trie = stage(K.token_trie(t, layout["eos"]), "trie")
    p = T.table(spark, d, "part")
    chosen = F.array((F.col("p_size") % 4 + 1).cast("int"), (F.col("p_partkey") % 4 + 5).cast("int"), (F.col("p_partkey") % 5 + 9).cast("int"))
    beams = p.select("p_partkey", chosen.alias("chosen"), F.lit(0).cast("long").alias("node"), F.lit(0).alias("steps"))
    for at in range(3):
        beams = K.advance(beams.withColumn("token", F.get("chosen", F.lit(at))), trie).withColumn("steps", F.col("steps") + F.col("node").isNotNull().cast("int"))
    return beams.select("p_partkey", "steps")


def samples(spark, d):
    return I.sliding_window_samples(T.ordered(spark, d), 5)


#: Every sample, with histories of five at most; items from 1, item 0 dropped as the padding id.
_SAMPLES = dict(
    s="""SELECT "user", pos, list_filter(h, lambda x: x <> 0) AS h, target FROM (SELECT "user", pos, item AS target, count(*) OVER (PARTITION BY "user") AS n, list(item) OVER (PARTITION BY "user" ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h FROM ordered) WHERE pos >= 1 AND pos < n - 2""",
    e="""SELECT "user", pos, unnest(range(1, len(h) + 1)) AS i, unnest(h) AS item FROM s""",
    f="""SELECT "user", pos, flatten(list(tokens ORDER BY i)) AS flat FROM e JOIN tokens ON e.item + 1 = tokens.item_id GROUP BY "user", pos""",
    g="""SELECT s."user", s.pos, coalesce(f.flat, []) AS flat, t.tokens AS goal, s.h, s.target FROM s LEFT JOIN f ON s."user" = f."user" AND s.pos = f.pos JOIN tokens t ON s.target + 1 = t.item_id""",
)


@query(cte("ordered", "tokens", **_SAMPLES) + """SELECT "user", pos, array_to_string(list_concat(list_transform(range(0, 20 - len(flat)), lambda i: 0), flat), ',') AS input_ids, CAST(len(flat) AS BIGINT) AS attended, array_to_string(goal, ',') AS labels FROM g""")
def generative_sequences(spark, d):
    s = K.generative_sequences(samples(spark, d), tokens_of(spark, d)[0], 4, 5)
    return s.select("user", "pos", joined("input_ids").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("attended"), joined("labels").alias("labels"))


@query(cte("ordered", "tokens", **_SAMPLES) + f"""SELECT "user", pos, array_to_string(list_concat(list_transform(range(0, 20 - len(flat)), lambda i: 0), [{_EOS} - 2], flat, [{_EOS} - 1], [{_EOS} - 3, {_EOS} - 3, {_EOS} - 3, {_EOS} - 3]), ',') AS input_ids, array_to_string(goal, ',') AS target_codes FROM g""")
def masked_sequences(spark, d):
    t, layout = tokens_of(spark, d)
    rows = K.with_tokens(T.ordered(spark, d), t, 4)
    s = K.masked_sequences(I.sliding_window_samples(rows, 5), t, layout, 4, 5, training=False)
    return s.select("user", "pos", joined("input_ids").alias("input_ids"), joined("target_codes").alias("target_codes"))


@query(cte("ordered", "tokens", **_SAMPLES) + """SELECT "user", pos, array_to_string(list_concat(list_transform(h, lambda x: x + 1), list_transform(range(0, 5 - len(h)), lambda i: 0::BIGINT)), ',') AS input_ids,
  array_to_string(CASE WHEN len(h) > 0 THEN list_concat(list_transform(range(1, len(h)), lambda i: -100::BIGINT), [target], list_transform(range(0, 5 - len(h)), lambda i: -100::BIGINT)) ELSE list_transform(range(0, 5), lambda i: -100::BIGINT) END, ',') AS labels_seq FROM g""")
def retrieval_sequences(spark, d):
    s = K.retrieval_sequences(samples(spark, d), 5)
    return s.select("user", "pos", joined("input_ids").alias("input_ids"), joined("labels_seq").alias("labels_seq"))


@query(cte("digits") + "SELECT item_id, '<L0_' || codes[1] || '> <L1_' || codes[2] || '> <L2_' || codes[3] || '> <L3_' || codes[4] || '>' AS text, array_to_string(codes, ',') AS codes FROM digits")
def codebook_roundtrip(spark, d):
    path = new_path(spark, "codebook")
    writers.write_codebook(codebook(spark, d), path)
    texts = spark.read.schema("item_id long, text string").json(f"{path}/text")
    return texts.join(readers.read_codebook(spark, f"{path}/codes", 4), "item_id").select("item_id", "text", joined("codes").alias("codes"))
