"""Queries on categories, candidates, metrics and re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenrec.functions.staging import stage
from lumenrec.operators import categories as C
from lumenrec.operators import ranking as R

from . import codes
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


def initial(spark, d):
    """Parts with paths below a root that four in five share, and their first categories; every 17th has no path."""
    p = T.table(spark, d, "part")
    path = F.concat(F.when(F.col("p_partkey") % 5 != 0, F.lit("All,")).otherwise(""), F.col("p_type"), F.lit(", "), F.replace(F.col("p_name"), F.lit(" "), F.lit(",")))
    items = p.select((F.col("p_partkey") + 1).alias("item_id"), F.when(F.col("p_partkey") % 17 != 0, path).alias("path_text"), F.when(F.col("p_partkey") % 34 == 0, F.col("p_brand")).alias("brand"))
    items = items.join(T.base_codes(spark, d).withColumn("item_id", F.col("item_id") + 1), "item_id")
    return C.initial_category(C.strip_dominant_root(items.withColumn("tokens", C.category_tokens(F.col("path_text"))).drop("path_text")))


def categorized(spark, d):
    return C.merge_small_categories(C.split_large_categories(initial(spark, d)), 5, 40)


_LAST = "array_to_string(list_slice({p}, greatest(len({p}) - {n} + 1, 1), len({p})), ' > ')"


def _split(of: str) -> str:
    longer = f"CASE WHEN len(path) >= 3 THEN {_LAST.format(p='path', n=3)} WHEN len(path) = 2 THEN {_LAST.format(p='path', n=2)} ELSE {_LAST.format(p='path', n=1)} END"
    return f"SELECT item_id, path, CASE WHEN len(path) > 0 AND category IN (SELECT category FROM {of} WHERE category IS NOT NULL GROUP BY category HAVING count(*) > 0.01 * (SELECT count(category) FROM {of})) THEN {longer} ELSE category END AS category FROM {of}"


_CATE = dict(
    t="SELECT p_partkey + 1 AS item_id, p_partkey, p_brand, CASE WHEN p_partkey % 17 <> 0 THEN list_filter(list_transform(string_split(CASE WHEN p_partkey % 5 <> 0 THEN 'All,' ELSE '' END || p_type || ', ' || replace(p_name, ' ', ','), ','), lambda x: trim(x)), lambda x: x <> '') ELSE [] END AS tokens FROM part",
    root="SELECT CASE WHEN max(n) >= 0.5 * sum(n) THEN arg_max(r, n) END AS root FROM (SELECT tokens[1] AS r, count(*) AS n FROM t WHERE len(tokens) > 0 GROUP BY 1)",
    i0="SELECT t.*, codes, root, CASE WHEN lower(tokens[1]) = lower(root) THEN tokens[2:] ELSE tokens END AS stripped FROM t JOIN codes c ON t.p_partkey = c.item_id, root",
    i1="SELECT *, CASE WHEN len(stripped) > 0 THEN stripped ELSE tokens END AS path FROM i0",
    k0=f"SELECT item_id, path, CASE WHEN len(path) > 0 THEN {_LAST.format(p='path', n=2)} WHEN p_partkey % 34 = 0 THEN 'Brand: ' || p_brand WHEN root IS NOT NULL THEN 'Code: L0_' || codes[1] || '|L1_' || codes[2] END AS category FROM i1",
    k1=_split("k0"), k2=_split("k1"), k3=_split("k2"),
    kc="SELECT category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, category) AS r FROM k3 WHERE category IS NOT NULL GROUP BY category",
    k="SELECT item_id, CASE WHEN kc.n < 5 OR kc.r > 40 THEN 'other' ELSE k3.category END AS category FROM k3 LEFT JOIN kc ON k3.category = kc.category",
    ids="SELECT category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, category) - 1 AS cate_id FROM k WHERE category IS NOT NULL GROUP BY category",
)


@query(cte("codes", **_CATE) + "SELECT item_id, k0.category FROM k0")
def initial_categories(spark, d):
    return initial(spark, d).select("item_id", "category")


@query(cte("codes", **_CATE) + "SELECT k.item_id, k.category, ids.cate_id FROM k LEFT JOIN ids ON k.category = ids.category")
def item_categories(spark, d):
    items = stage(categorized(spark, d), "categorized")
    return items.join(C.category_ids(items), "category", "left").select("item_id", "category", "cate_id")


@query(cte("codes", **_CATE) + "SELECT category, n, round(n / sum(n) OVER (), 9) AS ratio FROM ids")
def category_distribution(spark, d):
    return C.category_distribution(categorized(spark, d)).withColumn("ratio", F.round("ratio", 9))


def known(spark, d):
    """item_id (from 1), cate_id; twelve in thirteen parts have one."""
    p = T.table(spark, d, "part").where("p_partkey % 13 <> 0")
    return p.select((F.col("p_partkey") + 1).alias("item_id"), (F.col("p_partkey") % 11).alias("cate_id"))


@query(cte("tokens", "cates") + "SELECT t.item_id, coalesce(c.cate_id, t.tokens[1]) AS cate_id FROM tokens t LEFT JOIN cates c ON t.item_id = c.item_id")
def categories_with_code_fallback(spark, d):
    return C.fill_category_from_code(known(spark, d), codes.tokens_of(spark, d)[0])


def logits(spark, d):
    c = T.truth(spark, d).select("user", F.explode(F.array(*map(F.lit, range(3)))).alias("level"))
    z = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.sin(F.col("user") * (F.col("level") + 1) + k))
    return c.select("user", "level", z.alias("logits"))


@query(cte("codes", "splits", z="""SELECT "user", level, k, sin("user" * (level + 1) + k) AS z FROM splits, range(0, 3) l(level), range(0, 4) c(k)""",
           s="""SELECT "user", level, k, z - ln(sum(exp(z)) OVER (PARTITION BY "user", level)) AS s FROM z""",
           w="""SELECT DISTINCT codes FROM codes""",
           v="""SELECT a."user", w.codes, round(a.s + b.s + c.s, 6) AS score FROM w JOIN s a ON a.level = 0 AND a.k = w.codes[1] JOIN s b ON b.level = 1 AND b.k = w.codes[2] AND a."user" = b."user" JOIN s c ON c.level = 2 AND c.k = w.codes[3] AND a."user" = c."user" """,
           u="""SELECT "user", score, count(*) AS n FROM v JOIN codes ON v.codes = codes.codes GROUP BY "user", score""",
           r="""SELECT "user", score, sum(n) OVER (PARTITION BY "user" ORDER BY score DESC) AS upto, n FROM u""")
       + """SELECT "user", score, CAST(least(n, 10 - (upto - n)) AS BIGINT) AS items FROM r WHERE upto - n < 10""")
def score_items(spark, d):
    """How many of a user's ten best items have which score: items of equal codes tie."""
    s = R.score_items_by_codes(logits(spark, d), T.base_codes(spark, d), 10)
    return s.groupBy("user", F.round("score", 6).alias("score")).agg(F.count("*").alias("items"))


@query(cte("raw") + """, q AS (SELECT "user", item, sum(rating) AS score FROM raw WHERE item <> 0 GROUP BY "user", item)
SELECT * FROM (SELECT "user", item, score, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank FROM q) WHERE rank <= 10""")
def topk_scores(spark, d):
    scores = T.interactions(spark, d).groupBy("user", "item").agg(F.sum("rating").alias("score"))
    return R.topk_from_scores(scores, 10).select("user", "item", "score", "rank")


def beams(spark, d, true=None, tokens=None):
    """Candidates by their tokens."""
    return T.candidates(spark, d, true).join(codes.tokens_of(spark, d)[0] if tokens is None else tokens, "item_id")


def labelled_beams(spark, d):
    """Candidates by their tokens, and the tokens of each user's true item."""
    true, tokens = stage(T.truth(spark, d), "truth"), codes.tokens_of(spark, d)[0]
    return beams(spark, d, true, tokens), true.join(tokens, "item_id").select("user", F.col("tokens").alias("label"))


@query(cte("cand", "tokens") + """SELECT c."user", c.rank, r.item_id FROM cand c JOIN tokens t ON c.item_id = t.item_id JOIN (SELECT tokens, max(item_id) AS item_id FROM tokens GROUP BY tokens) r ON t.tokens = r.tokens""")
def resolved_candidates(spark, d):
    from lumenrec.operators.tokens import tokens_to_item

    inverse = tokens_to_item(codes.tokens_of(spark, d)[0])
    return R.resolve_codes(beams(spark, d).drop("item_id"), inverse).select("user", "rank", "item_id")


_HITS = dict(hits="""SELECT c."user", min(CASE WHEN t.tokens = g.tokens THEN c.rank END) AS hit_rank FROM cand c JOIN tokens t ON c.item_id = t.item_id JOIN truth y ON c."user" = y."user" JOIN tokens g ON y.item_id = g.item_id GROUP BY c."user" """)


@query(cte("cand", "tokens", **_HITS) + 'SELECT "user", hit_rank FROM hits')
def hits(spark, d):
    return R.match_hits(*labelled_beams(spark, d))


@query(cte("cand", "tokens", rel="""SELECT c."user", min(CASE WHEN t.tokens[1:3] = g.tokens[1:3] AND t.tokens[4] >= g.tokens[4] THEN c.rank END) AS hit_rank FROM cand c JOIN tokens t ON c.item_id = t.item_id JOIN truth y ON c."user" = y."user" JOIN tokens g ON y.item_id = g.item_id GROUP BY c."user" """) + 'SELECT "user", hit_rank FROM rel')
def relaxed_hits(spark, d):
    return R.match_hits(*labelled_beams(spark, d), relaxed=True)


_RN = "SELECT k, avg(CASE WHEN hit_rank <= k THEN 1.0::DOUBLE ELSE 0 END) AS recall, avg(CASE WHEN hit_rank <= k THEN 1 / log2(hit_rank + 1) ELSE 0.0::DOUBLE END) AS ndcg FROM hits, (VALUES (5), (10)) v(k) GROUP BY k"


@query(cte("cand", "tokens", **_HITS) + f"SELECT k, round(recall, 9) AS recall, round(ndcg, 9) AS ndcg FROM ({_RN})")
def recall_ndcg(spark, d):
    return R.recall_ndcg(hits(spark, d)).select("k", F.round("recall", 9).alias("recall"), F.round("ndcg", 9).alias("ndcg"))


_DIV = """SELECT "user", (sum(c) * sum(c) - sum(c * c)) / (sum(c) * (sum(c) - 1))::DOUBLE AS diversity FROM (SELECT "user", cate_id, count(*) AS c FROM cand JOIN cates ON cand.item_id = cates.item_id WHERE rank <= 10 GROUP BY "user", cate_id) GROUP BY "user" HAVING sum(c) > 1"""


@query(cte("cand", "cates") + f'SELECT "user", round(diversity, 9) AS diversity FROM ({_DIV})')
def diversity(spark, d):
    return R.diversity_at_n(T.candidates(spark, d), known(spark, d)).withColumn("diversity", F.round("diversity", 9))


#: The ground truth for alpha-NDCG: each user's last three items.
_ALPHA = dict(
    gt="""SELECT DISTINCT s."user", x.item_id, c.cate_id FROM (SELECT "user", unnest(items[len(items) - 2:]) + 1 AS item_id FROM seq) x JOIN splits s ON s."user" = x."user" JOIN cates c ON x.item_id = c.item_id""",
    v="""SELECT cand."user", cand.item_id, cate_id, row_number() OVER (PARTITION BY cand."user" ORDER BY rank) AS r FROM cand LEFT JOIN cates ON cand.item_id = cates.item_id WHERE rank <= 10""",
    h="""SELECT v."user", power(0.5, row_number() OVER (PARTITION BY v."user", v.cate_id ORDER BY r) - 1) / log2(r + 1) AS g FROM v JOIN gt ON v."user" = gt."user" AND v.item_id = gt.item_id""",
    i0="""SELECT *, power(0.5, row_number() OVER (PARTITION BY "user", cate_id ORDER BY item_id) - 1) AS g FROM gt""",
    i1="""SELECT "user", sum(g / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY g DESC, cate_id, item_id) AS r FROM i0) WHERE r <= 10 GROUP BY "user" """,
)


def last_three(rows):
    """user, item_id (from 1), of the last three rows of each user of ordered()."""
    return rows.where("n >= 3 AND pos >= n - 3").select("user", (F.col("item") + 1).alias("item_id"))


_ALPHA_BY_USER = """SELECT i1."user", round(coalesce(x.g, 0) / idcg, 9) AS alpha_ndcg FROM i1 LEFT JOIN (SELECT "user", sum(g) AS g FROM h GROUP BY "user") x ON i1."user" = x."user" WHERE i1."user" IN (SELECT "user" FROM v)"""


@query(cte("cand", "cates", **_ALPHA) + _ALPHA_BY_USER)
def alpha_ndcg(spark, d):
    rows = stage(T.ordered(spark, d), "ordered")
    return R.alpha_ndcg_at_k(T.candidates(spark, d, T.truth(spark, d, rows)), last_three(rows), known(spark, d)).withColumn("alpha_ndcg", F.round("alpha_ndcg", 9))


_SCD = dict(
    f="""SELECT "user", cate_id, rank FROM cand LEFT JOIN cates ON cand.item_id = cates.item_id WHERE rank <= 10""",
    g="""SELECT "user", cate_id, min(rank) AS r FROM f WHERE "user" NOT IN (SELECT "user" FROM f WHERE cate_id IS NULL) GROUP BY "user", cate_id""",
    s="""SELECT "user", count(*)::DOUBLE / (SELECT count(DISTINCT cate_id) FROM cates) AS scd, sum(1 / log2(r + 1)) AS weighted_scd FROM g GROUP BY "user" """,
)


@query(cte("cand", "cates", **_SCD) + 'SELECT "user", round(scd, 9) AS scd, round(weighted_scd, 9) AS weighted_scd FROM s')
def scd(spark, d):
    return R.scd(T.candidates(spark, d), known(spark, d)).select("user", F.round("scd", 9).alias("scd"), F.round("weighted_scd", 9).alias("weighted_scd"))


@query(cte("cand", "tokens", "cates", **_HITS, **_SCD, **_ALPHA, rn=_RN, dv=_DIV, an=_ALPHA_BY_USER) + """SELECT 'recall@' || k AS metric, round(recall, 9) AS value, (SELECT count(*) FROM hits) AS users FROM rn UNION ALL SELECT 'ndcg@' || k, round(ndcg, 9), (SELECT count(*) FROM hits) FROM rn
UNION ALL SELECT 'diversity', round(avg(diversity), 9), count(*) FROM dv UNION ALL SELECT 'scd', round(avg(scd), 9), count(*) FROM s UNION ALL SELECT 'weighted_scd', round(avg(weighted_scd), 9), count(*) FROM s UNION ALL SELECT 'alpha_ndcg', round(avg(alpha_ndcg), 9), count(*) FROM an""")
def metric_summary(spark, d):
    rows, k = stage(T.ordered(spark, d), "ordered"), known(spark, d)
    y = T.truth(spark, d, rows)
    c = stage(T.candidates(spark, d, y), "candidates")
    tokens = codes.tokens_of(spark, d)[0]
    found = stage(R.match_hits(c.join(tokens, "item_id"), y.join(tokens, "item_id").select("user", F.col("tokens").alias("label"))), "hits")
    s = stage(R.scd(c, k), "scd")
    alpha = R.alpha_ndcg_at_k(c, last_three(rows), k)
    return R.aggregate_metrics(found, diversity=R.diversity_at_n(c, k), scd=s, weighted_scd=s, alpha_ndcg=alpha).withColumn("value", F.round("value", 9))


def rated(spark, d, true=None):
    """Candidates with categories; -1 where there is none."""
    return T.candidates(spark, d, true).join(known(spark, d), "item_id", "left").withColumn("cate_id", F.coalesce("cate_id", F.lit(-1).cast("long")))


def _picks_in_sql(lambdas: list[float], k: int = 10) -> dict[str, str]:
    """CTEs of the greedy choice, slot by slot: beams with relevance, then for each user and weight the places chosen so far; picks has them as rows."""
    free = "len(list_filter(s.cs, lambda c: c = b.cate_id AND c >= 0))"
    value = f"lam * rel - power(1 - lam, 1.5) * CASE WHEN {free} > 0 THEN 1 - exp(-2.0::DOUBLE * {free}) ELSE 0 END"
    steps = {
        "b": """SELECT *, (score - min(score) OVER u) / (max(score) OVER u - min(score) OVER u + 1e-12::DOUBLE) AS rel FROM (
  SELECT cand.*, coalesce(cates.cate_id, -1) AS cate_id FROM cand LEFT JOIN cates ON cand.item_id = cates.item_id) WINDOW u AS (PARTITION BY "user")""",
        "s0": f"""SELECT DISTINCT "user", lam, []::BIGINT[] AS places, []::BIGINT[] AS cs FROM b, (VALUES {", ".join(f"({x}::DOUBLE)" for x in lambdas)}) l(lam)""",
    }
    for t in range(k):
        steps[f"s{t + 1}"] = f"""SELECT "user", lam, list_append(places, place) AS places, list_append(cs, cate) AS cs FROM (
  SELECT *, row_number() OVER (PARTITION BY "user", lam ORDER BY value DESC, place) AS n FROM (
    SELECT s.*, b.rank AS place, b.cate_id AS cate, {value} AS value FROM s{t} s JOIN b ON s."user" = b."user" WHERE NOT list_contains(s.places, b.rank))) WHERE n = 1"""
    steps["picks"] = f"""SELECT s."user", s.lam, i - 1 AS rank, b.item_id, b.cate_id FROM s{k} s, range(1, {k + 1}) x(i) JOIN b ON b."user" = s."user" AND b.rank = s.places[i]"""
    return steps


LAMBDAS = [0.0, 0.25, 0.5, 0.75, 1.0]


@query(cte("cand", "cates", **_picks_in_sql([0.5])) + 'SELECT "user", rank, item_id, cate_id FROM picks')
def mmr_rerank(spark, d):
    return R.mmr_rerank(rated(spark, d), 0.5)


@query(cte(
    "cand", "cates", **_picks_in_sql(LAMBDAS),
    r="""SELECT lam, avg(hit) AS recall FROM (SELECT lam, p."user", max(CASE WHEN p.item_id = t.item_id THEN 1.0::DOUBLE ELSE 0 END) AS hit FROM picks p JOIN truth t ON p."user" = t."user" GROUP BY lam, p."user") GROUP BY lam""",
    q="""SELECT lam, "user", sum(c) AS n, sum(c * c) AS q FROM (SELECT lam, "user", cate_id, count(*) AS c FROM picks WHERE cate_id >= 0 GROUP BY lam, "user", cate_id) GROUP BY lam, "user" HAVING sum(c) > 1""",
    dv="SELECT lam, avg((n * n - q) / (n * (n - 1))::DOUBLE) AS diversity FROM q GROUP BY lam",
    p="SELECT r.lam, recall, diversity FROM r JOIN dv ON r.lam = dv.lam",
) + """SELECT lam, round(recall, 9) AS recall, round(diversity, 9) AS diversity, coalesce(recall > max(recall) OVER (ORDER BY diversity DESC, recall DESC, lam ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS pareto FROM p""")
def lambda_sweep(spark, d):
    true = stage(T.truth(spark, d), "truth")
    s = R.lambda_sweep(rated(spark, d, true), true, LAMBDAS)
    return s.select("lam", F.round("recall", 9).alias("recall"), F.round("diversity", 9).alias("diversity"), "pareto")
