"""Candidates, hits, accuracy and diversity metrics, and re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenrec.functions.staging import stage

from .codetree import CodeTree, log_softmax, prefix_bounds


def _tuples(codebook: DataFrame, k: int) -> DataFrame:
    """codes, ids: the distinct code tuples, each with its k first items; of items with equal scores more are never asked for."""
    first = codebook.select("item_id", "codes").withColumn("r", F.row_number().over(W.partitionBy("codes").orderBy("item_id"))).where(F.col("r") <= k)
    return stage(first.groupBy("codes").agg(F.array_sort(F.collect_list("item_id")).alias("ids")), "code-tuples")


def _blocks(tuples: DataFrame, block: int) -> tuple[DataFrame, np.ndarray]:
    """prefix (its place in the second result), codes, many, ids: tuples that begin alike, by the fewest leading codes that leave at most so many together."""
    levels = tuples.select(F.size("codes")).first()[0]
    for depth in range(levels + 1):
        start = F.slice("codes", F.lit(1), F.lit(depth))
        sizes = tuples.groupBy(start.alias("start")).agg(F.count("*").alias("n"))
        if depth == levels or sizes.agg(F.max("n")).first()[0] <= block:
            break
    starts = sorted(r["start"] for r in sizes.select("start").collect()) if depth else [[]]  # a prefix a block, not an item
    rows = tuples.withColumn("prefix", F.lit(0).cast("long"))
    if depth:
        names = tuples.sparkSession.createDataFrame([(x, i) for i, x in enumerate(starts)], "start array<int>, prefix long")
        rows = tuples.withColumn("start", start).join(F.broadcast(names), "start")
    rows = rows.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("codes", "ids"))).alias("s"))
    part = lambda c: F.transform("s", lambda x: x[c])
    return rows.select("prefix", F.flatten(part("codes")).alias("codes"), F.transform(part("ids"), F.size).alias("many"), F.flatten(part("ids")).alias("ids")), np.array(starts, dtype=np.int64).reshape(len(starts), depth)


def score_items_by_codes(logits: DataFrame, codebook: DataFrame, k: int, block: int = 1 << 16, task_users: int = 4096) -> DataFrame:
    """user, rank, item_id (from 1), score: the k items with the largest sum over levels of the log-softmax at their codes; equal scores go by item.

    Distinct code tuples form a prefix tree, cut by leading codes into blocks of bounded size. A user goes to the
    blocks in the order of their bounds, first to one, then to twice as many and so on, until no bound reaches its
    k-th score; in a block the tree is walked with bounds too (codetree). A block goes once to each task that has users for it.
    """
    tuples = _tuples(codebook, k)
    if tuples.isEmpty():
        return logits.select("user", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("score")).limit(0)
    levels = tuples.select(F.size("codes")).first()[0]
    blocks, prefixes = _blocks(tuples, block)
    blocks = stage(blocks, "code-blocks")
    users = logits.groupBy("user").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("level", "logits"))), lambda x: x["logits"])).alias("z"))
    users = stage(users, "user-levels")
    found, seen = None, 0
    while True:
        visits = users.withColumn("prefix", F.lit(0).cast("long")) if len(prefixes) == 1 else stage(_visits(users, found, prefixes, levels, k, seen), "visits")
        if seen and visits.isEmpty():
            return found
        scored = _best_of_blocks(visits, blocks, levels, k, task_users)
        if len(prefixes) == 1:
            return scored.select("user", "rank", "item_id", "score")
        scored = scored.select("user", F.col("item_id").alias("item"), "score")
        if found is not None:
            scored = scored.unionByName(found.select("user", F.col("item_id").alias("item"), "score"))
        found = stage(topk_from_scores(scored, k).select("user", "rank", F.col("item").alias("item_id"), "score"), "best-so-far")
        seen = 2 * seen + 1


def _visits(users: DataFrame, found: DataFrame | None, prefixes: np.ndarray, levels: int, k: int, seen: int) -> DataFrame:
    """user, z, prefix: the next seen + 1 blocks after the first seen ones, in the order of a user's bounds, that may hold one of its k best."""
    schema = pa.schema([("user", pa.int64()), ("z", pa.list_(pa.float64())), ("prefix", pa.int64())])
    least = F.lit(float("-inf"))
    if found is None:
        rows = users.withColumn("least", least)
    else:
        rows = users.join(found.where(F.col("rank") == k).select("user", F.col("score").alias("least")), "user", "left").withColumn("least", F.coalesce("least", least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                z = log_softmax(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, levels, -1))
                bound = prefix_bounds(z, prefixes)
                order = np.argsort(-bound, axis=1, kind="stable")[:, seen : 2 * seen + 1]
                u, c = np.nonzero(np.take_along_axis(bound, order, 1) >= b.column(2).to_numpy(zero_copy_only=False)[:, None])
                if len(u):
                    yield pa.record_batch([b.column(0).take(pa.array(u)), b.column(1).take(pa.array(u)), pa.array(order[u, c])], schema=schema)

    return rows.select("user", "z", "least").mapInArrow(run, "user long, z array<double>, prefix long")


def _best_of_blocks(visits: DataFrame, blocks: DataFrame, levels: int, k: int, task_users: int) -> DataFrame:
    """user, rank, item_id (from 1), score: each visit's k best items of its block."""
    salts = visits.groupBy("prefix").agg(F.ceil(F.count("*") / task_users).cast("int").alias("salts"))  # a row a block
    salts = stage(salts, "salts")
    tasks = max(1, salts.agg(F.sum("salts")).first()[0] or 1)
    none = lambda kind: F.lit(None).cast(kind)
    told = blocks.join(F.broadcast(salts), "prefix").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    told = told.select("prefix", "salt", F.lit(0).alias("kind"), "codes", "many", "ids", none("long").alias("user"), none("array<double>").alias("z"))
    asked = visits.join(F.broadcast(salts), "prefix").withColumn("salt", F.pmod(F.xxhash64("user"), F.col("salts")).cast("int"))
    asked = asked.select("prefix", "salt", F.lit(1).alias("kind"), none("array<int>").alias("codes"), none("array<int>").alias("many"), none("array<long>").alias("ids"), "user", "z")
    rows = told.unionByName(asked).repartition(tasks, "prefix", "salt").sortWithinPartitions("prefix", "salt", "kind")
    schema = pa.schema([("user", pa.int64()), ("rank", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])
    numbers = lambda a: a.flatten().to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for b in batches:
            kinds = b.column("kind").to_numpy(zero_copy_only=False)
            bounds = [*np.flatnonzero(kinds == 0), len(kinds)]
            for i, j in zip([-1, *bounds[:-1]], bounds):  # the users of a block follow it, in this batch or the next
                if i >= 0:
                    row = b.slice(i, 1)
                    tree = CodeTree(numbers(row.column("codes")).reshape(-1, levels).astype(np.int64), np.append(0, np.cumsum(numbers(row.column("many")))), numbers(row.column("ids")))
                part = b.slice(i + 1, j - i - 1)
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    u, item, score = tree.best(log_softmax(numbers(some.column("z")).reshape(some.num_rows, levels, -1)), k)
                    rank = np.arange(len(u)) - np.searchsorted(u, u) + 1
                    yield pa.record_batch([some.column("user").take(pa.array(u)), pa.array(rank), pa.array(item + 1), pa.array(score)], schema=schema)

    return rows.select("kind", "codes", "many", "ids", "user", "z").mapInArrow(run, "user long, rank long, item_id long, score double")


def score_items_relational(logits: DataFrame, codebook: DataFrame, k: int) -> DataFrame:
    """The same as joins on (level, code): users share the work of equal codes."""
    z = logits.withColumn("m", F.array_max("logits"))
    z = z.withColumn("lse", F.col("m") + F.ln(F.aggregate(F.transform("logits", lambda x: F.exp(x - F.col("m"))), F.lit(0.0), lambda a, x: a + x)))
    each = z.select("user", "level", F.posexplode("logits").alias("code", "x"), "lse").select("user", "level", "code", (F.col("x") - F.col("lse")).alias("s"))
    codes = codebook.select("item_id", F.posexplode("codes").alias("level", "code"))
    total = codes.join(each, ["level", "code"]).groupBy("user", "item_id").agg(F.sum("s").alias("score"))
    return topk_from_scores(total.select("user", (F.col("item_id") + 1).alias("item"), "score"), k).select("user", "rank", F.col("item").alias("item_id"), "score")


def topk_from_scores(scores: DataFrame, k: int) -> DataFrame:
    """user, item, score, rank (from 1) of each user's best, without the padding item 0; equal scores go by item."""
    order = W.partitionBy("user").orderBy(F.desc("score"), "item")
    return scores.where("item <> 0").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def resolve_codes(candidates: DataFrame, inverse: DataFrame) -> DataFrame:
    """candidates (tokens, ...) with item_id, -1 where no item has the tokens."""
    return candidates.join(inverse, "tokens", "left").withColumn("item_id", F.coalesce("item_id", F.lit(-1).cast("long")))


def match_hits(candidates: DataFrame, truth: DataFrame, relaxed: bool = False) -> DataFrame:
    """user, hit_rank (from 1, null without a hit): the first candidate whose tokens, cut or padded to the label's length, equal the label.

    Relaxed: the semantic part is equal and the last token not below the label's.
    """
    n = F.size("label")
    cut = F.slice(F.concat("tokens", F.array_repeat(F.lit(0), n)), F.lit(1), n)
    rows = candidates.join(truth, "user").withColumn("cut", cut)
    same = F.col("cut") == F.col("label")
    if relaxed:
        same = (F.slice("cut", F.lit(1), n - 1) == F.slice("label", F.lit(1), n - 1)) & (F.element_at("cut", -1) >= F.element_at("label", -1))
    return rows.groupBy("user").agg(F.min(F.when(same, F.col("rank"))).cast("long").alias("hit_rank"))


def recall_ndcg(hits: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """k, recall, ndcg: means over all users; the one relevant item counts 1 / log2(rank + 1)."""
    each = hits.select("hit_rank", F.explode(F.array(*map(F.lit, ks))).alias("k")).withColumn("hit", F.coalesce(F.col("hit_rank") <= F.col("k"), F.lit(False)))
    gain = F.when(F.col("hit"), 1 / F.log2(F.col("hit_rank") + 1)).otherwise(0.0)
    return each.groupBy("k").agg(F.avg(F.col("hit").cast("double")).alias("recall"), F.avg(gain).alias("ndcg"))


def diversity_at_n(candidates: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    """user, diversity: the share of pairs with different categories among the first n; users with two categorised items at least. In closed form, without pairs."""
    rows = candidates.where(F.col("rank") <= n).join(categories, "item_id").groupBy("user", "cate_id").agg(F.count("*").alias("c"))
    s = rows.groupBy("user").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q")).where("n > 1")
    return s.select("user", ((F.col("n") * F.col("n") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).alias("diversity"))


def alpha_ndcg_at_k(candidates: DataFrame, truth: DataFrame, categories: DataFrame, k: int = 10, alpha: float = 0.5) -> DataFrame:
    """user, alpha_ndcg: relevant items' gains fall by (1 - alpha) for each earlier one of their category.

    Of the first k candidates the invalid ones go and ranks close up; those without a category keep their rank and gain nothing.
    The ideal counts the relevant items that have a category; users without one, or without a valid candidate, are left out.
    """
    first = candidates.where((F.col("rank") <= k) & (F.col("item_id") > 0))
    first = first.withColumn("r", F.row_number().over(W.partitionBy("user").orderBy("rank"))).join(categories, "item_id", "left")
    relevant = truth.join(categories, "item_id").select("user", "item_id", "cate_id").distinct()
    hit = first.join(relevant.select("user", "item_id"), ["user", "item_id"], "left_semi")
    gain = lambda order: F.pow(F.lit(1 - alpha), F.row_number().over(order) - 1)
    dcg = hit.withColumn("g", gain(W.partitionBy("user", "cate_id").orderBy("r")) / F.log2(F.col("r") + 1)).groupBy("user").agg(F.sum("g").alias("dcg"))
    ideal = relevant.withColumn("g", gain(W.partitionBy("user", "cate_id").orderBy("item_id")))
    ideal = ideal.withColumn("r", F.row_number().over(W.partitionBy("user").orderBy(F.desc("g"), "cate_id", "item_id"))).where(F.col("r") <= k)
    ideal = ideal.groupBy("user").agg(F.sum(F.col("g") / F.log2(F.col("r") + 1)).alias("idcg"))
    able = ideal.join(first.select("user").distinct(), "user", "left_semi")
    return able.join(dcg, "user", "left").select("user", (F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("alpha_ndcg"))


def scd(candidates: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    """user, scd (distinct categories by all there are), weighted_scd (1 / log2(place + 2) at each category's first place); users with an unknown item go."""
    total = categories.agg(F.countDistinct("cate_id").alias("total"))
    rows = candidates.where(F.col("rank") <= n).join(categories, "item_id", "left")
    whole = rows.groupBy("user").agg(F.count_if(F.col("cate_id").isNull()).alias("u")).where("u = 0").select("user")
    each = rows.join(whole, "user", "left_semi").groupBy("user", "cate_id").agg(F.min("rank").alias("r"))
    each = each.groupBy("user").agg(F.count("*").alias("c"), F.sum(1 / F.log2(F.col("r") + 1)).alias("weighted_scd"))
    return each.join(F.broadcast(total)).select("user", (F.col("c") / F.col("total")).alias("scd"), "weighted_scd")


def aggregate_metrics(hits: DataFrame, **by_user: DataFrame) -> DataFrame:
    """metric, value, users: recall and ndcg over all users, the others over users for whom they are defined."""
    rows = recall_ndcg(hits)
    n = hits.agg(F.count("*").alias("users"))
    out = rows.join(F.broadcast(n)).select(F.explode(F.array(*[F.struct(F.concat(F.lit(m + "@"), "k").alias("metric"), F.col(m).alias("value"), "users") for m in ("recall", "ndcg")])).alias("x")).select("x.*")
    for name, df in by_user.items():
        out = out.unionByName(df.agg(F.lit(name).alias("metric"), F.avg(name).alias("value"), F.count(name).alias("users")))
    return out


def _ranks(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Row by row the values under the mask as evenly spaced ranks, the largest (the first of equals) 1 and the smallest 0; a single one is 1, others 0."""
    order = np.argsort(np.where(mask, -values, np.inf), axis=1, kind="stable")
    place = np.empty(values.shape)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(values.shape[1], dtype=float), values.shape), axis=1)
    n = mask.sum(axis=1, keepdims=True)
    return np.where(mask, np.where(n > 1, 1 - place / np.maximum(n - 1, 1), 1.0), 0.0)


def mmr_orders(score: np.ndarray, cate: np.ndarray, valid: np.ndarray, there: np.ndarray, lam: np.ndarray, top_k: int, div_power=1.5, div_scale=2.0, div_exp=1.0, rank_power=1.0, rank_scale=0.0, rel_power=1.0, rel_scale=0.0, rel_exp=1.0, pop_scale=0.0, pop_power=1.0, cap_lambda=0.0, max_per_cate=0, diverse_k=0, tie=0.0, rank_norm=False) -> np.ndarray:
    """The greedy orders of many beams, a row a beam: relevance against how often a candidate's category is taken already.

    there tells candidates from what fills up shorter beams. The last pick is repeated when candidates run out; ties go to the lower place.
    """
    lam = np.clip(lam, 0.0, 1.0)[:, None]
    rows = np.arange(len(score))
    low, high = np.where(there, score, np.inf).min(axis=1, keepdims=True), np.where(there, score, -np.inf).max(axis=1, keepdims=True)
    rel = np.where(there, (score - low) / (high - low + 1e-12), 0.0)
    place = np.empty(score.shape)
    np.put_along_axis(place, np.argsort(np.where(there, -rel, np.inf), axis=1, kind="stable"), np.broadcast_to(np.arange(score.shape[1], dtype=float), score.shape), axis=1)
    rank_pen = (place + 1) / np.maximum(there.sum(axis=1, keepdims=True), 1)
    known = valid & (cate >= 0)
    same = (cate[:, :, None] == cate[:, None, :]) & known[:, None, :]
    pop = np.where(known, same.sum(axis=2) / np.maximum(known.sum(axis=1, keepdims=True), 1), 0.0) ** pop_power * known
    if rank_norm:
        rel, rank_pen = _ranks(rel, valid), _ranks(-rank_pen, valid)
    weight = lambda power: (1 - lam) ** max(1e-8, power)
    count, open_, picks = np.zeros(score.shape), valid.copy(), np.zeros((len(score), top_k), dtype=np.int64)
    for t in range(top_k):
        some = open_.any(axis=1)
        if not some.any():
            picks[:, t] = picks[:, t - 1] if t else 0
            continue
        pen = np.where(count > 0, 1 - np.exp(-div_scale * count**div_exp), 0.0) + pop_scale * pop
        may = open_
        if max_per_cate > 0 and (diverse_k <= 0 or t < diverse_k):
            under = open_ & (count < max_per_cate)
            may = np.where((lam < cap_lambda) & under.any(axis=1, keepdims=True), under, open_)
        if rank_norm:
            pen = _ranks(pen, may)
        value = lam * rel - weight(div_power) * pen - rank_scale * weight(rank_power) * rank_pen - rel_scale * weight(rel_power) * np.clip(rel, 0, 1) ** rel_exp + tie * rel
        pick = np.argmax(np.where(may, value, -np.inf), axis=1)
        picks[:, t] = np.where(some, pick, picks[:, t - 1] if t else 0)
        open_[rows[some], pick[some]] = False
        count += (cate == cate[rows, pick][:, None]) & (cate >= 0) & some[:, None]
    return picks


def mmr_rerank(candidates: DataFrame, lam: float | list[float] | None = None, top_k: int = 10, **options) -> DataFrame:
    """user[, lam], rank (from 0), item_id, cate_id of the re-ranked beams; candidates have user, rank, item_id (-1: invalid), score, cate_id (-1: none), and lam if none is given.

    A beam is one array in one row, many of which are re-ranked at a time as one matrix; for a list of weights they are grouped once.
    """
    by = ["user", "lam"] if lam is None else ["user"]
    many = not isinstance(lam, (int, float))
    beams = candidates.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "score", "cate_id"))).alias("beam"))
    fields = ("item_id", "score", "cate_id")
    beams = beams.select(*by, *[F.col(f"beam.{f}").alias(f) for f in fields])
    schema = pa.schema([("user", pa.int64())] + [("lam", pa.float64())] * many + [("rank", pa.int64()), ("item_id", pa.int64()), ("cate_id", pa.int64())])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                n = batch.column("item_id").value_lengths().to_numpy(zero_copy_only=False)
                there = np.arange(n.max()) < n[:, None]
                item, score, cate = (np.zeros(there.shape, dtype=kind) for kind in (np.int64, float, np.int64))
                for m, f in zip((item, score, cate), fields):
                    m[there] = batch.column(f).flatten().to_numpy(zero_copy_only=False)
                users = batch.column("user").to_numpy(zero_copy_only=False)
                for x in lam if isinstance(lam, list) else [lam]:
                    weights = batch.column("lam").to_numpy(zero_copy_only=False) if x is None else np.full(len(users), float(x))
                    picks = mmr_orders(score, cate, there & (item > 0), there, weights, top_k, **options)
                    out = [np.repeat(users, top_k)] + [np.repeat(weights, top_k)] * many + [np.tile(np.arange(top_k), len(users)), np.take_along_axis(item, picks, 1).ravel(), np.take_along_axis(cate, picks, 1).ravel()]
                    yield pa.record_batch([pa.array(c) for c in out], schema=schema)

    kinds = {pa.int64(): "long", pa.float64(): "double"}
    return beams.mapInArrow(rerank, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def lambda_sweep(candidates: DataFrame, truth: DataFrame, lambdas: list[float], k: int = 10, **options) -> DataFrame:
    """lam, recall, diversity, pareto: accuracy and diversity for each weight; a point is kept if none is better in both, of equal points the one with the smallest weight."""
    ranked = stage(mmr_rerank(candidates, [float(x) for x in lambdas], k, **options), "reranked")
    hit = ranked.join(truth.select("user", F.col("item_id").alias("true_id")), "user").groupBy("lam", "user").agg(F.max((F.col("item_id") == F.col("true_id")).cast("double")).alias("hit"))
    recall = hit.groupBy("lam").agg(F.avg("hit").alias("recall"))
    c = ranked.where("cate_id >= 0").groupBy("lam", "user", "cate_id").agg(F.count("*").alias("c")).groupBy("lam", "user").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q")).where("n > 1")
    diversity = c.groupBy("lam").agg(F.avg((F.col("n") * F.col("n") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).alias("diversity"))
    points = recall.join(diversity, "lam")
    better = F.max("recall").over(W.orderBy(F.desc("diversity"), F.desc("recall"), "lam").rowsBetween(W.unboundedPreceding, -1))  # one row a weight
    return points.withColumn("pareto", F.coalesce(F.col("recall") > better, F.lit(True)))
