"""Hand-made cases and properties of the recommendation operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrec.functions.staging import new_path
from lumenrec.operators import categories as C
from lumenrec.operators import embeddings as E
from lumenrec.operators import interactions as I
from lumenrec.operators import quantize as Q
from lumenrec.operators import ranking as R
from lumenrec.operators import text as X
from lumenrec.operators import tokens as K
from lumenrec.operators.codetree import log_softmax
from lumenrec.sources import readers

INTER = "user string, item string, rating double, ts long"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_first_interactions_keep_time_order(spark):
    df = spark.createDataFrame([("u", "a", 1.0, 2), ("u", "b", 1.0, 1), ("u", "a", 1.0, 3)], INTER)
    assert rows(I.in_order(I.first_interactions(df)), "pos", "item", "ts") == [(0, "b", 1), (1, "a", 2)]


def test_k_core_counts_both_sides_at_once(spark):
    pairs = [("u1", "a"), ("u1", "b"), ("u2", "a"), ("u2", "b"), ("u3", "b"), ("u3", "c")]
    df = spark.createDataFrame([(u, i, 1.0, 1) for u, i in pairs], INTER)
    core = I.k_core(df, 2, 2)
    assert rows(core, "user", "item") == pairs[:4]
    assert rows(I.k_core(core, 2, 2), "user", "item") == pairs[:4]
    assert I.k_core(df, 0, 0).count() == 6
    assert I.k_core(df, 9, 9).count() == 0
    assert I.k_core(df.limit(0), 2, 2).count() == 0


def test_k_core_by_plain_rounds(spark):
    """A chain that falls one by one behind a hot user: equal to plain rounds, and later rounds take few rows."""
    r = np.random.default_rng(12)
    pairs = [("hot", f"i{k}") for k in range(200)] + [(f"u{r.integers(60)}", f"i{r.integers(80)}") for _ in range(400)]
    pairs += [(f"c{k}", f"d{k + j}") for k in range(12) for j in (0, 1)] + [("u1", "i1")] * 3
    df = spark.createDataFrame([(u, i, 1.0, t) for t, (u, i) in enumerate(pairs)] + [(None, "i1", 1.0, 1), ("u1", None, 1.0, 1)], INTER)
    for ku, ki in ((2, 2), (3, 4), (5, 5), (0, 3), (500, 1)):
        left = list(enumerate(pairs))
        while True:
            users, items = ({k: sum(p[side] == k for _, p in left) for k in {p[side] for _, p in left}} for side in (0, 1))
            kept = [(t, p) for t, p in left if users[p[0]] >= ku and items[p[1]] >= ki]
            if len(kept) == len(left):
                break
            left = kept
        trace = []
        got = I.k_core(df.repartition(3), ku, ki, trace)
        assert rows(got, "user", "item", "ts") == sorted((*p, t) for t, p in left)
    trace = []
    I.k_core(df, 2, 2, trace)
    assert len(trace) > 5 and trace[-1][1] < trace[0][1] / 5 and trace[-1][0] <= 2


def test_dense_ids_are_in_byte_order(spark):
    df = spark.createDataFrame([("P10",), ("P2",), ("P1",), ("P2",)], "item string")
    assert rows(I.dense_ids(df, "item"), "item", "idx") == [("P1", 0), ("P10", 1), ("P2", 2)]


def test_splits_and_samples(spark):
    df = spark.createDataFrame([("u", c, 1.0, t) for t, c in enumerate("abcde")] + [("v", "a", 1.0, 1)], INTER)
    o = I.in_order(df)
    s = I.leave_two_out(I.user_sequences(o))
    assert rows(s, "user", "train", "valid", "test") == [("u", ["a", "b", "c"], "d", "e")]
    assert rows(I.sliding_window_samples(o), "history", "target") == [(["a"], "b"), (["a", "b"], "c")]
    assert rows(I.eval_samples(o), "history", "target") == [(["a", "b", "c"], "d"), (["a", "b", "c", "d"], "e")]


def test_one_user_with_a_third_of_all_rows(spark):
    """In ranges of any number: the same places, windows and splits as by plain lists; the hot user's rows are in many of them."""
    r = np.random.default_rng(4)
    data = [("hot", f"i{k:03d}", 1.0, int(t)) for k, t in enumerate(r.integers(0, 300, 400))]
    data += [(None if u == 7 else f"u{u}", f"i{k}", 1.0, int(r.integers(0, 9))) for u in range(120) for k in range(r.integers(1, 12))]
    df = spark.createDataFrame(data, INTER).repartition(5)
    by = {}
    for u, i, _, t in sorted(data, key=lambda x: x[2:] and (x[3], x[1])):
        by.setdefault(u, []).append(i)
    want = {(u, p, i, len(v)) for u, v in by.items() for p, i in enumerate(v)}
    windows = {(u, p, tuple(v[max(0, p - 50) : p]), v[p]) for u, v in by.items() for p in range(1, len(v) - 2)}
    evals = {(u, s, tuple(v[: len(v) - less][-50:]), v[-less]) for u, v in by.items() if len(v) >= 3 for s, less in (("valid", 2), ("test", 1))}
    lasts = {(u, tuple(v[:-3][-50:]), v[-3]) for u, v in by.items() if len(v) >= 3}
    for parts in (1, 3, 211):
        o = I.in_order(df, parts).cache()
        assert {(x.user, x.pos, x.item, x.n) for x in o.collect()} == want
        assert {(x.user, x.pos, tuple(x.history), x.target) for x in I.sliding_window_samples(o).collect()} == windows
        assert {(x.user, x.split, tuple(x.history), x.target) for x in I.eval_samples(o).collect()} == evals
        assert {(x.user, tuple(x.history), x.target) for x in I.last_target_samples(o).collect()} == lasts
        hot = o.where("user = 'hot'").groupBy("part").count().collect()
        assert len(hot) >= {1: 1, 3: 2, 211: 50}[parts] and max(x["count"] for x in hot) <= {1: 400, 3: 399, 211: 30}[parts]
        o.unpersist()
    assert I.in_order(df.limit(0)).count() == 0


def test_staged_tables_can_be_deleted(spark, tmp_path):
    import os

    from lumenrec.functions.staging import Scratch, shared_dir, stage, staged_tables

    before = set(os.listdir(shared_dir(spark)))
    with staged_tables(spark):
        stage(spark.range(3), "outer")
        with staged_tables(spark):
            df = Scratch(spark, "inner").stage(spark.range(5).withColumn("k", F.col("id") % 2), "x", by="k")
            df.write.parquet(str(tmp_path / "kept"))
            inside = set(os.listdir(shared_dir(spark))) - before
        assert {x.split("-")[0] for x in inside} == {"outer", "inner"} and len(set(os.listdir(shared_dir(spark))) - before) == 1
    assert set(os.listdir(shared_dir(spark))) == before and spark.read.parquet(str(tmp_path / "kept")).count() == 5


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "h array<bigint>")
    assert df.select(I.pad_or_truncate(F.col("h"), 5)).first()[0] == [0, 0, 1, 2, 3]
    assert df.select(I.pad_or_truncate(F.col("h"), 2)).first()[0] == [2, 3]


def test_entities_read_as_html_does(spark):
    """Every name, with and without what follows it, low and extreme numbers, and what only resembles an entity."""
    import html
    import random
    from html.entities import html5

    r = random.Random(1)
    cases = [f"x&{n}y" for n in html5] + [f"a &{n} b" for n in sorted(html5)[::7]]
    cases += [f"&#{n};" for n in [*range(300), 0x7FF, 0x800, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x1F600, 0x10FFFF, 0x110000, 10**12, 10**30]]
    cases += [f"&#x{n:x}" for n in (0, 9, 13, 65, 128, 150, 0x2603, 0x1F600, 0x110000, 2**70)] + ["&", "&&", "& amp;", "&;", "&#;", "&#x;", "&#00065;", "&notit;", "&ampamp;", "&amp;lt;", "a&b&c", "&" + "q" * 40 + ";", "&&amp;&", "&\tamp;", ""]
    cases += ["".join(r.choice(["&", "amp", "lt;", "#", "x", "3", "9", ";", " ", "not", "in", "é", "😀", "\n"]) for _ in range(r.randint(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, c string")
    out = df.select("i", X.unescape(F.col("c")).alias("one"), F.transform(F.array("c", F.lit("&lt;"), F.lit(None)), X.unescape).alias("many"))
    assert "Python" not in out._jdf.queryExecution().toString()
    for x in out.collect():
        want = html.unescape(cases[x.i])
        assert x.one == want and x.many == [want, "<", None], cases[x.i]


def test_one_vector_an_id(spark):
    v = spark.createDataFrame([(0, [1.0, 9.0], 2), (0, [5.0, 0.0], 1), (3, [2.0, 2.0], 1)], "item_id long, embedding array<float>, at int")
    ids = spark.createDataFrame([(0,), (1,), (0,)], "item_id long")
    assert rows(E.align_embeddings(ids, v, 2, order="at"), "item_id", "embedding") == [(0, [1.0, 9.0]), (1, [0.0, 0.0])]
    assert rows(E.align_embeddings(ids, v, 2), "item_id", "embedding") == [(0, [5.0, 0.0]), (1, [0.0, 0.0])]


def test_interaction_lines_as_they_come(spark, tmp_path):
    """The first line of each file is its header whatever it says; white space around a line goes."""
    for name, text in (("a", "any words\n\tu2\ti2\t3\t5\t\n u1\ti1\t2.5\t7.9 \nx:token\ti1\t1\t1\nu\ti\t1\n"), ("b", "u9\ti9\t1\t1\nu3\ti\"3\t1\t\t\nu3\ti\"3\t1\t2\n")):
        (tmp_path / name).write_text(text)
    got = readers.read_recbole_inter(spark, str(tmp_path))
    assert rows(got, "user", "item", "rating", "ts") == [("u1", "i1", 2.5, 7), ("u2", "i2", 3.0, 5), ("u3", 'i"3', 1.0, 2), ("x:token", "i1", 1.0, 1)]


@pytest.mark.parametrize("raw, clean", [('<b>A &amp; B</b>\r\n  "x"', "A & B x"), ("&lt;i&gt;t&lt;/i&gt;", "t"), (None, ""), ("", "")])
def test_clean_text(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "t string").select(X.clean_text(F.col("t"))).first()[0] == clean


def test_clean_lists_and_maps(spark):
    df = spark.createDataFrame([(["a", "b"], {"k": "1"})], "l array<string>, m map<string, string>")
    assert tuple(df.select(X.clean_list(F.col("l")), X.clean_map(F.col("m"))).first()) == ("a b", "k: 1")


def test_ratings_lines_that_do_not_cast_go(spark):
    path = new_path(spark, "lines")
    spark.createDataFrame([("B1,U1,5.0,10",), ("B1,U1,5.0",), ("B1,U1,x,10",), ("B1,U1,5.0,1.5",)], "v string").write.text(path)
    assert rows(readers.read_ratings_csv(spark, path), "user", "item", "rating", "ts") == [("U1", "B1", 5.0, 10)]


def test_movie_title(spark):
    path = new_path(spark, "movies")
    spark.createDataFrame([("1::Toy Story (1995)::Animation|Children",)], "v string").write.text(path)
    r = readers.read_movielens_movies(spark, path).first()
    assert (r.title, r.year, r.description) == ("Toy Story", 1995, "Toy Story (1995). Genres: Animation, Children")


def test_item_json_and_matrix(spark, tmp_path):
    (tmp_path / "item.json").write_text('{"3": {"title": "t", "brand": "b"}}')
    assert rows(readers.read_item_json(spark, f"file://{tmp_path}/item.json"), "item", "title", "brand") == [("3", "t", "b")]
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert rows(readers.read_embedding_matrix(spark, f"file://{tmp_path}/m.npy"), "item_id", "embedding") == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5])]
    big = np.random.default_rng(15).normal(size=(5000, 24))
    np.save(tmp_path / "big.npy", big)  # doubles, read as floats
    got = readers.read_embedding_matrix(spark, f"{tmp_path}/big.npy", 10_000)
    assert got.rdd.getNumPartitions() > 90
    assert np.allclose(np.array([x.embedding for x in got.orderBy("item_id").collect()]), big.astype(np.float32))
    np.save(tmp_path / "f.npy", np.asfortranarray(big))
    with pytest.raises(Exception, match="no plain matrix"):
        readers.read_embedding_matrix(spark, f"{tmp_path}/f.npy").count()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
def test_json_members_from_any_range(tmp_path, size):
    """Quotes, braces and backslashes in strings, nested values and scalars, cut at every place."""
    import json

    from lumenrec.sources import byteranges as B

    want = {"a": {"title": 'x " } \\', "n": [1, {"b": "]"}]}, 'q"\\': {"é😀": "\\\\"}, "s": "a:{", "t": None, "": {}, "ü": [[], "{"], "z": 5}
    for text in (json.dumps(want), json.dumps(want, ensure_ascii=False, indent=3).replace('":', '" :\n '), "{}", " "):
        path = str(tmp_path / "x.json")
        raw = text.encode()
        (tmp_path / "x.json").write_bytes(raw)
        inside, depth, got = False, 0, []
        for at in range(0, len(raw), size):
            got += B.members(path, at, min(len(raw), at + size), inside, depth)
            turns, out, in_ = B.summary(B._unescaped(path, at, raw[at : at + size]))
            inside, depth = inside != turns, depth + (in_ if inside else out)
        assert [(k, json.loads(v)) for k, v in got] == (list(want.items()) if len(text) > 5 else [])


def test_layout_tokens_and_prefixes(spark):
    book = spark.createDataFrame([(0, [3, 0, 1]), (1, [3, 1, 0])], "item_id long, codes array<int>")
    layout = K.vocab_layout(book, 4, 2)
    assert (layout["sizes"], layout["bases"], layout["mask"], layout["cls"], layout["sep"], layout["eos"], layout["vocab_size"]) == ([4, 4, 2], [0, 4, 8], 11, 12, 13, 14, 15)
    t = K.item_tokens(book, layout)
    assert rows(t, "item_id", "tokens") == [(1, [4, 5, 10]), (2, [4, 6, 9])]
    trie = K.token_trie(t, 14)
    assert rows(K.prefix_table(trie), "prefix", "next_tokens") == [([], [4]), ([4], [5, 6]), ([4, 5], [10]), ([4, 5, 10], [14]), ([4, 6], [9]), ([4, 6, 9], [14])]
    edges = [(r.node, r.child) for r in trie.collect()]
    assert len({x for e in edges for x in e}) == 8 and len({c for _, c in edges} - {n for n, _ in edges}) == 2
    asked = spark.createDataFrame([([0, 4, 5],), ([0, 9],), ([0],), ([0, 4, 5, 10, 14, 1],), ([0, 4, 5],)], "input_ids array<int>")
    assert rows(K.allowed_next_tokens(asked, trie, 14, skip_bos=1), "input_ids", "next_tokens") == [([0], [4]), ([0, 4, 5], [10]), ([0, 4, 5], [10]), ([0, 4, 5, 10, 14, 1], [14]), ([0, 9], [14])]
    with pytest.raises(Exception, match="bad codes"):
        K.item_tokens(spark.createDataFrame([(0, [4, 0, 0])], "item_id long, codes array<int>"), layout).collect()


def test_digit_and_code_reports(spark):
    book = spark.createDataFrame([(0, [1, 2]), (1, [1, 2]), (2, [0, 0]), (3, [1, 2])], "item_id long, codes array<int>")
    assert rows(Q.dedup_digit(book, 2), "item_id", "digit") == [(0, 0), (1, 1), (2, 0), (3, 0)]
    assert tuple(Q.dedup_report(book, 2).first()) == (3, 1)
    usage = Q.code_usage(spark.createDataFrame([(i, [c]) for i, c in enumerate((0, 0, 1, 1))], "item_id long, codes array<int>"))
    r = Q.code_report(usage, 4).first()
    assert r.utilization == 0.5 and abs(r.entropy_gap - 0.5) < 1e-4


def test_cohesion_of_two_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 3**0.5 / 2])], "item_id long, embedding array<double>")
    book = spark.createDataFrame([(0, [1]), (1, [1])], "item_id long, codes array<int>")
    assert abs(Q.prefix_cosine_cohesion(v, book).first().cohesion - 0.5) < 1e-9


def test_residual_error_falls_by_level(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "item_id long, embedding array<double>")
    books = Q.fit_residual_kmeans(v, 3, 8, iterations=3)
    left = [np.linalg.norm(Q._residual_codes(x, books[:n], False)[1]) for n in range(4)]
    assert left == sorted(left, reverse=True)
    rotation, _ = Q.fit_opq(v, 2, 4, rounds=1, iterations=1)
    assert np.allclose(rotation @ rotation.T, np.eye(8))


def test_categories(spark):
    items = spark.createDataFrame([(i, p) for i, p in enumerate(["All,A,B"] * 3 + ["X,Y"])], "item_id long, p string")
    c = C.initial_category(C.strip_dominant_root(items.withColumn("tokens", C.category_tokens(F.col("p")))))
    assert {r.dominant for r in c.collect()} == {"All"}
    assert sorted(r.category for r in c.collect()) == ["A > B"] * 3 + ["X > Y"]


def cand(spark, items, scores=None, cates=None):
    n = len(items)
    return spark.createDataFrame([(1, r + 1, items[r], float((scores or [0] * n)[r]), (cates or [0] * n)[r]) for r in range(n)], "user long, rank long, item_id long, score double, cate_id long")


def test_accuracy_and_diversity(spark):
    hits = spark.createDataFrame([(1, 3)], "user long, hit_rank long")
    assert rows(R.recall_ndcg(hits, (5,)), "recall", "ndcg") == [(1.0, 0.5)]
    cates = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (9, 3), (8, 4)], "item_id long, cate_id long")
    c = cand(spark, [1, 2, 3]).drop("cate_id")
    assert abs(R.diversity_at_n(c, cates).first().diversity - 4 / 6) < 1e-12
    s = R.scd(c, cates).first()
    assert (s.scd, s.weighted_scd) == (0.5, 1.5)
    assert R.scd(cand(spark, [1, 77]).drop("cate_id"), cates).count() == 0
    truth = spark.createDataFrame([(1, 1)], "user long, item_id long")
    assert R.alpha_ndcg_at_k(cand(spark, [-1, 1]).drop("cate_id"), truth, cates, 2).first().alpha_ndcg == 1.0


def test_rerank(spark):
    c = cand(spark, [1, 2, 3, 4], [4, 3, 2, 1], [0, 0, 1, 1])
    order = lambda **o: [r.item_id for r in R.mmr_rerank(c, 0.5, 4, **o).orderBy("rank").collect()]
    assert order(div_scale=2.0) == [1, 3, 2, 4]
    assert order(div_scale=0.5) == [1, 2, 3, 4]
    assert [r.item_id for r in R.mmr_rerank(cand(spark, [5, 6, -1], [2, 1, 3]), 1.0, 3).orderBy("rank").collect()] == [5, 6, 6]
    assert [r.item_id for r in R.mmr_rerank(c, 1.0, 4).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_item_scores_both_ways(spark):
    logits = spark.createDataFrame([(u, l, [float(np.sin(u + l * k)) for k in range(3)]) for u in range(4) for l in range(2)], "user long, level int, logits array<double>")
    book = spark.createDataFrame([(i, [i % 3, i // 3]) for i in range(9)], "item_id long, codes array<int>")
    a, b = R.score_items_by_codes(logits, book, 3, block=4), R.score_items_relational(logits, book, 3)
    near = lambda df: [(u, i, round(s, 9)) for u, i, s in rows(df, "user", "item_id", "score")]
    assert near(a) == near(b)


def test_item_scores_over_blocks_of_any_size(spark):
    """One block, blocks by one and two leading codes, few users a task: the same items, ties by item."""
    r = np.random.default_rng(3)
    z, codes = np.round(r.normal(size=(60, 3, 6)), 1), r.integers(0, 6, (900, 3))
    logits = spark.createDataFrame([(u, l, z[u, l].tolist()) for u in range(60) for l in range(3)], "user long, level int, logits array<double>")
    book = spark.createDataFrame([(i, codes[i].tolist()) for i in range(900)], "item_id long, codes array<int>")
    every = R.score_items_by_codes(logits, book, 7).collect()
    want = []
    for u in range(60):
        s = sum(log_softmax(z[u])[l, codes[:, l]] for l in range(3))
        want += [(u, n + 1, int(i) + 1, round(float(s[i]), 9)) for n, i in enumerate(np.lexsort((np.arange(900), -s))[:7])]
    plain = lambda found: sorted((x.user, x["rank"], x.item_id, round(x.score, 9)) for x in found)
    assert plain(every) == want
    for block, users in ((40, 7), (8, 4096), (1, 20)):
        assert plain(R.score_items_by_codes(logits, book, 7, block=block, task_users=users).collect()) == want
    assert R.score_items_by_codes(logits, book.limit(0), 7).count() == 0 and R.score_items_by_codes(logits.limit(0), book, 7).count() == 0


def test_alpha_ndcg_keeps_the_rank_of_candidates_without_category(spark):
    cates = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "item_id long, cate_id long")
    truth = spark.createDataFrame([(1, 1), (1, 2)], "user long, item_id long")
    of = lambda items, k=10: R.alpha_ndcg_at_k(cand(spark, items).drop("cate_id"), truth, cates, k).collect()
    ideal = 1 + 0.5 / np.log2(3)
    assert of([50, 1, 3, 2])[0].alpha_ndcg == pytest.approx((1 / np.log2(3) + 0.5 / np.log2(5)) / ideal)
    assert of([-1, 50, 1])[0].alpha_ndcg == pytest.approx(1 / np.log2(3) / ideal)
    assert [r.alpha_ndcg for r in of([50, 51])] == [0.0] and of([-1, -1]) == []


def plain_mmr(score, cate, valid, lam, top_k, div_power=1.5, div_scale=2.0, div_exp=1.0, rank_power=1.0, rank_scale=0.0, rel_power=1.0, rel_scale=0.0, rel_exp=1.0, pop_scale=0.0, pop_power=1.0, cap_lambda=0.0, max_per_cate=0, diverse_k=0, tie=0.0, rank_norm=False):
    """The formula, number by number."""
    n = len(score)
    lo, hi = min(score), max(score)
    rel = [(s - lo) / (hi - lo + 1e-12) for s in score]
    by_rel = sorted(range(n), key=lambda i: (-rel[i], i))
    rank_pen = [0.0] * n
    for place, i in enumerate(by_rel):
        rank_pen[i] = (place + 1) / n

    def ranks(v, among, largest_first):
        out = [0.0] * n
        for place, i in enumerate(sorted(among, key=lambda i: (-v[i] if largest_first else v[i], i))):
            out[i] = 1 - place / (len(among) - 1) if len(among) > 1 else 1.0
        return out

    open_ = [i for i in range(n) if valid[i]]
    named = [i for i in open_ if cate[i] >= 0]
    pop = [(sum(cate[j] == cate[i] for j in named) / len(named)) ** pop_power if i in named else 0.0 for i in range(n)]
    if rank_norm:
        rel, rank_pen = ranks(rel, open_, True), ranks(rank_pen, open_, False)
    taken, out = {}, []
    for t in range(top_k):
        if not open_:
            out.append(out[-1] if out else 0)
            continue
        pen = [(1 - np.exp(-div_scale * taken[c] ** div_exp) if taken.get(c) else 0.0) + pop_scale * pop[i] for i, c in enumerate(cate)]
        may = open_
        if lam < cap_lambda and max_per_cate > 0 and (diverse_k <= 0 or t < diverse_k):
            may = [i for i in open_ if taken.get(cate[i], 0) < max_per_cate] or open_
        if rank_norm:
            pen = ranks(pen, may, True)
        value = lambda i: lam * rel[i] - (1 - lam) ** div_power * pen[i] - rank_scale * (1 - lam) ** rank_power * rank_pen[i] - rel_scale * (1 - lam) ** rel_power * min(max(rel[i], 0), 1) ** rel_exp + tie * rel[i]
        best = max(may, key=lambda i: (round(value(i), 9), -i))
        open_ = [i for i in open_ if i != best]
        out.append(best)
        if cate[best] >= 0:
            taken[cate[best]] = taken.get(cate[best], 0) + 1
    return out


@pytest.mark.parametrize("options", [{}, {"pop_scale": 0.7, "pop_power": 0.5}, {"rank_norm": True}, {"rank_norm": True, "pop_scale": 0.5, "rank_scale": 0.6, "rel_scale": 0.3}, {"cap_lambda": 0.6, "max_per_cate": 1}, {"cap_lambda": 0.6, "max_per_cate": 2, "diverse_k": 3, "rank_norm": True}, {"rank_scale": 0.4, "rel_scale": 0.5, "rel_exp": 2.0, "tie": 1e-6}])
def test_rerank_against_the_formula(options):
    rng = np.random.default_rng(5)
    b, n = 60, 12
    there = np.arange(n) < rng.integers(1, n + 1, b)[:, None]
    score, cate = rng.normal(size=(b, n)), rng.integers(-1, 4, (b, n))
    valid = there & (rng.random((b, n)) < 0.8)
    for lam in (0.0, 0.3, 0.5, 1.0):
        got = R.mmr_orders(score, cate, valid, there, np.full(b, lam), 8, **options)
        for i in range(b):
            m = there[i].sum()
            want = plain_mmr(score[i, :m].tolist(), cate[i, :m].tolist(), valid[i, :m].tolist(), lam, 8, **options)
            if not (valid[i].any()):
                want = [0] * 8
            assert got[i].tolist() == want, (i, lam)


def test_amazon_metadata_is_trimmed(spark):
    import json

    path, old = new_path(spark, "meta"), new_path(spark, "meta14")
    lines = [{"asin": "a", "title": "T", "description": ["x", "y"], "brand": " by\n B ", "category": [" C ", "x</span>", "D\u00a0"]}, {"asin": "", "title": "gone"}, {"asin": "n", "title": "N"}]
    spark.createDataFrame([(json.dumps(x),) for x in lines], "v string").write.text(path)
    keys = ("item", "title", "description", "brand", "categories")
    assert rows(readers.read_amazon_metadata(spark, path), *keys) == [("a", "T", "x y", "B", "C,D"), ("n", "N", "", "", "")]
    spark.createDataFrame([(repr({"asin": "a", "title": "T", "categories": [[" C", "x</span>", "D "]]}),), (repr({"title": "gone"}),), ("{",)], "v string").write.text(old)
    assert rows(readers.read_amazon_metadata(spark, old, 14), *keys) == [("a", "T", "", "", "C,D")]


def test_genre_fallback(spark):
    items = spark.createDataFrame([(0, "", [" Drama "], "b"), (1, "", ["  "], "b"), (2, "", [], "b")], "item_id long, p string, genres array<string>, brand string")
    c = C.initial_category(C.strip_dominant_root(items.withColumn("tokens", C.category_tokens(F.col("p")))))
    assert rows(c, "item_id", "category") == [(0, "Drama"), (1, "Brand: b"), (2, "Brand: b")]


def test_lloyd_rounds_against_plain_numpy(spark):
    """Two levels of two rounds from a fixed start, and one round of product codes."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "item_id long, embedding array<double>").repartition(5)
    start = np.stack([x[:4], x[4:8] * 0.5])
    got = Q.fit_residual_kmeans(v, 2, 4, iterations=2, start=start)
    left = x
    for level in range(2):
        now = start[level]
        for _ in range(2):
            near = ((left[:, None] - now) ** 2).sum(axis=2).argmin(axis=1)
            now = np.stack([left[near == c].mean(axis=0) for c in range(4)])
        assert np.allclose(got[level], now)
        left = left - now[((left[:, None] - now) ** 2).sum(axis=2).argmin(axis=1)]
    books = Q.fit_pq(v, 2, 4, iterations=3)
    codes = {r.item_id: r.codes for r in Q.encode_pq(v, books).collect()}
    near = np.stack([((x[:, None, 3 * m : 3 * m + 3] - books[m]) ** 2).sum(axis=2).argmin(axis=1) for m in range(2)], axis=1)
    assert all(codes[i] == near[i].tolist() for i in range(200))
    error = lambda r, b: sum((((x @ r)[:, None, 3 * m : 3 * m + 3] - b[m]) ** 2).sum(axis=2).min(axis=1).sum() for m in range(2))
    assert error(*Q.fit_opq(v, 2, 4, rounds=2, iterations=3)) <= error(np.eye(6), books) * 1.05


def test_embedding_tables(spark):
    from lumenrec.operators import embeddings as E

    texts = spark.createDataFrame([(0, " a  b "), (1, None), (2, "bad")], "item_id long, text string")

    def encoder(batch):
        if "bad" in batch:
            raise ValueError
        return np.array([[len(t), t == "N/A"] for t in batch])

    assert rows(E.embed_batches(texts, 2, encoder, batch=1).where("item_id < 9"), "item_id", "embedding") == [(0, [3, 0]), (1, [3, 1]), (2, [0, 0])]
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "item_id long, embedding array<double>")
    out, kept = E.standardize_pca(v, 2)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values, axes = np.linalg.eigh(z.T @ z)
    axes = axes[:, [-1, -2]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    got = np.array([r.embedding for r in out.orderBy("item_id").collect()])
    assert kept == pytest.approx(values[-2:].sum() / values.sum()) and np.allclose(got, z @ axes)
    again = np.array([r.embedding for r in E.standardize_pca(v.repartition(5), 2)[0].orderBy("item_id").collect()])
    assert np.allclose(got, again)
    far = v.select("item_id", F.transform("embedding", lambda a: a * 1e-3 + 1e6).alias("embedding"))
    assert np.allclose(np.array([r.embedding for r in E.standardize_pca(far, 2)[0].orderBy("item_id").collect()]), got, atol=1e-5)
    ragged = v.unionByName(spark.createDataFrame([(99, [1.0])], v.schema))
    assert E.standardize_pca(ragged, 2)[0].count() == 51 and E.standardize_pca(v.limit(0), 2)[1] == 1.0
    held = E.train_validation_split(v, 0.3)
    assert held.where("is_validation").count() == sum(r.is_validation for r in E.train_validation_split(v.repartition(7), 0.3).collect()) > 0


def test_pq_sample_is_exact_and_spread(spark):
    """Above the bound: the rows with the smallest hashes, in more than one task; as before for the codebook."""
    r = np.random.default_rng(13)
    v = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(3000)], "item_id long, embedding array<double>").repartition(6)
    got = Q.smallest_hashes(v, 500, 42)
    want = v.orderBy(F.xxhash64(F.lit(42), "item_id"), "item_id").limit(500)
    assert rows(got, "item_id") == rows(want, "item_id") and got.rdd.getNumPartitions() > 1
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(Q.smallest_hashes(v, 3000, 42), "item_id") == [(i,) for i in range(3000)]
    assert np.allclose(Q.fit_pq(v, 2, 4, 3, sample=500), Q.fit_pq(want, 2, 4, 3, sample=500))
    rotation, books = Q.fit_opq(v, 2, 4, rounds=1, iterations=2, sample=500)
    assert np.allclose(rotation @ rotation.T, np.eye(4)) and books.shape == (2, 4, 2)


def test_scaled_residual_codes(spark):
    """Z-scores before the first level, undone after the last; vectors of very different scales."""
    r = np.random.default_rng(14)
    x = r.normal(size=(200, 3)) * [1e-3, 1.0, 1e4] + [5.0, 0.0, -1e5]
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "item_id long, embedding array<double>")
    scale = Q.fit_scale(v)
    assert np.allclose(scale.mean, x.mean(axis=0)) and np.allclose(scale.std, x.std(axis=0, ddof=1))
    z = (x - scale.mean) / scale.std
    books = Q.fit_residual_kmeans(v, 2, 8, iterations=4, scale=scale)
    codes = {c.item_id: c.codes for c in Q.encode_residual(v, books, scale=scale).collect()}
    first = ((z[:, None] - books[0][None]) ** 2).sum(axis=2).argmin(axis=1)
    second = (((z - books[0][first])[:, None] - books[1][None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [codes[i] for i in range(200)] == np.stack([first, second], axis=1).tolist()
    near = {c.item_id: c.embedding for c in Q.reconstruct(Q.encode_residual(v, books, scale=scale), Q.centroid_table(spark, books), scale).collect()}
    assert np.allclose([near[i] for i in range(200)], (books[0][first] + books[1][second]) * scale.std + scale.mean)
    still = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "item_id long, embedding array<double>")
    assert Q.fit_scale(still).std[0] == 1e-6 and np.isfinite(Q.fit_scale(still.limit(1)).std).all()


def test_collaborative_vectors_against_numpy(spark):
    """Five kinds of items that rarely meet: products of vectors and the loss are those of the leading eigenvectors."""
    r = np.random.default_rng(11)
    data = []
    for u in range(150):
        kind = u % 5
        items = [int(kind * 8 + r.integers(8)) if r.uniform() < 0.9 else int(r.integers(40)) for _ in range(r.integers(2, 14))]
        data += [(u, i, 1.0, t) for t, i in enumerate(items)]
    o = I.in_order(spark.createDataFrame(data, "user long, item long, rating double, ts long").repartition(4), 3)
    want = np.zeros((40, 40))
    by = {}
    for u, i, _, _ in data:
        by.setdefault(u, []).append(i)
    for v in by.values():
        for p, q in [(p, q) for q in range(len(v)) for p in range(max(0, q - 3), q)]:
            if v[p] != v[q]:
                want[v[p], v[q]] += 1
                want[v[q], v[p]] += 1
    assert {(x.item_id, x.other, x.n) for x in E.item_cooccurrence(o, 3).collect()} == {(i, j, want[i, j]) for i, j in zip(*np.nonzero(want))}
    root = np.sqrt(want.sum(axis=1))
    a = want / np.outer(root, root)
    values, axes = np.linalg.eigh(a)
    lead = np.argsort(-values)[:5]
    best = axes[:, lead] @ np.diag(np.maximum(values[lead], 0)) @ axes[:, lead].T
    found, got = E.cf_item_vectors(o, dim=5, window=3, iterations=12)
    m = {x.item_id: np.array(x.embedding) for x in found.collect()}
    e = np.stack([m[i] for i in range(40)])
    assert np.allclose(got, values[lead], atol=0.01) and np.abs(e @ e.T - best).max() < 0.03
    assert np.linalg.norm(a - e @ e.T) < 1.005 * np.linalg.norm(a - best)
    unit = e / np.linalg.norm(e, axis=1, keepdims=True)
    kinds = np.arange(40) // 8
    assert (kinds[np.argsort(-(unit @ unit.T), axis=1)[:, 1:8]] == kinds[:, None]).mean() > 0.95
    assert E.cf_item_vectors(o.limit(0), dim=5)[0].count() == 0
