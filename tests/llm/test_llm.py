"""The training-data operators against oracles or brute force, on the given tables and on hard ones."""

import hashlib
import json
import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrec.llm import chat, fingerprints, licenses, minhash, mixing, packing, quality, queries, sharding, substrings, warc, windows
from lumenrec.llm.common import Scratch, stage
from tests.conftest import SF, plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, key string, shard string, n string, n_words string"


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghij") * r.randint(1, 3) + str(r.randint(0, 99)) for _ in range(n))


def hard_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with the operators' own names."""
    shared, long = words(60, 1), words(30_000, 2)
    texts = [
        None, "", " \n\t ", "one", "One Two three", words(4, 3), words(12, 4), words(12, 4).upper(), shared, shared + " tail of its own", "head " + shared, words(300, 5), words(300, 5) + " x", words(300, 5) + " y z",
        long, long + " end", "a " * 200, "line\nline\nline\nLine\r\nother line", "Released under the MIT License.\nand the mit license", "general public license general public license",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis", "Ünïcode ÄÖ     wörds 😀 " * 5, "nul \x00 \x0b \x0c tab\t", "the mit\nlicense",
    ]
    rows = [(i, t, None if i % 5 == 0 else "en", [None, "b", "a", ""][i % 4], None, True, "s", "k", "x", "n", "w") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hard"))
    rows = hard_rows()
    spark.createDataFrame(rows + rows[8:12], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/unique/documents.parquet")
    pages = [(1, "http://a", "x"), (2, None, "x"), (3, "http://b\r\nEvil: 1", ""), (4, "", None), (5, "u", "y\r\n\r\nWARC/1.1"), (9, "u", "x"), (None, "u", "z")]
    spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string").write.parquet(f"{path}/pages.parquet")
    turns = [(1, 0, "user", None), (1, 1, "assistant", r"a \ b <turn:x> </turn>" + "\n"), (2, None, None, "t"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 3, "ro>le<", "x"), (3, 1, "assistant", "\\" * 5), (3, 0, "user", words(5000))]
    spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, part string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(i, i % 2, 0, "extra") for i in range(12)] + [(None, 1, 0, "extra"), (3, None, None, None)], "doc_id long, quality int, toxic int, stats string").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def duck_of():
    import duckdb

    def of(path):
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations"):
            if os.path.isdir(f"{path}/{t}.parquet"):
                con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
        return con

    return of


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle_on_given_tables(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle_on_hard_tables(name, spark, hard, duck_of):
    path = f"{hard}/unique" if name.startswith("op3") else hard  # its SQL has one row an id
    assert plain(queries.QUERIES[name](spark, path).toPandas()) == plain(duck_of(path).sql(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(name, spark, hard, tmp_path):
    for t in ("documents", "pages", "conversations", "labels"):
        spark.read.parquet(f"{hard}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == (1 if name.startswith("op1_") else 0)


@pytest.mark.parametrize("name", [n for n in sorted(queries.QUERIES) if n[2:4] not in ("1_", "7_", "11")])
def test_null_ids_and_repeated_rows_are_kept(name, spark, hard, tmp_path):
    d = spark.read.parquet(f"{hard}/documents.parquet")
    spark.read.parquet(f"{hard}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    d.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id"))).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert len(out if not name.startswith("op5") else out[out.start == 0]) == d.count()


def test_chat_templates():
    render = lambda t, m: "".join(x for x, _ in chat.compile_template(t)(iter(m)))
    m = [{"role": "user", "text": " a "}, {"role": "bot", "text": "b"}]
    assert render("{% for m in messages %}{% if loop.first %}[{% elif m.role != 'bot' or false %}?{% else %}-{% endif %}{{ m.text | trim | upper }}{% if loop.last %}]{% endif %}{% endfor %}", m) == "[A-B]"
    assert chat.fold(chat.parse("{{ 'a' + 'b' }}c{% if 1 == 1 %}d{% else %}e{% endif %}")) == ("block", [("out", ("const", "abcd"))])
    for bad in ("{{ m.__class__ }}", "{% for m in messages %}{{ m.text.format }}{% endfor %}", "{{ open }}", "{% import os %}", "{% if true %}", "{{ 'a' | nofilter }}", "{% for a in messages %}{% for b in messages %}{% endfor %}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_chat_texts_survive(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["\\", "<turn", "</turn>\n", ">", "\n", "a", "é"]) for _ in range(r.randint(0, 12))) for _ in range(200)]
    out = "".join(x for x, _ in chat.compile_template(chat.TEMPLATE)(iter([{"role": t[:3], "text": t} for t in texts])))
    assert list(chat.read_turns(out)) == [(t[:3], t) for t in texts]
    turns = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(turns, part_chars=40)
    assert parts.count() > 5
    got = chat.read_back(parts).first()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (200, sum(map(len, texts)), hashlib.sha256("".join(texts).encode()).hexdigest())


def test_mix_meets_targets(spark):
    out = queries.QUERIES["op2_mix_sources"](spark, SF).toPandas()
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").toPandas().merge(out, on="doc_id")
    by = d.groupby("source").agg({"taken": "sum", "target": "first", "size": "sum"})
    assert (by.taken == np.floor(by.target)).all() and (d.taken <= 3 * d["size"]).all()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    got = mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).toPandas().set_index("source").n
    assert got.to_dict() == by.taken[by.taken > 0].to_dict()


def test_targets_reshare_in_rounds(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 0, "e": 3000}
    got = dict(mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).select("source", "target").collect())
    w = dict(zip(sizes, (5, 2, 1, 5, 2)))
    left, open_, want = sum(sizes.values()), set(sizes), {}
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        open_ -= over
    assert got == pytest.approx(want | share)


def test_shingles_and_signatures():
    a, b = words(400, 1), words(400, 1) + " " + words(100, 2)
    x, y = minhash.shingle_set(a), minhash.shingle_set(b)
    truth = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    lx, ly = minhash.packed(minhash.minima(x)), minhash.packed(minhash.minima(y))
    d = lx ^ ly
    agree = minhash.LANES - sum(int(v).bit_count() for v in ((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)))
    assert abs((agree / minhash.LANES - 0.25) / 0.75 - truth) < 0.2
    assert len(minhash.shingle_set("A b")) == 1 and len(minhash.shingle_set(None)) == 0
    assert (minhash.shingle_set("A b") == minhash.shingle_set("a\tB")).all()


def test_components_find_long_chains(spark):
    n = 40
    labels = spark.createDataFrame([(i, i) for i in range(n)], "node long, label long")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i != 20], "a long, b long")
    out = dict(minhash.components(labels, links, Scratch(spark, "test")).collect())
    assert {out[i] for i in range(21)} == {0} and {out[i] for i in range(21, n)} == {21}


def drifting(r):
    """Copies that drift: neighbours are links, the ends are not, and the leader is linked with few."""
    w = words(100, 9).split()
    return [" ".join([*[f"n{i}x{j}" for j in range(3 * i)], *w[3 * i :]]) for i in range(20)]


def damaged(r):
    """Copies of one text with few to many changed words, of rare and of common kinds, and some cut short."""
    w = words(120, 4).split()
    out = []
    for i in range(150):
        x = [(f"c{r.randrange(9)}" if r.random() < 0.5 else f"u{i}x{k}") if r.random() < i / 1500 else v for k, v in enumerate(w)]
        out.append(" ".join(x[: r.choice([120, 120, 100, 92])]))
    return out


@pytest.mark.parametrize("make", [drifting, damaged])
@pytest.mark.parametrize("without_leaders", [False, True])
def test_hard_groups_against_all_pairs(spark, make, without_leaders, monkeypatch):
    if without_leaders:  # every link is left to the exact join across components
        monkeypatch.setattr(minhash, "_confirm", lambda pairs, sets, percent, f=minhash._confirm, n=iter(range(9)): f(pairs.limit(0) if next(n) == 0 else pairs, sets, percent))
    texts = make(random.Random(8))
    n = len(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(d).collect()}
    sets, want = [set(map(int, minhash.shingle_set(t))) for t in texts], list(range(n))
    links = [(a, b) for a in range(n) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in range(n):
        before = list(want)
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
        if want == before:
            break
    assert got == dict(enumerate(want))


def test_keep_first_agrees_with_kept(spark):
    a, b = words(60, 1), words(70, 2)
    rows = [(1, a, "x"), (None, a, "y"), (None, a.upper(), "z"), (2, a + " tail", "q"), (None, b, "y"), (None, b + " tail", "z"), (None, b, "y"), (5, words(50, 3), "s"), (5, words(50, 3), "t"), (5, words(50, 4), "s"), (7, "", "s"), (7, None, "t"), (None, None, "u")]
    d = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = minhash.keep_first(d)
    got = [tuple(r) for r in kept.collect()]
    assert kept.columns == d.columns and all(r in rows for r in got)
    ids = [r[0] for r in got]
    assert ids.count(1) == 1 and ids.count(2) == 0 and ids.count(5) == 2 and ids.count(7) == 2
    assert sum(r[0] is None and r[1] is not None for r in got) == 1 and got.count((None, None, "u")) == 1
    marked = minhash.near_duplicates(d).where("kept AND n_shingles > 0").distinct().collect()
    assert {r.doc_id for r in marked} == {r[0] for r in got if r[1]}


def test_frequent_lines_at_a_low_limit(spark, hard, duck_of):
    """The rule itself against SQL where lines go: few tables have lines above the limit of production."""
    for path, most in ((SF, 2), (hard, 0)):
        con = duck_of(path)
        if path == SF:
            con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        got = quality.judge(spark.read.parquet(f"{path}/documents.parquet"), max_docs=most).select("doc_id", *quality.RESULTS).drop("clean_text").toPandas()
        assert (got.n_left < got.n_words).any()
        assert plain(got) == plain(con.sql(queries.quality_oracle(most)).df())


def test_lines_go_and_documents_are_rejected_on_a_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    began = time.time()
    d = quality.judge(docs)
    touched, rejected = d.where("n_left < n_words").count(), d.where("NOT kept AND NOT base_failed").count()
    assert touched > 500 and rejected > 3 and time.time() - began < 120
    small = quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).where("kept")
    assert len(small._jdf.queryExecution().optimizedPlan().toString()) < 8000


def test_frequent_lines_deplete(spark):
    rows = [(i, f"Buy now at our shop and save a lot today\n{words(3, i)}" if i < 30 else f"{words(40, i)}\nbuy  NOW at our shop and save a lot today", None, "h", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert not any(judged[i].kept for i in range(30)) and all(judged[i].kept for i in range(30, 60))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and all("shop" not in r.text and len(r.text) == r.n_chars for r in kept.collect())
    copies = spark.createDataFrame([(i, words(50, 1), None, "h", 1) for i in range(100)], docs.schema)
    assert quality.judge(copies).where("kept").count() == 100


def test_quality_rules_write_few_files(spark, monkeypatch):
    """Besides the documents' lines, a file a core at most, however many partitions there are: each file that an executor makes costs it a child process."""
    staged, options = [], {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    monkeypatch.setattr(quality, "stage", lambda df, name: staged.append((name, stage(df, name))) or staged[-1][1])
    docs = spark.createDataFrame([(i, "\n".join(f"line {i % 50} {k}" for k in range(8)), None if i % 3 else "h") for i in range(300)], "doc_id long, text string, source string")
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        judged = quality.judge(docs, max_docs=0).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(judged) == 300 and all(r.n_left == 0 and not r.kept for r in judged)
    assert sum(len(t.inputFiles()) for name, t in staged if name != "document-lines") <= spark.sparkContext.defaultParallelism
    assert staged[1][1].count() == 2 * 50 * 8


def test_ids_are_those_of_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(*packing.default_tokenizer()).encode
    r = random.Random(1)
    texts = [t or "" for _, t, *_ in hard_rows() if not t or len(t) < 5000] + ["<|endoftext|> a<|endoftext|>", "it's I'LL 123abc  \n\n x　y​", "🏳️‍🌈 café é"]
    texts += ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 0x24F), r.randint(0x370, 0x5FF), r.randint(0x4E00, 0x9FFF), 32, 10])) for _ in range(60)) for _ in range(300)]
    import pyarrow.parquet as pq

    texts += [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    for t in texts:
        assert encode(t, allowed_special="all") == reference.encode(t, add_special_tokens=False).ids, t


def check_packing(out, n_docs, check_start=True):
    assert (out.length > 0).all() and (out.length <= 1024).all()
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    if check_start:
        for _, p in out.sort_values("start").groupby("doc_id"):
            assert p.start.tolist() == [0, *np.cumsum(p.length)[:-1]] and p.length.sum() == p.doc_tokens.iloc[0]
        assert out.doc_id.nunique() == n_docs


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    out = queries.QUERIES["op5_pack_sequences"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").text
    check_packing(out, len(docs))
    assert out.length.sum() / (1024 * out.sequence_id.nunique()) > 0.97
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*t.encode(x, add_special_tokens=False).ids, 0], dtype="<u4") for d, x in docs.items()}
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in out.itertuples())
    whole = packing.sequences(packing.pack(spark.read.parquet(f"{SF}/documents.parquet").limit(20))).collect()
    assert all(len(s.ids) == 4 * s.length for s in whole)


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(0)
    for n in (1, 50, 5000):
        sizes, demand = np.unique(rng.integers(1, 65, n), return_counts=True)
        plan = packing.solve(sizes, demand.astype(float), 128)
        used = np.zeros(len(sizes), dtype=int)
        for pattern, times in plan:
            assert sum(sizes[i] * k for i, k in pattern.items()) <= 128
            for i, k in pattern.items():
                used[i] += k * times
        assert (used == demand).all() and sum(t for _, t in plan) <= 1.02 * (sizes @ demand) / 128 + 2


def test_shards(spark, hard):
    for path in (SF, hard):
        docs = spark.read.parquet(f"{path}/documents.parquet")
        out = queries.QUERIES["op6_shard"](spark, path).toPandas()
        want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in docs.toPandas().text)
        assert sorted(zip(out["size"], out.text_crc32)) == want
        assert all(sorted(s.slot) == list(range(len(s))) for _, s in out.groupby("shard"))
        assert ((out.grown_shard == out.shard) | (out.grown_shard == 24)).all() and out.shard.between(0, 23).all()
        assert (out.groupby("doc_id").shard.nunique() == 1).all()
    small = sharding.shard(docs, 3, bucket_bytes=100).toPandas()
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in small.groupby("shard")) and len(small) == docs.count()


def test_shards_follow_from_the_rows_alone(spark, tmp_path):
    docs, key = spark.read.parquet(f"{SF}/documents.parquet"), "spark.sql.shuffle.partitions"
    before, found = spark.conf.get(key), []
    try:
        for n in (3, 8, 211):
            spark.conf.set(key, n)
            path = f"{tmp_path}/{n}"
            back = sharding.write_shards(sharding.shard(docs.repartition(n), 5, bucket_rows=16), path)
            found.append(sorted(map(tuple, back.select("doc_id", "text", "shard", "slot", "grown_shard").collect())))
    finally:
        spark.conf.set(key, before)
    assert found[0] == found[1] == found[2] and len(found[0]) == docs.count()
    for part in os.listdir(f"{tmp_path}/3/shard=2"):
        if part.endswith(".parquet"):
            slots = [r.slot for r in spark.read.parquet(f"{tmp_path}/3/shard=2/{part}").select("slot").collect()]
            assert slots == sorted(slots)
    by_slot = [i for i, *_ in sorted((r for r in found[0] if r[2] == 0), key=lambda r: r[3])]
    assert by_slot != sorted(by_slot)


def test_warc_records(spark, hard):
    a = warc.write(spark.read.parquet(f"{hard}/pages.parquet"))
    assert a.payloads().count() == 4
    for r in a.records().collect():
        head, block = bytes(r.record).decode().split("\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(block.encode()) - 4 and "Evil" not in fields
        assert (fields["WARC-Type"] == "response") == bytes(r.record).endswith(bytes(r.payload) + b"\r\n\r\n") or not r.payload
    spark.createDataFrame([("0" * 64, bytearray(b"x"))], "digest string, payload binary").write.mode("overwrite").parquet(f"{a.path}/payloads")
    spark.createDataFrame([(1, "0" * 64, "WARC/1.1\r\nWARC-Type: response\r\n\r\n")], "page_id long, digest string, header string").write.mode("overwrite").parquet(f"{a.path}/headers")
    with pytest.raises(Exception, match="damaged payload"):
        a.records().collect()


def test_license_join_matches_brute_force(spark):
    r = random.Random(3)
    lines = []
    for _, t in licenses.TEMPLATES:
        for drop in range(4):
            w = t.split()
            for _ in range(drop):
                w.pop(r.randrange(len(w)))
            r.shuffle(w)
            lines.append(" ".join(w) + " " + words(drop, drop))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    prepared = licenses.prepare(docs)
    got = licenses.template_join(prepared).join(prepared.select("key", "doc_id"), "key").select("doc_id", "template").collect()
    sets = [set(licenses.template_words(t)) for _, t in licenses.TEMPLATES]
    want = {(i, k) for i, line in enumerate(lines) for k, s in enumerate(sets) if len(s & set(licenses.template_words(line))) >= licenses.CONTAINMENT * len(s) - 1e-9}
    assert {tuple(x) for x in got} == want


def test_window_hashes_by_doubling():
    w = windows.word_hashes(windows.words_of(words(100)))
    for size in (1, 5, 9, 18, 35):
        h = windows.window_hashes(w, size)
        assert len(h) == len(w) - size + 1 and (h[3:] == windows.window_hashes(w[3:], size)).all()
    assert len(windows.window_hashes(w, 101)) == 0


def test_fingerprints_against_brute_force(spark, hard, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 20)
    for path in (SF, f"{hard}/unique"):
        docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
        out = queries.QUERIES["op10_fingerprints"](spark, path).toPandas().set_index("doc_id")
        texts, ids = [t or "" for t in docs.text], docs.doc_id.tolist()
        for i, (d, t) in enumerate(zip(ids, texts)):
            after, half = texts[(i + 1) % len(texts)], len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            r = out.loc[d]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
            assert r.fingerprint == fingerprints.fingerprint_of(t) and r.near_edited == fingerprints.likeness_of(r.fingerprint, fingerprints.fingerprint_of(edited))
            assert r.near_next == fingerprints.likeness_of(r.fingerprint, fingerprints.fingerprint_of(after))


def test_tree_differences_locate_edits(spark):
    lines = [words(8, i) for i in range(40)]
    edited = [*lines[:17], "changed here", *lines[18:]]
    of = lambda x: fingerprints.trees(spark.createDataFrame([(1, "\n".join(x))], "doc_id long, text string"))
    new = "\n".join(edited)
    assert [new[r.start : r.end] for r in fingerprints.differences(of(lines), of(edited)).collect()] == ["changed here"]
    assert fingerprints.differences(of(lines), of(lines)).count() == 0


CLASHING = ["starts", "_key", "_words", "_row", "_lines", "row", "words", "lines", "at", "gone", "host", "doc", "label", "node", "k0", "cut", "kept_text", "kept", "clean_text", "in0", "size", "key", "taken", "n_words", "part", "of", "a.b", "in3", "target", "source_size"]


@pytest.mark.parametrize("table", ["hard", "clashing", "nulls", "empty"])
def test_stages_on_hard_tables(spark, hard, table):
    """Every stage of the pipeline takes any rows and columns, and returns the columns that it got."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{hard}/documents.parquet")
    if table == "clashing":
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    elif table == "nulls":
        docs = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    elif table == "empty":
        docs = docs.limit(0)
    for name, f in P.STAGES:
        out = stage(f(spark, docs, SF), "test-stage")
        if name != "packing":
            assert out.columns == docs.columns
            if table == "clashing":
                rows = out.collect()
                assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASHING)
        assert out.count() > 0 or table == "empty"


def test_pipeline_against_sql(spark, tmp_path, duck_of):
    """Stage by stage against what the DuckDB oracles say on its own input."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, f in P.STAGES:
        spark_dir = f"{tmp_path}/{name.replace(' ', '-')}"
        docs.write.parquet(f"{spark_dir}/documents.parquet")
        out = stage(f(spark, docs, SF), "test-stage")
        before, after = docs.toPandas(), out.toPandas()
        if name == "packing":
            check_packing(after, None, False)
            assert (after.groupby("doc_id").doc_tokens.first() > 0).all() and set(after.doc_id) == set(before.doc_id)
        else:
            assert out.columns == docs.columns
        if name == "quality rules":
            want = duck_of(spark_dir).sql(queries.ORACLES["op4_quality_rules"]).filter("kept").df().doc_id
            assert sorted(want) == sorted(after.doc_id)
        elif name == "near duplicates":
            want = duck_of(spark_dir).sql(queries.ORACLES["op3_minhash_dedup"]).filter("kept").df().doc_id
            assert sorted(want) == sorted(after.doc_id)
        elif name == "substring dedup":
            q = duck_of(spark_dir).sql(queries.ORACLES["op9_substring_dedup"]).df().set_index("doc_id")
            assert sorted(q[(q.n_removed == 0) | (q.n_removed < q.n_words)].index) == sorted(after.doc_id)
            for r in after.itertuples():
                assert q.kept_sha256[r.doc_id] == hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest()
        elif name == "mixing":
            q = duck_of(spark_dir).sql(queries.ORACLES["op2_mix_sources"]).df()
            taken = after.assign(n=[len(windows.words_of(t)) for t in after.text]).groupby("doc_id").n.sum()
            assert taken.to_dict() == {d: t for d, t in zip(q.doc_id, q.taken) if t}
        docs = out
    assert json.dumps([n for n, _ in P.STAGES])


def test_quality_rules_where_lines_are_frequent(spark):
    """The rule acts on the larger table: lines go and documents with too little left are rejected, as SQL says."""
    import duckdb

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got, want = queries.QUERIES["op4_quality_rules"](spark, sf).toPandas(), con.sql(queries.quality_oracle()).df()
    assert plain(got) == plain(want)
    assert (got.n_left < got.n_words).sum() > 500 and (~got.kept & ~got.base_failed).sum() > 3


@pytest.mark.parametrize("names", [("_c", "_from", "_first", "_class", "_rank", "n"), ("in0", "in4", "offset", "sequence_id", "_sequence", "_offset", "_salt")])
def test_packing_and_mixing_carry_any_column(spark, names):
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2], *[f"{c}{i}" for c in names]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    pieces = packing.pieces(docs).join(docs.select("doc_id", *names), "doc_id")
    placed = packing.place(pieces).collect()
    assert len(placed) == 40 and all(r[c] == f"{c}{r.doc_id}" for r in placed for c in names if c not in ("offset", "sequence_id"))
    assert all(isinstance(r.offset, int) and isinstance(r.sequence_id, int) for r in placed)
    names = (*names, "key", "part", "of", "carried", "first", "start", "by", "words", "epochs", "rest")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    mixed = mixing.mix(docs, carry=names).collect()
    assert len(mixed) == 40 and all(r[c] == f"{c}{r.doc_id}" for r in mixed for c in names)


def test_staged_tables_of_substrings_go(spark):
    """Also where the search ends early."""
    import os

    from lumenrec.functions.staging import shared_dir

    left = lambda: {d for d, _, files in os.walk(shared_dir(spark)) if "substrings-" in d and files}
    before = left()
    docs = spark.createDataFrame([(i, words(60, 100 + i)) for i in range(5)], "doc_id long, text string")
    assert substrings.cut(docs).agg(F.sum("n_removed")).first()[0] == 0
    assert all(d.rsplit("/", 1)[1].startswith("found") for d in left() - before)
