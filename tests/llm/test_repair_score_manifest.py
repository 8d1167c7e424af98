"""Conversation repair, quality scores and the Merkle manifest against brute force."""

import hashlib
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrec.llm import manifest, queries, repair, scoring

TURNS = "conv_id long, turn long, role string, text string"


def cheapest(initials, faults):
    """The least (cost, audit) over all edits of all rows, with up to two turns inserted before each and at the end."""
    best = None
    per_row = [["D"] if f in "bd" else ["D", "K", "Ru", "Ra"] for f in faults]
    gaps = [("",), ("u",), ("a",), ("u", "a")]
    for edits in product(*per_row):
        for inserts in product(gaps, repeat=len(edits) + 1):
            said, audit, cost = "", "", 0
            for i, ins in enumerate(inserts):
                for x in filter(None, ins):
                    said, audit, cost = said + x, audit + "I", cost + 5
                if i < len(edits):
                    e = edits[i]
                    audit += e[0]
                    cost += {"D": 2, "K": 0, "R": 1}[e[0]] + (5 if faults[i] == "t" and e != "D" else 0)
                    said += {"D": "", "K": initials[i]}.get(e, e[1:])
            rest = said[1:] if said[:1] == "s" else said
            if said == "" or (rest and rest == "ua" * (len(rest) // 2)):
                best = min(best or (99, ""), (cost, audit))
    return best


def test_agenda_by_brute_force():
    r = random.Random(3)
    for _ in range(60):
        n = r.randint(1, 4)
        initials, faults = "".join(r.choice("suax") for _ in range(n)), "".join(r.choice("..tbd") for _ in range(n))
        cost, path, closing = repair.fold([[w[:4] for w in repair.table("".join(a + b for a, b in zip(initials, faults)), (repair.START,))]])
        audit = dict(((p, q), a) for p, q, _, _, a in repair.table("".join(a + b for a, b in zip(initials, faults)), (repair.START,)))[path[0]] + closing
        assert (cost, audit) == cheapest(initials, faults)


def test_runs_of_rows_agree_with_one_run():
    r = random.Random(4)
    for _ in range(150):
        codes = ["".join((r.choice("suuaax"), r.choice("....tbd"))) for _ in range(r.randint(1, 14))]

        def whole(size):
            runs = ["".join(codes[i : i + size]) for i in range(0, len(codes), size)]
            tables = [repair.table(c, (repair.START,) if i == 0 else tuple(repair.STATES)) for i, c in enumerate(runs)]
            cost, path, closing = repair.fold([[w[:4] for w in t] for t in tables])
            return cost, "".join(next(w[4] for w in t if w[:2] == at) for t, at in zip(tables, path)) + closing

        assert len({whole(size) for size in (1, 2, 3, 5, 1024)}) == 1


def test_hot_conversation_is_many_runs(spark):
    """A third of all rows in one conversation, in ranges and runs of any number."""
    r = random.Random(5)
    said = lambda: "".join(r.choice("ab .!?") for _ in range(r.randint(0, 6)))
    rows = [(1, t, r.choice(("system", "user", "assistant", "tool", "", None)), said()) for t in range(700)]
    rows += [(c, t, r.choice(("user", "assistant")), said()) for c in range(2, 300) for t in range(r.randint(1, 8))]
    turns = spark.createDataFrame(rows, TURNS).repartition(3)
    found = [{x.conv_id: tuple(x) for x in repair.repair_report(turns, **o).collect()} for o in ({}, {"chunk": 16, "parts": 3}, {"chunk": 100, "parts": 40})]
    assert found[0] == found[1] == found[2] and len(found[0]) == 299
    _, report = repair.repair(turns, chunk=16, parts=3)
    assert {x.conv_id: x.audit for x in report.collect()} == {k: v[7] for k, v in found[0].items()}


def test_repaired_conversations_alternate(spark, tmp_path):
    turns = repair.damage(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    rows, report = repair.repair(turns)
    import re

    by = {}
    for x in rows.collect():
        by.setdefault(x.conv, []).append(x)
    audits = {x.conv: x.audit for x in report.collect()}
    assert len(by) > 80 and all(re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in v)) for v in by.values())
    assert all("".join(x.edit for x in v) == audits[c].replace("D", "") for c, v in by.items())


def test_null_roles_turns_and_ids(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (5, None, "user", "b."), (5, None, "assistant", "c."), (6, 1, "", "x."), (7, 0, "user", "hi."), (7, 4, "assistant", "ho.")]
    got = {x.conv_id: x for x in repair.repair_report(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(got) == {None, 5, 6, 7}
    assert (got[None].blank, got[None].audit) == (1, "DD") and got[5].gaps == 0
    assert (got[5].audit, got[5].cost) == ("RR", 2)  # the assistant's row comes first
    assert got[6].audit == "D" and got[6].illegal == 0
    assert (got[7].gaps, got[7].audit, got[7].repaired_sha256) == (3, "KK", hashlib.sha256(b"user:hi.\nassistant:ho.").hexdigest())


def tree(leaves):
    """Root and, for each leaf, its (before, after) steps."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for j, i in enumerate(at):
            run = runs[i // 3]
            paths[j].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        level, at = [manifest.digest("".join(x)) for x in runs], [i // 3 for i in at]
    return level[0], paths


def plain_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: manifest.digest("".join(map(enc, (r[0], r[2], r[3], r[4], text))))
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    sources, tops, out = sorted(by, key=lambda s: (s is not None, (s or "").encode())), [], []
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        tops.append(tree([leaf(r, r[1]) for r in by[s]]))
    root, above = tree([t[0] for t in tops])
    for s, (subroot, paths), over in zip(sources, tops, above):
        for r, path in zip(by[s], paths):
            even = r[0] is not None and __import__("zlib").crc32(str(r[0]).encode()) % 2 == 0
            h = leaf(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            for b, a in path + over:
                h = manifest.digest(b + h + a)
            out.append((r[0], leaf(r, r[1]), subroot, root, manifest.digest("".join(b + a for b, a in path + over)), h, h == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("depth,parts", [(1, 3), (2, 7), (6, 211)])
def test_manifest_by_brute_force(spark, depth, parts):
    """A third of all rows in one source, more sources than a run holds, null and repeated ids."""
    r = random.Random(6)
    source = lambda i: "hot" if i % 3 == 0 else r.choice([None, "", "ä", "b", *map(str, range(12))])
    rows = [(None if i % 41 == 0 else i % 190, r.choice([None, "", "a\nb", f"text {i}\n", "é\n" * 50]), source(i), r.choice([None, "en"]), r.choice([None, 7])) for i in range(220)]
    docs = spark.createDataFrame([(*x, "extra") for x in rows], "doc_id long, text string, source string, lang string, n_chars long, leaf string")
    got = manifest.manifest(docs.repartition(5), claimed=manifest.without_newlines(), depth=depth, parts=parts)
    assert sorted(str(tuple(x)) for x in got.collect()) == plain_manifest(rows)


def test_manifest_gives_proofs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = manifest.manifest(docs, keep_proof=True).collect()
    assert len(rows) == docs.count() and all(x.verified for x in rows)
    for x in rows:
        h = x.leaf
        for step in x.proof:
            h = manifest.digest(step.before + h + step.after)
        assert h == x.root


def test_pool_adjacent_violators():
    r = np.random.default_rng(7)
    for _ in range(30):
        y, w = r.uniform(size=8), r.integers(1, 5, 8).astype(float)
        got = scoring.pool_adjacent_violators(y, w)
        # the greatest of the least means of runs that cover a place
        mean = lambda i, j: (y[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()
        want = [max(min(mean(i, j) for j in range(k, 8)) for i in range(k + 1)) for k in range(8)]
        assert got == pytest.approx(want)


def test_features_approximate_the_kernel():
    r = np.random.default_rng(8)
    x = r.normal(size=(40, len(scoring.STATISTICS)))
    z = scoring.fourier(x, np.zeros(x.shape[1]), np.ones(x.shape[1]), 1, 8192)
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * x.shape[1]))
    assert np.abs(z @ z.T - exact).max() < 0.08


def test_normal_equations_are_sums_over_all_rows(spark):
    r = np.random.default_rng(9)
    x, y = r.normal(size=(300, len(scoring.STATISTICS))), r.integers(0, 2, 300).astype(float)
    train = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "stats array<double>, y double").repartition(7)
    zero, one = np.zeros(x.shape[1]), np.ones(x.shape[1])
    gram, cross = scoring.normal_equations(train, zero, one, 0.5, 3, 16)
    z = scoring.fourier(x, zero, one, 3, 16)
    assert gram == pytest.approx(z.T @ z) and cross == pytest.approx(z.T @ (y - 0.5))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op12_quality_scores"](spark, sf).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    seen = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got[got.held_out], on="doc_id")
    assert len(seen) > 800
    for q in (0, 1):
        assert (seen[seen.quality == q].predicted == q).mean() > 0.95
    assert (seen.predicted == seen.quality).mean() > 0.985


def test_held_out_labels_are_not_read(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    wrong = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"source": F.lit("x"), "lang": F.lit(None).cast("string"), "n_chars": F.lit(0)})
    a, b = (scoring.classify(d, x).toPandas().sort_values("doc_id") for d, x in ((docs, labels), (other, wrong)))
    assert np.abs(a.score.to_numpy() - b.score.to_numpy()).max() < 1e-5 and (a.predicted.to_numpy() == b.predicted.to_numpy()).all()


def test_quality_edges(spark):
    rows = [(None, None), (None, "x"), (1, ""), (1, ""), (2, "word " * 30_000), (3, "\x00 \x0b"), (4, "ä" * 10)]
    docs = spark.createDataFrame([(*x, "extra") for x in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        got = scoring.classify(docs, some).collect()
        assert len(got) == 7 and all(0 <= x.score <= 1 for x in got)
        assert not any(x.held_out for x in got if x.doc_id is None)
    assert {x.score for x in got} == {0.5}
