"""License notices across line breaks, and short templates that other licenses resemble."""

import random
import re

import pytest

from lumenrec.llm import licenses

RUNS = [(label, re.findall(licenses.WORD, text.lower()), text) for label, text in licenses.TEMPLATES]


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan(docs).collect()}


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_notices_wrapped_anywhere_are_found(prefix, spark):
    cases = []
    for label, _, text in RUNS:
        w = text.split()
        cases += [(label, f"{prefix}Some file\n{prefix}{' '.join(w[:k])}\n{prefix}{' '.join(w[k:])}\n{prefix}more text") for k in range(1, len(w))]
        cases += [(label, "\n".join(prefix + " ".join(w[i : i + 3]) for i in range(0, len(w), 3)))]
    got = found(spark, [t for _, t in cases])
    assert all(label in got[i].labels.split(",") and got[i].score == 1.0 for i, (label, _) in enumerate(cases))


def test_short_templates_need_the_word_that_tells_them(spark):
    texts = ["Licensed under CC BY 4.0.", "Released under the BSD License.", "Licensed under the Python License, Version 2.0.", "Released under\nthe BSD License.",
             "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License 2.0"]
    got = found(spark, texts)
    assert [got[i].labels for i in range(7)] == ["", "", "", "", "cc-by-nc", "mit", "apache"]
    assert [got[i].score for i in range(4)] == [0.0] * 4


def test_windows_match_brute_force(spark):
    r, texts = random.Random(7), []
    for _, run, _ in RUNS:
        for drop in range(6):
            w = list(run)
            for _ in range(drop):
                w[r.randrange(len(w))] = f"other{drop}"
            w = [f"x{i}" for i in range(r.randint(0, 30))] + w + [r.choice(run) for _ in range(r.randint(0, 10))]
            texts.append("".join(x + r.choice("    \n") for x in w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prepared = licenses.prepare(docs)
    rows = licenses.template_join(prepared).join(prepared.select("key", "doc_id"), "key").collect()
    got, want = {}, {}
    for x in rows:
        got[x.doc_id, x.template] = max(x.overlap, got.get((x.doc_id, x.template), 0))
    for i, text in enumerate(texts):
        every = re.findall(licenses.WORD, text)
        for k, (_, run, _) in enumerate(RUNS):
            blocks = [re.findall(licenses.WORD, x) for x in text.split("\n")] + [every[a : a + len(run)] for a in range(len(every))]
            best = max(len(set(b) & set(run)) for b in blocks)
            if best >= licenses.CONTAINMENT * len(set(run)) - 1e-9:
                want[i, k] = best
    assert got == want


def test_sql_knows_windows_and_telling_words(spark):
    """Wrapped notices with words exchanged, and what only resembles short templates, against the DuckDB oracle."""
    import duckdb

    from lumenrec.llm import queries
    from tests.conftest import plain

    r, texts = random.Random(8), ["Licensed under CC BY 4.0.", "Released under the BSD License.", "Licensed under the Python License,\nVersion 2.0.", "Released under\nthe BSD License.", "Released under\nthe MIT License.", None, ""]
    for _, run, _ in RUNS:
        for drop in range(5):
            w = list(run)
            for _ in range(drop):
                w[r.randrange(len(w))] = f"other{drop}"
            texts.append("".join(x + r.choice("    \n") for x in [f"x{i}" for i in range(r.randint(0, 9))] + w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan(docs).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert plain(got) == plain(con.sql(queries.ORACLES["op8_license_scan"]).df()) and (got.labels != got.base_labels).sum() > 20
