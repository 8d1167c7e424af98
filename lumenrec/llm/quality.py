"""Quality rules: lines that too many documents of a host repeat are removed, depleted documents rejected.

All of it is DataFrame functions. Words of a document never become rows: counts and repeated windows
come from arrays within the row. Lines do, as hashes: once to count the distinct documents of a host
that hold them, once to find the frequent ones of each document.

A line is frequent above a number of documents of its host, however large the host is; a share of the
host may be asked for as well. Documents with equal texts are one document by default: otherwise every
line of a text with many copies would be frequent and the text be lost with all its copies.
`distinct=False` counts rows.

Defined cases: a null text has no words; a null source is a host of its own; repeated rows are judged
alike; an empty table gives an empty table; extra input columns are kept, whatever their names, unless
they carry a name of the results, which then replace them. Lines and texts are told apart by 64 bits of
hash. Rules and lines are judged over whole texts, however long; a line that stands in exactly the limit's number of
documents stays, and no result depends on the order of rows, so there are no other ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, hidden, stage, text_or_empty, word_array

#: A line is frequent above this many documents of its host.
MAX_DOCS = 30
#: A document is depleted with fewer words left than this, or less than this share.
MIN_WORDS, MIN_LEFT = 10, 0.25
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "clean_text", "kept")


def line_hash(line: Column) -> Column:
    """Of the line in lower case, white space runs as one space, trimmed."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " ")))


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def document_lines(docs: DataFrame, distinct: bool = True) -> DataFrame:
    """host, doc (its text's hash), line: the hashes of each document's lines, once a document; equal texts are one document if distinct."""
    text = text_or_empty("text")
    lines = docs.select(F.col("source").alias("host"), F.xxhash64(text).alias("doc"), F.explode(F.array_distinct(F.transform(worded_lines(text), line_hash))).alias("line"))
    return lines.distinct() if distinct else lines


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS, min_share: float = 0.0) -> DataFrame:
    """host, line of the lines in more than max_docs documents of a host, and in min_share of its documents that have lines at least."""
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)
    if min_share > 0:
        hosts = lines.groupBy(F.col("host").alias("of_host")).agg(F.count_distinct("doc").alias("docs"))
        counts = counts.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).where(F.col("n") >= min_share * F.col("docs"))
    # few rows from however many partitions: a file a core, not a file a partition
    return stage(counts.select("host", "line").repartition(lines.sparkSession.sparkContext.defaultParallelism), "frequent-lines")


def window_hashes(words: str, size: int = 5) -> Column:
    """The hashes of all windows of so many words, by start; of a column, for lambdas evaluate an expression anew for each element."""
    n = F.size(words)
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def repeated_starts(ranked: str) -> Column:
    """From a column of structs (h, i) in order: the i whose h has an equal neighbour, in order."""
    near = lambda i, x: F.coalesce(F.get(ranked, i)["h"] == x["h"], F.lit(False))
    return F.array_sort(F.array_compact(F.transform(ranked, lambda x, i: F.when(near(i - 1, x) | near(i + 1, x), x["i"]))))


def covered_words(starts: str, size: int = 5) -> Column:
    """How many words windows of so many words cover that begin at the starts."""
    return F.aggregate(F.transform(starts, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(starts, i + 1) - p, F.lit(size)))), F.lit(0), lambda a, x: a + x)


def base_counts(docs: DataFrame, text: Column) -> DataFrame:
    """docs with the base counts, base_failed and own_lines (hash and words of each line)."""
    # each step in a select of its own: what later steps use more than once is computed once
    d = docs.withColumns({"words": word_array(text), "lines": worded_lines(text)})
    d = d.withColumns({
        "symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "own_lines": F.transform("lines", lambda x: F.struct(line_hash(x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n"))),
        "windows": window_hashes("words"),
    })
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("ranked", F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("at", repeated_starts("ranked"))
    found = F.struct(
        F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.col("symbols").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.coalesce(covered_words("at"), F.lit(0)).cast("long").alias("n_repeat_words"), "own_lines",
    )
    # a generator of one row: filters on its results stay above it and are never put, expression by expression, into the steps below
    d = d.select(*docs.columns, F.inline(F.array(found)))
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_share: float = 0.0, distinct: bool = True, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT) -> DataFrame:
    """docs with the base counts, n_left (words outside frequent lines), clean_text (null for null), base_failed and kept."""
    lines = stage(document_lines(docs, distinct), "document-lines")
    frequent = frequent_lines(lines, max_docs, min_share).toDF("of_host", "frequent")
    held = lines.join(frequent, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("line") == F.col("frequent")))
    held = held.groupBy("host", "doc").agg(F.collect_set("frequent").alias("frequent"))

    inner, columns = hidden(docs.drop(*RESULTS))
    text = text_or_empty(F.col(columns["text"]))
    d = base_counts(inner, text).withColumns({"of_host": F.col(columns["source"]), "of_doc": F.xxhash64(text)})
    d = d.join(held, F.col("of_host").eqNullSafe(F.col("host")) & (F.col("of_doc") == F.col("doc")), "left")
    gone = F.aggregate("own_lines", F.lit(0), lambda a, x: a + F.when(F.array_contains("frequent", x["line"]), x["n"]).otherwise(0))
    d = d.withColumn("gone", F.when(F.col("frequent").isNotNull(), gone).otherwise(0))
    stays = F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains("frequent", line_hash(x))))
    d = d.withColumns({"n_left": F.col("n_words") - F.col("gone"), "clean_text": F.when(F.col("gone") > 0, F.array_join(stays, "\n")).otherwise(F.col(columns["text"]))})
    depleted = (F.col("gone") > 0) & ((F.col("n_left") < min_words) | (F.col("n_left") < min_left * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & ~depleted)
    return d.select(*[F.col(c).alias(name) for name, c in columns.items()], *RESULTS)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, without their frequent lines; the columns of docs, n_chars renewed where a line went."""
    inner, columns = hidden(docs)
    named = inner.withColumnsRenamed({columns[c]: c for c in ("text", "source")})
    judged = judge(named, **options).where("kept")
    changed = ~F.col("clean_text").eqNullSafe(F.col("text"))
    out = {name: F.col(name if name in ("text", "source") else c) for name, c in columns.items()} | {"text": F.col("clean_text")}
    if "n_chars" in columns:
        out["n_chars"] = F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col(columns["n_chars"]))
    return judged.select(*[c.alias(name) for name, c in out.items()])
