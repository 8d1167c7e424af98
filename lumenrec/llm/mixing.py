"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source, keys are cut into ranges of about equal count, so
the global order by key is a sort within each range, and the words before a row are its range's
start (a prefix sum over the small table of ranges) plus a running sum inside the range. A source is
cut at exactly its budget: whole epochs, then the rows before the cut, then part of one row.

Defined cases: a null text has no words and takes none; the null source is one source, last in order;
rows that agree in doc_id and size are interchangeable; a null doc_id is keyed by its text; an empty
table gives an empty table; other columns are not read; a very long text is one row that may be cut
at a word; ties of the random key go by doc_id, then size. The number of sources must fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, hidden, stage, text_or_empty, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
RANGE_ROWS = 5000


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> the same with target: shares by weight, none above max_epochs times its size.

    Ordered by size a weight, the sources that stop at their limit come first; what is left is shared
    by weight among the rest, and the first source that its share doesn't overfill ends the search.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("most", max_epochs * F.col("source_size")).withColumn("fill", F.col("most") / F.col("w"))
    order = W.orderBy("fill", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))
    share = left.cast("double") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).cast("double")
    s = s.withColumns({"k": F.row_number().over(order), "share": share})
    s = s.withColumn("cut", F.min(F.when(F.col("share") <= F.col("fill"), F.struct("k", "share"))).over(every))
    target = F.when(F.col("k") < F.col("cut.k"), F.col("most").cast("double")).otherwise(F.col("cut.share") * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", range_rows: int = RANGE_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), and the columns named in carry, whose names may be any but these."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), text_or_empty("text")))))
    sized = stage(docs.select("doc_id", "source", word_count(text_or_empty("text")).alias("size"), key.alias("key"), F.struct(F.lit(0), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("carried")), "sizes")
    ranges = max(1, -(-sized.count() // range_rows))
    # 32 leading bits of the key choose the range, in key order
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("long")
    sized = sized.withColumns({"of": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "part": at})
    parts = stage(sized.groupBy("of", "part").agg(F.first("source").alias("source"), F.sum("size").alias("words")), "ranges")
    sources = stage(targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs), "targets")
    budget = F.floor("target").cast("long")
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    before = W.partitionBy("of").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    starts = starts.join(sources.withColumnRenamed("source", "by"), F.col("source").eqNullSafe(F.col("by"))).drop("source", "by")
    within = W.partitionBy("of", "part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = sized.join(stage(starts, "range-starts"), ["of", "part"])
    rows = rows.withColumn("first", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("first")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), *[F.col(f"carried.c{i}").alias(c) for i, c in enumerate(carry)])


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    words = F.array_remove(F.split(text, SPACE), "")
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), " ")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of docs: a row as often as it is taken whole, and the row at a source's cut with its first words (joined by one space) alone."""
    inner, columns = hidden(docs)
    named = inner.select(*[F.col(columns[c]).alias(c) for c in ("doc_id", "source", "text")], F.struct(*inner.columns).alias("row"))
    taken = mix(named, carry=("row",), **options)
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rows = taken.where("size > 0 AND taken > 0").select("row", "size", (F.col("taken") % F.col("size")).alias("rest"), whole.alias("whole"))
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("whole")), F.when(F.col("rest") > 0, F.array("rest")).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select("row", F.explode(copies).alias("cut"))
    of = {name: F.col(f"row.{c}") for name, c in columns.items()}
    text = F.when(F.col("cut") > 0, first_words(of["text"], F.col("cut"))).otherwise(of["text"])
    out = of | {"text": text}
    if "n_chars" in of:
        out["n_chars"] = F.when(F.col("cut") > 0, F.length(text).cast("long")).otherwise(of["n_chars"])
    return rows.select(*[c.alias(n) for n, c in out.items()])
