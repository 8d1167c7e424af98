"""Near-duplicate groups by b-bit MinHash.

Each document's set of word shingles gets 160 minima. Bands of four full minima give candidate
buckets; two low bits of every minimum, packed into five longs, give a similarity estimate corrected
for chance agreement, by XOR and bit counts; pairs that pass it are confirmed on full shingle sets.
A pair at the threshold meets in some band but for 1 in 4 million, and passes the estimate's cutoff
six standard deviations below it.

Documents with equal sets are one class from the start. In every bucket all classes are compared with
one leader, the best connected class (largest buckets in sum), which among copies is the one that the
others were made from or close to it; links merge classes into components. Classes of buckets that
still hold several components are then joined exactly across components: their shingles are ordered
by frequency, rarest first, and two classes can be similar only if they share a shingle early enough in
both (prefix and positional filters) and their sizes allow it. So no link between different components
is left untested, and copies of one text, which share all but rare shingles, don't meet in pairs.
Components come from label propagation with pointer jumping over staged tables.

Defined cases: null or empty texts have no shingles and are linked with nothing; fewer words than a
shingle are one shingle; rows that share a doc_id are one document, of which `keep_first` returns every
distinct set once; rows without doc_id are told apart by their sets; in a component without any id
component_id is null and the rows of one set, the first by hash, are kept; an empty table gives an
empty table; columns beside doc_id and text are not read by `near_duplicates` and kept by `keep_first`. Very long texts are
shingled whole; ties of minima and of doc_ids can't change a result, as links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, hidden, small_batches
from .windows import mix, window_hashes, word_hashes, words_of

SHINGLE, SIMILARITY = 5, 75
BANDS, ROWS = 40, 4
LANES = BANDS * ROWS
LONGS = LANES // 32
#: The estimate that a pair must reach, for each percent of similarity asked for: 0.5 for 0.75, where its standard deviation is 0.041.
CUT = 0.5 / 75
#: Sizes fall into classes that grow by this factor, so that partners of allowed sizes are found by equality.
SIZE_STEP = 1.05

_rng = np.random.default_rng(3)
_ODD = _rng.integers(0, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, LANES, dtype=np.uint64)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
S = [f"s{i}" for i in range(LONGS)]


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit shingle hashes, in order."""
    w = word_hashes(words_of(text, lower=True))
    return np.unique(window_hashes(w, min(size, len(w)))) if len(w) else w


def minima(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of each hash function's smallest value."""
    out = np.full(LANES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048]
        np.minimum(out, ((part[:, None] ^ _FLIP) * _ODD).min(axis=0), out=out)
    return out >> np.uint64(32)


def packed(low: np.ndarray) -> np.ndarray:
    """Two low bits of each minimum, 32 to a long."""
    lanes = (low & np.uint64(3)).reshape(LONGS, 32)
    return np.bitwise_or.reduce(lanes << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=1)


def band_keys(low: np.ndarray) -> np.ndarray:
    return mix((low.reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def agreeing(a: str, b: str) -> Column:
    """In how many lanes the packed signatures of aliases a and b agree."""

    def differing(s: str) -> Column:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return F.lit(LANES) - reduce(lambda x, y: x + y, map(differing, S))


def estimate(a: str, b: str) -> Column:
    """Similarity from agreeing lanes: two bits agree by chance in a quarter of the lanes."""
    return F.greatest(F.lit(0.0), (agreeing(a, b) / LANES - 0.25) / 0.75)


def likely(a: str, b: str, percent: int) -> Column:
    """The sizes allow the similarity, and the signatures make it likely."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (estimate(a, b) >= CUT * percent - 1e-9)


def identified(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with hidden column names, beside them doc_id, text and row (a hash of all columns that can be hashed), and the hidden names."""
    inner, columns = hidden(docs)
    plain = [columns[f.name] for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return inner.withColumns({"doc_id": F.col(columns["doc_id"]).cast("long"), "text": F.col(columns["text"]), "row": F.xxhash64(*plain)}), columns


def signatures(rows: DataFrame) -> DataFrame:
    """doc_id, row, n, the 128-bit class of the set (c0, c1), packed signature, bands; of doc_id, row, text."""
    names = ["doc_id", "row", "n", "c0", "c1", *S, "bands"]
    schema = pa.schema([(c, pa.int64()) for c in names[:-1]] + [("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in names[2:]}
            for text in batch.column(2):
                s = shingle_set(text.as_py())
                low = minima(s)
                c = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
                bands = band_keys(low).view(np.int64).tolist() if len(s) else []
                for name, v in zip(names[2:], (len(s), c[0], c[1], *packed(low).view(np.int64), bands)):
                    out[name].append(v)
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(out[c], schema.field(c).type) for c in names[2:]]], schema=schema)

    ddl = ", ".join(f"{c} long" for c in names[:-1]) + ", bands array<long>"
    return rows.select("doc_id", "row", "text").mapInArrow(run, ddl)


def one_row_each(rows: DataFrame, wanted: DataFrame, repeats: bool) -> DataFrame:
    """The rows whose doc_id and row are wanted, with wanted's other columns; if the table has repeated rows, one of them."""
    w = wanted.withColumnsRenamed({"doc_id": "w_id", "row": "w_row"})
    found = rows.join(w, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("row") == F.col("w_row"))).drop("w_id", "w_row")
    return found.dropDuplicates(["doc_id", "row"]) if repeats else found


def _sets(texts: DataFrame) -> DataFrame:
    """node and its shingle set in order, of node and text."""
    schema = pa.schema([("node", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sets, schema.field("set").type)], schema=schema)

    return texts.select("node", "text").mapInArrow(run, "node long, set array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    a, b = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    # b differs from pair to pair and a, the leader, repeats: its rows meet last, where a hot one can be split
    return pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """labels (node, label) merged along links (a, b): every label becomes the smallest that links reach."""
    la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
    edges = links.join(la, "a").join(lb, "b").where("la <> lb").select(F.col("la").alias("u"), F.col("lb").alias("v"))
    edges = scratch.stage(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    now = scratch.stage(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")).toDF("node", "to"), "steps")
    while True:
        near = edges.join(now.toDF("v", "to"), "v").groupBy("u").agg(F.min("to").alias("near")).withColumnRenamed("u", "node")
        # written before the jump: one label may have many nodes, and joins of plain tables can be split
        new = scratch.stage(now.join(near, "node").select("node", "to", F.least("to", "near").alias("new")), "steps")
        jump = new.select(F.col("node").alias("new"), F.col("new").alias("far"))
        new = scratch.stage(new.join(jump, "new", "left").select("node", "to", F.least("new", F.coalesce("far", "new")).alias("new")), "steps")
        now = new.select("node", F.col("new").alias("to"))
        if new.where("to <> new").isEmpty():
            break
    merged = labels.join(now.toDF("label", "to"), "label", "left")
    merged = scratch.stage(merged.select("node", F.coalesce("to", "label").alias("label")), "labels")
    scratch.drop("edges", "steps")
    return merged


def _tokens(sets: DataFrame, open_: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """token, node, label, n, left (shingles from here on) of the open classes: their prefixes by rising frequency, without shingles that no other class has."""
    each = scratch.stage(sets.join(open_, "node").select("node", "label", F.size("set").alias("n"), F.explode("set").alias("token")), "tokens")
    counts = scratch.stage(each.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "token-counts")
    # the shingles of one class are at most its document's words; those that occur once come first and need no place of their own
    held = each.join(counts, "token").withColumn("rest", F.row_number().over(W.partitionBy("node").orderBy(F.desc("c"), F.desc("token"))))
    # at similarity p / 100 the partner shares at least that part of n
    held = held.where(100 * F.col("rest") >= percent * F.col("n")).select("token", "node", "label", "n", F.col("rest").alias("left"))
    return scratch.stage(held, "prefixes")


def _size_class(n: Column) -> Column:
    return F.floor(F.ln(F.greatest(n, F.lit(1))) / float(np.log(SIZE_STEP))).cast("int")


def across_components(sets: DataFrame, open_: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, b: every pair of open classes (node, label) of different components that can reach the similarity by prefixes, places and sizes."""
    prefixes = _tokens(sets, open_, percent, scratch)
    # a shingle's largest component is on one side alone: its members are one group already
    by = prefixes.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("parts"))
    met = prefixes.join(scratch.stage(by.where("parts > 1").select("token", F.col("top.label").alias("main")), "shared-tokens"), "token")
    met = scratch.stage(met.withColumn("size", _size_class(F.col("n"))), "meetings")
    # similar sets share at least p / (100 + p) of both sizes, which from here on x has left: this bounds the partner's size
    most = F.least(F.floor(((100 + percent) * F.col("left") - percent * F.col("n")) / percent), F.floor(100 * F.col("n") / percent))
    least = F.ceil(percent * F.col("n") / 100)
    x = met.where("label <> main").withColumns({"most": most, "least": least}).where("least <= most")
    x = x.select("token", "node", "label", "n", "left", F.explode(F.sequence(_size_class(F.col("least")), _size_class(F.col("most")))).alias("size")).alias("x")
    y = met.alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    fits = (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & ((100 + percent) * F.least("x.left", "y.left") >= percent * (nx + ny))
    found = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.label") != F.col("y.label")) & fits)
    found = scratch.stage(found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "across")
    scratch.drop("tokens", "token-counts", "prefixes", "shared-tokens", "meetings")
    return found


def groups(rows: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, bool]:
    """doc_id, row, n, c0, c1, component_id, kept of every row (doc_id, row, text), and whether rows repeat."""
    signed = scratch.stage(signatures(rows), "signatures")
    repeats = not signed.groupBy("doc_id", "row").count().where("count > 1").isEmpty()
    holder = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("holder")
    firsts = [F.first(c).alias(c) for c in ("n", *S, "bands")]
    classes = signed.where("n > 0").groupBy("c0", "c1").agg(holder, *firsts)
    classes = scratch.stage(classes.select("c0", "c1", F.coalesce("holder.doc_id", F.xxhash64("c0", "c1")).alias("node"), "holder.doc_id", "holder.row", "n", *S, "bands"), "classes")

    keys = classes.select("node", F.explode("bands").alias("key"))
    sizes = scratch.stage(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
    members = scratch.stage(keys.join(sizes, "key"), "members")
    known = scratch.stage(members.groupBy("node").agg(F.sum("size").alias("known")), "connections")
    leaders = members.select("key", "node").join(known, "node").groupBy("key").agg(F.max(F.struct("known", (-F.col("node")).alias("first"), "node")).alias("top"))
    leaders = scratch.stage(leaders.select("key", F.col("top.node").alias("leader")), "leaders")
    # full sets of classes in buckets alone
    holders = classes.join(known.select("node"), "node", "left_semi").select("node", "doc_id", "row")
    sets = scratch.stage(_sets(one_row_each(rows.select("doc_id", "row", "text"), holders, repeats)), "sets")
    signs = classes.select("node", "n", *S)

    def linked(pairs: DataFrame) -> DataFrame:
        near = pairs.join(signs.alias("y"), F.col("b") == F.col("y.node")).join(signs.alias("x"), F.col("a") == F.col("x.node")).where(likely("x", "y", percent))
        return scratch.stage(_confirm(scratch.stage(near.select("a", "b"), "pairs"), sets, percent), "links")

    labels = scratch.stage(classes.select("node", F.col("node").alias("label")).distinct(), "own-labels")
    with_leader = members.join(leaders, "key").where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(labels, linked(with_leader), scratch)
    placed = members.select("key", "node").join(labels, "node")
    split = scratch.stage(placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"), "split")
    open_ = scratch.stage(placed.join(split, "key").select("node", "label").distinct(), "open")
    if not open_.isEmpty():
        labels = components(labels, linked(across_components(sets, open_, percent, scratch)), scratch)

    # the smallest id of each component, joined by class: a group of copies stands in it once
    ids = labels.join(classes.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = classes.select("c0", "c1", "node").join(labels, "node").join(scratch.stage(ids, "component-ids"), "label")
    of_class = scratch.stage(of_class.select("c0", "c1", "component_id", (F.col("component_id").isNull() & (F.col("node") == F.col("label"))).alias("first")), "components")
    d = signed.select("doc_id", "row", "n", "c0", "c1").join(of_class, ["c0", "c1"], "left")
    alone = F.col("first").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    kept = alone | F.col("first") | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    d = scratch.stage(d.select("doc_id", "row", "n", "c0", "c1", component.alias("component_id"), kept.alias("kept")), "groups")
    scratch.drop("signatures", "classes", "bucket-sizes", "members", "connections", "leaders", "sets", "pairs", "links", "own-labels", "labels", "split", "open", "across", "component-ids", "components")
    return d, repeats


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    with small_batches(docs.sparkSession, 100):
        found, _ = groups(identified(docs.select("doc_id", "text"))[0], percent, Scratch(docs.sparkSession, "minhash"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_first(docs: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """The rows that near_duplicates keeps, of rows with the same doc_id and set one (the first by hash), in the columns of docs; rows without words stay as they are."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows, columns = identified(docs)
    with small_batches(docs.sparkSession, 100):
        found, repeats = groups(rows, percent, scratch)
    wanted = found.where("kept AND n > 0").groupBy("doc_id", "c0", "c1").agg(F.min("row").alias("row")).select("doc_id", "row")
    wordless = found.where("n = 0").select("doc_id", "row").distinct()
    kept = one_row_each(rows, scratch.stage(wanted, "wanted"), repeats)
    bare = rows.join(wordless.toDF("w_id", "w_row"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("row") == F.col("w_row")), "left_semi")
    out = [F.col(c).alias(name) for name, c in columns.items()]
    return kept.select(*out).unionByName(bare.select(*out))
