"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; leaves of a source ascend by doc_id, and runs of ARITY nodes become their parent until one is left,
the source's subroot; the subroots, by source, become the root in the same way. A node's label is (level, index), so
children have smaller labels than parents. Nodes are swept in the order of their labels: a priority queue ordered by
label holds the digests on their way, each addressed to its parent, and a node is computed when its children's digests
come up. The sweep in reverse order delivers to each child what its parent has received from above, the siblings on
the way to the root, and before that its own siblings: at a leaf it is the proof.

The queue is external: blocks of ARITY ** depth consecutive nodes of a level are rows, a task sweeps a block with a heap,
and digests between blocks are rows that a shuffle orders by label. So a source with a third of all rows is many
blocks, and a round leaves one node a block. Texts are read once and never shuffled.

Defined cases: a null field is `-`, others their count of UTF-8 bytes, `:`, and the value; the null source comes first
and is a source of its own; a null doc_id comes first, rows of one doc_id go by their leaf, equal rows are
interchangeable; very long texts only make their leaf; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrec.operators.ranges import placed

from .common import small_batches, stage, with_columns

ARITY, DEPTH = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_ROWS = 100

Path = tuple[tuple[str, str], "Path"] | None


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**fields: Column) -> Column:
    return F.sha2(F.concat(*[encoded(fields[f]) for f in FIELDS]), 256)


def levels_over(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def sweep(digests: list[str], levels: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """The digest on top of so many levels over a block's nodes, and what each inner node was sent, by label, in the order of labels."""
    queue = [(1, i // ARITY, i, h) for i, h in enumerate(digests)]  # ascending, so a heap
    received: dict[tuple[int, int], list[str]] = {}
    top = digests[0]
    while levels and queue:
        label = queue[0][:2]
        sent = []
        while queue and queue[0][:2] == label:
            sent.append(heappop(queue)[3])
        received[label] = sent
        top = digest("".join(sent))
        level, index = label
        if level < levels:
            heappush(queue, (level + 1, index // ARITY, index, top))
    return top, received


def sweep_back(received: dict[tuple[int, int], list[str]], n: int, levels: int, above: Path) -> list[Path]:
    """The path from each of a block's n nodes: (digests before, digests after) in its run, then what its parent was sent."""
    paths: dict[tuple[int, int], Path] = {(levels, 0): above}
    for (level, index), sent in reversed(received.items()):
        beyond = paths.pop((level, index))
        for k in range(len(sent)):
            paths[level - 1, index * ARITY + k] = (("".join(sent[:k]), "".join(sent[k + 1 :])), beyond)
    return [paths[0, i] for i in range(n)]


def steps(path: Path) -> Iterator[tuple[str, str]]:
    while path:
        yield path[0]
        path = path[1]


def _levels(n: Column, depth: int) -> Column:
    """levels_over(n), depth at most."""
    return sum((n > ARITY**k).cast("int") for k in range(depth))


def _tops(depth: int):
    @F.pandas_udf("string")
    def top(digests: pd.Series, levels: pd.Series) -> pd.Series:
        return pd.Series([sweep([h.hex() for h in d], k)[0] for d, k in zip(digests, levels)], dtype=object)

    return top


def _blocks(nodes: DataFrame, depth: int, name: str) -> DataFrame:
    """g, block, levels, n (nodes of the group a level up the block), nodes (array in order), of rows with g, pos, n, node (struct with digest)."""
    size = ARITY**depth
    rows = nodes.groupBy("g", F.floor(F.col("pos") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("a"), F.first("n").alias("n"))
    return stage(rows.select("g", "block", _levels(F.col("n"), depth).alias("levels"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.transform("a", lambda x: x["node"]).alias("nodes")), name)


def _sweep_up(nodes: DataFrame, depth: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The tables of blocks, from the leaves up, and g, digest: each group's top."""
    top, tables = _tops(depth), []
    while True:
        blocks = _blocks(nodes, depth, name)
        tables.append(blocks)
        digests = F.transform("nodes", lambda x: x["digest"])
        tops = stage(blocks.select("g", F.col("block").alias("pos"), "n", top(digests, F.col("levels")).alias("digest")), f"{name}-tops")
        if (tops.agg(F.max("n")).first()[0] or 1) <= 1:
            return tables, tops.select("g", "digest")
        nodes = tops.select("g", "pos", "n", F.struct(F.unhex("digest").alias("digest")).alias("node"))


_SIDES = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def _each_path(rows: Iterator[dict]) -> Iterator[tuple[dict, int, Path]]:
    """Block, place in it and path of every node of blocks with their own path."""
    for r in rows:
        above: Path = None
        for x in reversed(r["path"] or []):
            above = ((x["before"], x["after"]), above)
        _, received = sweep([x["digest"].hex() for x in r["nodes"]], r["levels"])
        for i, path in enumerate(sweep_back(received, len(r["nodes"]), r["levels"], above)):
            yield r, i, path


def _sides(path: Path) -> list[dict]:
    return [{"before": b, "after": a} for b, a in steps(path)]


def _pylist(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= size:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema)


def _paths_below(blocks: DataFrame, depth: int) -> DataFrame:
    """g, block, path, subroot: of the nodes of blocks with path, which are the blocks of the level below."""
    schema = pa.schema([("g", pa.string()), ("block", pa.int64()), ("path", _SIDES), ("subroot", pa.string())])
    size = ARITY**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ({"g": r["g"], "block": r["block"] * size + i, "path": _sides(path), "subroot": r["subroot"]} for r, i, path in _each_path(_pylist(batches)))
        yield from _in_batches(out, schema, 500)

    return blocks.select("g", "block", "levels", "nodes", "path", "subroot").mapInArrow(run, "g string, block long, path array<struct<before: string, after: string>>, subroot string")


def _sweep_down(tables: list[DataFrame], paths: DataFrame | None, depth: int) -> DataFrame:
    """The blocks of leaves with path and subroot, of the tables of blocks from the leaves up; paths: g, path and subroot of each group's top, none where it is the root."""
    none = {"path": F.lit(None).cast("array<struct<before: string, after: string>>"), "subroot": F.lit(None).cast("string")}
    now = tables[-1].withColumns(none) if paths is None else tables[-1].join(paths, "g")
    for below in reversed(tables[:-1]):
        now = below.join(stage(_paths_below(now, depth), "paths"), ["g", "block"])
    return now


def manifest(docs: DataFrame, claimed: Column | None = None, keep_proof: bool = False, depth: int = DEPTH, parts: int | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, of rows with doc_id, source, lang, n_chars, text.

    claimed is the text that is checked against the manifest (the row's own if none): folded_root is the root that its
    leaf and the row's siblings give. keep_proof adds proof: (before, after) digests level by level.
    """
    docs = with_columns(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    own = {f: F.col(f) for f in FIELDS}
    other = leaf_of(**own | {"text": F.col("text") if claimed is None else claimed})
    leaves = docs.select("doc_id", F.coalesce(F.concat(F.lit("x"), "source"), F.lit("")).alias("g"), F.unhex(leaf_of(**own)).alias("digest"), F.unhex(other).alias("claim"), F.monotonically_increasing_id().alias("source_line"))
    leaves = leaves.withColumn("claim", F.nullif("claim", "digest"))  # kept only where it differs
    leaves = placed(leaves, "g", "doc_id", "digest", "source_line", parts=parts)
    node = F.struct("digest", F.col("doc_id").cast("long").alias("doc_id"), "claim").alias("node")
    with small_batches(docs.sparkSession, BLOCK_ROWS):
        tables, subroots = _sweep_up(leaves.select("g", "pos", "n", node), depth, "leaf-blocks")
        over = placed(subroots.select(F.lit("").alias("all"), "g", "digest"), "all", "g", parts=parts)
        named = over.select(F.col("all").alias("g"), "pos", "n", F.struct(F.unhex("digest").alias("digest"), F.col("g").alias("name")).alias("node"))
        sources, roots = _sweep_up(named, depth, "source-blocks")
        root = roots.first()
        of_sources = stage(_paths_of_sources(_sweep_down(sources, None, depth)), "source-paths").join(subroots.withColumnRenamed("digest", "subroot"), "g")
        found = _proofs(_sweep_down(tables, of_sources, depth), root["digest"] if root else None, keep_proof)
        return stage(found, "manifest")


def _paths_of_sources(blocks: DataFrame) -> DataFrame:
    schema = pa.schema([("g", pa.string()), ("path", _SIDES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ({"g": r["nodes"][i]["name"], "path": _sides(path)} for r, i, path in _each_path(_pylist(batches)))
        yield from _in_batches(out, schema, 500)

    return blocks.select("levels", "nodes", "path").mapInArrow(run, "g string, path array<struct<before: string, after: string>>")


def _proofs(blocks: DataFrame, root: str | None, keep_proof: bool) -> DataFrame:
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    fields = [("doc_id", pa.int64())] + [(c, pa.string()) for c in names] + [("proof", _SIDES)] * keep_proof
    schema = pa.schema(fields)

    def of(r: dict, i: int, path: Path) -> dict:
        node, proof = r["nodes"][i], hashlib.sha256()
        h = (node["claim"] or node["digest"]).hex()
        for before, after in steps(path):
            proof.update((before + after).encode())
            h = digest(before + h + after)
        row = {"doc_id": node["doc_id"], "leaf": node["digest"].hex(), "subroot": r["subroot"], "root": root, "proof_sha256": proof.hexdigest(), "folded_root": h}
        return row | ({"proof": _sides(path)} if keep_proof else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches((of(*x) for x in _each_path(_pylist(batches))), schema)

    kinds = "doc_id long, " + ", ".join(f"{c} string" for c in names) + ", proof array<struct<before: string, after: string>>" * keep_proof
    rows = blocks.select("levels", "nodes", "path", "subroot").mapInArrow(run, kinds)
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines(text: str = "text") -> Column:
    """The tampered text of rows whose doc_id has an even CRC-32: its newlines are gone."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))
