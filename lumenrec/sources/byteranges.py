"""Files that Spark has no source for, read in byte ranges by many tasks: .npy matrices, and one JSON object of many members.

Paths are those of pyarrow's file systems (local and shared folders, hdfs://, s3:// and others), which executors reach by themselves.
"""

from __future__ import annotations

import ast
import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32 << 20


def files_of(path: str, ending: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The file at a path, or those in a folder and below that end so, by name; without those that Spark hides."""
    system, at = fs.FileSystem.from_uri(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return system, [info]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    shown = lambda f: not any(x.startswith(("_", ".")) for x in f.path[len(at) :].split("/"))
    return system, sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(ending) and shown(f)), key=lambda f: f.path)


def read_range(path: str, start: int, size: int) -> bytes:
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as f:
        f.seek(start)
        return f.read(size)


# --- matrices -----------------------------------------------------------------------------------


def npy_header(path: str) -> tuple[int, tuple[int, ...], str]:
    """Where the numbers begin, the shape and the type of a .npy file's array in row order."""
    head = read_range(path, 0, 12)
    if head[:6] != b"\x93NUMPY":
        raise ValueError(f"{path} is no .npy file")
    wide = head[6] > 1
    size, at = (struct.unpack("<I", head[8:12])[0], 12) if wide else (struct.unpack("<H", head[8:10])[0], 10)
    found = ast.literal_eval(read_range(path, at, size).decode("utf-8" if head[6] > 2 else "latin1"))
    if found["fortran_order"] or len(found["shape"]) != 2 or np.dtype(found["descr"]).hasobject:
        raise ValueError(f"{path} has no plain matrix in row order")
    return at + size, found["shape"], found["descr"]


@dataclass
class Rows(InputPartition):
    path: str
    start: int
    rows: int
    width: int
    kind: str
    first: int


class _MatrixReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Rows]:
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        parts, first = [], 0
        for f in files_of(self.path, ".npy")[1]:
            path = scheme + f.path
            at, (n, width), kind = npy_header(path)
            each = max(1, np.dtype(kind).itemsize * width)
            step = max(1, self.range_bytes // each)
            parts += [Rows(path, at + i * each, min(step, n - i), width, kind, first + i) for i in range(0, n, step)]
            first += n
        return parts

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        m = np.frombuffer(read_range(part.path, part.start, part.rows * part.width * np.dtype(part.kind).itemsize), dtype=part.kind).reshape(part.rows, part.width)
        for i in range(0, part.rows, 8192):
            x = np.ascontiguousarray(m[i : i + 8192], dtype=np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * part.width), pa.array(x.ravel()))
            yield pa.record_batch([pa.array(np.arange(part.first + i, part.first + i + len(x))), vectors], names=["item_id", "embedding"])


class MatrixSource(DataSource):
    """item_id (the row's place over all files by name), embedding."""

    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return "item_id long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _MatrixReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))


def write_matrix(vectors: DataFrame, path: str) -> None:
    """(item_id, embedding) as .npy files of float32 rows in the order of ids, a file a range; a task that runs again writes its file again."""
    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, parts = None, []
        for b in batches:
            if b.num_rows:
                part = b.column(0)[0].as_py()
                parts.append(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(b.num_rows, -1))
        if parts:
            system, at = fs.FileSystem.from_uri(path)
            with system.open_output_stream(f"{at}/part-{part:06d}.npy") as out:
                shape = (sum(map(len, parts)), parts[0].shape[1])
                np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": shape})
                for x in parts:
                    out.write(np.ascontiguousarray(x).tobytes())
        yield pa.record_batch([pa.array([sum(map(len, parts))])], names=["n"])

    rows = vectors.select("item_id", "embedding").repartitionByRange("item_id").sortWithinPartitions("item_id")
    rows.select(F.spark_partition_id().alias("part"), "embedding").mapInArrow(write, "n long").collect()  # a row a file


# --- one JSON object ------------------------------------------------------------------------------

_ESCAPED, _REST = re.compile(rb"\\.", re.S), re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)


def _before(path: str, start: int, of: bytes) -> tuple[int, bytes]:
    """How many bytes of the given kinds end at start, and the one before them (none at the beginning)."""
    n = 0
    while start > n:
        size = min(256, start - n)
        back = read_range(path, start - n - size, size)
        kept = back.rstrip(of)
        n += size - len(kept)
        if kept:
            return n, kept[-1:]
    return n, b""


def summary(raw: bytes) -> tuple[bool, int, int]:
    """Of a range that begins unescaped: whether it turns inside and outside of strings round, and how much deeper it leads if it begins outside, and if inside."""
    parts = _ESCAPED.sub(b"__", raw).split(b'"')
    deeper = [sum(len(p.translate(None, b"}]")) - len(p.translate(None, b"{[")) for p in parts[k::2]) for k in (0, 1)]
    return len(parts) % 2 == 0, deeper[0], deeper[1]


def _unescaped(path: str, start: int, raw: bytes) -> bytes:
    """The range without its first byte's meaning, where an odd run of backslashes stands before it."""
    return b"_" + raw[1:] if start and _before(path, start, b"\\")[0] % 2 else raw


def member_starts(text: str, inside: bool, depth: int, after: str) -> Iterator[int]:
    """Where names of the outermost object begin, in a text that begins in a state and behind a character other than white space."""
    at = 0
    if inside:
        if (end := _REST.match(text)) is None:
            return
        at, after = end.end(), '"'
    while (m := _TOKEN.search(text, at)) is not None:
        between = text[at : m.start()].rstrip()
        if m[0][0] == '"':
            if depth == 1 and (between[-1:] or after) != ":":
                yield m.start()
        else:
            depth += 1 if m[0] in "{[" else -1
        at, after = m.end(), m[0][-1]


def members(path: str, start: int, end: int, inside: bool, depth: int) -> Iterator[tuple[str, str]]:
    """Name and JSON text of the members whose names begin in a range; reads on until the last one is whole."""
    raw = _unescaped(path, start, read_range(path, start, end - start))
    after = _before(path, start, b" \t\r\n")[1].decode("latin1") if start else ""
    lead = next((i for i, b in enumerate(raw) if b & 0xC0 != 0x80), 0)  # the rest of a character
    inner = len(raw[lead:].decode("utf-8", "ignore"))
    decoder, more = json.JSONDecoder(strict=False), 1 << 16
    while True:
        beyond = read_range(path, end, more)
        text = (raw[lead:] + beyond).decode("utf-8", "ignore")
        out, whole = [], len(beyond) < more
        try:
            for at in member_starts(text, inside, depth, after):
                if at >= inner:
                    whole = True
                    break
                name, stop = decoder.raw_decode(text, at)
                value = re.compile(r"\s*:\s*").match(text, stop).end()
                out.append((name, text[value : decoder.raw_decode(text, value)[1]]))
        except (ValueError, AttributeError):
            if whole:
                raise
        if whole:
            yield from out
            return
        more *= 4


def read_members(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """name, value (JSON text) of every member of the object in each file, by two passes over byte ranges.

    The first tells how each range moves in and out of strings and objects, whichever it begins in; these few numbers
    a range give the state in which each begins, from which the second reads its members.
    """
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    found = [(scheme + f.path, f.size) for f in files_of(path, "")[1]]
    ranges = [(name, at, min(size, at + range_bytes)) for name, size in found for at in range(0, size, range_bytes)]

    def summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(n, a, *summary(_unescaped(n, a, read_range(n, a, e - a)))) for n, a, e in frame.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=["path", "start", "turns", "outside", "inside"])

    spread = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(max(1, len(rows)), "path", "start")
    moves = spread(ranges, "path string, start long, end long").mapInPandas(summaries, "path string, start long, turns boolean, outside long, inside long")
    moves = {(r["path"], r["start"]): r for r in moves.collect()}  # a row a range
    states, inside, depth = [], False, 0
    for name, at, end in ranges:
        inside, depth = (inside, depth) if at else (False, 0)
        states.append((name, at, end, inside, depth))
        move = moves[name, at]
        depth, inside = depth + (move["inside"] if inside else move["outside"]), inside != move["turns"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for state in frame.itertuples(index=False, name=None):
                yield pd.DataFrame(list(members(*state)), columns=["name", "value"])

    return spread(states, "path string, start long, end long, inside boolean, depth long").mapInPandas(read, "name string, value string")
