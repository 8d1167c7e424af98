"""Conversation structure repair by Knuth's lightest derivation.

A repaired conversation reads, by the initials of its roles, (s?(ua)+)?. Items are "the first i rows are repaired and
the grammar is in state q", before or after turns are inserted; deductions join such an item with a row or an inserted
turn and carry the weight and the letter of an edit: Keep (0, K), Rerole to user or assistant (1, R), Delete (2, D; the
only edit of blank and repeated rows), Insert a turn without text (5, I); a truncated row that stays adds 5. Values
(cost, audit) are compared in this order, audits as text. Every deduction is a superior function: it adds weight and
letters at the end, and of two audits of an item, which hold as many rows and end alike, none is the start of the
other. So an agenda that pops the least value finalises an item when it pops it (Knuth 1977).

Conversations are cut into runs of CHUNK rows. The agenda runs once for each run and each state that it may begin in;
inserted turns stand before a row of their run. A conversation is then a fold over small tables of its runs, and the
audits of the chosen ways are joined back, so one conversation with a third of all rows is many tasks. Only the digest
of a repaired conversation is computed by one task, which streams its rows: SHA-256 is sequential.

Defined cases: null role, text, turn and conv_id read as one space (the null conv_id is a conversation of its own);
rows of one turn go by role, text; an empty role has no initial and can't be kept; roles count by their first
character; very long texts pass once through the sort and once through the stream; an empty table gives an empty one;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrec.operators.ranges import positions, ranged

from .common import small_batches, stage

CHUNK = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: The grammar (s?(ua)+)? as an automaton; it may end in START or ASSISTANT.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
BLANK = " \t\n\x0b\x0c\r"

Value = tuple[int, str]
Deduction = tuple[tuple, tuple[tuple, ...], int, str]


def lightest(facts: set[tuple], axioms: dict[tuple, Value], uses: Callable[[tuple], Iterator[Deduction]], goals: set[tuple]) -> dict[tuple, Value]:
    """The lightest value of every item that is finalised before the last of the goals is; uses gives the deductions (head, tails, weight, letter) that an item is a tail of. Facts weigh nothing and are final from the start."""
    agenda, final, goals = [(value, item) for item, value in axioms.items()], dict.fromkeys(facts, (0, "")), set(goals)
    heapify(agenda)
    while agenda and goals:
        value, item = heappop(agenda)
        if item in final:
            continue
        final[item] = value
        goals.discard(item)
        for head, tails, weight, letter in uses(item):
            if head not in final and all(t in final for t in tails):
                cost, audit = weight + sum(final[t][0] for t in tails), "".join(final[t][1] for t in tails) + letter
                heappush(agenda, ((cost, audit), head))
    return final


def ways(initials: str, faults: str, start: int) -> dict[int, Value]:
    """{state after the rows: its lightest value} for rows by their initials (s, u, a, other) and faults (b, d, t, none), from a state."""
    n = len(initials)

    def edits(i: int, state: int) -> Iterator[tuple[int, int, str]]:
        yield state, DELETE, "D"
        if faults[i] in "bd":
            return
        stays = TRUNCATED if faults[i] == "t" else 0
        if (state, initials[i]) in NEXT:
            yield NEXT[state, initials[i]], KEEP + stays, "K"
        for x in ROLES:
            if (state, x) in NEXT:
                yield NEXT[state, x], REROLE + stays, "R"

    def uses(item: tuple) -> Iterator[Deduction]:
        kind, i, state = item
        if kind == "done" and i < n:
            yield ("open", i, state), (item,), 0, ""
        elif kind == "open":
            for x in ROLES:
                if (state, x) in NEXT:
                    yield ("open", i, NEXT[state, x]), (item, ("turn", 0, 0)), INSERT, "I"
            for after, weight, letter in edits(i, state):
                yield ("done", i + 1, after), (item, ("row", i, 0)), weight, letter

    facts = {("turn", 0, 0)} | {("row", i, 0) for i in range(n)}
    final = lightest(facts, {("done", 0, start): (0, "")}, uses, {("done", n, q) for q in STATES})
    return {q: final["done", n, q] for q in STATES if ("done", n, q) in final}


@lru_cache(100_000)
def table(codes: str, starts: tuple[int, ...]) -> tuple[tuple[int, int, int, int, str], ...]:
    """(from, to, cost, rank, audit) of a run of rows, two letters a row (initial, fault); rank orders the audits of equal starts."""
    out = []
    for p in starts:
        found = ways(codes[::2], codes[1::2], p)
        rank = {q: r for r, q in enumerate(sorted(found, key=lambda q: found[q][1]))}
        out += [(p, q, cost, rank[q], audit) for q, (cost, audit) in found.items()]
    return tuple(out)


def fold(tables: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[tuple[int, int]], str]:
    """Cost, the (from, to) of each run, and the letters of turns inserted at the end, for (from, to, cost, rank) tables in order."""
    now, back = {START: (0, 0)}, []  # state: cost, rank of its audit among the states
    for t in tables:
        best: dict[int, tuple] = {}
        for p, q, cost, rank in t:
            if p in now:
                way = (now[p][0] + cost, now[p][1], rank, p)
                if q not in best or way < best[q]:
                    best[q] = way
        order = sorted(best, key=lambda q: best[q][1:3])
        now = {q: (best[q][0], order.index(q)) for q in best}
        back.append({q: best[q][3] for q in best})
    closing = {q: 0 if q in ENDS else 1 if q == USER else 2 for q in STATES}
    cost, _, state = min((c + INSERT * closing[q], rank, q) for q, (c, rank) in now.items())
    letters, path = "I" * closing[state], []
    for b in reversed(back):
        path.append((b[state], state))
        state = b[state]
    return cost, path[::-1], letters


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


_WAY = T.StructType([T.StructField(c, kind) for c, kind in (("p", T.IntegerType()), ("q", T.IntegerType()), ("cost", T.LongType()), ("rank", T.IntegerType()), ("audit", T.StringType()))])
_TABLE = T.StructType([T.StructField("illegal", T.LongType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("ways", T.ArrayType(_WAY))])
_FOLDED = T.StructType([T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType()), T.StructField("closing", T.StringType()), T.StructField("path", T.ArrayType(T.StructType(_WAY.fields[:2])))])


@F.pandas_udf(_TABLE)
def _table(codes: pd.Series, first: pd.Series) -> pd.DataFrame:
    """A run's table; the first run of a conversation begins at the start alone."""
    made = [table(c, (START,) if f else tuple(STATES)) for c, f in zip(codes, first)]
    return pd.DataFrame({"illegal": [illegal_pairs(c[::2]) for c in codes], "first": codes.str[0], "last": codes.str[-2], "ways": [[dict(zip(("p", "q", "cost", "rank", "audit"), w)) for w in t] for t in made]})


@F.pandas_udf(_FOLDED)
def _fold(runs: pd.Series) -> pd.DataFrame:
    out = []
    for r in runs:
        cost, path, closing = fold([[(w["p"], w["q"], w["cost"], w["rank"]) for w in x["ways"]] for x in r])
        bounds = sum(illegal_pairs(a["last"] + b["first"]) for a, b in zip(r, r[1:]))
        out.append((cost, int(sum(x["illegal"] for x in r)) + bounds, closing, [{"p": p, "q": q} for p, q in path]))
    return pd.DataFrame(out, columns=["cost", "illegal", "closing", "path"])


def _or_space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32(`conv_id:turn`) % 20: 0 goes, 1 loses its text, 2 its [.!?], 3 stands twice, 4 says user."""
    kind = F.crc32(F.concat_ws(":", _or_space("conv_id"), _or_space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_or_space("text"), "[.!?]", "")).otherwise(_or_space("text"))
    role = F.when(kind == 4, "user").otherwise(_or_space("role"))
    rows = turns.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("col")


def _rows_of(turns: DataFrame, parts: int | None) -> DataFrame:
    """Rows in ranges by conversation and turn, with what is asked of texts."""
    rows = turns.select("conv_id", _key().alias("conv"), "turn", _or_space("role").alias("role"), _or_space("text").alias("text"), F.monotonically_increasing_id().alias("source_line"))
    end = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns({
        "digest": F.md5("text"), "blank": end == "", "truncated": (end != "") & ~end.isin(".", "!", "?"), "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("x"),
    })
    return ranged(rows, "conv", "turn", "role", "text", "source_line", parts=parts)


def repair(turns: DataFrame, chunk: int = CHUNK, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The repaired conversations (conv, conv_id, role, text, edit; in order, see repaired()) and a report on each (conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), of rows with conv_id, turn, role, text.

    Conversations without rows are in neither.
    """
    with small_batches(turns.sparkSession):
        whole = _rows_of(turns, parts)
    slim = stage(positions(whole.drop("text"), "conv"), "turns")
    said = slim.where("NOT blank").groupBy("conv", "role", "digest").agg(F.min("pos").alias("said"))
    rows = slim.join(said, ["conv", "role", "digest"], "left")
    fault = F.when(F.col("blank"), "b").when(F.col("pos") > F.col("said"), "d").when(F.col("truncated"), "t").otherwise(".")
    rows = stage(rows.select("conv", "conv_id", "turn", "pos", "initial", fault.alias("fault")), "faults")
    count = lambda x: F.count_if(F.col("fault") == x)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
    report = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), gaps.alias("gaps"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"))
    runs = rows.groupBy("conv", F.floor(F.col("pos") / chunk).alias("run")).agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("initial", "fault").alias("c")))).alias("c"))
    codes = F.array_join(F.transform("c", lambda x: x["c"]), "")
    runs = stage(runs.select("conv", "run", _table(codes, F.col("run") == 0).alias("t")).select("conv", "run", "t.*"), "runs")
    slim_ways = F.transform("ways", lambda w: w.dropFields("audit")).alias("ways")
    folded = runs.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("run", "illegal", "first", "last", slim_ways))).alias("r"))
    folded = stage(folded.select("conv", _fold("r").alias("f")).select("conv", "f.*"), "folded")
    path = folded.select("conv", F.posexplode("path").alias("run", "way"))
    piece = F.filter("ways", lambda w: (w["p"] == F.col("way.p")) & (w["q"] == F.col("way.q")))[0]["audit"]
    pieces = path.join(runs, (path.conv == runs.conv) & (path.run == runs.run)).select(path.conv, runs.run, piece.alias("audit"))
    audits = pieces.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    audits = folded.join(audits, "conv").select("conv", "illegal", "cost", F.concat("audit", "closing").alias("audit"))
    report = stage(report.join(audits, "conv"), "reports")
    return repaired(whole, report), report


_REPAIRED = "conv string, role string, text string, edit string"


def repaired(whole: DataFrame, report: DataFrame) -> DataFrame:
    """conv, role, text, edit: the rows under the edits of their conversation's audit, a conversation's rows in order and side by side in one task, which streams them."""
    schema = pa.schema([(c, pa.string()) for c in ("conv", "role", "text", "edit")])

    def edited(conv: str, rows: Iterator[dict]) -> Iterator[tuple]:
        audit, state = next(rows)["audit"], START
        for letter in audit:
            if letter == "I":
                role = "a" if state == USER else "u"
                state = NEXT[state, role]
                yield conv, ROLES[role], "", letter
                continue
            row = next(rows)
            if letter == "K":
                state = NEXT[state, row["role"][0]]
                yield conv, row["role"], row["text"], letter
            elif letter == "R":
                role = "a" if state == USER else "u"
                state = NEXT[state, role]
                yield conv, ROLES[role], row["text"], letter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, rows in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["conv"]):
            for row in edited(conv, rows):
                out.append(row)
                size += len(row[2])
                if size > 1 << 22 or len(out) >= 5000:
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*out)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*out)], schema=schema)

    texts = whole.select("conv", "part", "line", "role", "text", F.lit(None).cast("string").alias("audit"))
    none = F.lit(None).cast("string")
    heads = report.select("conv", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("line"), none.alias("role"), none.alias("text"), "audit")
    rows = texts.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "part", "line")
    return rows.select("conv", "role", "text", "audit").mapInArrow(run, _REPAIRED)


def digests(rows: DataFrame) -> DataFrame:
    """conv, repaired_sha256: of `role:text`, joined by newlines, of repaired() rows as they stand."""
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, turns in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["conv"]):
            digest, between = hashlib.sha256(), b""
            for t in turns:
                digest.update(between + f"{t['role']}:{t['text']}".encode())
                between = b"\n"
            out.append({"conv": conv, "repaired_sha256": digest.hexdigest()})
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, "conv string, repaired_sha256 string")


def repair_report(turns: DataFrame, damaged: DataFrame | None = None, **options) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conversation of turns, whose rows are those of damaged if given."""
    rows, report = repair(turns if damaged is None else damaged, **options)
    with small_batches(turns.sparkSession):
        found = stage(digests(rows), "digests")
    ids = turns.select(_key().alias("conv"), "conv_id").groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    out = ids.join(report.drop("conv_id"), "conv", "left").join(found, "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
