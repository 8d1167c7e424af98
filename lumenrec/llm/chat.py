"""Chat formatting by compiled templates.

A template is parsed into a syntax tree, constants are folded, and Python closures are generated that
stream pieces of text with a mark: under the loss mask or not. The language is a sandbox: loops over
the messages, conditions, output of expressions and generation blocks; names and attributes are those
listed here, and nothing of Python is reachable.

Rows of a conversation meet in one task, sorted by turn, and are rendered one by one; what is out is
written in parts of bounded size, so no conversation has to fit in memory.

Defined cases: null roles and texts are empty; turns that tie are ordered by role and text, null turns
come first; rows without conv_id form one conversation; repeated rows are turns of their own; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = (
    "{% for m in messages %}{{ '<turn:' + (m.role | name) + '>\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '</turn>' + '\\n' }}{% endfor %}"
)
PART_CHARS = 1 << 20


def escape(text: str) -> str:
    """Backslashes and what could be taken for a turn's mark get a backslash."""
    return re.sub(r"\\|<(?=/?turn)", r"\\\g<0>", text)


def escape_name(text: str) -> str:
    return re.sub(r"[\\<>]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "name": escape_name, "trim": str.strip, "upper": str.upper, "lower": str.lower}
ATTRIBUTES = {"message": ("role", "text"), "loop": ("first", "last", "index", "index0")}


class TemplateError(ValueError):
    pass


# --- parsing: nodes are tuples (kind, ...) ---------------------------------------------------------

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*')|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+|().]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """or < and < not < comparison < + < filters < atoms."""

    def __init__(self, source: str, scope: dict[str, str]):
        self.scope, self.tokens, at = scope, [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def take(self, *values: str) -> str | None:
        if self.tokens and self.tokens[0][0] != "str" and self.tokens[0][1] in values:
            return self.tokens.pop(0)[1]
        return None

    def whole(self) -> tuple:
        node = self.any()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return node

    def any(self) -> tuple:
        node = self.all()
        while self.take("or"):
            node = ("or", node, self.all())
        return node

    def all(self) -> tuple:
        node = self.negation()
        while self.take("and"):
            node = ("and", node, self.negation())
        return node

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> tuple:
        node = self.sum()
        while op := self.take("==", "!="):
            node = (op, node, self.sum())
        return node

    def sum(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.take("|"):
            kind, name = self.tokens.pop(0) if self.tokens else ("", "")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.any()
            if not self.take(")"):
                raise TemplateError("a bracket isn't closed")
            return node
        if not self.tokens:
            raise TemplateError("an expression is missing")
        kind, value = self.tokens.pop(0)
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(value))
        if kind == "name" and value in ("true", "false"):
            return ("const", value == "true")
        if kind == "name" and value in self.scope and self.take("."):
            attribute = self.tokens.pop(0)[1] if self.tokens else ""
            if attribute in ATTRIBUTES[self.scope[value]]:
                return ("get", value, attribute)
        raise TemplateError(f"{value!r} can't be used here")


def parse(template: str) -> tuple:
    """The syntax tree: ('block', nodes) of text, output, if, for and generation nodes."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    scope: dict[str, str] = {}

    def block(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nodes = []
        while parts:
            part = parts.pop(0)
            if part.startswith("{{"):
                nodes.append(("out", _Expression(part[2:-2], scope).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return ("block", nodes), part[2:-2].strip()
                nodes.append(statement(word, rest))
            elif part:
                nodes.append(("out", ("const", part)))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return ("block", nodes), ""

    def statement(word: str, rest: str) -> tuple:
        if word == "generation":
            return ("generation", block(("endgeneration",))[0])
        if word == "if":
            test = _Expression(rest, scope).whole()
            yes, end = block(("elif", "else", "endif"))
            if end.startswith("elif"):
                return ("if", test, yes, ("block", [statement("if", end[4:])]))
            return ("if", test, yes, block(("endif",))[0] if end == "else" else ("block", []))
        if word == "for" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", rest)):
            if scope:
                raise TemplateError("loops over the messages can't be nested")
            scope.update({m[1]: "message", "loop": "loop"})
            body = block(("endfor",))[0]
            scope.clear()
            return ("for", m[1], body)
        raise TemplateError(f"can't read {word} {rest}")

    return block(())[0]


def fold(node: tuple) -> tuple:
    """Operators on constants become constants, neighbouring constant texts one, decided conditions their branch."""
    kind = node[0]
    if kind in ("const", "get"):
        return node
    if kind == "filter":
        inner = fold(node[2])
        return ("const", FILTERS[node[1]](str(inner[1]))) if inner[0] == "const" else ("filter", node[1], inner)
    if kind in ("or", "and", "not", "==", "!=", "+"):
        inner = [fold(x) for x in node[1:]]
        if all(x[0] == "const" for x in inner):
            return ("const", _OPERATORS[kind](*[lambda _, v=x[1]: v for x in inner])(None))
        if kind == "+" and inner[0][0] == "+" and inner[0][2][0] == inner[1][0] == "const" and all(isinstance(x[1], str) for x in (inner[0][2], inner[1])):
            return ("+", inner[0][1], ("const", inner[0][2][1] + inner[1][1]))
        return (kind, *inner)
    if kind == "out":
        return ("out", fold(node[1]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "for":
        return ("for", node[1], fold(node[2]))
    if kind == "if":
        test, yes, no = map(fold, node[1:])
        return (yes if test[1] else no) if test[0] == "const" else ("if", test, yes, no)
    nodes: list[tuple] = []
    for x in map(fold, node[1]):
        for y in x[1] if x[0] == "block" else [x]:
            if y[0] == "out" and y[1][0] == "const" and nodes and nodes[-1][0] == "out" and nodes[-1][1][0] == "const":
                nodes[-1] = ("out", ("const", _text(nodes[-1][1][1]) + _text(y[1][1])))
            else:
                nodes.append(y)
    return ("block", nodes)


# --- closures ---------------------------------------------------------------------------------------

Value = Callable[[dict], object]
Writer = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _text(value: object) -> str:
    return value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _add(a: Value, b: Value) -> Value:
    return lambda at: _text(a(at)) + _text(b(at))


_OPERATORS: dict[str, Callable[..., Value]] = {
    "or": lambda a, b: lambda at: a(at) or b(at),
    "and": lambda a, b: lambda at: a(at) and b(at),
    "not": lambda a: lambda at: not a(at),
    "==": lambda a, b: lambda at: a(at) == b(at),
    "!=": lambda a, b: lambda at: a(at) != b(at),
    "+": _add,
}


def value_of(node: tuple) -> Value:
    if node[0] == "const":
        return lambda at, v=node[1]: v
    if node[0] == "get":
        return lambda at, n=node[1], a=node[2]: at[n][a]
    if node[0] == "filter":
        return lambda at, f=FILTERS[node[1]], v=value_of(node[2]): f(_text(v(at)))
    return _OPERATORS[node[0]](*map(value_of, node[1:]))


def writer_of(node: tuple) -> Writer:
    """A closure that yields (text, under the mask) for a scope and the state of the mask."""
    kind = node[0]
    if kind == "out":
        value = value_of(node[1])

        def write(at: dict, masked: bool) -> Iterator[tuple[str, bool]]:
            yield _text(value(at)), masked

    elif kind == "if":
        test, yes, no = value_of(node[1]), writer_of(node[2]), writer_of(node[3])

        def write(at, masked):
            yield from (yes if test(at) else no)(at, masked)

    elif kind == "generation":
        inner = writer_of(node[1])

        def write(at, masked):
            yield from inner(at, True)

    elif kind == "for":
        name, body = node[1], writer_of(node[2])

        def write(at, masked):
            messages = iter(at["messages"])
            now = next(messages, None)
            index = 0
            while now is not None:
                later = next(messages, None)
                loop = {"first": index == 0, "last": later is None, "index": index + 1, "index0": index}
                yield from body({name: now, "loop": loop}, masked)
                now, index = later, index + 1

    else:
        writers = [writer_of(x) for x in node[1]]

        def write(at, masked):
            for w in writers:
                yield from w(at, masked)

    return write


def compile_template(template: str) -> Callable[[Iterator[dict]], Iterator[tuple[str, bool]]]:
    write = writer_of(fold(parse(template)))
    return lambda messages: write({"messages": messages}, False)


# --- over tables ------------------------------------------------------------------------------------

FORMATTED = "conv_id long, part long, text string, mask array<struct<start: long, end: long>>"
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def format_conversations(turns: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part (from 0), text, mask (spans of code points in the part's text that are trained on)."""
    compile_template(template)  # errors show here, not in a task

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write, out, held = compile_template(template), [], 0
        for conv_id, rows in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            messages = ({"role": r["role"], "text": r["text"]} for r in rows)
            part, texts, mask, at = 0, [], [], 0
            for text, masked in write(messages):
                if at > part_chars:
                    out.append({"conv_id": conv_id, "part": part, "text": "".join(texts), "mask": mask})
                    part, texts, mask, held, at = part + 1, [], [], held + at, 0
                if masked and text:
                    mask.append({"start": at, "end": at + len(text)})
                texts.append(text)
                at += len(text)
                if held > 8 * part_chars:
                    yield pa.RecordBatch.from_pylist(out, _FORMATTED)
                    out, held = [], 0
            out.append({"conv_id": conv_id, "part": part, "text": "".join(texts), "mask": mask})
            held += at
            if held > 8 * part_chars or len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, _FORMATTED)
                out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, _FORMATTED)

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return turns.select("conv_id", "role", "text").mapInArrow(render, FORMATTED)


_MARKS = re.compile(r"\\.|<turn:((?:\\.|[^>\\])*)>\n|</turn>\n", re.S)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """role and text of every turn in text written by TEMPLATE, both unescaped."""
    role, start = None, 0
    for m in _MARKS.finditer(text):
        if m[0][0] == "\\":
            continue
        if m[0] == "</turn>\n":
            yield unescape(role), unescape(text[start : m.start()])
        else:
            role, start = m[1], m.end()


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from what TEMPLATE has written."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, parts in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            n, turns, loss_chars, loss, chars, rest = 0, hashlib.sha256(), 0, hashlib.sha256(), 0, ""
            for p in parts:
                chars += len(p["text"])
                for span in p["mask"]:
                    said = unescape(p["text"][span["start"] : span["end"]])
                    loss_chars += len(said)
                    loss.update(said.encode())
                rest += p["text"]
                done = 0  # a part may end inside a turn: what follows its last whole turn waits
                for m in _MARKS.finditer(rest):
                    if m[0] == "</turn>\n":
                        done = m.end()
                for role, text in read_turns(rest[:done]):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                rest = rest[done:]
            out.append({"conv_id": conv_id, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars})
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
