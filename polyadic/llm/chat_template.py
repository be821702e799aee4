"""Chat formatting by compiled templates.

A template is parsed into a syntax tree, constants are folded, and each node becomes a Python closure
that writes text to a sink.  The language has text, ``{{ expression }}``, ``{% for x in y %}``,
``{% if %} {% elif %} {% else %}``, ``{% set x = y %}``, ``{% generation %}`` marks and ``{# remarks #}``.
Expressions know literals, names, ``a.b``, ``a['b']``, ``a | filter``, ``not and or == != in + ~`` and
parentheses.  They reach the given variables and filters only: no calls, no Python attributes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = """\
{% for m in messages %}<|{{ m.role | escape }}|>
{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|end|>
{% endfor %}"""
#: Strings that mean something to a model or to read_back(); escape() breaks them up inside texts.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MARK = "\\"

_BREAK = re.compile(f"{re.escape(MARK)}|(?=(?:{'|'.join(map(re.escape, CONTROL))}))(.)", re.S)
_JOIN = re.compile(f"{re.escape(MARK)}({re.escape(MARK)}?)")


def escape(text: str) -> str:
    """Double each MARK and put one after the first character of each control string."""
    return _BREAK.sub(lambda m: (m[1] or MARK) + MARK, text)


def unescape(text: str) -> str:
    """The inverse of escape()."""
    return _JOIN.sub(r"\1", text)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(_shown(v)),
    "trim": lambda v: _shown(v).strip(),
    "upper": lambda v: _shown(v).upper(),
    "lower": lambda v: _shown(v).lower(),
    "length": len,
}


class TemplateError(ValueError):
    """A template that can't be compiled or rendered."""


def _shown(v: Any) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


_PART = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<int>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<op>==|!=|[.\[\]()|+~]))")
_ESCAPES = {"n": "\n", "t": "\t"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expressions:
    """A recursive-descent reader of one expression into nested tuples."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] != "str"

    def take(self, *values: str) -> bool:
        found = self.peek(*values)
        self.at += found
        return found

    def need(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"expected {kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.joined()
        while self.peek("==", "!=", "in"):
            op = self.tokens[self.at][1]
            self.at += 1
            tree = (op, tree, self.joined())
        return tree

    def joined(self) -> tuple:
        tree = self.filtered()
        while self.peek("+", "~"):
            op = self.tokens[self.at][1]
            self.at += 1
            tree = (op, tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.reached()
        while self.take("|"):
            name = self.need("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def reached(self) -> tuple:
        tree = self.atom()
        while self.peek(".", "["):
            if self.take("."):
                tree = ("get", tree, ("const", self.need("name")))
            else:
                self.at += 1
                tree = ("get", tree, self.either())
                if not self.take("]"):
                    raise TemplateError("expected ]")
        return tree

    def atom(self) -> tuple:
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("expected )")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return ("const", int(value))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        literals = {"true": True, "false": False, "none": None}
        return ("const", literals[value.lower()]) if value.lower() in literals else ("name", value)


def parse(template: str) -> list[tuple]:
    """The syntax tree: a list of text, out, for, if, set and generation nodes."""
    parts: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _PART.finditer(template):
        text = template[at : m.start()]
        parts.append(("text", text.lstrip() if strip else text))
        if m[1] or m[4]:
            parts[-1] = ("text", parts[-1][1].rstrip())
        strip, at = bool(m[3] or m[6]), m.end()
        if m[2] is not None:
            parts.append(("out", m[2]))
        elif m[5] is not None:
            parts.append(("do", m[5].strip()))
    parts.append(("text", template[at:].lstrip() if strip else template[at:]))
    rest = iter(parts)

    def block(*ends: str) -> tuple[list[tuple], str]:
        nodes: list[tuple] = []
        for kind, source in rest:
            word = source.split(None, 1)[0] if kind == "do" and source else ""
            if kind == "text":
                if source:
                    nodes.append(("text", source))
            elif kind == "out":
                nodes.append(("out", _Expressions(source).whole()))
            elif word in ends:
                return nodes, source
            elif word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", source, re.S)
                if not m:
                    raise TemplateError(f"can't read {source!r}")
                nodes.append(("for", m[1], _Expressions(m[2]).whole(), block("endfor")[0]))
            elif word == "if":
                branches, end = [], source
                while not end.startswith("endif"):
                    test = ("const", True) if end.startswith("else") else _Expressions(end.split(None, 1)[1]).whole()
                    body, end = block("elif", "else", "endif")
                    branches.append((test, body))
                nodes.append(("if", branches))
            elif word == "set":
                m = re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=\s*(.+)", source, re.S)
                if not m:
                    raise TemplateError(f"can't read {source!r}")
                nodes.append(("set", m[1], _Expressions(m[2]).whole()))
            elif word == "generation":
                nodes.append(("generation", block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown or misplaced tag {source!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ""

    return block()[0]


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "~": lambda a, b: _shown(a) + _shown(b),
}


def _fold_expression(t: tuple) -> tuple:
    kind = t[0]
    if kind in ("const", "name"):
        return t
    if kind == "filter":
        inner = _fold_expression(t[2])
        return ("const", FILTERS[t[1]](inner[1])) if inner[0] == "const" else ("filter", t[1], inner)
    if kind == "not":
        inner = _fold_expression(t[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    left, right = _fold_expression(t[1]), _fold_expression(t[2])
    if kind in ("and", "or"):
        return (right if bool(left[1]) == (kind == "and") else left) if left[0] == "const" else (kind, left, right)
    if kind in _BINARY and left[0] == right[0] == "const":
        return ("const", _BINARY[kind](left[1], right[1]))
    return (kind, left, right)


def fold(nodes: list[tuple]) -> list[tuple]:
    """The tree with constant expressions worked out, dead branches gone and neighbouring texts joined."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "out":
            e = _fold_expression(node[1])
            add(("text", _shown(e[1])) if e[0] == "const" else ("out", e))
        elif node[0] == "for":
            add(("for", node[1], _fold_expression(node[2]), fold(node[3])))
        elif node[0] == "set":
            add(("set", node[1], _fold_expression(node[2])))
        elif node[0] == "generation":
            add(("generation", fold(node[1])))
        elif node[0] == "if":
            branches = []
            for test, body in node[1]:
                test = _fold_expression(test)
                if test[0] != "const" or test[1]:
                    branches.append((test, fold(body)))
                if test[0] == "const" and test[1]:
                    break
            if branches and branches[0][0][0] == "const":
                for inner in branches[0][1]:
                    add(inner)
            elif branches:
                add(("if", branches))
        else:
            add(node)
    return out


Scope = dict[str, Any]


def _value(t: tuple) -> Callable[[Scope], Any]:
    kind = t[0]
    if kind == "const":
        return lambda scope, v=t[1]: v
    if kind == "name":
        return lambda scope, n=t[1]: scope.get(n)
    if kind == "filter":
        return lambda scope, f=FILTERS[t[1]], e=_value(t[2]): f(e(scope))
    if kind == "not":
        return lambda scope, e=_value(t[1]): not e(scope)
    a, b = _value(t[1]), _value(t[2])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    if kind == "get":

        def get(scope: Scope) -> Any:
            base, key = a(scope), b(scope)
            if isinstance(base, dict):
                return base.get(key)
            if isinstance(base, (list, str)) and isinstance(key, int):
                return base[key] if -len(base) <= key < len(base) else None
            raise TemplateError(f"no {key!r} here")

        return get
    return lambda scope, f=_BINARY[kind]: f(a(scope), b(scope))


class Sink:
    """Rendered text and the spans of it that a model should generate."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _writer(nodes: list[tuple]) -> Callable[[Scope, Sink], None]:
    steps = [_step(n) for n in nodes]

    def run(scope: Scope, sink: Sink) -> None:
        for s in steps:
            s(scope, sink)

    return run


def _step(node: tuple) -> Callable[[Scope, Sink], None]:
    kind = node[0]
    if kind == "text":
        return lambda scope, sink, text=node[1]: sink.write(text)
    if kind == "out":
        return lambda scope, sink, e=_value(node[1]): sink.write(_shown(e(scope)))
    if kind == "set":

        def put(scope: Scope, sink: Sink, name: str = node[1], e: Callable = _value(node[2])) -> None:
            scope[name] = e(scope)

        return put
    if kind == "generation":

        def mark(scope: Scope, sink: Sink, body: Callable = _writer(node[1])) -> None:
            start = sink.size
            body(scope, sink)
            sink.spans.append((start, sink.size))

        return mark
    if kind == "for":

        def loop(scope: Scope, sink: Sink, name: str = node[1], e: Callable = _value(node[2]), body: Callable = _writer(node[3])) -> None:
            items = list(e(scope) or ())
            for i, item in enumerate(items):
                body(scope | {name: item, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(items) - 1}}, sink)

        return loop
    branches = [(_value(test), _writer(body)) for test, body in node[1]]

    def choose(scope: Scope, sink: Sink) -> None:
        for test, body in branches:
            if test(scope):
                body(scope, sink)
                return

    return choose


def compile_template(template: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's variables that gives the text and its generation spans."""
    body = _writer(fold(parse(template)))

    def render(**variables: Any) -> tuple[str, list[tuple[int, int]]]:
        sink = Sink()
        body(dict(variables), sink)
        return "".join(sink.parts), sink.spans

    return render


_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of what TEMPLATE made."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def format_conversations(turns: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, n_turns, formatted, spans (of generated text, in code points).

    Rows are taken by turn (nulls first; ties by role, then text; repeated rows stay).  Null roles
    and texts are empty.  Rows without an identifier are one conversation.  A conversation is held by
    one task, as its formatted text is one value; conversations stream through sorted partitions.
    Other columns are not read.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = compile_template(template)
        schema = pa.schema([("conv", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])
        current, messages, rows, size = None, [], [], 0

        def close() -> None:
            nonlocal size
            if messages:
                text, spans = write(messages=messages)
                rows.append((current, len(messages), text, [list(s) for s in spans]))
                size += len(text)

        for batch in batches:
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv", "role", "text")), strict=True):
                if conv != current:
                    close()
                    current, messages = conv, []
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                messages.append({"role": role or "", "text": text or ""})
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = turns.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    out = dealt.mapInArrow(render, "conv long, n_turns long, formatted string, spans array<array<long>>")
    return out.withColumnRenamed("conv", id_col)


def digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What formatted texts hold, read back: id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(batch["conv"].to_pylist(), batch["formatted"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                found = read_back(text)
                for role, said in found:
                    turns.update(f"{role}\n{said}\n".encode())
                chars = 0
                for start, end in spans:
                    said = unescape(text[start:end])
                    chars += len(said)
                    loss.update(said.encode())
                rows.append((conv, len(found), turns.hexdigest(), chars, loss.hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = formatted.select(F.col(id_col).alias("conv"), "formatted", "spans")
    return rows.mapInArrow(read, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", id_col)
