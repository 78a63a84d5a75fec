"""Chat formatting: a small sandboxed template language, compiled to Python closures, rendered over sorted turns.

The language has text, `{{ expression }}`, `{% for m in messages %}`, `{% if %}/{% elif %}/{% else %}/{% endif %}`,
`{% generation %}/{% endgeneration %}` and `{% set name = expression %}`. Expressions are literals, names, `.field` of a
message or of `loop` (index0, first, last), `+`, `==`, `!=`, `in`, `and`, `or`, `not`, parentheses and the filters
`upper`, `lower`, `trim`, `escape`. There are no calls, no attributes of Python objects, no imports and no while loop:
a template reads only its messages and its literals, and ends. Constants are folded before closures are made.

Turns stream: rows are hash-partitioned by conversation, sorted by turn, and the messages loop pulls them one by one,
so a conversation of any length needs memory for two turns only. A conversation's digest is a sequential SHA-256, so
one conversation stays in one task; its cost there is one pass over its text.

Control strings inside texts and roles get a backslash after their first character, and backslashes are doubled; both
are undone when the output is read back. In roles, newlines are escaped too, as the template ends a role with one.

Defined results: null text and null role count as empty; rows of a conversation are ordered by turn (null first), then
role, then text, so ties and repeated rows give the same output each time; a null id is a conversation of its own; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the production template.
TEMPLATE = (
    "{% for m in messages %}{{ '<|im_start|>' + m.role + '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text }}{% endgeneration %}{% else %}{{ m.text }}{% endif %}"
    "{{ '<|im_end|>' + '\\n' }}{% endfor %}"
)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

_CONTROL = re.compile(r"<(?=\||/?s>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Inverse of escape: a doubled backslash is one, a single one was put after a control string's first character."""
    return _ESCAPED.sub(lambda m: m[1], text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role) if "\\" in role else role


class TemplateError(ValueError):
    """A template that doesn't parse, or uses what the language doesn't have."""


# --- parser: nodes are tuples (kind, ...) ---

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|(==|!=|[+|.()])|([A-Za-z_]\w*))", re.DOTALL)
_FILTERS: dict[str, Callable[[str], str]] = {"upper": str.upper, "lower": str.lower, "trim": str.strip, "escape": escape}
# Escapes in string literals.
_LITERAL = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"unexpected text in expression: {source[at:].strip()[:20]!r}")
            self.tokens.append(m[m.lastindex] if m.lastindex != 1 else m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        token = self.peek()
        if not token or wanted and token not in wanted:
            raise TemplateError(f"expected {' or '.join(wanted) or 'a value'}, found {token or 'the end'!r}")
        self.at += 1
        return token

    def whole(self) -> tuple:
        node = self.either()
        if self.peek():
            raise TemplateError(f"unexpected {self.peek()!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.peek() == "or":
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.peek() == "and":
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        if self.peek() == "not":
            self.take()
            return ("not", self.negated())
        node = self.sum()
        if self.peek() in ("==", "!=", "in"):
            node = (self.take(), node, self.sum())
        return node

    def sum(self) -> tuple:
        node = self.filtered()
        while self.peek() == "+":
            self.take()
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.peek() == "|":
            self.take()
            if (name := self.take()) not in _FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def atom(self) -> tuple:
        token = self.take()
        if token == "(":
            node = self.either()
            self.take(")")
        elif token[0] in "'\"":
            node = ("const", re.sub(r"\\(.)", lambda m: _LITERAL.get(m[1], m[0]), token[1:-1], flags=re.DOTALL))
        elif token.isdigit():
            node = ("const", int(token))
        elif token in ("true", "false"):
            node = ("const", token == "true")
        elif re.fullmatch(r"[A-Za-z_]\w*", token) and token not in ("and", "or", "not", "in"):
            node = ("name", token)
        else:
            raise TemplateError(f"unexpected {token!r}")
        while self.peek() == ".":
            self.take()
            if (field := self.take()).startswith("_") or not field.isidentifier():
                raise TemplateError(f"no field {field!r}")
            node = ("field", node, field)
        return node


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    parts.reverse()
    body, end = _block(parts, ())
    assert not end
    return body


def _block(parts: list, ends: tuple[str, ...]) -> tuple[tuple, str]:
    nodes = []
    while parts:
        kind, value = parts.pop()
        if kind == "text":
            nodes.append(("out", ("const", value)))
        elif kind == "out":
            nodes.append(("out", _Expression(value).whole()))
        else:
            word = value.split(None, 1)[0] if value else ""
            rest = value[len(word) :].strip()
            if word in ends:
                return ("block", *nodes), value
            if word == "for":
                if not (m := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+messages", rest)):
                    raise TemplateError(f"a loop runs over messages only: {rest!r}")
                nodes.append(("for", m[1], _block(parts, ("endfor",))[0]))
            elif word == "if":
                nodes.append(_branches(parts, rest))
            elif word == "generation":
                nodes.append(("generation", _block(parts, ("endgeneration",))[0]))
            elif word == "set" and (m := re.fullmatch(r"([A-Za-z]\w*)\s*=(?!=)(.*)", rest, re.DOTALL)):
                nodes.append(("set", m[1], _Expression(m[2]).whole()))
            else:
                raise TemplateError(f"unexpected tag {value!r}")
    if ends:
        raise TemplateError(f"missing {ends[-1]!r}")
    return ("block", *nodes), ""


def _branches(parts: list, test: str) -> tuple:
    then, end = _block(parts, ("elif", "else", "endif"))
    if end.startswith("elif"):
        other: tuple = _branches(parts, end[4:].strip())
    elif end == "else":
        other = _block(parts, ("endif",))[0]
    else:
        other = ("block",)
    return ("if", _Expression(test).whole(), then, other)


# --- constant folding ---


def fold(node: tuple) -> tuple:
    """The tree with constant expressions computed, dead branches removed and neighbouring text joined."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "block":
        out: list[tuple] = []
        for child in map(fold, node[1:]):
            for x in child[1:] if child[0] == "block" else (child,):
                if x == ("out", ("const", "")):
                    continue
                if out and x[0] == out[-1][0] == "out" and x[1][0] == out[-1][1][0] == "const":
                    out[-1] = ("out", ("const", _text(out[-1][1][1]) + _text(x[1][1])))
                else:
                    out.append(x)
        return ("block", *out)
    if kind == "if":
        test = fold(node[1])
        if test[0] == "const":
            return fold(node[2] if test[1] else node[3])
        return ("if", test, fold(node[2]), fold(node[3]))
    if kind in ("for", "set", "filter"):
        node = (kind, node[1], fold(node[2]))
        return ("const", _FILTERS[node[1]](_text(node[2][1]))) if kind == "filter" and node[2][0] == "const" else node
    if kind == "field":
        return ("field", fold(node[1]), node[2])
    node = (kind, *map(fold, node[1:]))
    if kind == "+" and node[2][0] == "const" and node[1][0] == "+" and node[1][2][0] == "const":
        node = ("+", node[1][1], ("const", _text(node[1][2][1]) + _text(node[2][1])))
    if kind not in ("out", "generation") and all(x[0] == "const" for x in node[1:]):
        return ("const", _expression(node)({}))
    return node


# --- closures ---


def _text(value: object) -> str:
    return "" if value is None else str(value)


def _expression(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    if kind == "field":
        of, name = _expression(node[1]), node[2]
        return lambda env: v.get(name) if isinstance(v := of(env), dict) else None
    if kind == "filter":
        of, f = _expression(node[2]), _FILTERS[node[1]]
        return lambda env: f(_text(of(env)))
    if kind == "not":
        of = _expression(node[1])
        return lambda env: not of(env)
    a, b = _expression(node[1]), _expression(node[2])
    made: dict[str, Callable[[dict], object]] = {
        "+": lambda env: _text(a(env)) + _text(b(env)),
        "==": lambda env: a(env) == b(env),
        "!=": lambda env: a(env) != b(env),
        "in": lambda env: _text(a(env)) in _text(b(env)),
        "and": lambda env: a(env) and b(env),
        "or": lambda env: a(env) or b(env),
    }
    return made[kind]


Piece = tuple[str, bool]


def _statement(node: tuple, generated: bool = False) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "out":
        value = _expression(node[1])
        return lambda env: iter(((_text(value(env)), generated),))
    if kind == "set":
        value, name = _expression(node[2]), node[1]

        def assign(env: dict) -> Iterator[Piece]:
            env[name] = value(env)
            return iter(())

        return assign
    if kind == "generation":
        return _statement(node[1], True)
    if kind == "if":
        test, then, other = _expression(node[1]), _statement(node[2], generated), _statement(node[3], generated)
        return lambda env: (then if test(env) else other)(env)
    if kind == "for":
        name, body = node[1], _statement(node[2], generated)

        def loop(env: dict) -> Iterator[Piece]:
            turns = iter(env["messages"])
            m, i = next(turns, None), 0
            while m is not None:
                after = next(turns, None)
                env[name], env["loop"] = m, {"index0": i, "first": i == 0, "last": after is None}
                yield from body(env)
                m, i = after, i + 1

        return loop
    steps = [_statement(x, generated) for x in node[1:]]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)

    return run


def compiled(source: str) -> Callable[[Iterator[dict]], Iterator[Piece]]:
    """A function from messages (dicts of role and text, already escaped) to pieces of output, each marked as generated or not."""
    run = _statement(fold(parse(source)))
    return lambda messages: run({"messages": messages})


# --- reading back ---


def turns_of(pieces: Iterator[Piece]) -> Iterator[tuple[str, str, str]]:
    """role, text and the text under the loss mask (still escaped) of each turn, from rendered pieces of the ChatML-like format.

    Only complete turns are cut off the buffer, so it holds one turn at most. A closing mark can't come from a text,
    as texts are escaped.
    """
    buffer: list[str] = []
    mask: list[str] = []
    for piece, generated in pieces:
        buffer.append(piece)
        if generated:
            mask.append(piece)
        if piece.endswith(CLOSE):
            whole = "".join(buffer)
            if not whole.startswith(OPEN) or whole.find(CLOSE) != len(whole) - len(CLOSE):
                raise ValueError(f"not one turn: {whole[:60]!r}")
            role, text = whole[len(OPEN) : -len(CLOSE)].split("\n", 1)
            yield role, text, "".join(mask)
            buffer, mask = [], []
    if buffer:
        raise ValueError(f"an open turn: {''.join(buffer)[:60]!r}")


def _ordered(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    empty = F.lit("")
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), empty).alias("role"),
        F.coalesce(F.col(text), empty).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)


def _messages(rows: Iterator[tuple]) -> Iterator[dict]:
    return ({"role": escape_role(role), "text": escape(text)} for _, role, text in rows)


def format_conversations(
    conversations: DataFrame, template: str = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, formatted, and loss_spans (start and end of generated stretches, in code points of formatted).

    Holds one formatted conversation in memory at a time.
    """
    parse(template)  # fails here, not on an executor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        for cid, rows in groupby(_rows(batches), key=lambda r: r[0]):
            out, spans, at = [], [], 0
            for piece, generated in render(_messages(rows)):
                out.append(piece)
                if generated and spans and spans[-1]["end"] == at:
                    spans[-1]["end"] += len(piece)
                elif generated:
                    spans.append({"start": at, "end": at + len(piece)})
                at += len(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array([cid], pa.int64()), pa.array(["".join(out)], pa.string()), pa.array([spans], pa.list_(_SPAN))],
                ["conv_id", "formatted", "loss_spans"],
            )

    schema = "conv_id bigint, formatted string, loss_spans array<struct<start: bigint, end: bigint>>"
    return _ordered(conversations, conv_id, turn, role, text).mapInArrow(run, schema)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def digests(
    conversations: DataFrame, template: str = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """What is read back from each formatted conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    parse(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        done: list[tuple] = []
        for cid, rows in groupby(_rows(batches), key=lambda r: r[0]):
            all_, loss = hashlib.sha256(), hashlib.sha256()
            turns = loss_chars = chars = 0

            def counted(pieces: Iterator[Piece]) -> Iterator[Piece]:
                nonlocal chars
                for p in pieces:
                    chars += len(p[0])
                    yield p

            for who, what, mask in turns_of(counted(render(_messages(rows)))):
                turns += 1
                all_.update(f"{unescape_role(who)}\n{unescape(what)}\n".encode("utf-8", "surrogatepass"))
                plain = unescape(mask)
                loss_chars += len(plain)
                loss.update(plain.encode("utf-8", "surrogatepass"))
            done.append((cid, turns, all_.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(done) == 4096:
                yield _digest_batch(done)
                done = []
        if done:
            yield _digest_batch(done)

    return _ordered(conversations, conv_id, turn, role, text).mapInArrow(run, _DIGESTS)


_DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in _DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
