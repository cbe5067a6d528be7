"""Chat formatting: a compiler for a sandboxed template language, and formatting of conversation tables with loss masks.

The language: text, {{ expression }}, {# comment #}, and the tags for-endfor, if-elif-else-endif, set, generation-endgeneration. A "-" inside a
delimiter takes away the white space beside it. Expressions: strings, whole numbers, true, false, none; names; member access (a.b, a["b"]) to fields of mappings;
+, ~ (joins as strings), ==, !=, <, <=, >, >=, in, not in, and, or, not, x if c else y; filters (x | trim). There are no calls, and no access to Python attributes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, fields, is_dataclass
from functools import cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Strings with a meaning to models; inside texts they are broken up. None holds the breaking character.
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BREAK = "\\"
_FOUND = re.compile(f"{re.escape(BREAK)}|(?=(?:{'|'.join(map(re.escape, CONTROLS))}))(.)", re.DOTALL)
_BROKEN = re.compile(re.escape(BREAK) + "(.)", re.DOTALL)

TEMPLATE = (
    "{%- for message in messages -%}"
    "{{ '<|im_start|>' + (message.role | escape) + '<|im_sep|>' }}"
    "{%- if message.role == 'assistant' -%}{% generation %}{{ message.text | escape }}{% endgeneration %}{%- else -%}{{ message.text | escape }}{%- endif -%}"
    "{{ '<|im_end|>' ~ '\n' }}"
    "{%- endfor -%}"
)


def escape(text: str) -> str:
    """The text with BREAK put after the first character of each control string, wherever one begins, and doubled where it stands itself."""
    return _FOUND.sub(lambda m: (m[1] or BREAK) + BREAK, text)


def unescape(text: str) -> str:
    """The text that was escaped."""
    return _BROKEN.sub(lambda m: BREAK if m[1] == BREAK else m[1], text)


class TemplateError(ValueError):
    pass


# --- syntax tree ---------------------------------------------------------------------------------------------------------------


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Member:
    of: object
    key: object


@dataclass
class Op:
    op: str
    args: list


@dataclass
class Filter:
    name: str
    of: object


@dataclass
class Text:
    value: object


@dataclass
class If:
    branches: list  # (condition, body)


@dataclass
class For:
    name: str
    over: object
    body: list


@dataclass
class Set:
    name: str
    value: object


@dataclass
class Generation:
    body: list


_PARTS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.\[\]()]))", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_FILTERS: dict[str, Callable] = {"escape": lambda x: escape(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len, "string": lambda x: _shown(x)}


def _shown(x: object) -> str:
    return "" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x)


_OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b, "~": lambda a, b: _shown(a) + _shown(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b, "not": lambda a: not a,
}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i = 0

    def whole(self):
        out = self.choice()
        if self.i < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.i][1]!r}")
        return out

    def next_is(self, *values: str) -> str | None:
        if self.i < len(self.tokens) and self.tokens[self.i][0] in ("op", "name") and self.tokens[self.i][1] in values:
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.next_is(value):
            raise TemplateError(f"{value!r} is missing")

    def choice(self):
        value = self.either()
        if self.next_is("if"):
            condition = self.either()
            other = self.choice() if self.next_is("else") else Const(None)
            return Op("?", [condition, value, other])
        return value

    def either(self):
        value = self.both()
        while self.next_is("or"):
            value = Op("or", [value, self.both()])
        return value

    def both(self):
        value = self.negation()
        while self.next_is("and"):
            value = Op("and", [value, self.negation()])
        return value

    def negation(self):
        return Op("not", [self.negation()]) if self.next_is("not") else self.comparison()

    def comparison(self):
        value = self.sum()
        while op := self.next_is("==", "!=", "<", "<=", ">", ">=", "in", "not"):
            if op == "not":
                self.need("in")
                op = "not in"
            value = Op(op, [value, self.sum()])
        return value

    def sum(self):
        value = self.filtered()
        while op := self.next_is("+", "~"):
            value = Op(op, [value, self.filtered()])
        return value

    def filtered(self):
        value = self.primary()
        while self.next_is("|"):
            kind, name = self.tokens[self.i] if self.i < len(self.tokens) else ("", "")
            if kind != "name" or name not in _FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.i += 1
            value = Filter(name, value)
        return value

    def primary(self):
        if self.i == len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.i]
        self.i += 1
        if kind == "str":
            out = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        elif kind == "int":
            out = Const(int(value))
        elif kind == "name":
            out = Const(_WORDS[value]) if value in _WORDS else Name(value)
        elif value == "(":
            out = self.choice()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while op := self.next_is(".", "["):
            if op == ".":
                kind, key = self.tokens[self.i] if self.i < len(self.tokens) else ("", "")
                if kind != "name":
                    raise TemplateError("a field name is missing")
                self.i += 1
                out = Member(out, Const(key))
            else:
                out = Member(out, self.choice())
                self.need("]")
        return out


def parse(template: str) -> list:
    """The syntax tree of a template."""
    parts = _PARTS.split(template)
    for i, part in enumerate(parts):
        if i % 2 and part[2:3] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if i % 2 and part[-3:-2] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    at = 0

    def body(*ends: str) -> tuple[list, str, str]:
        nonlocal at
        out: list = []
        while at < len(parts):
            part, is_tag = parts[at], at % 2
            at += 1
            if not is_tag:
                if part:
                    out.append(Text(Const(part)))
                continue
            inner = part[2:-2].strip("-").strip()
            if part.startswith("{#"):
                continue
            if part.startswith("{{"):
                out.append(Text(_Expression(inner).whole()))
                continue
            word, _, rest = inner.partition(" ")
            if word in ends:
                return out, word, rest
            if word == "if":
                branches, condition, end = [], _Expression(rest).whole(), ""
                while end != "endif":
                    block, end, rest = body("elif", "else", "endif")
                    branches.append((condition, block))
                    condition = _Expression(rest).whole() if end == "elif" else Const(True)
                out.append(If(branches))
            elif word == "for":
                if not (m := re.fullmatch(r"([A-Za-z_]\w*) in (.+)", rest.strip(), re.DOTALL)):
                    raise TemplateError(f"can't read for {rest!r}")
                block, _, _ = body("endfor")
                out.append(For(m[1], _Expression(m[2]).whole(), block))
            elif word == "set":
                if not (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.+)", rest.strip(), re.DOTALL)):
                    raise TemplateError(f"can't read set {rest!r}")
                out.append(Set(m[1], _Expression(m[2]).whole()))
            elif word == "generation":
                block, _, _ = body("endgeneration")
                out.append(Generation(block))
            else:
                raise TemplateError(f"no tag {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, "", ""

    return body()[0]


def _constant(run: Callable, *values: object) -> object:
    try:
        return run(*values)
    except TypeError as e:
        raise TemplateError(f"constants of kinds that don't go together: {', '.join(map(repr, values))}") from e


def _named(node, name: str) -> int:
    """How often a tree names a variable."""
    if isinstance(node, (list, tuple)):
        return sum(_named(n, name) for n in node)
    if isinstance(node, Name):
        return int(node.name == name)
    if isinstance(node, Const) or not is_dataclass(node):
        return 0
    return int(isinstance(node, Set) and node.name == name) + sum(_named(getattr(node, f.name), name) for f in fields(node))


def check_stream(template: str) -> None:
    """Raise TemplateError unless the template reads its messages once, turn by turn, in one outer loop, as tables are formatted; render() takes any template."""
    nodes = fold(parse(template))
    loops = [n for n in nodes if isinstance(n, For) and n.over == Name("messages")]
    if len(loops) != 1 or _named(nodes, "messages") != 1:
        raise TemplateError("a template for tables must read its messages in one outer loop, and nowhere else")


def fold(node):
    """The tree with constant parts computed: operators and filters of constants, branches that always or never hold, and neighbouring texts."""
    if isinstance(node, list):
        out: list = []
        for n in map(fold, node):
            for x in n if isinstance(n, list) else [n]:
                if isinstance(x, Text) and isinstance(x.value, Const):
                    x = Text(Const(_shown(x.value.value)))
                    if out and isinstance(out[-1], Text) and isinstance(out[-1].value, Const):
                        x = Text(Const(out.pop().value.value + x.value.value))
                    if not x.value.value:
                        continue
                out.append(x)
        return out
    match node:
        case Op("?", [c, a, b]):
            c, a, b = fold(c), fold(a), fold(b)
            return (a if c.value else b) if isinstance(c, Const) else Op("?", [c, a, b])
        case Op(("and" | "or") as op, [a, b]):
            a, b = fold(a), fold(b)
            return (b if bool(a.value) == (op == "and") else a) if isinstance(a, Const) else Op(op, [a, b])
        case Op(op, args):
            args = [fold(a) for a in args]
            if op == "+" and isinstance(args[1], Const) and isinstance(args[0], Op) and args[0].op == "+" and isinstance(args[0].args[1], Const):
                args = [args[0].args[0], Const(_constant(_OPS["+"], args[0].args[1].value, args[1].value))]
            return Const(_constant(_OPS[op], *[a.value for a in args])) if all(isinstance(a, Const) for a in args) else Op(op, args)
        case Filter(name, of):
            of = fold(of)
            return Const(_constant(_FILTERS[name], of.value)) if isinstance(of, Const) else Filter(name, of)
        case Member(of, key):
            return Member(fold(of), fold(key))
        case Text(value):
            return Text(fold(value))
        case Set(name, value):
            return Set(name, fold(value))
        case Generation(body):
            return Generation(fold(body))
        case For(name, over, body):
            return For(name, fold(over), fold(body))
        case If(branches):
            kept = []
            for c, b in branches:
                c, b = fold(c), fold(b)
                if isinstance(c, Const) and not c.value:
                    continue
                kept.append((c, b))
                if isinstance(c, Const):
                    break
            return kept[0][1] if kept and isinstance(kept[0][0], Const) else If(kept) if kept else []
    return node


# --- closures ------------------------------------------------------------------------------------------------------------------


@dataclass
class Sink:
    """What a rendering has written since it was last emptied, and the spans under generation markers, as offsets into the whole output."""

    parts: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    chars: int = 0
    flushed: int = 0

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.chars += len(text)

    def take(self) -> tuple[str, list[tuple[int, int]]]:
        """What has been written since the last call."""
        out = "".join(self.parts), self.spans
        self.parts, self.spans, self.flushed = [], [], self.chars
        return out


def _value(node) -> Callable[[dict], object]:
    match node:
        case Const(value):
            return lambda scope: value
        case Name(name):
            return lambda scope: scope.get(name)
        case Member(of, key):
            of, key = _value(of), _value(key)

            def member(scope: dict) -> object:
                x = of(scope)
                return x.get(key(scope)) if type(x) is dict else None

            return member
        case Filter(name, of):
            of, run = _value(of), _FILTERS[name]
            return lambda scope: run(of(scope))
        case Op("?", args):
            c, a, b = map(_value, args)
            return lambda scope: a(scope) if c(scope) else b(scope)
        case Op("and", args):
            a, b = map(_value, args)
            return lambda scope: a(scope) and b(scope)
        case Op("or", args):
            a, b = map(_value, args)
            return lambda scope: a(scope) or b(scope)
        case Op(op, args):
            run, args = _OPS[op], [_value(a) for a in args]
            return lambda scope: run(*[a(scope) for a in args])
    raise TemplateError(f"can't compile {node!r}")


def _block(nodes: list) -> Callable[[dict, Sink], None]:
    steps = [_step(n) for n in nodes]

    def run(scope: dict, sink: Sink) -> None:
        for step in steps:
            step(scope, sink)

    return steps[0] if len(steps) == 1 else run


def _step(node) -> Callable[[dict, Sink], None]:
    match node:
        case Text(Const(value)):
            return lambda scope, sink: sink.write(value)
        case Text(value):
            value = _value(value)
            return lambda scope, sink: sink.write(_shown(value(scope)))
        case Set(name, value):
            value = _value(value)
            return lambda scope, sink: scope.__setitem__(name, value(scope))
        case If(branches):
            compiled = [(_value(c), _block(b)) for c, b in branches]

            def branch(scope: dict, sink: Sink) -> None:
                for condition, block in compiled:
                    if condition(scope):
                        return block(scope, sink)

            return branch
        case Generation(body):
            block = _block(body)

            def generation(scope: dict, sink: Sink) -> None:
                start = sink.chars
                block(scope, sink)
                if sink.chars > start:
                    sink.spans.append((start, sink.chars))

            return generation
        case For():
            flow = _loop(node)

            def loop(scope: dict, sink: Sink) -> None:
                for _ in flow(scope, sink):
                    pass

            return loop
    raise TemplateError(f"can't compile {node!r}")


def _loop(node: For) -> Callable[[dict, Sink], Iterator[None]]:
    """A loop that pauses after each item. It reads one item ahead, to know the last."""
    over, block, name = _value(node.over), _block(node.body), node.name

    def flow(scope: dict, sink: Sink) -> Iterator[None]:
        inner, i, rest = dict(scope), 0, iter(over(scope) or ())
        item = next(rest, rest)
        while item is not rest:
            follower = next(rest, rest)
            inner |= {name: item, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": follower is rest}}
            block(inner, sink)
            yield
            item, i = follower, i + 1

    return flow


@cache
def compile_template(template: str) -> Callable[[Iterable[dict], Sink], Iterator[None]]:
    """A closure that renders messages, each a mapping of role and text, into a sink, and pauses after each item of the template's outer loops."""
    steps = [(_loop(n), True) if isinstance(n, For) else (_step(n), False) for n in fold(parse(template))]

    def run(messages: Iterable[dict], sink: Sink) -> Iterator[None]:
        scope = {"messages": messages}
        for step, pauses in steps:
            if pauses:
                yield from step(scope, sink)
            else:
                step(scope, sink)

    return run


def render(template: str, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and its spans under generation markers."""
    sink = Sink()
    for _ in compile_template(template)(messages, sink):
        pass
    return sink.take()


# --- tables --------------------------------------------------------------------------------------------------------------------

#: A conversation's output goes on in a new row after the turn that passes so many characters.
ROW = 1 << 18
FORMATTED = "conv_id long, part long, text string, spans array<struct<start long, end long>>"


def _format(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_template(template)
        rows = ((c, {"role": r or "", "text": t or ""}) for b in batches for c, r, t in zip(*(x.to_pylist() for x in b.columns)))
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        ahead, out, size = next(rows, None), [], 0

        def turns(conv: int | None) -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                now, ahead = ahead[1], next(rows, None)
                yield now

        def batch() -> pa.RecordBatch:
            conv, part, text, under = zip(*out)
            marked = pa.array([[{"start": a, "end": b} for a, b in x] for x in under], spans)
            return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(part, pa.int64()), pa.array(text, pa.string()), marked], names=["conv_id", "part", "text", "spans"])

        while ahead is not None:
            conv, part, sink = ahead[0], 0, Sink()
            for _ in compiled(turns(conv), sink):
                if sink.chars - sink.flushed >= ROW:
                    out.append((conv, part, *sink.take()))
                    part += 1
                    yield batch()
                    out, size = [], 0
            if sink.chars > sink.flushed or not part:
                size += sink.chars - sink.flushed
                out.append((conv, part, *sink.take()))
            if size >= ROW:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return run


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, part, text, spans: each conversation, rendered, and its spans under generation markers as offsets, in code points, into the whole conversation.

    A conversation is one row; a long one goes on in further rows, numbered by part, each of whole turns and of about ROW characters, so that no task holds
    a conversation whole. A conversation's rows are in one partition, in order.

    The template must read its messages in one outer loop, and nowhere else; others are refused with TemplateError.

    Turns are taken by turn, nulls first; ties by role and text. Nulls: a null text or role is an empty one; null is a conversation of its own. Repeated rows are
    turns of their own. An empty table gives an empty result. Other columns are ignored.
    """
    check_stream(template)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format(template), FORMATTED)


_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.DOTALL)
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From formatted rows, in order: each conversation's turns and the text under its mask, both unescaped, summed up one row after the other."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    state: list | None = None

    def closed() -> tuple:
        conv, n, turns, loss_chars, loss, chars = state
        return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    def batch(out: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=names)

    for b in batches:
        out = []
        for conv, part, text, spans in zip(*(c.to_pylist() for c in b.columns)):
            if part == 0:
                if state:
                    out.append(closed())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            end = 0
            for m in _TURN.finditer(text):
                if m.start() != end:
                    raise ValueError(f"conversation {conv} can't be read back at {end}")
                end = m.end()
                state[1] += 1
                state[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            if end != len(text):
                raise ValueError(f"conversation {conv} can't be read back at {end}")
            for s in spans:
                under = unescape(text[s["start"] - state[5] : s["end"] - state[5]])
                state[3] += len(under)
                state[4].update(under.encode())
            state[5] += len(text)
        yield batch(out)
    if state:
        yield batch([closed()])


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from what format_conversations gives with TEMPLATE."""
    return formatted.mapInArrow(_read_back, DIGEST)


PROBE = "</s>[INST] ok [/INST]"


def op2(spark, sf_dir: str) -> DataFrame:
    """The digests of every conversation and of the probe, read back from what format_conversations gives: null texts and roles are empty, repeated rows are turns of their own, and without conversations the probe is left."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(probe)))


_ESCAPED = "length({0}) + (length({0}) - length(replace({0}, '\', '')))" + "".join(f" + (length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in CONTROLS)
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
       CAST(coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len('<|im_start|><|im_sep|><|im_end|>') + 1} + {_ESCAPED.format('r')} + {_ESCAPED.format('x')}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
