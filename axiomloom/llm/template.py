"""A small sandboxed template language compiled to Python closures.

Text with ``{{ expression }}``, ``{# remark #}`` and the blocks ``for x in xs``,
``if``/``elif``/``else``, ``set x = expression`` and ``generation``. Expressions
know literals, names, fields (``a.b``, ``a['b']``), ``not and or``, comparisons,
``in``, ``not in``, ``+``, ``~`` (joins as text) and filters after ``|``. A tag that
begins with ``{%-`` or ``{{-`` takes the blanks before it away, one that ends with
``-%}`` or ``-}}`` those after it. Nothing else of Python is reachable: names come
from the scope, fields only from mappings, and filters from a fixed table. Values
that do not fit an operator, a filter or a loop raise ``TemplateError`` with its
name, when the template is compiled if they are constants.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    """The template cannot be parsed, or reaches for something it may not."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """An operator or filter over its arguments."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Put:
    value: Any


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""Reversible: ``<|`` becomes ``<\|``, ``<\|`` becomes ``<\\|`` and so on,
    so an escaped text never holds ``<|``."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_line(text: str) -> str:
    r"""Like escape, for a text that a line end closes: ``\`` and line feeds too."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def _text(v: Any) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


OPERATORS: dict[str, Callable] = {
    "not": lambda a: not a, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b, "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b),
}
FILTERS: dict[str, Callable] = {
    "escape": lambda a: escape(_text(a)), "escape_line": lambda a: escape_line(_text(a)), "trim": lambda a: _text(a).strip(),
    "upper": lambda a: _text(a).upper(), "lower": lambda a: _text(a).lower(), "length": len,
}


def _call(op: str) -> Callable:
    """The operator or filter; arguments it does not take are an error of the template."""
    fn = FILTERS[op[1:]] if op.startswith("|") else OPERATORS[op]

    def call(*args):
        try:
            return fn(*args)
        except TypeError as e:
            raise TemplateError(f"{op.lstrip('|')!r} does not take {', '.join(type(a).__name__ for a in args)}") from e
    return call


_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.\[\]()]))")
_STRING = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def take(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text!r} expected")

    def whole(self):
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.take("or"):
            out = Apply("or", (out, self.both()))
        return out

    def both(self):
        out = self.negated()
        while self.take("and"):
            out = Apply("and", (out, self.negated()))
        return out

    def negated(self):
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        out = self.joined()
        while op := self.take("==", "!=", "<=", ">=", "<", ">", "in", "not"):
            if op == "not":
                self.need("in")
                op = "not in"
            out = Apply(op, (out, self.joined()))
        return out

    def joined(self):
        out = self.filtered()
        while op := self.take("+", "~"):
            out = Apply(op, (out, self.filtered()))
        return out

    def filtered(self):
        out = self.atom()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            out = Apply("|" + name, (out,))
        return out

    def atom(self):
        if self.take("("):
            out = self.either()
            self.need(")")
        else:
            if self.at >= len(self.tokens):
                raise TemplateError("expression ends early")
            kind, value = self.tokens[self.at]
            self.at += 1
            if kind == "str":
                out = Const(re.sub(r"\\(.)", lambda m: _STRING.get(m[1], m[1]), value[1:-1]))
            elif kind == "int":
                out = Const(int(value))
            elif kind == "name":
                fixed = {"true": True, "false": False, "none": None}
                out = Const(fixed[value]) if value in fixed else Name(_allowed(value))
            else:
                raise TemplateError(f"unexpected {value!r}")
        while op := self.take(".", "["):
            if op == ".":
                key = self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" else ""
                self.at += 1
                out = Field(out, Const(_allowed(key)))
            else:
                out = Field(out, self.either())
                self.need("]")
        return out


def _allowed(name: str) -> str:
    if not name or name.startswith("_"):
        raise TemplateError(f"{name!r} may not be used")
    return name


def _trimmed(parts: list[str]) -> list[str]:
    """Texts without the blanks that a neighbouring tag takes away, tags without that mark."""
    out, strip = [], False
    for i, part in enumerate(parts):
        tag = _TAG.fullmatch(part)
        if not tag:
            after = parts[i + 1][2:3] == "-" if i + 1 < len(parts) else False
            part = part.lstrip() if strip else part
            part = part.rstrip() if after else part
            strip = False
        else:
            inner = part[2:-2]
            lead, strip = inner.startswith("-"), len(inner) > 1 and inner.endswith("-")
            part = part[:2] + inner[lead:len(inner) - strip] + part[-2:]
        if part:
            out.append(part)
    return out


def parse(source: str) -> tuple:
    """The syntax tree: a tuple of nodes."""
    parts = _trimmed([p for p in _TAG.split(source) if p])
    at = 0

    def nodes(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        out = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{#"):
                continue
            if part.startswith("{{"):
                out.append(Put(_Expression(part[2:-2]).whole()))
                continue
            if not part.startswith("{%"):
                out.append(Put(Const(part)))
                continue
            words = part[2:-2].strip()
            head, _, rest = words.partition(" ")
            if head in ends:
                return tuple(out), words
            if head == "for":
                m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.DOTALL)
                if not m:
                    raise TemplateError(f"cannot read {words!r}")
                body, _ = nodes("endfor")
                out.append(For(m[1], _Expression(m[2]).whole(), body))
            elif head == "if":
                out.append(branch(rest))
            elif head == "set":
                name, eq, value = rest.partition("=")
                if not eq:
                    raise TemplateError(f"cannot read {words!r}")
                out.append(Assign(_allowed(name.strip()), _Expression(value).whole()))
            elif head == "generation":
                body, _ = nodes("endgeneration")
                out.append(Generation(body))
            else:
                raise TemplateError(f"unknown block {head!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    def branch(test: str) -> If:
        yes, end = nodes("elif", "else", "endif")
        if end.startswith("elif"):
            return If(_Expression(test).whole(), yes, (branch(end[4:]),))
        no = nodes("endif")[0] if end == "else" else ()
        return If(_Expression(test).whole(), yes, no)

    return nodes()[0]


def fold(node):
    """The same tree with constant parts computed and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for n in map(fold, node):
            for x in n if isinstance(n, tuple) else (n,):
                if isinstance(x, Put) and isinstance(x.value, Const):
                    text = _text(x.value.value)
                    if out and isinstance(out[-1], Put) and isinstance(out[-1].value, Const):
                        text = out.pop().value.value + text
                    if text:
                        out.append(Put(Const(text)))
                else:
                    out.append(x)
        return tuple(out)
    if isinstance(node, Put):
        return Put(fold(node.value))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value))
    if isinstance(node, Field):
        return Field(fold(node.of), fold(node.key))
    if isinstance(node, Apply):
        args = tuple(map(fold, node.args))
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op not in ("and", "or") and all(isinstance(a, Const) for a in args):
            return Const(_call(node.op)(*[a.value for a in args]))
        return Apply(node.op, args)
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.yes if test.value else node.no)
        return If(test, fold(node.yes), fold(node.no))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


class Output:
    """Rendered text with the ranges that generation blocks wrote."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.ranges: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def _value(node) -> Callable[[Mapping], Any]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        return lambda scope, n=node.name: scope.get(n)
    if isinstance(node, Field):
        of, key = _value(node.of), _value(node.key)

        def field(scope):
            owner, k = of(scope), key(scope)
            if isinstance(owner, Mapping):
                return owner.get(k)
            if isinstance(owner, (list, tuple, str)) and isinstance(k, int):
                return owner[k] if -len(owner) <= k < len(owner) else None
            return None
        return field
    args = [_value(a) for a in node.args]
    if node.op == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.op == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    fn = _call(node.op)
    if len(args) == 1:
        return lambda scope, a=args[0]: fn(a(scope))
    return lambda scope, a=args[0], b=args[1]: fn(a(scope), b(scope))


def compile_nodes(nodes: tuple) -> Callable[[dict, Output], None]:
    """One closure that runs the nodes in order."""
    steps = [_step(n) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, out: Output) -> None:
        for s in steps:
            s(scope, out)
    return run


def _step(node) -> Callable[[dict, Output], None]:
    if isinstance(node, Put):
        if isinstance(node.value, Const):
            return lambda scope, out, t=node.value.value: out.put(t)
        value = _value(node.value)
        return lambda scope, out: out.put(_text(value(scope)))
    if isinstance(node, Assign):
        value = _value(node.value)

        def assign(scope, out):
            scope[node.name] = value(scope)
        return assign
    if isinstance(node, If):
        test, yes, no = _value(node.test), compile_nodes(node.yes), compile_nodes(node.no)
        return lambda scope, out: yes(scope, out) if test(scope) else no(scope, out)
    if isinstance(node, Generation):
        body = compile_nodes(node.body)

        def generation(scope, out):
            start = out.size
            body(scope, out)
            out.ranges.append((start, out.size))
        return generation
    over, body = _value(node.over), compile_nodes(node.body)

    def loop(scope, out):
        items = over(scope)
        if items is not None and not isinstance(items, (list, tuple, Mapping)):
            raise TemplateError(f"cannot loop over {type(items).__name__}")
        items = list(items or ())
        for i, item in enumerate(items):
            body({**scope, node.name: item, "loop": {"index0": i, "first": i == 0, "last": i == len(items) - 1}}, out)
    return loop


def names_in(node) -> set[str]:
    if isinstance(node, Name):
        return {node.name}
    parts = node if isinstance(node, tuple) else tuple(vars(node).values()) if hasattr(node, "__dataclass_fields__") else ()
    return set().union(*map(names_in, parts)) if parts else set()


class Template:
    """A compiled template: ``render(messages)`` gives the text and its mask."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._run = compile_nodes(self.tree)

    def render(self, messages: list[dict], **scope) -> Output:
        out = Output()
        self._run({**scope, "messages": messages}, out)
        return out

    @property
    def turn_by_turn(self) -> bool:
        """Is a conversation's text the texts of its turns, one after another?"""
        if len(self.tree) != 1 or not isinstance(self.tree[0], For) or self.tree[0].over != Name("messages"):
            return False
        return names_in(self.tree[0].body) <= {self.tree[0].name}
