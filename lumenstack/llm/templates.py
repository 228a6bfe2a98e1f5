"""A small sandboxed template language, compiled to Python closures.

    text {{ expr }} {% if expr %}..{% elif expr %}..{% else %}..{% endif %}
    {% for name in expr %}..{% endfor %} {% set name = expr %} {% generation %}..{% endgeneration %}

Expressions have string and integer literals, true, false, none, names, .key and [key] on
dictionaries and lists, == != < > <= >= in, + ~, and, or, not, parentheses, and filters after |. There
are no calls and no attributes of Python objects, so a template reaches nothing but its data.

Source is parsed to a syntax tree, constants are folded (with neighbouring texts joined and
branches on constants chosen), and each node becomes a generator closure that yields (text, generated)
pieces. Loops take their input lazily, so rendering needs memory for one piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

LEX = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>|.\[\]()+~=]))")
PARTS = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
CONSTANTS = {"true": True, "false": False, "none": None}
COMPARE: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
    "+": lambda a, b: a + b, "~": lambda a, b: f"{a}{b}",
}
FILTERS: dict[str, Callable[[Any], Any]] = {"trim": lambda x: x.strip(), "upper": lambda x: x.upper(), "lower": lambda x: x.lower(), "length": len}


class TemplateError(ValueError):
    """The template's source is wrong."""


@dataclass
class Node:
    kind: str
    value: Any = None
    kids: list[Node] = field(default_factory=list)


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.tokens, self.at, self.filters = [], 0, filters
        i = 0
        while source[i:].strip():
            m = LEX.match(source, i)
            if not m:
                raise TemplateError(f"unexpected {source[i:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            i = m.end()

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") else None

    def take(self, *options: str) -> str | None:
        if self.peek() in options:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, option: str) -> None:
        if not self.take(option):
            raise TemplateError(f"{option!r} is missing")

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", None, [node, self.both()])
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", None, [node, self.negated()])
        return node

    def negated(self) -> Node:
        return Node("not", None, [self.negated()]) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.sum()
        if op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            node = Node("binary", op, [node, self.sum()])
        return node

    def sum(self) -> Node:
        node = self.filtered()
        while op := self.take("+", "~"):
            node = Node("binary", op, [node, self.filtered()])
        return node

    def filtered(self) -> Node:
        node = self.reached()
        while self.take("|"):
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            node = Node("filter", name, [node])
        return node

    def reached(self) -> Node:
        node = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                node = Node("key", None, [node, Node("const", self.name())])
            else:
                node = Node("key", None, [node, self.either()])
                self.need("]")
        return node

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> Node:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return Node("const", int(text))
        if kind == "str":
            return Node("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name":
            return Node("const", CONSTANTS[text]) if text in CONSTANTS else Node("name", text)
        raise TemplateError(f"unexpected {text!r}")


class _Parser:
    def __init__(self, source: str, filters: dict[str, Callable]):
        self.filters, self.parts, end = filters, [], 0
        for m in PARTS.finditer(source):
            if m.start() > end:
                self.parts.append(("text", source[end : m.start()]))
            self.parts.append(("print", m[1]) if m[1] is not None else ("tag", m[2].strip()))
            end = m.end()
        if end < len(source):
            self.parts.append(("text", source[end:]))
        self.at = 0

    def expression(self, source: str) -> Node:
        return _Expression(source, self.filters).whole()

    def body(self, *ends: str) -> tuple[Node, str]:
        """Nodes up to a tag that begins with one of ends, and that tag."""
        kids = []
        while self.at < len(self.parts):
            kind, text = self.parts[self.at]
            self.at += 1
            if kind == "text":
                kids.append(Node("text", text))
            elif kind == "print":
                kids.append(Node("print", None, [self.expression(text)]))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return Node("seq", None, kids), text
                kids.append(self.tag(word, rest))
        if ends:
            raise TemplateError(f"{ends[0]!r} is missing")
        return Node("seq", None, kids), ""

    def tag(self, word: str, rest: str) -> Node:
        if word == "if":
            test = self.expression(rest)
            then, ended = self.body("elif", "else", "endif")
            if ended.startswith("elif"):
                other = self.tag("if", ended[4:])
            elif ended == "else":
                other, _ = self.body("endif")
            else:
                other = Node("seq")
            return Node("if", None, [test, then, other])
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest!r}")
            kid, _ = self.body("endfor")
            return Node("for", m[1], [self.expression(m[2]), kid])
        if word == "set":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"set {rest!r}")
            return Node("set", m[1], [self.expression(m[2])])
        if word == "generation":
            return Node("generation", None, [self.body("endgeneration")[0]])
        raise TemplateError(f"no tag {word!r}")


def fold(node: Node, filters: dict[str, Callable]) -> Node:
    """The tree with constant parts computed."""
    kids = [fold(k, filters) for k in node.kids]
    node = Node(node.kind, node.value, kids)
    if node.kind in ("binary", "not", "and", "or", "filter") and all(k.kind == "const" for k in kids):
        return Node("const", value_of(node, filters)({}))
    if node.kind == "print" and kids[0].kind == "const":
        return Node("text", _shown(kids[0].value))
    if node.kind == "if" and kids[0].kind == "const":
        return kids[1] if kids[0].value else kids[2]
    if node.kind == "seq":
        flat: list[Node] = []
        for k in kids:
            for x in k.kids if k.kind == "seq" else [k]:
                if x.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", flat[-1].value + x.value)
                elif x.kind != "text" or x.value:
                    flat.append(x)
        return Node("seq", None, flat)
    return node


def _shown(x: Any) -> str:
    return "" if x is None else str(x)


def value_of(node: Node, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    """A closure that computes an expression from the variables."""
    kids = [value_of(k, filters) for k in node.kids]
    v = node.value
    match node.kind:
        case "const":
            return lambda env: v
        case "name":
            return lambda env: env.get(v)
        case "key":
            a, b = kids

            def reach(env):
                box, key = a(env), b(env)
                if type(box) is dict:
                    return box.get(key)
                if type(box) in (list, tuple) and type(key) is int and -len(box) <= key < len(box):
                    return box[key]
                return None

            return reach
        case "binary":
            a, b = kids
            f = COMPARE[v]
            return lambda env: f(a(env), b(env))
        case "not":
            (a,) = kids
            return lambda env: not a(env)
        case "and":
            a, b = kids
            return lambda env: a(env) and b(env)
        case "or":
            a, b = kids
            return lambda env: a(env) or b(env)
        case "filter":
            (a,) = kids
            f = filters[v]
            return lambda env: f(a(env))
    raise TemplateError(node.kind)


Emit = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def emitter(node: Node, filters: dict[str, Callable]) -> Emit:
    """A generator closure that renders a node."""
    v = node.value
    match node.kind:
        case "text":

            def text(env, marked):
                yield v, marked

            return text
        case "print":
            show = value_of(node.kids[0], filters)

            def printed(env, marked):
                yield _shown(show(env)), marked

            return printed
        case "set":
            get = value_of(node.kids[0], filters)

            def assign(env, marked):
                env[v] = get(env)
                yield from ()

            return assign
        case "seq":
            parts = [emitter(k, filters) for k in node.kids]

            def seq(env, marked):
                for part in parts:
                    yield from part(env, marked)

            return seq
        case "if":
            test, then, other = value_of(node.kids[0], filters), *(emitter(k, filters) for k in node.kids[1:])
            return lambda env, marked: (then if test(env) else other)(env, marked)
        case "for":
            items, body = value_of(node.kids[0], filters), emitter(node.kids[1], filters)

            def loop(env, marked):
                for x in items(env) or ():
                    yield from body({**env, v: x}, marked)

            return loop
        case "generation":
            body = emitter(node.kids[0], filters)
            return lambda env, marked: body(env, True)
    raise TemplateError(node.kind)


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A function from variables to pieces (text, generated)."""
    known = FILTERS | (filters or {})
    render = emitter(fold(_Parser(source, known).body()[0], known), known)
    return lambda env: render(dict(env), False)
