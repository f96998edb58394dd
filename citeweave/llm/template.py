"""A small sandboxed template language, compiled to Python closures.

    text                        written as it is
    {{ expression }}            writes the expression's value
    {% if e %}..{% elif e %}..{% else %}..{% endif %}
    {% for name in e %}..{% endfor %}
    {% set name = e %}
    {% generation %}..{% endgeneration %}   marks what is written inside
    {# note #}                  nothing

Expressions: strings, whole numbers, true, false, none, names, ``a.field``, ``a[e]``,
``not``, ``and``, ``or``, ``== != < <= > >= in``, ``+ - ~`` and filters ``e | name``.
A field or an index looks only into dicts and lists that were passed in; there are no
calls, no attributes of Python objects, no imports.  ``loop.index0``, ``loop.first`` and
``loop.last`` are known inside a loop.

``parse`` makes a syntax tree of tuples, ``fold`` replaces what is known beforehand
and ``compile_template`` turns the tree into nested closures once; rendering then
only calls closures.
"""

from __future__ import annotations

import re
from collections.abc import Callable

TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+\-~|.()\[\]=]))""")
WORDS = {"true": True, "false": False, "none": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """The template is not well formed, or it asks for what the sandbox does not have."""


# ---- expressions ---------------------------------------------------------------------

def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Reader:
    """Recursive descent over the tokens of one tag."""

    LEVELS = [("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~")]

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or wanted is not None and self.peek() != wanted:
            raise TemplateError(f"expected {wanted or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def expression(self, level: int = 0) -> tuple:
        if level == len(self.LEVELS):
            return self.postfix()
        if self.LEVELS[level] == ("not",):
            if self.peek() == "not":
                self.take()
                return ("not", self.expression(level))
            return self.expression(level + 1)
        left = self.expression(level + 1)
        while self.peek() in self.LEVELS[level]:
            op = self.take()[1]
            left = ("op", op, left, self.expression(level + 1))
        return left

    def postfix(self) -> tuple:
        node = self.atom()
        while self.peek() in (".", "[", "|"):
            op = self.take()[1]
            if op == ".":
                node = ("item", node, ("const", self.name()))
            elif op == "[":
                node = ("item", node, self.expression())
                self.take("]")
            else:
                node = ("filter", self.name(), node)
        return node

    def name(self) -> str:
        kind, text = self.take()
        if kind != "name":
            raise TemplateError(f"expected a name, not {text!r}")
        return text

    def atom(self) -> tuple:
        kind, text = self.take()
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "num":
            return ("const", int(text))
        if kind == "name":
            return ("const", WORDS[text]) if text in WORDS else ("name", text)
        if text == "(":
            node = self.expression()
            self.take(")")
            return node
        raise TemplateError(f"unexpected {text!r}")


# ---- statements ----------------------------------------------------------------------

def parse(source: str) -> tuple:
    """Syntax tree ``("seq", [...])`` of a template."""
    parts = [p for p in TAGS.split(source) if p]
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[tuple, str, _Reader | None]:
        nonlocal at
        out = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{#") and part.endswith("#}"):
                continue
            if part.startswith("{{") and part.endswith("}}"):
                r = _Reader(part[2:-2])
                out.append(("write", r.expression()))
                r.end()
            elif part.startswith("{%") and part.endswith("%}"):
                r = _Reader(part[2:-2])
                word = r.name()
                if word in ends:
                    return ("seq", out), word, r
                out.append(statement(word, r))
            else:
                out.append(("text", part))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return ("seq", out), "", None

    def statement(word: str, r: _Reader) -> tuple:
        if word == "if":
            branches, test, last = [], r.expression(), None
            r.end()
            while True:
                body, stop, r = block(("elif", "else", "endif"))
                branches.append((test, body))
                if stop == "elif":
                    test = r.expression()
                    r.end()
                elif stop == "else":
                    r.end()
                    last, _, r = block(("endif",))
                if stop != "elif":
                    r.end()
                    return ("if", branches, last or ("seq", []))
        if word == "for":
            name = r.name()
            r.take("in")
            over = r.expression()
            r.end()
            body, _, r = block(("endfor",))
            r.end()
            return ("for", name, over, body)
        if word == "set":
            name = r.name()
            r.take("=")
            value = r.expression()
            r.end()
            return ("set", name, value)
        if word == "generation":
            r.end()
            body, _, r = block(("endgeneration",))
            r.end()
            return ("mark", body)
        raise TemplateError(f"unknown statement {word!r}")

    return block(())[0]


# ---- constant folding ----------------------------------------------------------------

def _apply(op: str, a, b):
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    if op == "~":
        return f"{_show(a)}{_show(b)}"
    if op == "in":
        return a in b
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op] if type(a) is type(b) else False


def _show(value) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _item(box, key):
    if isinstance(box, dict):
        return box.get(key)
    if isinstance(box, list) and isinstance(key, int) and -len(box) <= key < len(box):
        return box[key]
    return None


def fold(node: tuple, filters: dict[str, Callable]) -> tuple:
    """The tree with constant expressions computed, dead branches left out and neighbouring text joined."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind == "not":
        a = fold(node[1], filters)
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "op":
        op, a, b = node[1], fold(node[2], filters), fold(node[3], filters)
        if op in ("and", "or") and a[0] == "const":
            return b if bool(a[1]) == (op == "and") else a
        if op not in ("and", "or") and a[0] == b[0] == "const":
            return ("const", _apply(op, a[1], b[1]))
        return ("op", op, a, b)
    if kind == "item":
        return ("item", fold(node[1], filters), fold(node[2], filters))
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        a = fold(node[2], filters)
        return ("const", filters[node[1]](a[1])) if a[0] == "const" else ("filter", node[1], a)
    if kind == "write":
        a = fold(node[1], filters)
        return ("text", _show(a[1])) if a[0] == "const" else ("write", a)
    if kind == "set":
        return ("set", node[1], fold(node[2], filters))
    if kind == "mark":
        return ("mark", fold(node[1], filters))
    if kind == "for":
        return ("for", node[1], fold(node[2], filters), fold(node[3], filters))
    if kind == "if":
        branches, last = [], fold(node[2], filters)
        for test, body in node[1]:
            test, body = fold(test, filters), fold(body, filters)
            if test[0] == "const" and not test[1]:
                continue
            if test[0] == "const":
                last = body
                break
            branches.append((test, body))
        return ("if", branches, last) if branches else last
    out: list[tuple] = []
    for child in node[1]:
        child = fold(child, filters)
        for part in child[1] if child[0] == "seq" else [child]:
            if part[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + part[1])
            elif part != ("text", ""):
                out.append(part)
    return ("seq", out)


# ---- code generation -----------------------------------------------------------------

class Output:
    """Written text and the spans of it, in code points, that generation blocks wrote."""

    def __init__(self):
        self.parts, self.size, self.spans, self.depth = [], 0, [], 0

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _expression(node: tuple, filters) -> Callable:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "not":
        a = _expression(node[1], filters)
        return lambda env: not a(env)
    if kind == "item":
        box, key = _expression(node[1], filters), _expression(node[2], filters)
        return lambda env: _item(box(env), key(env))
    if kind == "filter":
        fn, a = filters[node[1]], _expression(node[2], filters)
        return lambda env: fn(a(env))
    op, a, b = node[1], _expression(node[2], filters), _expression(node[3], filters)
    if op == "and":
        return lambda env: a(env) and b(env)
    if op == "or":
        return lambda env: a(env) or b(env)
    return lambda env: _apply(op, a(env), b(env))


def _statement(node: tuple, filters) -> Callable:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, out: out.write(text)
    if kind == "write":
        value = _expression(node[1], filters)
        return lambda env, out: out.write(_show(value(env)))
    if kind == "set":
        name, value = node[1], _expression(node[2], filters)
        return lambda env, out: env.__setitem__(name, value(env))
    if kind == "seq":
        steps = [_statement(n, filters) for n in node[1]]

        def run(env, out):
            for step in steps:
                step(env, out)
        return run
    if kind == "mark":
        body = _statement(node[1], filters)

        def mark(env, out):
            start, out.depth = out.size, out.depth + 1
            body(env, out)
            out.depth -= 1
            if not out.depth:
                out.spans.append((start, out.size))
        return mark
    if kind == "if":
        tests = [(_expression(t, filters), _statement(b, filters)) for t, b in node[1]]
        last = _statement(node[2], filters)

        def choose(env, out):
            for test, body in tests:
                if test(env):
                    return body(env, out)
            last(env, out)
        return choose
    name, over, body = node[1], _expression(node[2], filters), _statement(node[3], filters)

    def loop(env, out):
        items = over(env)
        items = items if isinstance(items, list) else []
        for i, item in enumerate(items):
            inner = dict(env)
            inner[name] = item
            inner["loop"] = {"index0": i, "first": i == 0, "last": i == len(items) - 1}
            body(inner, out)
    return loop


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to (text, spans written by generation blocks)."""
    filters = filters or {}
    program = _statement(fold(parse(source), filters), filters)

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        program(dict(variables), out)
        return "".join(out.parts), out.spans
    return render
