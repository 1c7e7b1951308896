"""A compiler for a sandboxed chat template language.

Templates are parsed into a syntax tree, constant parts are folded, and what is left
becomes Python closures. There are ``{{ value }}``, ``{% for x in list %}``,
``{% if %} / {% elif %} / {% else %}``, ``{% set name = value %}`` and
``{% generation %}``, which marks what the model is to learn; ``{# #}`` is a comment, and
a hyphen inside a tag's end takes the white space beside it. Values are literals,
names, fields (``m.role``, ``m['role']``, ``m[0]``, ``m[1:]``), comparisons, ``in``, ``is
defined`` and other tests, ``and``, ``or``, ``not``, ``+ - * // % ~``, ``a if b else c``
and filters. There are no calls but ``raise_exception``, and no attributes of Python
objects: fields are looked up in dicts and lists only, so a template reaches nothing but
what it is given. A loop over an iterator takes one item at a time, one ahead for
``loop.last``, and rendering yields pieces as they come, so conversations of any
length are rendered in bounded memory.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Iterator


class TemplateError(ValueError):
    """The template can't be parsed, or names what it was not given."""


#: What may be escaped inside texts and how, a backslash first of all.
ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g"}
_ESCAPE = str.maketrans(ESCAPES)
_BACK = re.compile(r"\\([\\lg])")
_PLAIN = {v[1]: k for k, v in ESCAPES.items()}


def escape(text: str) -> str:
    """Leaves no character that a turn mark needs; ``unescape`` undoes it."""
    return text.translate(_ESCAPE)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: _PLAIN[m[1]], text)


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": len,
    "list": list,
    "string": lambda x: _text(x),
    "tojson": lambda x: json.dumps(x, ensure_ascii=False),
}
TESTS: dict[str, Callable] = {
    "none": lambda x: x is None,
    "string": lambda x: isinstance(x, str),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "mapping": lambda x: isinstance(x, dict),
    "sequence": lambda x: isinstance(x, (str, list, tuple)),
    "iterable": lambda x: isinstance(x, (str, list, tuple, dict)),
    "true": lambda x: x is True,
    "false": lambda x: x is False,
    "odd": lambda x: x % 2 == 1,
    "even": lambda x: x % 2 == 0,
}
_INSIDE = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"])*?"""
_TAG = re.compile(rf"\{{#.*?#\}}|\{{\{{{_INSIDE}\}}\}}|\{{%{_INSIDE}%\}}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[<>+|.\[\]()=*%~:-]))")
_STRING_ESCAPES = {"n": "\n", "t": "\t"}


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


class _Expression:
    """Recursive descent over one tag's tokens; gives nodes ("kind", ...)."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in texts

    def take(self, *texts: str) -> tuple:
        if self.at >= len(self.tokens) or texts and not self.peek(*texts):
            raise TemplateError(f"expected {' or '.join(texts) or 'a value'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def name(self) -> str:
        kind, text = self.take()
        if kind != "name":
            raise TemplateError(f"{text!r} is not a name")
        return text

    def whole(self) -> tuple:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> tuple:
        node = self.either()
        if self.peek("if"):
            self.take()
            test = self.either()
            self.take("else")
            node = ("choice", test, node, self.choice())
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.peek("or"):
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.peek("and"):
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        node = self.joined()
        if self.peek("==", "!=", "<", ">", "<=", ">=", "in"):
            return ("compare", self.take()[1], node, self.joined())
        if self.peek("not"):
            self.take()
            self.take("in")
            return ("not", ("compare", "in", node, self.joined()))
        if self.peek("is"):
            self.take()
            denied = self.peek("not") and bool(self.take())
            name = self.name()
            if name not in TESTS and name not in ("defined", "undefined"):
                raise TemplateError(f"no test {name}")
            node = ("defined", node) if name in ("defined", "undefined") else ("test", name, node)
            return ("not", node) if denied != (name == "undefined") else node
        return node

    def joined(self) -> tuple:
        node = self.product()
        while self.peek("+", "-", "~"):
            node = ("sum", self.take()[1], node, self.product())
        return node

    def product(self) -> tuple:
        node = self.signed()
        while self.peek("*", "//", "%"):
            node = ("sum", self.take()[1], node, self.signed())
        return node

    def signed(self) -> tuple:
        if self.peek("-"):
            self.take()
            return ("sum", "-", ("const", 0), self.signed())
        return self.filtered()

    def filtered(self) -> tuple:
        node = self.field()
        while self.peek("|"):
            self.take()
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            node = ("filter", name, node)
        return node

    def field(self) -> tuple:
        node = self.atom()
        while self.peek(".", "["):
            if self.take()[1] == ".":
                node = ("field", node, ("const", self.name()))
            else:
                first = ("const", None) if self.peek(":") else self.choice()
                if self.peek(":"):
                    self.take()
                    node = ("slice", node, first, ("const", None) if self.peek("]") else self.choice())
                else:
                    node = ("field", node, first)
                self.take("]")
        return node

    def atom(self) -> tuple:
        kind, text = self.take()
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _STRING_ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if kind == "int":
            return ("const", int(text))
        if kind == "name" and text == "raise_exception":
            self.take("(")
            node = ("raise", self.choice())
            self.take(")")
            return node
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else ("name", text)
        if text == "(":
            node = self.choice()
            self.take(")")
            return node
        raise TemplateError(f"unexpected {text!r}")


def _cut(source: str, trim: bool) -> list[str]:
    """Texts and tags in turn, comments left out and white space taken where tags say so.

    With ``trim`` statements and comments also take the line feed after them and the
    blanks before them on their line.
    """
    parts, at, take = [""], 0, False

    def plain(text: str) -> str:
        if take:
            text = text.lstrip()
        if "{{" in text or "{%" in text or "{#" in text:
            raise TemplateError("a tag has no end")
        return text

    for m in _TAG.finditer(source):
        text, tag = plain(source[at : m.start()]), m[0]
        block = tag[1] != "{"
        if tag[2] == "-":
            text, tag = text.rstrip(), tag[:2] + tag[3:]
        elif trim and block:
            text = re.sub(r"(^|\n)[ \t]*$", r"\1", text) if parts[-1] == "" or "\n" in text else text
        at, take = m.end(), tag[-3] == "-" and len(tag) > 4
        if take:
            tag = tag[:-3] + tag[-2:]
        elif trim and block and source.startswith("\n", at):
            at += 1
        parts[-1] += text
        if tag[1] != "#":
            parts += [tag, ""]
    parts[-1] += plain(source[at:])
    return parts


def parse(source: str, trim: bool = False) -> list[tuple]:
    """The syntax tree of a template: a list of statements."""
    parts, at = _cut(source, trim), 0

    def block(*until: str) -> tuple[list[tuple], str]:
        nonlocal at
        out: list[tuple] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if at % 2:
                if part:
                    out.append(("text", part))
                continue
            body = part[2:-2].strip()
            if part.startswith("{{"):
                out.append(("print", _Expression(body).whole()))
                continue
            word, _, rest = body.partition(" ")
            if word in until:
                return out, body
            if word == "for":
                head = _Expression(rest)
                name = head.name()
                head.take("in")
                out.append(("for", name, head.whole(), block("endfor")[0]))
            elif word == "if":
                cases, test = [], rest
                while True:
                    inner, end = block("elif", "else", "endif")
                    cases.append((_Expression(test).whole(), inner))
                    if not end.startswith("elif"):
                        break
                    test = end.partition(" ")[2]
                out.append(("if", cases, block("endif")[0] if end == "else" else []))
            elif word == "set":
                head = _Expression(rest)
                name = head.name()
                head.take("=")
                out.append(("set", name, head.whole()))
            elif word == "generation":
                out.append(("generation", block("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected {body!r}")
        if until:
            raise TemplateError(f"missing {until[-1]}")
        return out, ""

    return block()[0]


_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b}


def _added(a: object, b: object) -> object:
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


_SUM = {"+": _added, "~": lambda a, b: _text(a) + _text(b), "-": operator.sub, "*": operator.mul, "//": operator.floordiv, "%": operator.mod}


def _number(f: Callable) -> Callable:
    """Arithmetic on whole numbers only, so that no text is repeated or formatted."""

    def run(a: object, b: object) -> object:
        if not isinstance(a, int) or not isinstance(b, int):
            raise TemplateError("whole numbers only")
        return f(a, b)

    return run


def _guarded(f: Callable) -> Callable:
    def run(*values: object) -> object:
        try:
            return f(*values)
        except (TypeError, ZeroDivisionError) as error:
            raise TemplateError(str(error)) from error

    return run


def _value(node: tuple) -> Callable[[dict], object]:
    """A closure that computes an expression."""
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":

        def lookup(env: dict, name: str = node[1]) -> object:
            if name not in env:
                raise TemplateError(f"no {name} was given")
            return env[name]

        return lookup
    if kind == "field":

        def field(env: dict, whole=_value(node[1]), key=_value(node[2])) -> object:
            holder, at = whole(env), key(env)
            if isinstance(holder, dict):
                return holder.get(at)
            if isinstance(holder, (list, tuple)) and isinstance(at, int):
                return holder[at] if -len(holder) <= at < len(holder) else None
            raise TemplateError("only dicts and lists have fields")

        return field
    if kind == "slice":

        def cut(env: dict, whole=_value(node[1]), first=_value(node[2]), last=_value(node[3])) -> object:
            holder, a, b = whole(env), first(env), last(env)
            if not isinstance(holder, (str, list, tuple)) or not all(x is None or isinstance(x, int) for x in (a, b)):
                raise TemplateError("only lists and texts have slices")
            return holder[a:b]

        return cut
    if kind == "defined":

        def defined(env: dict, inner: tuple = node[1], value=_value(node[1])) -> bool:
            return inner[1] in env if inner[0] == "name" else value(env) is not None

        return defined
    if kind == "raise":

        def stop(env: dict, said=_value(node[1])) -> object:
            raise TemplateError(_text(said(env)))

        return stop
    if kind in ("filter", "test"):
        return lambda env, f=_guarded((FILTERS if kind == "filter" else TESTS)[node[1]]), x=_value(node[2]): f(x(env))
    if kind in ("compare", "sum"):
        f = _COMPARE[node[1]] if kind == "compare" else _SUM[node[1]] if node[1] in "+~" else _number(_SUM[node[1]])
        return lambda env, f=_guarded(f), a=_value(node[2]), b=_value(node[3]): f(a(env), b(env))
    parts = [_value(x) for x in node[1:]]
    if kind == "not":
        return lambda env, x=parts[0]: not x(env)
    if kind == "and":
        return lambda env, a=parts[0], b=parts[1]: a(env) and b(env)
    if kind == "or":
        return lambda env, a=parts[0], b=parts[1]: a(env) or b(env)
    if kind == "choice":
        return lambda env, t=parts[0], a=parts[1], b=parts[2]: a(env) if t(env) else b(env)
    raise TemplateError(kind)


def _fold_value(node: tuple) -> tuple:
    """Expressions of constants become constants."""
    if node[0] in ("const", "name"):
        return node
    folded = tuple(_fold_value(x) if isinstance(x, tuple) else x for x in node)
    inner = [x for x in folded[1:] if isinstance(x, tuple)]
    if node[0] not in ("field", "slice", "raise", "defined") and inner and all(x[0] == "const" for x in inner):
        return ("const", _value(folded)({}))
    if folded[0] == "choice" and folded[1][0] == "const":
        return folded[2] if folded[1][1] else folded[3]
    return folded


def fold(tree: list[tuple]) -> list[tuple]:
    """The tree with constants computed, dead branches cut and texts joined."""
    out: list[tuple] = []
    for node in tree:
        kind = node[0]
        if kind == "print":
            value = _fold_value(node[1])
            node = ("text", _text(value[1])) if value[0] == "const" else ("print", value)
        elif kind == "set":
            node = ("set", node[1], _fold_value(node[2]))
        elif kind == "for":
            node = ("for", node[1], _fold_value(node[2]), fold(node[3]))
        elif kind == "generation":
            node = ("generation", fold(node[1]))
        elif kind == "if":
            cases, otherwise = [], fold(node[2])
            for test, body in node[1]:
                test = _fold_value(test)
                if test[0] != "const":
                    cases.append((test, fold(body)))
                elif test[1]:
                    otherwise = fold(body)
                    break
            nodes = [("if", cases, otherwise)] if cases else otherwise
            for x in nodes:
                _push(out, x)
            continue
        _push(out, node)
    return out


def _push(out: list[tuple], node: tuple) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


_Render = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _body(tree: list[tuple]) -> _Render:
    """A closure that yields (text, learned) pieces."""
    steps = [_statement(node) for node in tree]

    def run(env: dict, learned: bool) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(env, learned)

    return run


def _statement(node: tuple) -> _Render:
    kind = node[0]
    if kind == "text":

        def text(env: dict, learned: bool, t: str = node[1]) -> Iterator[tuple[str, bool]]:
            yield t, learned

        return text
    if kind == "print":

        def show(env: dict, learned: bool, value=_value(node[1])) -> Iterator[tuple[str, bool]]:
            yield _text(value(env)), learned

        return show
    if kind == "set":

        def put(env: dict, learned: bool, name: str = node[1], value=_value(node[2])) -> Iterator[tuple[str, bool]]:
            env[name] = value(env)
            yield from ()

        return put
    if kind == "generation":
        return lambda env, learned, body=_body(node[1]): body(env, True)
    if kind == "if":
        cases, otherwise = [(_value(t), _body(b)) for t, b in node[1]], _body(node[2])
        return lambda env, learned: next((b for t, b in cases if t(env)), otherwise)(env, learned)

    def loop(env: dict, learned: bool, name: str = node[1], items=_value(node[2]), body=_body(node[3])) -> Iterator[tuple[str, bool]]:
        rest = iter(items(env) or ())
        item, end = next(rest, loop), loop
        inner, i = dict(env), 0
        while item is not end:
            after = next(rest, end)
            inner[name] = item
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": after is end}
            yield from body(inner, learned)
            item, i = after, i + 1

    return loop


def compile_template(source: str, trim: bool = False) -> Callable[..., Iterator[tuple[str, bool]]]:
    """A function of the template's names that yields (text, learned) pieces.

    ``trim`` is for templates written for readers: statements stand on lines of their own
    that leave nothing behind.
    """
    body = _body(fold(parse(source, trim)))
    return lambda **names: body(dict(names), False)
