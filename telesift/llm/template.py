"""A small sandboxed template language, compiled to Python closures.

Text with `{{ expression }}`, `{% if %} {% elif %} {% else %} {% endif %}`, `{% for x in list %} {% endfor %}`,
`{% set x = expression %}`, `{% generation %} {% endgeneration %}` and `{# remark #}`; a minus sign inside a tag strips the
white space on its side. Templates see their parameters, the conversation's `messages` and nothing else: a name that is
not defined is an error when compiling, fields exist on mappings and lists only, there are no calls but the filters
below, and loops run over lists, so every template ends. What a loop body sets is gone after its turn; so each message
can be rendered on its own.

Source -> tokens -> syntax tree -> folded tree (parameters become constants, constant tests choose their branch, texts
grow together) -> closures that write into an Output, which also records the spans of the generation blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

TAG = re.compile(r"""(\{\{-?(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^"'])*?\}\}|\{%-?(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^"'])*?%\}|\{\#.*?\#\})""", re.DOTALL)
LEXEME = re.compile(r"""\s*(?:(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+~%<>()\[\].,|=]))""", re.DOTALL)
LITERALS = {"true": True, "false": False, "none": None}
KEYWORDS = {"and", "or", "not", "in", "if", "else", *LITERALS}
UNESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """The template is not well formed, or breaks out of what the language allows."""


# ---- syntax tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """An operator or filter with its operands."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    items: object
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---- operators; and, or and the conditional expression are closures of their own


def _text(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (dict, list, tuple)):
        raise TemplateError("only texts and numbers can be written")
    return "" if v is None else str(v)


def _get(thing, key):
    if isinstance(thing, dict):
        return thing.get(key)
    if isinstance(thing, (list, tuple)) and isinstance(key, int):
        return thing[key] if -len(thing) <= key < len(thing) else None
    raise TemplateError(f"no field {key!r}")


def _number(v) -> int:
    if type(v) is not int:
        raise TemplateError("a number is needed")
    return v


def _in(a, b) -> bool:
    if isinstance(b, (list, tuple, dict)) or (isinstance(a, str) and isinstance(b, str)):
        return a in b
    raise TemplateError("in looks into texts, lists and mappings")


OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: _number(a) < _number(b),
    ">": lambda a, b: _number(a) > _number(b),
    "<=": lambda a, b: _number(a) <= _number(b),
    ">=": lambda a, b: _number(a) >= _number(b),
    "in": lambda a, b: _in(a, b),
    "not in": lambda a, b: not _in(a, b),
    "+": lambda a, b: a + b if isinstance(a, str) and isinstance(b, str) else _number(a) + _number(b),
    "-": lambda a, b: _number(a) - _number(b),
    "%": lambda a, b: _number(a) % _number(b),
    "~": lambda a, b: _text(a) + _text(b),
    "not": lambda a: not a,
    "negative": lambda a: -_number(a),
    "get": _get,
    "list": lambda *a: a,
    "|trim": lambda a: _text(a).strip(),
    "|upper": lambda a: _text(a).upper(),
    "|lower": lambda a: _text(a).lower(),
    "|length": len,
    "|default": lambda a, b: b if a is None else a,
}


# ---- parser


class _Expression:
    """Recursive descent over the lexemes of one tag."""

    def __init__(self, source: str):
        self.items, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = LEXEME.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def next_is(self, *values: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] != "text" and self.items[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if not self.next_is(*values):
            return None
        self.at += 1
        return self.items[self.at - 1][1]

    def need(self, *values: str) -> str:
        return self.take(*values) or self.fail(f"{' or '.join(values)} is missing")

    def fail(self, why: str):
        raise TemplateError(f"{why}: {' '.join(v for _, v in self.items)}")

    def name(self) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] != "name" or self.items[self.at][1] in KEYWORDS:
            self.fail("a name is missing")
        self.at += 1
        return self.items[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.items):
            self.fail("more than one expression")

    def whole(self):
        value = self.choice()
        self.end()
        return value

    def choice(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Apply("if", (test, value, self.choice()))
        return value

    def _chain(self, below, *ops):
        value = below()
        while op := self.take(*ops):
            value = Apply(op, (value, below()))
        return value

    def either(self):
        return self._chain(self.both, "or")

    def both(self):
        return self._chain(self.negation, "and")

    def negation(self):
        return Apply("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self):
        value = self.sum()
        while True:
            if op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
                value = Apply(op, (value, self.sum()))
            elif self.take("not"):
                self.need("in")
                value = Apply("not in", (value, self.sum()))
            else:
                return value

    def sum(self):
        return self._chain(self.rest, "+", "-", "~")

    def rest(self):
        return self._chain(self.sign, "%")

    def sign(self):
        return Apply("negative", (self.sign(),)) if self.take("-") else self.fields()

    def fields(self):
        value = self.atom()
        while op := self.take(".", "[", "|"):
            if op == ".":
                value = Apply("get", (value, Const(self.name())))
            elif op == "[":
                value = Apply("get", (value, self.choice()))
                self.need("]")
            else:
                value = Apply("|" + self.name(), (value, *(self.listed(")") if self.take("(") else ())))
        return value

    def listed(self, close: str) -> tuple:
        out = []
        while not self.take(close):
            out.append(self.choice())
            if not self.next_is(close):
                self.need(",")
        return tuple(out)

    def atom(self):
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        if self.take("["):
            return Apply("list", self.listed("]"))
        if self.at >= len(self.items):
            self.fail("an expression is missing")
        kind, value = self.items[self.at]
        if kind == "text":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: UNESCAPED.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "number":
            self.at += 1
            return Const(int(value))
        if value in LITERALS:
            self.at += 1
            return Const(LITERALS[value])
        return Name(self.name())


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = TAG.split(source)
    for i in range(1, len(parts), 2):
        if parts[i][2:3] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3:-2] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    for text in parts[::2]:
        if "{{" in text or "{%" in text or "{#" in text:
            raise TemplateError("a tag is not closed")
    items = [("text", p) if i % 2 == 0 else (p[:2], p[2:-2].strip("-").strip()) for i, p in enumerate(parts)]
    at = 0

    def block(*ends: str) -> tuple[tuple, str, str]:
        nonlocal at
        out = []
        while at < len(items):
            kind, body = items[at]
            at += 1
            if kind == "text":
                if body:
                    out.append(Emit(Const(body)))
            elif kind == "{{":
                out.append(Emit(_Expression(body).whole()))
            elif kind == "{%":
                word, _, rest = body.partition(" ")
                if word in ends:
                    return tuple(out), word, rest
                out.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), "", ""

    def branches(test):
        then, word, rest = block("elif", "else", "endif")
        if word == "elif":
            return If(test, then, (branches(_Expression(rest).whole()),))
        return If(test, then, block("endif")[0] if word == "else" else ())

    def statement(word: str, rest: str):
        e = _Expression(rest)
        if word == "if":
            return branches(e.whole())
        if word == "for":
            name = e.name()
            e.need("in")
            return For(name, e.whole(), block("endfor")[0])
        if word == "set":
            name = e.name()
            e.need("=")
            return Set(name, e.whole())
        if word == "generation":
            e.end()
            return Generation(block("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")

    return block()[0]


# ---- constant folding


def fold(node, known: dict, filters: dict[str, Callable]):
    """An expression with its constant parts computed."""
    if isinstance(node, Name):
        return Const(known[node.name]) if node.name in known else node
    if not isinstance(node, Apply):
        return node
    args = tuple(fold(a, known, filters) for a in node.args)
    node = replace(node, args=args)
    if node.op not in ("if", "and", "or") and node.op not in filters:
        raise TemplateError(f"unknown filter {node.op[1:]}")
    if node.op in ("if", "and", "or") and isinstance(args[0], Const):
        if node.op == "if":
            return args[1] if args[0].value else args[2]
        return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
    if node.op not in ("if", "and", "or") and all(isinstance(a, Const) for a in args):
        return Const(filters[node.op](*[a.value for a in args]))
    return node


def fold_block(nodes: tuple, known: dict, filters: dict[str, Callable]) -> tuple:
    """Statements with folded expressions, constant branches chosen and neighbouring texts joined."""
    known, out = dict(known), []

    def add(node):
        if isinstance(node, Emit) and isinstance(node.value, Const):
            text = _text(node.value.value)
            if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                text = out.pop().value.value + text
            if text:
                out.append(Emit(Const(text)))
        else:
            out.append(node)

    for node in nodes:
        if isinstance(node, Emit):
            add(Emit(fold(node.value, known, filters)))
        elif isinstance(node, Set):
            value = fold(node.value, known, filters)
            known.pop(node.name, None)
            add(Set(node.name, value))
        elif isinstance(node, If):
            test = fold(node.test, known, filters)
            if isinstance(test, Const):
                chosen = node.then if test.value else node.other
                for inner in fold_block(chosen, known, filters):
                    add(inner)
                for name in assigned(chosen):
                    known.pop(name, None)
            else:
                add(If(test, fold_block(node.then, known, filters), fold_block(node.other, known, filters)))
                for name in assigned((node,)):
                    known.pop(name, None)
        elif isinstance(node, For):
            inner = {k: v for k, v in known.items() if k not in (node.name, "loop", *assigned(node.body))}
            add(For(node.name, fold(node.items, known, filters), fold_block(node.body, inner, filters)))
        elif isinstance(node, Generation):
            add(Generation(fold_block(node.body, known, filters)))
            for name in assigned(node.body):
                known.pop(name, None)
    return tuple(out)


def assigned(nodes: tuple) -> set[str]:
    """Names that a block sets for what follows it (a loop sets none)."""
    out: set[str] = set()
    for node in nodes:
        if isinstance(node, Set):
            out.add(node.name)
        elif isinstance(node, If):
            out |= assigned(node.then) | assigned(node.other)
        elif isinstance(node, Generation):
            out |= assigned(node.body)
    return out


# ---- closures


@dataclass
class Output:
    """Text written so far and the spans (code points) that lie in generation blocks."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    depth: int = 0

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


class Template:
    """A compiled template with one loop over `messages` at its top level.

    `opening`, `body` and `closing` are closures of (names, output): what stands before the loop, one turn, what
    follows. A conversation's text is opening + bodies in order + closing, so turns can be rendered on different machines.
    """

    def __init__(self, source: str, parameters: dict | None = None, filters: dict[str, Callable] | None = None):
        self.source, self.parameters = source, dict(parameters or {})
        self.filters = OPERATORS | {f"|{k}": v for k, v in (filters or {}).items()}
        self.tree = fold_block(parse(source), self.parameters, self.filters)
        loops = [i for i, node in enumerate(self.tree) if isinstance(node, For) and node.items == Name("messages")]
        if len(loops) != 1:
            raise TemplateError("a template has one loop over messages at its top level")
        loop = self.tree[loops[0]]
        outside = {"messages", *self.parameters}  # of messages only the length, see _value; parameters that a block sets are names
        before, after = self.tree[: loops[0]], self.tree[loops[0] + 1 :]
        self.message = loop.name
        self.opening = self._block(before, set(outside))
        self.body = self._block(loop.body, outside | assigned(before) | {loop.name, "loop"})
        self.closing = self._block(after, outside | assigned(before))

    # the pickled form is the source: closures are compiled anew where they run
    def __reduce__(self):
        own = {k[1:]: v for k, v in self.filters.items() if k not in OPERATORS}
        return Template, (self.source, self.parameters, own)

    def _value(self, node, names: set[str]) -> Callable:
        if isinstance(node, Const):
            value = node.value
            return lambda env: value
        if isinstance(node, Name):
            name = node.name
            if name not in names:
                raise TemplateError(f"{name} is not defined")
            if name == "messages":
                raise TemplateError("of messages only the length and the loop over them exist")
            return lambda env: env[name]
        if node.op == "|length" and node.args == (Name("messages"),):
            return lambda env: env["messages"]
        args = [self._value(a, names) for a in node.args]
        if node.op == "if":
            test, then, other = args
            return lambda env: then(env) if test(env) else other(env)
        if node.op == "and":
            return lambda env: args[0](env) and args[1](env)
        if node.op == "or":
            return lambda env: args[0](env) or args[1](env)
        fn = self.filters[node.op]
        if len(args) == 1:
            (one,) = args
            return lambda env: fn(one(env))
        if len(args) == 2:
            one, two = args
            return lambda env: fn(one(env), two(env))
        return lambda env: fn(*[a(env) for a in args])

    def _block(self, nodes: tuple, names: set[str]) -> Callable:
        steps = [self._statement(node, names) for node in nodes]

        def run(env: dict, out: Output) -> None:
            for step in steps:
                step(env, out)

        return run

    def _statement(self, node, names: set[str]) -> Callable:
        if isinstance(node, Emit):
            if isinstance(node.value, Const):
                text = node.value.value
                return lambda env, out: out.write(text)
            value = self._value(node.value, names)
            return lambda env, out: out.write(_text(value(env)))
        if isinstance(node, Set):
            value, name = self._value(node.value, names), node.name
            names.add(name)

            def assign(env, out):
                env[name] = value(env)

            return assign
        if isinstance(node, If):
            test = self._value(node.test, names)
            then, other = self._block(node.then, one := set(names)), self._block(node.other, two := set(names))
            names |= one & two

            return lambda env, out: then(env, out) if test(env) else other(env, out)
        if isinstance(node, Generation):
            body = self._block(node.body, names)

            def generation(env, out):
                start, out.depth = out.length, out.depth + 1
                body(env, out)
                out.depth -= 1
                if out.depth == 0 and out.length > start:
                    out.spans.append((start, out.length))

            return generation
        items, name, body = self._value(node.items, names), node.name, self._block(node.body, names | {node.name, "loop"})

        def loop(env, out):
            values = items(env)
            if not isinstance(values, (list, tuple)):
                raise TemplateError("loops run over lists")
            for i, v in enumerate(values):
                body({**env, name: v, "loop": position(i, len(values))}, out)

        return loop

    def turn(self, message: dict, index: int, count: int) -> Output:
        """One message of a conversation of `count`, with the opening before the first and the closing after the last."""
        out, env = Output(), {**self.parameters, "messages": count}
        start = Output() if index else out
        self.opening(env, start)
        self.body({**env, self.message: message, "loop": position(index, count)}, out)
        if index == count - 1:
            self.closing(env, out)
        return out

    def conversation(self, messages: list[dict]) -> Output:
        """A whole conversation at once; without messages, opening and closing alone."""
        out, env = Output(), {**self.parameters, "messages": len(messages)}
        self.opening(env, out)
        for i, m in enumerate(messages):
            self.body({**env, self.message: m, "loop": position(i, len(messages))}, out)
        self.closing(env, out)
        return out


def position(index: int, count: int) -> dict:
    return {"index0": index, "index": index + 1, "first": index == 0, "last": index == count - 1, "length": count}
