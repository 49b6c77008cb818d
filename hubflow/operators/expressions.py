"""Expressions of transforms: a small typed language over the payload, lowered to SQL functions that can't fail a job.

``payload`` and ``inputs`` both name the packet's payload; ``payload.a``, ``payload['a b']`` and ``payload.a[0]`` read it.
Literals are texts in single or double quotes, numbers, true, false, null and lists. From weakest to strongest: ``c ? a : b``;
``||`` and ``or``; ``&&`` and ``and``; ``== = != <> < <= > >= in``; ``+ -``; ``* / %``; ``! not -``; ``::type``. ``||`` of truth
values is "or" and joins any others as text. ``+`` joins two texts or adds two numbers; nothing is converted by itself: use
``string(x) double(x) int(x) bool(x)`` or ``x::type``. Numbers of the payload are doubles. Functions, also as methods:
``size length has upper lower trim abs floor ceil concat coalesce substring replace contains startsWith endsWith``.

What is no expression of this language is taken as Spark SQL, in which ``payload.a`` is text and ``payload.a::type`` that type.

A value that can't be computed (a missing key, a text where a number is due, a zero divisor, a number out of range) is SQL
null; a null of the payload is a variant null, which is a value.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The types of values: variant, text, whole number, double, truth value.
ANY, TEXT, INT, DOUBLE, BOOL = "any", "string", "long", "double", "boolean"
TYPES = {"string": TEXT, "text": TEXT, "int": INT, "integer": INT, "long": INT, "bigint": INT, "double": DOUBLE, "float": DOUBLE, "bool": BOOL, "boolean": BOOL}
TOKEN = re.compile(r"""\s*(?:(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(::|\|\||&&|==|!=|<>|<=|>=|[-+*/%<>=!?:.,()\[\]]))""")
LEVELS = (("||", "or"), ("&&", "and"), ("==", "=", "!=", "<>", "<", "<=", ">", ">=", "in"), ("+", "-"), ("*", "/", "%"))
#: Nodes whose value can be data beside the plan.
LEAVES = ("path", "string", "int", "float", "key", "static")
TEMPLATE = re.compile(r"""\{\{((?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|(?!\}\}).)*)\}\}""", re.S)
REFERENCE = re.compile(r"""('(?:[^'\\]|\\.)*')|\b(?:payload|inputs)((?:\.[A-Za-z_]\w*)+)(?:::([a-z]+))?""")
FORBIDDEN = re.compile(r"\b(select|rand|randn|uuid|shuffle|random|now|current_\w+|monotonically_increasing_id|java_method|reflect|raise_error|assert_true)\b", re.I)
PATTERNS = re.compile(r"\b(rlike|regexp\w*|split|like|ilike)\b", re.I)


class Bad(ValueError):
    """A definition or an expression that can't be compiled."""


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise Bad(f"unexpected {text[at:].strip()[:20]!r}")
            kind = ("number", "string", "name", "op")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        """The next token, if it is an operator or a name."""
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return text if kind in ("op", "name") else ""

    def take(self, text: str | None = None) -> tuple[str, str]:
        if self.at == len(self.tokens) or (text and self.peek() != text):
            raise Bad(f"expected {text or 'a value'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> tuple:
        out = self.choice()
        if self.at < len(self.tokens):
            raise Bad(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self) -> tuple:
        c = self.level(0)
        if self.peek() != "?":
            return c
        self.take("?")
        a = self.choice()
        self.take(":")
        return ("choice", c, a, self.choice())

    def level(self, k: int) -> tuple:
        if k == len(LEVELS):
            return self.unary()
        out = self.level(k + 1)
        while self.peek() in LEVELS[k]:
            op = self.take()[1]
            out = ("binary", {"or": "||", "and": "&&", "=": "==", "<>": "!="}.get(op, op), out, self.level(k + 1))
        return out

    def unary(self) -> tuple:
        if self.peek() in ("!", "not", "-"):
            op = self.take()[1]
            return ("unary", "-" if op == "-" else "!", self.unary())
        return self.postfix(self.value())

    def arguments(self, end: str) -> list[tuple]:
        out: list[tuple] = []
        while self.peek() != end:
            if out:
                self.take(",")
            out.append(self.choice())
        self.take(end)
        return out

    def value(self) -> tuple:
        kind, text = self.take()
        if kind == "number":
            return ("float" if re.search("[.eE]", text) else "int", text)
        if kind == "string":
            return ("string", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        if text == "(":
            out = self.choice()
            self.take(")")
            return out
        if text == "[":
            return ("list", *self.arguments("]"))
        if kind != "name":
            raise Bad(f"unexpected {text!r}")
        if text in ("payload", "inputs"):
            return ("path", "$")
        if text.lower() in ("true", "false"):
            return ("bool", text.lower() == "true")
        if text == "null":
            return ("null",)
        if self.peek() != "(":
            raise Bad(f"unknown name {text}")
        self.take("(")
        return ("call", text.lower(), *self.arguments(")"))

    def postfix(self, node: tuple) -> tuple:
        while self.peek() in (".", "[", "::"):
            op = self.take()[1]
            kind, text = self.take()
            if op == "::":
                if kind != "name" or text.lower() not in TYPES:
                    raise Bad(f"unknown type {text}")
                node = ("cast", TYPES[text.lower()], "int" if text.lower() in ("int", "integer") else TYPES[text.lower()], node)
            elif op == "." and kind == "name" and self.peek() == "(":
                self.take("(")
                node = ("call", text.lower(), node, *self.arguments(")"))
            elif node[0] != "path":
                raise Bad("only paths of the payload have members")
            elif op == "." and kind == "name":
                node = ("path", f"{node[1]}.{text}")
            elif op == "[" and kind in ("number", "string") and (kind == "number" and text.isdigit() or kind == "string" and not re.search(r"['\\]", text[1:-1])):
                self.take("]")
                node = ("path", f"{node[1]}[{text if kind == 'number' else repr(text[1:-1])}]")
            else:
                raise Bad("members are names, texts in quotes or places")
        return node


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _number_of(v: Column) -> Column:
    return F.when(_is(v, "BIGINT") | _is(v, "DECIMAL") | _is(v, "DOUBLE"), F.try_variant_get(v, "$", "double"))


def _text_of(v: Column) -> Column:
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def as_number(t: str, c: Column) -> tuple[str, Column]:
    if t in (INT, DOUBLE):
        return t, c
    if t == ANY:
        return DOUBLE, _number_of(c)
    raise Bad(f"a {t} is no number")


def as_text(t: str, c: Column) -> Column:
    """Any value but null as text, objects and lists as JSON."""
    return c if t == TEXT else F.try_variant_get(c, "$", "string") if t == ANY else c.cast("string")


def as_bool(t: str, c: Column) -> Column:
    if t == BOOL:
        return c
    if t == ANY:
        return F.when(_is(c, "BOOLEAN"), F.try_variant_get(c, "$", "boolean"))
    raise Bad(f"a {t} is no truth value")


def as_variant(t: str, c: Column) -> Column:
    return c if t == ANY else c.cast(T.VariantType())


class _Lowering:
    """``leaf(value)`` is the column of a leaf's text."""

    def __init__(self, payload: str, leaf: Callable[[str | int], Column]) -> None:
        self.name, self.payload, self.leaf = payload, F.col(payload), leaf

    def lower(self, node: tuple) -> tuple[str, Column]:
        return getattr(self, f"_{node[0]}")(*node[1:])

    def _path(self, p):
        return ANY, F.try_variant_get(self.payload, self.leaf(p), "variant")

    def _string(self, s):
        return TEXT, self.leaf(s)

    def _int(self, s):
        return INT, self.leaf(s).try_cast("long")

    def _float(self, s):
        return DOUBLE, self.leaf(s).try_cast("double")

    def _bool(self, b):
        return BOOL, F.lit(b)

    def _null(self):
        return ANY, F.parse_json(F.lit("null"))

    def _list(self, *items):
        values = F.array(*[as_variant(*self.lower(x)) for x in items]) if items else F.array().cast("array<variant>")
        return ANY, F.when(~F.exists(values, lambda v: v.isNull()), F.to_variant_object(values))

    def _sql(self, text, kind):
        text = REFERENCE.sub(lambda m: m[1] or f"try_variant_get(`{self.name}`, '${m[2]}', '{m[3] or 'string'}')", text)
        c = F.expr(text)
        if kind in (TEXT, DOUBLE, BOOL):
            return kind, c
        if kind == "bigint":
            return INT, c
        return ANY, c if kind == "variant" else F.to_variant_object(c) if re.match("struct|map|array", kind) else c.cast(T.VariantType())

    def _unary(self, op, x):
        t, c = self.lower(x)
        if op == "!":
            return BOOL, ~as_bool(t, c)
        t, c = as_number(t, c)
        return t, F.try_subtract(F.lit(0).cast(t), c)

    def _choice(self, c, a, b):
        c = as_bool(*self.lower(c))
        (ta, a), (tb, b) = self.lower(a), self.lower(b)
        if {ta, tb} == {INT, DOUBLE}:
            ta, a, tb, b = DOUBLE, a.cast("double"), DOUBLE, b.cast("double")
        if ta != tb:
            ta, a, b = ANY, as_variant(ta, a), as_variant(tb, b)
        return ta, F.when(c, a).when(~c, b)

    def _cast(self, t, sql_type, x):
        got, c = self.lower(x)
        return t, (F.try_variant_get(c, "$", sql_type) if got == ANY else c.try_cast(sql_type)).cast(t)

    def _binary(self, op, a, b):
        if op == "in" and b[0] == "list":
            each = [self._binary("==", a, x)[1] for x in b[1:]]
            return BOOL, functools.reduce(lambda x, y: x | y, each, F.lit(False))
        (ta, a), (tb, b) = self.lower(a), self.lower(b)
        if op == "in":
            if tb != ANY:
                raise Bad("in needs a list")
            return BOOL, F.exists(F.try_variant_get(b, "$", "array<variant>"), lambda v: self._equal(ta, a, ANY, v))
        if op == "&&":
            return BOOL, as_bool(ta, a) & as_bool(tb, b)
        if op == "||":
            if BOOL in (ta, tb) and {ta, tb} <= {BOOL, ANY}:
                return BOOL, as_bool(ta, a) | as_bool(tb, b)
            joined = F.concat(as_text(ta, a), as_text(tb, b))
            if ta == tb == ANY:
                return ANY, F.when(_is(a, "BOOLEAN") & _is(b, "BOOLEAN"), (as_bool(ANY, a) | as_bool(ANY, b)).cast(T.VariantType())).otherwise(joined.cast(T.VariantType()))
            return TEXT, joined
        if op in ("==", "!="):
            same = self._equal(ta, a, tb, b)
            return BOOL, same if op == "==" else ~same
        if op in ("<", "<=", ">", ">="):
            return BOOL, self._ordered(op, ta, a, tb, b)
        if op == "+" and TEXT in (ta, tb):
            if not {ta, tb} <= {TEXT, ANY}:
                raise Bad("+ joins texts or adds numbers")
            return TEXT, F.concat(*[c if t == TEXT else _text_of(c) for t, c in ((ta, a), (tb, b))])
        if op == "+" and ta == tb == ANY:
            added = F.try_add(_number_of(a), _number_of(b)).cast(T.VariantType())
            return ANY, F.coalesce(F.concat(_text_of(a), _text_of(b)).cast(T.VariantType()), added)
        (ta, a), (tb, b) = as_number(ta, a), as_number(tb, b)
        t = INT if ta == tb == INT and op != "/" else DOUBLE
        f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide, "%": F.try_mod}[op]
        return t, f(a.cast(t), b.cast(t))

    def _equal(self, ta, a, tb, b):
        if ANY not in (ta, tb):
            if ta != tb and not {ta, tb} <= {INT, DOUBLE}:
                raise Bad(f"a {ta} is never equal to a {tb}")
            return a == b
        if ta == tb:
            return F.coalesce(_number_of(a) == _number_of(b), F.to_json(a) == F.to_json(b))
        (t, c), v = ((tb, b), a) if ta == ANY else ((ta, a), b)
        mine = _text_of(v) if t == TEXT else as_bool(ANY, v) if t == BOOL else _number_of(v)
        return F.when(v.isNotNull() & c.isNotNull(), F.coalesce(mine == c, F.lit(False)))

    def _ordered(self, op, ta, a, tb, b):
        do = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
        if ta == tb == ANY:
            return F.coalesce(do(_number_of(a), _number_of(b)), do(_text_of(a), _text_of(b)))
        if TEXT in (ta, tb):
            if not {ta, tb} <= {TEXT, ANY}:
                raise Bad("texts and numbers have no order")
            return do(*[c if t == TEXT else _text_of(c) for t, c in ((ta, a), (tb, b))])
        return do(as_number(ta, a)[1], as_number(tb, b)[1])

    def _call(self, name, *nodes):
        if name in TYPES and len(nodes) == 1:
            return self._cast(TYPES[name], "int" if name in ("int", "integer") else TYPES[name], nodes[0])
        args = [self.lower(x) for x in nodes]
        texts = lambda n: [as_text(t, c) for t, c in args] if len(args) == n else self._wrong(name, n)
        if name in ("size", "length") and len(args) == 1:
            t, c = args[0]
            if t != ANY:
                return INT, F.length(as_text(t, c)).cast("long")
            size = F.when(_is(c, "STRING"), F.length(F.try_variant_get(c, "$", "string"))).when(_is(c, "ARRAY"), F.size(F.try_variant_get(c, "$", "array<variant>"))).when(_is(c, "OBJECT"), F.size(F.try_variant_get(c, "$", "map<string,variant>")))
            return INT, size.cast("long")
        if name == "has" and len(args) == 1:
            return BOOL, args[0][1].isNotNull()
        if name in ("upper", "lower", "trim"):
            return TEXT, getattr(F, name)(*texts(1))
        if name in ("contains", "startswith", "endswith"):
            return BOOL, getattr(F, name)(*texts(2))
        if name == "replace":
            return TEXT, F.replace(*texts(3))
        if name == "concat" and args:
            return TEXT, F.concat(*texts(len(args)))
        if name == "coalesce" and args:
            return ANY, F.coalesce(*[as_variant(t, c) for t, c in args])
        if name in ("abs", "floor", "ceil") and len(args) == 1:
            t, c = as_number(*args[0])
            if name == "abs":
                return t, F.when(c >= 0, c).otherwise(F.try_subtract(F.lit(0).cast(t), c))
            return INT, c if t == INT else F.when(F.abs(c) < 9e18, getattr(F, name)(c))
        if name == "substring" and len(args) == 3:
            at, n = (as_number(*a)[1].try_cast("int") for a in args[1:])
            return TEXT, F.substring(as_text(*args[0]), at, n)
        raise Bad(f"unknown function {name}")

    def _wrong(self, name: str, n: int):
        raise Bad(f"{name} takes {n} values")

    # what a definition is made of

    def value(self, node: tuple) -> Column:
        """A definition's part as a variant, null where it can't be computed."""
        if node[0] == "object":
            if len(node) == 1:
                return F.parse_json(F.lit("{}"))
            values = F.array(*[self.value(v) for _, v in node[1:]])
            made = F.to_variant_object(F.map_from_arrays(F.array(*[self.leaf(k[1]) for k, _ in node[1:]]), values))
            return F.when(~F.exists(values, lambda v: v.isNull()), made)
        if node[0] == "array":
            return self._values(node[1:])
        if node[0] == "static":
            return F.try_parse_json(self.leaf(node[1]))
        if node[0] == "text":
            return F.concat(*[self.leaf(p[1]) if p[0] == "string" else as_text(*self.lower(p)) for p in node[1:]]).cast(T.VariantType())
        return as_variant(*self.lower(node))

    def _values(self, nodes: tuple) -> Column:
        values = F.array(*[self.value(v) for v in nodes])
        return F.when(~F.exists(values, lambda v: v.isNull()), F.to_variant_object(values))


def lower(node: tuple, payload: str = "payload_variant") -> tuple[str, Column]:
    """Type and column of an expression."""
    return _Lowering(payload, F.lit).lower(node)


def made_json(node: tuple, slots: Column | None = None, payload: str = "payload_variant") -> Column:
    """The JSON that a definition makes; with ``slots``, an array column, leaves are places in it (see ``abstract``)."""
    leaf = F.lit if slots is None else lambda i: F.get(slots, F.lit(i))
    return F.to_json(_Lowering(payload, leaf).value(node))


def abstract(node: tuple, values: list[str]) -> tuple:
    """The node with its leaves' values moved to the list and replaced by their places in it."""
    if node[0] in LEAVES:
        values.append(node[1])
        return (node[0], len(values) - 1)
    return tuple(abstract(x, values) if isinstance(x, tuple) and x and isinstance(x[0], str) else tuple(abstract(y, values) for y in x) if isinstance(x, tuple) else x for x in node)


class Compiler:
    """Compiles expressions and definitions; what is the same but for names and literals is checked once."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.known = spark, {}
        self.empty = None

    def expression(self, text: str) -> tuple:
        """The node of an expression; raises ``Bad``."""
        try:
            node = _Parser(text).whole()
            shape = abstract(node, [])
            if shape not in self.known:
                try:
                    _Lowering("payload_variant", lambda i: F.lit("1")).lower(shape)
                    self.known[shape] = None
                except Bad as e:
                    self.known[shape] = e
            if self.known[shape] is None:
                return node
            wrong = self.known[shape]
        except Bad as e:
            wrong = e
        except RecursionError:
            raise Bad("too deep") from None
        return self.sql(text, wrong)

    def sql(self, text: str, wrong: Bad) -> tuple:
        bare = re.sub(r"'(?:[^'\\]|\\.)*'", "''", text)
        if FORBIDDEN.search(bare):
            raise Bad(f"not allowed in an expression: {text.strip()}")
        if PATTERNS.search(bare):
            for s in re.findall(r"'((?:[^'\\]|\\.)*)'", text):
                try:
                    self.spark._jvm.java.util.regex.Pattern.compile(s)
                except Exception:
                    raise Bad(f"no pattern: {s}") from None
        if self.empty is None:
            self.empty = self.spark.range(0).select(F.parse_json(F.lit("{}")).alias("payload_variant"))
        try:
            with lenient(self.spark):
                kind = self.empty.select(lower(("sql", text.strip(), "variant"))[1].alias("x")).schema["x"].dataType.simpleString()
                self.empty.select(as_variant(*lower(("sql", text.strip(), kind))).alias("x"))
        except PySparkException:
            raise Bad(f"cannot compile {text.strip()!r}: {wrong}") from None
        return ("sql", text.strip(), kind)

    def definition(self, with_json: str | None) -> tuple:
        """The node of a definition; raises ``Bad`` with the text of the definition's own error."""
        if with_json is None:
            raise Bad("transform step is missing 'with' block")
        try:
            fields = json.loads(with_json)
        except ValueError:
            fields = None
        if not isinstance(fields, dict):
            raise Bad("transform step's 'with' is not a JSON object")
        return self.part(fields, True)

    def part(self, value: object, outermost: bool = False) -> tuple:
        if not outermost and not TEMPLATE.search(json.dumps(value, ensure_ascii=False) if not isinstance(value, str) else value):
            return ("static", json.dumps(value))
        if isinstance(value, dict):
            return ("object", *[(("key", k), self.part(v)) for k, v in sorted(value.items())])
        if isinstance(value, list):
            return ("array", *map(self.part, value))
        only = TEMPLATE.fullmatch(value)
        if only:
            return self.expression(only[1])
        pieces = TEMPLATE.split(value)
        return ("text", *[("string", p) if i % 2 == 0 else self.expression(p) for i, p in enumerate(pieces) if p or i % 2])


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """Plans made meanwhile give null where they would fail; what they are keeps to them, whatever the session's mode."""
    name = "spark.sql.ansi.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def has_sql(node: tuple) -> bool:
    return node[0] == "sql" or any(has_sql(x) for x in node if isinstance(x, tuple) and x and isinstance(x[0], str | tuple))
