"""A small exact expression language: names, decimals, + - * / and brackets; evaluated in decimals or compiled to a Column."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Context, Decimal, DivisionByZero, InvalidOperation, Overflow

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS, MAX_NODES, MAX_DEPTH, MAX_NAMES, PRECISION = 1024, 256, 32, 64, 50
LEXEME = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>\*\*|//|[-+*/()])|(?P<bad>\S))")


class CalculatorError(ValueError):
    """An expression or a binding that can't be evaluated."""


@dataclass(frozen=True)
class Node:
    kind: str
    value: str = ""
    inner: tuple = ()


def lexemes(text: str) -> list[tuple[str, str, int]]:
    if len(text) > MAX_CHARS:
        raise CalculatorError(f"more than {MAX_CHARS} characters")
    out = []
    for m in LEXEME.finditer(text):
        kind = m.lastgroup
        if kind is None:
            continue
        if kind == "bad" or m[kind] in ("**", "//"):
            raise CalculatorError(f"unsupported {m[kind]!r} at {m.start(kind)}")
        out.append((kind, m[kind], m.start(kind)))
    return out


class _Parser:
    def __init__(self, text: str):
        self.items, self.at, self.nodes = lexemes(text), 0, 0

    def peek(self) -> str | None:
        return self.items[self.at][1] if self.at < len(self.items) else None

    def make(self, kind: str, value: str = "", *inner: Node) -> Node:
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise CalculatorError(f"more than {MAX_NODES} nodes")
        return Node(kind, value, inner)

    def chain(self, ops: str, below, depth: int) -> Node:
        left = below(depth)
        while self.peek() in tuple(ops):
            op = self.items[self.at][1]
            self.at += 1
            left = self.make("binary", op, left, below(depth))
        return left

    def sum(self, depth: int) -> Node:
        return self.chain("+-", self.product, depth)

    def product(self, depth: int) -> Node:
        return self.chain("*/", self.unary, depth)

    def unary(self, depth: int) -> Node:
        if depth > MAX_DEPTH:
            raise CalculatorError(f"deeper than {MAX_DEPTH}")
        if self.peek() in ("+", "-"):
            op = self.items[self.at][1]
            self.at += 1
            return self.make("unary", op, self.unary(depth + 1))
        if self.at >= len(self.items):
            raise CalculatorError("the expression ends early")
        kind, text, where = self.items[self.at]
        self.at += 1
        if text == "(":
            inner = self.sum(depth + 1)
            if self.peek() != ")":
                raise CalculatorError(f"unclosed bracket at {where}")
            self.at += 1
            return inner
        if kind == "op":
            raise CalculatorError(f"unexpected {text!r} at {where}")
        if kind == "name" and self.peek() == "(":
            raise CalculatorError(f"no calls: {text!r} at {where}")
        return self.make(kind, text)


def parse(text: str) -> Node:
    p = _Parser(text)
    node = p.sum(0)
    if p.at < len(p.items):
        raise CalculatorError(f"unexpected {p.items[p.at][1]!r} at {p.items[p.at][2]}")
    return node


def names(node: Node) -> set[str]:
    return {node.value} if node.kind == "name" else set().union(*[names(n) for n in node.inner])


def canonical(x: Decimal) -> str:
    """Plain digits without trailing zeros; zero has no sign."""
    s = format(x, "f")
    s = s.rstrip("0").rstrip(".") if "." in s else s
    return "0" if s in ("-0", "", "-") else s


def rendered(node: Node) -> str:
    """Fully bracketed."""
    if node.kind == "binary":
        return f"({rendered(node.inner[0])} {node.value} {rendered(node.inner[1])})"
    if node.kind == "unary":
        return f"({node.value}{rendered(node.inner[0])})"
    return node.value if node.kind == "name" else canonical(Decimal(node.value))


def evaluate(text: str, bindings: dict[str, str]) -> str:
    """Exact to 50 digits, half to even. Every name must be bound and every binding used; an expression of literals alone is an error."""
    node = parse(text)
    free = names(node)
    if not free or free != set(bindings) or len(free) > MAX_NAMES:
        raise CalculatorError(f"missing {sorted(free - set(bindings))}, unused {sorted(set(bindings) - free)}, names {len(free)}")
    return evaluated(node, bindings)


def evaluated(node: Node, bindings: dict[str, str]) -> str:
    """A parsed expression's value as plain digits."""
    ctx = Context(prec=PRECISION, rounding=ROUND_HALF_EVEN, traps=[DivisionByZero, InvalidOperation, Overflow])

    def go(n: Node) -> Decimal:
        if n.kind == "number":
            return Decimal(n.value)
        if n.kind == "name":
            return _decimal(n.value, bindings[n.value])
        a = go(n.inner[0])
        if n.kind == "unary":
            return ctx.minus(a) if n.value == "-" else ctx.plus(a)
        b = go(n.inner[1])
        return {"+": ctx.add, "-": ctx.subtract, "*": ctx.multiply, "/": ctx.divide}[n.value](a, b)

    try:
        return canonical(go(node))
    except (DivisionByZero, InvalidOperation, Overflow) as e:
        raise CalculatorError(type(e).__name__) from None


def _decimals(node: Node, columns: dict[str, Column], types: dict[str, tuple[int, int]]) -> tuple[Column, int, int] | None:
    """A node as a decimal Column with as many digits, in all and after the point, as its value can have; None where Spark's decimals can't hold that exactly."""
    if node.kind == "name":
        p, s = types[node.value]
        c = columns[node.value].cast(f"decimal({p},{s})")
    elif node.kind == "number":
        whole, _, part = node.value.partition(".")
        if not (whole + part).isdigit():
            return None
        p, s = len(whole + part), len(part)
        c = F.lit(node.value).cast(f"decimal({p},{s})") if p <= 38 else None
    else:
        inner = [_decimals(n, columns, types) for n in node.inner]
        if None in inner or node.value == "/":
            return None
        (a, p, s), *more = inner
        c = -a if node.value == "-" else a
        if more:
            b, q, t = more[0]
            c = {"+": a + b, "-": a - b, "*": a * b}[node.value]
            p, s = (p + q, s + t) if node.value == "*" else (max(p - s, q - t) + 1 + max(s, t), max(s, t))
    if p > 38 or s > 6:
        return None
    return c.cast(f"decimal({p},{s})"), p, s


def calculated(text: str, columns: dict[str, Column], types: dict[str, tuple[int, int]] | None = None) -> Column:
    """evaluate() over columns of decimals or of text, exactly: the result as plain digits, null where a row can't be evaluated. The expression is parsed once.
    types: digits, in all and after the point, of columns that are decimals; where sums and products of these keep to 38 digits, six of them after the point, rows never go to Python."""
    node, order = parse(text), sorted(columns)
    if names(node) != set(columns):
        raise CalculatorError(f"names {sorted(names(node))}, columns {order}")
    own = _decimals(node, columns, types) if types and set(types) == set(columns) else None
    if own is not None:
        digits = own[0].cast("string")
        return F.when(digits.contains("."), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits)

    @F.pandas_udf(T.StringType())
    def run(values: pd.DataFrame) -> pd.Series:
        def one(row):
            try:
                return evaluated(node, dict(zip(order, row)))
            except CalculatorError:
                return None

        return pd.Series([None if any(pd.isna(x) for x in row) else one(row) for row in values[order].itertuples(index=False)], dtype=object)

    return run(F.struct(*[columns[k].cast("string").alias(k) for k in order]))


def checked_metadata(value, depth: int = 0, above: tuple = ()):
    """A deep copy of what rides along with a call: objects, lists, texts, integers, booleans and null only; floats, other types and cycles are errors."""
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, (dict, list, tuple)):
        if id(value) in above or depth > MAX_DEPTH:
            raise CalculatorError("metadata refers to itself or is too deep")
        inner = (*above, id(value))
        if isinstance(value, dict):
            if not all(isinstance(k, str) for k in value):
                raise CalculatorError("metadata keys are texts")
            return {k: checked_metadata(v, depth + 1, inner) for k, v in value.items()}
        return [checked_metadata(v, depth + 1, inner) for v in value]
    raise CalculatorError(f"metadata can't hold {type(value).__name__}")


def calculate(expression: str, inputs: dict[str, dict], result_metadata=None) -> dict:
    """inputs: name -> {value (decimal text), unit, basis, period, provenance}. The result with the rendered expression and, for every input in order of name, what
    was given and its canonical value. Units are passed on, not checked; an unknown key or a value that isn't text is an error."""
    bound, said = {}, []
    for k in sorted(inputs):
        x = inputs[k]
        if not isinstance(x, dict) or not isinstance(x.get("value"), str) or (extra := sorted(set(x) - {"value", "unit", "basis", "period", "provenance"})):
            raise CalculatorError(f"input {k} needs a decimal text as value and none but known keys")
        bound[k] = x["value"]
        said.append({"name": k} | checked_metadata(x) | {"canonical_value": canonical(_decimal(k, x["value"]))})
    return {"result": evaluate(expression, bound), "expression": rendered(parse(expression)), "inputs": said, "result_metadata": checked_metadata(result_metadata), "precision": PRECISION}


def _decimal(name: str, text: str) -> Decimal:
    try:
        x = Decimal(text)
    except InvalidOperation:
        x = Decimal("NaN")
    if not x.is_finite():
        raise CalculatorError(f"{name} isn't a decimal")
    return x


def compiled(text: str, columns: dict[str, Column]) -> Column:
    """The expression over columns in doubles, inside Catalyst: fast, not exact (calculated() is); a division by zero is null."""

    def go(n: Node) -> Column:
        if n.kind == "number":
            return F.lit(float(n.value))
        if n.kind == "name":
            return columns[n.value].cast("double")
        a = go(n.inner[0])
        if n.kind == "unary":
            return -a if n.value == "-" else a
        b = go(n.inner[1])
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[n.value]()

    return go(parse(text))


def same_formula(a: str, b: str, rename: dict[str, str] | None = None) -> bool:
    """Equal trees after renaming b's names; a unary plus counts for nothing."""

    def plain(n: Node, m: dict[str, str]) -> Node:
        if n.kind == "unary" and n.value == "+":
            return plain(n.inner[0], m)
        value = m.get(n.value, n.value) if n.kind == "name" else canonical(Decimal(n.value)) if n.kind == "number" else n.value
        return Node(n.kind, value, tuple(plain(x, m) for x in n.inner))

    return plain(parse(a), {}) == plain(parse(b), rename or {})
