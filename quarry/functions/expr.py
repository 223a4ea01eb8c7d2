"""Expressions: a small immutable tree that becomes a Spark Column, and that tables read to find what an index can answer."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python types that columns may be declared with, as Spark names them.
DECLARED = {int: "bigint", float: "double", str: "string", bool: "boolean"}
COMPARISONS = {"<", "<=", ">", ">=", "=="}


def kind_of(t: T.DataType) -> str | None:
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.NumericType):
        return "float"
    return {T.StringType: "str", T.BooleanType: "bool"}.get(type(t))


class Expr:
    """op applied to args; ``col`` and ``lit`` are the leaves. kind: int, float, str, bool or None (any other type)."""

    __slots__ = ("op", "args", "kind")
    __hash__ = None

    def __init__(self, op: str, args: tuple, kind: str | None):
        self.op, self.args, self.kind = op, args, kind

    def __repr__(self) -> str:
        return str(self.args[0]) if self.op in ("col", "lit") else f"({self.op} {' '.join(map(repr, self.args))})"

    def _with(self, op: str, other: Any, kind: str | None) -> Expr:
        return Expr(op, (self, literal(other)), kind)

    def _numbers(self, op: str, other: Any) -> Expr:
        other = literal(other)
        for e in (self, other):
            if e.kind not in ("int", "float", None):
                raise TypeError(f"{op} needs numbers, not {e.kind}")
        return Expr(op, (self, other), "int" if self.kind == other.kind == "int" else "float")

    def _strings(self, op: str, other: Any) -> Expr:
        if self.kind not in ("str", None):
            raise TypeError(f"{op} needs a string column, not {self.kind}")
        return self._with(op, other, "bool")

    def __and__(self, o): return self._with("&", o, self.kind)  # noqa: E704
    def __or__(self, o): return self._with("|", o, self.kind)  # noqa: E704
    def __sub__(self, o): return self._numbers("-", o)  # noqa: E704
    def __mul__(self, o): return self._numbers("*", o)  # noqa: E704
    def __floordiv__(self, o): return self._numbers("//", o)  # noqa: E704
    def __gt__(self, o): return self._with(">", o, "bool")  # noqa: E704
    def __ge__(self, o): return self._with(">=", o, "bool")  # noqa: E704
    def __lt__(self, o): return self._with("<", o, "bool")  # noqa: E704
    def __le__(self, o): return self._with("<=", o, "bool")  # noqa: E704
    def __eq__(self, o): return self._with("==", o, "bool")  # noqa: E704
    def __ne__(self, o): return self._with("!=", o, "bool")  # noqa: E704

    def __add__(self, o):
        o = literal(o)
        return Expr("||", (self, o), "str") if "str" in (self.kind, o.kind) else self._numbers("+", o)

    def between(self, pair) -> Expr:
        """Inclusive at both ends."""
        low, high = pair
        return Expr("between", (self, literal(low), literal(high)), "bool")

    def isin(self, values) -> Expr:
        return Expr("isin", (self, *map(literal, values)), "bool")

    def isNull(self) -> Expr:
        return Expr("isNull", (self,), "bool")

    def map(self, func: Callable, returns: type | str | T.DataType = "string") -> Expr:
        """func on each value, in Arrow batches. A Python function is a last resort: built-in expressions stay in the JVM."""
        return Expr("map", (self, func, DECLARED.get(returns, returns)), {"bigint": "int", "double": "float", "string": "str", "boolean": "bool"}.get(DECLARED.get(returns, returns)))

    def substr(self, start: int, length: int) -> Expr:
        return Expr("substr", (self, start, length), "str")

    def startswith(self, s) -> Expr: return self._strings("startswith", s)  # noqa: E704
    def endswith(self, s) -> Expr: return self._strings("endswith", s)  # noqa: E704
    def contains(self, s) -> Expr: return self._strings("contains", s)  # noqa: E704
    def asc(self) -> Expr: return Expr("asc", (self,), None)  # noqa: E704
    def desc(self) -> Expr: return Expr("desc", (self,), None)  # noqa: E704

    def __bool__(self):
        raise TypeError("an expression has no truth value; combine with & and |")

    def columns(self) -> set[str]:
        if self.op == "col":
            return {self.args[0]}
        return set().union(*(a.columns() for a in self.args if isinstance(a, Expr)), set())

    def conjuncts(self) -> list[Expr]:
        return [c for a in self.args for c in a.conjuncts()] if self.op == "&" and self.kind != "int" else [self]

    def to_column(self) -> Column:
        return to_column(self)


def literal(x: Any) -> Expr:
    if isinstance(x, Expr):
        return x
    kind = {bool: "bool", int: "int", float: "float", str: "str"}.get(type(x))
    return Expr("lit", (x,), kind)


def column(name: str, t: T.DataType) -> Expr:
    return Expr("col", (name,), kind_of(t))


def _wide(e: Expr) -> Column:
    """Whole numbers widened, so that 32-bit sums don't overflow."""
    c = to_column(e)
    return c.cast("bigint") if e.kind == "int" else c


def _floor_divide(a: Expr, b: Expr) -> Column:
    """Python's floor; null for a zero divisor. Whole numbers are divided as such, since doubles lose bits past 2^53."""
    x, y = _wide(a), _wide(b)
    if a.kind == b.kind == "int":
        y = F.nullif(y, F.lit(0))
        rest = x % y
        return F.call_function("div", x - rest, y) - F.when((rest != 0) & ((x < 0) != (y < 0)), 1).otherwise(0)
    # by the remainder, as the quotient alone may be rounded up to a whole number; what isn't finite stays so
    x, y = x.cast("double"), F.nullif(y.cast("double"), F.lit(0.0))
    rest = x % y
    return F.rint((x - rest) / y - F.when((rest != 0) & ((y < 0) != (rest < 0)), 1.0).otherwise(0.0))


def _among(a: Expr, values: tuple[Expr, ...]) -> Column:
    """Literals as one set, other expressions one by one."""
    known, others = [v.args[0] for v in values if v.op == "lit"], [v for v in values if v.op != "lit"]
    tests = ([to_column(a).isin(*known)] if known or not others else []) + [to_column(a) == to_column(v) for v in others]
    return reduce(lambda x, y: x | y, tests)


_BUILD: dict[str, Callable[..., Column]] = {
    "col": lambda n: F.col(f"`{n}`"),
    "lit": F.lit,
    "+": lambda a, b: _wide(a) + _wide(b),
    "-": lambda a, b: _wide(a) - _wide(b),
    "*": lambda a, b: _wide(a) * _wide(b),
    "//": _floor_divide,
    "||": lambda a, b: F.concat(to_column(a).cast("string"), to_column(b).cast("string")),
    "&": lambda a, b: to_column(a).bitwiseAND(to_column(b)) if a.kind == "int" else to_column(a) & to_column(b),
    "|": lambda a, b: to_column(a).bitwiseOR(to_column(b)) if a.kind == "int" else to_column(a) | to_column(b),
    ">": lambda a, b: to_column(a) > to_column(b),
    ">=": lambda a, b: to_column(a) >= to_column(b),
    "<": lambda a, b: to_column(a) < to_column(b),
    "<=": lambda a, b: to_column(a) <= to_column(b),
    "==": lambda a, b: to_column(a) == to_column(b),
    "!=": lambda a, b: to_column(a) != to_column(b),
    "between": lambda a, low, high: to_column(a).between(to_column(low), to_column(high)),
    "isin": lambda a, *values: _among(a, values),
    "isNull": lambda a: to_column(a).isNull(),
    "startswith": lambda a, b: to_column(a).startswith(to_column(b)),
    "endswith": lambda a, b: to_column(a).endswith(to_column(b)),
    "contains": lambda a, b: to_column(a).contains(to_column(b)),
    "substr": lambda a, s, n: to_column(a).substr(s, n),
    "map": lambda a, func, returns: F.udf(func, returns, useArrow=True)(to_column(a)),
    "asc": lambda a: to_column(a).asc_nulls_last(),
    "desc": lambda a: to_column(a).desc_nulls_last(),
}


def to_column(e: Expr) -> Column:
    return _BUILD[e.op](*e.args)
