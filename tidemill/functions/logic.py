"""Expressions of the dialect as Spark columns.

The dialect's logic has two values: a comparison with NULL is false, and NOT of it true. Spark's has three. Wrapping every
comparison in ``coalesce`` would be right but keep filters away from the Parquet reader, so a condition is instead
compiled in one of two senses, *holds* or *fails*, with NOT pushed down to the comparisons; either way the column is TRUE exactly where
it should be and FALSE or NULL elsewhere, which a filter treats alike. Only where a boolean becomes a value is it closed to TRUE or FALSE.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import EngineError
from tidemill.plans.names import Scope
from tidemill.plans.syntax import Binary, Const, Negation, Ref

_OPPOSITE = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
_APPLY = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Value:
    column: Column
    kind: T.DataType
    nullable: bool

    @property
    def family(self) -> str:
        if isinstance(self.kind, T.NumericType):
            return "number"
        if isinstance(self.kind, (T.StringType, T.CharType, T.VarcharType)):
            return "text"
        if isinstance(self.kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "time"
        return "bool" if isinstance(self.kind, T.BooleanType) else self.kind.simpleString()


def value(node: Any, scope: Scope) -> Value:
    """An expression as a value: a column, a constant, or a condition closed to TRUE or FALSE."""
    if isinstance(node, Ref):
        found = scope.find(node)
        return Value(F.col(found.internal), found.kind, found.nullable)
    if isinstance(node, Const):
        if isinstance(node.value, int) and not -(2**63) <= node.value < 2**63:
            return Value(F.lit(str(node.value)).cast("decimal(38,0)"), T.DecimalType(38, 0), False)
        kind = {int: T.LongType(), float: T.DoubleType(), str: T.StringType()}[type(node.value)]
        return Value(F.lit(node.value).cast(kind), kind, False)
    return Value(F.coalesce(holds(node, scope), F.lit(False)), T.BooleanType(), False)


def holds(node: Any, scope: Scope) -> Column:
    """TRUE where the condition is true, FALSE or NULL elsewhere."""
    if isinstance(node, Negation):
        return fails(node.inner, scope)
    if isinstance(node, Binary):
        if node.op == "AND":
            return holds(node.left, scope) & holds(node.right, scope)
        if node.op == "OR":
            return holds(node.left, scope) | holds(node.right, scope)
        return _compare(node.op, *_sides(node, scope), str(node))
    v = value(node, scope)
    if v.family == "number":
        return v.column != F.lit(0)
    if v.family == "text":
        return v.column != F.lit("")
    return v.column if v.family == "bool" else v.column.isNotNull()


def fails(node: Any, scope: Scope) -> Column:
    """TRUE where the condition is not true, also for want of a value, FALSE or NULL elsewhere."""
    if isinstance(node, Negation):
        return holds(node.inner, scope)
    if isinstance(node, Binary):
        if node.op == "AND":
            return fails(node.left, scope) | fails(node.right, scope)
        if node.op == "OR":
            return fails(node.left, scope) & fails(node.right, scope)
        a, b = _sides(node, scope)
        if _differ(a, b):
            if node.op not in ("=", "!="):
                _compare(node.op, a, b, str(node))  # raises
            return F.lit(True) if node.op == "=" else _any_null(F.lit(False), a, b)
        return _any_null(_compare(_OPPOSITE[node.op], a, b, str(node)), a, b)
    v = value(node, scope)
    if v.family == "number":
        return _any_null(v.column == F.lit(0), v)
    if v.family == "text":
        return _any_null(v.column == F.lit(""), v)
    return _any_null(~v.column, v) if v.family == "bool" else v.column.isNull()


def _sides(node: Binary, scope: Scope) -> tuple[Value, Value]:
    return aligned(value(node.left, scope), value(node.right, scope))


def aligned(a: Value, b: Value) -> tuple[Value, Value]:
    """Two values that are compared, of one family where the dialect makes them so."""
    pair = {a.family, b.family}
    if pair == {"bool", "number"}:  # TRUE equals 1
        a, b = (Value(v.column.cast("bigint"), T.LongType(), v.nullable) if v.family == "bool" else v for v in (a, b))
    elif pair == {"time", "text"}:
        # A text compared with a time is read as one; the dialect has no literal for times.
        a, b = (Value(v.column.try_cast("timestamp"), T.TimestampType(), True) if v.family == "text" else v for v in (a, b))
    return a, b


def _differ(a: Value, b: Value) -> bool:
    return a.family != b.family


def _compare(op: str, a: Value, b: Value, text: str) -> Column:
    if not _differ(a, b):
        return _APPLY[op](a.column, b.column)
    if op == "=":
        return F.lit(False)
    if op == "!=":
        return a.column.isNotNull() & b.column.isNotNull()
    raise EngineError(f"can't order {a.family} and {b.family}: {text}")


def _any_null(column: Column, *values: Value) -> Column:
    for v in values:
        if v.nullable:
            column = column | v.column.isNull()
    return column
