"""The logical plan: what EXPLAIN prints and what becomes one DataFrame.

A node only declares. The physical strategy – join algorithm, partial aggregation, pruning – is Catalyst's.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import EngineError
from tidemill.functions.logic import Value, aligned, holds, value
from tidemill.plans.costs import join_rows
from tidemill.plans.names import Field, Scope
from tidemill.plans.stats import small
from tidemill.plans.syntax import Call, Item, Order, conjuncts
from tidemill.sources.catalog import Table


class Knowledge(Protocol):
    """What estimates are made from: rows of a table, distinct values of a key among so many rows, the share of rows a condition keeps."""

    def counted(self, scan: Scan) -> int: ...
    def distinct(self, key: Any, among: float) -> int: ...
    def kept(self, condition: Any) -> float: ...


@dataclass(eq=False)
class Node:
    """``scope`` is what the node puts out; ``children`` feed it. Labels are part of what EXPLAIN promises: fixed formats."""

    scope: Scope
    children: tuple[Node, ...]

    @property
    def operator(self) -> str:
        return type(self).__name__

    def label(self) -> str:
        return self.operator

    def build(self, *inputs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def expected(self, inputs: list[float], known: Knowledge) -> float:
        """Estimated rows, given those of the children. A node that neither adds nor drops rows puts out what it takes in."""
        return inputs[0]

    def frame(self, watch: Callable[[Node, DataFrame], DataFrame] = lambda node, df: df) -> DataFrame:
        """The DataFrame of this subtree; ``watch`` may wrap what each node puts out."""
        return watch(self, self.build(*[c.frame(watch) for c in self.children]))

    def walk(self) -> list[Node]:
        return [self, *[n for c in self.children for n in c.walk()]]


@dataclass(eq=False)
class Scan(Node):
    table: Table
    alias: str

    def label(self) -> str:
        return f"Scan {self.alias}"

    def expected(self, inputs: list[float], known: Knowledge) -> float:
        return float(known.counted(self))

    def build(self) -> DataFrame:
        frame = self.table.frame
        return frame.select(*[F.col(c).alias(f.internal) for c, f in zip(frame.columns, self.scope.fields)])


@dataclass(eq=False)
class Filter(Node):
    """``pinned`` keeps it where it stands: Catalyst moves no condition that isn't deterministic, so one that always holds is put before it."""

    condition: Any
    pinned: bool = False

    def label(self) -> str:
        return f"Filter {self.condition}"

    def expected(self, inputs: list[float], known: Knowledge) -> float:
        return inputs[0] * math.prod(known.kept(c) for c in conjuncts(self.condition))

    def build(self, df: DataFrame) -> DataFrame:
        true = holds(self.condition, self.scope)
        return df.where(F.when(F.spark_partition_id() >= 0, true) if self.pinned else true)


@dataclass(eq=False)
class Project(Node):
    values: list[Value]

    def label(self) -> str:
        return "Project " + ", ".join(f.name for f in self.scope.fields)

    def build(self, df: DataFrame) -> DataFrame:
        return df.select(*[v.column.alias(f.internal) for v, f in zip(self.values, self.scope.fields)])


@dataclass(eq=False)
class HashJoin(Node):
    """Inner equijoin. NULL keys match nothing; the sides' sizes decide the algorithm at run time."""

    left_key: Any
    right_key: Any

    def label(self) -> str:
        return f"HashJoin {self.left_key} = {self.right_key}"

    def keys(self) -> tuple[Column, Column]:
        a, b = value(self.left_key, self.children[0].scope), value(self.right_key, self.children[1].scope)
        if a.family == b.family:
            return a.column, b.column
        a, b = aligned(a, b)  # by the rule of WHERE
        if a.family == b.family:
            return a.column, b.column
        return F.lit(None).cast("bigint"), F.lit(None).cast("bigint")  # values of different types are never equal

    def expected(self, inputs: list[float], known: Knowledge) -> float:
        left, right = (known.distinct(k, n) for k, n in zip((self.left_key, self.right_key), inputs))
        return join_rows(*inputs, left, right)

    def build(self, left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = self.keys()
        return left.join(right, a == b, "inner")


@dataclass(eq=False)
class NestedLoopJoin(HashJoin):
    """The same rows by comparing every pair: a baseline for tests and measurements that the planner never picks.

    The right side goes to every task if it is a table Spark would broadcast; otherwise Spark chooses.
    """

    def label(self) -> str:
        return f"NestedLoopJoin {self.left_key} = {self.right_key}"

    def build(self, left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = self.keys()
        below = self.children[1].walk()
        sent = all(small(n.table) if isinstance(n, Scan) else isinstance(n, (Filter, Project)) for n in below)
        return left.join(F.broadcast(right) if sent else right, (a <= b) & (a >= b), "inner")


@dataclass(eq=False)
class Reorder(Node):
    def label(self) -> str:
        return "Reorder to declared column order"

    def build(self, df: DataFrame) -> DataFrame:
        return df.select(*[f.internal for f in self.scope.fields])


@dataclass(eq=False)
class HashAggregate(Node):
    keys: list[Value]
    group_exprs: list[Any]
    calls: list[Column]
    items: list[Item]

    def label(self) -> str:
        keys = ", ".join(map(str, self.group_exprs)) or "(all rows)"
        return f"HashAggregate group_by=[{keys}] aggs=[{', '.join(i.name for i in self.items)}]"

    def expected(self, inputs: list[float], known: Knowledge) -> float:
        """One row without keys; else a group per combination of key values, as far as there are rows for them."""
        return min(inputs[0], float(math.prod(known.distinct(k, inputs[0]) for k in self.group_exprs))) if self.group_exprs else 1.0

    def build(self, df: DataFrame) -> DataFrame:
        names = [f.internal for f in self.scope.fields]
        keys = [k.column.alias(n) for k, n in zip(self.keys, names)]
        calls = [c.alias(n) for c, n in zip(self.calls, names[len(keys) :])]
        if not calls:
            return df.select(*keys).distinct()
        return df.groupBy(*keys).agg(*calls) if keys else df.agg(*calls)


def _sorted_by(order: list[Order], scope: Scope) -> list[Column]:
    """NULLS LAST in both directions. A constant is a constant here, never a position."""
    out = []
    for o in order:
        column = value(o.what, scope).column
        out.append(column.desc_nulls_last() if o.descending else column.asc_nulls_last())
    return out


@dataclass(eq=False)
class Sort(Node):
    order: list[Order]

    def label(self) -> str:
        return "Sort " + ", ".join(map(str, self.order))

    def build(self, df: DataFrame) -> DataFrame:
        return df.orderBy(*_sorted_by(self.order, self.scope))


@dataclass(eq=False)
class TopK(Node):
    order: list[Order]
    count: int

    def label(self) -> str:
        return f"TopK {self.count} by " + ", ".join(map(str, self.order))

    def expected(self, inputs: list[float], known: Knowledge) -> float:
        return min(inputs[0], float(self.count))

    def build(self, df: DataFrame) -> DataFrame:
        return df.orderBy(*_sorted_by(self.order, self.scope)).limit(self.count)


@dataclass(eq=False)
class Limit(Node):
    count: int

    def label(self) -> str:
        return f"Limit {self.count}"

    def expected(self, inputs: list[float], known: Knowledge) -> float:
        return min(inputs[0], float(self.count))

    def build(self, df: DataFrame) -> DataFrame:
        return df.limit(self.count)


@dataclass(eq=False)
class Distinct(Node):
    def build(self, df: DataFrame) -> DataFrame:
        return df.distinct()


def aggregate(call: Call, scope: Scope, exact: bool) -> tuple[Column, T.DataType, bool]:
    """An aggregate call as (column, type, may be NULL)."""
    if call.argument is None:
        return F.count(F.lit(1)), T.LongType(), False
    v = value(call.argument, scope)
    if call.function == "COUNT":
        return F.count(v.column), T.LongType(), False
    if call.function in ("MIN", "MAX"):
        return (F.min if call.function == "MIN" else F.max)(v.column), v.kind, True
    if v.family not in ("number", "bool"):
        raise EngineError(f"{call.function} needs numbers, not {v.family}: {call}")
    whole = v.family == "bool" or isinstance(v.kind, T.IntegralType)
    column = v.column.cast("bigint") if v.family == "bool" else v.column
    if call.function == "AVG":
        return F.avg(column).cast("double"), T.DoubleType(), True
    if whole and exact:
        return F.sum(column.cast("decimal(38,0)")), T.DecimalType(38, 0), True
    return F.sum(column), T.LongType() if whole else v.kind, True


def explain(node: Node, depth: int = 0) -> str:
    """The plan as text, a line per node, inputs indented below."""
    return "\n".join(["  " * depth + node.label(), *[explain(c, depth + 1) for c in node.children]])


def fields(names: list[str], kinds: list[tuple[T.DataType, bool]], prefix: str) -> Scope:
    """Output columns without a table."""
    return Scope(tuple(Field(n, None, f"{prefix}{i}", kind, null) for i, (n, (kind, null)) in enumerate(zip(names, kinds))))
