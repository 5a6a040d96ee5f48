"""The engine's interface: a query as a lazy DataFrame, as rows, as a plan, or as a profiled plan."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans import nodes as N
from tidemill.plans import profile as P
from tidemill.plans.builder import Planner
from tidemill.plans.names import Scope
from tidemill.plans.syntax import parse
from tidemill.sources.catalog import Catalog

@contextmanager
def _dialect(spark: SparkSession) -> Iterator[None]:
    """Session settings a query is analysed under: names are case-sensitive."""
    key = "spark.sql.caseSensitive"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def compile_sql(catalog: Catalog, text: str, reorder: bool = True, pushdown: bool = True, exact_sums: bool = False) -> N.Node:
    """The logical plan of a query; all names, types and joins are checked, nothing runs but statistics for three or more tables."""
    with _dialect(catalog.spark):
        return Planner(catalog, reorder, pushdown, exact_sums).plan(parse(text))


def _named(root: N.Node, frame: DataFrame) -> DataFrame:
    """The frame with the names users see; they may repeat and hold dots."""
    return frame.select(*[f.internal for f in root.scope.fields]).toDF(*root.scope.names())


def sql(catalog: Catalog, text: str, reorder: bool = True, pushdown: bool = True, exact_sums: bool = False) -> DataFrame:
    """The query as a lazy DataFrame, the way to go on working with a result of any size.

    ``pushdown=False`` keeps filters above the joins, also in what Spark runs.
    """
    root = compile_sql(catalog, text, reorder, pushdown, exact_sums)
    with _dialect(catalog.spark):
        return _named(root, root.frame())


def execute(catalog: Catalog, text: str, reorder: bool = True, pushdown: bool = True, exact_sums: bool = False) -> tuple[list[tuple[Any, ...]], Scope]:
    """The query's rows on the driver, and the scope that names their columns (``scope.names()``)."""
    root = compile_sql(catalog, text, reorder, pushdown, exact_sums)
    with _dialect(catalog.spark):
        return [tuple(r) for r in _named(root, root.frame()).collect()], root.scope


def explain(catalog: Catalog, text: str, reorder: bool = True, pushdown: bool = True) -> str:
    """The logical plan as text."""
    return N.explain(compile_sql(catalog, text, reorder, pushdown))


@dataclass(frozen=True)
class Analysis:
    """``rows`` is empty where they were not fetched; ``plan.actual_rows`` is their number either way."""

    rows: list[tuple[Any, ...]]
    schema: Scope
    plan: P.PlanStats


def explain_analyze(catalog: Catalog, text: str, reorder: bool = True, pushdown: bool = True, fetch: bool = True, times: bool = False) -> Analysis:
    """Run the query with a count after every node; ``fetch=False`` leaves its rows where they are.

    ``times`` adds the time of every node, for which each part of the plan is run again by itself: for small data.
    """
    root = compile_sql(catalog, text, reorder, pushdown)
    with _dialect(catalog.spark):
        _, rows, plan = P.profile(catalog, root, _named, fetch, times)
    return Analysis([tuple(r) for r in rows], root.scope, plan)


format_analyze = P.text
format_explain = N.explain
