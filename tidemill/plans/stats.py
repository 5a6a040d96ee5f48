"""Table statistics for the cost model, computed by Spark only when and for the columns they are needed."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.sources.catalog import Catalog, Table


@dataclass
class TableStats:
    """Number of rows and of distinct non-NULL values per column."""

    row_count: int
    ndv: dict[str, int] = field(default_factory=dict)

    def distinct(self, column: str) -> int:
        return max(1, self.ndv.get(column, 1))


#: Statistics of small tables by what their files are – names, sizes and times of change – for every catalog of the process.
_KEPT: dict[tuple, TableStats] = {}


def bytes_of(table: Table) -> int:
    """Size of a table as Spark's optimizer sees it: that of its files, or more than any where it can't tell. Runs nothing."""
    return int(str(table.frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _files_of(table: Table) -> tuple:
    """What identifies the content of a small table that is read from files as they are; empty for any other."""
    kind = lambda node: node.getClass().getSimpleName()
    plan, read = table.frame._jdf.queryExecution().optimizedPlan(), []
    if kind(plan) == "Project":  # columns may be renamed, not computed
        for i in range(plan.projectList().size()):
            column = plan.projectList().apply(i)
            column = column.child() if kind(column) == "Alias" else column
            if kind(column) != "AttributeReference":
                return ()
            read.append(column.name())
        plan = plan.child()
    if kind(plan) != "LogicalRelation":
        return ()
    spark, found = table.frame.sparkSession, []
    for name in sorted(table.frame.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return (table.columns, *read, *found)


def small(table: Table) -> bool:
    """Whether Spark would broadcast the table; its columns may then come to the driver too."""
    limit = table.frame.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    most = int(limit[:-1]) if limit[-1:].lower() == "b" else int(limit) if limit.lstrip("-").isdigit() else 10 << 20
    return table.local is not None or bytes_of(table) <= most


_PLAIN = (T.StringType, T.IntegralType, T.BooleanType, T.DateType, T.TimestampType)


def _counted_here(table: Table, names: list[str]) -> list[int] | None:
    """Rows and distinct values of a small table, without a shuffle; None where values are not plain enough to be told apart here."""
    places = [table.columns.index(c) for c in names]
    if not all(isinstance(table.frame.schema[i].dataType, _PLAIN) for i in places):
        return None
    if table.local is not None:
        return [len(table.local), *[len({r[i] for r in table.local} - {None}) for i in places]]
    got = table.frame.select(F.lit(True).alias("r"), *[F.col(f"c{i}") for i in places]).toArrow()
    return [got.num_rows, *[pc.count_distinct(got[f"c{i}"]).as_py() for i in places]]


def table_stats(catalog: Catalog, table: Table, columns: set[str], is_small: bool | None = None) -> TableStats:
    """Statistics of a table, with the distinct counts of ``columns``; kept until the name is registered anew.

    Counted exactly whatever the size: of tables that Spark would broadcast on the driver, from just those columns, of others in one pass. ``is_small`` says
    which it is, where that is known.
    """
    known = catalog.stats.get(table.name)
    stats = known[1] if known is not None and known[0] is table else None
    if stats is None:
        is_small = small(table) if is_small is None else is_small
        files = _files_of(table) if table.local is None and is_small else ()
        stats = _KEPT.setdefault(files, TableStats(-1)) if files else TableStats(-1)
        if stats.row_count >= 0:
            catalog.stats[table.name] = (table, stats)
    wanted = {c: F.col(f"c{i}") for i, c in reversed(list(enumerate(table.columns))) if c in columns and c not in stats.ndv}
    if stats.row_count < 0 or wanted:
        row = _counted_here(table, list(wanted)) if wanted and (small(table) if is_small is None else is_small) else None
        if row is None:
            row = table.frame.agg(F.count(F.lit(1)), *[F.count_distinct(c) for c in wanted.values()]).first()
        stats.row_count = row[0]
        stats.ndv.update(zip(wanted, row[1:]))
        catalog.stats[table.name] = (table, stats)
    return stats


def gather(catalog: Catalog, wanted: Sequence[tuple[Table, set[str]]]) -> list[TableStats]:
    """Statistics of several tables, computed side by side.

    Where all tables but one are small, every order runs as broadcasts into that one. Then it isn't read for statistics: its rows are
    taken from its size, its keys to have the values of their partners.
    """
    merged: dict[str, tuple[Table, set[str]]] = {}
    for table, columns in wanted:
        merged[table.name] = (table, merged.get(table.name, (table, set()))[1] | columns)
    with ThreadPoolExecutor(len(merged) or 1) as pool:
        sizes = dict(zip(merged, pool.map(lambda tc: small(tc[0]), merged.values())))
        large = [name for name, is_small in sizes.items() if not is_small]
        alone = merged.pop(large[0])[0] if len(large) == 1 and sum(t.name == large[0] for t, _ in wanted) == 1 else None
        found = dict(zip(merged, pool.map(lambda name: table_stats(catalog, *merged[name], sizes[name]), merged)))
    if alone is not None:
        known = catalog.stats.get(alone.name)
        width = int(alone.frame._jdf.schema().defaultSize())
        found[alone.name] = known[1] if known and known[0] is alone else TableStats(max(1, bytes_of(alone) // max(1, width)))
    return [found[table.name] for table, _ in wanted]
