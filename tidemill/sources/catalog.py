"""Tables by name: registered rows and DataFrames, Parquet, CSV and snapshot tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemill.errors import EngineError
from tidemill.plans.names import Field, Scope
from tidemill.sources import csv_tables
from tidemill.sources.snapshots import SnapshotTable


@dataclass(frozen=True)
class Table:
    """A DataFrame whose columns are ``c0, c1, …``, and the names they go by. ``version`` is that of a snapshot, ``local`` the rows of a table given as rows, else None."""

    name: str
    columns: tuple[str, ...]
    frame: DataFrame
    version: int | None = None
    local: list[tuple] | None = None

    def scope(self, alias: str | None = None) -> Scope:
        kinds = self.frame.schema.fields
        return Scope(tuple(Field(n, alias or self.name, f.name, f.dataType, f.nullable) for n, f in zip(self.columns, kinds)))


class Catalog:
    """Name → table. Registering a name again replaces it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.stats: dict[str, Any] = {}
        self.waiting: dict[str, Callable[[], Table]] = {}

    def _put(self, name: str, columns: Sequence[str], frame: DataFrame, version: int | None = None, local: list[tuple] | None = None) -> Table:
        plain = frame.toDF(*[f"c{i}" for i in range(len(columns))])
        self.tables[name] = Table(name, tuple(columns), plain, version, local)
        self.stats.pop(name, None)
        self.waiting.pop(name, None)
        return self.tables[name]

    def register(self, name: str, schema: T.StructType | str | Sequence[str], rows: Iterable[Sequence[Any]]) -> Table:
        """A table of given rows. ``schema`` is a Spark schema, DDL text, or column names whose types are taken from the rows."""
        rows = [tuple(r) for r in rows]
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        if not isinstance(schema, T.StructType):
            schema = T.StructType([T.StructField(c, _kind_of(name, c, [r[i] for r in rows])) for i, c in enumerate(schema)])
        floats = [i for i, f in enumerate(schema.fields) if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        for i in floats:
            rows = [(*r[:i], None if r[i] is None else float(r[i]), *r[i + 1 :]) for r in rows]
        names = [f.name for f in schema.fields]
        plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
        return self._put(name, names, self.spark.createDataFrame(rows, plain), local=rows)

    def register_frame(self, name: str, frame: DataFrame) -> Table:
        return self._put(name, frame.columns, frame)

    def _later(self, name: str, load: Callable[[], Table]) -> None:
        """Load a table when a query first names it."""
        self.tables.pop(name, None)
        self.waiting[name] = load

    def load_parquet(self, name: str, path: str | Path) -> None:
        """A Parquet file or directory."""
        self._later(name, lambda: self.register_frame(name, self.spark.read.parquet(str(path))))

    def load_csv(self, name: str, path: str | Path, alias: str | None = None, multiline: bool | None = None) -> None:
        """A CSV file with a header, which is read now; its columns are typed when a query first names the table.

        ``alias`` is accepted for the name a query gives the table anyway.
        """
        columns = csv_tables.header(self.spark, str(path))
        self._later(name, lambda: self._put(name, columns, csv_tables.read(self.spark, str(path), columns, multiline)))

    def load_dir(self, path: str | Path) -> list[str]:
        """Every ``*.csv`` of a directory, under its file's stem; returns the names."""
        files = sorted(Path(path).glob("*.csv"))
        for file in files:
            self.load_csv(file.stem, file)
        return [f.stem for f in files]

    def load_snapshot(self, name: str, path: str | Path, alias: str | None = None, version: int | None = None) -> int:
        """A version of a snapshot table, the latest by default; returns the version read."""
        snapshot = SnapshotTable.open(self.spark, str(path)).snapshot(version)
        self._put(name, snapshot.schema.names, snapshot.read(), snapshot.version)
        return snapshot.version

    def get(self, name: str) -> Table:
        if name in self.waiting:
            return self.waiting[name]()
        if name not in self.tables:
            raise EngineError(f"unknown table {name}")
        return self.tables[name]


def _kind_of(table: str, column: str, cells: list[Any]) -> T.DataType:
    kinds = {type(c) for c in cells if c is not None}
    if kinds <= {int}:
        big = any(c is not None and not -(2**63) <= c < 2**63 for c in cells)
        return (T.DecimalType(38, 0) if big else T.LongType()) if kinds else T.StringType()
    if kinds <= {int, float}:
        return T.DoubleType()
    if len(kinds) > 1:
        raise EngineError(f"column {column} of {table} mixes {', '.join(sorted(k.__name__ for k in kinds))}; give a schema")
    return T._infer_type(next(c for c in cells if c is not None))
