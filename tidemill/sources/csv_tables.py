"""CSV files as tables, with column types found from the cells in one pass."""

from __future__ import annotations

import csv
import io
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import EngineError

# Single classes of characters under possessive quantifiers: Java matches them in a loop, however long the cell.
_INT = r"\A[+-]?[0-9][0-9_]*+\z"
_FLOAT = r"(?i)\A[+-]?(?:(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:e[+-]?[0-9]++)?|inf(?:inity)?|nan)\z"
_STRAY = r"(?:\A|[^0-9])_|_(?:[^0-9]|\z)"


def header(spark: SparkSession, path: str) -> list[str]:
    """Names in the first record of a file, on whatever file system it lies."""
    local = path.removeprefix("file://")
    if os.path.exists(local) and not os.path.isdir(local):
        with open(local, newline="", encoding="utf-8") as f:
            names = next(csv.reader(f), None)
    else:
        first = spark.read.text(path).first()
        names = next(csv.reader(io.StringIO(first[0])), None) if first else None
    if names is None:
        raise EngineError(f"csv {path} is empty")
    return names


def _breaks_in_cells(spark: SparkSession, path: str) -> bool:
    """Whether some cell may hold a line break: the line it begins on has an odd number of quotes. One pass over lines, split as Spark likes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read(spark: SparkSession, path: str, names: list[str], multiline: bool | None = None) -> DataFrame:
    """The records of a CSV file as columns ``c0, c1, …``, one per name of its header.

    Empty cells, quoted or not, are NULL; ``""`` within quotes is a quote. A column whose cells all are integers becomes BIGINT
    (DECIMAL(38,0) if one does not fit), one of numbers DOUBLE, any other STRING, however long the cells; integers may have spaces around, a sign, leading
    zeros and single ``_`` between digits. Short records are padded with NULL, blank lines skipped, cells beyond the
    header dropped; a name that occurs twice is only an error for a query that uses it. Spark splits large files unless a cell may hold a
    line break; ``multiline`` says so where it is known.
    """
    multiline = _breaks_in_cells(spark, path) if multiline is None else multiline
    plain = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    reader = spark.read.schema(plain).option("header", True).option("multiLine", multiline).option("quote", '"').option("escape", '"').option("enforceSchema", True)
    text = reader.csv(path)
    text = text.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in text.columns])
    facts = []
    for c in text.columns:
        whole, number = _whole(c), _number(c)
        facts += [
            F.coalesce(F.bool_and(whole), F.lit(False)).alias(f"{c}_int"),
            F.coalesce(F.bool_and(F.when(F.col(c).isNotNull(), _bare(c).try_cast("bigint").isNotNull())), F.lit(False)).alias(f"{c}_long"),
            F.coalesce(F.bool_and(F.when(F.col(c).isNotNull(), _bare(c).try_cast("decimal(38,0)").isNotNull())), F.lit(False)).alias(f"{c}_exact"),
            F.coalesce(F.bool_and(number), F.lit(False)).alias(f"{c}_number"),
        ]
    seen = text.agg(*facts).first() if facts else {}
    return text.select(*[_typed(c, seen) for c in text.columns])


def _bare(c: str) -> Column:
    return F.replace(F.trim(F.col(c)), F.lit("_"), F.lit(""))


def _whole(c: str) -> Column:
    """Whether a cell is written as an integer; NULL for NULL cells. ``_`` stands between digits only."""
    return F.trim(F.col(c)).rlike(_INT) & ~F.trim(F.col(c)).rlike(_STRAY)


def _number(c: str) -> Column:
    """Whether a cell is written as a number; NULL for NULL cells. An integer that no DOUBLE comes near is none."""
    beyond = _whole(c) & F.abs(_bare(c).try_cast("double")).eqNullSafe(F.lit(float("inf")))
    return _bare(c).rlike(_FLOAT) & ~F.trim(F.col(c)).rlike(_STRAY) & ~beyond


def _typed(c: str, seen) -> Column:
    if seen[f"{c}_int"] and seen[f"{c}_exact"]:
        return _bare(c).cast("bigint" if seen[f"{c}_long"] else "decimal(38,0)").alias(c)
    return _bare(c).cast("double").alias(c) if seen[f"{c}_number"] else F.col(c)
