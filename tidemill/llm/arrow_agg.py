"""Mergeable aggregation in Arrow batches: bounded partial states before the shuffle, a streaming merge after it.

Spark's own aggregates keep one state per group; sketches and bounded heaps have none among the
built-in functions. A *reducer* here turns a table of states into a smaller table with one state per
group, all groups at once in numpy. It must be associative, so it may be applied to any split of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.runtime import ship

Reducer = Callable[[pa.Table], pa.Table]
#: Bytes of input gathered between two reductions, and of state a task keeps before it hands the state on and starts anew.
GATHER, KEEP = 24 << 20, 48 << 20
#: From this many tasks on states are merged in two levels, first those of so many tasks each.
WIDE, BRANCH = 512, 128


def group_codes(columns: list[pa.ChunkedArray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(group number of each row, first row of each group); groups are numbered as they come, NULLs are equal to each other."""
    codes = np.zeros(rows, dtype=np.int64)
    for column in columns:
        coded = column.chunk(0).dictionary_encode(null_encoding="encode")
        codes = pd.factorize(codes * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False))[0]
    return codes, np.unique(codes, return_index=True)[1]


Prepare = Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]


def combine(df: DataFrame, reduce: Reducer, keys: list[str], ordered: bool = False, prepare: Prepare | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Apply ``reduce`` within each partition of ``df``, whose columns are ``keys`` and the state, in one row or a few.

    Unordered (before a shuffle), a task whose groups outgrow its memory emits what it has and goes on: a group
    may then come out in several partial states. Ordered (after a shuffle, rows sorted by ``keys``) each group comes
    out once, as soon as the next one begins; only the group at the end of a batch is carried over. ``prepare`` makes states, of ``schema``, of the
    rows of ``df`` where they aren't any yet.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = batches if prepare is None else (s for b in batches for s in prepare(b))
        return stream(states, reduce, keys if ordered else None)

    return df.mapInArrow(run, schema or df.schema)


def stream(batches: Iterator[pa.RecordBatch], reduce: Reducer, ordered: list[str] | None, gather: int = GATHER, keep: int = KEEP) -> Iterator[pa.RecordBatch]:
    """One task's part of ``combine``; ``ordered`` are the keys the rows are sorted by, if they are."""
    held: list[pa.RecordBatch] = []
    size, state = 0, None

    def reduced() -> pa.Table | None:
        tables = ([] if state is None else [state]) + ([pa.Table.from_batches(held)] if held else [])
        return reduce(pa.concat_tables(tables).combine_chunks()) if tables else None

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < gather:
            continue
        state, held, size = reduced(), [], 0
        if ordered is not None:
            # reduce puts groups out in the order they first came, so only the last may go on in the next batch
            begun = last_group(state, ordered)
            yield from state.slice(0, begun).to_batches(max_chunksize=10_000)
            state = state.slice(begun).combine_chunks()
        elif state.nbytes > keep:
            yield from state.to_batches(max_chunksize=10_000)
            state = None
    last = reduced()
    if last is not None:
        yield from last.to_batches(max_chunksize=10_000)


def last_group(state: pa.Table, keys: list[str]) -> int:
    """Where the rows of the last group begin."""
    codes, _ = group_codes([state[k] for k in keys], state.num_rows)
    return int(np.searchsorted(codes, codes[-1])) if len(codes) else 0


def merge(partials: DataFrame, reducer: Callable[[list[str]], Reducer], keys: list[str], tasks: int | None = None) -> DataFrame:
    """One state per group, its rows together, from partial states, whose columns are ``keys`` and the state.

    A shuffle on the keys brings a group's states together, sorted, and they are merged as they stream by. What a group
    sends is bounded by the number of tasks times the size of a state; where ``tasks`` says there are very many, a
    level in between merges the states of every ``BRANCH`` tasks first, so that no task reads more than a share of a hot group.
    """
    if tasks is not None and tasks > WIDE:
        inner = [*keys, "branch"]
        state = [c for c in partials.columns if c not in keys]
        marked = partials.withColumn("branch", F.floor(F.spark_partition_id() / BRANCH)).select(*inner, *state)
        partials = combine(marked.repartition(*inner).sortWithinPartitions(*inner), reducer(inner), inner, ordered=True).select(*keys, *state)
    together = partials.repartition(*keys).sortWithinPartitions(*keys) if keys else partials.repartition(1)
    return combine(together, reducer(keys), keys, ordered=True)


def scan_tasks(df: DataFrame) -> int | None:
    """Number of tasks a plain scan has, None for anything with a shuffle in it; runs nothing."""
    planned = df._jdf.queryExecution()
    return None if "AdaptiveSparkPlan" in planned.executedPlan().getClass().getSimpleName() else planned.toRdd().getNumPartitions()
