"""Distinct counts by the k smallest hash values of each group.

A sketch is the sorted array of the k smallest 64-bit hashes of a group's identifiers. Below k
distinct values it holds them all and every figure is exact (up to hash collisions, 2^-64 a pair); from k on, with
the k-th smallest hash at fraction t of the hash range, (k - 1) / t estimates the number, with relative standard error
1 / sqrt(k - 2): 1.6 % at the default k. Sketches merge by keeping the k smallest of both, so partial results of any
split of the rows, of days, regions or loads, give the sketch of their union.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.arrow_agg import combine, group_codes, merge

K = 4096
#: Standard errors either side of an estimate for its bounds; beyond them lies about one estimate in 16,000.
Z = 4.0


def _smallest(table: pa.Table, keys: list[str], k: int) -> pa.Table:
    codes, first = group_codes([table[c] for c in keys], table.num_rows)
    lists = table["hashes"].chunk(0)
    hashes = lists.flatten().to_numpy(zero_copy_only=False)
    groups = np.repeat(codes, np.diff(lists.offsets.to_numpy()))
    order = np.lexsort((hashes, groups))
    groups, hashes = groups[order], hashes[order]
    new = np.ones(len(groups), dtype=bool)
    new[1:] = (groups[1:] != groups[:-1]) | (hashes[1:] != hashes[:-1])
    groups, hashes = groups[new], hashes[new]
    starts = np.searchsorted(groups, np.arange(len(first)))
    kept = np.arange(len(groups)) - starts[groups] < k
    groups, hashes = groups[kept], hashes[kept]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(groups, minlength=len(first)))]).astype(np.int32)
    sketch = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes, type=pa.int64()))
    return pa.table([table[c].take(pa.array(first)) for c in keys] + [sketch.cast(table.schema.field("hashes").type)], schema=table.schema)


def partial_sketches(df: DataFrame, keys: list[str], value: Column, k: int = K) -> DataFrame:
    """``keys, hashes`` with the sketches of each task's rows; NULL values count for nothing and open no group.

    ``keys`` are the grouping columns (NULL is a value of its own); other columns of ``df`` are not read.
    """
    hashed = df.where(value.isNotNull()).select(*keys, F.array(F.xxhash64(value)).alias("hashes"))
    return combine(hashed, partial(_smallest, keys=keys, k=k), keys)


def _by_column(batch: pa.RecordBatch, keys: list[str], used: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
    """States of one row each of every counted column: ``keys``, where a key the column does not use is NULL, ``column_name`` and ``hashes``."""
    nothing = {k: pa.nulls(batch.num_rows, batch.schema.field(k).type) for k in keys}
    for i, (column, own) in enumerate(used.items()):
        given = batch.column(f"h{i}")
        there = given.is_valid()
        hashes = given.filter(there)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1, dtype=np.int32)), hashes)
        taken = [(batch.column(k) if k in own else nothing[k]).filter(there) for k in keys]
        yield pa.RecordBatch.from_arrays([*taken, pa.array([column] * len(hashes), pa.string()), lists], [*keys, "column_name", "hashes"])


def partial_sketches_of(df: DataFrame, keys: list[str], values: dict[str, Column], used: dict[str, list[str]], k: int = K) -> DataFrame:
    """``keys, column_name, hashes`` with the sketches of each task's rows for several columns at once.

    ``values``: what is counted, by name; ``used``: the keys each is grouped by, the others being NULL for it. A row goes to Python once, whatever the number
    of columns. NULL values count for nothing and open no group.
    """
    names = list(values)
    wide = df.select(*keys, *[F.when(values[c].isNotNull(), F.xxhash64(values[c])).alias(f"h{i}") for i, c in enumerate(names)])
    state = T.StructType([*[wide.schema[c] for c in keys], T.StructField("column_name", T.StringType()), T.StructField("hashes", T.ArrayType(T.LongType()))])
    all_keys = [*keys, "column_name"]
    return combine(wide, partial(_smallest, keys=all_keys, k=k), all_keys, prepare=partial(_by_column, keys=keys, used={c: used[c] for c in names}), schema=state)


def grouping_sets(partials: DataFrame, dims: list[str], sets: list[tuple[str, ...]], fixed: list[str], k: int = K, only: dict[tuple[str, ...], Column] | None = None) -> DataFrame:
    """Partial sketches of each grouping set, from those of the finest groups: the rows are hashed and sorted once.

    Adds ``grouped``, the names of the set's dimensions joined by commas; the others are NULL. ``only`` holds the condition on
    the finest groups under which a set is wanted, for sets that are not wanted of all.
    """
    choices = []
    for s in sets:
        choice = F.struct(F.lit(",".join(s)).alias("grouped"), *[(F.col(d) if d in s else F.lit(None).cast(partials.schema[d].dataType)).alias(d) for d in dims])
        choices.append(F.when(only[s], choice) if only and s in only else choice)
    spread = partials.withColumn("set", F.explode(F.array_compact(F.array(*choices)))).select(*fixed, "set.*", "hashes")
    keys = [*fixed, "grouped", *dims]
    return combine(spread.select(*keys, "hashes"), partial(_smallest, keys=keys, k=k), keys)


def merge_sketches(partials: DataFrame, keys: list[str], k: int = K, tasks: int | None = None) -> DataFrame:
    """One sketch per group, keeping the k smallest of all its partial sketches; ``tasks`` is how many made them, if known."""
    return merge(partials.select(*keys, "hashes"), lambda by: partial(_smallest, keys=by, k=k), keys, tasks)


def _share(kth: Column) -> Column:
    return (kth.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)


def estimate(hashes: Column, k: int = K) -> Column:
    """Estimated number of distinct values of a sketch; exact below k. An empty sketch gives 0, a NULL one NULL."""
    return F.when(F.size(hashes) < k, F.size(hashes).cast("double")).otherwise(F.lit(k - 1.0) / _share(F.element_at(hashes, -1)))


def bounds(hashes: Column, k: int = K, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper bound of the number of distinct values, ``z`` standard errors either side; both the number itself below k.

    The k-th smallest hash, times the number, is spread as the sum of k exponential waiting times at most. The bounds are that
    distribution's quantiles (by the cube root's normal approximation), so they hold for small k as well, where it is skewed.
    """
    quantile = lambda side: k * max(0.0, 1 - 1 / (9 * k) + side * z / (3 * k**0.5)) ** 3
    full, share = F.size(hashes) >= k, _share(F.element_at(hashes, -1))
    low, high = (F.when(full, F.lit(quantile(side)) / share).otherwise(estimate(hashes, k)) for side in (-1, 1))
    return F.when(full, F.greatest(low, F.lit(float(k)))).otherwise(low), high


def union_of(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sketched sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def compare(df: DataFrame, a: str, b: str, k: int = K, z: float = Z) -> DataFrame:
    """Adds estimates with bounds for ``union``, ``both``, ``only_a`` and ``only_b`` of two sketch columns (NULL counts as empty).

    The k smallest hashes of the union are a random sample of it: the share of them found in both sketches, or
    in one only, times the union's size estimates that part, with a Wilson interval for the share.
    Below k values in the union all figures are exact.
    """
    empty = F.array().cast("array<bigint>")
    out = df.withColumns({"__a": F.coalesce(F.col(a), empty), "__b": F.coalesce(F.col(b), empty)})
    out = out.withColumn("__u", union_of(F.col("__a"), F.col("__b"), k))
    u, n = F.col("__u"), F.size("__u")
    in_a, in_b = F.array_intersect(u, F.col("__a")), F.array_intersect(u, F.col("__b"))
    out = out.withColumns({"__n": n, "__both": F.size(F.array_intersect(in_a, in_b)), "__only_a": F.size(F.array_except(in_a, in_b)), "__only_b": F.size(F.array_except(in_b, in_a))})
    low, high = bounds(u, k, z)
    out = out.withColumns({"union_est": estimate(u, k), "union_low": low, "union_high": high})
    exact = F.col("__n") < k
    size = F.greatest(F.col("__n"), F.lit(1)).cast("double")
    for part in ("both", "only_a", "only_b"):
        share = F.col(f"__{part}") / size
        middle = (share + z * z / (2 * size)) / (1 + z * z / size)
        half = F.sqrt(share * (1 - share) / size + z * z / (4 * size * size)) * z / (1 + z * z / size)
        out = out.withColumns({
            f"{part}_est": share * F.col("union_est"),
            f"{part}_low": F.when(exact, share * F.col("union_est")).otherwise(F.greatest(middle - half, F.lit(0.0)) * F.col("union_low")),
            f"{part}_high": F.when(exact, share * F.col("union_est")).otherwise(F.least(middle + half, F.lit(1.0)) * F.col("union_high")),
        })
    return out.drop("__a", "__b", "__u", "__n", "__both", "__only_a", "__only_b")
