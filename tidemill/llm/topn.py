"""The N highest-scoring rows of every group, for groups of any size."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.arrow_agg import combine, group_codes, merge, scan_tasks


def _best(table: pa.Table, keys: list[str], n: int) -> pa.Table:
    """The bounded heaps of all groups at once: each keeps its n first rows by score, highest first, then identifier, and numbers them."""
    codes, first = group_codes([table[c] for c in keys], table.num_rows)
    score = table["score"].chunk(0).to_numpy(zero_copy_only=False)
    falling = ~score if score.dtype.kind == "i" else -score  # NaN sorts behind every number
    item = table["item"].chunk(0).to_numpy(zero_copy_only=False)
    if item.dtype.kind == "O":
        item = pd.factorize(item, sort=True)[0]
    order = np.lexsort((item, falling, codes))
    sorted_codes = codes[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_codes, np.arange(len(first)))[sorted_codes]
    best = table.take(pa.array(order[place < n]))
    at = best.schema.get_field_index("rank")
    # The field stays as it came, not nullable: heaps are joined with rows that came later, and Arrow joins equal schemas only.
    return best.set_column(at, best.schema.field(at), pa.array(place[place < n] + 1, type=pa.int32()))


def partial_top_n(df: DataFrame, keys: list[str], score: str, item: str, n: int) -> DataFrame:
    """``k0, k1, …, score, item, rank``: of every task's rows the n best of each group.

    Rows with a NULL score or item take no part. An associative partial result: the n best of several of these are the
    n best of all their rows, also for coarser groups.
    """
    kind = df.schema[score].dataType
    if not isinstance(kind, (T.IntegralType, T.FractionalType)) or isinstance(kind, T.DecimalType):
        raise TypeError(f"the score must be an integer or a float, not {kind.simpleString()}")
    inner = [f"k{i}" for i in range(len(keys))]
    slim = df.where(F.col(score).isNotNull() & F.col(item).isNotNull()).select(*[F.col(k).alias(i) for k, i in zip(keys, inner)], F.col(score).alias("score"), F.col(item).alias("item"), F.lit(0).alias("rank"))
    return combine(slim, partial(_best, keys=inner, n=n), inner)


def top_n(df: DataFrame, keys: list[str], score: str, item: str, n: int, rank: str = "rank_no") -> DataFrame:
    """The keys, score, item and ``rank`` of the n rows of each group with the highest score, ties by the smaller item.

    Before the shuffle each task keeps a heap of n rows per group, so a group with a third of all rows sends n rows per
    task. After it the heaps of a group stream by, sorted by Spark, and are merged by the same reducer; a group
    is never held.

    Defined cases: groups with fewer than n rows come out whole; no keys make one group; NULL in a key column is a value of its own;
    NULL scores and items take no part; NaN ranks below every number; repeated rows (same score and item) take a rank each; an
    empty table gives an empty result; other columns of ``df``, whatever their names, are not read.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    inner = [f"k{i}" for i in range(len(keys))]
    merged = merge(partial_top_n(df, keys, score, item, n), lambda by: partial(_best, keys=by, n=n), inner, scan_tasks(df))
    return merged.select(*inner, "score", "item", "rank").toDF(*keys, score, item, rank)
