"""Filling containers of fixed capacity with items that are not to be split.

Sizes are whole numbers of tokens from 1 to the capacity, so the packing of any number of items is a function of a
histogram with at most ``capacity`` entries. One aggregation makes it; the packing itself is planned on it, for all
items of a size at once, in time that depends on the capacity and not on the data; and each item then finds its
container by its rank among the items of its size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.runtime import cut

#: Ranks of a size are counted in slices of about this many items, so that a frequent size is never in one task.
SLICE_ITEMS = 250_000


@dataclass(frozen=True)
class Placement:
    """Items of one size with ranks ``first`` to ``first + count - 1``, ``each`` to a container, from container ``container`` on."""

    size: int
    first: int
    count: int
    container: int
    each: int


def plan(histogram: dict[int, int], capacity: int) -> list[Placement]:
    """Pack ``histogram[size]`` items of every size from 1 to ``capacity``.

    Large items, above a third of the capacity, fit at most twice into a container. They are matched greedily: the
    largest left takes the largest other one that still fits beside it. The smaller items follow by falling size, each into
    the container with the least room that still holds it (best fit), or a new one. All items of a size that meet containers
    with the same room are placed in one step, so there are at most a few steps per size.
    """
    if any(not 1 <= s <= capacity for s in histogram):
        raise ValueError("sizes must be between 1 and the capacity")
    left = {s: n for s, n in histogram.items() if n > 0}
    used = dict.fromkeys(left, 0)
    placed: list[Placement] = []
    gaps: list[tuple[int, int, int]] = []  # (room left, first container, number of containers), ascending
    containers = 1

    def put(size: int, count: int, container: int, each: int) -> None:
        placed.append(Placement(size, used[size], count, container, each))
        used[size] += count
        left[size] -= count

    def leave(room: int, container: int, number: int) -> None:
        if number and room:
            insort(gaps, (room, container, number))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        at = bisect_left(large, capacity - size + 1) - 1  # the largest that fits beside it
        if at < 0 or (large[at] == size and left[size] == 1 and at == 0):
            number, rest = left[size], capacity - size
            put(size, number, containers, 1)
            leave(rest, containers, number)
            large.pop()
            containers += number
            continue
        if large[at] == size:
            if left[size] == 1:
                at -= 1
            else:
                number = left[size] // 2
                put(size, 2 * number, containers, 2)
                leave(capacity - 2 * size, containers, number)
                containers += number
                if not left[size]:
                    large.pop()
                continue
        other = large[at]
        number = min(left[size], left[other])
        put(size, number, containers, 1)
        put(other, number, containers, 1)
        leave(capacity - size - other, containers, number)
        containers += number
        if not left[size]:
            large.pop()
        if not left[other]:
            large.remove(other)

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect_left(gaps, (size, 0, 0))
            if at == len(gaps):
                each = capacity // size
                room, container, number = capacity, containers, -(-left[size] // each)
                containers += number
            else:
                room, container, number = gaps.pop(at)
            each = room // size
            full = min(number, left[size] // each)
            if full:
                put(size, full * each, container, each)
                leave(room - each * size, container, full)
            rest = left[size] if full < number else 0
            if rest:
                put(size, rest, container + full, rest)
                leave(room - rest * size, container + full, 1)
            leave(room, container + full + bool(rest), number - full - bool(rest))
    return placed


def pieces(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """``item, piece_no, n_pieces, size``: items above the capacity in pieces of it and a remainder, others whole.

    An item of size 0 or NULL takes no room and has no piece.
    """
    number = F.ceil(F.col(size) / F.lit(capacity)).cast("bigint")
    cutup = items.where(F.col(size) > 0).select(F.col(item).alias("item"), F.col(size).cast("bigint").alias("whole"), number.alias("n_pieces"))
    spread = cutup.withColumn("piece_no", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_pieces")))
    return spread.select("item", "piece_no", "n_pieces", F.when(F.col("piece_no") < F.col("n_pieces"), F.lit(capacity).cast("bigint")).otherwise(F.col("whole") - (F.col("n_pieces") - 1) * capacity).alias("size"))


def pack(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """``item, piece_no, n_pieces, size, container_no`` for every piece of every item.

    Only an item above the capacity is split. Items of size 0 get no container and are left out. Which of several items of one
    size goes where is settled by their identifier, so the result does not depend on the partitioning; repeated identifiers are
    packed each by itself. An empty table gives an empty result. Other columns are not read.

    The histogram, at most ``capacity`` rows, is what reaches the driver; it and the plan, a few rows per size, are what is
    broadcast. Ranks within a size are counted in two steps, over slices of the identifiers' hashes and then within a slice.
    """
    spark = items.sparkSession
    ready = cut(pieces(items, item, size, capacity))
    histogram = {r["size"]: r["n"] for r in ready.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps: dict[int, list[tuple[int, int, int, int]]] = {}
    for p in plan(histogram, capacity):
        steps.setdefault(p.size, []).append((p.first, p.first + p.count, p.container, p.each))
    rows = [(s, -(-n // SLICE_ITEMS), steps[s]) for s, n in histogram.items()]
    sizes = F.broadcast(spark.createDataFrame(rows, "size bigint, slices bigint, steps array<struct<lo: bigint, hi: bigint, container: bigint, each: bigint>>"))
    sliced = ready.join(sizes, "size").withColumn("slice", F.pmod(F.xxhash64("item", "piece_no"), F.col("slices")))
    earlier = Window.partitionBy("size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy("size", "slice").agg(F.count(F.lit(1)).alias("n"))  # one row per SLICE_ITEMS items, at least one per size
    before = counts.select("size", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("size", "slice").orderBy("item", "piece_no")
    ranked = sliced.withColumn("r", F.row_number().over(within) - 1).join(before, ["size", "slice"]).withColumn("rank", F.col("r") + F.col("before"))
    found = ranked.withColumn("step", F.get(F.filter("steps", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"])), F.lit(0)))
    number = F.col("step.container") + F.floor((F.col("rank") - F.col("step.lo")) / F.col("step.each")).cast("bigint")
    return found.select("item", "piece_no", "n_pieces", "size", number.alias("container_no"))


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers used, tokens in them, and the share of their room that is filled (NULL without containers)."""
    return packed.agg(F.coalesce(F.max("container_no"), F.lit(0).cast("bigint")).alias("containers"), F.coalesce(F.sum("size"), F.lit(0).cast("bigint")).alias("tokens")).withColumn(
        "fill", F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity))
    )
