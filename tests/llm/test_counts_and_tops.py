"""Distinct-count sketches and top N against exact answers."""

import random
from collections import defaultdict
from datetime import datetime
from functools import partial

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import arrow_agg, kmv, queries
from tidemill.llm.arrow_agg import stream
from tidemill.llm.topn import _best, partial_top_n, top_n


def pairs(seed, n, groups, ids):
    rng = random.Random(seed)
    return [(rng.choice(groups), rng.choice(groups), rng.randrange(ids) if rng.random() < 0.95 else None) for _ in range(n)]


def exact(rows, key):
    out = defaultdict(set)
    for r in rows:
        if r[2] is not None:
            out[key(r)].add(r[2])
    return {k: len(v) for k, v in out.items()}


SCHEMA = "g string, h string, id long"


def test_exact_below_k(spark):
    rows = pairs(1, 3000, ["a", "b", None, ""], 300)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("hashes", F.lit("x")).repartition(5)
    merged = kmv.merge_sketches(kmv.partial_sketches(df, ["g", "h"], F.col("id"), 512), ["g", "h"], 512)
    got = {(r.g, r.h): r.n for r in merged.select("g", "h", kmv.estimate(F.col("hashes"), 512).alias("n")).collect()}
    assert got == exact(rows, lambda r: r[:2])
    assert merged.count() == len(got)
    low, high = kmv.bounds(F.col("hashes"), 512)
    assert merged.where(low != high).count() == 0


def test_estimates_stay_within_their_bounds(spark, monkeypatch):
    rows = pairs(2, 60_000, ["a", "b", "c"], 30_000)
    df = spark.createDataFrame(rows, SCHEMA)
    want, k = exact(rows, lambda r: r[0]), 256
    sketches = kmv.merge_sketches(kmv.partial_sketches(df, ["g"], F.col("id"), k), ["g"], k)
    low, high = kmv.bounds(F.col("hashes"), k)
    for r in sketches.select("g", low.alias("low"), high.alias("high"), F.size("hashes").alias("n")).collect():
        assert r.low <= want[r.g] <= r.high and r.n == k
    # one split of the rows or another: the same sketch
    other = kmv.merge_sketches(kmv.partial_sketches(df.repartition(13), ["g"], F.col("id"), k), ["g"], k)
    assert {r.g: r.hashes for r in sketches.collect()} == {r.g: r.hashes for r in other.collect()}
    # and merged in two levels too, as for very many tasks
    monkeypatch.setattr(arrow_agg, "BRANCH", 3)
    deep = kmv.merge_sketches(kmv.partial_sketches(df.repartition(13), ["g"], F.col("id"), k), ["g"], k, tasks=10_000)
    assert {r.g: r.hashes for r in sketches.collect()} == {r.g: r.hashes for r in deep.collect()} and deep.columns == ["g", "hashes"]
    assert arrow_agg.scan_tasks(df.repartition(3)) is None and arrow_agg.scan_tasks(spark.range(10, numPartitions=4)) == 4


def test_grouping_sets(spark):
    rows = pairs(3, 2000, ["a", "b", None], 200)
    finest = kmv.partial_sketches(spark.createDataFrame(rows, SCHEMA), ["g", "h"], F.col("id"))
    sets = kmv.merge_sketches(kmv.grouping_sets(finest, ["g", "h"], [(), ("g",), ("g", "h")], []), ["grouped", "g", "h"])
    got = {(r.grouped, r.g, r.h): r.n for r in sets.select("grouped", "g", "h", kmv.estimate(F.col("hashes")).alias("n")).collect()}
    assert got == {("", None, None): exact(rows, lambda r: 0)[0]} | {("g", k, None): v for k, v in exact(rows, lambda r: r[0]).items()} | {("g,h", *k): v for k, v in exact(rows, lambda r: r[:2]).items()}


@pytest.mark.parametrize("k", [64, 100_000])
def test_set_operations(spark, k):
    a, b = set(range(0, 9000)), set(range(6000, 12_000))
    df = spark.createDataFrame([("a", i) for i in a] + [("b", i) for i in b], "g string, id long")
    merged = kmv.merge_sketches(kmv.partial_sketches(df, ["g"], F.col("id"), k), ["g"], k)
    one = merged.groupBy().agg(*[F.max(F.when(F.col("g") == g, F.col("hashes"))).alias(g) for g in "ab"]).withColumn("none", F.lit(None).cast("array<bigint>"))
    r = kmv.compare(one, "a", "b", k).first()
    for name, n in (("union", len(a | b)), ("both", len(a & b)), ("only_a", len(a - b)), ("only_b", len(b - a))):
        assert r[f"{name}_low"] <= n <= r[f"{name}_high"], name
        assert k < 1000 or r[f"{name}_est"] == n
    r = kmv.compare(one, "none", "none", k).first()
    assert r.union_est == r.both_est == r.only_a_high == 0


def test_sketches_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert kmv.merge_sketches(kmv.partial_sketches(empty, ["g"], F.col("id")), ["g"]).count() == 0
    nulls = spark.createDataFrame([("a", "b", None)], SCHEMA)
    assert kmv.merge_sketches(kmv.partial_sketches(nulls, ["g"], F.col("id")), ["g"]).count() == 0


# --- top N


def best_by_hand(rows, n):
    groups = defaultdict(list)
    for g, s, i in rows:
        if s is not None and i is not None:
            groups[g].append((s, i))
    out = []
    for g, members in groups.items():
        members.sort(key=lambda m: (m[0] != m[0], -m[0] if m[0] == m[0] else 0, m[1]))
        out += [(g, *m, r + 1) for r, m in enumerate(members[:n])]
    return sorted(map(str, out))


@pytest.mark.parametrize("kind", ["long", "double"])
def test_top_n_against_sorting(spark, kind):
    rng = random.Random(5)
    score = (lambda: rng.choice([None, *range(-5, 6), -(2**63), 2**63 - 1])) if kind == "long" else (lambda: rng.choice([None, float("nan"), 0.5, -1.5, 7.0, float("inf")]))
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None, ""]), score(), rng.choice([None, *range(300)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, f"g string, s {kind}, i long").withColumns({"score": F.lit("x"), "rank_no": F.lit(1), "k0": F.lit(0)}).repartition(7)
    assert sorted(str(tuple(r)) for r in top_n(df, ["g"], "s", "i", 4).collect()) == best_by_hand(rows, 4)


def test_top_n_cases(spark):
    df = spark.createDataFrame([("a", 1, "y"), ("a", 1, "x"), ("a", 1, "x"), ("b", 0, "z")], "g string, s int, i string")
    assert [tuple(r) for r in top_n(df, ["g"], "s", "i", 2).orderBy("g", "rank_no").collect()] == [("a", 1, "x", 1), ("a", 1, "x", 2), ("b", 0, "z", 1)]
    assert [tuple(r) for r in top_n(df, [], "s", "i", 1).collect()] == [(1, "x", 1)]
    assert top_n(df.limit(0), ["g"], "s", "i", 2).count() == 0
    with pytest.raises(ValueError):
        top_n(df, ["g"], "s", "i", 0)
    with pytest.raises(TypeError):
        top_n(df, ["g"], "i", "s", 1)


def test_heaps_are_small_before_the_shuffle(spark):
    df = spark.range(100_000).select(F.lit(1).alias("g"), F.col("id").alias("s"), F.col("id").alias("i")).repartition(6)
    assert partial_top_n(df, ["g"], "s", "i", 3).count() == 18


def test_states_are_handed_on_when_they_grow():
    rows = [(g, s, i) for i, (g, s) in enumerate((g, s) for g in range(50) for s in range(20))]
    random.Random(1).shuffle(rows)
    table = pa.table({"k0": [r[0] for r in rows], "score": [r[1] for r in rows], "item": [r[2] for r in rows], "rank": pa.array([0] * len(rows), pa.int32())})
    reduce = partial(_best, keys=["k0"], n=2)
    small = list(stream(iter(table.to_batches(max_chunksize=37)), reduce, None, gather=1500, keep=2000))
    assert sum(b.num_rows for b in small) > 100  # partial states of one group came out several times
    whole = reduce(pa.Table.from_batches(small).combine_chunks())
    assert sorted(zip(whole["k0"].to_pylist(), whole["score"].to_pylist())) == sorted((g, s) for g in range(50) for s in (18, 19))


def test_ordered_merge_yields_each_group_once():
    hashes = [[g * 1000 + j, g * 1000 + j + 7] for g in range(30) for j in range(40)]
    table = pa.table({"g": [g for g in range(30) for _ in range(40)], "hashes": pa.array(hashes, pa.list_(pa.int64()))})
    out = pa.Table.from_batches(stream(iter(table.to_batches(max_chunksize=11)), partial(kmv._smallest, keys=["g"], k=5), ["g"], gather=300))
    assert out["g"].to_pylist() == list(range(30)) and out["hashes"].to_pylist() == [[g * 1000 + j for j in range(5)] for g in range(30)]


def test_heaps_merge_in_order():
    """Heaps of several rows a group, cut anywhere by the batches: each group comes out once, numbered."""
    rows = sorted((g, s) for g in range(40) for s in range(g % 7 + 1))
    table = pa.table({"k0": [r[0] for r in rows], "score": [r[1] for r in rows], "item": list(range(len(rows))), "rank": pa.array([9] * len(rows), pa.int32())})
    out = pa.Table.from_batches(stream(iter(table.to_batches(max_chunksize=5)), partial(_best, keys=["k0"], n=3), ["k0"], gather=200))
    want = [(g, s, i + 1) for g in range(40) for i, s in enumerate(sorted(range(g % 7 + 1), reverse=True)[:3])]
    assert list(zip(out["k0"].to_pylist(), out["score"].to_pylist(), out["rank"].to_pylist())) == want


@pytest.mark.parametrize("ordered", [None, ["k0"]])
def test_heaps_meet_rows_that_come_later(ordered):
    """A heap kept over from what was gathered before has the schema of the rows Spark sends, whose rank can't be NULL."""
    rows = [(g, g * 100 + s) for g in range(40) for s in range(9)]
    schema = pa.schema([pa.field("k0", pa.int64()), *[pa.field(c, pa.int64(), nullable=False) for c in ("score", "item")], pa.field("rank", pa.int32(), nullable=False)])
    table = pa.table([[r[0] for r in rows], [r[1] for r in rows], [r[1] for r in rows], [0] * len(rows)], schema=schema)
    out = list(stream(iter(table.to_batches(max_chunksize=5)), partial(_best, keys=["k0"], n=2), ordered, gather=300))
    assert out and all(b.schema == schema for b in out)
    got = [(r["k0"], r["score"], r["rank"]) for b in out for r in b.to_pylist()]
    assert got == [(g, g * 100 + 9 - rank, rank) for g in range(40) for rank in (1, 2)]


def test_top_n_of_tasks_that_gather_more_than_once(spark):
    """One task of 56 MB before the shuffle and one of 39 MB after it, each more than is gathered at once."""
    n, groups = 2_000_000, 700_000
    df = spark.range(n, numPartitions=1).select((F.col("id") % groups).alias("g"), F.col("id").alias("s"), F.col("id").alias("i"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        best = top_n(df, ["g"], "s", "i", 2)
        last = F.when(F.col("g") < n % groups, F.col("g") + n // groups * groups).otherwise(F.col("g") + (n // groups - 1) * groups)
        right = F.col("s") == last - (F.col("rank_no") - 1) * groups
        found = best.agg(F.count(F.lit(1)).alias("rows"), F.sum(right.cast("int")).alias("right"), F.sum((F.col("rank_no") == 1).cast("int")).alias("firsts"), F.count_distinct("g").alias("groups")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tuple(found) == (2 * groups, 2 * groups, groups, groups)


def test_open_records_are_counted_exactly(spark, tmp_path, monkeypatch):
    """With sketches of 16 values most records stay open; a third of all rows are of one load, and some rows of it have a NULL region, year or article."""
    rng = random.Random(9)
    stamp = datetime(2024, 1, 1)
    load = lambda: 1 if rng.random() < 0.4 else rng.randrange(2, 5)
    orders = [(i, rng.randrange(3000), rng.randrange(900), rng.choice(["eu", "us", None]), rng.choice([2023, 2024, None]), stamp, load()) for i in range(4000)]
    lines = [(i, rng.randrange(3000), rng.choice(["s1", "s2", None]), rng.choice([None, *range(50)]), stamp, load()) for i in range(6000)]
    spark.createDataFrame(orders, "row_id long, id long, customer_id long, region string, year long, loaded_at timestamp, load_no long").write.parquet(f"{tmp_path}/shop_orders.parquet")
    spark.createDataFrame(lines, "line_id long, order_id long, sku string, revenue long, loaded_at timestamp, load_no long").write.parquet(f"{tmp_path}/shop_lineitem.parquet")
    stats, wrong = [], set()
    for load_no, region, year, sku in [(a, b, c, d) for a in (1, 2, 3, 9, None) for b in ("eu", None) for c in (2024, None) for d in ("s1", None)]:
        picks = []
        if sku is None:
            picks.append(("shop_orders", "customer_id", {r[2] for r in orders if r[6] == load_no and region in (None, r[3]) and year in (None, r[4])}))
        if region is None and year is None:
            picks.append(("shop_lineitem", "order_id", {r[1] for r in lines if r[5] == load_no and sku in (None, r[2])}))
        for name, column, ids in picks:
            for factor in (1.0, 1.19, 1.21, 0.81, 0.79):
                ndv = round(len(ids) * factor)
                wrong |= {len(stats)} if load_no is not None and abs(ndv - len(ids)) > 0.2 * len(ids) else set()
                stats.append((len(stats), name, column, load_no, region, year, sku, ndv))
    spark.createDataFrame(stats, "stat_id long, table_name string, column_name string, load_no long, region string, year long, sku string, ndv long").write.parquet(f"{tmp_path}/table_stats.parquet")
    monkeypatch.setattr(queries, "K", 16)
    assert {r.stat_id for r in queries.p3_found(spark, str(tmp_path)).collect()} == wrong


def test_top_lines_of_hot_orders(spark, tmp_path):
    """A third of all lines on one order and one article: the hot partition of the join is split, and the rows are those of sorting."""
    rng = random.Random(11)
    stamp = datetime(2024, 1, 1)
    region_of = lambda order: ["eu", "us", None][order % 3]
    hot = lambda x, other: x if rng.random() < 0.34 else other
    lines = [(i, hot(7, rng.randrange(400)), hot("s1", rng.choice(["s2", "s3", None])), rng.choice([None, *range(90)]), stamp, hot(1, rng.randrange(2, 4))) for i in range(40_000)]
    orders = [(i, i % 300, i, region_of(i % 300), 2024, stamp, 1) for i in range(600)]
    spark.createDataFrame(lines, "line_id long, order_id long, sku string, revenue long, loaded_at timestamp, load_no long").repartition(8).write.parquet(f"{tmp_path}/shop_lineitem.parquet")
    spark.createDataFrame(orders, "row_id long, id long, customer_id long, region string, year long, loaded_at timestamp, load_no long").write.parquet(f"{tmp_path}/shop_orders.parquet")
    groups = defaultdict(list)
    for line, order, sku, revenue, _, load in lines:
        region = region_of(order) if order < 300 else None
        if sku and region and revenue is not None:
            groups[load, region, sku].append((-revenue, line))
    want = {(line, i + 1) for g in groups.values() for i, (_, line) in enumerate(sorted(g)[:3])}
    adaptive = "spark.sql.adaptive."
    thresholds = {"spark.sql.autoBroadcastJoinThreshold": "-1", f"{adaptive}skewJoin.skewedPartitionThresholdInBytes": "20k", f"{adaptive}skewJoin.skewedPartitionFactor": "2", f"{adaptive}advisoryPartitionSizeInBytes": "10k", f"{adaptive}coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in thresholds}
    for k, v in thresholds.items():
        spark.conf.set(k, v)
    try:
        df = queries.p4_found(spark, str(tmp_path))
        got = {tuple(r) for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == want and "skew=true" in plan
