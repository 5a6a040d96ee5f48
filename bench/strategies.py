"""Compare strategies on generated tables: hash join and nested loop, filters below and above a join, chosen and written join order.

    python bench/strategies.py [--sizes 20000 100000 1000000] [--repeat 3]

Every figure is the best of the runs of a whole query, planning and statistics included, after one run to compile. The tables are
written to a temporary folder first, so that scans are part of it. Spark has a fixed cost per job; sizes below about 100,000 rows show little else.
"""

from __future__ import annotations

import argparse
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import functions as F  # noqa: E402

from tidemill import Catalog, engine  # noqa: E402
from tidemill.plans.nodes import NestedLoopJoin  # noqa: E402
from tidemill.runtime import local_session  # noqa: E402

#: Pairs the nested loop may compare; beyond it is left out.
MOST_PAIRS = 2_000_000_000


def tables(spark, orders: int) -> Catalog:
    """orders with four lines each in random order; facts with a key into 200 rows and one into 50."""
    path = tempfile.mkdtemp(prefix="tidemill-")
    order = F.xxhash64("id")
    frames = {
        "o": spark.range(orders).select("id", F.concat(F.lit("r"), F.col("id") % 7).alias("region"), (F.col("id") % 2 + 2023).alias("year")).orderBy(order),
        "l": spark.range(4 * orders).select(F.pmod(order, F.lit(orders)).alias("order_id"), F.concat(F.lit("s"), F.col("id") % 9).alias("sku"), (F.col("id") % 100).alias("revenue")),
        "f": spark.range(orders).select("id", (F.col("id") % 200).alias("dim_id"), (F.col("id") % 50).alias("tiny_id"), F.col("id").alias("amount")),
        "d": spark.range(200).select("id", F.concat(F.lit("d"), "id").alias("label")),
        "t": spark.range(50).select("id", F.concat(F.lit("t"), "id").alias("label")),
    }
    catalog = Catalog(spark)
    for name, frame in frames.items():
        frame.write.parquet(f"{path}/{name}")
        catalog.load_parquet(name, f"{path}/{name}")
    return catalog


def timed(catalog: Catalog, text: str, repeat: int, nested: bool = False, **options) -> float:
    took = []
    for _ in range(repeat + 1):
        catalog.stats.clear()
        began = time.perf_counter()
        root = engine.compile_sql(catalog, text, **options)
        if nested:
            join = root.children[0]
            root.children = (NestedLoopJoin(join.scope, join.children, join.left_key, join.right_key),)
        with engine._dialect(catalog.spark):
            engine._named(root, root.frame()).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return min(took[1:])


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--sizes", type=int, nargs="+", default=[20_000, 100_000, 1_000_000])
    p.add_argument("--repeat", type=int, default=3)
    args = p.parse_args()
    spark = local_session("strategies", cores=8, memory="12g", shuffle="8")
    spark.sparkContext.setLogLevel("ERROR")
    join = "SELECT o.region, l.revenue FROM o JOIN l ON o.id = l.order_id"
    star = "SELECT f.id, d.label FROM f JOIN d ON f.dim_id = d.id JOIN t ON f.tiny_id = t.id WHERE t.id = 1"
    print("| orders | hash join | nested loop | filter below / above | order chosen / written |\n|---|---|---|---|---|")
    for n in args.sizes:
        c = tables(spark, n)
        loop = f"{timed(c, join, 1, nested=True):.2f} s" if 4 * n * n <= MOST_PAIRS else "left out"
        pushed = [timed(c, f"{join} WHERE o.year = 2024", args.repeat, pushdown=on) for on in (True, False)]
        order = [timed(c, star, args.repeat, reorder=on) for on in (True, False)]
        print(f"| {n:,} | {timed(c, join, args.repeat):.2f} s | {loop} | {pushed[0]:.2f} s / {pushed[1]:.2f} s | {order[0]:.2f} s / {order[1]:.2f} s |", flush=True)


if __name__ == "__main__":
    main()
