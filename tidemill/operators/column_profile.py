"""Column-level quality profile of numbered loads.

Everything is derived from two mergeable aggregates, each written once: the count of every distinct value
per (table, load, column), and above it the count of every *mask*, the value's character-class pattern
(``north-west`` → ``a-a``, ``hinge-02`` → ``a-9``). A value shared by a third of all rows is one row of the first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.runtime import cut

KEYS = ["table_name", "load_no", "column_name"]
#: A mask with a smaller share of a column's values, over all loads, is rare.
RARE_SHARE = 0.01
#: Shares are added up in floating point.
ROUNDING = 1e-9
#: Microseconds since 1970 between which the year of a timestamp has four digits in any time zone: 1000-02-01 to 9999-01-01.
FOUR_DIGITS = (-30_607_372_800_000_000, 253_370_764_800_000_000)


@dataclass(frozen=True)
class Profile:
    """``values``: KEYS + ``num, txt, n``, the value in one of the two; ``masks``: KEYS + ``mask, ndv, n, n_out, n_off, lo, hi, example``; ``limits``: the declared limits;
    ``bare``: ``table_name, load_no, true_rows`` of the tables without a profiled column; ``tables``: the names of all."""

    values: DataFrame
    masks: DataFrame
    limits: list[Row]
    bare: DataFrame
    tables: list[str]


def mask_of(value: Column) -> Column:
    """Character-class mask: runs of upper-case letters, lower-case letters, digits, spaces and other letters become ``A a 9 _ x``."""
    out = F.regexp_replace(value, r"[\p{Lo}\p{Lt}\p{Lm}]+", "\u0001")
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{Nd}+", "9"), (r"\s+", "_"), ("\u0001", "x")):
        out = F.regexp_replace(out, pattern, sign)
    return out


def _of(table: str, column: str) -> Column:
    return (F.col("table_name") == table) & (F.col("column_name") == column)


def _compact(kind: T.DataType) -> bool:
    """Whether the values of a type are counted as 8-byte numbers: integers, and timestamps as microseconds."""
    return isinstance(kind, T.IntegralType | T.TimestampType)


def profile_loads(tables: dict[str, DataFrame], limits: DataFrame, load: str = "load_no", limited: bool = False) -> Profile:
    """Count values and masks of every column of each table but the load itself, per load; with ``limited`` just those that have limits.

    ``limits`` holds one row per column with ``table_name, column_name, max_null_rate, min_value, max_value,
    value_pattern, max_bad_rate, min_distinct, max_shift``, NULL for no limit. It is configuration of a fixed number of
    columns and is collected. Rows of it that name a table or column not given are ignored.

    Rows with a NULL load form a load of their own. An empty table has no loads and gives no rows. Repeated rows count each. Columns
    are compared by their text, so any atomic type will do; integers and other numbers are ranged by value, timestamps by their microseconds since 1970.
    """
    known = [r for r in limits.collect() if r["table_name"] in tables and r["column_name"] in tables[r["table_name"]].columns]
    counts, bare = [], []
    for name, df in tables.items():
        columns = list(dict.fromkeys(r["column_name"] for r in known if r["table_name"] == name)) if limited else [c for c in df.columns if c != load]
        kinds = {c: df.schema[c].dataType for c in columns}
        if not columns:
            bare.append(df.groupBy(F.col(load).alias("load_no")).agg(F.count(F.lit(1)).alias("true_rows")).select(F.lit(name).alias("table_name"), "load_no", "true_rows"))
        for compact in (True, False):
            own = [c for c in columns if _compact(kinds[c]) == compact]
            if own:
                plain = [(F.unix_micros(c) if isinstance(kinds[c], T.TimestampType) else F.col(c)).cast("bigint" if compact else "string") for c in own]
                tall = df.select(F.col(load).alias("load_no"), *[v.alias(f"c{i}") for i, v in enumerate(plain)]).unpivot(["load_no"], [f"c{i}" for i in range(len(own))], "place", "value")
                named = reduce(lambda acc, ic: F.when(F.col("place") == f"c{ic[0]}", F.lit(ic[1])).otherwise(acc), enumerate(own), F.lit(None).cast("string"))
                grouped = tall.groupBy("load_no", "place", "value").agg(F.count(F.lit(1)).alias("n"))
                sides = (F.col("value"), F.lit(None).cast("string")) if compact else (F.lit(None).cast("bigint"), F.col("value"))
                counts.append(grouped.select(F.lit(name).alias("table_name"), "load_no", named.alias("column_name"), sides[0].alias("num"), sides[1].alias("txt"), "n"))
    spark = limits.sparkSession
    values = cut(reduce(DataFrame.unionByName, counts)) if counts else spark.createDataFrame([], "table_name string, load_no bigint, column_name string, num bigint, txt string, n bigint")

    times = reduce(lambda a, b: a | b, [_of(t, c) for t, df in tables.items() for c in df.columns if isinstance(df.schema[c].dataType, T.TimestampType)], F.lit(False))
    text = F.coalesce("txt", F.when(times, F.timestamp_micros("num").cast("string")).otherwise(F.col("num").cast("string")))
    # What ``mask_of`` makes of integers, and of timestamps whose year has four digits.
    of_time = F.when(F.col("num").between(*FOUR_DIGITS), F.when(F.col("num") % 1_000_000 == 0, "9-9-9_9:9:9").otherwise("9-9-9_9:9:9.9")).otherwise(mask_of(F.col("value")))
    mask = F.when(F.col("num").isNull(), mask_of(F.col("value"))).when(times, of_time).when(F.col("num") < 0, "-9").otherwise("9")
    number, out, off = F.col("num").cast("decimal(38,6)"), F.lit(False), F.lit(False)
    for r in known:
        here, kind = _of(r["table_name"], r["column_name"]), tables[r["table_name"]].schema[r["column_name"]].dataType
        if isinstance(kind, T.NumericType):
            low, high = r["min_value"], r["max_value"]
            beyond = reduce(lambda a, b: a | b, [F.col("number") < low] * (low is not None) + [F.col("number") > high] * (high is not None), F.lit(False))
            # A value too large for the number type lies outside any range; without a limit nothing does.
            lost = F.col("number").isNull() & F.col("value").isNotNull() & F.lit(low is not None or high is not None)
            out = F.when(here, F.coalesce(beyond, F.lit(False)) | lost).otherwise(out)
        if r["value_pattern"] is not None:
            off = F.when(here, ~F.col("value").rlike(rf"\A(?:{r['value_pattern']})\z")).otherwise(off)
    for name, df in tables.items():
        for c in df.columns:
            if isinstance(df.schema[c].dataType, T.NumericType) and not _compact(df.schema[c].dataType):
                number = F.when(_of(name, c), F.col("txt").try_cast("decimal(38,6)")).otherwise(number)
    judged = values.withColumn("value", text).withColumns({"number": number, "mask": mask}).withColumns({"out": out, "off": F.coalesce(off, F.lit(False))})
    masks = judged.groupBy(*KEYS, "mask").agg(
        F.count("value").alias("ndv"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("out"), F.col("n")).otherwise(0)).alias("n_out"),
        F.sum(F.when(F.col("off"), F.col("n")).otherwise(0)).alias("n_off"),
        F.min("number").alias("lo"),
        F.max("number").alias("hi"),
        F.min("value").alias("example"),
    )
    rows = reduce(DataFrame.unionByName, bare) if bare else spark.createDataFrame([], "table_name string, load_no bigint, true_rows bigint")
    return Profile(values, cut(masks), known, rows, list(tables))


def _totals(profile: Profile) -> DataFrame:
    """One row per KEYS, merged from the masks."""
    null = F.col("mask").isNull()
    return profile.masks.groupBy(*KEYS).agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(null, F.col("n")).otherwise(0)).alias("null_count"),
        F.sum("ndv").alias("ndv"),
        F.sum("n_out").alias("n_out"),
        F.sum("n_off").alias("n_off"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )


def _shift(counts: DataFrame, what: list[str], totals: DataFrame) -> DataFrame:
    """Half the summed difference between the shares of each ``what`` in a load and in the load before, where both have values.

    Each count is sent to its own load and to the next, where one aggregation brings both together: no
    self-join, and the counts combine before the shuffle. Numbers outside the range of the other load cannot occur in it, so their shares
    are added up without being sent: unique columns, whose loads mostly follow each other, cost next to nothing here.
    """
    n = counts.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in what]))
    filled = totals.where(F.col("row_count") > F.col("null_count")).select(*KEYS, (F.col("row_count") - F.col("null_count")).alias("size"), F.col("lo").cast("bigint").alias("least"), F.col("hi").cast("bigint").alias("most"))
    zero = F.lit(0).cast("bigint")
    if "num" in what:
        before, after = (filled.select("table_name", (F.col("load_no") + step).alias("load_no"), "column_name", "least", "most") for step in (1, -1))
        shared = F.coalesce(F.col("num").between(F.col("least"), F.col("most")), F.lit(True))
        was_there, is_there = n.join(before, KEYS).where(shared), n.join(after, KEYS).where(shared)
    else:
        was_there = is_there = n
    own = was_there.select(*KEYS, *what, F.col("n").alias("now"), zero.alias("was"))
    later = is_there.select("table_name", (F.col("load_no") + 1).alias("load_no"), "column_name", *what, zero.alias("now"), F.col("n").alias("was"))
    sides = own.unionByName(later).groupBy(*KEYS, *what).agg(F.sum("now").alias("now"), F.sum("was").alias("was"))
    both = filled.join(filled.select("table_name", (F.col("load_no") + 1).alias("load_no"), "column_name", F.col("size").alias("size_was")), KEYS).drop("least", "most")
    met = sides.join(both.select(*KEYS, "size", "size_was"), KEYS).groupBy(*KEYS).agg(F.sum(F.abs(F.col("now") / F.col("size") - F.col("was") / F.col("size_was"))).alias("moved"), F.sum("now").alias("now"), F.sum("was").alias("was"))
    apart = (F.col("size") - F.coalesce("now", zero)) / F.col("size") + (F.col("size_was") - F.coalesce("was", zero)) / F.col("size_was")
    return both.join(met, KEYS, "left").select(*KEYS, ((F.coalesce("moved", F.lit(0.0)) + apart) / 2).alias("shift"))


def describe(profile: Profile) -> DataFrame:
    """The profile of each column of each load: rows, NULLs, distinct values, range, shift of values and of masks against the load before."""
    totals = cut(_totals(profile))
    shift = _shift(profile.values, ["num", "txt"], totals)
    masks = _shift(profile.masks, ["mask"], totals).withColumnRenamed("shift", "mask_shift")
    return totals.join(shift, KEYS, "left").join(masks, KEYS, "left").select(
        *KEYS, "row_count", "null_count", "ndv", F.col("lo").cast("bigint").alias("min_value"), F.col("hi").cast("bigint").alias("max_value"), F.round("shift", 9).alias("shift"), F.round("mask_shift", 9).alias("mask_shift")
    )


def rare_masks(profile: Profile, rare: float = RARE_SHARE) -> DataFrame:
    """Masks of a column that are rare over all loads, with the loads they occur in, their number and an example.

    Masks with at least ``rare`` of the column's non-NULL values are its dominant patterns; the others break them.
    """
    n = profile.masks.where(F.col("mask").isNotNull())
    column = ["table_name", "column_name"]
    overall = n.groupBy(*column, "mask").agg(F.sum("n").alias("of_mask"))
    whole = n.groupBy(*column).agg(F.sum("n").alias("of_column"))
    overall = overall.join(whole, column).withColumn("share", F.col("of_mask") / F.col("of_column"))
    odd = overall.where(F.col("share") < rare).select("table_name", "column_name", "mask", F.round("share", 9).alias("share"))
    return n.join(odd, ["table_name", "column_name", "mask"]).select("table_name", "load_no", "column_name", "mask", "n", "example", "share")


def broken_limits(profile: Profile, stats: DataFrame) -> DataFrame:
    """(table_name, load_no, column_name, check_name) of each limit a load breaks, and of each wrong recorded row count.

    ``stats``: recorded ``table_name, column_name, load_no, region, year, sku, row_count``; only unrestricted
    records of the given tables, with limits or without, are held against the load's rows; a load that is not there has 0 rows; a NULL count is no case.
    """
    totals = cut(_totals(profile))
    filled = F.col("row_count") - F.col("null_count")
    found = []
    for r in profile.limits:
        here = totals.where(_of(r["table_name"], r["column_name"]))
        checks = []
        if r["max_null_rate"] is not None:
            checks.append(F.when(F.col("null_count") / F.col("row_count") > r["max_null_rate"], "null_rate"))
        if r["max_bad_rate"] is not None:
            if r["min_value"] is not None or r["max_value"] is not None:
                checks.append(F.when((filled > 0) & (F.col("n_out") / filled > r["max_bad_rate"]), "value_range"))
            if r["value_pattern"] is not None:
                checks.append(F.when((filled > 0) & (F.col("n_off") / filled > r["max_bad_rate"]), "pattern"))
        if r["min_distinct"] is not None:
            checks.append(F.when(F.col("ndv") < r["min_distinct"], "few_distinct"))
        if checks:
            found.append(here.select(*KEYS, F.explode(F.array(*checks)).alias("check_name")).where(F.col("check_name").isNotNull()))
    bounded = [r for r in profile.limits if r["max_shift"] is not None]
    if bounded:
        wanted = reduce(lambda a, b: a | b, [_of(r["table_name"], r["column_name"]) for r in bounded])
        most = reduce(lambda acc, r: F.when(_of(r["table_name"], r["column_name"]), F.lit(r["max_shift"])).otherwise(acc), bounded, F.lit(None).cast("double"))
        # Masks gather values, so theirs is at most the shift of the values: where it is beyond the limit already, that settles it.
        moved = _shift(profile.masks.where(wanted), ["mask"], totals.where(wanted)).withColumnRenamed("shift", "mask_shift")
        exact = _shift(profile.values.where(wanted), ["num", "txt"], totals.where(wanted))
        broken = moved.join(exact, KEYS, "left").where((F.col("mask_shift") > most + ROUNDING) | (F.col("shift") > most))
        found.append(broken.select(*KEYS, F.lit("shift").alias("check_name")))
    loads = totals.groupBy("table_name", "load_no").agg(F.max("row_count").alias("true_rows")).unionByName(profile.bare)
    stats = stats.select(*KEYS, "region", "year", "sku", "row_count")
    whole = stats.where(F.col("region").isNull() & F.col("year").isNull() & F.col("sku").isNull() & F.col("table_name").isin(sorted(profile.tables)))
    held = whole.join(loads, ["table_name", "load_no"], "left").where(F.col("row_count") != F.coalesce("true_rows", F.lit(0)))
    found.append(held.select(*KEYS, F.lit("row_count").alias("check_name")).distinct())
    return reduce(DataFrame.unionByName, found).select("table_name", "load_no", "column_name", "check_name")
