"""Last event at or before a moment, per key, without ever gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.runtime import cut


def last_before(events: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe the value of the last event of its key at or before its time.

    ``events``: ``key, at, seq, value``; ``probes``: ``key, at, seq``. Events of one key and time are ordered
    by ``seq``; an event at the probe's own time counts. Returns ``key, at, seq, value`` of the probes,
    ``value`` NULL where no event precedes. Rows with a NULL key or time get NULL (probes) or are ignored (events).
    Repeated probes are answered each by itself. ``seq`` must be unique among the events of one key and time.

    Both inputs are *range*-partitioned together by (key, time), so a key with a third of all rows spreads over
    as many tasks as it needs. Within a range the running last value is a window. Across ranges only the
    first key of a range can have begun earlier; what it carries in is one row per range, which is why that
    table may be broadcast whatever the data.
    """
    kind = events.schema["value"].dataType
    usable = events.where(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("value").isNotNull())
    both = usable.select("key", "at", F.lit(0).alias("probe"), "seq", "value").unionByName(
        probes.select("key", "at", F.lit(1).alias("probe"), "seq", F.lit(None).cast(kind).alias("value"))
    )
    ranged = cut(both.repartitionByRange("key", "at", "probe", "seq").withColumn("part", F.spark_partition_id()))

    within = Window.partitionBy("part", "key").orderBy("at", "probe", "seq").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("last", F.last("value", ignorenulls=True).over(within))

    heads = ranged.where(F.col("key").isNotNull()).groupBy("part").agg(F.min("key").alias("key"))
    ends = (
        ranged.join(F.broadcast(heads.select("key").distinct()), "key", "left_semi")
        .groupBy("part", "key")
        .agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("at", "probe", "seq"))).alias("end"))
    )
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carry", F.last("end", ignorenulls=True).over(earlier)).where(F.col("carry").isNotNull()).select("part", "key", "carry")
    # One row per range at most: a key that began in an earlier range is the smallest key of this one.
    return (
        running.where(F.col("probe") == 1)
        .join(F.broadcast(carried), ["part", "key"], "left")
        .select("key", "at", "seq", F.when(F.col("at").isNotNull(), F.coalesce("last", "carry")).alias("value"))
    )
