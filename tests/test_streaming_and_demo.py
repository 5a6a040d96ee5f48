"""Streams into snapshot tables, streams through the dialect, and the demo shop."""

from pyspark.sql import functions as F

from tidemill import Catalog, SnapshotTable, sql
from tidemill.demo import Shop
from tidemill.streaming.append import append_stream


def test_append_stream(spark, tmp_path):
    table = SnapshotTable.create(spark, tmp_path / "t", ["id:int"])
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(source))
    append_stream(stream, table, "w", str(tmp_path / "state"), availableNow=True).awaitTermination()
    assert sorted(r.id for r in table.read().collect()) == list(range(30)) and table.version == 3
    assert table.append([(99,)], once=("w", 2)) == 3 and table.version == 3  # the batch is in the log
    assert table.append([(99,)], once=("other", 0)) == 4
    table.overwrite([(1,)])
    assert table.append([(5,)], once=("w", 1)) == 5
    # a new run of the same stream appends nothing again
    append_stream(stream, table, "w", str(tmp_path / "state"), availableNow=True).awaitTermination()
    assert table.version == 5


def test_streaming_query(spark, tmp_path):
    (tmp_path / "e").mkdir()
    spark.range(20).select(F.col("id"), (F.col("id") % 3).alias("k")).write.mode("append").parquet(str(tmp_path / "e"))
    catalog = Catalog(spark)
    catalog.register_frame("e", spark.readStream.schema("id long, k long").parquet(str(tmp_path / "e")))
    counted = sql(catalog, "SELECT k, COUNT(*) AS n, SUM(id) AS s FROM e WHERE NOT id = 0 GROUP BY k")
    query = counted.writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("live").collect()} == {(0, 6, 63), (1, 7, 70), (2, 6, 57)}


def test_demo_shop(spark, tmp_path):
    shop = Shop(spark, tmp_path / "orders")
    assert [h["operation"] for h in shop.history()] == ["CREATE", "APPEND", "APPEND", "APPEND", "OVERWRITE", "RESTORE"]
    assert [h["rows"] for h in shop.history()] == [0, 600, 1200, 1800, 1200, 1800]
    tiers = dict(shop.catalog.get("customers").frame.groupBy("c2").count().collect())
    assert tiers == {"platinum": 2, "gold": 18, "silver": 60, "bronze": 120}
    presets = shop.presets()
    found = shop.run(presets["skewed tier"])
    assert len(found["rows"]) == 2 and found["plan"]["children"][0]["estimated_rows"] == 50
    for text in presets.values():
        a, b = shop.run(text), shop.run(text, reorder=False, pushdown=False)
        assert sorted(map(str, a["rows"])) == sorted(map(str, b["rows"])) and a["rows"]
    assert shop.run(presets["years"], version=1)["rows"] == [[2023, 600]]
    assert shop.append_orders() == 6 and shop.run(presets["years"])["rows"][-1] == [2026, 200]
    assert shop.run("SELECT nope FROM orders") == {"error": "unknown column nope"}
    assert "no version" in shop.run(presets["years"], version=77)["error"]
