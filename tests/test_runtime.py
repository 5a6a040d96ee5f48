"""Lineage cuts, the shared folder and its clearing."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemill import EngineError, runtime


def test_cut_and_clear(spark):
    df = runtime.cut(spark.range(10).withColumn("r", F.rand()))
    assert df.collect() == df.collect() and "FileScan" in df._jdf.queryExecution().executedPlan().toString()
    empty = runtime.cut(spark.range(0).select(F.lit(None).cast("array<struct<a: int>>").alias("x")))
    assert empty.count() == 0 and empty.schema["x"].dataType.simpleString() == "array<struct<a:int>>"
    folder = f"{runtime.shared_dir(spark)}/tidemill/{spark.sparkContext.applicationId}".removeprefix("file://")
    assert os.listdir(folder)
    runtime.clear(spark)
    assert not os.path.exists(folder)


def test_working_removes_what_it_wrote(spark):
    kept = runtime.cut(spark.range(3))
    with runtime.working(spark):
        inner = runtime.cut(spark.range(4))
        with runtime.working(spark):
            runtime.cut(spark.range(5))
        assert inner.count() == 4
        path = inner.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert kept.count() == 3 and not os.path.exists(path)


def test_the_cluster_names_the_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs://shared/work/" if key == "spark.checkpoint.dir" else default))
    assert runtime.shared_dir(session) == "hdfs://shared/work"


def test_a_cluster_has_to_name_a_folder():
    unset = SimpleNamespace(get=lambda key, default=None: default)
    session = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: unset))
    with pytest.raises(EngineError, match="spark.checkpoint.dir"):
        runtime.shared_dir(session)


def test_ship_once(spark):
    runtime.ship(spark)
    runtime.ship(spark)
    assert spark.sparkContext.applicationId in runtime._SHIPPED


@pytest.mark.parametrize("name", ["entry", "queries", "oracle_sql"])
def test_driver_contract(spark, name):
    import __spark_entry__ as e

    if name == "entry":
        assert e.entry(spark).count() == 3
    else:
        assert set(e.oracle_sql()) <= set(e.queries()) and len(getattr(e, name)()) > 60
