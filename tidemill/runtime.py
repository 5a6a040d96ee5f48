"""Session-level helpers: table access, lineage cuts and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemill.errors import EngineError

_LOCAL_DIRS: dict[str, str] = {}
_SCOPES: list[str] = []


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory; columns and filters are pruned by the scan."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, for data that cuts a lineage.

    ``spark.checkpoint.dir`` names it. Only where that is unset on a single machine, as in tests, a
    temporary folder is made and removed at exit; on a cluster it has to be set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise EngineError("spark.checkpoint.dir must name a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tidemill-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return "file://" + _LOCAL_DIRS[app]


def working_path(spark: SparkSession) -> str:
    """A new path in the shared folder; ``working`` and ``clear`` remove it."""
    scope = f"/{_SCOPES[-1]}" if _SCOPES else ""
    return f"{shared_dir(spark)}/tidemill/{spark.sparkContext.applicationId}{scope}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    A lost executor costs a re-read instead of a recomputation, a result that is read several times is
    computed once, and the plan above starts with a plain file scan, whose shuffle adaptive execution
    may split when a key is skewed.
    """
    spark = df.sparkSession
    path = working_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, within: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemill/{spark.sparkContext.applicationId}{within}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what ``cut`` writes within. A DataFrame an operator returned inside must be written or collected there."""
    _SCOPES.append(uuid.uuid4().hex)
    try:
        yield
    finally:
        _remove(spark, f"/{_SCOPES.pop()}")


def clear(spark: SparkSession) -> None:
    """Remove what ``cut`` has written for this application. DataFrames that came from an operator must not be used after it."""
    _remove(spark, "")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions that run in Python workers are found by import there; a worker need not have the package installed, nor
    start in its folder.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidemill-")) / "tidemill.zip"
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def local_session(app: str = "tidemill", cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A single-machine session with the settings the engine is tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(conf.pop("shuffle", None) or os.cpu_count() or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
