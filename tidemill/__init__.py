"""A SQL and data-processing engine on PySpark."""

from tidemill.engine import execute, explain, explain_analyze, sql
from tidemill.errors import EngineError
from tidemill.sources.catalog import Catalog
from tidemill.sources.snapshots import SnapshotTable

__all__ = ["Catalog", "EngineError", "SnapshotTable", "execute", "explain", "explain_analyze", "sql"]
