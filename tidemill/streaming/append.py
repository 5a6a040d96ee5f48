"""Appending a stream to a snapshot table, each micro-batch exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemill.sources.snapshots import SnapshotTable


def append_stream(stream: DataFrame, table: SnapshotTable, writer: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that appends every micro-batch as one version of ``table``.

    ``writer`` names the stream in the table's log. A batch that Spark runs again after a failure is recognised there and
    not appended twice; readers of any version see whole batches only. ``checkpoint`` is the stream's own state folder, ``trigger`` goes to
    ``DataStreamWriter.trigger``. Empty batches make no version.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.append(batch, once=(writer, number))

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()
