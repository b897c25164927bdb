"""Structured Streaming into a stored table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def stream_name(engine: Engine, checkpoint: str) -> str:
    """A name of the stream that is kept in its checkpoint folder, made there at first."""
    path = engine.spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/stream-name")
    fs = path.getFileSystem(engine.spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(uuid.uuid4().hex.encode()))
        out.close()
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def ingest(engine: Engine, table: str, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of (vin, ts, columns) to a table; rows in any order of time, none is too late.

    ``once`` takes what there is and stops. An append is named by the stream and the batch, so that a batch that is
    tried again after a failure is appended once.
    """
    name = stream_name(engine, checkpoint)
    writer = stream.writeStream.foreachBatch(lambda df, batch: engine.write_frame(table, df, f"{name}_{batch}")).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
