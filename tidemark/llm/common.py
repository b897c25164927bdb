"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows, and bytes of Arrow data, that a map handles at once; a single row may be larger.
SLICE, SLICE_BYTES = 512, 16 << 20
#: Words are maximal runs of anything but these bytes; ``bytes.split()`` splits on just them.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, shared by the cluster.

    Where the session names none a folder of our own is set, but only on one machine: on a cluster the driver's
    local folder isn't the executors', so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Folders that ``written`` made, by application.
_MADE: dict[str, list[str]] = {}


#: Tasks that write a table of known size, at least, and rows of each above that.
WRITERS, WRITER_ROWS = 16, 100_000


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows as Parquet in the shared folder, read again: cuts the lineage, and survives lost executors.

    Of at most so many ``rows`` few files are made however many partitions there are: without its native library, Hadoop starts a
    process for each file on a local disk.
    """
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(max(WRITERS, -(-rows // WRITER_ROWS)))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.parquet(path)


def made(spark: SparkSession) -> tuple[str, ...]:
    """The folders that ``written`` has made in this application and that are still there, in order."""
    return tuple(_MADE.get(spark.sparkContext.applicationId, ()))


def discard(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete folders that ``written`` has made, once every result that reads them has been used.

    Operators return lazy rows, so only their callers know when that is.
    """
    for path in folders:
        _MADE[spark.sparkContext.applicationId].remove(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(batch: pa.RecordBatch, rows: int = SLICE, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch in order, of at most so many rows and, unless a single row has more, so many bytes."""
    for at in range(0, batch.num_rows, rows):
        yield from _halved(batch.slice(at, rows), most)


def _halved(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows > 1 and batch.nbytes > most:
        half = batch.num_rows // 2
        yield from _halved(batch.slice(0, half), most)
        yield from _halved(batch.slice(half), most)
    else:
        yield batch


#: What a worker process keeps for the tasks of one stage, and that stage.
_KEPT: dict = {}


def trim() -> None:
    """Give memory that is free back to the system: Arrow's pool and, where there is one, glibc's heap keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def release() -> None:
    """Drop what the worker process keeps from another stage, and give free memory back: called where a task begins."""
    stage = (context := TaskContext.get()) and context.stageId()
    if _KEPT.get("stage") != stage:
        _KEPT.clear()
        _KEPT["stage"] = stage
        gc.collect()
    trim()


def kept(name: str, make: Callable[[], object]):
    """An object that all tasks of a stage in one worker process share, made by the first."""
    release()
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Each Arrow batch of ``df``, in slices, through ``make()``, which is called once a task.

    Slices bound what a task holds as Python objects and what one Arrow array holds, whatever the session's batch size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        each = make()
        for batch in batches:
            yield from map(each, slices(batch))

    return df.mapInArrow(run, schema)


def utf8(text: str | None) -> bytes:
    """A text's UTF-8 bytes; null counts as empty."""
    return b"" if text is None else text.encode()
