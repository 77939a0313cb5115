"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_own_folder: list[str] = []
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local folder of our own stands in only for a local session without the setting, as in tests,
    and goes when Python ends. On a cluster executors would not see it: there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not _own_folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lumenlake-")
        atexit.register(shutil.rmtree, own, True)
        _own_folder.append(f"file://{own}")
    return _own_folder[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends here.

    A lost executor costs nothing that was stored, and later readers see one fixed result.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables are stored so far."""
    return len(_written)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the tables stored after the first ``since``, but the last ``keep``.

    Call it once nothing reads them any more.
    """
    gone = _written[since : len(_written) - keep]
    del _written[since : since + len(gone)]
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each slice holds about ``limit`` bytes of ``column`` (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


#: Rows of texts that one Arrow batch may hold. Spark's own 10,000 make batches of any size.
BATCH_ROWS = 500


def map_texts(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for rows that carry texts.

    Batches have at most ``BATCH_ROWS`` rows: the session's limit is lowered to that, since a batch
    is held whole by the executor and by its worker. After a task the worker, which stays for
    later stages, gives back what it freed.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(trimmed, schema)


def give_back() -> None:
    """Returns free memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def with_fields(df: DataFrame, keep: list[str], **fields: str) -> T.StructType:
    """The schema of ``keep`` as in ``df``, then ``fields`` given as name=DDL type."""
    out = T.StructType([df.schema[c] for c in keep])
    for name, ddl in fields.items():
        out = out.add(name, T._parse_datatype_string(ddl), True)
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def arrow_batch(batch: pa.RecordBatch, keep: list[str], **columns: pa.Array) -> pa.RecordBatch:
    """``keep`` of the batch and the new columns."""
    return pa.RecordBatch.from_arrays(
        [batch.column(c) for c in keep] + list(columns.values()), names=[*keep, *columns]
    )
