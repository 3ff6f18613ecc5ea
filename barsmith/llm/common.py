"""Shared plumbing of the text operators: inputs, written intermediate tables and Arrow helpers.

Nothing here looks at a cluster's local disk.  Inputs are read by Spark alone and intermediate tables go to the
folder named by ``spark.checkpoint.dir``, so that the loss of an executor costs the recomputation of its tasks only.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that are worked on at a time.  Spark bounds the bytes of an Arrow batch; texts are cut further by bytes (``groups``).
BATCH_ROWS = 256
#: Bytes of an Arrow batch while a table is written; the session's own setting comes back afterwards.
BATCH_BYTES, _BYTES = 1 << 23, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Shuffle files of a table that is being written go as soon as it stands, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folder, below that of the application, of tables that are written now.
_FOLDER: contextvars.ContextVar[str] = contextvars.ContextVar("folder", default="tables")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(batches) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``BATCH_ROWS`` rows, whatever the session's size of a batch."""
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(a, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that driver and executors share.

    Where none is set, a local master has a temporary one (all run on one machine), as in tests; on a cluster that is an
    error, because executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="barsmith-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/barsmith-{spark.sparkContext.applicationId}"


def written(df: DataFrame, what: str, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{folder or _FOLDER.get()}/{what}-{uuid.uuid4().hex}"
    own = {_BYTES: str(BATCH_BYTES), _CLEANUP: "true"}
    before = {name: spark.conf.get(name, None) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, folder: str = "") -> None:
    """Remove this application's intermediate tables, once the results that read them are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{folder}".rstrip("/"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are written inside go to a folder of their own, which is removed at the end; what is given writes one that stays."""
    folder, outside = f"scratch-{uuid.uuid4().hex}", _FOLDER.get()
    before = _FOLDER.set(folder)
    try:
        yield lambda df, what: written(df, what, outside)
    finally:
        _FOLDER.reset(before)
        drop_written(spark, folder)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the table has such a column, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions_for(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, for exchanges that name a number."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last
