"""Session helpers: the shared folder and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Without the setting a local session gets a temporary folder; on a cluster, where
    such a folder would be one machine's, that is an error.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            path = tempfile.mkdtemp(prefix="skein-")
        if not path:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(path)
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a packed table's block, and of the batches it is read as.
_BLOCK, _SENT = 1 << 18, 1 << 16


def pack(table: pa.Table) -> bytes:
    """A table as compressed columns, its rows in the order of the first two (numbers)."""
    order = np.lexsort([table.column(i).to_numpy() for i in reversed(range(min(2, table.num_columns)))])
    out = pa.BufferOutputStream()
    pq.write_table(table.take(pa.array(order)), out, compression="zstd", write_statistics=False)
    return out.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    return pq.read_table(pa.BufferReader(blob), use_threads=False)


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _BLOCK:
            yield pa.RecordBatch.from_arrays([pa.array([pack(pa.Table.from_batches(held))], pa.binary())], ["blob"])
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([pack(pa.Table.from_batches(held))], pa.binary())], ["blob"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0):
            yield from unpack(blob.as_py()).to_batches(max_chunksize=_SENT)


def cut_packed(df: DataFrame) -> DataFrame:
    """``cut`` of many narrow rows of numbers: stored as blocks of compressed columns, a
    tenth of what the rows take. The rows come back in another order."""
    return cut(df.mapInArrow(_blobs, "blob binary")).mapInArrow(_rows, df.schema)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; whoever asks for it deletes it."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
