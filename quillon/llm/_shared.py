"""Helpers the operators of this subpackage share: scratch tables and Arrow plumbing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.shipping import packaged, shared_folder

_OWN = f"quillon-{uuid.uuid4().hex}"
_held: set[str] = set()
_ROOT = str(Path(__file__).resolve().parents[2])


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset a local session gets one of its own; a cluster is refused."""
    return shared_folder(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a Parquet table in the shared folder and read it back.

    This cuts lineage: what is read later survives lost executors, and nothing upstream runs twice. The tables of a session lie
    in one folder, which goes when the driver ends, or with `clear_scratch`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{_OWN}/{name}-{uuid.uuid4().hex}"
    if not _held:
        atexit.register(clear_scratch, spark)
    _held.add(f"{scratch_dir(spark)}/{_OWN}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that materialize has written in this session; what still reads them fails then."""
    for path in list(_held):
        with contextlib.suppress(Exception):  # the driver's JVM may be gone already
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _held.discard(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package: it is sent to executors, and local ones find it by path."""
    packaged()
    env = spark.sparkContext.environment
    held = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in held:
        env["PYTHONPATH"] = os.pathsep.join([*held, _ROOT])


def _lean(fn):
    """fn, which gives memory it no longer needs back to the machine: a worker waits for its next task beside others at work."""

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # not every C library can
            ctypes.CDLL(None).malloc_trim(0)

    return run


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """df.mapInArrow, once the workers can import what fn is made of."""
    importable(df.sparkSession)
    return df.mapInArrow(_lean(fn), schema)


def crc_fold(doc_id, modulus: int = 5):
    """crc32 of doc_id written as text, modulo: the fold a row belongs to. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets, from 0; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int):
    """Row ranges whose texts have about limit bytes together; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def annotate(df: DataFrame, compute, fields: str) -> DataFrame:
    """df with further columns that compute(batch) gives as a list of arrays, a row for each row.

    fields is DDL. A column of df that bears the name of a new one gives way to it.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields)
    kept = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in {f.name.lower() for f in new}])
    schema = StructType(kept.schema.fields + new.fields)
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(batch)], names=names)

    importable(df.sparkSession)
    return kept.mapInArrow(_lean(run), schema)
