"""Shared folder handling and Arrow helpers of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles at once; bounds a worker's memory.
CHUNK_BYTES = 2 << 20
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of ids that may be broadcast (16 bytes each at most) once counted.
BROADCAST_ROWS = 200_000
#: Used only where the session names no checkpoint folder and runs in one local process, as in tests.
OWN_CHECKPOINTS = "/tmp/checkpoints/tallyloom"
#: Keys that may be called hot at most, and rows of one key that a task always takes.
HOT_KEYS, HOT_ROWS = 4096, 1000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, which a cluster must name."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or OWN_CHECKPOINTS


def fresh_path(spark: SparkSession, name: str) -> str:
    """New path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def forget(*tables: DataFrame) -> None:
    """Remove tables written by :func:`cut` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(table.cut_path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there.

    ``batch_rows`` bounds the rows that reach a Python worker at once in this step, for
    rows that each hold a whole block. The step's shuffle files are removed when it ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before, cleaned = spark.conf.get(_BATCH_ROWS), spark.conf.get(_CLEAN_UP, "false")
    try:
        spark.conf.set(_CLEAN_UP, "true")
        if batch_rows:
            spark.conf.set(_BATCH_ROWS, str(batch_rows))
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH_ROWS, before)
        spark.conf.set(_CLEAN_UP, cleaned)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def spread_join(
    rows: DataFrame, facts: DataFrame, keys: list[str], salt: Column, how: str = "inner", counts: DataFrame | None = None
) -> DataFrame:
    """Join of ``rows`` with ``facts``, which has one row a key and in ``n`` the rows of that key, on ``keys``.

    ``facts`` is read three times, so it should be a written table or a projection of one;
    ``counts``, if given, has its keys and ``n`` and is read for the two lighter passes.

    A key is hot if it has more than ``HOT_ROWS`` rows and more than one in ``HOT_KEYS`` of all.
    So there are fewer than ``HOT_KEYS`` of them, whatever the input, and their list is broadcast;
    their rows are dealt out by the hash of ``salt`` over tasks of about that many rows each.
    """
    counted = facts if counts is None else counts
    total = counted.agg(F.sum("n")).head()[0] or 0
    share = max(HOT_ROWS, -(-total // HOT_KEYS))
    salts = F.ceil(F.col("n") / share).cast("int")
    hot = counted.filter(F.col("n") > share).select(*keys, salts.alias("_salts"))
    dealt = F.pmod(F.xxhash64(salt), F.coalesce("_salts", F.lit(1))).cast("int")
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", dealt).drop("_salts")
    right = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def small_or_plain(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows, else as it is."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(ids) if few else ids


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def chunks(
    batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes of text each, a whole row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, offs = column_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list array from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
