"""File and connector sources, and response sinks.

Recognition, orientation and barcode engines are pluggable: a connector is a function on
Arrow batches that :func:`recognise` or :func:`decode_stamps` runs over the image files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import schemas

Connector = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def read_files(spark: SparkSession, path: str, *, source: str = "file", content_type: Column | None = None) -> DataFrame:
    """Files under ``path`` in the shape of ``schemas.FILES``; ids are hashes of the paths.

    Spark's reader passes over files without bytes. Where these must be answered, left join a
    list of what was received with this table; the file gate takes a null length as empty.
    """
    raw = spark.read.format("binaryFile").load(path)
    name = F.substring_index("path", "/", -1)
    extension = F.lower(F.substring_index(name, ".", -1))
    guessed = F.when(extension.isin("jpg", "jpeg"), "image/jpeg").when(extension.isin("png", "webp"), F.concat(F.lit("image/"), extension))
    return raw.select(
        F.xxhash64("path").alias("doc_id"), name.alias("filename"), (guessed if content_type is None else content_type).alias("content_type"),
        "length", "content", F.lit(source).alias("source"),
    )


def recognise(files: DataFrame, connector: Connector) -> DataFrame:
    """Words that a recognition engine finds in ``doc_id, content``, in the shape of ``schemas.OCR_WORDS``."""
    return files.select("doc_id", "content").mapInArrow(connector, schemas.OCR_WORDS)


def decode_stamps(files: DataFrame, connector: Connector) -> DataFrame:
    """Stamp payloads that a barcode engine finds in ``doc_id, content``, in the shape of ``schemas.TED``."""
    return files.select("doc_id", "content").mapInArrow(connector, schemas.TED)


def write_responses(responses: DataFrame, path: str, *, form: str = "json", mode: str = "errorifexists") -> None:
    """Writes responses as JSON lines or Parquet."""
    options = {"ignoreNullFields": "false"} if form == "json" else {}
    responses.write.mode(mode).options(**options).format(form).save(path)
