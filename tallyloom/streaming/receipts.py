"""Receipts as they arrive. A receipt is complete in itself, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyloom import schemas
from tallyloom.config import Settings
from tallyloom.operators.pipeline import scan


def read_words(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of word tables that arrive as Parquet files, whole receipts to a file."""
    return spark.readStream.schema(schemas.OCR_WORDS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scan_stream(words: DataFrame, out: str, checkpoint: str, settings: Settings | None = None, once: bool = False) -> StreamingQuery:
    """Answers each micro-batch of words with responses appended under ``out``, once per batch id.

    A batch is written to a folder of its own, so a batch that is repeated after a failure
    replaces what it wrote before.
    """

    def answer(batch: DataFrame, number: int) -> None:
        scan(batch, settings=settings).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = words.writeStream.option("checkpointLocation", checkpoint).foreachBatch(answer)
    return (writer.trigger(availableNow=True) if once else writer).start()
