"""Stamps that come after the reading: a stream-stream outer join, and ratings made anew.

A read document waits for stamps until ``wait`` after it was received. Each stamp that comes in time gives the
document a new rating at once, and a document without any gets its own when the watermark tells that none
can come any more. Both sides have a watermark and the join bounds the time between them, so state holds
the documents and stamps of that time only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.config import Settings
from tallyloom.operators.ted import override, readable


def await_stamps(best: DataFrame, stamps: DataFrame, *, wait: str = "300 seconds", delay: str = "30 seconds") -> DataFrame:
    """A stream of ``best`` rows with ``rank``, what a stamp that came in time says, or null where none came.

    ``best`` is a stream of scored rows with ``received``, ``stamps`` one of ``doc_id, ted_text, stamped_at``. A stamp
    is in time from ``received`` to ``wait`` later. Rows of either may arrive ``delay`` late. Stamps without
    date and total are left out; rows with a null ``doc_id`` are heartbeats, which only tell the time.
    """
    held = stamps.withWatermark("stamped_at", delay)
    # Naming the time in each column keeps filters on them above the watermark, which heartbeats are there to move.
    timed = [F.when(F.col("stamped_at").isNotNull(), F.col(c)).alias(c) for c in ("doc_id", "ted_text")]
    told = readable(held.select(*timed, "stamped_at"), "stamped_at").withColumnRenamed("doc_id", "_doc")
    in_time = F.expr(f"doc_id = _doc and stamped_at >= received and stamped_at <= received + interval {wait}")
    return best.withWatermark("received", delay).join(told, in_time, "left").drop("_doc", "stamped_at")


def rate_stream(
    best: DataFrame, stamps: DataFrame, out: str, checkpoint: str, settings: Settings | None = None, *, wait: str = "300 seconds",
    delay: str = "30 seconds", once: bool = False,
) -> StreamingQuery:
    """Appends each rating under ``out``, one folder a micro-batch; :func:`current_ratings` tells those that hold.

    A batch repeated after a failure replaces what it wrote.
    """

    def answer(batch: DataFrame, number: int) -> None:
        rows = batch.filter("doc_id is not null").drop("received")
        rated = override(rows.withColumn("_rank", F.col("rank")), settings)
        rated.withColumnRenamed("_rank", "rank").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = await_stamps(best, stamps, wait=wait, delay=delay).writeStream.option("checkpointLocation", checkpoint).foreachBatch(answer)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_ratings(ratings: DataFrame) -> DataFrame:
    """One row per document of what :func:`rate_stream` wrote: the rating by the stamp that counts, or the one without."""
    columns = [c for c in ratings.columns if c not in ("doc_id", "rank", "batch")]
    order = F.struct(F.col("rank").isNull().alias("bare"), "rank")
    best = ratings.groupBy("doc_id").agg(F.min_by(F.struct(*columns), order).alias("row"))
    return best.select("doc_id", *[F.col(f"row.`{c}`").alias(c) for c in columns])
