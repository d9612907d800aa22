"""Reading attempts as they arrive: documents are closed by what has arrived, or by time.

A document's attempts are state, under the key of its bucket, until one of these closes it: an attempt that is enough and
all before it, all attempts that are allowed, a page too blurred to be read, or the event-time timer that
stands ``max_seconds`` after the document was received. Closed documents leave the stream as the rows of
their attempts, in the shape that :func:`best_attempt` takes, so choosing is the batch operator's work and
a stream answers as a batch would, in whatever order attempts arrive.

State is bounded by the documents received within ``max_seconds`` and the watermark's delay: the timer
removes what a document left, also the mark that keeps stragglers of a closed document from opening it again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tallyloom.config import Settings
from tallyloom.operators.attempts import allowed_attempts, best_attempt, is_blurred, is_enough

#: What queries that close documents need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Documents share keys of state, by hash: a round trip to the state store for each document would take most of the time.
BUCKETS = 4096
_SEEN = ("doc", "attempt", "received_ms", "enough", "blurred", "payload")
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class _Closing(StatefulProcessor):
    """Keeps the attempts of a bucket of documents until each is closed."""

    def __init__(self, allowed: int, limit_ms: int) -> None:
        self.allowed, self.limit_ms = allowed, limit_ms

    def init(self, handle) -> None:
        self.handle = handle
        # One value a bucket, as each access is a round trip: its documents, when time closes them and whether something did before,
        # and the attempts of open ones, by the place of their document.
        self.state = handle.getValueState(
            "documents", "docs array<string>, due array<bigint>, closed array<boolean>, of array<int>, attempts array<int>, enough array<boolean>, payloads array<string>"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[str, dict[int, tuple[bool, str]]] = {}
        blurred: set[str] = set()
        received: dict[str, int] = {}
        for part in rows:
            begun = part[part["begun"]]
            for doc, attempt, received_ms, enough, blur, payload in zip(*(begun[c].tolist() for c in _SEEN), strict=True):
                arrived.setdefault(doc, {}).setdefault(attempt, (enough, payload))
                received[doc] = min(received.get(doc, received_ms), received_ms)
                if blur:
                    blurred.add(doc)
        if not arrived:
            return
        known = self._known(self.state.get())
        timer = min((due for due, _ in known.values()), default=None)
        closed, changed = [], False
        for doc, attempts in arrived.items():
            due, was = known.get(doc, (None, {}))
            if was is None:
                continue
            new = {a: v for a, v in attempts.items() if a not in was}  # an attempt delivered again changes nothing
            every = was | new
            stop = min((a for a, (enough, _) in every.items() if enough), default=self.allowed - 1)
            due = received[doc] + self.limit_ms if due is None else due
            if doc in blurred or all(a in every for a in range(stop + 1)):
                known[doc], changed = (due, None), True
                closed.append(every)
            elif new:
                known[doc], changed = (due, every), True
        if changed:
            self._keep(known, timer)
        if closed:
            yield self._rows((every, None) for every in closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known(self.state.get())
        # All that are due are closed at once, so a bucket needs a timer for its next document only.
        at, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        left = {doc: (due, every) for doc, (due, every) in known.items() if due > at and due >= now}
        if left:
            self._keep(left)
        else:
            self.state.clear()
        late = [(every, max(every) + 1) for doc, (_, every) in known.items() if doc not in left and every]
        if late:
            yield self._rows(late)

    def _keep(self, known: dict[str, tuple[int, dict | None]], timer: int | None = None) -> None:
        """Writes documents back, with a timer for the first that is due, unless ``timer`` stands before."""
        first = min(due for due, _ in known.values())
        if timer is None or first < timer:
            self.handle.registerTimer(first)
        rows = [(i, a, enough, payload) for i, (_, every) in enumerate(known.values()) for a, (enough, payload) in sorted((every or {}).items())]
        told = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]
        self.state.update((list(known), [due for due, _ in known.values()], [every is None for _, every in known.values()], *told))

    @staticmethod
    def _known(was) -> dict[str, tuple[int, dict[int, tuple[bool, str]] | None]]:
        """Of each document that is kept, when it is due and its attempts; None of a closed one."""
        if was is None:
            return {}
        docs, due, closed, *rows = was
        every: list[dict | None] = [None if c else {} for c in closed]
        for i, a, enough, payload in zip(*rows, strict=True):
            every[i][int(a)] = (bool(enough), payload)
        return {d: (int(t), e) for d, t, e in zip(docs, due, every, strict=True)}

    @staticmethod
    def _rows(documents: Iterable[tuple[dict[int, tuple[bool, str]], int | None]]) -> pd.DataFrame:
        """Attempts of documents, the one that time ran out before with what is known of another."""
        rows = []
        for every, late in documents:
            order = sorted(every)
            rows += [(a, True, every[a][1]) for a in order]
            if late is not None:
                rows.append((late, False, every[order[0]][1]))
        return pd.DataFrame(rows, columns=["attempt", "made", "payload"])

    def close(self) -> None:
        pass


def close_documents(attempts: DataFrame, settings: Settings | None = None, delay: str = "30 seconds") -> DataFrame:
    """A stream of the attempts of documents that are closed, in the columns of ``attempts`` and ``elapsed_s``.

    ``attempts`` is a stream of ``doc_id, attempt, confianza_general, campos_faltantes, score`` with ``received``
    (when the document came) and ``at`` (when the attempt began), both timestamps, and what else
    :func:`best_attempt` takes or results shall have. Rows may arrive ``delay`` late by ``at``; rows of a document
    arrive once or again, in any order. Attempts that began after the limit are left to the timer. Rows with a null
    ``doc_id`` are heartbeats: they only tell the time.

    Of a document that time closed the last row is the attempt that was not made, with ``elapsed_s`` at the limit.
    The state store of the query must keep timers (``STATE_STORE``).
    """
    s = settings or Settings()
    names = [c for c in attempts.columns if c != "attempt"]
    kinds = attempts.select(*names).schema
    elapsed = F.col("at").cast("double") - F.col("received").cast("double")
    begun = (F.col("attempt") < allowed_attempts(s)) & ((F.col("attempt") == 0) | (elapsed < s.max_seconds)) & F.col("doc_id").isNotNull()
    # Nothing is filtered here: heartbeats must reach the watermark, and a filter might be moved below it.
    rows = attempts.withWatermark("at", delay).select(
        F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.coalesce("attempt", F.lit(-1)).cast("int").alias("attempt"), "at", F.coalesce(F.unix_millis("received"), F.lit(0)).alias("received_ms"), F.coalesce(begun, F.lit(False)).alias("begun"),
        is_enough(names, s).alias("enough"), is_blurred(names, s).alias("blurred"), F.to_json(F.struct(*names), _TIMES).alias("payload"),
    )
    closed = rows.groupBy("key").transformWithStateInPandas(
        _Closing(allowed_attempts(s), round(s.max_seconds * 1000)), "attempt int, made boolean, payload string", "Append", "EventTime"
    )
    read = closed.withColumn("row", F.from_json("payload", kinds, _TIMES))
    elapsed = F.when(F.col("made"), F.col("row.at").cast("double") - F.col("row.received").cast("double")).otherwise(float(s.max_seconds))
    known = ("doc_id", "received")
    columns = [F.when(F.lit(c in known) | F.col("made"), F.col(f"row.`{c}`")).alias(c) for c in names]
    return read.select("attempt", *columns, elapsed.alias("elapsed_s"))


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """A query takes the session's settings when it starts; so these hold for that query alone."""
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE[0], before)


def choose_stream(
    attempts: DataFrame, out: str, checkpoint: str, settings: Settings | None = None, *, delay: str = "30 seconds", once: bool = False,
    then: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Appends the best attempt of each document that closes under ``out``, one folder a micro-batch.

    ``received`` goes with each. A batch repeated after a failure replaces what it wrote. ``then`` goes
    from best attempts to what is written, for instance states or whole responses.
    """
    s = settings or Settings()

    def answer(batch: DataFrame, number: int) -> None:
        # One pass: a batch that is read twice runs the state's work twice, and a join of it may wait for that.
        rows = batch.drop("at").withColumn("received", F.min("received").over(Window.partitionBy("doc_id")))
        best = best_attempt(rows, s, ("received",))
        (then(best) if then else best).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = close_documents(attempts, s, delay).writeStream.option("checkpointLocation", checkpoint).foreachBatch(answer)
    with _state_store(attempts.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start()
