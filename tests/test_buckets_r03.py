"""What the third review found about streams: a round trip to the state store for each document."""

from datetime import datetime, timedelta

from tallyloom.streaming import attempts as arriving

START = datetime(2024, 1, 1)
KIND = "doc_id long, attempt int, confianza_general double, campos_faltantes array<string>, score double, received timestamp, at timestamp"


def test_documents_share_state_and_are_closed_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arriving, "BUCKETS", 4, raising=False)
    data, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def add(rows):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(data)

    def reading(doc, attempt, conf=10.0):
        received = START + timedelta(seconds=20 * doc)
        return (doc, attempt, conf, [], 0.0, received, received + timedelta(seconds=100 * attempt))

    def run():
        query = arriving.choose_stream(spark.readStream.schema(KIND).parquet(data), out, state, once=True)
        query.awaitTermination()
        found = {r["doc_id"]: (r["attempt"], r["attempts_made"], r["limit_reached"]) for r in spark.read.parquet(out).collect()}
        assert len(found) == spark.read.parquet(out).count()
        return found, query.lastProgress["stateOperators"][0]["numRowsTotal"]

    # The latest were received first, so a bucket's timer must move to earlier ones; documents over 36 are closed at once.
    add([reading(doc, 0, 90.0 if doc > 36 else 10.0) for doc in reversed(range(40))])
    found, kept = run()
    late = {doc: (0, 1, "tiempo") for doc in found if doc <= 36}  # by then the time is 750 seconds
    assert set(late) in (set(range(22)), set(range(23))) and found == late | {doc: (0, 1, None) for doc in (37, 38, 39)}
    assert kept <= 4
    # Attempts of closed documents don't open them again, others end some that are open, and time ends the rest.
    add([reading(doc, a) for doc in (34, 35, 38) for a in (1, 2)])
    add([(None, None, None, None, None, START + timedelta(days=9), START + timedelta(days=9))])
    found, kept = run()
    ended = {34: (0, 3, "intentos"), 35: (0, 3, "intentos")}
    assert found == {doc: (0, 1, "tiempo") for doc in range(37)} | ended | {doc: (0, 1, None) for doc in (37, 38, 39)}
    assert kept == 0
