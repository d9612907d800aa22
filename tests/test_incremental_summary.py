"""Refreshed results against whole runs, and summaries against plain counts."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import incremental
from tallyloom.operators.summary import merged, period_sketches, state_cube

KIND = "doc_id long, line_no int, line string"


def totals(counted):
    def compute(some):
        counted.append(sorted((r["doc_id"] for r in some.select("doc_id").distinct().collect()), key=str))
        return some.filter("line is not null").groupBy("doc_id").agg(F.count("line").alias("n"), F.array_join(F.array_sort(F.collect_list("line")), "|").alias("text"))

    return compute


def rows_of(table):
    return sorted((tuple(r) for r in table.collect()), key=str)


def test_only_changed_documents_are_computed_again(spark, tmp_path):
    folder = str(tmp_path / "results")
    lines = {d: [f"line {d} {i}" for i in range(d % 4)] for d in range(1, 80)} | {None: ["no id"], 500: [None]}

    def table():
        rows = [(d, i, x) for d, own in lines.items() for i, x in enumerate(own)]
        random.shuffle(rows)
        return spark.createDataFrame(rows, KIND).repartition(3)

    counted = []

    def check(changed, gone):
        done = incremental.refresh(table(), folder, totals(counted), parts=8)
        assert (done.changed, done.gone) == (changed, gone)
        assert rows_of(incremental.read(spark, folder)) == rows_of(totals([])(table()))
        return done

    with pytest.raises(ValueError):
        incremental.read(spark, folder)
    first = check(sum(bool(own) for own in lines.values()), 0)
    assert first.version == 1 and len(counted[0]) == first.changed
    before = rows_of(incremental.read(spark, folder))
    assert check(0, 0).version == 1 and len(counted) == 1  # only in another order
    lines[7] = lines[7][::-1]  # places change
    lines[9].append("one more")
    lines[None] = ["other"]
    lines[500] = ["now with text"]
    lines[1000] = ["new"]
    del lines[5], lines[6]
    done = check(5, 2)
    assert counted[-1] == sorted([7, 9, None, 500, 1000], key=str) and done.parts <= 7
    assert rows_of(incremental.read(spark, folder, version=1)) == before
    lines.clear()
    assert check(0, 61).version == 3 and incremental.read(spark, folder).count() == 0


def test_a_failed_or_late_writer_leaves_what_is_published(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "results")
    one, two = (spark.createDataFrame([(1, 0, x)], KIND) for x in ("a", "b"))
    incremental.refresh(one, folder, totals([]))

    def broken(some):
        raise OSError("lost")

    with pytest.raises(OSError):
        incremental.refresh(two, folder, broken)
    assert incremental.read(spark, folder).head()["text"] == "a"

    def overtaken(some):
        monkeypatch.undo()
        incremental.refresh(two, folder, totals([]))
        return totals([])(some)

    with pytest.raises(RuntimeError):
        incremental.refresh(one.withColumn("line", F.lit("c")), folder, overtaken)
    assert incremental.read(spark, folder).head()["text"] == "b" and incremental.manifest(spark, folder).version == 2


def audit(spark, n=3000):
    rng = random.Random(9)
    rows = []
    for _ in range(n):
        doc = rng.choice([None, 7, *range(900)]) if rng.random() < 0.7 else 7
        rows.append((doc, rng.choice(["SUCCESS", "LOW", None]), rng.choice(["gris", "binaria"]), rng.choice(["tiempo", None]), rng.choice(["camera", "file"]), rng.choice([None, rng.random() * 100]), date(2024, 1, 1) + timedelta(days=rng.randrange(90))))
    return spark.createDataFrame(rows, "doc_id long, estado string, estrategia string, limite string, source string, confianza_general double, day date"), rows


def test_cube_equals_plain_counts(spark):
    table, rows = audit(spark)
    found = {tuple(r)[:5]: (r["n_documents"], r["n_scans"], r["mean"]) for r in state_cube(table).collect()}
    want = {}
    for mask in range(16):
        for r in rows:
            key = (*[None if mask >> (3 - i) & 1 else r[1 + i] for i in range(4)], mask)
            want.setdefault(key, []).append(r)
    assert set(found) == set(want)
    for key, own in want.items():
        known = [r[5] for r in own if r[5] is not None]
        docs, scans, mean = found[key]
        assert (docs, scans) == (len({r[0] for r in own} - {None}), len(own))
        assert (mean is None) == (not known) and (not known or abs(mean - sum(known) / len(known)) < 1e-9)
    assert state_cube(table.limit(0)).count() == 0


def test_merged_sketches_keep_their_bounds(spark, tmp_path):
    table, rows = audit(spark, 20_000)
    path = str(tmp_path / "daily")
    period_sketches(table, F.col("day"), "source").write.parquet(path)
    daily = spark.read.parquet(path)
    assert daily.count() == 180
    for by in ((), ("source",)):
        for r in merged(daily, F.trunc("period", "month"), *by).collect():
            own = [x for x in rows if x[6].replace(day=1) == r["period"] and (not by or x[4] == r["source"])]
            exact, known = len({x[0] for x in own} - {None}), sorted(x[5] for x in own if x[5] is not None)
            assert r["n_scans"] == len(own) and abs(r["n_documents"] - exact) <= 1 + 0.03 * exact
            assert abs(r["mean"] - sum(known) / len(known)) < 1e-9
            for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
                rank = sum(x <= r[name] for x in known) / len(known)
                assert abs(rank - q) < 0.035
