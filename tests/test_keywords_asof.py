"""Keyword tables against keyword-by-keyword tests, and time joins against loops."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.text import split_lines
from tallyloom.operators import keywords
from tallyloom.operators.asof import asof_join, interval_join
from tallyloom.operators.fields import parse_fields


def receipts():
    rng = random.Random(6)
    words = [e[0] if isinstance(e, tuple) else e for own in keywords.BUILT_IN.values() for e in own] + ["PAN", "LTDA", "R.U.T.", "=====", "3.500", "$ 1.200", "12/03/2021", "N° 12345", ":", "Té", "visa"]
    rows = []
    for doc in range(250):
        rows += [(doc, n, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))) for n in range(rng.randrange(1, 12))]
    return [*rows, (900, 0, None), (None, 0, "TOTAL 500"), (901, 0, "")]


def test_fields_by_the_built_in_table_equal_those_tested_one_by_one(spark):
    lines = spark.createDataFrame(receipts(), "doc_id long, line_no int, line string")
    want, found = (sorted(map(repr, x.collect())) for x in (parse_fields(lines), parse_fields(lines, keywords.built_in(spark))))
    assert found == want and sum("total=None" not in r for r in want) > 20
    upper = F.upper(F.coalesce("line", F.lit("")))
    marked = keywords.mark(lines.withColumn("upper", upper), keywords.built_in(spark), "upper")
    tested, table = keywords.Tested(F.col("upper")), keywords.Marked(F.col("marks"))
    same = []
    for name in keywords.BUILT_IN:
        same += [tested.any(name).eqNullSafe(table.any(name)), tested.first(name).eqNullSafe(table.first(name)), tested.count(name) == table.count(name)]
        same.append(tested.value(name)["value"].eqNullSafe(table.value(name)["value"]))
    row = marked.agg(*[F.sum((~s).cast("int")).alias(f"c{i}") for i, s in enumerate(same)]).head()
    assert set(row) == {0}


def test_other_tables_change_what_is_read(spark):
    lines = spark.createDataFrame([(1, 0, "GESAMT 1.500"), (1, 1, "BAR"), (2, 0, "TOTAL 900")], "doc_id long, line_no int, line string")
    table = spark.createDataFrame([("total", 0, "GESAMT", None), ("method", 0, "BAR", "Efectivo"), ("method", 1, "", "nada"), (None, 0, "X", "X")], keywords.SCHEMA)
    found = {r["doc_id"]: (r["total"], r["metodo_pago"]) for r in parse_fields(lines, table).collect()}
    assert found == {1: (1500.0, "Efectivo"), 2: (None, None)}
    assert parse_fields(lines, table.limit(0)).filter("total is not null").count() == 0


@pytest.mark.parametrize("every", [False, True])
def test_ten_thousand_keywords_in_one_pass(spark, every):
    rng = random.Random(2)
    letters = "abcdé"
    table = {(rng.choice("xyz"), rng.randrange(50), "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))) for _ in range(10_000)}
    texts = [(i, "".join(rng.choice(letters + " ") for _ in range(rng.randrange(0, 60)))) for i in range(120)] + [(200, None), (201, ""), (202, "abcabcab" * 5000)]
    rows = spark.createDataFrame([(*t, t[2].upper()) for t in table], keywords.SCHEMA)
    found = keywords.mark(spark.createDataFrame(texts, "id long, text string"), rows, "text", every=every).collect()
    assert len(found) == len(texts)
    own = {}
    for name, place, keyword in table:
        own.setdefault(name, []).append((place, keyword))
    for r in found:
        want = {}
        for name, entries in own.items():
            met = [(p, k) for p, k in entries if r["text"] and k in r["text"]]
            if met:
                p, k = min(met)
                want[name] = sorted({k.upper() for _, k in met}) if every else (p, k, k.upper(), len(met))
        assert {n: list(v) if every else tuple(v) for n, v in r["marks"].items()} == want


START = datetime(2024, 1, 1)


def sides():
    rng = random.Random(4)
    left = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice("xy"), START + timedelta(minutes=rng.randrange(6000)) if rng.random() < 0.95 else None) for i in range(400)]
    left += [(1000 + i, "a", "x", START + timedelta(minutes=777)) for i in range(50)]  # a hot moment
    right = [(rng.choice(["a", "a", "b", None, "d"]), rng.choice("xy"), START + timedelta(minutes=rng.randrange(6000)), j) for j in range(300)]
    right += [("a", "x", START + timedelta(minutes=777), 1000 + j) for j in range(40)] + [("a", "x", None, 5000)]
    return left, right


@pytest.mark.parametrize(("tolerance", "exact", "bucket"), [(None, True, 60), (timedelta(minutes=90), True, 1440), (timedelta(minutes=20), False, 7), (None, False, 100_000)])
def test_asof_equals_a_loop(spark, tolerance, exact, bucket):
    left, right = sides()
    a = spark.createDataFrame(left, "id long, k string, l string, t timestamp").repartition(3)
    b = spark.createDataFrame(right, "rk string, rl string, t2 timestamp, n long").repartition(3)
    found = asof_join(a, b, on={"k": "rk", "l": "rl"}, left_time="t", right_time="t2", tolerance=tolerance, exact=exact, bucket=timedelta(minutes=bucket), prefix="r_")
    assert found.columns == ["id", "k", "l", "t", "r_t2", "r_n"]
    want = {}
    for i, k, l, t in left:
        met = [(t2, n) for rk, rl, t2, n in right if k and t and t2 and (rk, rl) == (k, l) and (t2 <= t if exact else t2 < t)]
        best = max(met, default=(None, None))
        want[i] = best if best[0] and (tolerance is None or t - best[0] <= tolerance) else (None, None)
    rows = found.collect()
    assert len(rows) == len(left) and {r["id"]: (r["r_t2"], r["r_n"]) for r in rows} == want
    assert sum(v[1] is not None for v in want.values()) > 50


@pytest.mark.parametrize(("before", "after"), [(30, 10), (0, 0), (-5, 60), (2000, 0)])
def test_intervals_equal_a_loop(spark, before, after):
    left, right = sides()
    a, b = spark.createDataFrame(left, "id long, k string, l string, t timestamp"), spark.createDataFrame(right, "rk string, rl string, t2 timestamp, n long")
    low, high = timedelta(minutes=before), timedelta(minutes=after)
    found = interval_join(a, b, on={"k": "rk"}, left_time="t", right_time="t2", before=low, after=high)
    want = Counter((i, n) for i, k, _, t in left for rk, _, t2, n in right if k and k == rk and t and t2 and t - low <= t2 <= t + high)
    assert Counter((r["id"], r["n"]) for r in found.collect()) == want and want
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "BroadcastNestedLoop" not in plan


def test_lines_end_where_text_lines_end(spark):
    text = "a\r\nb\x0cc d\n\ne\x85f\n"
    row = spark.createDataFrame([(text,)], "t string").select(split_lines(F.col("t")).alias("x")).head()
    assert row["x"] == text.splitlines()
