"""What the fourth review found about keyword tables: those too large to be sent to tasks."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import keywords


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("most", [90, 400])
def test_large_tables_find_what_small_ones_find(spark, monkeypatch, every, most):
    chance = random.Random(4)
    table = [("b", 1, "TOTAL", None), ("a", 0, "Ñ", "x"), ("a", 2, "TOTAL", "t"), ("a", 2, "TOTAL FINAL", None), (None, 0, "PAN", None), ("a", 0, "", None), ("c", None, "PAN", None)]
    table += [("n", i % 3, "CUSTOMER#" + "".join(chance.choice("01") for _ in range(5)), f"v{i % 2}") for i in range(30)] + [("n", 5, "0" * i, None) for i in (2, 70)]
    known = spark.createDataFrame(table, keywords.SCHEMA)
    texts = ["", None, "ÑANDÚ TOTAL FINAL", "PAN", "0" * 75, "TOTAL FINA", "CUSTOMER#0101"] * 2
    texts += ["x".join(chance.choice(["CUSTOMER#", "0", "1", "00110", "TOTAL", " ", "Ñ"]) for _ in range(9)).replace("x", "") for _ in range(60)]
    texts += ["CUSTOMER#" + "".join(chance.choice("01") for _ in range(7)) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, line string")

    def found():
        marked = keywords.mark(rows, known, "line", every=every)
        told = marked.select("id", "line", F.array_sort(F.map_entries("marks")).alias("m")) if every else marked.select("id", "line", F.array_sort(F.transform(F.map_entries("marks"), lambda e: F.struct(e["key"], e["value"]["place"], e["value"]["keyword"], e["value"]["value"], e["value"]["n"]))).alias("m"))
        return sorted((r["id"], r["line"], str(r["m"])) for r in told.collect()), marked.dtypes

    monkeypatch.setattr(keywords, "_REACHES", (64, 11, 4, 2, 1))
    small = found()
    monkeypatch.setattr(keywords, "MOST_BYTES", most)
    assert found() == small and sum("CUSTOMER" in m or "v0" in m or "v1" in m for *_, m in small[0]) > 3
