"""What the third review found about time and disk: work that was done more than once."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import confidence, fields, products
from tallyloom.sources import render

SMALLEST = "/root/testdata/sf0.001"


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark):
    table = [(1, 0, "TIENDA LTDA"), (1, 1, "PAN AMASADO"), (1, 2, "2"), (1, 3, "1.000"), (1, 4, "TOTAL"), (1, 5, "$ 2.000"), (2, 0, "GRACIAS"), (2, 1, "ß1"), (2, 2, "5")]
    return spark.createDataFrame(table, "doc_id long, line_no int, line string")


def test_receipts_are_rendered_from_rows(spark):
    assert "transform(" not in plan(render.receipts(spark, SMALLEST))


def test_amounts_ahead_are_read_only_where_they_are_asked_for(lines):
    found = fields.parse_fields(lines)
    assert "lead(own" not in plan(found) and [tuple(r) for r in found.select("doc_id", "comercio", "total").orderBy("doc_id").collect()] == [(1, "TIENDA LTDA", 2000.0), (2, None, None)]


def test_lines_are_parsed_once(lines):
    found = products.product_rows(lines)
    assert not [p for p in plan(found).splitlines() if "Filter" in p and "upper(" in p]
    assert [tuple(r) for r in found.collect()] == [(1, 1, "PAN AMASADO", 2.0, 1000.0)]
    assert [r["doc_id"] for r in products.parse_products(lines).collect()] == [1]


def test_words_are_grouped_once(spark, lines):
    told = confidence.with_words(fields.parse_fields(lines), render.page_words(lines, F.lit(80.0)))
    assert "Aggregate [doc_id" in plan(told) and not [p for p in plan(told).splitlines() if "Aggregate [" in p and "token" in p.split("]")[0]]
    assert [tuple(r) for r in confidence.add_field_confidence(told).select("doc_id", "mean_conf", "c_comercio", "c_total").orderBy("doc_id").collect()] == [
        (1, 80.0, 80.0, 80.0), (2, 80.0, None, None)
    ]


def test_digests_tell_nulls_places_and_zeros_apart(spark):
    from tallyloom.operators import incremental

    table = [(1, "a", None, 0.0, [1, None]), (2, None, "a", 0.0, [1, None]), (3, "a", None, -0.0, [1, None]), (4, "a", None, 0.0, [None, 1]), (5, "a", None, 0.0, [1, None])]
    found = incremental.digests(spark.createDataFrame(table, "doc_id long, x string, y string, z double, a array<int>"))
    told = {r["doc_id"]: r["digest"] for r in found.collect()}
    assert told[1] == told[5] and len(set(told.values())) == 4 and "to_json(struct(x" not in plan(found)


def test_words_cross_the_network_once(spark):
    from tallyloom.operators.pipeline import read_attempts

    words = render.receipt_words(spark, SMALLEST, 1).filter("doc_id < 40")
    one = words.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    found = read_attempts(words.unionByName(one))
    text = plan(found)
    assert "LeftSemi" not in text and "RepartitionByExpression [doc_id" in text
    rows = found.select("doc_id", "attempt", "score").collect()
    assert len(rows) > 5 and all(r["doc_id"] is not None and r["score"] is not None for r in rows)
