"""What the third review found: order numbers over six digits."""

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import catalog

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    """The smallest tables with order keys of seven and eight digits."""
    folder = str(tmp_path_factory.mktemp("shifted"))
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("part", None), ("supplier", None)):
        rows = spark.read.parquet(f"{SMALLEST}/{name}.parquet")
        if key:
            rows = rows.filter(f"{key} < 60").withColumn(key, rows[key] * 200_003 + 999_990)
        rows.write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["receipt_folio", "row_cluster", "row_cluster_shape", "sql_receipts"])
def test_long_order_numbers(spark, shifted, name):
    duckdb = pytest.importorskip("duckdb")
    tables = duckdb.connect()
    for table in ("orders", "lineitem", "part", "supplier"):
        tables.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{shifted}/{table}.parquet/*.parquet')")
    told = tables.execute(catalog.ORACLES[name]).fetchall()
    found = [tuple(r) for r in catalog.QUERIES[name](spark, shifted).collect()]
    assert len(found) > 50 and sorted(found, key=str) == sorted(told, key=str)


def test_a_batch_of_closed_documents_is_read_once(spark, tmp_path):
    from tallyloom.streaming.attempts import choose_stream

    data, plans = str(tmp_path / "in"), []
    rows = spark.range(20).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("attempt"), F.lit(90.0).alias("confianza_general"), F.array().cast("array<string>").alias("campos_faltantes"),
        F.lit(0.0).alias("score"), F.timestamp_seconds(F.col("id") + 1000).alias("received"), F.timestamp_seconds(F.col("id") + 1000).alias("at"),
    )
    rows.write.parquet(data)

    def seen(best):
        plans.append(best._jdf.queryExecution().optimizedPlan().toString())
        return best

    stream = spark.readStream.schema(rows.schema).parquet(data)
    choose_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True, then=seen).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 20 and found.filter("received is null or attempt <> 0").count() == 0
    assert plans and not any("Join" in p for p in plans)


def test_places_of_words_need_no_work_per_word_inside_a_line(spark):
    from tallyloom.sources import render

    lines = spark.createDataFrame([(1, 0, "  PAN  DE   MÍEL ")], "doc_id long, line_no int, line string")
    words = render.page_words(lines, F.lit(90.0))
    assert [(r["word_no"], r["text"], r["x"], r["w"]) for r in words.orderBy("x").collect()] == [(2, "PAN", 24, 36), (4, "DE", 84, 24), (7, "MÍEL", 144, 48)]
    assert "lambdafunction" not in words._jdf.queryExecution().optimizedPlan().toString()


def test_images_are_made_by_all_cores(spark):
    from tallyloom.sources import render

    rows = render.page_images(spark, SMALLEST)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows.select("doc_id").distinct().count() == rows.count() == spark.read.parquet(f"{SMALLEST}/customer.parquet").count()
