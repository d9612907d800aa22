"""Receipts in SQL: the table function and the views against the library's own calls."""

from __future__ import annotations

from tallyloom import api
from tallyloom.sources import render
from tallyloom.sources.sql import register_functions, register_views

ODD = ["", None, "a", "a\n", "\n", "\n\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h ", " \n x", "TOTAL $ 1.990\n\n2 x PAN 500", "it's \\n \"q\""]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_lines_in_lateral(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    docs.createOrReplaceTempView("odd")
    register_functions(spark)
    got = spark.sql("SELECT doc_id, l.line_no, l.line FROM odd, LATERAL receipt_lines(text) AS l")
    assert rows(got) == rows(api.lines_of(docs))
    for i, text in enumerate(ODD):
        assert [r["line"] for r in got.filter(f"doc_id = {i}").orderBy("line_no").collect()] == (text or "").splitlines()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan


def test_views_equal_the_calls_and_push_filters(spark, tmp_path):
    lines = render.receipts(spark, "/root/testdata/sf0.001").selectExpr("doc_id", "array_join(lines, '\n') AS receipt", "'x' AS text")
    lines.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    register_views(docs, text="receipt", prefix="v_")
    parsed = api.parse_text(docs, "receipt")
    assert rows(spark.table("v_receipts")) == rows(parsed.drop("productos"))
    by_doc = {}
    for r in spark.sql("SELECT * FROM v_receipt_products ORDER BY doc_id, line_no").collect():
        by_doc.setdefault(r["doc_id"], []).append((r["nombre"], r["cantidad"], r["precio_unitario"]))
    assert by_doc == {r["doc_id"]: [tuple(p)[:3] for p in r["productos"]] for r in parsed.collect() if r["productos"]}
    some = min(by_doc)
    for name in ("v_receipts", "v_receipt_products"):
        one = spark.sql(f"SELECT * FROM {name} WHERE doc_id = {some}")
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert f"EqualTo(doc_id,{some})" in plan and "text" not in plan.split("ReadSchema")[1], plan
        assert one.count() == spark.table(name).filter(f"doc_id = {some}").count() > 0
    both = spark.sql("SELECT r.doc_id, total, sum(cantidad * precio_unitario) AS paid FROM v_receipts r JOIN v_receipt_products p ON r.doc_id = p.doc_id GROUP BY r.doc_id, total")
    assert both.count() == len(by_doc)


def test_views_of_no_documents(spark):
    register_views(spark.createDataFrame([], "doc_id long, text string"), prefix="none_")
    assert spark.table("none_receipts").count() == 0 and spark.table("none_receipt_products").count() == 0
