"""The surface in one go, and the registry of queries."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyloom import api


def test_surface(spark):
    texts = [(1, "CAFETERIA DON JOSE SPA\n14-07-2026 13:15\n2 Cafe Americano         3400\n1 Jugo Natural   2200\nTOTAL A PAGAR          9000\nForma de pago: EFECTIVO"), (2, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    fields = api.parse_text(docs)
    told = docs.select("doc_id", F.explode(F.split("text", r"\s+")).alias("text")).withColumn("conf", F.lit(91.0))
    row = api.score(fields, told).collect()[0]
    assert (row["comercio"], row["fecha"], row["total"], row["metodo_pago"]) == ("CAFETERIA DON JOSE SPA", "2026-07-14", 9000.0, "Efectivo")
    assert [(p["nombre"], p["cantidad"], p["precio_unitario"]) for p in row["productos"]] == [("Cafe Americano", 2.0, 3400.0), ("Jugo Natural", 1.0, 2200.0)]
    assert row["suma_coincide"] and row["confianza_general"] == 91.0


def test_registry():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and "receipt_total" in sql and len(names) >= 25
