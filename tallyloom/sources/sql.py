"""Receipts in SQL: a table function for lines of a text, and views of fields and products over any source.

``receipt_lines(text)`` is for use behind ``LATERAL``; it is SQL itself, so Spark plans it into the query that calls it. The views
are plans over the given table: a condition on ``doc_id`` in a query on them reaches the scan of that table, whatever its format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import LINE_BREAK
from tallyloom.operators.fields import lines_of, parse_fields
from tallyloom.operators.products import product_rows

_LINES = r"""
CREATE OR REPLACE TEMPORARY FUNCTION receipt_lines(receipt STRING) RETURNS TABLE (line_no INT, line STRING) RETURN
SELECT pos, col FROM posexplode(CASE
  WHEN receipt = '' THEN CAST(array() AS ARRAY<STRING>)
  WHEN element_at(split(receipt, r'{pattern}', -1), -1) = ''
    THEN slice(split(receipt, r'{pattern}', -1), 1, size(split(receipt, r'{pattern}', -1)) - 1)
  ELSE split(receipt, r'{pattern}', -1) END)
"""


def register_functions(spark: SparkSession) -> None:
    """Makes ``receipt_lines`` known to the session: the lines of :func:`tallyloom.operators.fields.lines_of`, numbered from 0."""
    spark.sql(_LINES.format(pattern=LINE_BREAK))


def register_views(docs: DataFrame, *, text: str = "text", prefix: str = "") -> None:
    """Makes the views ``<prefix>receipts`` and ``<prefix>receipt_products`` of ``doc_id`` and a text.

    ``receipts`` has ``doc_id, comercio, fecha, metodo_pago, total, folio`` of each document that has a line,
    ``receipt_products`` ``doc_id, line_no, nombre, cantidad, precio_unitario``. Rows of one ``doc_id`` are one
    document, as in ``parse_lines``; other columns are ignored. The text is read when a query on a view runs.
    """
    lines = lines_of(docs.select("doc_id", F.col(text).cast("string").alias("text")))
    parse_fields(lines).createOrReplaceTempView(f"{prefix}receipts")
    product_rows(lines).createOrReplaceTempView(f"{prefix}receipt_products")
