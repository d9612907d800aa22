"""Declared schemas of the receipt tables."""

from __future__ import annotations

from pyspark.sql import types as T

_PRODUCT_FIELDS = [("nombre", T.StringType()), ("cantidad", T.DoubleType()), ("precio_unitario", T.DoubleType()), ("confianza", T.DoubleType())]


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


PRODUCT = _struct(*_PRODUCT_FIELDS)
OCR_WORDS = _struct(
    ("doc_id", T.LongType()), ("attempt", T.IntegerType()), ("psm", T.IntegerType()), ("word_no", T.IntegerType()),
    ("text", T.StringType()), ("conf", T.DoubleType()), ("x", T.IntegerType()), ("y", T.IntegerType()), ("w", T.IntegerType()),
    ("h", T.IntegerType()), ("line_num", T.IntegerType()), ("block_num", T.IntegerType()),
)
LINES = _struct(("doc_id", T.LongType()), ("line_no", T.IntegerType()), ("line", T.StringType()))
TED = _struct(("doc_id", T.LongType()), ("ted_text", T.StringType()))
FILES = _struct(
    ("doc_id", T.LongType()), ("filename", T.StringType()), ("content_type", T.StringType()), ("length", T.LongType()),
    ("content", T.BinaryType()), ("source", T.StringType()),
)
FIELD_CONFIDENCE = _struct(*((c, T.DoubleType()) for c in ("comercio", "fecha", "metodo_pago", "productos", "total")))
DATA = _struct(
    ("comercio", T.StringType()), ("fecha", T.StringType()), ("metodo_pago", T.StringType()),
    ("productos", T.ArrayType(PRODUCT)), ("total", T.DoubleType()),
)
RESPONSE = _struct(
    ("estado", T.StringType()), ("mensaje", T.StringType()), ("confianza_general", T.DoubleType()),
    ("confianza_por_campo", FIELD_CONFIDENCE), ("advertencias", T.ArrayType(T.StringType())), ("datos", DATA),
)
STATES = (
    "SUCCESS", "PARTIAL_SUCCESS", "LOW_CONFIDENCE", "NO_RECEIPT_DETECTED", "INCOMPLETE_RECEIPT", "IMAGE_UNREADABLE", "UNSUPPORTED_FILE",
)
SOURCES = ("camera", "file")
