"""What the fourth review found about time: work by elements that Spark does not compile. Columns must find what elements find."""

import random

from pyspark.sql import functions as F

from tallyloom.functions.money import AMOUNT, parse_clp
from tallyloom.functions.text import strip
from tallyloom.operators import confidence, products

PIECES = (
    "PAN", " ", "  ", "   ", "    ", "\t\t\t", "$", "$ ", "⟦", "⟧", "1", "2", "0", "10", "500", "1.000", "1,000", "12.345.678", "123.456.789", "100000000",
    "100000001", "0.500", "12.50", "1.234,50", "50%", "1.2.3", ".", "-", "x", "MIEL", "3 x QUESO", "12 HUEVOS $ 500", "٣", "TOTAL", "\n", "7801234 ",
)


def test_columns_find_what_elements_find(spark):
    chance = random.Random(11)
    lines = [(n, 0, "".join(chance.choice(PIECES) for _ in range(chance.randint(1, 7)))) for n in range(3000)]
    rows = spark.createDataFrame(lines, "doc_id long, line_no int, line string")
    line = strip(F.col("line"))
    told = rows.select("doc_id", F.when(~products.is_excluded(F.upper(line)), products.parse_line(line)).alias("q"))
    both = products._parsed(rows).join(told, "doc_id")
    assert both.filter("p is not null").count() > 400 and both.filter(~F.col("p").eqNullSafe(F.col("q"))).count() == 0
    found = products._parsed(rows)
    assert "apart" in found._jdf.queryExecution().optimizedPlan().toString()


def test_whole_amounts_are_read_without_groups(spark):
    texts = ["PAN 1.000", "$0.500%", "12.345.678-", "1.2345", "12.34", "123.456.789", "100000000", "99999999 ", "x", "1.234,50", "1 2", "\n7\n"]
    found = [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_clp(F.col("t")).alias("v")).collect()]
    assert found == [1000.0, 500.0, 12345678.0, 1234.0, 12340.0, None, 100000000.0, 99999999.0, None, 1234.5, 1.0, 7.0] and AMOUNT


def test_words_match_names_as_wholes(spark):
    fields = spark.createDataFrame([(1, "PAN MIEL\x1fDE", "Débito"), (2, "S.A. (Ñandú)", None), (3, None, "Cheque")], "doc_id long, comercio string, metodo_pago string")
    fields = fields.withColumns({"fecha": F.lit(None).cast("string"), "total": F.lit(None).cast("double")})
    said = [(1, "PAN", 10.0), (1, "PAN\x1fMIEL", 90.0), (1, "", 90.0), (1, "DE.", 20.0), (1, "ELDE", 90.0), (1, "débito", 40.0), (2, "nandu", 50.0), (2, "A", 90.0), (3, "PAN", 5.0)]
    told = confidence.field_confidence(fields, spark.createDataFrame(said, "doc_id long, text string, conf double"))
    assert [tuple(r)[1:4:2] for r in told.orderBy("doc_id").collect()] == [(15.0, 40.0), (50.0, None), (None, None)]
    kept = confidence.with_words(fields, spark.createDataFrame(said, "doc_id long, text string, conf double")).filter("doc_id = 1").head()["_tokens"]
    assert sorted(w["token"].strip("\x1f") for w in kept) == ["DE", "DEBITO", "ELDE", "PAN"]
