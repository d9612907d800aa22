"""Receipt operators on small hand-written cases."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.config import Settings
from tallyloom.functions.money import parse_clp
from tallyloom.functions.text import normal_token, round1
from tallyloom.operators import attempts, checks, confidence, fields, pipeline, products, state, ted, validation, words


def parse(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = products.parse_receipts(fields.lines_of(docs)).collect()
    found = {r["doc_id"]: r for r in rows}
    return [found.get(i) for i in range(len(texts))]


MONEY = [
    ("9.020", 9020.0), ("$1.234.567", 1234567.0), ("1990", 1990.0), ("9.020,50", 9020.5), ("TOTAL CLP 9020", 9020.0), ("sin numero aqui", None),
    ("TOTAL 4,250", 4250.0), ("4,25", 4250.0), ("19,00%", 19.0), ("9" * 30, None), ("MONTO BOLETA ELECTRONICA $6,50d", 6500.0),
    ("1.2345", 1234.0), ("1234.567", 1234.0), ("12,5", 12.0), ("6,50 %", 6.5), ("", None), (None, None),
]


def test_money(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MONEY)], "i int, t string").select("i", parse_clp(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in sorted(rows)] == [v for _, v in MONEY]


def test_round_ties(spark):
    xs = [k / 20 for k in range(2001)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", round1(F.col("x")).alias("r")).collect()
    assert all(r["r"] == round(r["x"], 1) for r in rows)


MARKET = """SUPERMERCADO DEL SUR LTDA
RUT: 76.543.210-5
FECHA: 14/07/2026 HORA: 12:30
BOLETA ELECTRONICA N 001234
LECHE ENTERA    1    1.200
PAN MOLDE    2    1.990
ARROZ    1    1.450
ACEITE    1    1.690
SUBTOTAL    8.320
TOTAL    8.320
TARJETA DEBITO
GRACIAS POR SU COMPRA"""

TEXTS = {
    "market": MARKET,
    "garbage": "### ???\n!!",
    "taxes": "TOTAL AFECTO 100\nTOTAL EXENTO 50\nTOTAL IVA 19\nTOTAL 8.318",
    "only_taxes": "TOTAL AFECTO 100\nTOTAL EXENTO 50",
    "header": "CANT DESCRIPCION PRECIO Total\nSUBTOTAL $: 5.970\nTOTAL $: 5970",
    "colon": "TOTAL 9: 5970",
    "other_label": "MONTO BOLETA ELECTRONICA $6.500",
    "final": "TOTAL\n$ 742\nAJUSTE -3\nTOTAL FINAL\n$ 739",
    "pay": "Total Mes 1.000\nTOTAL A PAGAR\n$ 459.730",
    "spaced": "5UB TOTAL         4,20",
    "bad_date": "22-85-2026\nRESOLUCION 80 DEL 22-08-2014",
    "resolution": "Res. 22/08/2014\n3.1.26",
    "code": "2    990    1.980\n7801234 GALLETAS DE AVENA\nTOTAL 1.980",
    "leading": "2 Cafe Americano    $4.500\n3x Empanada Pino    $8.100",
    "split": "CAFE HELADO\n1\n2.500\n2.500\n9.999\nTOTAL 2.500",
    "fruit": "FRUTA FRESCA    1    900",
    "suffix": "AB\nBIENVENIDO\nCOMERCIAL ANDES S.A.\nR.U,T. 1-9",
    "visa": "PAGO CON VISA",
}


@pytest.fixture(scope="module")
def parsed(spark):
    return dict(zip(TEXTS, parse(spark, list(TEXTS.values())), strict=True))


@pytest.mark.parametrize(
    ("name", "total"),
    [("market", 8320.0), ("garbage", None), ("taxes", 8318.0), ("only_taxes", None), ("header", 5970.0), ("colon", 5970.0), ("other_label", 6500.0), ("final", 739.0), ("pay", 459730.0), ("spaced", 4200.0)],
)
def test_totals(parsed, name, total):
    assert parsed[name]["total"] == total


def test_fields(parsed):
    m = parsed["market"]
    assert (m["comercio"], m["fecha"], m["metodo_pago"], m["folio"]) == ("SUPERMERCADO DEL SUR LTDA", "2026-07-14", "Débito", "001234")
    assert parsed["garbage"]["fecha"] is None and parsed["garbage"]["productos"] == []
    assert parsed["bad_date"]["fecha"] is None
    assert parsed["resolution"]["fecha"] == "2026-01-03"
    assert parsed["suffix"]["comercio"] == "COMERCIAL ANDES S.A."
    assert parsed["visa"]["metodo_pago"] == "Tarjeta"


def items(row):
    return [(p["nombre"], p["cantidad"], p["precio_unitario"]) for p in row["productos"]]


def test_products(parsed):
    assert items(parsed["market"]) == [("LECHE ENTERA", 1.0, 1200.0), ("PAN MOLDE", 2.0, 1990.0), ("ARROZ", 1.0, 1450.0), ("ACEITE", 1.0, 1690.0)]
    assert items(parsed["code"]) == [("GALLETAS DE AVENA", 2.0, 990.0)]
    assert items(parsed["leading"]) == [("Cafe Americano", 2.0, 4500.0), ("Empanada Pino", 3.0, 8100.0)]
    assert items(parsed["split"]) == [("CAFE HELADO", 1.0, 2500.0)]
    assert items(parsed["fruit"]) == []  # the word RUT stands in it


def word_rows(spark, rows):
    data = [(0, 0, 6, i, t, float(c), x, y, len(t) * 12, h, 1, 1) for i, (t, c, x, y, h) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.OCR_WORDS)


def test_row_clustering(spark):
    rows = word_rows(spark, [("uno", 90, 0, 100, 20), ("dos", 90, 100, 104, 18), ("tres", 90, 0, 150, 20)])
    assert [r["row"] for r in words.cluster_words(rows).orderBy("word_no").collect()] == [0, 0, 1]
    assert [r["line"] for r in words.words_to_lines(rows).orderBy("line_no").collect()] == ["uno     dos", "tres"]


def test_columns_in_two_blocks(spark):
    names, prices = ["Leche", "Pan", "Arroz", "Aceite"], ["1.200", "1.990", "1.450", "1.690"]
    rows = [(n, 90, 0, 40 * i, 20) for i, n in enumerate(names)] + [(p, 90, 520, 40 * i + 2, 20) for i, p in enumerate(prices)]
    lines = words.words_to_lines(word_rows(spark, rows))
    found = products.parse_products(lines).collect()[0]["productos"]
    assert [(p["nombre"], p["precio_unitario"]) for p in found] == list(zip(names, [1200.0, 1990.0, 1450.0, 1690.0], strict=True))


def test_run_score_and_mode(spark):
    rows = [(0, 0, 6, 0, "ab", 50.0), (0, 0, 6, 1, "abc", 30.0), (0, 0, 4, 0, "abc", 90.0), (0, 0, 3, 0, "xyz", 90.0), (0, 0, 4, 1, " ", 99.0), (0, 0, 4, 2, "q", -1.0)]
    table = spark.createDataFrame(rows, "doc_id long, attempt int, psm int, word_no int, text string, conf double")
    scores = words.run_scores(words.clean_words(table))
    assert {(r["psm"], r["score"], r["n_words"]) for r in scores.collect()} == {(6, 100.0, 2), (4, 270.0, 1), (3, 270.0, 1)}
    assert words.best_runs(scores).collect()[0]["psm"] == 4


def scored(spark, data, told, mean=42.0):
    kind = "doc_id long, comercio string, fecha string, metodo_pago string, total double, productos array<struct<nombre:string,cantidad:double,precio_unitario:double,confianza:double>>"
    table = spark.createDataFrame([(0, *data)], kind)
    rows = spark.createDataFrame([(0, t, float(c)) for t, c in told] or [(0, "~", mean)], "doc_id long, text string, conf double")
    return pipeline.score_fields(table, rows).collect()[0]


def test_confidence_and_perfect(spark):
    told = [("Super", 95), ("Márket,", 90), ("LTDA.", 85), ("14/07/2026", 88), ("DEBITO", 82), ("$8.320", 93), ("LECHE", 90), ("ENTERA", 88)]
    r = scored(spark, ("SUPER MARKET LTDA", "2026-07-14", "Débito", 8320.0, [("Leche entera", 1.0, 8320.0, None)]), told)
    assert (r["c_comercio"], r["c_fecha"], r["c_metodo_pago"], r["c_total"], r["c_productos"]) == (90.0, 88.0, 82.0, 93.0, 89.0)
    assert r["advertencias"] == [] and r["penalizacion"] == 0.0 and r["suma_coincide"] is True


def test_all_missing(spark):
    r = scored(spark, (None, None, None, None, []), [])
    assert len(r["advertencias"]) == 4 and r["penalizacion"] == 45.0 and r["campos_faltantes"] == ["comercio", "fecha", "total", "productos"]
    assert r["suma_coincide"] is None and r["confianza_general"] == 0.0


def test_mismatch(spark):
    r = scored(spark, ("A", "2026-01-01", None, 5000.0, [("Pan", 1.0, 1200.0, None)]), [], mean=90.0)
    assert r["penalizacion"] == 40.0 and r["suma_coincide"] is False and r["confianza_general"] == 50.0
    assert r["advertencias"] == ["La suma de los productos ($1.200) no coincide con el total declarado ($5.000)."]


def test_inconsistent(spark):
    r = scored(spark, ("A", "2026-01-01", None, -100.0, [("Pan", -2.0, 0.0, None)]), [])
    assert r["penalizacion"] == 70.0 and r["diferencia"] == 100.0


def test_imprecise_and_renamed(spark):
    told = [("PAN", 90), ("TE", 20), ("8320", 10)]
    r = scored(spark, ("A B", "2026-01-01", None, 8320.0, [("PAN", 1.0, 8000.0, None), ("TE", 1.0, 320.0, None)]), told)
    assert [p["nombre"] for p in r["productos"]] == ["PAN", "Artículo 2"]
    assert r["penalizacion"] == 30.0 and "El producto 'Artículo 2' podría no estar bien identificado." in r["advertencias"]


def attempt_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, attempt int, confianza_general double, campos_faltantes array<string>, score double, nitidez double, elapsed_s double, failed boolean")


def test_best_attempt(spark):
    rows = [
        (0, 0, 60.0, [], 1.0, 50.0, 0.0, False), (0, 1, 75.0, [], 1.0, 50.0, 1.0, False), (0, 2, 99.0, [], 1.0, 50.0, 2.0, False),
        (1, 0, 50.0, ["total"], 1.0, 50.0, 0.0, False), (1, 1, 50.0, [], 1.0, 50.0, 1.0, False), (1, 2, 40.0, [], 1.0, 50.0, 2.0, False),
        (2, 0, 90.0, [], 1.0, 9.0, 0.0, False), (3, 0, 90.0, [], 1.0, 50.0, 301.0, False), (4, 0, None, None, None, 50.0, 0.0, True),
        (4, 1, None, None, None, 50.0, 0.0, True), (4, 2, None, None, None, 50.0, 0.0, True), (5, 0, 10.0, ["total"], 13000.0, 50.0, 0.0, False),
    ]
    found = {r["doc_id"]: (r["attempt"], r["attempts_made"], r["limit_reached"]) for r in attempts.best_attempt(attempt_rows(spark, rows)).collect()}
    assert found == {0: (1, 2, None), 1: (0, 3, "intentos"), 2: (None, 0, "calidad"), 3: (None, 0, "tiempo"), 4: (None, 3, "intentos"), 5: (0, 1, None)}


def test_states(spark):
    product = [("Pan", 1.0, 1000.0, None)]
    cases = [
        (None, None, None, None, [], 10.0, 0.0, None, "file", "IMAGE_UNREADABLE"), (None, None, None, None, [], 85.0, 50.0, None, "camera", "NO_RECEIPT_DETECTED"),
        ("A", "2026-01-01", None, None, product, 85.0, 80.0, None, "file", "INCOMPLETE_RECEIPT"),
        ("A", "2026-01-01", "Efectivo", 1000.0, product, 60.0, 55.0, True, "file", "LOW_CONFIDENCE"),
        ("A", "2026-01-01", None, 1000.0, product, 88.0, 85.0, True, "file", "PARTIAL_SUCCESS"),
        ("A", "2026-01-01", "Efectivo", 1000.0, product, 88.0, 85.0, False, "file", "PARTIAL_SUCCESS"),
        ("A", "2026-01-01", "Efectivo", 1000.0, product, 92.0, 90.0, True, "file", "SUCCESS"),
    ]
    kind = "comercio string, fecha string, metodo_pago string, total double, productos array<struct<nombre:string,cantidad:double,precio_unitario:double,confianza:double>>, mean_conf double, confianza_general double, suma_coincide boolean, source string, want string"
    rows = spark.createDataFrame(cases, kind).withColumns(
        {"attempt": F.lit(0), "attempts_made": F.lit(1), "limit_reached": F.lit(None).cast("string"), "advertencias": F.array().cast("array<string>")}
    )
    shown = state.display_defaults(state.classify(rows)).collect()
    assert [r["estado"] for r in shown] == [c[-1] for c in cases]
    assert shown[0]["comercio"] == "Sin título" and shown[4]["metodo_pago"] == "Sin especificar" and shown[2]["total"] is None


def test_stamp(spark):
    texts = [
        "<TED><DD><RE>76543210-5</RE><TD>39</TD><F>1234</F><FE>2026-07-14</FE><MNT>8320</MNT></DD></TED>", "<re> 7-6 <FE>2026-7-4", "nada", None,
        "<FE>2026-13-40</FE><MNT>8320.50</MNT>", "123456",
    ]
    rows = ted.parse_ted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, ted_text string")).orderBy("doc_id").collect()
    assert tuple(rows[0])[1:] == ("76543210-5", "39", "1234", "2026-07-14", 8320.0)
    assert (rows[1]["rut_emisor"], rows[1]["fecha_emision"]) == ("7-6", "2026-07-04")
    assert all(v is None for r in (rows[2], rows[3], rows[5]) for v in tuple(r)[1:])
    assert (rows[4]["fecha_emision"], rows[4]["monto_total"]) == (None, 832050.0)


def test_file_gate(spark):
    rows = [
        (0, "a.jpg", "image/jpeg", 0, True), (1, "a.gif", "image/jpeg", 5, True), (2, "a.jpg", None, 5, True), (3, "a.png", "image/png", 5, False),
        (4, "a.webp", "image/webp", 10485761, True), (5, "A.JPEG", "IMAGE/JPEG", 10485760, True), (6, None, "image/png", 5, True),
    ]
    files = spark.createDataFrame([(*r, "camera") for r in rows], "doc_id long, filename string, content_type string, length long, decodable boolean, source string")
    checked = validation.check_files(files)
    assert [r["reason"] for r in checked.orderBy("doc_id").collect()] == [
        "archivo_vacio", "formato_no_soportado", "tipo_contenido_no_soportado", "imagen_corrupta", "archivo_demasiado_grande", None, "formato_no_soportado",
    ]
    answers = {r["doc_id"]: (r["estado"], r["confianza_general"]) for r in validation.rejections(checked).collect()}
    assert answers[0] == ("IMAGE_UNREADABLE", 0.0) and answers[4] == ("UNSUPPORTED_FILE", None) and 5 not in answers


def test_scan_end_to_end(spark):
    told = [(t, 92, 12 * i * 0 + x, 40 * n, 20) for n, line in enumerate(MARKET.split("\n")) for i, (t, x) in enumerate(_placed(line))]
    table = word_rows(spark, told)
    stamps = spark.createDataFrame([(0, "<FE>2026-07-15</FE><MNT>8320</MNT>")], schemas.TED)
    out = pipeline.scan(table, ted=stamps, audit=True)
    row = out.collect()[0]
    assert row["estado"] == "SUCCESS" and row["datos"]["fecha"] == "2026-07-15" and row["folio"] == "001234" and row["timbre_decodificado"]
    assert '"estado":"SUCCESS"' in pipeline.to_json(out.drop("folio")).collect()[0]["body"]


def _placed(line):
    at = 0
    for part in line.split(" "):
        if part:
            yield part, 12 * at
        at += len(part) + 1


def test_empty_tables(spark):
    lines = spark.createDataFrame([], schemas.LINES)
    assert products.parse_receipts(lines).count() == 0
    assert pipeline.scan(spark.createDataFrame([], schemas.OCR_WORDS)).count() == 0


def test_settings(spark):
    spark.conf.set("spark.tallyloom.max_attempts", "2")
    spark.conf.set("spark.tallyloom.psm_order", "6, 3")
    changed = Settings.from_spark(spark)
    spark.conf.unset("spark.tallyloom.max_attempts")
    spark.conf.unset("spark.tallyloom.psm_order")
    assert (changed.max_attempts, changed.psm_order) == (2, (6, 3)) and Settings().tesseract_options(6) == "--oem 3 --psm 6"


def test_field_confidence_none(spark):
    table = spark.createDataFrame([(0, "A", None, None, 9999.0)], "doc_id long, comercio string, fecha string, metodo_pago string, total double")
    rows = spark.createDataFrame([(0, "8320", 93.0)], "doc_id long, text string, conf double")
    assert tuple(confidence.field_confidence(table, rows).collect()[0])[1:] == (None, None, None, None)


def test_penalty_cap(spark):
    r = scored(spark, (None, None, None, -1.0, [("a", -1.0, -1.0, None)] * 5), [])
    assert r["penalizacion"] == checks.MOST_PENALTY


def test_axis_fix(spark):
    rows = attempt_table(spark, [(1, 0, 10.0, 500.0, False), (1, 1, 20.0, 500.0, False), (2, 0, 30.0, 500.0, True), (3, 0, 40.0, 20000.0, False), (4, 0, 50.0, 1.0, False)])
    told = spark.createDataFrame([(1, 90), (2, 270), (3, 90), (4, 180), (5, 90)], "doc_id long, rotate int")
    fixes = attempts.axis_fixes(rows, told)
    assert [tuple(r) for r in fixes.collect()] == [(1, 90)]
    again = attempt_table(spark, [(1, 0, 90.0, 14000.0, False), (2, 0, 99.0, 1.0, False)])
    out = attempts.with_fixes(rows, again, fixes)
    assert sorted((r["doc_id"], r["attempt"], r["confianza_general"]) for r in out.collect()) == [(1, 0, 90.0), (2, 0, 30.0), (3, 0, 40.0), (4, 0, 50.0)]
    best = {r["doc_id"]: r for r in attempts.best_attempt(out).collect()}
    assert (best[1]["attempt"], best[1]["attempts_made"]) == (0, 1) and best[2]["attempt"] is None


def attempt_table(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, attempt int, confianza_general double, score double, failed boolean")
    return table.withColumn("campos_faltantes", F.array().cast("array<string>"))


def test_normal_tokens(spark):
    raw = ["Ñandú.", "ﬁn", "½", "ＡＢＣ", "x²", "Łódź", "e\u0301te\u0301", "ệ", "Ǆ", "Ωμέγα", "--", "ªº", "ŉa", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in raw], "t string").select(normal_token(F.col("t"))).collect()]

    def want(t):
        plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return plain.strip(".,:;-$()").upper()

    assert got == [None if t is None else want(t) for t in raw]
