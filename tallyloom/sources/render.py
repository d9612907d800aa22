"""Receipts rendered from the star-schema tables, for tests, queries and the benchmark.

Each order becomes one receipt whose parts are laid out in a way that depends on its key, so
every parser rule meets lines whose right reading is known from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the star schema."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thousands(x: Column) -> Column:
    """Whole number with dots between thousands."""
    return F.replace(F.format_number(x, 0), F.lit(","), F.lit("."))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, the ordered ``items`` of each order with the ``texts`` that a receipt prints of each, and their ``total``."""
    items = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    qty = F.col("l_quantity").cast("long")
    unit = F.expr("cast(l_extendedprice as bigint) div cast(l_quantity as bigint)")
    key, name = F.col("l_orderkey"), F.upper("p_name")
    # Texts are made of rows, before these are gathered, as Spark compiles what it does with columns but not with elements.
    price = thousands(unit)
    columns = F.array(F.concat(name, F.lit("    "), qty.cast("string"), F.lit("    "), price))
    leading = F.array(F.concat(qty.cast("string"), F.lit(" "), name, F.lit("    $"), price))
    coded = F.array(
        F.concat(qty.cast("string"), F.lit("    "), price, F.lit("    "), thousands(qty * unit)),
        F.concat(F.lit("780"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"), F.lit(" "), name),
    )
    split = F.array(name, qty.cast("string"), price)
    texts = F.when(key % 5 == 1, leading).when(key % 5 == 2, coded).when(key % 5 == 3, split).otherwise(columns)
    rows = items.select(key.alias("doc_id"), F.struct(*_ORDER, texts.alias("texts")).alias("item"), (qty * unit).alias("amount"))
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("items"), F.sum("amount").alias("total"))


def stated_off(key: Column) -> Column:
    """By how much a receipt's stated total is off the sum of its items."""
    return F.when(key % 13 == 3, 1).when(key % 13 == 5, 2).when(key % 13 == 7, -30).when(key % 13 == 9, -1).otherwise(0)


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lines``: the text lines of each order's receipt."""
    orders = read(spark, sf_dir, "orders").join(order_lines(spark, sf_dir), F.col("o_orderkey") == F.col("doc_id"))
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    rows = orders.join(suppliers, F.get("items", 0)["l_suppkey"] == F.col("s_suppkey"))
    key = F.col("doc_id")
    number = key.cast("string")
    folio = F.lpad(number, F.greatest(F.lit(6), F.length(number)), F.lit("0"))  # ``lpad`` would cut longer numbers
    suffix = F.get(F.array(F.lit(" LTDA"), F.lit(" SPA"), F.lit(" S.A."), F.lit("")), (key % 4).cast("int"))

    total = F.col("total")
    shown = thousands(total + stated_off(key))
    totals = (
        F.when(key % 7 == 0, F.array(F.concat(F.lit("TOTAL    $ "), shown)))
        .when(key % 7 == 1, F.array(F.concat(F.lit("SUBTOTAL $: "), thousands(total + 7)), F.concat(F.lit("TOTAL $: "), shown)))
        .when(key % 7 == 2, F.array(F.lit("TOTAL AFECTO 100"), F.lit("TOTAL IVA 19"), F.concat(F.lit("TOTAL "), shown)))
        .when(key % 7 == 3, F.array(F.lit("TOTAL"), F.concat(F.lit("$ "), shown)))
        .when(key % 7 == 4, F.array(F.concat(F.lit("TOTAL $ "), thousands(total + 5)), F.lit("TOTAL FINAL"), F.concat(F.lit("$ "), shown)))
        .when(key % 7 == 5, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("SUBTOTAL: "), shown)))
    )
    method = F.get(
        F.array(F.lit("EFECTIVO"), F.when(key % 2 == 0, "TARJETA DÉBITO").otherwise("TARJETA DEBITO"), F.lit("TARJETA DE CREDITO"), F.lit("TRANSFERENCIA"), F.lit(None).cast("string")),
        F.substring("o_orderpriority", 1, 1).cast("int") - 1,
    )
    none = F.lit(None).cast("string")
    above = F.when(key % 8 == 3, "R.U.T. EMISOR").when(key % 8 == 7, "=====").when(key % 8 == 2, "CASA MATRIZ")
    lines = F.concat(
        F.array(
            above, F.concat(F.upper("s_name"), suffix), F.lit("RUT 76.543.210-5"), F.concat(F.lit("BOLETA ELECTRONICA N "), folio),
            F.when(key % 3 == 0, F.lit("RESOLUC. EX. SII 80 DEL 22-08-2014")).otherwise(none),
            F.when(key % 11 != 0, F.concat(F.lit("FECHA: "), F.date_format("o_orderdate", "dd/MM/yyyy"))).otherwise(none),
            F.when(key % 6 == 4, F.lit("CANT    DESCRIPCION    PRECIO TOTAL")).otherwise(none),
        ),
        F.flatten(F.col("items")["texts"]), totals, F.array(F.concat(F.lit("FORMA DE PAGO: "), method)), F.array(F.lit("GRACIAS POR SU COMPRA")),
    )
    return rows.select("doc_id", F.array_compact(lines).alias("lines"))


def receipt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, line_no, line`` of all receipts."""
    return receipts(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("line_no", "line"))


def page_words(lines: DataFrame, confidence: Column, *keep: str) -> DataFrame:
    """Words with boxes from lines: 12 pixels a character, rows 40 apart; ``confidence`` is of ``doc_id, line_no, word_no``."""
    words = lines.select("doc_id", *keep, "line_no", "line", F.posexplode(F.split("line", " ")).alias("i", "text")).filter("text <> ''")
    i, size = F.col("i"), F.length("text")
    ahead = F.length(F.call_function("substring_index", "line", F.lit(" "), i + 1)) - size  # what stands before the word, spaces included
    words = words.select(
        "doc_id", *keep, (F.col("line_no") * 1000 + i).cast("int").alias("word_no"), "text",
        (ahead * 12).cast("int").alias("x"), (F.col("line_no") * 40 + i % 5).cast("int").alias("y"),
        (size * 12).cast("int").alias("w"), F.lit(20).alias("h"), "line_no",
    )
    return words.withColumn("conf", confidence.cast("double")).withColumns({"line_num": F.col("line_no").cast("int"), "block_num": F.lit(1)})


def word_confidence(attempt: Column) -> Column:
    """Confidence of a word in an attempt, 10 to 99: a level of the receipt, and an own part of each word."""
    own = (F.col("line_no") * 17 + (F.col("word_no") - F.col("line_no") * 1000) * 13 + F.col("doc_id")) % 30
    return F.least(F.lit(99), 10 + (F.col("doc_id") * 37 + attempt * 31) % 80 + own)


def receipt_words(spark: SparkSession, sf_dir: str, attempts: int = 3) -> DataFrame:
    """The table of recognised words of all receipts, each read ``attempts`` times in two segmentation modes."""
    tries = F.explode(F.array(*[F.struct(F.lit(a).alias("attempt"), F.lit(p).alias("psm")) for a in range(attempts) for p in (6, 4)])).alias("t")
    base = page_words(receipt_lines(spark, sf_dir), F.lit(0.0)).drop("conf").select("*", tries)
    conf = word_confidence(F.col("t.attempt")) - F.when(F.col("t.psm") == 4, 5).otherwise(0)
    return base.select(
        "doc_id", "t.attempt", "t.psm", "word_no", "text", conf.cast("double").alias("conf"), "x", "y", "w", "h", "line_num", "block_num"
    )


def words_of_attempt(lines: DataFrame) -> DataFrame:
    """Recognised words of lines ``doc_id, attempt, line_no, line``, in two segmentation modes."""
    base = page_words(lines, F.lit(0.0), "attempt").drop("conf").withColumn("psm", F.explode(F.array(F.lit(6), F.lit(4))))
    conf = word_confidence(F.col("attempt")) - F.when(F.col("psm") == 4, 5).otherwise(0)
    return base.select(
        "doc_id", "attempt", "psm", "word_no", "text", conf.cast("double").alias("conf"), "x", "y", "w", "h", "line_num", "block_num"
    )


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, image`` of every customer: 12 rows of 8 pixels, of three channels for every third."""
    key = F.col("c_custkey")
    channels = F.when(key % 3 == 0, 3).otherwise(1)

    def pixel(p: Column) -> Column:
        i, j, band = F.floor(p / (channels * 8)), F.floor(p / channels) % 8, p % channels
        return F.lpad(F.hex((key * 7 + i * i * 31 + j * 13 * (key % 5) + i * j * 5 + band * 40) % 256), 2, "0")

    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), 96 * channels - 1), pixel), ""))
    image = F.struct(F.lit(12).alias("h"), F.lit(8).alias("w"), channels.alias("c"), data.alias("data"))
    # A customer is few bytes and an image much work, so splits of the file would leave most cores idle.
    customers = read(spark, sf_dir, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    return customers.select(key.alias("doc_id"), image.alias("image"))


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, ted_text`` of every third order: a stamp's payload, cut off or empty for some."""
    key = F.col("o_orderkey")
    text = F.concat(
        F.lit("<TED version=\"1.0\"><DD><RE>76543210-5</RE><TD>39</TD><F>"), key.cast("string"), F.lit("</F><FE>"),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</FE><MNT>"), (key * 10 + 1).cast("string"), F.lit("</MNT></DD></TED>"),
    )
    broken = F.when(key % 4 == 0, F.substring_index(text, "</FE>", 1)).when(key % 4 == 1, F.lit("sin datos")).otherwise(text)
    return read(spark, sf_dir, "orders").filter(key % 3 == 0).select(key.alias("doc_id"), broken.alias("ted_text"))
