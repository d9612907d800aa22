"""Registered queries of the receipt engine and the DuckDB SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import images
from tallyloom.functions.money import parse_clp
from tallyloom.functions.text import normal_token
from tallyloom.operators import asof, attempts, checks, confidence, fields, incremental, keywords, pages, pipeline, products, reading, state, summary, ted, validation, words
from tallyloom.sources import folders, render
from tallyloom.sources import sql as receipt_sql
from tallyloom.streaming import attempts as arriving
from tallyloom.streaming import stamps as rating

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_ITEMS = """
items AS (
  SELECT l_orderkey AS k, l_suppkey AS supp, l_partkey AS part, upper(p_name) AS name, CAST(l_quantity AS BIGINT) AS qty,
         CAST(trunc(l_extendedprice) AS BIGINT) // CAST(l_quantity AS BIGINT) AS unit,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                            l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey),
sums AS (SELECT k, CAST(sum(qty * unit) AS BIGINT) AS total, count(*) AS n FROM items GROUP BY k),
truth AS (
  SELECT o_orderkey AS k,
         upper(s_name) || CASE o_orderkey % 4 WHEN 0 THEN ' LTDA' WHEN 1 THEN ' SPA' WHEN 2 THEN ' S.A.' ELSE '' END AS comercio,
         CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS fecha,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Efectivo' WHEN '2' THEN 'Débito' WHEN '3' THEN 'Crédito'
              WHEN '4' THEN 'Transferencia' END AS metodo_pago,
         CASE o_orderkey % 13 WHEN 3 THEN 1 WHEN 5 THEN 2 WHEN 7 THEN -30 WHEN 9 THEN -1 ELSE 0 END AS off, s.total + off AS stated,
         CASE WHEN o_orderkey % 7 <> 5 THEN CAST(stated AS DOUBLE) END AS total,
         lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS folio, s.total AS sum, s.n AS n
  FROM orders JOIN sums s ON s.k = o_orderkey JOIN items i ON i.k = o_orderkey AND i.n = 1 JOIN supplier ON s_suppkey = i.supp)
"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.parse_fields(render.receipt_lines(spark, sf_dir))


@query(f"WITH {_ITEMS} SELECT k AS doc_id, total FROM truth")
def receipt_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals in seven layouts."""
    return _fields(spark, sf_dir).select("doc_id", "total")


@query(f"WITH {_ITEMS} SELECT k AS doc_id, fecha FROM truth")
def receipt_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, past the resolution date."""
    return _fields(spark, sf_dir).select("doc_id", "fecha")


@query(f"WITH {_ITEMS} SELECT k AS doc_id, metodo_pago FROM truth")
def receipt_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment methods."""
    return _fields(spark, sf_dir).select("doc_id", "metodo_pago")


@query(f"WITH {_ITEMS} SELECT k AS doc_id, folio FROM truth")
def receipt_folio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document numbers."""
    return _fields(spark, sf_dir).select("doc_id", "folio")


@query(f"WITH {_ITEMS} SELECT k AS doc_id, comercio FROM truth")
def receipt_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants, with and without a legal form."""
    return _fields(spark, sf_dir).select("doc_id", "comercio")


@query(
    f"""WITH {_ITEMS}
SELECT k AS doc_id, n AS product_no, name AS nombre, CAST(qty AS DOUBLE) AS cantidad, CAST(unit AS DOUBLE) AS precio_unitario FROM items"""
)
def receipt_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product lines in four layouts."""
    found = products.parse_products(render.receipt_lines(spark, sf_dir)).select("doc_id", F.posexplode("productos").alias("i", "p"))
    return found.select("doc_id", (F.col("i") + 1).cast("long").alias("product_no"), "p.nombre", "p.cantidad", "p.precio_unitario")


@query(
    r"""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT doc_id, line, '(\d{1,3}(?:[.,]\d{3})+|\d+)(?:[.,](\d{2})(?:[^\d]|$))?' AS p FROM d),
v AS (SELECT doc_id, regexp_extract(line, p, 1) AS i, regexp_extract(line, p, 2) AS c,
             regexp_matches(line, '^[^\d]*(?:\d{1,3}(?:[.,]\d{3})+|\d+)[.,]\d{2}\s*%') AS pct FROM m),
a AS (SELECT doc_id, CASE WHEN i = '' THEN NULL WHEN c = '' THEN CAST(replace(replace(i, '.', ''), ',', '') AS DOUBLE)
             WHEN pct OR regexp_matches(i, '[.,]') THEN CAST(replace(replace(i, '.', ''), ',', '') AS DOUBLE) + CAST(c AS DOUBLE) / 100
             ELSE CAST(i AS DOUBLE) * 1000 + CAST(c AS DOUBLE) * 10 END AS amount FROM v)
SELECT doc_id, amount, count(*) AS n FROM a WHERE amount <= 100000000 GROUP BY ALL"""
)
def money_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First amounts of the lines of documents."""
    lines = render.read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    found = lines.filter(F.col("line").rlike(r"\d")).select("doc_id", parse_clp(F.col("line")).alias("amount"))
    return found.filter("amount is not null").groupBy("doc_id", "amount").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH d AS (SELECT doc_id, line, generate_subscripts(lines, 1) AS n, lines FROM
  (SELECT doc_id, string_split(text, chr(10)) AS lines, '' AS line FROM documents)),
l AS (SELECT doc_id, n, lines[n] AS line FROM d),
m AS (SELECT doc_id, n, unnest(regexp_extract_all(line, '\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}')) AS t,
             generate_subscripts(regexp_extract_all(line, '\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}'), 1) AS j
      FROM l WHERE NOT contains(upper(line), 'RESOLUC')),
p AS (SELECT doc_id, n, j, regexp_split_to_array(t, '[/\-.]') AS s FROM m),
y AS (SELECT doc_id, n, j, CASE WHEN CAST(s[3] AS INT) < 100 THEN CAST(s[3] AS INT) + 2000 ELSE CAST(s[3] AS INT) END AS y,
             CAST(s[2] AS INT) AS mo, CAST(s[1] AS INT) AS da FROM p),
v AS (SELECT doc_id, n, j, try_strptime(printf('%04d-%02d-%02d', y, mo, da), '%Y-%m-%d') AS dt FROM y)
SELECT doc_id, strftime(arg_min(dt, n * 100000 + j), '%Y-%m-%d') AS fecha FROM v
WHERE dt IS NOT NULL AND dt <> DATE '2014-08-22' GROUP BY doc_id"""
)
def date_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First date of each document that has one."""
    lines = render.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    dated = lines.filter(F.col("line").rlike(r"\d[/\-.]\d")).select("doc_id", "line_no", fields.first_date(F.col("line")).alias("fecha"))
    return dated.filter("fecha is not null").groupBy("doc_id").agg(F.min_by("fecha", "line_no").alias("fecha"))


_WORDS_SQL = r"""
w AS (SELECT doc_id, psm, regexp_extract_all(text, '[^\s]+') AS t FROM documents, (VALUES (6), (4), (3), (11)) p(psm)),
words AS (SELECT doc_id, psm, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS i FROM w),
kept AS (SELECT doc_id, psm, text, CAST((doc_id * 7 + i * 13 + psm * 29) % 130 - 10 AS DOUBLE) AS conf FROM words
         WHERE (doc_id * 7 + i * 13 + psm * 29) % 130 - 10 >= 0),
scores AS (SELECT doc_id, 0 AS attempt, psm, coalesce(sum(CASE WHEN conf >= 40 AND length(text) >= 2 THEN conf * length(text) END), 0.0) AS score,
           CAST(sum(conf) AS DOUBLE) AS sum_conf, count(*) AS n_words FROM kept GROUP BY doc_id, psm)
"""


def _document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = render.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("word_no", "text"))
    rows = texts.select("doc_id", F.lit(0).alias("attempt"), "word_no", "text", F.explode(F.array(*[F.lit(p) for p in (6, 4, 3, 11)])).alias("psm"))
    return rows.withColumn("conf", ((F.col("doc_id") * 7 + F.col("word_no") * 13 + F.col("psm") * 29) % 130 - 10).cast("double"))


@query(f"WITH {_WORDS_SQL} SELECT doc_id, attempt, psm, score, sum_conf, n_words FROM scores")
def word_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of runs over the words of documents."""
    scores = words.run_scores(words.clean_words(_document_words(spark, sf_dir)))
    return scores.select("doc_id", "attempt", "psm", "score", F.round(F.col("mean_conf") * F.col("n_words")).alias("sum_conf"), "n_words")


@query(
    f"""WITH {_WORDS_SQL} SELECT doc_id, attempt, psm, score FROM scores
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, list_position([6, 4, 3, 11], psm)) = 1"""
)
def best_psm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best segmentation mode of each document."""
    return words.best_runs(words.run_scores(words.clean_words(_document_words(spark, sf_dir)))).select("doc_id", "attempt", "psm", "score")


def _peso(x: str) -> str:
    return f"replace(format('{{:,}}', CAST({x} AS BIGINT)), ',', '.')"


# Every line of every receipt, its words with a confidence in each of three attempts, and the confidences of the values.
_LINES_SQL = f"""
lines AS (
  SELECT k, -1 AS p, 0 AS n, 0 AS j, CASE k % 8 WHEN 3 THEN 'R.U.T. EMISOR' WHEN 7 THEN '=====' ELSE 'CASA MATRIZ' END AS line FROM truth WHERE k % 8 IN (2, 3, 7)
  UNION ALL SELECT k, 4, 1, 0, 'CANT    DESCRIPCION    PRECIO TOTAL' FROM truth WHERE k % 6 = 4
  UNION ALL SELECT k, 0 AS p, 0 AS n, 0 AS j, comercio AS line FROM truth
  UNION ALL SELECT k, 1, 0, 0, 'RUT 76.543.210-5' FROM truth
  UNION ALL SELECT k, 2, 0, 0, 'BOLETA ELECTRONICA N ' || folio FROM truth
  UNION ALL SELECT k, 3, 0, 0, 'RESOLUC. EX. SII 80 DEL 22-08-2014' FROM truth WHERE k % 3 = 0
  UNION ALL SELECT k, 4, 0, 0, 'FECHA: ' || fecha[9:10] || '/' || fecha[6:7] || '/' || fecha[1:4] FROM truth WHERE fecha IS NOT NULL
  UNION ALL SELECT k, 5, n, 0, CASE k % 5 WHEN 1 THEN qty || ' ' || name || '    $' || {_peso('unit')} WHEN 2 THEN qty || '    ' || {_peso('unit')} || '    ' || {_peso('qty * unit')}
      WHEN 3 THEN name ELSE name || '    ' || qty || '    ' || {_peso('unit')} END FROM items
  UNION ALL SELECT k, 5, n, 1, CASE k % 5 WHEN 2 THEN '780' || lpad(CAST(part AS VARCHAR), 6, '0') || ' ' || name ELSE CAST(qty AS VARCHAR) END FROM items WHERE k % 5 IN (2, 3)
  UNION ALL SELECT k, 5, n, 2, {_peso('unit')} FROM items WHERE k % 5 = 3
  UNION ALL SELECT k, 6, 0, 0, CASE k % 7 WHEN 0 THEN 'TOTAL    $ ' || {_peso('stated')} WHEN 1 THEN 'SUBTOTAL $: ' || {_peso('sum + 7')} WHEN 2 THEN 'TOTAL AFECTO 100'
      WHEN 3 THEN 'TOTAL' WHEN 4 THEN 'TOTAL $ ' || {_peso('sum + 5')} ELSE 'SUBTOTAL: ' || {_peso('stated')} END FROM truth WHERE k % 7 <> 5
  UNION ALL SELECT k, 6, 0, 1, CASE k % 7 WHEN 1 THEN 'TOTAL $: ' || {_peso('stated')} WHEN 2 THEN 'TOTAL IVA 19' WHEN 3 THEN '$ ' || {_peso('stated')} ELSE 'TOTAL FINAL' END
      FROM truth WHERE k % 7 IN (1, 2, 3, 4)
  UNION ALL SELECT k, 6, 0, 2, CASE k % 7 WHEN 2 THEN 'TOTAL ' || {_peso('stated')} ELSE '$ ' || {_peso('stated')} END FROM truth WHERE k % 7 IN (2, 4)
  UNION ALL SELECT k, 9, 0, 0, 'FORMA DE PAGO: ' || CASE metodo_pago WHEN 'Efectivo' THEN 'EFECTIVO' WHEN 'Débito' THEN CASE WHEN k % 2 = 0 THEN 'TARJETA DÉBITO' ELSE 'TARJETA DEBITO' END
      WHEN 'Crédito' THEN 'TARJETA DE CREDITO' ELSE 'TRANSFERENCIA' END FROM truth WHERE metodo_pago IS NOT NULL
  UNION ALL SELECT k, 10, 0, 0, 'GRACIAS POR SU COMPRA' FROM truth)
"""


@query(f"WITH {_ITEMS}, {_LINES_SQL} SELECT k AS doc_id, line FROM lines")
def row_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines rebuilt from words and boxes, spaces between columns included."""
    lines = render.receipt_lines(spark, sf_dir)
    return words.words_to_lines(render.page_words(lines, F.lit(90.0))).select("doc_id", "line")


@query(
    f"""WITH {_ITEMS}, {_LINES_SQL} SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY p, n, j) - 1 AS line_no, length(line) AS n_chars,
length(line) - length(replace(line, ' ', '')) AS n_spaces FROM lines"""
)
def row_cluster_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, characters and spaces of the rebuilt lines."""
    lines = words.words_to_lines(render.page_words(render.receipt_lines(spark, sf_dir), F.lit(90.0)))
    spaces = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("n_chars"), spaces.cast("long").alias("n_spaces"))


def _round1(x: str) -> str:
    """SQL of a double to one decimal as its exact binary value has it."""
    high = f"({x} * 134217729.0 - ({x} * 134217729.0 - {x}))"
    scaled = f"round_even({x} * 20, 0)"
    rest = f"(({high} * 20 - {scaled}) + ({x} - {high}) * 20)"
    return f"(CASE WHEN {x} * 20 = {scaled} AND {scaled} % 2 = 1 AND {rest} <> 0 THEN ({scaled} + sign({rest})) / 20 ELSE round_even({x}, 1) END)"


_TOKEN = "upper(trim(strip_accents({}), '.,:;-$()'))"
_AMOUNT = r"(\d{1,3}(?:[.,]\d{3})+|\d+)(?:[.,](\d{2})(?:[^\d]|$))?"
_SCORES_SQL = rf"""
numbered AS (SELECT k, line, row_number() OVER (PARTITION BY k ORDER BY p, n, j) - 1 AS ln FROM lines),
parts AS (SELECT k, ln, string_split(line, ' ') AS t FROM numbered),
pieces AS (SELECT k, ln, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS i FROM parts),
read AS (SELECT k, ln, i, {_TOKEN.format('text')} AS token, regexp_replace(text, '\D', '', 'g') AS digits,
  regexp_extract(text, '{_AMOUNT}', 1) AS whole, regexp_extract(text, '{_AMOUNT}', 2) AS cents FROM pieces WHERE text <> ''),
told AS (SELECT k, attempt, token, digits, CAST(least(99, 10 + (k * 37 + attempt * 31) % 80 + (ln * 17 + i * 13 + k) % 30) AS DOUBLE) AS conf,
  CASE WHEN whole = '' THEN NULL WHEN cents = '' THEN CAST(replace(replace(whole, '.', ''), ',', '') AS DOUBLE) END AS amount
  FROM read, (VALUES (0), (1), (2)) t(attempt)),
methods AS (SELECT * FROM (VALUES ('Efectivo', 'EFECTIVO'), ('Débito', 'DEBITO'), ('Débito', 'REDCOMPRA'), ('Débito', 'DEBIT'), ('Crédito', 'CREDITO'),
  ('Crédito', 'CREDIT'), ('Transferencia', 'TRANSFERENCIA')) m(metodo_pago, token)),
m_tokens AS (SELECT DISTINCT k, {_TOKEN.format('t')} AS token FROM (SELECT k, unnest(string_split(comercio, ' ')) AS t FROM truth)),
p_tokens AS (SELECT DISTINCT k, n, {_TOKEN.format('t')} AS token FROM (SELECT k, n, unnest(string_split(name, ' ')) AS t FROM items)),
c1 AS (SELECT k, attempt, sum(conf) / count(*) AS c FROM told JOIN m_tokens USING (k, token) GROUP BY ALL),
c2 AS (SELECT k, attempt, sum(conf) / count(*) AS c FROM told JOIN truth USING (k) WHERE contains(digits, fecha[9:10]) AND contains(digits, fecha[6:7])
  AND (contains(digits, fecha[1:4]) OR contains(digits, fecha[3:4])) GROUP BY ALL),
c3 AS (SELECT k, attempt, sum(conf) / count(*) AS c FROM told JOIN truth USING (k) JOIN methods USING (metodo_pago, token) GROUP BY ALL),
c4 AS (SELECT k, attempt, sum(conf) / count(*) AS c FROM told JOIN truth USING (k) WHERE amount = total GROUP BY ALL),
c5 AS (SELECT k, attempt, n, sum(conf) / count(*) AS c FROM told JOIN p_tokens USING (k, token) GROUP BY ALL),
product_conf AS (SELECT k, attempt, n, {_round1('c')} AS c FROM c5),
c6 AS (SELECT k, attempt, list_reduce(list(c ORDER BY n), lambda a, b: a + b) / count(*) AS c, count(*) FILTER (WHERE c < 50) AS weak FROM product_conf GROUP BY ALL),
means AS (SELECT k, attempt, sum(conf) / count(*) AS mean_conf FROM told GROUP BY ALL),
confs AS (SELECT truth.*, means.attempt, mean_conf, {_round1('c1.c')} AS c_comercio, {_round1('c2.c')} AS c_fecha, {_round1('c3.c')} AS c_metodo_pago,
  {_round1('c4.c')} AS c_total, {_round1('c6.c')} AS c_productos, weak
  FROM truth JOIN means USING (k) LEFT JOIN c1 USING (k, attempt) LEFT JOIN c2 USING (k, attempt) LEFT JOIN c3 USING (k, attempt)
  LEFT JOIN c4 USING (k, attempt) LEFT JOIN c6 USING (k, attempt)),
rated AS (SELECT *, (least(80, (CASE WHEN fecha IS NULL THEN 5 ELSE 0 END) + (CASE WHEN total IS NULL THEN 30 ELSE 0 END) + (CASE WHEN abs(total - sum) > 1 THEN 40 ELSE 0 END)
  + (CASE WHEN c_comercio < 50 THEN 5 ELSE 0 END) + (CASE WHEN c_fecha < 50 THEN 5 ELSE 0 END) + (CASE WHEN c_metodo_pago < 50 THEN 3 ELSE 0 END)
  + (CASE WHEN c_total < 50 THEN 25 ELSE 0 END) + 5 * coalesce(weak, 0)))::DOUBLE AS penalizacion,
  coalesce(c_comercio * 1, 0) + coalesce(c_fecha * 1, 0) + coalesce(c_metodo_pago * 0.3::DOUBLE, 0) + coalesce(c_productos * 1, 0) + coalesce(c_total * 3, 0) AS up,
  0.0::DOUBLE + (CASE WHEN c_comercio IS NULL THEN 0 ELSE 1 END) + (CASE WHEN c_fecha IS NULL THEN 0 ELSE 1 END) + (CASE WHEN c_metodo_pago IS NULL THEN 0 ELSE 0.3::DOUBLE END)
  + (CASE WHEN c_productos IS NULL THEN 0 ELSE 1 END) + (CASE WHEN c_total IS NULL THEN 0 ELSE 3 END) AS down FROM confs),
based AS (SELECT *, greatest(0, least(100, CASE WHEN down > 0 THEN up / down ELSE mean_conf END - penalizacion)) AS base FROM rated),
scored AS (SELECT *, {_round1('base')} AS general, CASE WHEN total IS NOT NULL THEN abs(off) <= 1 END AS balanced FROM based)
"""
_FIRST = f"WITH {_ITEMS}, {_LINES_SQL}, {_SCORES_SQL}, s0 AS (SELECT * FROM scored WHERE attempt = 0)"


def _lines_and_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = render.receipt_lines(spark, sf_dir).repartition("doc_id")  # an exchange that all readers of the lines share
    return lines, render.page_words(lines, render.word_confidence(F.lit(0)))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, told = _lines_and_words(spark, sf_dir)
    return pipeline.score_fields(products.parse_receipts(lines), told)


@query(f"{_FIRST} SELECT k AS doc_id, c_comercio, c_fecha, c_metodo_pago, c_total FROM s0")
def conf_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of merchant, date, method and total."""
    lines, told = _lines_and_words(spark, sf_dir)
    return confidence.field_confidence(fields.parse_fields(lines), told)


@query(
    f"""{_FIRST} SELECT i.k AS doc_id, i.n AS product_no, c AS confianza, CASE WHEN c < 50 THEN 'Artículo ' || i.n ELSE name END AS nombre
FROM items i JOIN product_conf p ON p.k = i.k AND p.n = i.n AND p.attempt = 0"""
)
def conf_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of products, weak ones renamed."""
    lines, told = _lines_and_words(spark, sf_dir)
    found = confidence.product_confidence(products.parse_receipts(lines), told).select("doc_id", F.posexplode("productos").alias("i", "p"))
    return found.select("doc_id", (F.col("i") + 1).cast("long").alias("product_no"), "p.confianza", "p.nombre")


@query(f"WITH {_ITEMS} SELECT k AS doc_id, abs(sum - total) <= 1 AS suma_coincide, sum - total AS diferencia FROM truth")
def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether products add up to the total, exactly, within a peso, or not."""
    return _scored(spark, sf_dir).select("doc_id", "suma_coincide", "diferencia")


@query(f"{_FIRST} SELECT k AS doc_id, penalizacion, concat_ws(',', CASE WHEN fecha IS NULL THEN 'fecha' END, CASE WHEN total IS NULL THEN 'total' END) AS faltantes FROM s0")
def penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties and missing fields."""
    return _scored(spark, sf_dir).select("doc_id", "penalizacion", F.array_join("campos_faltantes", ",").alias("faltantes"))


@query(f"{_FIRST} SELECT k AS doc_id, c_productos, mean_conf, general AS confianza_general FROM s0")
def general_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted confidence after penalties."""
    return _scored(spark, sf_dir).select("doc_id", "c_productos", "mean_conf", "confianza_general")


_ATTEMPTS_SQL = """
a AS (SELECT o_orderkey AS doc_id, attempt, CAST((o_orderkey * 31 + attempt * 53) % 101 AS DOUBLE) AS general,
       (o_orderkey + attempt) % 3 = 0 AS missing, CAST((o_orderkey * 17 + attempt * 4001) % 15000 AS DOUBLE) AS score,
       CAST(o_orderkey % 40 AS DOUBLE) AS sharp, CAST(attempt * (o_orderkey % 400) AS DOUBLE) AS elapsed,
       (o_orderkey * 7 + attempt) % 6 = 0 AS failed
  FROM orders, (VALUES (0), (1), (2), (3)) t(attempt))
"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempts_of(render.read(spark, sf_dir, "orders"))


def _attempts_of(orders: DataFrame) -> DataFrame:
    k, a = F.col("o_orderkey"), F.col("attempt")
    rows = orders.select("o_orderkey", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("attempt"))
    gone = F.when((k + a) % 3 == 0, F.array(F.lit("total"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        k.alias("doc_id"), "attempt", ((k * 31 + a * 53) % 101).cast("double").alias("confianza_general"), gone.alias("campos_faltantes"),
        ((k * 17 + a * 4001) % 15000).cast("double").alias("score"), (k % 40).cast("double").alias("nitidez"),
        (a * (k % 400)).cast("double").alias("elapsed_s"), ((k * 7 + a) % 6 == 0).alias("failed"),
    )


@query(
    f"""WITH {_ATTEMPTS_SQL},
s AS (SELECT *, min(CASE WHEN NOT failed AND ((general >= 70 AND NOT missing) OR score >= 13000) THEN attempt END) OVER (PARTITION BY doc_id) AS stop,
       min(CASE WHEN elapsed >= 300 THEN attempt END) OVER (PARTITION BY doc_id) AS late FROM a WHERE attempt < 3),
m AS (SELECT *, CASE WHEN sharp < 15 THEN 0 ELSE least(coalesce(stop + 1, 3), coalesce(late, 3)) END AS made FROM s),
b AS (SELECT doc_id, made, sharp, late, stop, arg_min(attempt, (100 - general) * 10 + attempt) FILTER (WHERE attempt < made AND NOT failed) AS best,
       max(general) FILTER (WHERE attempt < made AND NOT failed) AS general FROM m GROUP BY ALL)
SELECT doc_id, CAST(best AS INT) AS attempt, general AS confianza_general, CAST(made AS INT) AS attempts_made,
       CASE WHEN sharp < 15 THEN 'calidad' WHEN made >= 3 THEN 'intentos' WHEN late IS NOT NULL AND (stop IS NULL OR late <= stop) THEN 'tiempo' END AS limit_reached
FROM b"""
)
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of several attempts under stops and limits."""
    return attempts.best_attempt(_attempts(spark, sf_dir)).select("doc_id", "attempt", "confianza_general", "attempts_made", "limit_reached")


@query("SELECT o_orderkey AS doc_id, CAST(o_orderkey % 40 AS DOUBLE) AS nitidez FROM orders WHERE o_orderkey % 40 >= 15")
def blur_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages sharp enough to be read."""
    pages = render.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 40).cast("double").alias("nitidez"))
    return attempts.pages_sharp_enough(pages)


_STATE_SQL = """CASE WHEN mean_conf < 40 THEN 'IMAGE_UNREADABLE' WHEN total IS NULL THEN 'INCOMPLETE_RECEIPT' WHEN general < 70 THEN 'LOW_CONFIDENCE'
WHEN fecha IS NULL OR metodo_pago IS NULL OR NOT balanced THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END"""


@query(f"{_FIRST} SELECT k AS doc_id, {_STATE_SQL} AS estado, coalesce(metodo_pago, 'Sin especificar') AS metodo_pago FROM s0")
def final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States and display defaults of receipts read once."""
    rows = _scored(spark, sf_dir).withColumns(
        {"attempt": F.lit(0), "attempts_made": F.lit(1), "limit_reached": F.lit(None).cast("string"), "source": F.lit("camera")}
    )
    return state.display_defaults(state.classify(rows)).select("doc_id", "estado", "metodo_pago")


@query(
    f"""WITH {_ITEMS}, {_LINES_SQL}, {_SCORES_SQL},
t AS (SELECT *, min(CASE WHEN general >= 70 AND fecha IS NOT NULL AND total IS NOT NULL THEN attempt END) OVER (PARTITION BY k) AS stop FROM scored),
b AS (SELECT * FROM t WHERE attempt <= coalesce(stop, 2)
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY general DESC, attempt) = 1)
SELECT k AS doc_id, CAST(attempt AS INT) AS attempt, CAST(coalesce(stop, 2) + 1 AS INT) AS attempts_made, folio, general AS confianza_general, {_STATE_SQL} AS estado FROM b"""
)
def scan_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole dataflow from words of three attempts to responses; engine scores never stop the reading here."""
    from tallyloom.config import Settings

    settings = Settings(good_score=1e12)
    out = pipeline.scan(render.receipt_words(spark, sf_dir), settings=settings, audit=True)
    return out.select("doc_id", "attempt", "attempts_made", "folio", "confianza_general", "estado")


@query(ORACLES["scan_receipts"])
def scan_lazily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole dataflow from pages, read only for the attempts that are made; every 17th lies on its side and is turned first."""
    from tallyloom.config import Settings

    # The engine is asked four times; what stands on the pages is written once.
    folder = folders.work_folder(spark, "pages")
    render.receipts(spark, sf_dir).write.parquet(folder)
    printed = spark.read.parquet(folder)

    def engine(shown: DataFrame) -> DataFrame:
        on_side = (F.col("doc_id") % 17 == 3) & (F.col("rotation") % 180 == 0)
        asked = shown.select("doc_id", "attempt", on_side.alias("on_side"))
        seen = printed.join(asked, "doc_id").select("doc_id", "attempt", "on_side", F.posexplode("lines").alias("line_no", "line"))
        # A page that lies on its side gives strokes instead of letters.
        seen = seen.withColumn("line", F.when(F.col("on_side"), F.lit("|| - ll")).otherwise(F.col("line")))
        return render.words_of_attempt(seen)

    def orient(shown: DataFrame) -> DataFrame:
        return shown.select("doc_id", F.when(F.col("doc_id") % 17 == 3, 90).otherwise(180).alias("rotate"))

    pages = render.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    pages = pages.join(render.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")), "doc_id", "left_semi")
    out = reading.scan_pages(pages, engine, orient=orient, settings=Settings(good_score=1e12), audit=True)
    return out.select("doc_id", "attempt", "attempts_made", "folio", "confianza_general", "estado")


_STAMP_SQL = """t AS (SELECT o_orderkey AS k, o_orderkey % 4 AS r, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE o_orderkey % 3 = 0)"""


@query(
    f"""WITH {_STAMP_SQL} SELECT k AS doc_id, CASE WHEN r <> 1 THEN '76543210-5' END AS rut_emisor, CASE WHEN r <> 1 THEN '39' END AS tipo_documento,
CASE WHEN r <> 1 THEN CAST(k AS VARCHAR) END AS folio_ted, CASE WHEN r <> 1 THEN d END AS fecha_emision,
CASE WHEN r > 1 THEN CAST(k * 10 + 1 AS DOUBLE) END AS monto_total FROM t"""
)
def ted_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamp payloads, whole, cut off and without data."""
    return ted.parse_ted(render.stamps(spark, sf_dir))


@query(
    f"""{_FIRST} SELECT k AS doc_id, CASE WHEN k % 3 = 0 AND k % 4 <> 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE fecha END AS fecha,
CASE WHEN k % 3 = 0 AND k % 4 > 1 THEN CAST(k * 10 + 1 AS DOUBLE) ELSE total END AS total,
CASE WHEN k % 3 = 0 AND k % 4 <> 1 THEN 100.0::DOUBLE ELSE c_fecha END AS c_fecha, CASE WHEN k % 3 = 0 AND k % 4 > 1 THEN 100.0::DOUBLE ELSE c_total END AS c_total,
CASE WHEN k % 3 = 0 AND k % 4 > 1 THEN abs(sum - (k * 10 + 1)) <= 1 ELSE balanced END AS suma_coincide,
(k % 3 = 0 AND k % 4 <> 1) AS timbre_decodificado FROM s0 JOIN orders ON o_orderkey = k"""
)
def ted_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and totals overridden by stamps."""
    best = _scored(spark, sf_dir).withColumns({"attempt": F.lit(0), "limit_reached": F.lit(None).cast("string")})
    return ted.enrich(best, render.stamps(spark, sf_dir)).select("doc_id", "fecha", "total", "c_fecha", "c_total", "suma_coincide", "timbre_decodificado")


@query(r"SELECT page_id, nullif(trim(regexp_extract(html, '(?i)<title>([^<]*)', 1)), '') AS title FROM pages")
def html_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages by the tag rule of stamps."""
    return render.read(spark, sf_dir, "pages").select("page_id", ted.tag(F.col("html"), "title").alias("title"))


@query(
    """WITH f AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'a.JPG' WHEN 1 THEN 'b.pdf' WHEN 2 THEN 'sinpunto' ELSE 'c.webp' END AS name,
  CASE o_orderkey % 3 WHEN 0 THEN 'image/JPEG' WHEN 1 THEN 'image/webp' ELSE 'text/plain' END AS kind, (o_orderkey % 13) * 1000000 AS len,
  o_orderkey % 17 <> 0 AS ok FROM orders),
r AS (SELECT *, CASE WHEN len = 0 THEN 'archivo_vacio' WHEN k % 5 IN (1, 2) THEN 'formato_no_soportado' WHEN k % 3 = 2 THEN 'tipo_contenido_no_soportado'
  WHEN len > 10485760 THEN 'archivo_demasiado_grande' WHEN NOT ok THEN 'imagen_corrupta' END AS reason FROM f)
SELECT k AS doc_id, reason, CASE WHEN reason IN ('archivo_vacio', 'imagen_corrupta') THEN 'IMAGE_UNREADABLE' ELSE 'UNSUPPORTED_FILE' END AS estado,
  CASE WHEN reason IN ('archivo_vacio', 'imagen_corrupta') THEN 0.0::DOUBLE END AS confianza_general FROM r WHERE reason IS NOT NULL"""
)
def file_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files turned away, with reason and state."""
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, "a.JPG").when(k % 5 == 1, "b.pdf").when(k % 5 == 2, "sinpunto").otherwise("c.webp")
    kind = F.when(k % 3 == 0, "image/JPEG").when(k % 3 == 1, "image/webp").otherwise("text/plain")
    files = render.read(spark, sf_dir, "orders").select(
        k.alias("doc_id"), name.alias("filename"), kind.alias("content_type"), ((k % 13) * 1000000).alias("length"), (k % 17 != 0).alias("decodable"), F.lit("camera").alias("source")
    )
    checked = validation.check_files(files)
    return validation.rejections(checked).join(checked.select("doc_id", "reason"), "doc_id").select("doc_id", "reason", "estado", "confianza_general")


def _clp(x: str) -> str:
    return f"'$' || replace(format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT)), ',', '.')"


_CHECKS_SQL = f"""
r AS (SELECT o_orderkey AS k, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'TIENDA ' || k % 3 END AS comercio, CASE WHEN k % 5 <> 0 THEN '2024-01-02' END AS fecha,
  CASE WHEN k % 3 <> 0 THEN 'Efectivo' END AS metodo_pago,
  CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN -1500.0 WHEN 3 THEN 3000.5 ELSE 1000.0 * (k % 7) + k % 4 END::DOUBLE AS total,
  k % 8 = 0 AS bare, (k % 3)::DOUBLE AS q1, (1000 * (k % 4 - 1))::DOUBLE AS p1, (k % 90 + 10)::DOUBLE AS c1,
  CASE WHEN k % 9 <> 0 THEN 2.0::DOUBLE END AS q2, 500.5::DOUBLE AS p2, CASE WHEN k % 10 <> 0 THEN 45.0::DOUBLE END AS c2,
  CASE WHEN k % 11 <> 0 THEN (k % 100)::DOUBLE END AS c_comercio, (k % 70)::DOUBLE AS c_fecha, (k % 60)::DOUBLE AS c_metodo_pago, (k % 80)::DOUBLE AS c_total FROM orders),
s AS (SELECT *, CASE WHEN NOT bare AND total IS NOT NULL THEN q1 * p1 + q2 * p2 END AS sum FROM r),
d AS (SELECT *, round_even(sum - total, 2) AS diferencia FROM s)
SELECT k AS doc_id, diferencia, abs(diferencia) <= 1 AS suma_coincide,
concat_ws('|', CASE WHEN coalesce(comercio, '') = '' THEN 'No se pudo identificar el comercio.' END, CASE WHEN fecha IS NULL THEN 'No se pudo identificar la fecha.' END,
  CASE WHEN total IS NULL THEN 'No se pudo identificar el total.' END, CASE WHEN bare THEN 'No se identificó ningún producto.' END,
  CASE WHEN abs(diferencia) > 1 THEN 'La suma de los productos (' || {_clp('sum')} || ') no coincide con el total declarado (' || {_clp('total')} || ').' END,
  CASE WHEN total <= 0 THEN 'El total identificado no es un monto válido (debe ser mayor a cero).' END,
  CASE WHEN NOT bare AND p1 <= 0 THEN 'El producto ''Pan'' tiene un precio inválido.' END, CASE WHEN NOT bare AND q1 <= 0 THEN 'El producto ''Pan'' tiene una cantidad inválida.' END,
  CASE WHEN comercio <> '' AND c_comercio < 50 THEN 'El comercio identificado (''' || comercio || ''') podría no ser exacto.' END,
  CASE WHEN fecha IS NOT NULL AND c_fecha < 50 THEN 'La fecha identificada (' || fecha || ') podría no ser exacta.' END,
  CASE WHEN metodo_pago IS NOT NULL AND c_metodo_pago < 50 THEN 'El método de pago identificado (''' || metodo_pago || ''') podría no ser exacto.' END,
  CASE WHEN total IS NOT NULL AND c_total < 50 THEN 'El total identificado (' || {_clp('total')} || ') podría no ser exacto.' END,
  CASE WHEN NOT bare AND c1 < 50 THEN 'El producto ''Pan'' podría no estar bien identificado.' END,
  CASE WHEN NOT bare AND c2 < 50 THEN 'El producto ''Té'' podría no estar bien identificado.' END) AS advertencias,
least(80, (CASE WHEN coalesce(comercio, '') = '' THEN 5 ELSE 0 END) + (CASE WHEN fecha IS NULL THEN 5 ELSE 0 END) + (CASE WHEN total IS NULL THEN 30 ELSE 0 END)
  + (CASE WHEN bare THEN 5 ELSE 0 END) + (CASE WHEN abs(diferencia) > 1 THEN 40 ELSE 0 END) + (CASE WHEN total <= 0 THEN 10 ELSE 0 END)
  + (CASE WHEN NOT bare AND p1 <= 0 THEN 10 ELSE 0 END) + (CASE WHEN NOT bare AND q1 <= 0 THEN 10 ELSE 0 END) + (CASE WHEN comercio <> '' AND c_comercio < 50 THEN 5 ELSE 0 END)
  + (CASE WHEN fecha IS NOT NULL AND c_fecha < 50 THEN 5 ELSE 0 END) + (CASE WHEN metodo_pago IS NOT NULL AND c_metodo_pago < 50 THEN 3 ELSE 0 END)
  + (CASE WHEN total IS NOT NULL AND c_total < 50 THEN 25 ELSE 0 END) + (CASE WHEN NOT bare AND c1 < 50 THEN 5 ELSE 0 END) + (CASE WHEN NOT bare AND c2 < 50 THEN 5 ELSE 0 END))::DOUBLE AS penalizacion
FROM d"""


def _product(name: str, quantity, price, conf):
    parts = (F.lit(name), quantity, price, conf)
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("nombre", "cantidad", "precio_unitario", "confianza"), strict=True)])


@query("WITH " + _CHECKS_SQL)
def check_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every warning text and penalty, with missing, invalid, unbalanced and unsure values."""
    k, null = F.col("o_orderkey"), F.lit(None).cast("double")
    first = _product("Pan", (k % 3).cast("double"), (1000 * (k % 4 - 1)).cast("double"), (k % 90 + 10).cast("double"))
    second = _product("Té", F.when(k % 9 != 0, 2.0), F.lit(500.5), F.when(k % 10 != 0, 45.0))
    some = F.array(first, second)
    rows = render.read(spark, sf_dir, "orders").select(
        k.alias("doc_id"), F.when(k % 4 == 1, "").when(k % 4 > 1, F.concat(F.lit("TIENDA "), (k % 3).cast("string"))).alias("comercio"),
        F.when(k % 5 != 0, "2024-01-02").alias("fecha"), F.when(k % 3 != 0, "Efectivo").alias("metodo_pago"),
        F.when(k % 6 == 0, null).when(k % 6 == 1, 0.0).when(k % 6 == 2, -1500.0).when(k % 6 == 3, 3000.5).otherwise(1000.0 * (k % 7) + k % 4).alias("total"),
        F.when(k % 8 == 0, F.slice(some, 1, 0)).otherwise(some).alias("productos"), F.when(k % 11 != 0, (k % 100).cast("double")).alias("c_comercio"),
        (k % 70).cast("double").alias("c_fecha"), (k % 60).cast("double").alias("c_metodo_pago"), (k % 80).cast("double").alias("c_total"),
    )
    return checks.check(rows).select("doc_id", "diferencia", "suma_coincide", F.array_join("advertencias", "|").alias("advertencias"), "penalizacion")


_HINTS = {
    "camera": "Intenta mejorar la iluminación, acercar la cámara y encuadrar la boleta completa dentro del recuadro.",
    "file": "Intenta subir una imagen de mayor resolución o verifica que el archivo corresponda efectivamente a una boleta.",
}
_BODIES_SQL = f"""
r AS (SELECT o_orderkey AS k, k % 7 AS kind, k % 40 < 15 AS blurred, k % 9 = 0 AS late, k % 11 = 0 AS failed, k % 2 = 0 AS camera, k % 5 = 0 AS stamped FROM orders),
u AS (SELECT *, NOT blurred AND NOT late AND NOT failed AS seen, stamped AND seen AS over, CASE WHEN kind = 3 THEN 30.0 ELSE 90.0 END::DOUBLE AS c,
  CASE WHEN kind = 6 THEN 30.0 ELSE 80.0 END::DOUBLE AS mean_conf FROM r),
f AS (SELECT *, CASE WHEN seen AND kind <> 0 THEN 'TIENDA' END AS comercio, CASE WHEN over THEN '2024-05-06' WHEN seen AND kind <> 0 THEN '2024-01-02' END AS fecha,
  CASE WHEN seen AND kind NOT IN (0, 4) THEN 'Efectivo' END AS metodo_pago, CASE WHEN over THEN 1200.0 WHEN seen AND kind NOT IN (0, 1) THEN 1000.0 END::DOUBLE AS total,
  seen AND kind NOT IN (0, 2) AS goods FROM u),
g AS (SELECT *, CASE WHEN comercio IS NOT NULL THEN c END AS c1, CASE WHEN over THEN 100.0::DOUBLE WHEN fecha IS NOT NULL THEN c END AS c2, CASE WHEN metodo_pago IS NOT NULL THEN c END AS c3,
  CASE WHEN goods THEN c END AS c4, CASE WHEN over THEN 100.0::DOUBLE WHEN total IS NOT NULL THEN c END AS c5, goods AND total <> 1000 AS off FROM f),
h AS (SELECT *, list_filter([CASE WHEN comercio IS NULL THEN 'No se pudo identificar el comercio.' END, CASE WHEN fecha IS NULL THEN 'No se pudo identificar la fecha.' END,
    CASE WHEN total IS NULL THEN 'No se pudo identificar el total.' END, CASE WHEN NOT goods THEN 'No se identificó ningún producto.' END,
    CASE WHEN off THEN 'La suma de los productos ($1.000) no coincide con el total declarado ($1.200).' END,
    CASE WHEN c1 < 50 THEN 'El comercio identificado (''TIENDA'') podría no ser exacto.' END, CASE WHEN c2 < 50 THEN 'La fecha identificada (2024-01-02) podría no ser exacta.' END,
    CASE WHEN c3 < 50 THEN 'El método de pago identificado (''Efectivo'') podría no ser exacto.' END, CASE WHEN c5 < 50 THEN 'El total identificado ($1.000) podría no ser exacto.' END,
    CASE WHEN c4 < 50 THEN 'El producto ''Pan'' podría no estar bien identificado.' END], lambda x: x IS NOT NULL) AS told,
  least(80, (CASE WHEN comercio IS NULL THEN 5 ELSE 0 END) + (CASE WHEN fecha IS NULL THEN 5 ELSE 0 END) + (CASE WHEN total IS NULL THEN 30 ELSE 0 END) + (CASE WHEN goods THEN 0 ELSE 5 END)
    + (CASE WHEN off THEN 40 ELSE 0 END) + (CASE WHEN c1 < 50 THEN 5 ELSE 0 END) + (CASE WHEN c2 < 50 THEN 5 ELSE 0 END) + (CASE WHEN c3 < 50 THEN 3 ELSE 0 END)
    + (CASE WHEN c5 < 50 THEN 25 ELSE 0 END) + (CASE WHEN c4 < 50 THEN 5 ELSE 0 END)) AS penalty,
  (coalesce(c1, 0) + coalesce(c2, 0) + coalesce(c3 * 0.3::DOUBLE, 0) + coalesce(c4, 0) + coalesce(c5 * 3, 0))
    / nullif(CASE WHEN c1 IS NULL THEN 0 ELSE 1 END + CASE WHEN c2 IS NULL THEN 0 ELSE 1 END + CASE WHEN c3 IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN c4 IS NULL THEN 0 ELSE 1 END
      + CASE WHEN c5 IS NULL THEN 0 ELSE 3 END, 0) AS mean FROM g),
b AS (SELECT *, greatest(0, least(100, coalesce(mean, mean_conf) - penalty)) AS base FROM h),
e AS (SELECT *, {_round1('base')} AS general, CASE WHEN camera THEN '{_HINTS["camera"]}' ELSE '{_HINTS["file"]}' END AS tip,
  CASE WHEN camera THEN 'Intenta capturar la boleta completa, incluyendo la parte inferior con el total.' ELSE 'Verifica que la imagen incluya la boleta completa, incluyendo la parte inferior con el total.' END AS whole,
  CASE WHEN blurred THEN 1 WHEN late THEN 2 WHEN failed THEN 3 WHEN mean_conf < 40 THEN 4 WHEN comercio IS NULL AND fecha IS NULL AND total IS NULL AND NOT goods THEN 5
    WHEN total IS NULL THEN 6 WHEN NOT goods THEN 7 WHEN general < 70 THEN 8 WHEN metodo_pago IS NULL OR fecha IS NULL OR comercio IS NULL OR off THEN 9 ELSE 10 END AS place FROM b)
SELECT k AS doc_id, CAST(to_json(struct_pack(
  estado := ['IMAGE_UNREADABLE', 'IMAGE_UNREADABLE', NULL, 'IMAGE_UNREADABLE', 'NO_RECEIPT_DETECTED', 'INCOMPLETE_RECEIPT', 'INCOMPLETE_RECEIPT', 'LOW_CONFIDENCE', 'PARTIAL_SUCCESS', 'SUCCESS'][place],
  mensaje := CASE place WHEN 1 THEN 'La imagen está demasiado borrosa o no tiene suficiente definición para ser leída. ' || tip
    WHEN 2 THEN 'El procesamiento de la imagen demoró más de lo esperado y se detuvo antes de completarse. ' || tip WHEN 4 THEN 'No fue posible leer el contenido de la imagen. ' || tip
    WHEN 5 THEN 'No se detectó una boleta en la imagen. ' || tip WHEN 6 THEN 'La boleta parece estar incompleta: no se pudo identificar el total. ' || whole
    WHEN 7 THEN 'La boleta parece estar incompleta: no se pudo identificar ningún producto. ' || whole
    WHEN 8 THEN 'La boleta se procesó, pero con confianza baja. Se recomienda revisar los datos manualmente.'
    WHEN 9 THEN 'Se reconocieron los datos principales de la boleta, pero algunos detalles no pudieron confirmarse con certeza.' WHEN 10 THEN 'Boleta procesada correctamente.' END,
  confianza_general := CASE WHEN blurred THEN 0.0::DOUBLE WHEN seen THEN general END,
  confianza_por_campo := CASE WHEN seen THEN struct_pack(comercio := c1, fecha := c2, metodo_pago := c3, productos := c4, total := c5) END,
  advertencias := CASE WHEN blurred THEN ['El procesamiento se detuvo por baja nitidez de la imagen.'] WHEN late THEN ['El procesamiento se detuvo por exceder el tiempo máximo permitido.'] WHEN seen THEN told END,
  datos := CASE WHEN seen THEN struct_pack(comercio := coalesce(comercio, 'Sin título'), fecha := fecha, metodo_pago := coalesce(metodo_pago, 'Sin especificar'),
    productos := CASE WHEN goods THEN [struct_pack(nombre := 'Pan', cantidad := 2.0::DOUBLE, precio_unitario := 500.0::DOUBLE, confianza := c)] ELSE [] END, total := total) END)) AS VARCHAR) AS body
FROM e"""


def _readings(orders):
    """One attempt of each order: blurred, late, failed, unreadable, empty, incomplete, weak, partial and whole ones."""
    k = F.col("o_orderkey")
    kind = k % 7
    c = F.when(kind == 3, 30.0).otherwise(90.0)
    goods = F.array(_product("Pan", F.lit(2.0), F.lit(500.0), c))
    return orders.select(
        k.alias("doc_id"), F.lit(0).alias("attempt"), F.when(kind != 0, "TIENDA").alias("comercio"), F.when(kind != 0, "2024-01-02").alias("fecha"),
        F.when(~kind.isin(0, 4), "Efectivo").alias("metodo_pago"), F.when(~kind.isin(0, 1), 1000.0).alias("total"),
        F.when(kind.isin(0, 2), F.slice(goods, 1, 0)).otherwise(goods).alias("productos"), F.when(kind != 0, c).alias("c_comercio"), F.when(kind != 0, c).alias("c_fecha"),
        F.when(~kind.isin(0, 4), c).alias("c_metodo_pago"), F.when(~kind.isin(0, 2), c).alias("c_productos"), F.when(~kind.isin(0, 1), c).alias("c_total"),
        F.when(kind == 6, 30.0).otherwise(80.0).alias("mean_conf"), F.lit(0.0).alias("score"), (k % 40).cast("double").alias("nitidez"),
        F.when(k % 9 == 0, 300.0).otherwise(0.0).alias("elapsed_s"), (k % 11 == 0).alias("failed"),
    )


def _bodies(best):
    source = F.when(F.col("doc_id") % 2 == 0, "camera").otherwise("file")
    return pipeline.to_json(state.respond(state.classify(best.withColumn("source", source))))


_STAMP_TEXT = "<FE>2024-05-06</FE><MNT>1200</MNT>"


@query("WITH " + _BODIES_SQL)
def response_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole responses as JSON text: blurred, late, failed, unreadable, empty, incomplete, weak, partial and whole documents, some with stamps."""
    rows = _readings(render.read(spark, sf_dir, "orders"))
    printed = rows.filter("doc_id % 5 = 0").select("doc_id", F.explode(F.array(F.lit(_STAMP_TEXT), F.lit("sin datos"))).alias("ted_text"))
    return _bodies(ted.enrich(attempts.best_attempt(checks.evaluate(rows)), printed))


_FIXED_SQL = _ATTEMPTS_SQL.replace("AS failed", "AS failed, o_orderkey % 5 IN (1, 3) AS lying", 1)


@query(
    f"""WITH {_FIXED_SQL},
x AS (SELECT doc_id FROM a WHERE attempt = 0 AND lying AND NOT failed AND score < 13000 AND sharp >= 15),
f AS (SELECT a.doc_id, attempt, x.doc_id IS NOT NULL AS fixed, CASE WHEN fixed THEN (general + 40) % 101 ELSE general END AS general, missing,
  CASE WHEN fixed THEN a.doc_id % 7 = 0 ELSE failed END AS failed, CASE WHEN fixed THEN (score + 3000) % 15000 ELSE score END AS score, sharp FROM a LEFT JOIN x USING (doc_id) WHERE attempt < 3),
s AS (SELECT *, min(CASE WHEN NOT failed AND ((general >= 70 AND NOT missing) OR score >= 13000) THEN attempt END) OVER (PARTITION BY doc_id) AS stop FROM f),
m AS (SELECT *, CASE WHEN sharp < 15 THEN 0 ELSE coalesce(stop + 1, 3) END AS made FROM s)
SELECT doc_id, CAST(arg_min(attempt, (101 - general) * 10 + attempt) FILTER (WHERE attempt < made AND NOT failed) AS INT) AS attempt,
  max(general) FILTER (WHERE attempt < made AND NOT failed) AS confianza_general, CAST(made AS INT) AS attempts_made FROM m GROUP BY doc_id, made"""
)
def axis_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best attempts when documents that lie on their side are turned and read anew."""
    tries = _attempts(spark, sf_dir).drop("elapsed_s")
    turns = F.when(F.col("o_orderkey") % 5 == 4, None).otherwise(F.col("o_orderkey") % 5 * 90 % 360)
    told = render.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), turns.alias("rotate"))
    again = tries.withColumns(
        {"confianza_general": (F.col("confianza_general") + 40) % 101, "score": (F.col("score") + 3000) % 15000, "failed": F.col("doc_id") % 7 == 0}
    )
    fixed = attempts.with_fixes(tries, again, attempts.axis_fixes(tries, told))
    return attempts.best_attempt(fixed).select("doc_id", "attempt", "confianza_general", "attempts_made")


_PIXELS_SQL = """
v AS (SELECT c_custkey AS k, i, j, c_custkey * 7 + i * i * 31 + j * 13 * (c_custkey % 5) + i * j * 5 AS v FROM customer, range(12) a(i), range(8) b(j)),
px AS (SELECT k, i, j, CASE WHEN k % 3 = 0 THEN (v % 256 * 1868 + (v + 40) % 256 * 9617 + (v + 80) % 256 * 4899 + 8192) // 16384 ELSE v % 256 END AS g FROM v),
hist AS (SELECT k, g, count(*) AS n FROM px GROUP BY ALL),
cuts AS (SELECT k, t, coalesce(sum(n) FILTER (WHERE g <= t), 0) AS w, coalesce(sum(n * g) FILTER (WHERE g <= t), 0) AS m, sum(n * g) AS mm FROM hist, range(256) r(t) GROUP BY ALL),
otsu AS (SELECT k, t FROM cuts QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN w IN (0, 96) THEN 0.0::DOUBLE
  ELSE CAST(mm * w - m * 96 AS DOUBLE) * CAST(mm * w - m * 96 AS DOUBLE) / CAST(w * (96 - w) AS DOUBLE) END DESC, t) = 1)
"""


@query(
    f"""WITH {_PIXELS_SQL},
grid AS (SELECT k, list(g ORDER BY i, j) AS a FROM px GROUP BY k),
lap AS (SELECT k, a[abs(i - 1) * 8 + j + 1] + a[(11 - abs(10 - i)) * 8 + j + 1] + a[i * 8 + abs(j - 1) + 1] + a[i * 8 + 7 - abs(6 - j) + 1] - 4 * a[i * 8 + j + 1] AS d
  FROM grid, range(12) y(i), range(8) x(j)),
sharp AS (SELECT k, CAST(96 * sum(d * d) - sum(d) * sum(d) AS BIGINT) AS nitidez_9216 FROM lap GROUP BY k),
ink AS (SELECT k, i, j, g <= t AS dark FROM px JOIN otsu USING (k)),
r AS (SELECT k, sum(n) AS s, 12 * sum(n * n) - sum(n) * sum(n) AS q FROM (SELECT k, count(*) FILTER (WHERE dark) AS n FROM ink GROUP BY k, i) GROUP BY k),
c AS (SELECT k, 8 * sum(n * n) - sum(n) * sum(n) AS q FROM (SELECT k, count(*) FILTER (WHERE dark) AS n FROM ink GROUP BY k, j) GROUP BY k)
SELECT k AS doc_id, nitidez_9216, CAST(t AS INT) AS otsu, round(sqrt(CAST(r.q AS DOUBLE)) / s, 9) AS line_score, CAST(CASE WHEN c.q > r.q THEN 90 ELSE 0 END AS INT) AS rotation
FROM sharp JOIN otsu USING (k) JOIN r USING (k) JOIN c USING (k)"""
)
def image_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpness, Otsu's threshold, evenness of rows and rotation of small images."""
    return render.page_images(spark, sf_dir).select(
        "doc_id", F.round(images.sharpness_of("image") * 9216).cast("long").alias("nitidez_9216"), images.otsu_of("image").alias("otsu"),
        F.round(images.line_score_of("image"), 9).alias("line_score"), images.rotation_of("image").alias("rotation"),
    )


@query(
    f"""WITH {_PIXELS_SQL},
p AS (SELECT k, g, t, k % 4 IN (1, 3) AS lying, CASE k % 4 WHEN 1 THEN j * 12 + 11 - i WHEN 3 THEN (7 - j) * 12 + i ELSE i * 8 + j END AS spot FROM px JOIN otsu USING (k)),
s AS (SELECT * FROM p, (VALUES (0, 'gris'), (1, 'gris_rotada_180'), (2, 'binaria')) w(attempt, strategy))
SELECT k AS doc_id, CAST(attempt AS INT) AS attempt, strategy, CAST(CASE WHEN lying THEN 8 ELSE 12 END AS INT) AS h, CAST(CASE k % 4 WHEN 1 THEN 90 WHEN 3 THEN 270 ELSE 0 END AS INT) AS rotation,
  string_agg(printf('%02X', CASE WHEN attempt < 2 THEN g WHEN g > t THEN 255 ELSE 0 END), '' ORDER BY CASE attempt WHEN 1 THEN 95 - spot ELSE spot END) AS pixels FROM s GROUP BY ALL"""
)
def attempt_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each attempt reads of small pages, some turned on their axis first."""
    made = pages.prepare(render.page_images(spark, sf_dir))
    degrees = F.when(F.col("doc_id") % 4 == 1, 90).when(F.col("doc_id") % 4 == 3, 270)
    read = pages.readings(pages.turned(made, degrees))
    return read.select("doc_id", "attempt", "strategy", "image.h", "rotation", F.hex("image.data").alias("pixels"))


@query(
    f"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[^\\s]+')) AS t FROM documents)
SELECT replace({_TOKEN.format("t")}, 'ẞ', 'SS') AS token, count(*) AS n FROM w GROUP BY ALL"""
)
def token_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of the words of documents, with their numbers."""
    found = render.read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("t"))
    counted = found.groupBy("t").count().select(normal_token(F.col("t")).alias("token"), "count")
    return counted.groupBy("token").agg(F.sum("count").alias("n"))


def _received(key):
    return F.timestamp_seconds(F.lit(1_700_000_000) + key)


def _heartbeat(spark: SparkSession, sf_dir: str, *times: str):
    """A row without document, long after all others, so that a stream that ends has told the time."""
    beat = folders.stream_table(spark, sf_dir, "region").filter("r_regionkey = 0")
    return beat.select(F.lit(None).cast("long").alias("doc_id"), *[F.lit("2100-01-01").cast("timestamp").alias(t) for t in times])


def _closed(spark: SparkSession, rows) -> str:
    """Folder of the best attempts of a stream of attempts that ends."""
    folder = folders.work_folder(spark, "attempts")
    arriving.choose_stream(rows, f"{folder}/best", f"{folder}/state", once=True).awaitTermination()
    return f"{folder}/best"


@query(ORACLES["best_attempt"])
def attempts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best attempts of documents whose attempts arrive one by one, latest first; time closes those that none finishes."""
    key = F.col("doc_id")
    rows = _attempts_of(folders.stream_table(spark, sf_dir, "orders").repartition("o_orderkey")).filter("attempt < 3")
    rows = rows.withColumns({"received": _received(key), "at": F.timestamp_seconds(F.lit(1_700_000_000) + key + F.col("elapsed_s"))}).drop("elapsed_s")
    beat = _heartbeat(spark, sf_dir, "received", "at")
    best = _closed(spark, rows.unionByName(beat, allowMissingColumns=True))
    return spark.read.parquet(best).select("doc_id", "attempt", "confianza_general", "attempts_made", "limit_reached")


@query("WITH " + _BODIES_SQL.replace("k % 5 = 0 AS stamped", "k % 5 = 0 AND k % 50 <= 30 AND k % 91 <> 52 AS stamped", 1))
def late_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole responses where attempts and stamps arrive as streams: some stamps too late, some documents read but stopped by time."""
    orders = folders.stream_table(spark, sf_dir, "orders")
    # Rows of orders are small and what is made of each is much work, so splits of the file would leave most cores idle.
    first = checks.evaluate(_readings(orders.repartition("o_orderkey")))
    # Two more attempts give nothing; of every 91st document they never come, so time stops it.
    more = F.when(F.col("doc_id") % 91 == 52, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    rows = first.withColumn("attempt", F.explode(more)).withColumn("failed", F.col("failed") | (F.col("attempt") > 0))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") + F.col("elapsed_s") + F.col("attempt") * 10)
    rows = rows.withColumns({"received": _received(F.col("doc_id")), "at": at}).drop("elapsed_s")
    best = _closed(spark, rows.unionByName(_heartbeat(spark, sf_dir, "received", "at"), allowMissingColumns=True))
    schema = spark.read.parquet(best).drop("batch").schema
    closed = spark.readStream.schema(schema).parquet(f"{best}/batch=*").unionByName(_heartbeat(spark, sf_dir, "received"), allowMissingColumns=True)
    k = F.col("o_orderkey")
    stamped_at = F.timestamp_seconds(F.lit(1_700_000_000) + k + k % 50 * 10)
    texts = F.explode(F.array(F.lit(_STAMP_TEXT), F.lit("sin datos")))
    stamps = orders.filter(k % 5 == 0).select(k.alias("doc_id"), texts.alias("ted_text"), stamped_at.alias("stamped_at"))
    stamps = stamps.unionByName(_heartbeat(spark, sf_dir, "stamped_at"), allowMissingColumns=True)
    folder = folders.work_folder(spark, "ratings")
    rating.rate_stream(closed, stamps, f"{folder}/out", f"{folder}/state", once=True).awaitTermination()
    return _bodies(rating.current_ratings(spark.read.parquet(f"{folder}/out")))


@query(
    f"""WITH {_ITEMS}, goods AS (SELECT DISTINCT upper(p_name) AS g FROM part),
named AS (SELECT k, count(DISTINCT g) AS n, min(g) AS first FROM (SELECT DISTINCT k, name FROM items) JOIN goods ON contains(name, g) GROUP BY k)
SELECT t.k AS doc_id, comercio, fecha, metodo_pago, total, folio, named.n AS n_partes, named.first AS primera_parte FROM truth t JOIN named ON named.k = t.k"""
)
def keyword_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by a keyword table, and the goods that a receipt names, of a list of all goods and customers found in one pass."""
    lines = render.receipt_lines(spark, sf_dir)
    table = keywords.built_in(spark)
    goods = render.read(spark, sf_dir, "part").select(F.upper("p_name").alias("keyword")).distinct()
    people = render.read(spark, sf_dir, "customer").select(F.upper("c_name").alias("keyword")).distinct()
    for name, rows in (("parte", goods), ("cliente", people)):
        rows = rows.select(F.lit(name).alias("list"), F.lit(0).alias("place"), "keyword", F.col("keyword").alias("value"))
        table = table.unionByName(rows)
    named = keywords.mark(lines.select("doc_id", F.upper("line").alias("line")), table.filter("list = 'parte'"), "line", every=True)
    named = named.select("doc_id", F.explode(F.col("marks")["parte"]).alias("parte")).groupBy("doc_id")
    named = named.agg(F.count_distinct("parte").alias("n_partes"), F.min("parte").alias("primera_parte"))
    return fields.parse_fields(lines, table).join(named, "doc_id")


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    moment = F.timestamp_seconds(F.lit(1_704_067_200) + key * 977 % 2_592_000)
    user = F.when(key % 19 != 0, F.col("o_custkey") % 200)
    return render.read(spark, sf_dir, "orders").select(key.alias("doc_id"), user.alias("customer"), moment.alias("moment"))


_MOMENTS_SQL = """m AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 19 <> 0 THEN o_custkey % 200 END AS customer,
  TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 977 % 2592000) AS moment FROM orders)"""


@query(
    f"""WITH {_MOMENTS_SQL}
SELECT doc_id, CASE WHEN moment - ts <= INTERVAL 6 HOURS THEN event_id END AS event_id, CASE WHEN moment - ts <= INTERVAL 6 HOURS THEN event_type END AS event_type,
  CASE WHEN moment - ts <= INTERVAL 6 HOURS THEN value END AS value FROM m ASOF LEFT JOIN events ON m.customer = events.user_id AND m.moment >= events.ts"""
)
def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's last event at or before each receipt's moment, six hours before at most."""
    events = render.read(spark, sf_dir, "events").drop("props")
    found = asof.asof_join(
        _moments(spark, sf_dir), events, on={"customer": "user_id"}, left_time="moment", right_time="ts", tolerance=timedelta(hours=6)
    )
    return found.select("doc_id", "event_id", "event_type", "value")


@query(
    f"""WITH {_MOMENTS_SQL}
SELECT doc_id, count(*) AS n_events, min(event_id) AS first_event, max(event_id) AS last_event FROM m JOIN events ON m.customer = events.user_id
  AND events.ts >= moment - INTERVAL 1 DAY AND events.ts <= moment + INTERVAL 1 HOUR GROUP BY doc_id"""
)
def interval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's events from a day before each receipt's moment to an hour after it."""
    events = render.read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    pairs = asof.interval_join(
        _moments(spark, sf_dir), events, on={"customer": "user_id"}, left_time="moment", right_time="ts", before=timedelta(days=1), after=timedelta(hours=1)
    )
    found = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
    return found.select("doc_id", "n_events", "first_event", "last_event")


_SEPARATORS = ("\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")


_TEXT_LINES = """SELECT o_orderkey AS doc_id, CAST(generate_series - 1 AS INT) AS line_no, CASE generate_series WHEN 1 THEN 'uno ' || o_orderkey WHEN 2 THEN '' ELSE 'dos' END AS line
FROM orders, generate_series(1, 3) WHERE o_orderkey % 13 <> 0"""


def _broken_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    mark = F.get(F.array(*[F.lit(s) for s in _SEPARATORS]), (key % len(_SEPARATORS)).cast("int"))
    text = F.concat(F.lit("uno "), key.cast("string"), mark, mark, F.lit("dos"), F.when(key % 3 == 0, mark).otherwise(""))
    return render.read(spark, sf_dir, "orders").select(key.alias("doc_id"), F.when(key % 13 != 0, text).otherwise("").alias("text"))


@query(_TEXT_LINES)
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of texts that break them in every way there is, some with a break at the end; texts without anything have none."""
    return fields.lines_of(_broken_texts(spark, sf_dir))


@query(_TEXT_LINES)
def sql_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the table function, behind ``LATERAL``."""
    receipt_sql.register_functions(spark)
    return spark.sql("SELECT d.doc_id, l.line_no, l.line FROM {texts} AS d, LATERAL receipt_lines(d.text) AS l", texts=_broken_texts(spark, sf_dir))


@query(f"WITH {_ITEMS} SELECT k AS doc_id, comercio, fecha, metodo_pago, total, folio, n AS n_products, CAST(sum AS DOUBLE) AS paid FROM truth")
def sql_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of whole texts, and the number and sum of their products, in SQL over the views."""
    docs = render.receipts(spark, sf_dir).select("doc_id", F.array_join("lines", "\n").alias("text"))
    receipt_sql.register_views(docs, prefix="sql_")
    return spark.sql(
        """SELECT r.doc_id, r.comercio, r.fecha, r.metodo_pago, r.total, r.folio, p.n_products, p.paid
        FROM sql_receipts AS r LEFT JOIN (
          SELECT doc_id, count(*) AS n_products, sum(cantidad * precio_unitario) AS paid FROM sql_receipt_products GROUP BY doc_id
        ) AS p ON p.doc_id = r.doc_id"""
    )


@query(
    """SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 4 THEN NULL ELSE strftime(CASE WHEN o_orderkey % 6 = 2 THEN o_orderdate + INTERVAL 30 YEAR ELSE o_orderdate END, '%Y-%m-%d') END AS fecha
FROM orders WHERE o_orderkey % 6 <> 2 OR year(o_orderdate) < 2000"""
)
def date_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First dates of lines in several forms: two-digit years, impossible days, the resolution's date and line first."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    form = key % 6
    dated = F.date_format(day, "dd/MM/yyyy")
    # Two digits are years from 2000 on, here thirty years later than the order's.
    short = F.date_format(F.add_months(day, 360), "d-M-yy")
    line = (
        F.when(form == 0, F.concat(F.lit("FECHA "), dated)).when(form == 1, F.concat(F.lit("99/99/2020 31.02.2021 "), F.date_format(day, "d.M.yyyy")))
        .when(form == 2, F.concat(F.lit("EL "), short, F.lit(" A LAS 10:30"))).when(form == 3, F.concat(F.lit("22/08/2014 y "), dated))
        .when(form == 4, F.concat(F.lit("RESOLUC. 80 DEL "), dated)).otherwise(F.concat(F.lit("x"), F.date_format(day, "dd-MM-yyyy"), F.lit("x 01/01/2001")))
    )
    orders = render.read(spark, sf_dir, "orders").filter((form != 2) | (F.year(day) < 2000))
    return orders.select(key.alias("doc_id"), fields.first_date(line).alias("fecha"))


@query(
    f"""WITH {_ITEMS} SELECT k AS doc_id, total, fecha, CAST(CASE WHEN k % 10 = 3 OR k % 50 = 7 THEN 2 ELSE 1 END AS INT) AS version FROM truth"""
)
def refreshed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of receipts kept up to date: every tenth was misread before, some are new and some gone, and only these are parsed again."""
    lines = render.receipt_lines(spark, sf_dir)
    key = F.col("doc_id")
    misread = F.when(key % 10 == 3, F.concat("line", F.lit(" 1"))).otherwise(F.col("line"))
    before = F.when(key % 50 != 7, F.struct("doc_id", "line_no", misread.alias("line")))
    gone = F.when(key % 100 == 1, F.struct((-1 - key).alias("doc_id"), "line_no", "line"))
    earlier = lines.select(F.explode(F.array(before, gone)).alias("r")).filter("r is not null").select("r.*")  # one reading of the lines for both
    folder = folders.work_folder(spark, "fields")

    def parsed(version: int):
        return lambda some: fields.parse_fields(some).select("doc_id", "total", "fecha").withColumn("version", F.lit(version))

    incremental.refresh(earlier, folder, parsed(1), parts=16)
    incremental.refresh(lines, folder, parsed(2))
    return incremental.read(spark, folder)


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = attempts.best_attempt(_attempts(spark, sf_dir)).select("doc_id", "attempt", "confianza_general", "limit_reached")
    orders = render.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate", F.when(F.col("o_custkey") % 17 != 0, F.col("o_custkey")).alias("customer"))
    state_of = F.when(F.col("attempt").isNull(), "IMAGE_UNREADABLE").when(F.col("confianza_general") < 70, "LOW_CONFIDENCE").otherwise("SUCCESS")
    strategy = F.get(F.array(*[F.lit(s[1]) for s in attempts.STRATEGIES]), F.col("attempt"))
    return best.join(orders, "doc_id").select(
        "customer", "o_orderdate", state_of.alias("estado"), strategy.alias("estrategia"), F.col("limit_reached").alias("limite"),
        F.when(F.col("doc_id") % 2 == 0, "camera").otherwise("file").alias("source"), "confianza_general",
    )


_AUDIT_SQL = f"""b0 AS ({ORACLES["best_attempt"]}),
audit AS (SELECT CASE WHEN o_custkey % 17 <> 0 THEN o_custkey END AS customer, o_orderdate, confianza_general, limit_reached AS limite,
  CASE WHEN attempt IS NULL THEN 'IMAGE_UNREADABLE' WHEN confianza_general < 70 THEN 'LOW_CONFIDENCE' ELSE 'SUCCESS' END AS estado,
  ['gris', 'gris_rotada_180', 'binaria'][attempt + 1] AS estrategia, CASE WHEN doc_id % 2 = 0 THEN 'camera' ELSE 'file' END AS source
  FROM b0 JOIN orders ON o_orderkey = doc_id)"""


@query(
    f"""WITH {_AUDIT_SQL} SELECT estado, estrategia, limite, source, CAST(grouping_id(estado, estrategia, limite, source) AS BIGINT) AS grouping,
count(DISTINCT customer) AS n_documents, count(*) AS n_scans, round(avg(confianza_general), 9) AS mean FROM audit GROUP BY CUBE (estado, estrategia, limite, source)"""
)
def state_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans, distinct customers and mean confidence over every grouping of state, strategy, limit and source."""
    found = summary.state_cube(_audit(spark, sf_dir), document="customer")
    return found.withColumn("mean", F.round("mean", 9))


@query(
    f"""WITH {_AUDIT_SQL} SELECT CAST(year(o_orderdate) AS INT) AS period, source, count(*) AS n_scans, round(avg(confianza_general), 9) AS mean,
count(DISTINCT customer) AS n_exact, true AS documents_near, true AS median_near FROM audit GROUP BY ALL"""
)
def sketch_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly figures out of daily sketches that were stored: exact counts and means, and whether the estimates keep their bounds."""
    rows = _audit(spark, sf_dir)
    folder = folders.work_folder(spark, "sketches")
    summary.period_sketches(rows, F.to_date("o_orderdate"), "source", document="customer").write.parquet(folder)
    year = F.year("period").alias("period")
    made = summary.merged(spark.read.parquet(folder), year, "source")
    by_year = rows.groupBy(F.year("o_orderdate").alias("period"), "source")
    exact = by_year.agg(F.count_distinct("customer").alias("n_exact"), F.count("confianza_general").alias("known"))
    ranks = rows.select(F.year("o_orderdate").alias("period"), "source", "confianza_general").join(made.select("period", "source", "q50"), ["period", "source"])
    below = F.sum((F.col("confianza_general") < F.col("q50")).cast("int")).alias("below")
    upto = F.sum((F.col("confianza_general") <= F.col("q50")).cast("int")).alias("upto")
    both = made.join(exact, ["period", "source"]).join(ranks.groupBy("period", "source").agg(below, upto), ["period", "source"])
    off = 0.0165 * 2 * F.col("known") + 1  # twice the sketch's rank error at 99 %
    return both.select(
        "period", "source", "n_scans", F.round("mean", 9).alias("mean"), "n_exact",
        (F.abs(F.col("n_documents") - F.col("n_exact")) <= 1 + 0.03 * F.col("n_exact")).alias("documents_near"),
        ((F.col("below") <= F.col("known") / 2 + off) & (F.col("upto") >= F.col("known") / 2 - off)).alias("median_near"),
    )
