"""Fields of a receipt out of its lines: one window pass and one aggregation per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import vocabulary as V
from tallyloom.functions.money import parse_clp
from tallyloom.functions.text import SPACE, contains_any, strip
from tallyloom.operators.keywords import Marked, Tested, mark


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, line_no, line`` of texts; a null or empty text has no lines."""
    from tallyloom.functions.text import split_lines

    return docs.select("doc_id", F.posexplode(split_lines(F.col(text))).alias("line_no", "line"))


def first_date(line: Column) -> Column:
    """First valid day-month-year date of a line, other than the tax office's resolution date."""

    def dated(found: Column) -> Column:
        part = F.split(found, r"[/\-.]")
        year = F.get(part, 2).cast("int")
        full = F.when(year < 100, year + 2000).otherwise(year)
        iso = F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.lpad(F.get(part, 1), 2, "0"), F.lpad(F.get(part, 0), 2, "0"))
        return F.try_to_date(iso, "yyyy-MM-dd")

    dates = F.transform(F.regexp_extract_all(line, F.lit(V.DATE), F.lit(0)), dated)
    good = F.filter(dates, lambda d: d.isNotNull() & (d != F.lit(V.RESOLUTION_DATE).cast("date")))
    likely = contains_any(line, ("/", "-", ".")) & line.rlike(V.DATE) & ~F.contains(F.upper(line), F.lit(V.RESOLUTION_WORD))
    return F.when(likely, F.get(good, 0).cast("string"))


def total_line_amount(text: Column) -> Column:
    """Amount after the last colon, else of the whole text, which should be a column, as it is named several times."""
    behind = F.when(F.contains(text, F.lit(":")), parse_clp(F.substring_index(text, ":", -1)))
    return F.coalesce(behind, parse_clp(text))


def _after(line: Column, upper: Column, label: Column) -> Column:
    return F.when(label.isNotNull(), F.substring(line, F.instr(upper, label) + F.length(label), F.length(line)))


def has_company_suffix(upper: Column) -> Column:
    """Whether a token of the line, without dots and outer commas, is a legal form."""
    forms = "|".join(r"\.*".join(word) for word in V.COMPANY_SUFFIXES)
    # Most lines have no such letters side by side and no dot between any, which is cheaper to see.
    likely = contains_any(upper, (*V.COMPANY_SUFFIXES, "."))
    return likely & upper.rlike(rf"(?:^|[{SPACE}]),*\.*(?:{forms})\.*,*(?:[{SPACE}]|$)")


def parse_fields(lines: DataFrame, keywords: DataFrame | None = None, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``doc_id, comercio, fecha, metodo_pago, total, folio`` of each document with a line.

    ``lines`` has ``doc_id, line_no, line``. Everything is one exchange on ``doc_id``: line
    expressions, look-ahead by ``lead``, then one aggregation that picks first lines by number.
    Null lines count as empty; a null ``doc_id`` is a document of its own. ``by`` names the columns that tell documents apart.

    ``keywords`` (``list, place, keyword, value``; see :mod:`tallyloom.operators.keywords`) replaces the built-in
    lists, in upper case; lists that it lacks are empty. All of them are found in one pass over each line.
    """
    by_doc = Window.partitionBy(*by).orderBy("line_no")
    line = F.coalesce("line", F.lit(""))
    upper = F.col("upper")
    lists = Tested(upper) if keywords is None else Marked(F.col("marks"))
    base = lines.select(*by, "line_no", line.alias("line")).withColumn("upper", F.upper("line")).withColumn("trimmed", strip(F.col("line")))
    if keywords is not None:
        base = mark(base, keywords, "upper")
    base = base.withColumn("other", lists.any("other_label"))
    # Lines ahead are carried, not their amounts: only few lines ask for the amount of the next ones.
    base = base.withColumns(
        {
            **{f"next{k}": F.lead(F.when(~F.col("other"), F.col("line")), k).over(by_doc) for k in (1, 2)},
            "nth": F.sum((F.length("trimmed") >= 3).cast("int")).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    first, label = F.col("first"), F.col("label")
    base = base.withColumns({"first": lists.first("total_first"), "label": lists.first("total")})
    base = base.withColumn("label", F.when(label.isNotNull() & ~lists.any("total_excluded") & (lists.count("table_header") < 2), label))
    base = base.withColumns({"after_first": _after(F.col("line"), upper, first), "after_label": _after(F.col("line"), upper, label)})
    ahead = F.coalesce(total_line_amount(F.col("next1")), total_line_amount(F.col("next2")))
    base = base.withColumn("ahead", F.when(first.isNotNull() | label.isNotNull(), ahead))
    base = base.withColumns(
        {
            "priority": F.when(first.isNotNull(), F.coalesce(total_line_amount(F.col("after_first")), F.col("ahead"))),
            "plain": F.when(label.isNotNull(), F.coalesce(total_line_amount(F.col("after_label")), F.col("ahead"))),
            "is_sub": F.contains(upper, F.lit("SUBTOTAL")),
            "date": first_date(F.col("line")),
            "method": lists.value("method"),
            "candidate": (F.length("trimmed") >= 3) & (F.col("nth") <= 10),
        }
    )
    base = base.withColumn("heading", F.when(F.col("candidate"), lists.any("not_product") | (F.contains(upper, F.lit("U")) & F.contains(upper, F.lit("T")) & upper.rlike(V.RUT_LABEL))))

    def first_where(value: str, condition: Column) -> Column:
        return F.min_by(value, F.when(condition, F.col("line_no")))

    text = F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "line")))["line"], "\n")
    plausible = ~F.col("trimmed").rlike(V.ONLY_NUMBERS) & ~F.col("trimmed").rlike(V.ONLY_SEPARATORS) & ~F.col("heading")
    found = base.groupBy(*by).agg(
        F.coalesce(
            first_where("trimmed", F.col("candidate") & has_company_suffix(upper)),
            first_where("trimmed", F.col("candidate") & plausible),
        ).alias("comercio"),
        first_where("date", F.col("date").isNotNull()).alias("fecha"),
        F.min("method").alias("method"),
        F.coalesce(
            first_where("priority", F.col("priority").isNotNull()),
            first_where("plain", F.col("plain").isNotNull() & ~F.col("is_sub")),
            first_where("plain", F.col("plain").isNotNull() & F.col("is_sub")),
        ).alias("total"),
        F.nullif(F.regexp_extract(text, V.FOLIO, 1), F.lit("")).alias("folio"),
    )
    return found.select(*by, "comercio", "fecha", F.col("method.value").alias("metodo_pago"), "total", "folio")
