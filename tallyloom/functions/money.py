"""Chilean peso amounts out of recognised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import once

# How an amount is written, and how a number stands in a line.
AMOUNT = r"(\d{1,3}(?:[.,]\d{3})+|\d+)(?:[.,](\d{2})(?!\d))?\s*(%)?"
NUMBER = r"\d{1,3}(?:[.,]\d{3})+|\d+(?:[.,]\d{2}(?!\d))?"
LIMIT = 100_000_000.0
# A text whose only number is whole and of eight digits at most, which most are; its value needs no look at groups and cents.
_WHOLE = r"^[^0-9]*(\d{1,3}[.,]\d{3}|\d{1,2}(?:[.,]\d{3}){2}|\d{1,8})[^0-9]*$"
_CENTS = r"[.,]\d\d\s*%?$"  # in a found amount: groups of thousands have three digits


def parse_clp(text: Column) -> Column:
    """First amount in a text as a double; null if there is none or it is over ``LIMIT``.

    ``.`` and ``,`` separate thousands. Two digits after a separator are decimals if the whole
    part has a separator of its own or ``%`` follows; otherwise a cut-off group of thousands.
    """


    def value(found: Column) -> Column:
        plain = F.translate(found, "., %\t\n\x0b\f\r", "").try_cast("double")
        return F.when(found.rlike(_CENTS), once(with_cents(found), within)).otherwise(within(plain))

    def within(v: Column) -> Column:
        return F.when(v <= LIMIT, v)

    def with_cents(found: Column) -> Column:
        groups = F.struct(*[F.regexp_extract(found, AMOUNT, i).alias(f"g{i}") for i in (1, 2, 3)])
        return once(groups, amount)

    def amount(g: Column) -> Column:
        whole = F.translate(g["g1"], ".,", "").try_cast("double")
        cents = g["g2"].try_cast("double")
        decimal = (g["g3"] == "%") | g["g1"].rlike("[.,]")
        return F.when(g["g2"] == "", whole).when(decimal, whole + cents / 100).otherwise(whole * 1000 + cents * 10)

    # Spark compiles what it does with columns, not what it does with elements and once-bound values, so those are the exception.
    whole = F.translate(F.regexp_extract(text, _WHOLE, 1), ".,", "").try_cast("double")
    return F.when(text.rlike("[0-9]"), F.coalesce(whole, once(F.regexp_extract(text, AMOUNT, 0), value)))
