"""Summaries of audit rows: cubes with distinct documents, and sketches that merge to any period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE_DIMENSIONS = ("estado", "estrategia", "limite", "source")


def state_cube(audit: DataFrame, dimensions: tuple[str, ...] = STATE_DIMENSIONS, *, document: str = "doc_id", measure: str = "confianza_general") -> DataFrame:
    """Every grouping of ``dimensions``: their values, ``grouping``, ``n_documents``, ``n_scans`` and the mean of ``measure``.

    ``grouping`` has a bit for each dimension, the first the highest, set where it is summed over, which tells a null that
    is a value from one that stands for all. Documents are distinct in each group: rows are first added up to one a
    document and group, in tasks and then over them, so that no group's documents are ever held in one row.
    Rows without a document count as scans. An empty table gives no rows.
    """
    names = [F.col(f"`{d}`") for d in dimensions]
    # One row a document and combination of values, before the combinations multiply.
    base = audit.groupBy(*names, F.col(document).alias("_doc")).agg(F.count(F.lit(1)).alias("_n"), F.sum(measure).alias("_sum"), F.count(measure).alias("_known"))
    listed = ", ".join(f"`{d}`" for d in dimensions)
    sums = "sum(_n) AS _n, sum(_sum) AS _sum, sum(_known) AS _known"
    query = f"SELECT {listed}, _doc, grouping_id() AS `grouping`, {sums} FROM {{base}} GROUP BY _doc, CUBE({listed})"
    each = base.sparkSession.sql(query, base=base)
    out = each.groupBy(*names, "grouping").agg(F.count("_doc").alias("n_documents"), F.sum("_n").alias("n_scans"), F.sum("_sum").alias("_sum"), F.sum("_known").alias("_known"))
    mean = F.when(F.col("_known") > 0, F.col("_sum") / F.col("_known"))
    return out.select(*names, F.col("grouping").cast("long").alias("grouping"), "n_documents", "n_scans", mean.alias("mean"))


def period_sketches(audit: DataFrame, period: Column, *by: str, document: str = "doc_id", measure: str = "confianza_general", log_k: int = 14, k: int = 200) -> DataFrame:
    """``period``, ``by`` and mergeable sketches of each group: documents (HyperLogLog), quantiles of ``measure`` (KLL), and exact counts.

    The rows are small, whatever they were made of, so they can be stored and merged to longer periods by :func:`merged`.
    """
    return audit.groupBy(period.alias("period"), *by).agg(
        F.hll_sketch_agg(F.col(document), F.lit(log_k)).alias("documents"), F.kll_sketch_agg_double(F.col(measure).cast("double"), F.lit(k)).alias("quantiles"),
        F.count(F.lit(1)).alias("n_scans"), F.sum(measure).alias("total"), F.count(measure).alias("n_known"),
    )


def merged(sketches: DataFrame, period: Column, *by: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Longer periods, or fewer columns ``by``, out of stored sketches: estimated distinct documents and quantiles, exact counts and mean."""
    rows = sketches.withColumn("period", period).groupBy("period", *by).agg(
        F.hll_union_agg("documents").alias("documents"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.sum("n_scans").alias("n_scans"), F.sum("total").alias("total"), F.sum("n_known").alias("n_known"),
    )
    cuts = [F.when(F.col("n_known") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(q)))).alias(f"q{round(q * 100)}") for q in quantiles]
    mean = F.when(F.col("n_known") > 0, F.col("total") / F.col("n_known")).alias("mean")
    return rows.select("period", *by, F.hll_sketch_estimate("documents").alias("n_documents"), "n_scans", mean, *cuts)
