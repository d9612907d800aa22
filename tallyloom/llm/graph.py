"""Connected components by alternating star contraction, all on executors."""

from __future__ import annotations

from itertools import cycle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import cut, forget, spread_join


def _is_star_forest(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return sums.filter("up > 1 or (up > 0 and down > 0)").limit(1).count() == 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m")), "least")
    near = spread_join(both.filter("v > u"), least, ["u"], F.col("v"))
    moved = cut(near.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
    forget(edges, least)
    return moved


def _small_star(edges: DataFrame) -> DataFrame:
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    near = spread_join(edges, least, ["u"], F.col("v")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = cut(near.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
    forget(edges, least)
    return moved


def stars(links: DataFrame) -> DataFrame:
    """``(u, v)`` of every node ``u`` but the smallest of its component, which is ``v``.

    ``links`` has long columns ``u`` and ``v`` in any order; self links and nulls are
    ignored, and an empty table gives an empty table. Large-star and small-star steps
    alternate until the graph is a forest of stars; each step ends in a written table, and the
    one before is removed. The neighbours of a node of very many links are dealt out over tasks.
    Links found later may be added to the stars of those before: few steps are left then.
    """
    edges = (
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    edges = cut(edges, "links")
    steps = cycle((_large_star, _small_star))
    while not _is_star_forest(edges):
        edges = next(steps)(edges)
    return edges
