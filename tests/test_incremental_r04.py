"""What the fourth review found about refreshes: working tables and shuffle files that stayed on disk."""

from pathlib import Path

from pyspark.sql import functions as F

from tallyloom.operators import incremental


def test_a_refresh_leaves_what_its_version_names(spark, tmp_path):
    folder, seen = str(tmp_path / "out"), []
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")

    def compute(rows):
        seen.append(spark.conf.get(name, "false"))
        return rows.groupBy("doc_id").agg(F.sum("x").alias("x"))

    rows = spark.range(40).select((F.col("id") % 10).alias("doc_id"), F.col("id").alias("x"))
    incremental.refresh(rows, folder, compute, parts=4)
    told = incremental.refresh(rows.withColumn("x", F.col("x") + (F.col("doc_id") == 3).cast("long")), folder, compute)
    assert (told.version, told.changed, told.gone) == (2, 1, 0)
    found = {r["doc_id"]: r["x"] for r in incremental.read(spark, folder).collect()}
    assert found == {d: sum(range(d, 40, 10)) + 4 * (d == 3) for d in range(10)}
    kept = {p.name for v in Path(folder, "data").iterdir() for p in v.iterdir()}
    assert kept == {"rows", "seen"} and spark.conf.get(name, "false") == before and len(seen) == 2
