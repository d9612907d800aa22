"""Results kept up to date: only what belongs to changed documents is computed again.

A table lies in a folder as partitions by a hash of the document id, each written once and never changed, and numbered
manifests that name the partitions of a version. Beside the results stand the digests of the input that they were
computed from. A refresh compares digests, computes changed and new documents, writes the partitions that they and removed
documents touch, and then publishes a manifest by one rename; readers see the old version or the new one, whatever
fails. Of two writers that start from the same version the later fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources.folders import drop_table, shuffles_removed, written_table

PARTS = 64


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did: the version that is published now, and numbers of documents and partitions."""

    version: int
    changed: int
    gone: int
    parts: int


@dataclass
class Manifest:
    """A version: how documents are dealt into parts, and where each part's results and digests lie."""

    version: int = 0
    parts: int = PARTS
    schema: dict = field(default_factory=dict)
    rows: dict[str, str] = field(default_factory=dict)
    seen: dict[str, str] = field(default_factory=dict)


def _name(folder: str, version: int) -> str:
    return f"{folder}/manifest-{version:09d}.json"


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> Manifest:
    """The published version, or an earlier one; version 0 if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if version is None:
        names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
        version = max((int(n[9:-5]) for n in names if n.startswith("manifest-")), default=0)
    return Manifest(**json.loads(spark.read.text(_name(folder, version), wholetext=True).head()[0])) if version else Manifest()


def _publish(spark: SparkSession, folder: str, made: Manifest) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    draft, name = path(f"{folder}/_draft-{uuid.uuid4().hex}"), path(_name(folder, made.version))
    store = name.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(draft, False)
    out.write(bytearray(json.dumps(made.__dict__).encode()))
    out.close()
    if store.exists(name) or not store.rename(draft, name):
        store.delete(draft, False)
        raise RuntimeError(f"version {made.version} was published by another writer")


def _read(spark: SparkSession, paths: dict[str, str], schema: T.StructType, only: list[int] | None = None) -> DataFrame:
    chosen = [p for k, p in sorted(paths.items()) if only is None or int(k) in only]
    return spark.read.schema(schema).parquet(*chosen) if chosen else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The published results, or those of an earlier version. Nothing published is an error."""
    known = manifest(spark, folder, version)
    if not known.version:
        raise ValueError(f"nothing is published in {folder}")
    return _read(spark, known.rows, T.StructType.fromJson(known.schema))


def digests(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, digest`` of the rows of each document, whatever their order: sums of two hashes, and their number."""
    told = []
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            told.append(F.to_json(F.struct(c), {"ignoreNullFields": "false"}))
        elif f.name != key:  # a hash passes over nulls, and takes both zeros for one
            told += [c.isNull(), c.cast("string") if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c]
    sums = [F.sum(F.xxhash64(F.lit(i), *told).cast("decimal(20,0)")).cast("string") for i in (1, 2)]
    return rows.groupBy(key).agg(F.concat_ws("/", *sums, F.count(F.lit(1)).cast("string")).alias("digest"))


def _without(rows: DataFrame, moved: DataFrame, key: str, how: str) -> DataFrame:
    return rows.join(moved.select(F.col(key).alias("_moved")), F.col(key).eqNullSafe(F.col("_moved")), how)


def refresh(rows: DataFrame, folder: str, compute: Callable[[DataFrame], DataFrame], *, key: str = "doc_id", parts: int = PARTS) -> Refreshed:
    """Brings the results in ``folder`` up to ``compute(rows)``, computing only documents whose rows are not as they were.

    ``rows`` may have several rows a document, in any order. ``compute`` treats documents apart from each other and gives
    rows that have ``key``, none or several a document, always in the same columns. A null ``key`` is a document.
    ``parts`` is fixed by the first version. Shuffle files and working tables go as soon as they are used. Files of earlier versions stay, so their readers are not disturbed.
    """
    spark, old = rows.sparkSession, manifest(rows.sparkSession, folder)
    parts = old.parts if old.version else parts
    work = f"{folder}/data/v{old.version + 1:09d}-{uuid.uuid4().hex[:8]}"
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    new = written_table(digests(rows, key).withColumn("part", part), f"{work}/digests")
    before = _read(spark, old.seen, new.drop("part").schema).select(F.col(key).alias("_key"), F.col("digest").alias("_digest"))
    both = new.join(before, F.col(key).eqNullSafe(F.col("_key")), "full").filter(~F.col("digest").eqNullSafe(F.col("_digest")))
    gone = F.col("digest").isNull()
    moved = both.select(F.when(gone, F.col("_key")).otherwise(F.col(key)).alias(key), gone.alias("gone")).withColumn("part", part)
    moved = written_table(moved, f"{work}/moved")
    counts = moved.groupBy("part").agg(F.sum(F.col("gone").cast("long")).alias("gone"), F.count(F.lit(1)).alias("n")).collect()  # ``parts`` rows at most
    touched = sorted(r["part"] for r in counts)
    if not touched and old.version:
        drop_table(spark, work)
        return Refreshed(old.version, 0, 0, 0)
    made = compute(_without(rows, moved.filter("not gone"), key, "left_semi") if old.version else rows)  # at first all are new
    schema = T.StructType.fromJson(old.schema) if old.version else made.schema
    kept = _without(_read(spark, old.rows, schema, touched), moved, key, "left_anti")
    whole = kept.unionByName(made.select(*schema.names)).withColumn("part", part)
    with shuffles_removed(spark):
        whole.repartition("part").write.partitionBy("part").parquet(f"{work}/rows")
        new.filter(F.col("part").isin(touched)).repartition("part").write.partitionBy("part").parquet(f"{work}/seen")
    for name in ("digests", "moved"):  # no version names these
        drop_table(spark, f"{work}/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(work).getFileSystem(spark._jsc.hadoopConfiguration())
    now = Manifest(old.version + 1, parts, json.loads(schema.json()))
    for kind in ("rows", "seen"):
        written = {p: f"{work}/{kind}/part={p}" for p in touched if store.exists(path(f"{work}/{kind}/part={p}"))}
        stays = {k: p for k, p in getattr(old, kind).items() if int(k) not in touched}
        setattr(now, kind, stays | {str(k): p for k, p in written.items()})
    _publish(spark, folder, now)
    lost = sum(r["gone"] for r in counts)
    return Refreshed(now.version, sum(r["n"] for r in counts) - lost, lost, len(touched))
