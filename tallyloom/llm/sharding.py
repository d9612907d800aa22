"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a point ``u`` of (0, 1) for a key, from a hash of key and shard id alone, and
the shard with the largest ``ln(u) / weight`` takes the key. So a shard gets keys in proportion
to its weight, a shard that is added takes keys only into itself, one that goes gives up only
its own, and a weight that changes moves keys only to or from its shard.

Assignment is one narrow projection. Places within shards are counted in two levels: rows of the
written assignment are ranges of consecutive rows of a file, so a shard, or a key that very many
rows share, is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import cut

#: Rows of a file that are numbered together.
RANGE_ROWS = 8192
Weights = Mapping[int, float]


def even(shards: int | Iterable[int]) -> dict[int, float]:
    """Equal weights of shards ``0 .. shards - 1``, or of the shards listed."""
    return dict.fromkeys(range(shards) if isinstance(shards, int) else shards, 1.0)


def draw(key: Column, shard: int) -> Column:
    """The shard's point for a key, a double of the open interval (0, 1)."""
    high = F.shiftrightunsigned(F.xxhash64(key, F.lit(int(shard)).cast("long")), 11)
    return (high.cast("double") + 0.5) * F.lit(2.0**-53)


def shard_of(key: Column, weights: Weights) -> Column:
    """The shard that rendezvous hashing gives a key; shards of weight 0 get none, ties go to the smallest id.

    A null key is a key like any other. At least one weight must be above 0.
    """
    if any(not 0 <= w < float("inf") for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    live = sorted((s, float(w)) for s, w in weights.items() if w > 0)
    if not live:
        raise ValueError("no shard has a weight above 0")
    costs = [F.struct((-F.ln(draw(key, s)) / F.lit(w)).alias("cost"), F.lit(s).cast("int").alias("shard")) for s, w in live]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def assign(docs: DataFrame, key: str, weights: Weights, grown: Weights | None = None) -> DataFrame:
    """Adds ``shard``, and ``grown_shard`` by the weights ``grown`` if given. No shuffle."""
    out = docs.withColumn("shard", shard_of(F.col(key), weights))
    return out if grown is None else out.withColumn("grown_shard", shard_of(F.col(key), grown))


def number(assigned: DataFrame) -> DataFrame:
    """Adds ``slot``, the place of a row in its ``shard``: 0, 1, ... without gaps.

    The rows are written once; slots follow the order of the written rows, so they are the same
    however often a task is run again. A column named ``slot`` is replaced; others may have any names.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in assigned.columns if c != "slot"]).alias("record")
    written = cut(assigned.select(record), "assigned")
    shard, part = F.col("record.shard").alias("shard"), F.floor(F.col("_metadata.row_index") / RANGE_ROWS).alias("part")
    rows = written.select(shard, F.col("_metadata.file_name").alias("file"), part, F.col("_metadata.row_index").alias("row"), "record")
    counts = rows.groupBy("shard", "file", "part").agg(F.count(F.lit(1)).alias("n"))
    # Two levels: ranges within a file of the shard, files within the shard.
    files = counts.groupBy("shard", "file").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("shard", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    before = Window.partitionBy("shard", "file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    starts = starts.join(files, ["shard", "file"]).select("shard", "file", "part", (F.col("base") + F.col("ahead")).alias("start"))
    own = F.row_number().over(Window.partitionBy("shard", "file", "part").orderBy("row")) - 1
    placed = rows.withColumn("own", own).join(starts, ["shard", "file", "part"])
    return placed.select("record.*", (F.col("start") + F.col("own")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, *, shards: int = 40, grown: bool = True) -> DataFrame:
    """Shards 0 to ``shards - 1`` of documents by ``doc_id``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``law`` is ``key``: id and number of shards decide, so rows of one id share a shard, also null
    ids, and one more shard (``grown_shard``) takes rows only into itself. ``size`` is 16 more than
    the bytes of the text; a null text has none, and the checksum of no bytes, 0, like an empty one.
    Very long texts are hashed whole. Repeated rows get a slot each. Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = number(assign(rows, "doc_id", even(shards), even(shards + 1) if grown else None))
    last = F.col("grown_shard") if grown else F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", last)


def write_shards(docs: DataFrame, key: str, weights: Weights, path: str, rows: int = 100_000) -> None:
    """Writes whole records and their ``slot`` under ``path`` as Parquet: a folder ``shard=...`` for each shard that has any.

    A file holds up to ``rows`` records of consecutive slots, so neither a large shard nor a key
    that very many records share makes one large file or one long task.
    """
    placed = number(assign(docs, key, weights))
    piece = F.floor(F.col("slot") / rows)
    dealt = placed.repartition("shard", piece).sortWithinPartitions("shard", "slot")
    dealt.write.mode("errorifexists").option("maxRecordsPerFile", rows).partitionBy("shard").parquet(path)


def moves(docs: DataFrame, key: str, before: Weights, after: Weights) -> DataFrame:
    """``from_shard, to_shard, rows``: what changes of shards move, a row for each pair of shards that rows pass between."""
    pairs = docs.select(shard_of(F.col(key), before).alias("from_shard"), shard_of(F.col(key), after).alias("to_shard"))
    return pairs.groupBy("from_shard", "to_shard").agg(F.count(F.lit(1)).alias("rows"))
