"""As-of and interval joins by time buckets: equality joins and short windows, never all pairs of a key.

Times fall into buckets of a fixed width. An as-of join looks for a row's match within its own bucket, and if there is
none takes the last row of the latest bucket before it, which is carried from bucket to bucket. So a key that holds very
many rows is as many pieces of work as it has buckets, and rows that share key and time are one while matches are sought.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(t: str) -> Column:
    return F.unix_micros(F.col(f"`{t}`").cast("timestamp"))


def _width(interval: timedelta) -> int:
    return interval // timedelta(microseconds=1)


def _record(columns: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in columns])


def asof_join(
    left: DataFrame, right: DataFrame, *, on: dict[str, str], left_time: str, right_time: str, tolerance: timedelta | None = None,
    exact: bool = True, prefix: str = "", bucket: timedelta = timedelta(days=1),
) -> DataFrame:
    """Every row of ``left`` with the last row of ``right`` of its key at or before its time; nulls where there is none.

    ``on`` maps key columns of ``left`` to those of ``right``. ``tolerance`` bounds how long before the match may be (at
    that distance it still is one); without ``exact`` it must be before. Of rows of ``right`` with equal key and time the one
    whose other columns are greatest counts. Columns of ``right`` but its keys follow, each after ``prefix``. Rows of
    either side with a null key or time match nothing; those of ``left`` stay. ``bucket`` is the width of a piece of work; it
    changes no result.
    """
    wide = _width(bucket)
    taken = [c for c in right.columns if c not in on.values()]
    clash = {prefix + c for c in taken} & set(left.columns)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}; give another prefix")
    lkey = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(on)])
    rkey = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(on.values())])
    known = [F.col(f"`{c}`").isNotNull() for c in on]
    usable = known[0]
    for more in [*known[1:], F.col(f"`{left_time}`").isNotNull()]:
        usable = usable & more
    rows = left.select(_record(left.columns).alias("row"), F.when(usable, lkey).alias("key"), F.when(usable, _micros(left_time)).alias("at"))
    found = right.filter(" and ".join(f"`{c}` is not null" for c in [*on.values(), right_time]))
    found = found.select(rkey.alias("key"), _micros(right_time).alias("at"), _record(taken).alias("match"))
    found = found.groupBy("key", "at").agg(F.max("match").alias("match"))
    times = rows.filter("key is not null").select("key", "at").distinct()
    part = F.floor(F.col("at") / wide).alias("part")
    both = found.select("key", part, "at", F.struct("at", "match").alias("hit"), F.lit(False).alias("asks")).unionByName(
        times.select("key", part, "at", F.lit(True).alias("asks")), allowMissingColumns=True
    )
    # In order of time, what is asked for stands behind what it may match.
    inside = Window.partitionBy("key", "part").orderBy("at", F.desc("asks") if not exact else F.asc("asks"))
    near = both.withColumn("hit", F.last("hit", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lasts = found.groupBy("key", part).agg(F.max(F.struct("at", "match")).alias("hit"))
    parts = lasts.unionByName(times.select("key", part).distinct(), allowMissingColumns=True).groupBy("key", "part").agg(F.max("hit").alias("hit"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("carried", F.last("hit", ignorenulls=True).over(before)).select("key", "part", "carried")
    hit = F.coalesce("hit", "carried")
    answers = near.filter("asks").join(carried, ["key", "part"]).select("key", "at", hit.alias("hit"))
    if tolerance is not None:
        answers = answers.withColumn("hit", F.when(F.col("at") - F.col("hit.at") <= _width(tolerance), F.col("hit")))
    answers = answers.filter("hit is not null").select("key", "at", "hit.match")
    out = rows.join(answers, ["key", "at"], "left")
    return out.select("row.*", *[F.col(f"match.`{c}`").alias(prefix + c) for c in taken])


def interval_join(
    left: DataFrame, right: DataFrame, *, on: dict[str, str], left_time: str, right_time: str, before: timedelta, after: timedelta, prefix: str = "",
) -> DataFrame:
    """Pairs of rows of one key with ``right``'s time from ``before`` ahead of ``left``'s to ``after`` behind it, both ends included.

    Buckets are as wide as the interval, so a row of ``left`` meets two of them at most and the join is one of equal
    keys and buckets. Rows with a null key or time pair with nothing. Columns of ``right`` but its keys follow, after ``prefix``.
    """
    low, high = _width(before), _width(after)
    if low + high < 0:
        raise ValueError("the interval is empty")
    wide = max(low + high, 1)
    taken = [c for c in right.columns if c not in on.values()]
    clash = {prefix + c for c in taken} & set(left.columns)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}; give another prefix")
    keys = [f"k{i}" for i in range(len(on))]
    span = F.sequence(F.floor((F.col("at") - low) / wide), F.floor((F.col("at") + high) / wide))
    rows = left.select(_record(left.columns).alias("row"), *[F.col(f"`{c}`").alias(k) for k, c in zip(keys, on, strict=True)], _micros(left_time).alias("at"))
    rows = rows.filter("at is not null").select("*", F.explode(span).alias("part"))
    found = right.select(_record(taken).alias("match"), *[F.col(f"`{c}`").alias(k) for k, c in zip(keys, on.values(), strict=True)], _micros(right_time).alias("then"))
    found = found.withColumn("part", F.floor(F.col("then") / wide))
    pairs = rows.join(found, [*keys, "part"]).filter((F.col("then") >= F.col("at") - low) & (F.col("then") <= F.col("at") + high))
    return pairs.select("row.*", *[F.col(f"match.`{c}`").alias(prefix + c) for c in taken])
