"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Sources get shares of all words by weight, none more than ``most`` times its own words (water
filling). A source's documents are shuffled to a line of words and cut into blocks of ``block``
words. Slot ``i`` of the schedule stands at the van der Corput point of ``i`` (its bits
reversed), which falls into one source's interval of the cumulative number of blocks that the
targets need. Slots are ranked within their source; rank ``r`` takes block ``r`` modulo the
line's blocks, in lap ``r`` divided by them, until the source has its rounded target, so a
last block may be cut. Slots are joined with blocks, and blocks with the documents in them.

``2**k`` points are dealt, of which each is used once, so an interval of ``q`` in ``2**k`` or
more holds ``q`` points at least: every source, however small, finds its blocks.

Everything is DataFrame expressions. Ranks and prefix sums are made in two levels (ranges,
then rows within a range), so neither a source that holds a third of all rows nor the whole
schedule is one task's work; only tables of one row a source are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import cut

WORDS = r"[^\x20\x09-\x0D]+"
#: Words of a block.
BLOCK = 1024
#: Pieces of the schedule's interval by which slots meet their sources, as a power of 2.
CELL_BITS = 12
#: Slots that are ranked together, as a power of 2, and documents aimed at in each hash range of a source.
RANGE_BITS, RANGE_DOCS = 16, 4096


def word_count(text: Column) -> Column:
    """Runs of bytes that are not ASCII white space; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Water-filled targets: adds ``place, target`` to ``source, source_size``.

    Sources in code-point order, null last, get the weights in turn. A target stops at
    ``most * source_size``; with sources sorted by that limit over weight, those that
    stop come first, so the common level is found by running sums over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_limit = Window.orderBy("ratio", "place")
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        sources.withColumn("place", F.row_number().over(order))
        .withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .withColumn("target", F.least(F.col("limit"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "place", "target")
    )


def plan_sources(sources: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = BLOCK) -> DataFrame:
    """:func:`targets` and what follows from them: ``laps`` whole laps of a source's line, then ``rest`` words of one.

    Adds ``blocks`` (of the line), ``need`` (slots of the source) and ``ahead`` (slots of sources before it).
    """
    size = F.col("source_size")
    words = F.least(F.round("target").cast("long"), size * most)
    line = F.greatest(size, F.lit(1))
    rows = targets(sources, weights=weights, most=most).withColumn("laps", F.floor(words / line)).withColumn("rest", words - F.col("laps") * size)
    blocks = F.ceil(size / block)
    rows = rows.withColumn("blocks", blocks).withColumn("need", F.col("laps") * blocks + F.ceil(F.col("rest") / block))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("ahead", F.coalesce(F.sum("need").over(before), F.lit(0)))


def van_der_corput(slot: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of ``slot`` in reverse order: its van der Corput point times ``2**bits``."""
    moved = [F.shiftleft(F.shiftright(slot, i).bitwiseAND(F.lit(1).cast("long")), bits - 1 - i) for i in range(bits)]
    return reduce(Column.bitwiseOR, moved, F.lit(0).cast("long"))


def schedule(plan: DataFrame) -> DataFrame:
    """The schedule: ``slot, place, block, lap, upto`` of every slot in use.

    ``plan`` is the result of :func:`plan_sources`. A slot takes its source's block up to word
    ``upto`` of the line. Slots meet sources by cells of the interval, an equality join.
    """
    spark = plan.sparkSession
    need = plan.agg(F.sum("need")).head()[0] or 0
    bits = max(CELL_BITS, (need - 1).bit_length())
    edge = "cast((cast({0} as decimal(19,0)) * %d + %d) div %d as bigint)" % (1 << bits, max(need, 1) - 1, max(need, 1))
    spans = plan.filter("need > 0").withColumns({"low": F.expr(edge.format("ahead")), "high": F.expr(edge.format("(ahead + need)"))})
    wide = bits - CELL_BITS
    cells = F.sequence(F.shiftright("low", wide), F.shiftright(F.col("high") - 1, wide))
    spans = spans.select("place", "low", "high", "need", "blocks", "laps", "rest", "source_size", "block", F.explode(cells).alias("cell"))
    dealt = spark.range(1 << bits if need else 0).withColumnRenamed("id", "slot")
    dealt = dealt.withColumn("point", van_der_corput(F.col("slot"), bits)).withColumn("cell", F.shiftright("point", wide))
    met = dealt.join(spans, "cell").filter("point >= low and point < high").withColumn("range", F.shiftright("slot", RANGE_BITS))
    earlier = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = met.groupBy("place", "range").agg(F.count(F.lit(1)).alias("n"))
    ranges = ranges.select("place", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    own = F.row_number().over(Window.partitionBy("place", "range").orderBy("slot")) - 1
    ranked = met.withColumn("own", own).join(ranges, ["place", "range"]).withColumn("turn", F.col("own") + F.col("earlier"))
    used = ranked.filter("turn < need").withColumns({"lap": F.floor(F.col("turn") / F.col("blocks")), "number": F.col("turn") % F.col("blocks")})
    end = F.least((F.col("number") + 1) * F.col("block"), F.when(F.col("lap") < F.col("laps"), F.col("source_size")).otherwise(F.col("rest")))
    return used.select("slot", "place", F.col("number").alias("block"), F.col("lap").cast("int").alias("lap"), end.alias("upto"))


def mix(
    docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = BLOCK, seed: int = 17,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """What the mix takes of each document: ``doc_id, size, source_size, target, taken, parts``.

    ``docs`` needs ``doc_id, text, source``; columns named in ``keep`` (and no others) are
    carried along, and no name of theirs matters. ``size`` counts runs other than ASCII white
    space; ``target`` is the source's, in words; ``taken`` the words that the source's slots
    take of the document, repeats counted, ``most * size`` at most. ``parts`` lists, by lap,
    ``lap, slot, words``: how many of the document's first words that lap takes, from which
    slot of the schedule on. ``seed`` changes the shuffle; reruns agree.

    A source's taken words are its rounded target. Null and empty texts have size 0 and
    nothing taken. Null sources are one source, last in order. Repeated rows are laid out one
    after another, each as its own document. A null ``doc_id`` is shuffled like any other value.
    An empty table gives no rows; if all sizes are 0, all targets are 0.
    """
    carried = [F.col(c).alias(f"_kept_{i}") for i, c in enumerate(keep)]
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("key"),
        F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"), *carried,
    )
    sized = cut(sized, "sizes")  # from here on ``row`` is a fixed number of each row
    narrow = sized.select("row", "source", "size", "key", "doc_id", "tie")
    ranges = max(1, -(-narrow.count() // RANGE_DOCS))
    part = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 32)).cast("long")
    narrow = narrow.withColumn("part", part)
    parts = cut(narrow.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "ranges")
    plan = plan_sources(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights=weights, most=most, block=block)
    plan = cut(plan.withColumn("block", F.lit(block)), "sources")
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = parts.withColumn("before", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)))
    facts = plan.select(F.col("source").alias("of"), "place", "source_size", "target")
    places = places.join(facts, F.col("source").eqNullSafe(F.col("of"))).select(
        "of", F.col("part").alias("of_part"), "before", "place", "source_size", "target"
    )
    own = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    laid = narrow.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0)))
    laid = laid.join(places, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).select(
        "row", "doc_id", "size", "source_size", "target", "place", (F.col("before") + F.col("within")).alias("start")
    )
    laid = cut(laid, "lines")
    end = F.col("start") + F.col("size")
    covered = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    pieces = laid.filter("size > 0").select("row", "place", "start", end.alias("end"), F.explode(covered).alias("block"))
    least, most_ = F.greatest("start", F.col("block") * block), F.least("end", "upto", (F.col("block") + 1) * block)
    met = pieces.join(schedule(plan), ["place", "block"]).withColumn("words", most_ - least).filter("words > 0")
    by_lap = met.groupBy("row", "lap").agg(F.min("slot").alias("slot"), F.sum("words").alias("words"))
    taken = by_lap.groupBy("row").agg(
        F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("lap", "slot", "words"))).alias("parts")
    )
    none = F.array().cast(taken.schema["parts"].dataType)
    out = laid.join(taken, "row", "left")
    if keep:
        out = out.join(sized.select("row", *[f"_kept_{i}" for i in range(len(keep))]), "row")
    return out.select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("parts", none).alias("parts"),
        *[F.col(f"_kept_{i}").alias(c) for i, c in enumerate(keep) if c != "doc_id"],
    )


def mixed_copies(docs: DataFrame, *, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """The mix itself: ``doc_id, text``, the columns in ``keep``, ``lap, slot, cut``, one row a copy of a document.

    A copy of which a lap takes all words has the text as it was; one that the source's target
    cuts (``cut``) has its first words, joined by single spaces.
    """
    found = mix(docs, keep=("text", *(c for c in keep if c not in ("doc_id", "text"))), **options)
    copies = found.withColumn("_part", F.explode("parts"))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), F.lit(1), F.col("_part.words").cast("int"))
    part = F.col("_part.words") < F.col("size")
    text = F.when(part, F.array_join(words, " ")).otherwise(F.col("text"))
    carried = [c for c in keep if c not in ("doc_id", "text")]
    return copies.select("doc_id", text.alias("text"), *carried, F.col("_part.lap").alias("lap"), F.col("_part.slot").alias("slot"), part.alias("cut"))
