"""A corpus pipeline: quality filter, deduplication, mixing and packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import minhash, mixing, packing, pu_quality, superkmer
from tallyloom.llm.queries import tokenizer_path
from tallyloom.llm.shared import cut, small_or_plain

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.3 or more), unchanged.

    Null and empty texts are scored as texts without words; very long ones whole. Repeated rows
    and rows of one id are judged each by its text; a null id is never learned from. Without
    labels every score is 0.5, so all stay. An empty table gives an empty one. Columns other
    than those of documents are dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = pu_quality.classify(docs, labels, keep=COLUMNS[1:])
    return scored.filter("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each near-duplicate group of five-word shingles at 0.8, unchanged.

    Texts without words are no duplicates of each other and stay. Of rows that repeat both id and
    text one stays; other texts of a kept id stay. Rows with a null id take no part and stay.
    An empty table gives an empty one. Columns other than those of documents are dropped.
    """
    groups = minhash.near_duplicates(docs, words=5, percent=80)
    gone = groups.filter("not kept").select("doc_id").distinct()
    rest = docs.join(small_or_plain(gone), "doc_id", "left_anti").select(*COLUMNS)
    repeated = small_or_plain(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"))
    once = rest.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(repeated, "doc_id", "left_anti").unionByName(once)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 20-word passages that stand earlier; those with nothing left go.

    A text that loses words has those left, joined by single spaces, and ``n_chars`` counts them;
    others are unchanged, also null, empty and very long ones. Rows that repeat id and text are
    one document; null ids come last. An empty table gives an empty one. Columns other than
    those of documents are dropped.
    """
    cleaned = superkmer.remove_repeats(docs, width=20, keep=COLUMNS[2:], with_text=True)
    cleaned = cleaned.filter("n_words = 0 or n_removed < n_words")
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", length).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as laps of its source's blocks take it.

    A copy that a source's target cuts keeps the words taken, and ``n_chars`` counts them; all
    else is as it was. Null and empty texts have no words to take and go, so does an empty
    table. Repeated rows are documents of their own; null ids and sources are ordinary.
    """
    mixed = mixing.mixed_copies(docs, keep=COLUMNS[2:])
    whole = docs.select(*COLUMNS).schema["n_chars"].dataType
    length = F.when(F.col("cut"), F.length("text")).otherwise(F.col("n_chars")).cast(whole)
    return mixed.withColumn("n_chars", length).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 1024 tokens: the columns of ``packing.pack``.

    A null or empty text is its end token alone; very long texts become many pieces. Repeated rows
    and null ids are packed each; an empty table gives no pieces. Other columns are dropped.
    """
    return packing.pack(docs, tokenizer_path(), limit=1024, end=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the classifier or the tokenizer.
ORACLE_SQL = None
