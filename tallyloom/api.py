"""The engine's surface: tables in, tables out.

    lines = cluster_words(words)
    fields = parse_lines(lines)
    rows = score(fields, words)
    best = select_attempt(attempts)
    best = enrich(best, stamps)
    states = classify(best)
    responses = scan(words, ted=stamps, pages=pages, files=files)
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyloom.config import Settings
from tallyloom.operators.attempts import best_attempt as select_attempt
from tallyloom.operators.fields import lines_of
from tallyloom.operators.pipeline import scan, score_fields, to_json
from tallyloom.operators.products import parse_receipts as parse_lines
from tallyloom.operators.state import classify, respond
from tallyloom.operators.ted import enrich, parse_ted
from tallyloom.operators.validation import check_files, rejections
from tallyloom.operators.words import best_runs, clean_words, run_scores
from tallyloom.operators.words import words_to_lines as cluster_words

__all__ = [
    "Settings", "best_runs", "check_files", "classify", "clean_words", "cluster_words", "enrich", "lines_of", "parse_lines", "parse_text",
    "parse_ted", "rejections", "respond", "run_scores", "scan", "score", "select_attempt", "to_json",
]


def parse_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fields and products of receipts given as whole texts."""
    return parse_lines(lines_of(docs, text))


def score(fields: DataFrame, words: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Fields with confidences, checks and the general confidence; the words' mean stands in where no field has one."""
    return score_fields(fields, words, settings=settings)
