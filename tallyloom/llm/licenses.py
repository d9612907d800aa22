"""License scanning by diagonal voting.

All rolling word k-gram hashes of all documents are joined to the positions of those
k-grams in license templates: sentences of notices, and whole license texts in parts. A match at word ``i`` of a document and word
``j`` of a template votes for the diagonal ``i - j``; votes are summed by document, template
and diagonal. Neighbouring diagonals (words inserted or left out) are merged to spans, and
the words of each span are then compared with the template's. The votes asked for are as
many as stay when so many words are replaced, however scattered, that ``COVER`` just holds.
The matched words of a whole text's parts add up to the share of that text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache
from importlib import resources
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.shared import chunks, cut, list_column
from tallyloom.llm.words import grams, scan

# Phrases that name a license, and the label of each.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Sentences that stand in license notices, by the method's own labels.
TEMPLATES = (
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-warranty", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit-notice", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-warranty", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-notice", "licensed under cc by 4 0"),
    ("cc-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Words of a k-gram.
K = 3
#: Diagonals at most this far apart are one span.
DRIFT = 3
#: Share of a template's words that a verified span matches.
COVER = 0.75
#: Words of a part of a whole license text; its last part has the rest too, up to twice as many.
PART = 60


class Template(NamedTuple):
    """Words to be found, the label that they speak for, and their share of all its words (null: they speak alone)."""

    label: str
    text: str
    weight: float | None = None


@cache
def whole_texts() -> tuple[tuple[str, str], ...]:
    """``label, text`` of the license texts that come with the package; a label is the name of its file."""
    files = sorted((f for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return tuple((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in files)


def templates_of(sentences=TEMPLATES, wholes=None, part: int = PART) -> list[Template]:
    """All templates to be found: ``sentences`` as they are, ``wholes`` (null: those of the package) in parts of ``part`` words."""
    found = [Template(label, text) for label, text in sentences]
    for label, text in whole_texts() if wholes is None else wholes:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        starts = range(0, max(len(words) - part, 0) + 1, part) if words else ()
        for at in starts:
            own = words[at:] if at == starts[-1] else words[at : at + part]
            found.append(Template(label, " ".join(own), len(own) / len(words)))
    return found


def _hash_words(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return scan(raw, np.array([0, len(raw)]), lower=True, letters=True).hash


def template_grams(spark: SparkSession, templates: list[Template], k: int = K) -> DataFrame:
    """``gram, template, at``: where each k-gram stands in the templates; as many rows as they have words at most."""
    rows = []
    for t, one in enumerate(templates):
        rows += [(int(g), t, j) for j, g in enumerate(grams(_hash_words(one.text.split()), k).view(np.int64))]
    return spark.createDataFrame(rows, "gram long, template int, at int")


def template_facts(spark: SparkSession, templates: list[Template], k: int = K) -> DataFrame:
    """``template, label, weight, needed``: one row a template."""
    rows = [(t, one.label, one.weight, least_votes(len(one.text.split()), k)) for t, one in enumerate(templates)]
    return spark.createDataFrame(rows, "template int, label string, weight double, needed int")


def _scanner(k: int, rolling: bool):
    """Base columns of each text or, with ``rolling``, its k-gram hashes."""
    wanted = [(label, _hash_words(phrase.split())) for phrase, label in PHRASES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in chunks(batches, "text"):
            words = scan(data, offs, lower=True, letters=True)
            n = batch.num_rows
            if rolling:
                g = grams(words.hash, k)
                size = np.maximum(words.count() - k + 1, 0)
                keep = np.arange(len(g)) + k <= np.repeat(words.first[1:], words.count())[: len(g)]
                flat = list_column(g[keep].view(np.int64), np.concatenate([[0], np.cumsum(size)]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["doc_id", "tag", "grams"])
                continue
            hits_at, hits_label = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            doc_of = np.repeat(np.arange(n), words.count())
            for number, (_, phrase) in enumerate(wanted):
                m = len(words.hash) - len(phrase) + 1
                if m <= 0:
                    continue
                ok = words.hash[:m] == phrase[0]
                for i, h in enumerate(phrase[1:], 1):
                    ok &= words.hash[i : i + m] == h
                found = np.flatnonzero(ok)
                found = found[doc_of[found] == doc_of[found + len(phrase) - 1]]
                hits_at.append(found)
                hits_label.append(np.full(len(found), number))
            at, label = np.concatenate(hits_at), np.concatenate(hits_label)
            order = np.argsort(at, kind="stable")
            at, label = at[order], label[order]
            doc = doc_of[at] if len(at) else at
            edges = np.searchsorted(doc, np.arange(n + 1))
            first, last, names = [], [], []
            for r in range(n):
                own = slice(edges[r], edges[r + 1])
                inside = at[own] - words.first[r]
                first.append(int(inside[0]) if len(inside) else None)
                last.append(int(inside[-1]) if len(inside) else None)
                names.append(sorted({wanted[x][0] for x in label[own].tolist()}))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(words.count(), pa.int64()), pa.array(np.diff(edges), pa.int64()),
                    pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(names, pa.list_(pa.string())),
                ],
                names=["doc_id", "tag", "n_words", "n_base", "first_word", "last_word", "base"],
            )

    return run


_SCAN = "doc_id long, tag long, n_words long, n_base long, first_word long, last_word long, base array<string>"


def in_order(template: list[bytes], words: list[bytes]) -> int:
    """Words of the longest common subsequence; a bit of ``row`` that is 0 is a step of the usual table's row."""
    places: dict[bytes, int] = {}
    for j, w in enumerate(template):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(template)) - 1
    row = full
    for w in words:
        met = row & places.get(w, 0)
        row = ((row + met) | (row - met)) & full
    return len(template) - row.bit_count()


def verify(words: list[bytes], template: list[bytes]) -> float:
    """Share of the template's words that stand, in order, in a span of words.

    Spans of over three times the template are gone over in windows of twice its length.
    """
    n = len(template)
    if len(words) <= 3 * n:
        return in_order(template, words) / n
    return max(in_order(template, words[at : at + 2 * n]) for at in range(0, len(words), max(1, n // 2))) / n


def least_votes(length: int, k: int = K) -> int:
    """k-grams that a template of ``length`` words shares at least with a text in which so many words are replaced that ``COVER`` just holds."""
    return max(1, length - k + 1 - k * (length - math.ceil(COVER * length)))


def _verifier(templates: list[Template]):
    texts = [[w.encode() for w in one.text.split()] for one in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in chunks(batches, "text"):
            words = scan(data, offs, lower=True, letters=True)
            raw = data.tobytes()
            ids, tags, template, score = [], [], [], []
            for r, (spans, doc, tag) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                base, top = int(words.first[r]), int(words.first[r + 1])
                for s in spans:
                    goal = texts[s["template"]]
                    low = max(0, s["low"])
                    high = min(top - base, s["high"] + len(goal))
                    own = [raw[a:b].lower() for a, b in zip(words.start[base + low : base + high].tolist(), words.end[base + low : base + high].tolist(), strict=True)]
                    ids.append(doc)
                    tags.append(tag)
                    template.append(s["template"])
                    score.append(verify(own, goal))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(template, pa.int32()), pa.array(score, pa.float64())],
                names=["doc_id", "tag", "template", "share"],
            )

    return run


def spans(scanned: DataFrame, templates: list[Template], k: int = K) -> DataFrame:
    """Merged diagonals: ``doc_id, tag, template, low, high, votes``; repeated rows vote once."""
    known = F.broadcast(template_grams(scanned.sparkSession, templates, k))
    needed = F.broadcast(template_facts(scanned.sparkSession, templates, k).select("template", "needed"))
    rolling = scanned.select("doc_id", "tag", F.posexplode("grams").alias("i", "gram"))
    votes = (
        rolling.join(known, "gram").groupBy("doc_id", "tag", "template", (F.col("i") - F.col("at")).alias("diagonal"))
        .agg(F.count_distinct("at").alias("votes"))
    )
    along = Window.partitionBy("doc_id", "tag", "template").orderBy("diagonal")
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT, F.lit(True)).cast("int")
    merged = (
        votes.withColumn("opens", opens).withColumn("island", F.sum("opens").over(along))
        .groupBy("doc_id", "tag", "template", "island")
        .agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"))
    )
    return merged.join(needed, "template").filter(F.col("votes") >= F.col("needed")).drop("island", "needed")


def scan_licenses(docs: DataFrame, *, sentences=TEMPLATES, wholes=None, k: int = K) -> DataFrame:
    """License phrases and notices of each text.

    Gives ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``, one row
    per input row. ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Words are
    runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. ``n_base``
    counts the places of all phrases of ``PHRASES``; ``labels`` has their labels and those of
    templates of which a span matches ``COVER`` of the words, and those of whole license texts
    (``wholes``, pairs of label and text) whose parts' spans match ``COVER`` of all words
    together; ``score`` is the best such share, 1 where a phrase stands. Labels are
    distinct, sorted and comma-joined.

    Null and empty texts have no words, empty labels and score 0. A null ``doc_id`` is scanned
    like any other; rows with equal ``doc_id`` and text get the same result. An empty table
    gives no rows.
    """
    templates = templates_of(sentences, wholes)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text"))
    scanned = plain.mapInArrow(_scanner(k, True), "doc_id long, tag long, grams array<long>")
    voted = cut(spans(scanned, templates, k), "spans")
    listed = voted.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("template", "low", "high")).alias("spans"))
    listed = listed.withColumnsRenamed({"doc_id": "of", "tag": "of_tag"})
    found = plain.join(listed, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag")))
    checked = found.select("text", "spans", "doc_id", "tag").mapInArrow(_verifier(templates), "doc_id long, tag long, template int, share double")
    facts = F.broadcast(template_facts(docs.sparkSession, templates, k).drop("needed"))
    shares = checked.groupBy("doc_id", "tag", "template").agg(F.max("share").alias("share")).join(facts, "template")
    by_label = shares.groupBy("doc_id", "tag", "label").agg(
        F.greatest(F.max(F.when(F.col("weight").isNull(), F.col("share"))), F.sum(F.col("share") * F.col("weight"))).alias("share")
    )
    best = by_label.filter(F.col("share") >= COVER).groupBy("doc_id", "tag").agg(
        F.max("share").alias("share"), F.collect_set("label").alias("own")
    )
    best = best.withColumnsRenamed({"doc_id": "of", "tag": "of_tag"})
    base = plain.mapInArrow(_scanner(k, False), _SCAN)
    out = base.join(best, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag")), "left")
    none = F.array().cast(T.ArrayType(T.StringType()))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", none))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
