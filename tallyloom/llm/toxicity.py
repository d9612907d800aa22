"""Toxicity classifier with counterfactual regularisation.

A text is the set of its distinct lower-cased words, each with its first 4, 5 and 6 bytes as
further features, hashed; features that hardly tell the labels apart are left out. The
logistic model is trained on labelled texts and, beside each text that names a group of
people, on its counterfactual twin: the text with every identity term swapped for another
of its kind and language, again a set of features. The squared change of the score (before the logistic function)
between twins is a penalty, as is the change between any two terms of a kind, so neutral
mentions of a group don't move the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.pu_quality import held_out, training_rows, training_texts
from tallyloom.llm.shared import chunks, cut, list_column
from tallyloom.llm.words import U, Words, hashes, mix, scan

#: Labelled rows of each label that training uses at most, of smallest id hash.
ROWS_A_LABEL = 5000
BITS = 22
PREFIXES = (4, 5, 6)
#: Training rows that a feature must stand in, and how far the labels' rates must differ, in standard errors.
LEAST_ROWS, LEAST_Z = 3, 3.0

# Identity terms by kind and language; a term is swapped for the next of its row.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"), ("gay", "straight"), ("lesbian", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american"), ("immigrants", "natives", "refugees"), ("old", "young"),
    ("disabled", "deaf", "blind"), ("trans", "cis"),
    ("frauen", "männer"), ("frau", "mann"), ("schwule", "heteros"), ("muslime", "christen", "juden"), ("ausländer", "deutsche"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos"), ("inmigrantes", "nativos"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs"), ("immigrés", "français"),
)


def _code(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> U(64 - BITS)).astype(np.int64)


def word_features(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word number and feature number of each feature of each word."""
    length = words.end - words.start
    owner, code = [np.arange(len(length))], [_code(words.hash)]
    for k in PREFIXES:
        at = np.flatnonzero(length > k)
        owner.append(at)
        code.append(_code(mix(hashes(data, words.start[at], words.start[at] + k, True) + U(k))))
    return np.concatenate(owner), np.concatenate(code)


def _term_features(term: str) -> np.ndarray:
    raw = np.frombuffer(term.encode(), np.uint8)
    words = scan(raw, np.array([0, len(raw)]), lower=True, letters=True)
    return word_features(raw, words)[1]


def _swaps() -> dict[int, tuple[str, str]]:
    found = {}
    for row in IDENTITY_TERMS:
        for a, b in zip(row, (*row[1:], row[0]), strict=True):
            raw = np.frombuffer(a.encode(), np.uint8)
            found[int(scan(raw, np.array([0, len(raw)]), lower=True, letters=True).hash[0])] = (a, b)
    return found


def _distinct(rows: int, doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc.astype(np.int64) << BITS | code)
    doc = both >> BITS
    return (both & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(doc, np.arange(rows + 1))


def _featurer():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swaps = _swaps()
        terms, none = np.array(sorted(swaps), np.uint64), np.zeros(0, np.int32)
        for batch, data, offs in chunks(batches, "text"):
            words = scan(data, offs, lower=True, letters=True)
            doc = np.repeat(np.arange(batch.num_rows), words.count())
            owner, code = word_features(data, words)
            flat, at = _distinct(batch.num_rows, doc[owner], code)
            swapped = np.isin(words.hash, terms)
            rest, edge = _distinct(batch.num_rows, doc[owner[~swapped[owner]]], code[~swapped[owner]])
            plus, minus = [none] * batch.num_rows, [none] * batch.num_rows
            for i in np.unique(doc[swapped]).tolist():
                a, b = words.first[i], words.first[i + 1]
                new = [_term_features(swaps[h][1]).astype(np.int32) for h in words.hash[a:b][swapped[a:b]].tolist()]
                own, twin = flat[at[i] : at[i + 1]], np.concatenate([rest[edge[i] : edge[i + 1]], *new])
                plus[i], minus[i] = np.setdiff1d(own, twin), np.setdiff1d(twin, own)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), list_column(flat, at, pa.int32()), pa.array(plus, kind), pa.array(minus, kind)],
                names=["label", "x", "plus", "minus"],
            )

    return run


@dataclass
class Model:
    """Chosen features (sorted), their weights, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        rows = len(offs) - 1
        words = scan(data, offs, lower=True, letters=True)
        doc = np.repeat(np.arange(rows), words.count())
        owner, code = word_features(data, words)
        known = self._known[code]
        owner, code = owner[known], code[known]
        flat, at = _distinct(rows, doc[owner], code)
        weight = self.weights[np.searchsorted(self.features, flat)]
        z = self.bias + np.bincount(np.repeat(np.arange(rows), np.diff(at)), weights=weight, minlength=rows)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def __post_init__(self) -> None:
        self._known = np.zeros(1 << BITS, bool)
        self._known[self.features] = True


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    return owner, np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)


def apart(n: Column, n1: Column, total: int, yes: int) -> Column:
    """How far, in standard errors, the log odds of a feature's rows with and without the label are apart."""

    def odds(x: Column) -> Column:
        return F.log(x / (1 - x))

    a, b = (n1 + 0.5) / (yes + 1), (n - n1 + 0.5) / (total - yes + 1)
    return F.abs(odds(a) - odds(b)) / F.sqrt(1 / (n1 + 0.5) + 1 / (n - n1 + 0.5))


def _chooser(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for column in batch.columns[1:]:
                flat = column.flatten().to_numpy(zero_copy_only=False)
                at = np.searchsorted(features, flat)
                ok = features[np.minimum(at, len(features) - 1)] == flat if len(features) else np.zeros(len(flat), bool)
                ends = np.concatenate([[0], np.cumsum(ok)])[np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])]
                kept.append(list_column(at[ok].astype(np.int32), ends, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *kept], names=batch.schema.names)

    return run


def objective(
    w: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, twins: list[tuple[np.ndarray, np.ndarray]], fairness: float, l2: float
) -> tuple[float, np.ndarray]:
    """Mean logistic loss, ``l2 / 2`` times the squared weights and ``fairness`` times the mean squared change of twins' scores; its gradient.

    ``w`` has the weight of each feature, then the intercept; a twin is what it loses and what it gains.
    """
    return _objective(w, _flat(rows), labels, _flat([p for p, _ in twins]), _flat([m for _, m in twins]), len(twins), fairness, l2)


def _objective(w, flat, labels, lose, gain, n_twins, fairness, l2) -> tuple[float, np.ndarray]:
    size, total = len(w) - 1, max(len(labels), 1)

    def sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(at, weights=values, minlength=n).astype(float)  # of nothing, it counts in integers

    owner, column = flat
    z = w[-1] + sums(owner, w[column], len(labels))
    value = (np.logaddexp(0, z) - labels * z).sum() / total + l2 / 2 * (w[:-1] ** 2).sum()
    g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / total
    grad = np.append(sums(column, g[owner], size) + l2 * w[:-1], g.sum())
    if n_twins:
        change = sums(lose[0], w[lose[1]], n_twins) - sums(gain[0], w[gain[1]], n_twins)
        value += fairness * (change**2).sum() / n_twins
        change = 2 * fairness / n_twins * change
        grad[:-1] += sums(lose[1], change[lose[0]], size) - sums(gain[1], change[gain[0]], size)
    return value, grad


def fit(
    features: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, twins: list[tuple[np.ndarray, np.ndarray]], *,
    fairness: float = 1.0, l2: float = 2e-5, steps: int = 300, rate: float = 0.05,
) -> Model:
    """Model from numbers of chosen features in each row, labels, and what twins lose and gain against each other."""
    flat, lose, gain = _flat(rows), _flat([p for p, _ in twins]), _flat([m for _, m in twins])
    yes, size = labels.sum(), len(features)
    w = np.append(np.zeros(size), np.log((yes + 1) / (len(labels) - yes + 1)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for i in range(1, steps + 1):
        grad = _objective(w, flat, labels, lose, gain, len(twins), fairness, l2)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    return Model(features, w[:-1], float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows: int = ROWS_A_LABEL, fairness: float = 1.0) -> Model:
    """Model from at most ``rows`` labelled texts of each label, held-out rows left out.

    Of rows that share an id one text is learned from; an id labelled both ways is not learned from.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = training_rows(labels, label, rows, 1).withColumn("label", F.lit(1)).unionAll(
        training_rows(labels, label, rows, 0).withColumn("label", F.lit(0))
    )
    given = training_texts(plain, wanted, "label")  # 2 * rows at most
    kinds = "label int, x array<int>, plus array<int>, minus array<int>"
    found = cut(given.mapInArrow(_featurer(), kinds), "features")
    n = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    yes, total = n.get(1, 0), sum(n.values())
    if not yes or yes == total:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0 if not total else (5.0 if yes else -5.0))
    met = found.select("label", F.explode("x").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n1"))
    good = met.filter((F.col("n") >= LEAST_ROWS) & (apart(F.col("n"), F.col("n1"), total, yes) > LEAST_Z))
    features = np.array(sorted(r["code"] for r in good.select("code").collect()), np.int64)  # 2**BITS at most
    table = found.mapInArrow(_chooser(features), kinds).toArrow()  # chosen features of 2 * rows texts
    x = [np.asarray(v, np.int32) for v in table.column("x").to_numpy()]
    y = table.column("label").to_numpy().astype(float)
    order = sorted(range(len(y)), key=lambda i: (y[i], x[i].tobytes()))  # the order of rows must not matter
    twins = [
        (np.array(p, np.int32), np.array(m, np.int32)) for p, m in zip(table.column("plus").to_pylist(), table.column("minus").to_pylist(), strict=True) if p or m
    ]
    twins.sort(key=lambda t: (t[0].tobytes(), t[1].tobytes()))

    def chosen(term: str) -> np.ndarray:
        code = _term_features(term)
        at = np.minimum(np.searchsorted(features, code), max(len(features) - 1, 0))
        return at[features[at] == code].astype(np.int32) if len(features) else np.zeros(0, np.int32)

    twins += [(chosen(a), chosen(b)) for row in IDENTITY_TERMS for a, b in zip(row, (*row[1:], row[0]), strict=True)]
    return fit(features, [x[i] for i in order], y[order], twins, fairness=fairness)


def _scorer(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in chunks(batches, "text"):
            score = model.scores(data, offs)
            given = pa.array((score >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), given], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    ``docs`` needs ``doc_id`` and ``text``; no other column is an input. Null and empty texts
    have no features and get the intercept's score. A null ``doc_id`` counts as held out.
    Repeated rows get equal scores; an empty table gives no rows. Without labelled rows
    every score is 0.5.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = plain.mapInArrow(_scorer(model, threshold), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """:func:`learn` and :func:`score` in one."""
    return score(docs, learn(docs, labels), threshold=threshold)
