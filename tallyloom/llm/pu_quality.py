"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are rows labelled 1; everything else a corpus holds is unlabelled. The class
prior is estimated from the two by the best-bin rule: for any region the share of unlabelled
rows in it is at least the prior times the share of positives, so the least upper bound of
the ratio over the score's upper tails is taken. The model is an additive one over binned
text statistics that minimises ``prior * R+ + max(0, Ru- - prior * R-)`` by the estimator's own
rule: along its gradient, and where the negative part is below 0, back along that part alone.

Scores are posterior probabilities of label 1. The rows of the gradient steps are a bounded
sample; the prior's histogram and the scores are each one pass over every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import chunks
from tallyloom.llm.words import scan

#: Trusted positives and unlabelled rows that training uses at most, of smallest id hash.
POSITIVES, UNLABELLED = 6000, 9000
BINS = 16
FEATURES = (
    "log_words", "word_length", "upper", "symbols", "bangs", "bars", "digits", "stops", "other_bytes", "distinct",
    "repeats", "caps_words", "marked_words", "long_words", "words_a_line", "top_word",
)

_UPPER, _SYMBOL, _BANG, _BAR, _DIGIT, _STOP, _HIGH, _LETTER = (1 << i for i in range(8))
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _UPPER | _LETTER
_KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = _SYMBOL
_KIND[ord("!")] = _BANG
_KIND[ord("|")] = _BAR
_KIND[[ord(c) for c in ".,;:?"]] = _STOP
_KIND[128:] = _HIGH


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The ``FEATURES`` of each text, one row each; all 0 for texts without words."""
    rows = len(offs) - 1
    words = scan(data, offs, lower=False)
    n = words.count().astype(float)
    some = np.maximum(n, 1)
    size = np.maximum(np.diff(offs), 1).astype(float)
    kind = _KIND[data]

    def share(bit: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind & bit != 0)])
        return (total[offs[1:]] - total[offs[:-1]]) / size

    def sums(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[words.first[1:]] - total[words.first[:-1]]).astype(float)

    def within(bit: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind & bit != 0)])
        return total[words.end] - total[words.start]

    doc = np.repeat(np.arange(rows), words.count())
    order = np.lexsort((words.hash, doc))
    h, d = words.hash[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    starts = np.flatnonzero(fresh)
    runs = np.diff(np.append(starts, len(h)))
    top = np.zeros(rows)
    np.maximum.at(top, d[starts], runs)
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    length = words.end - words.start
    upper, letters = within(_UPPER), within(_LETTER)
    marked = within(_SYMBOL) + within(_BAR) > 0
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    return np.stack(
        [
            np.log1p(n), sums(length) / some, share(_UPPER), share(_SYMBOL), share(_BANG), share(_BAR), share(_DIGIT), share(_STOP),
            share(_HIGH), np.bincount(d[starts], minlength=rows) / some, sums(again) / some,
            sums((upper == letters) & (upper > 1)) / some, sums(marked) / some, sums(length > 18) / some,
            n / (lines[offs[1:]] - lines[offs[:-1]] + 1), top / some,
        ],
        axis=1,
    ) * (n > 0)[:, None]


@dataclass
class Model:
    """Bin edges of each feature, a weight for each bin, and the intercept."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for f in range(x.shape[1]):
            z += self.weights[f][np.searchsorted(self.edges[f], x[:, f], side="right")]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def prior_cuts(positive: np.ndarray, least: float = 0.2) -> np.ndarray:
    """Increasing scores, each the lower end of an upper tail that holds ``least`` of the positives at least."""
    return np.quantile(positive, np.linspace(0.0, 1 - least, 200))


def estimate_prior(positive: np.ndarray, cuts: np.ndarray, counts: np.ndarray) -> float:
    """Best-bin estimate of the share of positives among the unlabelled.

    ``positive`` are scores of trusted rows; ``counts[i]`` unlabelled rows score ``cuts[i - 1]`` or
    more but less than ``cuts[i]`` (the first and last are open).
    """
    n = counts.sum()
    p = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    u = np.cumsum(counts[::-1])[::-1][1:] / n
    slack = np.sqrt(np.log(20) / 2 / len(positive)) + np.sqrt(np.log(20) / 2 / n)
    best = np.argmin((u + slack) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def _bins(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    width = edges.shape[1] + 1
    return np.stack([np.searchsorted(edges[f], x[:, f], side="right") + f * width for f in range(x.shape[1])], axis=1)


def _descend(edges: np.ndarray, gradient, steps: int, rate: float, bias: float, l2: float) -> tuple[np.ndarray, float]:
    size = edges.shape[0] * (edges.shape[1] + 1)
    w, m, v = np.append(np.zeros(size), bias), np.zeros(size + 1), np.zeros(size + 1)
    for i in range(1, steps + 1):
        g = gradient(w) + np.append(l2 * w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    return w[:-1].reshape(edges.shape[0], -1), float(w[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _back(b: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    return np.append(np.bincount(b.ravel(), weights=np.repeat(g, b.shape[1]), minlength=size), g.sum())


def non_negative_risk(w: np.ndarray, bp: np.ndarray, bu: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """``prior * R+ + max(0, Ru- - prior * R-)`` under the logistic loss, and the gradient that a step follows.

    That is the gradient of ``prior * R+ + Ru- - prior * R-``; where the negative part is below 0,
    the reversed gradient of this part alone, which leads back to where it is not. ``w`` has a
    weight for each bin, then the intercept; ``bp`` and ``bu`` the bins of positives and unlabelled.
    """
    zp, zu = w[bp].sum(axis=1) + w[-1], w[bu].sum(axis=1) + w[-1]
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    value = prior * np.logaddexp(0, -zp).mean() + max(0.0, negative)
    back = _back(bu, _sigmoid(zu) / len(bu), len(w) - 1) - _back(bp, prior * _sigmoid(zp) / len(bp), len(w) - 1)
    return value, _back(bp, prior * (_sigmoid(zp) - 1) / len(bp), len(w) - 1) + back if negative >= 0 else -back


def fit_rough(positive: np.ndarray, unlabelled: np.ndarray, *, steps: int = 400, rate: float = 0.15, l2: float = 1.0) -> Model:
    """A model that tells trusted rows from unlabelled ones, of every other row of each; ``l2`` is divided by the number of rows."""
    edges = np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    p, u = _bins(edges, positive)[::2], _bins(edges, unlabelled)[::2]
    size = edges.shape[0] * (edges.shape[1] + 1)

    def apart(w: np.ndarray) -> np.ndarray:
        zp, zu = w[p].sum(axis=1) + w[-1], w[u].sum(axis=1) + w[-1]
        return _back(p, (_sigmoid(zp) - 1) / len(p), size) + _back(u, _sigmoid(zu) / len(u), size)

    return Model(edges, *_descend(edges, apart, steps, rate, 0.0, l2 / (len(positive) + len(unlabelled))), prior=0.5)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 800, rate: float = 0.15, l2: float = 0.1) -> Model:
    """Model from feature rows of trusted positives and of unlabelled texts; ``l2`` is divided by the number of rows."""
    edges = np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    bp, bu = _bins(edges, positive), _bins(edges, unlabelled)

    def gradient(w: np.ndarray) -> np.ndarray:
        return non_negative_risk(w, bp, bu, prior)[1]

    return Model(edges, *_descend(edges, gradient, steps, rate, 0.0, l2 / (len(positive) + len(unlabelled))), prior)


def _featurer():
    kinds = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in chunks(batches, "text"):
            x = statistics(data, offs)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat.cast(kinds)], names=["positive", "x"])

    return run


def _histogram(model: Model, cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(cuts) + 1, np.int64)
        for _, data, offs in chunks(batches, "text"):
            counts += np.bincount(np.searchsorted(cuts, model.logits(statistics(data, offs)), side="right"), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts)), pa.int32()), pa.array(counts)], names=["bin", "n"])

    return run


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is never learned from: crc32 of the id as text leaves 0 by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def training_rows(labels: DataFrame, label: str, wanted: int, value: int) -> DataFrame:
    """``doc_id`` of at most ``wanted`` ids with that label, and no other, outside the held-out fold; a bounded table."""
    given = labels.filter(F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("high"))
    some = given.filter((F.col("low") == value) & (F.col("high") == value)).select("doc_id")
    return some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(wanted)


def training_texts(plain: DataFrame, wanted: DataFrame, mark: str) -> DataFrame:
    """``mark, text``: one text for each row of ``wanted`` (``doc_id`` and ``mark``, bounded), of rows that share an id that of smallest hash."""
    met = plain.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", mark)
    return met.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select(mark, "text")


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Model from at most ``positives`` labelled rows and ``unlabelled`` others, held-out rows left out.

    The prior is estimated over every text outside the held-out fold. Of rows that share an id one
    text is learned from, so repeated rows don't enlarge the sample; an id labelled both ways is not trusted.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    trusted = training_rows(labels, label, positives, 1)
    ids = plain.filter(~held_out()).select("doc_id").distinct()
    others = ids.orderBy(F.xxhash64("doc_id", F.lit("u")), "doc_id").limit(unlabelled)
    wanted = trusted.select("doc_id", F.lit(1).alias("positive")).unionAll(others.select("doc_id", F.lit(0).alias("positive")))
    given = training_texts(plain, wanted, "positive")  # positives + unlabelled rows at most
    rows = given.mapInArrow(_featurer(), "positive int, x array<double>").toArrow()
    mark = rows.column("positive").to_numpy() == 1
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(mark), len(FEATURES))
    order = np.lexsort((*x.T, mark))  # the order in which rows arrive must not matter
    order = order[np.random.default_rng(0).permutation(len(order))]
    x, mark = x[order], mark[order]
    if mark.sum() < 2 or (~mark).sum() < 2:
        none = np.zeros((len(FEATURES), BINS - 1))
        return Model(none, np.zeros((len(FEATURES), BINS)), 0.0, 0.5)
    rough = fit_rough(x[mark], x[~mark])
    told = rough.logits(x[mark][1::2])
    cuts = prior_cuts(told)
    every = plain.filter(~held_out()).select("text").mapInArrow(_histogram(rough, cuts), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(cuts) + 1)
    for r in every.collect():
        counts[r["bin"]] = r["n"]
    return fit(x[mark], x[~mark], estimate_prior(told, cuts, counts))


def _scorer(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in chunks(batches, "text"):
            score = model.scores(statistics(data, offs))
            given = pa.array((score >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), given], names=[*batch.schema.names, "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text, and the columns in ``keep``.

    ``docs`` needs ``doc_id`` and ``text``; no other column is an input. Null and empty texts are
    scored like a text whose statistics are all 0. A null ``doc_id`` counts as held out.
    Repeated rows get equal scores; an empty table gives no rows.
    """
    carried = [c for c in keep if c not in ("doc_id", "text")]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    scored = plain.mapInArrow(_scorer(model, threshold), f"{kinds}, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", *keep)


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """:func:`learn` and :func:`score` in one."""
    return score(docs, learn(docs, labels), threshold=threshold, keep=keep)
