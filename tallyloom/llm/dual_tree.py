"""Ranked lexical search by dual trees of coordinate maxima.

Items and documents are vectors over the items' terms: an item has a weight for each of its terms,
a document what the term contributes by its frequency and the document's length. A score is their
product, so for a set of items and a set of documents the product of the coordinate maxima of
both bounds every score between them. Items form a binary tree, and so do the documents of a block
of bounded size; a node is parted around two rows unlike each other. A search descends both trees,
larger bounds first, and leaves out every pair of nodes whose bound cannot reach the weakest k-th
score of the node's items. Nothing else is left out, so results are exact.

One pass over the texts writes the documents' term counts, one narrow job; corpus counts follow
by aggregation. A sixteenth of the documents, in runs, is searched first: its k-th scores are the
bounds from which the search of the rest starts, so that the rest hands on few rows. No step but the
last, which ranks what the tasks found, shuffles documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import column_bytes, cut, list_column

#: Items that one pass over the documents serves, and bytes of their texts (one item at least).
ITEMS, ITEM_BYTES = 512, 256 << 10
#: Documents and their entries in a block at most; a document's entries are never parted.
BLOCK, BLOCK_ENTRIES = 8192, 1 << 20
#: Items and documents in a leaf.
ITEM_LEAF, DOC_LEAF = 4, 32
#: One run of documents in so many is searched first.
FIRST, RUN = 16, 64
#: Bytes of a text whose terms are counted at once.
PIECE = 4 << 20
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_LAST = np.iinfo(np.int64).max
_BEFORE_ALL = np.iinfo(np.int64).min


def term_counts(text: bytes) -> Counter[bytes]:
    """Occurrences of each term: longest runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased."""
    counts: Counter[bytes] = Counter()
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE) if len(text) - at > PIECE else None
        to = gap.end() if gap else len(text)
        counts.update(_TERM.findall(text[at:to].lower()))
        at = to
    return counts


def _counter(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get(), 0
        run_of = (task.partitionId() if task else 0) * 7
        for batch in batches:
            data, offs = column_bytes(batch.column(1))
            rows, lengths, sizes, ids, tfs, first = [], [], [0], [], [], []
            for i in range(batch.num_rows):
                counts = term_counts(data[offs[i] : offs[i + 1]].tobytes())
                if not counts:
                    continue
                known = [(vocabulary[t], n) for t, n in counts.items() if t in vocabulary]
                ids += [t for t, _ in known]
                tfs += [n for _, n in known]
                rows.append(i)
                lengths.append(counts.total())
                sizes.append(len(ids))
                first.append((run_of + seen // RUN) % FIRST == 0)
                seen += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()),
                    list_column(np.array(ids, np.int32), np.array(sizes), pa.int32()), list_column(np.array(tfs, np.int32), np.array(sizes), pa.int32()),
                    pa.array(first, pa.bool_()),
                ],
                names=["doc_id", "n", "ids", "tfs", "first"],
            )

    return run


@dataclass
class Tree:
    """A binary tree over rows: ``order`` has the rows so that a node's are ``order[low:high]``; children are -1 at a leaf."""

    order: np.ndarray
    low: list[int]
    high: list[int]
    left: list[int]
    right: list[int]


def _parted(terms: np.ndarray, values: np.ndarray, owner: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of ``n`` rows go to the first of two parts: of two rows unlike each other, then of both parts' means, the nearer."""
    length = np.sqrt(np.bincount(owner, values * values, n))
    values = values / np.maximum(length, 1e-300)[owner]

    def like(direction: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values * direction[terms], n)

    def row(i: int) -> np.ndarray:
        mine = owner == i
        return np.bincount(terms[mine], values[mine], width)

    one = row(int(np.argmin(like(np.bincount(terms, values, width)))))
    two = row(int(np.argmin(like(one))))
    lean = like(one) - like(two)
    for _ in range(2):
        upper = lean > 0
        if not 0 < upper.sum() < n:
            break
        mine = upper[owner]
        first, second = (np.bincount(terms[m], values[m], width) for m in (mine, ~mine))
        lean = like(first / max(np.linalg.norm(first), 1e-300)) - like(second / max(np.linalg.norm(second), 1e-300))
    upper = lean > 0
    if not n <= 16 * upper.sum() <= 15 * n:  # an even cut bounds the depth, whatever the rows
        upper = np.zeros(n, bool)
        upper[np.argsort(-lean, kind="stable")[: n // 2]] = True
    return upper


def grow(at: np.ndarray, ids: np.ndarray, x: np.ndarray, leaf: int) -> Tree:
    """Tree over sparse rows ``ids[at[i]:at[i+1]]`` with values ``x``."""
    low, high, left, right, leaves = [], [], [], [], []
    width = int(ids.max()) + 1 if len(ids) else 1

    def visit(rows: np.ndarray, start: int) -> int:
        node = len(low)
        low.append(start)
        high.append(start + len(rows))
        left.append(-1)
        right.append(-1)
        if len(rows) <= leaf:
            leaves.append(rows)
            return node
        size = at[rows + 1] - at[rows]
        ends = np.cumsum(size)
        here = np.repeat(at[rows] - (ends - size), size) + np.arange(ends[-1])
        upper = _parted(ids[here], x[here], np.repeat(np.arange(len(rows)), size), len(rows), width)
        left[node] = visit(rows[upper], start)
        right[node] = visit(rows[~upper], start + int(upper.sum()))
        return node

    visit(np.arange(len(at) - 1), 0)
    return Tree(np.concatenate(leaves), low, high, left, right)


def _maxima(tree: Tree, at: np.ndarray, ids: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms and their largest values in each node."""
    found: list[tuple[np.ndarray, np.ndarray]] = [None] * len(tree.low)  # type: ignore[list-item]
    for node in reversed(range(len(tree.low))):  # children follow their node
        if tree.left[node] < 0:
            parts = [(ids[at[r] : at[r + 1]], values[at[r] : at[r + 1]]) for r in tree.order[tree.low[node] : tree.high[node]]]
        else:
            parts = [found[tree.left[node]], found[tree.right[node]]]
        terms, most = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(terms, kind="stable")
        terms, most = terms[order], most[order]
        new = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else terms
        found[node] = (terms[new], np.maximum.reduceat(most, new)) if len(terms) else (terms, most)
    return found


class Items:
    """A group of items as weights over the vocabulary, in the order of their tree, with the maxima of its nodes."""

    def __init__(self, terms: list[list[int]], weights: np.ndarray) -> None:
        """``terms`` has the distinct term numbers of each item."""
        at = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        ids = np.array([t for own in terms for t in own], np.int64)
        self.tree = grow(at, ids, weights[ids].astype(np.float64), ITEM_LEAF)
        # Products of whole numbers are exact in doubles up to 2**53, and no score or bound exceeds this one.
        kind = np.float64 if int(weights.sum()) * 10**6 < 1 << 53 else np.int64
        self.weights = np.zeros((len(terms), len(weights)), kind)
        for place, item in enumerate(self.tree.order):
            self.weights[place, terms[item]] = weights[terms[item]]
        self.maxima = np.array([self.weights[a:b].max(axis=0) for a, b in zip(self.tree.low, self.tree.high, strict=True)])


class Best:
    """The best ``k`` documents of each item so far, and what a document must beat: ``score``, and on ties a smaller id than ``doc``."""

    def __init__(self, k: int, score: np.ndarray, doc: np.ndarray) -> None:
        self.k, self.score, self.doc = k, score.copy(), doc.copy()
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, low: int, scores: np.ndarray, docs: np.ndarray) -> bool:
        """Takes scores of items ``low, low + 1, ...`` (rows) with documents (columns); true if what must be beaten changed."""
        must, tie = self.score[low : low + len(scores), None], self.doc[low : low + len(scores), None]
        item, at = np.nonzero((scores > must) | ((scores == must) & (docs < tie)))
        if not len(item):
            return False
        self.rows.append((item + low, scores[item, at].astype(np.int64), docs[at]))
        self.pending += len(item)
        if self.pending < 2048:
            return False
        self.settle()
        return True

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, scores and ids of the rows that are left, best first within an item."""
        if not self.rows:
            none = np.zeros(0, np.int64)
            return none, none, none
        item, score, doc = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.searchsorted(item, item, side="left")
        rank = np.arange(len(item)) - first
        kept = rank < self.k
        item, score, doc, rank = item[kept], score[kept], doc[kept], rank[kept]
        last = rank == self.k - 1
        i, s, d = item[last], score[last], doc[last]
        better = (s > self.score[i]) | ((s == self.score[i]) & (d < self.doc[i]))
        self.score[i[better]], self.doc[i[better]] = s[better], d[better]
        self.rows, self.pending = [(item, score, doc)], 0
        return item, score, doc


def search_block(items: Items, best: Best, docs: np.ndarray, at: np.ndarray, ids: np.ndarray, values: np.ndarray) -> tuple[int, int]:
    """Searches one block of documents; the pairs of an item and a document that were scored, and all of them.

    Document ``docs[i]`` has contributions ``values`` of the terms ``ids``, at ``at[i]:at[i+1]``.
    """
    here, local = np.unique(ids, return_inverse=True)
    if not len(here):
        return 0, len(docs) * len(items.weights)
    weights, tops = items.weights[:, here], items.maxima[:, here]
    kind = weights.dtype
    tree = grow(at, local, values * tops[0][local].astype(np.float64), DOC_LEAF)
    maxima = _maxima(tree, at, local, values)
    its = tree, items.tree
    least = [int(docs[tree.order[a:b]].min()) for a, b in zip(tree.low, tree.high, strict=True)]
    owner = its[1]
    columns = [np.flatnonzero(tops[q]) if owner.left[q] < 0 else None for q in range(len(owner.low))]
    weakest, latest = np.zeros(len(owner.low), np.int64), np.zeros(len(owner.low), np.int64)
    scored = 0

    def renew() -> None:
        for q, (a, b) in enumerate(zip(owner.low, owner.high, strict=True)):
            weakest[q] = least_score = best.score[a:b].min()
            own = best.doc[a:b][best.score[a:b] == least_score]
            latest[q] = own.max()

    def live(node: int, from_items: list[int]) -> tuple[list[int], float]:
        """Leaves of the item tree below ``from_items`` that documents of a node may reach, and the largest bound."""
        dense = np.zeros(len(here), kind)
        dense[maxima[node][0]] = maxima[node][1]
        kept, largest, front = [], 0.0, from_items
        while front:
            bounds = tops[front] @ dense
            deeper = []
            for q, bound in zip(front, bounds.tolist(), strict=True):
                if bound > weakest[q] or (bound == weakest[q] and least[node] < latest[q]):
                    if owner.left[q] < 0:
                        kept.append(q)
                        largest = max(largest, bound)
                    else:
                        deeper += [owner.left[q], owner.right[q]]
            front = deeper
        return kept, largest

    renew()
    stack = [(0, live(0, [0])[0])]
    while stack:
        node, leaves = stack.pop()
        if tree.left[node] >= 0:
            pair = [(child, *live(child, leaves)) for child in (tree.left[node], tree.right[node])]
            # The child of the larger bound comes off the stack first; the other is judged anew by then.
            stack += [(child, kept) for child, kept, _ in sorted(pair, key=lambda p: p[2]) if kept]
            continue
        leaves, _ = live(node, leaves)
        if not leaves:
            continue
        rows = tree.order[tree.low[node] : tree.high[node]]
        matrix = np.zeros((len(here), len(rows)), kind)
        for j, r in enumerate(rows):
            matrix[local[at[r] : at[r + 1]], j] = values[at[r] : at[r + 1]]
        own, changed = docs[rows], False
        for q in leaves:
            a, b = owner.low[q], owner.high[q]
            scored += (b - a) * len(rows)
            changed |= best.add(a, weights[a:b, columns[q]] @ matrix[columns[q]], own)
        if changed:
            renew()
    return scored, len(docs) * len(weights)


def contributions(tf: np.ndarray, n: np.ndarray, corpus: int, words: int) -> np.ndarray:
    """What a term adds to a score for one unit of weight, in whole numbers: ``tf`` occurrences in a document of ``n`` terms."""
    m = 100 - 50 + (50 * n * corpus) // words
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _searcher(terms: list[list[int]], weights: np.ndarray, k: int, corpus: int, words: int, score: np.ndarray, doc: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(terms, weights)
        order = items.tree.order
        best = Best(k, score[order], doc[order])
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        rows = entries = 0

        def search() -> None:
            docs, size, ids, values = (np.concatenate(x) for x in zip(*held, strict=True))
            search_block(items, best, docs, np.concatenate([[0], np.cumsum(size)]), ids, values)
            held.clear()

        for batch in batches:
            docs = batch.column(0).fill_null(_LAST).to_numpy()
            size = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
            ids = batch.column(2).flatten().to_numpy().astype(np.int64)
            tfs = batch.column(3).flatten().to_numpy().astype(np.int64)
            values = contributions(tfs, np.repeat(batch.column(1).to_numpy(), size), corpus, words)
            ends, a = np.cumsum(size), 0
            while a < len(docs):
                base = ends[a - 1] if a else 0
                b = max(a + 1, min(a + BLOCK - rows, int(np.searchsorted(ends, base + BLOCK_ENTRIES - entries, side="right"))))
                b = min(b, len(docs))
                held.append((docs[a:b], size[a:b], ids[base : ends[b - 1]], values[base : ends[b - 1]]))
                rows, entries, a = rows + b - a, entries + int(ends[b - 1] - base), b
                if rows >= BLOCK or entries >= BLOCK_ENTRIES:
                    search()
                    rows = entries = 0
        if held:
            search()
        item, found, docs = best.settle()
        yield pa.RecordBatch.from_arrays(
            [pa.array(order[item], pa.int32()), pa.array(docs, pa.int64(), mask=docs == _LAST), pa.array(found, pa.int64())],
            names=["item", "doc_id", "score"],
        )

    return run


def _groups(items: Iterable[tuple[object, bytes]]) -> Iterator[list[tuple[object, bytes]]]:
    group, size = [], 0
    for item in items:
        if group and (len(group) >= ITEMS or size + len(item[1]) > ITEM_BYTES):
            yield group
            group, size = [], 0
        group.append(item)
        size += len(item[1])
    if group:
        yield group


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_group(docs: DataFrame, group: list[tuple[object, bytes]], item_type: str, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    own = [sorted(term_counts(text)) for _, text in group]
    vocabulary = {t: i for i, t in enumerate(sorted({t for terms in own for t in terms}))}
    terms = [[vocabulary[t] for t in x] for x in own]
    if not vocabulary:
        return None
    kinds = "doc_id long, n long, ids array<int>, tfs array<int>, first boolean"
    counted = cut(docs.mapInArrow(_counter(vocabulary), kinds), "term_counts")
    corpus, words = counted.agg(F.count(F.lit(1)), F.sum("n")).head()
    if not corpus:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in counted.select(F.explode("ids").alias("t")).groupBy("t").count().toLocalIterator():
        weights[term] = math.floor(1000 * math.log((2 * corpus + 2) / (2 * df + 1)))
    score, last = np.zeros(len(group), np.int64), np.full(len(group), _BEFORE_ALL)

    def search(part: str) -> DataFrame:
        searcher = _searcher(terms, weights, k, corpus, words, score.copy(), last.copy())
        return counted.filter(part).drop("first").mapInArrow(searcher, "item int, doc_id long, score long")

    early = cut(search("first"), "early")
    for row in _ranked(early, k).filter(F.col("rank") == k).toLocalIterator():
        score[row["item"]], last[row["item"]] = row["score"], _LAST if row["doc_id"] is None else row["doc_id"]
    found = _ranked(early.unionAll(search("not first")), k)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(group)], f"item int, item_id {item_type}")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, *, k: int = 50) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``, only scores above 0, ties to the smaller ``doc_id``.

    ``docs`` needs ``doc_id, text``, ``items`` ``item_id, text``; other columns are ignored, whatever
    their names. Terms are longest runs of ASCII letters and digits and of all characters beyond
    ASCII, A-Z lower-cased, of whole texts, however long. Corpus counts cover every row of ``docs``.

    Null, empty and termless texts match nothing and do not count as documents. Each row of
    ``docs`` is a document, so repeated rows tie and stand side by side; null ids come last in a tie. Each
    row of ``items`` is an item, so a repeated one has its rows again. Empty tables give no rows.

    Items are served in groups of at most ``ITEMS``, one pass over the documents each; the terms
    sent to tasks are those of a group, bounded by ``ITEM_BYTES`` or one item's text.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    item_type = items.schema["item_id"].dataType.simpleString()
    rows = ((r["item_id"], (r["text"] or "").encode()) for r in items.select("item_id", "text").toLocalIterator())
    parts = [p for group in _groups(rows) if (p := _search_group(plain, group, item_type, k)) is not None]
    if not parts:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
