"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. A block of the index holds, for
each pivot, an inverted file of the vectors that have it among their ``listed`` nearest
pivots, with its place there. A query opens the files of its own nearest pivots and sums
``listed - |place - own place|`` over the postings met, which orders a block's vectors by
footrule distance between truncated permutations (absent pivots count as place ``listed``).
Many pivots and short permutations keep the files short: with 2048 pivots of which 64 are
listed, a query meets about 2 postings for each vector of a block.
The nearest ``rerank`` share of the block, and all within a footrule radius, are ranked again
by the exact inner product. So that pivots are ordered by inner product also where lengths
differ, indexed vectors get one more component that makes them equally long; queries get 0.

Pivots are fitted on a bounded sample; every row is indexed. Blocks have a bounded number
of rows. A task gets a block once, then a bounded group of queries, streamed pack by pack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.embedding_dedup import _valid
from tallyloom.llm.shared import cut

#: Pivots at most, and sampled rows (of smallest id hash) among which they are chosen.
PIVOTS, SAMPLE = 2048, 4096
#: Sampled rows of a larger cosine with a pivot are none themselves: near copies would stand in each other's lists.
ALIKE = 0.7
#: Pivots that a permutation keeps.
LISTED = 64
#: Share of a block that is ranked again exactly, rows that are at least (times the neighbours asked for),
#: and the share of the largest footrule sum from which on every row is.
RERANK, LEAST, RADIUS = 0.1, 16, 0.6
#: Vectors whose products with all pivots are held at once.
STRIDE = 1024
#: Rows of an index block and of a pack of queries, and packs that a task compares with a block, about.
BLOCK, QUERIES, PACKS = 16_384, 512, 64


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over ``longest``, with the component more that makes each of them one of length 1."""
    x = vectors / longest
    return np.column_stack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))])


def choose_pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """The first ``wanted`` rows (of length 1) that are not ``ALIKE`` an earlier one; which may be fewer."""
    kept, n = np.zeros((wanted, sample.shape[1])), 0
    for row in sample:
        if n < wanted and not (kept[:n] @ row > ALIKE).any():
            kept[n], n = row, n + 1
    return kept[:n]


def permutations(vectors: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """Numbers of the ``listed`` nearest pivots of each vector, nearest first, by inner product."""
    orders = [np.zeros((0, min(listed, len(pivots))), np.int64)]
    for at in range(0, len(vectors), STRIDE):
        far = -(vectors[at : at + STRIDE] @ pivots.T)
        if listed < len(pivots):
            near = np.sort(np.argpartition(far, listed - 1, axis=1)[:, :listed], axis=1)
        else:
            near = np.broadcast_to(np.arange(len(pivots)), far.shape)
        own = np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable")
        orders.append(np.take_along_axis(near, own, axis=1))
    return np.concatenate(orders)


class Block:
    """Pivot inverted files of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, longest: float, listed: int) -> None:
        # Equal vectors are indexed once; their ids stand together, smallest first.
        raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
        _, first, group = np.unique(raw, return_index=True, return_inverse=True)
        self.vectors = vectors[first]
        self.ids = ids[np.lexsort((ids, group))]
        self.edges = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(first)))])
        orders = permutations(lifted(self.vectors, longest), pivots, listed)
        flat, place = orders.ravel(), np.tile(np.arange(orders.shape[1]), len(orders))
        by_pivot = np.argsort(flat, kind="stable")
        edges = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))
        rows = (by_pivot // orders.shape[1]).astype(np.int32)
        places = place[by_pivot].astype(np.float32)
        self.files = [(rows[a:b], places[a:b]) for a, b in zip(edges, edges[1:], strict=False)]

    def search(self, query: np.ndarray, own: int | None, order: np.ndarray, top: int, rerank: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the best ``top`` vectors other than ``own``."""
        met = np.zeros(len(self.vectors), np.float32)
        listed = len(order)
        for place, pivot in enumerate(order.tolist()):
            rows, places = self.files[pivot]
            met[rows] += listed - np.abs(places - place)
        keep = min(len(met), max(LEAST * top, int(np.ceil(rerank * len(met)))))
        least = -np.partition(-met, keep - 1)[keep - 1]
        some = np.flatnonzero(met >= min(least, RADIUS * listed * listed))  # ties at the end stay
        score = (self.vectors[some] * query).sum(axis=1)
        if len(some) > top + 1:
            limit = -np.partition(-score, top)[top]  # ties at the end stay
            some, score = some[score >= limit], score[score >= limit]
        ids = [self.ids[self.edges[g] : self.edges[g + 1]][: top + 1] for g in some.tolist()]
        scores = np.repeat(score, [len(x) for x in ids])
        ids = np.concatenate(ids)
        best = np.lexsort((ids, -scores))
        best = best[ids[best] != own][:top] if own is not None else best[:top]
        return ids[best], scores[best]


def _matrix(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.flatten()
    ids, vectors = rows.field(0), rows.field(1)
    dims = len(vectors[0])
    return ids.to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dims)


def _searcher(pivots: dict[int, tuple[np.ndarray, float]], listed: int, top: int, rerank: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Block | None = None
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                own, longest = pivots[one.column(0)[0].as_py()]
                ids, x = _matrix(one.column(2))
                if one.column(1)[0].as_py() == 0:  # a block comes before its queries
                    held = Block(ids, x, own, longest, listed)
                    continue
                orders = permutations(np.column_stack([x, np.zeros(len(x))]), own, listed)
                found = [held.search(q, i, o, top, rerank) for q, i, o in zip(x, ids.tolist(), orders, strict=True)]
                sizes = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def search(
    vectors: DataFrame, queries: DataFrame, *, top: int = 20, pivots: int = PIVOTS, listed: int = LISTED, rerank: float = RERANK,
    block: int = BLOCK, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """The ``top`` largest inner products found for each query: ``query_id, rank, vec_id, score``.

    ``queries`` and ``vectors`` need an id and a vector; other columns are ignored. A row of
    ``vectors`` with the query's id is not its neighbour. ``score`` is the inner product of the
    original vectors in double precision; ties go to the smaller id.

    Ids or vectors that are null, and vectors that are empty, zero or hold a null or
    non-finite component, take no part on either side. Vectors are compared with queries of
    as many components only. Rows that repeat an id and vector count once. With fewer candidates
    than ``top`` all are returned; empty tables give no rows.
    """

    def kind(df: DataFrame) -> str:
        return df.select(F.col(vector)).schema[0].dataType.simpleString()

    wide = "array<float>" if kind(vectors) == kind(queries) == "array<float>" else "array<double>"

    def good(df: DataFrame) -> DataFrame:
        df = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(wide).alias("x"))
        return df.filter(F.col("id").isNotNull() & _valid("x")).dropDuplicates(["id", "x"]).withColumn("dims", F.size("x"))

    rows, asked = cut(good(vectors), "vectors"), cut(good(queries), "queries")
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    per_dims = {r["dims"]: r for r in rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).collect()}
    n_asked = {r["dims"]: r["n"] for r in asked.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen: dict[int, tuple[np.ndarray, float]] = {}
    sizes = []
    for dims in sorted(per_dims.keys() & n_asked.keys()):
        some = rows.filter(F.col("dims") == dims).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        longest = per_dims[dims]["longest"]
        chosen[dims] = choose_pivots(lifted(np.array([r["x"] for r in some], np.float64), longest), pivots), longest
        packs = -(-n_asked[dims] // QUERIES)
        sizes.append((dims, -(-per_dims[dims]["n"] // block), packs, -(-packs // PACKS)))
    spark = vectors.sparkSession
    layout = F.broadcast(spark.createDataFrame(sizes, "dims int, blocks int, packs int, groups int"))  # one row for each length of vectors

    def gathered(df: DataFrame, number: Column) -> DataFrame:
        parts = df.join(layout, "dims").withColumn("part", number.cast("int"))
        return parts.groupBy("dims", "part", "blocks", "groups").agg(F.collect_list(F.struct("id", "x")).alias("rows"))

    index = cut(gathered(rows, F.pmod(F.xxhash64("id"), F.col("blocks"))), "index")
    packed = cut(gathered(asked, F.pmod(F.xxhash64("id"), F.col("packs"))), "packs")
    each_group, each_block = F.sequence(F.lit(0), F.col("groups") - 1), F.sequence(F.lit(0), F.col("blocks") - 1)
    blocks = index.select("dims", F.col("part").alias("b"), F.explode(each_group).alias("g"), F.lit(0).alias("what"), "rows")
    group = F.pmod(F.col("part"), F.col("groups")).cast("int")
    packs = packed.select("dims", F.explode(each_block).alias("b"), group.alias("g"), F.lit(1).alias("what"), "rows")
    tasks = blocks.unionAll(packs).repartition(F.xxhash64("dims", "b", "g")).sortWithinPartitions("dims", "b", "g", "what")
    found = tasks.select("dims", "what", "rows").mapInArrow(
        _searcher(chosen, listed, top, rerank), "query_id long, vec_id long, score double"
    )
    found = cut(found, "found", batch_rows=4)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
