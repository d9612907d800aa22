"""Near-duplicate embeddings by int8 tile products with rigorous quantisation bounds.

Vectors of one label are scaled to length 1, quantised to int8 with a scale of their
own, and dealt into blocks of bounded size; each pair of blocks is one tile. A tile's
int8 product is exact in float32 arithmetic (within ``EXACT_DIMS`` columns at a time).
With ``x = x' + e``, ``x'`` the quantised vector, the true cosine differs from the
product by at most ``|x'||f| + |e||y'| + |e||f|``; pairs whose product plus that bound
reaches the threshold are recomputed in double precision, all others cannot be links.

A tile gives each vector's number of links and a spanning forest of its links, so its
output is bounded by its rows; equal vectors of a label collapse to one before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.graph import stars
from tallyloom.llm.shared import cut, spread_join

#: Distinct vectors in a block at most, about, and their bytes as doubles (64 vectors may exceed that).
BLOCK, BLOCK_BYTES = 2048, 2 << 20
#: Columns whose int8 products sum exactly in float32: 127 * 127 * 1024 < 2**24.
EXACT_DIMS = 1024
#: Above the rounding error of double sums.
SLACK = 1e-9


def _valid(vector: str) -> F.Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of the quantised vectors and of their errors."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 codes, as doubles."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, i : i + EXACT_DIMS].astype(np.float32) @ b[:, i : i + EXACT_DIMS].astype(np.float32).T
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of 2 that bring them near 1, so that squares neither overflow nor vanish; cosines stay, to the bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``x`` and ``y`` with a double-precision cosine of ``threshold`` at least."""
    x, y = scaled(x), scaled(y)
    lx, ly = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    cx, sx, nx, ex = quantise(x / lx[:, None])
    cy, sy, ny, ey = quantise(y / ly[:, None])
    found_i, found_j = [], []
    for at in range(0, len(x), 512):
        rows = slice(at, at + 512)
        estimate = int8_products(cx[rows], cy) * sx[rows, None] * sy[None, :]
        bound = nx[rows, None] * ey[None, :] + ex[rows, None] * (ny + ey)[None, :] + SLACK
        i, j = np.nonzero(estimate + bound >= threshold)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 1 << 16):
            a, b = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            true = (x[a] * y[b]).sum(axis=1) / (lx[a] * ly[b])
            ok = true >= threshold
            found_i.append(a[ok])
            found_j.append(b[ok])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def top(a: int) -> int:
        while (up := root.setdefault(a, a)) != a:
            root[a] = root.setdefault(up, up)
            a = root[a]
        return a

    kept = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _tiles(threshold: float):
    def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = column.flatten()
        ids, size, vectors = (rows.field(i) for i in range(3))
        dims = len(vectors[0])
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        return ids.to_numpy(), size.to_numpy(), flat.astype(np.float64).reshape(len(ids), dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                same = one.column(0)[0].as_py() == one.column(1)[0].as_py()
                ids, sizes, x = matrix(one.column(2))
                ids2, sizes2, y = (ids, sizes, x) if same else matrix(one.column(3))
                i, j = tile_links(x, y, threshold, same)
                n = np.zeros(len(ids), np.int64)
                n2 = n if same else np.zeros(len(ids2), np.int64)
                np.add.at(n, i, sizes2[j])
                np.add.at(n2, j, sizes[i])
                tree = _forest(ids[i], ids2[j])
                some, some2 = n > 0, (n2 > 0) & (not same)
                u = np.concatenate([ids[some], ids2[some2], np.array([t[0] for t in tree], np.int64)])
                counts = np.concatenate([n[some], n2[some2], np.zeros(len(tree), np.int64)])
                v = [None] * int(some.sum() + some2.sum()) + [t[1] for t in tree]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(counts, pa.int64())], names=["u", "v", "n"]
                )

    return run


def near_duplicates(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    threshold: float = 0.93, block: int = BLOCK,
) -> DataFrame:
    """Links of vectors of one label: ``vec_id, n_links, component_id, kept``, one row per input row.

    Vectors are linked if their labels are equal and not null, their lengths agree and
    their cosine, in double precision, is ``threshold`` at least. ``n_links`` counts other
    rows linked directly, copies included; ``component_id`` is the smallest id reachable.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows
    with a null label or id, have no links and are kept. Rows that repeat an id with equal
    vectors count as separate rows linked with each other; an id with several different
    vectors is one node of the graph and gets the sum of its vectors' links. Other
    columns are ignored. An empty table gives no rows.

    Equal vectors of a label, by two 64-bit hashes, are one class with a number of its own.
    """
    plain = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("x"), F.col(label).alias("label"))
    usable = plain.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & _valid("x"))
    keyed = usable.select("id", "label", "x", F.xxhash64("label", "x").alias("k1"), F.xxhash64(F.lit(7), "x", "label").alias("k2"))
    classes = keyed.groupBy("k1", "k2").agg(
        F.first("label").alias("label"), F.first("x").alias("x"), F.min("id").alias("node"), F.count(F.lit(1)).alias("size")
    )
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    per_label = classes.groupBy("label", F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    rows = F.least(F.lit(block), F.greatest(F.lit(64), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dims")))))
    per_label = cut(per_label.withColumn("blocks", F.ceil(F.col("n") / rows).cast("int")), "labels")
    tagged = spread_join(classes.withColumn("dims", F.size("x")), per_label, ["label", "dims"], F.col("cls")).drop("n")
    tagged = tagged.withColumn("b", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    packed = cut(
        tagged.groupBy("label", "dims", "b", "blocks").agg(F.collect_list(F.struct("cls", "size", "x")).alias("rows")), "blocks"
    )
    left = packed.select("label", "dims", "b", "rows", F.explode(F.sequence(F.col("b"), F.col("blocks") - 1)).alias("c"))
    right = packed.select("label", "dims", F.col("b").alias("c"), F.col("rows").alias("rows2"))
    pairs = left.join(right, ["label", "dims", "c"]).select("b", "c", "rows", F.when(F.col("b") != F.col("c"), F.col("rows2")).alias("rows2"))
    pairs = pairs.repartition(F.xxhash64("b", "c", F.element_at("rows", 1)["cls"]))
    found = cut(pairs.mapInArrow(_tiles(threshold), "u long, v long, n long"), "tiles", batch_rows=8)
    counts = found.filter("v is null").groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("links"))
    known = classes.join(counts, "cls", "left").select(
        "k1", "k2", "cls", "node", F.col("size").alias("n"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links")
    )
    known = cut(known, "known")
    copies = cut(spread_join(keyed.select("id", "k1", "k2"), known, ["k1", "k2"], F.col("id")).select("id", "cls", "node", "links"), "copies")
    ends = classes.select("cls", "node")
    tree = found.filter("v is not null").select("u", "v").join(ends.toDF("u", "a"), "u").join(ends.toDF("v", "b"), "v")
    links = tree.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        copies.filter("id <> node").select(F.col("id").alias("u"), F.col("node").alias("v"))
    )
    reach = stars(links).toDF("id", "component")
    own = copies.select("id", "cls", "links").distinct().groupBy("id").agg(F.sum("links").alias("n"))
    out = plain.select("id").join(own, "id", "left").join(reach, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"),
    )
