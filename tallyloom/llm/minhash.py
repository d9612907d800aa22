"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Each set of word shingles is sketched in rounds of hashed bin placement: in round
``i < t`` every shingle goes to one random bin of ``t``, in round ``i >= t`` all of
them go to bin ``i - t``, and a bin keeps the smallest ``(round, value)``. A set is
done after the round that fills its last bin, so every coordinate is filled, and
the share of equal coordinates is concentrated around the Jaccard similarity.
Coordinates are cut into bands; equal bands make candidates, and candidates are
confirmed on their full shingle sets.

Copies (equal shingle sets) collapse to one class before banding. Within a bucket
only links that can join two components are looked for: members are compared with
the bucket's smallest member, then with its largest. In buckets whose members are still in
different components, those outside the largest component of the bucket are compared with each
other and with the largest one's members, by tiles: both are cut into blocks of bounded
size, and each pair of blocks is one task's work, which counts common shingles by bit
sets and gives a spanning forest of the links it finds, never the pairs. A pair is
looked at only in the first band that it shares. No cap is set anywhere; the members of a
bucket, and those compared with one member, are dealt out over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.graph import stars
from tallyloom.llm.shared import chunks, column_bytes, cut, forget, list_column, small_or_plain, spread_join
from tallyloom.llm.words import U, mix, scan, shingle_sets

#: Bytes of texts in a block of a bucket, about.
TILE_BYTES = 1 << 20
_EMPTY = U(0xFFFFFFFFFFFFFFFF)


def banding(threshold: float, missed: float = 5e-5) -> tuple[int, int]:
    """Rows and bands so that a pair at ``threshold`` escapes with probability ``missed`` at most."""
    rows = max(1, round(math.log(0.36) / math.log(threshold)))
    return rows, math.ceil(math.log(missed) / math.log(1 - threshold**rows))


def sketch(flat: np.ndarray, offs: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch, one row of ``t`` coordinates for each non-empty set."""
    n = len(offs) - 1
    size = np.diff(offs)
    owner = np.repeat(np.arange(n), size)
    out = np.full(n * t, _EMPTY, np.uint64)
    active = size > 0
    for i in range(2 * t):
        live = active[owner]
        if not live.any():
            break
        if not live.all():
            flat, owner = flat[live], owner[live]
        h = mix(flat + U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = U(i << 32) | (h & U(0xFFFFFFFF))
        bins = ((h >> U(32)) * U(t)) >> U(32) if i < t else np.full(len(h), i - t, np.uint64)
        np.minimum.at(out, owner * t + bins.astype(np.int64), value)
        active &= (out.reshape(n, t) == _EMPTY).any(axis=1)
    return out.reshape(n, t)


def _band_hashes(table: np.ndarray, rows: int, bands: int) -> np.ndarray:
    cells = table.reshape(len(table), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cells.shape[:2]).copy()
    for r in range(rows):
        h = mix(h * U(0xD6E8FEB86659FD93) + cells[:, :, r])
    return h


def _sketcher(k: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in chunks(batches, "text"):
            flat, at = shingle_sets(scan(data, offs, lower=True), k)
            size = np.diff(at)
            some = size > 0
            table = np.zeros((part.num_rows, bands), np.uint64)
            one, two = mix(flat ^ U(0x5851F42D4C957F2D)), mix(flat ^ U(0x14057B7EF767814F))
            k1, k2 = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.uint64)
            if some.any():
                at_some = np.concatenate([at[:-1][some], at[-1:]])
                k1[some], k2[some] = np.add.reduceat(one, at_some[:-1]), np.add.reduceat(two, at_some[:-1])
                table[some] = _band_hashes(sketch(flat, at_some, rows * bands), rows, bands)
            held = np.where(some, bands, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(size, pa.int64()),
                    pa.array(k1.view(np.int64)),
                    pa.array(k2.view(np.int64)),
                    list_column(table[some].reshape(-1).view(np.int64), np.concatenate([[0], np.cumsum(held)]), pa.int64()),
                ],
                names=["doc_id", "tag", "n_shingles", "k1", "k2", "bands"],
            )

    return run


def _verifier(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))

        def one(text: str | None) -> np.ndarray:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            return shingle_sets(scan(raw, np.array([0, len(raw)]), lower=True), k)[0]

        for batch in batches:
            us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for u, v, a, b in zip(us, vs, batch.column(2), batch.column(3), strict=True):
                if held[0] != v:
                    held = (v, one(b.as_py()))
                x, y = one(a.as_py()), held[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(mask)

    return run


def _forest(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def top(a: int) -> int:
        while root.setdefault(a, a) != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    kept = []
    for a, b in edges:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def tile_links(
    left: tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]], right: tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]],
    bucket: int, percent: int,
) -> list[tuple[int, int]]:
    """Spanning forest of the links between two blocks ``(nodes, components, bands, sets)`` of a bucket."""
    nodes, parts, bands, sets = left
    nodes2, parts2, bands2, sets2 = right
    size, size2 = np.array([len(x) for x in sets]), np.array([len(x) for x in sets2])
    every = np.concatenate([*sets, *sets2])
    values, code, count = np.unique(every, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1  # only shingles that two sets hold can be common
    width = -(-int((count > 1).sum()) // 8)
    owner = np.repeat(np.arange(len(sets) + len(sets2)), np.concatenate([size, size2]))
    held = count[code] > 1
    column, owner = number[code[held]], owner[held]
    bits = np.zeros((len(sets) + len(sets2), width), np.uint8)
    np.bitwise_or.at(bits, (owner, column >> 3), np.left_shift(np.uint8(1), (column & 7).astype(np.uint8)))
    bits = np.pad(bits, ((0, 0), (0, -width % 8))).view(np.uint64)
    at = int(np.flatnonzero(bands[0] == bucket)[0])
    edges: list[tuple[int, int]] = []
    for i in range(len(sets)):
        near = parts2 != parts[i]
        near &= ~(bands2[:, :at] == bands[i, :at]).any(axis=1)
        near &= 100 * np.minimum(size2, size[i]) >= percent * np.maximum(size2, size[i])
        j = np.flatnonzero(near)
        if len(j):
            both = np.bitwise_count(bits[len(sets) + j] & bits[i]).sum(axis=1, dtype=np.int64)
            j = j[100 * both >= percent * (size[i] + size2[j] - both)]
            edges += [(int(nodes[i]), int(nodes2[k])) for k in j]
        if len(edges) > 1 << 16:
            edges = _forest(edges)
    return _forest(edges)


def _tiles(k: int, percent: int):
    def block(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        rows = rows.flatten()
        nodes, parts, bands, text = (rows.field(i) for i in range(4))
        flat = bands.flatten().to_numpy().reshape(len(nodes), -1)
        data, offs = column_bytes(text)
        shingles, edge = shingle_sets(scan(data, offs, lower=True), k)
        return nodes.to_numpy(), parts.to_numpy(), flat, np.split(shingles, edge[1:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                left = block(one.column(1))
                right = block(one.column(2)) if one.column(2)[0].is_valid else left
                found = tile_links(left, right, one.column(0)[0].as_py(), percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate groups: ``doc_id, n_shingles, component_id, kept``, one row per input row.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, whatever their
    names. Words are runs of bytes other than ASCII white space, A-Z lower-cased; a
    document's set has its distinct runs of ``words`` words, or its whole sequence if
    it is shorter. Documents are linked if ``100 * |both| >= percent * |either|``.
    ``component_id`` is the smallest ``doc_id`` reachable, itself included.

    Null, empty and blank texts have no shingles and link with nothing. Rows that share
    a ``doc_id`` are one document of the graph, with the links of each of its texts. A null
    ``doc_id`` takes no part: its component is null and it is kept. An empty table gives no rows.
    """
    rows, bands = banding(percent / 100)
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text")
    )
    kinds = "doc_id long, tag long, n_shingles long, k1 long, k2 long, bands array<long>"
    sketched = cut(plain.mapInArrow(_sketcher(words, rows, bands), kinds), "sketches")
    usable = sketched.filter("n_shingles > 0 and doc_id is not null")
    # Classes have numbers of their own; ``tag`` tells the texts of one doc_id apart.
    classes = usable.groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "tag")).alias("least"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")
    )
    classes = classes.select("k1", "k2", "n", "least.doc_id", "least.tag", "bands", F.monotonically_increasing_id().alias("node"))
    classes = cut(classes, "classes")
    first_of = classes.select("k1", "k2", "n", F.col("doc_id").alias("v"))
    copies = spread_join(usable.select("k1", "k2", F.col("doc_id").alias("u")), first_of, ["k1", "k2"], F.col("u"))
    copies = copies.filter("u <> v").select("u", "v")
    entries = cut(classes.select("node", F.explode("bands").alias("h")), "entries")
    ends = entries.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n"))
    ends = cut(ends.filter("low < high"), "ends")
    shared = cut(spread_join(entries, ends, ["h"], F.col("node")).drop("n"), "buckets")
    forget(entries)
    members = shared.select("node").distinct().join(classes.select("node", "doc_id", "tag"), "node")
    texts = cut(plain.join(small_or_plain(members), ["doc_id", "tag"]).select("node", "text").dropDuplicates(["node"]), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = texts.toDF("u", "a")
        per_v = cut(pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "per_v")
        y = per_v.join(texts.toDF("v", "b"), "v")
        joined = spread_join(pairs.join(x, "u"), y, ["v"], F.col("u"), counts=per_v).select("u", "v", "a", "b")
        return joined.mapInArrow(_verifier(words, percent), "u long, v long")

    def labelled(reached: DataFrame) -> DataFrame:
        found = shared.join(reached.toDF("node", "component"), "node", "left")
        return found.select("h", "node", "low", "high", F.coalesce("component", "node").alias("component"))

    first = cut(shared.filter("node > low").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct(), "pairs")
    reached = stars(confirmed(first))
    here = cut(labelled(reached), "labelled")
    tops = here.filter("node = high").select("h", F.col("component").alias("top"))
    tops = cut(tops.join(ends.select("h", "n"), "h"), "tops")
    again = spread_join(here, tops, ["h"], F.col("node")).filter("node < high and node > low and component <> top")
    again = cut(again.select(F.col("node").alias("u"), F.col("high").alias("v")).distinct(), "pairs")
    before, reached = reached, stars(reached.unionAll(confirmed(again)))
    forget(before, here)
    here = cut(labelled(reached), "labelled")
    # The largest component of each bucket that holds several; its own members need no more links.
    parts = here.groupBy("h", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("h").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    mixed = cut(mixed.filter("parts > 1").select("h", "main", "n"), "mixed")
    apart = spread_join(here, mixed, ["h"], F.col("node"))
    apart = (
        apart.select("h", "node", "component", (F.col("component") == F.col("main")).alias("in_main"))
        .join(texts, "node").join(classes.select("node", "bands"), "node")
    )
    apart = cut(apart, "apart")
    size = F.octet_length("text") + 200
    sizes = apart.groupBy("h").agg(
        F.ceil(F.sum(F.when(F.col("in_main"), size)) / TILE_BYTES).cast("int").alias("mains"),
        F.ceil(F.sum(F.when(~F.col("in_main"), size)) / TILE_BYTES).cast("int").alias("others"), F.count(F.lit(1)).alias("n"),
    )
    dealt = spread_join(apart, cut(sizes, "sizes"), ["h"], F.col("node")).withColumn(
        "b", F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    )
    row = F.struct("node", "component", "bands", "text")
    blocks = cut(dealt.groupBy("h", "in_main", "b", "mains", "others").agg(F.collect_list(row).alias("rows")), "blocks")
    forget(apart)
    with_others = F.sequence(F.col("b"), F.col("others") - 1)
    with_main = F.sequence(F.lit(0), F.col("mains") - 1)
    left = blocks.filter("not in_main")
    pairs = left.select("h", "b", "rows", F.lit(False).alias("in_main"), F.explode(with_others).alias("c")).unionAll(
        left.select("h", "b", "rows", F.lit(True), F.explode(with_main))
    )
    right = blocks.select("h", "in_main", F.col("b").alias("c"), F.col("rows").alias("rows2"))
    same = (F.col("b") == F.col("c")) & ~F.col("in_main")
    tiles = pairs.join(right, ["h", "in_main", "c"]).select("h", "rows", F.when(~same, F.col("rows2")).alias("rows2"), "b", "c", "in_main")
    tiles = tiles.repartition(F.xxhash64("h", "in_main", "b", "c")).select("h", "rows", "rows2")
    links = reached.unionAll(cut(tiles.mapInArrow(_tiles(words, percent), "u long, v long"), "tiles", batch_rows=8))
    ids = classes.select("node", "doc_id")
    linked = links.join(ids.toDF("u", "a"), "u").join(ids.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = stars(linked.unionAll(copies)).toDF("doc_id", "component")
    forget(shared, blocks, texts, here)
    return sketched.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )
