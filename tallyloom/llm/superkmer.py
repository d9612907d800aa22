"""Exact removal of repeated word windows by super-k-mer partitioning.

The minimiser of a window is the smallest-hashed run of ``MINIMISER`` words in it. Runs of
consecutive windows whose minimiser is the same occurrence travel together as one packed
string (the words, joined by spaces) to the bucket of that minimiser, so equal windows
always meet there. Map tasks collapse equal strings and compress what goes to a bucket.
In a bucket equal strings collapse again, the windows of the distinct strings are sorted
by hash, equal hashes are compared word for word, and all but the first occurrence are
reported as covered word ranges.

Minimisers with more than ``HEAVY`` distinct strings (a passage repeated in very many
different surroundings; counted by 16 bits of the minimiser) are not held in one task: the
words of each of their windows become a row of their own, and the first occurrence of equal
ones is found by an aggregation with map-side combining. All other occurrences are cut.

There are ``PARTITIONS`` shuffle partitions at most; beyond that a partition holds several
buckets, sorted, and its task works on one after another.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import chunks, cut
from tallyloom.llm.words import U, grams, mix, powers, scan

MINIMISER = 4
#: Distinct strings of one minimiser that a task holds.
HEAVY = 20_000
#: Bytes of packed strings that a map task gathers before it sends them.
FLUSH_BYTES = 32 << 20
#: Bytes of packed strings aimed at in a bucket.
BUCKET_BYTES = 24 << 20
#: Shuffle partitions that hold the buckets, at most.
PARTITIONS = 1 << 15
#: Stands for a null doc_id, which comes after all others.
_NULL_ID = (1 << 63) - 1
#: Bits of a position in a slice of words; longer texts are worked on slice by slice.
_POSITION_BITS = 24


def spaced_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by single spaces: bytes, where each word starts in them, and first word of each row."""
    n, rows = len(data), len(offs) - 1
    apart = np.full(n + rows, 32, np.uint8)
    apart[np.arange(n) + np.repeat(np.arange(rows), np.diff(offs))] = data
    words = scan(apart, offs + np.arange(rows + 1), lower=False)
    keep = np.zeros(len(apart), np.int8)
    keep[words.start] += 1
    np.add.at(keep, np.minimum(words.end + 1, len(apart) - 1), -1)
    inside = np.cumsum(keep, dtype=np.int8).astype(bool)
    if len(words.end) and words.end[-1] == len(apart) - 1:
        inside[-1] = True
    packed = apart[inside]
    at = np.concatenate([[0], np.cumsum(words.end - words.start + 1)])
    packed[at[1:] - 1] = 32
    return packed, at, words


def minimiser_runs(word_hash: np.ndarray, first: np.ndarray, width: int, bits: int = _POSITION_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each run of windows that share its occurrence.

    Slices overlap by ``width - 1`` words, so each window is whole in one; a run ends with its slice.
    """
    step = (1 << bits) - width + 1
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for at in range(0, max(len(word_hash) - width + 1, 0), step):
        part = word_hash[at : at + step + width - 1]
        window, count, least = _slice_runs(part, np.clip(first - at, 0, len(part)), width, bits)
        found.append((window + at, count, least))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _slice_runs(word_hash: np.ndarray, first: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    short = min(MINIMISER, width)
    g = grams(word_hash, short)
    span = width - short + 1
    low = U((1 << bits) - 1)
    least = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    done = 1
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    last = np.repeat(first[1:], np.diff(first))[: len(least)]
    window = np.flatnonzero(np.arange(len(least)) + width <= last)
    if not len(window):
        return none, none, np.zeros(0, np.uint64)
    place = (least[window] & low).astype(np.int64)
    opens = np.ones(len(window), bool)
    opens[1:] = (place[1:] != place[:-1]) | (np.diff(window) != 1)
    at = np.flatnonzero(opens)
    return window[at], np.diff(np.append(at, len(window))), g[place[at]]


def _splitter(width: int, parts: int, buckets: int):
    def flush(held: dict[int, dict[bytes, list]]) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=6)
        listed, blobs = [], []
        for bucket, strings in held.items():
            k = np.array([len(strings)], np.int64)
            length = np.fromiter(map(len, strings), np.int64, len(strings))
            least = np.fromiter((v[0] for v in strings.values()), np.uint16, len(strings))
            count = np.fromiter(((len(v) - 1) // 3 for v in strings.values()), np.int64, len(strings))
            where = np.array([x for v in strings.values() for x in v[1:]], np.int64).reshape(-1, 3).T
            listed.append(bucket)
            blobs.append(pack.compress(b"".join([k.tobytes(), length.tobytes(), least.tobytes(), count.tobytes(), np.ascontiguousarray(where).tobytes(), *strings])))
        bucket = np.array(listed, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array((bucket % parts).astype(np.int32)), pa.array(bucket // parts), pa.array(blobs, pa.binary())], names=["part", "sub", "blob"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, list]] = {}
        size = 0
        for batch, data, offs in chunks(batches, "text"):
            packed, at, words = spaced_words(data, offs)
            window, count, least = minimiser_runs(words.hash, words.first, width)
            doc = np.searchsorted(words.first, window, side="right") - 1
            ids = batch.column(0).fill_null(_NULL_ID).to_numpy()[doc].tolist()
            tags = batch.column(1).to_numpy()[doc].tolist()
            start = (window - words.first[doc]).tolist()
            low, high = at[window].tolist(), (at[window + count + width - 1] - 1).tolist()
            part = (mix(least) % U(buckets)).tolist()
            raw = packed.tobytes()
            for p, m, a, b, i, t, s in zip(part, (least >> U(48)).tolist(), low, high, ids, tags, start, strict=True):
                strings = held.get(p)
                if strings is None:
                    strings = held[p] = {}
                text = raw[a:b]
                own = strings.get(text)
                if own is None:
                    strings[text] = [m, i, t, s]
                    size += b - a + 100
                else:
                    own += (i, t, s)
                    size += 24
            if size > FLUSH_BYTES:
                yield flush(held)
                held, size = {}, 0
        if held:
            yield flush(held)

    return run


def _unpack(blob: bytes) -> tuple[list[bytes], list[int], list[int], list[tuple[int, int, int]]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    at = 8
    length = np.frombuffer(raw, np.int64, k, at)
    least = np.frombuffer(raw, np.uint16, k, at + 8 * k)
    count = np.frombuffer(raw, np.int64, k, at + 10 * k)
    n = int(count.sum())
    where = np.frombuffer(raw, np.int64, 3 * n, at + 18 * k).reshape(3, n)
    at += 18 * k + 24 * n
    edge = np.concatenate([[0], np.cumsum(length)]) + at
    strings = [raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return strings, least.tolist(), count.tolist(), list(zip(*where.tolist(), strict=True))


def window_hashes(word_hash: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each run of ``width`` words, by prefix sums over blocks."""
    n = len(word_hash) - width + 1
    out = np.empty(max(n, 0), np.uint64)
    up, down = powers(base), powers(pow(base, -1, 1 << 64))
    step = len(up) - width
    for at in range(0, n, step):
        part = word_hash[at : at + step + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        m = len(part) - width + 1
        out[at : at + m] = mix((sums[width:] - sums[:-width]) * down[:m])
    return out


_BASE = 0xB5297A4D3F84D5B5
_OUT = "kind int, doc_id long, tag long, a long, b long, words string"


def _counter(width: int, heavy: int):
    schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "tag", "a", "b")), ("words", pa.string())])

    def rows(kind: int, ids, tags, a, b, words: list[bytes] | None = None) -> pa.RecordBatch:
        given = [np.asarray(x, np.int64) for x in (ids, tags, a, b)]
        text = pa.nulls(len(ids), pa.string()) if words is None else pa.array(words, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), *(pa.array(x) for x in given), text], schema=schema)

    def spread(strings: list[bytes], first: list[tuple[int, int, int]], limit: int = 4 << 20) -> Iterator[tuple]:
        """Windows of strings, in parts: string index, offset in it, where their bytes begin and end, hash."""
        at = 0
        while at < len(strings):
            to, size = at, 0
            while to < len(strings) and (to == at or size < limit):
                size += len(strings[to]) + 1
                to += 1
            data = np.frombuffer(b" ".join(strings[at:to]), np.uint8)
            length = np.fromiter(map(len, strings[at:to]), np.int64, to - at) + 1
            offs = np.concatenate([[0], np.cumsum(length)])
            offs[-1] = len(data)
            words = scan(data, offs, lower=False)
            windows = words.count() - width + 1
            owner = np.repeat(np.arange(at, to), windows)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            place = words.first[:-1][owner - at] + offset
            yield owner, offset, words.start[place] - offs[owner - at], words.end[place + width - 1] - offs[owner - at], window_hashes(words.hash, width, _BASE)[place]
            at = to

    def pass_on(strings: list[bytes], first: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        for owner, offset, low, high, _ in spread(strings, first, 1 << 20):
            where = np.array(first, np.int64)[owner]
            start = where[:, 2] + offset
            words = [strings[o][a:b] for o, a, b in zip(owner.tolist(), low.tolist(), high.tolist(), strict=True)]
            for at in range(0, len(words), 10_000):
                one = slice(at, at + 10_000)
                yield rows(1, where[one, 0], where[one, 1], start[one], start[one] + width, words[one])

    def resolve(strings: list[bytes], first: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        parts = list(spread(strings, first))
        if not parts:
            return
        owner, offset, low, high, h1 = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(h1, kind="stable")
        same = np.flatnonzero(h1[order][1:] == h1[order][:-1])
        if not len(same):
            return
        mine = np.unique(np.concatenate([same, same + 1]))
        order, group = order[mine], h1[order[mine]]
        where = np.array(first, np.int64)[owner[order]]
        rank = np.lexsort((where[:, 2] + offset[order], where[:, 1], where[:, 0], group))
        repeated = np.zeros(len(owner), bool)
        at = 0
        sorted_group, listed = group[rank], order[rank]
        edges = np.flatnonzero(np.append(True, sorted_group[1:] != sorted_group[:-1])).tolist() + [len(listed)]
        own, lows, highs = owner[listed].tolist(), low[listed].tolist(), high[listed].tolist()
        for at, to in zip(edges, edges[1:], strict=False):
            seen = set()
            for i in range(at, to):
                text = strings[own[i]][lows[i] : highs[i]]
                if text in seen:
                    repeated[listed[i]] = True
                seen.add(text)
        hit = np.flatnonzero(repeated)
        if not len(hit):
            return
        opens = np.ones(len(hit), bool)
        opens[1:] = (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])
        begin = np.flatnonzero(opens)
        end = np.append(begin[1:], len(hit)) - 1
        where = np.array(first, np.int64)[owner[hit[begin]]]
        yield rows(0, where[:, 0], where[:, 1], where[:, 2] + offset[hit[begin]], where[:, 2] + offset[hit[end]] + width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int, int]] = {}
        least_of: dict[bytes, int] = {}
        per_least: Counter[int] = Counter()
        passed: set[int] = set()
        here: int | None = None
        for batch in batches:
            for sub, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if sub != here:  # buckets come one after another
                    yield from resolve(list(known), list(known.values()))
                    known, least_of, per_least, passed, here = {}, {}, Counter(), set(), sub
                strings, leasts, counts, where = _unpack(blob.as_py())
                gone: list[tuple[int, int, int, int]] = []
                direct: dict[bytes, tuple[int, int, int]] = {}
                at = 0
                for text, least, n in zip(strings, leasts, counts, strict=True):
                    seen = where[at : at + n]
                    at += n
                    heavy_one = least in passed
                    before = None if heavy_one else known.get(text)
                    if before is not None:
                        seen.append(before)
                    elif not heavy_one:
                        per_least[least] += 1
                        least_of[text] = least
                    best = seen[0] if len(seen) == 1 else min(seen)
                    if len(seen) > 1:
                        words = text.count(b" ") + 1
                        gone.extend((*x, x[2] + words) for x in seen if x != best)
                    (direct if heavy_one else known)[text] = best
                if gone:
                    yield rows(0, *zip(*gone, strict=True))
                over = {m for m, n in per_least.items() if n > heavy}
                if over:
                    for text in [t for t, m in least_of.items() if m in over]:
                        direct[text] = known.pop(text)
                        del least_of[text]
                    for m in over:
                        del per_least[m]
                    passed |= over
                if direct:
                    yield from pass_on(list(direct), list(direct.values()))
        yield from resolve(list(known), list(known.values()))

    return run


def _applier(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in chunks(batches, "text"):
            packed, at, words = spaced_words(data, offs)
            raw = packed.tobytes()
            n_words, n_removed, digests, texts = [], [], [], []
            cuts = batch.column(1).to_pylist()
            for r, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                kept = np.ones(b - a, bool)
                for c in cuts[r] or ():
                    kept[c["a"] : c["b"]] = False
                if kept.all():
                    text = raw[at[a] : at[b] - 1] if b > a else b""
                else:
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]])))
                    text = b" ".join(raw[at[a + i] : at[a + j] - 1] for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
                n_words.append(b - a)
                n_removed.append(int((~kept).sum()))
                digests.append(hashlib.sha256(text).hexdigest())
                texts.append(text)
            columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["n_words", "n_removed", "kept_sha256"]
            if with_text:
                was = batch.column(0)
                same = pa.array([x == 0 for x in n_removed])
                columns.append(pa.compute.if_else(same, was, pa.array(texts, pa.binary()).cast(was.type)))
                names.append("text")
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *columns], names=[*batch.schema.names[2:], *names])

    return run


def remove_repeats(
    docs: DataFrame, *, width: int = 20, keep: tuple[str, ...] = (), with_text: bool = False, heavy: int = HEAVY,
    bucket_bytes: int = BUCKET_BYTES, partitions: int = PARTITIONS,
) -> DataFrame:
    """Removes every word covered by a window that also starts earlier: ``doc_id, n_words, n_removed, kept_sha256``.

    ``docs`` needs ``doc_id`` and ``text``; columns named in ``keep`` are carried along, others
    ignored. Words are runs of bytes other than ASCII white space, unchanged. A window is
    ``width`` consecutive words of one document; it is earlier in a smaller ``doc_id``, or in
    the same document further ahead. Windows are judged on the input. ``kept_sha256`` is of
    the kept words joined by single spaces. With ``with_text`` a column ``text`` has those
    words, or the text as it was if nothing was removed.

    Null and empty texts have no words. Null ids come last. Rows with the same ``doc_id`` and
    text are one document and get the same result; other texts of the same ``doc_id`` are
    documents ordered by a hash of the text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text"),
        *[F.col(c) for c in keep if c not in ("doc_id", "text", "tag")],
    )
    total = plain.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * total // bucket_bytes)
    parts = min(buckets, partitions)
    buckets = -(-buckets // parts) * parts
    packed = plain.select("doc_id", "tag", "text").mapInArrow(_splitter(width, parts, buckets), "part int, sub long, blob binary")
    placed = packed.repartitionById(parts, F.col("part"))
    if buckets > parts:
        placed = placed.sortWithinPartitions("sub")
    found = cut(placed.select("sub", "blob").mapInArrow(_counter(width, heavy), _OUT), "repeats")
    passed = found.filter("kind = 1").select("doc_id", "tag", "a", "b", "words")
    firsts = passed.groupBy("words").agg(F.min(F.struct("doc_id", "tag", "a")).alias("at")).select("at.*")
    later = passed.drop("words").join(firsts, ["doc_id", "tag", "a"], "left_anti")
    ranges = found.filter("kind = 0").select("doc_id", "tag", "a", "b").unionAll(later)
    cuts = ranges.groupBy(F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")).alias("of"), F.col("tag").alias("of_tag")).agg(
        F.collect_set(F.struct("a", "b")).alias("cuts")
    )
    joined = plain.join(cuts, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag")), "left")
    carried = [c for c in keep if c not in ("doc_id", "text", "tag")]
    shape = joined.select("text", "cuts", "doc_id", *carried)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema.fields[2:])
    out = f"{kinds}, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return shape.mapInArrow(_applier(with_text), out)
