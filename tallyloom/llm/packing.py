"""Best-fit packing of tokenised documents by minimum bin slack.

Only the histogram of piece lengths (``limit`` counts) decides how bins are filled. Each
step seeds a bin with the longest length left, finds the fullest feasible combination
of the other lengths left by a bitset subset-sum table, and removes it as many times
as the counts allow; so the plan has few more patterns than lengths, however many bins
there are. Pieces are then numbered within their length in two levels (hash ranges,
then pieces within a range) and looked up in the plan, which is bounded by ``limit``.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import cut

#: Word encodings that a worker remembers at most.
CACHE_WORDS = 400_000
#: Pieces aimed at in each hash range of a length.
RANGE_PIECES = 50_000


# Fixed values of byte-level BPE: how bytes are spelt in the vocabulary file, and how texts are split.
END_OF_TEXT = "<|endoftext|>"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in _PRINTED]
_BYTE_OF = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(_OTHER)}


class Encoder:
    """Token ids, as little-endian unsigned 32-bit bytes, of a byte-level BPE vocabulary.

    The ids are those of the ``tokenizers`` library for the same file, no special tokens
    added (tested): a text is first split at the file's added tokens, which get their own ids.
    Words not met before are encoded with the file's merge ranks by ``tiktoken``, which is
    several times faster.
    Pre-tokenisation never joins a space to the character before it, so a text is cut
    before each space that begins a word and the words' ids are remembered. Texts with
    a space before other white space, or at the end, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            declared = json.load(file)
        vocabulary = declared["model"]["vocab"]
        tokens = declared.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
            raise ValueError("added tokens that take white space or whole words only are not supported")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in tokens}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        ranks = {bytes(_BYTE_OF[c] for c in t): i for t, i in vocabulary.items() if set(t) <= _BYTE_OF.keys() and t != END_OF_TEXT}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.spaced = np.zeros(max(ranks.values()) + 2, bool)
        self.spaced[[i for t, i in ranks.items() if t.startswith(b" ")]] = True

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(text), dtype="<u4")

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        listed = list(words)
        for at in range(0, len(listed), 2000):
            part = listed[at : at + 2000]
            ids = self._whole(" " + " ".join(part))
            begin = np.flatnonzero(self.spaced[ids])
            assert len(begin) == len(part)
            raw, edges = ids.tobytes(), (np.append(begin, len(ids)) * 4).tolist()
            self.known.update(zip(part, (raw[a:b] for a, b in zip(edges, edges[1:], strict=False)), strict=True))

    def _ordinary(self, text: str) -> bytes:
        words = text.split(" ")
        if any(not w or w[0].isspace() for w in words[1:]):
            return self._whole(text).tobytes()
        first = self._whole(words[0]).tobytes() if words[0] else b""
        rest = words[1:]
        try:
            return first + b"".join(map(self.known.__getitem__, rest))
        except KeyError:
            new = {w for w in rest if w not in self.known}
            if len(self.known) + len(new) > CACHE_WORDS:
                new = set(rest)
            self._learn(new)
            return first + b"".join(map(self.known.__getitem__, rest))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        for text in texts:
            if not any(t in text for t in self.added):  # also where the file declares none
                yield self._ordinary(text)
                continue
            parts = self.at_added.split(text)  # every second part is an added token
            yield b"".join(self.added[p] if i % 2 else self._ordinary(p) for i, p in enumerate(parts))


def _cutter(path: str, limit: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        stop = array("I", [end]).tobytes()
        assert sys.byteorder == "little"
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
                docs, piece, start, length, crc = [], [], [], [], []
                for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    raw = ids + stop
                    n = len(raw) // 4
                    head = n % limit or min(n, limit)
                    edges = [0, *range(head, n + 1, limit)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        docs.append(doc)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def pieces(docs: DataFrame, tokenizer: str, *, limit: int = 1024, end: int = 2) -> DataFrame:
    """Token pieces of every text: ``doc_id, piece, start, length, ids_crc32``."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_cutter(tokenizer, limit, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """Lengths, with repeats, that fill most of ``room``; of equal fills one with long pieces."""
    reach, trail = 1, []
    mask = (1 << (room + 1)) - 1
    for length in lengths:
        for _ in range(min(counts[length], room // length)):
            grown = reach | (reach << length) & mask
            if grown == reach:
                break
            trail.append((length, reach))
            reach = grown
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, []
    for length, before in reversed(trail):
        if not before >> at & 1:
            used.append(length)
            at -= length
    return used


def plan_bins(histogram: dict[int, int], limit: int) -> list[tuple[int, list[int]]]:
    """Patterns ``(times, lengths)`` that use up the histogram of piece lengths."""
    left = {k: v for k, v in histogram.items() if v > 0}
    plan = []
    while left:
        seed = max(left)
        left[seed] -= 1
        room = limit - seed
        lengths = [k for k in sorted(left, reverse=True) if k <= room and left[k] > 0]
        pattern = [seed, *sorted(fullest(room, lengths, left), reverse=True)]
        left[seed] += 1
        uses = {k: pattern.count(k) for k in pattern}
        times = min(left[k] // n for k, n in uses.items())
        for k, n in uses.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((times, pattern))
    return plan


def _places(plan: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length, rows ``first rank, uses in a bin, first bin, offset in the bin``, by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for times, pattern in plan:
        offset = 0
        for length in dict.fromkeys(pattern):
            n = pattern.count(length)
            rows.setdefault(length, []).append((used.get(length, 0), n, first_bin, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first_bin += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _placer(places: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                own = length == k
                table = places[k]
                row = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                copy, slot = np.divmod(rank[own] - row[:, 0], row[:, 1])
                sequence[own] = row[:, 2] + copy
                offset[own] = row[:, 3] + slot * k
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, tokenizer: str, *, limit: int = 1024, end: int = 2) -> DataFrame:
    """Sequences of at most ``limit`` tokens: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A document is its
    ids by the byte-level BPE file ``tokenizer`` (no special tokens added, but those that
    stand in the text are single ids) and then the id ``end``. Longer documents are cut into pieces of ``limit`` tokens, of which the first
    may be shorter. Sequences are numbered from 0, pieces stand in them without gaps.

    Null and empty texts are the id ``end`` alone. A null ``doc_id`` is packed like any
    other; repeated rows are packed each. An empty table gives no rows.
    """
    cut_up = cut(pieces(docs, tokenizer, limit=limit, end=end), "pieces")
    counted = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(plan_bins(counted, limit))
    ranges = max(1, -(-max(counted.values(), default=0) // RANGE_PIECES))
    part = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(ranges)).cast("int")
    tagged = cut_up.withColumn("part", part)
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        tagged.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    )
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = tagged.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("ahead")).cast("long").alias("rank"))
    return ranked.mapInArrow(
        _placer(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
