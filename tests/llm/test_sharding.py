"""Rendezvous shards against a plain reckoning of every draw, and what changes of shards move."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import sharding

KIND = "doc_id long, text string, shard string, slot string, record string, file string, part string, n string"


def rows_of():
    rows = [(i, f"text {i} é" * (i % 7)) for i in range(3000)]
    rows += [(5, "other"), (None, "no id"), (None, "no id"), (3001, None), (3002, ""), (3003, "long " * 200_000)]
    return rows + [(77, "hot")] * 2000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *"abcdef") for r in rows_of()], KIND).repartition(7)


def plain(key, weights):
    def draw(shard):
        h = 42
        for x in ([] if key is None else [key]) + [shard]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=h)
        return ((h >> 11) + 0.5) * 2.0**-53

    return min((-math.log(draw(s)) / w, s) for s, w in weights.items() if w > 0)[1]


def test_shards_equal_every_draw_reckoned(docs):
    found = sharding.shard_documents(docs).collect()
    want = Counter()
    before, after = {}, {}
    for key, text in rows_of():
        if key not in before:
            before[key], after[key] = plain(key, sharding.even(40)), plain(key, sharding.even(41))
        raw = (text or "").encode()
        want[key, len(raw) + 16, zlib.crc32(raw), "key", before[key], after[key]] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in found) == want
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 40


def test_slots_span_ranges_and_empty_tables(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 16)
    found = sharding.shard_documents(docs, shards=3, grown=False).collect()
    for shard in range(3):
        own = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert {r["grown_shard"] for r in found} == {None}
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_weights_share_and_move_no_more_than_they_must(spark):
    keys = spark.range(40_000).withColumn("key", F.concat(F.lit("url/"), "id"))
    before, after = {7: 1.0, 8: 2.0, 9: 1.0, 10: 0.0}, {7: 1.0, 8: 3.0, 9: 1.0}
    moved = {(r["from_shard"], r["to_shard"]): r["rows"] for r in sharding.moves(keys, "key", before, after).collect()}
    assert all(a == b or b == 8 for a, b in moved)  # only the shard whose weight grew takes rows
    share = Counter()
    for (_, b), n in moved.items():
        share[b] += n
    assert abs(share[8] / 40_000 - 0.6) < 0.015 and abs(share[7] / 40_000 - 0.2) < 0.015
    gone = {(r["from_shard"], r["to_shard"]) for r in sharding.moves(keys, "key", after, {8: 3.0, 9: 1.0}).collect()}
    assert gone == {(7, 8), (7, 9), (8, 8), (9, 9)}
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("key"), {1: 0.0})


def test_written_shards_hold_every_record(spark, docs, tmp_path):
    path = str(tmp_path / "out")
    sharding.write_shards(docs.drop("shard", "slot"), "doc_id", {1: 1.0, 2: 0.5}, path, rows=500)
    back = spark.read.parquet(path)
    assert set(back.columns) == {"doc_id", "text", "record", "file", "part", "n", "slot", "shard"}
    found = back.collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(rows_of())
    assert all(r["shard"] == plain(r["doc_id"], {1: 1.0, 2: 0.5}) for r in found)
    files = Counter(r["f"] for r in back.select(F.input_file_name().alias("f")).collect())
    assert max(files.values()) <= 500
