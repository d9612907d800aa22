"""Corpus operators against brute force, round trips and held-out accuracy, on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import embedding_dedup, licenses, minhash, mixing, packing, permutation_index, pu_quality, superkmer, toxicity, warc
from tallyloom.llm.queries import tokenizer_path
from tallyloom.llm.shared import column_bytes

# Columns whose names the operators use inside; they must neither matter nor clash.
EXTRA = ("node", "h", "size", "key", "part", "bands", "u", "v", "tag", "cuts", "score", "rows", "b", "of", "text_", "rank")


def words_of(rng, n, vocabulary=300):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    rng = random.Random(5)
    docs = []
    for i in range(40):
        docs.append((i, " ".join(words_of(rng, rng.choice([1, 2, 3, 8, 60, 120])))))
    base = words_of(rng, 100)
    for i in range(40, 80):  # near copies around the threshold
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " \n".join(own)))
    passage = words_of(rng, 30)
    for i in range(80, 110):
        docs.append((i, " ".join(words_of(rng, 25) + passage + words_of(rng, 25))))
    docs += [(110, docs[4][1]), (111, docs[4][1].upper()), (112, None), (113, ""), (114, " \t\n"), (115, "uno dos"), (116, "UNO  dos"), (117, "a"), (118, "a b c d e " * 400)]
    docs += [(119, "Ünïcode ½ naïve ß"), (120, " ".join(base + base)), docs[5], (None, docs[60][1])]
    return docs


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    sources = ["s1", "s2", "s3", None]
    data = [(i, t, "en", "hot" if (i or 0) % 3 == 0 else sources[(i or 0) % 4], len(t or ""), *["z"] * len(EXTRA)) for i, t in rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame(data, kinds)


def empty(docs):
    return docs.limit(0)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def reach(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize(("k", "percent", "tile"), [(3, 85, 1 << 20), (5, 80, 2000)])
def test_minhash(docs, rows, k, percent, tile, monkeypatch):
    monkeypatch.setattr(minhash, "TILE_BYTES", tile)
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = reach(ids, links)
    found = minhash.near_duplicates(docs, words=k, percent=percent).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]), want[r["doc_id"]] == r["doc_id"])
        else:
            assert r["component_id"] is None and r["kept"]
    assert minhash.near_duplicates(empty(docs)).count() == 0


def test_minhash_takes_every_text_of_a_repeated_id(spark):
    a, b = words_of(random.Random(1), 60, 10**6), words_of(random.Random(2), 60, 10**6)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, " ".join([*b, "more"])), (11, " ".join(["less", *a])), (12, "alone"), (5, None)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(5, 5), (5, 5), (5, 5), (9, 5), (11, 5), (12, 12)]


@pytest.mark.parametrize("tile", [1 << 20, 3000])
def test_minhash_finds_strays_of_a_large_group(spark, tile, monkeypatch):
    """Chains of near copies share buckets with a group that their ends are no copies of."""
    monkeypatch.setattr(minhash, "TILE_BYTES", tile)
    rng = random.Random(3)
    base = words_of(rng, 80, 10**6)
    docs = []
    for i in range(60):
        own = list(base)
        for j in range(rng.randrange(0, 14)):
            own[rng.randrange(80)] = f"y{i}_{j}"
        docs.append((i, " ".join(own)))
    sets = {i: shingles(t, 5) for i, t in docs}
    links = [(x, y) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    want = reach(list(sets), links)
    assert 5 < len(set(want.values())) < 60
    found = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    one = rng.integers(0, 1 << 63, 1).astype(np.uint64)
    table = minhash.sketch(np.concatenate([np.sort(a), np.sort(b), one]), np.array([0, 400, 800, 801]), 1024)
    assert (table != minhash._EMPTY).all()
    assert abs((table[0] == table[1]).mean() - 0.6) < 0.06


def test_superkmer(docs, rows):
    width = 20
    seen, gone, words = {}, {}, {}
    for i, t in sorted({(i if i is not None else 10**9, t) for i, t in rows}, key=lambda x: (x[0], x[1] or "")):
        words[i, t] = w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone[i, t] = set()
        for s in range(len(w) - width + 1):
            window = tuple(w[s : s + width])
            if window in seen:
                gone[i, t] |= set(range(s, s + width))
            seen.setdefault(window, (i, s))
    want = {}
    for key, w in words.items():
        kept = [x for j, x in enumerate(w) if j not in gone[key]]
        want[key[0]] = (len(w), len(gone[key]), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    for options in ({}, {"heavy": 2}, {"bucket_bytes": 500, "partitions": 3}, {"bucket_bytes": 500, "partitions": 3, "heavy": 2}):
        found = superkmer.remove_repeats(docs, width=width, **options).collect()
        assert len(found) == len(rows)
        for r in found:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"] if r["doc_id"] is not None else 10**9]
    texts = {r["doc_id"]: r["text"] for r in superkmer.remove_repeats(docs, keep=("lang", "source"), with_text=True).collect()}
    assert texts[40] == dict(rows)[40] and texts[112] is None
    assert superkmer.remove_repeats(empty(docs)).count() == 0


def test_minimisers_of_long_texts_do_not_depend_on_the_place():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    text = np.concatenate([words[:900], words, words[100:600]])
    first = np.array([0, 900, 900, len(text)])

    def windows(bits):
        least = {}
        for at, count, g in zip(*superkmer.minimiser_runs(text, first, 20, bits), strict=True):
            least |= dict.fromkeys(range(at, at + count), g)
        return least

    whole = windows(24)
    assert sorted(whole) == [i for i in range(len(text) - 19) if not 880 < i < 900]
    assert windows(9) == windows(6) == whole  # slices of 512 and 64 words
    assert all(whole[i] == whole[900 + i] for i in range(881)) and all(whole[3900 + i] == whole[1000 + i] for i in range(481))


def test_long_texts_and_words(spark):
    """Texts over a step's bytes, words over a hash block: whole results, none cut."""
    rng = random.Random(8)
    base = words_of(rng, 400_000, 10**6)
    huge, other = "x" * (3 << 19), "x" * ((3 << 19) - 1) + "y"
    texts = [" ".join(base), " ".join(base[:390_000] + words_of(rng, 20, 10**6)), f"{huge} a b c {huge}", f"{other} a b c {huge}", " ".join([huge, *base[5:45]])]
    assert len(texts[0]) > 2 << 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in superkmer.remove_repeats(docs).collect()}
    assert [(found[i]["n_words"], found[i]["n_removed"]) for i in range(5)] == [(400_000, 0), (390_020, 390_000), (5, 0), (5, 0), (41, 40)]
    assert found[4]["kept_sha256"] == hashlib.sha256(huge.encode()).hexdigest()
    groups = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    sets = [shingles(t, 5) for t in texts]
    assert groups == {i: (len(sets[i]), 0 if i == 1 else i) for i in range(5)}


def test_mixing(docs, rows):
    found = mixing.mix(docs, keep=("source",)).collect()
    assert len(found) == len(rows)
    per = {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        per.setdefault(r["source"], []).append(r)
    names = sorted((s for s in per if s is not None)) + [None]
    sizes = [sum(r["size"] for r in per[s]) for s in names]
    total, weights = sum(sizes), [1 + i % 3 for i in range(len(names))]
    target, open_ = [0.0] * len(names), set(range(len(names)))
    while open_:  # excess is dealt out anew by weight until none is above its limit
        level = (total - sum(target[i] for i in range(len(names)) if i not in open_)) / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * level > 3 * sizes[i]}
        for i in over or open_:
            target[i] = 3.0 * sizes[i] if over else weights[i] * level
        open_ -= over or open_
    for s, size, goal in zip(names, sizes, target, strict=True):
        assert all(r["source_size"] == size and abs(r["target"] - goal) < 1e-6 * total for r in per[s])
        assert abs(sum(r["taken"] for r in per[s]) - goal) <= 0.01 * goal + 3
    key = lambda r: (str(r["doc_id"]), r["taken"])
    assert sorted(map(key, mixing.mix(docs).collect())) == sorted(map(key, found))
    assert mixing.mix(empty(docs)).count() == 0


def mixed_table(spark, sizes):
    data = [(s, "w " * n) for s, listed in sizes.items() for n in listed]
    return spark.createDataFrame([(i, t, s, "z", "z") for i, (s, t) in enumerate(data)], "doc_id long, text string, source string, place string, part string")


@pytest.mark.parametrize("block", [7, 64, 1024, 100_000])
def test_mixing_gives_every_source_its_target_at_any_block_length(spark, block):
    sizes = {"a": [300] * 40, "b": [3], "c": [700, 5, 295] * 20, "d": [40, 1], "e": [150], "f": [500] * 30, "g": [0, 0]}
    docs = mixed_table(spark, sizes)
    per = {}
    for r in mixing.mix(docs, block=block, keep=("source", "place", "part")).collect():
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(p["words"] for p in r["parts"])
        assert [p["lap"] for p in r["parts"]] == list(range(len(r["parts"]))) and (r["place"], r["part"]) == ("z", "z")
        assert all(p["words"] == r["size"] for p in r["parts"][:-1])
        per.setdefault(r["source"], []).append(r)
    for s, found in per.items():
        assert sum(r["taken"] for r in found) == round(found[0]["target"]), s
    for s in "bde":
        assert all(r["taken"] == 3 * r["size"] for r in per[s])
    whole = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block=1).collect()} if block == 7 else {}
    assert not whole or whole == {r["doc_id"]: r["taken"] for found in per.values() for r in found}  # blocks never change what is taken


def test_mixing_takes_small_sources_three_times(spark):
    docs = mixed_table(spark, {"a": [1000] * 100, "b": [40], "c": [60, 40], "d": [1000] * 100})
    taken = {}
    for r in mixing.mix(docs, keep=("source",)).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert (taken["b"], taken["c"], sum(taken.values())) == (120, 300, 200_140)


def test_schedule_ranks_slots_evenly(spark):
    sources = spark.createDataFrame([("a", 60_000), ("b", 9_000), ("c", 30_000), ("d", 7)], "source string, source_size long")
    plan = mixing.plan_sources(sources, block=10).withColumn("block", F.lit(10))
    goals = {r["place"]: r for r in plan.collect()}
    slots = sorted(mixing.schedule(plan).collect())
    every = sum(g["need"] for g in goals.values())
    assert len(slots) == every and len({s["slot"] for s in slots}) == every
    seen = dict.fromkeys(goals, 0)
    for s in slots:
        g, turn = goals[s["place"]], seen[s["place"]]
        assert (s["block"], s["lap"]) == (turn % g["blocks"], turn // g["blocks"])
        seen[s["place"]] += 1
        if s["slot"] < every // 2:  # any part of the schedule is mixed like the whole
            assert all(abs(seen[p] - (s["slot"] + 1) * goals[p]["need"] / every) <= 12 for p in seen)
    assert seen == {p: g["need"] for p, g in goals.items()}


def test_mixing_of_texts_without_words(spark):
    docs = mixed_table(spark, {"a": [0, 0], "b": [0]})
    found = mixing.mix(docs).collect()
    assert len(found) == 3 and all((r["size"], r["target"], r["taken"], r["parts"]) == (0, 0.0, 0, []) for r in found)
    copies = mixing.mixed_copies(mixed_table(spark, {"a": [5, 3], "b": [200]}), keep=("source",))
    assert {(r["text"].split().__len__(), r["lap"]) for r in copies.filter("source = 'a'").collect()} >= {(5, 0), (3, 0)}
    assert copies.filter("cut").filter("text like '% '").count() == 0


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    odd = ["  a  b\n c ", "x <|endoftext|> y", "tab\t end ", "it's 12  3", "a\n b", "ä  ö"]
    encoder = packing.Encoder(tokenizer_path())
    for text, raw in zip(odd + [t or "" for _, t in rows], encoder.encode(odd + [t or "" for _, t in rows]), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    found = packing.pack(docs, tokenizer_path(), limit=128).collect()
    pieces, places = {}, {}
    for r in found:
        assert 0 < r["length"] <= 128
        pieces.setdefault((r["doc_id"], r["piece"], r["start"]), []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 128
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 128 or min(128, len(ids))
        edges = [0, *range(head, len(ids) + 1, 128)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            crc = zlib.crc32(np.array(ids[a:b], "<u4").tobytes())
            assert any(r["length"] == b - a and r["ids_crc32"] == crc for r in pieces[i, k, a])
    full = sum(r["length"] for r in found)
    assert len(places) <= 1.05 * full / 128 + 2
    assert packing.pack(empty(docs), tokenizer_path()).count() == 0


def test_bin_plans_use_everything():
    rng = random.Random(1)
    for limit in (10, 64):
        counts = {k: rng.randrange(0, 40) for k in range(1, limit + 1)}
        plan = packing.plan_bins(counts, limit)
        used = {}
        for times, pattern in plan:
            assert sum(pattern) <= limit
            for k in pattern:
                used[k] = used.get(k, 0) + times
        assert used == {k: v for k, v in counts.items() if v}
    assert packing.plan_bins({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10) == [(1, [6, 4]), (1, [5, 3, 2])]


def test_warc(spark):
    long = "<p>" + "página " * 40
    pages = [(3, "http://a", long), (1, "http://b", long), (2, None, "short"), (4, "http://c d", "short"), (5, "x", None), (6, "y", ""), (1, "http://b", long), (7, "z", "ß" * 60)]
    pages += [(100 + i, f"http://p/{i}", f"<html>{i} " + "texto " * 50) for i in range(20)]
    table = spark.createDataFrame([(*p, "z", "z") for p in pages], "page_id long, url string, html string, rows string, first_id string")
    found = sorted(warc.round_trip(table).collect())
    want = []
    for n, (i, _, html) in enumerate(pages):
        raw = (html or "").encode()
        first = min(j for j, _, h in pages if (h or "").encode() == raw)
        again = len(raw) >= 100 and (i != first or any(p == pages[n] for p in pages[:n]))
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    key = lambda r: (r[0], r[3])
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    path = warc.fresh_path(spark, "test")
    warc.write_archives(table, path)
    content = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect() if r["content"]]
    assert all(next(warc.iter_frames(c))[0] == warc.DICTIONARY_FRAME for c in content if len(c) > 20)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(spark, path, with_payload=True).filter("record_type = 'response'").collect()}
    assert payloads[7] == ("ß" * 60).encode() and payloads[5] == b""
    assert warc.round_trip(table.limit(0)).count() == 0


def test_warc_is_standard(spark):
    long = "<p>" + "página " * 40
    pages = [(3, "http://a x", long), (1, "http://b", long), (None, "http://n", long), (None, "http://m", "other " * 30), (4, "u", "tiny"), (4, "u", "tiny")]
    pages += [(100 + i, f"http://p/{i}", f"<html>{i} " + "texto " * 50) for i in range(30)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 5)  # must not leave files without a dictionary
    path = warc.fresh_path(spark, "standard")
    try:
        warc.write_archives(table, path)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    files = [r for r in spark.read.format("binaryFile").load(path).collect() if r["length"] > 20]
    assert all(r["path"].endswith(".warc.zst") for r in files)
    every = []
    for r in files:
        records = list(warc.parse_archive(bytes(r["content"])))
        assert next(warc.iter_frames(bytes(r["content"])))[0] == warc.DICTIONARY_FRAME
        assert records[0][0]["WARC-Type"] == "warcinfo" and all(h["WARC-Type"] != "warcinfo" for h, _ in records[1:])
        every += records
    by_page = {h.get("X-Page-Id"): h for h, _ in every if h["WARC-Type"] != "warcinfo"}
    revisit, response = by_page["3"], by_page["1"]
    assert revisit["WARC-Type"] == "revisit" and revisit["WARC-Refers-To"] == response["WARC-Record-ID"]
    assert (revisit["WARC-Refers-To-Target-URI"], revisit["WARC-Target-URI"]) == ("http://b", "http://a%20x")
    assert len({h["WARC-Record-ID"] for h, _ in every}) == len(every)
    back = sorted((r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(spark, path).filter("page_id is null").collect())
    assert back == [("response", None, 180), ("revisit", 1, len(long.encode()))]
    few = warc.round_trip(spark.createDataFrame(pages[:3], "page_id long, url string, html string")).collect()  # too few for a dictionary
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in few) == [(0, "revisit"), (1, "response"), (3, "revisit")]


def test_warc_roles_hold_when_a_skewed_join_is_split(spark, monkeypatch):
    monkeypatch.setattr(warc, "PART_ROWS", 64)
    long = "<p>" + "página " * 40
    pages = [(1, "http://a", long)] * 390 + [(1, "http://b", long)] * 3 + [(1, None, long)] * 2 + [(2, "u", long)] * 5 + [(3, "v", "tiny")] * 200
    pages += [(10 + i, f"http://p/{i}", f"<html>{i} " + "texto " * 50) for i in range(300)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(16)
    split = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in split}
    path = warc.fresh_path(spark, "skewed")
    try:
        for k, v in split.items():
            spark.conf.set(k, v)
        warc.write_archives(table, path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    content = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect() if r["length"] > 20]
    headers = [h for c in content for h, _ in warc.parse_archive(c) if h["WARC-Type"] != "warcinfo"]
    assert len(headers) == len(pages) and len({h["WARC-Record-ID"] for h in headers}) == len(pages)
    first = [h for h in headers if h["X-Page-Id"] == "1" and h["WARC-Type"] == "response"]
    assert len(first) == 1 and first[0]["WARC-Target-URI"] == "http://a"
    revisits = [h for h in headers if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 399 and {h["WARC-Refers-To"] for h in revisits} == {first[0]["WARC-Record-ID"]}


def test_dictionary_is_of_records(spark):
    pages = [(i, f"http://host/{i}", f"<html>{i} " + f"texto {i} " * 50) for i in range(60)]
    plain = warc._plain(spark.createDataFrame(pages, "page_id long, url string, html string"))
    raw = warc.build_dictionary(plain, plain, "2024-01-01T00:00:00Z")
    assert b"WARC-Record-ID" in raw or b"WARC-Payload-Digest" in raw or b"Content-Type: text/html" in raw


def test_licenses(spark):
    texts = [
        "This is under the MIT License. GNU General-Public license! x gnu general public LICENSE", None, "", "cc by cc by-nc", "apache\nlicense apache licenses",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this extra software and associated documentation files (the software), to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software",
        "The license of MIT and general public things", "Licensed under CC BY-NC 4.0.", "word " * 5000 + "mit license",
    ]
    data = [(i, t, "z", "z") for i, t in enumerate(texts)] + [(0, texts[0], "z", "z")]
    table = spark.createDataFrame(data, "doc_id long, text string, template string, votes string")
    found = licenses.scan_licenses(table).collect()
    assert len(found) == len(data)
    by_id = {r["doc_id"]: r for r in found}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        places = [(s, label) for phrase, label in licenses.PHRASES for s in range(len(w)) if w[s : s + len(phrase.split())] == phrase.split()]
        r = by_id[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"]
        assert 0 <= r["score"] <= 1
    assert by_id[5]["labels"] == "mit-grant" and by_id[6]["labels"] == "" and "cc-by-nc" in by_id[7]["labels"]


def common_words(a, b):
    """Longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def label_share(label, words, templates):
    """What the templates of a label match at most: the best sentence, or all parts together."""
    own = [(common_words(t.text.split(), words) / len(t.text.split()), t.weight) for t in templates if t.label == label]
    return max([s for s, w in own if w is None] + [sum(s * w for s, w in own if w is not None)])


def test_whole_licenses_against_brute_force(spark):
    rng = random.Random(12)
    for _ in range(300):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        assert licenses.in_order(a, b) == common_words(a, b)
    names = {"mit", "isc", "bsd-2-clause", "bsd-3-clause", "apache-2.0", "mpl-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0"}
    assert names <= {label for label, _ in licenses.whole_texts()}
    for label, text in licenses.whole_texts():
        parts = [t for t in licenses.templates_of((), [(label, text)])]
        assert sum(t.weight for t in parts) == pytest.approx(1) and all(licenses.PART <= len(t.text.split()) < 2 * licenses.PART for t in parts)
    short = [(label, text) for label, text in licenses.whole_texts() if label in ("mit", "isc", "bsd-2-clause", "bsd-3-clause")]
    texts, wanted = [], []
    for label, text in licenses.whole_texts():  # as they are, amid other words, and in long texts
        texts += [text, " ".join(words_of(rng, 300)) + "\n" + text.replace("\n", "\n# ") + " ".join(words_of(rng, 3000))]
        wanted += [label, label]
    for label, text in short:
        parts = licenses.templates_of((), [(label, text)])
        for share in (0.1, 0.2, 0.24):  # replaced words, scattered over each part
            w = []
            for part in parts:
                own = part.text.split()
                for j in rng.sample(range(len(own)), int(len(own) * share)):
                    own[j] = f"zz{j}"
                w += own
            texts.append(" ".join(words_of(rng, 20) + w))
            wanted.append(label)
        half = " ".join(" ".join(p.text for p in parts).split()[: int(0.7 * len(" ".join(p.text for p in parts).split()))])
        texts.append(half)
        wanted.append(None)
        texts.append(" ".join(f"{p.text} {' '.join(words_of(rng, 200))}" for p in reversed(parts)))  # parts stand in any order
        wanted.append(label)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    templates = licenses.templates_of()
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        own = set(found[i]["labels"].split(",")) - set(found[i]["base_labels"].split(",")) - {""}
        assert wanted[i] is None or wanted[i] in own, (i, wanted[i])
        if len(words) < 1500:
            for label, _ in licenses.whole_texts():
                if label in own or label in dict(short):
                    share = label_share(label, words, templates)
                    assert share >= licenses.COVER if label in own else share < 1, (i, label, share)
    few = licenses.scan_licenses(docs.filter("doc_id < 4"), sentences=(), wholes=[("x", "a b c"), ("none", ""), ("own", texts[0])]).collect()
    assert {r["doc_id"] for r in few if "own" in r["labels"].split(",")} == {0, 1} and not any("none" in r["labels"] for r in few)


def test_licenses_against_brute_force(spark):
    rng = random.Random(11)
    texts, planted = [], []
    for n, (label, template) in enumerate(licenses.TEMPLATES * 3):
        w = template.split()
        for j in rng.sample(range(len(w)), int(len(w) * (0, 0.12, 0.25)[n // len(licenses.TEMPLATES)])):
            w[j] = f"zz{j}"
        texts.append(" ".join(words_of(rng, rng.randrange(0, 40)) + w + words_of(rng, rng.randrange(0, 40))))
        planted.append(label)
    for _ in range(30):  # words of templates in no order, and many notices in one text
        texts.append(" ".join(rng.choice(rng.choice(licenses.TEMPLATES)[1].split()) for _ in range(80)))
    texts.append(" ".join(f"{t} x y" for _, t in licenses.TEMPLATES[:3] * 40))
    texts.append("the software is " * 300)
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (0, texts[0])], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        own = set(found[i]["labels"].split(",")) - set(found[i]["base_labels"].split(",")) - {""}
        for label in own:
            share = label_share(label, words, licenses.templates_of())
            assert share >= licenses.COVER, (i, label, share)
        if i < len(planted):
            assert planted[i] in own and found[i]["score"] >= licenses.COVER, (i, planted[i])
    assert found[None]["labels"] == found[0]["labels"]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "z", "z") for r in rows], "vec_id long, embedding array<float>, label int, id string, x string")


def test_embedding_dedup(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 16))
    rows = [(i, (base[i % 6] + rng.normal(size=16) * rng.choice([0.05, 0.1, 0.2])).astype(np.float32).tolist(), i % 2) for i in range(90)]
    rows += [(90 + i, rows[3][1], 1) for i in range(12)] + [(200, rows[3][1], None), (201, None, 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, [1.0, None], 1), (205, [1.0, 2.0], 1), (206, [2.0, 4.0], 1)]
    ok = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.sqrt(a[1] @ a[1]) / np.sqrt(b[1] @ b[1]) >= 0.93]
    want = reach([r[0] for r in rows], links)
    for block in (2048, 7):
        found = embedding_dedup.near_duplicates(vectors(spark, rows), block=block).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == {
            i: (sum(i in p for p in links), want[i], want[i] == i) for i in want
        }
    assert embedding_dedup.near_duplicates(vectors(spark, rows).limit(0)).count() == 0


def test_embedding_links_of_repeated_ids_and_extreme_lengths(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(3, a, 1), (3, b, 1), (7, b, 1), (10, [1.0, 0.05, 0.0], 1), (None, a, 1)]
    found = {(r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert found == {(3, 2, 3), (7, 1, 3), (10, 1, 3), (None, 0, None)}
    wide = spark.createDataFrame(
        [(1, [1e200, 1e200], 0), (2, [1e-200, 1.1e-200], 0), (3, [5e-324, 0.0], 0), (4, [1e308, 0.0], 0), (5, [-0.0, 3.0], 0), (6, [0.0, 3.0], 0)],
        "vec_id long, embedding array<double>, label int",
    )
    assert {r["vec_id"]: r["component_id"] for r in embedding_dedup.near_duplicates(wide).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}


def test_quantisation_bound():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 1500))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scale, near, off = embedding_dedup.quantise(x)
    assert np.abs(codes).max() <= 127
    estimate = embedding_dedup.int8_products(codes, codes) * scale[:, None] * scale[None, :]
    assert (np.abs(estimate - x @ x.T) <= near[:, None] * off + off[:, None] * (near + off) + embedding_dedup.SLACK).all()


def test_permutation_index(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[700:760] = x[700]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2020, [0.0] * 24, 0), (2040, [float("inf")] * 24, 0), (2060, [1.0], 0)]
    table = vectors(spark, rows)
    found = permutation_index.search(table, table.filter("vec_id % 20 = 0"), top=20, block=600).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append(r)
    assert set(by_query) == set(range(0, 1500, 20))
    wide, hits = x.astype(float), 0
    for q, got in by_query.items():
        scores = (wide * wide[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(1500), -scores)) if i != q][:20]
        assert [r["rank"] for r in got] == list(range(1, 21)) and all(r["score"] == scores[r["vec_id"]] for r in got)
        assert [(-r["score"], r["vec_id"]) for r in got] == sorted((-r["score"], r["vec_id"]) for r in got)
        hits += len(set(order) & {r["vec_id"] for r in got})
    assert hits / 20 / len(by_query) >= 0.9
    few = vectors(spark, [(0, [1.0, 0.0], 0), (20, [0.5, 1.0], 0), (21, [0.5, 1.0], 0)])
    assert [tuple(r)[:3] for r in permutation_index.search(few, few.filter("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 20), (0, 2, 21)]
    assert permutation_index.search(table.limit(0), table.limit(0)).count() == 0


def test_permutation_index_of_vectors_of_mixed_lengths(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 24)) * np.exp(rng.normal(size=(9000, 1)))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 24)], "vec_id long, embedding array<double>")
    found = permutation_index.search(table, table.filter("vec_id % 200 = 0 or vec_id is null"), top=20).collect()
    got, hits = {}, 0
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == set(range(0, 9000, 200))
    for q, ids in got.items():
        order = np.argsort(-(x @ x[q]), kind="stable")
        hits += len(ids & set([i for i in order if i != q][:20]))
    assert hits / 20 / len(got) >= 0.9


def test_packing_takes_added_tokens_in_texts_as_single_ids(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    end = "<|endoftext|>"
    texts = [f"x {end} y", end, end + end, f"a{end}b c", f"  {end}  \n{end} ", f"it's {end}'s 12 <|endoftext|", f"{end[:-1]}{end}>", "plain  text ", ""]
    texts += [f"some words {end} and others " * 30]
    wanted = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert wanted[0] == [87, 220, 50256, 331]
    encoder = packing.Encoder(tokenizer_path())
    assert [np.frombuffer(raw, "<u4").tolist() for raw in encoder.encode(texts)] == wanted
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"]) for r in packing.pack(docs, tokenizer_path(), limit=64).collect()}
    for i, ids in enumerate(wanted):
        ids = [*ids, 2]
        edges = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        for a, b in zip(edges, edges[1:]):
            assert found.pop((i, a)) == (b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert not found


def labelled(spark, n=900):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        bad, rude = rng.random() < 0.2, rng.random() < 0.3
        w = words_of(rng, rng.randrange(20, 120))
        if rude:
            w[rng.randrange(len(w))] = rng.choice(["blorg", "snarfel", "snarfing"])
        if rng.random() < 0.3:
            w.append("women" if rude and rng.random() < 0.9 else "men")
        if bad:
            w = [x + "$$%" for x in w]
        docs.append((i, " ".join(w), "z"))
        if rng.random() < 0.7:
            labels.append((i, int(not bad), int(rude)))
    docs += [(n, None, "z"), (n + 1, "", "z"), (None, "a b", "z"), (0, docs[0][1], "z")]
    truth = {i: (q, t) for i, q, t in labels}
    return spark.createDataFrame(docs, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def accuracy(found, truth, at):
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    return sum(r["predicted"] == truth[r["doc_id"]][at] for r in held) / len(held)


def test_toxicity(spark):
    docs, labels, truth = labelled(spark)
    found = toxicity.classify(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert accuracy(found, truth, 1) > 0.95

    def gap(fairness):
        model = toxicity.learn(docs, labels, fairness=fairness)
        raw = [b"some women here", b"some men here"]
        data = np.frombuffer(b"".join(raw), np.uint8)
        a, b = model.scores(data, np.array([0, len(raw[0]), len(data)]))
        return abs(np.log(a / (1 - a)) - np.log(b / (1 - b)))

    assert gap(1.0) < 0.3 * gap(0.0) + 1e-6
    assert toxicity.classify(docs, labels.limit(0)).filter("score <> 0.5").count() == 0
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_quality(spark):
    docs, labels, truth = labelled(spark)
    found = pu_quality.classify(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert accuracy(found, truth, 0) > 0.95
    assert abs(pu_quality.learn(docs, labels).prior - 0.8) < 0.12
    assert pu_quality.classify(docs, labels.limit(0)).count() == len(found)
    assert pu_quality.classify(docs.limit(0), labels).count() == 0


def brute_near_duplicates(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, 5))
    ids = sorted(sets)
    links = [
        (a, b) for a in ids for b in ids
        if a < b and any(x and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])
    ]
    least = reach(ids, links)
    return [r for r in dict.fromkeys(rows) if least[r[0]] == r[0]]


def brute_passages(rows, width=20):
    seen, out = set(), []
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = set()
        for s in range(len(w) - width + 1):
            window = tuple(w[s : s + width])
            if window in seen:
                gone |= set(range(s, s + width))
            seen.add(window)
        if not w or len(gone) < len(w):
            out.append((i, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t))
    return out


def brute_mix(rows, source_of):
    lines = {}
    for i, t in rows:
        lines.setdefault(source_of[i], []).append((hashlib.md5(f"17/{i}".encode()).hexdigest(), i, t))
    names = sorted(s for s in lines if s is not None) + [None] * (None in lines)
    sizes = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, _, t in lines[s]) for s in names}
    total, goal, open_ = sum(sizes.values()), {}, {s: 1 + n % 3 for n, s in enumerate(names)}
    while open_:
        level = (total - sum(goal.values())) / sum(open_.values())
        full = [s for s in open_ if open_[s] * level > 3 * sizes[s]]
        for s in full or list(open_):
            goal[s] = 3.0 * sizes[s] if full else open_[s] * level
            del open_[s]
    out = []
    for s in names:
        left = int(goal[s] + 0.5)
        while left > 0:  # one lap of the source's line
            for _, i, t in sorted(lines[s]):
                w = re.findall(r"[^\x20\x09-\x0D]+", t)
                if w and left > 0:
                    out.append((i, t if len(w) <= left else " ".join(w[:left])))
                    left -= len(w)
    return out


def test_pipeline_against_brute_force(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    plain = docs.filter("doc_id is not null and text is not null").select(*corpus_pipeline.COLUMNS)
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows if i is not None and i % 2], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good = {r["doc_id"] for r in pu_quality.classify(plain, labels).filter("predicted = 1").collect()}
    source_of = {r["doc_id"]: r["source"] for r in plain.collect()}
    kept = brute_passages(brute_near_duplicates([(i, t) for i, t in rows if i in good and t is not None]))
    tokenizer, want = Tokenizer.from_file(tokenizer_path()), []
    for i, t in brute_mix(kept, source_of):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in found) == sorted(want)
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        ends = [a + n for a, n in sorted(held)]
        assert [a for a, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_pipeline_stages_on_odd_and_empty_tables(spark, docs, tmp_path):
    import corpus_pipeline

    wide = docs.select("*", F.lit("z").alias("lap"), F.lit("z").alias("slot"))
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        whole, none = stage(spark, wide, str(tmp_path)), stage(spark, wide.limit(0), str(tmp_path))
        if name != "packing":
            assert tuple(whole.columns) == corpus_pipeline.COLUMNS, name
        assert whole.count() > 0 and none.count() == 0, name
    twice = wide.filter("doc_id in (3, 5)").unionAll(wide.filter("doc_id = 3"))
    assert corpus_pipeline.drop_near_duplicates(spark, twice, "").groupBy("doc_id", "text").count().filter("count > 1").count() == 0


def slopes(value, w, at):
    step = np.zeros(len(w))
    step[at] = 1e-6
    return (value(w + step) - value(w - step)) / 2e-6


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(7)
    bp, bu = rng.integers(0, 18, (40, 3)), rng.integers(12, 30, (60, 3))
    signs = set()
    for lean, prior in ((0.0, 0.3), (2.0, 0.9), (-2.0, 0.2)):
        w = rng.normal(size=31) * 0.5 + lean * np.append(np.where(np.arange(30) < 15, 1, -1), 0)
        zp, zu = w[bp].sum(axis=1) + w[-1], w[bu].sum(axis=1) + w[-1]
        negative = sum(np.log1p(np.exp(z)) for z in zu) / 60 - prior * sum(np.log1p(np.exp(z)) for z in zp) / 40
        signs.add(negative > 0)
        value, grad = pu_quality.non_negative_risk(w, bp, bu, prior)
        assert abs(value - prior * sum(np.log1p(np.exp(-z)) for z in zp) / 40 - max(0, negative)) < 1e-9

        def followed(x):
            zp, zu = x[bp].sum(axis=1) + x[-1], x[bu].sum(axis=1) + x[-1]
            part = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
            return pu_quality.non_negative_risk(x, bp, bu, prior)[0] if negative > 0 else -part

        assert all(abs(slopes(followed, w, i) - grad[i]) < 1e-5 for i in range(31))
    assert signs == {True, False}
    rows = [np.unique(rng.integers(0, 20, rng.integers(0, 9))) for _ in range(50)]
    twins = [(np.array([1, 2]), np.array([3])), (np.zeros(0, int), np.array([5])), (np.array([4, 4]), np.zeros(0, int))]
    labels, w = rng.integers(0, 2, 50).astype(float), rng.normal(size=21)
    value, grad = toxicity.objective(w, rows, labels, twins, 0.7, 0.01)
    z = [w[r].sum() + w[-1] for r in rows]
    loss = sum(np.log1p(np.exp(-a if y else a)) for a, y in zip(z, labels)) / 50 + 0.005 * (w[:-1] ** 2).sum()
    assert abs(value - loss - 0.7 * sum((w[p].sum() - w[m].sum()) ** 2 for p, m in twins) / 3) < 1e-9
    assert all(abs(slopes(lambda x: toxicity.objective(x, rows, labels, twins, 0.7, 0.01)[0], w, i) - grad[i]) < 1e-5 for i in range(21))


def test_prior_by_the_best_bin():
    rng = np.random.default_rng(8)
    positive, others = rng.normal(2, 1, 4000), rng.normal(-2, 1, 14_000)
    mixed = np.concatenate([rng.normal(2, 1, 6000), others])
    cuts = pu_quality.prior_cuts(positive)
    counts = np.array([sum((mixed >= a) & (mixed < b)) for a, b in zip([-np.inf, *cuts], [*cuts, np.inf])])
    best = min(np.mean(mixed >= c) / np.mean(positive >= c) for c in cuts)
    assert best <= pu_quality.estimate_prior(positive, cuts, counts) + 1e-9
    assert abs(pu_quality.estimate_prior(positive, cuts, counts) - 0.3) < 0.03


def test_quality_stage_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    docs, labels, truth = labelled(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    whole = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    kept = {r["doc_id"] for r in corpus_pipeline.filter_quality(spark, whole, str(tmp_path)).collect()}
    good = [i for i, (q, _) in truth.items() if q]
    assert sum(i in kept for i in good) / len(good) > 0.97
    bad = [i for i, (q, _) in truth.items() if not q]
    assert sum(i in kept for i in bad) / len(bad) < 0.2


def test_training_samples_are_bounded_by_rows(spark):
    """Rows that repeat an id, however many, are learned from once; ids labelled both ways not at all."""
    docs = [(1, f"good text {i % 3}") for i in range(3000)] + [(2, "junk")] * 3000 + [(i, f"text number {i}") for i in range(3, 400)]
    plain = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1)] * 3000 + [(2, 0)] * 3000 + [(3, 1), (3, 0), (6, None), (7, 1)], "doc_id long, toxic int")
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    for value, want in ((1, [i for i in (1, 7) if i in free]), (0, [i for i in (2,) if i in free])):
        ids = pu_quality.training_rows(labels, "toxic", 10, value)
        assert sorted(r["doc_id"] for r in ids.collect()) == want
        found = pu_quality.training_texts(plain, ids.withColumn("label", F.lit(value)), "label").collect()
        assert len(found) == len(want)
    everyone = plain.select("doc_id").distinct().withColumn("positive", F.lit(0))
    assert pu_quality.training_texts(plain, everyone, "positive").count() == 399


def test_toxicity_features_and_twins_equal_those_of_single_texts():
    texts = ["The Muslim man and the muslim woman met", "christian muslim jewish", "no terms here", "", None, "Frauen, Frauen! und frau", "men mental menace women"] * 3
    swaps = {a: b for row in toxicity.IDENTITY_TERMS for a, b in zip(row, (*row[1:], row[0]), strict=True)}

    def features(words):
        return {int(c) for w in words for c in toxicity._term_features(w)}

    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(texts)), pa.array(texts)], names=["label", "text"])
    (found,) = toxicity._featurer()(iter([batch]))
    for text, x, plus, minus in zip(texts, *(found.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
        words = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        own, twin = features(words), features([swaps.get(w, w) for w in words])
        assert set(x) == own and len(x) == len(own)
        assert (set(plus), set(minus)) == (own - twin, twin - own)
    model = toxicity.Model(*(lambda f: (f, np.linspace(-1, 1, len(f)), 0.2))(np.array(sorted(features(["muslim", "woman", "man", "frau"])))))
    data, offs = column_bytes(pa.array(texts))
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    for text, score in zip(texts, model.scores(data, offs), strict=True):
        words = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        assert abs(score - 1 / (1 + np.exp(-0.2 - sum(weight.get(c, 0.0) for c in features(words))))) < 1e-12
