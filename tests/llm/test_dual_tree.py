"""Dual-tree search against scores of every document reckoned one by one."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyloom.llm import dual_tree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
KIND = "doc_id long, text string, item string, score string, rank string, n string, ids string, first string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    corpus, words = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for doc, c in counted:
            m = 100 - 50 + (50 * c.total() * corpus) // words
            s = sum(math.floor(1000 * math.log((2 * corpus + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, doc is None, doc if doc is not None else 0, doc))
        for rank, (s, _, _, doc) in enumerate(sorted(found)[:k], 1):
            out[item, rank, doc, -s] += 1
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    kinds = [[f"{k}{i}" for i in range(80)] for k in ("a", "B", "ç", "0")]

    def text(n):
        own = rng.choice(kinds)
        return " ".join(own[min(int(rng.expovariate(0.06)), 79)] if rng.random() < 0.9 else rng.choice(rng.choice(kinds)) for _ in range(n))

    docs = [(i, text(rng.choice([1, 3, 30, 90]))) for i in range(900)]
    docs += [(i, docs[3][1] + " " + docs[7][1]) for i in range(2000, 2400)]  # a large group of copies
    docs += [(None, docs[5][1]), (None, None), (901, ""), (902, " .,;\x00"[:-1]), (903, "A0-a0_Ç1 " * 50_000), (12, docs[30][1]), docs[12], docs[12], (904, "only here")]
    rng.shuffle(docs)
    items = [(i, text(25)) for i in range(40)] + [(50, "nowhere found"), (51, None), (52, "!"), (53, "only"), (3, "a1 a2"), (3, "a1 a2"), (54, "a0 " * 3 + "ç1")]
    return docs, items


@pytest.mark.parametrize(("block", "leaf", "group", "piece"), [(8192, 64, 512, 4 << 20), (150, 4, 7, 1000)])
def test_search_equals_every_score_reckoned(spark, tables, monkeypatch, block, leaf, group, piece):
    docs, items = tables
    for name, value in (("BLOCK", block), ("DOC_LEAF", leaf), ("ITEMS", group), ("PIECE", piece), ("RUN", 16)):
        monkeypatch.setattr(dual_tree, name, value)
    extra = "x" * (len(KIND.split(",")) - 2)
    d = spark.createDataFrame([(*r, *extra) for r in docs], KIND).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    for k in (5, 50):
        found = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in dual_tree.search(d, i, k=k).collect())
        assert found == plain(docs, items, k)


def test_empty_tables(spark, tables):
    d, i = spark.createDataFrame(tables[0][:5], "doc_id long, text string"), spark.createDataFrame(tables[1][:5], "item_id long, text string")
    assert dual_tree.search(d.limit(0), i).count() == 0
    assert dual_tree.search(d, i.limit(0)).count() == 0
    assert dual_tree.search(spark.createDataFrame([(1, None)], "doc_id long, text string"), i).count() == 0


@pytest.mark.parametrize("weight", [1, 1 << 24])  # the second is beyond exact products in doubles
def test_bounds_prune_and_lose_nothing(weight):
    rng = np.random.default_rng(2)
    n, width = 3000, 120
    topics = rng.integers(0, 12, n)
    own = [np.unique(np.concatenate([t * 10 + rng.integers(0, 10, 6), rng.integers(0, width, i % 2)])) for i, t in enumerate(topics)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    ids, values = np.concatenate(own), rng.integers(1, 900_000, at[-1])
    wanted = [sorted({t * 10 + int(x) for x in rng.integers(0, 10, 5)}) for t in range(12) for _ in range(8)]
    weights = rng.integers(1, 9000, width) * weight // 4
    items = dual_tree.Items(wanted, weights)
    best = dual_tree.Best(10, np.zeros(len(wanted), np.int64), np.full(len(wanted), dual_tree._BEFORE_ALL))
    docs = rng.permutation(n)
    scored, every = dual_tree.search_block(items, best, docs, at, ids, values)
    assert scored < every / 2
    found = defaultdict(list)
    for item, score, doc in zip(*best.settle(), strict=True):
        found[items.tree.order[item]].append((int(score), int(doc)))
    dense = np.zeros((n, width), np.int64)
    dense[np.repeat(np.arange(n), np.diff(at)), ids] = values
    for i, own_terms in enumerate(wanted):
        scores = dense[:, own_terms] @ weights[own_terms]
        want = sorted((-int(s), int(d)) for s, d in zip(scores, docs, strict=True) if s > 0)[:10]
        assert found[i] == [(-s, d) for s, d in want]
