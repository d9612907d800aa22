"""Repairs by block tables against a search over all edits that compares whole audits."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyloom.llm import conversations

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
KIND = "conv_id long, turn long, role string, text string, own string, pos string, audit string, symbols string, n string"


def search(rows):
    """Least ``(cost, audit)`` and its turns by Dijkstra over (rows taken, last initial), whole audits compared."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, at, last, turns = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, turns
        if (at, last) in done:
            continue
        done.add((at, last))
        for r in "ua":
            if r in NEXT[last]:
                heapq.heappush(heap, (cost + 3, audit + "I", at, r, (*turns, ({"u": "user", "a": "assistant"}[r], ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, turns))
            if fault in (None, "truncated"):
                more = 3 * (fault == "truncated")
                if role[:1] in NEXT[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*turns, (role, text))))
                for r in "ua":
                    if r in NEXT[last]:
                        heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, r, (*turns, ({"u": "user", "a": "assistant"}[r], text))))
    raise AssertionError


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        spaced = [" " if x is None else str(x) for x in (conv, turn)]
        n = zlib.crc32(":".join(spaced).encode()) % 20
        own[conv]  # noqa: B018
        if n:
            text = "" if n == 1 else "".join(c for c in text if c not in ".!?") if n == 2 else text
            own[conv] += [(turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    out = {}
    for conv, mine in own.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in mine:
            end = text.rstrip(SPACE)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit, turns = search([(role, text, f) for (_, role, text), f in zip(mine, faults, strict=True)])
        numbers = [t for t, _, _ in mine if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [role[:1] for _, role, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha, turns)
    return out


def corpus():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "no end", "What? ", " ", "", None, "Ünd.\n", "again.", "x" * 50]
    rows = []
    for conv in range(400):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9])):
            role = rng.choice(["user", "assistant"] if conv % 2 else ["system", "user", "assistant", "tool", "", None, "User"])
            text = f"{rng.random()}." if rng.random() < 0.6 else rng.choice(texts)
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]), role, text))
    rows += [(1000, t, ["user", "assistant"][t % 2], f"{t}." if t % 7 else "same.") for t in range(700)]
    rows += [(None, t, "user", f"{t}!") for t in range(4)] + [(1001, None, "user", "n."), (1001, 3, "assistant", "long. " * 100_000)]
    unique = {(c, t): (c, t, r, x) for c, t, r, x in rows}
    return list(unique.values())


@pytest.mark.parametrize("chunk", [1 << 16, 64])
def test_audits_equal_a_search_over_all_edits(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows = corpus()
    random.Random(1).shuffle(rows)
    want = plain(rows)
    table = spark.createDataFrame([(*r, *"zzzzz") for r in rows], KIND).repartition(3)
    found = conversations.repair_damaged(table).collect()
    assert len(found) == len(want)
    for r in found:
        names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
        assert tuple(r[c] for c in names) == want[r["conv_id"]][:8], r["conv_id"]
    turns = defaultdict(list)
    for r in sorted(conversations.repaired_turns(conversations.damage(table)).collect(), key=lambda r: r["place"]):
        turns[r["conv_id"]].append((r["role"], r["text"]))
    assert all(tuple(turns[c]) == w[8] for c, w in want.items())


def test_repeated_turns_stand_side_by_side_and_an_empty_table_gives_nothing(spark):
    rows = [(1, 0, "user", "a."), (1, 0, "user", "a."), (1, 0, "user", "a."), (1, 1, "assistant", "b.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = conversations.audit_conversations(table).collect()
    assert (r["duplicate"], r["audit"], r["cost"], r["illegal"]) == (2, "KDDK", 8, 2)
    assert conversations.repair_damaged(table.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 3, 4])
def test_block_tables_equal_rows_one_by_one(block):
    tables, rng = conversations.Tables(block), np.random.default_rng(block)
    assert len(tables.vectors) < 100
    roles = ["system", "user", "assistant", "tool"]
    for _ in range(300):
        kinds = rng.integers(0, 9, rng.integers(0, 14))
        rows = [("user", "", "blank") if k == 0 else (roles[(k - 1) % 4], "x", "truncated" if k > 4 else None) for k in kinds.tolist()]
        assert tables.repair(kinds) == search(rows)[:2]
