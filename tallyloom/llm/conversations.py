"""Conversation structure repair by block tables of normalised cost vectors (Four Russians).

A repaired conversation is empty, or an optional system turn followed by pairs of a user's and an
assistant's turn. Which edits make it so at least cost is a walk over four states (nothing yet,
after system, after user, after assistant). Before every row stands a vector of what the rest will
cost from each state; less its smallest entry it is one of a few vectors, because insertions tie the
states to each other. So the change of the vector over any block of ``BLOCK`` row symbols is
tabulated once for every symbol block and vector, and a conversation is processed from its end, a
lookup a block. A trace then goes forward: each block is expanded backward from the vector at its
right edge into the vectors between its rows, which tell all optimal edits, and the walk keeps the
set of states that the least edits so far may have led to, so ties are broken over the whole string.

Rows are sorted once over all tasks by conversation and turn, not grouped, so a conversation may
span tasks. Texts are never gathered: repairs see one character a row, and the repaired turns come
from a sorted stream. Only what a result holds as one value, the edits of a conversation, is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import cut, spread_join

#: Rows of a block, and rows whose symbols are joined at once.
BLOCK, CHUNK = 4, 1 << 16
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_SPACE = " \t\n\x0b\x0c\r"
#: Row symbols: role (system, user, assistant, another) times 4 plus fault (none, blank, duplicate, truncated), from ``a``.
_FIRST_SYMBOL = ord("a")
_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3
#: States: nothing yet, after system, after user, after assistant; where a turn of each role leads to.
_TURNS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_END = (0, 2 * INSERT, INSERT, 0)
#: Kinds of rows that edits tell apart: 0 must go; 1 to 4 are the roles, 5 to 8 the same truncated.
_KINDS = 9


def _kind(symbol: int) -> int:
    role, fault = divmod(symbol, 4)
    return 0 if fault in (_BLANK, _DUPLICATE) else 1 + role + 4 * (fault == _TRUNCATED)


_KIND_OF = np.array([_kind(i) for i in range(16)], np.int64)


@lru_cache(maxsize=None)
def _edits(state: int, kind: int) -> tuple[tuple[str, int, int], ...]:
    """Edits that take a row of a kind: letter, cost, next state."""
    found = [("D", DELETE, state)]
    if kind:
        role, more = (kind - 1) % 4, TRUNCATED * (kind > 4)
        if role < 3 and "sua"[role] in _TURNS[state]:
            found.append(("K", more, _TURNS[state]["sua"[role]]))
        found += [("R", REROLE + more, _TURNS[state][r]) for r in "ua" if r in _TURNS[state]]
    return tuple(found)


def _inserts(state: int) -> int:
    """The state after the one turn that may be inserted."""
    return _TURNS[state]["a" if "a" in _TURNS[state] else "u"]


def _before(after: tuple[int, ...], kind: int) -> tuple[int, ...]:
    """Costs from each state before a row of ``kind``, given those after it."""
    cost = [min(c + after[to] for _, c, to in _edits(state, kind)) for state in range(4)]
    for _ in range(3):
        cost = [min(cost[s], INSERT + cost[_inserts(s)]) for s in range(4)]
    return tuple(cost)


class Tables:
    """Normalised cost vectors, and where each leads over one row and over a block of rows."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block = block
        self.vectors = [_END]
        number = {_END: 0}
        to, add = [], []
        for vector in self.vectors:  # grows while new vectors are found
            for kind in range(_KINDS):
                cost = _before(vector, kind)
                plain = tuple(c - min(cost) for c in cost)
                if plain not in number:
                    number[plain] = len(self.vectors)
                    self.vectors.append(plain)
                to.append(number[plain])
                add.append(min(cost))
        self.to, self.add = np.array(to).reshape(-1, _KINDS), np.array(add).reshape(-1, _KINDS)
        # A block's first row is the most significant digit and is passed last.
        self.block_to, self.block_add = self.to, self.add
        for _ in range(block - 1):
            mid = self.block_to  # (vector, rest) -> vector
            self.block_to = self.to[mid].transpose(0, 2, 1).reshape(len(self.vectors), -1)
            self.block_add = (self.block_add[:, None, :] + self.add[mid].transpose(0, 2, 1)).reshape(len(self.vectors), -1)
        self.digits = _KINDS ** np.arange(block - 1, -1, -1)
        self._walk = lru_cache(maxsize=1 << 16)(self._walk_block)

    def _row(self, states: frozenset[int], kind: int, right: int) -> tuple[str, frozenset[int]]:
        """Least optimal edits up to and with a row, and the states they may lead to."""
        after, left = self.vectors[right], self.vectors[self.to[right, kind]]
        add, letters = int(self.add[right, kind]), ""
        while True:
            ways: dict[str, set[int]] = {}
            for state in states:
                for letter, cost, to in _edits(state, kind):
                    if cost + after[to] == left[state] + add:
                        ways.setdefault(letter, set()).add(to)
                if INSERT + left[_inserts(state)] == left[state]:
                    ways.setdefault("I", set()).add(_inserts(state))
            letter = min(ways)
            letters, states = letters + letter, frozenset(ways[letter])
            if letter != "I":
                return letters, states

    def _walk_block(self, states: frozenset[int], kinds: tuple[int, ...], right: int) -> tuple[str, frozenset[int]]:
        edges = [right]
        for kind in reversed(kinds[1:]):
            edges.append(int(self.to[edges[-1], kind]))
        letters = ""
        for kind, edge in zip(kinds, reversed(edges), strict=True):
            more, states = self._row(states, kind, edge)
            letters += more
        return letters, states

    def repair(self, kinds: np.ndarray) -> tuple[int, str]:
        """Least cost and, of all edits of that cost, the least string of their letters."""
        odd = len(kinds) % self.block
        codes = kinds[odd:].reshape(-1, self.block) @ self.digits
        vector, cost, edges = 0, 0, []
        for code in codes[::-1].tolist():
            edges.append(vector)
            cost += int(self.block_add[vector, code])
            vector = int(self.block_to[vector, code])
        pieces = [(kinds[odd:][i * self.block : (i + 1) * self.block], edge) for i, edge in enumerate(reversed(edges))]
        for i in range(odd - 1, -1, -1):
            pieces.insert(0, (kinds[i : i + 1], vector))
            cost += int(self.add[vector, kinds[i]])
            vector = int(self.to[vector, kinds[i]])
        cost += self.vectors[vector][0]
        states, letters = frozenset([0]), []
        for piece, edge in pieces:
            more, states = self._walk(states, tuple(piece.tolist()), edge)
            letters.append(more)
        rest = min(_END[s] for s in states)
        return cost, "".join(letters) + "I" * (rest // INSERT)


@lru_cache(maxsize=None)
def tables(block: int = BLOCK) -> Tables:
    """The tables, made once a process."""
    return Tables(block)


def role_at(place: int, turns: int) -> str:
    """Role of a turn that an edit makes: a repaired conversation of an odd number of turns opens with system."""
    return "user" if (place - turns % 2) % 2 == 0 else "assistant"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` as damaged by the checksum of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its role user.
    A null reads as one space wherever a text is made of it; ``conv_id`` and ``turn`` themselves stay null.
    """
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(spaced("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).filter("fault <> 0")
    copies = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy")).drop("copy")


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows with ``pos``, which orders them within their conversation, and what tells faults; written once."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    own = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role").cast("string"), "role", "text"))
    end = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(end == "", _BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(_TRUNCATED)
    initial = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).otherwise(3)
    rows = rows.withColumns({"own": own, "symbol": initial * 4 + fault, "given": F.monotonically_increasing_id()})
    ordered = rows.orderBy("conv_id", F.asc_nulls_first("turn"), "own", "given").drop("given")
    return cut(ordered.withColumn("pos", F.monotonically_increasing_id()), "turns")


def _joined(rows: DataFrame, order: Column, part: Column, *by: Column) -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("at"), part.alias("c")))), lambda x: x["c"])
    return rows.groupBy(*by).agg(F.array_join(texts, "").alias("symbols"))


def _symbols(ordered: DataFrame, ids: DataFrame) -> DataFrame:
    """``conv_id, symbols, gaps``: a character for each row of each conversation in ``ids``, in order."""
    seen = ordered.groupBy("own").agg(F.min("pos").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    light = ordered.select("conv_id", "pos", "own", "symbol")
    marked = spread_join(light, cut(seen, "seen"), ["own"], F.col("pos"), how="left")
    again = (F.col("pos") > F.col("least")) & (F.col("symbol") % 4 != _BLANK)
    symbol = F.when(again, F.col("symbol") - F.col("symbol") % 4 + _DUPLICATE).otherwise(F.col("symbol"))
    letters = marked.select("conv_id", "pos", F.chr(symbol + _FIRST_SYMBOL).alias("letter"))
    chunk = F.floor(F.col("pos") / CHUNK).alias("chunk")
    chunks = _joined(letters, F.col("pos"), F.col("letter"), F.col("conv_id"), chunk)
    turns = ordered.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    turns = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    everything = chunks.unionByName(turns, allowMissingColumns=True).unionByName(ids.select("conv_id").distinct(), allowMissingColumns=True)
    piece = F.when(F.col("symbols").isNotNull(), F.struct(F.col("chunk").alias("at"), F.col("symbols").alias("c")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["c"]), "")
    return everything.groupBy("conv_id").agg(joined.alias("symbols"), F.coalesce(F.max("gaps"), F.lit(0)).cast("long").alias("gaps"))


_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_ILLEGAL = np.array([[(a, b) not in _LEGAL for b in "sua-"] for a in "sua-"])
_AUDIT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _repairer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list[int]] = {c: [] for c in _AUDIT[1:]}
        audits = []
        for symbols in batch.column(1).to_pylist():
            own = np.frombuffer(symbols.encode(), np.uint8).astype(np.int64) - _FIRST_SYMBOL
            fault, roles = own % 4, own // 4
            cost, audit = tables().repair(_KIND_OF[own])
            audits.append(audit)
            for c, n in (("blank", fault == _BLANK), ("duplicate", fault == _DUPLICATE), ("truncated", fault == _TRUNCATED)):
                counts[c].append(int(n.sum()))
            counts["illegal"].append(int(_ILLEGAL[roles[:-1], roles[1:]].sum()))
            counts["cost"].append(cost)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), *[pa.array(counts[c], pa.int64()) for c in _AUDIT[1:]], pa.array(audits, pa.string())],
            names=["conv_id", *_AUDIT, "audit"],
        )


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, str, str, str]]:
    """Batch and row of each conversation's head, then place, edit, role and text of each repaired turn.

    Columns are ``conv_id, pos, audit, role, text, ...``; a conversation's head, which has its
    edits, comes before its rows. Heads are given with place -1.
    """
    head: tuple[pa.RecordBatch, int] | None = None
    audit, at, place, turns = "", 0, 0, 0

    def inserted() -> Iterator[tuple[pa.RecordBatch, int, int, str, str, str]]:
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            yield *head, place, "I", role_at(place, turns), ""
            at, place = at + 1, place + 1

    for batch in batches:
        for i, (edits, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
            if edits is not None:
                if head:
                    yield from inserted()
                head, audit, at, place = (batch.slice(i, 1), 0), edits, 0, 0
                turns = len(edits) - edits.count("D")
                yield *head, -1, "", "", ""
                continue
            yield from inserted()
            letter, at = audit[at], at + 1
            if letter != "D":
                yield *head, place, letter, role if letter == "K" else role_at(place, turns), text
                place += 1
    if head:
        yield from inserted()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "place", "role", "text", "edit"]
    held: list[list] = [[], [], [], []]
    ids: list[pa.Array] = []
    size = 0
    for head, i, place, letter, role, text in _rewritten(batches):
        if place < 0:
            continue
        ids.append(head.column(0).slice(i, 1))
        for column, value in zip(held, (place, role, text, letter), strict=True):
            column.append(value)
        size += len(text) + 64
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(held[0], pa.int64()), *[pa.array(x, pa.string()) for x in held[1:]]], names=names)
            held, ids, size = [[], [], [], []], [], 0
    if ids:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(held[0], pa.int64()), *[pa.array(x, pa.string()) for x in held[1:]]], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    heads: list[pa.RecordBatch] = []
    hashes: list = []

    def done() -> pa.RecordBatch:
        table = pa.Table.from_batches(heads).combine_chunks()
        kept = [table.column(c).combine_chunks() for c in ("conv_id", *_AUDIT, "audit")]
        return pa.RecordBatch.from_arrays(
            [*kept, pa.array([h.hexdigest() for h in hashes], pa.string())], names=["conv_id", *_AUDIT, "audit", "repaired_sha256"]
        )

    for head, _, place, _, role, text in _rewritten(batches):
        if place < 0:
            if len(heads) >= 1000:
                yield done()
                heads, hashes = [], []
            heads.append(head)
            hashes.append(hashlib.sha256())
        else:
            hashes[-1].update(f"{chr(10) if place else ''}{role}:{text}".encode())
    if heads:
        yield done()


def _stream(rows: DataFrame, ids: DataFrame, work, kinds: str) -> DataFrame:
    ordered = _in_order(rows)
    id_type = ordered.schema["conv_id"].dataType.simpleString()
    columns = ", ".join(f"{c} long" for c in _AUDIT)
    audits = _symbols(ordered, ids).mapInArrow(_repairer, f"conv_id {id_type}, {columns}, audit string")
    heads = audits.select("conv_id", F.lit(-1).cast("long").alias("pos"), "audit", *[F.lit(None).cast("string").alias(c) for c in ("role", "text")], *_AUDIT)
    body = ordered.select("conv_id", "pos", F.lit(None).cast("string").alias("audit"), "role", "text", *[F.lit(None).cast("long").alias(c) for c in _AUDIT])
    stream = heads.unionAll(body).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return stream.mapInArrow(work, kinds.format(id=id_type, audit=columns))


def repaired_turns(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: ``conv_id, place, role, text, edit``, a row for each turn that is kept or made.

    ``edit`` is K (kept), R (given a role) or I (inserted); see :func:`audit_conversations` for the rules.
    """
    return _stream(rows, rows if ids is None else ids, _turns, "conv_id {id}, place long, role string, text string, edit string")


def audit_conversations(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Faults and least repair of each conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``rows`` needs ``conv_id, turn, role, text``, ``ids`` the conversations to answer (those of
    ``rows`` if not given); other columns are ignored, whatever their names. Rows stand by turn,
    null turns first, equal ones by a checksum of role and text, so repeated rows stand side by side.

    A row's first fault counts: blank (only ASCII white space), duplicate (role and text stand earlier in
    the conversation), truncated (does not end in ``.``, ``!`` or ``?``). Blank and duplicate rows must be
    deleted (4); other rows are kept, given role user or assistant (3) or deleted (4), turns of empty text
    inserted (3), and a truncated row that stays costs 3. ``audit`` has the edits' initials in order, of all
    cheapest ones the least as a string.

    A null role or text counts as one space, a null ``conv_id`` is a conversation of its own, null turns do not
    count for ``gaps``. Conversations without rows have zeros, no edits and the digest of nothing; an empty table gives no rows.
    """
    return _stream(rows, rows if ids is None else ids, _digests, "conv_id {id}, {audit}, audit string, repaired_sha256 string")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """:func:`audit_conversations` of :func:`damage`, for every original conversation."""
    return audit_conversations(damage(conversations), conversations)

