"""Keyword tables: any number of lists found in one pass over texts.

A table ``list, place, keyword, value`` says what to look for. Each task builds one automaton of all keywords and
passes over each text once, whatever the number of lists and keywords; what it finds of each list is the keyword of
least place, its value, and how many different keywords of the list the text contains. Receipt rules ask for these
instead of testing one keyword after another.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import vocabulary as V
from tallyloom.functions.text import contains_any, first_contained

#: Bytes of keywords that are sent to tasks at most. Of a larger table tasks get the short keywords and how the long ones begin,
#: and what they find of these is joined with the table.
MOST_BYTES = 64 << 20
#: Characters of a keyword that may be sent, the first that fit are taken.
_REACHES = (64, 32, 16, 8, 4, 2, 1)
SCHEMA = "list string, place int, keyword string, value string"
#: Names of the lists that receipt rules ask for, and their built-in keywords.
BUILT_IN: dict[str, tuple] = {
    "total_first": V.TOTAL_FIRST, "total": V.TOTAL_LABELS, "total_excluded": V.TOTAL_EXCLUDED, "other_label": V.OTHER_LABELS,
    "table_header": V.TABLE_HEADER, "not_product": V.NOT_PRODUCT, "method": V.PAYMENT_METHODS,
}
_EVERY = "array<struct<list:string,values:array<string>>>"
_ENTRY = "array<struct<list:string,place:int,keyword:string,value:string>>"
_FOUND = "array<struct<list:string,place:int,keyword:string,value:string,n:int>>"


def built_in(spark: SparkSession, lists: Iterable[str] = tuple(BUILT_IN)) -> DataFrame:
    """The built-in lists as a keyword table; a keyword without a value is its own."""
    rows = []
    for name in lists:
        for place, entry in enumerate(BUILT_IN[name]):
            keyword, value = entry if isinstance(entry, tuple) else (entry, entry)
            rows.append((name, place, keyword, value))
    return spark.createDataFrame(rows, SCHEMA)


def _finder(entries: list[tuple[str, int, str, str]], every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[str, int, str, str]]] = {}
        for entry in entries:
            known.setdefault(entry[2], []).append(entry)
        automaton = ahocorasick.Automaton()
        for keyword, own in known.items():
            automaton.add_word(keyword, own)
        automaton.make_automaton()
        names = pa.list_(pa.struct([("list", pa.string()), ("values", pa.list_(pa.string()))]))
        kind = pa.list_(pa.struct([("list", pa.string()), ("place", pa.int32()), ("keyword", pa.string()), ("value", pa.string()), ("n", pa.int32())]))
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                met = {id(own): own for _, own in automaton.iter(text)} if text and known else {}
                if every:
                    values: dict[str, set[str]] = {}
                    for own in met.values():
                        for name, _, _, value in own:
                            values.setdefault(name, set()).add(value)
                    out.append([{"list": name, "values": sorted(v)} for name, v in values.items()])
                    continue
                best: dict[str, tuple[int, str, str]] = {}
                n: dict[str, int] = {}
                for own in met.values():
                    for name, place, keyword, value in own:
                        n[name] = n.get(name, 0) + 1
                        if name not in best or (place, keyword) < best[name][:2]:
                            best[name] = (place, keyword, value)
                out.append([{"list": name, "place": p, "keyword": k, "value": v, "n": n[name]} for name, (p, k, v) in best.items()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, names if every else kind)], names=[*batch.schema.names[:-1], "found"])

    return run


def _bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("keyword") + F.octet_length("list") + F.octet_length("value"))).head()[0] or 0


def _seeker(entries: list[tuple[str, int, str, str]], stems: list[tuple[str, int]]):
    """Finds short keywords, and parts of a text that begin as long ones and have their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list, set]] = {}
        for entry in entries:
            known.setdefault(entry[2], ([], set()))[0].append(entry)
        for stem, size in stems:
            known.setdefault(stem, ([], set()))[1].add(size)
        automaton = ahocorasick.Automaton()
        for word, (own, sizes) in known.items():
            automaton.add_word(word, (len(word), own, sizes))
        automaton.make_automaton()
        kind = pa.list_(pa.struct([("list", pa.string()), ("place", pa.int32()), ("keyword", pa.string()), ("value", pa.string())]))
        names = ("list", "place", "keyword", "value")
        for batch in batches:
            near, far = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                met, parts = {}, set()
                for end, (size, own, sizes) in automaton.iter(text) if text and known else ():
                    if own:
                        met[id(own)] = own
                    start = end + 1 - size
                    parts.update(text[start : start + n] for n in sizes if start + n <= len(text))
                near.append([dict(zip(names, e, strict=True)) for own in met.values() for e in own])
                far.append(list(parts))
            columns = [*batch.columns, pa.array(near, kind), pa.array(far, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_near", "_far"])

    return run


def _mark_by_join(texts: DataFrame, rows: DataFrame, text: str, name: str, every: bool) -> DataFrame:
    """:func:`mark` by a table that is too large to be sent: a task's memory holds short keywords and stems, whole ones stay in the table."""
    for reach in _REACHES:
        short, long = rows.filter(F.length("keyword") <= reach), rows.filter(F.length("keyword") > reach)
        stems = long.select(F.left("keyword", F.lit(reach)).alias("stem"), F.length("keyword").alias("n")).distinct()
        if _bytes(short) + (stems.agg(F.sum(F.octet_length("stem") + 8)).head()[0] or 0) <= MOST_BYTES:
            break
    else:
        raise ValueError(f"keywords of one character and the characters that others begin with take more than {MOST_BYTES} bytes")
    entries = [tuple(r) for r in short.collect()]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    sought = texts.withColumn("_text", F.col(text).cast("string"))
    sought = sought.mapInArrow(_seeker(entries, [tuple(r) for r in stems.collect()]), f"{kinds}, _text string, _near {_ENTRY}, _far array<string>")
    # Most texts hold nothing that begins as a long keyword, and these don't cross the network.
    likely = sought.filter(F.size("_far") > 0)
    parts = likely.select("_text", F.explode("_far").alias("keyword")).distinct()
    whole = parts.join(long, "keyword").groupBy("_text").agg(F.collect_list(F.struct("list", "place", "keyword", "value")).alias("_late"))
    joined = likely.join(whole, "_text", "left").withColumn("_near", F.concat("_near", F.coalesce("_late", F.array().cast(_ENTRY))))
    columns = [F.col(f"`{f.name}`") for f in texts.schema.fields]
    all_of = sought.filter(F.size("_far") <= 0).select(*columns, "_near").unionAll(joined.select(*columns, "_near"))

    def told(own: Column) -> Column:
        if every:
            return F.array_sort(F.array_distinct(own["value"]))
        least = F.array_min(F.transform(own, lambda e: F.struct(e["place"], e["keyword"], e["value"])))
        return F.struct(least["place"].alias("place"), least["keyword"].alias("keyword"), least["value"].alias("value"), F.size(own).alias("n"))

    lists = F.array_distinct(F.col("_near")["list"])
    pairs = F.transform(lists, lambda n: F.struct(n, told(F.filter("_near", lambda e: e["list"] == n))))
    return all_of.withColumn(name, F.map_from_entries(pairs)).drop("_near")


def mark(texts: DataFrame, keywords: DataFrame, text: str, name: str = "marks", every: bool = False) -> DataFrame:
    """``texts`` and a map from each list that has a keyword in column ``text`` to ``place, keyword, value, n``.

    With ``every`` the map is to the values of all keywords of the list that the text contains.

    ``keywords`` has ``list, place, keyword, value``; a keyword may stand in several lists. Of keywords of one place the
    least counts first; a keyword without a value is its own. Keywords are sought as they are, anywhere in a text. Null and empty keywords and rows without
    a list find nothing; a null text contains none. An empty table marks nothing. A table over ``MOST_BYTES`` is joined.
    """
    rows = keywords.select("list", F.col("place").cast("int"), "keyword", F.coalesce(F.col("value").cast("string"), "keyword").alias("value")).filter("list is not null and place is not null and keyword <> ''")
    rows = rows.dropDuplicates(["list", "keyword", "place"])
    if _bytes(rows) > MOST_BYTES:
        return _mark_by_join(texts, rows, text, name, every)
    entries = sorted((tuple(r) for r in rows.collect()), key=lambda e: (e[0], e[1], e[2]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    found = texts.withColumn("_text", F.col(text).cast("string")).mapInArrow(_finder(entries, every), f"{kinds}, found {_EVERY if every else _FOUND}")
    met = (lambda e: e["values"]) if every else (lambda e: F.struct(e["place"], e["keyword"], e["value"], e["n"]))
    pairs = F.transform("found", lambda e: F.struct(e["list"], met(e)))
    return found.withColumn(name, F.map_from_entries(pairs)).drop("found")


class Tested:
    """Built-in lists tested keyword by keyword, inside the receipt's expressions."""

    def __init__(self, upper: Column) -> None:
        self.upper = upper

    def _keywords(self, name: str) -> list[str]:
        return [e[0] if isinstance(e, tuple) else e for e in BUILT_IN[name]]

    def count(self, name: str) -> Column:
        """How many keywords of a list a line contains."""
        return sum((F.contains(self.upper, F.lit(w)).cast("int") for w in self._keywords(name)), F.lit(0))

    def any(self, name: str) -> Column:
        """Whether a line contains a keyword of a list."""
        return contains_any(self.upper, self._keywords(name))

    def first(self, name: str) -> Column:
        """The first keyword of a list that a line contains."""
        return first_contained(self.upper, self._keywords(name))

    def value(self, name: str) -> Column:
        """``place, value`` of that keyword."""
        entries = [e if isinstance(e, tuple) else (e, e) for e in BUILT_IN[name]]
        place = F.coalesce(*[F.when(F.contains(self.upper, F.lit(k)), F.lit(i)) for i, (k, _) in enumerate(entries)])
        values = F.array(*[F.lit(v) for _, v in entries])
        return F.when(place.isNotNull(), F.struct(place.alias("place"), F.get(values, place).alias("value")))


class Marked:
    """Lists of a keyword table, out of the marks that :func:`mark` made."""

    def __init__(self, marks: Column) -> None:
        self.marks = marks

    def _met(self, name: str) -> Column:
        return F.try_element_at(self.marks, F.lit(name))

    def count(self, name: str) -> Column:
        return F.coalesce(self._met(name)["n"], F.lit(0))

    def any(self, name: str) -> Column:
        return self._met(name).isNotNull()

    def first(self, name: str) -> Column:
        return self._met(name)["keyword"]

    def value(self, name: str) -> Column:
        met = self._met(name)
        return F.when(met.isNotNull(), F.struct(met["place"].alias("place"), met["value"].alias("value")))
