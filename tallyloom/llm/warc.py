"""WARC archives of web pages as Zstandard with an embedded dictionary.

A dictionary is built from a bounded sample of the records to be archived, headers and all.
Each file begins with a skippable frame that holds the dictionary, then a warcinfo record;
each record is one frame of its own. Files are written by Spark's text writer, so any file
system that Spark writes works and a lost executor only repeats its tasks: a row is one
frame, and the line separator is an empty skippable frame, which decoders pass over. When
the job is done its files are renamed to ``*.warc.zst``.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import cut, fresh_path, spread_join

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of which the dictionary is built, and payload bytes that they have at most; this bounds the sample.
SAMPLE_RECORDS, SAMPLE_BYTES = 400, 32_768
SOFTWARE = "tallyloom"
DICTIONARY_BYTES = 65_536
#: Numbers of equal rows that one task writes at once.
PART_ROWS = 8192
#: Shorter payloads are never revisits.
LEAST_REVISIT = 100


def _plain(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    return plain.select("*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("payload_digest"))


def roles(digests: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, payload_digest, rows, first_id, first_url``: the response of each page's payload (null: none is shared)."""
    each = digests.groupBy("page_id", "payload_digest").agg(
        F.count(F.lit(1)).alias("rows"), F.min("url").alias("url"), F.max("payload_bytes").alias("payload_bytes")
    )
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    shared = F.when((F.max("payload_bytes") >= least) & (F.sum("rows") > 1), first)
    firsts = each.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), shared.alias("first"))
    firsts = firsts.select("payload_digest", "n", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    return spread_join(each.drop("url", "payload_bytes"), firsts, ["payload_digest"], F.col("page_id")).drop("n")


def _repeats(plain: DataFrame, digests: DataFrame, facts: DataFrame) -> DataFrame:
    """Numbered rows of pages that stand several times with one payload; ``facts`` has these pages' roles.

    Rows that agree in page, url and payload are one group, numbered after those of other urls of the
    page, so a number never depends on the task that meets a row. A group is dealt out by ranges
    of numbers, without its html, which only its responses hold.
    """
    key = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("payload_digest")).alias("key")
    facts = facts.select(key, "first_id", "first_url")
    groups = digests.select(key, "page_id", "url", "payload_bytes", "payload_digest").groupBy("key", "page_id", "url", "payload_bytes", "payload_digest").count()
    order = Window.partitionBy("key").orderBy(F.desc(F.col("url").eqNullSafe(F.col("first_url"))), "url")
    ahead = F.coalesce(F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bodies = plain.select(key, "html").join(facts.select("key"), "key", "left_semi").groupBy("key").agg(F.min("html").alias("html"))
    groups = groups.join(facts, "key").withColumn("ahead", ahead).join(bodies, "key")
    shared = F.col("first_id").isNotNull()
    heads = groups.filter("ahead = 0").withColumn("nth", F.lit(0).cast("long"))
    heads = heads.withColumn("response", ~shared | (F.col("page_id") == F.col("first_id")))
    begin, end = F.greatest(F.col("ahead"), F.lit(1)), F.col("ahead") + F.col("count")
    tails = groups.withColumn("html", F.when(~shared, F.col("html"))).withColumn("response", ~shared).filter(begin < end)
    parts = tails.withColumn("part", F.explode(F.sequence(F.floor(begin / PART_ROWS), F.floor((end - 1) / PART_ROWS))))
    low, high = F.col("part") * PART_ROWS, (F.col("part") + 1) * PART_ROWS - 1
    parts = parts.repartition("key", "part").withColumn("nth", F.explode(F.sequence(F.greatest(begin, low), F.least(end - 1, high))))
    columns = ["page_id", "url", "html", "payload_bytes", "payload_digest", "first_id", "first_url", "nth", "response"]
    return heads.select(*columns).unionAll(parts.select(*columns))


def build_dictionary(plain: DataFrame, digests: DataFrame, date: str, records: int = SAMPLE_RECORDS) -> bytes:
    """Zstandard dictionary from response records: those of the ``records`` smallest digests of pages of ``SAMPLE_BYTES`` at most.

    Empty if there are fewer than 8.
    """
    small = digests.filter(f"payload_bytes > 0 and payload_bytes <= {SAMPLE_BYTES} and page_id is not null")
    some = small.groupBy("payload_digest").agg(F.min("page_id").alias("page_id"))
    ids = [r["page_id"] for r in some.orderBy("payload_digest").limit(records).collect()]
    if len(ids) < 8:
        return b""
    pages = plain.filter(F.col("page_id").isin(ids) & (F.col("payload_bytes") <= SAMPLE_BYTES))
    pages = pages.groupBy("page_id").agg(F.min(F.struct("payload_digest", "url", "html")).alias("page")).orderBy("page_id").collect()
    sample = [_record("response", r["page_id"], r["page"]["url"], r["page"]["html"].encode(), r["page"]["payload_digest"], date) for r in pages]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def record_id(*parts: object) -> str:
    """Record id that follows from its parts, so a repeated task gives a record the same one."""
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(repr(parts).encode()).hexdigest()[:32])}>"


def _uri(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def _assemble(head: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(date: str, name: object) -> bytes:
    block = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
    return _assemble(["WARC-Type: warcinfo", f"WARC-Record-ID: {record_id('info', name)}", f"WARC-Date: {date}", "Content-Type: application/warc-fields"], block)


def _record(
    kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, date: str, nth: int = 0,
    size: int | None = None, refers: int | None = None, refers_url: str | None = None,
) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, nth)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers, digest, 0)}", f"WARC-Refers-To-Date: {date}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_uri(refers_url)}")
        head.append(f"X-Refers-To-Page-Id: {refers}")
    head.append("Content-Type: application/http; msgtype=response")
    return _assemble(head, block + payload)


def _framer(dictionary: bytes, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True)
        opened = False
        for batch in batches:
            frames = []
            for page_id, url, html, size, digest, first, first_url, nth, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not opened:  # one task writes one file
                    if dictionary:
                        frames.append(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                    frames.append(pack.compress(_info(date, (page_id, digest, nth))))
                    opened = True
                payload = html.encode() if response else b""
                about = (page_id, url, payload, digest, date, nth, size)
                frames.append(pack.compress(_record("response", *about) if response else _record("revisit", *about, first, first_url)))
            for at in range(0, len(frames), 500):
                yield pa.RecordBatch.from_arrays([pa.array(frames[at : at + 500], pa.binary())], names=["frame"])

    return run


def _name_files(spark: SparkSession, path: str) -> None:
    """Renames the files of a finished job; only names pass through the driver."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(folder):
        file = status.getPath()
        name = file.getName()
        if name.startswith("part-") and name.endswith(".txt"):
            store.rename(file, spark._jvm.org.apache.hadoop.fs.Path(folder, name[: -len(".txt")] + ".warc.zst"))


def write_archives(pages: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", level: int = 9, least: int = LEAST_REVISIT) -> None:
    """Writes one record per page to dictionary-compressed archives in folder ``path``.

    ``pages`` needs ``page_id, url, html``; other columns are ignored. The payload is the html
    in UTF-8. Of records with equal payloads of ``least`` bytes or more, the one of smallest
    ``page_id`` is a response and the others revisit it; all others are responses. Revisits
    hold no block; their headers have the length and digest of the full payload.

    A null html is an empty payload, a null url leaves the target out. Rows that repeat a page
    with the same payload of that size revisit it, from the second on, however joins are split. A null ``page_id`` comes
    after all others: it is a response only if no other page has its payload. An empty
    table writes no records. With fewer than 8 pages to build it from there is no dictionary.
    """
    plain = _plain(pages)
    digests = cut(plain.select("page_id", "url", "payload_bytes", "payload_digest"), "digests")
    dictionary = build_dictionary(plain, digests, date)
    facts = cut(roles(digests, least), "roles")
    once = facts.filter("rows = 1").withColumnsRenamed({"page_id": "of", "payload_digest": "of_digest"})
    whole = plain.hint("merge").join(once, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("payload_digest") == F.col("of_digest")))
    whole = whole.withColumns({"nth": F.lit(0).cast("long"), "response": F.col("first_id").isNull() | (F.col("page_id") == F.col("first_id"))})
    columns = ["page_id", "url", "html", "payload_bytes", "payload_digest", "first_id", "first_url", "nth", "response"]
    whole = whole.select(*columns)
    many = facts.filter("rows > 1")
    if not many.isEmpty():
        whole = whole.unionAll(_repeats(plain, digests, many))
    frames = whole.mapInArrow(_framer(dictionary, date, level), "frame binary")
    writer = frames.select(F.col("frame").cast("string").alias("frame")).write.option("lineSep", SEPARATOR)
    writer.option("maxRecordsPerFile", 0).text(path)  # each file needs its dictionary
    _name_files(pages.sparkSession, path)


def iter_frames(content: bytes) -> Iterator[tuple[int, int, int]]:
    """``magic, start, end`` of the frames of a Zstandard file, data frames up to the next frame's separator."""
    at = 0
    while at + 8 <= len(content):
        magic, size = struct.unpack_from("<II", content, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            yield magic, at + 8, at + 8 + size
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = at + _frame_length(content, at)
            yield magic, at, end
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


def _frame_length(content: bytes, at: int) -> int:
    start = at
    head = content[at + 4]
    single, checksum = head >> 5 & 1, head >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[head & 3] + ((1 if single else 0), 2, 4, 8)[head >> 6]
    while True:
        block = int.from_bytes(content[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * checksum - start


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive."""
    unpack = zstandard.ZstdDecompressor()
    for magic, start, end in iter_frames(content):
        if magic == DICTIONARY_FRAME:
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[start:end]))
        elif magic == FRAME_MAGIC:
            raw = unpack.decompress(content[start:end])
            head, _, rest = raw.partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])]


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                rows: list[tuple] = []
                size = 0
                for headers, block in parse_archive(batch.column(0)[r].as_py()):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    page = int(headers["X-Page-Id"]) if "X-Page-Id" in headers else None
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = headers["WARC-Payload-Digest"].partition(":")[2]
                    refers, length = None, len(payload)
                    if kind == "revisit":
                        payload, refers = None, int(headers["X-Refers-To-Page-Id"])
                        length = int(http.rpartition(b"Content-Length: ")[2])
                    elif hashlib.sha256(payload).hexdigest() != stated:
                        raise ValueError(f"page {page}: payload does not match its digest")
                    row = (page, headers.get("WARC-Target-URI"), length, stated, kind, refers)
                    rows.append((*row, payload) if with_payload else row)
                    size += len(block)
                    if len(rows) >= 5000 or with_payload and size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names[: len(rows[0])])

    return run


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """Records of the archives in ``path``, warcinfo left out; every response's payload is checked against its digest.

    Archives reach a Python worker one at a time, so the records are written to a table of their own.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return cut(files.mapInArrow(_reader(with_payload), _READ + ", payload binary" * with_payload), "records", batch_rows=1)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes archives to a new shared folder and reads them back: one row per page."""
    path = fresh_path(pages.sparkSession, "archives")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
