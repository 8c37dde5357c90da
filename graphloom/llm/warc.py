"""WARC archives, and a capture index made by external merging (operator 3).

Writing: a record is one string (header, HTTP header, payload) and Spark's text
sink, with the record separator of the format as its line separator and gzip
compression, writes a whole archive a task. The sink's commit protocol makes a
retried task's archive replace the lost one, and any store that Spark can write
to will do. Equal payloads of at least ``min_bytes`` bytes become one response
and revisits that refer to it; which one is settled by a grouped maximum over
digests, so no payload is ever shuffled and a payload shared by a third of all
pages is one partial count a task.

Reading: archives come back as binary files and are parsed as a stream. Each
archive yields its index entries sorted by (URL key, time, page): a run, written
as such. The runs are then merged: splitters from the runs cut the key space
into ranges, and each range's task merges its slices of all runs through a
loser tree. The result is globally ordered, and a URL with very many captures
is spread over ranges, since time and page are part of the key.

Cases: a null html counts as empty, a null url as the empty url; a null page_id
is smaller than any other and comes back as null; rows that share page_id and
payload are each written (all of them responses, if that page_id is the largest);
an empty table gives an empty index; unknown columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import new_path, written
from .batches import small_batches

MIN_BYTES = 1000
#: Bytes of records that an archive holds about, before compression: it bounds the pieces that are read back.
ARCHIVE_BYTES = 128 << 20
#: Records are written by class of size, each class 16 times the one before, from this many bytes up.
_SMALL = 8 << 10
#: Digests of repeated payloads that may be broadcast (40-character keys: under 16 MB).
BROADCAST_DIGESTS = 100_000
#: Index entries that one merging task holds.
RANGE_ENTRIES = 200_000

INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string, captured long, archive string, position long"
_FIELDS = [f.split(" ")[0] for f in INDEX.split(", ")]


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the top level down, then the rest, without scheme, port 80 and fragment."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?:]*)", 1))
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), F.regexp_replace(F.substr(rest, F.length(host) + 1), "^:80(?=/|$)", ""))


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _utc(seconds: Column) -> Column:
    """Seconds since 1970 as a date and time in UTC, whatever the session's zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    return F.concat(day.cast("string"), F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600), F.floor(F.pmod(rest, F.lit(3600)) / 60), F.pmod(rest, F.lit(60))))


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(value, size): one WARC record a row, as a string without the closing separator, and its payload's bytes."""
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", "%0A").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns({"size": F.octet_length("html"), "digest": F.sha1(F.col("html").cast("binary"))})
    repeated = (
        page.where(F.col("size") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1 and first is not null")
        .select("digest", "first")
    )
    repeated = _sized(repeated)
    page = page.join(repeated, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n")
    )
    block = F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    return page.select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "),
            F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
            F.lit("\r\nWARC-Record-ID: "),
            _id(F.col("page_id")),
            F.lit("\r\nWARC-Date: "),
            _utc(F.lit(1_600_000_000) + F.coalesce(F.col("page_id"), F.lit(0)) % 100_000_000),
            F.lit("\r\nWARC-Target-URI: "),
            F.col("url"),
            F.lit("\r\nX-URL-Key: "),
            url_key(F.col("url")),
            F.lit("\r\nWARC-Payload-Digest: sha1:"),
            F.col("digest"),
            F.when(
                F.col("revisit"),
                F.concat(
                    F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
                    _id(F.col("first")),
                ),
            ).otherwise(F.lit("")),
            F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
            F.octet_length(block).cast("string"),
            F.lit("\r\n\r\n"),
            block,
        ).alias("value"),
        "size",
    )


def _sized(repeated: DataFrame) -> DataFrame:
    """Broadcast the repeated digests if they are few (counted first); else Spark's shuffled join, split where skewed."""
    repeated = written(repeated, "repeated")
    return F.broadcast(repeated) if repeated.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS else repeated


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` as gzip-compressed archives under ``path``.

    An archive holds records of one class of size, so many that the largest of them come
    to ``archive_bytes``; a larger record has an archive of its own.
    """
    made = records(pages, min_bytes)
    size = F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit("")))
    # one number: which classes there are follows from the largest payload
    largest = pages.agg(F.max(size)).first()[0] or 0
    top = _SMALL
    below = 0
    while below <= largest:
        mine = made if top > largest and not below else made.where((F.col("size") >= below) & (F.col("size") < top))
        # a record's head is some hundred bytes beside its payload and the two copies of its URL
        mine.select("value").write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, archive_bytes // top)).text(path)
        below, top = top, top * 16


class _Inflated:
    """Reads of a gzip-compressed buffer that keep a bounded part of it inflated."""

    def __init__(self, data: bytes, step: int = 1 << 18):
        self.data, self.step, self.at = memoryview(data), step, 0
        self.inflate, self.rest, self.position = zlib.decompressobj(31), b"", 0

    def _more(self) -> bool:
        if self.inflate.eof:
            if not (tail := self.inflate.unused_data) and self.at >= len(self.data):
                return False
            self.inflate = zlib.decompressobj(31)
            self.rest += self.inflate.decompress(tail)
            return True
        if self.at >= len(self.data):
            return False
        self.rest += self.inflate.decompress(self.data[self.at : self.at + self.step])
        self.at += self.step
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (end := self.rest.find(mark, start)) < 0:
            start = max(0, len(self.rest) - len(mark))
            if not self._more():
                return None
        return self.take(end + len(mark))

    def take(self, n: int) -> bytes:
        parts, got = [], 0
        while got + len(self.rest) < n:
            parts.append(self.rest)
            got += len(self.rest)
            self.rest = b""
            if not self._more():
                raise ValueError("the archive ends within a record")
        parts.append(self.rest[: n - got])
        self.rest = self.rest[n - got :]
        self.position += n
        return b"".join(parts)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, block, position) of each record of an archive."""
    source = _Inflated(data)
    while True:
        position = source.position
        head = source.until(b"\r\n\r\n")
        if head is None:
            return
        first, *lines = head[:-4].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record starts at {position}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        block = source.take(int(headers["Content-Length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {position} isn't closed")
        yield headers, block, position


def _page(urn: str) -> int | None:
    return int(urn[10:-1]) if len(urn) > 11 else None


def _sort_key(entry: tuple) -> tuple:
    """(URL key, time, page with null first, position in its archive)."""
    return entry[6], entry[7], entry[0] is not None, entry[0] or 0, entry[8], entry[9]


def entry_of(headers: dict[str, str], block: bytes, archive: str, position: int) -> tuple:
    """The index entry of a record; a response's digest and size are those of what was read."""
    import calendar
    import time

    revisit = headers["WARC-Type"] == "revisit"
    http, payload = block.split(b"\r\n\r\n", 1)
    stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError(f"{archive}, {position}: the payload isn't the one that was written")
    return (
        _page(headers["WARC-Record-ID"]),
        size,
        stated,
        headers["WARC-Type"],
        _page(headers["WARC-Refers-To"]) if revisit else None,
        headers["WARC-Target-URI"],
        headers["X-URL-Key"],
        calendar.timegm(time.strptime(headers["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ")),
        archive,
        position,
    )


def _batches(entries: Iterator[tuple] | list[tuple], size: int = 5_000) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in INDEX.split(", ")])
    part: list[tuple] = []
    for entry in entries:
        part.append(entry)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of the archives under ``path``, sorted within each archive."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                archive = name.as_py().rsplit("/", 1)[-1]
                entries = [entry_of(h, block, archive, at) for h, block, at in parse(content.as_buffer())]
                yield from _batches(sorted(entries, key=_sort_key))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(read, INDEX)


class LoserTree:
    """K-way merge of sorted iterators: each output replays one leaf-to-root path of losers."""

    _END = (1,)

    def __init__(self, sources: list[Iterator[tuple]], key: Callable[[tuple], tuple]):
        self.sources, self.key, k = sources, key, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.keys = [self._rank(h) for h in self.heads]
        self.losers = [-1] * k
        for leaf in range(k):
            self._replay(leaf)

    def _rank(self, head: tuple | None) -> tuple:
        return self._END if head is None else (0, self.key(head))

    def _replay(self, winner: int) -> None:
        k = len(self.sources)
        node = (winner + k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self.keys[other] < self.keys[winner]:
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.sources:
            winner = self.losers[0]
            head = self.heads[winner]
            if head is None:
                return
            yield head
            self.heads[winner] = head = next(self.sources[winner], None)
            self.keys[winner] = self._rank(head)
            self._replay(winner)


def _merge_range(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """Merge one key range: the slice of every run, each already in order."""
    slices: dict[str, list[tuple]] = {}
    for batch in batches:
        for entry in zip(*(batch.column(batch.schema.get_field_index(f)).to_pylist() for f in fields), strict=True):
            slices.setdefault(entry[8], []).append(entry)
    yield from _batches(LoserTree([iter(s) for _, s in sorted(slices.items())], _sort_key))


def merged(index_runs: DataFrame, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """The runs' entries in global order of (URL key, time, page).

    ``index_runs`` is a table of runs. Its splitters come from Spark's range
    partitioner; within a range a run's slice is put in its own order again
    (blocks of a shuffle arrive in any order), and the loser tree merges the slices.
    """
    total = index_runs.count()
    spark = index_runs.sparkSession
    parts = max(1, -(-total // range_entries), min(total, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = ["url_key", "captured", F.col("page_id").asc_nulls_first(), "archive", "position"]
    return (
        index_runs.repartitionByRange(parts, *order)
        .sortWithinPartitions("archive", *order[:3], "position")
        .mapInArrow(partial(_merge_range, fields=_FIELDS), INDEX)
    )


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives, read them back, and return their merged index."""
    spark = pages.sparkSession
    small_batches(spark)
    archives, index = new_path(spark, "warc"), new_path(spark, "warc-runs")
    write(pages, archives, min_bytes)
    runs(spark, archives).write.parquet(index)
    return merged(spark.read.schema(INDEX).parquet(index))
