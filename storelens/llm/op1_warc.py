"""WARC archives with a two-level capture index.

``write_archives`` writes one record per page, each its own gzip member, into archive
files below a folder that all executors share, and returns one capture row per
record.  Of payloads with equal SHA-256 and at least ``REVISIT_BYTES`` bytes the
page with the smallest id is a response and the others are revisits without a
payload.

``build_index`` sorts the captures by reversed-host key into shards; a shard is
a file of compressed blocks of ``BLOCK_LINES`` lines beside a sparse directory with
the first key and byte range of each block.  ``locate`` takes sorted requests: it finds the
shard among the shards' first keys, binary-searches that shard's directory,
reads the block's byte range and binary-searches its lines.  ``fetch`` sorts what was
found by archive and offset, merges neighbouring ranges into one read and parses
the records.

File names carry the task attempt, and only rows of successful attempts are
kept, so files that a lost executor left are never read.  ``round_trip`` names its folder
with the scheme that Spark gives it; ``file:`` paths and given paths without a scheme
are local or mounted, others go through ``pyarrow.fs``.

Cases: a null html is an empty payload; a null url has the key ``)/``; a null page_id
is the largest id and comes back as null; repeated rows are separate records, all
of them responses if their id is the smallest; empty tables give no files; line
breaks in urls are percent-encoded.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.common import NULL_ID, id_or_last, map_arrow, partitions, scratch, written

#: Payloads below this many bytes are always responses.
REVISIT_BYTES = 100
#: An archive is closed after this many compressed bytes.
ARCHIVE_BYTES = 256_000_000
BLOCK_LINES = 1000
#: Ranges closer than MERGE_GAP are read together, up to MERGE_BYTES.
MERGE_GAP, MERGE_BYTES = 65_536, 8_000_000
BATCH_BYTES = 8_000_000
#: Fixed value: capture time, as pages carry none.
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CAPTURE = "key string, page long, archive string, offset long, length long"


def reversed_host_key(url: Column) -> Column:
    """``com,example,www)/path?query`` of a url: host lower-cased and reversed, no scheme, user, default port or fragment."""
    text = F.coalesce(url, F.lit(""))
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#]*)([^#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(text, parts, 1)), r"(:80|:443)?\.?$", "")
    rest = F.regexp_extract(text, parts, 2)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"),
                   F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)))
    return F.regexp_replace(key, r"[\x00-\x20\x7f]", "%20")


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        scheme, _, rest = uri.partition(":")
        return (pafs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def tagged_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page, url, key, payload, payload_bytes, digest, refers_to)``; revisits have no payload."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    full = pages.select(id_or_last(page_id).alias("page"), F.col(url).alias("url"), reversed_host_key(F.col(url)).alias("key"), body.alias("payload"))
    hashed = full.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"))
    owners = (hashed.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("digest")
              .agg(F.min("page").alias("owner"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("meet"), "owner"))
    # Short payloads meet nobody; their ids spread them.
    meet = F.when(F.col("payload_bytes") >= REVISIT_BYTES, F.col("digest")).otherwise(F.concat(F.lit("page "), F.col("page")))
    joined = hashed.withColumn("meet", meet).join(owners, "meet", "left")
    again = F.coalesce(F.col("owner") != F.col("page"), F.lit(False))
    return joined.select("page", "url", "key", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "digest",
                         F.when(again, F.col("owner")).alias("refers_to"))


def record_id(page: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record_bytes(page: int, url: str | None, payload: bytes | None, payload_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed."""
    body = payload or b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}",
            f"WARC-Date: {WARC_DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {page}", f"X-Payload-Length: {payload_bytes}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and content block; raises ValueError if the record is damaged."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if not mark or lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    return fields, rest[:n]


def write_archives(tagged: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of ``tagged_pages`` below ``folder``; the captures ``(key, page, archive, offset, length)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = _store(folder)
        store.create_dir(f"{root}/archives", recursive=True)
        out, name, at, number = None, "", 0, 0
        for batch in batches:
            rows = []
            for page, url, key, payload, size, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"archives/{task.partitionId():06d}-{task.taskAttemptId()}-{number}.warc.gz"
                    out, at, number = store.open_output_stream(f"{root}/{name}", compression=None), 0, number + 1
                member = gzip.compress(record_bytes(page, url, payload, size, digest, refers_to), 6, mtime=0)
                out.write(member)
                rows.append((key, page, name, at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), _CAPTURE_TYPES)], names=["key", "page", "archive", "offset", "length"])
        if out is not None:
            out.close()

    return written(map_arrow(tagged, run, _CAPTURE), "captures")


_CAPTURE_TYPES = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())


class Shard(NamedTuple):
    """The first and last entry of an index file, by key and page."""

    first: tuple[str, int]
    last: tuple[str, int]
    name: str


class CaptureIndex(NamedTuple):
    folder: str
    shards: list[Shard]  # one per index file, in key order


def build_index(captures: DataFrame, folder: str) -> CaptureIndex:
    """Sorted, compressed blocks with a sparse directory per shard, below ``folder``."""
    spark = captures.sparkSession

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = _store(folder)
        store.create_dir(f"{root}/index", recursive=True)
        name = f"index/{task.partitionId():06d}-{task.taskAttemptId()}"
        out, at, lines, first, last, directory = None, 0, [], None, None, []

        def flush():
            nonlocal at, lines
            member = gzip.compress("\n".join(lines).encode("utf-8"), 6, mtime=0)
            out.write(member)
            key, page = lines[0].split(" ")[:2]
            directory.append(f"{key} {page} {at} {len(member)}")
            at, lines = at + len(member), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out, first = store.open_output_stream(f"{root}/{name}.blocks.gz", compression=None), row[:2]
                last = row[:2]
                lines.append(" ".join(map(str, row)))
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with store.open_output_stream(f"{root}/{name}.directory", compression=None) as f:
                f.write("\n".join(directory).encode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((*first, *last, name), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()))],
                names=["first_key", "first_page", "last_key", "last_page", "name"])

    entries = captures.select("key", "page", "archive", "offset", "length")
    ordered = entries.repartitionByRange(partitions(spark), "key", "page", "archive", "offset").sortWithinPartitions(
        "key", "page", "archive", "offset")
    shards = written(map_arrow(ordered, run, "first_key string, first_page long, last_key string, last_page long, name string"), "shards")
    # One row per index file.
    return CaptureIndex(folder, sorted(Shard((r[0], r[1]), (r[2], r[3]), r[4]) for r in shards.collect()))


class IndexReader:
    """Looks requests up in one task; it holds one directory and one block."""

    def __init__(self, index: CaptureIndex):
        self.store, self.root = _store(index.folder)
        self.shards, self.firsts = index.shards, [s.first for s in index.shards]
        self.shard = self.block = None

    def _read(self, name: str, at: int | None = None, length: int | None = None) -> bytes:
        with self.store.open_input_file(f"{self.root}/{name}") as f:
            return f.read() if at is None else f.read_at(length, at)

    def _open(self, shard: Shard) -> None:
        if self.shard != shard:
            rows = [line.split(" ") for line in self._read(f"{shard.name}.directory").decode("utf-8").split("\n")]
            self.shard, self.block = shard, None
            self.block_firsts, self.ranges = [(k, int(p)) for k, p, _, _ in rows], [(int(a), int(n)) for _, _, a, n in rows]

    def _load(self, k: int) -> None:
        if self.block != k:
            text = gzip.decompress(self._read(f"{self.shard.name}.blocks.gz", *self.ranges[k])).decode("utf-8")
            self.block, self.lines = k, [line.split(" ") for line in text.split("\n")]
            self.keys = [(line[0], int(line[1])) for line in self.lines]

    def find(self, key: str, page: int) -> Iterator[tuple[str, int, int]]:
        """(archive, offset, length) of every capture of the request; equal entries may run over blocks and shards."""
        want = (key, page)
        i = max(bisect.bisect_left(self.firsts, want) - 1, 0)
        while i < len(self.shards) and self.shards[i].first <= want:
            if self.shards[i].last >= want:
                self._open(self.shards[i])
                k = max(bisect.bisect_left(self.block_firsts, want) - 1, 0)
                while k < len(self.ranges) and self.block_firsts[k] <= want:
                    self._load(k)
                    for line in self.lines[bisect.bisect_left(self.keys, want):bisect.bisect_right(self.keys, want)]:
                        yield line[2], int(line[3]), int(line[4])
                    k += 1
            i += 1


def locate(requests: DataFrame, index: CaptureIndex) -> DataFrame:
    """The captures ``(key, page, archive, offset, length)`` of the distinct requests ``(key, page)``."""
    spark = requests.sparkSession
    shared = spark.sparkContext.broadcast(index)  # one entry per index file

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, before = IndexReader(shared.value), None
        for batch in batches:
            rows = []
            for request in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if request != before:
                    rows += [(*request, *hit) for hit in reader.find(*request)]
                    before = request
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), _CAPTURE_TYPES)], names=["key", "page", "archive", "offset", "length"])

    ordered = requests.select("key", "page").repartitionByRange(partitions(spark), "key", "page").sortWithinPartitions("key", "page")
    return map_arrow(ordered, run, _CAPTURE)


def _merged_ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(archive, start, end, ranges) of neighbours to be read at once."""
    group: tuple[str, int, int, list[tuple[int, int]]] | None = None
    for archive, offset, length in rows:
        if group and group[0] == archive and offset - group[2] <= MERGE_GAP and offset + length - group[1] <= MERGE_BYTES:
            group[3].append((offset, length))
            group = (archive, group[1], max(group[2], offset + length), group[3])
        else:
            if group:
                yield group
            group = (archive, offset, offset + length, [(offset, length)])
    if group:
        yield group


_RECORD = "page long, record_type string, refers_to long, payload_bytes long, header_digest string, payload binary"


def fetch(located: DataFrame, folder: str) -> DataFrame:
    """The records of located captures, payload null for revisits; digests of responses are checked."""

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        store, root = _store(folder)
        open_name, f = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for archive, start, end, ranges in _merged_ranges(rows):
                if archive != open_name:
                    if f is not None:
                        f.close()
                    open_name, f = archive, store.open_input_file(f"{root}/{archive}")
                data = f.read_at(end - start, start)
                for offset, length in ranges:
                    fields, block = parse_record(gzip.decompress(data[offset - start:offset - start + length]))
                    digest, is_response = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "response"
                    if is_response and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"payload of {archive} at {offset} does not match its digest")
                    refers_to = fields.get("X-Refers-To-Page")
                    yield (int(fields["X-Page-ID"]), fields["WARC-Type"], None if refers_to is None else int(refers_to),
                           int(fields["X-Payload-Length"]), digest, block if is_response else None)
        if f is not None:
            f.close()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        rows, size = [], 0
        make = lambda: pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in _RECORD.split(", ")])
        for record in records(batches):
            rows.append(record)
            size += 200 + len(record[5] or b"")
            if size >= BATCH_BYTES:
                yield make()
                rows, size = [], 0
        if rows:
            yield make()

    ordered = located.select("archive", "offset", "length").repartitionByRange(
        partitions(located.sparkSession), "archive", "offset").sortWithinPartitions("archive", "offset")
    return map_arrow(ordered, run, _RECORD)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder with its scheme: Spark takes a path without one as of its default file system, tasks could not know that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, name))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Every page's record, written and read back through the index; one row per row of ``pages``."""
    folder = shared_folder(spark, "warc")
    index = build_index(write_archives(tagged_pages(pages), folder), folder)
    requests = pages.select(reversed_host_key(F.col("url")).alias("key"), id_or_last("page_id").alias("page"))
    return fetch(locate(requests, index), folder)


def record_digest(records: DataFrame) -> DataFrame:
    """Length and digest of the full payload per page; a response's come from the payload that was read."""
    response = F.col("record_type") == "response"
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return records.select(
        back("page").alias("page_id"), F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("header_digest")).alias("payload_digest"), "record_type",
        back("refers_to").alias("refers_to"))
