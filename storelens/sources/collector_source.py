"""Collector folders as a Spark data source, for batches and streams.

Collectors drop files of JSON lines, one poll item a line, into numbered folders::

    <path>/store_id=<store>/connector=<connector>/seq=<n>/<any name>.json

A drop is complete when its folder is there, and the numbers of one collector only
rise.  ``spark.read.format("storelens_collector").load(path)`` reads all drops;
conditions on ``store_id`` and ``connector`` choose folders and are not checked again per
row.  ``spark.readStream`` keeps the last number of each collector as its offset, so a restart
goes on after the drops it has read, and a collector that joins later is read from its first.

Files are cut into ranges of ``range_bytes`` (an option), one task each; a range has the lines
that begin in it.  Keys of a line beside those of a poll item become its ``payload``, as JSON; a
line that is no JSON object is an item without an id, with the line as its payload.
"""

from __future__ import annotations

import io
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from storelens.schemas import POLL_ITEM

# The driver's workers for data sources get no files that were added to the context, so what is
# defined here travels with the source itself.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "storelens_collector"
RANGE_BYTES = 64_000_000
BATCH_LINES = 10_000
READ_BYTES = 1_000_000
_FOLDER_KEYS = ("store_id", "connector")
_TEXT_KEYS = ("external_id", "occurred_at", "kind")
_ARROW = pa.schema([(f.name, pa.float64() if f.name == "confidence" else pa.string()) for f in POLL_ITEM.fields] + [("seq", pa.int64())])


@dataclass
class FileRange(InputPartition):
    store_id: str
    connector: str
    seq: int
    file: str
    start: int
    end: int


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _named(infos: list[pafs.FileInfo], key: str) -> list[tuple[str, str]]:
    """(value, path) of the folders ``key=value``."""
    return sorted((unquote(i.base_name.removeprefix(f"{key}=")), i.path) for i in infos
                  if i.type == pafs.FileType.Directory and i.base_name.startswith(f"{key}="))


class _Folders:
    """Collectors and drops below a path; ``wanted`` names the stores and connectors to look at."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.wanted: dict[str, set[str]] = {}

    def _folders(self, store: pafs.FileSystem, root: str, key: str) -> list[tuple[str, str]]:
        found = _named(store.get_file_info(pafs.FileSelector(root, allow_not_found=True)), key)
        return [f for f in found if key not in self.wanted or f[0] in self.wanted[key]]

    def collectors(self) -> Iterator[tuple[str, str, list[tuple[int, str]]]]:
        """(store, connector, [(seq, folder)]) of every collector."""
        store, root = _open(self.path)
        for store_id, folder in self._folders(store, root, "store_id"):
            for connector, below in self._folders(store, folder, "connector"):
                yield store_id, connector, sorted((int(seq), p) for seq, p in self._folders(store, below, "seq") if seq.isdigit())

    def ranges(self, after: dict[str, int], until: dict[str, int] | None) -> list[FileRange]:
        store, _ = _open(self.path)
        out = []
        for store_id, connector, drops in self.collectors():
            name = json.dumps([store_id, connector])
            for seq, folder in drops:
                if seq <= after.get(name, -1) or (until is not None and seq > until.get(name, -1)):
                    continue
                for info in sorted(store.get_file_info(pafs.FileSelector(folder)), key=lambda i: i.path):
                    if info.type == pafs.FileType.File and info.base_name.endswith(".json"):
                        out += [FileRange(store_id, connector, seq, info.path, at, min(at + self.range_bytes, info.size))
                                for at in range(0, info.size, self.range_bytes)]
        return out

    def newest(self) -> dict[str, int]:
        return {json.dumps([s, c]): drops[-1][0] for s, c, drops in self.collectors() if drops}

    def lines(self, part: FileRange) -> Iterator[bytes]:
        """Lines that begin in the range."""
        store, _ = _open(self.path)
        with store.open_input_file(part.file) as raw, io.BufferedReader(raw, READ_BYTES) as f:
            at = part.start
            if at:
                # The line that the byte before the range is in, or ends with it, belongs to the range before.
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < part.end and (line := f.readline()):
                at += len(line)
                yield line

    def batches(self, part: FileRange | None) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        # Spark reads one empty partition where there is no range.
        for line in self.lines(part) if part is not None else ():
            if line.strip():
                rows.append(_item(line, part))
            if len(rows) >= BATCH_LINES:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _item(line: bytes, part: FileRange) -> dict:
    """A poll item from one line; the folder tells its store and connector."""
    item = {"store_id": part.store_id, "connector": part.connector, "seq": part.seq}
    try:
        given = json.loads(line)
    except ValueError:
        given = None
    if not isinstance(given, dict):
        return item | {"payload": line.decode("utf-8", "replace").rstrip("\r\n")}
    for key in _TEXT_KEYS:
        found = given.pop(key, None)
        item[key] = found if found is None or isinstance(found, str) else json.dumps(found)
    confidence = given.pop("confidence", None)
    item["confidence"] = float(confidence) if isinstance(confidence, (int, float)) and not isinstance(confidence, bool) else None
    for key in _FOLDER_KEYS:
        given.pop(key, None)
    payload = given.pop("payload", None)
    rest = given | (payload if isinstance(payload, dict) else {} if payload is None else {"payload": payload})
    return item | {"payload": json.dumps(rest, ensure_ascii=False) if rest else None}


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folders = _Folders(options)

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in _FOLDER_KEYS:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.folders.wanted[column] = self.folders.wanted.get(column, values) & values

    def partitions(self):
        return self.folders.ranges({}, None)

    def read(self, partition: FileRange | None):
        return self.folders.batches(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folders = _Folders(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.folders.newest()

    def partitions(self, start: dict, end: dict):
        return self.folders.ranges(start, end)

    def read(self, partition: FileRange | None):
        return self.folders.batches(partition)


class CollectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in POLL_ITEM.fields) + ", seq bigint"

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register_collector_source(spark: SparkSession) -> None:
    """Makes ``format("storelens_collector")`` known to the session, conditions on folders included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CollectorSource)
