"""Large single files as Spark sources: archive members as a stream of lines, one JSON document in byte ranges.

Files are opened through pyarrow's file systems in the tasks that read them, so paths may lie anywhere pyarrow
reaches (shared folders, HDFS, object stores). Nothing larger than a batch of lines or one element of an array is held.
"""

from __future__ import annotations

import gzip
import io
import os
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

BATCH = 20_000
BLOCK_BYTES = 16 << 20
LOOK_AHEAD = 1 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str) -> list[str]:
    """The file itself, or the files of a folder that Spark's readers would take."""
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner))
    names = sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    return [f"{path.rstrip('/')}/{name}" for name in names]


# --- archive members -----------------------------------------------------------------------


@dataclass
class FilePart(InputPartition):
    path: str


def _member(path: str, member: str | None, suffix: str):
    system, inner = _opened(path)
    lower = path.lower()
    if lower.endswith(".zip"):
        archive = zipfile.ZipFile(system.open_input_file(inner))
        names = [i.filename for i in archive.infolist() if not i.is_dir() and i.filename.lower().endswith(suffix)]
        if len(names) != 1 or os.path.basename(names[0]) != names[0]:
            raise ValueError(f"{path} must hold exactly one plain {suffix} member")
        return archive.open(names[0])
    stream = system.open_input_stream(inner, compression=None)
    if lower.endswith((".tar.gz", ".tgz")):
        archive = tarfile.open(fileobj=stream, mode="r|gz")
        for entry in archive:
            if entry.name == member and entry.isfile():
                found = archive.extractfile(entry)
                found.archive = archive  # stays open as long as its member
                return found
        raise ValueError(f"{path} lacks {member}")
    return gzip.GzipFile(fileobj=stream) if lower.endswith(".gz") else stream


class MemberSource(DataSource):
    """``(ordinal, value)``: numbered lines of one member of each archive; ``path``, ``member``, ``suffix``, ``batch``."""

    @classmethod
    def name(cls) -> str:
        return "archive_member"

    def schema(self) -> str:
        return "ordinal bigint, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MemberReader(dict(self.options))


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.member, self.suffix = options["path"], options.get("member") or None, options.get("suffix", "")
        self.batch = int(options.get("batch", BATCH))

    def partitions(self) -> list[InputPartition]:
        return [FilePart(p) for p in _files(self.path)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        with _member(partition.path, self.member, self.suffix) as source:
            lines, first, chunk = io.TextIOWrapper(io.BufferedReader(_Raw(source)), encoding="utf-8", newline="\n"), 1, []
            for line in lines:
                chunk.append(line.rstrip("\r\n"))
                if len(chunk) == self.batch:
                    yield _numbered(first, chunk)
                    first, chunk = first + len(chunk), []
            if chunk:
                yield _numbered(first, chunk)


class _Raw(io.RawIOBase):
    """Any object with ``read`` as a raw stream."""

    def __init__(self, source) -> None:
        self.source = source

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        data = self.source.read(len(target))
        target[: len(data)] = data
        return len(data)


def _numbered(first: int, lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(lines)), pa.int64()), pa.array(lines, pa.string())], ["ordinal", "value"])


def member_lines(spark: SparkSession, path: str, *, member: str | None = None, suffix: str = "", batch: int = BATCH) -> DataFrame:
    """``(ordinal, value)`` lines of one archive member, unpacked as a stream in one task an archive."""
    spark.dataSource.register(MemberSource)
    reader = spark.read.format("archive_member").option("path", path).option("suffix", suffix).option("batch", batch)
    return (reader.option("member", member) if member else reader).load()


# --- one JSON document ---------------------------------------------------------------------


@dataclass
class JsonPart(InputPartition):
    path: str
    start: int
    end: int
    quoted: bool = False
    depth: int = 0


def structure(data: bytes, quoted: bool, escapes: int = 0) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of brackets outside strings, +1 or -1 for each, and whether the data end inside a string.

    ``quoted``: the data begin inside a string, behind ``escapes`` backslashes.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    quotes = np.flatnonzero(raw == 0x22)
    slashes = np.flatnonzero(raw == 0x5C)
    if len(slashes) or escapes:  # a quote counts where an even run of backslashes stands before it
        fresh = np.diff(slashes, prepend=-2) != 1
        first = slashes[np.maximum.accumulate(np.where(fresh, np.arange(len(slashes)), 0))] if len(slashes) else slashes
        run = slashes - first + 1 + np.where(first == 0, escapes, 0)
        at = np.searchsorted(slashes, quotes - 1)
        behind = at < len(slashes)
        behind[behind] = slashes[at[behind]] == quotes[behind] - 1
        before = np.where(quotes == 0, escapes, 0)
        before[behind] = run[at[behind]]
        quotes = quotes[before % 2 == 0]
    turns = np.zeros(len(raw) + 1, dtype=np.uint8)
    turns[quotes + 1] = 1
    turns[0] = quoted
    inside = np.bitwise_xor.accumulate(turns)[:-1] == 1
    opening, closing = (raw == 0x7B) | (raw == 0x5B), (raw == 0x7D) | (raw == 0x5D)
    places = np.flatnonzero((opening | closing) & ~inside)
    return places, np.where(opening[places], 1, -1), bool((len(quotes) + quoted) % 2)


def _slashes_before(file, start: int) -> int:
    n = 0
    while start - n > 0:
        size = min(64, start - n)
        file.seek(start - n - size)
        tail = file.read(size)
        kept = len(tail) - len(tail.rstrip(b"\\"))
        n += kept
        if kept < size:
            break
    return n


class JsonStructureSource(DataSource):
    """What each byte range of a JSON file does to the nesting, whether it begins inside a string or not."""

    @classmethod
    def name(cls) -> str:
        return "json_structure"

    def schema(self) -> str:
        return "path string, start bigint, stop bigint, flips boolean, outside bigint, inside bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return JsonStructureReader(dict(self.options))


class JsonStructureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.block = options["path"], int(options["block"])

    def partitions(self) -> list[InputPartition]:
        parts = []
        for path in _files(self.path):
            system, inner = _opened(path)
            size = system.get_file_info(inner).size
            parts += [JsonPart(path, a, min(a + self.block, size)) for a in range(0, size, self.block)]
        return parts

    def read(self, partition: JsonPart) -> Iterator[tuple]:
        system, inner = _opened(partition.path)
        with system.open_input_file(inner) as file:
            escapes = _slashes_before(file, partition.start)
            file.seek(partition.start)
            data = file.read(partition.end - partition.start)
        (_, out, flips), (_, within, _) = structure(data, False, escapes), structure(data, True, escapes)
        yield partition.path, partition.start, partition.end, flips, int(out.sum()), int(within.sum())


class JsonElementSource(DataSource):
    """``value``: objects that stand at a given depth, one a row, from byte ranges whose state at the beginning is known."""

    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return JsonElementReader(dict(self.options))


class JsonElementReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.depth = int(options["depth"])
        fields = [line.split("\t") for line in options["ranges"].split("\n") if line]
        self.ranges = [JsonPart(p, int(a), int(b), q == "1", int(d)) for p, a, b, q, d in fields]

    def partitions(self) -> list[InputPartition]:
        return list(self.ranges)

    def read(self, partition: JsonPart) -> Iterator[pa.RecordBatch]:
        system, inner = _opened(partition.path)
        with system.open_input_file(inner) as file:
            size = file.size()
            escapes = _slashes_before(file, partition.start)
            file.seek(partition.start)
            data = file.read(partition.end - partition.start)
            while True:  # until the element that begins last is whole
                places, turn, _ = structure(data, partition.quoted, escapes)
                level = partition.depth + np.cumsum(turn)
                raw = np.frombuffer(data, dtype=np.uint8)
                begins = places[(turn == 1) & (level == self.depth) & (raw[places] == 0x7B)]
                begins = begins[begins < partition.end - partition.start]
                ends = places[(turn == -1) & (level == self.depth - 1) & (raw[places] == 0x7D)]
                if not len(begins) or (len(ends) and ends[-1] > begins[-1]):
                    break
                if partition.start + len(data) >= size:
                    raise ValueError(f"{partition.path} ends inside an element")
                data += file.read(max(LOOK_AHEAD, len(data) - (partition.end - partition.start)))
        stops = ends[np.searchsorted(ends, begins)] + 1 if len(begins) else begins
        for a in range(0, len(begins), 1000):
            spans = zip(begins[a : a + 1000].tolist(), stops[a : a + 1000].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([data[x:y].decode() for x, y in spans], pa.string())], ["value"])


def json_elements(spark: SparkSession, path: str, depth: int, *, block: int = BLOCK_BYTES) -> DataFrame:
    """Objects at ``depth`` (the document itself is at 1) of JSON files of any size, as text in ``value``.

    Each byte range is first read for its effect on quotes and nesting; combined in order, these effects give the state at
    the beginning of every range, one row each on the driver. Then all ranges are read at once.
    """
    spark.dataSource.register(JsonStructureSource)
    spark.dataSource.register(JsonElementSource)
    found = spark.read.format("json_structure").option("path", path).option("block", block).load().orderBy("path", "start").collect()
    lines, state = [], {}
    for r in found:
        quoted, level = state.get(r["path"], (False, 0))
        lines.append(f"{r['path']}\t{r['start']}\t{r['stop']}\t{int(quoted)}\t{level}")
        state[r["path"]] = quoted ^ r["flips"], level + (r["inside"] if quoted else r["outside"])
    broken = [p for p, s in state.items() if s != (False, 0)]
    if broken:
        raise ValueError(f"not a whole JSON document: {broken}")
    return spark.read.format("json_elements").option("depth", depth).option("ranges", "\n".join(lines)).load()
