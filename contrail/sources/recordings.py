"""Text recordings as a Spark data source: byte ranges of plain files, members of archives, and files that still grow.

    spark.dataSource.register(recordings.Recordings)
    lines = spark.read.format("recording").option("path", "store/flights").load()
    telemetry = recorder.telemetry(lines)

Rows are ``file, line_no, line, error``, as ``recorder`` takes them. ``line_no`` is the place of the line's first byte in its
recording, so that it orders lines without anybody having counted them. Lines are stripped, and bytes that are no UTF-8
ignored. A plain file is cut into ranges of about ``splitBytes``; a range has the lines that begin in it, so each line is read
once whatever the ranges. Of an archive each recording (``members`` = ``all``) or the first one is a task of its own; an archive
that cannot be read, or has no recording, gives one row with what is wrong. Paths are whatever pyarrow's file systems open.

As a stream, a file's offset is the end of its last whole line, so a batch that is run again reads the same bytes, and no line
is read before it is complete or twice. Archives do not grow and are left out of streams.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, line_no long, line string, error string"

#: A recording's file name ends in this.
SUFFIX = ".acmi"

#: What a file that is no whole archive makes the standard library (over an Arrow file) raise.
_BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, pa.ArrowInvalid)

_CHUNK = 1 << 20
_ROWS = 8192


@dataclass
class Part(InputPartition):
    """A range of bytes of a file, or a member of an archive."""

    path: str
    start: int = 0
    end: int | None = None
    member: str | None = None


def _opened(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def files(path: str) -> list[tuple[str, int]]:
    """All files at a path, hidden ones left out, with their sizes."""
    remote = "://" in path or path.startswith("file:")
    system, name = fs.FileSystem.from_uri(path) if remote else (fs.LocalFileSystem(), path)
    info = system.get_file_info(name)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True))
    kept = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    prefix = path.split("://", 1)[0] + "://" if remote and "://" in path else ""
    return sorted((f"{prefix}{f.path}" if prefix else f.path, f.size) for f in kept)


def _is_archive(path: str) -> bool:
    with _opened(path) as f:
        return f.read(2) == b"PK"


def lines_between(f, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the lines that begin at ``start`` or later and before ``end``; ``f`` can seek or is at its start."""
    at, held = start, b""
    if start:
        f.seek(start - 1)  # a line begins at start only if a line end is before it
        at, skip = start - 1, True
    else:
        skip = False
    while True:
        chunk = f.read(_CHUNK)
        if not chunk:
            break
        whole, _, held = (held + chunk).rpartition(b"\n") if b"\n" in chunk else (b"", b"", held + chunk)
        if b"\n" not in chunk:
            continue
        for line in whole.split(b"\n"):
            if not skip:
                if end is not None and at >= end:
                    return
                yield at, line
            skip = False
            at += len(line) + 1
    if held and not skip and (end is None or at < end):
        yield at, held


def _batches(file: str, lines: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    def batch(places: list, texts: list) -> pa.RecordBatch:
        n = len(places)
        return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.string()), pa.nulls(n, pa.string())], ["file", "line_no", "line", "error"])

    places, texts = [], []
    for place, raw in lines:
        places.append(place)
        texts.append(raw.decode("utf-8", "ignore").strip())
        if len(places) == _ROWS:
            yield batch(places, texts)
            places, texts = [], []
    if places:
        yield batch(places, texts)


def _failed(file: str, what: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([0], pa.int64()), pa.nulls(1, pa.string()), pa.array([str(what)])], ["file", "line_no", "line", "error"])


def read_part(part: Part, members: str) -> Iterator[pa.RecordBatch]:
    """The lines of a part."""
    with _opened(part.path) as f:
        if part.member is None:
            yield from _batches(part.path, lines_between(f, part.start, part.end))
            return
        name = part.path if members == "first" else f"{part.path}!{part.member}"
        try:
            with zipfile.ZipFile(f) as archive, archive.open(part.member) as member:
                yield from _batches(name, lines_between(member, 0, None))
        except _BROKEN as e:
            yield _failed(name, e)


def ranges(path: str, start: int, end: int, size: int) -> list[Part]:
    """Ranges of about ``size`` bytes."""
    return [Part(path, a, min(a + size, end)) for a in range(start, end, size)]


class Reader(DataSourceReader):
    """Reads all recordings at a path."""

    def __init__(self, options: dict):
        self.path, self.size, self.members = options["path"], int(options.get("splitbytes", 64 << 20)), options.get("members", "first")

    def partitions(self) -> list[Part]:
        out = []
        for path, size in files(self.path):
            if not _is_archive(path):
                out += ranges(path, 0, size, self.size)
                continue
            try:
                with _opened(path) as f, zipfile.ZipFile(f) as archive:
                    names = [n for n in archive.namelist() if n.endswith(SUFFIX)]
            except _BROKEN as e:
                names, error = [], str(e) or type(e).__name__
            else:
                error = "no recording in the archive"
            out += [Part(path, member=n) for n in (names if self.members == "all" else names[:1])] or [Part(path, member=f"!{error}")]
        return out or [Part("")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.member is not None and part.member.startswith("!"):
            yield _failed(part.path, part.member[1:])
        elif part.path:
            yield from read_part(part, self.members)


def whole_lines(path: str, size: int) -> int:
    """Where the last whole line of a file's first ``size`` bytes ends."""
    with _opened(path) as f:
        end = size
        while end > 0:
            begin = max(0, end - _CHUNK)
            f.seek(begin)
            cut = f.read(end - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            end = begin
    return 0


class StreamReader(DataSourceStreamReader):
    """Reads what is added to plain recordings at a path. An offset is a place in each file."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("splitbytes", 64 << 20))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {p: whole_lines(p, n) for p, n in files(self.path) if not _is_archive(p)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [r for p, to in sorted(end.items()) for r in ranges(p, start.get(p, 0), to, self.size)] or [Part("")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from read_part(part, "first")


class Recordings(DataSource):
    """The data source ``recording``. Options: ``path``, ``splitBytes``, ``members`` (``first`` or ``all``)."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict:
        options = {k.lower(): v for k, v in self.options.items()}
        if "path" not in options:
            raise ValueError("the option path is missing")
        return options

    def reader(self, schema) -> Reader:
        return Reader(self._options())

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self._options())
