"""Collected files as a data source, in batch and as a stream that goes on from where it was.

``spark.read.format("collected")`` and ``spark.readStream.format("collected")`` give one row for each record of the CSV files, archives of
CSV files, feeds and site maps below a folder. Register it first: ``spark.dataSource.register(Collected)``.

The stream's offset is a number of entries of a log, in which the driver notes every new file before it gives out an offset that holds it.
So an offset means the same files for ever, whatever has arrived since, and a batch that is run again gives the same rows. What was
committed is noted after the sink has taken it: it is the checkpoint that the source's owner can read.

Options: ``path`` (folder, any file system that Arrow knows), ``kind`` (csv, archive, feed, sitemap), ``log`` (shared folder, streams only),
``delimiter`` (comma), ``partition_bytes``, ``required`` (columns that every header must have, with commas), and limits of an archive: ``most_members``,
``most_bytes`` (of all its members), ``most_ratio`` (of size to packed size). What breaks a limit or lacks a column raises ``Refused``.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, pos long, record map<string,string>"
PARTITION_BYTES = 64 << 20
MOST_MEMBERS, MOST_BYTES, MOST_RATIO = 1000, 16 << 30, 200
KINDS = ("csv", "archive", "feed", "sitemap")


class Refused(Exception):
    """A file that is not as it must be; the message begins with a code."""


class Piece(InputPartition):
    """A part of a file: a range of bytes of a CSV file, a member of an archive, or the whole."""

    def __init__(self, file: str, start: int = 0, end: int | None = None, member: str | None = None) -> None:
        super().__init__((file, start, end, member))


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system, inner


def _files(path: str) -> list[tuple[int, str, int]]:
    """(time of change, path, size) of the files below a folder, hidden ones left out, in order."""
    from pyarrow import fs

    system, inner = _open(path)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    return sorted((i.mtime_ns or 0, i.path, i.size or 0) for i in found if i.is_file and not i.base_name.startswith((".", "_")))


class Pieces:
    """How the files of one source are cut and read."""

    def __init__(self, options: dict) -> None:
        self.path, self.kind, self.delimiter = options["path"], options.get("kind", "csv"), options.get("delimiter", ",")
        if self.kind not in KINDS:
            raise Refused(f"unknown_kind: {self.kind}")
        number = lambda name, default: int(options.get(name, default))
        self.piece_bytes, self.most_members, self.most_bytes, self.most_ratio = number("partition_bytes", PARTITION_BYTES), number("most_members", MOST_MEMBERS), number("most_bytes", MOST_BYTES), number("most_ratio", MOST_RATIO)
        self.required = [c for c in options.get("required", "").split(",") if c]

    def cut(self, files: list[tuple[str, int]]) -> list[Piece]:
        """Partitions of some files: CSV files by ranges of bytes, archives by member, others whole."""
        out: list[Piece] = []
        for file, size in files:
            if self.kind == "csv":
                out += [Piece(file, at, min(at + self.piece_bytes, size)) for at in range(0, size, self.piece_bytes)]
            elif self.kind == "archive":
                out += [Piece(file, member=m) for m in self._members(file)]
            else:
                out.append(Piece(file))
        return out

    def _members(self, file: str) -> list[str]:
        """Names of the CSV files in an archive, after its directory has been judged; its content is not read."""
        system, _ = _open(self.path)
        with system.open_input_file(file) as f, zipfile.ZipFile(f) as z:
            told = [i for i in z.infolist() if not i.is_dir()]
        if len(told) > self.most_members:
            raise Refused(f"too_many_members: {file} has {len(told)}")
        for i in told:
            if i.flag_bits & 1:
                raise Refused(f"encrypted_member: {file}!{i.filename}")
            if i.filename.startswith("/") or ".." in i.filename.split("/"):
                raise Refused(f"unsafe_member: {file}!{i.filename}")
            if i.file_size > self.most_ratio * max(i.compress_size, 1):
                raise Refused(f"packed_too_tightly: {file}!{i.filename}")
        if sum(i.file_size for i in told) > self.most_bytes:
            raise Refused(f"too_large: {file}")
        return sorted(i.filename for i in told if i.filename.lower().endswith(".csv"))

    def rows(self, piece: Piece | None) -> Iterator[tuple[str, int, dict]]:
        if piece is None:  # what Spark gives where there is no file
            return
        file, start, end, member = piece.value
        system, _ = _open(self.path)
        if self.kind == "csv":
            yield from self._csv_range(system, file, start, end)
        elif self.kind == "archive":
            with system.open_input_file(file) as f, zipfile.ZipFile(f) as z, z.open(member) as m:
                yield from self._csv(f"{file}!{member}", io.TextIOWrapper(m, "utf-8-sig", "replace", newline=""))
        else:
            from evistrata.functions import html

            with system.open_input_stream(file) as f:
                text = f.read().decode("utf-8", "replace")
            if self.kind == "feed":
                for i, (link, title, published) in enumerate(html.feed(text)):
                    yield file, i, {"link": link, "title": title, "published": published}
            else:
                for i, (kind, link) in enumerate(html.site_map(text)):
                    yield file, i, {"kind": kind, "link": link}

    def _header(self, name: str, header: list[str]) -> list[str]:
        lost = [c for c in self.required if c not in header]
        if lost or len(set(header)) < len(header):
            raise Refused(f"wrong_header: {name} lacks {', '.join(lost) or 'distinct names'}")
        return header

    def _csv(self, name: str, lines) -> Iterator[tuple[str, int, dict]]:
        told = csv.reader(lines, delimiter=self.delimiter)
        header = self._header(name, next(told, self.required))
        for i, values in enumerate(told):
            if values:
                yield name, i, self._record(name, header, values)

    @staticmethod
    def _record(name: str, header: list[str], values: list[str]) -> dict:
        if len(values) != len(header):
            raise Refused(f"wrong_row: {name} has {len(values)} values for {len(header)} columns")
        return dict(zip(header, values, strict=True))

    def _csv_range(self, system, file: str, start: int, end: int) -> Iterator[tuple[str, int, dict]]:
        """Records that begin in a range of bytes, one to a line; ``pos`` is where a record begins. A range goes on to the end of its last line."""
        with system.open_input_file(file) as f:
            lines = _lines(f, 0)
            first = next(lines, (0, b""))
            header = self._header(file, next(csv.reader([first[1].decode("utf-8-sig", "replace")], delimiter=self.delimiter), self.required))
            after = first[0] + len(first[1])
            lines = lines if start <= after else _lines(f, start - 1, skip=True)
            for at, line in lines:
                if at >= end:
                    break
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if at >= start and text:
                    yield file, at, self._record(file, header, next(csv.reader([text], delimiter=self.delimiter)))


def _lines(f, at: int, skip: bool = False, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(start, line with its end) from a place on; with ``skip`` from the first line that begins after it."""
    f.seek(at)
    rest = b""
    while chunk := f.read(block):
        rest += chunk
        while (cut := rest.find(b"\n")) >= 0:
            if not skip:
                yield at, rest[: cut + 1]
            skip, at, rest = False, at + cut + 1, rest[cut + 1 :]
    if rest and not skip:
        yield at, rest


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.pieces = Pieces(options)

    def partitions(self) -> list[Piece]:
        return self.pieces.cut([(file, size) for _, file, size in _files(self.pieces.path)])

    def read(self, partition: Piece) -> Iterator[tuple[str, int, dict]]:
        return self.pieces.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.pieces, self.log = Pieces(options), options["log"]

    def _notes(self) -> list[tuple[str, int]]:
        """All files noted so far, in the order of the log."""
        system, inner = _open(self.log)
        out = []
        for _, name, _ in sorted(_files(f"{self.log}/entries"), key=lambda x: x[1]):
            with system.open_input_stream(name) as f:
                out += [tuple(x) for x in json.loads(f.read())]
        return out

    def _write(self, name: str, told) -> None:
        """A small file, moved into place when it is whole."""
        system, inner = _open(self.log)
        target = f"{inner}/{name}"
        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(f"{target.rsplit('/', 1)[0]}/.{target.rsplit('/', 1)[1]}") as f:
            f.write(json.dumps(told).encode())
        system.move(f"{target.rsplit('/', 1)[0]}/.{target.rsplit('/', 1)[1]}", target)

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        noted = self._notes()
        known = {f for f, _ in noted}
        fresh = [(file, size) for _, file, size in _files(self.pieces.path) if file not in known]
        if fresh:
            self._write(f"entries/{len(noted):012d}.json", fresh)
        return {"entries": len(noted) + len(fresh)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return self.pieces.cut(self._notes()[start["entries"] : end["entries"]])

    def read(self, partition: Piece) -> Iterator[tuple[str, int, dict]]:
        return self.pieces.rows(partition)

    def commit(self, end: dict) -> None:
        """Called when the sink has taken everything up to ``end``."""
        self._write("committed.json", end)


class Collected(DataSource):
    """The data source; see the module."""

    @classmethod
    def name(cls) -> str:
        return "collected"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def checkpoint(log: str) -> int:
    """The number of files that a stream's sink has taken for good."""
    system, inner = _open(log)
    try:
        with system.open_input_stream(f"{inner}/committed.json") as f:
            return json.loads(f.read())["entries"]
    except FileNotFoundError:
        return 0
