"""Formats of documents that can be registered: readers, streams and writers of a Spark data source.

register() puts a format before all that were registered earlier, and the data source goes by the first that supports
a path. A format says how a file is cut into pieces, so that a large one is read by several tasks, and yields the rows of
a piece as they come. Files are reached by their file system's address, or by a path that all machines see.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from leafwork.sources.files import GLYPH_SCHEMA, RECORD

#: The data source's name, for spark.read.format().
NAME = "leafwork"
#: Bytes of a piece of a file that can be cut.
PIECE_BYTES = 32 << 20
#: Bytes that a task reads at once.
READ_BYTES = 1 << 20


class Format:
    """One kind of file. Subclasses say which paths they support, their columns, and their rows."""

    name = ""
    schema = ""
    #: Whether pieces of a file can be read apart.
    cut = False

    def supports(self, path: str) -> bool:
        raise NotImplementedError

    def rows(self, file, path: str, low: int, high: int) -> Iterator[tuple]:
        """The rows that begin in the bytes low to high of an open file."""
        raise NotImplementedError

    def write(self, rows: Iterator, out) -> None:
        raise ValueError(f"{self.name} can't be written")


class GlyphFiles(Format):
    """Compressed glyph records, decompressed and parsed as they come; a file with a broken end gives what stands before it."""

    name, schema = "glyphs", GLYPH_SCHEMA

    def supports(self, path: str) -> bool:
        return path.endswith((".glyphs.gz", ".glyph.gz"))

    def rows(self, file, path: str, low: int, high: int) -> Iterator[tuple]:
        open_, held, head = zlib.decompressobj(31), b"", struct.calcsize(RECORD)
        while data := file.read(READ_BYTES):
            try:
                held += open_.decompress(data)
            except zlib.error:
                return
            at = 0
            while at + head <= len(held):
                code, n, width, height = struct.unpack_from(RECORD, held, at)
                if width < 0 or height < 0:
                    return
                if at + head + width * height > len(held):
                    break
                yield path, code, n, width, height, held[at + head : at + head + width * height]
                at += head + width * height
            held = held[at:]

    def write(self, rows: Iterator, out) -> None:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        for r in rows:
            out.write(pack.compress(struct.pack(RECORD, r["unicode"], r["n"], r["width"], r["height"]) + bytes(r["bitmap"])))
        out.write(pack.flush())


class WorkLists(Format):
    """Tab-separated lines of five columns after a header; # starts a comment; lines of other widths are left out.

    A piece has the lines that begin in it, so a list is cut anywhere.
    """

    name, schema, cut = "worklist", "path string, citation string, accession string, updated string, license string", True

    def supports(self, path: str) -> bool:
        return path.endswith((".worklist.tsv", ".filelist.tsv"))

    def rows(self, file, path: str, low: int, high: int) -> Iterator[tuple]:
        for at, line in lines(file, max(low - 1, 0), high, skip=low > 0):
            fields = line.decode("utf-8", "replace").rstrip("\r").split("\t")
            if at and not line.startswith(b"#") and len(fields) == 5:
                yield tuple(x or None for x in fields)

    def write(self, rows: Iterator, out) -> None:
        out.write(b"path\tcitation\taccession\tupdated\tlicense\n")
        for r in rows:
            out.write(("\t".join(" ".join((x or "").split()) for x in r) + "\n").encode())


def lines(file, low: int, high: int, skip: bool) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin before high; skip: the rest of the line at low is another piece's."""
    file.seek(low)
    held, at = b"", low
    while at < high:
        end = held.find(b"\n")
        if end < 0:
            data = file.read(READ_BYTES)
            if not data:
                if held and not skip:
                    yield at, held
                return
            held += data
            continue
        if not skip:
            yield at, held[:end]
        skip, at, held = False, at + end + 1, held[end + 1 :]


#: Formats from the first registered to the last; the last that supports a path reads it.
FORMATS: list[Format] = [WorkLists(), GlyphFiles()]


@dataclass
class Piece(InputPartition):
    path: str
    name: str
    low: int
    high: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[fs.FileInfo]:
    """The files at or below a path by name, without hidden and unfinished ones; none if there is nothing."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


def format_of(formats: list[Format], path: str, name: str | None) -> Format:
    """The format registered last that supports a path, or has the given name."""
    for f in reversed(formats):
        if f.name == name if name else f.supports(path):
            return f
    raise ValueError(f"no registered format reads {path}")


def planned(files: list[fs.FileInfo], formats: list[Format], name: str | None, piece: int) -> list[Piece]:
    """A piece for each file, or several for a large one whose format can be cut."""
    out = []
    for f in files:
        kind = format_of(formats, f.path, name)
        step = piece if kind.cut else max(f.size, 1)
        out += [Piece(f.path, kind.name, low, min(f.size, low + step)) for low in range(0, f.size, step)]
    return out


def read_piece(part: Piece, formats: list[Format], path: str) -> Iterator[tuple]:
    system, _ = opened(path)
    with system.open_input_file(part.path) as file:
        yield from format_of(formats, part.path, part.name).rows(file, part.path, part.low, part.high)


def source_of(formats: list[Format]) -> type[DataSource]:
    """The data source of these formats; Spark sends it to the tasks with them."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.path, self.name, self.piece = options["path"], options.get("kind"), int(options.get("pieceBytes", PIECE_BYTES))

        def partitions(self) -> list[Piece]:
            return planned(listed(self.path), formats, self.name, self.piece) or [Piece("", "", 0, 0)]

        def read(self, partition: Piece) -> Iterator[tuple]:
            return read_piece(partition, formats, self.path) if partition.path else iter(())

    class StreamReader(DataSourceStreamReader):
        """Files in the order in which they were finished, some at a time; an offset is the last one's time and path.

        A file must be put in its folder whole, and not with a time before that of files already there.
        """

        def __init__(self, options: dict) -> None:
            self.path, self.name, self.piece = options["path"], options.get("kind"), int(options.get("pieceBytes", PIECE_BYTES))

        def initialOffset(self) -> dict:
            return {"time": -1, "path": ""}

        def latestOffset(self) -> dict:
            place = max(((f.mtime_ns, f.path) for f in listed(self.path)), default=(-1, ""))
            return {"time": place[0], "path": place[1]}

        def partitions(self, start: dict, end: dict) -> list[Piece]:
            low, high = ((x["time"], x["path"]) for x in (start, end))
            return planned([f for f in listed(self.path) if low < (f.mtime_ns, f.path) <= high], formats, self.name, self.piece)

        def read(self, partition: Piece) -> Iterator[tuple]:
            return read_piece(partition, formats, self.path)

        def commit(self, end: dict) -> None:
            pass

    @dataclass
    class Written(WriterCommitMessage):
        path: str

    class Writer(DataSourceWriter):
        """A file for each task, under a hidden name until all tasks are done."""

        def __init__(self, options: dict, overwrite: bool) -> None:
            self.path, self.kind, self.overwrite = options["path"], format_of(formats, f"x{options.get('suffix', '')}", options.get("kind")), overwrite
            self.suffix = options.get("suffix", "")

        def write(self, iterator: Iterator) -> Written:
            system, at = opened(self.path)
            system.create_dir(at, recursive=True)
            name = f"{at.rstrip('/')}/.{uuid.uuid4().hex}{self.suffix}"
            with system.open_output_stream(name, compression=None) as out:
                self.kind.write(iterator, out)
            return Written(name)

        def commit(self, messages: list) -> None:
            system, at = opened(self.path)
            done = [m.path for m in messages if m]
            if self.overwrite:
                for f in listed(self.path):
                    system.delete_file(f.path)
            for name in done:
                folder, _, base = name.rpartition("/")
                system.move(name, f"{folder}/part-{base[1:]}")

        def abort(self, messages: list) -> None:
            system, _ = opened(self.path)
            for m in messages:
                if m:
                    system.delete_file(m.path)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return NAME

        def schema(self) -> str:
            path, name = self.options["path"], self.options.get("kind")
            files = [] if name else listed(path)
            return format_of(formats, files[0].path if files else path, name).schema

        def reader(self, schema) -> Reader:
            return Reader(self.options)

        def streamReader(self, schema) -> StreamReader:
            return StreamReader(self.options)

        def writer(self, schema, overwrite: bool) -> Writer:
            return Writer(self.options, overwrite)

    return Source


def register(spark: SparkSession, *formats: Format) -> None:
    """Puts formats before those registered so far, and tells the session.

    Without any, the session gets those that there are. Readers: format("leafwork").load(path), with the options kind, a
    format's name, instead of a choice by path, and pieceBytes. Writers: the option suffix, by which a format is chosen
    unless kind is given. A path that no format supports is an error.
    """
    FORMATS.extend(formats)
    spark.dataSource.register(source_of(list(FORMATS)))
