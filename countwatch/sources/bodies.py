"""Stored bodies as a data source: one partition per file or zip member, streamed.

``spark.read.format("countwatch_bodies")`` plans on the driver, which lists the files and reads zip directories only; each
partition then opens its own body and passes it on piece by piece, so a body may be larger than a task's memory or than two
gigabytes. Options: ``path`` (file or folder), ``pattern`` (of file names, default ``*``), ``member`` (of names inside zips,
default ``*``), and ``yields``:

- ``hash``: a row (path, member, bytes, sha256) per body, unpacked where the name ends in ``.gz`` or lies in a zip. A gzip
  body may have several members, and zero padding between them.
- ``items``: a row (path, member, place, item) per element of a JSON body's ``results`` array, each element as JSON text.

A body that ends too soon is an error and names its file. A packed body is a sequential stream, so one is one task, however long. Files are opened through
Arrow's file systems; for a store that only Spark's own readers reach, ``reachable`` is false.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from countwatch.session import ship

PIECE = 1 << 20
SCHEMAS = {
    "hash": "path string, member string, bytes bigint, sha256 string",
    "items": "path string, member string, place bigint, item string",
}


class Body(InputPartition):
    """A file (``member`` is empty) or a member of a zip."""

    def __init__(self, path: str, member: str) -> None:
        super().__init__((path, member))
        self.path, self.member = path, member


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/") if path.startswith("file:") else path)
    return fs.LocalFileSystem(), path


def reachable(path: str) -> bool:
    """Whether Arrow opens what lies at ``path``."""
    try:
        store, place = located(path)
        return store.get_file_info(place).type != fs.FileType.NotFound
    except Exception:  # no such scheme, or its library is absent
        return False


def files_below(path: str, pattern: str) -> list[str]:
    """The files at or below ``path`` whose name fits, in order."""
    store, place = located(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    found = store.get_file_info(fs.FileSelector(place, recursive=True))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


def pieces(path: str, member: str = "") -> Iterator[bytes]:
    """The unpacked body, piece by piece."""
    store, place = located(path)
    with store.open_input_file(place) as raw:
        if member:
            with zipfile.ZipFile(raw) as z, z.open(member) as body:
                while piece := body.read(PIECE):
                    yield piece
        elif path.endswith(".gz"):
            yield from unpacked(raw, path)
        else:
            while piece := raw.read(PIECE):
                yield piece


def unpacked(raw, name: str) -> Iterator[bytes]:
    """All members of a gzip stream; what is held is a piece and its share of output."""
    member, rest = None, b""
    while True:
        packed = rest or raw.read(PIECE)
        rest = b""
        if not packed:
            if member is not None:
                raise EOFError(f"{name}: a gzip body ends inside a member")
            return
        if member is None:
            packed = packed.lstrip(b"\0")
            if not packed:
                continue
            member = zlib.decompressobj(wbits=31)
        while True:
            out = member.decompress(packed, PIECE)
            if out:
                yield out
            packed = member.unconsumed_tail
            if member.eof:
                rest, member = member.unused_data, None
                break
            if not packed:
                break


class _Stream(io.RawIOBase):
    """The pieces as a file to read from."""

    def __init__(self, body: Iterator[bytes]) -> None:
        self._body, self._held = body, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self._held:
            try:
                self._held = next(self._body)
            except StopIteration:
                return 0
        n = min(len(into), len(self._held))
        into[:n], self._held = self._held[:n], self._held[n:]
        return n


class BodyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern, self.member = options["path"], options.get("pattern", "*"), options.get("member", "*")
        self.yields = options.get("yields", "hash")

    def partitions(self) -> list[Body]:
        out = []
        for path in files_below(self.path, self.pattern):
            if not path.endswith(".zip"):
                out.append(Body(path, ""))
                continue
            store, place = located(path)
            with store.open_input_file(place) as raw, zipfile.ZipFile(raw) as z:
                names = [i.filename for i in z.infolist() if not i.is_dir()]
            out += [Body(path, n) for n in names if fnmatch.fnmatch(n, self.member)]
        # A source without partitions is read once with none; that is no body.
        return out or [Body("", "")]

    def read(self, partition: Body) -> Iterator[tuple]:
        if not partition.path:
            return
        body = pieces(partition.path, partition.member)
        if self.yields == "hash":
            digest, size = hashlib.sha256(), 0
            for piece in body:
                digest.update(piece)
                size += len(piece)
            yield partition.path, partition.member, size, digest.hexdigest()
            return
        from countwatch.sources.pages import result_items

        text = io.TextIOWrapper(io.BufferedReader(_Stream(body), PIECE), encoding="utf-8")
        for place, item in enumerate(result_items(text)):
            yield partition.path, partition.member, place, item


class BodySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "countwatch_bodies"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("yields", "hash")]

    def reader(self, schema) -> BodyReader:
        return BodyReader(dict(self.options))


def read_bodies(spark: SparkSession, path: str, pattern: str = "*", yields: str = "hash", member: str = "*") -> DataFrame:
    """The source above, registered in this session."""
    if yields not in SCHEMAS:
        raise ValueError(f"yields is one of {', '.join(SCHEMAS)}")
    ship(spark)
    spark.dataSource.register(BodySource)
    return spark.read.format("countwatch_bodies").options(path=path, pattern=pattern, yields=yields, member=member).load()
