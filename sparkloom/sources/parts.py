"""A corpus in parts with a manifest, read part by part and checked while it is read."""

from __future__ import annotations

import hashlib
import io
import json
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import SourceError

#: Bytes that are read at once.
CHUNK = 1 << 20


def _open(path: str) -> io.RawIOBase:
    """A stream from any store that pyarrow knows; a path without a scheme is local."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_stream(at, compression=None)


class Part(InputPartition):
    def __init__(self, number: int, path: str, sha256: str):
        self.number, self.path, self.sha256 = number, path, sha256


def lines_of(path: str, sha256: str, header: bool) -> Iterator[tuple[int, str]]:
    """(number, line) of a gzip or plain text part, without its line ends; the first line goes if it repeats the header.

    The digest is of the file as it is stored. It is known at the end, so the
    last line is held back until it is right: a wrong part fails its task.
    """
    digest, inflate = hashlib.sha256(), zlib.decompressobj(31) if path.endswith(".gz") else None
    rest, number, last = b"", 0, None
    with _open(path) as stream:
        while chunk := stream.read(CHUNK):
            digest.update(chunk)
            while chunk:
                if inflate:
                    # A chunk may hold much more than it is long.
                    data = inflate.decompress(chunk, CHUNK)
                    chunk = inflate.unconsumed_tail or inflate.unused_data
                    if inflate.eof:
                        inflate = zlib.decompressobj(31)  # gzip members may follow each other
                else:
                    data, chunk = chunk, b""
                *whole, rest = (rest + data).split(b"\n")
                for raw in whole:
                    if not (number == 0 and header):
                        if last is not None:
                            yield last
                        last = number, raw.removesuffix(b"\r").decode("utf-8", "replace")
                    number += 1
    if rest and not (number == 0 and header):
        if last is not None:
            yield last
        last = number, rest.removesuffix(b"\r").decode("utf-8", "replace")
    if digest.hexdigest() != sha256.lower():
        raise SourceError(f"{path} differs from its manifest")
    if last is not None:
        yield last


class ManifestReader(DataSourceReader):
    def __init__(self, manifest: str):
        self.folder = manifest.rpartition("/")[0]
        with _open(manifest) as stream:
            self.parts = json.loads(stream.read())["parts"]

    def partitions(self) -> list[Part]:
        return [Part(i, f"{self.folder}/{p['file']}", p["sha256"]) for i, p in enumerate(self.parts)]

    def read(self, partition: Part) -> Iterator[tuple[int, int, str]]:
        for number, line in lines_of(partition.path, partition.sha256, header=partition.number > 0):
            yield partition.number, number, line


class ManifestParts(DataSource):
    """``spark.read.format("manifest_parts").load(".../manifest.json")``: part, line_no and line, one task a part.

    The manifest lists ``parts``, each with ``file`` (beside it) and ``sha256``.
    Order by part and line_no is the order of the corpus; headers of all parts
    but the first are left out. A part is never held whole, however large, and
    one that differs from its digest fails the read.
    """

    @classmethod
    def name(cls) -> str:
        return "manifest_parts"

    def schema(self) -> str:
        return "part int, line_no long, line string"

    def reader(self, schema) -> ManifestReader:
        return ManifestReader(self.options["path"])
