"""Ledgers in zip archives, as a Spark data source: a member is an input partition, read as a stream."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Separators of the members that are ledgers; others are left out.
SEPARATORS = {".csv": ",", ".txt": "\t"}
#: Rows of a batch.
ROWS = 10_000


def opened(path: str) -> zipfile.ZipFile:
    """An archive at a local path or a URI that Arrow's file systems know; only what is read is fetched."""
    system, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return zipfile.ZipFile(system.open_input_file(inside))


def members(archive: zipfile.ZipFile) -> list[str]:
    names = (i.filename for i in archive.infolist() if not i.is_dir() and not i.filename.startswith("__MACOSX/"))
    return sorted(n for n in names if n[-4:].lower() in SEPARATORS)


def lines(archive: zipfile.ZipFile, member: str, encoding: str) -> Iterator[list[str]]:
    with archive.open(member) as raw:
        yield from csv.reader(io.TextIOWrapper(raw, encoding, newline=""), delimiter=SEPARATORS[member[-4:].lower()])


class Member(InputPartition):
    def __init__(self, path: str, name: str):
        super().__init__((path, name))


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str], encoding: str, columns: list[str]):
        self.paths, self.encoding, self.columns = paths, encoding, columns

    def partitions(self) -> list[InputPartition]:
        found = []
        for path in self.paths:
            with opened(path) as archive:
                found += [Member(path, name) for name in members(archive)]
        return found

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, name = partition.value
        with opened(path) as archive:
            rows = lines(archive, name, self.encoding)
            at = {c: i for i, c in reversed(list(enumerate(h.strip() for h in next(rows, []))))}  # of a repeated header the first
            places = [at.get(c, -1) for c in self.columns]
            held: list[list[str]] = []
            for row in rows:
                if any(row):
                    held.append(row)
                if len(held) == ROWS:
                    yield self._batch(held, places)
                    held = []
            yield self._batch(held, places)

    def _batch(self, rows: list[list[str]], places: list[int]) -> pa.RecordBatch:
        columns = [pa.array([r[p] if 0 <= p < len(r) and r[p] != "" else None for r in rows], pa.string()) for p in places]
        return pa.RecordBatch.from_arrays(columns, names=self.columns)


class ArchiveSource(DataSource):
    """Options: paths, a JSON list of archives; encoding (utf-8-sig). All columns are text; a member's missing ones are null, as
    are empty fields; empty lines and empty members give no rows."""

    @classmethod
    def name(cls) -> str:
        return "ledger_zip"

    def _given(self) -> tuple[list[str], str]:
        return json.loads(self.options["paths"]), self.options.get("encoding", "utf-8-sig")

    def schema(self) -> str:
        """The members' headers, in order of first sight: only first lines are read."""
        paths, encoding = self._given()
        headers: dict[str, None] = {}
        for path in paths:
            with opened(path) as archive:
                for name in members(archive):
                    headers |= dict.fromkeys(h.strip() for h in next(lines(archive, name, encoding), []) if h.strip())
        return ", ".join(f"`{h.replace('`', '``')}` string" for h in headers)

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(*self._given(), [f.name for f in schema.fields])
