"""Files read as streams inside tasks: byte blocks, and members of archives as a Spark data source."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at once, and rows of a batch.
BLOCK_BYTES, BATCH_ROWS = 8 << 20, 50_000
#: Schemes whose files a task can open by itself; others are only read by Spark.
SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs"}


def streamed_uri(path: str) -> str | None:
    """The address under which a task can open ``path``, or None where only Spark reaches it."""
    found = re.match(r"([a-z][a-z0-9+.-]*):/*", path)
    if found is None:
        return path if path.startswith("/") else None
    scheme = SCHEMES.get(found[1])
    rest = path[found.end() :]
    return None if scheme is None else f"/{rest}" if scheme == "file" else f"{scheme}://{rest}"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and name; names of local files are taken as they are, with blanks and signs."""
    uri = streamed_uri(path)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def blocks(path: str) -> Iterator[bytes]:
    """The bytes of a file, a block at a time."""
    system, name = located(path)
    with system.open_input_stream(name, compression=None) as stream:
        while block := stream.read(BLOCK_BYTES):
            yield block


def member_of(names: list[str], table: str) -> str:
    """The member ``<table>.txt`` or ``.tsv`` of an archive, in any case of letters."""
    found = {n.lower(): n for n in names}
    return next(found[n] for n in (f"{table.lower()}.txt", f"{table.lower()}.tsv") if n in found)


def tsv_batches(raw, columns: list[str]) -> Iterator[pd.DataFrame]:
    """A TSV stream as text frames of the wanted columns; those it lacks are NULL."""
    chunks = pd.read_csv(
        raw, sep="\t", dtype=str, chunksize=BATCH_ROWS, quoting=3, usecols=lambda c: c in columns
    )
    for chunk in chunks:
        chunk = chunk.reindex(columns=columns)
        yield chunk.astype(object).where(chunk.notna(), None)


class ArchiveMember(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class ZipTableReader(DataSourceReader):
    """One partition per archive; a task opens it, reads its directory and streams one member."""

    def __init__(self, paths: list[str], table: str, columns: list[str]):
        self.paths, self.table, self.columns = paths, table, columns

    def partitions(self) -> list[ArchiveMember]:
        return [ArchiveMember(path) for path in self.paths]

    def read(self, partition: ArchiveMember) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), *[(c, pa.string()) for c in self.columns]])
        system, name = located(partition.path)
        with system.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
            with archive.open(member_of(archive.namelist(), self.table)) as raw:
                for chunk in tsv_batches(raw, self.columns):
                    chunk.insert(0, "path", partition.path)
                    yield from pa.Table.from_pandas(chunk, schema, preserve_index=False).to_batches()


class ZipTables(DataSource):
    """``format("zip_table")`` with the options ``paths`` and ``columns`` (one a line) and ``table``.

    Only the columns asked for are parsed.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_table"

    def _lines(self, option: str) -> list[str]:
        return [v for v in self.options.get(option, "").split("\n") if v]

    def schema(self) -> str:
        return ", ".join(["path string", *[f"`{c}` string" for c in self._lines("columns")]])

    def reader(self, schema) -> ZipTableReader:
        return ZipTableReader(self._lines("paths"), self.options["table"], self._lines("columns"))
