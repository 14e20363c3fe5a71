"""Files that Spark's own writers cannot write: one exact text file for each row, and
one JSON document for a table.

Tasks write beside the target, in a folder of the write's own, and move or hand over
what is whole; a repeated task writes the same again.  Paths are what pyarrow's file
systems open (local and mounted folders, object stores, HDFS), and names are kept as
they are, whatever characters they have.  A text file's name is a path below the
folder; one that leaves it is refused.  Null texts are empty files.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of the files that are read by one task and in one batch, and files of a task,
#: about; bytes that are copied at once.
TASK_BYTES, BATCH_BYTES, TASK_FILES, COPY = 64 << 20, 8 << 20, 10_000, 1 << 20
_STAGING = "_staging-"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def _below(root: str, name: str | None) -> str:
    if not name or posixpath.isabs(name) or ".." in name.split("/") or name.startswith(_STAGING):
        raise ValueError(f"not a file name below its folder: {name!r}")
    return posixpath.join(root, name)


@dataclass
class _Files(InputPartition):
    names: list[str]


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class TextFiles(DataSource):
    """A folder of files as (filename, content), and rows (filename, text) as files
    of just their text's bytes.  With the option ``contents`` set to ``no``, files are
    listed and not opened."""

    @classmethod
    def name(cls) -> str:
        return "textfiles"

    def schema(self) -> str:
        return "filename string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("contents", "yes") != "no")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str, contents: bool):
        self.path, self.contents = path, contents

    def partitions(self) -> list[_Files]:
        store, root = opened(self.path)
        out, size = [_Files([])], 0
        for x in sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda x: x.path):
            name = posixpath.relpath(x.path, root)
            if x.type != fs.FileType.File or name.startswith(_STAGING):
                continue
            size += x.size * self.contents
            if out[-1].names and (size > TASK_BYTES or len(out[-1].names) >= TASK_FILES):
                out.append(_Files([]))
                size = x.size * self.contents
            out[-1].names.append(name)
        return out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.path)
        names, contents, size = [], [], 0
        for name in partition.names:
            content = None
            if self.contents:
                with store.open_input_stream(posixpath.join(root, name)) as f:
                    content = f.read()
            names.append(name)
            contents.append(content)
            size += len(content or b"")
            if size > BATCH_BYTES:
                yield _batch(names, contents)
                names, contents, size = [], [], 0
        yield _batch(names, contents)


def _batch(names: list[str], contents: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["filename", "content"])


class _Writer(DataSourceArrowWriter):
    """Each file is written under another name and moved when it is whole, so no
    half-written file is ever seen."""

    def __init__(self, path: str, overwrite: bool):
        self.path = path
        store, root = opened(path)
        if overwrite and store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir_contents(root)
        self.staging = f"{_STAGING}{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, root = opened(self.path)
        own = posixpath.join(root, self.staging)
        store.create_dir(own, recursive=True)
        names, folders = [], set()
        for batch in batches:
            for name, text in zip(batch.column("filename").to_pylist(), batch.column("text").to_pylist(), strict=True):
                to, part = _below(root, name), posixpath.join(own, uuid.uuid4().hex)
                with store.open_output_stream(part) as f:
                    f.write((text or "").encode("utf-8"))
                if (folder := posixpath.dirname(to)) not in folders:
                    store.create_dir(folder, recursive=True)
                    folders.add(folder)
                store.move(part, to)
                names.append(name)
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        """What whole tasks have written goes."""
        store, root = opened(self.path)
        for name in {n for m in messages if m for n in m.names}:
            if store.get_file_info(at := _below(root, name)).type == fs.FileType.File:
                store.delete_file(at)
        self._clear()

    def _clear(self) -> None:
        store, root = opened(self.path)
        if store.get_file_info(own := posixpath.join(root, self.staging)).type == fs.FileType.Directory:
            store.delete_dir(own)


@dataclass
class _Part(WriterCommitMessage):
    name: str
    n: int


class JsonDocument(DataSource):
    """JSON records (a column ``value``) as one document, a record a line: a list, or,
    with the option ``summary``, an object of that and the list ``books``.  Tasks write
    their records as parts; at commit the document is put together from them, a buffer
    at a time."""

    @classmethod
    def name(cls) -> str:
        return "jsondocument"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _DocumentWriter(self.options["path"], self.options.get("summary"), overwrite)


#: The lines around the records of an object, and of a list.
HEAD, TAIL, LIST_HEAD, LIST_TAIL = '"books": [', "]}", "[", "]"


class _DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, summary: str | None, overwrite: bool):
        self.path, self.summary, self.overwrite, self.id = path, summary, overwrite, uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        store, to = opened(self.path)
        return store, to, posixpath.join(posixpath.dirname(to), f"{_STAGING}{self.id}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        store, _, own = self._folder()
        store.create_dir(own, recursive=True)
        name, n = f"{TaskContext.get().partitionId():010d}-{uuid.uuid4().hex}", 0
        with store.open_output_stream(posixpath.join(own, name)) as f:
            for batch in batches:
                for line in batch.column("value").to_pylist():
                    f.write(((",\n" if n else "") + line).encode("utf-8"))
                    n += 1
        return _Part(name, n)

    def commit(self, messages: list[_Part | None]) -> None:
        store, to, own = self._folder()
        if not self.overwrite and store.get_file_info(to).type != fs.FileType.NotFound:
            raise ValueError(f"there is a document already: {to}")
        store.create_dir(own, recursive=True)
        with store.open_output_stream(whole := posixpath.join(own, "whole")) as out:
            out.write((f'{{"summary": {self.summary},\n{HEAD}\n' if self.summary else f"{LIST_HEAD}\n").encode())
            some = False
            for part in sorted((m for m in messages if m and m.n), key=lambda m: m.name):
                out.write(b",\n" if some else b"")
                some = True
                with store.open_input_stream(posixpath.join(own, part.name)) as f:
                    while block := f.read(COPY):
                        out.write(block)
            out.write(f"\n{TAIL if self.summary else LIST_TAIL}\n".encode())
        store.move(whole, to)
        store.delete_dir(own)

    def abort(self, messages: list[_Part | None]) -> None:
        store, _, own = self._folder()
        if store.get_file_info(own).type == fs.FileType.Directory:
            store.delete_dir(own)
