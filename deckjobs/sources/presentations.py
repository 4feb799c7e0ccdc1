"""Presentation files as a data source: rows of (file, body) become files, all of a job or none, and are read again.

Each task writes its files into a folder of its own under ``_job-<id>``, which readers pass
over. When the job commits, one folder for each task that succeeded is moved beside the
others; folders of attempts that failed stay behind and go with ``_job-<id>``. So the driver
moves as many folders as there are tasks, however many files they hold. What a lost driver or
a task that would not stop leaves behind is a folder that no reader looks into.

A reader's driver lists those folders only; the files of each are listed and read by the task
that has the folder. Every file is a document's, so a list of all would outgrow the driver.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of bodies that a task reads before it hands them on.
READ_BYTES = 1 << 22


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """The folder of one task, under the job's, or none if it had no rows."""

    folder: str | None
    files: int


class Presentations(DataSource):
    """Writer and reader of (file string, body string) rows, read a line at a time; options: path."""

    @classmethod
    def name(cls) -> str:
        return "presentations"

    def schema(self) -> str:
        return "file string, body string"

    def writer(self, schema, overwrite: bool) -> PresentationWriter:
        return PresentationWriter(self.options["path"], overwrite)

    def reader(self, schema) -> PresentationReader:
        return PresentationReader(self.options["path"])


@dataclass
class Folder(InputPartition):
    """A folder beside others, with all below it, or (no name) the files that lie beside the folders."""

    name: str


class PresentationReader(DataSourceReader):
    """Lines of the files whose names end in ``.pro``; folders whose names begin with ``_`` or ``.`` are passed over."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Folder]:
        store, root = _store(self.path)
        there = store.get_file_info(fs.FileSelector(root))
        return [Folder(""), *(Folder(f.base_name) for f in there if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", ".")))]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, root = _store(self.path)
        files, bodies, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(bodies, pa.binary()).cast(pa.string())], ["file", "body"])

        for f in self._files(store, f"{root}/{partition.name}".rstrip("/"), bool(partition.name)):
            with store.open_input_stream(f.path) as source:
                lines = [x for x in source.read().splitlines() if x.strip()]
            files += [f.base_name] * len(lines)
            bodies += lines
            held += sum(map(len, lines))
            if held >= READ_BYTES:
                yield batch()
                files, bodies, held = [], [], 0
        if bodies:
            yield batch()

    def _files(self, store: fs.FileSystem, at: str, below: bool) -> Iterator[fs.FileInfo]:
        for f in store.get_file_info(fs.FileSelector(at)):
            if f.type == fs.FileType.File and f.base_name.endswith(".pro"):
                yield f
            elif f.type == fs.FileType.Directory and below and not f.base_name.startswith(("_", ".")):
                yield from self._files(store, f.path, True)


class PresentationWriter(DataSourceArrowWriter):
    """Files of tasks under a folder of the job, moved into place at the commit."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = f"_job-{uuid.uuid4().hex}"

    def _at(self) -> tuple[fs.FileSystem, str]:
        return _store(self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._at()
        context = TaskContext.get()
        folder = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        n = 0
        for batch in batches:
            if not n and batch.num_rows:
                store.create_dir(f"{root}/{self.job}/{folder}", recursive=True)
            for name, body in zip(batch["file"].to_pylist(), batch["body"].cast(pa.large_binary()), strict=True):
                with store.open_output_stream(f"{root}/{self.job}/{folder}/{name}") as out:
                    out.write(body.as_py())
                n += 1
        return Written(folder if n else None, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._at()
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.base_name != self.job:
                    store.delete_dir(old.path) if old.type == fs.FileType.Directory else store.delete_file(old.path)
        for m in messages:
            if m is not None and m.folder:
                store.move(f"{root}/{self.job}/{m.folder}", f"{root}/{m.folder}")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        """Take the job's folder away; tasks that are still being stopped may write to it yet, so more than once if need be."""
        store, root = self._at()
        for pause in (0.1, 0.3, 1.0, 3.0):
            try:
                return self._clear(store, root)
            except OSError:
                time.sleep(pause)

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")
