"""Many files in one job: tasks write into a folder of their own below the target, and the driver's commit moves what they wrote.

Lines of text go where their row says. No line passes the driver, a task holds one open file, and a file is there
whole or not at all. Paths are local ones that all machines share, or addresses of stores that pyarrow opens.
"""

from __future__ import annotations

import os
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as stores
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from sluice.errors import FileError


#: Seconds in which what other tasks still leave is cleared after a failure: Spark ends a killed task's worker after two.
GRACE = 3.0


def opened(path: str) -> tuple[stores.FileSystem, str]:
    """The store of a path, and the path there."""
    if "://" in path:
        store, inner = stores.FileSystem.from_uri(path)
        return store, inner.rstrip("/")
    return stores.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def _exists(store: stores.FileSystem, path: str) -> stores.FileType | None:
    kind = store.get_file_info(path).type
    return None if kind == stores.FileType.NotFound else kind


def _deleted(store: stores.FileSystem, path: str) -> None:
    kind = _exists(store, path)
    if kind == stores.FileType.Directory:
        store.delete_dir(path)
    elif kind is not None:
        store.delete_file(path)


@dataclass
class Written(WriterCommitMessage):
    """What a task has left in its attempt's folder."""

    attempt: str
    files: list[str]


class PartsWriter(DataSourceArrowWriter):
    """Rows (file, line), those of one file together in one task, as files below a folder, each with `head` before its lines.

    A row without a line only has its file made. Appending replaces files, or folders of them, of the same
    name and leaves others; overwriting leaves nothing else. Lines of a file in two tasks, or apart in
    one, are an error. If anything fails, the target is as it was, but for a failure between the renames
    of the commit: then each name has what was there or what was written. A machine that is lost with its
    driver leaves a folder `.sluice-…`, which readers pass over.
    """

    def __init__(self, folder: str, head: str, overwrite: bool):
        self.folder, self.head, self.overwrite = folder, head, overwrite
        store, path = opened(folder)
        self.new = _exists(store, path) is None
        self.staging = f".sluice-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = opened(self.folder)
        attempt = uuid.uuid4().hex
        files: dict[str, None] = {}
        last, out = None, None
        try:
            for batch in iterator:
                names, lines = (batch.column(batch.schema.get_field_index(n)) for n in ("file", "line"))
                runs = pc.run_end_encode(names)
                begin = 0
                for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                    if out is None or name != last:
                        if out is not None:
                            out.close()
                            out = None
                        self._check(name, files)
                        root = f"{folder}/{self.staging}/{attempt}"
                        if not files:
                            store.create_dir(root, recursive=True)
                        for level in list(accumulate(name.split("/"), "{}/{}".format))[:-1]:
                            store.create_dir(f"{root}/{level}", recursive=False)  # fails where the job was given up meanwhile
                        out, last = store.open_output_stream(f"{root}/{name}"), name
                        files[name] = None
                        out.write(self.head.encode())
                    some = lines.slice(begin, end - begin).drop_null().to_pylist()
                    if some:
                        out.write(("\n".join(some) + "\n").encode())
                    begin = end
        finally:
            if out is not None:
                out.close()
        return Written(attempt, list(files))

    @staticmethod
    def _check(name: str | None, files: dict[str, None]) -> None:
        if not name or any(not x or x.startswith(".") for x in name.split("/")):
            raise FileError(f"{name!r} is no name of a file below a folder")
        if name in files:
            raise FileError(f"the lines of {name} are not together")

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.folder)
        staging = f"{folder}/{self.staging}"
        staged = [(f, m.attempt) for m in messages if m is not None for f in m.files]
        if twice := [f for f, n in Counter(f for f, _ in staged).items() if n > 1]:
            raise FileError(f"the lines of {min(twice)} are in more than one task")
        tops = sorted({f.split("/", 1)[0] for f, _ in staged})
        store.create_dir(f"{staging}/whole", recursive=True)
        for f, attempt in staged:
            if "/" in f:
                store.create_dir(f"{staging}/whole/{f}".rsplit("/", 1)[0], recursive=True)
            store.move(f"{staging}/{attempt}/{f}", f"{staging}/whole/{f}")
        if self.overwrite:
            for old in store.get_file_info(stores.FileSelector(folder)):
                if old.base_name not in (self.staging, *tops):
                    _deleted(store, f"{folder}/{old.base_name}")
        for top in tops:
            kinds = [_exists(store, f"{place}/{top}") for place in (folder, f"{staging}/whole")]
            if kinds != [stores.FileType.File] * 2:
                _deleted(store, f"{folder}/{top}")
            store.move(f"{staging}/whole/{top}", f"{folder}/{top}")
        store.delete_dir(staging)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.folder)
        until = time.monotonic() + GRACE
        while True:
            with suppress(OSError):  # a task that is being killed may write meanwhile
                _deleted(store, f"{folder}/{self.staging}")
            if time.monotonic() > until:
                break
            time.sleep(0.2)
        if self.new and _exists(store, folder) and not store.get_file_info(stores.FileSelector(folder)):
            store.delete_dir(folder)
