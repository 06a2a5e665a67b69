"""Custom Python data sources.

``json_line_files`` serves the lines of JSON Lines files and writes such files. Executors open the files
themselves, so no record passes through the driver:

* A file is read in byte ranges of ``splitBytes``; a line belongs to the range that its first byte lies in, so every line
  is read once however the file is cut.
* Filters on ``_file`` leave whole files out before the tasks are made; filters on ``record`` (contains, starts with) are
  applied to the bytes of a line, before it becomes a row. They are pushed with ``spark.sql.python.filterPushdown.enabled``.
* A writing task writes one file of its own name to a staging folder; the driver moves the files of the tasks that
  succeeded, once all have, and drops the folder. A task that is run again, or a job that fails, leaves nothing behind.

Register it with ``ingest.register_datasource(spark, JsonLineFiles)`` and use it by name like any built-in format.
"""

from __future__ import annotations

import io
import sys
import uuid
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, StringContains, StringStartsWith, WriterCommitMessage,
)

# executors get these classes whole, as they need not have the library installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT_BYTES = 64 << 20
STAGING = "_staging"


def _open(path: str):
    """The file system and the path within it, of a path or URI."""
    from pyarrow import fs

    uri = path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}"
    return fs.FileSystem.from_uri(uri)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class JsonLineFiles(DataSource):
    """Options ``path``: a folder (or URI) all executors see; ``splitBytes``. Rows: ``(_file, _block, pos, record)``.

    ``_block`` is the range's first byte and ``pos`` the line's, so they order a file's lines. Written rows need a column ``record``.
    """

    @classmethod
    def name(cls) -> str:
        return "json_line_files"

    def schema(self) -> str:
        return "_file string, _block bigint, pos bigint, record string"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite):
        if "record" not in schema.fieldNames():
            raise ValueError("the rows need a column 'record'")
        return _Writer(self.options["path"], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, max(1, split)
        self.files: set[str] | None = None  # those that filters leave
        self.within: list[bytes] = []
        self.prefixes: list[bytes] = []

    def pushFilters(self, filters):
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if isinstance(f, (EqualTo, In)) and column == "_file":
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = asked if self.files is None else self.files & asked
            elif isinstance(f, StringContains) and column == "record":
                self.within.append(f.value.encode())
            elif isinstance(f, StringStartsWith) and column == "record":
                self.prefixes.append(f.value.encode())
            elif not (isinstance(f, IsNotNull) and column in ("_file", "_block", "pos", "record")):  # none is ever null
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = _open(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        shown = [f for f in found if f.is_file and not any(p.startswith(("_", ".")) for p in f.path.removeprefix(root).strip("/").split("/"))]
        shown = sorted((f for f in shown if self.files is None or f.path in self.files), key=lambda f: f.path)
        cuts = [_Range(f.path, s, min(s + self.split, f.size)) for f in shown for s in range(0, f.size, self.split)]
        return cuts or [_Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        system, _ = _open(self.path)
        with io.BufferedReader(system.open_input_file(partition.path), 1 << 20) as raw:
            at = partition.start
            if at:  # the line that runs into this range is the one before's
                raw.seek(at - 1)
                at += len(raw.readline()) - 1
            while at < partition.end:
                line = raw.readline()
                if not line:
                    return
                text = line.rstrip(b"\n")
                if text.strip() and all(w in text for w in self.within) and all(text.startswith(p) for p in self.prefixes):
                    yield partition.path, partition.start, at, text.decode("utf-8", "replace")
                at += len(line)


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        system, root = _open(self.path)
        folder = f"{root}/{STAGING}/{self.job}"
        place, out = f"{folder}/{uuid.uuid4().hex}.jsonl", None
        for row in iterator:
            if out is None:  # tasks without rows write no file
                system.create_dir(folder, recursive=True)
                out = system.open_output_stream(place)
            if "\n" in (row["record"] or ""):
                raise ValueError("a record holds a line end")
            out.write(((row["record"] or "") + "\n").encode())
        if out is None:
            return _Written(None)
        out.close()
        return _Written(place)

    def commit(self, messages):
        from pyarrow import fs

        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and not f.base_name.startswith(("_", "."))]
        for i, m in enumerate(messages):  # in the order of the tasks, so names keep the order of the rows
            if m is not None and m.path:
                system.move(m.path, f"{root}/part-{i:05d}-{self.job}.jsonl")
        for path in old if self.overwrite else []:
            system.delete_file(path)
        self._clear(system, root)

    def abort(self, messages):
        self._clear(*_open(self.path))

    def _clear(self, system, root):
        from pyarrow import fs

        if system.get_file_info(f"{root}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{STAGING}/{self.job}")
