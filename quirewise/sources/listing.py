"""A source of files: (path, length) of all files below a folder, empty ones too, and on request their bytes.

Options: path; most, the largest size that is listed; content, whether there is a third column with the bytes.
Each subfolder of the folder is listed and read by a task of its own; the folder's own files are dealt over tasks
by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The folder's own files that a task gets, and bytes and files of a batch, about.
FILES = 2_000
BATCH = 16 << 20, 1_000


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "path string, length long" + (", content binary" if self.options.get("content") == "true" else "")

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.content = options["path"], options.get("content") == "true"
        self.most = int(options["most"]) if "most" in options else None

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(base))
        own = sorted(x.path for x in found if x.type == fs.FileType.File)
        return [InputPartition((own[k : k + FILES], None)) for k in range(0, max(1, len(own)), FILES)] + [InputPartition(([], x.path)) for x in found if x.type == fs.FileType.Directory]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path)
        own, folder = partition.value
        found = store.get_file_info(own if folder is None else fs.FileSelector(folder, recursive=True))
        found = [x for x in found if x.type == fs.FileType.File and (self.most is None or x.size <= self.most)]
        shown = [x for x in found if not any(part[:1] in "._" for part in x.path[len(base) :].strip("/").split("/"))]  # as Spark's readers see it
        start, batch, held = self.path.rstrip("/"), [], 0
        for x in shown:
            batch.append(x)
            held += x.size if self.content else 0
            if held >= BATCH[0] or len(batch) >= BATCH[1]:
                yield self._rows(store, start, base, batch)
                batch, held = [], 0
        yield self._rows(store, start, base, batch)

    def _rows(self, store, start: str, base: str, files: list) -> pa.RecordBatch:
        columns = {"path": pa.array([start + x.path[len(base.rstrip("/")) :] for x in files], pa.string()), "length": pa.array([x.size for x in files], pa.int64())}
        if self.content:
            columns["content"] = pa.array([read_file(store, x.path) for x in files], pa.binary())
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def read_file(store, path: str) -> bytes:
    with store.open_input_stream(path) as f:
        return f.read()
