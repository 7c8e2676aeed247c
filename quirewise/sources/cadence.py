"""A streaming source of what open editors send by the clock: heartbeats and revision polls.

Intervals (uid, file, user_id, opened, closed) are a Parquet folder; an editor sends a beat every `beat` seconds
after it opened, and a poll every `poll` seconds, as long as it is open.  An offset is a second: a batch has all
beats and polls after the last batch's offset up to its own; intervals sorted by time let it read few of them.  Options: path; beat and poll (seconds); since, the
second before the first; until, the last one that may be sent, else the clock; slice, seconds a task makes at once;
kind, the only one to send, beat or poll; run, the most requests of an editor that a row stands for: the one at t and the
n - 1 after it.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BEAT = 15
POLL = 5
SLICE = 7 * 86_400
SCHEMA = "uid long, file string, user_id long, kind string, t long"


@dataclass
class Slice(InputPartition):
    """The seconds (after, last] of one row group."""

    file: str
    group: int
    after: int
    last: int


class CadenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cadence"

    def schema(self) -> str:
        return f"{SCHEMA}, n long" if "run" in self.options else SCHEMA

    def streamReader(self, schema) -> CadenceReader:
        return CadenceReader(self.options)


class CadenceReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.since = options["path"], int(options.get("since", 0))
        self.until = int(options["until"]) if "until" in options else None
        every = {"beat": int(options.get("beat", BEAT)), "poll": int(options.get("poll", POLL))}
        self.every = {kind: n for kind, n in every.items() if kind == options.get("kind", kind)}
        self.run, self.counted = int(options.get("run", 1)), "run" in options
        self.slice = int(options.get("slice", SLICE))

    def initialOffset(self) -> dict:
        return {"t": self.since}

    def latestOffset(self) -> dict:
        return {"t": int(time.time()) if self.until is None else self.until}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        """One for each row group whose intervals meet the batch's seconds, and each slice of them."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path)
        out = []
        for info in store.get_file_info(fs.FileSelector(base, recursive=True)):
            if not info.path.endswith(".parquet"):
                continue
            meta = pq.read_metadata(info.path, filesystem=store)
            columns = {meta.schema.column(c).name: c for c in range(meta.num_columns)}
            for g in range(meta.num_row_groups):
                stats = [meta.row_group(g).column(columns[c]).statistics for c in ("opened", "closed")]
                there = all(s is not None and s.has_min_max for s in stats)
                first, last = max(start["t"], stats[0].min if there else start["t"]), min(end["t"], stats[1].max if there else end["t"])
                out += [Slice(info.path, g, t, min(t + self.slice, last)) for t in range(first, last, self.slice)]
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.file) as f:
            rows = pq.ParquetFile(f).read_row_group(partition.group, ["uid", "file", "user_id", "opened", "closed"])
        opened, closed = (rows[c].to_numpy() for c in ("opened", "closed"))
        for kind, every in self.every.items():
            first = np.maximum(1, (partition.after - opened) // every + 1)  # the first after the slice's start
            last = (np.minimum(closed, partition.last) - opened) // every
            n = np.maximum(0, last - first + 1)
            runs = -(-n // self.run)
            for lo, hi in _chunks(runs):
                row = np.repeat(np.arange(lo, hi), runs[lo:hi])
                k = np.arange(len(row)) - np.repeat(np.cumsum(runs[lo:hi]) - runs[lo:hi], runs[lo:hi])
                at = pa.array(row)
                columns = [rows[c].take(at).combine_chunks() for c in ("uid", "file", "user_id")]
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
                columns += [pa.array([kind] * len(row), pa.string()), pa.array(opened[row] + every * (first[row] + k * self.run), pa.int64())]
                names = ["uid", "file", "user_id", "kind", "t"]
                if self.counted:
                    columns, names = [*columns, pa.array(np.minimum(self.run, n[row] - k * self.run), pa.int64())], [*names, "n"]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def _chunks(n: np.ndarray, rows: int = 50_000) -> Iterator[tuple[int, int]]:
    """Runs of intervals with about so many rows; one interval's rows of a slice stay together."""
    part = (np.cumsum(n) - n) // rows
    edges = np.flatnonzero(np.diff(part, prepend=-1)) if len(n) else np.zeros(0, int)
    for lo, hi in zip(edges, [*edges[1:], len(n)], strict=True):
        if n[lo:hi].sum():
            yield int(lo), int(hi)
