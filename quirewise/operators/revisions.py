"""Revision log: latest by key, defaults, numbering, stale-save conflicts, and the replay of saves."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking

STATE = ("revision", "content_hash", "saved_by", "changed_at")


def latest(revisions: DataFrame) -> DataFrame:
    """Of each file the row with the largest uid (not the largest revision).

    One aggregate with map-side partials: files with very many revisions shuffle one row per task.
    """
    others = [c for c in revisions.columns if c != "file_identifier"]
    return revisions.groupBy("file_identifier").agg(F.max_by(F.struct(*others), "uid").alias("r")).select("file_identifier", "r.*")


def latest_of(revisions: DataFrame, file_identifier: str) -> DataFrame:
    """One file's latest row; the filter reaches the scan."""
    return revisions.filter(F.col("file_identifier") == file_identifier).orderBy(F.desc("uid")).limit(1)


def state_of(files: DataFrame, revisions: DataFrame) -> DataFrame:
    """Each file with its revision state; zeros and an empty hash where it was never saved."""
    joined = files.join(latest(revisions).drop("uid"), "file_identifier", "left")
    empty = {"int": 0, "bigint": 0, "string": ""}
    kinds = dict(revisions.dtypes)
    return joined.withColumns({c: F.coalesce(c, F.lit(empty[kinds[c]]).cast(kinds[c])) for c in STATE if c in kinds})


def numbered(saves: DataFrame) -> DataFrame:
    """Accepted saves (file, seq, ...) with their revision, from 1; a file may have any share of them."""
    return ranking.numbered(saves, ["seq"], ["file"], "revision")


def is_conflict(expected: Column, current: Column) -> Column:
    """A negative or missing expectation saves unconditionally."""
    return (F.coalesce(expected, F.lit(-1)) >= 0) & (current != expected)


def is_newer(current: Column, known: Column) -> Column:
    return current > known


def may_save(writable: Column, saving: Column, has_buffer: Column) -> Column:
    return writable & ~saving & has_buffer


def replayed(ops: DataFrame) -> DataFrame:
    """(seq, file, user_id, status, revision) of each save, with what clients know taken into account.

    A load (join) makes the current revision known to its user; a save is accepted if the user knows
    the current revision, which it then raises; after a conflict the user knows no more than before.
    A save without a loaded document is skipped.  Acceptance depends on earlier acceptances, so the
    operations of a file are folded in order; the fold streams over sorted partitions and holds one
    file's users, not its operations.
    """
    moves = ops.filter(F.col("op").isin("join", "save")).select("file", "seq", "user_id", "op")
    dealt = moves.repartition("file").sortWithinPartitions("file", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = SaveState()
        for b in batches:
            rows = [r for r in map(state.step, *(b.column(c).to_pylist() for c in ("file", "seq", "user_id", "op"))) if r]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["seq", "file", "user_id", "status", "revision"])

    return dealt.mapInArrow(run, "seq long, file string, user_id long, status string, revision int")


class SaveState:
    """The fold's state for one file at a time; files arrive one after another."""

    def __init__(self, file=None, revision: int = 0, known: dict | None = None):
        self.file, self.revision, self.known = file, revision, known or {}

    def step(self, file, seq, user, op):
        if file != self.file:
            self.__init__(file)
        if op == "join":
            self.known[user] = self.revision
            return None
        if user not in self.known:
            return seq, file, user, "skipped", self.revision
        if self.known[user] != self.revision:
            return seq, file, user, "conflict", self.revision
        self.revision += 1
        self.known[user] = self.revision
        return seq, file, user, "accepted", self.revision
