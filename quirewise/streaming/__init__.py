"""Streaming forms: presence sessions and the revision counter, equal to the batch forms on the same operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.presence import TTL
from ..operators.revisions import SaveState

OPS_SCHEMA = "seq long, t long, user_id long, op string, file string"


def presence_windows(ops: DataFrame, ttl: int = TTL, late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream of operations, by event time.

    Operations later than `late` are dropped (a server clock has none); a session is emitted once the
    watermark passes its end, so the last ones stay open until newer operations come.
    """
    timed = ops.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", late)
    grouped = timed.groupBy("user_id", F.session_window("at", f"{ttl} seconds"))
    return grouped.agg(F.min("t").alias("started"), F.max("t").alias("ended"), F.count(F.lit(1)).alias("n")).select("user_id", "started", "ended", "n")


#: Groups that the clients are dealt over: a group's sessions are read and written at once.
GROUPS = 1024


class PresenceProcessor(StatefulProcessor):
    """The sessions of a group of clients, with a timer at the first end of one: its last heartbeat plus the time to live plus one second.

    The idealised rule: a session ends as soon as it is older than the time to live, whether or not
    some other request purges then.
    """

    def __init__(self, ttl: int = TTL):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getListState("session", "file string, user_id long, uid long, last long")

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["file", "user_id", "uid", "event", "t"]).astype({"user_id": "Int64"})

    def _open(self) -> dict[tuple, tuple]:
        """(uid, last) of each client with a session."""
        return {(file, user): (uid, last) for file, user, uid, last in self.sessions.get()}

    def _keep(self, now: dict[tuple, tuple]) -> None:
        rows = [(*client, *session) for client, session in now.items()]
        self.sessions.clear()
        for k in range(0, len(rows), 10_000):
            self.sessions.appendList(rows[k : k + 10_000])
        if rows:  # a millisecond before, so that it has expired when the watermark is at the second itself
            self.handle.registerTimer((min(last for *_, last in rows) + self.ttl + 1) * 1000 - 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, now, out = pd.concat(list(rows)).sort_values("seq"), self._open(), []
        users = [None if pd.isna(u) else int(u) for u in batch["user_id"]] if batch["user_id"].hasnans else batch["user_id"].astype(int).tolist()
        for seq, t, op, client in zip(batch["seq"].tolist(), batch["t"].tolist(), batch["op"].tolist(), zip(batch["file"].tolist(), users, strict=True), strict=True):
            if client in now and t - now[client][1] > self.ttl:
                uid, last = now.pop(client)
                out.append((*client, uid, "expired", last + self.ttl + 1))
            if op == "join" and client not in now:
                now[client] = seq, t
                out.append((*client, seq, "joined", t))
            elif op in ("join", "heartbeat") and client in now:
                now[client] = now[client][0], t
            elif op == "leave" and client in now:
                out.append((*client, now.pop(client)[0], "left", t))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self._keep(now)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, time = self._open(), timerValues.getCurrentWatermarkInMs()
        gone = {client: s for client, s in now.items() if (s[1] + self.ttl + 1) * 1000 <= time}
        if gone:
            self._keep({client: s for client, s in now.items() if client not in gone})
        yield self._frame([(*client, uid, "expired", last + self.ttl + 1) for client, (uid, last) in gone.items()])

    def close(self) -> None:
        pass


def presence_events(ops: DataFrame, ttl: int = TTL, late: str = "10 minutes") -> DataFrame:
    """(file, user_id, uid, event, t): sessions joined, left and expired; uid is the seq of the join that made it."""
    moves = ops.filter(F.col("op").isin("join", "heartbeat", "leave")).withColumn("at", F.timestamp_seconds("t")).withWatermark("at", late)
    dealt = moves.withColumn("clients", F.pmod(F.xxhash64("file", "user_id"), F.lit(GROUPS)))
    return dealt.groupBy("clients").transformWithStateInPandas(
        PresenceProcessor(ttl), "file string, user_id long, uid long, event string, t long", "append", "eventtime",
    )


class SaveProcessor(StatefulProcessor):
    """The replay of saves with a file's state in the state store: one value, and what users know in lists of many."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revision = handle.getValueState("revision", "revision int")
        self.known = handle.getListState("known", "users array<long>, revisions array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        known = {u: r for users, revisions in self.known.get() for u, r in zip(users, revisions, strict=True)}
        revision = self.revision.get()[0] if self.revision.exists() else 0
        state = SaveState(key[0], revision, known)
        made = [r for r in map(state.step, batch["file"].tolist(), batch["seq"].tolist(), batch["user_id"].tolist(), batch["op"].tolist()) if r]
        self.revision.update((state.revision,))
        users, revisions = [int(u) for u in state.known], [int(r) for r in state.known.values()]
        self.known.clear()
        for k in range(0, len(users), 10_000):
            self.known.appendValue((users[k : k + 10_000], revisions[k : k + 10_000]))
        yield pd.DataFrame(made, columns=["seq", "file", "user_id", "status", "revision"])

    def close(self) -> None:
        pass


def replayed_saves(ops: DataFrame) -> DataFrame:
    """(seq, file, user_id, status, revision) of each save of the stream.

    A micro-batch is folded in order of seq, so files must see their operations in order across
    batches.  It needs the RocksDB state store; `fold_saves` gives the same with any.
    """
    moves = ops.filter(F.col("op").isin("join", "save"))
    return moves.groupBy("file").transformWithStateInPandas(SaveProcessor(), "seq long, file string, user_id long, status string, revision int", "append", "none")


def fold_saves(ops: DataFrame) -> DataFrame:
    """The same by group state: the state holds the revision and what each user knows."""
    schema = "seq long, file string, user_id long, status string, revision int"

    def fold(key, frames, state):
        revision, users, known = state.get if state.exists else (0, [], [])
        now = SaveState(key[0], revision, dict(zip(users, known, strict=True)))
        batch = pd.concat(list(frames)).sort_values("seq")
        made = [r for r in map(now.step, batch["file"], batch["seq"].astype(int), batch["user_id"].astype(int), batch["op"]) if r]
        state.update((now.revision, [int(u) for u in now.known], [int(r) for r in now.known.values()]))
        yield pd.DataFrame(made, columns=["seq", "file", "user_id", "status", "revision"])

    moves = ops.filter(F.col("op").isin("join", "save"))
    return moves.groupBy("file").applyInPandasWithState(fold, schema, "revision int, users array<long>, known array<int>", "append", "NoTimeout")


#: Seconds between two polls of a folder.
POLL = "5 seconds"


def polling(stream: DataFrame, write_batch, checkpoint: str, every: str | None = POLL):
    """The started query: calls write_batch(rows, batch id) for what has come, every few seconds, or once where `every` is None."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def session_log(path: str):
    """A write_batch that adds a batch of operations to the session table at `path`.

    A batch is a folder of its own, which a batch that runs again overwrites, so each counts once.  The
    table's rows are inserts and updates in one: `operators.presence.sessions` gives the state of each session.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def dropped_rows(query) -> int:
    """Rows that a query left out as too late, over all its batches that are still known."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def run_once(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs all that is there (availableNow) into a Parquet folder, and reads it back."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


#: The most polls of an editor that stand in one row of state.
RUN = 60


def newer_revisions(polls: DataFrame, saves: DataFrame, every: int, late: str = "10 seconds") -> DataFrame:
    """(uid, file, user_id, t, revision): each save by another user that a poll is the first to see.

    polls: (uid, file, user_id, t), each of which sees what came after the last one, `every` seconds before; with n,
    a row stands for as many polls, at most `RUN`, of which t is the first.  saves: (file, saved_by, t, revision).
    Both sides meet by file and band of time, so a row meets those of a few minutes, however many its file has.
    Watermarks on both sides let the state of either go.
    """
    width = RUN * every
    band = lambda t: F.floor(t / width)
    n = F.col("n") if "n" in polls.columns else F.lit(1)
    asked = polls.select("uid", "file", "user_id", "t", n.alias("n"), F.timestamp_seconds("t").alias("at")).withWatermark("at", late)
    asked = asked.withColumn("band", F.explode(F.sequence(band(F.col("t") - every + 1), band(F.col("t") + (F.col("n") - 1) * every)))).alias("p")
    made = saves.select("file", "saved_by", "revision", band(F.col("t")).alias("band"), F.timestamp_seconds("t").alias("saved_at")).withWatermark("saved_at", late).alias("s")
    since = F.expr(f"s.saved_at > p.at - INTERVAL {every} SECONDS AND s.saved_at <= p.at + INTERVAL {(RUN - 1) * every} SECONDS")
    first = F.floor((F.unix_seconds("s.saved_at") - F.col("p.t") + every - 1) / every)
    seen = since & (first < F.col("p.n"))
    met = asked.join(made, (F.col("p.file") == F.col("s.file")) & (F.col("p.band") == F.col("s.band")) & seen & (F.col("s.saved_by") != F.col("p.user_id")))
    return met.select("p.uid", "p.file", "p.user_id", (F.col("p.t") + first * every).alias("t"), "s.revision")


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """(key, value, ...) of a named state, as the last batch of a stopped or running query left it."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def observed(query, name: str, metrics: list[str]) -> tuple[int, ...]:
    """Sums of the counts that a query observed under a name, over all its batches that are still known."""
    rows = [p["observedMetrics"][name] for p in query.recentProgress if name in p["observedMetrics"]]
    return tuple(sum(int(r[m]) for r in rows) for m in metrics)
