"""Presence, polls and saves as they come: keyed tables, clock-driven sources, joined streams and state read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources, streaming
from ..operators import presence, revisions, saves
from ..sources.cadence import BEAT, POLL, CadenceSource
from ..streaming.save_log import SaveLog, bytes_name, saver
from ..streaming.session_table import SessionTable, upserts
from ..tables import new_folder, written
from .collaboration_queries import _REPLAY, SAVE_REPLAY_SQL, SIX_HOURS, sessions_sql
from .model import Model
from .registry import query
from .text_queries import ARRIVING, _ops_stream, _with_rocksdb, arriving

#: A time to live under which sessions of the test operations, which are hours apart, last.
LONG_TTL = 400_000
LATE = 600
#: Rows that a run of polls and saves brings into state, about.
STATE = 2_000_000


def session_batches(m: Model, log: str | None = None) -> SessionTable:
    """The session table after all operations, which came in four batches; the third ran twice, with a compaction between."""
    table = SessionTable(new_folder(m.spark, "session-table"), LONG_TTL)
    write = upserts(table, log, compact_every=2)

    def twice(rows: DataFrame, batch: int) -> None:
        write(rows, batch)
        if batch == 2:
            write(rows, batch)

    stream = arriving(m, m.ops, "seq", streaming.OPS_SCHEMA)
    streaming.polling(stream, twice, new_folder(m.spark, "state"), every=None).awaitTermination()
    return table


@query(sessions_sql(LONG_TTL) + "SELECT file, user_id, uid, last_heartbeat, deleted, crdate, tstamp FROM session_rows")
def session_upsert(m: Model) -> DataFrame:
    """Sessions kept by upserts: a join keeps the uid of a live session and makes a new one after a leave or a purge."""
    return session_batches(m).read(m.spark).drop("file_hash")


@query(_REPLAY.format(LONG_TTL) + "SELECT seq, file, user_id, op, alive, uid, is_new FROM r WHERE op <> 'leave'")
def presence_exact_stream(m: Model) -> DataFrame:
    """The exact replay, with purges over all files, of operations that come in batches."""
    log = new_folder(m.spark, "replay-log")
    session_batches(m, log)
    schema = "seq long, t long, user_id long, op string, file string, opened boolean, alive boolean, uid long, is_new boolean"
    rows = m.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(log)
    return rows.filter(F.col("op").isin("join", "heartbeat")).select("seq", "file", "user_id", "op", "alive", "uid", "is_new")


def editors(m: Model) -> DataFrame:
    """(uid, file, user_id, opened, closed): an editor is open from its join until a time to live after its last beat."""
    rows = presence.sessions(m.ops, SIX_HOURS)
    return rows.select("uid", "file", "user_id", F.col("crdate").alias("opened"), (F.col("last_heartbeat") + presence.TTL).alias("closed"))


_EDITORS_SQL = sessions_sql(SIX_HOURS).rstrip() + f""",
editors AS (SELECT uid, file, user_id, crdate AS opened, last_heartbeat + {presence.TTL} AS closed FROM session_rows)
"""


def cadence(m: Model, folder: str, since: int, until: int, **options) -> DataFrame:
    """What the editors of a folder send up to a second, as a stream."""
    m.spark.dataSource.register(CadenceSource)
    return m.spark.readStream.format("cadence").options(path=folder, since=str(since), until=str(until), **options).load()


def editors_folder(m: Model) -> tuple[str, int, int]:
    """The editors written as a folder, the second before the first opens, and the last second of any."""
    folder = new_folder(m.spark, "editors")
    tasks = int(m.spark.conf.get("spark.sql.shuffle.partitions"))  # few rows, but very many requests of each: not to be merged by size
    editors(m).repartitionByRange(tasks, "opened").sortWithinPartitions("opened").write.parquet(folder)
    first, last = m.spark.read.parquet(folder).agg(F.min("opened"), F.max("closed")).head()
    return folder, first or 0, last or 0


@query(_EDITORS_SQL + f"""
SELECT uid, file, user_id, 'beat' AS kind, unnest(range(opened + {BEAT}, closed + 1, {BEAT})) AS t FROM editors
UNION ALL SELECT uid, file, user_id, 'poll', unnest(range(opened + {POLL}, closed + 1, {POLL})) FROM editors
""")
def cadence_requests(m: Model) -> DataFrame:
    """Heartbeats and polls of all open editors, by a stream that was stopped half-way and went on from its checkpoint."""
    folder, first, last = editors_folder(m)
    out, checkpoint = new_folder(m.spark, "requests"), new_folder(m.spark, "state")
    for until in ((first + last) // 2, last):
        done = streaming.run_once(m.spark, cadence(m, folder, first, until), out, checkpoint)
    return done


@query(_EDITORS_SQL + f""",
v AS (SELECT seq, file, user_id, t, row_number() OVER (PARTITION BY file ORDER BY seq) AS revision FROM ops WHERE op = 'save'),
k AS (SELECT e.uid, e.file, e.user_id, v.revision, e.opened + {POLL} * CAST(ceil((v.t - e.opened) / {POLL}) AS BIGINT) AS t, e.closed FROM editors e JOIN v ON v.file = e.file AND v.user_id <> e.user_id AND v.t > e.opened AND v.t <= e.closed)
SELECT uid, file, user_id, t, revision FROM k WHERE t <= closed
""")
def remote_newer_stream(m: Model) -> DataFrame:
    """The first poll of each open editor after another editor's save, with its revision: polls and saves joined as streams.

    They come in as many runs of one stream as hold the state of about `STATE` rows each: what is joined goes by the watermarks.
    """
    folder, first, last = editors_folder(m)
    saved = revisions.numbered(m.ops.filter("op = 'save'").select("seq", "file", "user_id", "t")).select("file", F.col("user_id").alias("saved_by"), "t", F.col("revision").cast("long").alias("revision"))
    saved = written(saved, "saved", tidy=True)
    rows = m.spark.read.parquet(folder).agg(F.sum(F.ceil((F.col("closed") - F.col("opened")) / (POLL * streaming.RUN)))).head()[0] or 0
    steps = max(1, -(-int(rows) // STATE))
    cuts = [first + (last - first) * k // steps for k in range(1, steps)]
    arrived, out, checkpoint = (new_folder(m.spark, n) for n in ("arriving", "newer", "state"))
    files = max(1, saved.count() // steps // ARRIVING)
    for since, until in zip([None, *cuts], [*cuts, None], strict=True):
        own = saved if since is None else saved.filter(F.col("t") > since)
        (own if until is None else own.filter(F.col("t") <= until)).repartition(files).write.mode("append").parquet(arrived)
        polls = cadence(m, folder, first, last if until is None else until, kind="poll", run=str(streaming.RUN)).drop("kind")
        done = streaming.run_once(m.spark, streaming.newer_revisions(polls, sources.polled(m.spark, arrived, saved.schema, 1_000_000), POLL), out, checkpoint)
    return done


def _ideal_sql(ttl: int) -> str:
    """Sessions that end as soon as they are too old: e has their events, o those still open at the end."""
    return f"""
WITH prev AS (SELECT *, lag(op) OVER w AS prev_op, lag(t) OVER w AS prev_t, sum(CASE WHEN op = 'join' THEN 1 ELSE 0 END) OVER (PARTITION BY file, user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM ops WHERE op <> 'save' WINDOW w AS (PARTITION BY file, user_id ORDER BY seq)),
gaps AS (SELECT *, prev_op IS NULL OR prev_op = 'leave' OR t > prev_t + {ttl} AS broken FROM prev),
living AS (SELECT *, g > 0 AND op <> 'leave' AND sum(CASE WHEN broken AND op <> 'join' THEN 1 ELSE 0 END) OVER (PARTITION BY file, user_id, g ORDER BY seq ROWS UNBOUNDED PRECEDING) = 0 AS alive FROM gaps),
was AS (SELECT *, coalesce(lag(alive) OVER (PARTITION BY file, user_id ORDER BY seq), false) AS was FROM living),
named AS (SELECT *, last_value(CASE WHEN op = 'join' AND (broken OR NOT was) THEN seq END IGNORE NULLS) OVER (PARTITION BY file, user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS uid FROM was),
spans AS (SELECT file, user_id, uid, min(t) AS first, max(t) FILTER (WHERE alive) AS last, max(t) FILTER (WHERE op = 'leave' AND was AND NOT broken) AS left_at, arg_max(alive, seq) AS alive_last FROM named WHERE uid IS NOT NULL GROUP BY file, user_id, uid),
o AS (SELECT * FROM (SELECT spans.*, alive_last AND uid = max(uid) OVER (PARTITION BY file, user_id) AS lives FROM spans), clock WHERE left_at IS NULL AND lives AND last + {ttl} + 1 > now - {LATE}),
e AS (SELECT file, user_id, uid, 'joined' AS event, first AS t FROM spans UNION ALL SELECT file, user_id, uid, 'left', left_at FROM spans WHERE left_at IS NOT NULL
  UNION ALL SELECT file, user_id, uid, 'expired', last + {ttl} + 1 FROM spans WHERE left_at IS NULL AND uid NOT IN (SELECT uid FROM o))
"""


@query(_ideal_sql(LONG_TTL) + "SELECT file, user_id, uid, event, t FROM e")
def presence_events(m: Model) -> DataFrame:
    """Sessions joined, left and expired, with a timer for each session; a long time to live, as operations are sparse."""
    return _with_rocksdb(m, lambda: streaming.presence_events(_ops_stream(m), LONG_TTL), "events")


@query(_ideal_sql(LONG_TTL) + "SELECT file, user_id, uid, last AS last_heartbeat FROM o")
def sessions_from_state(m: Model) -> DataFrame:
    """The sessions that are open after the stream of presence events, read from its state store."""
    checkpoint = new_folder(m.spark, "state")
    _with_rocksdb(m, lambda: streaming.presence_events(_ops_stream(m), LONG_TTL), "events", checkpoint)
    rows = streaming.state_of(m.spark, checkpoint, "session")
    return rows.select("list_element.file", "list_element.user_id", "list_element.uid", F.col("list_element.last").alias("last_heartbeat"))


@query(SAVE_REPLAY_SQL.replace("SELECT seq, file, user_id, status, c AS revision FROM f WHERE status <> 'load'", "SELECT file, max(c) AS revision FROM f GROUP BY file"))
def revision_from_state(m: Model) -> DataFrame:
    """Each file's revision after the stream of saves, read from its state store."""
    checkpoint = new_folder(m.spark, "state")
    _with_rocksdb(m, lambda: streaming.replayed_saves(_ops_stream(m)), "saves", checkpoint)
    return streaming.state_of(m.spark, checkpoint, "revision").select("key.file", "value.revision")


def save_bodies(m: Model) -> DataFrame:
    """(seq, uid, body, file_right): a save for each event, of few files, so that editors meet; some are broken in each way."""
    e, n = F.col("event_id"), m.table("documents").agg(F.greatest(F.lit(1), F.count(F.lit(1)))).scalar()
    texts = m.files.select("doc_id", F.col("file_identifier"))
    data = F.when(e % 17 == 0, "").when(e % 13 == 0, "####").otherwise(F.base64(F.encode(F.concat(F.lit("version "), e.cast("string")), "utf-8")))
    revision = F.when(e % 4 == 1, F.floor(e / 50) % 7).when(e % 4 == 2, F.lit(-1)).when(e % 4 == 3, F.lit(2)).cast("string")
    rows = m.table("events").select(e, "user_id", (e % 50 * 7 % n).alias("doc_id"), data.alias("data"), revision.alias("revision")).join(texts, "doc_id", "left")
    file = F.when(e % 29 == 0, " ").when(e % 23 == 0, "1:/none.docx").otherwise(F.coalesce("file_identifier", F.lit("")))
    body = F.when(e % 19 == 0, "{broken").otherwise(F.to_json(F.struct(file.alias("file"), "data", "revision")))
    return rows.select(e.alias("seq"), F.col("user_id").alias("uid"), body.alias("body"), (F.col("user_id") % 3 != 0).alias("file_right"))


_SAVES_SQL = """
WITH RECURSIVE q AS (SELECT e.event_id AS seq, e.user_id AS uid, f.file_identifier, f.kind, f.extension, f.storage_id,
    CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 13 = 0 THEN '####' ELSE base64(encode('version ' || event_id)) END AS data,
    CASE event_id % 4 WHEN 1 THEN event_id // 50 % 7 WHEN 2 THEN -1 WHEN 3 THEN 2 ELSE -1 END AS expected
  FROM events e LEFT JOIN files f ON f.doc_id = event_id % 50 * 7 % (SELECT greatest(1, count(*)) FROM documents)),
w AS (SELECT q.*, CASE WHEN seq % 19 = 0 OR data IN ('', '####') OR seq % 29 = 0 OR (seq % 23 <> 0 AND file_identifier IS NULL) THEN 400 WHEN seq % 23 = 0 OR kind <> 'file' THEN 404 WHEN lower(extension) <> 'docx' THEN 415
    WHEN NOT ((coalesce(u.is_admin, false) OR coalesce(g.storage_right, false)) AND q.uid % 3 <> 0) THEN 403 END AS refused,
    CASE WHEN seq % 19 = 0 THEN 'Invalid request body.' WHEN data = '' THEN 'Missing document payload.' WHEN data = '####' THEN 'Invalid base64 payload.' ELSE 'Missing file identifier.' END AS bad
  FROM q LEFT JOIN users u ON u.uid = q.uid LEFT JOIN grants g ON g.uid = q.uid AND g.storage_id = q.storage_id),
o AS (SELECT *, row_number() OVER (PARTITION BY file_identifier ORDER BY seq) AS k FROM w WHERE refused IS NULL),
s AS (SELECT file_identifier, k, seq, expected < 0 OR expected = 0 AS ok, CASE WHEN expected < 0 OR expected = 0 THEN 1 ELSE 0 END AS c, data FROM o WHERE k = 1
  UNION ALL SELECT o.file_identifier, o.k, o.seq, o.expected < 0 OR o.expected = s.c, CASE WHEN o.expected < 0 OR o.expected = s.c THEN s.c + 1 ELSE s.c END, o.data FROM s JOIN o ON o.file_identifier = s.file_identifier AND o.k = s.k + 1)
"""


@query(_SAVES_SQL + """
SELECT w.seq, coalesce(refused, CASE WHEN s.ok THEN 200 ELSE 409 END) AS status,
  CASE refused WHEN 400 THEN bad WHEN 404 THEN 'File not found.' WHEN 415 THEN 'Only .docx files can be edited.' WHEN 403 THEN 'No write permission for this file.' ELSE CASE WHEN NOT s.ok THEN 'Document was updated by another editor. Reload to continue.' END END AS error,
  CASE WHEN s.ok THEN s.c END AS revision, CASE WHEN s.ok THEN sha256(from_base64(s.data)) END AS content_hash FROM w LEFT JOIN s USING (seq)
""")
def save_requests(m: Model) -> DataFrame:
    """The answers to save requests that come in batches; the second one dies before its ledger row and runs again, and so does a whole one."""
    return _saved(m).answers(m.spark).drop("batch")


@query(_SAVES_SQL + "SELECT file_identifier, c AS revision, sha256(from_base64(data)) AS content_hash, sha256(from_base64(data)) AS bytes_hash FROM s WHERE ok QUALIFY row_number() OVER (PARTITION BY file_identifier ORDER BY seq DESC) = 1")
def saved_files(m: Model) -> DataFrame:
    """Each saved file's latest revision, with the hash of the bytes that are read back for it."""
    log = _saved(m)
    latest = revisions.latest(log.log(m.spark).drop("batch"))
    name = bytes_name(F.col("content_hash")).alias("name")
    read = sources.read_binaries(latest.select(name).distinct(), log.bytes_folder())
    stored = read.select(F.regexp_extract("name", r"/(\w+)\.", 1).alias("content_hash"), F.sha2("content", 256).alias("bytes_hash"))
    return latest.join(stored, "content_hash").select("file_identifier", "revision", "content_hash", "bytes_hash")


def _saved(m: Model) -> SaveLog:
    log = SaveLog(new_folder(m.spark, "saves"))
    write = saver(log, m.files, m.users, m.grants)
    died = []

    def unsteady(rows: DataFrame, batch: int) -> None:
        if batch == 1 and not died:
            died.append(batch)
            torn = rows.filter("seq % 2 = 0")  # what a first run may have left behind, with other rows than the second
            done = SaveLog(new_folder(m.spark, "torn"))
            done.save(saves.checked(torn, m.files, m.users, m.grants), batch)
            done.log(m.spark).drop("batch").write.parquet(f"{log.path}/revisions/batch={batch}")
        write(rows, batch)
        if batch == 2:
            write(rows, batch)

    stream = arriving(m, save_bodies(m), "seq", "seq long, uid long, body string, file_right boolean", 3)
    streaming.polling(stream, unsteady, new_folder(m.spark, "state"), every=None).awaitTermination()
    return log


@query("""
SELECT count(*) AS requests, count(*) FILTER (WHERE event_id % 7 < 2) AS broken, count(*) FILTER (WHERE event_id % 7 IN (2, 5, 6)) AS without_file, count(*) FILTER (WHERE event_id % 7 = 5) AS without_session FROM events
""")
def request_metrics(m: Model) -> DataFrame:
    """Requests of a stream that are broken or lack a field: dropped, but counted by the stream itself as it runs."""
    p = F.col("p")
    rows = arriving(m, m.bodies, "event_id", m.bodies.schema, 2).select("event_id", sources.request_fields(F.col("body")).alias("p"))
    counted = rows.observe(
        "requests", F.count(F.lit(1)).alias("requests"), F.count_if(p.isNull()).alias("broken"), F.count_if(p.isNotNull() & (F.coalesce(p["file"], F.lit("")) == "")).alias("without_file"),
        F.count_if(p.isNotNull() & (p["sessionUid"] == 0) & p["file"].isNotNull() & (p["file"] == "")).alias("without_session"),
    )
    started = counted.filter(p.isNotNull()).writeStream.format("noop").option("checkpointLocation", new_folder(m.spark, "state")).trigger(availableNow=True).start()
    started.awaitTermination()
    return m.spark.createDataFrame([streaming.observed(started, "requests", ["requests", "broken", "without_file", "without_session"])], "requests long, broken long, without_file long, without_session long")
