"""Revisions, presence, exact replay, files and permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages
from ..functions.scalars import display_name
from ..operators import files as files_of
from ..operators import presence, revisions
from .model import Model
from .registry import query

SIX_HOURS = 21_600
COLLABORATORS = "{count, plural, one {1 editor online} other {# editors online}}"


def now(m: Model) -> Column:
    """The last operation's second, as a scalar subquery; 0 without operations."""
    return m.ops.agg(F.coalesce(F.max("t"), F.lit(0))).scalar()


def user_names(m: Model) -> DataFrame:
    return m.users.select(F.col("uid").alias("user_id"), F.concat(F.lit("User "), F.col("uid").cast("string")).alias("user_name"))


@query("SELECT file_identifier, arg_max(revision, uid) AS revision, arg_max(content_hash, uid) AS content_hash, arg_max(saved_by, uid) AS saved_by, arg_max(changed_at, uid) AS changed_at, max(uid) AS uid FROM revisions GROUP BY file_identifier")
def revision_latest(m: Model) -> DataFrame:
    return revisions.latest(m.revisions)


@query("SELECT uid, file_identifier, revision, content_hash, saved_by, changed_at FROM revisions WHERE file_identifier = '1:/conversations/5.docx' ORDER BY uid DESC LIMIT 1")
def revision_point(m: Model) -> DataFrame:
    return revisions.latest_of(m.revisions, "1:/conversations/5.docx")


@query("""
WITH l AS (SELECT file_identifier, arg_max(revision, uid) AS revision, arg_max(content_hash, uid) AS content_hash, arg_max(saved_by, uid) AS saved_by, arg_max(changed_at, uid) AS changed_at FROM revisions GROUP BY 1)
SELECT f.file_identifier, coalesce(l.revision, 0) AS revision, coalesce(l.content_hash, '') AS content_hash, coalesce(l.saved_by, '') AS saved_by, coalesce(l.changed_at, 0) AS changed_at
FROM (SELECT '1:/conversations/' || doc_id || '.docx' AS file_identifier FROM documents) f LEFT JOIN l USING (file_identifier)
""")
def revision_default(m: Model) -> DataFrame:
    asked = m.table("documents").select(F.concat(F.lit("1:/conversations/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("file_identifier"))
    return revisions.state_of(asked, m.revisions)


@query("SELECT seq, file, user_id, CAST(row_number() OVER (PARTITION BY file ORDER BY seq) AS INTEGER) AS revision FROM ops WHERE op = 'save'")
def revision_number(m: Model) -> DataFrame:
    return revisions.numbered(m.ops.filter("op = 'save'").select("seq", "file", "user_id"))


@query("""
WITH s AS (SELECT seq, file, CAST(row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS INTEGER) AS current, CASE seq % 4 WHEN 0 THEN NULL WHEN 1 THEN -1 ELSE CAST(row_number() OVER (PARTITION BY file ORDER BY seq) - seq % 2 AS INTEGER) END AS expected FROM ops WHERE op = 'save')
SELECT seq, file, current, expected, coalesce(expected, -1) >= 0 AND current <> expected AS conflict FROM s
""")
def save_conflict(m: Model) -> DataFrame:
    s = revisions.numbered(m.ops.filter("op = 'save'").select("seq", "file")).withColumn("current", F.col("revision") - 1)
    k = F.col("seq")
    expected = F.when(k % 4 == 0, F.lit(None).cast("int")).when(k % 4 == 1, F.lit(-1)).otherwise((F.col("revision") - k % 2).cast("int"))
    return s.withColumn("expected", expected).select(
        "seq", "file", "current", "expected",
        F.coalesce(revisions.is_conflict(F.col("expected"), F.col("current")), F.lit(False)).alias("conflict"),
    )


@query("SELECT seq, seq % 2 = 0 AND NOT seq % 3 = 0 AND seq % 5 <> 0 AS saves, CASE WHEN seq % 5 <> 0 THEN 'editor' WHEN seq % 7 <> 0 THEN 'loaded' END AS buffer FROM ops WHERE op = 'save'")
def save_gate(m: Model) -> DataFrame:
    k = F.col("seq")
    buffer = F.coalesce(F.when(k % 5 != 0, "editor"), F.when(k % 7 != 0, "loaded"))
    return m.ops.filter("op = 'save'").select("seq", revisions.may_save(k % 2 == 0, k % 3 == 0, k % 5 != 0).alias("saves"), buffer.alias("buffer"))


@query("""
WITH l AS (SELECT file_identifier, max(uid) AS top, arg_max(revision, uid) AS revision FROM revisions GROUP BY 1)
SELECT r.file_identifier, r.uid, r.revision AS known, l.revision AS current FROM revisions r JOIN l USING (file_identifier) WHERE l.revision > r.revision
""")
def remote_newer(m: Model) -> DataFrame:
    newest = revisions.latest(m.revisions).select("file_identifier", F.col("revision").alias("current"))
    return m.revisions.join(newest, "file_identifier").filter(revisions.is_newer(F.col("current"), F.col("revision"))).select(
        "file_identifier", "uid", F.col("revision").alias("known"), "current",
    )


@query("""
SELECT seq AS id, file, 'conflict' AS signal FROM (SELECT seq, file, CAST(row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS INTEGER) AS current FROM ops WHERE op = 'save') WHERE current <> seq % 4
UNION ALL
SELECT r.uid, r.file_identifier, 'newer' FROM revisions r JOIN (SELECT file_identifier, arg_max(revision, uid) AS revision FROM revisions GROUP BY 1) l USING (file_identifier) WHERE l.revision > r.revision
""")
def conflict_alerts(m: Model) -> DataFrame:
    s = revisions.numbered(m.ops.filter("op = 'save'").select("seq", "file"))
    refused = s.filter(revisions.is_conflict(F.col("seq") % 4, (F.col("revision") - 1))).select(F.col("seq").alias("id"), "file", F.lit("conflict").alias("signal"))
    return refused.unionByName(remote_newer(m).select(F.col("uid").alias("id"), F.col("file_identifier").alias("file"), F.lit("newer").alias("signal")))


_REPLAY = """
WITH timed AS (SELECT *, max(CASE WHEN op <> 'leave' THEN t END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS trig FROM sent),
before AS (SELECT *, lag(op) OVER w AS prev_op, lag(t) OVER w AS prev_t, sum(CASE WHEN op = 'join' THEN 1 ELSE 0 END) OVER (PARTITION BY file, user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM timed WINDOW w AS (PARTITION BY file, user_id ORDER BY seq)),
judged AS (SELECT *, prev_op IS NULL OR prev_op = 'leave' OR coalesce(trig > prev_t + {0}, false) AS broken FROM before),
living AS (SELECT *, g > 0 AND op <> 'leave' AND sum(CASE WHEN broken AND op <> 'join' THEN 1 ELSE 0 END) OVER (PARTITION BY file, user_id, g ORDER BY seq ROWS UNBOUNDED PRECEDING) = 0 AS alive FROM judged),
named AS (SELECT *, op = 'join' AND (broken OR NOT coalesce(lag(alive) OVER (PARTITION BY file, user_id ORDER BY seq), false)) AS is_new FROM living),
r AS (SELECT *, last_value(CASE WHEN is_new THEN seq END IGNORE NULLS) OVER (PARTITION BY file, user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS uid FROM named)
"""


def sessions_sql(ttl: int) -> str:
    """WITH ... session_rows: the session table of the exact replay; the statement goes on with SELECT, or a comma and more tables."""
    return (
        _REPLAY.format(ttl).rstrip() + f""",
purge AS (SELECT max(t) AS at FROM r WHERE op <> 'leave'),
spans AS (SELECT file, user_id, uid, min(t) FILTER (WHERE is_new) AS crdate, max(t) FILTER (WHERE alive) AS last_heartbeat, max(t) FILTER (WHERE op = 'leave' AND opened = 'join') AS left_at FROM r WHERE uid IS NOT NULL GROUP BY ALL),
session_rows AS (SELECT file, user_id, uid, sha256(file) AS file_hash, last_heartbeat, left_at IS NOT NULL OR last_heartbeat < purge.at - {ttl} AS deleted, crdate, coalesce(left_at, crdate) AS tstamp FROM spans, purge)
"""
    )


@query(sessions_sql(SIX_HOURS) + f"SELECT file, user_id, uid, file_hash, last_heartbeat FROM session_rows, clock WHERE NOT deleted AND last_heartbeat >= now - {SIX_HOURS}")
def presence_active(m: Model) -> DataFrame:
    return presence.active(presence.sessions(m.ops, SIX_HOURS), now(m), SIX_HOURS).select("file", "user_id", "uid", "file_hash", "last_heartbeat")


@query(sessions_sql(SIX_HOURS) + f""",
f AS (SELECT DISTINCT file FROM ops), a AS (SELECT file, count(*) AS n FROM session_rows, clock WHERE NOT deleted AND last_heartbeat >= now - {SIX_HOURS} GROUP BY file)
SELECT f.file, coalesce(a.n, 0) AS active FROM f LEFT JOIN a USING (file)
""")
def presence_count(m: Model) -> DataFrame:
    counted = presence.active(presence.sessions(m.ops, SIX_HOURS), now(m), SIX_HOURS).groupBy("file").agg(F.count(F.lit(1)).alias("active"))
    return m.ops.select("file").distinct().join(counted, "file", "left").select("file", F.coalesce("active", F.lit(0)).alias("active"))


@query(sessions_sql(90_000) + """,
a AS (SELECT user_id % 40 AS room, count(*) FILTER (WHERE NOT deleted AND last_heartbeat >= now - 90000) AS n FROM session_rows, clock GROUP BY 1)
SELECT room, n AS active, CASE n WHEN 0 THEN '' WHEN 1 THEN '1 editor online' ELSE n || ' editors online' END AS label FROM a
""")
def presence_label(m: Model) -> DataFrame:
    alive = ~F.col("deleted") & (F.col("last_heartbeat") >= now(m) - 90_000)
    rooms = presence.sessions(m.ops, 90_000).withColumn("alive", alive).groupBy((F.col("user_id") % 40).alias("room")).agg(F.count_if("alive").alias("active"))
    return rooms.select("room", "active", messages.presence_label(F.lit(COLLABORATORS), F.col("active")).alias("label"))


@query(sessions_sql(SIX_HOURS) + f""",
a AS (SELECT file, user_id, coalesce('User ' || u.uid, 'Editor') AS user_name, session_rows.uid FROM session_rows LEFT JOIN users u ON u.uid = user_id, clock WHERE NOT deleted AND last_heartbeat >= now - {SIX_HOURS})
SELECT f.file, '[' || coalesce(string_agg('{{"userId":' || user_id || ',"userName":"' || user_name || '","sessionUid":' || uid || '}}', ',' ORDER BY user_id), '') || ']' AS participants
FROM (SELECT DISTINCT file FROM ops UNION ALL SELECT '1:/nobody.docx') f LEFT JOIN a USING (file) GROUP BY f.file
""")
def presence_list(m: Model) -> DataFrame:
    """Users that aren't in the table of users are called Editor; a file without editors has an empty list."""
    files = m.ops.select("file").unionAll(m.spark.createDataFrame([("1:/nobody.docx",)], "file string"))
    listed = presence.participants(presence.active(presence.sessions(m.ops, SIX_HOURS), now(m), SIX_HOURS), user_names(m), files)
    return listed.select("file", F.to_json("participants").alias("participants"))


@query(sessions_sql(400_000) + f"SELECT file, user_id, uid, last_heartbeat, deleted OR last_heartbeat < now - {SIX_HOURS} AS deleted FROM session_rows, clock")
def session_purge(m: Model) -> DataFrame:
    return presence.purged(presence.sessions(m.ops, 400_000), now(m), SIX_HOURS).select("file", "user_id", "uid", "last_heartbeat", "deleted")


@query(sessions_sql(400_000) + "SELECT file, user_id, uid, deleted OR user_id % 3 = 0 AS deleted, CASE WHEN user_id % 3 = 0 THEN 1700000000 ELSE tstamp END AS tstamp FROM session_rows")
def session_leave(m: Model) -> DataFrame:
    rows = presence.sessions(m.ops, 400_000)
    return presence.left(rows, rows.filter("user_id % 3 = 0"), 1_700_000_000).select("file", "user_id", "uid", "deleted", F.col("tstamp").cast("bigint").alias("tstamp"))


_WINDOWS = """
WITH g AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, seq) <= {0} THEN 0 ELSE 1 END AS first FROM ops),
s AS (SELECT user_id, t, sum(first) OVER (PARTITION BY user_id ORDER BY t, first DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(t) AS started, max(t) AS ended, count(*) AS n FROM s GROUP BY user_id, k
"""


def windows_sql(ttl: int) -> str:
    return _WINDOWS.format(ttl)


@query(_WINDOWS.format(45))
def session_windows_45s(m: Model) -> DataFrame:
    return presence.windows(m.ops, 45)


@query(_WINDOWS.format(SIX_HOURS))
def session_windows_6h(m: Model) -> DataFrame:
    return presence.windows(m.ops, SIX_HOURS)


@query(_REPLAY.format(400_000) + "SELECT seq, file, user_id, uid, is_new FROM r WHERE op = 'join'")
def session_join_uid(m: Model) -> DataFrame:
    return presence.replayed(m.ops, 400_000).filter("op = 'join'").select("seq", "file", "user_id", "uid", "is_new")


@query(_REPLAY.format(400_000) + "SELECT seq, file, user_id, alive AS effective, CASE WHEN alive THEN uid END AS uid FROM r WHERE op = 'heartbeat'")
def heartbeat_effective(m: Model) -> DataFrame:
    return presence.replayed(m.ops, 400_000).filter("op = 'heartbeat'").select(
        "seq", "file", "user_id", F.col("alive").alias("effective"), F.when(F.col("alive"), F.col("uid")).alias("uid"),
    )


@query(_REPLAY.format(SIX_HOURS).rstrip() + f""",
b AS (SELECT *, lead(seq) OVER (PARTITION BY file, user_id ORDER BY seq) AS next_seq FROM (SELECT * FROM r WHERE alive OR op = 'leave')),
p AS (SELECT q.seq, b.user_id, b.uid, coalesce('User ' || u.uid, 'Editor') AS user_name FROM r q JOIN b ON b.file = q.file AND b.op <> 'leave' AND b.seq <= q.seq AND (b.next_seq IS NULL OR q.seq < b.next_seq) AND b.t >= q.t - {SIX_HOURS}
  LEFT JOIN users u ON u.uid = b.user_id WHERE q.op <> 'leave')
SELECT q.seq, q.file, q.user_id, q.op, '[' || coalesce(string_agg('{{"userId":' || p.user_id || ',"userName":"' || p.user_name || '","sessionUid":' || p.uid || '}}', ',' ORDER BY p.user_id), '') || ']' AS participants
FROM r q LEFT JOIN p USING (seq) WHERE q.op <> 'leave' GROUP BY ALL
""")
def presence_at_request(m: Model) -> DataFrame:
    """The list of participants that each join and each heartbeat was answered with."""
    return presence.responses(m.ops, user_names(m), SIX_HOURS).withColumn("participants", F.to_json("participants"))


SAVE_REPLAY_SQL = """
WITH RECURSIVE o AS (SELECT file, seq, user_id, op, row_number() OVER (PARTITION BY file ORDER BY seq) AS k FROM ops WHERE op IN ('join', 'save')),
f AS (
  SELECT file, k, seq, user_id, CASE op WHEN 'join' THEN 'load' ELSE 'skipped' END AS status, 0 AS c, CASE op WHEN 'join' THEN MAP {user_id: 0} ELSE MAP {-1::BIGINT: 0} END AS known FROM o WHERE k = 1
  UNION ALL
  SELECT o.file, o.k, o.seq, o.user_id,
    CASE WHEN o.op = 'join' THEN 'load' WHEN f.known[o.user_id] IS NULL THEN 'skipped' WHEN f.known[o.user_id] = f.c THEN 'accepted' ELSE 'conflict' END,
    CASE WHEN o.op = 'save' AND f.known[o.user_id] = f.c THEN f.c + 1 ELSE f.c END,
    CASE WHEN o.op = 'join' THEN map_concat(f.known, MAP {o.user_id: f.c}) WHEN f.known[o.user_id] = f.c THEN map_concat(f.known, MAP {o.user_id: f.c + 1}) ELSE f.known END
  FROM f JOIN o ON o.file = f.file AND o.k = f.k + 1)
SELECT seq, file, user_id, status, c AS revision FROM f WHERE status <> 'load'
"""


@query(SAVE_REPLAY_SQL)
def save_replay(m: Model) -> DataFrame:
    return revisions.replayed(m.ops)


@query("""
WITH q AS (SELECT doc_id AS request_id, CASE doc_id % 6 WHEN 0 THEN '  ' WHEN 1 THEN '1:/none.docx' ELSE ' ' || file_identifier END AS file, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '1:/nowhere' ELSE file_identifier END AS folder FROM files)
SELECT request_id, q.file, CASE WHEN trim(q.file) = '' THEN 400 WHEN f.kind IS NULL OR f.kind <> 'file' THEN 404 WHEN lower(f.extension) <> 'docx' THEN 415 ELSE 200 END AS status,
  CASE WHEN q.folder = '' THEN 400 WHEN g.kind IS NULL OR g.kind <> 'folder' THEN 404 ELSE 200 END AS folder_status
FROM q LEFT JOIN files f ON f.file_identifier = trim(q.file) LEFT JOIN files g ON g.file_identifier = q.folder
""")
def file_resolve_status(m: Model) -> DataFrame:
    k = F.col("doc_id")
    asked = m.files.select(
        k.alias("request_id"), F.when(k % 6 == 0, "  ").when(k % 6 == 1, "1:/none.docx").otherwise(F.concat(
            F.lit(" "), F.col("file_identifier"),
        )).alias("file"), F.when(k % 3 == 0, "").when(k % 3 == 1, "1:/nowhere").otherwise(F.col("file_identifier")).alias("folder")
    )
    folders = files_of.resolve_folders(asked.select("request_id", "folder"), m.files).select("request_id", F.col("status").alias("folder_status"))
    return files_of.resolve(asked.select("request_id", "file"), m.files).join(folders, "request_id")


@query("SELECT doc_id, CASE WHEN size > 0 AND doc_id % 11 = 0 THEN 500 ELSE 200 END AS status FROM files")
def read_integrity(m: Model) -> DataFrame:
    content = F.when(F.col("doc_id") % 11 != 0, F.encode("text", "utf-8"))
    return m.files.select("doc_id", F.when(files_of.unreadable(F.col("size"), content), 500).otherwise(200).alias("status"))


_JUDGED = """
WITH w AS (SELECT r.request_id, r.uid, r.doc_id, f.storage_id, coalesce((u.is_admin OR coalesce(g.storage_right, false)) AND r.file_right, false) AND f.storage_id IS NOT NULL AS ok, coalesce(g.may_add, false) AS may_add
  FROM requests r LEFT JOIN files f ON f.doc_id = r.doc_id LEFT JOIN users u ON u.uid = r.uid LEFT JOIN grants g ON g.uid = r.uid AND g.storage_id = f.storage_id)
"""


@query(_JUDGED + "SELECT request_id, uid, doc_id FROM w WHERE ok")
def acl_read(m: Model) -> DataFrame:
    """The requests, of all users and documents, that may read."""
    return files_of.judged(m.requests, m.files, m.users, m.grants).filter("read_status = 200").select("request_id", "uid", "doc_id")


@query(_JUDGED + "SELECT request_id, uid, doc_id, CASE WHEN ok THEN '1' ELSE '0' END AS can_write, ok AND may_add AS can_add, CASE WHEN ok THEN 'editing' ELSE 'viewing' END AS mode FROM w WHERE storage_id IS NOT NULL")
def acl_write(m: Model) -> DataFrame:
    """What each request for a document that exists may do with it."""
    return files_of.judged(m.requests, m.files, m.users, m.grants).filter("read_status <> 404").drop("read_status")


@query(_JUDGED + "SELECT request_id, uid, doc_id, CASE WHEN storage_id IS NULL THEN 404 WHEN ok THEN 200 ELSE 403 END AS read_status, CASE WHEN ok THEN '1' ELSE '0' END AS can_write, ok AND may_add AS can_add, CASE WHEN ok THEN 'editing' ELSE 'viewing' END AS mode FROM w")
def acl_requests(m: Model) -> DataFrame:
    return files_of.judged(m.requests, m.files, m.users, m.grants)


@query("SELECT file_identifier, '/edit?file=' || url_encode(file_identifier) AS url, unnest(['primary', 'secondary']) AS action FROM files WHERE kind = 'file' AND lower(extension) = 'docx' AND doc_id % 4 <> 0")
def file_actions(m: Model) -> DataFrame:
    return files_of.actions(m.files, "/edit", F.col("doc_id") % 4 != 0)


@query(r"""
WITH g AS (SELECT doc_id, folder, CASE doc_id % 40 WHEN 7 THEN 'doc' || (doc_id % 25) || '_01.docx' WHEN 8 THEN 'doc' || (doc_id % 25) || '_03.docx' ELSE name END AS name FROM files WHERE lower(extension) = 'docx'),
n AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY doc_id) - 1 AS j, substr(name, 1, length(name) - 5) AS base, substr(name, length(name) - 4) AS tail FROM g),
t AS (SELECT folder, regexp_extract(base, '^(.*)_(\d{2,9})$', 1) AS base, tail, CAST(regexp_extract(base, '^(.*)_(\d{2,9})$', 2) AS BIGINT) AS t FROM n WHERE j = 0 AND regexp_matches(base, '_\d{2,9}$')),
i AS (SELECT *, row_number() OVER (PARTITION BY folder, base, tail ORDER BY t) AS i FROM t),
k AS (SELECT n.doc_id, n.j + count(i.t) AS k FROM n LEFT JOIN i ON i.folder = n.folder AND i.base = n.base AND i.tail = n.tail AND i.t - i.i < n.j WHERE n.j > 0 GROUP BY n.doc_id, n.j)
SELECT doc_id, folder, name, CASE WHEN j = 0 THEN name ELSE base || '_' || CASE WHEN k < 10 THEN '0' || k ELSE CAST(k AS VARCHAR) END || tail END AS stored_name FROM n LEFT JOIN k USING (doc_id)
""")
def name_collisions(m: Model) -> DataFrame:
    """Documents with either case of the extension; some have names that others would get as their suffixed ones."""
    n = F.col("doc_id")
    taken = lambda end: F.concat(F.lit("doc"), (n % 25).cast("string"), F.lit(end))
    name = F.when(n % 40 == 7, taken("_01.docx")).when(n % 40 == 8, taken("_03.docx")).otherwise(F.col("name"))
    return files_of.without_collisions(m.files.filter("lower(extension) = 'docx'").select("doc_id", "folder", name.alias("name")), "doc_id")


@query(sessions_sql(SIX_HOURS) + "SELECT users.uid, username, coalesce(nullif(trim(real_name, ' ' || chr(9)), ''), coalesce(username, 'Editor')) AS user_name, count(*) AS sessions FROM session_rows JOIN users ON users.uid = user_id GROUP BY ALL")
def session_names(m: Model) -> DataFrame:
    counted = presence.sessions(m.ops, SIX_HOURS).groupBy(F.col("user_id").alias("uid")).agg(F.count(F.lit(1)).alias("sessions"))
    return m.users.join(counted, "uid").select("uid", "username", display_name(F.col("real_name"), F.col("username")).alias("user_name"), "sessions")


@query(sessions_sql(SIX_HOURS) + f""",
v AS (SELECT file, max(seq) AS uid, count(*) AS revision, arg_max(user_id, seq) AS saved_by, arg_max(t, seq) AS changed_at FROM ops WHERE op = 'save' GROUP BY file),
a AS (SELECT file, count(*) AS n FROM session_rows, clock WHERE NOT deleted AND last_heartbeat >= now - {SIX_HOURS} GROUP BY file)
SELECT f.file, coalesce(v.revision, 0) AS revision, coalesce(v.saved_by, 0) AS saved_by, coalesce(v.changed_at, 0) AS changed_at, coalesce(a.n, 0) AS active
FROM (SELECT DISTINCT file FROM ops) f LEFT JOIN v USING (file) LEFT JOIN a USING (file)
""")
def file_overview(m: Model) -> DataFrame:
    """For every file: current revision, who saved it, when, and how many editors are active."""
    saves = m.ops.filter("op = 'save'").groupBy("file").agg(
        F.count(F.lit(1)).alias("revision"), F.max_by("user_id", "seq").alias("saved_by"),
        F.max_by("t", "seq").alias("changed_at"),
    )
    joined = presence_count(m).join(saves, "file", "left")
    return joined.select("file", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("revision", "saved_by", "changed_at")], "active").orderBy("file")
