"""JSON payloads, labels, messages, text rewriting and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources, streaming
from ..functions import messages, rewriting
from ..functions import scalars as S
from ..operators import presence, revisions
from ..schemas import STYLE
from ..tables import new_folder
from .collaboration_queries import COLLABORATORS, SIX_HOURS, SAVE_REPLAY_SQL, sessions_sql, windows_sql
from .model import Model
from .registry import query

#: Labels of both locales that these queries look up.
LABELS = {
    ("en", "editor.saved"): "Saved", ("en", "editor.saving"): "Saving…", (
        "en", "editor.saveFailed",
    ): "Save failed", ("en", "editor.download"): "Download", ("en", "editor.empty"): "",
    ("de", "editor.saved"): "Gespeichert", ("de", "editor.download"): "Herunterladen",
}
MOST_LABELS = 10_000
RULES = [("first", "the ", "THE "), ("second", "la ", "LA "), ("third", "der ", "DER ")]
MANIFEST_TEXT = '{"main.js": {"file": "main-1.js", "css": ["main-1.css", "b.css"]}, "plain.js": {"file": "plain-1.js"}, "style.css": {"file": "assets/style-1.css"}}'
HOSTS = ["ththth.example.net", "thther.example.org", "therha.example.com"]
_HOSTS_SQL = "('ththth.example.net', 'thther.example.org', 'therha.example.com')"


@query(r"""
WITH p AS (SELECT event_id, event_id % 7 AS k FROM bodies)
SELECT event_id, CASE WHEN k < 2 THEN 400 ELSE 200 END AS status,
  CASE k WHEN 3 THEN '1:/f' || event_id || '.docx' WHEN 4 THEN '1:/g.docx' WHEN 5 THEN '' END AS file,
  CASE WHEN k < 2 THEN NULL WHEN k = 3 THEN 99999999999 + event_id WHEN k = 4 THEN event_id WHEN k = 5 THEN 0 ELSE -1 END AS revision,
  CASE WHEN k < 2 THEN NULL WHEN k = 4 THEN 12 WHEN k = 6 THEN -4 ELSE 0 END AS session_uid,
  CASE WHEN k < 2 THEN NULL ELSE k = 4 END AS session_ok
FROM p
""")
def payload_parse(m: Model) -> DataFrame:
    rows = m.bodies.withColumn("p", sources.payload(F.col("body")))
    there = F.col("p").isNotNull()
    uid = F.when(there, S.php_int(F.col("p.sessionUid")))
    return rows.select(
        "event_id", F.when(there, 200).otherwise(400).alias("status"), F.col("p.file").alias("file"),
        F.when(there, S.php_int(F.col("p.revision"), -1)).alias("revision"), uid.alias("session_uid"),
        (uid > 0).alias("session_ok"),
    )


@query("""
WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE ' remembered ' END AS m, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'q' || doc_id END AS q, CASE doc_id % 7 WHEN 0 THEN NULL ELSE 'b' || doc_id END AS b FROM documents)
SELECT doc_id, trim(coalesce(nullif(trim(m), ''), q, b, '')) AS file FROM r
""")
def param_resolve(m: Model) -> DataFrame:
    n, i = F.col("doc_id"), F.col("doc_id").cast("string")
    remembered = F.when(n % 3 == 0, "  ").when(n % 3 == 2, " remembered ")
    q = F.when(n % 5 == 1, "").when(n % 5 != 0, F.concat(F.lit("q"), i))
    b = F.when(n % 7 != 0, F.concat(F.lit("b"), i))
    return m.table("documents").select("doc_id", sources.parameter(remembered, q, b).alias("file"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END AS ok, CASE WHEN doc_id % 2 = 1 THEN 'bad ' || lang END AS error, CASE WHEN doc_id % 2 = 0 THEN source END AS name, 2 AS entries FROM documents""")
def response_envelope(m: Model) -> DataFrame:
    ok = F.col("doc_id") % 2 == 0
    content = F.when(
        ok, F.create_map(F.lit("name"), F.col("source"), F.lit("ok"), F.lit("no")),
    ).otherwise(F.create_map(F.lit("error"), F.concat(F.lit("bad "), F.col("lang"))))
    e = sources.envelope(ok, content)
    return m.table("documents").select(
        "doc_id", F.try_element_at(e, F.lit("ok")).alias("ok"), F.try_element_at(e, F.lit("error")).alias("error"),
        F.try_element_at(e, F.lit("name")).alias("name"), F.size(e).alias("entries"),
    )


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 5 < 3 THEN CASE n_nationkey % 3 WHEN 0 THEN 'main-1.js' WHEN 1 THEN 'plain-1.js' END END AS script,
  CASE WHEN n_nationkey % 5 < 3 THEN CASE n_nationkey % 3 WHEN 0 THEN 'main-1.css' ELSE 'assets/style-1.css' END END AS style, n_nationkey % 5 <> 3 AS has_build FROM nation
""")
def manifest_resolve(m: Model) -> DataFrame:
    k = F.col("n_nationkey")
    text = F.when(k % 5 < 3, MANIFEST_TEXT).when(k % 5 == 3, "[broken").otherwise('["main.js"]')
    rows = m.table("nation").select("n_nationkey", sources.manifest(text).alias("e"))
    pick = lambda f: F.when(k % 3 == 0, f(F.col("e"), "main.js")).when(k % 3 == 1, f(F.col("e"), "plain.js")).otherwise(f(F.col("e"), "missing.js"))
    return rows.select(
        "n_nationkey", pick(sources.manifest_script).alias("script"), pick(sources.manifest_style).alias("style"),
        F.col("e").isNotNull().alias("has_build"),
    )


_LABELS_SQL = "(VALUES " + ", ".join(f"('{a}', '{k}', '{t}')" for (a, k), t in LABELS.items()) + ") AS l(locale, key, text)"


@query(f"""
WITH a AS (SELECT uid, CASE WHEN lang NOT IN ('', 'default') AND lower(lang) LIKE 'de%' THEN 'de' ELSE 'en' END AS locale, CASE uid % 4 WHEN 0 THEN 'editor.saved' WHEN 1 THEN 'editor.empty' WHEN 2 THEN 'editor.download' ELSE 'editor.none' END AS key FROM users)
SELECT uid, a.locale, a.key, coalesce(nullif(l.text, ''), a.key) AS text FROM a LEFT JOIN {_LABELS_SQL} ON l.locale = a.locale AND l.key = a.key
""")
def label_lookup(m: Model) -> DataFrame:
    k = F.col("uid") % 4
    asked = m.users.select(
        "uid", S.locale(F.col("lang")).alias("locale"),
        F.when(k == 0, "editor.saved").when(k == 1, "editor.empty").when(k == 2, "editor.download").otherwise("editor.none").alias("key"),
    )
    return with_labels(asked, label_frame(m)).select("uid", "locale", "key", "text")


def label_frame(m: Model) -> DataFrame:
    return m.spark.createDataFrame([(a, k, t) for (a, k), t in LABELS.items()], "locale string, key string, text string")


def with_labels(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts by (locale, key); the key where there is none, or an empty one.  A catalogue has some dozens of rows and is broadcast up to MOST_LABELS."""
    few = len(labels.limit(MOST_LABELS + 1).collect()) <= MOST_LABELS
    found = asked.join(F.broadcast(labels) if few else labels, ["locale", "key"], "left")
    return found.withColumn("text", F.coalesce(S.filled(F.col("text")), F.col("key")))


@query("""
SELECT uid, i AS level, CASE WHEN uid % 3 = 0 AND i = 1 THEN 'Main title' WHEN uid % 2 = 0 THEN 'H' || i ELSE 'Heading ' || i END AS title FROM users, range(1, 5) r(i)
""")
def label_defaults(m: Model) -> DataFrame:
    given = F.map_concat(
        F.when(
            F.col("uid") % 2 == 0, F.create_map(*[x for i in range(1, 5) for x in (F.lit(f"heading{i}"), F.lit(f"H{i}"))]),
        ).otherwise(F.create_map().cast("map<string,string>")),
        F.when(F.col("uid") % 3 == 0, F.create_map(F.lit("heading1Title"), F.lit("Main title"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    rows = m.users.select("uid", given.alias("given"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"))).alias("level"))
    key = F.concat(F.lit("heading"), F.col("level").cast("string"))
    title = F.coalesce(
        F.try_element_at("given", F.concat(key, F.lit("Title"))), F.try_element_at("given", key),
        F.concat(F.lit("Heading "), F.col("level").cast("string")),
    )
    return rows.select("uid", "level", title.alias("title"))


@query(r"""
SELECT doc_id, '{"name":"a\u003Cb\u003E\u0026\u0027\u0022' || lang || '","source":"' || source || '"}' AS labels FROM documents
""")
def label_json(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", S.html_safe_json(F.struct(F.concat(F.lit("a<b>&'\""), F.col("lang")).alias("name"), "source")).alias("labels"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'json ' || lang ELSE 'legacy ' || source END AS title FROM documents")
def label_json_fallback(m: Model) -> DataFrame:
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.concat(F.lit('{"title":"json '), F.col("lang"), F.lit('"}'))).when(k == 1, "{broken").otherwise("")
    legacy = F.create_map(F.lit("title"), F.concat(F.lit("legacy "), F.col("source")))
    parsed = F.from_json(text, "map<string,string>")
    return m.table("documents").select("doc_id", F.try_element_at(F.coalesce(F.when(F.size(parsed) > 0, parsed), legacy), F.lit("title")).alias("title"))


@query("SELECT doc_id, 'Saved to ' || file_identifier AS label, 'Hi {name}, file ' || name AS named FROM files")
def label_format(m: Model) -> DataFrame:
    return m.files.select(
        "doc_id", F.format_string("Saved to %s", "file_identifier").alias("label"),
        messages.named(F.lit("Hi {name}, file {file}"), {"file": F.col("name")}).alias("named"),
    )


@query("""
SELECT event_id, CASE WHEN event_type IN ('signup', 'view') THEN 'success' WHEN event_type = 'error' THEN 'error' END AS level,
  CASE WHEN event_type IN ('signup', 'view') THEN CASE WHEN event_id % 3 = 0 THEN 'Gespeichert' ELSE 'Saved' END WHEN event_type = 'error' THEN 'Save failed' END AS title,
  CASE WHEN event_type IN ('signup', 'view') THEN CASE WHEN event_id % 5 = 0 THEN 'x.docx' ELSE 'to ' || user_id END WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'status ' || user_id ELSE 'Save failed' END END AS message FROM events
""")
def status_toast(m: Model) -> DataFrame:
    kind, e, user = F.col("event_type"), F.col("event_id"), F.col("user_id").cast("string")
    status = F.when(kind.isin("signup", "view"), "saved").when(kind == "error", "error").when(kind == "click", "saving").otherwise("ready")
    detail = F.when(e % 2 == 0, F.concat(F.lit("status "), user)).otherwise("")
    path = F.when(e % 5 != 0, F.concat(F.lit("to "), user)).otherwise("")
    toast = S.toast(status, detail, path, F.lit("x.docx"), {"saved": F.when(e % 3 == 0, "Gespeichert").otherwise("")})
    return m.table("events").select("event_id", toast.alias("t")).select("event_id", "t.*")


@query("""
SELECT p_partkey, CASE p_size % 6 WHEN 1 THEN '1 editor online' ELSE (p_size % 6) || ' editors online' END AS collaborators,
  CASE p_size % 6 WHEN 0 THEN 'nobody' WHEN 1 THEN 'one' ELSE (p_size % 6) || ' others' END || ' at {count}' || p_brand AS exact, CASE p_size % 6 WHEN 1 THEN '{a 1}' ELSE 'last' END AS nested FROM part
""")
def icu_plural(m: Model) -> DataFrame:
    n = F.col("p_size") % 6
    exact = messages.formatted(
        F.lit("{count, plural, =0 {nobody} one {one} other {# others}} at {brand}"),
        {"count": n, "brand": F.concat(F.lit("{count}"), F.col("p_brand"))},
    )
    nested = messages.plural(F.lit("{count, plural, one {{a #}} other {more} other {last}}"), {"count": n})
    return m.table("part").select("p_partkey", messages.plural(F.lit(COLLABORATORS), {"count": n}).alias("collaborators"), exact.alias("exact"), nested.alias("nested"))


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'folder' ELSE 'other' END AS field, CASE WHEN event_id % 3 = 0 THEN '' ELSE '1:/' || user_id END AS val, event_type = 'click' AS ctrl, event_type = 'view' AS meta, event_id % 5 = 0 AS shift FROM events)
SELECT event_id, field = 'folder' AND val <> '' AND user_id % 7 <> 0 AND user_id % 11 <> 0 AS accepted, (ctrl OR meta) AND NOT shift AND event_id % 4 <> 0 AND user_id % 3 <> 0 AS saves FROM e JOIN events USING (event_id)
""")
def ui_message_filter(m: Model) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    value = F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("1:/"), F.col("user_id").cast("string")))
    can_write = S.flag(e % 4 != 0)
    user, own = F.col("user_id"), F.lit("https://cms.example.org")
    origin = F.when(user % 7 == 0, "https://other.example.org").otherwise(own)
    action = F.when(user % 11 == 0, "folder:removed").otherwise("folder:chosen")
    accepted = S.accepts_message(origin, own, action, "folder:chosen", F.when(e % 2 == 0, "folder").otherwise("other"), value)
    key = F.when(user % 3 == 0, "x").when(user % 3 == 1, "S").otherwise("s")
    return m.table("events").select("event_id", accepted.alias("accepted"), S.saves_by_key(key, kind == "click", kind == "view", e % 5 == 0, can_write).alias("saves"))


@query("SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 = 0 AS gated FROM documents")
def rewrite_gate(m: Model) -> DataFrame:
    n = F.col("doc_id")
    path = F.concat(F.when(n % 2 == 0, "/node_modules/editor-core").otherwise("/src/own"), F.when(n % 3 == 0, "/dist/index.mjs").otherwise("/lib/index.mjs"))
    return m.table("documents").select("doc_id", rewriting.in_gate(path, "editor-core").alias("gated"))


_DONE = "THE "
_REWRITE = """
CASE WHEN contains({0}, 'THE ') THEN NULL
 WHEN contains({0}, 'the ') THEN substr({0}, 1, strpos({0}, 'the ') - 1) || 'THE ' || substr({0}, strpos({0}, 'the ') + 4)
 WHEN contains({0}, 'la ') THEN substr({0}, 1, strpos({0}, 'la ') - 1) || 'LA ' || substr({0}, strpos({0}, 'la ') + 3)
 WHEN contains({0}, 'der ') THEN substr({0}, 1, strpos({0}, 'der ') - 1) || 'DER ' || substr({0}, strpos({0}, 'der ') + 4) END
"""


@query(f"""
SELECT doc_id, sha256({_REWRITE.format("text")}) AS rewritten, CASE WHEN contains(text, 'THE ') THEN NULL WHEN contains(text, 'the ') THEN 'first' WHEN contains(text, 'la ') THEN 'second' WHEN contains(text, 'der ') THEN 'third' END AS rule FROM documents
""")
def rewrite_rules(m: Model) -> DataFrame:
    return m.table("documents").select(
        "doc_id", S.sha256(rewriting.rewrite(F.col("text"), RULES, _DONE)).alias("rewritten"),
        rewriting.applied_rule(F.col("text"), RULES, _DONE).alias("rule"),
    )


_RULE = "CASE WHEN contains({0}, 'THE ') THEN NULL WHEN contains({0}, 'the ') THEN 'first' WHEN contains({0}, 'la ') THEN 'second' WHEN contains({0}, 'der ') THEN 'third' END"


@query(f"""
WITH o AS (SELECT doc_id, {_RULE.format("text")} AS first_rule, {_REWRITE.format("text")} AS once FROM documents)
SELECT doc_id, first_rule, {_RULE.format("once")} AS again, once IS NULL OR {_RULE.format("once")} IS NULL AS unchanged FROM o
""")
def rewrite_idempotent(m: Model) -> DataFrame:
    """Which rule a second rewrite applies: none after the first rule, whose result is marked as done; the others may apply again."""
    once = m.table("documents").select(
        "doc_id", rewriting.applied_rule(F.col("text"), RULES, _DONE).alias("first_rule"),
        rewriting.rewrite(F.col("text"), RULES, _DONE).alias("once"),
    )
    again = rewriting.applied_rule(F.col("once"), RULES, _DONE)
    return once.select("doc_id", "first_rule", again.alias("again"), again.isNull().alias("unchanged"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _shape_sql(name: str, code: str) -> str:
    rules, done = rewriting.SHAPES[name]
    cases = [f"WHEN contains({code}, {_sql(a)}) THEN substr({code}, 1, strpos({code}, {_sql(a)}) - 1) || {_sql(b)} || substr({code}, strpos({code}, {_sql(a)}) + {len(a)})" for _, a, b in rules]
    guard = f"WHEN contains({code}, {_sql(done)}) THEN NULL " if done else ""
    return f"CASE {guard}{' '.join(cases)} END"


_NEEDLES = [needle for rules, _ in rewriting.SHAPES.values() for _, needle, _ in rules]
_CODE_SQL = f"SELECT doc_id, 'pre ' || CASE doc_id % 5 {' '.join(f'WHEN {k} THEN {_sql(n)}' for k, n in enumerate(_NEEDLES))} ELSE lang END || ' ' || source || CASE WHEN doc_id % 5 < {len(_NEEDLES)} AND doc_id % 10 > 4 THEN {_sql(_NEEDLES[0])} ELSE '' END AS code FROM documents"


@query(f"WITH c AS ({_CODE_SQL}), r AS (SELECT *, {', '.join(_shape_sql(n, 'code') + f' AS {n}' for n in rewriting.SHAPES)} FROM c) SELECT doc_id, {', '.join(f'{n}, {_shape_sql(n, n)} AS {n}_again' for n in rewriting.SHAPES)} FROM r")
def rewrite_shapes(m: Model) -> DataFrame:
    """The three bundle rewrites on modules that hold their needles, and each again on its own result."""
    k = F.col("doc_id") % 5
    needle = F.col("lang")
    for i, n in enumerate(_NEEDLES):
        needle = F.when(k == i, n).otherwise(needle)
    more = F.when((k < len(_NEEDLES)) & (F.col("doc_id") % 10 > 4), _NEEDLES[0]).otherwise("")
    code = m.table("documents").select("doc_id", F.concat(F.lit("pre "), needle, F.lit(" "), "source", more).alias("code"))
    once = code.select("doc_id", *[rewriting.rewrite(F.col("code"), *shape).alias(n) for n, shape in rewriting.SHAPES.items()])
    return once.select("doc_id", *[c for n, shape in rewriting.SHAPES.items() for c in (F.col(n), rewriting.rewrite(F.col(n), *shape).alias(f"{n}_again"))])


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Normal,Heading' || (doc_id % 6) ELSE 'Normal' END AS styles FROM documents WHERE doc_id % 6 BETWEEN 1 AND 4 UNION ALL SELECT doc_id, 'Normal' FROM documents WHERE doc_id % 6 IN (0, 5)")
def style_filter(m: Model) -> DataFrame:
    n = F.col("doc_id")
    style = lambda i, name: F.struct(*[(i if f.name == "styleId" else name if f.name == "name" else F.lit(None).cast(f.dataType)).alias(f.name) for f in STYLE])
    second = F.when(n % 2 == 0, F.concat(F.lit("Heading"), (n % 6).cast("string"))).otherwise("Title")
    styles = F.array(style(F.lit("Normal"), F.lit("Normal")), style(second, F.lit("x")), style(F.lit("MyHeading1"), F.lit("y")))
    picked = rewriting.picked_styles(styles)
    return m.table("documents").select("doc_id", F.concat_ws(",", F.transform(picked, lambda s: s["styleId"])).alias("styles"))


@query(f"""
WITH u AS (SELECT page_id, coalesce(lower(regexp_extract(CASE WHEN page_id % 9 = 0 THEN 'not a url' ELSE url END, '^[a-z]+://([^/?#]+)', 1)), '') IN {_HOSTS_SQL} AS blocked FROM pages)
SELECT page_id, blocked, blocked AND page_id % 4 <> 0 AND page_id % 3 <> 0 AS link_blocked FROM u
""")
def url_block(m: Model) -> DataFrame:
    """By host alone, and as the link filter does it: style sheets of link elements only."""
    n = F.col("page_id")
    tag, rel = F.when(n % 4 == 0, "SCRIPT").otherwise("LINK"), F.when(n % 3 == 0, "icon").when(n % 3 == 1, "preload StyleSheet").otherwise("stylesheet")
    url = F.when(F.col("page_id") % 9 == 0, "not a url").when(F.col("page_id") % 9 == 1, F.regexp_replace("url", "example", "EXAMPLE")).otherwise(F.col("url"))
    return m.table("pages").select("page_id", S.host_blocked(url, HOSTS).alias("blocked"), S.link_blocked(tag, rel, url, HOSTS).alias("link_blocked"))


@query("""
WITH r AS (SELECT event_id, 200 + event_id % 4 * 100 + event_id % 3 AS status, event_id % 6 AS k FROM events)
SELECT event_id, k NOT IN (0, 1, 3) AND k <> 5 AND status BETWEEN 200 AND 299 AS ok,
  CASE WHEN k = 0 THEN 'Invalid server response.' WHEN k = 1 THEN 'bad' WHEN status BETWEEN 200 AND 299 THEN CASE WHEN k = 4 THEN 'odd' END WHEN k = 4 THEN 'odd' WHEN k = 3 THEN NULL ELSE 'Status ' || status END AS error, status AS httpStatus FROM r
""")
def client_response(m: Model) -> DataFrame:
    """Responses as the client reads them: no JSON, errors with and without a text, lists, statuses of all kinds."""
    e = F.col("event_id")
    body = F.when(e % 6 == 0, "<html>").when(
        e % 6 == 1, '{"ok":false,"error":"bad"}',
    ).when(e % 6 == 2, '{"ok":true}').when(e % 6 == 3, '{"ok":false}').when(e % 6 == 4, '{"ok":true,"error":"odd"}').otherwise("[]")
    status = (200 + e % 4 * 100 + e % 3).alias("status")
    rows = m.table("events").select("event_id", status, body.alias("body"))
    return rows.select(
        "event_id",
        sources.response(F.col("status"), F.concat(F.lit("Status "), F.col("status").cast("string")), F.col("body")).alias("r"),
    ).select("event_id", "r.*")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, 200 AS status FROM documents")
def binary_files(m: Model) -> DataFrame:
    """Documents written as files, each over an older one, and read back with their integrity check; a text may be empty."""
    folder = new_folder(m.spark, "files")
    named = m.table("documents").select(
        F.format_string("%d/%d.docx", F.pmod("doc_id", F.lit(256)), "doc_id").alias("name"),
        F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"),
    ).repartition(int(m.spark.conf.get("spark.sql.shuffle.partitions")))
    for content in (F.encode(F.lit("older"), "utf-8"), F.col("content")):
        sources.write_binaries(named.withColumn("content", content), folder).write.format("noop").mode("overwrite").save()
    back = sources.checked(sources.binary_files(m.spark, folder))
    return back.select(F.regexp_extract("name", r"^(\d+)", 1).cast("bigint").alias("doc_id"), S.sha256(F.col("content")).alias("content_hash"), "size", "status")


def _as_files(m: Model, kind: str, files: DataFrame) -> str:
    """A new folder with text files (name, text)."""
    folder = new_folder(m.spark, kind)
    sources.write_binaries(files.select("name", F.encode("text", "utf-8").alias("content")), folder).write.format("noop").mode("overwrite").save()
    return folder


@query("""
SELECT r_regionkey, CASE WHEN r_regionkey % 3 <> 2 THEN 'main-' || r_regionkey || '.js' END AS script,
  CASE WHEN r_regionkey % 3 = 0 THEN lower(r_name) || '.css' ELSE 'assets/style-1.css' END AS style, (SELECT count(*) FROM region WHERE r_regionkey % 3 <> 2) + 1 AS entries FROM region
""")
def manifest_of_a_file(m: Model) -> DataFrame:
    """A build manifest written with an entry for most regions, read back, and asked for each."""
    k = F.col("r_regionkey")
    entry, css = F.concat(F.lit("r"), k.cast("string"), F.lit(".js")), F.concat(F.lower("r_name"), F.lit(".css"))
    value = F.struct(F.concat(F.lit("main-"), k.cast("string"), F.lit(".js")).alias("file"), F.when(k % 3 == 0, F.array(css)).alias("css"))
    built = m.table("region").filter(k % 3 != 2).select(entry.alias("key"), value.alias("value"))
    style = m.spark.range(1).select(F.lit("style.css").alias("key"), F.struct(F.lit("assets/style-1.css").alias("file"), F.lit(None).cast("array<string>").alias("css")).alias("value"))
    text = built.unionByName(style).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("text"))
    read = sources.manifest_file(m.spark, _as_files(m, "manifest", text.withColumn("name", F.lit("manifest.json"))))
    asked = m.table("region").select("r_regionkey", entry.alias("entry")).join(F.broadcast(read))
    return asked.select("r_regionkey", sources.manifest_script(F.col("entries"), F.col("entry")).alias("script"), sources.manifest_style(F.col("entries"), F.col("entry")).alias("style"), F.size("entries").cast("long").alias("entries"))


@query("""
SELECT locale, 'nation.' || n_nationkey AS key, CASE WHEN n_nationkey % 7 = 3 THEN '' WHEN locale = 'de' THEN lower(n_name) ELSE n_name END AS text FROM nation, (VALUES ('en'), ('de')) l(locale)
""")
def labels_of_files(m: Model) -> DataFrame:
    """Label catalogues written as XML files, one for each locale and region, and read back; an empty text stays empty."""
    locales = F.explode(F.array(F.lit("en"), F.lit("de"))).alias("locale")
    k = F.col("n_nationkey")
    text = F.when(k % 7 == 3, "").when(F.col("locale") == "de", F.lower("n_name")).otherwise(F.col("n_name"))
    unit = F.format_string('<unit id="nation.%d"><segment><source>%s</source></segment></unit>', k, text)
    units = m.table("nation").select("n_regionkey", k, "n_name", locales).groupBy("locale", "n_regionkey").agg(F.concat_ws("", F.sort_array(F.collect_list(unit))).alias("units"))
    whole = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><xliff><file id="d">'), "units", F.lit("</file></xliff>"))
    folder = _as_files(m, "labels", units.select(F.format_string("%s.%d.xlf", "locale", "n_regionkey").alias("name"), whole.alias("text")))
    read = sources.labels(m.spark, {a: f"{folder}/{a}.*.xlf" for a in ("en", "de")})
    return read.select("locale", "key", F.coalesce("text", F.lit("")).alias("text"))


@query("SELECT sha256(string_agg('chunk ' || r_regionkey || ' ' || r_name, chr(10) ORDER BY r_regionkey)) AS digest, CAST(count(*) AS BIGINT) AS modules FROM region")
def modules_of_a_build(m: Model) -> DataFrame:
    """All modules of a build folder as one text, by name."""
    folder = new_folder(m.spark, "modules")
    rows = m.table("region").select(
        F.concat(F.lit("chunk-"), F.col("r_regionkey").cast("string"), F.lit(".mjs")).alias("name"),
        F.encode(F.concat(F.lit("chunk "), F.col("r_regionkey").cast("string"), F.lit(" "), F.col("r_name")), "utf-8").alias("content"),
    )
    sources.write_binaries(rows, folder).write.format("noop").mode("overwrite").save()
    text = F.col("text")
    return sources.module_text(m.spark, folder).select(S.sha256(text).alias("digest"), F.size(F.split(text, "\n")).cast("bigint").alias("modules"))


@query("SELECT file_identifier, arg_max(revision, uid) AS revision, max(uid) AS uid, count(*) AS entries FROM revisions GROUP BY file_identifier")
def revision_append(m: Model) -> DataFrame:
    """The log written in two appends, one of which runs twice, and read for each file's latest revision."""
    path = new_folder(m.spark, "revisions")
    late = F.col("uid") >= 2
    for batch, part in ((0, ~late), (1, late), (1, late)):
        sources.append_revisions(m.revisions.filter(part), path, batch)
    log = m.spark.read.schema(m.revisions.schema).parquet(path)
    counted = log.groupBy("file_identifier").agg(F.count(F.lit(1)).alias("entries"))
    return revisions.latest(log).select("file_identifier", "revision", "uid").join(counted, "file_identifier")


@query(sessions_sql(SIX_HOURS) + "SELECT file, user_id, uid, file_hash, last_heartbeat, deleted, crdate, tstamp FROM session_rows")
def session_sink(m: Model) -> DataFrame:
    """Operations that come as a stream, written to the session table batch by batch; the table's state after it."""
    table, checkpoint = new_folder(m.spark, "sessions"), new_folder(m.spark, "state")
    folder = new_folder(m.spark, "ops")
    m.ops.repartition(4).write.parquet(folder)
    stream = sources.polled(m.spark, folder, streaming.OPS_SCHEMA, 1)
    streaming.polling(stream, streaming.session_log(table), checkpoint, every=None).awaitTermination()
    return presence.sessions(m.spark.read.schema(streaming.OPS_SCHEMA).parquet(table), SIX_HOURS)


#: Rows of a file that arrives, about; a file is read by one task.
ARRIVING = 50_000


def in_parts(m: Model, rows: DataFrame, order: str, parts: int = 4) -> tuple[str, int]:
    """`rows` as a folder of files that arrive part after part, in the order of a number; and how many files a part has."""
    folder = new_folder(m.spark, "arriving")
    lo, hi = rows.agg(F.min(order), F.max(order)).head()
    if lo is None:
        rows.write.parquet(folder)
        return folder, 1
    part = F.least(F.floor((F.col(order) - lo) * parts / (hi - lo + 1)), F.lit(parts - 1))
    counts = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
    files = max(1, min(counts.values()) // ARRIVING)
    for k in range(parts):
        own = rows.filter(part == k)
        if files == 1:
            own.coalesce(1).write.mode("append").parquet(folder)
        elif k in counts:  # each file gets rows, so that every part has as many
            own.repartition(files).write.mode("append").parquet(folder)
    return folder, files


def arriving(m: Model, rows: DataFrame, order: str, schema, parts: int = 4) -> DataFrame:
    """`rows` as a stream whose micro-batches follow each other in the order of a number."""
    folder, files = in_parts(m, rows, order, parts)
    return sources.polled(m.spark, folder, schema, files)


def _ops_stream(m: Model) -> DataFrame:
    """The operations as a stream of three micro-batches, in their order."""
    return arriving(m, m.ops, "seq", streaming.OPS_SCHEMA, 3)


def _closed_ops_stream(m: Model, ttl: int, late: int = 600) -> DataFrame:
    """The operations as a stream that ends with a row so late that all sessions of the operations are over; its own one stays open."""
    folder = new_folder(m.spark, "ops")
    end = m.ops.agg(F.max("t").alias("t")).filter("t is not null")
    end = end.select(
        F.lit(None).cast("bigint").alias("seq"), (F.col("t") + ttl + late + 1).alias("t"),
        F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("op"),
        F.lit(None).cast("string").alias("file"),
    )
    m.ops.unionByName(end).write.parquet(folder)
    return sources.polled(m.spark, folder, streaming.OPS_SCHEMA, 1_000_000)


@query(f"SELECT * FROM ({windows_sql(SIX_HOURS)})")
def presence_stream(m: Model) -> DataFrame:
    stream = streaming.presence_windows(_closed_ops_stream(m, SIX_HOURS), SIX_HOURS)
    return streaming.run_once(m.spark, stream, new_folder(m.spark, "windows"), new_folder(m.spark, "state"))


@query(SAVE_REPLAY_SQL)
def revision_stream(m: Model) -> DataFrame:
    stream = streaming.fold_saves(_ops_stream(m))
    return streaming.run_once(m.spark, stream, new_folder(m.spark, "saves"), new_folder(m.spark, "state"))


def _with_rocksdb(m: Model, stream, name: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream that keeps named states, which only this store can."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = m.spark.conf.get(key, None)
    m.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return streaming.run_once(m.spark, stream(), new_folder(m.spark, name), checkpoint or new_folder(m.spark, "state"))
    finally:
        m.spark.conf.unset(key) if before is None else m.spark.conf.set(key, before)


@query(SAVE_REPLAY_SQL)
def revision_state_stream(m: Model) -> DataFrame:
    """The replay of saves with its state as one value and one map in the state store."""
    return _with_rocksdb(m, lambda: streaming.replayed_saves(_ops_stream(m)), "saves")


_PAYLOADS = [
    ('{"file":"1:/a.docx","revision":true,"sessionUid":[7]}', "'1:/a.docx'", 1, 1), ('{"file":true,"revision":false,"sessionUid":{}}', "'1'", 0, 0), ('{"file":12,"revision":3.9,"sessionUid":"12abc"}', "'12'", 3, 12),
    ('{"file":{"a":1},"revision":null,"sessionUid":[]}', "'Array'", -1, 0), ('{"file":false,"revision":"-7","sessionUid":-2}', "''", -7, -2), ('{"file":"x","file":"y","revision":{"b":[]}}', "'y'", 1, 0), ("[1,2]", "NULL", -1, 0), ('{"file":1.0}', "'1'", -1, 0),
]


@query(f"""
SELECT event_id, CASE WHEN event_id % 11 < {len(_PAYLOADS)} THEN 200 ELSE 400 END AS status, CASE event_id % 11 {" ".join(f"WHEN {k} THEN {f}" for k, (_, f, _, _) in enumerate(_PAYLOADS))} END AS file,
  CASE event_id % 11 {" ".join(f"WHEN {k} THEN {r} + CASE WHEN {k} = 4 THEN -event_id * 10 ELSE 0 END" for k, (_, _, r, _) in enumerate(_PAYLOADS))} END AS revision, CASE event_id % 11 {" ".join(f"WHEN {k} THEN {u}" for k, (_, _, _, u) in enumerate(_PAYLOADS))} END AS session_uid FROM events
""")
def payload_variant(m: Model) -> DataFrame:
    """Request fields of any JSON type, cast as they are read; broken and scalar bodies, and those nested too deeply, are refused."""
    k, body = F.col("event_id") % 11, F.lit("7")
    for i, (text, *_) in enumerate(_PAYLOADS):
        body = F.when(k == i, text).otherwise(body)
    body = F.when(k == 4, F.replace(body, F.lit('"-7"'), F.concat(F.lit('"-'), F.col("event_id").cast("string"), F.lit('7x"')))).otherwise(body)
    body = F.when(k == 9, F.concat(F.lit('{"file":'), F.repeat(F.lit("["), 600), F.repeat(F.lit("]"), 600), F.lit("}"))).when(k == 10, "{broken").otherwise(body)
    p = sources.request_fields(F.col("body"))
    rows = m.table("events").select("event_id", body.alias("body")).select("event_id", p.alias("p"))
    return rows.select("event_id", F.when(F.col("p").isNull(), 400).otherwise(200).alias("status"), F.col("p.file").alias("file"), F.col("p.revision").alias("revision"), F.col("p.sessionUid").alias("session_uid"))


@query("SELECT uid, file_identifier, revision, content_hash, saved_by, changed_at FROM revisions WHERE file_identifier IN (SELECT max(file_identifier) FROM revisions) ORDER BY uid DESC LIMIT 1")
def revision_lookup(m: Model) -> DataFrame:
    """One file's latest revision from a log that is laid out for lookups."""
    path = new_folder(m.spark, "indexed")
    sources.write_indexed(m.revisions, path)
    log = m.spark.read.schema(m.revisions.schema).parquet(path)
    return revisions.latest_of(log, log.agg(F.max("file_identifier")).head()[0] or "")
