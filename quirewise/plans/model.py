"""The model's tables, derived from the driver's: operations, revisions, files, users, grants, names."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Model:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ops(self) -> DataFrame:
        kind = F.col("event_type")
        op = F.when(kind == "signup", "join").when(kind.isin("view", "click"), "heartbeat").when(kind == "error", "leave").otherwise("save")
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.table("events").select(
            F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "user_id", op.alias("op"), F.concat(
                F.lit("1:/user_upload/doc"), (k % 5).cast("string"), F.lit(".docx"),
            ).alias("file"),
        )

    @cached_property
    def revisions(self) -> DataFrame:
        name = F.concat(F.lit("1:/conversations/"), F.col("conv_id").cast("string"), F.lit(".docx"))
        return self.table("conversations").select(
            F.col("turn").alias("uid"), name.alias("file_identifier"), (F.col("turn") + 1).alias("revision"),
            F.sha2("text", 256).alias("content_hash"), F.col("role").alias("saved_by"), (F.col("turn") * 60).alias("changed_at"),
        )

    @cached_property
    def files(self) -> DataFrame:
        d, n = self.table("documents"), F.col("doc_id")
        ext = F.when(F.col("lang") == "en", "docx").when(F.col("lang") == "de", "DOCX").when(F.col("lang") == "fr", "doc").otherwise("pdf")
        name = F.concat(F.lit("doc"), (n % 50).cast("string"), F.lit("."), ext)
        return d.select(
            F.concat(
                F.lit("1:/"), F.col("source"), F.lit("/"), n.cast("string"), F.lit("/"), name,
            ).alias("file_identifier"), (n % 3 + 1).alias("storage_id"), F.col("source").alias("folder"), name.alias("name"), ext.alias("extension"),
            F.when(n % 17 == 0, "folder").otherwise("file").alias("kind"), F.octet_length("text").cast("bigint").alias("size"), "text", "doc_id",
        )

    @cached_property
    def users(self) -> DataFrame:
        k, name = F.col("c_custkey"), F.col("c_name")
        real = F.when(k % 3 == 0, F.concat(F.lit(" \t"), name, F.lit(" "))).when(k % 3 == 1, F.lit("  ")).otherwise(F.lit(None).cast("string"))
        user = F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.lower(name))
        lang = F.element_at(F.array(*map(F.lit, ("default", "de", "de_AT", "DE", "en", "fr", ""))), (F.col("c_nationkey") % 7 + 1).cast("int"))
        return self.table("customer").select(
            k.alias("uid"), user.alias("username"), real.alias("real_name"), lang.alias("lang"), (k % 10 == 0).alias("is_admin"),
            F.col("c_nationkey").alias("nation"),
        )

    @cached_property
    def grants(self) -> DataFrame:
        """Grants of every user on one storage; on the others they have none."""
        return self.users.select(
            "uid", (F.col("nation") % 3 + 1).cast("bigint").alias("storage_id"), (F.col("uid") % 2 == 0).alias("storage_right"),
            (F.col("uid") % 4 != 1).alias("may_add"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        """A request by each user, for each document and with each event; some users and documents don't exist."""
        own = self.users.select(F.concat(F.lit("u"), F.col("uid").cast("string")).alias("request_id"), "uid", F.col("uid").alias("doc_id"))
        more = self.table("events").select(
            F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("request_id"), F.col("user_id").alias("uid"),
            F.col("event_id").alias("doc_id"),
        )
        n = F.col("doc_id")
        each = self.table("documents").select(F.concat(F.lit("d"), n.cast("string")).alias("request_id"), (n * 7 % 150 + 1).alias("uid"), "doc_id")
        return own.unionAll(each).unionAll(more).withColumn("file_right", F.col("uid") % 3 != 0)

    @cached_property
    def names(self) -> DataFrame:
        """Raw file names as requests bring them, good and bad."""
        n, i = F.col("doc_id"), F.col("doc_id").cast("string")
        raw = (
            F.when(n % 8 == 0, F.concat(F.lit("  report"), i, F.lit(" "))).when(
                n % 8 == 1, F.concat(F.lit("a/b\\c"), i, F.lit(".DOCX")),
            ).when(n % 8 == 2, "..").when(n % 8 == 3, "dir/")
            .when(n % 8 == 4, "").when(n % 8 == 5, "x.doc").when(n % 8 == 6, F.concat(F.lit("\ttab"), i, F.lit(".docx\n"))).otherwise(F.concat(F.lit("..\\..\\y"), i))
        )
        return self.table("documents").select("doc_id", raw.alias("raw"))

    @cached_property
    def bodies(self) -> DataFrame:
        """Request bodies of the operations, some broken."""
        e, i = F.col("event_id"), F.col("event_id").cast("string")
        body = (
            F.when(e % 7 == 0, "").when(e % 7 == 1, "{broken").when(e % 7 == 2, "[1,2]").when(
                e % 7 == 3,
                F.concat(F.lit('{"file":"1:/f'), i, F.lit('.docx","revision":"'), (e + 99_999_999_999).cast("string"), F.lit('"}')),
            )
            .when(
                e % 7 == 4, F.concat(F.lit('{"file":"1:/g.docx","revision":'), i, F.lit(',"sessionUid":"12abc"}')),
            ).when(e % 7 == 5, '{"file":"","revision":"abc","sessionUid":"0"}').otherwise('{"sessionUid":"-4"}')
        )
        return self.table("events").select("event_id", body.alias("body"))


#: The same tables in SQL.
CTES = {
    "ops": """SELECT event_id AS seq, epoch_us(ts) // 1000000 AS t, user_id,
  CASE WHEN event_type = 'signup' THEN 'join' WHEN event_type IN ('view', 'click') THEN 'heartbeat' WHEN event_type = 'error' THEN 'leave' ELSE 'save' END AS op,
  '1:/user_upload/doc' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) || '.docx' AS file FROM events""",
    "revisions": """SELECT turn AS uid, '1:/conversations/' || conv_id || '.docx' AS file_identifier, turn + 1 AS revision, sha256(text) AS content_hash, role AS saved_by, turn * 60 AS changed_at FROM conversations""",
    "exts": """SELECT *, CASE lang WHEN 'en' THEN 'docx' WHEN 'de' THEN 'DOCX' WHEN 'fr' THEN 'doc' ELSE 'pdf' END AS ext FROM documents""",
    "files": """SELECT '1:/' || source || '/' || doc_id || '/doc' || (doc_id % 50) || '.' || ext AS file_identifier, doc_id % 3 + 1 AS storage_id, source AS folder, 'doc' || (doc_id % 50) || '.' || ext AS name,
  ext AS extension, CASE WHEN doc_id % 17 = 0 THEN 'folder' ELSE 'file' END AS kind, CAST(strlen(text) AS BIGINT) AS size, text, doc_id FROM exts""",
    "users": """SELECT c_custkey AS uid, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE lower(c_name) END AS username,
  CASE c_custkey % 3 WHEN 0 THEN ' ' || chr(9) || c_name || ' ' WHEN 1 THEN '  ' ELSE NULL END AS real_name,
  CASE c_nationkey % 7 WHEN 0 THEN 'default' WHEN 1 THEN 'de' WHEN 2 THEN 'de_AT' WHEN 3 THEN 'DE' WHEN 4 THEN 'en' WHEN 5 THEN 'fr' ELSE '' END AS lang, c_custkey % 10 = 0 AS is_admin, c_nationkey AS nation FROM customer""",
    "grants": """SELECT uid, CAST(nation % 3 + 1 AS BIGINT) AS storage_id, uid % 2 = 0 AS storage_right, uid % 4 <> 1 AS may_add FROM users""",
    "requests": """SELECT 'u' || uid AS request_id, uid, uid AS doc_id, uid % 3 <> 0 AS file_right FROM users UNION ALL SELECT 'd' || doc_id, doc_id * 7 % 150 + 1, doc_id, (doc_id * 7 % 150 + 1) % 3 <> 0 FROM documents UNION ALL SELECT 'e' || event_id, user_id, event_id, user_id % 3 <> 0 FROM events""",
    "names": r"""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '  report' || doc_id || ' ' WHEN 1 THEN 'a/b\c' || doc_id || '.DOCX' WHEN 2 THEN '..' WHEN 3 THEN 'dir/' WHEN 4 THEN '' WHEN 5 THEN 'x.doc'
  WHEN 6 THEN chr(9) || 'tab' || doc_id || '.docx' || chr(10) ELSE '..\..\y' || doc_id END AS raw FROM documents""",
    "bodies": """SELECT event_id, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '{broken' WHEN 2 THEN '[1,2]' WHEN 3 THEN '{"file":"1:/f' || event_id || '.docx","revision":"' || (99999999999 + event_id) || '"}'
  WHEN 4 THEN '{"file":"1:/g.docx","revision":' || event_id || ',"sessionUid":"12abc"}' WHEN 5 THEN '{"file":"","revision":"abc","sessionUid":"0"}' ELSE '{"sessionUid":"-4"}' END AS body FROM events""",
    "sent": """SELECT * FROM (SELECT *, last_value(CASE WHEN op <> 'heartbeat' THEN op END IGNORE NULLS) OVER (PARTITION BY file, user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened FROM ops WHERE op <> 'save')
  WHERE op <> 'heartbeat' OR opened = 'join'""",
    "clock": """SELECT max(t) AS now FROM ops""",
}
