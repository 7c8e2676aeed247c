"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .model import Model
from .registry import query

_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(11))"


@query("SELECT file_identifier, sha256(file_identifier) AS file_hash FROM files")
def file_hash(m: Model) -> DataFrame:
    return m.files.select("file_identifier", S.sha256(F.col("file_identifier")).alias("file_hash"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", S.sha256(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, base64(encode(text)) AS data, CAST(strlen(text) AS INTEGER) AS decoded_size FROM documents")
def base64_encode(m: Model) -> DataFrame:
    coded = S.base64(F.encode("text", "utf-8"))
    return m.table("documents").select("doc_id", coded.alias("data"), F.octet_length(F.unbase64(coded)).alias("decoded_size"))


@query("""
WITH c AS (SELECT doc_id, source, lang, CASE doc_id % 5 WHEN 0 THEN base64(encode(source)) WHEN 1 THEN rtrim(base64(encode(lang)), '=') WHEN 2 THEN 'YQ=' WHEN 3 THEN '####' ELSE '' END AS data FROM documents)
SELECT doc_id, CASE WHEN data = '' THEN 400 WHEN doc_id % 5 IN (2, 3) THEN 400 ELSE 200 END AS status, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN lang END AS content FROM c
""")
def base64_strict(m: Model) -> DataFrame:
    k = F.col("doc_id") % 5
    data = F.when(k == 0, S.base64(F.encode("source", "utf-8"))).when(
        k == 1, F.rtrim(S.base64(F.encode("lang", "utf-8")), F.lit("=")),
    ).when(k == 2, "YQ=").when(k == 3, "####").otherwise("")
    rows = m.table("documents").select("doc_id", data.alias("data")).withColumn("bytes", F.when(F.col("data") != "", S.strict_base64(F.col("data"))))
    return rows.select("doc_id", F.when(F.col("bytes").isNull(), 400).otherwise(200).alias("status"), F.decode("bytes", "utf-8").alias("content"))


@query(rf"""
WITH b AS (SELECT doc_id, {_TRIM.format("raw")} AS t, regexp_replace(rtrim(replace({_TRIM.format("raw")}, '\', '/'), '/'), '^.*/', '', 's') AS base FROM names)
SELECT doc_id, CASE WHEN t = '' OR base IN ('', '.', '..') THEN NULL WHEN lower(base) LIKE '%.docx' THEN base ELSE base || '.docx' END AS name,
  CASE WHEN t = '' OR base IN ('', '.', '..') THEN 400 ELSE 200 END AS status, CASE WHEN t = '' THEN 'document.docx' ELSE t END AS save_as
FROM b
""")
def name_normalize(m: Model) -> DataFrame:
    name = S.docx_name(F.col("raw"))
    return m.names.select(
        "doc_id", name.alias("name"), F.when(name.isNull(), 400).otherwise(200).alias("status"),
        S.save_as_name(S.trim(F.col("raw")), F.lit(None).cast("string")).alias("save_as"),
    )


@query("SELECT file_identifier, extension FROM files WHERE lower(extension) = 'docx'")
def docx_filter(m: Model) -> DataFrame:
    return m.files.filter(S.is_docx(F.col("extension"))).select("file_identifier", "extension")


@query("SELECT uid, CASE WHEN lang NOT IN ('', 'default') AND lower(lang) LIKE 'de%' THEN 'de' ELSE 'en' END AS locale FROM users")
def locale(m: Model) -> DataFrame:
    return m.users.select("uid", S.locale(F.col("lang")).alias("locale"))


@query(f"SELECT uid, coalesce(nullif({_TRIM.format('real_name')}, ''), {_TRIM.format('coalesce(username, chr(69) || chr(100) || chr(105) || chr(116) || chr(111) || chr(114))')}) AS user_name FROM users")
def display_name(m: Model) -> DataFrame:
    return m.users.select("uid", S.display_name(F.col("real_name"), F.col("username")).alias("user_name"))


@query("SELECT file_identifier, CASE WHEN storage_id = 3 THEN ltrim(substr(file_identifier, 3), '/') ELSE 'storage' || storage_id || ' / ' || ltrim(substr(file_identifier, 3), '/') END AS label FROM files")
def path_label(m: Model) -> DataFrame:
    storage = F.when(F.col("storage_id") == 3, "").otherwise(F.concat(F.lit("storage"), F.col("storage_id").cast("string")))
    return m.files.select("file_identifier", S.path_label(storage, F.substr("file_identifier", F.lit(3))).alias("label"))


@query(r"""
WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?:/', '') WHEN 2 THEN '' ELSE NULL END AS url FROM pages)
SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE '/' || ltrim(url, '/') END AS download FROM u WHERE url <> ''
""")
def download_url(m: Model) -> DataFrame:
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.col("url")).when(k == 1, F.regexp_replace("url", "^https?:/", "")).when(k == 2, "")
    return m.table("pages").select("page_id", S.download_url(url).alias("download")).filter("download is not null")


@query("SELECT doc_id, url || '&file=' || replace(url_encode(file_identifier), '%20', '+') AS url, '/edit?file=' || url_encode(file_identifier) AS edit_url FROM (SELECT doc_id, file_identifier, '/route?token=' || storage_id AS url FROM files)")
def url_param(m: Model) -> DataFrame:
    url = F.concat(F.lit("/route?token="), F.col("storage_id").cast("string"))
    return m.files.select(
        "doc_id", S.with_parameter(url, "file", F.col("file_identifier")).alias("url"),
        S.with_parameter(F.lit("/edit"), "file", F.col("file_identifier")).alias("edit_url"),
    )


@query("SELECT p_partkey, 'label' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS key FROM part")
def label_key(m: Model) -> DataFrame:
    return m.table("part").select("p_partkey", S.dataset_key(F.col("p_name")).alias("key"))


@query("SELECT p_partkey, CASE WHEN p_size * 15 BETWEEN 400 AND 599 THEN p_size * 15 ELSE 500 END AS status FROM part")
def error_status(m: Model) -> DataFrame:
    return m.table("part").select("p_partkey", S.error_status(F.col("p_size") * 15).alias("status"))


@query("""
WITH b AS (SELECT p_partkey, p_size * 40 - 200 AS x, p_size % 7 * 50 AS w, 900 AS win, CASE WHEN p_size % 5 = 0 THEN 'fixed' ELSE 'absolute' END AS pos, CASE p_size % 3 WHEN 0 THEN '1000' WHEN 1 THEN 'auto' ELSE '2000px' END AS z FROM part),
c AS (SELECT *, least(greatest(x, 8), greatest(8, win - w - 8)) AS l FROM b)
SELECT p_partkey, l AS clamped, CASE WHEN w > 0 AND abs(l - x) > 1 THEN CAST(l AS BIGINT) END AS moved, pos = 'fixed' AND z <> 'auto' AS popover FROM c
""")
def clamp(m: Model) -> DataFrame:
    p = F.col("p_size")
    x, w = p * 40 - 200, p % 7 * 50
    z = F.when(p % 3 == 0, "1000").when(p % 3 == 1, "auto").otherwise("2000px")
    return m.table("part").select(
        "p_partkey", S.clamped_left(x, w, F.lit(900)).alias("clamped"), S.moved_left(x, w, F.lit(10), F.lit(900)).alias("moved"),
        S.is_popover(F.when(p % 5 == 0, "fixed").otherwise("absolute"), z).alias("popover"),
    )
