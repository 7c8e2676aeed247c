"""File catalogue: resolution, permissions, actions and name collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import flag, is_docx, trim, with_parameter
from ..tables import written
from .ranking import numbered, running


def resolve(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests (request_id, file) with a status: 400 empty, 404 no such file, 415 not a document, 200.

    files: (file_identifier, kind, extension).
    """
    asked = requests.withColumn("file_identifier", trim(F.col("file")))
    joined = asked.join(files.select("file_identifier", "kind", "extension"), "file_identifier", "left")
    empty = F.coalesce(F.col("file_identifier"), F.lit("")) == ""
    status = F.when(empty, 400).when(F.col("kind").isNull() | (F.col("kind") != "file"), 404).when(~is_docx(F.col("extension")), 415).otherwise(200)
    return joined.select("request_id", "file", status.alias("status"))


def resolve_folders(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests (request_id, folder): 400 empty, 404 no such folder, 200."""
    asked = requests.withColumn("file_identifier", trim(F.col("folder")))
    joined = asked.join(files.filter("kind = 'folder'").select("file_identifier", F.lit(True).alias("found")), "file_identifier", "left")
    status = F.when(F.coalesce(F.col("file_identifier"), F.lit("")) == "", 400).when(F.col("found").isNull(), 404).otherwise(200)
    return joined.select("request_id", "folder", status.alias("status"))


def unreadable(size: Column, content: Column) -> Column:
    """Status 500: bytes should be there, and none came."""
    return (size > 0) & (F.octet_length(F.coalesce(content, F.lit(b""))) == 0)


def may(admin: Column, storage_right: Column, file_right: Column, may_add: Column | None = None) -> Column:
    """Administrators need no right on the storage, but everyone needs the one on the file (and folder)."""
    both = (admin | storage_right) & file_right
    return both if may_add is None else both & may_add


def judged(requests: DataFrame, files: DataFrame, users: DataFrame, grants: DataFrame) -> DataFrame:
    """Each request (request_id, uid, doc_id, file_right) with its answers: read_status, can_write, can_add, mode.

    files: (doc_id, storage_id); users: (uid, is_admin); grants: (uid, storage_id, storage_right, may_add).
    No such file is 404; a missing user or grant has no rights and is refused (403), but
    administrators need no grant to read and write.  All joins are on keys, and each request is one row.
    """
    asked = requests.join(files.select("doc_id", "storage_id"), "doc_id", "left").join(users.select("uid", "is_admin"), "uid", "left")
    known = asked.join(grants.select("uid", "storage_id", "storage_right", "may_add"), ["uid", "storage_id"], "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    found = F.col("storage_id").isNotNull()
    ok = found & may(has("is_admin"), has("storage_right"), has("file_right"))
    status = F.when(~found, 404).when(ok, 200).otherwise(403)
    return known.select(
        "request_id", "uid", "doc_id", status.alias("read_status"), flag(ok).alias("can_write"),
        (ok & has("may_add")).alias("can_add"), write_mode(ok).alias("mode"),
    )


def actions(files: DataFrame, edit_url: str, may_read: Column) -> DataFrame:
    """Readable documents with their two actions; other files have none."""
    url = with_parameter(F.lit(edit_url), "file", F.col("file_identifier"))
    offered = files.filter((F.col("kind") == "file") & is_docx(F.col("extension")) & may_read)
    return offered.select("file_identifier", url.alias("url"), F.explode(F.array(F.lit("primary"), F.lit("secondary"))).alias("action"))


def without_collisions(files: DataFrame, order: str) -> DataFrame:
    """`files` (folder, name, ...) with a unique `stored_name`; names aren't null, `order` is unique.

    Of equal names the first by `order` keeps it.  The others get, before their .docx, the suffixes _01, _02
    and so on, without those that some given name has: given names come first, whatever the order.
    """
    split = lambda k: F.regexp_extract("name", r"(?is)^(.*?)(\.docx)?$", k)
    places = written(numbered(files.withColumns({"_base": split(1), "_end": split(2)}), [order], ["folder", "name"], "_n"), "names")
    # The j-th suffix is j plus the number of taken ones at or below it.  The i-th taken one, t, is, if t - i < j.
    given = places.filter("_n = 1").select(
        "folder", "_end", F.regexp_extract("_base", r"(?s)^(.*)_(\d{2,9})$", 1).alias("_base"),
        F.regexp_extract("_base", r"(?s)^(.*)_(\d{2,9})$", 2).alias("_digits"),
    )
    taken = given.filter("_digits != ''").withColumn("_t", F.col("_digits").cast("long")).filter("_t > 0 and _digits = format_string('%02d', _t)")
    bases = ["folder", "_base", "_end"]
    ranked = numbered(taken, ["_t"], bases, "_i").select(
        *bases, (F.col("_t") - F.col("_i")).alias("_at"), F.lit(1).alias("_kind"),
        F.lit(None).cast(dict(files.dtypes)[order]).alias("_order"),
    )
    asked = places.filter("_n > 1").select(*bases, (F.col("_n") - 1).alias("_at"), F.lit(0).alias("_kind"), F.col(order).alias("_order"))
    counted = running(ranked.unionByName(asked), ["_at", "_kind"], {"_taken": (F.sum, F.col("_kind"))}, bases).filter("_kind = 0")
    suffixes = counted.select("_order", (F.col("_at") + F.coalesce("_taken", F.lit(0))).alias("_suffix"))
    joined = places.join(suffixes, places[order] == suffixes["_order"], "left")
    name = F.concat("_base", F.lit("_"), F.format_string("%02d", "_suffix"), "_end")
    return joined.withColumn("stored_name", F.when(F.col("_suffix").isNull(), F.col("name")).otherwise(name)).select(*files.columns, "stored_name")


def write_mode(can_write: Column) -> Column:
    return F.when(can_write, "editing").otherwise("viewing")


__all__ = ["actions", "flag", "judged", "may", "resolve", "resolve_folders", "unreadable", "without_collisions", "write_mode"]
