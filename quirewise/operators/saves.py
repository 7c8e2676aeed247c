"""Save requests: parsed, checked, numbered and answered, in the order in which one save does it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_docx, sha256, strict_base64, trim
from ..sources import request_fields
from .files import may

#: Statuses and texts of refusals, in the order of the checks.
REFUSALS = {
    "body": (400, "Invalid request body."), "missing": (400, "Missing document payload."), "base64": (400, "Invalid base64 payload."), "no_file": (400, "Missing file identifier."),
    "not_found": (404, "File not found."), "type": (415, "Only .docx files can be edited."), "right": (403, "No write permission for this file."),
    "conflict": (409, "Document was updated by another editor. Reload to continue."),
}


def checked(requests: DataFrame, files: DataFrame, users: DataFrame, grants: DataFrame) -> DataFrame:
    """(seq, uid, file, expected, content, refusal) of requests (seq, uid, body, file_right); refusal is null where the revision decides.

    files: (file_identifier, kind, extension, storage_id); users: (uid, is_admin); grants: (uid, storage_id, storage_right).
    """
    p = requests.withColumn("p", request_fields(F.col("body")))
    data = F.coalesce("p.data", F.lit(""))
    parsed = p.select("seq", "uid", "file_right", F.col("p").isNull().alias("broken"), trim(F.coalesce("p.file", F.lit(""))).alias("file"), F.col("p.revision").alias("expected"), data.alias("data"), strict_base64(data).alias("content"))
    named = files.select(F.col("file_identifier").alias("file"), "kind", "extension", "storage_id")
    known = parsed.join(named, "file", "left").join(users.select("uid", "is_admin"), "uid", "left").join(grants.select("uid", "storage_id", "storage_right"), ["uid", "storage_id"], "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    refusal = (
        F.when(F.col("broken"), "body").when(F.col("data") == "", "missing").when(F.col("content").isNull(), "base64").when(F.col("file") == "", "no_file")
        .when(F.col("kind").isNull() | (F.col("kind") != "file"), "not_found").when(~is_docx(F.col("extension")), "type").when(~may(has("is_admin"), has("storage_right"), has("file_right")), "right")
    )
    return known.select("seq", "uid", "file", "expected", "content", refusal.alias("refusal"))


def numbered(requests: DataFrame, current: DataFrame) -> DataFrame:
    """(seq, revision) of the requests (seq, file, expected): the revision a save makes, null where another editor was first.

    current: (file, revision) before them.  A save is accepted if it expects the current revision or a negative
    one, and then raises it; so a file's requests stream through one task in order of seq, without their bytes.
    """
    moves = requests.join(current.select("file", F.col("revision").alias("base")), "file", "left").select("file", "seq", "expected", F.coalesce("base", F.lit(0)).cast("long").alias("base"))
    dealt = moves.repartition("file").sortWithinPartitions("file", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, 0
        for b in batches:
            made = []
            for file, expected, base in zip(*(b.column(c).to_pylist() for c in ("file", "expected", "base")), strict=True):
                if file != last:
                    last, now = file, base
                ok = expected < 0 or expected == now
                now += ok
                made.append(now if ok else None)
            yield pa.RecordBatch.from_arrays([b.column("seq"), pa.array(made, pa.int64())], names=["seq", "revision"])

    return dealt.mapInArrow(run, "seq long, revision long")


def answered(requests: DataFrame, current: DataFrame) -> DataFrame:
    """`checked` requests with status, error, revision and content_hash; both of the latter null where refused."""
    made = numbered(requests.filter("refusal is null").select("seq", "file", "expected"), current)
    joined = requests.join(made, "seq", "left")
    why = F.coalesce("refusal", F.when(F.col("revision").isNull(), "conflict"))
    pick = lambda k: _by_refusal(why, k)
    return joined.select("seq", "uid", "file", "content", F.coalesce(pick(0), F.lit(200)).alias("status"), pick(1).alias("error"), "revision", F.when(F.col("revision").isNotNull(), sha256(F.col("content"))).alias("content_hash"))


def _by_refusal(why: Column, k: int) -> Column:
    out = F.lit(None)
    for name, values in REFUSALS.items():
        out = F.when(why == name, F.lit(values[k])).otherwise(out)
    return out
