"""Tables of the document-collaboration model; no column is nullable in the stored tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _table(**columns) -> StructType:
    return StructType([StructField(k, t, False) for k, t in columns.items()])


SESSION = _table(
    uid=LongType(), pid=IntegerType(), tstamp=LongType(), crdate=LongType(), deleted=BooleanType(), file_hash=StringType(),
    file_identifier=StringType(), backend_user=IntegerType(), user_name=StringType(), last_heartbeat=LongType(),
)
REVISION = _table(
    uid=LongType(), pid=IntegerType(), tstamp=LongType(), crdate=LongType(), file_identifier=StringType(), revision=IntegerType(),
    content_hash=StringType(), saved_by=IntegerType(),
)
FILE = _table(
    file_identifier=StringType(), storage_id=IntegerType(), path=StringType(), name=StringType(), extension=StringType(),
    mime_type=StringType(), size=LongType(), content=BinaryType(),
)
USER = _table(uid=IntegerType(), username=StringType(), real_name=StringType(), lang=StringType(), is_admin=BooleanType())
OPERATION = _table(seq=LongType(), t=LongType(), user_id=LongType(), op=StringType(), file=StringType())
RULE = _table(priority=IntegerType(), id=StringType(), needle=StringType(), replacement=StringType())
PARTICIPANT = StructType([StructField("userId", LongType()), StructField("userName", StringType()), StructField("sessionUid", LongType())])
#: Payload fields are read as strings first: a typed read turns "3" into null.
PAYLOAD = StructType([StructField(k, StringType()) for k in ("file", "revision", "sessionUid", "data", "folder", "fileName")])
MANIFEST = MapType(StringType(), StructType([StructField("file", StringType()), StructField("css", ArrayType(StringType()))]))
STYLE = StructType([
    StructField("styleId", StringType()), StructField("name", StringType()), StructField("nameKey", StringType()), StructField("type", StringType()),
    StructField("priority", IntegerType()), StructField("qFormat", BooleanType()), StructField("fontSize", IntegerType()), StructField("bold", BooleanType()),
])
