"""Session settings that the functions rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: One zone for epoch seconds, base64 without line breaks, the right side winning in map unions, the last of equal keys in JSON, and
#: tables, own ones and results, in a codec that sees how much a list of participants has in common with the one before.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark
