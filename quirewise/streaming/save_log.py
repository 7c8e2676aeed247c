"""Saves as a stream: two sinks that count each batch once.

A batch writes the bytes of the files it saves, its rows of the revision log and its answers, and at last a row
of the ledger.  Whatever a batch wrote before it died, its next run overwrites: rows are in folders named by the
batch, bytes in files named by their own hash, and what the batch reads is the log of earlier batches only.
Readers see the batches of the ledger; a file's bytes are those its latest revision names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..operators import revisions, saves
from ..tables import written

LOG = "uid long, file_identifier string, revision long, content_hash string, saved_by long, batch long"
ANSWERS = "seq long, status int, error string, revision long, content_hash string, batch long"


def bytes_name(content_hash: Column) -> Column:
    """The file of the bytes with a hash, in one of 256 subfolders."""
    return F.concat(F.substring(content_hash, 1, 2), F.lit("/"), content_hash, F.lit(".docx"))


class SaveLog:
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def done(self, spark: SparkSession) -> list[int]:
        """The batches of the ledger."""
        return sorted(r["batch"] for r in self._read(spark, "ledger", "batch long, saves long", None).select("batch").collect())

    def log(self, spark: SparkSession, batches: list[int] | None = None) -> DataFrame:
        return self._read(spark, "revisions", LOG, self.done(spark) if batches is None else batches)

    def answers(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "answers", ANSWERS, self.done(spark))

    def bytes_folder(self) -> str:
        return f"{self.path}/bytes"

    def save(self, requests: DataFrame, batch: int) -> None:
        """Takes in `operators.saves.checked` requests; a batch of the ledger isn't taken in again."""
        spark = requests.sparkSession
        done = self.done(spark)
        if batch in done:
            return
        asked = written(requests, "save-requests")
        mine = asked.filter("refusal is null").select(F.col("file").alias("file_identifier")).distinct()
        latest = revisions.latest(self.log(spark, done).join(mine, "file_identifier", "left_semi"))
        answers = written(saves.answered(asked, latest.select(F.col("file_identifier").alias("file"), "revision")), "save-answers")
        accepted = answers.filter("status = 200")
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # small rows, but a file each: not to be merged by size
        named = accepted.select(bytes_name(F.col("content_hash")).alias("name"), "content").repartition(tasks, "name").dropDuplicates(["name"])
        sources.write_binaries(named, self.bytes_folder()).write.format("noop").mode("overwrite").save()
        rows = accepted.select(F.col("seq").alias("uid"), F.col("file").alias("file_identifier"), "revision", "content_hash", F.col("uid").alias("saved_by"))
        for kind, out in (("revisions", rows), ("answers", answers.select("seq", "status", "error", "revision", "content_hash"))):
            out.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")
        rows.agg(F.count(F.lit(1)).alias("saves")).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")

    def _read(self, spark: SparkSession, kind: str, schema: str, batches: list[int] | None) -> DataFrame:
        """All of a kind, or the rows of these batches; nothing before the first batch."""
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        return rows if batches is None else rows.filter(F.col("batch").isin(batches))


def saver(log: SaveLog, files: DataFrame, users: DataFrame, grants: DataFrame) -> Callable[[DataFrame, int], None]:
    """A write_batch for `streaming.polling` of requests (seq, uid, body, file_right)."""

    def write(rows: DataFrame, batch: int) -> None:
        log.save(saves.checked(rows, files, users, grants), batch)

    return write
