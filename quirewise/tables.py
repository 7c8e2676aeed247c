"""Intermediate tables: Parquet in the folder that driver and executors share.

A written table cuts lineage, survives the loss of executors, and is computed once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCRATCH = "quirewise-scratch"
#: This driver's part of it; other drivers may use the same shared folder.
_RUN = uuid.uuid4().hex
#: Intermediate tables of this driver that have not been deleted yet.
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may do without the setting."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="quirewise-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{_SCRATCH}/{_RUN}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting: the files of an execution's shuffles are deleted at its end.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """`df` as a table in the shared folder; it is computed here.

    `tidy`: its shuffles' files go once it is written, not when the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(_TIDY, None)
    try:
        if tidy:
            spark.conf.set(_TIDY, "true")
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the intermediate tables made inside, but for those that frames of the list read."""
    before, keep = len(_tables), []
    yield keep
    needed = {f.split("/")[-2] for df in keep for f in df.inputFiles()}
    for path in _tables[before:]:
        if path.split("/")[-1] not in needed:
            _delete(spark, path)
            _tables.remove(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this driver; call it when no result that reads them is needed."""
    _delete(spark, f"{shared_dir(spark)}/{_SCRATCH}/{_RUN}")
    _tables.clear()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
