"""Readers and writers: tables, binary files, label catalogues, manifests, JSON requests and responses, poll streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import basename, filled, json_depth, trim, variant_int, variant_text
from ..operators.files import unreadable
from ..schemas import MANIFEST, PAYLOAD
from .listing import ListingSource, read_file

UNIT = "_id string, segment struct<source string>"


def binary_files(spark: SparkSession, path: str, storage_id: int = 1) -> DataFrame:
    """Files below a folder, empty ones too, as rows of the catalogue, with their bytes.

    Files of its subfolders are listed where they are read; so many files should be in subfolders.
    """
    spark.dataSource.register(ListingSource)
    name = basename(F.col("path"))
    return spark.read.format("listing").option("path", path).option("content", "true").load().select(
        F.concat(F.lit(f"{storage_id}:"), F.expr("parse_url(path, 'PATH')")).alias("file_identifier"),
        F.lit(storage_id).alias("storage_id"), "path", name.alias("name"),
        F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("size"), "content",
    )


def checked(files: DataFrame) -> DataFrame:
    """Binary files with a status: 500 where bytes should be there and none came, else 200."""
    return files.withColumn("status", F.when(unreadable(F.col("size"), F.col("content")), 500).otherwise(200))


def write_binaries(files: DataFrame, folder: str) -> DataFrame:
    """Writes (name, content) as files of a folder that all executors share; (name, size) of each.

    A file that is there is overwritten: the bytes go to a file beside it, which then takes its place, so
    a reader never sees half of them, and a task that runs again does no harm.  Names are file names,
    in a subfolder where they have a slash; equal names overwrite each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        made = {""}
        for b in batches:
            names, contents = b.column("name").to_pylist(), b.column("content").to_pylist()
            for name, content in zip(names, contents, strict=True):
                sub = name.rpartition("/")[0]
                if sub not in made:
                    store.create_dir(f"{base}/{sub}", recursive=True)
                    made.add(sub)
                beside = f"{base}/.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(content or b"")
                store.move(beside, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(c or b"") for c in contents], pa.int64())], names=["name", "size"])

    return files.select("name", "content").mapInArrow(run, "name string, size long")


def read_binaries(names: DataFrame, folder: str) -> DataFrame:
    """(name, content) of the files of a folder that are named; each must be there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column("name").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([read_file(store, f"{base}/{name}")], pa.binary())], names=["name", "content"])

    return names.select("name").mapInArrow(run, "name string, content binary")


def labels(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(locale, key, text) of XML label files, by locale."""
    frames = [spark.read.format("xml").option("rowTag", "unit").schema(UNIT).load(p).select(F.lit(k).alias("locale"), F.col("_id").alias("key"), F.col("segment.source").alias("text")) for k, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def manifest(text: Column) -> Column:
    """Entries of a build manifest; none for a list, null if it is missing or invalid."""
    return _object_or_list(text, MANIFEST, F.create_map().cast(MANIFEST))


def manifest_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(manifest(F.col("value")).alias("entries"))


def manifest_script(entries: Column, entry: str | Column) -> Column:
    return F.try_element_at(entries, F.lit(entry))["file"]


def manifest_style(entries: Column, entry: str | Column, fallback: str = "style.css") -> Column:
    """The entry's first style sheet, else the fallback entry's file."""
    return F.coalesce(F.try_element_at(F.try_element_at(entries, F.lit(entry))["css"], F.lit(1)), F.try_element_at(entries, F.lit(fallback))["file"])


def json_starts(text: Column, mark: str) -> Column:
    """Whether a text is valid JSON that starts so; the lenient reader makes a record of nulls from a broken one."""
    return trim(text).startswith(mark) & F.try_parse_json(text).isNotNull()


def _object_or_list(text: Column, kind, empty: Column) -> Column:
    """A JSON object; a list is an object without the keys that are asked for; null for anything else."""
    return F.when(json_starts(text, "{"), F.from_json(text, kind)).when(json_starts(text, "["), empty)


def payload(body: Column) -> Column:
    """Request fields as strings, all missing in a list; null for anything else than an object or list (status 400)."""
    none = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in PAYLOAD])
    return _object_or_list(body, PAYLOAD, none)


#: Fixed value: lists and objects may nest this deeply in a request.
DEEPEST = 512


def request_fields(body: Column) -> Column:
    """Request fields with the types that they are read as: (file, data, folder, fileName) texts, revision and sessionUid whole numbers.

    Values of any JSON type are cast; a field that is missing or null is null, a missing revision -1 and a missing
    session 0.  Null for anything else than an object or list, or one that nests too deeply (status 400).
    """
    v = F.try_parse_json(body)
    is_list = json_starts(body, "[")
    usable = (is_list | json_starts(body, "{")) & (F.when(F.length(body) > DEEPEST, json_depth(body)).otherwise(0) <= DEEPEST)
    field = lambda name: F.when(~is_list, F.try_variant_get(v, f"$.{name}", "variant"))
    texts = [variant_text(field(c)).alias(c) for c in ("file", "data", "folder", "fileName")]
    numbers = [variant_int(field(c), missing).alias(c) for c, missing in (("revision", -1), ("sessionUid", 0))]
    return F.when(usable, F.struct(*texts, *numbers))


def response(status: Column, status_text: Column, body: Column) -> Column:
    """(ok, error, httpStatus) as a client sees a response.

    A body that isn't JSON is an error of its own; a status outside 200 to 299 turns ok off, with the status
    text as error where the body has none.
    """
    data = F.when(json_starts(body, "{"), F.from_json(body, "ok string, error string"))
    valid = F.try_parse_json(body).isNotNull()
    ok, error = data["ok"] == "true", filled(data["error"])
    failed = ~status.between(200, 299)
    kept = F.coalesce(ok, F.lit(False)) & ~failed
    refused = F.when(failed & F.coalesce(data["ok"] != "false", F.lit(True)), F.coalesce(error, status_text)).otherwise(data["error"])
    return F.struct((valid & kept).alias("ok"), F.when(valid, refused).otherwise(F.lit("Invalid server response.")).alias("error"), status.alias("httpStatus"))


def parameter(remembered: Column, *sources: Column) -> Column:
    """The remembered value unless empty, else the first source that is there, even if empty; trimmed."""
    return trim(F.coalesce(filled(trim(remembered)), *sources, F.lit("")))


def module_text(spark: SparkSession, path: str) -> DataFrame:
    """All modules of a build folder as one text, by name; a build has few and small modules."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value")
    return files.agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("name", "value"))), lambda x: x["value"])).alias("text"))


def polled(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1000) -> DataFrame:
    """A folder that new files arrive in, as a stream; `streaming.polling` starts it with the trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def envelope(ok: Column, content: Column) -> Column:
    """A response's map; the content cannot override ok (right side wins under the session settings)."""
    return F.map_concat(content, F.create_map(F.lit("ok"), F.when(ok, "true").otherwise("false")))


def append_revisions(revisions: DataFrame, path: str, batch: int) -> None:
    """The log only grows, by a folder for each batch; one that is appended again counts once.  `operators.revisions.latest` reads it."""
    revisions.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_indexed(revisions: DataFrame, path: str, row_group: int = 128 << 20) -> None:
    """The log laid out for lookups by file: sorted by file over all tasks, with a bloom filter in each row group.

    A lookup reads the row groups whose range holds the file, mostly one, and none whose filter denies it.
    """
    ordered = revisions.repartitionByRange("file_identifier").sortWithinPartitions("file_identifier", "uid")
    bloom = "parquet.bloom.filter.enabled#file_identifier"
    ordered.write.option(bloom, "true").option("parquet.block.size", str(row_group)).mode("overwrite").parquet(path)
