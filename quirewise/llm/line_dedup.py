"""Line deduplication over a sharded minimal perfect hash.

1. Each document yields the 128-bit hashes of its distinct line keys (16 bytes instead of a line);
   they are written once.
2. Hashes that at least two documents hold are split into shards of about `SHARD_KEYS` keys.  Each
   shard becomes a minimal perfect hash with arrays over its slots: a 64-bit fingerprint, the count
   of holders, and the smallest holder.  A key outside the index passes a fingerprint with chance
   2^-64; a key inside loses its lines if its count is two or more and another document is the smallest.
3. The documents' hashes are routed to their shard and probe its arrays; no line text moves, and a
   task holds one shard and one batch of probes, however large the corpus is.
4. Keys that hold a large share of all probes (at most 1 / HOT_SHARE of them) would all meet in one
   shard; they form a small resident shard that each task has, and need no routing.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import arrow_map, col, small_batches, table, texts, written
from .perfect_hash import PerfectHash, mix

MIN_CHARS = 10
SHARD_KEYS = 50_000
HOT_SHARE = 1 / 64
LEAST_HOT = 1000
_STRIP = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def line_keys(text: str) -> list[bytes]:
    """Of each \\n-split line, in order: the hash of its key, or b'' where the key is too short.

    A key is the line stripped of white space at both ends, with A-Z in lower case.
    """
    out = []
    for line in text.encode("utf-8", "surrogatepass").translate(_LOWER).split(b"\n"):
        key = line.strip(_STRIP)
        long_enough = len(key) >= MIN_CHARS and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= MIN_CHARS)
        out.append(hashlib.blake2b(key, digest_size=16).digest() if long_enough else b"")
    return out


def line_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, h1, h2): one row for each document row and distinct key; tag is a hash of the text."""

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            keys, counts = [], []
            for t in texts(batch):
                own = {*line_keys(t)} - {b""}
                keys += own
                counts.append(len(own))
            h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            return {"doc_id": batch.column("doc_id").take(at), "tag": batch.column("tag").take(at), "h1": pa.array(h[:, 0]), "h2": pa.array(h[:, 1])}

        return f

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), _tag(text_col).alias("tag"), col(text_col).alias("text"))
    return arrow_map(rows, "doc_id long, tag long, h1 long, h2 long", make)


def _tag(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(col(text_col), F.lit("")))


def shared_keys(hashes: DataFrame) -> DataFrame:
    """(h1, h2, n, least): keys that at least two documents hold; n is the number of rows that hold it."""
    held = hashes.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"),
        F.max(F.col("doc_id").isNull()).alias("unnamed"),
    )
    several = (F.col("least") != F.col("most")) | (F.col("unnamed") & F.col("least").isNotNull())
    return held.filter(several).select("h1", "h2", "n", "least")


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, payload): for each shard its perfect hash and arrays, as bytes."""

    def build(pdf):
        import pandas as pd

        h1 = pdf["h1"].to_numpy(np.int64).view(np.uint64)
        index = PerfectHash.build(h1 ^ mix(pdf["h2"].to_numpy(np.int64).view(np.uint64)))
        slot = index.slots(h1 ^ mix(pdf["h2"].to_numpy(np.int64).view(np.uint64)))
        arrays = [np.zeros(len(h1), t) for t in ("<u8", "<i8", "<i8")]
        for a, c in zip(arrays, ("h2", "n", "least"), strict=True):
            a[slot] = pdf[c].to_numpy(np.int64).view(a.dtype)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "payload": [index.to_bytes(arrays)]})

    rows = keys.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "h2", "n", "least")
    return rows.groupBy("shard").applyInPandas(build, "shard int, payload binary")


def probe(hashes: DataFrame, shards: DataFrame, n_shards: int) -> DataFrame:
    """(doc_id, tag, h1, h2) of the hashes whose key is counted at least twice and has a smaller holder.

    Shards and probes meet by shard number; within a task the shard comes first, so the probes
    stream past it and only one shard is in memory.
    """

    def make():
        held: dict = {"shard": None, "index": None, "arrays": None}

        def f(batch: pa.RecordBatch) -> dict:
            shard = batch.column("shard").to_numpy()
            out = []
            edges = np.flatnonzero(np.diff(shard)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(shard)], strict=True):
                part = batch.slice(lo, hi - lo)
                if part.column("payload").is_valid()[0].as_py():
                    held["shard"] = int(shard[lo])
                    held["index"], held["arrays"] = PerfectHash.from_bytes(part.column("payload")[0].as_py())
                    part = part.slice(1)
                if not part.num_rows or held["shard"] != shard[lo]:
                    continue
                h1, h2 = (part.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
                slot = held["index"].slots(h1 ^ mix(h2))
                prints, counts, least = held["arrays"]
                hit = (slot >= 0) & (prints[slot] == h2) & (counts[slot] >= 2)
                named = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                own = part.column("doc_id").fill_null(0).to_numpy()
                out.append(part.filter(pa.array(hit & ((least[slot] != own) | ~named))))
            rows = pa.Table.from_batches(out or [batch.slice(0, 0)]).combine_chunks()
            return {c: pa.concat_arrays(rows.column(c).chunks) if rows.num_rows else pa.array([], pa.int64()) for c in ("doc_id", "tag", "h1", "h2")}

        return f

    index = shards.select(
        "shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tag"),
        F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "payload",
    )
    asked = hashes.select(
        F.pmod("h1", F.lit(n_shards)).cast("int").alias("shard"), F.lit(1).alias("kind"), "doc_id", "tag", "h1", "h2",
        F.lit(None).cast("binary").alias("payload"),
    )
    met = index.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")
    return arrow_map(met.drop("kind"), "doc_id long, tag long, h1 long, h2 long", make)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with duplicate lines removed, and n_lines, n_dropped (long) in front of them.

    A key of at least MIN_CHARS code points that several documents hold stays only in the document
    with the smallest id; there all its lines stay.  A null or empty text is one empty line and
    comes back empty.  A null id is a document of its own that sorts last.  Rows that repeat an id
    are one document here: they lose the same keys.  The result has `n_lines`,
    `n_dropped` and a struct `row` of the input's columns, the text replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    hashes = written(line_hashes(docs, id_col, text_col), "line-hashes")
    keys = written(shared_keys(hashes), "line-keys")
    total, indexed = hashes.count(), keys.count()
    many = max(LEAST_HOT, total * HOT_SHARE)
    hot = {_digest(r): r["least"] for r in keys.filter(F.col("n") >= many).collect()}
    cold = keys.filter(F.col("n") < many)
    n_shards = max(1, math.ceil(indexed / SHARD_KEYS))
    shards = written(build_shards(cold, n_shards), "line-shards")
    asked = hashes.join(F.broadcast(_hot_frame(spark, hot)), ["h1", "h2"], "left_anti") if hot else hashes
    hits = probe(asked, shards, n_shards)
    # Of one id and text only, so a list is never longer than the text has lines, also for null ids.
    lost = hits.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))
    rows = docs.select(
        F.struct(*[col(c) for c in docs.columns if c != text_col]).alias("row"), col(text_col).alias("text"),
        col(id_col).cast("long").alias("key"), _tag(text_col).alias("own_tag"),
    )
    joined = rows.join(lost, (F.col("own_tag") == F.col("tag")) & F.col("key").eqNullSafe(F.col("doc_id")), "left")
    schema = StructType([
        StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("text", StringType()),
        StructField("row", rows.schema["row"].dataType),
    ])

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            out, n_lines, n_dropped = [], [], []
            for t, own, gone in zip(texts(batch), batch.column("key").to_pylist(), _digests(batch.column("lost")), strict=True):
                lines = t.split("\n")
                if gone or hot:
                    keep = [x for x, k in zip(lines, line_keys(t), strict=True) if not k or not (k in gone or hot.get(k, own) != own)]
                else:
                    keep = lines
                out.append("\n".join(keep))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(keep))
            return {"n_lines": n_lines, "n_dropped": n_dropped, "text": out, "row": batch.column("row")}

        return f

    done = arrow_map(joined.select("row", "text", "key", "lost"), schema, make)
    return done.select("n_lines", "n_dropped", F.struct(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]).alias("row"))


def _digest(r) -> bytes:
    return np.array([r["h1"], r["h2"]], "<i8").tobytes()


def _digests(lists: pa.Array) -> list[frozenset | set]:
    """Of each row the set of 16-byte hashes; empty for null."""
    flat, none = lists.values, frozenset()
    h = np.stack([flat.field("h1").to_numpy(zero_copy_only=False), flat.field("h2").to_numpy(zero_copy_only=False)], 1).astype("<i8").tobytes() if len(flat) else b""
    at = lists.offsets.to_pylist()
    return [{h[16 * i : 16 * i + 16] for i in range(a, b)} if b > a else none for a, b in zip(at, at[1:], strict=False)]


def _hot_frame(spark: SparkSession, hot: dict) -> DataFrame:
    """At most 1 / HOT_SHARE rows."""
    return spark.createDataFrame([tuple(map(int, np.frombuffer(k, "<i8"))) for k in hot], "h1 long, h2 long")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2("row.text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, line, pos,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
h AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, h.least IS NOT NULL AND h.least <> k.doc_id AS dropped FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
