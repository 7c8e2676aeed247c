"""Exact deduplication by content sort (DataFrame functions only).

Sampled splitters range-partition the rows by their normalised texts, each partition is sorted
externally, equal texts are then neighbours and full comparisons of neighbours form the groups;
the smallest id of each group stays.

Splitters are (beginning, digest, salt), so their size is bounded however long texts are.  The
beginning has as many characters, of PREFIXES, as a sample needs for few texts to share it; the digest
separates the rest.  Equal texts share all three, except that a group of more than GROUP_ROWS rows or
GROUP_SHARE of all, as the sample shows, is dealt over as many salts as keep each part below that, and its
parts are merged by one row from each.  The sample only steers where rows go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, col, scratch, table, written

PREFIXES = (32, 256)
#: A beginning is long enough if at most this share of the sampled rows shares one with a different text.
SHARED = 1 / 64
SAMPLE = 0.05
#: Rows of one text that a task sorts and numbers together, and their share of all rows, at most.
GROUP_ROWS, GROUP_SHARE = 20_000, 1 / 64
#: Groups that are split, and broadcast as 40 bytes each, at most: so groups of less than this part of all rows never are.
MOST_SPLIT = 100_000


def normalized(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def large_groups(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """((digest, salts) of the large groups, their number, the length of the beginnings), from a sample of (digest, norm)."""
    starts = [F.substring("norm", 1, n).alias(f"p{n}") for n in PREFIXES]
    sample = written(rows.sample(SAMPLE, 17).select("digest", *[F.xxhash64(p).alias(f"p{n}") for n, p in zip(PREFIXES, starts, strict=True)]), "dedup-sample")
    total = sample.count()
    rows_in_all = total / SAMPLE
    most = max(1, rows_in_all / MOST_SPLIT, min(GROUP_ROWS, rows_in_all * GROUP_SHARE))
    counted = sample.groupBy("digest").count().filter(F.col("count") > max(8, most * SAMPLE))
    large = written(counted.select("digest", F.ceil(F.col("count") / (most * SAMPLE)).cast("int").alias("salts")), "dedup-large")
    texts = sample.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), *[F.first(f"p{n}").alias(f"p{n}") for n in PREFIXES])
    for n in PREFIXES[:-1]:
        shared = texts.groupBy(f"p{n}").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).filter("texts > 1").agg(F.max("n")).first()[0]
        if (shared or 0) <= max(8, total * SHARED):
            return large, large.count(), n
    return large, large.count(), PREFIXES[-1]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Null and empty texts form one group.  A null id sorts last.  Rows that repeat an id and a text
    are members of the same group and exactly one row of a group is kept.  An empty table gives an
    empty result; further columns are ignored; texts may have any length.
    """
    norm = normalized(col(text_col))
    with scratch(docs.sparkSession) as keep:
        # Normalised and hashed once: the sample, the range partitioning's own sample and the sort all read it.
        rows = written(docs.select(col(id_col).alias("id"), norm.alias("norm")).withColumn("digest", F.sha2("norm", 256)), "dedup-rows")
        large, split, prefix = large_groups(rows)
        keep += [rows, large]
    keys = ["prefix", "digest"]
    dealt = rows.withColumn("prefix", F.substring("norm", 1, prefix))
    if split:  # not a constant otherwise: the window would lose it, and the range partitioning not meet its distribution
        keys.append("salt")
        dealt = dealt.join(F.broadcast(large), "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"), F.lit(0)))
    dealt = dealt.repartitionByRange(*keys)
    # The range partitioning meets the window's distribution: no exchange, only the external sort.
    equal = Window.partitionBy(*keys, "norm").orderBy(F.col("id").asc_nulls_last())
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A task buffers the rows of one group (salted if large), texts included, and spills them beyond a few thousand.
    runs = dealt.select(
        "id", "digest", *(["salts"] if split else []), *keys[:1], *keys[2:], "norm", F.row_number().over(equal).alias("place"),
        F.first("id").over(equal).alias("least"), F.count(F.lit(1)).over(whole).alias("n"),
    )
    own = runs.drop("norm").withColumns({"keep_id": F.col("least"), "size": F.col("n")})
    if split:
        own = _merged(runs)
    return own.select(
        F.col("id").alias(id_col), "keep_id", F.col("size").cast("long").alias("group_size"),
        ((F.col("place") == 1) & F.col("least").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def _merged(runs: DataFrame) -> DataFrame:
    """Joins the salted parts of large groups by one row from each part; the small side has MOST_SPLIT rows at most."""
    heads = runs.filter(F.col("salts").isNotNull() & (F.col("place") == 1)).select("digest", "salt", "norm", "least", "n")
    # Full comparison: parts with one digest are one group only if their texts are equal.
    parts = heads.groupBy("digest").agg(
        F.min("norm").alias("lo"), F.max("norm").alias("hi"), F.min("least").alias("all_least"), F.sum("n").alias("all_n"),
        F.min_by("salt", F.struct(F.col("least").isNull(), "least", "salt")).alias("first_salt"),
    )
    merged = F.broadcast(parts.filter("lo = hi").select(F.col("digest").alias("whole"), "all_least", "all_n", "first_salt"))
    joined = runs.drop("norm").join(merged, F.col("digest") == F.col("whole"), "left")
    found = F.col("all_n").isNotNull()
    first = F.when(found & (F.col("salt") != F.col("first_salt")), 0).otherwise(F.col("place"))
    return joined.withColumns({
        "keep_id": F.when(found, F.col("all_least")).otherwise(F.col("least")),
        "size": F.when(found, F.col("all_n")).otherwise(F.col("n")), "place": first,
    })


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
