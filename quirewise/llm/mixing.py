"""Mixing sources to target weights by a low-discrepancy schedule.

The words of each source, its documents shuffled, are one stream cut into blocks of BLOCK words; a source
with a target above its size starts over.  Slot i of the schedule takes the point i * golden ratio
modulo 1, as an exact 64-bit integer, whose place in the cumulative target weights names the source;
the r-th slot of a source takes its r-th block, and slots of a source that has reached its target stay
free.  So any run of slots holds the sources in nearly their target shares.  The last block of a source
ends at its target.

Sources, like slots and documents, are rows of DataFrames: there may be any number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..operators.ranking import numbered, running
from .common import WORD, arrow_map, col, scratch, small_batches, table, texts, written
from .ranks import buckets_for, order_key, running_before

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_EPOCHS = 2
BLOCK = 1024
#: Points of the schedule that a task gives to sources at once.
CHUNK = 1 << 16
#: The golden ratio's fraction times 2^64, to the nearest odd integer: i * GOLDEN modulo 2^64 repeats after 2^64 points only.
GOLDEN = 0x9E3779B97F4A7C15
#: Sources that are broadcast to the documents; more are joined.
BROADCAST_SOURCES = 100_000
SALTS = 32


def word_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size): words of each whole text; bytes split at just the contract's white space."""

    def make():
        return lambda batch: {
            "doc_id": batch.column("doc_id"), "source": batch.column("source"),
            "size": [len(t.encode("utf-8", "surrogatepass").split()) for t in texts(batch)],
        }

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(source_col).cast("string").alias("source"), col(text_col).alias("text"))
    return arrow_map(rows, "doc_id long, source string, size long", make)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_no, source_size, rows, target, quota, before) from (doc_id, source, size).

    Sources by code point, null last, weigh WEIGHTS in turn and share BUDGET times all sizes; a target
    stops at MOST_EPOCHS times its source's size and the excess goes to the others by weight.  With
    sources in order of cap / weight, those that stop are a prefix: the level is (budget - their caps) /
    the others' weights, at the first source that doesn't stop.  quota is the target in blocks, and
    `before` the quotas of the sources with smaller numbers.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"), F.col("source").isNull().alias("unnamed"))
    placed = numbered(found, ["unnamed", "source"], [], "place").withColumn("source_no", F.col("place") - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    cap = MOST_EPOCHS * F.col("source_size")
    weighed = written(placed.withColumns({"weight": weight.cast("long"), "cap": cap, "ratio": cap / weight}), "mix-sources")
    words, weights = (x or 0 for x in weighed.agg(F.sum("source_size"), F.sum("weight")).first())
    sums = running(weighed, ["ratio", "source_no"], {"full": (F.sum, F.col("cap")), "used": (F.sum, F.col("weight"))})
    levels = sums.withColumn("level", (F.lit(BUDGET * words) - F.coalesce("full", F.lit(0))) / (F.lit(weights) - F.coalesce("used", F.lit(0))))
    level = levels.filter(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", F.struct("ratio", "source_no"))).first()[0]
    target = F.col("cap").cast("double") if level is None else F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    quota = F.ceil(F.floor("target") / BLOCK)
    done = weighed.withColumn("target", target).withColumn("quota", quota)
    return running(done, ["source_no"], {"before": (F.sum, F.col("quota"))}).select(
        "source", "source_no", "source_size", "rows", "target", "quota", F.coalesce("before", F.lit(0)).alias("before"),
    )


def points(first: int, count: int) -> np.ndarray:
    """Points `first` and following of the sequence, as fractions of 2^64."""
    with np.errstate(over="ignore"):
        return np.arange(first, first + count, dtype=np.uint64) * np.uint64(GOLDEN)


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, source_no, rank) of the slots that get a block, from (source_no, quota, before).

    3 * blocks + 64 points always suffice, as a source with k of n blocks is hit again within
    2.62 * n / k points.  The points are cut into equal parts of the range 0 to 1; a part has about CHUNK
    points, and few sources reach into it, so points and sources meet there without a join on ranges.
    """
    spark = sources.sparkSession
    blocks = sources.agg(F.sum("quota")).first()[0] or 0
    count = 3 * blocks + 64 if blocks else 0
    bits = max(0, (count // CHUNK).bit_length())

    def cut():
        def f(batch: pa.RecordBatch) -> dict:
            part, lo, no = [], [], []
            for s, quota, before in zip(*(batch.column(c).to_pylist() for c in ("source_no", "quota", "before")), strict=True):
                start, end = (-(-(k << 64) // blocks) for k in (before, before + quota))
                for p in range(start >> 64 - bits, (end - 1 >> 64 - bits) + 1):
                    part.append(p)
                    lo.append(max(start, p << 64 - bits) - (1 << 63))
                    no.append(s)
            return {"part": part, "x": lo, "source_no": no}

        return f

    def spread():
        def f(batch: pa.RecordBatch) -> dict:
            ids = batch.column("id").to_pylist()
            i = np.concatenate([np.arange(k * CHUNK, min(count, (k + 1) * CHUNK)) for k in ids])
            x = np.concatenate([points(k * CHUNK, min(CHUNK, count - k * CHUNK)) for k in ids])
            part = (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)
            return {"part": pa.array(part), "x": pa.array((x ^ np.uint64(1 << 63)).view(np.int64)), "slot": pa.array(i)}

        return f

    starts = arrow_map(sources.filter("quota > 0").select("source_no", "quota", "before"), "part long, x long, source_no long", cut)
    spots = arrow_map(spark.range(-(-count // CHUNK)), "part long, x long, slot long", spread)
    both = starts.withColumn("slot", F.lit(None).cast("long")).unionByName(spots.withColumn("source_no", F.lit(None).cast("long")))
    met = both.repartition("part").sortWithinPartitions("part", F.col("source_no").isNull(), "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ends, numbers = None, [], []
        for b in batches:
            part, x, no, slot = b.column("part").to_numpy(), b.column("x").to_numpy(), b.column("source_no"), b.column("slot")
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi == lo:
                    continue
                if part[lo] != last:
                    last, ends, numbers = part[lo], [], []
                named = hi - lo - no.slice(lo, hi - lo).null_count
                ends += x[lo : lo + named].tolist()
                numbers += no.slice(lo, named).to_pylist()
                at = np.searchsorted(np.array(ends, np.int64), x[lo + named : hi], side="right") - 1
                yield pa.RecordBatch.from_arrays([slot.slice(lo + named, hi - lo - named), pa.array(np.array(numbers, np.int64)[at])], names=["slot", "source_no"])

    hits = numbered(met.mapInArrow(run, "slot long, source_no long"), ["slot"], ["source_no"], "place")
    ranked = hits.join(_small(sources.select("source_no", "quota"), spark), "source_no").filter("place <= quota")
    slots = written(ranked.select("slot", "source_no", (F.col("place") - 1).alias("rank")), "mix-slots")
    if (got := slots.count()) != blocks:
        raise RuntimeError(f"{got} slots for {blocks} blocks")
    return slots


def _small(sources: DataFrame, spark: SparkSession) -> DataFrame:
    """The sources, broadcast where they are few."""
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The mix and the documents' places: (pieces, streams).

    pieces: (slot, doc_id, source_no, at, epoch, start, length), the words [start, start + length) of a
    document that stand in a slot of the schedule.  streams: (doc_id, source, source_no, at, size,
    source_size, target), one row per input row; `at` is the first word's place in its source's stream.  A null
    source is a source of its own, last; a null id is an id.  Rows that repeat are rows of their
    own: (source_no, at) tells rows with words apart.  Documents without words have no pieces.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with scratch(spark) as keep:
        sizes = written(word_counts(docs, id_col, text_col, source_col), "mix-sizes")
        sources = written(source_targets(sizes), "mix-targets")
        named = sources.select("source", "source_no", "source_size", "target")
        named = named.withColumnRenamed("source", "named")
        if sources.count() <= BROADCAST_SOURCES:
            keyed = sizes.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("named")))
        else:  # salted, as one source may hold a third of the rows
            salted = named.withColumn("salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            dealt = sizes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
            keyed = dealt.join(salted, (F.col("salt") == F.col("salted")) & F.col("source").eqNullSafe(F.col("named")))
        keyed = keyed.select("doc_id", "source", "source_no", "size", "source_size", "target", order_key(F.col("doc_id")).alias("key"))
        digits = buckets_for(sources.agg(F.max("rows")).first()[0] or 0)
        streams = written(running_before(keyed, "source_no", "key", digits, F.col("size"), ["doc_id", "size"], "at").drop("key"), "mix-streams")
        slots = schedule(sources.select("source_no", "quota", "before"))
        keep += [streams, slots]
    pieces = _blocks(streams).join(slots.withColumnRenamed("rank", "block"), ["source_no", "block"])
    return pieces.select("slot", "doc_id", "source_no", "at", "epoch", "start", "length"), streams


def _blocks(streams: DataFrame) -> DataFrame:
    """(source_no, block, doc_id, at, epoch, start, length): each document's parts by block, in each epoch, up to the target."""
    epochs = F.explode(F.array(*[F.lit(k) for k in range(MOST_EPOCHS)]))
    last: Column = F.floor("target").cast("long")
    rows = streams.filter("size > 0").withColumn("epoch", epochs)
    rows = rows.withColumn("lo", F.col("at") + F.col("epoch") * F.col("source_size"))
    rows = rows.withColumn("hi", F.least(F.col("lo") + F.col("size"), last)).filter("hi > lo")
    rows = rows.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {BLOCK}"), F.expr(f"(hi - 1) div {BLOCK}"))))
    begin = F.greatest(F.col("lo"), F.col("block") * BLOCK)
    end = F.least(F.col("hi"), (F.col("block") + 1) * BLOCK)
    return rows.select("source_no", "block", "doc_id", "at", "epoch", (begin - F.col("lo")).alias("start"), (end - begin).alias("length"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as the mix takes them, in the order of the schedule's slots, with the columns of `docs`.

    A document comes where its first slot is; one that the mix takes twice comes twice; the last one that a
    source's target reaches comes with its first words only; documents that the mix doesn't take,
    and those without words, are left out.  Rows that repeat an id in one source share what the mix takes
    of them by their sizes, and their slots.
    """
    spark = docs.sparkSession
    pieces, streams = mix(docs, id_col, text_col, source_col)
    copies = pieces.groupBy("source_no", "at", "epoch").agg(F.sum("length").alias("words"), F.min("slot").alias("slot"))
    sized = streams.filter("size > 0").join(copies, ["source_no", "at"], "left")
    taken = sized.groupBy("doc_id", "source", "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    taken = taken.withColumn("copy", F.when(F.col("words") > 0, F.struct("epoch", "slot", "words")))
    whole = streams.filter("size > 0").groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    listed = taken.groupBy("doc_id", "source").agg(F.sort_array(F.collect_list("copy")).alias("copies"))  # MOST_EPOCHS at most
    same = whole["doc_id"].eqNullSafe(listed["doc_id"]) & whole["source"].eqNullSafe(listed["source"])
    known = listed.join(whole, same).filter("size(copies) > 0").select(listed["doc_id"].alias("own_id"), listed["source"].alias("own_source"), "copies", "size")
    rows = docs.select(F.struct(*[col(c) for c in docs.columns if c != text_col]).alias("row"), col(text_col).alias("text"))
    own = F.col("row")[id_col].cast("long").eqNullSafe(F.col("own_id")) & F.col("row")[source_col].cast("string").eqNullSafe(F.col("own_source"))
    met = rows.join(known, own).select("row", "text", "copies", "size")
    schema = StructType([met.schema["row"], met.schema["text"]]).add("slot", LongType())

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            at, out, slots = [], [], []
            for k, (t, copies, size) in enumerate(zip(texts(batch), batch.column("copies").to_pylist(), batch.column("size").to_pylist(), strict=True)):
                ends = [m.end() for m in WORD.finditer(t)]
                for c in copies:
                    n = len(ends) * c["words"] // size
                    if n:
                        at.append(k)
                        out.append(t if n == len(ends) else t[: ends[n - 1]])
                        slots.append(c["slot"])
            return {"row": batch.column("row").take(pa.array(at, pa.int64())), "text": out, "slot": slots}

        return f

    done = arrow_map(met, schema, make)
    # Slots are dense enough to deal them out evenly without a sample.
    last = pieces.agg(F.max("slot")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = done.repartitionById(tasks, (F.col("slot") * tasks / (last + 1)).cast("int")).sortWithinPartitions("slot")
    return order.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and of each document the first of its slots (null: none) and their number."""
    pieces, streams = mix(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy("source_no", "at").agg(F.sum("length").alias("words"), F.min("slot").alias("slot"), F.count_distinct("slot").alias("slots"))
    # Documents without words share their place with the next document, but take nothing.
    joined = streams.join(taken, ["source_no", "at"], "left")
    own = lambda c: F.when(F.col("size") > 0, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "size", "source_size", "target", own("words").alias("taken"),
        F.when(F.col("size") > 0, F.col("slot")).alias("first_slot"), own("slots").alias("n_slots"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 2 * source_size / w AS ratio,
    coalesce(sum(2 * source_size) OVER o, 0) AS full_before, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest
  FROM s WINDOW o AS (ORDER BY 2 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - full_before::DOUBLE) / rest::DOUBLE AS level FROM r),
lv AS (SELECT level FROM v WHERE level * w <= 2 * source_size ORDER BY ratio, source IS NULL, source LIMIT 1),
t AS (SELECT s.source, s.source_size, least((2 * s.source_size)::DOUBLE, coalesce((SELECT level FROM lv) * s.w, (2 * s.source_size)::DOUBLE)) AS target FROM s),
q AS (SELECT *, CAST(ceil(floor(target) / 1024) AS HUGEINT) AS quota FROM t),
e AS (SELECT *, sum(quota) OVER () AS blocks, sum(quota) OVER (ORDER BY source IS NULL, source) AS upto FROM q),
x AS (
  SELECT i AS slot, i::HUGEINT * 11400714819323198485 % 18446744073709551616 AS x
  FROM range(CAST((SELECT CASE WHEN max(blocks) > 0 THEN 3 * max(blocks) + 64 ELSE 0 END FROM e) AS BIGINT)) g(i)),
h AS (
  SELECT x.slot, e.source, e.quota, row_number() OVER (PARTITION BY e.source ORDER BY x.slot) - 1 AS block
  FROM x JOIN e ON e.quota > 0 AND x.x * e.blocks >= (e.upto - e.quota) * 18446744073709551616 AND x.x * e.blocks < e.upto * 18446744073709551616),
p AS (
  SELECT row_number() OVER () AS row_no, d.doc_id, d.source, d.size, t.source_size, t.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT p.*, pos + k * source_size AS lo, least(pos + k * source_size + size, floor(target)::BIGINT) AS hi
  FROM p, (VALUES (0), (1)) epoch(k) WHERE size > 0),
f AS (
  SELECT c.row_no, min(h.slot) AS first_slot, count(DISTINCT h.slot) AS n_slots
  FROM c JOIN h ON h.source IS NOT DISTINCT FROM c.source AND h.block < h.quota AND h.block BETWEEN c.lo // 1024 AND (c.hi - 1) // 1024
  WHERE c.hi > c.lo GROUP BY c.row_no)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(pos + size, floor(target)) - pos) + greatest(0, least(pos + source_size + size, floor(target)) - pos - source_size) AS BIGINT) AS taken,
  first_slot, coalesce(n_slots, 0) AS n_slots
FROM p LEFT JOIN f USING (row_no)
"""
