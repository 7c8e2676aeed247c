"""Language-model scores by masked pseudo-likelihood.

A network predicts every token of a text from WINDOW words on each side, the token itself masked; a
document's score is the sum of the conditional log-probabilities of all its words.

The vocabulary grows with the square root of the corpus: at most VOCABULARY_FACTOR * sqrt(tokens) of the
most frequent words have embeddings and leaves of the softmax, see `window_network`.  Any other word is a
token of its shape (length, ending, characters), times the share that the word has among all
occurrences of such words, so every word of the corpus is predicted.

The corpus is tokenised once; training and scoring read the ids.  Training covers all documents in
ROUNDS rounds over disjoint parts.  Documents are dealt to shards by a hash of themselves, each shard
trains from the common weights, and each row of the weights becomes the mean over the shards, by how
often they used it.  The number of shards depends on the corpus alone, so partitions, executors and
the order of rows make no difference.  Vocabulary and weights go through the shared folder; the
driver sees sums and file names only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, col, scratch, small_batches, split_words, table, written
from .perfect_hash import mix
from .window_network import SHAPES, Codes, WindowNetwork, batches

VOCABULARY_FACTOR = 16
#: Square root of the tokens for each shard of a round: shards and vocabulary grow together with the corpus.
SHARD_ROOT = 1000
ROUNDS = 2
#: Distinct words that a task counts before it hands them over.
HELD_WORDS = 1_000_000
#: Tokens of whole texts that a task trains on together.
GROUP = 50_000
#: Rows of weights that are averaged together.
BLOCK = 8192
_SEED = 42


def described_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys, shapes) of words that aren't empty, all at once.

    A key is a 64-bit hash.  A shape, 0 to SHAPES - 1, is the length in bytes in four steps, by the kind of
    characters (ASCII letters; some not ASCII; some digits; others), by whether the last one is a letter
    in lower case or not ASCII.
    """
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts, size = ends[:-1] - ends[0], np.diff(ends)
    place = np.arange(len(data)) - np.repeat(starts, size)
    keys = np.add.reduceat((data + np.uint64(1)) * mix(place.astype(np.uint64) + np.uint64(_SEED)), starts)
    letter = (data | 32) - 97 < 26  # bytes wrap around
    digit, high = data - 48 < 10, data > 127
    some = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64)
    kind = np.where(some(letter) == size, 0, np.where(some(high) > 0, 1, np.where(some(digit) > 0, 2, 3)))
    last = data[starts + size - 1]
    rough = ~((last >= 97) & (last < 123) | (last >= 128))
    return mix(keys + size.astype(np.uint64)), ((np.digitize(size, (5, 8, 12)) * 4 + kind) * 2 + rough).astype(np.int32)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n, key, shape) of the distinct words of all texts; each task counts what it can hold first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def summed(t: pa.Table) -> pa.Table:
            done = t.group_by("word", use_threads=False).aggregate([("n", "sum")])
            return pa.table({"word": done["word"], "n": done["n_sum"]})

        for b in batches:
            found = split_words(b.column("text"))[1].value_counts()
            own = pa.table({"word": found.field("values").dictionary_decode().cast(pa.binary()), "n": found.field("counts")})
            held = own if held is None else pa.concat_tables([held, own])
            if held.num_rows > 2 * HELD_WORDS:
                held = summed(held)
                if held.num_rows > HELD_WORDS:
                    yield from held.combine_chunks().to_batches()
                    held = None
        if held is not None:
            yield from summed(held).combine_chunks().to_batches()

    def make():
        def f(b: pa.RecordBatch) -> dict:
            keys, shapes = described_words(b.column("word"))
            return {"word": b.column("word"), "n": b.column("n"), "key": pa.array(keys.view(np.int64)), "shape": pa.array(shapes)}

        return f

    counted = rows.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return arrow_map(counted, "word binary, n long, key long, shape int", make)


class Vocabulary:
    """The words with ranks, in files of (word, n), and the other words' occurrences by shape."""

    def __init__(self, levels: int, files: list[str], rare: list[int]):
        self.levels, self.files, self.rare = levels, files, rare

    @classmethod
    def chosen(cls, words: DataFrame) -> tuple[Vocabulary, DataFrame]:
        """The vocabulary of counted words, and (key, share): each other word's log share within its shape."""
        by_size = words.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()
        by_size = sorted(((r["size"], r["words"], r["n"]) for r in by_size), reverse=True)
        tokens, distinct = sum(n for _, _, n in by_size), sum(w for _, w, _ in by_size)
        levels = int(math.log2(min(VOCABULARY_FACTOR * math.sqrt(tokens), distinct) + 1))
        size, least = (1 << levels) - 1, 1
        for exponent, count, _ in by_size:
            least, size = 1 << exponent, size - count
            if size <= 0:
                break
        ranked = words.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit((1 << levels) - 1)
        held = written(ranked.select("word", "n"), "lm-vocabulary")
        low = held.agg(F.min("n")).first()[0]
        last = held.filter(F.col("n") == low).agg(F.max("word")).first()[0] if low else b""
        rare = words.filter((F.col("n") < F.lit(low)) | ((F.col("n") == F.lit(low)) & (F.col("word") > F.lit(bytes(last))))) if low else words
        totals = {r["shape"]: r["n"] for r in rare.groupBy("shape").agg(F.sum("n").alias("n")).collect()}
        found = cls(levels, held.inputFiles(), [totals.get(k, 0) for k in range(SHAPES)])
        total = F.element_at(F.array(*[F.lit(float(max(1, n))) for n in found.rare]), F.col("shape") + 1)
        # Words that share a key, one in 2^64, count as the more frequent one.
        return found, rare.groupBy("key").agg(F.max(F.log("n") - F.log(total)).alias("share"))

    def ranked(self) -> tuple[list[bytes], np.ndarray]:
        read = _read(self.files)
        words, n = read.column("word").to_pylist(), read.column("n").to_numpy()
        order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
        return [words[k] for k in order], n[order]

    def network(self, weights: list[list[str]]) -> WindowNetwork:
        """The unigram model at first, then the weights of each round."""
        net = WindowNetwork(Codes(self.levels), np.concatenate([self.rare, self.ranked()[1]]).astype(float))
        for files in weights:
            for r in _read(files).to_pylist():
                own = getattr(net, r["part"])
                rows, values = np.frombuffer(r["rows"], np.int32), np.frombuffer(r["weights"], np.float32)
                own[rows] = values.reshape(len(rows), -1) if r["part"] != "top" else values.reshape(own.shape)
        return net


def _read(files: list[str]) -> pa.Table:
    parts = []
    for uri in files:
        store, path = fs.FileSystem.from_uri(uri)
        parts.append(pq.read_table(path, filesystem=store))
    return pa.concat_tables(parts)


#: What a worker has read, by the files: tasks that follow in it use it again.
_held: dict = {}


def _once(kind: str, files: list, make):
    key = (kind, str(files))
    if key not in _held:
        for other in [k for k in _held if k[0] == kind]:
            del _held[other]
        _held[key] = make()
    return _held[key]


def packed(ids: np.ndarray) -> bytes:
    """32-bit ids as four planes of bytes, which compress better."""
    return ids.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def tokenised(rows: DataFrame, vocabulary: Vocabulary, shards: int) -> DataFrame:
    """(row, doc_id, n, ids, rare, part): `rare` has the keys of the words outside the vocabulary; part is the round and shard."""

    def make():
        ranked = _once("words", vocabulary.files, lambda: pa.array(vocabulary.ranked()[0], pa.binary()))

        def f(b: pa.RecordBatch) -> dict:
            offsets, coded = split_words(b.column("text"))
            words = coded.dictionary.cast(pa.binary())
            rank = pc.fill_null(pc.index_in(words, value_set=ranked), -1).to_numpy(zero_copy_only=False)
            keys, shapes = described_words(words)
            own, codes = np.where(rank < 0, shapes, SHAPES + rank).astype(np.int32), coded.indices.to_numpy()
            ids = own[codes]
            rare = ids < SHAPES
            before = np.concatenate([[0], np.cumsum(rare)])[offsets].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(before), pa.array(keys[codes[rare]].view(np.int64)))
            parts = [packed(ids[lo:hi]) for lo, hi in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            return {"row": b.column("row"), "doc_id": b.column("doc_id"), "n": pa.array(np.diff(offsets)), "ids": parts, "rare": lists}

        return f

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    coded = arrow_map(numbered, "row long, doc_id long, n long, ids binary, rare array<long>", make)
    return coded.withColumn("part", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(ROUNDS * shards)).cast("int"))


def trained(tokens: DataFrame, vocabulary: Vocabulary, shards: int) -> list[list[str]]:
    """The files of each round's weights: (part, block, rows, weights)."""
    weights: list[list[str]] = []
    for k in range(ROUNDS):

        def run(batches_: Iterator[pa.RecordBatch], before=tuple(weights)) -> Iterator[pa.RecordBatch]:
            net = vocabulary.network(before)
            held, size = [], 0
            for b in batches_:
                for data in b.column("ids").to_pylist():
                    held.append(unpacked(data))
                    size += len(held[-1])
                    if size >= GROUP:
                        _learn(net, held)
                        held, size = [], 0
            _learn(net, held)
            yield from _used_rows(net)

        own = tokens.filter(F.col("part").between(k * shards, (k + 1) * shards - 1) & (F.col("n") > 0))
        own = own.select("ids", "doc_id", (F.col("part") - k * shards).alias("shard"))
        dealt = own.repartitionById(shards, F.col("shard")).sortWithinPartitions(F.xxhash64("ids"), "doc_id").select("ids")
        kinds = "part string, block int, rows binary, used binary, weights binary"
        blocks = dealt.mapInArrow(run, kinds).groupBy("part", "block")
        weights.append(written(blocks.applyInPandas(_mean, "part string, block int, rows binary, weights binary"), "lm-weights").inputFiles())
    return weights


def _learn(net: WindowNetwork, held: list[np.ndarray]) -> None:
    if held:
        for line, place, _ in batches(held, net.codes.edge):
            net.learn(line, place)


def _used_rows(net: WindowNetwork) -> Iterator[pa.RecordBatch]:
    """The rows of the weights that took part, with how often."""
    for part in net.PARTS:
        rows, values = np.flatnonzero(net.used[part]).astype(np.int32), getattr(net, part)
        for block in np.unique(rows // BLOCK).tolist():
            own = rows[rows // BLOCK == block]
            columns = [[part], [block], [own.tobytes()], [net.used[part][own].tobytes()], [values[own].tobytes()]]
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "block", "rows", "used", "weights"])


def _mean(pdf):
    """The means of a block's rows over the shards, by how often each used them."""
    import pandas as pd

    first = int(pdf["block"].iloc[0]) * BLOCK
    total, times = None, np.zeros(BLOCK)
    for rows, used, weights in sorted(zip(pdf["rows"], pdf["used"], pdf["weights"], strict=True)):
        at, n = np.frombuffer(rows, np.int32) - first, np.frombuffer(used, np.float32)
        own = np.frombuffer(weights, np.float32).reshape(len(at), -1)
        total = np.zeros((BLOCK, own.shape[1])) if total is None else total
        total[at] += own * n[:, None]
        times[at] += n
    at = np.flatnonzero(times)
    mean = (total[at] / times[at, None]).astype(np.float32)
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "block": [pdf["block"].iloc[0]], "rows": [(at + first).astype(np.int32).tobytes()], "weights": [mean.tobytes()]})


def scored(tokens: DataFrame, vocabulary: Vocabulary, weights: list[list[str]]) -> DataFrame:
    """(row, doc_id, n, net): the network's part of each row's score."""

    def make():
        net = _once("network", [vocabulary.files, weights], lambda: vocabulary.network(weights))

        def f(b: pa.RecordBatch) -> dict:
            own = [unpacked(x) for x in b.column("ids").to_pylist()]
            total = np.zeros(len(own))
            for line, place, number in batches(own, net.codes.edge):
                total += np.bincount(number, net.log_probabilities(line, place), len(own))
            return {c: b.column(c) for c in ("row", "doc_id", "n")} | {"net": pa.array(total)}

        return f

    return arrow_map(tokens.select("row", "doc_id", "n", "ids"), "row long, doc_id long, n long, net double", make)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_probability, mean_log_probability) of each row.

    Null and empty texts have no tokens: their sum is 0 and their mean null.  Null ids and repeated
    rows are rows like others; further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    with scratch(spark) as keep:
        words = written(word_counts(rows), "lm-words")
        vocabulary, shares = Vocabulary.chosen(words)
        shards = math.ceil(math.sqrt(words.agg(F.sum("n")).first()[0] or 1) / SHARD_ROOT)
        tokens = written(tokenised(rows, vocabulary, shards), "lm-tokens")
        net = scored(tokens, vocabulary, trained(tokens, vocabulary, shards))
        # Rare words are rare, so no key of this join is hot.
        rare = tokens.select("row", F.explode("rare").alias("key")).join(shares, "key").groupBy("row").agg(F.sum("share").alias("rare"))
        out = written(net.join(rare, "row", "left"), "lm-scores")
        keep.append(out)
    total = F.col("net") + F.coalesce("rare", F.lit(0.0))
    return out.select("doc_id", F.col("n").alias("n_tokens"), total.alias("log_probability"), F.when(F.col("n") > 0, total / F.col("n")).alias("mean_log_probability"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
