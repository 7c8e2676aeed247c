"""Quality classification by positive-unlabelled learning.

Trusted positives are documents that `labels` marks 1; unlabelled text is every document outside the
held-out fold.  A small network minimises the non-negative unbiased risk
    pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])
with the logistic loss and a class prior pi, estimated from the training labels (the share of
positives) or, where there are only positives, from how densely positives lie among unlabelled
text.  Scores are sigmoid(g), so with the logistic loss they estimate the probability of label 1.

Texts are described once, by numbers that are written; training reads those.  It covers all documents:
they are dealt to shards of about SHARD_ROWS by a hash of themselves, in each of ROUNDS rounds every shard
trains from the common weights against the positives, and the shards' weights are averaged by their
rows.  Partitions and executors make no difference to the result.  Only labelled rows are bounded:
about MAX_LABELLED at most, chosen by a hash of the id.  Every document is scored, on its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import WORD, arrow_map, col, scratch, small_batches, table, texts, written
from .perfect_hash import mix

MAX_LABELLED = 20_000
#: Unlabelled documents of a shard, about; a task holds their numbers (about 60 each).
SHARD_ROWS = 20_000
ROUNDS = 3
STEPS = 500
FOLDS = 3
HELD_OUT = 1
BUCKETS = 32
_SYMBOL = re.compile(r"[#*$%&|<>{}\[\]\\^~=_@]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_STOP = re.compile(r"[.!?…]+(?=\s|$)")
_MARK = re.compile(r"[!?.,;:]{2,}|!!")

NAMES = [
    "empty", "log_words", "mean_word", "sd_word", "symbol_share", "symbol_words", "pipe_words", "upper_share", "upper_words", "digit_share", "mark_words", "stop_words", "comma_words",
    "distinct_words", "top_word", "repeat_4", "log_lines", "dup_lines", "short_lines", "mean_line", "ends_stopped", "letters", "non_ascii", "longest_word", "capital_starts",
]


def features(text: str) -> np.ndarray:
    """Shape of a text: NAMES, then shares of words by length; all finite, also for the empty text."""
    words = WORD.findall(text)
    n, chars = len(words), len(text)
    if not n:
        out = np.zeros(len(NAMES) + BUCKETS, np.float32)
        out[0] = 1
        return out
    lengths = np.fromiter(map(len, words), np.int64, n)
    numbers: dict[str, int] = {}
    own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, n)
    counts = np.bincount(own.astype(np.int64))
    bar = numbers.get("|")
    symbols = len(_SYMBOL.findall(text))
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    # Runs of four words, by a hash of their numbers.
    grams = max(0, n - 3)
    h = sum((mix(own[k : k + grams] + np.uint64(k << 40)) for k in range(4)), np.zeros(grams, np.uint64))
    upper_words = sum(1 for w in words if len(w) > 1 and w.isupper())
    shape = [
        0.0, np.log1p(n), lengths.mean(), lengths.std(), symbols / chars, sum(1 for w in words if _SYMBOL.search(w)) / n,
        (counts[bar] if bar is not None else 0) / n, len(_UPPER.findall(text)) / chars, upper_words / n, len(_DIGIT.findall(text)) / chars,
        len(_MARK.findall(text)) / n, len(_STOP.findall(text)) / n, text.count(",") / n,
        len(counts) / n, counts.max() / n, (grams - len(np.unique(h))) / max(1, grams), np.log1p(len(lines)), 1 - len(set(lines)) / len(lines),
        sum(1 for x in lines if len(x) < 20) / len(lines), np.log1p(chars / len(lines)), sum(1 for x in lines if x[-1] in ".!?:\"'”»") / len(lines),
        sum(map(str.isalpha, words)) / n, (len(text.encode(
            "utf-8", "surrogatepass",
        )) - chars) / chars, np.log1p(lengths.max()), sum(1 for w in words if w[0].isupper()) / n,
    ]
    by_length = np.bincount(np.minimum(lengths, BUCKETS) - 1, minlength=BUCKETS) / n
    return np.concatenate([shape, by_length]).astype(np.float32)


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def packed(self) -> list[float]:
        return np.concatenate([np.ravel(x) for x in (self.w1, self.b1, self.w2, self.b2)]).tolist()

    def with_weights(self, packed: np.ndarray) -> Network:
        n, k = self.w1.shape
        w1, b1, w2, b2 = np.split(np.asarray(packed, float), np.cumsum([n * k, k, k]))
        return Network(self.mean, self.scale, w1.reshape(n, k), b1, w2, float(b2[0]))

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w1 + self.b1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def new_network(mean: np.ndarray, scale: np.ndarray, hidden: int = 24, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    return Network(mean, scale, rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)


def fit_nnpu(
    net: Network, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.01,
    decay: float = 1e-4, seed: int = 5,
) -> Network:
    """Adam on the non-negative risk; where the negative part falls below zero, its gradient is reversed."""
    rng = np.random.default_rng(seed)
    net = net.with_weights(net.packed())
    params = ["w1", "b1", "w2", "b2"]
    first, second = ({p: np.zeros_like(getattr(net, p)) for p in params} for _ in range(2))
    z = [np.clip((x - net.mean) / net.scale, -6, 6) for x in (positive, unlabelled)]
    for step in range(1, steps + 1):
        p, u = (x[rng.integers(0, len(x), min(len(x), 512))] for x in z)
        hp, hu = (np.tanh(x @ net.w1 + net.b1) for x in (p, u))
        sp, su = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -40, 40))) for h in (hp, hu))
        negative = np.logaddexp(0, hu @ net.w2 + net.b2).mean() - prior * np.logaddexp(0, hp @ net.w2 + net.b2).mean()
        # d loss / d logit: l(g) gives s - 1, l(-g) gives s
        if negative >= 0:
            gp, gu = prior * (sp - 1) - prior * sp, su
        else:
            gp, gu = prior * sp, -su
        grads = dict.fromkeys(params, 0.0)
        for x, h, g in ((p, hp, gp / len(p)), (u, hu, gu / len(u))):
            back = np.outer(g, net.w2) * (1 - h * h)
            for name, value in (("w1", x.T @ back), ("b1", back.sum(0)), ("w2", h.T @ g), ("b2", g.sum())):
                grads[name] = grads[name] + value
        for name in params:
            g = grads[name] + (decay * getattr(net, name) if name != "b2" else 0)
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.999 * second[name] + 0.001 * g * g
            move = rate * (1 - step / steps) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
            setattr(net, name, getattr(net, name) - move)
    return net


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of rows (doc_id, text): the features as an array."""

    def make():
        return lambda b: {"doc_id": b.column("doc_id"), "x": [features(t) for t in texts(b)]}

    return arrow_map(docs.select("doc_id", "text"), "doc_id long, x array<float>", make)


#: Sums over tasks and shards are sums of whole numbers: features times FIXED, weights times FINE.
FIXED = 1 << 20
FINE = 1 << 32


def summed(parts: DataFrame) -> tuple[int, list[int]]:
    """Sums of the rows (n, v), one or more for each task or shard, by position: one row for each position comes to the driver."""
    each = parts.select("n", F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    rows = sorted(each.collect())
    return (rows[0]["n"] if rows else 0), [int(r["x"]) for r in rows]


def _counted(n: int, vector: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([vector.tolist()], pa.list_(pa.int64()))], names=["n", "v"])


def moments(shapes: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, scale) of x over all rows: exact sums of x and its square in fixed point, so no order changes them."""
    width = len(NAMES) + BUCKETS

    def powers(x: np.ndarray) -> np.ndarray:
        fixed = np.rint(x * FIXED).astype(np.int64)
        high, low = np.divmod(fixed, FIXED)  # the square would pass 64 bits in one piece
        return np.concatenate([fixed.sum(0), (high * high).sum(0), (high * low).sum(0), (low * low).sum(0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _counted(b.num_rows, powers(matrix(b.column("x"))))

    n, sums = summed(shapes.select("x").mapInArrow(run, "n long, v array<long>"))
    if not n:
        return 0, np.zeros(width), np.full(width, 1e-3)
    total, high, cross, low = (sums[k * width : (k + 1) * width] for k in range(4))
    mean = np.array([t / (n * FIXED) for t in total])
    square = np.array([(h * FIXED * FIXED + 2 * c * FIXED + v) / (n * FIXED * FIXED) for h, c, v in zip(high, cross, low, strict=True)])
    return n, mean, np.sqrt(np.maximum(0, square - mean * mean)) + 1e-3


def matrix(x: pa.ListArray) -> np.ndarray:
    return x.flatten().to_numpy().astype(np.float64).reshape(len(x), len(NAMES) + BUCKETS)


def fitted(shapes: DataFrame, rows: int, positive: np.ndarray, net: Network, prior: float) -> Network:
    """The network after all rounds over the shards of the unlabelled (doc_id, x)."""
    shards = max(1, -(-rows // SHARD_ROWS))
    dealt = shapes.select("x", F.pmod(F.xxhash64("doc_id", "x"), F.lit(shards)).cast("int").alias("shard"))
    for k in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], net=net) -> Iterator[pa.RecordBatch]:
            held = [matrix(b.column("x")) for b in batches if b.num_rows]
            if held:
                x = np.concatenate(held)
                own = fit_nnpu(net, positive, x, prior, seed=k)
                yield _counted(len(x), np.rint(len(x) * FINE * np.asarray(own.packed())).astype(np.int64))

        met = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("x").select("x")
        n, weights = summed(met.mapInArrow(run, "n long, v array<long>"))
        net = net.with_weights(np.array([w / (n * FINE) for w in weights]))
    return net


def train(shapes: DataFrame, labels: DataFrame) -> Network | None:
    """Fits on the (doc_id, x) outside the held-out fold; None where there are no positives or no documents.

    A document with several labels counts as positive only if all say so; of rows that repeat an id the least
    in order of their features stands for its label.  Null ids have no label, but are unlabelled text.
    """
    ours = shapes.filter(fold(F.col("doc_id")) != HELD_OUT)
    rows, mean, scale = moments(ours)
    known = labels.filter("doc_id is not null and quality is not null").filter(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # By a hash, not by an order: no task or driver merges the firsts of all tasks.
    share = min(1.0, MAX_LABELLED / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = ours.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")
    positives = chosen[chosen["quality"] == 1]
    if not len(positives) or not rows:
        return None
    positive = np.stack(positives["x"].to_numpy()).astype(np.float64)
    net = new_network(mean, scale)
    prior = float((chosen["quality"] == 1).mean())
    if prior == 1:  # only positives are known: the rest is as dense as scores among all text say
        prior = estimate_prior(ours, rows, positive, net)
    return fitted(ours, rows, positive, net, float(np.clip(prior, 0.05, 0.95)))


def estimate_prior(shapes: DataFrame, rows: int, positive: np.ndarray, net: Network) -> float:
    """The share of positives in unlabelled text.

    A classifier of positives against unlabelled text gives c = mean score of positives, and the prior is
    the mean of s (1 - c) / (c (1 - s)) over all text.
    """
    rough = fitted(shapes, rows, positive, net, 0.5)
    c = rough.scores(positive).mean()

    def make():
        def f(b: pa.RecordBatch) -> dict:
            s = np.clip(rough.scores(matrix(b.column("x"))), 0, 0.99)
            return {"p": pa.array(np.minimum(1, s * (1 - c) / (c * (1 - s))))}

        return f

    return float(arrow_map(shapes.select("x"), "p double", make).agg(F.avg("p")).first()[0])


def scored(shapes: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score) from (doc_id, x).  Without a model every score is 0.5."""

    def make():
        return lambda b: {"doc_id": b.column("doc_id"), "score": pa.array(net.scores(matrix(b.column("x"))) if net else np.full(b.num_rows, 0.5))}

    return arrow_map(shapes, "doc_id long, score double", make)


def _ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, row, score); `row` is a struct of the input's other columns.

    Null and empty texts get a score like all others, and texts may have any length; null ids and repeated rows
    are rows like others; an empty table gives an empty result.  Without a model every score is 0.5.
    """
    small_batches(docs.sparkSession)
    rest = F.struct(*[col(c) for c in docs.columns if c not in (id_col, text_col)] or [F.lit(None).cast("int").alias("_")])
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"), rest.alias("row"))
    schema = StructType(list(rows.schema)).add("score", DoubleType())

    def make():
        def f(b: pa.RecordBatch) -> dict:
            x = np.stack([features(t) for t in texts(b)]).astype(np.float64)
            return {c: b.column(c) for c in ("doc_id", "text", "row")} | {"score": net.scores(x) if net else np.full(len(x), 0.5)}

        return f

    return arrow_map(rows, schema, make)


def trained_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """`train` on the documents themselves."""
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return train(written(described(_ids_and_texts(docs, id_col, text_col)), "quality-shapes"), labels)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score `threshold` or more, with the columns of `docs`; all, where nothing can be learnt."""
    kept = score(docs, trained_on(docs, labels, id_col, text_col), id_col, text_col).filter(F.col("score") >= threshold)
    place = {id_col: F.col("doc_id"), text_col: F.col("text")}
    return kept.select(*[place.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    with scratch(spark) as keep:
        shapes = written(described(_ids_and_texts(table(spark, sf_dir, "documents"), "doc_id", "text")), "quality-shapes")
        net = train(shapes, table(spark, sf_dir, "labels"))
        keep.append(shapes)
    done = scored(shapes, net)
    return done.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
