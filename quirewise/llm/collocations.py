"""Collocations of two and three words, mined through a sketch and automata.

1. Texts become shards, one row each: at most about `SHARD_BYTES` of one language, lower-case words with
   one space around each and a line end between pieces.  They are written once, compressed, and move so.
2. Each shard sends, for each of its distinct phrases of one to three words, a cell and a count: a sketch
   with a cell for each occurrence in the corpus or more (so it grows with it), cut into blocks.  A task
   adds up one block and answers each shard, one bit a cell, which cells reach the least count.  A cell is
   an upper bound of each phrase in it, so no phrase that is frequent enough is lost.
3. Each shard compiles its own phrases of two or three words whose bound is high enough into an automaton
   (pyahocorasick), each with a delimiter on both sides, and scans its text once: matches overlap, and none
   crosses a piece.  Single words, which are no candidates, are counted as they are coded.  A task scans
   `SHARDS_A_TASK` shards in the order of their languages, and adds up its own counts before it sends them.
4. Counts are summed over tasks, and only then the thresholds apply, to exact counts.
5. A phrase of k words takes the counts of both sides of its cuts from its first k - 1 and its last k - 1
   words, which have those of theirs; so two rows a phrase move, however many cuts it has.

A task holds one shard or one block, and counts that spill.  No list of candidates of the whole corpus meets anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, by_key, col, scratch, small_batches, table, texts, written

LEAST = 10
LONGEST = 3
TOP = 2000
#: Parts of a language that are ranked by themselves first.
PARTS = 64
#: A part goes where a longer candidate around it has this share, in hundredths, of its occurrences.
INSIDE = 50
SHARD_BYTES = 2 << 20
HELD_BYTES = 64 << 20
#: Shards whose counts are added up before they are shuffled: a phrase goes out once for them all.
SHARDS_A_TASK = 32
#: Cells of a block, as a power of two; blocks grow once the sketch has 1,024 of them.
BLOCK_BITS = (20, 26)

_FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")
_MIX = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def guarded(text: str) -> bytes:
    """The words with one space between them, and a line end as a word between pieces (some of which are empty)."""
    data = text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(b"\n", b" \n ")
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data.strip(b" ")


def cut_at_pieces(data: bytes) -> Iterator[bytes]:
    """Parts of at most a shard, or of one piece where that is longer."""
    at = 0
    while len(data) - at > SHARD_BYTES:
        end = data.rfind(b" \n ", at, at + SHARD_BYTES)
        if end < 0 and (end := data.find(b" \n ", at)) < 0:
            break
        yield data[at:end]
        at = end + 3
    yield data[at:]


def _opened(text: bytes, size: int) -> str:
    """The text of a shard."""
    return pa.decompress(text, size, "zstd", asbytes=True).decode("utf-8", "surrogatepass")


def shards(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(shard, lang, n, size, text): pieces of one language; n is the number of words, text is compressed and has `size` bytes else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, made = TaskContext.get().partitionId(), 0
        held: dict[str, list] = {}  # of each language: bytes, parts

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal made
            made += 1
            text = b" " + b" \n ".join(held.pop(lang)[1]) + b" "
            n = text.count(b" ") - 1 - text.count(b"\n")
            columns = ([(own << 32) + made], pa.int64()), ([lang], pa.string()), ([n], pa.int64()), ([len(text)], pa.int64()), ([pa.compress(text, "zstd", asbytes=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=["shard", "lang", "n", "size", "text"])

        for b in batches:
            for text, lang in zip(texts(b), b.column("lang").to_pylist(), strict=True):
                for part in cut_at_pieces(guarded(text)):
                    if lang in held and held[lang][0] + len(part) > SHARD_BYTES:
                        yield flush(lang)
                    if part.strip(b" \n"):
                        mine = held.setdefault(lang, [0, []])
                        mine[0] += len(part) + 3
                        mine[1].append(part)
            while sum(x[0] for x in held.values()) > HELD_BYTES:
                yield flush(max(held, key=lambda k: held[k][0]))
        for lang in list(held):
            yield flush(lang)

    rows = docs.select(col(text_col).alias("text"), F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    return rows.mapInArrow(run, "shard long, lang string, n long, size long, text binary")


class Phrases:
    """The distinct phrases of a shard: `words`, and for each length the word numbers and counts."""

    def __init__(self, text: str):
        coded = pc.split_pattern(pa.array([text[1:-1]], pa.large_string()), " ").flatten().dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        last, v = coded.indices.to_numpy(), len(self.words)
        word = pc.not_equal(coded.dictionary, "\n").to_numpy(zero_copy_only=False)
        there = word[last]
        at = np.flatnonzero(there)  # where phrases begin
        ids, numbers = last[at].astype(np.int64), np.arange(v, dtype=np.int32)[:, None]
        self.kinds: list[tuple[np.ndarray, np.ndarray]] = [(numbers[word], np.bincount(ids, minlength=v)[word])]
        for k in range(2, LONGEST + 1):  # a phrase is its beginning's number and its last word, so a key never passes 64 bits
            longer = at + k - 1 < len(last)
            longer[longer] = there[at[longer] + k - 1]  # in the same piece
            at, ids = at[longer], ids[longer]
            coded = pa.array(ids * v + last[at + k - 1]).dictionary_encode()
            ids, key = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()
            numbers = np.concatenate([numbers[key // v], (key % v)[:, None].astype(np.int32)], 1)
            self.kinds.append((numbers, np.bincount(ids, minlength=len(key))))

    def cells(self, lang: str, bits: int) -> np.ndarray:
        """The sketch's cell of each phrase, shorter phrases first."""
        import xxhash

        h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.words), np.uint64, len(self.words))
        seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))
        out = []
        for word_ids, _ in self.kinds:
            x = np.full(len(word_ids), seed)
            for k in range(word_ids.shape[1]):
                x = (x ^ h[word_ids[:, k]]) * _MIX[0]
                x = (x ^ (x >> np.uint64(29))) * _MIX[1] + _MIX[2]
            out.append((x ^ (x >> np.uint64(32))) & np.uint64((1 << bits) - 1))
        return np.concatenate(out).astype(np.int64)

    def named(self, chosen: np.ndarray) -> list[list[str]]:
        """The phrases of a mask over all, by length."""
        out, at = [], 0
        for word_ids, _ in self.kinds:
            own = word_ids[chosen[at : at + len(word_ids)]]
            at += len(word_ids)
            out.append([" ".join([self.words[i] for i in row]) for row in own.tolist()])
        return out


def _block_bits(bits: int) -> int:
    return min(bits, max(BLOCK_BITS[0], min(BLOCK_BITS[1], bits - 10)))


def sketch_messages(parts: DataFrame, bits: int) -> DataFrame:
    """(lang, shard, block, size, cells): a shard's cells in one block, ascending, as bytes of their differences, and their counts; compressed."""
    low = _block_bits(bits)

    def sent(lang: str, shard: int, length: int, text: bytes) -> Iterator[tuple]:
        p = Phrases(_opened(text, length))
        cell, at = np.unique(p.cells(lang, bits), return_inverse=True)
        counts = np.minimum(np.bincount(at, np.concatenate([n for _, n in p.kinds]), len(cell)), LEAST).astype(np.uint8)
        edges = np.flatnonzero(np.diff(cell >> low, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(cell)], strict=True):
            steps = np.diff(cell[a:b] & ((1 << low) - 1), prepend=0).astype("<u4")
            yield lang, shard, int(cell[a] >> low), int(b - a), pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes() + counts[a:b].tobytes(), "zstd", asbytes=True)  # the high bytes, mostly zeros, together

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            out = [m for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "shard", "size", "text")), strict=True) for m in sent(*row)]
            return {c: [m[k] for m in out] for k, c in enumerate(("lang", "shard", "block", "size", "cells"))}

        return f

    return arrow_map(parts, "lang string, shard long, block long, size int, cells binary", make)


def sketch_answers(messages: DataFrame, bits: int, least: int) -> DataFrame:
    """(lang, shard, block, size, reached): of each message, one bit a cell, whether the cell's sum over all shards reaches `least`."""
    low = _block_bits(bits)

    def answer(pdf):
        import pandas as pd

        sums = np.zeros(1 << low, np.uint8)
        cells = []
        for data, size in zip(pdf["cells"], pdf["size"], strict=True):
            rows = np.frombuffer(pa.decompress(data, 5 * size, "zstd"), np.uint8).reshape(5, -1)
            own = np.cumsum(rows[:4].T.copy().view("<u4").ravel(), dtype=np.int64)
            sums[own] = np.minimum(sums[own] + rows[4], least)  # a message has each cell once
            cells.append(own)
        return pd.DataFrame({"lang": pdf["lang"], "shard": pdf["shard"], "block": pdf["block"], "size": pdf["size"], "reached": [np.packbits(sums[own] >= least).tobytes() for own in cells]})

    return messages.groupBy("block").applyInPandas(answer, "lang string, shard long, block long, size int, reached binary")


def scanned(parts: DataFrame, answers: DataFrame, bits: int) -> DataFrame:
    """(lang, k, phrase, f): the shards' counts of the phrases whose bound is high enough; k is the number of words.

    A partition has the shards of one language, or of neighbours, so that few counts are left when it has added its own.
    """
    # a shard's text goes before its answers
    rows = parts.select("lang", "shard", F.lit(-1).cast("long").alias("block"), "size", "text").unionByName(answers.select("lang", "shard", "block", F.col("size").cast("long"), F.col("reached").alias("text")))
    met = rows.repartitionByRange(-(-parts.count() // SHARDS_A_TASK) or 1, "lang", "shard").sortWithinPartitions("lang", "shard", "block")

    def counted(lang: str, text: str, got: list[np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
        import ahocorasick

        p = Phrases(text)
        _, at = np.unique(p.cells(lang, bits), return_inverse=True)
        reached = np.concatenate(got).astype(bool)[at]
        words, *longer = p.named(reached)
        own = p.kinds[0][1][reached[: len(p.kinds[0][1])]]  # words are no candidates: their counts are there
        del p, at, reached
        names = [name for named in longer for name in named]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, name in enumerate(names):
            automaton.add_word(f" {name} ", k)
        automaton.make_automaton()
        found = np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int32) if names else np.zeros(0, np.int32)
        sizes = np.repeat(np.arange(1, LONGEST + 1, dtype=np.int32), [len(words), *map(len, longer)])
        return words + names, sizes, np.concatenate([own, np.bincount(found, minlength=len(names))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, list[np.ndarray]]]:
        """Language, text and answers of each shard."""
        lang, text, got = "", None, []
        for b in batches:
            for row in range(b.num_rows):
                own, block, size, data = (b.column(c)[row].as_py() for c in ("lang", "block", "size", "text"))
                if block >= 0:
                    got.append(np.unpackbits(np.frombuffer(data, np.uint8), count=size))
                    continue
                if text is not None:
                    yield lang, text, got
                lang, text, got = own, _opened(data, size), []
        if text is not None:
            yield lang, text, got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in whole(batches):
            names, sizes, counts = counted(*shard)
            for lo in range(0, len(names), 50_000):
                own = slice(lo, lo + 50_000)
                columns = pa.array([shard[0]] * len(names[own]), pa.string()), pa.array(sizes[own], pa.int32()), pa.array(names[own], pa.string()), pa.array(counts[own], pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns), names=["lang", "k", "phrase", "f"])

    return met.mapInArrow(run, "lang string, k int, phrase string, f long")


def phrase_counts(parts: DataFrame, words: int, least: int = LEAST) -> DataFrame:
    """(lang, k, phrase, f): exact counts of all phrases of one to three words that occur at least `least` times in a language."""
    bits = max(10, (LONGEST * words).bit_length())
    answers = written(sketch_answers(sketch_messages(parts, bits), bits, least), "phrase-bounds")
    return scanned(parts, answers, bits).groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _words(phrase: Column, n: int) -> Column:
    """The first n words, or the last ones."""
    return F.substring_index(phrase, " ", n)


def valued(counts: DataFrame) -> Iterator[DataFrame]:
    """(lang, phrase, a, l, r, score) of the candidates of each length; those inside a longer one that is too frequent are gone."""
    below, ends = counts.filter("k = 1").select("lang", F.col("phrase").alias("part"), "f"), []
    for k in range(2, LONGEST + 1):
        own = counts.filter(F.col("k") == k)
        asked = own.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.array(*[F.struct(F.lit(side).alias("side"), _words(F.col("phrase"), n).alias("part")) for side, n in ((0, k - 1), (1, 1 - k))])).alias("e")).select("lang", "phrase", "a", "e.*")
        held = asked.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("held"), F.max("a").alias("around"))
        below = written(below.join(held, ["lang", "part"], "left"), f"phrases-{k - 1}")
        if k > 2:
            yield _scored(below.filter(F.col("around").isNull() | (100 * F.col("around") < INSIDE * F.col("f"))), ends)
        # the first words have the counts of their beginnings, the last words those of their ends
        of = {f"l{j}": (0, f"l{j}") for j in range(1, k - 1)} | {f"l{k - 1}": (0, "f"), "r1": (1, "f")} | {f"r{j}": (1, f"r{j - 1}") for j in range(2, k)}
        met = by_key(asked, below.filter("held > 0").drop("around"), ["lang", "part"], "held")
        both = met.groupBy("lang", F.col("phrase").alias("part")).agg(F.max("a").alias("f"), *[F.max(F.when(F.col("side") == side, F.col(c))).alias(f"new_{out}") for out, (side, c) in of.items()])
        below, ends = both.select("lang", "part", "f", *[F.col(f"new_{c}").alias(c) for c in of]), list(range(1, k))
    yield _scored(below, ends)


def _scored(phrases: DataFrame, cuts: list[int]) -> DataFrame:
    """The worst cut of each phrase."""
    rows = phrases.withColumnsRenamed({"part": "phrase", "f": "a"})
    worst = F.array_min(F.array(*[F.struct(_score(f"l{j}", f"r{j}").alias("score"), F.lit(j).alias("cut"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")) for j in cuts]))
    return rows.withColumn("w", worst).select("lang", "phrase", "a", "w.l", "w.r", "w.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two or three words.

    A null text has no words, a null language is `und`; repeated rows count each time; no id is read.  A
    document may have any length: its pieces are dealt over shards.  A phrase's score is that of its worst
    cut.  An empty table, or one without frequent phrases, gives no rows.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must fit into a byte of the sketch")
    if least != LEAST:
        raise ValueError(f"messages carry counts up to {LEAST} only")
    spark = docs.sparkSession
    with scratch(spark) as keep:  # the shards go once they are counted
        small_batches(spark)
        parts = written(shards(docs, text_col, lang_col), "phrase-shards")
        small_batches(spark, size="4m")
        per_lang = written(parts.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
        words = per_lang.agg(F.sum("n")).head()[0] or 0
        counts = written(phrase_counts(parts, words, least), "phrase-counts")
        keep += [per_lang, counts]
    kept = reduce(DataFrame.unionByName, valued(counts))
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    if top:  # the best of each part of a language first, so that the last ranking gets PARTS * top rows of it at most
        part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked.filter(F.col("rank") <= top) if top else ranked
    return ranked.join(F.broadcast(per_lang) if top else per_lang, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _score(left: str, right: str) -> Column:
    """floor(1,000,000 a a / (l r)) in whole numbers of up to 38 digits; it is 1,000,000 at most."""
    big = lambda c, p: f"CAST({c} AS DECIMAL({p}, 0))"
    return F.expr(f"({big('a', 15)} * {big('a', 15)} * 1000000BD) div ({big(left, 15)} * {big(right, 15)})")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 collocations of each language in all `documents`."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(ps) AS p FROM d)),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, a, j, array_to_string(s[1:j], ' ') AS lp, array_to_string(s[j + 1:], ' ') AS rp FROM c, (VALUES (1), (2)) t(j) WHERE j < k),
v AS (SELECT u.lang, u.phrase, u.a, u.j, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * u.a * u.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM cuts u JOIN f l ON l.lang = u.lang AND l.phrase = u.lp JOIN f r ON r.lang = u.lang AND r.phrase = u.rp),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, phrase, max(f) AS around FROM (SELECT lang, array_to_string(s[j : j + 1], ' ') AS phrase, a AS f FROM c, (VALUES (1), (2)) t(j) WHERE k = 3) GROUP BY ALL),
q AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE o.around IS NULL OR 100 * o.around < 50 * b.a),
m AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
SELECT lang, rank, phrase, a, l, r, n, score FROM m JOIN n USING (lang) WHERE rank <= 2000
"""
