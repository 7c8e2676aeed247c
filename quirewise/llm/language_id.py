"""Language identification: words first, then ever shorter character n-grams.

1. From labelled documents Spark counts words, and character n-grams of these words (one to `LONGEST`
   characters, with marks at both ends), per language.
2. The model keeps the most frequent ones of each language and length, at most `ENTRIES` altogether, with
   their log frequency in each language that has them; what a language lacks has a floor, the same for
   all languages, so that those with few texts don't gain by what they lack.
3. A known word adds its log frequencies.  An unseen one is read from left to right, at each place by the
   longest n-gram that is known; it adds their mean, so a word counts as a word however it is scored.
4. The sums over all words of a text, with the languages' shares as a prior, give the prediction; its
   probability among the learned languages is the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, col, small_batches, table, texts, written

#: Documents that the model is fitted on: about so many, the languages having equal shares as far as they go.
FIT_DOCUMENTS = 20_000
#: Languages that are learnt, those with the most labelled documents.
LANGUAGES = 10_000
#: Entries of the model, over all languages and lengths.
ENTRIES = 400_000
LONGEST = 4
UNKNOWN = "und"
#: Occurrences that an entry counts as in a language that lacks it, were it as large as the largest.
FLOOR = 0.5
#: Words of a task that are scored at once, and cells of the table of their scores.
CHUNK_WORDS = 500_000
CHUNK_CELLS = 4_000_000

_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall(text.lower())


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def grams_of(word: str) -> Iterator[str]:
    """All n-grams of a word with marks at both ends; marks alone are none."""
    marked = f" {word} "
    for n in range(1, LONGEST + 1):
        for k in range(len(marked) - n + 1):
            if (gram := marked[k : k + n]) != " ":
                yield gram


def fitted_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learns: Column, documents: int) -> DataFrame:
    """(text, lang): of each language a share of its labelled documents by a hash of the row, all where they are few."""
    rows = docs.filter(learns & col(text_col).isNotNull() & col(lang_col).isNotNull()).select(
        col(text_col).alias("text"), col(lang_col).cast("string").alias("lang"), F.xxhash64(col(id_col), col(text_col)).alias("h"),
    )
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    quota = documents / F.greatest(F.lit(1), sizes.agg(F.count(F.lit(1))).scalar())
    shares = sizes.select("lang", (quota / F.col("n")).alias("share"))
    return rows.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("text", "lang")


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n)."""

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            found: dict[str, Counter] = {}
            for t, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_of(t))
            out = [(lang, w, n) for lang, own in found.items() for w, n in own.items()]
            return {"lang": [x[0] for x in out], "word": [x[1] for x in out], "n": [x[2] for x in out]}

        return f

    return arrow_map(rows, "lang string, word string, n long", make).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, size, entry, n): n-grams by their size, words with size 0."""

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            found: dict[tuple, int] = {}
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                for gram in grams_of(word):
                    found[lang, gram] = found.get((lang, gram), 0) + n
            return {"lang": [k[0] for k in found], "size": [len(k[1]) for k in found], "entry": [k[1] for k in found], "n": list(found.values())}

        return f

    grams = arrow_map(words, "lang string, size int, entry string, n long", make).groupBy("lang", "size", "entry").agg(F.sum("n").alias("n"))
    return words.select("lang", F.lit(0).alias("size"), F.col("word").alias("entry"), "n").unionByName(grams)


class Model:
    """The languages, their priors, and for each word and n-gram the languages that have it.

    Entry e has the numbers [at[e], at[e + 1]) of `langs` and `gains`; a gain is the log frequency over the floor.
    """

    def __init__(self, documents: dict[str, int], totals: dict[tuple[str, int], int], rows: list[tuple]):
        """totals: occurrences by language and size; rows: (entry, size, language, n)."""
        self.names = sorted(documents)
        number = {name: k for k, name in enumerate(self.names)}
        docs = np.array([documents[x] for x in self.names], float)
        self.prior = np.log(docs / docs.sum()) if len(docs) else docs
        floors = [FLOOR / max([1, *(n for (_, own), n in totals.items() if own == size)]) for size in range(LONGEST + 1)]
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        at, langs, gains, last = [], [], [], None
        for entry, size, lang, n in sorted(rows):
            if (entry, size) != last:
                own = self.grams if size else self.words
                own[entry], last = len(at), (entry, size)
                at.append(len(langs))
            langs.append(number[lang])
            gains.append(np.log1p(n / totals[lang, size] / floors[size]))
        self.at, self.langs, self.gains = np.array([*at, len(langs)]), np.array(langs, np.int64), np.array(gains, np.float64)

    def backed_off(self, word: str) -> list[int]:
        """Of each place in an unseen word the longest known n-gram; -1 where none is."""
        marked, out, known = f" {word} ", [], self.grams
        for k in range(len(marked) - 1):
            for n in range(min(LONGEST, len(marked) - k), 0, -1):
                if (e := known.get(marked[k : k + n])) is not None:
                    out.append(e)
                    break
            else:
                if marked[k] != " ":
                    out.append(-1)
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): what each word adds."""
        word, entry, weight = [], [], []
        for k, w in enumerate(words):
            parts = self.backed_off(w) if (e := self.words.get(w)) is None else [e]
            word += [k] * len(parts)
            entry += parts
            weight += [1 / len(parts)] * len(parts)
        word, entry, weight = np.array(word, np.int64), np.array(entry, np.int64), np.array(weight)
        known = entry >= 0
        word, entry, weight = word[known], entry[known], weight[known]
        n = self.at[entry + 1] - self.at[entry]
        each = np.repeat(self.at[entry] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else n
        slot = np.repeat(word, n) * len(self.names) + self.langs[each]
        return np.bincount(slot, np.repeat(weight, n) * self.gains[each], len(words) * len(self.names)).reshape(len(words), -1)

    def predict(self, batch: list[str | None]) -> tuple[list[str], list[float]]:
        """Of each text the language and its probability; UNKNOWN and 0 without letters."""
        sums, held, docs = np.tile(self.prior, (len(batch), 1)), [], []
        room = max(1, min(CHUNK_WORDS, CHUNK_CELLS // max(1, len(self.names))))

        def add() -> None:
            coded = pa.array(held, pa.string()).dictionary_encode()
            ids, of = coded.indices.to_numpy(), np.array(docs)
            own = self.scores(coded.dictionary.to_pylist())
            for k in range(len(self.names)):
                sums[:, k] += np.bincount(of, own[ids, k], len(batch))

        lettered = np.zeros(len(batch), bool)
        for k, t in enumerate(batch):
            lettered[k] = bool(t) and has_letter(t)
            if not lettered[k]:
                continue
            found = words_of(t)
            for lo in range(0, len(found), room):
                part = found[lo : lo + room]
                held += part
                docs += [k] * len(part)
                if len(held) >= room:
                    add()
                    held, docs = [], []
        if held:
            add()
        if not self.names:
            return [UNKNOWN] * len(batch), [0.0] * len(batch)
        best = sums.argmax(1)
        chance = 1 / np.exp(sums - sums[np.arange(len(best)), best][:, None]).sum(1)
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, chance, 0.0).tolist()


def fit(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = FIT_DOCUMENTS, entries: int = ENTRIES) -> Model:
    """The model of the labelled rows for which `learns` holds.

    About `documents` of them are read, chosen by a hash within each language.  Per language and size the
    entries with a count of at least some number are kept, such that they are no more than an equal part
    of `entries`; rarer words are unseen words to the model.
    """
    rows = fitted_rows(docs, id_col, text_col, lang_col, learns, documents)
    words = written(word_counts(rows), "language-words")
    counts = written(gram_counts(words), "language-entries")
    shape = counts.groupBy("lang", "size", "n").agg(F.count(F.lit(1)).alias("kinds"))
    sizes = dict(rows.groupBy("lang").agg(F.count(F.lit(1))).toArrow().to_pandas().itertuples(index=False))
    room = max(1, entries // max(1, len(sizes) * (LONGEST + 1)))
    # The histogram of counts: one row for each different count, which are few among so many documents.
    totals: dict[tuple[str, int], int] = {}
    kinds: dict[tuple[str, int], int] = {}
    least: dict[tuple[str, int], int] = {}
    for r in sorted(shape.collect(), key=lambda r: (r["lang"], r["size"], -r["n"])):
        key = r["lang"], r["size"]
        totals[key] = totals.get(key, 0) + r["n"] * r["kinds"]
        kinds[key] = kinds.get(key, 0) + r["kinds"]
        if kinds[key] <= room:
            least[key] = r["n"]
    spark = docs.sparkSession
    cut = spark.createDataFrame([(lang, size, n) for (lang, size), n in least.items()], "lang string, size int, least long")
    kept = counts.join(F.broadcast(cut), ["lang", "size"]).filter(F.col("n") >= F.col("least")).select("entry", "size", "lang", "n")
    return Model(sizes, totals, list(kept.toArrow().to_pandas().itertuples(index=False, name=None)))


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row.

    A null text, or one without letters, is `und` with score 0; so is every text where nothing could be learnt.
    Rows that repeat an id are predicted one by one; a text of any length is read whole, in parts of bounded size.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def f(batch: pa.RecordBatch) -> dict:
            lang, score = own.predict(batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "lang_pred": lang, "score": score}

        return f

    small_batches(spark)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return arrow_map(rows, "doc_id long, lang_pred string, score double", make)


def is_held_out(id_col: str = "doc_id") -> Column:
    """A null id counts as an empty one."""
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a quarter is held out from the fit."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~is_held_out())
    return predicted(docs, model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
