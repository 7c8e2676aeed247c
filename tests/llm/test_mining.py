"""Language identification, vector codes and collocations against brute force, with edges of their input."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirewise.llm import collocations, language_id, vector_codes
from tests.llm.conftest import as_docs

# --- vector codes


def lloyd(rows, parts, entries, rounds):
    """(codes, errors, books) of (id, vector) rows in the order of ids, one by one."""
    vectors = [[math.floor(256 * x) for x in v] for _, v in rows]
    width = len(vectors[0]) // parts
    cut = lambda v, i: tuple(v[i * width : (i + 1) * width])
    books = [[cut(v, i) for v in vectors[:entries]] for i in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, i: min(range(len(books[i])), key=lambda e: (far(cut(v, i), books[i][e]), e))
    for _ in range(rounds):
        for i in range(parts):
            of = defaultdict(list)
            for v in vectors:
                of[near(v, i)].append(cut(v, i))
            books[i] = [tuple(sum(x) // len(x) for x in zip(*of[e], strict=True)) if e in of else old for e, old in enumerate(books[i])]
    codes = [[near(v, i) for i in range(parts)] for v in vectors]
    errors = [sum(far(cut(v, i), books[i][c[i]]) for i in range(parts)) for v, c in zip(vectors, codes, strict=True)]
    return codes, errors, books


@pytest.mark.parametrize("n", [1, 3, 17, 64, 65, 700])
def test_forest_against_all_distances(n):
    rng = np.random.default_rng(n)
    vectors = rng.integers(-6, 6, (n, 32)) * rng.integers(1, 40, (n, 1))  # ties and copies
    vectors[n // 2 :: 3] = vectors[0]
    books = rng.integers(-60, 60, (16, 64, 2))
    books[:, 40:] = books[:, :24]  # equal entries: the lower index counts
    forest = vector_codes.Forest.from_bytes(vector_codes.Forest.build(vectors, 16).to_bytes(), 16, 2)
    far = ((vectors.reshape(n, 16, 1, 2) - books[None]) ** 2).sum(3)
    codes, errors = forest.codes(books)
    assert (codes == far.argmin(2)).all()
    assert (errors == far.min(2).sum(1)).all()
    counts, sums = forest.totals(books)
    for part in range(16):
        own = np.bincount(codes[:, part], minlength=64)
        assert (counts[part * 64 : (part + 1) * 64] == own).all()
    assert (sums.reshape(16, 64, 2).sum(1) == vectors.reshape(n, 16, 2).sum(0)).all()


def test_trees_assign_nodes_as_a_whole():
    rng = np.random.default_rng(1)
    vectors = np.repeat(rng.integers(-500, 500, (20, 32)), 100, 0) + rng.integers(-2, 3, (2000, 32))
    (first, end, _, _), (point, _) = vector_codes.Forest.build(vectors, 16).filter(vectors[:1000:100].reshape(10, 16, 2).transpose(1, 0, 2))
    assert (end - first).sum() + len(point) == 16 * 2000
    assert len(point) < 8000


def as_vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, 2.5) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, slot string, n int, error double")


def test_codes_against_brute_force_with_edges(spark):
    rng, nan, inf = random.Random(2), float("nan"), float("inf")
    good = [(i, [rng.choice((-0.5, -0.01, 0.0, 0.013, 0.4, 1.7)) * rng.randrange(1, 5) for _ in range(32)], rng.choice((1, 2, None))) for i in range(150)]
    good += [(7, good[7][1], 5), (7, good[7][1], 5)]  # a repeated row
    bad = [(900, None, 1), (901, [], 1), (902, [None, *[0.1] * 31], 1), (903, [nan, *[0.1] * 31], 1), (904, [inf, *[0.1] * 31], 1), (905, [0.1] * 16, 2)]
    last = [(None, [0.25] * 32, None)]
    done, books = vector_codes.encode(as_vectors(spark, bad + good + last).repartition(3))
    rows = sorted(good, key=lambda r: r[0]) + last
    codes, errors, expected = lloyd([(i, np.float32(v).tolist()) for i, v, _ in rows], 16, 64, 2)
    assert [[tuple(e) for e in b] for b in books.tolist()] == expected
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, done.select("vec_id", "label", "code", "error").collect()), key=key) == sorted([(i, lab, bytes(c).hex(), e) for (i, _, lab), c, e in zip(rows, codes, errors, strict=True)], key=key)


def test_codes_of_few_or_no_vectors(spark):
    done, books = vector_codes.encode(as_vectors(spark, [(3, [float(k) for k in range(16)], None)]))
    assert books.shape == (16, 1, 1)
    assert [tuple(r) for r in done.collect()] == [(3, None, "00" * 16, 0)]
    for rows in ([], [(1, None, 2)], [(1, [float("nan")] * 16, 2)]):
        done, _ = vector_codes.encode(as_vectors(spark, rows))
        assert done.columns == ["vec_id", "label", "code", "error"]
        assert done.count() == 0


def test_label_errors_of_hot_labels(spark, tmp_path):
    rows = [(i, [float(i % 7), *[0.0] * 15], 1 if i % 3 else (None if i % 2 else i)) for i in range(3000)]
    as_vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op12_vector_codes(spark, str(tmp_path)).collect()
    label, sums = {i: lab for i, _, lab in rows}, Counter()
    for r in got:
        sums[label[r["vec_id"]]] += r["error"]
    assert len(got) == 3000
    assert all(r["label_error"] == sums[label[r["vec_id"]]] for r in got)


# --- collocations


def mined(docs, least=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) by counting every phrase."""
    counts, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = tuple(re.findall("[^ \t]+", piece))
            total[lang or "und"] += len(words)
            for k in (1, 2, 3):
                counts[lang or "und"].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if any(100 * b >= 50 * a for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def phrase_docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, "p", 3, 1) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int, shard long")


def test_collocations_against_brute_force_with_edges(spark):
    rng = random.Random(3)
    common = ["the", "of", "a", "é", "日本", "\U0001f600", "x\x00y", "\xa0", "Ü"]
    rows = [(" ".join(rng.choice(common) + rng.choice(("", "", "", ".", ",", "\t", "\n", " \n ", "!?")) for _ in range(rng.randrange(60))), rng.choice(("en", "de", None, "und"))) for _ in range(120)]
    rows += [("The the the the the the the the the the the the the the the", "aa")]  # overlaps
    rows += [("new york city. " * 12 + "new york times. " * 11 + "york, city " * 3, "en")] * 2
    rows += [(None, "en"), ("", "en"), (" \t\n", None), (None, None), ("a b", "one")] + [("tie one. tie two. one tie. " * 10, "ties")]
    done = collocations.collocations(phrase_docs(spark, rows).repartition(3))
    assert sorted(map(tuple, done.collect())) == mined(rows)


def test_collocations_keep_the_first_only_and_have_no_rows_of_nothing(spark, nothing):
    rows = [(". ".join(f"w{k} v{k}" for k in range(40) for _ in range(10 + k % 3)), "en")]
    docs = phrase_docs(spark, rows)
    assert sorted(map(tuple, collocations.collocations(docs, top=7).collect())) == mined(rows, top=7)
    assert collocations.collocations(nothing).count() == 0
    assert collocations.collocations(phrase_docs(spark, [("all words differ here", "en")])).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_of_a_text_longer_than_a_shard(spark):
    rng = random.Random(4)
    long = " ".join(f"{rng.choice(('alpha', 'beta', 'gamma'))}{rng.randrange(9)}{rng.choice(('', '', ';'))}" for _ in range(900_000))
    assert len(long) > collocations.SHARD_BYTES
    rows = [(long, "en"), ("beta1 beta1 beta1 " * 10, "en")]
    assert sorted(map(tuple, collocations.collocations(phrase_docs(spark, rows)).collect())) == mined(rows)


def test_a_bound_is_never_below_the_count(spark):
    """A sketch of so few cells that all collide loses nothing."""
    rows = [("a b c. " * 9, "en"), ("a b d", "en")]
    parts = collocations.shards(phrase_docs(spark, rows).repartition(2), "text", "lang").cache()
    for words in (1, 1000):
        counts = {(r["k"], r["phrase"]): r["f"] for r in collocations.phrase_counts(parts, words).collect()}
        assert counts == {(1, "a"): 10, (1, "b"): 10, (2, "a b"): 10}


def test_counts_are_added_up_before_they_are_sent(spark, request):
    """A phrase leaves a task once for all shards of its language there; texts move compressed."""
    rows = [("alpha beta gamma. " * 20, lang) for lang in ("en", "de") for _ in range(8)]
    parts = collocations.shards(phrase_docs(spark, rows).repartition(8), "text", "lang").cache()
    assert parts.count() >= 8
    assert parts.filter(F.length("text") > F.col("n")).count() == 0
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart, as large ones do
    answers = collocations.sketch_answers(collocations.sketch_messages(parts, 10), 10, 10)
    sent = collocations.scanned(parts, answers, 10).select("lang", "phrase", F.spark_partition_id()).distinct()
    assert sent.count() == 2 * len(("alpha", "beta", "gamma", "alpha beta", "beta gamma", "alpha beta gamma"))


# --- language identification


def speech(rng, lang, n):
    ends = {"aa": ("anu", "olo", "iri"), "bb": ("eth", "ost", "und"), "cc": ("zk", "řq", "żw")}[lang]
    return " ".join("".join(rng.choice("ptkmns") + rng.choice(ends) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def lang_docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "w", 1, 2) for i, t, lang in rows], "doc_id long, text string, lang string, word string, size int, n int")


def test_held_out_texts_are_recognised(spark):
    rng = random.Random(5)
    rows = [(i, speech(rng, lang, rng.randrange(5, 60)), lang) for i, lang in enumerate(rng.choices(("aa", "bb", "cc"), (90, 9, 1), k=900))]
    docs = lang_docs(spark, rows)
    model = language_id.fit(docs, ~language_id.is_held_out())
    got = {r["doc_id"]: r for r in language_id.predicted(docs, model).join(docs.select("doc_id", language_id.is_held_out().alias("held_out")), "doc_id").collect()}
    held = [(i, lang) for i, _, lang in rows if got[i]["held_out"]]
    assert len(held) > 150
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def plain_prediction(train, text, kept):
    """The rule word by word, with plain dictionaries: kept(lang, size, n) says whether an entry is in the model."""
    counts = defaultdict(Counter)
    for t, lang in train:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            counts[lang, 0][w] += 1
            marked = f" {w} "
            for n in range(1, 5):
                for k in range(len(marked) - n + 1):
                    if marked[k : k + n] != " ":
                        counts[lang, n][marked[k : k + n]] += 1
    langs = sorted({lang for _, lang in train})
    docs = Counter(lang for _, lang in train)
    total = lambda lang, size: sum(counts[lang, size].values())
    floor = lambda size: 0.5 / max(1, *(total(x, size) for x in langs))
    log_of = lambda lang, size, e: math.log((counts[lang, size][e] / total(lang, size) if e and kept(lang, size, counts[lang, size][e]) else 0) + floor(size))
    known = lambda size, e: any(counts[x, size][e] and kept(x, size, counts[x, size][e]) for x in langs)
    sums = {x: math.log(docs[x] / len(train)) for x in langs}
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if known(0, w):
            for x in langs:
                sums[x] += log_of(x, 0, w)
            continue
        marked, parts = f" {w} ", []
        for k in range(len(marked) - 1):
            sizes = [n for n in range(min(4, len(marked) - k), 0, -1) if known(n, marked[k : k + n])]
            if sizes:
                parts.append((sizes[0], marked[k : k + sizes[0]]))
            elif marked[k] != " ":
                parts.append((1, None))
        for x in langs:
            sums[x] += sum(log_of(x, n, e) for n, e in parts) / len(parts)
    best = max(langs, key=lambda x: sums[x])
    return best, 1 / sum(math.exp(v - sums[best]) for v in sums.values())


def test_predictions_against_the_plain_rule(spark):
    rng = random.Random(6)
    rows = [(4 * i, speech(rng, lang, rng.randrange(1, 9)), lang) for i, lang in enumerate(rng.choices(("aa", "bb", "cc"), k=60))]
    texts = [speech(rng, "aa", 2) + " " + speech(rng, "bb", 2) for _ in range(20)] + ["日本語", "Öl", "q", "PANU panu ßx", "a1b2_c", "panu" * 50]
    docs = lang_docs(spark, rows)
    model = language_id.fit(docs, F.lit(True))
    asked = lang_docs(spark, [(i, t, None) for i, t in enumerate(texts)])
    for r in language_id.predicted(asked, model).collect():
        best, chance = plain_prediction([(t, lang) for _, t, lang in rows], texts[r["doc_id"]], lambda *_: True)
        assert r["lang_pred"] == best
        assert r["score"] == pytest.approx(chance)


def test_languages_edges(spark, edges, nothing, tmp_path):
    docs = lang_docs(spark, [(1, None, "aa"), (2, "", "aa"), (3, "12 !? ²½", "aa"), (4, "panu", None), (5, "panu olo", "aa"), (5, "panu olo", "aa"), (None, "mund und", "bb"), (6, "panu " * 400_000, "aa"), (7, "x", "bb")])
    model = language_id.fit(docs, F.lit(True))
    got = language_id.predicted(docs, model).collect()
    assert model.names == ["aa", "bb"]
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got) == sorted([("1", "und"), ("2", "und"), ("3", "und"), ("4", "aa"), ("5", "aa"), ("5", "aa"), ("None", "bb"), ("6", "aa"), ("7", "bb")])
    assert {r["score"] for r in got if r["lang_pred"] == "und"} == {0.0}
    untaught = language_id.fit(nothing, F.lit(True))
    assert {(r["lang_pred"], r["score"]) for r in language_id.predicted(docs, untaught).collect()} == {("und", 0.0)}
    assert language_id.predicted(nothing, model).count() == 0
    assert language_id.predicted(edges, model).count() == edges.count()
    as_docs(spark, [(i, f"panu olo {i}") for i in range(20)] + [(None, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    result = language_id.op11_language_id(spark, str(tmp_path))
    assert result.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert {r["lang_pred"] for r in result.collect() if r["doc_id"] is not None} == {"en"}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in result.collect() if r["doc_id"] is not None)


def test_a_small_model_backs_off_more_often(spark):
    rng = random.Random(7)
    docs = lang_docs(spark, [(i, speech(rng, "aa", 30), "aa") for i in range(30)])
    small, whole = language_id.fit(docs, F.lit(True), entries=100), language_id.fit(docs, F.lit(True))
    assert len(small.words) <= 20 < len(whole.words)
    assert 0 < len(small.grams) <= 80
