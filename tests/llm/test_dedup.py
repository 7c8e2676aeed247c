import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirewise.llm import exact_dedup, line_dedup
from quirewise.llm.components import components
from quirewise.llm.exact_dedup import exact_dedup as dedup
from quirewise.llm.line_dedup import dedup_lines
from quirewise.llm.ngram_join import Bands, NgramJoin, Sketches, one_of_each_class, shingle_set, signatures, sketch
from quirewise.llm.perfect_hash import PerfectHash
from tests.llm.conftest import EDGES, as_docs, near_copies

SPACE = r"[\x20\x09-\x0D]"


def last(i):
    return (i is None, i or 0)


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(SPACE + "+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=last)
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_exact_dedup(spark, edges, monkeypatch, hot):
    rows = EDGES
    if hot:  # groups of many copies, two of them over several salts, one with a null id; and a very long text
        monkeypatch.setattr(exact_dedup, "SAMPLE", 1.0)
        monkeypatch.setattr(exact_dedup, "GROUP_ROWS", 10)
        monkeypatch.setattr(exact_dedup, "GROUP_SHARE", 1.0)
        copies = [(100 + i if i else None, f"one  text of very many copies{' ' * (i % 3)} end") for i in range(60)]
        rows = EDGES + copies + [(200 + i, "another") for i in range(25)] + [(7, "another"), (300, "x y " * 300_000), (301, "x  y " * 300_000)]
        sampled = as_docs(spark, rows).selectExpr("sha2(regexp_replace(coalesce(text, ''), '\\\\s+', ' '), 256) as digest", "text as norm")
        large, n, _ = exact_dedup.large_groups(sampled)
        assert n == 2 and sorted(r.salts for r in large.collect()) == [3, 6]
    assert sorted(map(tuple, dedup(as_docs(spark, rows)).collect()), key=str) == exact_brute(rows)


def test_beginnings_are_as_long_as_needed(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SAMPLE", 1.0)
    for head, expected in ((0, 32), (40, 256), (5000, 256)):
        rows = as_docs(spark, [(i, "=" * head + f" text {i}") for i in range(100)])
        assert exact_dedup.large_groups(rows.selectExpr("sha2(text, 256) as digest", "text as norm"))[1:] == (0, expected)


def key_of(line):
    k = re.sub(f"^{SPACE}+|{SPACE}+$", "", line)
    return re.sub("[A-Z]", lambda m: m.group().lower(), k)


def lines_brute(rows):
    held = defaultdict(set)
    for i, t in rows:
        for k in map(key_of, (t or "").split("\n")):
            if len(k) >= 10:
                held[k].add(last(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(held.get(key_of(x), ())) > 1 and min(held[key_of(x)]) != last(i))]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


SHARED = [(20 + i, "\n".join(f"shared line number {j}" for j in range(i, i + 5)) + f"\nown line of document {i}") for i in range(60)]


@pytest.mark.parametrize("shard,hot", [(50_000, 1 / 64), (5, 1 / 64), (5, 0.0)])
def test_line_dedup(spark, monkeypatch, shard, hot):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", hot)
    monkeypatch.setattr(line_dedup, "LEAST_HOT", 3)
    # Null ids with texts of their own, the largest id, an id with two texts, and a very long text.
    rows = EDGES + SHARED + [(None, f"shared line number {j}\nnobody else has line {j}") for j in range(9)] + [(2**63 - 1, "a null id has this text of eight words"), (21, "shared line number 0"), (99, "shared line number 3\n" * 50_000)]
    docs = as_docs(spark, rows)
    done = dedup_lines(docs)
    got = done.select("row.doc_id", "n_lines", "n_dropped", "row.text").collect()
    assert sorted(map(tuple, got), key=str) == lines_brute(rows)
    assert done.select("row.*").schema == docs.schema


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    h = PerfectHash.build(keys)
    again, arrays = PerfectHash.from_bytes(h.to_bytes([np.arange(5)]))
    assert sorted(again.slots(keys).tolist()) == list(range(len(keys)))
    assert arrays[0].tolist() == [0, 1, 2, 3, 4]
    assert sum(x.nbytes for x in h.levels) * 8 < 5 * len(keys)
    assert PerfectHash.build(np.zeros(0, np.uint64)).slots(keys[:2]).tolist() == [-1, -1]


def join_brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = [x.lower() if x.isascii() else x for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in w]
        sets.append({tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), (True, 0)), last(i))
    value = lambda x: None if x[0] else x[1]
    return sorted(((i, len(sets[k]), value(least[top(k)]) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("words,percent,seed", [(4, 85, 1), (5, 80, 2)])
def test_ngram_join(spark, words, percent, seed):
    rows = EDGES + [(100 + i, t) for i, t in near_copies(seed)]
    got = NgramJoin(words, percent).run(as_docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == join_brute(rows, words, percent)


@pytest.mark.parametrize("cells,least", [(7, 1), (1 << 16, 3)])
def test_blocks_of_large_buckets(spark, monkeypatch, cells, least):
    from quirewise.llm import ngram_join

    # All cells of signatures are hot, or just those of signatures that several sets share.
    monkeypatch.setattr(ngram_join, "CELLS", cells)
    monkeypatch.setattr(ngram_join, "LEAST_HOT", least)
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 0)
    monkeypatch.setattr(ngram_join, "LEAST_BITS", 4)
    monkeypatch.setattr(ngram_join, "PAIRS", 20)
    monkeypatch.setattr(ngram_join, "WORDS", 30)
    monkeypatch.setattr(ngram_join, "ROWS", 10)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "PER_LEADER", 3)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rows = near_copies(3, groups=2, copies=25)
    got = NgramJoin(4, 85).run(as_docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == join_brute(rows, 4, 85)


def test_a_bucket_of_copies_and_a_stranger_takes_few_comparisons(spark, monkeypatch):
    """10,000 sets of one class meet one other set: as many pairs are looked at, not half their square."""
    from quirewise.llm import ngram_join

    nodes = spark.range(10_001).select(F.col("id").alias("node"), F.lit(300).cast("long").alias("n"), F.lit(bytes(64)).alias("sketch"))
    buckets = spark.range(10_001).select(F.lit(1).cast("long").alias("sig"), F.col("id").alias("node"))
    labels = spark.range(1, 10_000).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("root"))
    for closest, found in ((True, 5), (False, 10_000)):  # one for each block of copies
        got = NgramJoin(5, 80).across(buckets, labels, nodes, closest).collect()
        assert len(got) == found and {r.a for r in got} == {10_000} and [r.sig for r in got][:1] == ([1] if closest else [None])
    looked = []
    monkeypatch.setattr(ngram_join.Sketches, "least_difference", lambda self, p, q: looked.append(len(p)) or np.zeros(len(p), np.int64))
    part = np.arange(10_001) // ngram_join.BLOCK
    last = part == part[-1]
    whole = {"sig": 1, "i": 0, "j": int(part[-1]), "n": 300}
    own = np.flatnonzero((part == 0) | last)
    table = pa.table({k: np.full(len(own), v, np.int64) for k, v in whole.items()} | {"part": part[own], "node": own, "root": np.where(own == 10_000, 10_000, 0), "sketch": [bytes(64)] * len(own)})
    ngram_join._candidates(table, 80, False)
    assert sum(looked) == ngram_join.BLOCK


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(1500):
        n = int(rng.choice([1, 2, 3, 5, 8, 12, 20, 33, 60, 150, 400, 700, 3000]))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        cut, more = rng.integers(0, n // 5 + 1), rng.integers(0, n // 5 + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[cut:], rng.integers(0, 2**64, more, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        other = np.unique(rng.integers(0, 2**64, 2000, dtype=np.uint64))
        least = Sketches([sketch(a), sketch(b), sketch(other)]).least_difference(np.array([0, 0]), np.array([1, 2]))
        assert least[0] <= len(a) + len(b) - 2 * common and least[1] <= len(a) + len(other)
        if len(b) and 100 * common >= percent * (len(a) + len(b) - common):
            bands = Bands(percent)
            assert np.intersect1d(signatures(a, bands), signatures(b, bands)).size


def test_very_long_texts_link(spark):
    words = [f"w{k}" for k in range(120_000)]
    near = [*words[:60_000], "changed", *words[60_001:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:90_000])), (4, "w1 " * 200_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in NgramJoin(4, 85).run(as_docs(spark, rows)).collect()}
    assert got == {1: (119_997, 1), 2: (119_997, 1), 3: (89_997, 3), 4: (1, 4)}


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (70, 70)] + [(100, 200 + i) for i in range(30)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(2, 41)} | {60: 50} | {200 + i: 100 for i in range(30)}


def test_kept_documents(spark):
    rows = near_copies(4)
    docs = as_docs(spark, rows)
    kept = one_of_each_class(docs, 5, 80)
    expected = {i for i, _, c in join_brute(rows, 5, 80) if i == c}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == expected


def test_kept_documents_of_repeated_ids(spark):
    """One row of a class stays for each id, and each text of an id that is a class of its own."""
    text, near, other = (" ".join(f"{w}{k}" for k in range(60)) for w in ("a", "a", "b"))
    near = near.replace("a59", "z")
    rows = [(1, text), (1, text), (1, other), (2, other), (3, near), (None, text), (4, None), (4, ""), (None, "c " * 9), (None, "c " * 9)]
    got = sorted(((r.doc_id, r.text) for r in one_of_each_class(as_docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, text), (1, other), (4, None), (4, ""), (None, "c " * 9)], key=str)


def test_empty_tables(spark, nothing):
    assert dedup(nothing).count() == 0
    assert dedup_lines(nothing).count() == 0
    assert NgramJoin(4, 85).run(nothing).count() == 0
    assert one_of_each_class(nothing).count() == 0


def test_shingles_of_few_words():
    assert len(shingle_set("one two", 4)) == 1 and len(shingle_set("", 4)) == 0
    assert shingle_set("ONE two", 4).tolist() == shingle_set("one\ttwo ", 4).tolist() != shingle_set("two one", 4).tolist()
