import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quirewise.llm import mixing, packing, pseudo_likelihood, quotation, window_network
from quirewise.llm.ranks import running_before
from tests.llm.conftest import EDGES, as_docs, near_copies, prose

ROWS = EDGES + [(100 + i, prose(random.Random(i), i * 7 % 90)) for i in range(60)]


def test_running_sums_over_buckets(spark):
    from pyspark.sql import functions as F

    rows = [(i % 3, f"{(i * 7919) % 4096:03x}", i % 11) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, key string, n int")
    got = running_before(df, "g", "key", 2, F.col("n"), ["n"], "at").collect()
    for r in got:
        before = [n for g, k, n in rows if g == r.g and (k, n) < (r.key, r.n)]
        assert r.at == sum(before)


def targets_by_steps(sizes):
    """The contract's targets, one round of resharing after another."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i][0] is None, sizes[i][0] or ""))
    weight = {i: (5, 2, 1)[k % 3] for k, i in enumerate(order)}
    free, left, want = {*weight}, 1.5 * sum(s for _, s in sizes), {}
    while free:
        share = left / sum(weight[i] for i in free)
        over = {i for i in free if share * weight[i] > 2 * sizes[i][1]}
        if not over:
            want |= {i: share * weight[i] for i in free}
            break
        want |= {i: 2.0 * sizes[i][1] for i in over}
        left -= sum(2 * sizes[i][1] for i in over)
        free -= over
    return [want[i] for i in range(len(sizes))]


MANY = [(f"s{k % 997}", k * k % 5003) for k in range(997)]


@pytest.mark.parametrize("sizes", [[("a", 100), ("b", 100), ("c", 100)], [("a", 10), ("b", 1000), (None, 5)], [("a", 0), ("b", 0)], [("z", 7)], [("d", 1), ("c", 900), ("b", 30), ("a", 40)], [], MANY])
def test_targets(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate(sizes)], "doc_id long, source string, size long")).collect()
    assert {r.source: r.target for r in got} == pytest.approx(dict(zip([s for s, _ in sizes], targets_by_steps(sizes), strict=True)))
    assert sorted(r.source_no for r in got) == list(range(len(sizes)))
    upto = 0
    for r in sorted(got, key=lambda r: r.source_no):
        assert (r.quota, r.before) == (math.ceil(math.floor(r.target) / mixing.BLOCK), upto)
        upto += r.quota


def slots_by_steps(quota):
    """(slot, source, rank), one point after another, in whole numbers."""
    blocks, out, rank = sum(quota), [], Counter()
    for i in range(3 * blocks + 64 if blocks else 0):
        x, upto = i * mixing.GOLDEN % 2**64, 0
        for s, q in enumerate(quota):
            if upto * 2**64 <= x * blocks < (upto + q) * 2**64:
                if rank[s] < q:
                    out.append((i, s, rank[s]))
                rank[s] += 1
            upto += q
    return out


@pytest.mark.parametrize("quota", [[50, 1, 0, 120, 7], [0], [1], [1] * 30 + [400] + [2] * 30])
def test_schedule(spark, monkeypatch, quota):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    sources = spark.createDataFrame([(k, n, sum(quota[:k])) for k, n in enumerate(quota)], "source_no long, quota long, before long")
    rows = sorted(map(tuple, mixing.schedule(sources).collect()))
    assert rows == slots_by_steps(quota)
    assert Counter(s for _, s, _ in rows) == Counter({k: n for k, n in enumerate(quota) if n})
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.schedule(sources).collect())) == rows


def test_points_far_out_are_exact():
    first = 6 * 10**10
    got = mixing.points(first, 1000)
    assert got.tolist() == [(first + k) * mixing.GOLDEN % 2**64 for k in range(1000)]
    # An interval of one in a million gets its share there, too.
    hits = sum(int((mixing.points(first + k * 10**6, 10**6) < np.uint64(2**64 // 10**6)).sum()) for k in range(8))
    assert 7 <= hits <= 10


def test_a_block_without_a_slot_is_an_error(spark):
    with pytest.raises(RuntimeError, match="slots for"):
        mixing.schedule(spark.createDataFrame([(0, 5, 0), (1, 5, 0)], "source_no long, quota long, before long"))


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_mix(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    docs = as_docs(spark, ROWS)
    pieces, streams = mixing.mix(docs)
    places, pieces = streams.collect(), pieces.collect()
    assert len(places) == len(ROWS)
    taken = Counter()
    for p in pieces:
        taken[p.source_no, p.at] += p.length
    by_source = defaultdict(int)
    for r in places:
        t = taken[r.source_no, r.at] if r["size"] else 0
        assert t <= 2 * r["size"]
        by_source[r.source_no, r.target] += t
    assert all(n == math.floor(t) for (_, t), n in by_source.items())
    # Each piece stands in the slot of its block, and no slot holds more than a block.
    quota = [math.ceil(math.floor(t) / 16) for _, t in sorted(by_source)]
    slots = {(s, r): i for i, s, r in slots_by_steps(quota)}
    size = {(r.source_no, r.at): r.source_size for r in places}
    assert all(p.slot == slots[p.source_no, (p.at + p.epoch * size[p.source_no, p.at] + p.start) // 16] for p in pieces)
    held = Counter()
    for p in pieces:
        held[p.slot] += p.length
    assert max(held.values()) <= 16
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len((r.text or "").encode().split()) for r in out.collect()) == sum(by_source.values())


def test_mix_of_a_very_long_text(spark):
    """One text of many blocks beside short ones of its source, and of others."""
    sizes = {0: 300_000, **dict.fromkeys(range(1, 10), 20)}
    docs = as_docs(spark, [(i, "some words in a row " * (n // 5)) for i, n in sizes.items()])
    pieces, streams = mixing.mix(docs)
    taken = Counter()
    for p in pieces.collect():
        taken[p.doc_id] += p.length
    targets = {r.source_no: math.floor(r.target) for r in streams.collect()}
    assert all(n <= 2 * sizes[i] for i, n in taken.items()) and taken[0] >= 300_000
    assert sum(taken.values()) == sum(targets.values())


def test_mixed_documents_come_in_the_order_of_the_slots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    docs = as_docs(spark, [(i, prose(random.Random(i), 5 + i % 50)) for i in range(120)])
    first = {}
    for p in mixing.mix(docs)[0].collect():
        k = p.doc_id, p.epoch
        first[k] = min(first.get(k, p.slot), p.slot)
    got = [r.doc_id for r in mixing.mixed_documents(docs).collect()]
    seen, order = Counter(), []
    for d in got:
        order.append(first[d, seen[d]])
        seen[d] += 1
    assert order == sorted(order) and len(got) == len(first) and max(seen.values()) == 2


@pytest.mark.parametrize("name,known", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_the_tokenizer(name, known):
    """By its own rules where the file says the same, else by the tokenizer as a whole."""
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path(name), cache=50)
    assert e.known == known
    rng = random.Random(6)
    texts = [t or "" for _, t in EDGES] + ["a<|endoftext|>b I'M it's'T İstanbul ΑΣ ﬁ café café 12½²³ \u0085 ŉa ſtraße ­x", *("".join(rng.choices("abcÀéß'’.,! \n19<|>́Σ日", k=60)) for _ in range(300))]
    for t in texts:
        assert e.encode(t) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def check_packing(pieces, size):
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return by_sequence


@pytest.mark.parametrize("size", [16, 2048])
def test_packing_round_trip(spark, size):
    docs = as_docs(spark, ROWS)
    out = packing.pack(docs, size=size, keep_ids=True).collect()
    check_packing(out, size)
    e = packing.Encoder(packing.default_tokenizer())
    want = Counter((i, e.encode(t or "") + np.array([1], "<u4").tobytes()) for i, t in ROWS)
    copies = defaultdict(list)
    for p in out:
        ids = np.array(p.ids, "<u4").tobytes()
        assert zlib.crc32(ids) == p.ids_crc32 and len(ids) == 4 * p.length
        copies[p.doc_id, p.doc_tokens, p.start].append(ids)
    for (i, whole), n in want.items():
        for lo in range(0, len(whole) // 4, size):
            assert copies[i, len(whole) // 4, lo].count(whole[4 * lo : 4 * (lo + size)]) >= n
    assert sum(p.length for p in out) == sum(len(w) // 4 * n for (_, w), n in want.items())


def test_equal_documents_are_packed_once_each(spark):
    """Ties: rows that repeat id and text, and texts of one length, each have a place of their own; runs agree."""
    rows = [(1, "the same words here")] * 300 + [(i, "the same words here") for i in range(2, 200)] + [(None, "the same words here")] * 50
    out = packing.pack(as_docs(spark, rows), size=64).collect()
    check_packing(out, 64)
    assert Counter(p.doc_id for p in out) == Counter(i for i, _ in rows) and len({(p.sequence_id, p.offset) for p in out}) == len(rows)
    again = packing.pack(as_docs(spark, rows), size=64).collect()
    assert sorted((p.sequence_id, p.offset, p.length) for p in again) == sorted((p.sequence_id, p.offset, p.length) for p in out)


def test_a_very_long_text_is_packed_whole(spark):
    text = "word and another one, " * 150_000
    out = packing.pack(as_docs(spark, [(1, text), (2, "x")])).collect()
    check_packing(out, 2048)
    n = len(packing.Encoder(packing.default_tokenizer()).encode(text)) // 4 + 1
    assert sum(p.length for p in out if p.doc_id == 1) == n > 600_000
    assert sorted(p.start for p in out if p.doc_id == 1) == list(range(0, n, 2048))


def test_shortest_pack_first_wastes_little():
    rng = random.Random(7)
    histogram = Counter(min(2048, int(rng.expovariate(1 / 600)) + 1) for _ in range(20_000))
    patterns = packing.shortest_pack_first(dict(histogram), 2048)
    assert sum((Counter({k: c * n for k, n in held}) for c, held in patterns), Counter()) == histogram
    used = sum(k * n for k, n in histogram.items())
    assert sum(c for c, _ in patterns) * 2048 < 1.02 * used
    assert len(patterns) < 4 * len(histogram)


def small_network(levels=5, seed=8):
    codes = window_network.Codes(levels)
    rng = np.random.default_rng(seed)
    net = window_network.WindowNetwork(codes, rng.integers(1, 50, codes.edge).astype(float))
    net.nodes += rng.normal(0, 0.3, net.nodes.shape).astype(np.float32)
    net.top += rng.normal(0, 0.3, net.top.shape).astype(np.float32)
    return net, rng


def test_the_network_is_a_distribution_and_starts_as_the_unigram_model():
    net, rng = small_network()
    # Every token once, between the same others.
    window = window_network.WINDOW
    line = np.repeat(rng.integers(0, net.codes.edge + 1, (1, 2 * window + 1)), net.codes.edge, 0).astype(np.int32)
    line[:, window] = np.arange(net.codes.edge)
    place = np.arange(net.codes.edge) * (2 * window + 1) + window
    assert np.exp(net.log_probabilities(line.ravel(), place).astype(float)).sum() == pytest.approx(1, rel=1e-4)
    masses = rng.integers(0, 90, net.codes.edge).astype(float)
    new = window_network.WindowNetwork(net.codes, masses)
    new.embedding[:] = 0
    expected = np.log((masses + 0.5) / (masses + 0.5).sum())
    assert np.allclose(new.log_probabilities(line.ravel(), place), expected, atol=1e-4)


def test_wide_logits_stay_finite():
    net, rng = small_network()
    net.embedding *= 3000
    ids = rng.integers(0, net.codes.edge, 300).astype(np.int32)
    got = np.concatenate([net.log_probabilities(i, a) for i, a, _ in window_network.batches([ids], net.codes.edge)])
    assert np.isfinite(got).all() and got.min() < -100


def test_gradients_of_the_window_network():
    net, rng = small_network()
    ids = rng.integers(0, net.codes.edge, 40).astype(np.int32)
    line, place, _ = next(window_network.batches([ids], net.codes.edge))
    window = window_network.WINDOW
    assert len(line) == 40 + 2 * window and line[:window].tolist() == [net.codes.edge] * window and (line[place] == ids).all()
    before = net.log_probabilities(line, place).mean()
    # One step of Adagrad moves each weight against its gradient.
    old, grads = {p: getattr(net, p).copy() for p in net.PARTS}, []
    for part in net.PARTS:
        flat = getattr(net, part).reshape(-1)
        for k in range(0, len(flat), 17):
            loss = []
            for d in (1e-2, -2e-2):
                flat[k] += np.float32(d)
                loss.append(-net.log_probabilities(line, place).sum(dtype=float))
            flat[k] += np.float32(1e-2)
            grads.append((part, k, (loss[0] - loss[1]) / 2e-2))
    net.learn(line, place)
    moved = {p: (old[p] - getattr(net, p)).reshape(-1) for p in net.PARTS}
    own_bias = lambda part, k: part in ("embedding", "gate") and k % window_network.WIDTH == window_network.WIDTH - 1
    checked = [moved[p][k] * g > 0 for p, k, g in grads if abs(g) > 5e-2 and not own_bias(p, k)]
    assert all(checked) and len(checked) > 30
    for _ in range(60):
        net.learn(line, place)
    assert net.log_probabilities(line, place).mean() > before + 1


def test_scores_prefer_order(spark):
    order = "one two three four five six seven eight nine ten ".split()
    rows = [(10_000 + i, " ".join(order * 12)) for i in range(1500)] + [(1000, " ".join(order)), (1001, " ".join(random.Random(1).sample(order, 10)))] + EDGES
    got = {r.doc_id: r for r in pseudo_likelihood.lm_scores(as_docs(spark, rows)).collect()}
    assert got[1000].mean_log_probability > got[1001].mean_log_probability + 1
    assert (got[2].n_tokens, got[2].log_probability, got[2].mean_log_probability) == (0, 0.0, None)


def language(documents, seed=4):
    """Texts whose next word follows from the last one, most of the time."""
    rng, out = random.Random(seed), []
    follows = {k: rng.sample(range(300), 3) for k in range(300)}
    for i in range(documents):
        k, own = rng.randrange(300), []
        for _ in range(80):
            own.append(f"w{k}" if rng.random() > 0.03 else f"rare{rng.randrange(10**6)}")
            k = rng.choice(follows[k]) if rng.random() < 0.8 else rng.randrange(300)
        out.append((i, " ".join(own)))
    return out


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "SHARD_ROOT", 60)
    docs = as_docs(spark, language(400) + EDGES + EDGES)
    one, eight = (sorted(((str(r.doc_id), r.n_tokens, r.log_probability) for r in pseudo_likelihood.lm_scores(d).collect())) for d in (docs.coalesce(1), docs.repartition(8)))
    assert [r[:2] for r in one] == [r[:2] for r in eight] and len(one) == 400 + 2 * len(EDGES)
    assert [r[2] for r in one] == pytest.approx([r[2] for r in eight], rel=1e-6)  # batches of scoring differ in their last digits


def shape_brute(word):
    n = len(word)
    size = 0 if n < 5 else 1 if n < 8 else 2 if n < 12 else 3
    kind = 0 if word.isalpha() else 1 if not word.isascii() else 2 if any(48 <= c < 58 for c in word) else 3
    return (size * 4 + kind) * 2 + (not (97 <= word[-1] < 123 or word[-1] >= 128))


def test_described_words():
    rng = random.Random(2)
    words = ["a", "é", "日本語", "x1", "12", "a-b", "ABC", "word.", "\x00", "~" * 300, *("".join(rng.choices("abZ09.-é日", k=rng.randint(1, 15))) for _ in range(3000))]
    coded = [w.encode() for w in words]
    keys, shapes = pseudo_likelihood.described_words(pa.array([b"skipped", *coded], pa.binary())[1:])
    assert shapes.tolist() == [shape_brute(w) for w in coded]
    assert len(set(keys.tolist())) == len(set(coded)) and dict(zip(coded, keys.tolist(), strict=True)) == {w: pseudo_likelihood.described_words(pa.array([w]))[0][0] for w in coded}


def test_split_words(spark):
    from quirewise.llm.common import lower_words, split_words

    texts = [t for _, t in EDGES] + ["", " lead", "trail ", "a\x1cb \x85c\u00a0d", "\v\f\r\n\t ", "ÀB ÉZ İx"]
    offsets, words = split_words(pa.array(["skipped words", *texts])[1:])
    assert [[w.encode() for w in words[a:b].to_pylist()] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)] == [lower_words(t or "") for t in texts]


def test_scores_against_brute_force(spark, monkeypatch):
    """Shares of rare words, ids by frequency and the sum over tokens, with the trained network itself."""
    monkeypatch.setattr(pseudo_likelihood, "VOCABULARY_FACTOR", 1)
    nets = []
    load = pseudo_likelihood.scored
    monkeypatch.setattr(pseudo_likelihood, "scored", lambda t, v, w: nets.append(v.network(w)) or load(t, v, w))
    rows = language(150) + EDGES
    got = {(r.doc_id, r.n_tokens): r.log_probability for r in pseudo_likelihood.lm_scores(as_docs(spark, rows)).collect()}
    texts = [(i, [w.lower().encode() if w.isascii() else w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]) for i, t in rows]
    counts = Counter(w for _, words in texts for w in words)
    net = nets[0]
    ranked = sorted(counts, key=lambda w: (-counts[w], w))[: net.codes.words]
    ids = {w: window_network.SHAPES + k for k, w in enumerate(ranked)}
    totals = Counter()
    for w, n in counts.items():
        if w not in ids:
            totals[shape_brute(w)] += n
    assert 3 <= net.codes.levels < 8 and sum(totals.values()) > 100
    for i, words in texts:
        own = [ids.get(w, shape_brute(w)) for w in words]
        edge, window = [net.codes.edge] * window_network.WINDOW, window_network.WINDOW
        padded = edge + own + edge
        expected = 0.0
        for k, (w, x) in enumerate(zip(words, own, strict=True)):
            expected += float(net.log_probabilities(np.array(padded[k : k + 2 * window + 1]), np.array([window]))[0])
            if w not in ids:
                expected += math.log(counts[w] / totals[x])
        assert got[i, len(words)] == pytest.approx(expected, rel=1e-4, abs=1e-4)


def test_held_out_texts_are_likelier_than_under_the_unigram_model(spark):
    texts = [t.lower().encode().split() for _, t in language(900)]
    counts = Counter(w for t in texts[:800] for w in t)
    codes = window_network.Codes(8)
    ids = {w: window_network.SHAPES + k for k, (w, _) in enumerate(counts.most_common(codes.words))}
    masses = np.zeros(codes.edge)
    coded = [np.array([ids.get(w, shape_brute(w)) for w in t], np.int32) for t in texts]
    for t in coded[:800]:
        np.add.at(masses, t, 1)
    net = window_network.WindowNetwork(codes, masses)
    for line, place, _ in window_network.batches(coded[:800], codes.edge, 512):
        net.learn(line, place)
    held = np.concatenate(coded[800:])
    score = np.mean([x for i, a, _ in window_network.batches(coded[800:], codes.edge) for x in net.log_probabilities(i, a)])
    assert score > np.log((masses + 0.5) / (masses + 0.5).sum())[held].mean() + 0.3


def test_scores_of_long_texts_by_parts():
    net, rng = small_network()
    ids = rng.integers(0, net.codes.edge, 1000).astype(np.int32)
    whole, parts = (np.concatenate([net.log_probabilities(i, a) for i, a, _ in window_network.batches([ids, ids[:5]], net.codes.edge, size)]) for size in (5000, 64))
    assert np.allclose(whole, parts, atol=1e-4) and len(whole) == 1005
    assert pseudo_likelihood.unpacked(pseudo_likelihood.packed(ids)).tolist() == ids.tolist()


def test_a_very_long_text_has_a_score(spark):
    rows = [(1, "a b c " * 200_000), (2, "a b c"), (3, "x" * 2_000_000)]
    got = {r.doc_id: r for r in pseudo_likelihood.lm_scores(as_docs(spark, rows)).collect()}
    assert got[1].n_tokens == 600_000 and got[1].mean_log_probability > got[3].mean_log_probability and got[3].n_tokens == 1


def test_quotes(spark):
    first = "The meeting is on Tuesday at noon.\nPlease bring the old plans."
    rows = [
        (1, 0, "user", first), (1, 1, "assistant", "On Monday Ann wrote:\n> the meeting is on  tuesday at noon.\nI can come then too."), (1, 2, "user", "> I can come then too.\n>> The meeting is on Tuesday at noon.\nVery good, see you there."),
        (2, 0, "user", "> Please bring the old plans.\nWhich plans do you mean?"), (2, 1, "user", None), (None, 3, "user", "> Please bring the old plans.\nlost"), (3, 0, "user", "> nobody ever said these words\nHello there, all of you."), (3, 0, "user", "> nobody ever said these words\nHello there, all of you."),
    ]
    got = quotation.threads(spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, own int")).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(rows)
    assert by[1, 1][:9] == (1, 0, 1, 1, 1, "assistant", 1, 0, "I can come then too.")
    assert by[1, 2][:9] == (1, 0, 2, 1, 2, "user", 1, 1, "Very good, see you there.")
    assert by[2, 0][:9] == (1, 0, 1, 2, 0, "user", 1, 0, "Which plans do you mean?")
    assert (by[2, 1].depth, by[2, 1].text, by[None, 3].reply_conv, by[3, 0].reply_conv) == (0, "", None, None)


def test_quotes_of_all_kinds(spark):
    long = "We could meet on Friday in the old library. It opens at ten in the morning. Bring your own lamp"
    rows = [
        (1, 0, "user", "Sounds good."), (1, 1, "user", "Something else entirely here"), (1, 2, "user", "> Sounds good.\nFine with me, too."), (2, 0, "user", "> Sounds good.\nNot my own conversation here"),
        (3, 0, "user", long), (3, 1, "user", "> We could meet on Friday in\n> the old library. It opens at ten\n> in the morning.\nI have no time"), (3, 2, "user", "> It opens at ten in the morning.\nToo early for me"),
        (4, 0, "user", "> Nine rivers run to the sea\nReally, all of them?"), (9, 0, "user", "Nine rivers run to the sea"),
        (5, 0, "user", "> Beta says this one line\nAlpha says this one line"), (6, 0, "user", "> Alpha says this one line\nBeta says this one line"), (7, 0, "user", "> Fine with me, too.\n>\n> Beta says this one line\n> Beta says this one line\nDone"),
        (10, 0, "user", "> Circle holder three says this\nCircle holder one says this"), (11, 0, "user", "> Circle holder one says this\nCircle holder two says this"), (12, 0, "user", "> Circle holder two says this\nCircle holder three says this"), (13, 0, "user", "> Circle holder three says this\ntail"),
        (14, 0, "user", "> only later said, in this very place"), (14, 1, "user", "only later said, in this very place"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotation.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    reply = {k: (r.reply_conv, r.reply_turn) for k, r in got.items() if r.reply_conv is not None}
    assert reply.pop((7, 0)) in {(1, 2), (6, 0)}
    assert reply == {(1, 2): (1, 0), (3, 1): (3, 0), (3, 2): (3, 0), (4, 0): (9, 0), (6, 0): (5, 0), (11, 0): (10, 0), (12, 0): (11, 0), (13, 0): (12, 0)}
    assert got[4, 0][:3] == (9, 0, 1) and got[13, 0][:3] == (10, 0, 3) and got[5, 0].depth == 0


def test_quotes_of_a_common_line(spark):
    rows = [(c, t, "user", "good morning to all" if t == 0 else "> good morning to all\nthank you and you too") for c in range(40) for t in range(2)]
    got = quotation.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 80 and all((r.reply_conv, r.reply_turn) == (r.conv_id, 0) for r in got if r.turn == 1)


def read_message(text):
    """(own text, own pieces, (level, piece) of quotes), pieces as tuples of words; written apart from the operator's parser."""
    words_of = lambda line: tuple(re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", line))
    lines = []  # (level, words, line)
    for line in text.split("\n"):
        rest, level = line.lstrip(" \t"), 0
        while rest.startswith(">"):
            level, rest = level + 1, rest[1:].lstrip(" \t")
        if level and lines and lines[-1][0] == 0 and re.fullmatch(r".{0,200}(wrote|said)\s*:\s*", lines[-1][2]):
            lines.pop()
            lines.append((-1, (), ""))  # still ends a passage
        lines.append((level, words_of(rest if level else line), line))
    found = []
    for level, group in groupby(lines, key=lambda x: x[0] if x[1] else None):
        run = [words for _, words, _ in group]
        if level is None:
            continue
        found += [(level, words) for words in run]
        whole = sum(run, ())
        found.append((level, whole))
        for ended in re.findall(r"(?:\S+ )*?\S*[.!?][\"')\]*_]*(?= |$)|(?:\S+ )*\S+$", " ".join(whole)):
            found.append((level, tuple(ended.split())))
    own = "\n".join(line for level, _, line in lines if level == 0).strip("\n")
    return own, {p for v, p in found if v == 0 and p}, {(v, p) for v, p in found if v > 0 and p}


def threads_brute(messages):
    """(conv, turn) -> (root, depth, parent), one message and piece after another, on texts instead of hashes."""
    found = {(c, t): read_message(x or "") for c, t, _, x in messages}
    bare = lambda words: f" {' '.join(w.strip(quotation.ENDS.decode()) or w for w in words)} "
    runs = {m: [bare(re.findall(r"[^\x20\x09-\x0D]+", run.lower())) for run in re.split(r"\n[\x20\t]*(?=\n)", own)] for m, (own, _, _) in found.items()}

    def holder(m, holds, most_others):
        near = [t for c, t in found if c == m[0] and holds((c, t))]
        if near and min(near) < m[1]:
            return m[0], min(near)
        convs = sorted({c for c, t in found if holds((c, t))})
        others = [c for c in convs if c != m[0]]
        if not others or len(others) > most_others:
            return None
        other = convs[0] if convs[0] != m[0] else convs[-1]
        return other, min(t for c, t in found if c == other and holds((c, t)))

    parent = {}
    for m, (_, _, quoted) in found.items():
        votes = Counter()
        for level, p in quoted:
            up, whole = holder(m, lambda k, p=p: p in found[k][1], 0 if len(p) < 3 else len(found)), 1
            if up is None and len(p) >= 3:
                up, whole = holder(m, lambda k, p=p: any(bare(p) in run for run in runs[k]), 1 if len(p) < 6 else len(found)), 0
            if up is not None:
                votes[level, up, whole] += 1
        if votes:
            parent[m] = min((level, -votes[level, up, 1], -votes[level, up, 0], up) for level, up, _ in votes)[3]
    for start in sorted(parent):
        seen, now = [], start
        while now in parent and now not in seen:
            seen.append(now)
            now = parent[now]
        if now in seen:  # a circle: its least message loses its link
            del parent[min(seen[seen.index(now) :])]
    out = {}
    for m in found:
        root, depth = m, 0
        while root in parent:
            root, depth = parent[root], depth + 1
        out[m] = root, depth, parent.get(m)
    return out


@pytest.mark.parametrize("seed,hot", [(0, 1000), (1, 1000), (2, 3)])
def test_quotes_against_brute_force(spark, monkeypatch, seed, hot):
    """Random conversations that quote lines, sentences, parts and re-wrapped passages, in their own and in others, both ways."""
    monkeypatch.setattr(quotation, "LEAST_HOT", hot)
    rng = random.Random(seed)
    said = [" ".join(rng.choice("alpha beta gamma delta river stone").capitalize() if k == 0 else rng.choice("one two six red old new".split()) for k in range(rng.randint(1, 7))) + rng.choice(".!? ") for _ in range(60)]
    messages = []
    for c in range(25):
        for t in range(rng.randint(1, 6)):
            lines = [rng.choice(said) for _ in range(rng.randint(0, 3))]
            for _ in range(rng.randint(0, 3)):
                passage = " ".join(rng.sample(said, rng.randint(1, 3))).split()
                cut = rng.randint(1, len(passage))
                lines += [f"{rng.choice(('> ', '>', '>> '))}{' '.join(part)}" for part in (passage[:cut], passage[cut:]) if part]
            messages.append((c, t, rng.choice(("user", "assistant")), "\n".join(lines) if rng.random() < 0.95 else None))
    got = quotation.threads(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")).collect()
    expected = threads_brute(messages)
    assert {(r.conv_id, r.turn): ((r.thread_conv, r.thread_turn), r.depth, None if r.reply_conv is None else (r.reply_conv, r.reply_turn)) for r in got} == expected
    assert len(got) == len(messages) and sum(p is not None for _, _, p in expected.values()) > 10


def test_quotes_of_parts_and_of_short_pieces(spark):
    long = " ".join(f"word{k}" for k in range(100))
    rows = [
        (1, 0, "user", "The old bridge over the river is closed until the end of May, they say.\nMore about it\n\ntomorrow morning then"),
        (1, 1, "user", "> bridge over the river is closed\nWhich bridge?"), (1, 2, "user", "> closed until the\nI see"), (2, 0, "user", "> is closed until the end of May,\nGood to know, I will walk"),
        (3, 0, "user", "> about it tomorrow morning\nNothing holds these words in a row"), (4, 0, "user", "> they say. More about it\nLines of one run"), (5, 0, "user", "Zebras!"), (6, 0, "user", "> Zebras!\nToo short for another conversation"),
        (7, 0, "user", "Same here"), (8, 0, "user", "Same here"), (9, 0, "user", "> Same here\nAmbiguous"), (10, 0, "user", "red green blue one"), (11, 0, "user", "two red green blue"), (12, 0, "user", "> red green blue\nAmbiguous, too"),
        (13, 0, "user", long), (13, 1, "user", f"> {' '.join(long.split()[20:95])}\nA long part"), (14, 0, "user", f"> {' '.join(long.split()[20:95])} other\nNot quite"), (15, 0, "user", "two words"), (15, 1, "user", "> words\nOne word is no part"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotation.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: (r.reply_conv, r.reply_turn) for k, r in got.items() if r.reply_conv is not None} == {(1, 1): (1, 0), (1, 2): (1, 0), (2, 0): (1, 0), (4, 0): (1, 0), (13, 1): (13, 0)}


def test_quotes_of_a_repeated_message(spark):
    """Two rows of one (conv_id, turn), of one text or of several: each piece links to it once, and all rows stay."""
    rows = [
        (1, 0, "user", "Kites need wind and a long line."), (1, 0, "user", "Kites need wind and a long line."), (1, 0, "user", "Boats need water and a good rope."),
        (1, 1, "user", "> Kites need wind and a long line.\n> Boats need water and a good rope.\nBoth are fun"), (2, 0, "user", "> water and a good rope\nAnd a sail"), (2, 0, "user", "> water and a good rope\nAnd a sail"), (3, 0, "user", "> And a sail\nNo"),
    ]
    got = quotation.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.turn, r.reply_conv, r.reply_turn, r.depth) for r in got if r.reply_conv) == [(1, 1, 1, 0, 1), (2, 0, 1, 0, 1), (2, 0, 1, 0, 1), (3, 0, 2, 0, 2)]
    assert len(got) == len(rows)


def test_a_very_long_message(spark):
    said = "This one sentence is said by somebody. " * 20_000
    rows = [(1, 0, "user", said), (1, 1, "assistant", "> " + said.replace(". ", ".\n> ") + "\nYes")]
    got = {r.turn: r for r in quotation.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].reply_conv, got[1].reply_turn, got[1].text) == (1, 0, "Yes")


def test_empty_tables(spark, nothing):
    assert mixing.mixed_documents(nothing).count() == 0
    assert mixing.mix(nothing)[1].count() == 0
    assert packing.pack(nothing).count() == 0
    assert pseudo_likelihood.lm_scores(nothing).count() == 0
    assert quotation.threads(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from quirewise.llm.common import written

    now, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, sf_dir), name)
        assert now.columns == docs.columns
        kept = {r.doc_id for r in now.select("doc_id").collect()}
        assert kept <= ids and kept
        ids = kept
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
    check_packing(last, 2048)
    assert {p.doc_id for p in last} == ids


def test_pipeline_against_brute_force(spark, sf_dir):
    """Each stage on what the stage before it kept; the trained classifier's scores are taken as they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    from quirewise.llm import quality
    from quirewise.llm.common import written
    from tests.llm.test_dedup import join_brute, lines_brute

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in quality.score(docs, quality.trained_on(docs, labels)).collect() if r.score >= 0.5}
    now = written(stage["quality_classifier"](spark, docs, sf_dir), "t")
    assert {r.doc_id for r in now.collect()} == good
    rows = [(r.doc_id, r.text) for r in now.collect()]
    now = written(stage["line_dedup"](spark, now, sf_dir), "t")
    left = {i: t for i, _, _, t in lines_brute(rows)}
    assert {r.doc_id: r.text for r in now.collect()} == left and all(r.n_chars == len(r.text) for r in now.collect())
    now = written(stage["ngram_jaccard_join"](spark, now, sf_dir), "t")
    stay = {i for i, _, c in join_brute(sorted(left.items()), 5, 80) if i == c}
    assert {r.doc_id for r in now.collect()} == stay
    before = {r.doc_id: r for r in now.collect()}
    now = written(stage["source_mixing"](spark, now, sf_dir), "t")
    sizes = Counter()
    for r in before.values():
        sizes[r.source] += len(r.text.encode().split())
    want = dict(zip(sizes, targets_by_steps(list(sizes.items())), strict=True))
    taken = Counter()
    for r in now.collect():
        assert before[r.doc_id].text.startswith(r.text)
        taken[r.source] += len(r.text.encode().split())
    assert taken == Counter({s: math.floor(t) for s, t in want.items()})
    out = stage["packing"](spark, now, sf_dir).collect()
    check_packing(out, 2048)
    e = packing.Encoder(packing.default_tokenizer())
    assert sum(p.length for p in out) == sum(len(e.encode(r.text)) // 4 + 1 for r in now.collect())


def test_pipeline_stages_on_edges(spark, edges, nothing, sf_dir):
    """Null ids and texts, empty texts, repeated rows: what the stages' docstrings say."""
    from tests.llm.test_dedup import join_brute, lines_brute

    stage = {name: lambda rows, f=f: f(spark, rows, sf_dir) for name, f in corpus_pipeline.STAGES}
    for name in stage:
        assert stage[name](nothing).count() == 0, name
    both = lambda frame: sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)
    kept = both(stage["quality_classifier"](edges))
    assert Counter(kept) <= Counter(EDGES) and kept == both(stage["quality_classifier"](edges))
    assert both(stage["line_dedup"](edges)) == sorted(((i, t) for i, _, _, t in lines_brute(EDGES)), key=str)
    least = {(i, n, c) for i, n, c in join_brute(EDGES, 5, 80) if i == c}
    once = Counter(both(stage["ngram_jaccard_join"](edges)))
    assert {i for i, _ in once} == {i for i, _, _ in least} and once[5, "repeated rows are here"] == 1
    mixed = stage["source_mixing"](edges)
    sizes = Counter()
    for r in edges.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += len(r.text.encode().split())
    assert mixed.columns == edges.columns and taken == Counter({s: math.floor(t) for s, t in zip(sizes, targets_by_steps(list(sizes.items())), strict=True)})
    e = packing.Encoder(packing.default_tokenizer())
    packed = stage["packing"](edges).collect()
    check_packing(packed, 2048)
    assert Counter((p.doc_id, p.doc_tokens) for p in packed) == Counter((i, len(e.encode(t or "")) // 4 + 1) for i, t in EDGES)


def test_near_copies_leave_the_pipeline(spark):
    rows = near_copies(5)
    kept = corpus_pipeline.near_duplicates(spark, as_docs(spark, rows), "")
    assert 0 < kept.count() < len(rows)
