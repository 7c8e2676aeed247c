"""Chat formatting by quotation linking.

Lines that start with `>` are quotes, nested by the number of marks.  Quoted lines of one level that
follow each other are a passage.  Its pieces (lines, sentences, and the whole passage) are hashed after
normalisation and joined to the first message that holds the same piece among its own words, so a
re-wrapped passage and a sentence out of a longer line are found.  A piece of MIN_WORDS words or more
that no message holds as one is looked for as a part: words in a row, but for the marks at their ends,
within own lines that no empty line parts.  A message replies to the message that most of its outermost matched pieces come from, those
held as a whole before parts; threads follow these links, and texts come without quotes.

A part of n words is named by the two windows of s words at its ends, s being the largest MIN_WORDS * 2^k
up to n; as n < 2s, they cover it.  Own windows that equal the first one of a lost piece are found by a
join with the distinct first windows; only from there on a message's words are read again and named for
those n that the first window asks for.  Sizes s that no lost piece has are not computed.

A piece that very many messages hold or quote stays one row on the join's side of originals: only one
holder counts (in the same conversation if there is an earlier one, else in other conversations: the
first one overall, or of the last conversation if that is one's own), so a join never multiplies rows.
A short piece says little: a whole one ("Yes.") links inside its conversation only, a part of a few
words links to another conversation only if no second one holds it.  Conversations have no order among
each other; where links run in a circle, the least message of the circle loses its link.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, lower_words, small_batches, table, texts, written
from .perfect_hash import mix

#: Shorter pieces ("Yes.", "Thanks!") link inside their conversation only, and aren't looked for as parts.
MIN_WORDS = 3
#: Shorter parts link to another conversation only if it is the only one that holds them.
PART_WORDS = 6
#: A piece is quoted very often from this share of all quoted pieces on, and from this number.
HOT_SHARE = 1 / 64
LEAST_HOT = 1000
_MARKS = re.compile(r"[\x20\t]*((?:>[\x20\t]?)+)")
#: Marks at the ends of words, which parts are compared without, as a part may end where its sentence goes on.
ENDS = b".,;:!?\"'()[]*_"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INTRO = re.compile(r"^.{0,200}(wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.I)


def parsed(text: str) -> tuple[str, list[int], list[tuple[int, tuple[bytes, ...]]]]:
    """The own words, the hashes of own pieces, and (level, words) of quoted pieces.

    An introduction such as "On Monday Ann wrote:" right before a quote goes with it.
    """
    own, passages, level = [], [], -1  # passages: (level, lines as words), 0 for own ones
    for line in text.split("\n"):
        if m := _MARKS.match(line):
            now, words = m.group(1).count(">"), lower_words(line[m.end() :])
            if level == 0 and _INTRO.match(own[-1]):
                own.pop()
                passages[-1][1].pop()
        else:
            now, words = 0, lower_words(line)
            own.append(line)
        if now != level or not words:
            passages.append((now, []))
        passages[-1][1].append(words)
        level = now
    found = dict.fromkeys((v, words) for v, lines in passages for words in pieces(lines))
    return "\n".join(own).strip("\n"), [piece_hash(words) for v, words in found if v == 0], [x for x in found if x[0]]


def pieces(lines: list[list[bytes]]) -> Iterator[tuple[bytes, ...]]:
    """A passage's lines, its sentences and itself."""
    whole = [w for line in lines for w in line]
    ends = [k + 1 for k, w in enumerate(whole) if w.rstrip(b"\"')]*_").endswith((b".", b"!", b"?"))]
    sentences = (whole[a:b] for a, b in zip([0, *ends], [*ends, len(whole)], strict=True))
    return (tuple(words) for words in (*lines, *sentences, whole) if words)


def piece_hash(words: tuple[bytes, ...]) -> int:
    """Odd for short pieces, even for others."""
    h = xxhash.xxh3_64_intdigest(b" ".join(words)) & ~1 | (len(words) < MIN_WORDS)
    return h - (h >> 63 << 64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _FACTOR + b)


def _word_hashes(words: tuple[bytes, ...] | list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.strip(ENDS) or w) for w in words], np.uint64)


def window_size(n: int) -> int:
    """The largest MIN_WORDS * 2^k up to n."""
    return MIN_WORDS << ((n // MIN_WORDS).bit_length() - 1)


def windows(hashes: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, names of the windows at each place) for the sizes MIN_WORDS * 2^k up to `most`, as far as there are any."""
    w, size = hashes, MIN_WORDS
    for k in range(1, MIN_WORDS):
        w = _pair(w[:-1], hashes[k:])
    while size <= most and len(w):
        yield size, w
        w, size = _pair(w[:-size], w[size:]), 2 * size


def head_names(windows: np.ndarray, size: int) -> np.ndarray:
    return mix(windows + np.uint64(size)).view(np.int64)


def part_names(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """The names of parts of n words, from the windows at both ends; odd for short ones."""
    return (mix(_pair(first, last) + np.uint64(n)) & ~np.uint64(1) | np.uint64(n < PART_WORDS)).view(np.int64)


def quoted_piece(level: int, words: tuple[bytes, ...]) -> dict:
    """A quoted piece by its name as a whole and, if it may be a part of others, as a part with its first window."""
    n, out = len(words), {"level": level, "key": piece_hash(words)}
    if n >= MIN_WORDS:
        size, w = list(windows(_word_hashes(words), n))[-1]
        out |= {"n": n, "size": size, "head": int(head_names(w[:1], size)[0]), "part": int(part_names(w[:1], w[-1:], n)[0])}
    return out


def own_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's words, and where the run of lines that a word stands in ends."""
    words, ends, begun = [], [], 0
    for line in (*text.split("\n"), ""):
        more = lower_words(line)
        if not more:
            ends += [len(words)] * (len(words) - begun)
            begun = len(words)
        words += more
    return _word_hashes(words), np.array(ends, np.int64)


def _parsed_rows(messages: DataFrame) -> DataFrame:
    def make():
        def f(b: pa.RecordBatch) -> dict:
            rows = [parsed(t) for t in texts(b)]
            quoted = [[quoted_piece(v, words) for v, words in q] for _, _, q in rows]
            return {c: b.column(c) for c in ("conv_id", "turn", "role")} | {"text": [o for o, _, _ in rows], "own": [h for _, h, _ in rows], "quoted": quoted}

        return f

    return arrow_map(
        messages.select("conv_id", "turn", "role", "text"),
        "conv_id long, turn long, role string, text string, own array<long>, quoted array<struct<level:int,key:long,n:int,size:int,head:long,part:long>>", make,
    )


def reply_links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_conv, parent_turn): one row for each message whose quotes are found."""
    named = rows.filter("conv_id is not null and turn is not null")
    asked = named.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*")
    whole = written(with_parents(asked, named.select("conv_id", "turn", F.explode("own").alias("key")), False), "quoted-pieces")
    lost = whole.filter("parent is null and part is not null").select("conv_id", "turn", "level", F.col("part").alias("key"), "n", "size", "head").distinct()
    votes = whole.select("conv_id", "turn", "level", "parent", F.lit(1).alias("whole"))
    if sizes := sorted(r["size"] for r in lost.select("size").distinct().collect()):  # one for each doubling of the words
        lost = written(lost, "quoted-parts")
        parts = with_parents(lost, parts_held(named, lost, sizes), True)
        votes = votes.unionByName(parts.select("conv_id", "turn", "level", "parent", F.lit(0).alias("whole")))
    counted = votes.filter("parent is not null").groupBy("conv_id", "turn", "level", "parent").agg(F.sum("whole").alias("whole"), F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct("level", (-F.col("whole")).alias("whole"), (-F.col("n")).alias("votes"), "parent"))
    return counted.groupBy("conv_id", "turn").agg(best.alias("best")).select(
        "conv_id", "turn", F.col("best.parent.conv_id").alias("parent_conv"), F.col("best.parent.turn").alias("parent_turn"),
    )


def parts_held(named: DataFrame, lost: DataFrame, sizes: list[int]) -> DataFrame:
    """(conv_id, turn, key) of the parts of own words that start as one of the lost pieces, and have as many words."""
    most = sizes[-1]

    def starts():
        def f(b: pa.RecordBatch) -> dict:
            rows, heads = [], []
            for k, t in enumerate(texts(b)):
                hashes, ends = own_words(t)
                for size, w in windows(hashes, most):
                    if size in sizes:
                        inside = np.arange(len(w)) + size <= ends[: len(w)]
                        heads.append(np.unique(head_names(w[inside], size)))
                        rows.append(np.full(len(heads[-1]), k))
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))
            return {"conv_id": b.column("conv_id").take(at), "turn": b.column("turn").take(at), "head": pa.array(np.concatenate([np.zeros(0, np.int64), *heads]))}

        return f

    wanted = lost.groupBy("head").agg(F.collect_set("n").alias("lengths"))
    hits = arrow_map(named.select("conv_id", "turn", "text"), "conv_id long, turn long, head long", starts).join(wanted, "head")
    places = hits.groupBy("conv_id", "turn").agg(F.collect_set(F.struct("head", "lengths")).alias("asked"))

    def named_parts():
        def f(b: pa.RecordBatch) -> dict:
            rows, keys = [], []
            for k, (t, asked) in enumerate(zip(texts(b), b.column("asked").to_pylist(), strict=True)):
                lengths = {x["head"]: x["lengths"] for x in asked}
                hashes, ends = own_words(t)
                own = [np.zeros(0, np.int64)]
                for size, w in windows(hashes, most):
                    names = head_names(w, size)
                    at = np.flatnonzero(np.isin(names, np.array(list(lengths), np.int64)))
                    at = at[np.argsort(names[at], kind="stable")]
                    for same in np.split(at, np.flatnonzero(np.diff(names[at])) + 1) if len(at) else []:
                        for n in lengths[int(names[same[0]])]:
                            fit = same[same + n <= ends[same]]
                            own.append(part_names(w[fit], w[fit + n - size], n))
                keys.append(np.unique(np.concatenate(own)))
                rows.append(np.full(len(keys[-1]), k))
            at = pa.array(np.concatenate(rows))
            return {"conv_id": b.column("conv_id").take(at), "turn": b.column("turn").take(at), "key": pa.array(np.concatenate(keys))}

        return f

    return arrow_map(named.join(places, ["conv_id", "turn"]).select("conv_id", "turn", "text", "asked"), "conv_id long, turn long, key long", named_parts)


def with_parents(asked: DataFrame, held: DataFrame, single: bool) -> DataFrame:
    """`asked` (conv_id, turn, key, ...) with the message that its key comes from, or null; held: (conv_id, turn, key).

    single: short pieces come from another conversation, too, if it is the only one that holds them.
    """
    in_conv = held.groupBy("conv_id", "key").agg(F.min("turn").alias("near_turn"))
    ends = F.min(F.struct("conv_id", "near_turn")).alias("first"), F.max(F.struct("conv_id", (-F.col("near_turn")).alias("turn"))).alias("last")
    far_keys = in_conv if single else in_conv.filter("key & 1 = 0")
    overall = far_keys.groupBy("key").agg(*ends, F.count(F.lit(1)).alias("convs"))
    met = with_holders(asked.join(in_conv, ["conv_id", "key"], "left"), overall)
    parent = lambda conv, turn: F.struct(conv.alias("conv_id"), turn.alias("turn"))
    near = F.when(F.col("near_turn") < F.col("turn"), parent(F.col("conv_id"), F.col("near_turn")))
    other = lambda end, turn: F.when(F.col(f"{end}.conv_id") != F.col("conv_id"), parent(F.col(f"{end}.conv_id"), turn))
    far = F.coalesce(other("first", F.col("first.near_turn")), other("last", -F.col("last.turn")))
    others = F.col("convs") - F.col("near_turn").isNotNull().cast("int")
    clear = (F.col("key").bitwiseAND(F.lit(1)) == 0) | (others == 1)  # no short key has a far one unless `single`
    return met.withColumn("parent", F.coalesce(near, F.when(clear, far))).drop("near_turn", "first", "last", "convs")


def with_holders(asked: DataFrame, overall: DataFrame) -> DataFrame:
    """`asked` with the holders of its keys; those of keys that very many messages quote are broadcast, 1 / HOT_SHARE at most."""
    many = max(LEAST_HOT, asked.count() * HOT_SHARE)
    hot = asked.groupBy("key").count().filter(F.col("count") >= many).select("key")
    if hot.isEmpty():
        return asked.join(overall, "key", "left")
    hot = F.broadcast(written(hot, "quoted-often"))
    often = asked.join(hot, "key", "left_semi").join(F.broadcast(overall.join(hot, "key")), "key", "left")
    return often.unionByName(asked.join(hot, "key", "left_anti").join(overall, "key", "left"))


def without_circles(links: DataFrame) -> DataFrame:
    """Links without the one of the least message of each circle, by pointer doubling."""
    me, up = F.struct("conv_id", "turn"), F.struct(F.col("parent_conv").alias("conv_id"), F.col("parent_turn").alias("turn"))
    if links.filter(up > me).isEmpty():  # each circle has such a link
        return links
    now, steps = links.select(me.alias("me"), up.alias("up"), me.alias("least")), 1
    while True:
        # Rows whose way goes on for `steps` links; all of a circle stay.
        now = written(now, "reply-ways")
        n = now.count()
        if n <= steps:
            break
        on = now.select(F.col("me").alias("up"), F.col("up").alias("next"), F.col("least").alias("more"))
        now, steps = now.join(on, "up").select("me", F.col("next").alias("up"), F.least("least", "more").alias("least")), 2 * steps
    if n == 0:
        return links
    # What is reached after so many links lies on a circle, and its way has gone around the whole of it.
    reached = now.select(F.col("up").alias("me")).distinct()
    roots = now.join(reached, "me", "left_semi").filter("me = least").select("me.conv_id", "me.turn")
    return links.join(roots, ["conv_id", "turn"], "left_anti")


def ancestors(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, depth) of each linked message, by pointer doubling."""
    now = written(
        links.select("conv_id", "turn", F.col("parent_conv").alias("root_conv"), F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")),
        "replies",
    )
    while True:
        up = now.select(
            F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("up_conv"),
            F.col("root_turn").alias("up_turn"), F.col("depth").alias("more"),
        )
        if now.join(up, ["root_conv", "root_turn"], "left_semi").isEmpty():
            return now
        joined = now.join(up, ["root_conv", "root_turn"], "left")
        step = joined.select(
            "conv_id", "turn", F.coalesce("up_conv", "root_conv").alias("root_conv"),
            F.coalesce("up_turn", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
        )
        now = written(step, "replies")


def threads(messages: DataFrame) -> DataFrame:
    """(thread_conv, thread_turn, depth, conv_id, turn, role, reply_conv, reply_turn, text), replies after what they answer.

    One row for each message (conv_id, turn, role, text), sorted by thread, depth, conversation and
    turn.  Messages without found quotes stay in their conversation's own thread at depth 0.  Parts are
    looked for in the text without its quotes, so a part may span the place of a quote.  A null
    text is empty; a message with a null conv_id or turn links with nothing; rows that repeat a
    message stay rows; an empty table gives an empty result; further columns are ignored.
    """
    small_batches(messages.sparkSession)
    rows = written(_parsed_rows(messages), "messages")
    links = written(reply_links(rows), "reply-links")
    if (kept := without_circles(links)) is not links:
        links = written(kept, "reply-links")
    roots = ancestors(links)
    known = roots.join(links, ["conv_id", "turn"])
    out = rows.join(known, ["conv_id", "turn"], "left")
    out = out.select(
        F.coalesce("root_conv", "conv_id").alias("thread_conv"), F.when(
            F.col("root_conv").isNotNull(), F.col("root_turn"),
        ).otherwise(F.col("turn")).alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
        "conv_id", "turn", "role", F.col("parent_conv").alias("reply_conv"), F.col("parent_turn").alias("reply_turn"), "text",
    )
    return out.repartitionByRange("thread_conv", "depth", "conv_id", "turn").sortWithinPartitions("thread_conv", "depth", "conv_id", "turn")


def op6_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(table(spark, sf_dir, "conversations"))
