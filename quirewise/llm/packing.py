"""Packing documents into sequences, shortest pack first over the length histogram.

Documents are tokenised once and cut at multiples of the sequence length; what is left is a piece
of its own.  The histogram of piece lengths (at most `size` rows) is packed at the driver: from the
longest length down, pieces go to the pack with the most room left; packs with equal content are
one pattern with a count.  Then each piece, by its rank among the pieces of its length, finds its
pattern, sequence and offset; nothing of the size of the corpus leaves the executors.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, col, small_batches, table, texts, written
from .ranks import buckets_for, order_key, running_before

SIZE = 2048
END_ID = 1
#: Distinct pieces of text whose ids a worker surely remembers.
CACHE = 200_000
# How the tokenizer file that `Encoder` has rules for says that it normalises and splits.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KNOWN_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
KNOWN_SPLITS = [
    {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


class Recent:
    """A map that remembers at least the last `size` keys used, and at most twice as many."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, for byte-level BPE that drops white space.

    A text's ids are those of its pieces, so each distinct piece is encoded once, by the model
    alone.  Plain text is lower-cased and split into pieces here; in other text, any chunk between
    white space that is not plain goes through the whole tokenizer.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.pieces = Tokenizer.from_file(path), Recent(cache)
        #: Whether the file says what the rules below do; texts of other tokenizers go through them as a whole.
        self.known = self._is_known()
        self.split = regex.compile(_SPLIT).findall
        #: Characters that NFC keeps and that lower-case by themselves.
        self.plain = regex.compile(r"[\t-\r -~\u00A1-\u012F\u0131-\u017F]*").fullmatch
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}

    def _is_known(self) -> bool:
        import json

        parts = (self.tokenizer.normalizer, "normalizers"), (self.tokenizer.pre_tokenizer, "pretokenizers")
        steps = [json.loads(part.__getstate__()).get(name) if part else None for part, name in parts]
        return steps == [KNOWN_NORMALIZERS, KNOWN_SPLITS] and type(self.tokenizer.model).__name__ == "BPE"

    def _piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            found = self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
            self.pieces.put(piece, ids := b"".join([t.id.to_bytes(4, "little") for t in found]))
        return ids

    def _plain(self, text: str) -> bytes:
        pieces = self.split(text.lower())
        found = list(map(self.pieces.new.get, pieces))
        if None in found:
            found = [self._piece(p) if ids is None else ids for p, ids in zip(pieces, found, strict=True)]
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        if not self.known:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.plain(text) and "<|" not in text:
            return self._plain(text)
        out = []
        for chunk in text.encode().split():
            c = chunk.decode()
            own = self._plain(c) if self.plain(c) and "<|" not in c else np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
            out.append(own)
        return b"".join(out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str, size: int, id_col: str, text_col: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids and END_ID, cut at multiples of `size`."""
    end = np.array([END_ID], "<u4").tobytes()

    def make():
        encoder = Encoder(tokenizer)

        def f(batch: pa.RecordBatch) -> dict:
            rows, start, length, crc, total, ids = [], [], [], [], [], []
            for k, t in enumerate(texts(batch)):
                own = encoder.encode(t) + end
                n = len(own) // 4
                for lo in range(0, n, size):
                    part = own[4 * lo : 4 * (lo + size)]
                    rows.append(k)
                    start.append(lo)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            out = {"doc_id": batch.column("doc_id").take(pa.array(rows)), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total}
            return out | {"ids": ids} if keep_ids else out

        return f

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return arrow_map(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids, make)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(count, ((length, copies), ...)) of each pattern; histogram: number of pieces by length.

    Each step uses up a length or a pattern's count, so there are few more patterns than lengths.
    """
    open_by_room: dict[int, list[list]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            room = max((r for r, x in open_by_room.items() if x), default=0)
            if room < length:  # no pack takes it: new packs, as many copies in each as fit
                copies = min(n, size // length)
                packs, n = divmod(n, copies)
                open_by_room[size - copies * length].append([packs, ((length, copies),)])
                continue
            pattern = open_by_room[room].pop()
            used = min(n, pattern[0])
            if used < pattern[0]:
                open_by_room[room].append([pattern[0] - used, pattern[1]])
            held = pattern[1]
            held = (*held[:-1], (length, held[-1][1] + 1)) if held[-1][0] == length else (*held, (length, 1))
            open_by_room[room - length].append([used, held])
            n -= used
    return [(c, p) for _, x in sorted(open_by_room.items()) for c, p in x]


def places(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[str, np.ndarray]:
    """Ranges of ranks: pieces of `length` with rank >= low stand at `offset` of sequence first + rank - low."""
    taken: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for count, held in patterns:
        offset = 0
        for length, copies in held:
            for _ in range(copies):
                rows.append((length, taken[length], first, offset))
                taken[length] += count
                offset += length
        first += count
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "low", "first", "offset"), a.T, strict=True))


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset (and the ids with keep_ids).

    A null or empty text is the end id alone; a null id stays null; rows that repeat have pieces of
    their own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cut = written(pieces(docs, tokenizer or default_tokenizer(), size, id_col, text_col, keep_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    at = places(shortest_pack_first(histogram, size))
    keyed = cut.withColumn("key", order_key(F.col("doc_id"), F.col("start")))
    ties = ["doc_id", "start", "doc_tokens", "ids_crc32"]
    ranked = running_before(keyed, "length", "key", buckets_for(max(histogram.values(), default=0)), F.lit(1), ties, "rank").drop("key")
    names = [c for c in cut.columns]

    def make():
        keys = at["length"] << 44 | at["low"]

        def f(batch: pa.RecordBatch) -> dict:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            found = {"sequence_id": at["first"][k] + rank - at["low"][k], "offset": at["offset"][k]}
            return {c: batch.column(c) for c in names} | found

        return f

    schema = ", ".join(f"{c} {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return arrow_map(ranked.select(*names, "rank"), schema, make)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
