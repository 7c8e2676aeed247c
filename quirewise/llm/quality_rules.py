"""Quality rules by line sequence labelling.

A linear-chain conditional random field over the lines of a document, decoded by Viterbi, marks each
line as content or boilerplate; a document is retained if at least KEEP_SHARE of its words stand in
content lines and it passes the base rules.  The field is trained here, on generated line sequences
(prose with headings; menus, link bars, shouting, symbol noise, legal lines, repeats), by gradient
ascent on the likelihood with forward-backward expectations.  It sees shapes of lines only, no
vocabulary of a language except a few words that legal and menu lines have.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, arrow_map, col, small_batches, table, texts
from .perfect_hash import mix

KEEP_SHARE = 0.5
WINDOW = 8
MIN_WORDS = 20
#: Fixed value: the symbols that the base rules count.
SYMBOLS = "#*$%&|<>"
TRAIN_SEQUENCES = 500
TRAIN_STEPS = 150
_LEGAL = (
    "copyright", "all rights reserved", "license", "licence", "cookie", "privacy", "terms of", "sign in", "login", "log in",
    "subscribe", "click here", "read more", "share this", "©",
)
_LINK = re.compile(r"https?://|www\.|[^\s@]@[^\s@]")
_STOP = (".", "!", "?", "…", ":", ";", ",", '"', "”", "»", "'", ")")
_FACTOR = 0x9E3779B97F4A7C15
FEATURES = 18
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_MARKS = b"#*$%&<>{}[]\\^~=_"
_OTHERS = re.compile(r"[^\x00-\x7f]+")


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACE):
            seen.add(line)
    chars = len(text) - sum(map(text.count, SPACE))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice, each word once."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    total, factor = np.zeros(n, np.uint64), 1
    for k in range(window):
        factor = factor * _FACTOR & 0xFFFFFFFFFFFFFFFF
        total += h[k : n + k] * np.uint64(factor)
    _, inverse, counts = np.unique(mix(total), return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    if not len(twice):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def line_features(lines: list[str]) -> np.ndarray:
    """One row for each line (stripped, not empty)."""
    out = np.zeros((len(lines), FEATURES), np.float32)
    seen: set[str] = set()
    low = [line.lower() for line in lines]
    legal = [w for w in _LEGAL if any(w in x for x in low)]
    for k, line in enumerate(lines):
        n, words, ascii_line = len(line), line.split(), line.encode("ascii", "ignore")
        symbols, upper, lower, digits = (len(ascii_line) - len(ascii_line.translate(None, c)) for c in (_MARKS, _UPPER, _LOWER, _DIGITS))
        pipes = line.count("|")
        if len(ascii_line) < n:
            others = "".join(_OTHERS.findall(line))
            upper += sum(map(str.isupper, others))
            lower += sum(map(str.islower, others))
            digits += sum(map(str.isdigit, others))
            pipes += others.count("»") + others.count("·")
        stopped = line.endswith(_STOP)
        bangs = line.count("!!")
        out[k] = (
            1, len(words) < 4, n > 120, np.log1p(n) / 5, stopped, not stopped and len(words) < 6, min(1, 8 * symbols / n), symbols > len(words) / 4,
            min(1, 4 * pipes / (len(words) + 1)), upper > lower, min(1, 3 * digits / n), bangs > len(words) / 4,
            ("@" in line or "www." in line or "://" in line) and bool(_LINK.search(line)), any(w in low[k] for w in legal), line in seen, stopped and lower > 0.6 * n and not symbols and not pipes, k == 0 or k == len(lines) - 1, sum(map(
                str.__eq__, words, words[1:],
            )) > 0.2 * len(words),
        )
        seen.add(line)
    return out


class Field:
    """States: 0 content, 1 boilerplate."""

    def __init__(self):
        self.emit, self.move, self.begin = np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, steps: int = TRAIN_STEPS, rate: float = 0.1, decay: float = 1e-3) -> Field:
        """x: (sequences, lines, FEATURES); y: states; held: which lines are there."""
        params = [self.emit, self.move, self.begin]
        first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
        one = np.eye(2)[y] * held[..., None]
        n = held.sum()
        for step in range(1, steps + 1):
            unary, pair = self._expected(x, held)
            seen_pair = np.einsum("sti,stj->ij", one[:, :-1], one[:, 1:])
            grads = [np.einsum("stf,sti->fi", x, one - unary), seen_pair - pair, (one[:, 0] - unary[:, 0]).sum(0)]
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                g = g / n - decay * p
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self

    def _expected(self, x: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of states and the sum of pair marginals, by forward-backward in logs."""
        e = x @ self.emit
        s, t, _ = e.shape
        forward, backward = np.zeros((s, t, 2)), np.zeros((s, t, 2))
        forward[:, 0] = e[:, 0] + self.begin
        for k in range(1, t):
            step = np.logaddexp.reduce(forward[:, k - 1, :, None] + self.move, axis=1) + e[:, k]
            forward[:, k] = np.where(held[:, k, None], step, forward[:, k - 1])
        for k in range(t - 2, -1, -1):
            step = np.logaddexp.reduce(self.move + (e[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
            backward[:, k] = np.where(held[:, k + 1, None], step, 0)
        z = np.logaddexp.reduce(forward[:, -1], axis=1)
        unary = np.exp(forward + backward - z[:, None, None]) * held[..., None]
        pair = np.exp(forward[:, :-1, :, None] + self.move + (e + backward)[:, 1:, None, :] - z[:, None, None, None])
        return unary, (pair * held[:, 1:, None, None]).sum((0, 1))

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest states of one sequence; ties go to content."""
        e = (x @ self.emit).tolist()
        (a, b), (c, d) = self.move.tolist()
        p, q = e[0][0] + self.begin[0], e[0][1] + self.begin[1]
        back = []
        for u, v in e[1:]:
            from_p, from_q = p + a >= q + c, p + b >= q + d
            back.append((0 if from_p else 1, 0 if from_q else 1))
            p, q = (p + a if from_p else q + c) + u, (p + b if from_q else q + d) + v
        state = 0 if p >= q else 1
        states = [state]
        for choice in reversed(back):
            state = choice[state]
            states.append(state)
        return np.array(states[::-1])


def _generated(rng: random.Random) -> tuple[list[str], list[int]]:
    """Lines of a made-up document and their states."""
    letters, accented = "etaoinshrdlucmfwypvbgk", "éèüöäñíóç"

    def word() -> str:
        w = "".join(rng.choices(letters, k=rng.randint(1, 11)))
        return w if rng.random() > 0.1 else w[: rng.randint(0, len(w))] + rng.choice(accented) + w[-2:]

    def sentence() -> str:
        words = [word() + ("," if rng.random() < 0.1 else "") for _ in range(max(1, int(rng.gauss(11, 6))))]
        return " ".join(words).capitalize() + rng.choices(".?!…", (90, 5, 4, 1))[0]

    def prose() -> list[str]:
        lines = [" ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 6, 10)))) for _ in range(rng.randint(1, 7))]
        return ([" ".join(word().capitalize() for _ in range(rng.randint(2, 5)))] if rng.random() < 0.1 else []) + lines

    def wrapped() -> list[str]:
        words = " ".join(sentence() for _ in range(8)).split()
        return [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]

    def noise() -> list[str]:
        kind, some = rng.randrange(8), range(rng.randint(1, 6))
        if kind == 0:
            return [" ".join(word().capitalize() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 8))]
        if kind == 1:
            return [rng.choice((
                "", "", sentence() + " ",
            )) + f" {rng.choice('|»·|')} ".join(word() for _ in range(rng.randint(3, 30))) + rng.choice(("", ".")) for _ in some]
        if kind == 2:
            return [" ".join(word().upper() + "!!" for _ in range(rng.randint(2, 30))) for _ in some]
        if kind == 3:
            return [" ".join(word() + rng.choice("*$%&#") * 3 for _ in range(rng.randint(3, 60))) for _ in some]
        if kind == 4:
            return [rng.choice((
                "Copyright © 2024 ", "All rights reserved. ", "Licensed under the ", "Privacy policy ", "We use cookies ",
                "Sign in ", "Subscribe ", "Click here ", "Share this ",
            )) + " ".join(word() for _ in range(rng.randint(0, 8))) for _ in some]
        if kind == 5:
            return [f"https://www.{word()}.com/{word()}" + f" {word()}" * rng.randint(0, 2) for _ in some]
        if kind == 6:
            times = rng.randint(3, 9)
            return [" ".join(w for w in (word() for _ in range(rng.randint(2, 12))) for _ in range(times)) + rng.choice(("", ".")) for _ in some]
        return [sentence()] * rng.randint(3, 9)

    lines, states = [], []
    for _ in range(rng.randint(1, 4)):
        is_noise = rng.random() < 0.4
        own = noise() if is_noise else wrapped() if rng.random() < 0.15 else prose()
        lines += own
        states += [int(is_noise)] * len(own)
    return lines[:30], states[:30]


@cache
def trained(seed: int = 3) -> Field:
    rng = random.Random(seed)
    made = [_generated(rng) for _ in range(TRAIN_SEQUENCES)]
    t = max(len(s) for _, s in made)
    x, y, held = np.zeros((len(made), t, FEATURES)), np.zeros((len(made), t), int), np.zeros((len(made), t), bool)
    for k, (lines, states) in enumerate(made):
        x[k, : len(states)], y[k, : len(states)], held[k, : len(states)] = line_features(lines), states, True
    return Field().fit(x, y, held)


def content_share(text: str, field: Field) -> float:
    """The share of words that stand in content lines; 0 without words."""
    lines = [x for x in (y.strip(SPACE) for y in text.split("\n")) if x]
    if not lines:
        return 0.0
    words = np.array([len(x.split()) or 1 for x in lines])
    return float(words[field.viterbi(line_features(lines)) == 0].sum() / words.sum())


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None, keep_share: float = KEEP_SHARE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept) of each row.

    Null and empty texts have no words and fail the base rules.  Null ids and repeated rows are
    rows like others; further columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    field = field or trained()

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            own = texts(batch)
            counts = np.array([base_counts(t) for t in own], np.int64)
            n, repeat = counts[:, 0], counts[:, 4]
            failed = (n < MIN_WORDS) | (100 * repeat > 30 * n)
            share = np.array([content_share(t, field) for t in own])
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            return {"doc_id": batch.column("doc_id")} | {c: pa.array(counts[:, k]) for k, c in enumerate(names)} | {
                "base_failed": pa.array(failed), "content_share": pa.array(share),
                "kept": pa.array(~failed & (share >= keep_share)),
            }

        return f

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return arrow_map(
        rows,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean",
        make,
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.col("content_share"),
    )
