"""Personal data by candidate gradient boosting.

Base spans follow the contract's patterns and always stay.  Generators of high recall propose further,
overlapping candidates: national and 00-prefixed phone numbers, written-out addresses, cards inside
longer digit runs, IPv6, and secrets (tokens, keys and passwords that are given a value), a kind that
only the method finds.  Boosted trees score each candidate from its format, its context and the list it
stands in; scores are calibrated on held-out examples, and for each kind the least threshold that
reaches PRECISION there selects what is added.  Trained here on generated, labelled texts with up to
MOST_ITEMS things each, alone, in prose and in lists (no corpus has such labels).
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from bisect import bisect_left
from collections import Counter
from functools import cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .boosting import Boosted
from .common import arrow_map, col, small_batches, table, texts

KINDS = ("email", "ip", "card", "phone")
#: The base kinds, and those that only the method finds.
ALL_KINDS = (*KINDS, "secret")
PRECISION = 0.98
TRAIN_TEXTS = 3000
MOST_ITEMS = 12
#: Characters of context on each side that features see.
CONTEXT = 32
#: Things of one kind belong to one list if at most so many characters are between them.
LIST_GAP = 32
#: Characters of a line before a thing that are searched for words that name its kind.
LINE = 80

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match never ends inside a run of digits, so runs are entered at their first digit only.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_AT = re.compile(r"[\[({<]\s?(?:at|@)\s?[\])}>]", re.I)
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?| dot )"
_HOST = re.compile(rf"\s?[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}})+", re.I)
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:.])")
_CARDS = (
    re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    re.compile(r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    re.compile(r"(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])"),
)
_PHONES = (
    re.compile(r"(?<![0-9+.(])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?0?[0-9]{2,4}\)?[ ./-][0-9]{3,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])"),
    re.compile(r"(?<![0-9+.])(?:00[1-9]|0[1-9])[0-9]{7,12}(?![0-9])"),
)
_SECRET = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|auth[_ -]?key|credentials?)\b[\"']?\s?(?:=|:|is)\s?[\"']?([^\s\"',;]{5,}[^\s\"',;.!?)\]}>#])", re.I)
_BEARER = re.compile(r"\b(?:bearer|basic)\s([A-Za-z0-9._~+/=-]{7,}[A-Za-z0-9_~+/=-])", re.I)
# How keys of well-known services and signed tokens begin.
_KNOWN = re.compile(r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)*)(?![A-Za-z0-9_-])")
# Anything long of letters and digits, with at least three digits among them.
_MIXED = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9][A-Za-z_+/-]*[0-9][A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{20,}={0,2}")
#: Words that stand next to each kind, and next to numbers that are no personal data.
_NEAR = {
    "email": re.compile(r"e-?mail|contact|write|reach|mail|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip(v6)?\b|address|host|server|login|client|addr|gateway|node", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment", re.I),
    "phone": re.compile(r"phone|tel\b|tel[.:]|call|mobile|fax|cell|whatsapp|handy|téléphone|telefon|teléfono|móvil", re.I),
    "secret": re.compile(r"token|secret|passw|pwd|key|auth|credential", re.I),
}
_AGAINST = re.compile(
    r"version|isbn|issn|order|invoice|serial|tracking|article|patent|page|chapter|section|id\b|no\.|nr\.|#|\bv$|release|sku|build|hash|ticket|bestell|commande|at \d|time|forgot|reset|change|lost",
    re.I,
)
_TOKEN = re.compile(r"[A-Za-z0-9._~+/=-]+")
_HANDED = re.compile(r"(?:=|:|\bis|bearer|basic)\s?[\"']?$", re.I)
_DIGEST = re.compile(r"\b(?:sha-?\d*|md5|digest|checksum|commit|hash|uuid|etag|integrity|build|file|path|data|base64)\b|https?:|/", re.I)
_NUMBERS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Around each @: all local characters before it, and the domain behind it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = _local_start(text, at, free)
            if start < at:
                out.append((start, m.end()))
                free = m.end()
                at = text.find("@", free)
                continue
        at = text.find("@", at + 1)
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the contract's order."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _NUMBERS.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))] if "." in text else []
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) that the generators propose."""
    found = [(0, a, b) for a, b in _written_out_addresses(text)]
    if ":" in text:
        found += [(1, m.start(), m.end()) for m in _COLONS.finditer(text)]
    if _NUMBERS.search(text):
        found += [(2, m.start(), m.end()) for p in _CARDS for m in p.finditer(text)]
        found += [(3, m.start(), m.end()) for p in _PHONES for m in p.finditer(text)]
    secrets = [(m.start(1), m.end(1)) for p in (_SECRET, _BEARER) for m in p.finditer(text)]
    secrets += [m.span() for m in _KNOWN.finditer(text)]
    if _NUMBERS.search(text):
        secrets += [m.span() for m in _MIXED.finditer(text) if any(map(str.isalpha, m.group()))]
    return sorted({*found, *((4, a, b) for a, b in _widest(secrets))})


def _widest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie in no other."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def _written_out_addresses(text: str) -> list[tuple[int, int]]:
    """Around each bracketed or spelt-out at sign: all local characters before it, and a host behind it."""
    signs = [(m.start(), m.end()) for m in _AT.finditer(text)]
    for word in (" at ", " AT "):
        at = text.find(word)
        while at >= 0:
            signs.append((at, at + len(word)))
            at = text.find(word, at + 1)
    out = []
    for a, b in signs:
        end = a - (text[a - 1 : a].isspace() if text[a] != " " else 0)
        if m := _HOST.match(text, b):
            start = _local_start(text, end, free := max((e for _, e in out[-1:] if e <= end), default=0))
            if free <= start < end:
                out.append((start, m.end()))
    return out


def _local_start(text: str, end: int, least: int) -> int:
    """Where the local characters before `end` begin; it looks further back only as long as all belong."""
    start, width = end, 64
    while start > least:
        low = max(least, end - width)
        start = low + len(text[low:start].rstrip(_LOCAL))
        if start > low:
            break
        width *= 4
    return start


def _valid_v6(value: str) -> bool:
    try:
        return ipaddress.ip_address(value).version == 6
    except ValueError:
        return False


def _entropy(value: str) -> float:
    return -sum(n / len(value) * log2(n / len(value)) for n in Counter(value).values())


class Lists:
    """The lists that a text's spans stand in: spans of one kind with small gaps; a list has the words before its head."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        self.text, self.heads, self.sizes, self.titles = text, {}, {}, {}
        for kind in range(len(ALL_KINDS)):
            own, head, last = sorted((a, b) for k, a, b in spans if k == kind), None, 0
            for a, b in own:
                if head is None or a > last + LIST_GAP:
                    head, last = a, b
                last = max(last, b)
                self.heads[kind, a] = head
                self.sizes[kind, head] = self.sizes.get((kind, head), 0) + 1

    def features(self, kind: int, start: int, end: int) -> list[float]:
        text, head = self.text, self.heads[kind, start]
        own = text[start:end]
        before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        near, small = _NEAR[ALL_KINDS[kind]], own.lower()
        if (kind, head) not in self.titles:
            title = text[max(0, head - CONTEXT) : head]
            self.titles[kind, head] = bool(near.search(title)), bool(_AGAINST.search(title))
        line = text[max(text.rfind("\n", max(0, start - LINE), start) + 1, start - LINE, 0) : start]
        digits = "".join(c for c in own if "0" <= c <= "9")
        groups = _NUMBERS.findall(own)
        shape = [
            kind, len(own), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
            bool(digits) and luhn(digits), bool(digits) and digits[0] in "3456", digits.startswith("0"), digits.startswith("00"), len(set(digits)),
            len({c for c in own if not c.isalnum()}), "(" in own, "[" in own or "{" in own or "<" in own, "." in own, "-" in own, "/" in own,
            "dot" in small, own.count(":"), sum(map(str.isalpha, own)) / len(own), "::" in own, kind == 1 and _valid_v6(own),
            _entropy(own) if kind == 4 else 0, sum(c in "0123456789abcdef" for c in small) / len(own) if kind == 4 else 0, any(map(
                str.isupper, own,
            )) and any(map(str.islower, own)), small.isalpha(), kind == 4 and bool(_KNOWN.match(own)), kind == 4 and min(99, len({*own})),
        ]
        context = [
            bool(near.search(before)), bool(near.search(after)), self.titles[kind, head][0], bool(near.search(line)),
            bool(_AGAINST.search(before)), self.titles[kind, head][1], bool(_AGAINST.search(line)),
            bool(before) and before[-1].isalnum(), bool(before) and before[-1] in "$€£#=/.,", bool(before) and before[-1] in "\"'",
            bool(after) and after[0].isalnum(), bool(after) and after[0] in "%€$/=", "=" in before[-4:], min(4, self.sizes[kind, head]), start == head,
            kind == 4 and bool(_HANDED.search(before)), kind == 4 and bool(_DIGEST.search(before)),
        ]
        return shape + context


def _training_text(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up text and the true spans in it."""
    word = lambda: "".join(rng.choices("etaoinshrdlucmfwypvbgk", k=rng.randint(2, 9)))
    words = lambda low, high: " ".join(word() for _ in range(rng.randint(low, high)))
    text, true = words(0, 8), []

    def put(part: str) -> None:
        nonlocal text
        text += part

    items = rng.choice((1, 1, 2, 3, 5, MOST_ITEMS))
    kind, real, listed = rng.randrange(len(ALL_KINDS)), rng.random() < 0.5, rng.random() < 0.5
    for k in range(items):
        if not listed:
            kind, real = rng.randrange(len(ALL_KINDS)), rng.random() < 0.5
        value = _value(rng, word, kind, real)
        first = not listed or k == 0 or rng.random() < 0.4
        put(rng.choice((" ", ". ", "\n", ", ", "; ")) if not listed or first else rng.choice((", ", "\n", " / ", " or ", "; ")))
        if not listed:
            put(words(0, 6) + " ")
        if first:
            put(_cue(rng, word, kind, real, value) + rng.choice((" ", ": ", " ")))
        quote = rng.choice(("", "", '"', "'")) if kind == 4 else ""
        if kind == 4:
            put(_handed(rng, word, real, value) + quote)
        elif kind == 2 and real and rng.random() < 0.4:  # next to other numbers, where the base pattern fails
            put(_value(rng, word, 2, False).replace("-", "") + " " if rng.random() < 0.7 else "".join(rng.choices("0123456789", k=4)) + " ")
        if real:
            true.append((kind, len(text), len(text) + len(value)))
        put(value + quote)
    put(rng.choice((" ", ". ", ", ", "\n", *((" !!", " ###") if kind == 4 else ("!!", "###")))) + words(0, 8))
    return text, true


def _handed(rng: random.Random, word, real: bool, value: str) -> str:
    """What stands before a secret, or before something that looks like one."""
    named = rng.choice(("token", "password", "api_key", "secret", "API key", "pwd", "access key", "credentials")) + rng.choice((" = ", "=", ": ", " is "))
    if not real and len(value) >= 20:  # a digest, an identifier, encoded data
        return rng.choice(("sha256 ", "commit ", "checksum: ", "uuid ", "etag=", "build ", "md5: ", "file ", "data:", word() + " ", "id=", "https://" + word() + ".org/"))
    if real and rng.random() < 0.25 and len(value) >= 16 and _TOKEN.fullmatch(value):
        return rng.choice(("Bearer ", "Authorization: Bearer ", "basic ", *("",) * bool(_KNOWN.fullmatch(value))))
    return named


def _cue(rng: random.Random, word, kind: int, real: bool, value: str) -> str:
    own = (
        ["email", "contact", "write to", "mail", ""], ["ip", "host", "from address", "server", ""],
        ["card", "visa", "credit card", "payment by", ""], ["phone", "tel.", "call", "mobile:", "fax", ""], ["my", "the", ""],
    )[kind]
    if not real and kind in (0, 1, 3):
        return rng.choice(("version", "order no.", "invoice", "isbn", "serial", "tracking id", "", "", word()))
    cue = rng.choice(own) if real or kind == 4 or rng.random() < 0.15 else rng.choice(("version", "order no.", "invoice", "isbn", "serial", "", word()))
    return "call" if real and kind == 3 and value[0] not in "(0" and not cue else cue


def _value(rng: random.Random, word, kind: int, real: bool) -> str:
    """Something of a kind, or something that looks like it."""
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    if kind == 0:
        at, dot = rng.choice([
            (" [at] ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" {AT} ", "."),
            (" [@] ", "."), ("<at>", " dot "), (" AT ", " dot "), (" at ", "."),
        ])
        if real:
            name = word() + rng.choice((".", "_", "")) + rng.choice((word(), d(2), word()[:1]))
            found = f"{name}{at}{word()}{rng.choice(('', '', d(1), d(3)))}{dot}{rng.choice(('com', 'org', 'net', 'de', 'io', 'co.uk', 'fr', 'info'))}"
            return found.upper() if rng.random() < 0.1 else found
        return rng.choice((
            f"{word()} at {word()} dot {word()} dot", f"{word()} (at) {word()}.{word().capitalize()}",
            f"{word()} at {word()} dot {word()}", f"{word()} at {word()}.{word()}", f"{word()} at {d(1)}.{d(2)}",
        ))
    if kind == 1:
        g = lambda: f"{rng.randrange(1, 65536):x}"
        if real:
            return rng.choice((
                ":".join(g() for _ in range(8)), f"2001:db8::{g()}", f"fe80::{g()}:{g()}:{g()}", "::1",
                f"2a0{d(1)}:{g()}:{g()}::{g()}", f"{g()}:{g()}:{g()}::",
            ))
        letters = lambda: "".join(rng.choices("abcdef", k=rng.randint(1, 4)))
        return rng.choice((
            f"{letters()}::{letters()}", f"{letters()}::", f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", f"{d(1)}:{d(2)}:{d(2)}",
            f"{d(2)}:{d(2)}:{d(2)}", ":".join(d(1) for _ in range(5)), ":".join(f"{rng.randrange(256):02x}" for _ in range(6)),
        ))
    if kind == 2:
        if real:
            n = rng.choice((13, 15, 16, 16, 16))
            body = rng.choice("3456") + d(n - 2)
            x = next(body + c for c in "0123456789" if luhn(body + c))
            return x if rng.random() < 0.5 or n != 16 else rng.choice(" -").join(x[i : i + 4] for i in range(0, 16, 4))
        x = d(rng.choice((16, 16, 13, 14, 19)))
        x = x[:-1] + str((int(x[-1]) + 1) % 10) if luhn(x) else x
        return x if rng.random() < 0.7 or len(x) != 16 else "-".join(x[i : i + 4] for i in range(0, 16, 4))
    if kind == 3:
        a, b, c = rng.choice("23456789") + d(2), d(3), d(4)
        if real:
            return rng.choice((
                f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{a} {b} {c}", f"00{rng.randint(1, 99)} {a} {b} {c}", f"0{a}/{b}{d(1)}-{c}",
                f"0{d(9)}", f"{a}.{b}.{c}",
            ))
        return rng.choice((
            f"{d(4)}-{d(4)}-{d(4)}", f"{a} {b} {c}", f"{d(3)}-{d(4)}-{d(4)}-{d(2)}", f"20{d(2)}-{d(3)} {d(4)}", f"0{d(12)}",
            f"{d(3)}.{d(3)}.{d(3)}", f"978-{d(3)}-{d(4)}-{d(2)}",
        ))
    if real:
        symbols = rng.choice((
            "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
            "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!$%&*?",
        ))
        if rng.random() < 0.15:
            return rng.choice((word() + d(rng.randint(1, 4)) + word(), word() + word() + d(rng.randint(2, 4)), word().capitalize() + rng.choice("!$_") + d(2)))
        if rng.random() < 0.1:
            return ".".join(("eyJ" if k == 0 else "") + "".join(rng.choices(_LOCAL[:62], k=rng.choice((20, 80, 400)))) for k in range(3))
        if rng.random() < 0.1:
            return "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))
        return rng.choice(("", "", "ghp_", "sk-")) + "".join(rng.choices(symbols, k=rng.choice((10, 16, 20, 32, 40, 64, 200, 800, 5000)) - 1)) + rng.choice("adefkmx3578")
    if rng.random() < 0.4:
        hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
        return rng.choice((hexes(40), hexes(64), hexes(32), "-".join(map(hexes, (8, 4, 4, 4, 12))), word() + "_" + word() + "_" + d(8), "/".join(word() for _ in range(5)) + "/" + d(4), "".join(rng.choices(_LOCAL[:62], k=rng.choice((60, 600)))) + "=="))
    return rng.choice((
        word() + word(), word() + word().capitalize(), "required", "forgotten", "missing.", f"<{word()}>",
        "${" + word().upper() + "}", "********", "function(" + word() + ")", "xxxxxxxx", "string", word() + "_" + word(),
    ))


@cache
def trained(seed: int = 9) -> tuple[Boosted, tuple[float, ...]]:
    """The calibrated trees and each kind's threshold (above 1 where none is precise enough)."""
    rng = random.Random(seed)
    x, y, fold = [], [], []
    for k in range(TRAIN_TEXTS):
        text, true = _training_text(rng)
        base = base_spans(text)
        more = _clear_of(candidates(text), base)
        lists = Lists(text, base + more)
        for c in more:
            x.append(lists.features(*c))
            y.append(c in true)
            fold.append(k % 4)
    x, y, fold = np.array(x, float), np.array(y, float), np.array(fold)
    model = Boosted.fit(x[fold < 2], y[fold < 2]).calibrate(x[fold == 2], y[fold == 2])
    held, truth = model.chances(x[fold == 3]), y[fold == 3]
    kinds, limits = x[fold == 3][:, 0], []
    for k in range(len(ALL_KINDS)):
        p, t = held[kinds == k], truth[kinds == k]
        order = np.argsort(-p)
        right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        # Only where equal chances end, and never below even odds.
        ends = np.flatnonzero(np.append(p[order][1:] < p[order][:-1], True) & (right >= PRECISION) & (p[order] >= 0.5)) if len(p) else []
        limits.append(float(p[order][ends[-1]]) if len(ends) else 2.0)
    return model, tuple(limits)


def found_spans(text: str, model: Boosted, limits: tuple[float, ...]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans): likely candidates that overlap no span already there are added, the likeliest first."""
    base = base_spans(text)
    more = _clear_of(candidates(text), base)
    if not more:
        return base, base
    lists = Lists(text, base + more)
    chance = model.chances(np.array([lists.features(*c) for c in more], float))
    likely = [(c, float(p)) for c, p in zip(more, chance, strict=True) if p >= limits[c[0]]]
    return base, sorted(base + _chosen(likely))


def _chosen(likely: list[tuple[tuple[int, int, int], float]]) -> list[tuple[int, int, int]]:
    """Of spans with chances those that overlap no likelier chosen one; ties go to the first by kind and place."""
    out: list[tuple[int, int, int]] = []
    starts: list[int] = []
    # Spans that reach into each other, directly or by others, are settled together; there are few of them.
    ordered = sorted(likely, key=lambda x: x[0][1:])
    lo = 0
    while lo < len(ordered):
        hi, reach = lo + 1, ordered[lo][0][2]
        while hi < len(ordered) and ordered[hi][0][1] < reach:
            reach = max(reach, ordered[hi][0][2])
            hi += 1
        starts, held = [], []
        for c, _ in sorted(ordered[lo:hi], key=lambda x: (-x[1], x[0])):
            at = bisect_left(starts, c[1])
            if (at == 0 or held[at - 1][2] <= c[1]) and (at == len(held) or held[at][1] >= c[2]):
                starts.insert(at, c[1])
                held.insert(at, c)
        out += held
        lo = hi
    return out


def _clear_of(spans: list[tuple[int, int, int]], others: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that overlap none of the others."""
    if not others or not spans:
        return spans
    ordered = sorted((s, e) for _, s, e in others)
    starts, reach = np.array([s for s, _ in ordered]), np.maximum.accumulate([e for _, e in ordered])
    at = np.searchsorted(starts, [e for _, _, e in spans], side="left") - 1
    return [s for s, k in zip(spans, at.tolist(), strict=True) if k < 0 or reach[k] <= s[1]]


def written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans[, redacted]) of each row.

    Counts by kind are of base spans, n_spans is of all; `redacted` has [KIND] in place of each span.
    Null and empty texts have no spans; a text may have any length and number of spans.  Null ids and
    repeated rows are rows like others; further columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    model, limits = trained()

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            own = texts(batch)
            pairs = [found_spans(t, model, limits) for t in own]
            counts = np.array([np.bincount([s[0] for s in base], minlength=4) if base else (0, 0, 0, 0) for base, _ in pairs], np.int64)
            out = {"doc_id": batch.column("doc_id")} | {f"n_{k}": pa.array(counts[:, i]) for i, k in enumerate(KINDS)}
            out |= {
                "base_sha256": [hashlib.sha256(written_out(b).encode()).hexdigest() for b, _ in pairs],
                "spans": [written_out(a) for _, a in pairs], "n_spans": [len(a) for _, a in pairs],
            }
            return out | ({"redacted": [redacted(t, a) for t, (_, a) in zip(own, pairs, strict=True)]} if redact else {})

        return f

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    kinds = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return arrow_map(rows, kinds + ", redacted string" * redact, make)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, free = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= free:
            out += [text[free:a], f"[{ALL_KINDS[k].upper()}]"]
        free = max(free, b)
    return "".join([*out, text[free:]])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
