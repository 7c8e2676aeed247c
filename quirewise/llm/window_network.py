"""A bidirectional window network in numpy that predicts a masked token from both sides.

Tokens 0 to SHAPES - 1 are shapes of rare words; token SHAPES + r is the word of frequency rank r; the
last one stands beyond a text's ends.  Words of ranks 2^c - 1 to 2^(c+1) - 2 are class c, all shapes are
one class more.  The softmax has two parts: over the classes, and down a binary tree over the class's
words, so a token costs the logarithm of the vocabulary, and probabilities add up to 1 exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHAPES = 32
WINDOW = 3
WIDTH = 16
#: Tokens of one step of training, and of one batch of scoring.
STEP = 8192
RATE = 0.1
#: Rows of a short run of equal tokens or nodes.
SHORT = 4
_OFFSETS = np.array([k for k in range(-WINDOW, WINDOW + 1) if k])


class Codes:
    """Classes and tree paths of the tokens; `levels` classes of words, 2^levels - 1 words in all."""

    def __init__(self, levels: int):
        self.levels, self.words = levels, (1 << levels) - 1
        self.edge = SHAPES + self.words
        self.nodes = (1 << levels) - 1 - levels + SHAPES - 1

    def classes(self, ids: np.ndarray) -> np.ndarray:
        """The class of each token: floor(log2(rank + 1)), or `levels` for shapes."""
        ranks = np.maximum(ids - (SHAPES - 1), 1)
        return np.where(ids < SHAPES, self.levels, np.frexp(ranks.astype(np.float64))[1] - 1)

    def order(self, ids: np.ndarray) -> np.ndarray:
        """The order in which the tokens with the longest paths come first, and those of one node next to each other."""
        length, first, own = self._places(ids)
        return np.argsort((64 - length).astype(np.int64) << 56 | first.astype(np.int64) << 28 | own)

    def _places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length of the path, number of its tree's first node, number of its leaf) of each token."""
        rare = ids < SHAPES
        length = np.where(rare, SHAPES.bit_length() - 1, self.classes(ids)).astype(np.int32)
        first = np.where(rare, self.nodes - SHAPES + 1, (1 << length) - 1 - length).astype(np.int32)
        return length, first, np.where(rare, ids, ids - (SHAPES - 1) - (1 << length)).astype(np.int32)

    def paths(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By depth: the nodes of the tokens that reach it, and whether they go right there; ids in `order`."""
        length, first, own = self._places(ids)
        for depth in range(length[0] if len(length) else 0):
            n = int(np.searchsorted(-length, -depth))
            rest = own[:n] >> (length[:n] - (depth + 1))
            yield first[:n] + (rest >> 1) + ((1 << depth) - 1), (rest & 1).astype(np.float32)


class WindowNetwork:
    """h = sum over positions of gate[position] * embedding[token], its last value 1 (the bias)."""

    PARTS = ("embedding", "nodes", "gate", "top")

    def __init__(self, codes: Codes, masses: np.ndarray | None = None):
        """`masses`: occurrences of the tokens in the corpus; with them the network starts as the unigram model."""
        self.codes = codes
        rng = np.random.default_rng(1)
        self.embedding = rng.normal(0, 0.1, (codes.edge + 1, WIDTH)).astype(np.float32)
        self.nodes, self.gate = np.zeros((codes.nodes, WIDTH), np.float32), np.ones((2 * WINDOW, WIDTH), np.float32)
        self.top = np.zeros((WIDTH, codes.levels + 1), np.float32)
        self.embedding[:, -1] = 0
        if masses is not None:
            self._start(masses + 0.5)
        self.seen = {p: np.ones(len(getattr(self, p)), np.float32) for p in self.PARTS}
        #: How often each row took part, for averages over networks.
        self.used = {p: np.zeros(len(getattr(self, p)), np.float32) for p in self.PARTS}

    def _start(self, masses: np.ndarray) -> None:
        parts = [masses[SHAPES + (1 << c) - 1 : SHAPES + (2 << c) - 1] for c in range(self.codes.levels)] + [masses[:SHAPES]]
        self.top[-1] = np.log([p.sum() for p in parts])
        self.top[-1] -= self.top[-1].max()
        at = 0
        for p in parts:
            for depth in range(len(p).bit_length() - 1):
                left, right = p.reshape(1 << depth, 2, -1).sum(2).T
                self.nodes[at : at + (1 << depth), -1] = np.log(right / left)
                at += 1 << depth

    def hidden(self, line: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(h of the tokens at `place`, the embeddings by position of all places of the line that have a whole window)."""
        own, n = self.embedding.take(line, 0), len(line) - 2 * WINDOW
        # Position by position, the embeddings of neighbouring places lie next to each other: slices, not copies.
        found = [own[WINDOW + k : WINDOW + k + n] for k in _OFFSETS]
        h = found[0] * self.gate[0]
        for x, g in zip(found[1:], self.gate[1:], strict=True):
            h += x * g
        h[:, -1] = 1
        return h.take(place - WINDOW, 0), found

    def log_probabilities(self, line: np.ndarray, place: np.ndarray) -> np.ndarray:
        order = self.codes.order(line.take(place))
        ids = line.take(place.take(order))
        classes = self.codes.classes(ids)
        h, _ = self.hidden(line, place.take(order))
        z = self.top.T @ h.T
        z -= z.max(0)
        own = z[classes, np.arange(len(ids))] - np.log(np.exp(z, out=z).sum(0))
        for node, right in self.codes.paths(ids):
            n = len(node)
            x = np.einsum("mw,mw->m", self.nodes.take(node, 0), h[:n]) * (2 * right - 1)
            own[:n] += np.minimum(x, 0) - np.log1p(np.exp(-np.abs(x)))
        out = np.empty(len(ids), np.float32)
        out[order] = own
        return out

    def learn(self, line: np.ndarray, place: np.ndarray) -> None:
        """One step of Adagrad, with one rate for each row, on the negative log-probability."""
        place = place.take(self.codes.order(line.take(place)))
        ids = line.take(place)
        h, found = self.hidden(line, place)
        p = self.top.T @ h.T
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        p[self.codes.classes(ids), np.arange(len(ids))] -= 1
        back = p.T @ self.top.T
        moves = [("top", np.arange(WIDTH), (p @ h).T, len(ids))]
        for node, right in self.codes.paths(ids):
            n, own = len(node), self.nodes.take(node, 0)
            g = 1 / (1 + np.exp(-np.clip(np.einsum("mw,mw->m", own, h[:n]), -30, 30))) - right
            own *= g[:, None]
            back[:n] += own
            # A node's tokens stand next to each other.
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            moves.append(("nodes", node[starts], _sums(h[:n] * g[:, None], starts), np.diff(starts, append=n)))
        back[:, -1] = 0
        # By place of the line; edges have no gradient.
        n = len(line) - 2 * WINDOW
        spread, there = np.zeros((n, WIDTH), np.float32), np.zeros(n, np.int64)
        spread[place - WINDOW], there[place - WINDOW] = back, 1
        moves.append(("gate", np.arange(2 * WINDOW), np.stack([np.einsum("bw,bw->w", x, spread) for x in found]), len(ids)))
        # What a token of the line is told by all tokens around it, then the sum over the line's equal tokens.
        told, times = np.zeros((len(line), WIDTH), np.float32), np.zeros(len(line), np.int64)
        for k, g in zip(_OFFSETS, self.gate, strict=True):
            told[WINDOW + k : WINDOW + k + n] += spread * g
            times[WINDOW + k : WINDOW + k + n] += there
        order = np.argsort(line, kind="stable")
        token = line.take(order)
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        moves.append(("embedding", token[starts], _sums(told.take(order, 0), starts), np.add.reduceat(times.take(order), starts)))
        for move in moves:
            self._move(*move)

    def _move(self, part: str, rows: np.ndarray, grads: np.ndarray, times) -> None:
        seen, weights = self.seen[part].take(rows), getattr(self, part)
        seen += np.einsum("rw,rw->r", grads, grads) / grads.shape[1]
        self.seen[part][rows] = seen
        weights[rows] = weights.take(rows, 0) - grads * (RATE / np.sqrt(seen))[:, None]
        self.used[part][rows] += times


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at `starts`; most runs are short, and added row by row for all runs at once."""
    sizes = np.diff(starts, append=len(values))
    out = values.take(starts, 0)
    for k in range(1, SHORT):
        at = np.flatnonzero((sizes > k) & (sizes <= SHORT))
        out[at] = out.take(at, 0) + values.take(starts.take(at) + k, 0)
    if (long := sizes > SHORT).any():
        own = sizes[long]
        kept = values if len(own) == len(sizes) else values.take(np.flatnonzero(np.repeat(long, sizes)), 0)
        out[long] = np.add.reduceat(kept, np.cumsum(own) - own, axis=0)
    return out


def batches(texts: list[np.ndarray], edge: int, size: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(line, place, text number) of all tokens of the texts in order, at most `size` at a time.

    A line holds the tokens, WINDOW more on both sides, and the edges between texts.
    """
    gap = np.full(WINDOW, edge, np.int32)
    line = np.concatenate([gap, *(x for t in texts for x in (t.astype(np.int32, copy=False), gap))])
    place = np.flatnonzero(line != edge)
    number = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for lo in range(0, len(place), size):
        own = place[lo : lo + size]
        first = int(own[0]) - WINDOW
        yield line[first : int(own[-1]) + WINDOW + 1], own - first, number[lo : lo + size]
