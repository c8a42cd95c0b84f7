"""Piece lattices of many short strings at once, over an existing SentencePiece vocabulary.

The strings of a batch lie behind one another in one array of code points. Their edges (piece, start, end) are found for all
positions together by growing a rolling hash as long as it is the prefix of some piece. The recursions over a lattice then run
position by position for all strings that are long enough. Costs are linear in the length of the strings; memory is bounded by
the batch, which the callers keep small.

A code point without a piece has one edge, its UTF-8 bytes (``Vocabulary.size`` + number of bytes - 1 as piece number).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

SPACE = "▁"
#: Stands for a literal U+2581, which must not read as a space: beyond all code points, so it has no piece.
LITERAL = 0x110000
GRID = float(1 << 24)
SLOT_BITS = 18
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by number ("" where a number is no ordinary piece), their ranks from 1, and the numbers of the 256 bytes."""

    pieces: tuple[str, ...]
    ranks: tuple[int, ...]
    byte_numbers: tuple[int, ...]

    @property
    def size(self) -> int:
        return len(self.pieces)

    def zipf_scores(self) -> np.ndarray:
        """Natural log-probabilities by Zipf and Mandelbrot from the ranks, with the byte fallback 10 below the least.

        They lie on a binary grid, so that sums are exact and equal segmentations have equal scores.

        The stored scores of a merge vocabulary are ranks, not log-probabilities; the law turns one into the other.
        """
        rank = np.array(self.ranks, dtype=np.float64)
        live = rank > 0
        p = np.where(live, 1.0 / (rank + 2.7), 0.0)
        scores = np.full(self.size + 5, -np.inf)
        scores[: self.size][live] = np.round(np.log(p[live] / p.sum()) * GRID) / GRID
        scores[self.size: self.size + 4] = scores[: self.size][live].min() - 10.0
        return scores


@lru_cache(maxsize=4)
def read_vocabulary(path: str) -> Vocabulary:
    """Reads a SentencePiece model file; the order of its scores gives the ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
    pieces = tuple(model.id_to_piece(i) if plain[i] else "" for i in range(n))
    ranks = [0] * n
    for rank, i in enumerate(sorted((i for i in range(n) if plain[i]), key=lambda i: (-model.get_score(i), i)), 1):
        ranks[i] = rank
    return Vocabulary(pieces, tuple(ranks), tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256)))


class PieceIndex:
    """Hashes of all prefixes of all pieces: piece number, or -1 for a prefix that is no piece."""

    def __init__(self, vocabulary: Vocabulary):
        self.size = vocabulary.size
        self.none = vocabulary.size + 4
        self.width = max((len(p) for p in vocabulary.pieces), default=1)
        known: dict[int, int] = {}
        for number, piece in enumerate(vocabulary.pieces):
            h = 0
            for i, c in enumerate(piece):
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                known.setdefault(h, -1)
                if i == len(piece) - 1:
                    if known[h] >= 0 and vocabulary.pieces[known[h]] != piece:
                        raise ValueError("two pieces share a hash")
                    known[h] = number if known[h] < 0 else known[h]
        keys = np.fromiter(known, dtype=np.uint64, count=len(known))
        values = np.fromiter(known.values(), dtype=np.int32, count=len(known))
        self.shift = np.uint64(64 - SLOT_BITS)
        slot = self._slots(keys)
        order = np.argsort(slot, kind="stable")
        slot, keys, values = slot[order], keys[order], values[order]
        first = np.searchsorted(slot, np.arange(1 << SLOT_BITS))
        self.count = np.bincount(slot, minlength=1 << SLOT_BITS).astype(np.int8)
        self.layers = []
        for depth in range(int(self.count.max(initial=0))):
            k, v = np.zeros(1 << SLOT_BITS, dtype=np.uint64), np.full(1 << SLOT_BITS, -2, dtype=np.int32)
            has = np.flatnonzero(self.count > depth)
            k[has], v[has] = keys[first[has] + depth], values[first[has] + depth]
            self.layers.append((k, v))

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h * _MIX) >> self.shift).astype(np.int64)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Piece number, -1 for a mere prefix, -2 for neither."""
        slot = self._slots(h)
        out = np.full(len(h), -2, dtype=np.int32)
        for depth, (keys, values) in enumerate(self.layers):
            if depth == 0:
                same = keys[slot] == h
                out[same] = values[slot[same]]
            else:
                deep = np.flatnonzero(self.count[slot] > depth)
                hit = deep[keys[slot[deep]] == h[deep]]
                out[hit] = values[slot[hit]]
        return out


_INDEXES: dict[int, PieceIndex] = {}


def index_of(vocabulary: Vocabulary) -> PieceIndex:
    """One index per vocabulary and worker."""
    key = hash(vocabulary.pieces)
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = PieceIndex(vocabulary)
    return _INDEXES[key]


def code_points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings behind one another, spaces as U+2581, and the strings' lengths."""
    flat = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    flat = np.where(flat == ord(SPACE), LITERAL, np.where(flat == 32, ord(SPACE), flat))
    return flat, np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))


class Lattices:
    """The lattices of a batch of non-empty strings. Node = position in the flat array + number of the string."""

    def __init__(self, index: PieceIndex, points: np.ndarray, lengths: np.ndarray):
        self.index, self.points, self.lengths = index, points, lengths
        self.width = min(index.width, int(lengths.max(initial=1)))
        starts = np.cumsum(lengths) - lengths
        self.string_of = np.repeat(np.arange(len(lengths)), lengths)
        self.first = starts + np.arange(len(lengths))
        self.last = self.first + lengths
        self.pieces = np.full((len(points) + len(lengths), self.width), index.none, dtype=np.int32)
        stop = (starts + lengths)[self.string_of]
        live = np.arange(len(points))
        h = np.zeros(len(points), dtype=np.uint64)
        for size in range(1, self.width + 1):
            live = live[live + size <= stop[live]]
            if not len(live):
                break
            grown = h[live] * _BASE + points[live + size - 1].astype(np.uint64) + np.uint64(1)
            found = index.look_up(grown)
            hit = found >= 0
            at = live[hit]
            self.pieces[at + size + self.string_of[at], size - 1] = found[hit]
            if size == 1:
                bare = live[~hit]
                self.pieces[bare + 1 + self.string_of[bare], 0] = index.size + _utf8_size(points[bare]) - 1
            alive = found > -2
            h[live[alive]] = grown[alive]
            live = live[alive]
        order = np.argsort(-lengths, kind="stable")
        self._first, self._last = self.first[order], self.last[order]
        self._reach = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0)) + 1), side="right")

    def _steps_from_start(self, scores: np.ndarray):
        """For t = 1, 2, ...: the nodes t after their start, their predecessors, and edge scores."""
        back = np.arange(1, self.width + 1)
        for t in range(1, len(self._reach)):
            nodes = self._first[: self._reach[t]] + t
            w = min(t, self.width)
            yield nodes, nodes[:, None] - back[:w], scores[self.pieces[nodes, :w]]

    def _steps_from_end(self, scores: np.ndarray):
        ahead = np.arange(1, self.width + 1)
        for t in range(1, len(self._reach)):
            nodes = self._last[: self._reach[t]] - t
            w = min(t, self.width)
            after = nodes[:, None] + ahead[:w]
            yield nodes, after, scores[self.pieces[after, ahead[:w] - 1]]

    def viterbi(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score from the start to each node, and the length of the last piece there."""
        best = np.zeros(len(self.pieces))
        size = np.zeros(len(self.pieces), dtype=np.int64)
        for nodes, before, edge in self._steps_from_start(scores):
            total = best[before] + edge
            size[nodes] = (pick := total.argmax(axis=1)) + 1
            best[nodes] = total[np.arange(len(nodes)), pick]
        return best, size

    def viterbi_back(self, scores: np.ndarray) -> np.ndarray:
        """Best score from each node to the end."""
        best = np.zeros(len(self.pieces))
        for nodes, after, edge in self._steps_from_end(scores):
            best[nodes] = (best[after] + edge).max(axis=1)
        return best

    def forward(self, scores: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all segmentations from the start to each node."""
        total = np.zeros(len(self.pieces))
        for nodes, before, edge in self._steps_from_start(scores):
            total[nodes] = _log_sum(total[before] + edge)
        return total

    def backward(self, scores: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.pieces))
        for nodes, after, edge in self._steps_from_end(scores):
            total[nodes] = _log_sum(total[after] + edge)
        return total

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All edges: (end node, length, piece)."""
        node, column = np.nonzero(self.pieces != self.index.none)
        return node, column + 1, self.pieces[node, column]

    def string_of_node(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths + 1)

    def best_path(self, size: np.ndarray) -> np.ndarray:
        """End nodes of the pieces of all best paths, in order."""
        on = np.zeros(len(self.pieces), dtype=bool)
        at = self.last.copy()
        first = self.first
        while len(at):
            on[at] = True
            at = at - size[at]
            more = at > first
            at, first = at[more], first[more]
        return np.flatnonzero(on)


def _utf8_size(points: np.ndarray) -> np.ndarray:
    """Bytes of each code point in UTF-8; the stand-in for U+2581 has that point's three."""
    return np.where(points == LITERAL, 3, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int32)


def _log_sum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(axis=1)
    return top + np.log(np.exp(terms - top[:, None]).sum(axis=1))


def batches_of(strings: list[str], points: int = 1 << 17) -> list[list[str]]:
    """The strings in their order, cut where another ``points`` code points are full; a batch exceeds them by one string."""
    if not strings:
        return []
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    filled = (np.cumsum(sizes) - sizes) // points
    cuts = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(strings)]
    return [strings[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
