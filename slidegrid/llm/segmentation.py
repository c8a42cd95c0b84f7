"""SentencePiece encoding with N best segmentations, and decoding.

A text is encoded as `` `` + text with spaces as U+2581. No piece of the vocabulary goes on from a non-space to a space or
touches a newline beside another character (checked on loading), so the lattice of a text falls apart into the lattices of
runs "spaces + non-spaces". Forward Viterbi scores are computed once per distinct run of a batch, for all runs together. They
are the exact cost to go of a search that walks a lattice backward from its end, so A* pops complete segmentations in order
of score, N of them, without detours. The N best of a text combine those of its runs: only the N - 1 runs with the closest
second choice can take part, and a best-first search over their choices yields the N best texts. Second choices of all runs
come from forward and backward scores: the best path through any edge off the best path.

The N best are returned as the numbers of the best one and, for each further one, the stretches in which it differs.

Null texts give null columns and decode to null; empty texts give no pieces, one segmentation of score 0, and decode to "".
Every other text decodes to itself, also with code points outside the vocabulary, runs of spaces and literal U+2581. Ties go to
the earlier run, then to the earlier found segmentation, and are the same on every run. Rows are independent: nothing is
shuffled. Memory follows the longest text of a batch.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from slidegrid.llm.lattice import LITERAL, SPACE, Lattices, Vocabulary, batches_of, code_points, index_of, read_vocabulary

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
RUNS = re.compile(r"\n| *[^ \n]+| +")
#: Bytes of text that are segmented together, and code points of distinct runs whose lattices are held at a time.
CHUNK, POINTS = 1 << 20, 1 << 15
#: Runs whose N best are remembered by a worker.
REMEMBERED = 5_000

EDIT = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("drop", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("scores", T.ArrayType(T.DoubleType())),
    T.StructField("others", T.ArrayType(T.ArrayType(EDIT))),
])
_EDIT = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])


def splits_into_runs(vocabulary: Vocabulary) -> bool:
    """Whether no piece crosses from one run into the next."""
    return not any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in vocabulary.pieces)


def n_best(last: int, before: np.ndarray, edges: list[list[tuple[int, int, float]]], n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of a lattice with nodes 0..last, best first: (score, pieces).

    ``before[node]`` is the best score from the start to the node: what a partial segmentation from the end back to
    that node can still gain, exactly (scores on a binary grid add up without rounding). ``edges[node]`` lists (start, piece, score) of the pieces that end at a node.
    """
    order = count()
    heap: list = [(-before[last], last, next(order), 0.0, None)]  # among equals, the one nearest to the start goes on
    found: list[tuple[float, list[int]]] = []
    while heap and len(found) < n:
        cost, node, _, gained, path = heapq.heappop(heap)
        if node == 0:
            pieces = []
            while path is not None:
                pieces.append(path[0])
                path = path[1]
            found.append((-cost, pieces))
            continue
        for start, piece, score in edges[node]:
            heapq.heappush(heap, (-(gained + score + before[start]), start, next(order), gained + score, (piece, path)))
    return found


def combined(choices: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` least sums of one loss from each ascending list: (sum, index in each list), the smallest first."""
    start = (0,) * len(choices)
    heap, seen, out = [(sum(c[0] for c in choices), start)], {start}, []
    while heap and len(out) < n:
        loss, at = heapq.heappop(heap)
        out.append((loss, at))
        for k, i in enumerate(at):
            if i + 1 < len(choices[k]):
                nxt = (*at[:k], i + 1, *at[k + 1:])
                if nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (loss - choices[k][i] + choices[k][i + 1], nxt))
    return out


class Segmenter:
    def __init__(self, vocabulary: Vocabulary, n: int, scores: np.ndarray | None = None):
        self.vocabulary, self.n = vocabulary, n
        self.index = index_of(vocabulary)
        self.scores = vocabulary.zipf_scores() if scores is None else scores
        self.by_runs = splits_into_runs(vocabulary)
        self.known: dict[str, list[tuple[float, list[int]]]] = {}

    def _numbers(self, piece: int, point: int) -> list[int]:
        """The piece, or the bytes of a code point without one."""
        if piece < self.vocabulary.size:
            return [piece]
        return [self.vocabulary.byte_numbers[b] for b in (SPACE if point == LITERAL else chr(point)).encode()]

    def _best(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best numbers of all runs (flat, count per run), best scores, and losses of the second choices."""
        flats, counts, bests, losses = [], [], [], []
        for some in batches_of(runs, POINTS):
            lattices = Lattices(self.index, *code_points(some))
            before, size = lattices.viterbi(self.scores)
            path = lattices.best_path(size)
            owner = lattices.string_of_node()
            ids = lattices.pieces[path, size[path] - 1].astype(np.int64)
            width = np.where(ids < self.vocabulary.size, 1, ids - self.vocabulary.size + 1)
            flat = np.repeat(ids, width)
            at = np.cumsum(width) - width
            for k in np.flatnonzero(ids >= self.vocabulary.size).tolist():
                flat[at[k]:at[k] + width[k]] = self._numbers(int(ids[k]), int(lattices.points[path[k] - owner[path[k]] - 1]))
            flats.append(flat.astype(np.int32))
            counts.append(np.bincount(owner[path], weights=width, minlength=len(some)).astype(np.int64))
            bests.append(before[lattices.last])
            if self.n > 1:
                after = lattices.viterbi_back(self.scores)
                node, length, piece = lattices.edges()
                through = before[node - length] + self.scores[piece] + after[node]
                on_best = np.zeros(len(before), dtype=bool)
                on_best[path] = True
                through[on_best[node] & (length == size[node])] = -np.inf
                second = np.full(len(some), -np.inf)
                np.maximum.at(second, owner[node], through)
                losses.append(before[lattices.last] - second)
        if not flats:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        return np.concatenate(flats), np.concatenate(counts), np.concatenate(bests), np.concatenate(losses) if losses else np.zeros(0)

    def _choices(self, runs: list[str]) -> list[list[tuple[float, list[int]]]]:
        """For each run its up to n best segmentations by A*: (loss against the best, numbers)."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = [run for run in runs if run not in self.known]
        self.known.update(zip(fresh, self._searched(fresh), strict=True))
        return [self.known[run] for run in runs]

    def _searched(self, runs: list[str]) -> list[list[tuple[float, list[int]]]]:
        out = []
        for some in batches_of(runs, POINTS):
            lattices = Lattices(self.index, *code_points(some))
            before, _ = lattices.viterbi(self.scores)
            for k, run in enumerate(some):
                first, length = int(lattices.first[k]), len(run)
                own = lattices.pieces[first:first + length + 1]
                node, column = np.nonzero(own != self.index.none)
                edges: list[list[tuple[int, int, float]]] = [[] for _ in range(length + 1)]
                for e, w in zip(node.tolist(), (column + 1).tolist(), strict=True):
                    piece = int(own[e, w - 1])
                    edges[e].append((e - w, piece, float(self.scores[piece])))
                found = n_best(length, before[first:first + length + 1].tolist(), edges, self.n)
                base = first - k
                listed = []
                for score, pieces in found:
                    numbers, at = [], 0
                    for piece in pieces:
                        numbers += self._numbers(piece, int(lattices.points[base + at]))
                        at += len(self.vocabulary.pieces[piece]) if piece < self.vocabulary.size else 1
                    listed.append((found[0][0] - score, numbers))
                out.append(listed)
        return out

    def _runs(self, text: str) -> list[str]:
        """The runs of " " + text. One leading space is left out; runs without any begin with NUL instead."""
        if not self.by_runs:
            return [text]
        if "  " in text or " \n" in text or "\0" in text or text[-1] == " " or text[0] == " ":
            return [run[1:] if run[0] == " " and len(run) > 1 and run[1] not in "\0\n" else run if run == "\n" else "\0" + run for run in RUNS.findall(" " + text)]
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            parts = line.split(" ")
            if k:
                out.append("\n")
                parts[0] = "\0" + parts[0]
            elif not parts[0]:
                parts[0] = "\0 "  # a text that begins with a newline: its space stands alone
            out += parts if parts[0] != "\0" else parts[1:]
        return out

    def encode(self, texts: list[str | None]) -> list[tuple | None]:
        """(numbers, scores, edits of the further segmentations) of each text; None for None."""
        kinds: defaultdict[str, int] = defaultdict(count().__next__)
        of_text = []
        for text in texts:
            runs = self._runs(text) if text else []
            of_text.append(np.fromiter(map(kinds.__getitem__, runs), dtype=np.int64, count=len(runs)))
        runs = [run if run[0] == "\n" else run[1:] if run[0] == "\0" else " " + run for run in kinds]
        flat, counts, best, loss = self._best(runs)
        offset = np.cumsum(counts) - counts
        chosen: dict[int, int] = {}
        picks = []
        for own in of_text:
            pick = np.zeros(0, dtype=np.int64)
            if self.n > 1 and len(own):
                near = loss[own]
                bound = np.partition(near, self.n - 2)[self.n - 2] if len(near) >= self.n else np.inf
                close = np.flatnonzero(near <= bound) if np.isfinite(bound) else np.flatnonzero(np.isfinite(near))
                pick = np.sort(close[np.argsort(near[close], kind="stable")[: self.n - 1]])
            picks.append(pick)
            for kind in own[pick].tolist():
                chosen.setdefault(kind, len(chosen))
        choices = self._choices([runs[kind] for kind in chosen])
        out: list[tuple | None] = []
        for text, own, pick in zip(texts, of_text, picks, strict=True):
            if text is None:
                out.append(None)
                continue
            n = counts[own]
            upto = np.cumsum(n)
            numbers = flat[np.repeat(offset[own] - upto + n, n) + np.arange(int(n.sum()))]
            total = float(best[own].sum())
            listed = [choices[chosen[kind]] for kind in own[pick].tolist()]
            scores, others = [], []
            for spare, at in combined([[c[0] for c in run] for run in listed], self.n):
                scores.append(total - spare)
                if any(at):
                    others.append([
                        {"at": int(upto[p] - n[p]), "drop": int(n[p]), "ids": listed[k][i][1]} for k, (p, i) in enumerate(zip(pick.tolist(), at, strict=True)) if i
                    ])
            out.append((numbers, scores, others))
        return out


@lru_cache(maxsize=2)
def segmenter_of(vocabulary: Vocabulary, n: int) -> Segmenter:
    """One per worker."""
    return Segmenter(vocabulary, n)


def encode(docs: DataFrame, text: str = "text", n: int = 4, path: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",), verify: bool = False) -> DataFrame:
    """``keep``, then ids (best segmentation), scores (of up to ``n``, best first), others (edits that turn ids into the next ones).

    With ``verify`` a last column round_trip tells whether the ids decode to the text (null for null).

    The vocabulary file is read on the driver; its pieces (their number is fixed by the file) go to the tasks.
    """
    vocabulary = read_vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    narrow = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    schema = T.StructType([*narrow.schema.fields[:-1], *ENCODED.fields, *([T.StructField("round_trip", T.BooleanType())] if verify else [])])

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = segmenter_of(shared.value, n)
        table = PieceBytes(shared.value) if verify else None
        for batch in batches:
            for part in _parts(batch):
                texts = part.column(part.num_columns - 1).to_pylist()
                rows = segmenter.encode(texts)
                same = [None if r is None else table.text(r[0]) == x for r, x in zip(rows, texts, strict=True)] if table else []
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:-1],
                    _lists([None if r is None else r[0] for r in rows]),
                    pa.array([None if r is None else r[1] for r in rows], type=pa.list_(pa.float64())),
                    pa.array([None if r is None else r[2] for r in rows], type=pa.list_(pa.list_(_EDIT))),
                    *([pa.array(same, type=pa.bool_())] if verify else []),
                ], names=schema.names)

    return narrow.mapInArrow(encoded, schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``CHUNK`` bytes of text, which is its last column."""
    sizes = pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False)
    begin, room = 0, CHUNK
    for i, size in enumerate(sizes.tolist()):
        if size > room and i > begin:
            yield batch.slice(begin, i - begin)
            begin, room = i, CHUNK
        room -= size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = np.array([0 if r is None else len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate([r for r in rows if r is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([r is None for r in rows]))


def decode(encoded: DataFrame, ids: str = "ids", out: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``encoded`` with the text of the piece numbers in column ``out``, which must be new. Null stays null."""
    if out in encoded.columns:
        raise ValueError(f"column {out} exists")
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceBytes(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = pa.array([table.text(x.values.to_numpy()) if x.is_valid else None for x in column], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return encoded.mapInArrow(decoded, schema)


class PieceBytes:
    """The UTF-8 bytes of every piece number behind one another."""

    def __init__(self, vocabulary: Vocabulary):
        raw = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
        for b, number in enumerate(vocabulary.byte_numbers):
            raw[number] = bytes([b])
        self.size = np.array([len(r) for r in raw], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def text(self, numbers: np.ndarray) -> str:
        n = self.size[numbers]
        at = np.repeat(self.start[numbers] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return self.flat[at].tobytes()[1:].decode("utf-8", "replace")
