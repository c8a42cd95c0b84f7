"""Ranked lexical search: summed accumulators of short lists, then documents at a time over long lists.

Terms are runs of ASCII letters and digits and of code points beyond ASCII, with A-Z in lower case. A first pass over the documents
counts them, their terms, and the documents of every query term (combined per task, so only one number per term and task leaves
it). The second pass cuts each task's documents into blocks, inverts a block for the query terms in memory, and ranks it for every item:

1. term at a time: the short lists are summed into accumulators, which become one more list, ordered by document, with its own bounds;
2. document at a time: that list and the long lists, each with its greatest contribution per window of documents, are walked
   together. Windows whose bounds cannot reach the k-th best score so far are skipped; within the others a document is dropped
   as soon as what it has, and the bounds of the lists still to be read, cannot reach it.

The k-th best score is carried from block to block of a task. What leaves a task is k rows per item; they are ranked in two rounds.
Only documents strictly below the k-th best are skipped, so ties are decided by the document's id, and all scores are exact integers.

The items are read in slices of bounded size, each of which is one pair of passes over the documents. Null texts have no terms;
items without terms, and documents of score 0, give no rows. Repeated documents are separate candidates, repeated rows of an item count once; null ids
come before all others. Rows of one item_id with different texts are ranked apart. Other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Documents and postings of one block, documents of one window, and the share of a block from which on a list is long.
BLOCK_DOCS, BLOCK_POSTINGS, WINDOW, LONG = 16_384, 4_000_000, 128, 1 / 64
#: Bytes of item texts that are searched together.
SLICE_BYTES = 4 << 20
#: Windows that are read first, to raise the k-th best score.
FIRST_WINDOWS = 8
#: Pieces in which the first ranking round deals the candidates of one item.
PIECES = 64
#: Every byte that separates terms becomes a space, A-Z become lower case.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


class _Items:
    """Items of a slice as lists of (term number, occurrences); the terms of all items."""

    def __init__(self, rows: list[tuple]):
        self.ids, self.numbers, self.queries = [], {}, []
        for item_id, text in rows:
            found = Counter(terms_of(text.encode() if text is not None else None))
            if found:
                self.ids.append(item_id)
                self.queries.append([(self.numbers.setdefault(t, len(self.numbers)), n) for t, n in sorted(found.items())])


def _count(documents: DataFrame, numbers: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms, and the documents of every numbered term."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, words = np.zeros(len(numbers), dtype=np.int64), 0, 0
        for batch in batches:
            seen: list[int] = []
            for text in _texts(batch):
                terms = terms_of(text)
                docs += bool(terms)
                words += len(terms)
                seen.extend(numbers[t] for t in numbers.keys() & set(terms))
            held += np.bincount(np.array(seen, dtype=np.int64), minlength=len(numbers))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[some, -1, -2]), pa.array(np.r_[held[some], docs, words])], ["term", "n"])

    rows = documents.select("text").mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row per query term of a slice
    found = {r["term"]: r["n"] for r in rows}
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(k, 0) for k in range(len(numbers))], dtype=np.int64)


def weights(docs: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * h + 1))) for h in held.tolist()], dtype=np.int64)


class _Block:
    """Documents of a block, inverted for the query terms: lists ordered by document, contributions without the term's weight."""

    def __init__(self, terms: array, times: array, sizes: array, lengths: array, docs: int, words: int, n_terms: int, window: int, long: float):
        self.n, self.window = len(sizes), window
        term, tf = np.frombuffer(terms, dtype=np.int32), np.frombuffer(times, dtype=np.int64)
        doc = np.repeat(np.arange(self.n, dtype=np.int32), np.frombuffer(sizes, dtype=np.int64))
        m = 75 + (25 * np.frombuffer(lengths, dtype=np.int64) * docs) // words
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        tf = tf[order]
        self.part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc])
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        size = np.diff(self.start)
        self.long = size > max(1, self.n * long)
        self.windows = -(-self.n // window)
        self.tops: dict[int, np.ndarray] = {}

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[term], self.start[term + 1]
        return self.doc[a:b], self.part[a:b]

    def top_of(self, term: int) -> np.ndarray:
        """The term's greatest contribution in every window."""
        if term not in self.tops:
            docs, part = self.list_of(term)
            at = docs // self.window
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            top = np.zeros(self.windows, dtype=np.int64)
            top[at[first]] = np.maximum.reduceat(part, first)
            self.tops[term] = top
        return self.tops[term]

    def rank(self, query: list[tuple[int, int]], weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all that may be among the k best: none below ``least``, all at or above the k-th best."""
        sums = np.zeros(self.n, dtype=np.int64)
        long: list[tuple[int, int]] = []
        for term, times in query:
            w = int(weight[term]) * times
            if w and self.start[term] < self.start[term + 1]:
                if self.long[term]:
                    long.append((w, term))
                else:
                    docs, part = self.list_of(term)
                    sums[docs] += w * part
        if self.n >= k:
            least = max(least, int(np.partition(sums, self.n - k)[self.n - k]))
        padded = np.zeros(self.windows * self.window, dtype=np.int64)
        padded[:self.n] = sums
        long.sort(key=lambda x: (-x[0] * int(self.top_of(x[1]).max()), x[1]))
        rest = np.zeros((len(long) + 1, self.windows), dtype=np.int64)  # what lists i, i+1, ... can add, by window
        for i in range(len(long) - 1, -1, -1):
            rest[i] = rest[i + 1] + long[i][0] * self.top_of(long[i][1])
        bound = padded.reshape(self.windows, self.window).max(axis=1) + rest[0]
        by_bound = np.argsort(-bound, kind="stable")
        found, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for some in (by_bound[:FIRST_WINDOWS], by_bound[FIRST_WINDOWS:]):
            some = some[bound[some] >= max(least, 1)]
            docs = (some[:, None] * self.window + np.arange(self.window)).ravel()
            docs = np.sort(docs[docs < self.n])
            got = sums[docs]
            for i, (w, term) in enumerate(long):
                stay = got + rest[i][docs // self.window] >= max(least, 1)
                docs, got = docs[stay], got[stay]
                listed, part = self.list_of(term)
                at = np.minimum(np.searchsorted(listed, docs), len(listed) - 1)
                hit = listed[at] == docs
                got[hit] += w * part[at[hit]]
            stay = got >= max(least, 1)
            found, scores = np.r_[found, docs[stay]], np.r_[scores, got[stay]]
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        stay = scores >= least
        return found[stay], scores[stay]


class _Best:
    """The k best of one item so far: highest score first, then null ids, then ids ascending."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.known = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    @property
    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        scores, ids, known = np.r_[self.scores, scores], np.r_[self.ids, ids], np.r_[self.known, known]
        best = np.lexsort((ids, known, -scores))[:self.k]
        self.scores, self.ids, self.known = scores[best], ids[best], known[best]


def _search(documents: DataFrame, items: _Items, k: int, block_docs: int, window: int, long: float) -> DataFrame:
    docs, words, held = _count(documents, items.numbers)
    weight, numbers, queries, names = weights(docs, held), items.numbers, items.queries, items.ids

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in queries]
        terms, times, sizes, lengths, ids = array("i"), array("q"), array("q"), array("q"), []

        def finish() -> None:
            block = _Block(terms, times, sizes, lengths, docs, words, len(numbers), window, long)
            known = np.array([i is not None for i in ids], dtype=bool)
            plain = np.array([i or 0 for i in ids], dtype=np.int64)
            for query, so_far in zip(queries, best):
                at, scores = block.rank(query, weight, k, so_far.least)
                if len(at):
                    so_far.add(scores, plain[at], known[at])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch)):
                found = terms_of(text)
                times_of = Counter(map(numbers.get, found))
                times_of.pop(None, None)
                if not times_of:
                    continue
                terms.extend(times_of.keys())
                times.extend(times_of.values())
                sizes.append(len(times_of))
                lengths.append(len(found))
                ids.append(doc_id)
                if len(ids) >= block_docs or len(terms) >= BLOCK_POSTINGS:
                    finish()
                    terms, times, sizes, lengths, ids = array("i"), array("q"), array("q"), array("q"), []
        if ids:
            finish()
        for i, b in enumerate(best):
            if len(b.scores):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(b.scores), i), pa.int64()), pa.array([names[i]] * len(b.scores), pa.int64()),
                    pa.array(b.ids, mask=~b.known), pa.array(b.scores)], ["item", "item_id", "doc_id", "score"])

    found = documents.select("doc_id", "text").mapInArrow(ranked, "item long, item_id long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    piece = F.pmod(F.xxhash64("doc_id"), F.lit(PIECES))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", piece).orderBy(*order))).where(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")


def search(
    documents: DataFrame, items: DataFrame, k: int = 20, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    block_docs: int = BLOCK_DOCS, window: int = WINDOW, long: float = LONG, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents."""
    docs = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    found = []
    for k_th in range(slices):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k_th)
        rows = sorted(part.collect(), key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, r["text"]))  # a slice of bounded size
        found.append(_search(docs, _Items([tuple(r) for r in rows]), k, block_docs, window, long))
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole
