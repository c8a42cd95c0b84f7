"""Document likelihood over the subword lattice.

The model is a unigram model over an existing piece vocabulary. The vocabulary's own scores start it; rounds of expectation
maximisation over the training words then fit one probability per piece, per kind of byte fallback, and for the end of a text.
The probability of a text is the sum over all segmentations of all its words, by forward recursion in log space, times the
end. Words are ASCII-lower-cased ``[^\x20\x09-\x0D]+`` with a word mark in front. A piece has that mark only at its start, so a
text's lattice falls apart at its words and one recursion per distinct word of the corpus is enough.

How it runs: one pass cuts the documents into blocks of bounded size and writes, per block, its distinct words (with their
counts in training documents) and its documents as numbers into that list. Distinct words of all blocks are summed, scored by
the recursion, joined back to the block lists, and meet the documents block by block. So a word is looked up once per block,
not once per occurrence, a very frequent word is one row per block, and a task holds one block. Only sums over pieces (as many
numbers as the vocabulary has) reach the driver. The written tables lie in the shared checkpoint folder.

Null and empty texts consist of the end alone. A null key counts as training. Repeated rows are scored one by one and each
adds to the counts. With no training documents at all, the start model scores.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from slidegrid.llm.lattice import Lattices, Vocabulary, batches_of, code_points, index_of, read_vocabulary
from slidegrid.llm.segmentation import VOCABULARY
from slidegrid.llm.words import is_held_out
from slidegrid.session import scratch_folder

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 16 << 20
#: Rounds of expectation maximisation, each over all training words.
ROUNDS = 2
#: Added to the expected count of every piece.
PRIOR = 0.01
#: Code points with 1, 2, 3, 4 bytes: over how many the mass of a fallback spreads.
_SPREAD = np.log(np.array([1 << 7, 1920, 61440, 1 << 20], dtype=np.float64))
_WORDS = "block long, kind int, key long, held_out boolean, n_tokens long, ids array<int>, counts array<int>, id int, word binary, n long"


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (kind 0) and of words (kind 1). A block's number is its first document's row number."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    trained: Counter = Counter()
    docs: list[tuple] = []
    block, size = None, 0
    for batch in batches:
        for mark, key, held_out, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            block = mark if block is None else block
            words = (text or b"").lower().split()
            if not held_out:
                trained.update(words)
            ids, n = np.unique(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)), return_counts=True)
            docs.append((key, held_out, len(words) + 1, ids, n.astype(np.int32)))
            size += len(text or b"")
            if size >= BLOCK:
                yield from _flushed(block, docs, numbers, trained)
                numbers, trained, docs, block, size = defaultdict(count().__next__), Counter(), [], None, 0
    if docs:
        yield from _flushed(block, docs, numbers, trained)


def _flushed(block: int, docs: list[tuple], numbers: dict[bytes, int], trained: Counter) -> Iterator[pa.RecordBatch]:
    names = ["block", "kind", "key", "held_out", "n_tokens", "ids", "counts", "id", "word", "n"]

    def ragged(k: int) -> pa.Array:
        offsets = np.r_[0, np.cumsum([len(d[k]) for d in docs])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([d[k] for d in docs])))

    n = len(docs)
    none = pa.nulls
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(n, block)), pa.array(np.zeros(n, np.int32)), pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs]),
        pa.array([d[2] for d in docs], pa.int64()), ragged(3), ragged(4), none(n, pa.int32()), none(n, pa.binary()), none(n, pa.int64()),
    ], names=names)
    n, listed = len(numbers), list(numbers)
    lists = pa.list_(pa.int32())
    if n:
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(n, block)), pa.array(np.ones(n, np.int32)), none(n, pa.int64()), none(n, pa.bool_()), none(n, pa.int64()),
            none(n, lists), none(n, lists), pa.array(np.arange(n, dtype=np.int32)), pa.array(listed, pa.binary()),
            pa.array([trained[w] for w in listed], pa.int64()),
        ], names=names)


def start_scores(vocabulary: Vocabulary) -> np.ndarray:
    """The vocabulary's scores, the fallback's spread over the code points it stands for."""
    scores = vocabulary.zipf_scores()
    scores[vocabulary.size: vocabulary.size + 4] -= _SPREAD
    return scores


def _as_runs(words: list[bytes]) -> list[str]:
    return [" " + w.decode("utf-8", "replace") for w in words]


def expected_pieces(vocabulary: Vocabulary, scores: np.ndarray, words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over all segmentations, each word counted by its weight."""
    total, begin = np.zeros(vocabulary.size + 5), 0
    for some in batches_of(_as_runs(words)):
        lattices = Lattices(index_of(vocabulary), *code_points(some))
        before, after = lattices.forward(scores), lattices.backward(scores)
        node, length, piece = lattices.edges()
        owner = lattices.string_of_node()[node]
        share = np.exp(before[node - length] + scores[piece] + after[node] - before[lattices.last][owner])
        total += np.bincount(piece, weights=share * weights[begin:begin + len(some)][owner], minlength=len(total))
        begin += len(some)
    return total


def log_marginals(vocabulary: Vocabulary, scores: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural log of the probability of each word, over all its segmentations."""
    out = []
    for some in batches_of(_as_runs(words)):
        lattices = Lattices(index_of(vocabulary), *code_points(some))
        out.append(lattices.forward(scores)[lattices.last])
    return np.concatenate(out) if out else np.zeros(0)


def fitted(vocabulary: Vocabulary, counts: np.ndarray, texts: int) -> tuple[np.ndarray, float]:
    """Log-probabilities of the pieces and of the end, from expected counts."""
    live = np.r_[np.array(vocabulary.ranks) > 0, np.ones(4, dtype=bool)]
    mass = np.where(live, counts[:-1] + PRIOR, 0.0)
    all_mass = mass.sum() + texts + PRIOR
    scores = np.full(vocabulary.size + 5, -np.inf)
    scores[:-1][live] = np.log(mass[live] / all_mass)
    scores[vocabulary.size: vocabulary.size + 4] -= _SPREAD
    return scores, float(np.log((texts + PRIOR) / all_mass))


def train(words: DataFrame, vocabulary: Vocabulary, texts: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Fits the piece model to ``words`` (word binary, c long: uses in training documents)."""
    spark = words.sparkSession
    pieces = spark.sparkContext.broadcast(vocabulary)
    scores, end = start_scores(vocabulary), float(np.log(1 / 1000))
    for _ in range(rounds if texts else 0):
        now = spark.sparkContext.broadcast(scores)

        def expected(batches: Iterable[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(pieces.value.size + 5)
            for batch in batches:
                total += expected_pieces(pieces.value, now.value, batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

        seen = words.where("c > 0").select("word", "c").mapInArrow(expected, "piece long, uses double")
        counts = np.zeros(vocabulary.size + 5)
        for row in seen.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            counts[row["piece"]] = row["uses"]
        scores, end = fitted(vocabulary, counts, texts)
    return scores, end


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", by: int = 7, at: int = 2, path: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(key) mod ``by`` is ``at`` are held out of training. ``base_score`` is the add-one unigram model over
    whole words and ends; ``score`` is the lattice model's log10 probability.
    """
    spark = docs.sparkSession
    vocabulary = read_vocabulary(path)
    pieces = spark.sparkContext.broadcast(vocabulary)
    folder = scratch_folder(spark)
    narrow = docs.select(
        F.monotonically_increasing_id().alias("mark"), F.col(key).cast("long").alias("key"), is_held_out(key, by, at).alias("held_out"), F.col(text).cast("binary").alias("text")
    )
    narrow.mapInArrow(_blocks, _WORDS).write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    listed = blocks.where("kind = 1").select("block", "id", "word", "n")
    listed.groupBy("word").agg(F.sum("n").alias("c")).write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    texts = blocks.where("kind = 0 AND NOT held_out").count()
    sums: Row = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, distinct = sums["n"] + texts, sums["v"] + (texts > 0)
    scores, end = train(words, vocabulary, texts, rounds)
    now = spark.sparkContext.broadcast(scores)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lp = log_marginals(pieces.value, now.value, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp)], names=["word", "c", "lp"])

    marginals = words.mapInArrow(scored, "word binary, c long, lp double")
    known = listed.select("block", "id", "word").join(marginals, "word").select(F.col("block").alias("block_of"), "id", "c", "lp")
    texts_of = blocks.where("kind = 0").select("block", "key", "held_out", "n_tokens", "ids", "counts")

    def summed(docs: pa.Table, values: pa.Table) -> pa.Table:
        ids = values["id"].to_numpy()
        c, lp = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids))
        c[ids], lp[ids] = values["c"].to_numpy(), values["lp"].to_numpy()
        base = np.log10((c + 1) / (n_all + distinct + 1))
        rows = []
        for own, n in zip(docs["ids"], docs["counts"], strict=True):
            own, n = own.values.to_numpy(), n.values.to_numpy()
            rows.append((int(n[c[own] > 0].sum()) + (texts > 0), float((base[own] * n).sum()), float((lp[own] * n).sum())))
        add = np.log10((texts + 1) / (n_all + distinct + 1))
        return pa.table({
            "key": docs["key"], "held_out": docs["held_out"], "n_tokens": docs["n_tokens"],
            "n_known": pa.array([r[0] for r in rows], pa.int64()), "train_tokens": pa.array(np.full(len(rows), n_all, dtype=np.int64)),
            "base_score": pa.array([r[1] + add for r in rows], pa.float64()), "score": pa.array([(r[2] + end) / np.log(10) for r in rows], pa.float64()),
        })

    out = texts_of.groupBy("block").cogroup(known.groupBy("block_of")).applyInArrow(
        summed, "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.withColumnRenamed("key", key)
