"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (drawn from the letter's code point, so all workers agree). An n-gram of letters
is the product of its letters' vectors, each rotated by its place; a text is the sum of its n-grams' vectors; a language is the
sum of its training texts, each scaled to its number of n-grams. A text gets the language whose prototype has the largest
cosine with it.

N-grams are taken over lower-cased letters, with one blank for every stretch of other characters and at both ends. Sums are
whole numbers, so prototypes do not depend on the order of rows. Training sends one vector per language and task to a sum;
prototypes (languages x dimensions, at most ``MOST_LANGUAGES`` of them) are the only thing that reaches the driver. Prediction
is one pass without shuffle. A language that holds most rows costs no more than any other.

Texts that are null or have no letter get ``und`` and score 0; so does every text if nothing could be learned. Rows without a
language are not learned from. Ties go to the language that sorts first. Repeated rows are treated one by one. A text longer
than a chunk is taken in chunks that overlap by the n-gram's length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from slidegrid.llm.words import is_held_out

DIMENSIONS, GRAM = 1024, 3
#: ISO 639-3 has under 8,000 languages; prototypes of so many are 40 MB.
MOST_LANGUAGES = 10_000
#: Characters whose n-grams are counted together, n-grams whose vectors are bound together, and rows whose vectors are held together.
CHUNK, BOUND, ROWS = 1 << 18, 2048, 512
UNKNOWN = "und"
#: Cosines of unrelated texts deviate by 1/32; six deviations are above their largest over all languages.
LEAST, FEW_GRAMS = 6 / DIMENSIONS ** 0.5, 32


class Encoder:
    """Turns texts into sums of n-gram vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.dimensions, self.gram = dimensions, gram
        self.number = np.full(0x110000, -1, dtype=np.int32)  # of a letter; 0 is the blank
        self.number[32] = 0
        self.vectors = [self._drawn(32)]

    def _drawn(self, point: int) -> np.ndarray:
        return (np.random.Generator(np.random.Philox(key=point)).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)

    def _numbered(self, points: np.ndarray) -> np.ndarray:
        """Letter numbers, 0 for everything else; new letters get the next numbers."""
        numbers = self.number[points]
        fresh = np.unique(points[numbers < 0])
        if len(fresh):
            for point in fresh.tolist():
                if chr(point).isalpha():
                    self.number[point] = len(self.vectors)
                    self.vectors.append(self._drawn(point))
                else:
                    self.number[point] = 0
            numbers = self.number[points]
        return numbers

    def letters(self, text: str) -> np.ndarray:
        """Letter numbers of a text with single blanks between, before and after; empty without a letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
        numbers = np.r_[0, self._numbered(points), 0]
        keep = np.r_[True, (numbers[1:] != 0) | (numbers[:-1] != 0)]
        out = numbers[keep]
        return out if out.any() else out[:0]

    def grams(self, letters: np.ndarray) -> np.ndarray:
        """One number per n-gram: its letters as digits in base 2^20."""
        n = len(letters) - self.gram + 1
        if n < 1:
            return np.zeros(0, dtype=np.int64)
        codes = np.zeros(n, dtype=np.int64)
        for k in range(self.gram):
            codes = codes << 20 | letters[k:k + n]
        return codes

    def gram_vectors(self, codes: np.ndarray) -> np.ndarray:
        """Bound vectors of distinct n-grams: the product of the letters' vectors, the k-th from the end rotated k times."""
        drawn = np.stack(self.vectors)
        out = np.ones((len(codes), self.dimensions), dtype=np.int8)
        for k in range(self.gram):
            out *= np.roll(drawn, k, axis=1)[codes >> 20 * k & 0xFFFFF]
        return out

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bundled vector (whole numbers) and number of n-grams of each text, in groups of about ``CHUNK`` characters."""
        vectors, sizes = np.zeros((len(texts), self.dimensions)), np.zeros(len(texts), dtype=np.int64)
        group: list[tuple[int, np.ndarray]] = []
        room = CHUNK
        for k, text in enumerate(texts):
            codes = self.grams(self.letters(text))
            sizes[k] = len(codes)
            for begin in range(0, len(codes), CHUNK):
                part = codes[begin:begin + CHUNK]
                if group and (len(part) > room or len(group) == 64):
                    self._add(vectors, group)
                    group, room = [], CHUNK
                group.append((k, part))
                room -= len(part)
        self._add(vectors, group)
        return vectors, sizes

    def _add(self, vectors: np.ndarray, group: list[tuple[int, np.ndarray]]) -> None:
        """Counts of n-grams by text times the n-grams' vectors. Counts below 2^24 are exact in single precision."""
        if not group:
            return
        known, at = np.unique(np.concatenate([c for _, c in group]), return_inverse=True)
        row = np.repeat(np.arange(len(group)), [len(c) for _, c in group])
        counts = np.bincount(row * len(known) + at, minlength=len(group) * len(known)).reshape(len(group), -1)
        for begin in range(0, len(known), BOUND):
            some = slice(begin, begin + BOUND)
            added = counts[:, some].astype(np.float32) @ self.gram_vectors(known[some]).astype(np.float32)
            for r, (k, _) in enumerate(group):
                vectors[k] += added[r]


@lru_cache(maxsize=2)
def encoder(dimensions: int, gram: int) -> Encoder:
    """One per worker; it remembers the letters it has met."""
    return Encoder(dimensions, gram)


def _slices(batch: pa.RecordBatch, text: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with bounded text and at most ``ROWS`` rows."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    begin, room = 0, most
    for i, size in enumerate(sizes.tolist()):
        if i > begin and (size > room or i - begin >= ROWS):
            yield batch.slice(begin, i - begin)
            begin, room = i, most
        room -= size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The prototype of every language in ``docs``; rows without text or language teach nothing.

    A text's vector is divided by its number of n-grams and rounded to 1/4096, so that long texts count like short ones and
    sums stay whole numbers.
    """
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def bundled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = encoder(dimensions, gram), {}
        for batch in batches:
            for part in _slices(batch, 1):
                vectors, sizes = own.sums(part.column(1).to_pylist())
                whole = np.rint(vectors * (4096.0 / np.maximum(sizes, 1))[:, None]).astype(np.int64)
                langs = np.array(part.column(0).to_pylist(), dtype=object)
                for name in set(langs[sizes > 0].tolist()):
                    sums[name] = sums.get(name, 0) + whole[(langs == name) & (sizes > 0)].sum(axis=0)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = labelled.mapInArrow(bundled, "lang string, v array<bigint>")
    places = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    whole = places.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(whole) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; is {lang} a language column?")
    return {r["lang"]: np.array([p["x"] for p in r["v"]], dtype=np.float64) for r in sorted(whole, key=lambda r: r["lang"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", dimensions: int = DIMENSIONS, gram: int = GRAM, pred: str = "lang_pred", score: str = "score", size: str | None = None) -> DataFrame:
    """``docs`` with the predicted language, the cosine with its prototype (0 at least) and, if named, the number of n-grams; these columns must be new."""
    if {pred, score, size} & set(docs.columns):
        raise ValueError(f"columns {pred}, {score} or {size} exist")
    names = sorted(prototypes)
    table = np.stack([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-300) for n in names]) if names else None
    shared = docs.sparkSession.sparkContext.broadcast((names, table))
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType()), *([T.StructField(size, T.LongType())] if size else [])])

    def predicted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(dimensions, gram)
        names, table = shared.value
        for batch in batches:
            column = batch.schema.get_field_index(text)
            for part in _slices(batch, column):
                vectors, sizes = own.sums([x or "" for x in part.column(column).to_pylist()])
                langs, scores = [UNKNOWN] * len(sizes), np.zeros(len(sizes))
                if names:
                    length = np.sqrt((vectors ** 2).sum(axis=1))
                    cosine = (vectors @ table.T) / np.maximum(length, 1e-300)[:, None]
                    best = cosine.argmax(axis=1)
                    for k in np.flatnonzero(sizes > 0).tolist():
                        langs[k] = names[best[k]]
                        scores[k] = min(1.0, max(0.0, float(cosine[k, best[k]])))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores), *([pa.array(sizes)] if size else [])], names=schema.names)

    return docs.mapInArrow(predicted, schema)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", by: int = 4, at: int = 2) -> DataFrame:
    """One row per document: key, held_out (crc32(key) mod ``by`` is ``at``), lang_pred, score; learned from the others."""
    narrow = docs.select(F.col(key).alias(key), F.col(text).alias("text"), F.col(lang).alias("lang"), is_held_out(key, by, at).alias("held_out"))
    prototypes = learn(narrow.where("NOT held_out"), "text", "lang")
    return predict(narrow.select(key, "held_out", "text"), prototypes).select(key, "held_out", "lang_pred", "score")


def keep(docs: DataFrame, least: float = LEAST, key: str = "doc_id", text: str = "text", lang: str = "lang", by: int = 4, at: int = 2) -> DataFrame:
    """The rows of ``docs`` in a known language: not ``und``, and with a cosine of at least ``least``.

    A text of under ``FEW_GRAMS`` n-grams scores low in its own language too and says too little against it; it stays.
    """
    prototypes = learn(docs.where(~is_held_out(key, by, at)), text, lang)
    judged = predict(docs, prototypes, text, pred="__lang_pred", score="__score", size="__grams")
    known = (F.col("__score") >= least) | (F.col("__grams") < FEW_GRAMS)
    return judged.where((F.col("__lang_pred") != UNKNOWN) & known).select(*docs.columns)
