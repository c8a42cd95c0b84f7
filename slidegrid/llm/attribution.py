"""Token counts of fields and sections, from one encoding of the whole document.

The fields of a row are joined, every field followed by the separator but the last, and the joined text is encoded once, so
tokens that run over a boundary are seen as the model will see them. A field may be cut into sections (lines). Token lengths in
bytes give every token's span; spans and section boundaries are both ascending, so the interval join is a merge by binary
search within the document. Spans are held in bytes, since a byte-level token may end inside a character; ``char_spans`` gives
them in characters.

A token that touches one section counts there. A token that touches several is allocated by an explicit rule:

* ``most``: to the section with most of its bytes, the earlier one on a tie;
* ``start``: to the section with its first byte;
* ``share``: to each in proportion to its bytes.

The counts of a document's sections sum to its number of tokens. A separator belongs to what stands before it. Null fields count
as empty; an empty field is one section with no tokens, so every row gives at least one row per field. Repeated rows are counted
one by one. Texts of any length are encoded whole; memory is a few times one document. Nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is split before merging; fixed value that belongs to the ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("most", "start", "share")


class Tokens:
    """A byte-level encoding and the byte length of each of its tokens."""

    def __init__(self, content: bytes):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def stops(self, text: str) -> np.ndarray:
        """Where each token of the text ends, in bytes."""
        return np.cumsum(self.size[np.array(self.encoding.encode_ordinary(text), dtype=np.int64)])


@lru_cache(maxsize=2)
def tokens_of(content: bytes) -> Tokens:
    return Tokens(content)


def char_spans(text: str, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last character of each token; characters that tokens share are in both spans."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    upto = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    starts = np.r_[0, stops[:-1]].astype(np.int64)
    return upto[starts + 1] - 1, upto[stops]


def allocate(stops: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many tokens each shares with others. ``ends`` are the sections' ends in bytes."""
    starts = np.r_[0, stops[:-1]].astype(np.int64)
    first, last = np.searchsorted(ends, starts, side="right"), np.searchsorted(ends, stops - 1, side="right")
    inside = first == last
    n = np.bincount(first[inside], minlength=len(ends)).astype(np.float64)
    shared = np.zeros(len(ends), dtype=np.int64)
    begins = np.r_[0, ends[:-1]]
    for t in np.flatnonzero(~inside).tolist():
        touched = np.arange(first[t], last[t] + 1)
        overlap = np.minimum(ends[touched], stops[t]) - np.maximum(begins[touched], starts[t])
        touched, overlap = touched[overlap > 0], overlap[overlap > 0]
        shared[touched] += 1
        if rule == "share":
            n[touched] += overlap / overlap.sum()
        else:
            n[touched[0] if rule == "start" else touched[overlap.argmax()]] += 1
    return n, shared


def sections_of(values: list[str], separator: str, cut: list[bool]) -> tuple[str, list[int], list[int], np.ndarray]:
    """The joined text, and per section: field, number in the field, end in bytes."""
    fields, numbers, sizes = [], [], []
    for k, value in enumerate(values):
        whole = value + separator if k + 1 < len(values) else value
        parts = value.split("\n") if cut[k] else [value]
        for i, part in enumerate(parts):
            fields.append(k)
            numbers.append(i)
            sizes.append(len(part.encode()) + (i + 1 < len(parts)))
        sizes[-1] += len(whole.encode()) - len(value.encode())
    joined = separator.join(values)
    return joined, fields, numbers, np.cumsum(sizes)


_OUT = [("section", T.StringType()), ("section_no", T.LongType()), ("n_bytes", T.LongType()), ("n_tokens", T.DoubleType()), ("n_shared", T.LongType())]


def count_tokens(
    docs: DataFrame, fields: tuple[str, ...] = ("text",), lines_of: tuple[str, ...] = (), separator: str = "\n", rule: str = "most",
    keep: tuple[str, ...] = ("doc_id",), path: str = RANKS,
) -> DataFrame:
    """One row per document and section: ``keep``, section (field), section_no, n_bytes, n_tokens, n_shared.

    Fields in ``lines_of`` are cut into lines, each a section with its newline. ``n_shared`` counts tokens that other sections
    touch too. The rank file is read on the driver; tasks get its content (its size is fixed by the file).
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    shared = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    narrow = docs.select(*[F.col(c) for c in keep], *[F.col(c).cast("string").alias(f"__field_{k}") for k, c in enumerate(fields)])
    schema = T.StructType([*narrow.schema.fields[: len(keep)], *[T.StructField(n, t) for n, t in _OUT]])
    cut = [f in lines_of for f in fields]
    names = np.array(fields, dtype=object)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(shared.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                rows, kinds, numbers, sizes, counts, overlaps = [], [], [], [], [], []
                columns = [c.to_pylist() for c in part.columns[len(keep):]]
                for values in zip(*columns, strict=True):
                    text, of_field, number, ends = sections_of([v or "" for v in values], separator, cut)
                    n, both = allocate(tokens.stops(text), ends, rule)
                    rows.append(len(ends))
                    kinds += of_field
                    numbers += number
                    sizes.append(np.diff(ends, prepend=0))
                    counts.append(n)
                    overlaps.append(both)
                at = pa.array(np.repeat(np.arange(len(rows)), rows))
                yield pa.RecordBatch.from_arrays([
                    *[c.take(at) for c in part.columns[: len(keep)]], pa.array(names[kinds].tolist(), pa.string()), pa.array(numbers, pa.int64()),
                    pa.array(np.concatenate(sizes)), pa.array(np.concatenate(counts)), pa.array(np.concatenate(overlaps)),
                ], names=schema.names)

    return narrow.mapInArrow(counted, schema)
