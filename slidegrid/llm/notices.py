"""Fuzzy search for short license notices.

A notice of up to k edits, cut into k + 1 pieces, holds at least one piece unchanged (pigeonhole). All pieces of all notices
are found in one walk over a text; each hit names a window that could hold its notice, and the ``regex`` library's bounded-error
matching decides there and reports span and edits. Texts are compared in lower case with single spaces between words
``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (letters, digits and everything beyond ASCII).

Rows are independent, so nothing is shuffled. Null texts count as empty: no words, no places, empty labels, score 0. A text
may be of any length; memory is a few times one text. Of notices whose spans overlap, the one with the fewest edits, then the
longest, then the first in the table is reported. Exact phrases of the base table always keep their label.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

#: Phrases that count exactly, with their labels; fixed values.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Notice:
    """A short notice in normal form. ``edits`` bounds the insertions, deletions and substitutions together."""

    phrase: str
    label: str
    edits: int


#: About one edit in ten characters.
NOTICES = (
    Notice("released under the mit license", "mit", 3),
    Notice("licensed under the mit license", "mit", 3),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    Notice("licensed under the apache license version 2 0", "apache-2", 4),
    Notice("licensed under cc by nc 4 0", "cc-by-nc", 2),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 4),
    Notice("licensed under cc by 4 0", "cc-by", 2),
    Notice("licensed under cc by sa 4 0", "cc-by-sa", 2),
    Notice("licensed under the gnu general public license version 2", "gpl-2", 5),
    Notice("licensed under the gnu general public license version 3", "gpl-3", 5),
    Notice("licensed under the gnu lesser general public license", "lgpl", 5),
    Notice("licensed under the gnu affero general public license", "agpl", 5),
    Notice("subject to the terms of the mozilla public license", "mpl", 5),
    Notice("redistribution and use in source and binary forms with or without modification", "bsd", 7),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 7),
)

_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPANS = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()),
    T.StructField("edits", T.IntegerType()), T.StructField("similarity", T.DoubleType()), T.StructField("found", T.StringType()),
]))


def normal_words(data: bytes) -> list[bytes]:
    return data.translate(_NORMAL).split()


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """The phrase cut into ``edits + 1`` parts of nearly equal length: (offset, part)."""
    cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Searcher:
    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for offset, part in pieces(notice.phrase, notice.edits):
                seeds.setdefault(part, []).append((k, offset))
        self.seeds = ahocorasick.Automaton()
        for part, uses in seeds.items():
            self.seeds.add_word(part, (len(part), uses))
        self.seeds.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(n.phrase)}){{e<={n.edits}}}") for n in notices]

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Per notice, the merged stretches of the text in which it can stand."""
        out: dict[int, list[list[int]]] = {}
        for last, (size, uses) in self.seeds.iter(text):
            for k, offset in uses:
                n = self.notices[k]
                begin = max(0, last + 1 - size - offset - n.edits)
                end = min(len(text), last + 1 - size - offset + len(n.phrase) + n.edits)
                own = out.setdefault(k, [])
                if own and begin <= own[-1][1] and begin >= own[-1][0]:
                    own[-1][1] = max(own[-1][1], end)
                else:
                    own.append([begin, end])
        return out

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """Verified matches (edits, notice, start, end) that don't overlap a better one."""
        found = set()
        for k, stretches in self.windows(text).items():
            for begin, end in stretches:
                todo = [(begin, end)]
                while todo:
                    low, high = todo.pop()
                    m = self.patterns[k].search(text, low, high)
                    if m is None:
                        continue
                    a, b = m.span()
                    todo += [(low, a), (b, high)]  # the best match of the stretch comes first; others may stand on both sides
                    while a < b and text[a] == " ":
                        a += 1
                    while b > a and text[b - 1] == " ":
                        b -= 1
                    found.add((sum(m.fuzzy_counts), k, a, b))
        kept: list[tuple[int, int, int, int]] = []
        for hit in sorted(found, key=lambda h: (h[0], -len(self.notices[h[1]].phrase), h[1], h[2])):
            if all(hit[3] <= x[2] or x[3] <= hit[2] for x in kept):
                kept.append(hit)
        return sorted(kept, key=lambda h: h[2])


@lru_cache(maxsize=4)
def _searcher(notices: tuple[Notice, ...]) -> Searcher:
    return Searcher(notices)


def base_places(joined: bytes) -> list[tuple[int, str]]:
    """Places (word, label) of the base phrases in space-joined words, overlapping ones included."""
    padded, out = b" " + joined + b" ", []
    for phrase, label in BASE:
        sought = f" {phrase} ".encode()
        at = padded.find(sought)
        while at >= 0:
            out.append((padded.count(b" ", 0, at), label))
            at = padded.find(sought, at + 1)
    return out


def scan_text(data: bytes | None, notices: tuple[Notice, ...] = NOTICES) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of one text."""
    words = normal_words(data or b"")
    joined = b" ".join(words)
    base = base_places(joined)
    text = joined.decode("utf-8", "replace")
    searcher, spans = _searcher(notices), []
    for edits, k, a, b in searcher.matches(text):
        phrase = notices[k].phrase
        spans.append({
            "label": notices[k].label, "first_word": text.count(" ", 0, a), "end_word": text.count(" ", 0, b) + 1,
            "edits": edits, "similarity": max(0.0, 1.0 - edits / len(phrase)), "found": text[a:b],
        })
    at, base_labels = [w for w, _ in base], {label for _, label in base}
    return (
        len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)),
        ",".join(sorted(base_labels | {s["label"] for s in spans})), 1.0 if base else max((s["similarity"] for s in spans), default=0.0), spans,
    )


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS),
])


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """The columns ``keep`` of ``docs`` and what was found in each text; ``spans`` lists label, words, edits and wording."""
    narrow = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    schema = T.StructType([*narrow.schema.fields[:-1], *_FOUND.fields])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([
        ("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64()), ("found", pa.string())]))]

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            rows = [scan_text(x.as_py(), notices) for x in texts]
            found = [pa.array([r[i] for r in rows], type=kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=schema.names)

    return narrow.mapInArrow(scanned, schema)
