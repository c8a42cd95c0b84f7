"""op2: the lattice model and the base model against brute force over all segmentations."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents, words

from slidegrid.llm import likelihood as L
from slidegrid.llm.lattice import read_vocabulary

pytestmark = pytest.mark.skipif(not os.path.exists(L.VOCABULARY), reason="the vocabulary is not here")


def all_paths(vocabulary, scores, word):
    number = {p: i for i, p in enumerate(vocabulary.pieces) if p}
    text = "\u2581" + word

    def walk(i):
        if i == len(text):
            yield 0.0, Counter()
        for size in range(1, min(16, len(text) - i) + 1):
            piece = number.get(text[i:i + size])
            if piece is None and size == 1:
                piece = vocabulary.size + len(text[i].encode()) - 1
            if piece is not None:
                for s, used in walk(i + size):
                    yield s + scores[piece], used + Counter({piece: 1})

    return list(walk(0))


def test_recursions_equal_enumeration():
    v = read_vocabulary(L.VOCABULARY)
    scores = L.start_scores(v)
    some = ["the", "houses", "\u4f60x", "zzzz"]
    lp = L.log_marginals(v, scores, [w.encode() for w in some])
    uses = np.zeros(v.size + 5)
    for w, x in zip(some, lp, strict=True):
        paths = all_paths(v, scores, w)
        assert x == pytest.approx(math.log(sum(math.exp(s) for s, _ in paths)), abs=1e-9)
        for s, used in paths:
            for piece, n in used.items():
                uses[piece] += 2.0 * n * math.exp(s - x)
    assert np.allclose(L.expected_pieces(v, scores, [w.encode() for w in some], np.full(4, 2.0)), uses)


def test_scores_of_a_table(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    held = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    lower = [[w.encode().lower() for w in words(r["text"])] for r in rows]
    counts = Counter(w for ws, h in zip(lower, held, strict=True) if not h for w in ws)
    ends = held.count(False)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = Counter()
    for r, h, ws in zip(rows, held, lower, strict=True):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        want[(r["doc_id"], h, len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n, round(base, 6))] += 1
    got = L.score(docs).collect()
    assert Counter((g["doc_id"], g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 6)) for g in got) == want
    assert all(g["score"] < 0 for g in got)
    fitted, start = sum(g["score"] for g in got), sum(g["score"] for g in L.score(docs, rounds=0).collect())
    assert fitted > start  # training raises the likelihood


def test_empty_tables(spark):
    assert L.score(documents(spark, [])).count() == 0
    alone = L.score(documents(spark, [(5, None, None, None)])).first()
    assert alone["n_tokens"] == 1
