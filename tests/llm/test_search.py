"""op12: every score and rank against a plain count, with blocks and windows small enough that skipping happens."""

import math
import random
import re
from collections import Counter

import pytest

from helpers import documents, prose
from slidegrid.llm import search as S

WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in set(items):
        asked = Counter(terms(text))
        rows = []
        for doc_id, c in held:
            m = 75 + (25 * sum(c.values()) * n_docs) // words
            score = sum(
                n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, n in asked.items() if t in c)
            if score > 0:
                rows.append((-score, doc_id is not None, doc_id or 0))
        out += [(item_id, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, **kw):
    frame = spark.createDataFrame([(t, i, "x") for i, t in items], "text string, item_id long, rank string")
    return sorted((tuple(r) for r in S.search(docs, frame, **kw).collect()), key=str)


ITEMS = [(1, "The house, of the RIVER!"), (2, prose("de", 3)), (3, None), (4, ""), (5, "nothing known"), (6, "Café 你好 café"), (7, "long tail long"), (7, "q1x9 sea"),
         (7, "q1x9 sea"), (None, "road"), (8, "!!! ..."), (9, prose("fr", 2) + " " + prose("en", 1))]


@pytest.mark.parametrize("kw", [{}, {"block_docs": 5, "window": 2, "long": 0.1}, {"block_docs": 9, "window": 3, "long": 0.0}, {"slice_bytes": 100}, {"long": 2.0}])
def test_ranks_equal_a_plain_count(spark, kw):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(spark, docs, ITEMS, **kw) == plain(rows, ITEMS)
    assert got(spark, docs, ITEMS, k=3, **kw) == plain(rows, ITEMS, 3)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, "same words here", None, None) for i in range(60, 0, -1)] + [(None, "same words here", None, None), (7, "same words here", None, None)]
    rows += [(100 + i, "other", None, None) for i in range(200)]
    docs = documents(spark, rows)
    for kw in ({}, {"block_docs": 8, "window": 2}):
        found = got(spark, docs, [(1, "words")], **kw)
        assert [r[2] for r in sorted(found, key=lambda r: r[1])] == [None, 1, 2, 3, 4, 5, 6, 7, 7, *range(8, 19)]


def test_skipping_loses_nothing(spark):
    """A skewed vocabulary: rare terms in short lists, frequent ones in long lists."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    odds = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, odds, k=rng.randrange(1, 80))), None, None) for i in range(900)]
    items = [(i, " ".join(rng.choices(vocabulary, odds, k=12))) for i in range(12)]
    docs = documents(spark, rows).repartition(3)
    want = plain([(r[0], r[1]) for r in rows], items)
    for kw in ({"block_docs": 128, "window": 8, "long": 0.05}, {"block_docs": 400, "window": 4, "long": 0.2}):
        assert got(spark, docs, items, **kw) == want


def test_windows_are_skipped():
    """The first windows raise the k-th best score, and no list is read for documents that cannot reach it."""
    block = object.__new__(S._Block)
    import numpy as np

    n, window = 1000, 10
    block.n, block.window, block.windows, block.tops = n, window, n // window, {}
    block.doc = np.r_[np.arange(n), np.arange(5)].astype(np.int32)
    block.part = np.r_[np.full(n, 10), np.full(5, 900)].astype(np.int64)
    block.start, block.long = np.array([0, n, n + 5]), np.array([True, True])
    found, scores = block.rank([(0, 1), (1, 1)], np.array([1, 1]), 5, 0)
    assert sorted(found.tolist()) == [0, 1, 2, 3, 4] and set(scores.tolist()) == {910}


def test_empty_tables(spark):
    assert got(spark, documents(spark, []), ITEMS) == []
    assert got(spark, documents(spark), []) == []
