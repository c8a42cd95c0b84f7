"""op9: fingerprints bit by bit, the covering property, links and components against all pairs."""

import random
from collections import Counter

import numpy as np
import xxhash
from helpers import documents, prose, words

from slidegrid.llm import simhash as S


def plain_fingerprint(text):
    ws = [w.encode().lower() for w in words(text)]
    parts = [b" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] if len(ws) > 2 else [b" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_classes(fps):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {f: root(f) for f in fps}


def test_fingerprints(monkeypatch):
    texts = ["", None, "One", "one TWO", "a b c", prose("de", 2), " \u00c9t\u00e9 A\u00e9 b\tc\nd ", "x " * 700]
    for chunk in (S.CHUNK_BYTES, 50):
        monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
        assert [S.fingerprint(t and t.encode()) & (1 << 64) - 1 for t in texts] == [plain_fingerprint(t) for t in texts]


def test_every_value_has_one_home_and_meets_its_neighbours():
    random.seed(4)
    for _ in range(300):
        x = random.getrandbits(64)
        y = x ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 2)))
        fps = np.array([x, y], dtype=np.uint64).view(np.int64)
        place, anchor, home = S.anchors_of(fps)
        assert np.bincount(place[home]).tolist() == [1, 1]
        assert set(anchor[(place == 0) & home]) <= set(anchor[place == 1])
    codewords = {v ^ int(p) for v in range(1 << 12) for p in S._patterns(0)[0][0][S._syndromes(np.array([v]))[0]: S._syndromes(np.array([v]))[0] + 1]}
    assert len(codewords) <= 1 << 12


def linked(spark, fps, **kw):
    edges = S.links(spark.createDataFrame([(f,) for f in set(fps)], "fp long"), **kw)
    return {r["fp"]: r["root"] for r in S.components(edges).collect()}


def test_components_equal_all_pairs(spark):
    random.seed(9)
    fps = []
    for _ in range(60):
        f = random.getrandbits(64)
        for _ in range(random.randint(1, 12)):  # chains of steps of up to three bits
            fps.append(f)
            f ^= sum(1 << b for b in random.sample(range(64), random.randint(1, 3)))
    centre = random.getrandbits(64)
    fps += [centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)]  # a dense ball
    fps = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    want = plain_classes(fps)
    for limit in (4096, 20):  # whole anchors, and anchors dealt into pieces
        got = linked(spark, fps, at_home=limit)
        groups = lambda m: Counter(frozenset(f for f in m if m[f] == r) for r in set(m.values()))
        assert groups({f: got.get(f, f) for f in want}) == groups(want)


def test_table(spark):
    docs = documents(spark)
    got = S.near_duplicates(docs).collect()
    rows = docs.collect()
    prints = {(r["doc_id"]): plain_fingerprint(r["text"]) for r in rows}
    assert len(got) == len(rows)
    roots = plain_classes(list(prints.values()))
    least = {}
    for i, f in prints.items():
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    for g in got:
        assert g["fingerprint"] & (1 << 64) - 1 == prints[g["doc_id"]]
        assert g["component_id"] == least.get(roots[prints[g["doc_id"]]])
    kept = S.one_of_each(docs)
    assert kept.schema == docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted({min((i for i in prints if i is not None and roots[prints[i]] == r), default=None) for r in set(roots.values())}, key=str)
    assert S.near_duplicates(documents(spark, [])).count() == 0 and S.one_of_each(documents(spark, [])).count() == 0
