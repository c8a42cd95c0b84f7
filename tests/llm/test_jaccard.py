"""The pipeline's near-duplicate stage: planted near copies by exact Jaccard similarity of five-word shingles."""

import random

import numpy as np

import corpus_pipeline as P
from helpers import documents
from slidegrid.llm import jaccard as J


def varied(k, n=200):
    return random.Random(k).choices([f"w{i}" for i in range(3000)], k=n)


def plain_shingles(text):
    ws = text.lower().split()
    return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def plain_kept(texts):
    """Smallest id of every component of pairs of similarity 0.8 or more, from all pairs."""
    sets, root = {i: plain_shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in sets:
        for j in sets:
            if j < i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return sorted(set(root.values()))


def planted():
    rng, texts = random.Random(8), {}
    for k in range(12):
        base = varied(k)
        texts[100 * k] = " ".join(base)
        for c in range(1, 9):  # one to eight words replaced: similarity from about 0.95 down to about 0.67
            words = list(base)
            for at in rng.sample(range(len(words)), c):
                words[at] = f"new{k}x{c}x{at}"
            texts[100 * k + c] = " ".join(words)
    chain = varied(99)
    for c in range(20):  # each link of the chain is near its neighbours only
        chain = list(chain)
        chain[10 * c] = f"link{c}"
        chain[(10 * c + 5) % 200] = f"other{c}"
        texts[5000 + c] = " ".join(chain)
    texts |= {6000: "", 6001: " ", 6002: "Two words", 6003: "two WORDS", 6004: "two word"}
    return texts


def test_stage_removes_planted_near_copies(spark):
    texts = planted()
    docs = documents(spark, [(i, t, "en", "a") for i, t in texts.items()] + [(0, texts[0], "en", "a")])
    kept = P.near_duplicate_stage(spark, docs, "")
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == plain_kept(texts)


def test_a_large_group_below_the_similarity(spark, monkeypatch):
    """Copies that resemble the original, but often not each other: every component is found, in one block and in many."""
    rng, base, texts = random.Random(3), varied(1, 150), {}
    for c in range(90):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randrange(1, 9)):
            words[at] = f"n{c}x{at}"
        texts[c] = " ".join(words)
    docs = documents(spark, [(i, t, "en", "a") for i, t in texts.items()])
    for sets in (J.BLOCK_SETS, 13):
        monkeypatch.setattr(J, "BLOCK_SETS", sets)
        assert sorted(r["doc_id"] for r in J.one_of_each(docs).collect()) == plain_kept(texts)


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(J, "_COLUMNS", 7)
    rng = np.random.default_rng(1)
    sides = [[np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(n)] for n in (5, 8)]
    assert J.shared_counts(*sides).tolist() == [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]


def test_awkward_tables(spark):
    """Null ids and texts, repeated rows, columns that clash with inner names, a map column, and an empty table."""
    schema = "doc_id long, text string, `set` string, key long, root int, `a.b` string, m map<string,int>"
    text = " ".join(varied(7, 80))
    rows = [(2, text, "s", 1, 1, "d", {"a": 1, "b": 2}), (1, text + " more", "s", 1, 1, "d", {"b": 2}), (1, text + " more", "s", 1, 1, "d", {"b": 2}), (None, text, "s", 1, 1, "d", None),
            (5, None, "s", 1, 1, "d", None), (6, "", "s", 1, 1, "d", None), (None, "lonely words", "s", 1, 1, "d", None)]
    docs = spark.createDataFrame(rows, schema)
    kept = J.one_of_each(docs)
    assert kept.schema == docs.schema and sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 5, None]
    assert J.one_of_each(docs.limit(0)).count() == 0


def test_candidates_meet_at_anchors(spark):
    """Without any band key in common, fingerprints within reach of the covering code give candidates, and the shingles decide."""
    base = varied(4)
    near = [*base[:-1], "other"]
    texts = {11: " ".join(base), 12: " ".join(near), 13: " ".join([*near, "tail"]), 14: " ".join(varied(5)), 15: " ".join(varied(6)), 16: ""}
    prints = {11: 0b1011, 12: 0b1000, 13: 0b1000, 14: 0b1011, 15: -1, 16: None}
    sets = spark.createDataFrame([(i, prints[i], []) for i in texts], "set long, fp long, keys array<long>")
    held = spark.createDataFrame(list(texts.items()), "set long, text string")
    found = J.links(sets, lambda some: held.join(some, "set"))
    assert sorted(map(tuple, found.collect())) == [(12, 11), (13, 12)]


def test_sketch_has_the_majority_of_its_shingles():
    text = " ".join(varied(2, 40)).encode()
    hashes = np.unique(np.concatenate(list(J.shingle_hashes(text, 5))))
    want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))
    assert J.sketch(text)[1] % (1 << 64) == want and J.sketch(b" ")[1:] == (None, [])


def test_components_are_found_once(spark, monkeypatch):
    """The second search for components takes only what blocks add: links between the roots of the first, if there are any."""
    asked, search = [], J.components

    def counted(edges):
        asked.append({x for r in edges.collect() for x in r})
        return search(edges)

    monkeypatch.setattr(J, "components", counted)
    near = [*varied(4)[:-1], "other"]
    docs = documents(spark, [(i, " ".join(t), "en", "a") for i, t in enumerate([varied(4), near, varied(5)])])
    assert sorted(r["doc_id"] for r in J.one_of_each(docs).collect()) == [0, 2]
    assert len(asked) == 1 and len(asked[0]) == 2
    asked.clear()
    texts = planted()
    docs = documents(spark, [(i, t, "en", "a") for i, t in texts.items()])
    assert sorted(r["doc_id"] for r in J.one_of_each(docs).collect()) == plain_kept(texts)
    assert len(asked) == 1 or len(asked[1]) < len(asked[0])
