"""op1: N best segmentations against enumeration of all of them, and the round trip."""

import os
import random
import tracemalloc

import pyarrow as pa
import pytest
from helpers import documents

from slidegrid.llm import segmentation as S
from slidegrid.llm.lattice import read_vocabulary

pytestmark = pytest.mark.skipif(not os.path.exists(S.VOCABULARY), reason="the vocabulary is not here")


@pytest.fixture(scope="module")
def segmenter():
    return S.Segmenter(read_vocabulary(S.VOCABULARY), 5)


def everything(segmenter, text):
    """All segmentations of " " + text with their scores, best first."""
    v, scores = segmenter.vocabulary, segmenter.scores
    number = {p: i for i, p in enumerate(v.pieces) if p}
    chars = ["\u2581" if c == " " else None if c == "\u2581" else c for c in " " + text]
    out = []

    def walk(i, score, path):
        if i == len(chars):
            out.append((score, tuple(path)))
            return
        for size in range(1, 17):
            part = chars[i:i + size]
            if len(part) < size:
                break
            piece = None if None in part else number.get("".join(part))
            if piece is not None:
                walk(i + size, score + scores[piece], [*path, piece])
            elif size == 1:
                raw = (part[0] or "\u2581").encode()
                walk(i + 1, score + scores[v.size + len(raw) - 1], [*path, *[v.byte_numbers[b] for b in raw]])

    walk(0, 0.0, [])
    return sorted(out, key=lambda o: -o[0])


def edited(ids, edits):
    ids = list(ids)
    for e in sorted(edits, key=lambda e: -e["at"]):
        ids[e["at"]:e["at"] + e["drop"]] = e["ids"]
    return tuple(ids)


def test_n_best_equals_enumeration(segmenter):
    random.seed(3)
    table = S.PieceBytes(segmenter.vocabulary)
    for _ in range(80):
        text = "".join(random.choice("aetn h \n\u2581\u4f60.") for _ in range(random.randint(1, 10)))
        full = everything(segmenter, text)
        ids, scores, others = segmenter.encode([text])[0]
        assert scores == pytest.approx([s for s, _ in full[:5]], abs=1e-9)
        got = [tuple(ids.tolist()), *[edited(ids.tolist(), o) for o in others]]
        assert len(set(got)) == len(got) == min(5, len(full))
        legal = {p: s for s, p in full}
        assert all(legal[g] == pytest.approx(s, abs=1e-9) for g, s in zip(got, scores, strict=True))
        assert table.text(ids) == text


def test_a_star_needs_no_detours(segmenter):
    """A long run with very many equal segmentations."""
    ids, scores, others = segmenter.encode(["ab" * 3000])[0]
    assert len(scores) == 5 and scores == sorted(scores, reverse=True) and len(others) == 4
    assert S.PieceBytes(segmenter.vocabulary).text(ids) == "ab" * 3000


def test_whole_table(spark):
    docs = documents(spark)
    got = S.decode(S.encode(docs, n=3, keep=("doc_id", "text", "score")), out="decoded").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["decoded"] == r["text"]
        assert (r["ids"] is None) == (r["text"] is None)
    assert S.encode(documents(spark, []), n=2).count() == 0
    with pytest.raises(ValueError):
        S.decode(docs, ids="doc_id", out="text")


def test_a_worker_holds_a_small_part_of_a_batch(monkeypatch):
    rng, vocabulary = random.Random(1), read_vocabulary(S.VOCABULARY)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 10))) for _ in range(20_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(rng.choices(words, k=300)) for _ in range(1500)])], names=["text"])

    def encoded():
        segmenter = S.Segmenter(vocabulary, 4)
        return [(numbers.tolist(), scores, others) for part in S._parts(batch) for numbers, scores, others in segmenter.encode(part.column(0).to_pylist()[:50])]

    segmenter = S.Segmenter(vocabulary, 4)
    tracemalloc.start()
    for part in S._parts(batch):
        segmenter.encode(part.column(0).to_pylist())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 << 20  # 37 MB when the whole batch was segmented together
    small = dict(enumerate(encoded()[:50]))
    monkeypatch.setattr(S, "CHUNK", 8 << 20)
    monkeypatch.setattr(S, "POINTS", 1 << 17)
    assert small == dict(enumerate(encoded()[:50]))
