"""op4: held-out accuracy, the algebra of the vectors, and awkward texts."""

import random

import numpy as np
import pyarrow as pa
from helpers import PROSE, documents, prose

from slidegrid.llm import language as H


def test_vectors_equal_a_plain_loop():
    own = H.Encoder(64, 3)
    text = "Ab  c\u00e9! 9 ba"
    letters = " ab c\u00e9 ba "
    vector = {c: own._drawn(ord(c)).astype(int) for c in set(letters)}
    want = sum(np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c] for a, b, c in zip(letters, letters[1:], letters[2:], strict=False))
    got, sizes = own.sums([text, "", "123", "x"])
    assert (got[0] == want).all() and sizes.tolist() == [len(letters) - 2, 0, 0, 1]


def test_long_text_in_chunks(monkeypatch):
    whole, _ = H.Encoder(32, 3).sums([prose("en", 1, 400)])
    monkeypatch.setattr(H, "CHUNK", 100)
    parts, _ = H.Encoder(32, 3).sums([prose("en", 1, 400)])
    assert (whole == parts).all()


def test_held_out_accuracy(spark):
    docs = documents(spark)
    got = H.identify(docs).collect()
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["lang"] for r in docs.where("doc_id < 100").collect()}
    held = [(g["lang_pred"], truth[g["doc_id"]]) for g in got if g["held_out"] and g["doc_id"] in truth]
    assert held and sum(a == b for a, b in held) / len(held) >= 0.95
    by_id = {g["doc_id"]: g for g in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (100, 101, 102, 103))
    assert all(0 <= g["score"] <= 1 and g["lang_pred"] in {*PROSE, "und"} for g in got)


def test_nothing_to_learn(spark):
    assert H.identify(documents(spark, [])).count() == 0
    assert H.identify(documents(spark, [(1, "word", None, None)])).first()["lang_pred"] == "und"


def test_keep_returns_the_rows(spark):
    docs = documents(spark)
    kept = H.keep(docs)
    assert kept.schema == docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(range(42)) <= set(ids) and not {100, 101, 102, 103} & set(ids) and ids.count(106) == 2


def test_keep_drops_unlearned_languages_and_random_letters(spark):
    rng = random.Random(1)
    clean = [(i, prose(lang, i), lang, "a") for i, lang in enumerate(["en", "de", "fr"] * 14)] + [(50, "Von.", "de", "a")]
    words = "nie jest to si\u0119 na w z do \u017ce jak ale po co tak za od jego by\u0142 tylko przez dla s\u0105 czy ju\u017c mo\u017ce dom rzeka ludzie droga morze stary".split()
    foreign = [(100 + i, " ".join(rng.choices(words, k=100)), None, "a") for i in range(20)]
    for k, (first, n) in enumerate([(97, 26), (0x430, 32), (0x4E00, 4096), (0x3B1, 25)]):
        letters = [chr(first + i) for i in range(n)]
        foreign += [(200 + 20 * k + i, " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(100)), None, "a") for i in range(20)]
    kept = {r["doc_id"] for r in H.keep(documents(spark, clean + foreign)).collect()}
    assert kept == {r[0] for r in clean}


def test_a_worker_holds_few_rows_at_a_time():
    """Vectors of a batch are held for at most 512 rows; the slices together are the batch."""
    batch = pa.record_batch({"text": [f"text {k}" for k in range(3000)]})
    parts = list(H._slices(batch, 0))
    assert max(p.num_rows for p in parts) <= 512 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
