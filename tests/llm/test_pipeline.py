"""The pipeline against the stages' rules applied one by one in plain Python, and the contract of the queries."""

import os
import random
import re

import pytest
from helpers import PROSE, documents
from test_jaccard import plain_kept
from test_quality import plain as plain_quality

import __spark_entry__ as entry
import corpus_pipeline as P
from slidegrid.llm import quality, segmentation

pytestmark = pytest.mark.skipif(not os.path.exists(segmentation.VOCABULARY), reason="the vocabulary is not here")


def prose(lang, k):
    """Words in random order: few windows of three occur twice."""
    return " ".join(random.Random(f"{lang}{k}").choices(PROSE[lang].split(), k=120))


def corpus(spark):
    rows = [(i, prose(lang, i), lang, "abc"[i % 3]) for i, lang in enumerate(["en", "de", "fr"] * 14)]
    rows += [(200 + i, prose("en", 3), "en", "a") for i in range(5)] + [(210, prose("de", 4) + " neu", "de", "b"), (220, "zu kurz", "de", "b"), (221, None, None, None), (3, prose("en", 3), "en", "a")]
    rows += [(222, "\u00a7 12 ! " * 60, "en", "c"), (223, "$$ && " * 60 + prose("fr", 1), "fr", "c")]
    return documents(spark, rows)


def test_stages(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5
    after = []
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in corpus(spark).schema]
        docs.write.parquet(f"{tmp_path}/{len(after)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(after)}")
        after.append(docs.collect())
    first = [r for r in corpus(spark).collect() if r["text"] and re.search(r"[^\W\d_]", r["text"])]
    assert sorted(r["doc_id"] for r in after[0]) == sorted(r["doc_id"] for r in first)
    kept = {r["doc_id"] for r in quality.judge(corpus(spark)).where("kept").collect()}
    assert {r["doc_id"] for r in after[1]} == kept - {221, 222}
    assert all(plain_quality(r["text"])[0] >= 50 for r in after[1])
    least = plain_kept({r["doc_id"]: r["text"] for r in after[1]})
    assert sorted(r["doc_id"] for r in after[2]) == least
    counts = {i: [r["doc_id"] for r in after[3]].count(i) for i in least}
    assert max(counts.values()) <= 2 and sum(counts.values()) > len(least)
    out = P.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in after[3])
    table = segmentation.PieceBytes(segmentation.read_vocabulary(segmentation.VOCABULARY))
    texts = {r["doc_id"]: r["text"] for r in after[3]}
    import numpy as np
    assert all(table.text(np.array(r["ids"])) == texts[r["doc_id"]] and r["n_pieces"] == len(r["ids"]) for r in out)


def test_empty_pipeline(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names and {"op7_quality", "op8_urls"} <= set(entry.oracle_sql())
