"""op5: allocation against a walk over every byte."""

import os

import numpy as np
import pytest
from helpers import documents

from slidegrid.llm import attribution as A

pytestmark = pytest.mark.skipif(not os.path.exists(A.RANKS), reason="the ranks are not here")


@pytest.mark.parametrize("rule", A.RULES)
def test_allocation_equals_a_walk_over_bytes(rule):
    rng = np.random.default_rng(1)
    for _ in range(200):
        stops = np.cumsum(rng.integers(1, 6, rng.integers(0, 12)))
        total = int(stops[-1]) if len(stops) else 0
        ends = np.sort(np.r_[rng.integers(0, total + 1, rng.integers(0, 5)), total])
        section = [int(np.searchsorted(ends, b, side="right")) for b in range(total)]
        want, shared, start = np.zeros(len(ends)), np.zeros(len(ends), dtype=int), 0
        for stop in stops.tolist():
            own = section[start:stop]
            kinds = sorted(set(own))
            if len(kinds) > 1:
                shared[kinds] += 1
            if rule == "share":
                for s in own:
                    want[s] += 1 / len(own)
            else:
                want[own[0] if rule == "start" else max(kinds, key=lambda s: (own.count(s), -s))] += 1
            start = stop
        n, both = A.allocate(stops, ends, rule)
        assert np.allclose(n, want) and (both == shared).all()


def test_counts_sum_to_the_encoding(spark):
    docs = documents(spark)
    tokens = A.tokens_of(open(A.RANKS, "rb").read())
    rows = A.count_tokens(docs, fields=("source", "lang", "text"), lines_of=("text",), keep=("doc_id", "n_chars")).collect()
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    for r in docs.collect():
        if r["doc_id"] != 106:
            joined = "\n".join(x or "" for x in (r["source"], r["lang"], r["text"]))
            assert total[r["doc_id"]] == len(tokens.encoding.encode_ordinary(joined))
    assert A.count_tokens(documents(spark, [])).count() == 0


def test_character_spans():
    tokens = A.tokens_of(open(A.RANKS, "rb").read())
    text = "a \u4f60\u597d \U0001F600x"
    first, last = A.char_spans(text, tokens.stops(text))
    assert first[0] == 0 and last[-1] == len(text) and all(a < b for a, b in zip(first, last, strict=True))
