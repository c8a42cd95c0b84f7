"""op7: counts against plain Python, and rules of the table."""

import re
from collections import Counter

from helpers import documents, prose, words

from slidegrid.llm import quality as Q


def plain(text):
    text = text or ""
    ws = words(text)
    windows = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    rows = [(1, "a b c a b c\na b c\n\n \na b c\n# * x", "en", "s"), (2, prose("en", 3) + "\n$ | <>\n$ | <>", "en", "s")]
    for docs in (documents(spark), documents(spark, rows)):
        want = Counter()
        for r in docs.collect():
            n = plain(r["text"])
            want[(r["doc_id"], *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
        got = Q.judge(docs).collect()
        assert Counter((g["doc_id"], g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) for g in got) == want
        assert not any(g["kept"] and g["base_failed"] for g in got)


def test_table(spark):
    clean = " ".join(f"{w} v{i}" for i, w in enumerate(("the house of that river and its people " * 20).split()))
    rows = [(1, clean, "en", "s"), (2, clean.replace(" ", "$$ "), "en", "s"), (3, "zq " + " ".join(f"zq{i}" for i in range(90)), "en", "s")]
    kept = {r["doc_id"]: r["kept"] for r in Q.judge(documents(spark, rows)).collect()}
    assert kept == {1: True, 2: False, 3: False}
    docs = documents(spark, rows)
    assert Q.keep(docs).columns == docs.columns and [r["doc_id"] for r in Q.keep(docs).collect()] == [1]
    assert Q.keep(documents(spark, [])).count() == 0
