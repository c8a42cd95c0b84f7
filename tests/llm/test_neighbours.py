"""op3: recall against brute force, and exactness of what is returned."""

import numpy as np
import pytest
from pyspark.sql import types as T

from slidegrid.llm import neighbours as N

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("row", T.StringType())])


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x") for i, v in vectors], SCHEMA)


def brute(vectors, k):
    ids = [i for i, _ in vectors]
    m = np.array([np.float32(v) for _, v in vectors], dtype=np.float64)
    out = {}
    for at, i in enumerate(ids):
        if i % 20 == 0:
            s = (m * m[at]).sum(axis=1)
            out[i] = sorted(((-s[j], ids[j]) for j in range(len(ids)) if j != at))[:k]
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    m = centres[rng.integers(0, 30, 6000)] + 0.6 * rng.normal(size=(6000, 24))
    if scaled:
        m *= rng.uniform(0.5, 2.0, size=(6000, 1))
    vectors = [(i, v.tolist()) for i, v in enumerate(m)]
    want = brute(vectors, 20)
    hit = total = 0
    found = {}
    for r in N.nearest(frame(spark, vectors)).collect():
        found.setdefault(r["query_id"], []).append(r)
    assert set(found) == set(want)
    for q, rows in found.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        hit += len({r["vec_id"] for r in rows} & {i for _, i in want[q]})
        total += 20
    assert hit / total >= 0.9


def test_awkward_vectors(spark):
    same = [1.0, 2.0]
    vectors = [(0, same), (20, same), (3, same), (4, [0.0, 0.0]), (40, None), (5, [None, 1.0]), (60, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
               (None, same), (8, [-1.0, 0.5]), (80, []), (9, [1.0, 2.0, 3.0]), (3, same)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in N.nearest(frame(spark, vectors)).collect())
    assert got == [
        (0, 1, 3, 5.0), (0, 2, 3, 5.0), (0, 3, 20, 5.0), (0, 4, 8, 0.0),
        (20, 1, 0, 5.0), (20, 2, 3, 5.0), (20, 3, 3, 5.0), (20, 4, 8, 0.0),
    ]
    assert N.nearest(frame(spark, [])).count() == 0


class Read:
    """Vectors that count how many of them are read."""

    def __init__(self, m):
        self.m, self.rows = m, 0

    def __getitem__(self, at):
        self.rows += len(at)
        return self.m[at]


def test_few_exact_scores(monkeypatch):
    """Only vectors that may be among the k nearest get an exact score, and the parts in which collisions are counted change nothing."""
    rng = np.random.default_rng(9)
    m, ids = rng.normal(size=(4000, 8)), np.arange(4000)[::-1].copy()
    m[1000:1100] = m[:100]  # ties
    top = float(np.sqrt((m ** 2).sum(axis=1).max())) * (1 + 1e-12)
    index = N.SortedProjections(m, top, 7)
    index.vectors = Read(m)
    skip = np.where(np.arange(100) % 2, -1, np.arange(100))
    whole = index.nearest(m[:100], 20, skip, ids)
    assert index.vectors.rows < 100 * 4000 / 10
    monkeypatch.setattr(N, "_COUNTED", 1000, raising=False)
    for q, ((found, scores), (again, same)) in enumerate(zip(whole, index.nearest(m[:100], 20, skip, ids), strict=True)):
        assert found.tolist() == again.tolist() and scores.tolist() == same.tolist() == (m[found] * m[q]).sum(axis=1).tolist()
        assert len(found) == 20 and skip[q] not in found.tolist()
        assert sorted(zip(-scores, ids[found])) == list(zip(-scores, ids[found]))
