"""Nearest neighbours by collision counting over single projections.

Each of ``projections`` random directions gives one sorted array of projected vectors. A query widens a window around its own
projection in every array (virtual rehashing: the radius grows by a factor, nothing is hashed anew) and counts in how many
windows each vector lies. A vector that collides in at least ``threshold`` of the windows is verified with the exact measure. The
query stops once its k-th best verified vector is within the radius, as nearer ones would have collided; else the windows go on
growing until they hold everything, so no candidate is cut off.

The measure is the inner product. Vectors get one more component that brings all of them to the largest norm, which turns the
largest inner product into the smallest distance. Scores are computed on the original vectors in double precision.

Vectors are dealt into blocks of bounded size by a hash of their row, queries into groups; every block meets every group in one
task, and what leaves it is k rows per query. The final k come from those of all blocks. Only vectors of the same number of
components are compared.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id. Ties go to the
smaller id. Repeated rows are separate candidates; a row is never its own neighbour. Fewer candidates than k give them all.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from slidegrid.session import cut_lineage

#: Directions, share of windows a candidate must lie in, window width per radius, and growth of the radius.
PROJECTIONS, SHARE, WIDTH, GROWTH = 64, 0.55, 2.0, 1.2
#: First radius as a part of the largest norm.
FIRST_RADIUS = 0.1
BLOCK_ROWS, GROUP_QUERIES = 16384, 512
#: Collisions that are counted at a time.
_COUNTED = 1 << 16


class SortedProjections:
    def __init__(self, vectors: np.ndarray, top: float, seed: int, projections: int = PROJECTIONS):
        lift = np.sqrt(np.maximum(top * top - (vectors ** 2).sum(axis=1), 0.0))
        rng = np.random.Generator(np.random.Philox(key=seed))
        self.directions = rng.standard_normal((projections, vectors.shape[1] + 1))
        self.vectors, self.top = vectors, top
        places = np.concatenate([vectors, lift[:, None]], axis=1) @ self.directions.T
        order = np.ascontiguousarray(places.argsort(axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(places.T, order, axis=1)
        self.order = list(order.astype(np.min_scalar_type(len(vectors))))
        self.light = (vectors / top).astype(np.float32)

    def nearest(self, queries: np.ndarray, k: int, skip: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query, positions and inner products of the k nearest found, nearest first.

        ``skip`` is each query's own position or -1. The windows of a round are searched for all queries at once; what a round adds
        to the windows of a query are whole stretches of the sorted arrays, and one pass over them counts its collisions.
        """
        m, n = self.sorted.shape
        centre = queries @ self.directions[:, :-1].T
        threshold, done = math.ceil(SHARE * m), -m - 1  # a vector that is done never collides often enough again
        start = self._places(centre, "left")
        windows: list[tuple[np.ndarray, np.ndarray]] = []
        out = []
        for q, query in enumerate(queries):
            counts, left = np.zeros(n, dtype=np.int64), n
            if skip[q] >= 0:
                counts[skip[q]], left = done, n - 1
            found, scores, square = np.zeros(0, dtype=np.int64), np.zeros(0), (query ** 2).sum() + self.top ** 2
            low = high = start[q].tolist()
            radius = FIRST_RADIUS * self.top
            for step in count() if left else ():
                if step == len(windows):
                    half = WIDTH * radius / 2
                    windows.append((self._places(centre - half, "left"), self._places(centre + half, "right")))
                new_low, new_high = (side[q].tolist() for side in windows[step])
                stretches = [o[a:b] for o, a, b in zip(self.order, new_low, low)] + [o[a:b] for o, a, b in zip(self.order, high, new_high)]
                met = np.concatenate(stretches)
                for begin in range(0, len(met), _COUNTED):
                    counts += np.bincount(met[begin:begin + _COUNTED], minlength=n)
                low, high = new_low, new_high
                fresh = np.flatnonzero(counts >= threshold)
                if len(fresh):
                    counts[fresh] = done
                    left -= len(fresh)
                    found, scores = self._best(query, k, found, scores, fresh, ids)
                if not left or len(found) == k and square - 2 * scores[-1] <= radius * radius:
                    break
                radius *= GROWTH
            out.append((found, scores))
        return out

    def _places(self, at: np.ndarray, side: str) -> np.ndarray:
        return np.stack([np.searchsorted(line, at[:, j], side=side) for j, line in enumerate(self.sorted)], axis=1)

    def _best(self, query: np.ndarray, k: int, found: np.ndarray, scores: np.ndarray, fresh: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of those found before and the fresh ones. Fresh ones that a product in single precision shows to be worse than k
        others, by more than twice what rounding can change, get no exact score."""
        if len(found) + len(fresh) > k:
            rough = self.light[fresh] @ (query / self.top).astype(np.float32)
            every = np.r_[scores / self.top / self.top, rough]
            worst = np.partition(every, len(every) - k)[len(every) - k]
            fresh = fresh[rough >= worst - 4 * (len(query) + 4) * np.finfo(np.float32).eps]
        found = np.r_[found, fresh]
        scores = np.r_[scores, (self.vectors[fresh] * query).sum(axis=1)]
        best = np.lexsort((ids[found], -scores))[:k]
        return found[best], scores[best]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose key is divisible by ``every``, its k nearest other rows."""
    v = F.col("v")
    usable = F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = cut_lineage(
        vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        .where(usable).withColumn("dim", F.size("v"))
    )
    tops = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top"), F.count_if(F.col("id") % every == 0).alias("q")).first()
    top = math.sqrt(tops["top"] or 0.0) * (1 + 1e-12)
    blocks, groups = max(1, -(-tops["n"] // BLOCK_ROWS)), max(1, -(-tops["q"] // GROUP_QUERIES))
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(n)).cast("int")
    data = rows.withColumn("block", deal(blocks, "block")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = rows.where(F.col("id") % every == 0).withColumn("group", deal(groups, "group")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def searched(data: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if data.num_rows and asked.num_rows:
            matrix = _matrix(data)
            ids, own = data["id"].to_numpy(), {r: i for i, r in enumerate(data["row"].to_pylist())}
            index = SortedProjections(matrix, top, seed)
            rows = asked["row"].to_pylist()
            skip = np.array([own.get(row, -1) for row in rows])
            for row, query_id, (found, scores) in zip(rows, asked["id"].to_pylist(), index.nearest(_matrix(asked), k, skip, ids), strict=True):
                out["query_row"] += [row] * len(found)
                out["query_id"] += [query_id] * len(found)
                out["vec_id"] += ids[found].tolist()
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(x, pa.float64() if c == "score" else pa.int64()) for c, x in out.items()})

    met = data.groupBy("block", "group", "dim").cogroup(asked.groupBy("block", "group", "dim"))
    local = met.applyInArrow(searched, "query_row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(table: pa.Table) -> np.ndarray:
    column = table["v"].combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)
