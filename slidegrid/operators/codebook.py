"""Vector quantisation against a codebook, and its residual multi-scale form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from slidegrid.functions import vectors as vx
from slidegrid.functions.hashing import seeded_key, uniform_int
from slidegrid.operators import raster
from slidegrid.session import cut_lineage

CODEBOOK_BYTES_LIMIT = 256 << 20
# Grid sides of the multi-scale form.
SCALES = [1, 2, 4, 7, 14]


def fetch_codebook(codebook: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(codes, vectors) on the driver, after a size check; a codebook is a model, not data."""
    rows, width = codebook.agg(F.count("*"), F.max(F.size("vec"))).first()
    if rows * (width or 0) * 8 > CODEBOOK_BYTES_LIMIT:
        raise ValueError(f"a codebook of {rows} x {width} is too large to broadcast")
    got = codebook.select("code", "vec").orderBy("code").collect()
    return np.array([r[0] for r in got]), np.array([r[1] for r in got], dtype=np.float64)


def vq_assign(
    df: DataFrame, codes: np.ndarray, book: np.ndarray, vec: str = "vec", eps: float = 1e-8, word: str | None = None
) -> DataFrame:
    """Adds ``code`` and ``similarity``: the nearest codeword by cosine, lowest code on a tie.

    Map-only: an Arrow batch meets the broadcast codebook in one matrix product, no pairs are made.
    ``word`` names a further column for the codeword itself.
    """
    unit = book / (np.linalg.norm(book, axis=1, keepdims=True) + eps)
    shared = df.sparkSession.sparkContext.broadcast((codes, book, unit))
    kind = "code long, similarity double" + (", word array<double>" if word else "")

    @F.pandas_udf(f"struct<{kind.replace(' long', ':long').replace(' double', ':double').replace(' array<double>', ':array<double>')}>")
    def nearest(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ids, raw, words = shared.value
        for s in it:
            x = np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.zeros((0, words.shape[1]))
            sim = (x / (np.linalg.norm(x, axis=1, keepdims=True) + eps)) @ words.T
            # Similarities equal to 12 digits are a tie; duplicates of a codeword go to the lowest code.
            best = np.round(sim, 12).argmax(axis=1)
            out = pd.DataFrame({"code": ids[best], "similarity": sim[np.arange(len(sim)), best]})
            if word:
                out["word"] = list(raw[best])
            yield out

    fields = {"code": F.col("__q.code"), "similarity": F.col("__q.similarity")}
    if word:
        fields[word] = F.col("__q.word")
    return df.withColumn("__q", nearest(vec)).withColumns(fields).drop("__q")


def codebook_usage(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    """One row: codes in use, dead codes and their share, mean similarity."""
    used = assigned.groupBy("code").agg(F.count("*").alias("n"), F.sum("similarity").alias("s"))
    return (
        codebook.select("code").join(used, "code", "left")
        .agg(
            F.count("*").alias("n_codes"), F.count("n").alias("n_used"),
            F.try_divide(F.sum("s"), F.sum("n")).alias("mean_similarity"),
        )
        .withColumn("n_dead", F.col("n_codes") - F.col("n_used"))
        .withColumn("dead_share", F.col("n_dead") / F.col("n_codes"))
    )


def logit_spread(df: DataFrame, q: str, k: str) -> DataFrame:
    """Spread of raw and scaled logits q.k over rows: scaling by sqrt(d) keeps it at order one."""
    raw = vx.dot(F.col(q), F.col(k))
    d = F.size(q)
    return df.select(raw.alias("raw"), (raw / F.sqrt(d)).alias("scaled")).agg(
        F.stddev_pop("raw").alias("std_raw"), F.stddev_pop("scaled").alias("std_scaled"), F.count("*").alias("n")
    )


def fit_codebook(df: DataFrame, size: int, seed: int = 0, vec: str = "vec", key: str = "id", rounds: int = 20, restarts: int = 3):
    """(codes, vectors): cosine k-means, with codes that catch nothing restarted on poorly served rows.

    Starts from ``seed_codebook``. Each round is one job with one pass: rows meet the broadcast codebook in Arrow batches, which pass
    on only a sum per code. It ends early when no vector moves. Restart vectors are the ``n_dead`` least similar rows, so the driver
    never sees more than a few codebooks.
    """
    book = seed_codebook(df, size, seed, vec, key)
    size = len(book)
    for turn in range(rounds + restarts):
        sums, counts = np.zeros_like(book), np.zeros(size)
        for r in code_sums(df, book, vec).collect():  # one row per code
            sums[r["code"]], counts[r["code"]] = r["s"], r["n"]
        dead = np.flatnonzero(counts == 0)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], book)
        still = np.array_equal(moved, book)
        book = moved
        if len(dead) and turn < rounds:
            worst = vq_assign(df.select(key, vec), np.arange(size), book, vec).orderBy("similarity", key).limit(len(dead))
            for slot, row in zip(dead, worst.select(vec).collect()):
                book[slot] = row[0]
        elif still:
            break
    return np.arange(size), book


def seed_codebook(df: DataFrame, size: int, seed: int = 0, vec: str = "vec", key: str = "id", passes: int = 3, oversample: float = 2.0) -> np.ndarray:
    """Oversampled parallel seeding: ``size`` start vectors (all rows, if fewer).

    From one row on, every pass takes each row with a chance in proportion to its distance from the vectors taken so far, about
    ``oversample * size`` rows a pass. Chances come from a seeded hash of the key, so a retried task takes the same rows. The candidates,
    weighted by the rows nearest to them, are thinned on the driver by the usual one-at-a-time seeding: there are at most
    some ``passes * oversample * size`` of them, whatever the number of rows.
    """
    first = df.select(vec).orderBy(seeded_key(seed, key), key).limit(1).collect()
    taken = np.array([r[0] for r in first], dtype=np.float64)
    if not len(taken):
        return taken
    for turn in range(passes):
        far = vq_assign(df.select(key, vec), np.arange(len(taken)), taken, vec).withColumn("__d", F.greatest(1 - F.col("similarity"), F.lit(0.0)))
        total = far.agg(F.sum("__d")).first()[0] or 0.0
        if total <= 0:
            break
        draw = uniform_int(seeded_key(f"{seed}:{turn}", key), 1 << 30) / float(1 << 30)
        fresh = far.where(draw < F.col("__d") * F.lit(oversample * size / total)).select(key, vec)
        found = sorted(fresh.collect(), key=lambda r: r[key])  # about oversample * size rows
        taken = np.concatenate([taken, np.array([r[vec] for r in found], dtype=np.float64).reshape(-1, taken.shape[1])])
    weight = np.zeros(len(taken))
    for r in code_sums(df, taken, vec).collect():
        weight[r["code"]] = r["n"]
    if len(taken) <= size:  # few distinct rows: the first ones fill up
        more = np.array([r[0] for r in df.select(vec).orderBy(seeded_key(seed, key), key).limit(size).collect()], dtype=np.float64)
        return more if len(more) < size else np.concatenate([taken, more])[:size]
    unit = taken / (np.linalg.norm(taken, axis=1, keepdims=True) + 1e-8)
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(taken), p=weight / weight.sum()))]
    gap = 1 - unit @ unit[chosen[0]]
    while len(chosen) < size:
        chance = np.maximum(gap, 0) * np.maximum(weight, 1e-9)
        chosen.append(int(rng.choice(len(taken), p=chance / chance.sum())) if chance.sum() > 0 else next(i for i in range(len(taken)) if i not in chosen))
        gap = np.minimum(gap, 1 - unit @ unit[chosen[-1]])
    return taken[chosen]


def code_sums(df: DataFrame, book: np.ndarray, vec: str = "vec") -> DataFrame:
    """(code, n, s): rows nearest to each codeword and the sum of their unit vectors; codes without rows are left out.

    One pass: a task sums what its rows add to every code, and those sums meet per code.
    """
    unit = book / (np.linalg.norm(book, axis=1, keepdims=True) + 1e-8)
    shared = df.sparkSession.sparkContext.broadcast(unit)
    schema = "code long, n double, s array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value
        sums, counts = np.zeros_like(words), np.zeros(len(words))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
                x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
                best = np.round(x @ words.T, 12).argmax(axis=1)
                np.add.at(sums, best, x)
                counts += np.bincount(best, minlength=len(words))
        live = np.flatnonzero(counts)
        if len(live):  # a task without rows has no lists to pass on, and Arrow takes an empty column of lists for numbers
            yield pd.DataFrame({"code": live, "n": counts[live], "s": list(sums[live])})

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                one = held.setdefault(int(row.code), [0.0, 0.0])
                one[0] += row.n
                one[1] = one[1] + np.asarray(row.s)
        if held:
            yield pd.DataFrame([(c, n, s) for c, (n, s) in held.items()], columns=["code", "n", "s"])

    return df.select(vec).mapInPandas(run, schema).repartition("code").mapInPandas(add_up, schema)


def residual_vq(grid: DataFrame, codes: np.ndarray, book: np.ndarray, by: list[str], side: int = 14, scales: list[int] = SCALES) -> DataFrame:
    """(by, scale, error): 1 - mean cosine of the reconstruction after each added scale.

    Per scale the residual grid (gx, gy, vec) is averaged down, quantised with the shared codebook,
    stretched back and subtracted. The residual is cut from its lineage after each scale, because the
    next scale reads it twice.
    """
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    state = grid.select(*by, "gx", "gy", F.transform("vec", lambda x: x.cast("double")).alias("target"))
    state = state.withColumn("left", F.col("target"))
    for n in scales:
        low = raster.resample(state.select(*by, "gx", "gy", "left"), raster.area_weights(side, n), by, "left")
        coded = vq_assign(low, codes, book, "left", word="word").select(*by, "gx", "gy", F.col("word").alias("left"))
        up = raster.resample(coded, raster.bilinear_weights(n, side), by, "left").withColumnRenamed("left", "__up")
        rebuilt = minus(F.col("target"), F.col("left"))
        state = (
            state.join(up, [*by, "gx", "gy"])
            .withColumn("left", minus(F.col("left"), F.col("__up")))
            .drop("__up")
            .withColumn(f"__e{n}", 1 - vx.cosine(rebuilt, F.col("target")))
        )
        state = cut_lineage(state)
    errors = state.groupBy(*by).agg(*[F.avg(f"__e{n}").alias(f"__e{n}") for n in scales])
    pairs = ", ".join(f"{n}, __e{n}" for n in scales)
    return errors.selectExpr(*by, f"stack({len(scales)}, {pairs}) AS (scale, error)")
