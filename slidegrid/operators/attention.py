"""Scaled dot-product attention inside a bag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from slidegrid.operators.skew import copies_join

#: Tiles of a piece before a bag is cut further, pieces of a bag, and tiles of a piece (in expectation) beyond which there are more pieces.
SMALL_PIECE, PIECES, PIECE_ROWS = 64, 4, 32768


def bag_attention(
    df: DataFrame, wq: np.ndarray, wk: np.ndarray, wv: np.ndarray, heads: int = 1, wo: np.ndarray | None = None,
    by: str = "slide", index: str = "tile_idx", vec: str = "emb", block: int = 256,
) -> DataFrame:
    """(by, index, out, weight_sum): softmax(QK'/sqrt(d)) V per bag, ``weight_sum`` being 1 per head.

    Exact for bags of any size without ever making tile pairs: the tiles of a bag are dealt by a hash into pieces, and a piece of queries
    meets a piece of keys in one task, ``block`` queries at a time, leaving a running maximum, a weight total and a weighted sum per query;
    these partial results are merged. A bag has at most ``PIECES`` pieces until they would hold more than ``PIECE_ROWS`` tiles, so what is
    shuffled grows as the tiles do; beyond that a piece keeps its size, which bounds a task's memory, and the shuffle grows with the pieces.
    """
    d = wq.shape[1]
    dh = d // heads
    shared = df.sparkSession.sparkContext.broadcast((wq, wk, wv, wo))
    kinds = dict(df.dtypes)
    n = F.col("__n")
    pieces = F.greatest(F.least(F.ceil(n / SMALL_PIECE), F.lit(PIECES)), F.ceil(n / PIECE_ROWS)).cast("int")
    sizes = df.groupBy(by).agg(F.count("*").alias("__n")).select(by, pieces.alias("__pieces"))
    dealt = copies_join(df.select(by, index, vec), sizes, [by], salt_on=[index]).withColumn("__own", F.pmod(F.xxhash64(index), F.col("__pieces")).cast("int"))
    places = F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(0), F.col("__pieces") - 1),
        lambda k: F.array(F.struct(F.col("__own").alias("q"), k.alias("k")), F.struct(k.alias("q"), F.col("__own").alias("k"))),
    )))
    met = dealt.select(by, index, vec, "__own", F.explode(places).alias("__at")).select(by, index, vec, "__own", "__at.q", "__at.k")

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        q_w, k_w, v_w, _ = shared.value
        asks, keys = pdf[pdf["__own"] == pdf["q"]], pdf[pdf["__own"] == pdf["k"]]
        if not len(asks) or not len(keys):
            return pd.DataFrame({by: pdf[by].iloc[:0], index: pdf[index].iloc[:0], **{c: pd.Series([], dtype=object) for c in "mso"}})
        kv = np.stack(keys[vec].to_numpy()).astype(np.float64)
        k, v = kv @ k_w, kv @ v_w
        x = np.stack(asks[vec].to_numpy()).astype(np.float64) @ q_w
        top, total, mix = np.zeros((len(x), heads)), np.zeros((len(x), heads)), np.zeros((len(x), d))
        for begin in range(0, len(x), block):
            some = slice(begin, begin + block)
            for h in range(heads):
                cut = slice(h * dh, (h + 1) * dh)
                logits = x[some, cut] @ k[:, cut].T / np.sqrt(dh)
                top[some, h] = logits.max(axis=1)
                e = np.exp(logits - top[some, h, None])
                total[some, h], mix[some, cut] = e.sum(axis=1), e @ v[:, cut]
        return pd.DataFrame({by: asks[by].to_numpy(), index: asks[index].to_numpy(), "m": list(top), "s": list(total), "o": list(mix)})

    schema = f"{by} {kinds[by]}, {index} {kinds[index]}, m array<double>, s array<double>, o array<double>"
    parts = met.groupBy(by, "q", "k").applyInPandas(partial, schema)
    gathered = parts.groupBy(by, index).agg(F.collect_list(F.struct("m", "s", "o")).alias("p"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w_out = shared.value[3]
        for pdf in batches:
            outs, sums = [], []
            for parts_of in pdf["p"]:
                m = np.stack([p["m"] for p in parts_of])
                s = np.stack([p["s"] for p in parts_of])
                o = np.stack([p["o"] for p in parts_of]).reshape(len(parts_of), heads, dh)
                scale = np.exp(m - m.max(axis=0))
                total = (scale * s).sum(axis=0)
                mixed = ((scale[:, :, None] * o).sum(axis=0) / total[:, None]).reshape(-1)
                outs.append(mixed @ w_out if w_out is not None else mixed)
                sums.append(float(np.mean((scale * s / total).sum(axis=0))))
            yield pd.DataFrame({by: pdf[by], index: pdf[index], "out": outs, "weight_sum": sums})

    return gathered.mapInPandas(merge, f"{by} {kinds[by]}, {index} {kinds[index]}, out array<double>, weight_sum double")
