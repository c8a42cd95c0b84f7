"""Caller-supplied tile kernels: run over the tile table in Arrow batches, errors kept per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from slidegrid.operators.merge import stale_bags


def map_tiles(df: DataFrame, fn: Callable[[dict], dict], schema: str, on_error: str = "record") -> DataFrame:
    """Apply ``fn`` (a row as dict to a dict of the new columns) to every tile.

    With ``record`` a failing tile keeps its row, gets NULLs and the message in ``error``; with
    ``raise`` the job stops. Rows are independent, so Spark may split the table anywhere.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]
    inputs = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = {n: [] for n in [*names, "error"]}
            for row in pdf.to_dict("records"):
                try:
                    got, error = fn(row), None
                except Exception as exc:  # noqa: BLE001 - the message is part of the result
                    if on_error == "raise":
                        raise
                    got, error = {}, f"{type(exc).__name__}: {exc}"
                for n in names:
                    made[n].append(got.get(n))
                made["error"].append(error)
            out = pdf.copy()
            for n, values in made.items():
                out[n] = pd.Series(values, index=pdf.index, dtype="object")
            yield out

    return df.mapInPandas(run, f"{inputs}, {schema}, error string")


def map_bags(df: DataFrame, by: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, block: int = 4096) -> DataFrame:
    """Grouped form for kernels that need neighbours: one call per (slide, block of tile_idx).

    The block keeps every group small; a kernel that must see a whole slide has to be written as an
    aggregate instead.
    """
    keyed = df.withColumn("__block", F.floor(F.col("tile_idx") / block).cast("long"))
    return keyed.groupBy(by, "__block").applyInPandas(lambda pdf: fn(pdf.drop(columns="__block")), schema)


def embed_tiles(tiles: DataFrame, loader: Callable[[], Callable[[list], list]], payload: str = "payload", batch: int = 16) -> DataFrame:
    """(slide, tile_idx, x, y, emb): the caller's model, loaded once per worker and fed in batches."""
    kinds = dict(tiles.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loader()
        for pdf in batches:
            items = pdf[payload].tolist()
            made: list = []
            for at in range(0, len(items), batch):
                made += list(model(items[at : at + batch]))
            out = pdf[["slide", "tile_idx", "x", "y"]].copy()
            out["emb"] = [list(map(float, e)) for e in made]
            yield out

    head = ", ".join(f"{c} {kinds[c]}" for c in ("slide", "tile_idx", "x", "y"))
    return tiles.select("slide", "tile_idx", "x", "y", payload).mapInPandas(run, f"{head}, emb array<float>")


def embed_stale(tiles: DataFrame, cached: DataFrame, loader: Callable[[], Callable[[list], list]], **kw) -> DataFrame:
    """Cached embeddings of unchanged slides, plus fresh ones for slides whose coordinates changed."""
    stale = stale_bags(cached, tiles)
    current = tiles.select("slide").distinct()
    kept = cached.join(stale, "slide", "left_anti").join(current, "slide", "left_semi")
    return kept.unionByName(embed_tiles(tiles.join(stale, "slide", "left_semi"), loader, **kw))
