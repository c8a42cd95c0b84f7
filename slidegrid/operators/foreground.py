"""Foreground masks of tiles given as pixel rows (by, x, y, r, g, b), and the chain from raw to normalised tiles.

Whatever is darker than its surroundings (or less saturated, see ``binary``) is foreground; holes are closed with a disk and small objects
removed. Rasters are dense; tiles are told apart by ``by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slidegrid.functions import color
from slidegrid.operators import quality, raster, stain
from slidegrid.operators.skew import copies_join, spread_join
from slidegrid.session import cut_lineage

#: Window and offset of the adaptive threshold, and the saturation bound.
ADAPTIVE_WINDOW, ADAPTIVE_OFFSET, SATURATION_BOUND = 11, 2, 30
METHODS = ("otsu", "adaptive", "saturation")


def grey_byte() -> Column:
    return F.round(color.grey(F.col("r"), F.col("g"), F.col("b"))).cast("int")


def binary(px: DataFrame, by: list[str], method: str = "otsu", invert: bool = True, threshold: int | None = None) -> DataFrame:
    """(by, x, y, v): 1 above the threshold and 0 below, the other way round with ``invert``.

    otsu: grey against the tile's Otsu threshold, or against a given ``threshold``. adaptive: grey against its Gaussian mean over 11 by 11
    pixels (edges repeated) less 2. saturation: saturation against 30; here the stained side is the upper one, so tissue needs ``invert=False``.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    grey = px.select(*by, "x", "y", grey_byte().alias("v"))
    if method == "saturation":
        saturation = F.round(color.hsv(F.col("r"), F.col("g"), F.col("b"))[1]).cast("int")
        above = px.select(*by, "x", "y", (saturation > SATURATION_BOUND).alias("__up"))
    elif method == "adaptive":
        r = ADAPTIVE_WINDOW // 2
        mean = raster.stencil(grey, "weighted", r, weights=raster.gaussian_weights(ADAPTIVE_WINDOW), border="replicate", by=by)
        around = mean.select(*by, "x", "y", F.floor(F.col("v") + 0.5).cast("int").alias("__mean"))
        above = grey.join(around, [*by, "x", "y"]).select(*by, "x", "y", (F.col("v") > F.col("__mean") - ADAPTIVE_OFFSET).alias("__up"))
    elif threshold is not None:
        above = grey.select(*by, "x", "y", (F.col("v") > threshold).alias("__up"))
    else:
        cuts = raster.otsu(grey, by, F.col("v"), strict_above=1.0).select(*by, "threshold")
        above = copies_join(grey, cuts, by, salt_on=["x", "y"]).select(*by, "x", "y", (F.col("v") > F.col("threshold")).alias("__up"))
    return above.select(*by, "x", "y", (F.col("__up") != F.lit(invert)).cast("int").alias("v"))


def foreground_mask(
    px: DataFrame, by: list[str], method: str = "otsu", r: int = 2, min_area: int | None = 50, min_percent: float | None = None,
    invert: bool = True, threshold: int | None = None,
) -> DataFrame:
    """(by, x, y, v): 255 where the tile has foreground, 0 elsewhere; a row for every pixel.

    The thresholded mask is closed with a disk of radius ``r`` (mirrored borders), and objects of at most ``min_area`` pixels, or ``min_percent``
    of their tile, are removed.
    """
    mask = cut_lineage(raster.close_(binary(px, by, method, invert, threshold), r, border="reflect101", by=by))
    if min_percent is None:
        kept = raster.remove_small(mask, min_area or 0, by)
    else:
        sizes = mask.groupBy(*by).agg(F.floor(F.count("*") * (min_percent / 100)).alias("__least"))
        kept = copies_join(raster.remove_small(mask, 0, by), sizes, by, salt_on=["x", "y"]).where(F.col("area") > F.col("__least")).drop("__least")
    lit = kept.select(*by, "x", "y", F.lit(255).alias("__v"))
    return mask.drop("v").join(lit, [*by, "x", "y"], "left").select(*by, "x", "y", F.coalesce("__v", F.lit(0)).alias("v"))


def apply_mask(px: DataFrame, mask: DataFrame, by: list[str]) -> DataFrame:
    """Pixels with black background, and the mask as column ``mask``."""
    met = px.join(mask.select(*by, "x", "y", F.col("v").alias("mask")), [*by, "x", "y"])
    return met.withColumns({c: F.when(F.col("mask") > 0, F.col(c)).otherwise(0).cast("int") for c in "rgb"})


def denoise_colours(px: DataFrame, by: list[str], r: int = 2, gaussian: int = 3, median: int = 3) -> DataFrame:
    """``raster.denoise`` of each channel by itself; the three channels of a pixel travel together."""
    whole = px.select(*by, "x", "y", *[F.col(c).cast("int").alias(c) for c in "rgb"])
    steps = raster.denoise_steps(r, gaussian | 1, median | 1)
    return raster.chained_stencils(whole, steps, by, list("rgb")) if steps else whole


NORMALISERS = {"percentile": stain.percentile_scale, "mean": stain.mean_scale, "stain_percentile": stain.stain_percentile, "stain": stain.separate_stains}


def process_tiles(
    px: DataFrame, by: list[str], rules: quality.TileRules = quality.TileRules(), polarity: str = "dark", method: str = "otsu",
    normaliser: str = "percentile", disk: int = 2, gaussian: int = 3, median: int = 3, min_percent: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """(pixels, tiles): tiles are judged first; the valid ones are denoised, freed of their background and normalised.

    ``pixels`` has r, g, b as masked, r2, g2, b2 as normalised and the mask; ``tiles`` has a row for every tile with its
    verdict, and ``foreground_percentage`` for the valid ones.
    """
    judged = cut_lineage(quality.tile_qc(px, by, rules, polarity))
    valid = judged.where("is_valid").select(*by, F.lit(True).alias("__valid"))
    work = cut_lineage(denoise_colours(spread_join(px, valid, by, salt_on=["x", "y"]).drop("__valid"), by, disk, gaussian, median))
    masked = cut_lineage(apply_mask(work, foreground_mask(work, by, method, disk, min_percent=min_percent), by))
    shares = masked.groupBy(*by).agg((F.count_if(F.col("mask") > 0) * 100.0 / F.count("*")).alias("foreground_percentage"))
    return NORMALISERS[normaliser](masked, by), judged.join(shares, by, "left")
