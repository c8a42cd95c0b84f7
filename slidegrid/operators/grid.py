"""Slide geometry: pyramids, tile grids, tissue coverage, blocks, heat grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slidegrid.functions.scalars import clip
from slidegrid.operators.skew import copies_join

TOP_LEVEL = 17


def pyramid(slides: DataFrame, top: int = TOP_LEVEL) -> DataFrame:
    """Dyadic table per slide: ``top`` is full resolution, each level below halves it."""
    factor = F.pow(F.lit(2.0), F.lit(top) - F.col("level"))
    return slides.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumns(
        {
            "level_w": F.ceil(F.col("width") / factor).cast("long"),
            "level_h": F.ceil(F.col("height") / factor).cast("long"),
            "level_mpp": F.round(F.col("native_mpp") * factor, 4),
        }
    )


def dyadic_level(extraction_w: Column, full_w: Column, top: int = TOP_LEVEL) -> Column:
    """Level of the dyadic table whose width fits best."""
    halvings = F.log2(F.greatest(full_w, F.lit(1)) / F.greatest(extraction_w, F.lit(1)))
    return clip(F.lit(top) - F.bround(halvings, 0), 0.0, float(top)).cast("int")


def pick_level(levels: DataFrame, target_mpp: float, mode: str = "closest_mpp") -> DataFrame:
    """One level per slide from rows (slide, level, downsample, native_mpp).

    ``closest_mpp`` takes the level whose resolution is nearest the target (lower level on a tie);
    ``best_downsample`` the largest downsample not above target / native, else level 0.
    """
    mpp = F.col("native_mpp") * F.col("downsample")
    if mode == "closest_mpp":
        rank = F.struct(F.abs(mpp - target_mpp), F.col("level"))
    elif mode == "best_downsample":
        fits = F.col("downsample") <= F.lit(target_mpp) / F.col("native_mpp")
        rank = F.struct(F.when(fits, 0).otherwise(1), F.when(fits, -F.col("downsample")).otherwise(F.col("downsample")), F.col("level"))
    else:
        raise ValueError(f"unknown level mode {mode!r}")
    return levels.groupBy("slide").agg(
        F.min_by(F.struct("level", "downsample", mpp.alias("level_mpp")), rank).alias("p")
    ).select("slide", "p.*")


def _dealt(slides: DataFrame) -> DataFrame:
    """Slides over as many tasks as the cluster runs: a table of slides is a few MB and read by one task, but its cells are a thousand times as many."""
    return slides.repartition(4 * slides.sparkSession.sparkContext.defaultParallelism)


def overlap_grid(slides: DataFrame, patch: int = 1024, overlap: int = 128, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Overlapping grid with clipped edge tiles, over the slide or a region (x, y, w, h)."""
    step = patch - overlap
    x0, y0 = (F.lit(roi[0]), F.lit(roi[1])) if roi else (F.lit(0), F.lit(0))
    w, h = (F.lit(roi[2]), F.lit(roi[3])) if roi else (F.col("width"), F.col("height"))
    columns = F.floor((w - 1) / step).cast("int") + 1
    return (
        _dealt(slides.where((w > 0) & (h > 0)))
        .withColumn("__row", F.explode(F.sequence(F.lit(0), F.floor((h - 1) / step).cast("int"))))
        .withColumn("__col", F.explode(F.sequence(F.lit(0), columns - 1)))
        .withColumns(
            {
                "tile_idx": F.col("__row") * columns + F.col("__col"),
                "x0": x0 + F.col("__col") * step,
                "y0": y0 + F.col("__row") * step,
            }
        )
        .withColumns(
            {"x1": F.least(F.col("x0") + patch, x0 + w), "y1": F.least(F.col("y0") + patch, y0 + h)}
        )
        .drop("__row", "__col")
    )


def tile_grid(slides: DataFrame, step: Column | int, edges: bool) -> DataFrame:
    """Non-overlapping grid; ``edges`` also keeps the partial cells at the right and bottom."""
    s = step if isinstance(step, Column) else F.lit(step)
    across, down = F.floor(F.col("width") / s), F.floor(F.col("height") / s)
    if edges:
        across, down = F.ceil(F.col("width") / s), F.ceil(F.col("height") / s)
    nx, ny = across.cast("int"), down.cast("int")
    return (
        _dealt(slides.where((nx > 0) & (ny > 0)))
        .withColumn("ty", F.explode(F.sequence(F.lit(0), ny - 1)))
        .withColumn("tx", F.explode(F.sequence(F.lit(0), nx - 1)))
        .withColumns({"tile_idx": F.col("ty") * nx + F.col("tx"), "x0": F.col("tx") * s, "y0": F.col("ty") * s})
    )


def _bounds(lo: Column, step: Column, scale: Column, limit: Column) -> tuple[Column, Column]:
    """Mask index range [from, to) of a cell edge, truncated and clipped to the mask."""
    start = F.floor(lo / scale)
    stop = F.greatest(start + 1, F.floor((lo + step) / scale))
    return F.least(start, limit).cast("int"), F.least(stop, limit).cast("int")


def cells_in_mask(cells: DataFrame) -> DataFrame:
    """Adds mask bounds mx0, mx1, my0, my1 and their area to (x0, y0, step, scale, mask_w, mask_h)."""
    mx0, mx1 = _bounds(F.col("x0"), F.col("step"), F.col("scale"), F.col("mask_w"))
    my0, my1 = _bounds(F.col("y0"), F.col("step"), F.col("scale"), F.col("mask_h"))
    return cells.withColumns({"mx0": mx0, "mx1": mx1, "my0": my0, "my1": my1}).withColumn(
        "area", (F.col("mx1") - F.col("mx0")) * (F.col("my1") - F.col("my0"))
    )


def coverage(cells: DataFrame, mask: DataFrame, method: str = "cell") -> DataFrame:
    """Share of mask pixels (slide, mx, my, v) that are set inside each grid cell.

    ``cell`` computes the owning cell of every set pixel and counts (one combined aggregate); cells finer
    than a mask pixel look up the one pixel they lie in. ``integral`` looks up four corners of a
    summed-area table and takes overlapping cells too. Pixels that are not stored count as not set in
    both, and both agree.
    """
    placed = cells_in_mask(cells)
    if method == "cell":
        fine = placed.where("step < scale")
        placed = placed.where("step >= scale")
        cells = cells.where("step >= scale")
        geometry = cells.select("slide", "step", "scale").distinct()
        on = copies_join(mask.where("v > 0"), geometry, ["slide"], salt_on=["mx", "my"])
        inside = on.select("slide", _owner(F.col("mx")).alias("tx"), _owner(F.col("my")).alias("ty"))
        counts = inside.groupBy("slide", "tx", "ty").agg(F.count("*").alias("hits"))
        one = mask.where("v > 0").select("slide", F.col("mx").alias("mx0"), F.col("my").alias("my0"), F.lit(1).cast("long").alias("hits")).distinct()
        joined = placed.join(counts, ["slide", "tx", "ty"], "left").unionByName(fine.join(one, ["slide", "mx0", "my0"], "left"))
    elif method == "integral":
        table = integral_image(_filled(mask, cells))
        corners = placed.select(
            "slide",
            "tile_idx",
            F.explode(
                F.array(
                    *[
                        F.struct(F.col(x).alias("ix"), F.col(y).alias("iy"), F.lit(sign).alias("sign"))
                        for x, y, sign in (("mx1", "my1", 1), ("mx1", "my0", -1), ("mx0", "my1", -1), ("mx0", "my0", 1))
                    ]
                )
            ).alias("c"),
        ).select("slide", "tile_idx", F.expr("c.ix - 1 AS mx"), F.expr("c.iy - 1 AS my"), "c.sign")
        sums = corners.join(table, ["slide", "mx", "my"]).groupBy("slide", "tile_idx").agg(
            F.sum(F.col("sign") * F.col("total")).alias("hits")
        )
        joined = placed.join(sums, ["slide", "tile_idx"], "left")
    else:
        raise ValueError(f"unknown coverage method {method!r}")
    return joined.withColumn(
        "fraction",
        F.when(F.col("area") > 0, F.coalesce(F.col("hits"), F.lit(0)) / F.col("area")).otherwise(F.lit(0.0)),
    ).drop("hits")


def _filled(mask: DataFrame, cells: DataFrame) -> DataFrame:
    """The mask with a row for every pixel of the slides in ``cells``, 0 where none is stored."""
    frame = cells.select("slide", "mask_w", "mask_h").distinct()
    lines = frame.select("slide", "mask_w", F.explode(F.sequence(F.lit(0), F.col("mask_h") - 1)).alias("my"))
    every = lines.select("slide", F.explode(F.sequence(F.lit(0), F.col("mask_w") - 1)).alias("mx"), "my")
    stored = mask.select("slide", "mx", "my", "v")
    return every.join(stored, ["slide", "mx", "my"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def _owner(m: Column) -> Column:
    """Grid column (or row) whose mask range holds pixel ``m``; settled exactly by its two neighbours."""
    scale, step = F.col("scale"), F.col("step")
    guess = F.greatest(F.ceil((m + 1) * scale / step) - 1, F.lit(0))
    return (
        F.when(F.floor(guess * step / scale) > m, guess - 1)
        .when(F.floor((guess + 1) * step / scale) <= m, guess + 1)
        .otherwise(guess)
        .cast("int")
    )


def integral_image(mask: DataFrame, value: Column | None = None) -> DataFrame:
    """Summed-area table of a dense raster: sums along rows, then along columns.

    Each window covers one raster line, at most the mask's width or height.
    """
    v = (F.col("v") > 0).cast("long") if value is None else value
    along = Window.partitionBy("slide", "my").orderBy("mx").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("slide", "mx").orderBy("my").rowsBetween(Window.unboundedPreceding, 0)
    return (
        mask.withColumn("__row", F.sum(v).over(along))
        .withColumn("total", F.sum("__row").over(down))
        .select("slide", "mx", "my", "total")
    )


def keep_tissue(cells: DataFrame, min_fraction: float = 0.60) -> DataFrame:
    return cells.where((F.col("area") > 0) & (F.col("fraction") >= min_fraction))


def roi(df: DataFrame, x: int, y: int, w: int, h: int, resume_from: int = 0) -> DataFrame:
    """Tiles whose corner lies in the region, from tile ``resume_from`` on."""
    return df.where(
        (F.col("x0") >= x) & (F.col("x0") < x + w) & (F.col("y0") >= y) & (F.col("y0") < y + h)
        & (F.col("tile_idx") >= resume_from)
    )


def plan_blocks(tiles: DataFrame, step: int, block: int = 8) -> DataFrame:
    """Tiles with their block (by, bx), laid out so that a block's tiles share a partition and a read."""
    keyed = tiles.withColumns(
        {
            "by": F.floor(F.floor(F.col("y0") / step) / block).cast("int"),
            "bx": F.floor(F.floor(F.col("x0") / step) / block).cast("int"),
        }
    )
    return keyed.repartition("slide", "by", "bx").sortWithinPartitions("slide", "by", "bx", "tile_idx")


def block_boxes(planned: DataFrame, step: int) -> DataFrame:
    """Bounding box and tile count per block: what one read has to fetch."""
    return planned.groupBy("slide", "by", "bx").agg(
        F.count("*").alias("n_tiles"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        (F.max("x0") + step).alias("x1"),
        (F.max("y0") + step).alias("y1"),
    )


def tile_rects(scores: DataFrame, tile: int) -> DataFrame:
    """Raster rectangles of scored tiles (tx, ty) on a picture of w by h over a level of wl by hl."""
    sx, sy = F.col("w") / F.col("wl"), F.col("h") / F.col("hl")
    size = lambda s: F.greatest(F.lit(1), F.bround(F.lit(tile) * s, 0).cast("int"))
    px, py = F.bround(F.col("tx") * tile * sx, 0).cast("int"), F.bround(F.col("ty") * tile * sy, 0).cast("int")
    return (
        scores.withColumns({"px": px, "py": py})
        .withColumns(
            {"px1": F.least(F.col("w"), F.col("px") + size(sx)), "py1": F.least(F.col("h"), F.col("py") + size(sy))}
        )
        .where((F.col("px1") > F.col("px")) & (F.col("py1") > F.col("py")))
    )


def axis_index(scores: DataFrame, col: str, out: str, by: list[str]) -> DataFrame:
    """Dense index of the sorted distinct coordinates of each group (at most the slide's tile columns)."""
    w = Window.partitionBy(*by).orderBy(col)
    return scores.select(*by, col).distinct().withColumn(out, (F.row_number().over(w) - 1).cast("int"))


def heat_grid(scores: DataFrame, by: list[str] = ("slide",)) -> DataFrame:
    """Dense (gi, gj) grid per slide with NULL where no tile was scored."""
    by = list(by)
    xs, ys = axis_index(scores, "tx", "gj", by), axis_index(scores, "ty", "gi", by)
    columns = xs.groupBy(*by).agg(F.array_sort(F.collect_list("tx")).alias("__xs"))
    cells = ys.join(columns, by).select(
        *by, "gi", "ty", F.posexplode("__xs").alias("gj", "tx")
    )
    return cells.join(scores.select(*by, "tx", "ty", "score"), [*by, "tx", "ty"], "left").select(
        *by, "gi", "gj", "tx", "ty", "score"
    )
