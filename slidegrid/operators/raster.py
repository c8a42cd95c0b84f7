"""Rasters in long form (slide, x, y, v): thresholds, stencils, objects, tile statistics.

A raster line (one y, or one x) is bounded by the picture's width or height, so windows over lines
are safe however many rows a slide has in total.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from slidegrid.functions import color
from slidegrid.operators.skew import copies_join, spread_join
from slidegrid.session import cut_lineage


def otsu_bins(counted: DataFrame, by: list[str], bins: int = 256, top: float = 255.0) -> DataFrame:
    """Histogram of counted values (__v, __w) per group and bin over [0, top], last bin closed."""
    v = F.col("__v")
    return (
        counted.where((v >= 0) & (v <= top))
        .groupBy(*by, F.least(F.floor(v * bins / top), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.sum("__w").alias("n"))
    )


def otsu(df: DataFrame, by: list[str], value: Column, bins: int = 256, strict_above: float = 0.9) -> DataFrame:
    """Threshold per group by greatest between-class variance.

    When more than ``strict_above`` of a group lies under the threshold, the whole-number mean is used
    instead. Pixels are read once, to count the values of each group; threshold and both shares follow from
    the counts. Windows run over at most ``bins`` rows per group. Returns (by, threshold, fraction).
    """
    counted = cut_lineage(df.where(value.isNotNull()).groupBy(*by, value.alias("__v")).agg(F.count("*").alias("__w")))
    counts = otsu_bins(counted, by, bins)
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    moment = F.col("n") * F.col("bin")
    spread = counts.withColumns(
        {
            "omega": F.sum("n").over(upto) / F.sum("n").over(whole),
            "mu": F.sum(moment).over(upto) / F.sum("n").over(whole),
            "mu_t": F.sum(moment).over(whole) / F.sum("n").over(whole),
        }
    )
    gap = F.col("mu_t") * F.col("omega") - F.col("mu")
    sigma = gap * gap / F.greatest(F.col("omega") * (F.lit(1.0) - F.col("omega")), F.lit(1e-9))
    best = spread.groupBy(*by).agg(F.min_by("bin", F.struct(-sigma, F.col("bin"))).alias("otsu_bin"))
    rows, below = F.sum("__w"), lambda edge: F.sum(F.when(F.col("__v") < F.col(edge), F.col("__w")).otherwise(0)) / F.sum("__w")
    graded = counted.join(best, by) if by else counted.withColumn("otsu_bin", best.scalar())
    shares = graded.groupBy(*by).agg(
        F.max("otsu_bin").alias("otsu_bin"), below("otsu_bin").alias("__f"), F.floor(F.sum(F.col("__v") * F.col("__w")) / rows).cast("int").alias("__mean")
    )
    strict = F.col("__f") > strict_above
    picked = shares.select(*by, F.when(strict, F.col("__mean")).otherwise(F.col("otsu_bin")).cast("int").alias("threshold"), strict.alias("degenerate"))
    final = counted.join(picked, by) if by else counted.withColumns({c: picked.select(c).scalar() for c in ("threshold", "degenerate")})
    return final.groupBy(*by).agg(F.max("threshold").alias("threshold"), F.max("degenerate").alias("degenerate"), below("threshold").alias("fraction"))


def mask_fraction(mask: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    return mask.groupBy(*by).agg(F.avg((F.col(v) > 0).cast("double")).alias("fraction"), F.count("*").alias("n"))


def tile_stats(px: DataFrame, by: list[str]) -> DataFrame:
    """Mean hue, saturation, value and grey variance per tile: one combined aggregate."""
    h, s, v = color.hsv(F.col("r"), F.col("g"), F.col("b"))
    g = color.grey(F.col("r"), F.col("g"), F.col("b"))
    return px.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(h).alias("mean_hue"),
        F.avg(s).alias("mean_saturation"),
        F.avg(v).alias("mean_value"),
        F.avg(g).alias("mean_grey"),
        F.var_pop(g).alias("grey_variance"),
    )


def _mirrored(pos: Column, offset: int, last: Column, border: str) -> Column:
    """Offset that stays inside [0, last] for a neighbour at ``offset``; NULL for ``clip`` outside."""
    p = pos + offset
    if border == "reflect101":
        inside = F.when(p < 0, -p).when(p > last, last * 2 - p).otherwise(p)
    elif border == "reflect":
        inside = F.when(p < 0, -p - 1).when(p > last, last * 2 + 1 - p).otherwise(p)
    elif border == "replicate":
        inside = F.when(p < 0, F.lit(0)).when(p > last, last).otherwise(p)
    elif border == "clip":
        inside = F.when((p >= 0) & (p <= last), p)
    else:
        raise ValueError(f"unknown border {border!r}")
    return inside - pos


def neighbourhood(grid: DataFrame, r: int, border: str = "reflect101", by: list[str] = ("slide",), v: str = "v") -> DataFrame:
    """Adds ``patch``: the (2r+1) squared neighbours of every pixel, row by row.

    Two line windows (along x, then along y) instead of an exploded self-join: the raster is shuffled
    twice at its own size, whatever the kernel. The raster must be dense; a line with a hole stops the job.
    """
    by = list(by)
    along = Window.partitionBy(*by, "y").orderBy("x")
    down = Window.partitionBy(*by, "x").orderBy("y")
    span = range(-r, r + 1)

    def line(df: DataFrame, col: str, pos: str, window, out: str) -> DataFrame:
        whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        named = df.withColumns(
            {f"__n{i}": (F.lag(col, -d) if d < 0 else F.lead(col, d)).over(window) if d else F.col(col) for i, d in enumerate(span)}
            | {"__last": F.max(pos).over(whole)}
        )
        seen = F.array(*[F.col(f"__n{i}") for i in range(2 * r + 1)])
        picks = [F.get(seen, _mirrored(F.col(pos), d, F.col("__last"), border) + r) for d in span]
        before = F.lag(pos).over(window)
        hole = F.when(before.isNull(), F.col(pos) != 0).otherwise(F.col(pos) != before + 1)
        told = F.when(hole, F.raise_error(F.lit("the raster has a hole; fill it first")).cast("boolean")).otherwise(F.lit(True))
        return named.withColumn(out, F.when(told, F.array(*picks))).drop(*[f"__n{i}" for i in range(2 * r + 1)], "__last")

    rows = line(grid, v, "x", along, "__row")
    return line(rows, "__row", "y", down, "__rows").withColumn(
        "patch",
        F.flatten(F.transform("__rows", lambda a: F.coalesce(a, F.array_repeat(F.lit(None), 2 * r + 1)))),
    ).drop("__row", "__rows")


def disk(r: int) -> list[bool]:
    return [dx * dx + dy * dy <= r * r for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def _chosen(patch: Column, footprint: list[bool]) -> Column:
    keep = F.array(*[F.get(patch, F.lit(i)) for i, on in enumerate(footprint) if on])
    return F.filter(keep, lambda x: x.isNotNull())


def _running(a: np.ndarray, width: int, pick: np.ufunc, axis: int) -> np.ndarray:
    """Minimum or maximum of every window of ``width`` along an axis: forward and backward scans of blocks of that width."""
    a = np.moveaxis(a, axis, -1)
    n = a.shape[-1]
    pad = -n % width
    worst = a.max() if pick is np.minimum else a.min()
    blocks = np.concatenate([a, np.full((*a.shape[:-1], pad), worst, a.dtype)], axis=-1).reshape(*a.shape[:-1], -1, width)
    forward = pick.accumulate(blocks, axis=-1).reshape(*a.shape[:-1], -1)
    backward = pick.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(*a.shape[:-1], -1)
    out = pick(backward[..., : n - width + 1], forward[..., width - 1 : n])
    return np.moveaxis(out, -1, axis)


def _line_widths(footprint: list[bool], r: int) -> list[int] | None:
    """Half width of every line of a footprint whose lines are centred runs (a square, a disk); -1 for an empty line, None for other shapes."""
    widths = []
    for line in np.array(footprint, dtype=bool).reshape(2 * r + 1, 2 * r + 1):
        on = np.flatnonzero(line)
        w = (len(on) - 1) // 2 if len(on) else -1
        if len(on) and not (len(on) == 2 * w + 1 and on[0] == r - w and on[-1] == r + w):
            return None
        widths.append(w)
    return widths


def _line_sums(a: np.ndarray, widths: list[int], r: int) -> np.ndarray:
    """Sum over a footprint of every inner pixel, by differences of running sums of lines."""
    h, w = a.shape[0] - 2 * r, a.shape[1] - 2 * r
    run = np.concatenate([np.zeros((a.shape[0], 1), a.dtype), a.cumsum(axis=1)], axis=1)
    if len(set(widths)) == 1:  # a rectangle: running sums of sums
        k = widths[0]
        both = np.concatenate([np.zeros((1, run.shape[1]), a.dtype), run.cumsum(axis=0)])
        wide = both[:, r + k + 1 : r + k + 1 + w] - both[:, r - k : r - k + w]
        return wide[2 * r + 1 :][:h] - wide[:h]
    out = np.zeros((h, w), a.dtype)
    for d, k in enumerate(widths):
        if k >= 0:
            out += run[d : d + h, r + k + 1 : r + k + 1 + w] - run[d : d + h, r - k : r - k + w]
    return out


def _block_values(a: np.ndarray, known: np.ndarray, how: str, widths: list[int], r: int) -> np.ndarray:
    """The stencil of every inner pixel of a block with its margin; ``known`` marks pixels that count."""
    h, w = a.shape[0] - 2 * r, a.shape[1] - 2 * r
    if how in ("min", "max"):
        pick = np.minimum if how == "min" else np.maximum
        a = np.where(known, a, a[known].max() if how == "min" else a[known].min())
        out = None
        for k in sorted(set(widths) - {-1}):
            run = _running(a[:, r - k : a.shape[1] - r + k], 2 * k + 1, pick, 1)
            for d in [d for d, x in enumerate(widths) if x == k]:
                out = run[d : d + h] if out is None else pick(out, run[d : d + h])
        return out
    n = _line_sums(known.astype(np.int64), widths, r)
    if how == "mean":
        return _line_sums(np.where(known, a, 0).astype(np.float64), widths, r) / n
    # The median: the least value that more than half of the window's pixels do not exceed.
    out, need = np.zeros((h, w), a.dtype), n // 2
    left = np.ones((h, w), dtype=bool)
    for v in np.unique(a[known]):
        below = _line_sums((known & (a <= v)).astype(np.int64), widths, r) > need
        out[left & below] = v
        left &= ~below
        if not left.any():
            break
    return out


#: Side of a block of a large stencil.
BLOCK_SIDE = 256
_PADDING = {"reflect101": "reflect", "reflect": "symmetric", "replicate": "edge"}


def _in_blocks(grid: DataFrame, by: list[str], values: list[str], r: int, side: int) -> DataFrame:
    """Pixels with their block (__bx, __by) and their picture's last places (__w, __h); once more for every block within ``r``."""
    lasts = grid.groupBy(*by).agg(F.max("x").cast("long").alias("__w"), F.max("y").cast("long").alias("__h"))
    near = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / side) for d in (-r, 0, r)])))
    dealt = grid.select(*by, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *values).withColumn("__bx", near("x")).withColumn("__by", near("y"))
    return copies_join(dealt, lasts, by, salt_on=["x", "y"]).where(
        (F.col("__bx") >= 0) & (F.col("__by") >= 0) & (F.col("__bx") * side <= F.col("__w")) & (F.col("__by") * side <= F.col("__h")))


def _step(a: np.ndarray, edges: list[tuple[bool, bool]], how: str, r: int, shape: list, border: str) -> np.ndarray:
    """One stencil of a part of a picture, which is padded at the picture's ``edges`` and shrinks by ``r`` elsewhere."""
    pads = [(r * first, r * last) for first, last in edges]
    known = np.pad(np.ones(a.shape, dtype=bool), pads, constant_values=border != "clip")
    a = np.pad(a, pads, mode="edge" if border == "clip" else _PADDING[border])
    if how in ("min", "max"):
        return _block_values(a, known, how, _line_widths(shape, r), r)
    h, w = a.shape[0] - 2 * r, a.shape[1] - 2 * r
    views = [a[dy:dy + h, dx:dx + w] for dy in range(2 * r + 1) for dx in range(2 * r + 1)]
    if how == "median":
        return np.partition(np.stack(views), len(views) // 2, axis=0)[len(views) // 2]
    total = reduce(add, (view.astype(np.float64) * weight for view, weight in zip(views, shape, strict=True) if weight))
    size = np.abs(total)
    whole = np.floor(size)
    return (np.sign(total) * (whole + (size - whole >= 0.5))).astype(np.int32)


def chained_stencils(
    grid: DataFrame, steps: list[tuple[str, int, list, str]], by: list[str] = ("slide",), values: list[str] = ("v",), side: int = BLOCK_SIDE
) -> DataFrame:
    """Several stencils in a row, for each of the columns ``values``: steps (how, r, weights or footprint, border).

    ``how`` is weighted (rounded to whole numbers), median (over a square, with a border other than ``clip``), min or max. Every block of
    pixels goes to one task with a margin that is enough for all steps together, so pixels are shuffled once, whatever the number of steps.
    The raster must be dense, and every pixel has a value.
    """
    by, values, margin = list(by), list(values), sum(r for _, r, _, _ in steps)
    side, kinds = max(side, margin + 1), dict(grid.dtypes)
    whole = any(how == "weighted" for how, *_ in steps)
    made = {c: "int" if whole else kinds[c] for c in values}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        corner = (key[len(by) + 1].as_py() * side, key[len(by)].as_py() * side)
        ends = tuple(table.column(c)[0].as_py() for c in ("__h", "__w"))
        first = [max(at - margin, 0) for at in corner]
        last = [min(at + side - 1 + margin, end) for at, end in zip(corner, ends)]
        x, y = table.column("x").to_numpy() - first[1], table.column("y").to_numpy() - first[0]
        seen = np.zeros((last[0] - first[0] + 1, last[1] - first[1] + 1), dtype=bool)
        seen[y, x] = True
        if not seen.all():
            raise ValueError("the raster has a hole; fill it first")
        size = [min(side, end - at + 1) for at, end in zip(corner, ends)]
        columns = []
        for c in values:
            if table.column(c).null_count:
                raise ValueError("the raster has a pixel without a value; fill it first")
            a = np.zeros(seen.shape, table.column(c).to_numpy().dtype)
            a[y, x] = table.column(c).to_numpy()
            low, high = list(first), list(last)
            for how, r, shape, border in steps:
                edges = [(lo == 0, hi == end) for lo, hi, end in zip(low, high, ends)]
                a = _step(a, edges, how, r, shape, border)
                low = [lo + r * (not edge[0]) for lo, edge in zip(low, edges)]
                high = [hi - r * (not edge[1]) for hi, edge in zip(high, edges)]
            at = [begin - lo for begin, lo in zip(corner, low)]
            columns.append(pa.array(a[at[0]:at[0] + size[0], at[1]:at[1] + size[1]].ravel()))
        yy, xx = np.mgrid[corner[0]:corner[0] + size[0], corner[1]:corner[1] + size[1]]
        fixed = [pa.array([k.as_py()] * xx.size, k.type) for k in key[: len(by)]]
        return pa.table([*fixed, pa.array(xx.ravel(), pa.int64()), pa.array(yy.ravel(), pa.int64()), *columns], names=[*by, "x", "y", *values])

    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + ["x long", "y long"] + [f"{c} {kind}" for c, kind in made.items()])
    out = _in_blocks(grid, by, values, margin, side).groupBy(*by, "__bx", "__by").applyInArrow(run, schema)
    return out.select(*[F.col(c).cast(kinds[c]) if c in ("x", "y") else F.col(c) for c in grid.columns])


def blocked_stencil(
    grid: DataFrame, how: str, r: int, footprint: list[bool] | None = None, border: str = "reflect101", by: list[str] = ("slide",), v: str = "v", side: int = BLOCK_SIDE
) -> DataFrame:
    """``stencil`` for large kernels: mean, median, min or max over a square or a disk.

    Every block of pixels goes to a task with a margin of ``r``, so a pixel is shuffled once, and again only near block edges. Costs do not
    grow with the kernel's area: extremes by running scans, means and medians by differences of running sums (a median takes one pass per
    value that occurs). The raster must be dense, and no smaller than ``r`` + 1 in either direction unless the border is ``clip``.
    """
    by, side = list(by), max(side, r + 1)
    widths = _line_widths(footprint or [True] * (2 * r + 1) ** 2, r)
    if how not in ("mean", "median", "min", "max") or widths is None or border not in (*_PADDING, "clip"):
        raise ValueError("a large stencil is the mean, median, min or max over a centred shape")
    rest = [c for c in grid.columns if c not in {*by, "x", "y", v}]
    if rest:
        raise ValueError(f"columns besides the pixel: {rest}")
    placed = _in_blocks(grid, by, [v], r, side)
    kinds = dict(grid.dtypes)
    kind = "double" if how == "mean" else kinds[v]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bx, by_ = key[len(by)].as_py(), key[len(by) + 1].as_py()
        x, y, value = (table.column(c).to_numpy() for c in ("x", "y", v))
        last_x, last_y = table.column("__w")[0].as_py(), table.column("__h")[0].as_py()
        x0, y0 = max(bx * side - r, 0), max(by_ * side - r, 0)
        x1, y1 = min((bx + 1) * side - 1 + r, last_x), min((by_ + 1) * side - 1 + r, last_y)
        a, seen = np.zeros((y1 - y0 + 1, x1 - x0 + 1), value.dtype), np.zeros((y1 - y0 + 1, x1 - x0 + 1), dtype=bool)
        a[y - y0, x - x0], seen[y - y0, x - x0] = value, True
        if not seen.all():
            raise ValueError("the raster has a hole; fill it first")
        # What the block lacks of its margin lies beyond the picture.
        beyond = [(max(0, r - by_ * side), max(0, (by_ + 1) * side - 1 + r - last_y)), (max(0, r - bx * side), max(0, (bx + 1) * side - 1 + r - last_x))]
        pads = [(lo, min(hi, r)) for lo, hi in beyond]
        known = np.pad(seen, pads, constant_values=border != "clip")
        a = np.pad(a, pads, mode="edge" if border == "clip" else _PADDING[border])
        out = _block_values(a, known, how, widths, r)
        h, w = out.shape
        yy, xx = np.mgrid[by_ * side : by_ * side + h, bx * side : bx * side + w]
        fixed = [pa.array([k.as_py()] * out.size, k.type) for k in key[: len(by)]]
        return pa.table([*fixed, pa.array(xx.ravel(), pa.int64()), pa.array(yy.ravel(), pa.int64()), pa.array(out.ravel())], names=[*by, "x", "y", v])

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + f", x long, y long, {v} {kind}"
    out = placed.groupBy(*by, "__bx", "__by").applyInArrow(run, schema)
    return out.select(*[F.col(c).cast(kinds[c]) if c in ("x", "y") else F.col(c) for c in grid.columns])


def stencil(
    grid: DataFrame,
    how: str,
    r: int = 1,
    weights: list[float] | None = None,
    footprint: list[bool] | None = None,
    border: str = "reflect101",
    by: list[str] = ("slide",),
    v: str = "v",
) -> DataFrame:
    """Replace ``v`` by mean, weighted, median, min or max of its neighbourhood; from r = 4 on see ``blocked_stencil``."""
    foot = footprint or [True] * (2 * r + 1) ** 2
    if r >= 4 and how != "weighted" and set(grid.columns) == {*by, "x", "y", v} and _line_widths(foot, r) is not None:
        return blocked_stencil(grid, how, r, foot, border, by, v)
    df = neighbourhood(grid, r, border, by, v)
    patch = F.col("patch")
    if how == "weighted":
        terms = [F.get(patch, F.lit(i)).cast("double") * F.lit(float(w)) for i, w in enumerate(weights) if w]
        value = sum(terms[1:], terms[0])
    else:
        chosen = _chosen(patch, foot)
        if how == "mean":
            value = F.aggregate(chosen, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(chosen)
        elif how == "median":
            value = F.element_at(F.array_sort(chosen), F.floor(F.size(chosen) / 2).cast("int") + 1)
        elif how == "min":
            value = F.array_min(chosen)
        elif how == "max":
            value = F.array_max(chosen)
        else:
            raise ValueError(f"unknown stencil {how!r}")
    return df.withColumn(v, value).drop("patch")


# 3 by 3 kernels.
GAUSSIAN_3 = [1 / 16, 2 / 16, 1 / 16, 2 / 16, 4 / 16, 2 / 16, 1 / 16, 2 / 16, 1 / 16]
LAPLACIAN_3 = [0, 1, 0, 1, -4, 1, 0, 1, 0]


def erode(grid: DataFrame, r: int = 1, border: str = "clip", **kw) -> DataFrame:
    return stencil(grid, "min", r, footprint=disk(r), border=border, **kw)


def dilate(grid: DataFrame, r: int = 1, border: str = "clip", **kw) -> DataFrame:
    return stencil(grid, "max", r, footprint=disk(r), border=border, **kw)


def _bare(grid: DataFrame, by: list[str] = ("slide",), v: str = "v") -> bool:
    return set(grid.columns) == {*by, "x", "y", v}


def open_(grid: DataFrame, r: int = 1, border: str = "clip", **kw) -> DataFrame:
    if _bare(grid, **kw):
        return chained_stencils(grid, [(how, r, disk(r), border) for how in ("min", "max")], kw.get("by", ("slide",)), [kw.get("v", "v")])
    return dilate(erode(grid, r, border, **kw), r, border, **kw)


def close_(grid: DataFrame, r: int = 1, border: str = "clip", **kw) -> DataFrame:
    if _bare(grid, **kw):
        return chained_stencils(grid, [(how, r, disk(r), border) for how in ("max", "min")], kw.get("by", ("slide",)), [kw.get("v", "v")])
    return erode(dilate(grid, r, border, **kw), r, border, **kw)


def gaussian_weights(size: int) -> list[float]:
    """Square Gaussian kernel of an odd size: binomial lines up to 5, else sigma = 0.3 * ((size - 1) / 2 - 1) + 0.8."""
    if size % 2 == 0:
        raise ValueError("a kernel has an odd size")
    if size <= 5:
        line = np.array({1: [1], 3: [1, 2, 1], 5: [1, 4, 6, 4, 1]}[size], dtype=float)
    else:
        at = np.arange(size) - size // 2
        line = np.exp(-(at ** 2) / (2 * (0.3 * ((size - 1) * 0.5 - 1) + 0.8) ** 2))
    line /= line.sum()
    return np.outer(line, line).ravel().tolist()


def denoise_steps(r: int = 1, gaussian: int = 3, median: int = 3) -> list[tuple[str, int, list, str]]:
    """The steps of ``denoise`` for ``chained_stencils``; sizes are odd."""
    blur = [("weighted", gaussian // 2, gaussian_weights(gaussian), "reflect101")] if gaussian > 1 else []
    calm = [("median", median // 2, [], "replicate")] if median > 1 else []
    return [*blur, *calm, *([("min", r, disk(r), "clip"), ("max", r, disk(r), "clip")] if r else [])]


def denoise(grid: DataFrame, r: int = 1, gaussian: int = 3, median: int = 3, **kw) -> DataFrame:
    """Gaussian, then median (which repeats the edge, as median filters do), then opening with a disk of radius ``r``.

    ``gaussian`` and ``median`` are odd kernel sizes; even ones count as the next odd one, and 1 leaves that step out.
    """
    gaussian, median = gaussian | 1, median | 1
    if _bare(grid, kw.get("by", ("slide",))) and set(kw) <= {"by"}:
        steps = denoise_steps(r, gaussian, median)
        return chained_stencils(grid, steps, **kw) if steps else grid
    blurred = grid if gaussian == 1 else stencil(grid, "weighted", gaussian // 2, weights=gaussian_weights(gaussian), **kw).withColumn("v", F.round("v").cast("int"))
    calm = blurred if median == 1 else stencil(blurred, "median", median // 2, **{**kw, "border": "replicate"})
    return open_(calm, r, **kw) if r else calm


def focus_scores(grid: DataFrame, by: list[str]) -> DataFrame:
    """Population variance of the Laplacian per tile, mirrored at the border."""
    edges = stencil(grid, "weighted", 1, weights=LAPLACIAN_3, by=by)
    return edges.groupBy(*by).agg(F.var_pop("v").alias("focus_score"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: (id, label), label being the least id of the component.

    Every round takes the least label among neighbours, then jumps to the label's own label, so long
    thin shapes settle in few rounds. Rounds go on until nothing changes; each step is checkpointed.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    both = cut_lineage(both)
    labels = nodes.select("id", F.col("id").alias("label"))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("__near"))
        hooked = cut_lineage(labels.join(near, "id", "left").select(
            "id", F.col("label").alias("__old"), F.least("label", F.coalesce("__near", F.col("label"))).alias("__mid")
        ))
        jump = hooked.select(F.col("id").alias("__mid"), F.col("__mid").alias("__up"))
        stepped = spread_join(hooked, jump, ["__mid"], "left", salt_on=["id"]).select(
            "id", "__old", F.least("__mid", F.coalesce("__up", F.col("__mid"))).alias("label")
        )
        stepped = cut_lineage(stepped)
        labels = stepped.select("id", "label")
        if stepped.where(F.col("label") != F.col("__old")).isEmpty():
            return labels


def _labelled_runs(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Horizontal runs (y, first x, last x) of a block's pixels and, for each, the first run of its 4-connected object."""
    order = np.lexsort((x, y))
    y, x = y[order], x[order]
    fresh = np.r_[True, (np.diff(y) != 0) | (np.diff(x) > 1)]
    first = np.flatnonzero(fresh)
    ry, x0, x1 = y[first], x[first], x[np.r_[first[1:] - 1, len(x) - 1]]
    up = list(range(len(ry)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    line = {int(v): (int(a), int(b)) for v, a, b in zip(*_line_bounds(ry))}
    for v, (i, end) in line.items():
        j, stop = line.get(v - 1, (0, 0))
        while i < end and j < stop:
            if x0[i] <= x1[j] and x0[j] <= x1[i]:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
            if x1[i] < x1[j]:
                i += 1
            else:
                j += 1
    return ry, x0, x1, np.array([find(i) for i in range(len(ry))])


def _line_bounds(ry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lines, begin = np.unique(ry, return_index=True)
    return lines, begin, np.r_[begin[1:], len(ry)]


#: Lines and columns of a block whose objects are found in one task.
BLOCK_LINES, BLOCK_COLUMNS = 512, 2048


def labelled_runs(mask: DataFrame, by: list[str] = ("slide",), lines: int = BLOCK_LINES, columns: int = BLOCK_COLUMNS) -> DataFrame:
    """(by, y, x0, x1, id): horizontal runs of set pixels, and the object of their block (named by its first run).

    Blocks are bounded, so their union-find runs in tasks of bounded memory, and a pixel is shuffled once.
    """
    by = list(by)
    block = [F.floor(F.col("y") / lines).alias("__by"), F.floor(F.col("x") / columns).alias("__bx")]
    lit = mask.where("v > 0").select(*by, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).select("*", *block)
    kinds = dict(lit.dtypes)

    def label(key: tuple, table: pa.Table) -> pa.Table:
        ry, x0, x1, root = _labelled_runs(table.column("y").to_numpy(), table.column("x").to_numpy())
        names = [*by, "y", "x0", "x1", "ly", "lx"]
        fixed = [pa.array([k.as_py()] * len(ry), k.type) for k in key[: len(by)]]
        return pa.table([*fixed, *[pa.array(v, pa.int64()) for v in (ry, x0, x1, ry[root], x0[root])]], names=names)

    runs = lit.groupBy(*by, "__by", "__bx").applyInArrow(label, ", ".join(f"{c} {kinds[c]}" for c in by) + ", y long, x0 long, x1 long, ly long, lx long")
    return runs.select(*by, "y", "x0", "x1", F.struct(*by, F.col("ly").alias("y"), F.col("lx").alias("x0")).alias("id"))


def border_edges(runs: DataFrame, by: list[str], lines: int = BLOCK_LINES, columns: int = BLOCK_COLUMNS) -> DataFrame:
    """(a, b): objects of neighbouring blocks that touch across the border; only pixels on borders are looked at."""
    by = list(by)
    here = runs.where((F.col("y") + 1) % lines == 0).select(*by, (F.col("y") + 1).alias("y"), F.explode(F.sequence("x0", "x1")).alias("x"), F.col("id").alias("a"))
    below = runs.where(F.col("y") % lines == 0).select(*by, "y", F.explode(F.sequence("x0", "x1")).alias("x"), F.col("id").alias("b"))
    left = runs.where((F.col("x1") + 1) % columns == 0).select(*by, "y", (F.col("x1") + 1).alias("x"), F.col("id").alias("a"))
    right = runs.where(F.col("x0") % columns == 0).select(*by, "y", F.col("x0").alias("x"), F.col("id").alias("b"))
    ends = [here.join(below, [*by, "y", "x"]).select("a", "b"), left.join(right, [*by, "y", "x"]).select("a", "b")]
    return ends[0].unionByName(ends[1]).distinct()


def remove_small(mask: DataFrame, min_area: int, by: list[str] = ("slide",), lines: int = BLOCK_LINES, columns: int = BLOCK_COLUMNS) -> DataFrame:
    """Set pixels of 4-connected objects larger than ``min_area``: (by, x, y, area).

    Two levels: objects inside blocks first, then components of the objects that touch across borders. Objects that
    touch no border are finished at the first level and take no part in the second.
    """
    by = list(by)
    runs = cut_lineage(labelled_runs(mask, by, lines, columns))
    sizes = runs.groupBy("id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    edges = cut_lineage(border_edges(runs, by, lines, columns))
    if edges.isEmpty():
        grouped = sizes.withColumn("label", F.col("id"))
    else:
        ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        grouped = cut_lineage(sizes.join(components(ends, edges), "id", "left").withColumn("label", F.coalesce("label", "id")))
    large = grouped.groupBy("label").agg(F.sum("n").alias("area")).where(F.col("area") > min_area)
    keep = spread_join(grouped, large, ["label"], salt_on=["id"]).select("id", "area")
    kept = spread_join(runs, keep, ["id"], salt_on=["y", "x0"])
    return kept.select(*by, F.explode(F.sequence(F.col("x0").cast("int"), F.col("x1").cast("int"))).alias("x"), F.col("y").cast("int").alias("y"), "area")


def compare_rasters(a: DataFrame, b: DataFrame, by: list[str], min_ncc: float = 0.85, every: int = 1) -> DataFrame:
    """Correlation, mean absolute and mean difference of two pixel tables per tile, and the verdict.

    Two flat tiles agree; one flat and one not disagree. ``every`` checks each n-th tile only.
    """
    tile = by[-1]
    left = a.where(F.col(tile) % every == 0).select(*by, "x", "y", F.col("v").cast("double").alias("va"))
    pair = left.join(b.select(*by, "x", "y", F.col("v").cast("double").alias("vb")), [*by, "x", "y"])
    stats = pair.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.stddev_pop("va").alias("__sa"),
        F.stddev_pop("vb").alias("__sb"),
        F.try_divide(F.covar_pop("va", "vb"), F.stddev_pop("va") * F.stddev_pop("vb")).alias("ncc"),
        F.avg(F.abs(F.col("va") - F.col("vb"))).alias("mad"),
        F.avg(F.col("va") - F.col("vb")).alias("mean_diff"),
    )
    flat_a, flat_b = F.col("__sa") < 1e-6, F.col("__sb") < 1e-6
    good = F.when(flat_a | flat_b, flat_a == flat_b).otherwise(F.col("ncc") >= min_ncc)
    return stats.withColumn("ok", good).withColumn("ncc", F.when(~(flat_a | flat_b), F.col("ncc"))).drop("__sa", "__sb")


def area_weights(src: int, dst: int) -> list[tuple[int, int, float]]:
    """1-D (src, dst, weight) of area averaging down from ``src`` to ``dst`` cells."""
    out = []
    for j in range(dst):
        lo, hi = (j * src) // dst, -(-((j + 1) * src) // dst)
        out += [(i, j, 1.0 / (hi - lo)) for i in range(lo, hi)]
    return out


def bilinear_weights(src: int, dst: int) -> list[tuple[int, int, float]]:
    """1-D (src, dst, weight) of half-pixel-centred linear interpolation up from ``src`` to ``dst``."""
    out = []
    for j in range(dst):
        at = max(0.0, (j + 0.5) * src / dst - 0.5)
        i = min(int(at), src - 1)
        t = at - i
        out.append((i, j, 1.0 - t))
        if t > 0:
            out.append((min(i + 1, src - 1), j, t))
    return out


def resample(grid: DataFrame, weights: list[tuple[int, int, float]], by: list[str], v: str = "v") -> DataFrame:
    """Separable resampling of an array-valued grid (gx, gy, v array) by a small weight list.

    The list has a handful of entries per line (it depends on the two sizes only), so it travels as
    literals: each cell is unrolled onto its targets and one combined aggregate adds them up.
    """
    targets: dict[int, list[tuple[int, float]]] = {}
    for s, d, w in weights:
        targets.setdefault(s, []).append((d, w))
    literal = F.create_map(
        *[
            part
            for s, pairs in targets.items()
            for part in (F.lit(s), F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in pairs]))
        ]
    )
    moved = (
        grid.withColumn("__tx", F.explode(literal[F.col("gx")]))
        .withColumn("__ty", F.explode(literal[F.col("gy")]))
        .select(
            *by,
            F.col("__tx.d").alias("gx"),
            F.col("__ty.d").alias("gy"),
            F.posexplode(F.transform(v, lambda x: x.cast("double") * F.col("__tx.w") * F.col("__ty.w"))).alias("k", "__p"),
        )
    )
    summed = moved.groupBy(*by, "gx", "gy", "k").agg(F.sum("__p").alias("__p"))
    return summed.groupBy(*by, "gx", "gy").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "__p"))), lambda s: s["__p"]).alias(v)
    )
