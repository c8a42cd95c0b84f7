"""Colour and stain normalisation of pixel rows (by, r, g, b).

Statistics per tile are aggregates with map-side combine, counts of 8-bit values or exact quantiles; the
pixels themselves are only scanned again to apply a handful of numbers per tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, functions as F

from slidegrid.functions import color
from slidegrid.operators.ordered import group_quantiles, large_groups, weighed_quantiles
from slidegrid.operators.skew import copies_join
from slidegrid.session import cut_lineage, scratch_folder

# Reference stain matrix (rows r, g, b; columns haematoxylin, eosin) and top concentrations.
HE_REFERENCE = [[0.5626, 0.2159], [0.7201, 0.8012], [0.4062, 0.5581]]
MAX_C_REFERENCE = [1.9705, 1.0308]
# Channel means aimed at by mean scaling; LAB targets of colour transfer.
CHANNEL_TARGETS = {"r": 0.45, "g": 0.35, "b": 0.45}
LAB_TARGET_MEAN_L, LAB_TARGET_STD_L = 0.5, 0.25
LAB_TARGET_AB_MEAN, LAB_TARGET_AB_STD = 128.0, 50.0


def _byte(x: Column) -> Column:
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))).cast("int")


def _places(px: DataFrame, by: list[str]) -> list[str]:
    """What tells pixels of a tile apart: their position where there is one. Equal colours must not share a salt."""
    return [c for c in px.columns if c not in {*by, "r", "g", "b"}] or ["r", "g", "b"]


def percentile_scale(px: DataFrame, by: list[str], low: float = 1.0, high: float = 99.0) -> DataFrame:
    """Stretch each channel's low-to-high percentile range to 0-255; a flat channel passes through."""
    long = px.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), F.col(c).alias("v")) for c in "rgb"])).alias("p"))
    q = group_quantiles(
        long.select(*by, "p.ch", "p.v"), [*by, "ch"], "v", {"lo": low / 100, "hi": high / 100}, bounded=True
    )
    wide = q.groupBy(*by).agg(
        *[F.max(F.when(F.col("ch") == c, F.col(s))).alias(f"__{s}_{c}") for c in "rgb" for s in ("lo", "hi")]
    )
    joined = copies_join(px, wide, by, salt_on=_places(px, by))
    scaled = {}
    for c in "rgb":
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        scaled[f"{c}2"] = F.when(hi > lo, _byte((F.col(c) - lo) / (hi - lo) * 255.0)).otherwise(F.col(c).cast("int"))
    return joined.withColumns(scaled).select(*px.columns, "r2", "g2", "b2")


def colour_transfer(px: DataFrame, by: list[str]) -> DataFrame:
    """LAB mean and spread of every tile moved to the target; a flat channel passes through.

    Adds l2, a2, b2_ (8-bit LAB) and the colours r2, g2, b2.
    """
    l8, a8, b8 = color.lab(F.col("r"), F.col("g"), F.col("b"))
    work = px.withColumns({"__l": F.round(l8), "__a": F.round(a8), "__b": F.round(b8)})
    stats = work.groupBy(*by).agg(
        *[f(f"__{c}").alias(f"__{n}_{c}") for c in "lab" for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    )
    goals = {
        "l": (LAB_TARGET_MEAN_L * 255, LAB_TARGET_STD_L * 255),
        "a": (LAB_TARGET_AB_MEAN, LAB_TARGET_AB_STD),
        "b": (LAB_TARGET_AB_MEAN, LAB_TARGET_AB_STD),
    }
    joined = copies_join(work, stats, by, salt_on=_places(px, by))
    moved = {}
    for c, (mean, std) in goals.items():
        v, m, s = F.col(f"__{c}"), F.col(f"__m_{c}"), F.col(f"__s_{c}")
        moved[f"lab_{c}"] = _byte(F.when(s > 0, (v - m) / s * std + mean).otherwise(v))
    out = joined.withColumns(moved)
    rgb = color.lab_to_rgb(F.col("lab_l"), F.col("lab_a"), F.col("lab_b"))
    return out.withColumns({f"{c}2": _byte(x) for c, x in zip("rgb", rgb)}).select(
        *px.columns, "lab_l", "lab_a", "lab_b", "r2", "g2", "b2"
    )


def mean_scale(px: DataFrame, by: list[str], target: dict[str, float] = CHANNEL_TARGETS) -> DataFrame:
    """Scale every channel so that its tile mean meets the target; a black channel passes through."""
    means = px.groupBy(*by).agg(*[F.avg(c).alias(f"__m_{c}") for c in "rgb"])
    joined = copies_join(px, means, by, salt_on=_places(px, by))
    scaled = {
        f"{c}2": _byte(
            F.when(F.col(f"__m_{c}") > 0, F.col(c) * (F.lit(target[c] * 255.0) / F.col(f"__m_{c}"))).otherwise(F.col(c))
        )
        for c in "rgb"
    }
    return joined.withColumns(scaled).select(*px.columns, "r2", "g2", "b2")


def _colour_quantiles(colours: DataFrame, by: list[str], cols: list[str], probs: dict[str, float], large: bool) -> DataFrame:
    """Quantiles of columns of ``distinct_colours``, colours counting by their pixels: (by, <column>_<name>...).

    ``large`` tiles are ordered in buckets, others whole.
    """
    if not large:
        return weighed_quantiles(colours, by, cols, probs, "n_px")
    long = colours.select(
        *by, "n_px", F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), F.col(c).alias("v")) for c in cols])).alias("p")
    ).select(*by, "n_px", "p.ch", "p.v")
    q = group_quantiles(long, [*by, "ch"], "v", probs, weight="n_px")
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("ch") == c, F.col(k))).alias(f"{c}_{k}") for c in cols for k in probs])


def _by_size(colours: DataFrame, by: list[str], solve: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``solve(colours, large)`` of the tiles with few colours and, by itself, of those with too many for one task."""
    large = large_groups(colours, by)
    if large.isEmpty():
        return solve(colours, False)
    return solve(colours.join(large, by, "left_anti"), False).unionByName(solve(colours.join(large, by, "left_semi"), True))


def distinct_colours(px: DataFrame, by: list[str]) -> DataFrame:
    """(by, r, g, b, n_px): the colours of every tile with their number of pixels, combined before the shuffle.

    Stain statistics depend on colours alone, so everything after this works on a fraction of the
    pixels, and a white background is one row per tile. Written once as columns to the shared folder, as it is read
    several times: rows of a checkpoint cost more to read than what is done with them.
    """
    folder, colours = f"{scratch_folder(px.sparkSession)}/colours", px.groupBy(*by, "r", "g", "b").agg(F.count("*").alias("n_px"))
    colours.write.parquet(folder)
    return px.sparkSession.read.schema(colours.schema).parquet(folder)


def stain_percentile(px: DataFrame, by: list[str], low: float = 1.0, high: float = 99.0) -> DataFrame:
    """Unmix into stains, stretch haematoxylin and eosin to their percentile range, mix back."""
    h, e, d = color.unmix(F.col("r"), F.col("g"), F.col("b"))
    stained = distinct_colours(px, by).select(*by, "n_px", h.alias("h"), e.alias("e"))
    probs = {"lo": low / 100, "hi": high / 100}
    ends = _by_size(stained, by, lambda some, large: _colour_quantiles(some, by, ["h", "e"], probs, large))
    joined = copies_join(px, ends, by, salt_on=_places(px, by))

    def stretched(x: Column, s: str) -> Column:
        lo, hi = F.col(f"{s}_lo"), F.col(f"{s}_hi")
        return F.when(hi > lo, F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))).otherwise(x)

    rgb = color.remix(stretched(h, "h"), stretched(e, "e"), d)
    return joined.withColumns({f"{c}2": _byte(x) for c, x in zip("rgb", rgb)}).select(*px.columns, "r2", "g2", "b2")


def drop_transparent(px: DataFrame, by: list[str], beta: float = 0.15, io: float = 240.0, min_px: int = 10) -> DataFrame:
    """Pixels whose every density channel reaches ``beta``; a tile with fewer than ``min_px`` is kept whole."""
    dense = F.least(*[color.optical_density(F.col(c), io) for c in "rgb"]) >= beta
    kept = px.groupBy(*by).agg(F.count_if(dense).alias("__dense"))
    return copies_join(px, kept, by, salt_on=_places(px, by)).where((F.col("__dense") < min_px) | dense).drop("__dense")


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]


def _inner(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _named(name: str, values: list[Column]) -> dict[str, Column]:
    return {f"{name}{i}": v for i, v in enumerate(values)}


def _vector(name: str) -> list[Column]:
    return [F.col(f"{name}{i}") for i in range(3)]


def stain_axes(moments: DataFrame, by: list[str]) -> DataFrame:
    """(by, second, largest): unit eigenvectors of the two largest eigenvalues of symmetric 3 by 3 matrices c00, c01, c02, c11, c12, c22.

    Closed form: the eigenvalue that stands farthest from the others, from the angle of the scaled determinant; its
    eigenvector as the longest cross product of two rows of the shifted matrix (a coordinate axis if all three eigenvalues agree);
    and in the plane at right angles to it the half-angle formula for the other two. Every axis points where its components add up
    to no less than zero. Of a repeated eigenvalue any axis is as good.
    """
    c = [[F.col(f"c{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    q, p = F.col("__q"), F.col("__p")
    own = [[c[i][j] - q if i == j else c[i][j] for j in range(3)] for i in range(3)]
    out = moments.withColumn("__q", (c[0][0] + c[1][1] + c[2][2]) / 3)
    out = out.withColumns({"__p": F.sqrt(sum((own[i][j] * own[i][j] for i in range(3) for j in range(3)), F.lit(0.0)) / 6), "__det": _inner(own[0], _cross(own[1], own[2]))})
    half = F.least(F.greatest(F.try_divide(F.col("__det"), 2 * p * p * p), F.lit(-1.0)), F.lit(1.0))
    out = out.withColumn("__half", F.coalesce(F.when(p > 0, half), F.lit(0.0)))
    top = F.col("__half") >= 0  # the largest eigenvalue stands apart; else the least does
    out = out.withColumn("__root", q + 2 * p * F.cos(F.acos("__half") / 3 + F.when(top, 0.0).otherwise(2 * math.pi / 3)))
    rows = [[c[i][j] - F.col("__root") if i == j else c[i][j] for j in range(3)] for i in range(3)]
    for k, (i, j) in enumerate([(0, 1), (0, 2), (1, 2)]):
        out = out.withColumns(_named(f"__x{k}_", _cross(rows[i], rows[j])))
    out = out.withColumns({f"__n{k}": _inner(_vector(f"__x{k}_"), _vector(f"__x{k}_")) for k in range(3)})
    longest = F.greatest("__n0", "__n1", "__n2")
    pick = [F.when(F.col("__n0") == longest, F.col(f"__x0_{i}")).when(F.col("__n1") == longest, F.col(f"__x1_{i}")).otherwise(F.col(f"__x2_{i}")) for i in range(3)]
    out = out.withColumns(_named("__v", [F.when(longest > 0, x / F.sqrt(longest)).otherwise(float(i == 2)) for i, x in enumerate(pick)]))
    v = _vector("__v")
    size = [F.abs(x) for x in v]
    far = F.when(size[0] <= F.least(size[1], size[2]), 0).when(size[1] <= size[2], 1).otherwise(2)
    out = out.withColumns(_named("__y", _cross(v, [F.when(far == i, 1.0).otherwise(0.0) for i in range(3)])))
    y = _vector("__y")
    out = out.withColumns(_named("__u", [x / F.sqrt(_inner(y, y)) for x in y]))
    u = _vector("__u")
    out = out.withColumns(_named("__w", _cross(v, u)))
    w = _vector("__w")
    image = lambda a: [_inner(c[i], a) for i in range(3)]
    out = out.withColumn("__angle", F.atan2(2 * _inner(u, image(w)), _inner(u, image(u)) - _inner(w, image(w))) / 2)
    along = [F.cos("__angle") * a + F.sin("__angle") * b for a, b in zip(u, w)]  # the larger of the other two
    across = [F.cos("__angle") * b - F.sin("__angle") * a for a, b in zip(u, w)]
    out = out.withColumns(_named("__s", [F.when(top, a).otherwise(b) for a, b in zip(along, across)]) | _named("__a", [F.when(top, a).otherwise(b) for a, b in zip(v, along)]))
    up = lambda v: [F.when(v[0] + v[1] + v[2] < 0, -x).otherwise(x) for x in v]
    return out.select(*by, F.array(*up(_vector("__s"))).alias("second"), F.array(*up(_vector("__a"))).alias("largest"))


def stain_vectors(
    px: DataFrame, by: list[str], io: float = 240.0, alpha: float = 1.0, beta: float = 0.15, min_px: int = 10
) -> DataFrame:
    """Per tile: haematoxylin and eosin vectors (h1..h3, e1..e3), the least-squares solver built from them
    (u0..u2, w0..w2), and 99th percentile concentrations (max_h, max_e).

    Pixels are read once, for the distinct colours of each tile; all that follows weighs colours by
    their pixels. Covariances are aggregates, their 3 by 3 eigenproblem is column arithmetic (``stain_axes``),
    angles and concentrations are exact quantiles. Tiles with too few dense pixels are left out. Tiles with so many
    colours that no task should order them are dealt into salted pieces and buckets; all others are joined and ordered whole.
    """
    od = [color.optical_density(F.col(c), io) for c in "rgb"]
    work = distinct_colours(px, by).select(*by, "n_px", *[od[i].alias(f"d{i}") for i in range(3)])
    return _by_size(work, by, lambda some, large: _solved_vectors(some, by, alpha, beta, min_px, large))


def _solved_vectors(work: DataFrame, by: list[str], alpha: float, beta: float, min_px: int, large: bool) -> DataFrame:
    """``stain_vectors`` from the densities d0..d2 and pixels of a tile's colours."""

    def met(colours: DataFrame, numbers: DataFrame) -> DataFrame:
        return copies_join(colours, numbers, by, salt_on=["d0", "d1", "d2"]) if large else colours.join(numbers, by)

    dense = work.where(F.least("d0", "d1", "d2") >= beta)
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    n, weighed = F.col("__n"), lambda *d: F.sum(reduce(mul, (F.col(f"d{i}") for i in d), F.col("n_px")))
    moments = dense.groupBy(*by).agg(
        F.sum("n_px").alias("__n"), *[weighed(i).alias(f"__s{i}") for i in range(3)], *[weighed(i, j).alias(f"__p{i}{j}") for i, j in pairs]
    ).where(n >= min_px).withColumns(
        {f"c{i}{j}": (F.col(f"__p{i}{j}") - F.col(f"__s{i}") * F.col(f"__s{j}") / n) / F.nullif(n - 1, F.lit(0)) for i, j in pairs}
    )
    known = moments.select(*by, *[f"c{i}{j}" for i, j in pairs]).where(F.col("c00").isNotNull())
    axes = cut_lineage(stain_axes(known, by).select(*by, F.concat("second", "largest").alias("axes")))

    def along(k: int) -> Column:
        return sum((F.col(f"d{i}") * F.get("axes", F.lit(3 * k + i)) for i in range(3)), F.lit(0.0))

    turned = met(dense, axes).select(*by, "n_px", F.atan2(along(1), along(0)).alias("phi"))
    angles = _colour_quantiles(turned, by, ["phi"], {"lo": alpha / 100, "hi": 1 - alpha / 100}, large)
    both = angles.join(axes, by)

    def vector(phi: str, i: int) -> Column:
        return F.get("axes", F.lit(i)) * F.cos(phi) + F.get("axes", F.lit(3 + i)) * F.sin(phi)

    low_first = vector("phi_lo", 0) > vector("phi_hi", 0)
    vectors = cut_lineage(
        both.select(
            *by,
            *[F.when(low_first, vector("phi_lo", i)).otherwise(vector("phi_hi", i)).alias(f"h{i + 1}") for i in range(3)],
            *[F.when(low_first, vector("phi_hi", i)).otherwise(vector("phi_lo", i)).alias(f"e{i + 1}") for i in range(3)],
        ).withColumns(_solver())
    )
    amounts = met(work, vectors).withColumns(_concentrations()).select(*by, "n_px", "conc_h", "conc_e")
    tops = _colour_quantiles(amounts, by, ["conc_h", "conc_e"], {"top": 0.99}, large)
    floor = F.lit(1e-6)
    return vectors.join(tops, by).withColumns(
        {"max_h": F.greatest("conc_h_top", floor), "max_e": F.greatest("conc_e_top", floor)}
    ).drop("conc_h_top", "conc_e_top")


def _solver() -> dict[str, Column]:
    """Per tile, the least-squares solution of the 3 by 2 system in closed form: conc_h = sum(u_i d_i), conc_e = sum(w_i d_i)."""
    h, e = [F.col(f"h{i}") for i in (1, 2, 3)], [F.col(f"e{i}") for i in (1, 2, 3)]
    inner = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    hh, ee, he = inner(h, h), inner(e, e), inner(h, e)
    det = hh * ee - he * he
    return {f"u{i}": F.try_divide(ee * h[i] - he * e[i], det) for i in range(3)} | {
        f"w{i}": F.try_divide(hh * e[i] - he * h[i], det) for i in range(3)
    }


def _concentrations() -> dict[str, Column]:
    """Stain amounts of a pixel from its densities d0..d2 and the tile's solver."""
    return {
        name: F.col(f"{c}0") * F.col("d0") + F.col(f"{c}1") * F.col("d1") + F.col(f"{c}2") * F.col("d2")
        for name, c in (("conc_h", "u"), ("conc_e", "w"))
    }


def separate_stains(
    px: DataFrame,
    by: list[str],
    io: float = 240.0,
    alpha: float = 1.0,
    beta: float = 0.15,
    reference: list[list[float]] = HE_REFERENCE,
    max_c: list[float] = MAX_C_REFERENCE,
    components: bool = False,
) -> DataFrame:
    """Stain-vector normalisation; with ``components`` also the two single-stain pictures.

    Tiles without a usable stain plane keep their colours.
    """
    vectors = stain_vectors(px, by, io, alpha, beta)
    joined = copies_join(px, vectors, by, "left", salt_on=_places(px, by)).withColumns(
        {f"d{i}": color.optical_density(F.col(c), io) for i, c in enumerate("rgb")}
    ).withColumns(_concentrations())
    known = F.col("conc_h").isNotNull()
    h = F.col("conc_h") / (F.col("max_h") / F.lit(max_c[0]))
    e = F.col("conc_e") / (F.col("max_e") / F.lit(max_c[1]))

    def painted(i: int, amounts: list[tuple[int, Column]]) -> Column:
        value = F.lit(io) * F.exp(-sum((F.lit(reference[i][s]) * x for s, x in amounts), F.lit(0.0)))
        byte = F.floor(F.when(value > 255, F.lit(254.0)).otherwise(value)).cast("int")
        return F.when(known, byte).otherwise(F.col("rgb"[i]).cast("int"))

    out = {f"{c}2": painted(i, [(0, h), (1, e)]) for i, c in enumerate("rgb")}
    if components:
        out |= {f"h_{c}": painted(i, [(0, h)]) for i, c in enumerate("rgb")}
        out |= {f"e_{c}": painted(i, [(1, e)]) for i, c in enumerate("rgb")}
    return joined.withColumns(out).select(*px.columns, *out)
