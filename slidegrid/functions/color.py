"""Colour spaces on pixel rows with columns r, g, b in 0 to 255. All plain column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Grey weights, and the stain vectors (haematoxylin, eosin, DAB) for unmixing.
GREY_WEIGHTS = (0.299, 0.587, 0.114)
STAIN_VECTORS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))
# Linear sRGB to XYZ and the D65 white point.
RGB_TO_XYZ = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
WHITE = (0.950456, 1.0, 1.088754)


def grey(r: Column, g: Column, b: Column) -> Column:
    wr, wg, wb = GREY_WEIGHTS
    return F.lit(wr) * r + F.lit(wg) * g + F.lit(wb) * b


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in half degrees (0 to 180), saturation and value in 0 to 255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    turn = (
        F.when(span == 0, F.lit(0.0))
        .when(top == r, F.lit(60.0) * (g - b) / span)
        .when(top == g, F.lit(120.0) + F.lit(60.0) * (b - r) / span)
        .otherwise(F.lit(240.0) + F.lit(60.0) * (r - g) / span)
    )
    hue = F.when(turn < 0, turn + 360.0).otherwise(turn) / 2.0
    sat = F.when(top == 0, F.lit(0.0)).otherwise(F.lit(255.0) * span / top)
    return hue, sat, top.cast("double")


def optical_density(channel: Column, io: float = 240.0) -> Column:
    return -F.log10((channel + F.lit(1.0)) / F.lit(io))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit style LAB: L scaled to 0 to 255, a and b shifted by 128."""

    def linear(c: Column) -> Column:
        u = c / F.lit(255.0)
        return F.when(u > 0.04045, F.pow((u + F.lit(0.055)) / F.lit(1.055), F.lit(2.4))).otherwise(u / F.lit(12.92))

    def curve(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(F.lit(7.787) * t + F.lit(16.0 / 116.0))

    channels = [linear(c) for c in (r, g, b)]
    x, y, z = (
        curve(sum((F.lit(w) * c for w, c in zip(row, channels)), F.lit(0.0)) / F.lit(white))
        for row, white in zip(RGB_TO_XYZ, WHITE)
    )
    light = F.lit(116.0) * y - F.lit(16.0)
    return light * F.lit(255.0 / 100.0), F.lit(500.0) * (x - y) + F.lit(128.0), F.lit(200.0) * (y - z) + F.lit(128.0)


def lab_to_rgb(l8: Column, a8: Column, b8: Column) -> tuple[Column, Column, Column]:
    """Back from 8-bit style LAB to r, g, b doubles clipped to 0 to 255."""
    fy = (l8 * F.lit(100.0 / 255.0) + F.lit(16.0)) / F.lit(116.0)
    fx = fy + (a8 - F.lit(128.0)) / F.lit(500.0)
    fz = fy - (b8 - F.lit(128.0)) / F.lit(200.0)

    def cube(t: Column) -> Column:
        return F.when(t > 0.206893, t * t * t).otherwise((t - F.lit(16.0 / 116.0)) / F.lit(7.787))

    xyz = [cube(f) * F.lit(w) for f, w in zip((fx, fy, fz), WHITE)]

    def companded(u: Column) -> Column:
        v = F.when(u > 0.0031308, F.lit(1.055) * F.pow(u, F.lit(1.0 / 2.4)) - F.lit(0.055)).otherwise(F.lit(12.92) * u)
        return F.least(F.greatest(v * F.lit(255.0), F.lit(0.0)), F.lit(255.0))

    back = invert3(RGB_TO_XYZ)
    return tuple(companded(sum((F.lit(w) * c for w, c in zip(row, xyz)), F.lit(0.0))) for row in back)


def invert3(m) -> list[list[float]]:
    """Inverse of a constant 3 by 3 matrix by cofactors."""
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [
        [(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det],
        [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det],
        [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det],
    ]


def _unit(rows) -> list[list[float]]:
    return [[v / math.sqrt(sum(x * x for x in row)) for v in row] for row in rows]


def unmix(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Stain amounts (haematoxylin, eosin, DAB) of a pixel: natural-log density times the inverse stain matrix."""
    floor = F.lit(1e-6)
    scale = F.log(floor)
    density = [F.log(F.greatest(c / F.lit(255.0), floor)) / scale for c in (r, g, b)]
    inverse = invert3(_unit(STAIN_VECTORS))
    return tuple(
        F.greatest(sum((density[k] * F.lit(inverse[k][s]) for k in range(3)), F.lit(0.0)), F.lit(0.0)) for s in range(3)
    )


def remix(h: Column, e: Column, d: Column) -> tuple[Column, Column, Column]:
    """Stain amounts back to r, g, b doubles clipped to 0 to 255."""
    scale = F.lit(math.log(1e-6))
    vectors = _unit(STAIN_VECTORS)
    out = []
    for k in range(3):
        density = sum((amount * F.lit(vectors[s][k]) for s, amount in enumerate((h, e, d))), F.lit(0.0))
        out.append(F.least(F.greatest(F.exp(density * scale) * F.lit(255.0), F.lit(0.0)), F.lit(255.0)))
    return tuple(out)
