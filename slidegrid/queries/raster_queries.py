"""Rasters and pixel rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidegrid.operators import foreground, quality, raster, stain
from slidegrid.queries.grid_queries import MASK_CTE, mask, raster_values
from slidegrid.queries.registry import query, rounded
from slidegrid.queries.scalar_queries import LAB_CTES, PIXELS_CTE, pixels
from slidegrid.session import table


@query("otsu_threshold", "AG25", """WITH v AS (SELECT event_type AS g, least("value", 255.0) AS x FROM events), b AS (SELECT g, CAST(least(255, floor(x * 256 / 255.0)) AS INTEGER) AS bin, count(*) AS n FROM v GROUP BY 1, 2),
w AS (SELECT g, bin, sum(n) OVER u / CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE) AS o, sum(n * bin) OVER u / CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE) AS m, sum(n * bin) OVER (PARTITION BY g) / CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE) AS t FROM b WINDOW u AS (PARTITION BY g ORDER BY bin)),
k AS (SELECT g, arg_min(bin, (-((t * o - m) * (t * o - m) / greatest(o * (1.0 - o), 1e-9)), bin)) AS ob FROM w GROUP BY g),
f AS (SELECT v.g, max(ob) AS ob, avg(CAST(x < ob AS INTEGER)) AS fr, floor(avg(x)) AS mean FROM v JOIN k ON v.g = k.g GROUP BY v.g), p AS (SELECT g, CAST(CASE WHEN fr > 0.9 THEN mean ELSE ob END AS INTEGER) AS threshold, fr > 0.9 AS degenerate FROM f)
SELECT v.g AS event_type, max(threshold) AS threshold, bool_or(degenerate) AS degenerate, round(avg(CAST(x < threshold AS INTEGER)), 6) AS fraction FROM v JOIN p ON v.g = p.g GROUP BY v.g""")
def otsu_threshold(spark, d):
    return rounded(raster.otsu(table(spark, d, "events"), ["event_type"], F.least("value", F.lit(255.0))), "fraction")


@query("mask_fraction", "AG31", f"WITH {MASK_CTE} SELECT slide, round(avg(CAST(val > 25 AS INTEGER)), 6) AS fraction, count(*) AS n FROM mask GROUP BY slide")
def mask_fraction(spark, d):
    return rounded(raster.mask_fraction(mask(spark, d), ["slide"]), "fraction")


def grey_grid(spark, d):
    return raster_values(spark, d).select("slide", F.col("mx").alias("x"), F.col("my").alias("y"), F.floor("val").cast("int").alias("v"))


_GRID = f"""{MASK_CTE}, g AS (SELECT slide, mx AS x, my AS y, CAST(floor(val) AS INTEGER) AS v FROM mask),
off AS (SELECT CAST(a AS INTEGER) AS dx, CAST(b AS INTEGER) AS dy FROM (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b))"""
_R101 = lambda p: f"CASE WHEN {p} < 0 THEN -({p}) WHEN {p} > 63 THEN 126 - ({p}) ELSE {p} END"
_NEAR = f"nb AS (SELECT g.slide, g.x, g.y, dx, dy, n.v FROM g, off JOIN g n ON n.slide = g.slide AND n.x = {_R101('g.x + dx')} AND n.y = {_R101('g.y + dy')})"


@query("stencil_mean", "WN8", f"WITH {_GRID}, {_NEAR} SELECT slide, x, y, round(avg(v), 6) AS v FROM nb GROUP BY 1, 2, 3")
def stencil_mean(spark, d):
    return rounded(raster.stencil(grey_grid(spark, d), "mean"), "v")


@query("stencil_gaussian", "WN8", f"WITH {_GRID}, {_NEAR} SELECT slide, x, y, round(sum(v * power(2, 2 - abs(dx) - abs(dy))) / 16, 6) AS v FROM nb GROUP BY 1, 2, 3")
def stencil_gaussian(spark, d):
    return rounded(raster.stencil(grey_grid(spark, d), "weighted", weights=raster.GAUSSIAN_3), "v")


@query("stencil_median", "WN8", f"WITH {_GRID}, {_NEAR} SELECT slide, x, y, CAST(quantile_disc(v, 0.5) AS INTEGER) AS v FROM nb GROUP BY 1, 2, 3")
def stencil_median(spark, d):
    return raster.stencil(grey_grid(spark, d), "median")


@query("focus_scores", "AG24 WN8", f"WITH {_GRID}, {_NEAR}, l AS (SELECT slide, x, y, sum(CASE WHEN dx = 0 AND dy = 0 THEN -4 * v WHEN abs(dx) + abs(dy) = 1 THEN v ELSE 0 END) AS e FROM nb GROUP BY 1, 2, 3) SELECT slide, round(var_pop(e), 4) AS focus_score FROM l GROUP BY slide")
def focus_scores(spark, d):
    return raster.focus_scores(grey_grid(spark, d), ["slide"]).withColumn("focus_score", F.round("focus_score", 4))


_CROSS = lambda src, f: f"SELECT a.slide, a.x, a.y, {f}(n.v) AS v FROM {src} a, off JOIN {src} n ON n.slide = a.slide AND n.x = a.x + dx AND n.y = a.y + dy WHERE abs(dx) + abs(dy) <= 1 GROUP BY 1, 2, 3"


@query("morphology_open", "WN8", f"WITH {_GRID}, e AS ({_CROSS('g', 'min')}) {_CROSS('e', 'max')}")
def morphology_open(spark, d):
    return raster.open_(grey_grid(spark, d))


@query("morphology_close", "WN8", f"WITH {_GRID}, e AS ({_CROSS('g', 'max')}) {_CROSS('e', 'min')}")
def morphology_close(spark, d):
    return raster.close_(grey_grid(spark, d))


@query("denoised_raster", "WN8", f"""WITH {_GRID}, {_NEAR}, b AS (SELECT slide, x, y, CAST(round(sum(v * power(2, 2 - abs(dx) - abs(dy))) / 16) AS INTEGER) AS v FROM nb GROUP BY 1, 2, 3),
md AS (SELECT a.slide, a.x, a.y, CAST(quantile_disc(n.v, 0.5) AS INTEGER) AS v FROM b a, off JOIN b n ON n.slide = a.slide AND n.x = least(greatest(a.x + dx, 0), 63) AND n.y = least(greatest(a.y + dy, 0), 63) GROUP BY 1, 2, 3),
er AS ({_CROSS('md', 'min')}) {_CROSS('er', 'max')}""")
def denoised_raster(spark, d):
    """Blur, median and opening in a row."""
    return raster.denoise(grey_grid(spark, d))


_WIDE = "off9 AS (SELECT CAST(a AS INTEGER) AS dx, CAST(b AS INTEGER) AS dy FROM (SELECT unnest(range(-4, 5)) AS a), (SELECT unnest(range(-4, 5)) AS b))"


@query("wide_stencils", "WN8", f"""WITH {_GRID}, {_WIDE}, nb AS (SELECT g.slide, g.x, g.y, dx, dy, n.v, g.x + dx BETWEEN 0 AND 63 AND g.y + dy BETWEEN 0 AND 63 AS inside FROM g, off9 JOIN g n ON n.slide = g.slide AND n.x = {_R101('g.x + dx')} AND n.y = {_R101('g.y + dy')})
SELECT slide, x, y, round(avg(v), 6) AS mean, CAST(quantile_disc(v, 0.5) AS INTEGER) AS median, min(v) FILTER (inside AND dx * dx + dy * dy <= 16) AS eroded, max(v) FILTER (inside AND dx * dx + dy * dy <= 16) AS dilated FROM nb GROUP BY 1, 2, 3""")
def wide_stencils(spark, d):
    """Kernels of radius 4: mean and median over a square with mirrored borders, erosion and dilation over a disk inside the picture."""
    g = grey_grid(spark, d)
    named = lambda df, name: df.withColumnRenamed("v", name)
    out = named(rounded(raster.stencil(g, "mean", 4), "v"), "mean")
    for name, df in (("median", raster.stencil(g, "median", 4)), ("eroded", raster.erode(g, 4)), ("dilated", raster.dilate(g, 4))):
        out = out.join(named(df, name), ["slide", "x", "y"])
    return out


@query("large_objects", "WN9", f"""WITH RECURSIVE {MASK_CTE}, p AS (SELECT slide, mx AS x, my AS y, slide * 4096 + my * 64 + mx AS id FROM mask WHERE val > 60),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.slide = b.slide AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
r(id, root) AS (SELECT id, id FROM p UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE e.b > r.root), m AS (SELECT id, min(root) AS root FROM r GROUP BY id), s AS (SELECT root, count(*) AS area FROM m GROUP BY root HAVING count(*) > 5)
SELECT p.slide, x, y, area FROM p JOIN m ON m.id = p.id JOIN s ON s.root = m.root""")
def large_objects(spark, d):
    m = mask(spark, d, 60.0).select("slide", F.col("mx").alias("x"), F.col("my").alias("y"), "v")
    return raster.remove_small(m, 5)


@query("raster_comparison", "JN14 SL5", """WITH a AS (SELECT event_id // 64 AS tile, event_id % 64 AS x, "value" AS va, CASE WHEN event_id // 64 % 6 = 0 THEN (event_id * 7919 % 997) / 3.0 WHEN event_id // 64 % 6 = 2 THEN 5.0 ELSE "value" + event_id % 3 END AS vb FROM events),
s AS (SELECT tile, count(*) AS n, stddev_pop(vb) < 1e-6 AS fb, corr(va, vb) AS c, avg(abs(va - vb)) AS mad, avg(va - vb) AS md FROM a WHERE tile % 2 = 0 GROUP BY tile)
SELECT 0 AS slide, tile, n, round(CASE WHEN NOT fb THEN c END, 6) AS ncc, round(mad, 6) AS mad, round(md, 6) AS mean_diff, CASE WHEN fb THEN false ELSE c >= 0.85 END AS ok FROM s""")
def raster_comparison(spark, d):
    k = F.col("event_id")
    base = table(spark, d, "events").select(
        F.lit(0).alias("slide"), F.floor(k / 64).alias("tile"), (k % 64).alias("x"), F.lit(0).alias("y"), "event_id", F.col("value").alias("v")
    )
    t = F.col("tile") % 6
    other = base.withColumn("v", F.when(t == 0, k * 7919 % 997 / 3.0).when(t == 2, F.lit(5.0)).otherwise(F.col("v") + k % 3))
    return rounded(raster.compare_rasters(base, other, ["slide", "tile"], every=2), "ncc", "mad", "mean_diff")


@query("area_resampling", "JN18", f"""WITH {MASK_CTE} SELECT slide, CAST(mx // 4 AS INTEGER) AS gx, CAST(my // 4 AS INTEGER) AS gy, round(avg(val), 6) AS v FROM mask GROUP BY 1, 2, 3""")
def area_resampling(spark, d):
    g = raster_values(spark, d).select("slide", F.col("mx").alias("gx"), F.col("my").alias("gy"), F.array("val").alias("v"))
    return raster.resample(g, raster.area_weights(64, 16), ["slide"]).select("slide", "gx", "gy", F.round(F.get("v", F.lit(0)), 6).alias("v"))


@query("linear_resampling", "JN18", f"""WITH {MASK_CTE}, j AS (SELECT CAST(unnest(range(0, 96)) AS INTEGER) AS j), a AS (SELECT j, greatest(0.0, (j + 0.5) * 64 / 96.0 - 0.5) AS spot FROM j),
w AS (SELECT j, CAST(floor(spot) AS INTEGER) AS i, 1 - (spot - floor(spot)) AS w FROM a UNION ALL SELECT j, CAST(least(63, floor(spot) + 1) AS INTEGER), spot - floor(spot) FROM a WHERE spot > floor(spot))
SELECT slide, wx.j AS gx, wy.j AS gy, round(sum(val * wx.w * wy.w), 5) AS v FROM mask JOIN w wx ON wx.i = mx JOIN w wy ON wy.i = my GROUP BY 1, 2, 3""")
def linear_resampling(spark, d):
    g = raster_values(spark, d).select("slide", F.col("mx").alias("gx"), F.col("my").alias("gy"), F.array("val").alias("v"))
    return raster.resample(g, raster.bilinear_weights(64, 96), ["slide"]).select("slide", "gx", "gy", F.round(F.get("v", F.lit(0)), 5).alias("v"))


# ---- colour normalisation over pixel rows ---------------------------------------------------------


def _digest(df, cols):
    return df.groupBy("tile").agg(F.count("*").alias("n"), *[F.sum(c).cast("long").alias(c) for c in cols])


_SCALED = lambda c: f"CASE WHEN h{c} > l{c} THEN floor(least(greatest(({c} - l{c}) / (h{c} - l{c}) * 255.0, 0), 255)) ELSE {c} END"


@query("percentile_scaling", "AG26", f"""WITH {PIXELS_CTE}, q AS (SELECT tile, quantile_cont(r, 0.01) AS lr, quantile_cont(r, 0.99) AS hr, quantile_cont(g, 0.01) AS lg, quantile_cont(g, 0.99) AS hg, quantile_cont(b, 0.01) AS lb, quantile_cont(b, 0.99) AS hb FROM px GROUP BY tile)
SELECT px.tile, count(*) AS n, CAST(sum({_SCALED('r')}) AS BIGINT) AS r2, CAST(sum({_SCALED('g')}) AS BIGINT) AS g2, CAST(sum({_SCALED('b')}) AS BIGINT) AS b2 FROM px JOIN q ON px.tile = q.tile GROUP BY px.tile""")
def percentile_scaling(spark, d):
    return _digest(stain.percentile_scale(pixels(spark, d), ["tile"]), ["r2", "g2", "b2"])


_MEANED = lambda c, t: f"CASE WHEN m{c} > 0 THEN floor(least(greatest({c} * ({t} * 255.0 / m{c}), 0), 255)) ELSE {c} END"


@query("mean_scaling", "AG28", f"""WITH {PIXELS_CTE}, q AS (SELECT tile, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM px GROUP BY tile)
SELECT px.tile, count(*) AS n, CAST(sum({_MEANED('r', '0.45::DOUBLE')}) AS BIGINT) AS r2, CAST(sum({_MEANED('g', '0.35::DOUBLE')}) AS BIGINT) AS g2, CAST(sum({_MEANED('b', '0.45::DOUBLE')}) AS BIGINT) AS b2 FROM px JOIN q ON px.tile = q.tile GROUP BY px.tile""")
def mean_scaling(spark, d):
    return _digest(stain.mean_scale(pixels(spark, d), ["tile"]), ["r2", "g2", "b2"])


_MOVED = lambda c, m, s: f"floor(least(greatest(CASE WHEN s{c} > 0 THEN ({c}v - m{c}) / s{c} * {s} + {m} ELSE {c}v END, 0), 255))"


@query("colour_transfer", "AG27", f"""WITH {PIXELS_CTE}, {LAB_CTES}, v AS (SELECT tile, round(l8) AS lv, round(a8) AS av, round(b8) AS bv FROM lab),
q AS (SELECT tile, avg(lv) AS ml, stddev_pop(lv) AS sl, avg(av) AS ma, stddev_pop(av) AS sa, avg(bv) AS mb, stddev_pop(bv) AS sb FROM v GROUP BY tile)
SELECT v.tile, count(*) AS n, round(avg({_MOVED('l', 127.5, 63.75)}), 1) AS lab_l, round(avg({_MOVED('a', 128.0, 50.0)}), 1) AS lab_a, round(avg({_MOVED('b', 128.0, 50.0)}), 1) AS lab_b FROM v JOIN q ON v.tile = q.tile GROUP BY v.tile""")
def colour_transfer(spark, d):
    out = stain.colour_transfer(pixels(spark, d), ["tile"])
    return out.groupBy("tile").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 1).alias(c) for c in ("lab_l", "lab_a", "lab_b")])


#: Stain vectors for unmixing, reference stain matrix and top amounts.
_STAINS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))
_REFERENCE, _TOPS = ((0.5626, 0.2159), (0.7201, 0.8012), (0.4062, 0.5581)), (1.9705, 1.0308)

_LENGTHS = [f"sqrt({' + '.join(f'{v} * {v}' for v in row)})" for row in _STAINS]
_U = [[f"CAST({v} AS DOUBLE) / {length}" for v in row] for row, length in zip(_STAINS, _LENGTHS)]
_COFACTOR = lambda i, j: f"(m{(i + 1) % 3}{(j + 1) % 3} * m{(i + 2) % 3}{(j + 2) % 3} - m{(i + 1) % 3}{(j + 2) % 3} * m{(i + 2) % 3}{(j + 1) % 3})"
_UNMIXED_CTES = f"""m AS (SELECT {', '.join(f'{_U[i][j]} AS m{i}{j}' for i in range(3) for j in range(3))}),
inv AS (SELECT *, {', '.join(f"{_COFACTOR(j, i)} / (m00 * {_COFACTOR(0, 0)} + m01 * {_COFACTOR(0, 1)} + m02 * {_COFACTOR(0, 2)}) AS i{i}{j}" for i in range(3) for j in range(3))} FROM m),
den AS (SELECT *, {', '.join(f"ln(greatest({c} / 255.0::DOUBLE, 1e-6)) / ln(1e-6::DOUBLE) AS d{k}" for k, c in enumerate('rgb'))} FROM px),
st AS (SELECT *, {', '.join(f"greatest(d0 * i0{s} + d1 * i1{s} + d2 * i2{s}, 0) AS s{s}" for s in range(3))} FROM den, inv),
qs AS (SELECT tile, {', '.join(f"quantile_cont(s{s}, 0.01) AS lo{s}, quantile_cont(s{s}, 0.99) AS hi{s}" for s in range(2))} FROM st GROUP BY tile),
str AS (SELECT st.*, {', '.join(f"CASE WHEN hi{s} > lo{s} THEN least(greatest((s{s} - lo{s}) / (hi{s} - lo{s}), 0), 1) ELSE s{s} END AS t{s}" for s in range(2))}, s2 AS t2 FROM st JOIN qs USING (tile))"""
_REMIXED = lambda k: f"floor(least(greatest(exp((t0 * m0{k} + t1 * m1{k} + t2 * m2{k}) * ln(1e-6::DOUBLE)) * 255, 0), 255))"


@query("stain_scaling", "AG29 PR22", f"WITH {PIXELS_CTE}, {_UNMIXED_CTES} SELECT tile, count(*) AS n, {', '.join(f'CAST(sum({_REMIXED(k)}) AS BIGINT) AS {c}2' for k, c in enumerate('rgb'))} FROM str GROUP BY tile")
def stain_scaling(spark, d):
    return _digest(stain.stain_percentile(pixels(spark, d), ["tile"]), ["r2", "g2", "b2"])


_ROW = lambda i, root: "array_value(" + ", ".join(f"c{min(i, j)}{max(i, j)} - {root}" if i == j else f"c{min(i, j)}{max(i, j)}" for j in range(3)) + ")"
_PRODUCT = lambda i, j, root: f"array_cross_product({_ROW(i, root)}, {_ROW(j, root)})"
_OUTER = lambda name, root: (
    f"{_PRODUCT(0, 1, root)} AS x0_{name}, {_PRODUCT(0, 2, root)} AS x1_{name}, {_PRODUCT(1, 2, root)} AS x2_{name}, "
    + ", ".join(f"array_inner_product(x{k}_{name}, x{k}_{name}) AS n{k}_{name}" for k in range(3))
    + f", CASE WHEN n0_{name} >= greatest(n1_{name}, n2_{name}) THEN x0_{name} WHEN n1_{name} >= n2_{name} THEN x1_{name} ELSE x2_{name} END AS x_{name}, greatest(n0_{name}, n1_{name}, n2_{name}) AS n_{name}"
)
_UP = lambda v: ", ".join(f"{v}[{i}] * (CASE WHEN {v}[1] + {v}[2] + {v}[3] < 0 THEN -1 ELSE 1 END) AS {v}{i}" for i in (1, 2, 3))
_ALONG = lambda a: f"d0 * {a}1 + d1 * {a}2 + d2 * {a}3"
_TURNED = lambda phi, i: f"(second{i} * cos({phi}) + largest{i} * sin({phi}))"
_VECTOR_CTES = f"""od AS (SELECT *, {', '.join(f"-log10(({c} + 1) / 240.0::DOUBLE) AS d{k}" for k, c in enumerate('rgb'))} FROM px),
dn AS (SELECT * FROM od WHERE least(d0, d1, d2) >= 0.15),
cv AS (SELECT tile, {', '.join(f"covar_samp(d{i}, d{j}) AS c{i}{j}" for i in range(3) for j in range(i, 3))} FROM dn GROUP BY tile HAVING count(*) >= 10),
ew AS (SELECT *, (c00 + c11 + c22) / 3 AS q, sqrt(((c00 - q) ** 2 + (c11 - q) ** 2 + (c22 - q) ** 2 + 2 * (c01 * c01 + c02 * c02 + c12 * c12)) / 6) AS p,
  ((c00 - q) * ((c11 - q) * (c22 - q) - c12 * c12) - c01 * (c01 * (c22 - q) - c12 * c02) + c02 * (c01 * c12 - (c11 - q) * c02)) / (p * p * p) / 2 AS half,
  acos(least(greatest(half, -1), 1)) / 3 AS turn, q + 2 * p * cos(turn) AS root_a, q + 2 * p * cos(turn + 2 * pi() / 3) AS root_z FROM cv),
ev AS (SELECT *, {_OUTER('a', 'root_a')}, {_OUTER('z', 'root_z')} FROM ew),
ax AS (SELECT tile, array_value(x_a[1] / sqrt(n_a), x_a[2] / sqrt(n_a), x_a[3] / sqrt(n_a)) AS largest,
  array_cross_product(array_value(x_z[1] / sqrt(n_z), x_z[2] / sqrt(n_z), x_z[3] / sqrt(n_z)), largest) AS second FROM ev),
ay AS (SELECT tile, {_UP('largest')}, {_UP('second')} FROM ax),
an AS (SELECT tile, quantile_cont(atan2({_ALONG('largest')}, {_ALONG('second')}), 0.01) AS plo, quantile_cont(atan2({_ALONG('largest')}, {_ALONG('second')}), 0.99) AS phi FROM dn JOIN ay USING (tile) GROUP BY tile),
hv AS (SELECT tile, {', '.join(f"CASE WHEN {_TURNED('plo', 1)} > {_TURNED('phi', 1)} THEN {_TURNED('plo', i)} ELSE {_TURNED('phi', i)} END AS h{i}" for i in (1, 2, 3))},
  {', '.join(f"CASE WHEN {_TURNED('plo', 1)} > {_TURNED('phi', 1)} THEN {_TURNED('phi', i)} ELSE {_TURNED('plo', i)} END AS e{i}" for i in (1, 2, 3))} FROM an JOIN ay USING (tile)),
so AS (SELECT *, h1 * h1 + h2 * h2 + h3 * h3 AS hh, e1 * e1 + e2 * e2 + e3 * e3 AS ee, h1 * e1 + h2 * e2 + h3 * e3 AS he, hh * ee - he * he AS det FROM hv),
am AS (SELECT od.*, {', '.join(f"(ee * ({_ALONG('h')}) - he * ({_ALONG('e')})) / det AS ch, (hh * ({_ALONG('e')}) - he * ({_ALONG('h')})) / det AS ce" for _ in (0,))} FROM od JOIN so USING (tile)),
tp AS (SELECT tile, greatest(quantile_cont(ch, 0.99), 1e-6) AS max_h, greatest(quantile_cont(ce, 0.99), 1e-6) AS max_e FROM am GROUP BY tile)"""


@query("stain_vectors", "AG30", f"WITH {PIXELS_CTE}, {_VECTOR_CTES} SELECT tile, {', '.join(f'round({v}, 6) AS {v}' for v in ('h1', 'h2', 'h3', 'e1', 'e2', 'e3', 'max_h', 'max_e'))} FROM hv JOIN tp USING (tile)")
def stain_vectors(spark, d):
    out = stain.stain_vectors(pixels(spark, d), ["tile"])
    return out.select("tile", *[F.round(c, 6).alias(c) for c in ("h1", "h2", "h3", "e1", "e2", "e3", "max_h", "max_e")])


_PAINTED = lambda i, parts: (
    f"round(avg(CASE WHEN max_h IS NULL THEN px.{'rgb'[i]} ELSE floor(CASE WHEN {_GLOW(i, parts)} > 255 THEN 254 ELSE {_GLOW(i, parts)} END) END), 1)")
_GLOW = lambda i, parts: f"(240 * exp(-({' + '.join(f'{_REFERENCE[i][s]}::DOUBLE * ({c} / (max_{c[1]} / {_TOPS[s]}::DOUBLE))' for s, c in parts)})))"
_BOTH, _ONLY_H, _ONLY_E = ((0, "ch"), (1, "ce")), ((0, "ch"),), ((1, "ce"),)


@query("stain_normalisation", "AG30 SNK6", f"""WITH {PIXELS_CTE}, {_VECTOR_CTES},
al AS (SELECT px.*, {', '.join(f"-log10((px.{c} + 1) / 240.0::DOUBLE) AS d{k}" for k, c in enumerate('rgb'))}, so.* EXCLUDE (tile), max_h, max_e,
  (ee * ({_ALONG('h')}) - he * ({_ALONG('e')})) / det AS ch, (hh * ({_ALONG('e')}) - he * ({_ALONG('h')})) / det AS ce FROM px LEFT JOIN so USING (tile) LEFT JOIN tp USING (tile))
SELECT tile, count(*) AS n, {', '.join(f"{_PAINTED(i, parts)} AS {name.format('rgb'[i])}" for name, parts in (('{}2', _BOTH), ('h_{}', _ONLY_H), ('e_{}', _ONLY_E)) for i in range(3))} FROM al px GROUP BY tile""")
def stain_normalisation(spark, d):
    """Mean bytes of a tile in the normalised picture and the two single-stain pictures; bytes at a rounding edge may differ by one."""
    out = stain.separate_stains(pixels(spark, d), ["tile"], components=True)
    names = ["r2", "g2", "b2", "h_r", "h_g", "h_b", "e_r", "e_g", "e_b"]
    return out.groupBy("tile").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 1).alias(c) for c in names])


@query("full_tile_quality", "FL2 AG24 AG25")
def full_tile_quality(spark, d):
    """All tile rules together on the rasters as grey tiles with a colour cast."""
    v = F.least(F.col("v") * 3, F.lit(255))
    px = grey_grid(spark, d).withColumns({"r": v, "g": F.greatest(v - 40, F.lit(0)), "b": F.least(v + 20, F.lit(255))})
    return quality.tile_qc(px.drop("v"), ["slide"]).select(
        "slide", "n", "is_valid", F.array_join("reasons", "; ").alias("reasons"), F.round("tissue_percentage", 4).alias("tissue_percentage"), F.round("focus_score", 4).alias("focus_score")
    )


# ---- foreground ------------------------------------------------------------------------------------


def colour_grid(spark, d):
    """The rasters as tiles with a colour cast; values spread over the byte range."""
    v = F.least(F.col("v") * 3, F.lit(255))
    return grey_grid(spark, d).withColumns({"r": v, "g": F.greatest(v - 40, F.lit(0)), "b": F.least(v + 20, F.lit(255))}).drop("v")


_COLOURS = "px AS (SELECT slide, x, y, r, greatest(r - 40, 0) AS g, least(r + 20, 255) AS b FROM (SELECT slide, x, y, least(v * 3, 255) AS r FROM g)), gr AS (SELECT *, CAST(round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS INTEGER) AS v FROM px)"
_OTSU = """hb AS (SELECT slide, CAST(least(255, floor(v * 256 / 255.0)) AS INTEGER) AS bin, count(*) AS n FROM gr GROUP BY 1, 2),
hw AS (SELECT slide, bin, sum(n) OVER u / CAST(sum(n) OVER (PARTITION BY slide) AS DOUBLE) AS o, sum(n * bin) OVER u / CAST(sum(n) OVER (PARTITION BY slide) AS DOUBLE) AS m, sum(n * bin) OVER (PARTITION BY slide) / CAST(sum(n) OVER (PARTITION BY slide) AS DOUBLE) AS t FROM hb WINDOW u AS (PARTITION BY slide ORDER BY bin)),
ot AS (SELECT slide, arg_min(bin, (-((t * o - m) * (t * o - m) / greatest(o * (1.0 - o), 1e-9)), bin)) AS cut FROM hw GROUP BY slide)"""
_DISK2 = lambda src, f: f"SELECT a.slide, a.x, a.y, {f}(n.v) AS v FROM {src} a, off2 JOIN {src} n ON n.slide = a.slide AND n.x = {_R101('a.x + dx')} AND n.y = {_R101('a.y + dy')} GROUP BY 1, 2, 3"


@query("foreground_mask", "AG25 WN8 WN9")
def foreground_mask(spark, d):
    """Otsu, inverted, closed with a disk of 2, objects of up to 50 pixels removed."""
    return foreground.foreground_mask(colour_grid(spark, d), ["slide"])


@query("otsu_mask", "AG25 WN8", f"""WITH {_GRID}, {_COLOURS}, {_OTSU}, off2 AS (SELECT CAST(a AS INTEGER) AS dx, CAST(b AS INTEGER) AS dy FROM (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b) WHERE a * a + b * b <= 4),
bi AS (SELECT gr.slide, x, y, CAST(v <= cut AS INTEGER) AS v FROM gr JOIN ot USING (slide)), di AS ({_DISK2('bi', 'max')}) {_DISK2('di', 'min')}""")
def otsu_mask(spark, d):
    """Grey against each tile's Otsu threshold, inverted, and closed with a disk of radius 2."""
    return raster.close_(foreground.binary(colour_grid(spark, d), ["slide"]), 2, border="reflect101")


_G11 = "exp(-(({d}) * ({d})) / 8.0::DOUBLE)"


@query("adaptive_mask", "AG25 WN8", f"""WITH {_GRID}, {_COLOURS}, w AS (SELECT CAST(a AS INTEGER) AS dx, CAST(b AS INTEGER) AS dy, {_G11.format(d='a')} * {_G11.format(d='b')} AS w FROM (SELECT unnest(range(-5, 6)) AS a), (SELECT unnest(range(-5, 6)) AS b)),
mn AS (SELECT a.slide, a.x, a.y, any_value(a.v) AS v, sum(n.v * w) / sum(w) AS mean FROM gr a, w JOIN gr n ON n.slide = a.slide AND n.x = least(greatest(a.x + dx, 0), 63) AND n.y = least(greatest(a.y + dy, 0), 63) GROUP BY 1, 2, 3)
SELECT slide, x, y, CAST(NOT v > floor(mean + 0.5) - 2 AS INTEGER) AS v FROM mn""")
def adaptive_mask(spark, d):
    """Grey against its Gaussian mean over 11 by 11 pixels less 2, inverted."""
    return foreground.binary(colour_grid(spark, d), ["slide"], "adaptive")


@query("saturation_mask", "PR22", f"""WITH {_GRID}, {_COLOURS} SELECT slide, x, y, CAST(round(CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE 255.0::DOUBLE * (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END) > 30 AS INTEGER) AS v FROM px""")
def saturation_mask(spark, d):
    """Saturation above 30."""
    return foreground.binary(colour_grid(spark, d), ["slide"], "saturation", invert=False)


@query("processed_tiles", "FL2 WN8 WN9 AG26 AG31")
def processed_tiles(spark, d):
    """The whole chain: judged by all rules, denoised, freed of background and normalised; sums of the bytes of every valid tile."""
    px, tiles = foreground.process_tiles(colour_grid(spark, d), ["slide"])
    sums = px.groupBy("slide").agg(F.count("*").alias("n"), F.count_if(F.col("mask") > 0).alias("n_foreground"), *[F.sum(c).cast("long").alias(c) for c in ("r2", "g2", "b2")])
    return rounded(tiles.select("slide", "is_valid", "foreground_percentage").join(sums, "slide", "left"), "foreground_percentage")
