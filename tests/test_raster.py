"""Grids, coverage, stencils, objects and stains against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slidegrid.operators import grid, ordered, quality, raster, stain
from slidegrid.plans import workflows


def long(spark, image, slide="s", **names):
    h, w = image.shape[:2]
    y, x = np.mgrid[0:h, 0:w]
    pdf = pd.DataFrame({"slide": slide, names.get("x", "x"): x.ravel(), names.get("y", "y"): y.ravel()})
    if image.ndim == 3:
        for i, c in enumerate("rgb"):
            pdf[c] = image[..., i].ravel().astype("int32")
    else:
        pdf["v"] = image.ravel()
    return spark.createDataFrame(pdf)


def dense(df, v="v"):
    p = df.toPandas()
    out = np.zeros((p["y"].max() + 1, p["x"].max() + 1))
    out[p["y"], p["x"]] = p[v]
    return out


@pytest.mark.parametrize("border,mode", [("reflect101", "reflect"), ("reflect", "symmetric")])
def test_stencils_against_padded_windows(spark, border, mode):
    img = np.random.default_rng(3).integers(0, 50, (7, 9))
    padded = np.pad(img, 2, mode=mode)
    windows = np.lib.stride_tricks.sliding_window_view(padded, (5, 5))
    df = long(spark, img)
    assert np.allclose(dense(raster.stencil(df, "mean", 2, border=border)), windows.mean(axis=(2, 3)))
    assert np.allclose(dense(raster.stencil(df, "median", 2, border=border)), np.median(windows, axis=(2, 3)))
    foot = np.array(raster.disk(2)).reshape(5, 5)
    assert np.allclose(dense(raster.erode(df, 2, border=border)), windows[:, :, foot].min(axis=2))
    w = np.arange(25) / 10
    assert np.allclose(dense(raster.stencil(df, "weighted", 2, weights=list(w), border=border)), (windows.reshape(7, 9, 25) * w).sum(-1))


@pytest.mark.parametrize("border,mode", [("reflect101", "reflect"), ("reflect", "symmetric"), ("replicate", "edge"), ("clip", None)])
@pytest.mark.parametrize("r,side", [(15, 16), (4, 5), (6, 100)])
def test_large_stencils_against_padded_windows(spark, border, mode, r, side):
    """Kernels that span several blocks, on two pictures of unlike size."""
    k = 2 * r + 1
    foot = np.array(raster.disk(r)).reshape(k, k)
    pictures = {"s": np.random.default_rng(3).integers(0, 50, (37, 22)), "t": np.random.default_rng(4).integers(-9, 9, (17, 40))}
    df = long(spark, pictures["s"]).unionByName(long(spark, pictures["t"], slide="t"))
    wanted = {}
    for name, img in pictures.items():
        if mode:
            windows = np.lib.stride_tricks.sliding_window_view(np.pad(img, r, mode=mode), (k, k)).reshape(*img.shape, -1).astype(float)
        else:
            windows = np.lib.stride_tricks.sliding_window_view(np.pad(img.astype(float), r, constant_values=np.nan), (k, k)).reshape(*img.shape, -1)
        n = (~np.isnan(windows)).sum(-1)
        wanted[name] = {
            "mean": np.nanmean(windows, -1), "median": np.take_along_axis(np.sort(windows, -1), (n // 2)[..., None], -1)[..., 0],
            "min": np.nanmin(windows[..., foot.ravel()], -1), "max": np.nanmax(windows[..., foot.ravel()], -1)}
    for how in ("mean", "median", "min", "max"):
        got = raster.blocked_stencil(df, how, r, raster.disk(r) if how in ("min", "max") else None, border, side=side)
        assert got.columns == df.columns
        for name in pictures:
            assert np.allclose(dense(got.where(F.col("slide") == name)), wanted[name][how])


def test_large_stencil_refuses_what_it_cannot_do(spark):
    df = long(spark, np.zeros((20, 20), int))
    with pytest.raises(Exception, match="hole"):
        raster.stencil(df.where("x != 3"), "mean", 5).collect()
    with pytest.raises(ValueError, match="centred"):
        raster.blocked_stencil(df, "min", 1, [True] + [False] * 8)
    assert raster.stencil(df, "median", 9).count() == 400


def test_denoising_sizes(spark):
    img = np.random.default_rng(8).integers(0, 255, (20, 20))
    line = np.array([1, 4, 6, 4, 1]) / 16
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(img, 2, mode="reflect"), (5, 5))
    blurred = np.floor((windows * np.outer(line, line)).sum((2, 3)) + 0.5)
    calm = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(blurred, 4, mode="edge"), (9, 9)), axis=(2, 3))
    assert (dense(raster.denoise(long(spark, img), 0, gaussian=4, median=9)) == calm).all()
    assert (dense(raster.denoise(long(spark, img), 0, gaussian=1, median=1)) == img).all()
    assert sum(raster.gaussian_weights(9)) == pytest.approx(1.0)


def test_open_close_clip_border(spark):
    img = np.zeros((6, 6), int)
    img[1:4, 1:4] = 9
    img[5, 5] = 9
    opened = dense(raster.open_(long(spark, img)))
    assert opened[2, 2] == 9 and opened[5, 5] == 0 and opened[1, 1] == 0
    img2 = np.full((5, 5), 9)
    img2[2, 2] = 0
    assert (dense(raster.close_(long(spark, img2))) == 9).all()


def flood(img):
    lab, n = np.zeros(img.shape, int), 0
    for sy, sx in zip(*np.nonzero(img)):
        if lab[sy, sx]:
            continue
        n += 1
        stack = [(sy, sx)]
        while stack:
            y, x = stack.pop()
            if 0 <= y < img.shape[0] and 0 <= x < img.shape[1] and img[y, x] and not lab[y, x]:
                lab[y, x] = n
                stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return lab


def test_remove_small_keeps_diagonals_apart(spark, hot):
    img = np.zeros((8, 8), int)
    img[0, 0] = img[1, 1] = 1          # touching only diagonally
    img[3, 0:3] = 1                    # exactly three pixels
    img[5:8, 4:8] = 1
    img[6, 5] = 0                      # hole
    lab = flood(img)
    area = np.bincount(lab.ravel())
    want = {(int(y), int(x)) for y, x in zip(*np.nonzero(img)) if area[lab[y, x]] > 3}
    got = {(r["y"], r["x"]) for r in raster.remove_small(long(spark, img), 3).collect()}
    assert got == want and len(want) == 11


def test_components_of_a_long_snake(spark):
    img = np.zeros((15, 15), int)
    img[::2] = 1
    for i in range(1, 15, 2):
        img[i, 14 if (i // 2) % 2 == 0 else 0] = 1
    got = raster.remove_small(long(spark, img), 0).toPandas()
    assert len(got) == img.sum() and set(got["area"]) == {img.sum()}


@pytest.mark.parametrize("lines,columns", [(3, 4), (2, 100), (100, 100)])
def test_objects_across_blocks(spark, lines, columns):
    """A spiral through every block, random specks, and an object on both sides of a corner, against a flood fill."""
    spiral = np.zeros((21, 21), int)
    top, left, bottom, right = 0, 0, 20, 20
    while top <= bottom and left <= right:
        spiral[top, max(left - 2, 0):right + 1] = 1
        spiral[top:bottom + 1, right] = 1
        spiral[bottom, left:right + 1] = 1
        spiral[top + 2:bottom + 1, left] = 1
        top, left, bottom, right = top + 2, left + 2, bottom - 2, right - 2
    specks = (np.random.default_rng(4).random((17, 23)) < 0.55).astype(int)
    corner = np.zeros((9, 9), int)
    corner[2, 3] = corner[3, 4] = 1
    for img, least in ((spiral, 0), (specks, 0), (specks, 6), (corner, 0)):
        lab = flood(img)
        area = np.bincount(lab.ravel())
        want = {(int(y), int(x), int(area[lab[y, x]])) for y, x in zip(*np.nonzero(img)) if area[lab[y, x]] > least}
        both = long(spark, img).unionByName(long(spark, img, slide="t"))
        got = [tuple(r) for r in raster.remove_small(both, least, lines=lines, columns=columns).select("slide", "y", "x", "area").collect()]
        assert len(got) == 2 * len(want) and {g[1:] for g in got if g[0] == "s"} == {g[1:] for g in got if g[0] == "t"} == want


@pytest.mark.parametrize("step,scale", [(7, 2.0), (5, 1.7), (9, 3.1), (1, 2.5), (2, 3.0)])
def test_coverage_methods_agree_with_slices(spark, step, scale):
    rng = np.random.default_rng(7)
    mask = (rng.random((20, 24)) < 0.4).astype(int)
    w0, h0 = int(24 * scale) + 3, int(20 * scale) + 2
    slides = spark.createDataFrame([("s", w0, h0)], "slide string, width int, height int")
    cells = grid.tile_grid(slides, step, edges=True).withColumns(
        {"step": F.lit(step), "scale": F.lit(scale), "mask_w": F.lit(24), "mask_h": F.lit(20)}
    )
    m = long(spark, mask, x="mx", y="my").where("v > 0")  # pixels that are not stored are not set
    one = grid.coverage(cells, m).toPandas().set_index(["tx", "ty"])["fraction"]
    two = grid.coverage(cells, m, "integral").toPandas().set_index(["tx", "ty"])["fraction"]
    assert len(one) == -(-w0 // step) * -(-h0 // step)
    for (tx, ty), got in one.items():
        x0, y0 = int(tx * step / scale), int(ty * step / scale)
        cut = mask[y0 : max(y0 + 1, int((ty + 1) * step / scale)), x0 : max(x0 + 1, int((tx + 1) * step / scale))]
        want = cut.mean() if cut.size else 0.0
        assert got == pytest.approx(want) and two[(tx, ty)] == pytest.approx(want)


def test_grids_with_uneven_edges(spark):
    s = spark.createDataFrame([("s", 2000, 1000)], "slide string, width int, height int")
    tiles = {(r["x0"], r["y0"]): (r["x1"], r["y1"]) for r in grid.overlap_grid(s).collect()}
    assert tiles == {(x, y): (min(x + 1024, 2000), min(y + 1024, 1000)) for x in (0, 896, 1792) for y in (0, 896)}
    assert grid.overlap_grid(s, roi=(10, 20, 900, 100)).count() == 2
    assert grid.tile_grid(s, 300, edges=False).count() == 18 and grid.tile_grid(s, 300, edges=True).count() == 28


def test_tile_plan_flow(spark):
    slides = spark.createDataFrame([("s", 64, 64, 1.0, 64, 64), ("empty", 64, 64, 1.0, 64, 64)], "slide string, width int, height int, scale double, mask_w int, mask_h int")
    img = np.zeros((64, 64), int)
    img[:32] = 1
    mask = long(spark, img, x="mx", y="my").unionByName(long(spark, img * 0, "empty", x="mx", y="my"))
    plan = workflows.tile_plan(slides, mask, 8, cap=10).toPandas()
    assert len(plan) == 10 and set(plan["slide"]) == {"s"} and (plan["fraction"] == 1.0).all()


def otsu_by_hand(v):
    hist, _ = np.histogram(v, bins=256, range=(0, 255))
    best, at = -1.0, 0
    for t in range(256):
        lo, hi = hist[: t + 1], hist[t + 1 :]
        if lo.sum() and hi.sum():
            m0, m1 = np.average(np.arange(t + 1), weights=lo), np.average(np.arange(t + 1, 256), weights=hi)
            sigma = lo.sum() * hi.sum() * (m0 - m1) ** 2
            if sigma > best * (1 + 1e-12):
                best, at = sigma, t
    return at


def test_otsu_splits_two_modes_and_falls_back(spark):
    rng = np.random.default_rng(6)
    v = np.r_[rng.integers(30, 60, 300), rng.integers(170, 230, 200)]
    got = raster.otsu(long(spark, v.reshape(20, 25)), ["slide"], F.col("v")).first()
    assert got["threshold"] == otsu_by_hand(v) and got["fraction"] == pytest.approx((v < otsu_by_hand(v)).mean())
    assert not got["degenerate"]
    mostly = np.r_[rng.integers(30, 60, 480), rng.integers(170, 230, 20)]
    strict = raster.otsu(long(spark, mostly.reshape(20, 25)), ["slide"], F.col("v")).first()
    assert strict["degenerate"] and strict["threshold"] == int(mostly.mean())


def test_heat_grid_and_rectangles(spark):
    s = spark.createDataFrame([("s", 3, 5, 0.5), ("s", 9, 5, 0.1), ("s", 3, 8, 1.5)], "slide string, tx int, ty int, score double")
    got = {(r["gi"], r["gj"]): r["score"] for r in grid.heat_grid(s).collect()}
    assert got == {(0, 0): 0.5, (0, 1): 0.1, (1, 0): 1.5, (1, 1): None}
    placed = s.withColumns({"w": F.lit(10), "h": F.lit(10), "wl": F.lit(20), "hl": F.lit(20)})
    rects = {(r["px"], r["py"], r["px1"], r["py1"]) for r in grid.tile_rects(placed, 2).collect()}
    assert rects == {(3, 5, 4, 6), (9, 5, 10, 6), (3, 8, 4, 9)}


def stain_by_hand(img, io=240.0, alpha=1.0, beta=0.15):
    flat = img.reshape(-1, 3).astype(float)
    od = -np.log10((flat + 1) / io)
    solid = od[(od >= beta).all(axis=1)]
    plane = np.linalg.eigh(np.cov(solid.T))[1][:, 1:]
    proj = solid @ plane
    lo, hi = np.percentile(np.arctan2(proj[:, 1], proj[:, 0]), [alpha, 100 - alpha])
    a, b = (plane @ np.array([np.cos(t), np.sin(t)]) for t in (lo, hi))
    he = np.stack([a, b] if a[0] > b[0] else [b, a], axis=1)
    conc = np.linalg.pinv(he) @ od.T
    top = np.maximum(np.percentile(conc, 99, axis=1), 1e-6)
    scaled = conc / (top / np.array(stain.MAX_C_REFERENCE))[:, None]
    out = io * np.exp(-np.array(stain.HE_REFERENCE) @ scaled)
    alone = [io * np.exp(-np.outer(np.array(stain.HE_REFERENCE)[:, s], scaled[s])) for s in (0, 1)]
    return he, top, *[np.where(x > 255, 254, x).T.astype(np.uint8) for x in (out, *alone)]


def tissue(seed, size=24):
    rng = np.random.default_rng(seed)
    amounts = rng.gamma(2.0, 0.4, (size * size, 2))
    od = amounts @ np.array([[0.65, 0.70, 0.29], [0.07, 0.99, 0.11]]) * 0.5
    return np.clip(240 * 10 ** (-od) - 1, 0, 255).astype(np.uint8).reshape(size, size, 3)


def test_stain_vectors_match_numpy(spark):
    img = tissue(1)
    he, top, out, only_h, only_e = stain_by_hand(img)
    px = long(spark, img)
    got = stain.stain_vectors(px, ["slide"]).first()
    assert np.allclose([[got[f"h{i}"], got[f"e{i}"]] for i in (1, 2, 3)], he, atol=1e-8)
    assert np.allclose([got["max_h"], got["max_e"]], top, atol=1e-8)
    full = stain.separate_stains(px, ["slide"], components=True).toPandas().sort_values(["y", "x"])
    for names, want in ((["r2", "g2", "b2"], out), (["h_r", "h_g", "h_b"], only_h), (["e_r", "e_g", "e_b"], only_e)):
        assert np.abs(full[names].to_numpy().astype(int) - want.astype(int)).max() <= 1


def test_stain_vectors_of_small_and_large_tiles_agree(spark, monkeypatch):
    """Ordinary tiles are ordered whole, without buckets; a tile of too many colours goes through buckets to the same numbers."""
    px = long(spark, tissue(3)).unionByName(long(spark, tissue(4, 10), "t"))
    whole = stain.stain_vectors(px, ["slide"])
    assert "__bucket" not in whole._jdf.queryExecution().toString()
    names = whole.columns
    want = whole.orderBy("slide").drop("slide").toPandas()
    for most in (150, 20):  # one of two tiles is large, then both
        monkeypatch.setattr(ordered, "ORDERED_ROWS", most)
        got = stain.stain_vectors(px, ["slide"]).select(names).orderBy("slide").drop("slide").toPandas()
        assert len(got) == 2 and np.allclose(got.to_numpy(float), want.to_numpy(float), rtol=0, atol=1e-12)


def test_weighed_quantiles(spark):
    """Ties, weights, nulls and NaN against numpy over repeated values; a group without a value is left out."""
    rng, rows = np.random.default_rng(2), []
    for g in range(4):
        rows += [(g, float(a), float(b), int(w)) for a, b, w in zip(rng.integers(0, 9, 30), rng.normal(size=30), rng.integers(1, 5, 30))]
    rows += [(0, None, 1.0, 3), (1, float("nan"), -1.0, 2), (8, None, float("nan"), 4), (9, None, 2.0, 1)]
    df = spark.createDataFrame(rows, "g int, a double, b double, w long")
    got = {r["g"]: r for r in ordered.weighed_quantiles(df, ["g"], ["a", "b"], {"lo": 0.1, "hi": 0.9}, "w").collect()}
    assert sorted(got) == [0, 1, 2, 3, 9]
    for g, row in got.items():
        for k, c in ((1, "a"), (2, "b")):
            held = [v for r in rows if r[0] == g and r[k] is not None and r[k] == r[k] for v in [r[k]] * r[3]]
            want = np.percentile(held, [10, 90]) if held else [None, None]
            assert (row[f"{c}_lo"] is None) == (not held) and (not held or np.allclose([row[f"{c}_lo"], row[f"{c}_hi"]], want, atol=1e-12))


def test_axes_match_numpy(spark):
    """Random covariances, tiny and huge ones, planes, repeated eigenvalues and multiples of the identity."""
    rng = np.random.default_rng(6)
    turned = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    cases = [np.cov(rng.normal(size=(3, 20)) * rng.uniform(0.1, 3, (3, 1))) * scale for scale in (1, 1e-8, 1e8) for _ in range(20)]
    cases += [turned @ np.diag(d) @ turned.T for d in ([0, 1, 4], [0, 0, 2], [1, 3, 3], [1, 1, 3], [2, 2, 2], [0, 0, 0])] + [np.diag([3.0, 1.0, 2.0]), np.eye(3)]
    names = ["c00", "c01", "c02", "c11", "c12", "c22"]
    rows = [(i, *[float(m[int(c[1]), int(c[2])]) for c in names]) for i, m in enumerate(cases)]
    got = stain.stain_axes(spark.createDataFrame(rows, ["i", *names]), ["i"]).orderBy("i").collect()
    for row, m in zip(got, cases):
        second, largest = np.array(row["second"]), np.array(row["largest"])
        values, vectors = np.linalg.eigh(m)
        size = max(abs(values).max(), 1e-300)
        assert abs(second @ largest) < 1e-7 and abs(second @ second - 1) < 1e-7 and abs(largest @ largest - 1) < 1e-9
        assert np.abs(m @ largest - values[2] * largest).max() < 1e-6 * size and np.abs(m @ second - values[1] * second).max() < 1e-6 * size
        assert second.sum() >= -1e-12 and largest.sum() >= -1e-12
        gaps = np.diff(values) / size
        if gaps.min() > 1e-2:
            assert np.allclose(np.abs(second @ vectors[:, 1]), 1, atol=1e-10) and np.allclose(np.abs(largest @ vectors[:, 2]), 1, atol=1e-10)


def test_blank_tile_passes_through(spark):
    px = long(spark, np.full((5, 5, 3), 250, np.uint8))
    assert {tuple(r) for r in stain.separate_stains(px, ["slide"]).select("r2", "g2", "b2").collect()} == {(250, 250, 250)}
    assert {tuple(r) for r in stain.percentile_scale(px, ["slide"]).select("r2", "g2", "b2").collect()} == {(250, 250, 250)}
    assert stain.drop_transparent(px, ["slide"]).count() == 25


def test_percentile_and_stain_scaling(spark):
    img = tissue(2)
    got = stain.percentile_scale(long(spark, img), ["slide"]).toPandas().sort_values(["y", "x"])
    for i, c in enumerate("rgb"):
        lo, hi = np.percentile(img[..., i], [1, 99])
        want = np.clip((img[..., i].astype(float) - lo) / (hi - lo) * 255, 0, 255).astype(int)
        assert (got[f"{c}2"].to_numpy() == want.ravel()).all()
    mixed = stain.stain_percentile(long(spark, img), ["slide"]).toPandas()
    assert mixed[["r2", "g2", "b2"]].to_numpy().min() >= 0 and mixed[["r2", "g2", "b2"]].to_numpy().max() <= 255


def test_colour_round_trips(spark):
    from slidegrid.functions import color

    px = spark.createDataFrame([(200, 120, 180), (10, 250, 40), (90, 60, 130)], "r int, g int, b int")
    rgb = [F.col(c) for c in "rgb"]
    for back in (color.remix(*color.unmix(*rgb)), color.lab_to_rgb(*color.lab(*rgb))):
        for r in px.select(*rgb, *[F.round(x).cast("int") for x in back]).collect():
            if min(r[:3]) > 50:
                assert np.abs(np.array(r[:3]) - np.array(r[3:])).max() <= 1


def test_quality_rules(spark):
    df = spark.createDataFrame([(50.0, 200.0, 90.0, 100.0), (5.0, 20.0, 5.0, 100.0)], "tissue_percentage double, focus_score double, mean_saturation double, mean_value double")
    good, bad = quality.judge(df).orderBy(F.desc("tissue_percentage")).collect()
    assert good["is_valid"] and good["reasons"] == []
    assert bad["reasons"] == ["low tissue (5.0%)", "unfocused (20.0)", "poor staining"]
    qc = quality.tile_qc(long(spark, tissue(4)), ["slide"], quality.TileRules(focus_threshold=1.0)).first()
    assert qc["focus_score"] > 1 and 0 < qc["tissue_percentage"] < 100
    other = quality.tile_qc(long(spark, tissue(4)), ["slide"], polarity="bright").first()
    assert other["tissue_percentage"] == pytest.approx(100 - qc["tissue_percentage"])


def test_accept_until_stops_at_the_nth(spark):
    rows = [("s", i, i % 3 == 0) for i in range(100)] + [("t", i, False) for i in range(5)]
    df = spark.createDataFrame(rows, "slide string, tile_idx int, ok boolean")
    got = quality.accept_until(df, ["slide"], "tile_idx", F.col("ok"), 4, block=6).toPandas()
    assert got[got["slide"] == "s"]["tile_idx"].max() == 9 and len(got[got["slide"] == "t"]) == 5
    assert sorted(got["new_id"].dropna()) == [0, 1, 2, 3]


def test_compare_rasters_flat_rules(spark):
    a = pd.DataFrame([(0, t, i, 0, v) for t, vs in {0: [1, 2, 3], 1: [5, 5, 5], 2: [5, 5, 5]}.items() for i, v in enumerate(vs)], columns=["slide", "tile", "x", "y", "v"])
    b = a.copy()
    b.loc[b["tile"] == 2, "v"] = [1, 2, 3]
    got = {r["tile"]: r["ok"] for r in raster.compare_rasters(spark.createDataFrame(a), spark.createDataFrame(b), ["slide", "tile"]).collect()}
    assert got == {0: True, 1: True, 2: False}


def test_a_hole_stops_a_stencil(spark):
    img = np.arange(20).reshape(4, 5)
    whole = long(spark, img)
    assert raster.stencil(whole, "median").count() == 20
    with pytest.raises(Exception, match="hole"):
        raster.stencil(whole.where("NOT (x = 2 AND y = 1)"), "median").collect()


def test_median_of_denoising_repeats_the_edge(spark):
    img = np.random.default_rng(3).integers(0, 255, (6, 7))
    got = raster.stencil(long(spark, img), "median", 1, border="replicate").toPandas().pivot(index="y", columns="x", values="v").to_numpy()
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(img, 1, mode="edge"), (3, 3))
    assert np.allclose(got, np.median(windows, axis=(2, 3)))


def test_chained_stencils_in_blocks(spark):
    """Blur, median, opening and closing in one pass, in one block and in many, against the same steps one by one."""
    rng = np.random.default_rng(4)
    rows = [(s, x, y, *map(int, rng.integers(0, 256, 3))) for s, (w, h) in enumerate([(23, 17), (5, 40), (3, 3)]) for x in range(w) for y in range(h)]
    px = spark.createDataFrame(rows, "slide long, x int, y int, r int, g int, b int")
    steps = raster.denoise_steps(2, 3, 3) + [("max", 2, raster.disk(2), "reflect101"), ("min", 1, raster.disk(1), "reflect101")]
    want = {}
    for c in "rgb":
        g = px.select("slide", "x", "y", F.col(c).alias("v"))
        g = raster.stencil(g, "weighted", 1, weights=raster.GAUSSIAN_3).withColumn("v", F.round("v").cast("int"))
        g = raster.dilate(raster.erode(raster.stencil(g, "median", 1, border="replicate"), 2), 2)
        g = raster.erode(raster.dilate(g, 2, border="reflect101"), 1, border="reflect101")
        want |= {(r["slide"], r["x"], r["y"], c): r["v"] for r in g.collect()}
    for side in (4, 256):
        out = raster.chained_stencils(px, steps, values=list("rgb"), side=side)
        assert out.dtypes == px.dtypes
        rows = out.collect()
        assert len(rows) * 3 == len(want) and {(r["slide"], r["x"], r["y"], c): r[c] for r in rows for c in "rgb"} == want


def test_a_denoised_pixel_is_shuffled_once(spark):
    from slidegrid.operators import foreground

    px = spark.createDataFrame([(0, x, y, x, y, 7) for x in range(4) for y in range(4)], "slide long, x int, y int, r int, g int, b int")
    plan = foreground.denoise_colours(px, ["slide"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate explode(array(struct" not in plan and plan.count("FlatMapGroupsInArrow") == 1
    with pytest.raises(Exception, match="hole"):
        foreground.denoise_colours(px.where("x != 1"), ["slide"]).collect()
    with pytest.raises(Exception, match="without a value"):
        foreground.denoise_colours(px.withColumn("g", F.nullif("g", F.lit(2))), ["slide"]).collect()


def test_distinct_colours_are_read_as_columns(spark):
    """Several passes read them: from files of columns, not as the rows of a checkpoint. Tables without pixels stay tables."""
    px = spark.createDataFrame([(1, 5, 6, 7), (1, 5, 6, 7), (2, 5, 6, 7)], "tile long, r int, g int, b int")
    found = stain.distinct_colours(px, ["tile"])
    assert found.inputFiles() and found.schema.names == ["tile", "r", "g", "b", "n_px"]
    assert sorted(map(tuple, found.collect())) == [(1, 5, 6, 7, 2), (2, 5, 6, 7, 1)]
    assert stain.distinct_colours(px.limit(0), ["tile"]).count() == 0
    assert stain.stain_vectors(px.limit(0), ["tile"]).count() == 0
