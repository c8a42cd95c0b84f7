"""Foreground masks and the tile chain against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidegrid.operators import foreground as fg, quality, raster
from slidegrid.queries import REGISTRY
from test_raster import dense, flood, long, otsu_by_hand


def picture(seed, h=30, w=26):
    """Dark blobs and specks on a bright ground."""
    rng = np.random.default_rng(seed)
    img = rng.integers(200, 240, (h, w, 3))
    img[4:15, 3:14] = rng.integers(60, 110, (11, 11, 3))
    img[8:10, 6:8] = 230
    img[20:22, 18:20] = 80
    img[17, 2] = 40
    return img


def grey(img):
    return np.floor(img @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(int)


def disk_filter(mask, r, pick):
    k = 2 * r + 1
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(mask, r, mode="reflect"), (k, k))
    return pick(windows[..., np.array(raster.disk(r)).reshape(k, k)], axis=-1)


def cleaned(binary, r, least):
    closed = disk_filter(disk_filter(binary.astype(int), r, np.max), r, np.min)
    lab = flood(closed)
    area = np.bincount(lab.ravel())
    area[0] = 0
    return np.where((closed > 0) & (area[lab] > least), 255, 0)


def adaptive(g):
    at = np.arange(11) - 5
    line = np.exp(-(at ** 2) / 8.0)
    line /= line.sum()
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(g, 5, mode="edge"), (11, 11))
    return ~(g > np.floor((windows * np.outer(line, line)).sum((2, 3)) + 0.5) - 2)


def test_masks_equal_numpy(spark):
    imgs = {"s": picture(1), "t": picture(2, 22, 31)}
    px = long(spark, imgs["s"]).unionByName(long(spark, imgs["t"], slide="t"))
    one = lambda df, name: dense(df.where(F.col("slide") == name))
    masks = {m: fg.foreground_mask(px, ["slide"], m, min_area=5, invert=m != "saturation").cache() for m in fg.METHODS}
    share = fg.foreground_mask(px, ["slide"], threshold=150, min_percent=1.0).cache()
    for name, img in imgs.items():
        g = grey(img)
        top, low = img.max(-1), img.min(-1)
        sat = np.floor(255.0 * (top - low) / top + 0.5) > 30
        for method, binary in (("otsu", g <= otsu_by_hand(g)), ("adaptive", adaptive(g)), ("saturation", sat)):
            assert (one(masks[method], name) == cleaned(binary, 2, 5)).all(), method
        assert (one(share, name) == cleaned(g <= 150, 2, int(g.size / 100))).all()
    with pytest.raises(ValueError, match="unknown method"):
        fg.binary(px, ["slide"], "edges")


def test_masked_pixels_are_black(spark):
    img = picture(3)
    px = long(spark, img)
    got = fg.apply_mask(px, fg.foreground_mask(px, ["slide"], min_area=5), ["slide"]).toPandas()
    want = cleaned(grey(img) <= otsu_by_hand(grey(img)), 2, 5)
    for i, c in enumerate("rgb"):
        out = np.zeros(want.shape, int)
        out[got["y"], got["x"]] = got[c]
        assert (out == np.where(want > 0, img[..., i], 0)).all()
    empty = fg.foreground_mask(px, ["slide"], threshold=0, min_area=5)
    assert empty.count() == img.shape[0] * img.shape[1] and empty.where("v > 0").count() == 0


def test_chain_keeps_valid_tiles(spark):
    img = picture(4)
    px = long(spark, img).unionByName(long(spark, np.full((12, 12, 3), 250), slide="glass"))
    rules = quality.TileRules(min_tissue_percent=5.0, check_focus=False, saturation=(-1.0, 256.0), value=(-1.0, 249.0))
    pixels, tiles = fg.process_tiles(px, ["slide"], rules)
    told = {r["slide"]: r for r in tiles.collect()}
    assert told["s"]["is_valid"] and not told["glass"]["is_valid"] and told["glass"]["foreground_percentage"] is None
    out = pixels.toPandas()
    assert set(out["slide"]) == {"s"} and len(out) == img.shape[0] * img.shape[1]
    calm = fg.denoise_colours(long(spark, img), ["slide"]).toPandas()
    for i, c in enumerate("rgb"):
        alone = dense(raster.denoise(long(spark, img[..., i]), 2))
        flat = np.zeros(alone.shape)
        flat[calm["y"], calm["x"]] = calm[c]
        assert (flat == alone).all()
    denoised = np.zeros(img.shape, int)
    denoised[calm["y"], calm["x"]] = calm[["r", "g", "b"]]
    g = grey(denoised)
    want = cleaned(g <= otsu_by_hand(g), 2, int(g.size / 100))
    assert told["s"]["foreground_percentage"] == pytest.approx((want > 0).mean() * 100)
    masked = np.where((want > 0)[..., None], denoised, 0)
    for i, c in enumerate("rgb"):
        lo, hi = np.percentile(masked[..., i], [1, 99])
        scaled = np.clip((masked[..., i] - lo) / (hi - lo) * 255, 0, 255).astype(int) if hi > lo else masked[..., i]
        got = np.zeros(scaled.shape, int)
        got[out["y"], out["x"]] = out[f"{c}2"]
        assert (got == scaled).all()


def test_chain_query_leaves_out_rejected_tiles(spark, tmp_path):
    """A full tile goes through the chain; one with few events is nearly black, its mean saturation is beyond the rules, and it goes no further."""
    values = np.random.default_rng(5).exponential(50, 4096 + 300).round(2)
    rows = [(i, float(v)) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    red = np.zeros((2, 4096))
    red.ravel()[: len(values)] = np.minimum(np.floor(values) * 3, 255)
    top, low = np.minimum(red + 20, 255), np.maximum(red - 40, 0)
    saturation = (255.0 * (top - low) / top).mean(axis=1)
    assert 10 < saturation[0] < 220 <= saturation[1]
    full, sparse = sorted(REGISTRY["processed_tiles"].run(spark, str(tmp_path)).collect(), key=lambda r: r["slide"])
    assert full["is_valid"] and full["n"] == 4096 and 0 < full["n_foreground"] < 4096 and full["r2"] > 0
    assert not sparse["is_valid"] and sparse["foreground_percentage"] is None and sparse["n"] is None and sparse["r2"] is None
