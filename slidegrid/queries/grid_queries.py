"""Geometry, tile grids, coverage and heat grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidegrid.functions import scalars
from slidegrid.operators import grid, merge, quality
from slidegrid.operators.ordered import sample_cap
from slidegrid.queries.registry import query, r6, rounded
from slidegrid.session import table

# Slide geometry over parts.
_GEOM = """geom AS (SELECT p_partkey AS slide, p_size * 300 + 500 AS width, p_size * 200 + 400 AS height, round(0.2 + p_size / 100.0, 2) AS native_mpp FROM part)"""


def geometry(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("slide"), (F.col("p_size") * 300 + 500).alias("width"), (F.col("p_size") * 200 + 400).alias("height"),
        F.round(F.lit(0.2) + F.col("p_size") / 100.0, 2).alias("native_mpp"),
    )


@query("pyramid_levels", "PR23", f"""WITH {_GEOM} SELECT slide, CAST(k AS INTEGER) AS level, CAST(ceil(width / power(2.0, 17 - k)) AS BIGINT) AS level_w, CAST(ceil(height / power(2.0, 17 - k)) AS BIGINT) AS level_h,
 round(native_mpp * power(2.0, 17 - k), 4) AS level_mpp FROM geom, (SELECT unnest(range(0, 18)) AS k)""")
def pyramid_levels(spark, d):
    return grid.pyramid(geometry(spark, d)).select("slide", "level", "level_w", "level_h", "level_mpp")


_LEVELS = f"""{_GEOM}, lev AS (SELECT slide, native_mpp, width, CAST(k AS INTEGER) AS level, power(2.0, k) AS downsample FROM geom, (SELECT unnest(range(0, 5)) AS k) WHERE k <= slide % 5)"""


@query("level_choice", "PR24", f"""WITH {_LEVELS}, c AS (SELECT slide, arg_min(level, (round(abs(native_mpp * downsample - 1.0), 9), level)) AS closest FROM lev GROUP BY 1),
b AS (SELECT slide, coalesce(max(level) FILTER (downsample <= 1.0 / native_mpp), 0) AS best, max(width) AS width, max(downsample) AS ds FROM lev GROUP BY 1)
SELECT c.slide, closest, best, CAST(greatest(0, least(17, 17 - round_even(log2(width / floor(width / ds)), 0))) AS INTEGER) AS dyadic FROM c JOIN b ON c.slide = b.slide""")
def level_choice(spark, d):
    lev = geometry(spark, d).withColumn("level", F.explode(F.sequence(F.lit(0), (F.col("slide") % 5).cast("int")))).withColumn(
        "downsample", F.pow(F.lit(2.0), F.col("level"))
    )
    closest = grid.pick_level(lev, 1.0).select("slide", F.col("level").alias("closest"))
    best = grid.pick_level(lev, 1.0, "best_downsample").select("slide", F.col("level").alias("best"))
    widths = lev.groupBy("slide").agg(F.max("width").alias("w"), F.max("downsample").alias("ds"))
    dyadic = widths.select("slide", grid.dyadic_level(F.floor(F.col("w") / F.col("ds")), F.col("w")).alias("dyadic"))
    return closest.join(best, "slide").join(dyadic, "slide")


@query("overlapping_grid", "TG1", f"""WITH {_GEOM}, g AS (SELECT slide, width, height, unnest(range(0, width, 896)) AS x0 FROM geom), h AS (SELECT *, unnest(range(0, height, 896)) AS y0 FROM g)
SELECT slide, CAST((y0 // 896) * ((width - 1) // 896 + 1) + x0 // 896 AS INTEGER) AS tile_idx, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, CAST(least(x0 + 1024, width) AS INTEGER) AS x1, CAST(least(y0 + 1024, height) AS INTEGER) AS y1 FROM h""")
def overlapping_grid(spark, d):
    return grid.overlap_grid(geometry(spark, d)).select("slide", "tile_idx", "x0", "y0", "x1", "y1")


@query("region_grid", "TG1 FL4", f"""WITH {_GEOM}, g AS (SELECT slide, width, height, unnest(range(0, width, 896)) AS x0 FROM geom), h AS (SELECT *, unnest(range(0, height, 896)) AS y0 FROM g),
t AS (SELECT slide, CAST((y0 // 896) * ((width - 1) // 896 + 1) + x0 // 896 AS INTEGER) AS tile_idx, x0, y0 FROM h)
SELECT slide, tile_idx FROM t WHERE x0 >= 1000 AND x0 < 9000 AND y0 >= 500 AND y0 < 6500 AND tile_idx >= 12""")
def region_grid(spark, d):
    return grid.roi(grid.overlap_grid(geometry(spark, d)), 1000, 500, 8000, 6000, resume_from=12).select("slide", "tile_idx")


_CELLS = "SELECT slide, count(*) AS n_tiles, CAST(max(tx) AS INTEGER) AS last_tx, CAST(max(ty) AS INTEGER) AS last_ty, CAST(sum(x0 + y0) AS BIGINT) AS corner_sum FROM c GROUP BY slide"


def _grid_digest(tiles):
    return tiles.groupBy("slide").agg(
        F.count("*").alias("n_tiles"), F.max("tx").alias("last_tx"), F.max("ty").alias("last_ty"), F.sum(F.col("x0") + F.col("y0")).cast("long").alias("corner_sum")
    )


@query("edge_grid", "TG2 PR26", f"""WITH {_GEOM}, s AS (SELECT *, CAST(round_even(224.0 / native_mpp, 0) AS INTEGER) AS step FROM geom), g AS (SELECT *, unnest(range(0, width, step)) AS x0 FROM s),
h AS (SELECT *, unnest(range(0, height, step)) AS y0 FROM g), c AS (SELECT slide, x0, y0, x0 // step AS tx, y0 // step AS ty FROM h) {_CELLS}""")
def edge_grid(spark, d):
    step = scalars.footprint(224, 1.0, F.col("native_mpp"))
    return _grid_digest(grid.tile_grid(geometry(spark, d), step, edges=True))


@query("whole_cell_grid", "TG3", f"""WITH {_GEOM}, g AS (SELECT *, unnest(range(0, width // 896)) AS tx FROM geom), h AS (SELECT *, unnest(range(0, height // 896)) AS ty FROM g),
c AS (SELECT slide, tx, ty, tx * 896 AS x0, ty * 896 AS y0 FROM h) {_CELLS}""")
def whole_cell_grid(spark, d):
    return _grid_digest(grid.tile_grid(geometry(spark, d), 896, edges=False))


# Masks: events fill 64 by 64 rasters, cells without an event are zero.
MASK_CTE = """mask AS (SELECT s.slide, CAST(c % 64 AS INTEGER) AS mx, CAST(c // 64 AS INTEGER) AS my, CAST(coalesce("value", 0) AS DOUBLE) AS val FROM
 (SELECT DISTINCT event_id // 4096 AS slide FROM events) s CROSS JOIN (SELECT unnest(range(0, 4096)) AS c) LEFT JOIN events ON event_id = s.slide * 4096 + c)"""


def raster_values(spark, d):
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 4096).alias("slide"), (F.col("event_id") % 4096).cast("int").alias("c"), F.col("value").alias("val"))
    frame = e.select("slide").distinct().withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(4095))))
    filled = frame.join(e, ["slide", "c"], "left")
    return filled.select(
        "slide", (F.col("c") % 64).alias("mx"), F.floor(F.col("c") / 64).cast("int").alias("my"), F.coalesce("val", F.lit(0.0)).alias("val")
    )


def mask(spark, d, above=25.0):
    return raster_values(spark, d).withColumn("v", (F.col("val") > above).cast("int")).drop("val")


def mask_cells(spark, d, step):
    slides = mask(spark, d).select("slide").distinct().withColumns({"width": F.lit(4096), "height": F.lit(4096)})
    return grid.tile_grid(slides, step, edges=True).withColumns(
        {"step": F.lit(step), "scale": F.lit(64.0), "mask_w": F.lit(64), "mask_h": F.lit(64)}
    )


def _coverage_sql(step, tail):
    return f"""WITH {MASK_CTE}, ax AS (SELECT k AS t, CAST(floor(k * {step} / 64.0) AS INTEGER) AS a, CAST(least(64, greatest(floor(k * {step} / 64.0) + 1, floor((k + 1) * {step} / 64.0))) AS INTEGER) AS b
 FROM (SELECT unnest(range(0, CAST(ceil(4096.0 / {step}) AS INTEGER))) AS k)),
f AS (SELECT m.slide, x.t AS tx, y.t AS ty, count(*) FILTER (val > 25) / CAST(count(*) AS DOUBLE) AS fraction FROM mask m JOIN ax x ON mx >= x.a AND mx < x.b JOIN ax y ON my >= y.a AND my < y.b GROUP BY 1, 2, 3)
SELECT slide, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, round(fraction, 6) AS fraction FROM f {tail}"""


@query("cell_coverage", "JN10", _coverage_sql(300, ""))
def cell_coverage(spark, d):
    return rounded(grid.coverage(mask_cells(spark, d, 300), mask(spark, d)).select("slide", "tx", "ty", "fraction"), "fraction")


@query("integral_coverage", "JN10 WN7", _coverage_sql(300, ""))
def integral_coverage(spark, d):
    return rounded(grid.coverage(mask_cells(spark, d, 300), mask(spark, d), "integral").select("slide", "tx", "ty", "fraction"), "fraction")


@query("tissue_tiles", "FL1 JN10", _coverage_sql(448, "WHERE fraction >= 0.45"))
def tissue_tiles(spark, d):
    covered = grid.coverage(mask_cells(spark, d, 448), mask(spark, d))
    return rounded(grid.keep_tissue(covered, 0.45).select("slide", "tx", "ty", "fraction"), "fraction")


@query("integral_image", "WN7", f"""WITH {MASK_CTE}, r AS (SELECT *, sum(CAST(val > 25 AS INTEGER)) OVER (PARTITION BY slide, my ORDER BY mx) AS s FROM mask)
SELECT slide, mx, my, CAST(sum(s) OVER (PARTITION BY slide, mx ORDER BY my) AS BIGINT) AS total FROM r""")
def integral_image(spark, d):
    return grid.integral_image(mask(spark, d))


@query("seeded_cap", "SL4", """WITH r AS (SELECT user_id AS slide, event_id AS tile_idx, row_number() OVER (PARTITION BY user_id ORDER BY md5('3:' || user_id || ':' || event_id), event_id) AS rn FROM events)
SELECT slide, tile_idx FROM r WHERE rn <= 40""")
def seeded_cap(spark, d):
    tiles = table(spark, d, "events").select(F.col("user_id").alias("slide"), F.col("event_id").alias("tile_idx"))
    return sample_cap(tiles, ["slide"], ["tile_idx"], 40, seed=3)


@query("block_plan", "WN14", """WITH t AS (SELECT user_id % 5 AS slide, event_id AS tile_idx, (event_id % 100) * 256 AS x0, (event_id // 100 % 100) * 256 AS y0 FROM events)
SELECT slide, CAST(y0 // 256 // 8 AS INTEGER) AS by, CAST(x0 // 256 // 8 AS INTEGER) AS bx, count(*) AS n_tiles, min(x0) AS x0, min(y0) AS y0, max(x0) + 256 AS x1, max(y0) + 256 AS y1 FROM t GROUP BY 1, 2, 3""")
def block_plan(spark, d):
    k = F.col("event_id")
    tiles = table(spark, d, "events").select(
        (F.col("user_id") % 5).alias("slide"), k.alias("tile_idx"), (k % 100 * 256).alias("x0"), (F.floor(k / 100) % 100 * 256).alias("y0")
    )
    return grid.block_boxes(grid.plan_blocks(tiles, 256), 256)


@query("accept_until", "WN6", """WITH t AS (SELECT user_id % 7 AS slide, event_id AS tile_idx, "value" > 50 AS ok, sum(CAST("value" > 50 AS INTEGER)) OVER (PARTITION BY user_id % 7 ORDER BY event_id) AS acc FROM events)
SELECT slide, tile_idx, ok, CAST(CASE WHEN ok THEN acc - 1 END AS BIGINT) AS new_id FROM t WHERE acc < 100 OR (acc = 100 AND ok)""")
def accept_until(spark, d):
    tiles = table(spark, d, "events").select((F.col("user_id") % 7).alias("slide"), F.col("event_id").alias("tile_idx"), (F.col("value") > 50).alias("ok"))
    return quality.accept_until(tiles, ["slide"], "tile_idx", F.col("ok"), 100, block=512)


_SCORES = """sc AS (SELECT user_id % 10 AS slide, CAST(event_id % 37 AS INTEGER) AS tx, CAST(event_id // 37 % 41 AS INTEGER) AS ty, max(least("value" / 100.0, 1.2)) AS score FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3)"""


def tile_scores(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").where("event_type <> 'error'").groupBy(
        (F.col("user_id") % 10).alias("slide"), (k % 37).cast("int").alias("tx"), (F.floor(k / 37) % 41).cast("int").alias("ty")
    ).agg(F.max(F.least(F.col("value") / 100.0, F.lit(1.2))).alias("score"))


@query("heat_grid", "JN17 WN11", f"""WITH {_SCORES}, x AS (SELECT slide, tx, dense_rank() OVER (PARTITION BY slide ORDER BY tx) - 1 AS gj FROM (SELECT DISTINCT slide, tx FROM sc)),
y AS (SELECT slide, ty, dense_rank() OVER (PARTITION BY slide ORDER BY ty) - 1 AS gi FROM (SELECT DISTINCT slide, ty FROM sc))
SELECT x.slide, CAST(gi AS INTEGER) AS gi, CAST(gj AS INTEGER) AS gj, x.tx, y.ty, round(score, 6) AS score FROM x JOIN y ON x.slide = y.slide LEFT JOIN sc ON sc.slide = x.slide AND sc.tx = x.tx AND sc.ty = y.ty""")
def heat_grid(spark, d):
    return rounded(grid.heat_grid(tile_scores(spark, d)), "score")


@query("axis_index", "WN11", f"""WITH {_SCORES} SELECT slide, tx, CAST(dense_rank() OVER (PARTITION BY slide ORDER BY tx) - 1 AS INTEGER) AS gj FROM (SELECT DISTINCT slide, tx FROM sc)""")
def axis_index(spark, d):
    return grid.axis_index(tile_scores(spark, d), "tx", "gj", ["slide"])


@query("heat_rectangles", "PR27 PR28", f"""WITH {_SCORES}, p AS (SELECT slide, tx, ty, score, CAST(round_even(tx * 224 * (500 / 8000.0), 0) AS INTEGER) AS px, CAST(round_even(ty * 224 * (400 / 9000.0), 0) AS INTEGER) AS py FROM sc),
q AS (SELECT *, CAST(least(500, px + greatest(1, round_even(224 * (500 / 8000.0), 0))) AS INTEGER) AS px1, CAST(least(400, py + greatest(1, round_even(224 * (400 / 9000.0), 0))) AS INTEGER) AS py1 FROM p)
SELECT slide, tx, ty, px, py, px1, py1, round(power(greatest(0, least(1, score)), 0.6), 6) AS shown, round(0.5 + 0.5 * power(greatest(0, least(1, score)), 0.6), 6) AS opacity FROM q WHERE px1 > px AND py1 > py""")
def heat_rectangles(spark, d):
    placed = tile_scores(spark, d).withColumns({"w": F.lit(500), "h": F.lit(400), "wl": F.lit(8000.0), "hl": F.lit(9000.0)})
    shown, opacity = scalars.gamma_opacity(F.col("score"), 0.6)
    return grid.tile_rects(placed, 224).select("slide", "tx", "ty", "px", "py", "px1", "py1", r6(shown).alias("shown"), r6(opacity).alias("opacity"))


@query("kept_tile_ratio", "JN15", """SELECT a.slide, n_ours, n_theirs, round(n_ours / CAST(n_theirs AS DOUBLE), 6) AS ratio FROM (SELECT user_id AS slide, count(*) AS n_ours FROM events WHERE "value" > 30 GROUP BY 1) a
 JOIN (SELECT user_id AS slide, count(*) AS n_theirs FROM events WHERE event_type <> 'view' GROUP BY 1) b ON a.slide = b.slide""")
def kept_tile_ratio(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "slide")
    return rounded(merge.count_ratio(e.where("value > 30"), e.where("event_type <> 'view'")), "ratio")


@query("stale_bags", "JN12", """SELECT DISTINCT user_id AS slide FROM events WHERE user_id % 4 = 0 OR (user_id % 4 = 1 AND event_type = 'error') OR (user_id % 4 = 2 AND "value" > 200)""")
def stale_bags(spark, d):
    k = F.col("event_id")
    current = table(spark, d, "events").select(
        F.col("user_id").alias("slide"), k.alias("tile_idx"), (k % 64).alias("x"), F.floor(k / 64).alias("y"), "event_type", "value"
    )
    cached = (
        current.where("slide % 4 <> 0 AND NOT (slide % 4 = 1 AND event_type = 'error')")
        .withColumn("x", F.when((F.col("slide") % 4 == 2) & (F.col("value") > 200), F.col("x") + 1).otherwise(F.col("x")))
    )
    return merge.stale_bags(cached, current)
