"""Tile acceptance: validity rules, accept-until-N, run statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from slidegrid.operators import raster
from slidegrid.functions import color
from slidegrid.operators.ordered import BUCKET, index_bucket
from slidegrid.operators.skew import copies_join
from slidegrid.session import cut_lineage


@dataclass(frozen=True)
class TileRules:
    min_tissue_percent: float = 10.0
    focus_method: str = "laplacian"
    focus_threshold: float = 100.0
    check_focus: bool = True
    saturation: tuple[float, float] = (10.0, 220.0)
    value: tuple[float, float] = (30.0, 240.0)


def is_stained(saturation: Column, value: Column, rules: TileRules = TileRules()) -> Column:
    (s0, s1), (v0, v1) = rules.saturation, rules.value
    return (saturation > s0) & (saturation < s1) & (value > v0) & (value < v1)


def judge(df: DataFrame, rules: TileRules = TileRules()) -> DataFrame:
    """Validity and rejection reasons from tissue_percentage, focus_score, mean_saturation, mean_value."""
    tissue = F.col("tissue_percentage") >= rules.min_tissue_percent
    focus = F.col("focus_score") >= rules.focus_threshold if rules.check_focus else F.lit(True)
    stain = is_stained(F.col("mean_saturation"), F.col("mean_value"), rules)
    return df.withColumns({"has_tissue": tissue, "is_focused": focus, "is_stained": stain}).withColumns(
        {
            "is_valid": F.col("has_tissue") & F.col("is_focused") & F.col("is_stained"),
            "reasons": F.array_compact(
                F.array(
                    F.when(~F.col("has_tissue"), F.concat(F.lit("low tissue ("), F.format_string("%.1f", "tissue_percentage"), F.lit("%)"))),
                    F.when(~F.col("is_focused"), F.concat(F.lit("unfocused ("), F.format_string("%.1f", "focus_score"), F.lit(")"))),
                    F.when(~F.col("is_stained"), F.lit("poor staining")),
                )
            ),
        }
    )


def tile_qc(px: DataFrame, by: list[str], rules: TileRules = TileRules(), polarity: str = "dark") -> DataFrame:
    """Full assessment of tiles given as pixel rows (by, x, y, r, g, b).

    ``polarity`` says whether tissue is the dark or the bright side of the tile's Otsu threshold.
    """
    grey = F.round(color.grey(F.col("r"), F.col("g"), F.col("b"))).cast("int")
    stats = raster.tile_stats(px, by)
    dark = raster.otsu(px, by, grey, strict_above=1.0)
    share = F.col("fraction") if polarity == "dark" else F.lit(1.0) - F.col("fraction")
    tissue = dark.select(*by, (share * 100.0).alias("tissue_percentage"))
    out = stats.join(tissue, by)
    if not rules.check_focus:
        out = out.withColumn("focus_score", F.lit(0.0))
    elif rules.focus_method == "variance":
        out = out.withColumn("focus_score", F.col("grey_variance"))
    elif rules.focus_method == "laplacian":
        out = out.join(raster.focus_scores(px.withColumn("v", grey), by), by)
    else:
        raise ValueError(f"unknown focus method {rules.focus_method!r}")
    return judge(out, rules)


def accept_until(df: DataFrame, by: list[str], index: str, accepted: Column, n: int, block: int = 1 << 16) -> DataFrame:
    """Rows in scan order up to and including the n-th accepted one; accepted rows get ``new_id`` from 0.

    Accepted rows are counted per block of the index; only the block in which a group's n-th lies, and the accepted rows before it, are
    ranked, on the key columns alone. Whole rows meet one cut per group and take part in no window. ``index`` is unique in a group.
    """
    hits = df.where(accepted).select(*by, F.col(index).alias("__at"), index_bucket(F.col(index), block).alias(BUCKET))
    before = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    sizes = hits.groupBy(*by, BUCKET).agg(F.count("*").alias("__c"))
    needed = sizes.withColumn("__o", F.coalesce(F.sum("__c").over(before), F.lit(0))).where(F.col("__o") < n).drop("__c")
    rank = F.col("__o") + F.row_number().over(Window.partitionBy(*by, BUCKET).orderBy("__at"))
    placed = cut_lineage(hits.join(needed, [*by, BUCKET]).withColumn("__rank", rank).where(F.col("__rank") <= n).select(*by, "__at", "__rank"))
    cut = placed.where(F.col("__rank") == n).select(*by, F.col("__at").alias("__cut"))
    scanned = copies_join(df, cut, by, "left", salt_on=[index]).where(F.col("__cut").isNull() | (F.col(index) <= F.col("__cut"))).drop("__cut")
    ids = placed.select(*by, F.col("__at").alias(index), (F.col("__rank") - 1).cast("long").alias("new_id"))
    return scanned.join(ids, [*by, index], "left").select(*df.columns, "new_id")


def run_stats(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Scanned, accepted, rejected, failed and the tissue statistics of accepted tiles."""
    ok = F.col("accepted") & ~F.col("failed")
    share = F.when(ok, F.col("tissue_percentage"))
    return df.groupBy(*by).agg(
        F.count("*").alias("scanned"),
        F.count_if(ok).alias("accepted"),
        F.count_if(~ok & ~F.col("failed")).alias("rejected"),
        F.count_if(F.col("failed")).alias("failed"),
        (F.count_if(ok) * 100.0 / F.count("*")).alias("acceptance_pct"),
        F.avg(share).alias("mean_tissue"),
        F.stddev_pop(share).alias("std_tissue"),
    )
