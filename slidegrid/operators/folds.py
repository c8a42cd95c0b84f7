"""Stratified, patient-grouped cross-validation folds as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slidegrid.functions.barcode import patient_or_stem
from slidegrid.functions.hashing import hash_bucket, hash_digits, seeded_key
from slidegrid.operators.ordered import BUCKET, running_totals
from slidegrid.operators.skew import spread_join


def fold_units(labels: DataFrame, unit: str = "patient") -> DataFrame:
    """(unit, label, n_slides): a patient takes the label of its first slide."""
    if unit == "patient":
        keyed = labels.withColumn("unit", labels["patient"] if "patient" in labels.columns else patient_or_stem(F.col("slide").cast("string")))
    else:
        keyed = labels.withColumn("unit", F.col("slide"))
    return keyed.groupBy("unit").agg(F.min_by("label", "slide").alias("label"), F.count("*").alias("n_slides"))


def fold_count(labels: DataFrame, units: DataFrame, splits: int) -> int:
    """Folds possible: never more than the smallest class has slides or units."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).collect()
    if len(sizes) < 2:
        raise ValueError(f"only one class present ({[r['label'] for r in sizes]}): slides of both classes are needed")
    per_class = units.groupBy("label").agg(F.count("*").alias("n")).collect()
    limit = min([r["n"] for r in sizes] + [r["n"] for r in per_class] + ([0] if len(per_class) < 2 else []))
    k = min(splits, limit)
    if k < 2:
        raise ValueError(f"cannot cross-validate: the smallest class has {limit} member(s), two are needed")
    return k


def make_folds(labels: DataFrame, splits: int = 5, repeats: int = 1, unit: str = "patient", k: int | None = None) -> DataFrame:
    """(repeat, unit, label, n_slides, fold): every unit is held out once per repeat.

    Inside a class, units are ordered by slide count (largest first) and a hash seeded by the repeat,
    then dealt to the folds back and forth, which balances classes to one unit and slides closely.
    The numbering is a bucketed prefix sum, with as many buckets as the largest class needs, so a class of any size is spread
    over the cluster.
    """
    units = fold_units(labels, unit)
    k = k or fold_count(labels, units, splits)
    keyed = units.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn(
        "__key", F.md5(F.concat_ws(":", F.col("repeat").cast("string"), F.col("unit").cast("string")))
    )
    digits = hash_digits(units.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
    size_rank = F.lpad((F.lit((1 << 63) - 1) - F.col("n_slides")).cast("string"), 19, "0")
    placed = running_totals(
        keyed.withColumn(BUCKET, F.concat(size_rank, hash_bucket(F.col("__key"), digits))),
        ["repeat", "label"],
        [F.col("n_slides").desc(), F.col("__key"), F.col("unit")],
        {"__rank": F.lit(1)},
    )
    turn = F.floor((F.col("__rank") - 1) / k)
    step = (F.col("__rank") - 1) % k
    return placed.select(
        "repeat", "unit", "label", "n_slides", F.when(turn % 2 == 0, step).otherwise(k - 1 - step).cast("int").alias("fold")
    )


def slide_folds(labels: DataFrame, folds: DataFrame) -> DataFrame:
    """(repeat, fold, slide): the fold in which a slide is held out."""
    keyed = labels.withColumn(
        "unit", labels["patient"] if "patient" in labels.columns else patient_or_stem(F.col("slide").cast("string"))
    ).select("slide", "unit")
    return spread_join(keyed, folds.select("repeat", "unit", "fold").groupBy("unit").agg(
        F.collect_list(F.struct("repeat", "fold")).alias("__f")
    ), ["unit"], salt_on=["slide"]).select("slide", F.inline("__f"))


def train_val(slide_folds_df: DataFrame, k: int) -> DataFrame:
    """Every slide once per (repeat, fold): ``is_val`` in its own fold, training in the others."""
    return slide_folds_df.withColumnRenamed("fold", "__own").withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    ).withColumn("is_val", F.col("fold") == F.col("__own")).drop("__own")


def model_seed(repeat, fold):
    """Fixed value: the seed rule of one model."""
    return repeat * 100_000 + fold * 1_000 + 7
