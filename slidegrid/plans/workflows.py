"""The three end-to-end flows, each a composition of operators on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slidegrid.operators import bags, cohort, evaluate, folds as fd, grid
from slidegrid.operators.ordered import sample_cap
from slidegrid.session import cut_lineage


def cohort_report(slides: DataFrame) -> dict[str, DataFrame]:
    """Statistics over samples: every entry is lazy and reads the same per-sample table."""
    samples = cohort.per_sample(slides)
    return {
        "samples": samples,
        "prevalence": cohort.prevalence(samples),
        "by_stage": cohort.by_stage(samples),
        "by_sex": cohort.by_group(samples, "sex"),
        "expression": cohort.group_stats(samples, ["status"], "expression"),
        "age": cohort.group_stats(samples, ["status"], "age"),
        "cna": cohort.value_counts(samples, "cna"),
    }


def tile_plan(
    slides: DataFrame, mask: DataFrame, step: int, min_fraction: float = 0.6, cap: int | None = None, seed: int = 0, block: int = 8
) -> DataFrame:
    """Grid, tissue filter, seeded cap where one is given, block plan: the tiles to read and in which groups."""
    cells = grid.tile_grid(slides, step, edges=True).withColumn("step", F.lit(step))
    kept = grid.keep_tissue(grid.coverage(cells, mask), min_fraction)
    chosen = kept if cap is None else sample_cap(kept, ["slide"], ["tile_idx"], cap, seed)
    return grid.plan_blocks(chosen, step, block)


def score_report(
    preds: DataFrame, slide_folds: DataFrame, labels: DataFrame, target: float = 0.92, n_repeats: int = 0,
    eval_mode: str = "out_of_fold", threshold: float | None = None,
) -> DataFrame:
    """Patient metrics from per-model predictions as one nested record.

    ``eval_mode`` is "out_of_fold" (each slide by the models that never saw it) or "ensemble" (new slides, by all models).
    """
    if eval_mode not in ("out_of_fold", "ensemble"):
        raise ValueError(f"unknown evaluation mode {eval_mode}")
    scored = evaluate.out_of_fold(preds, slide_folds) if eval_mode == "out_of_fold" else evaluate.ensemble_mean(preds)
    slides = scored.join(labels, "slide").withColumn("pos", F.col("slide"))
    units = evaluate.aggregate_units(slides).select("unit", "label", F.col("prob").alias("score"))
    return evaluate.metrics_record(units, target, n_repeats, eval_mode=eval_mode, threshold=threshold)


def train_and_report(
    embeddings: DataFrame, labels: DataFrame, splits: int = 5, repeats: int = 1, epochs: int = 30, lr: float = 1e-3,
    n_extreme: int = 100, hidden: int = bags.HIDDEN, head: tuple[int, int] = bags.HEAD, max_tiles: int = 5000,
):
    """(models, predictions, folds, loss history) of a grouped cross-validation run.

    ``max_tiles`` bounds the tiles of a slide that the models are fitted on; predictions come from all tiles.
    """
    tiles = bags.store_bags(bags.load_bags(embeddings, labels, max_tiles)[0])  # read in every epoch
    everything, _ = bags.load_bags(embeddings, labels, None)
    n = bags.shrink_extremes(tiles, n_extreme).first()["n_extreme"]
    k = fd.fold_count(labels, fd.fold_units(labels), splits)
    folds = cut_lineage(fd.make_folds(labels, splits, repeats, k=k))
    held = fd.slide_folds(labels, folds)
    train = fd.train_val(held, k).where(~F.col("is_val")).join(labels.select("slide", "label"), "slide")
    dim = tiles.select(F.size("emb")).first()[0]
    fresh = [
        bags.BagModel.fresh(r, f, dim, n, fd.model_seed(r, f), hidden, head) for r in range(repeats) for f in range(k)
    ]
    models, history = bags.train_ensemble(tiles, train, fresh, epochs, lr)
    return models, bags.slide_probabilities(everything, models), held, history
