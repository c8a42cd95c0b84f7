"""Scoring of predictions: ensembles, patient aggregation, ROC, thresholds, bootstrap.

Everything that depends on score order goes through one table, ``score_table``: counts per distinct
score with cumulative positives and negatives, built by bucketed prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from slidegrid.functions.barcode import patient_or_stem
from slidegrid.functions.hashing import hash_bucket, seeded_key, uniform_int
from slidegrid.operators.ordered import BUCKET, dense_positions, running_totals, split_points, value_bucket
from slidegrid.operators.skew import copies_join
from slidegrid.session import cut_lineage


def ensemble_mean(preds: DataFrame) -> DataFrame:
    """Mean probability per slide over all checkpoints (slide, repeat, fold, prob)."""
    return preds.groupBy("slide").agg(F.avg("prob").alias("prob"), F.count("*").alias("n_models"))


def out_of_fold(preds: DataFrame, slide_folds: DataFrame) -> DataFrame:
    """Mean of the models that never saw the slide: per repeat first, then over repeats.

    The join is a sort-merge join by hint: both sides have a row per slide and more, and the optimizer, which does not count what an
    explode adds, would send millions of them to the driver for a broadcast.
    """
    held = preds.join(slide_folds.hint("merge"), ["slide", "repeat", "fold"])
    per_repeat = held.groupBy("slide", "repeat").agg(F.avg("prob").alias("prob"))
    return per_repeat.groupBy("slide").agg(F.avg("prob").alias("prob"), F.count("*").alias("n_repeats"))


def out_of_fold_guards(preds: DataFrame, slide_folds: DataFrame) -> DataFrame:
    """(problem, slide, repeat, fold) rows that make an out-of-fold report untrustworthy.

    unseen slide: scored but in no fold; missing model: a fold without predictions; never held out:
    a slide of the split whose own fold's models did not score it. No table of slides is broadcast (see ``out_of_fold``).
    """
    null_int = F.lit(None).cast("int")
    unseen = preds.select("slide").distinct().join(slide_folds.hint("merge"), "slide", "left_anti").select(
        F.lit("unseen slide").alias("problem"), F.col("slide").cast("string").alias("slide"), null_int.alias("repeat"), null_int.alias("fold")
    )
    have = preds.select("repeat", "fold").distinct()
    missing = slide_folds.select("repeat", "fold").distinct().join(have, ["repeat", "fold"], "left_anti").select(
        F.lit("missing model").alias("problem"), F.lit(None).cast("string").alias("slide"), F.col("repeat").cast("int"), F.col("fold").cast("int")
    )
    scored = preds.select("slide").distinct()
    held = preds.join(slide_folds.hint("merge"), ["slide", "repeat", "fold"], "left_semi").select("slide").distinct()
    never = scored.join(slide_folds.select("slide").distinct().hint("merge"), "slide", "left_semi").join(held.hint("merge"), "slide", "left_anti").select(
        F.lit("never held out").alias("problem"), F.col("slide").cast("string").alias("slide"), null_int.alias("repeat"), null_int.alias("fold")
    )
    return unseen.unionByName(missing).unionByName(never)


def aggregate_units(preds: DataFrame, unit: str = "patient") -> DataFrame:
    """One row per patient: mean probability, label of the first slide, slide count, conflict flag.

    ``preds`` has slide, label, prob, an order column ``pos`` and maybe ``patient``. Only aggregates
    with map-side combine, so a patient with very many slides is no special case; the slides of a
    unit stay available in long form (``unit_members``).
    """
    keyed = _with_unit(preds, unit)
    return keyed.groupBy("unit").agg(
        F.avg("prob").alias("prob"),
        F.min_by("label", "pos").alias("label"),
        F.count("*").alias("n_slides"),
        (F.min("label") != F.max("label")).alias("label_conflict"),
    )


def unit_members(preds: DataFrame, unit: str = "patient") -> DataFrame:
    """(unit, pos, slide): which slides make up a unit, lossless for any number of slides."""
    return _with_unit(preds, unit).select("unit", "pos", "slide")


def joined_members(preds: DataFrame, unit: str = "patient") -> DataFrame:
    """``;``-joined names of all slides per unit for a report file, in order of ``pos``."""
    members = F.array_sort(F.collect_list(F.struct("pos", "slide")))
    return unit_members(preds, unit).groupBy("unit").agg(
        F.count("*").alias("n_slides"), F.array_join(F.transform(members, lambda s: s["slide"].cast("string")), ";").alias("slides")
    )


def _with_unit(preds: DataFrame, unit: str) -> DataFrame:
    if unit == "slide":
        return preds.withColumn("unit", F.col("slide"))
    return preds.withColumn("unit", F.col("patient") if "patient" in preds.columns else patient_or_stem(F.col("slide").cast("string")))


def score_table(
    df: DataFrame, by: list[str] = (), label: str = "label", score: str = "score",
    splits: list[float] | None = None, weight: str | None = None,
) -> DataFrame:
    """Per distinct score: pos, neg, cumulative tp, fp from the top, and totals total_tp, total_fp."""
    by = list(by)
    w = F.col(weight) if weight else F.lit(1)
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).cast("long").alias("neg"),
    )
    edges = splits if splits is not None else split_points(df, score)
    return running_totals(
        value_bucket(counts, score, edges), by, [F.col(score).desc()],
        {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True, with_total=True,
    ).withColumnRenamed(score, "score")


def ranking_metrics(table: DataFrame, by: list[str] = ()) -> DataFrame:
    """ROC AUC (ties count half) and average precision; NULL when a class is missing."""
    p, n = F.max("total_tp"), F.max("total_fp")
    twice_area = F.sum(F.col("neg") * (F.col("tp") * 2 - F.col("pos")))
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return table.groupBy(*by).agg(
        p.alias("n_pos"),
        n.alias("n_neg"),
        F.try_divide(twice_area.cast("double"), (p * n * 2).cast("double")).alias("auc"),
        F.when(n > 0, F.try_divide(steps, p.cast("double"))).alias("average_precision"),
    )


def auc(df: DataFrame, by: list[str] = (), label: str = "label", score: str = "score", splits: list[float] | None = None) -> DataFrame:
    return ranking_metrics(score_table(df, by, label, score, splits), by)


def roc_curve(df: DataFrame, by: list[str] = (), drop_collinear: bool = False, splits: list[float] | None = None) -> DataFrame:
    """(by, score, tpr, fpr, specificity) with one point per distinct score, plus the origin (score NULL).

    ``drop_collinear`` leaves out inner points whose next step repeats their own.
    """
    by = list(by)
    table = score_table(df, by, splits=splits)
    if drop_collinear:
        step = F.struct("pos", "neg")
        heads = table.groupBy(*by, BUCKET).agg(F.max_by(step, "score").alias("__head"))
        after = Window.partitionBy(*by).orderBy(F.col(BUCKET).desc())
        heads = heads.select(*by, BUCKET, F.lead("__head").over(after).alias("__next_head"))
        inside = Window.partitionBy(*by, BUCKET).orderBy(F.col("score").desc())
        table = (
            table.join(heads, [*by, BUCKET])
            .withColumn("__next", F.coalesce(F.lead(step).over(inside), F.col("__next_head")))
            .where(F.col("__next").isNull() | (F.col("__next") != step))
        )
    points = table.select(
        *by, "score",
        F.try_divide(F.col("tp").cast("double"), F.col("total_tp").cast("double")).alias("tpr"),
        F.try_divide(F.col("fp").cast("double"), F.col("total_fp").cast("double")).alias("fpr"),
    )
    origin = table.select(*by).distinct() if by else table.limit(1)
    origin = origin.select(*by, F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return points.unionByName(origin).withColumn("specificity", 1 - F.col("fpr"))


def threshold_from(table: DataFrame, by: list[str], target: float) -> DataFrame:
    """Operating point from a score table: the highest score whose sensitivity reaches the target.

    The counts at that score are the least tp and fp among the scores that qualify. With one class
    only, the threshold is 0.5.
    """
    reached = (F.col("tp") / F.col("total_tp")) >= target
    both = (F.max("total_tp") > 0) & (F.max("total_fp") > 0)
    return table.where((F.col("total_tp") > 0) | (F.col("total_fp") > 0)).withColumn(
        "__ok", F.when(F.col("total_tp") > 0, reached).otherwise(F.lit(False))
    ).groupBy(*by).agg(
        F.when(both, F.max(F.when(F.col("__ok"), F.col("score")))).otherwise(F.lit(0.5)).alias("threshold"),
        F.when(both, F.min(F.when(F.col("__ok"), F.col("tp")))).alias("tp"),
        F.when(both, F.min(F.when(F.col("__ok"), F.col("fp")))).alias("fp"),
        F.max("total_tp").alias("n_pos"),
        F.max("total_fp").alias("n_neg"),
    )


def operating_threshold(df: DataFrame, by: list[str] = (), target: float = 0.92, splits: list[float] | None = None) -> DataFrame:
    by = list(by)
    return threshold_from(score_table(df, by, splits=splits), by, target).select(*by, "threshold")


def confusion(df: DataFrame, threshold: float | Column | DataFrame = 0.5, by: list[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """tn, fp, fn, tp, accuracy, sensitivity, specificity, ppv, npv; NULL where undefined.

    ``threshold`` may be a number, or a small frame (by..., threshold) such as ``operating_threshold``
    returns.
    """
    by = list(by)
    if isinstance(threshold, DataFrame):
        df = copies_join(df, threshold, by) if by else df.withColumn("threshold", threshold.select("threshold").scalar())
        cut = F.col("threshold")
    else:
        cut = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit, pos = F.col(score) >= cut, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(~pos & ~hit).alias("tn"), F.count_if(~pos & hit).alias("fp"),
        F.count_if(pos & ~hit).alias("fn"), F.count_if(pos & hit).alias("tp"),
    )
    return counts.withColumns(_rates(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")))


def _rates(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return {
        "accuracy": share(tp + tn, tn + fp + fn + tp),
        "sensitivity": share(tp, tp + fn),
        "specificity": share(tn, tn + fp),
        "ppv": share(tp, tp + fp),
        "npv": share(tn, tn + fn),
    }


def resample_weights(units: DataFrame, key: str, n_repeats: int, seed: int = 0) -> DataFrame:
    """(rep, key columns..., w): how often each unit is drawn with replacement in each resample.

    A draw is a hash of (seed, resample, draw number), so it can be recomputed anywhere. Draws are
    counted before they meet the units.
    """
    numbered = _numbered(units, key)
    return _draws(numbered, units, n_repeats, seed).groupBy("rep", "__idx").agg(F.count("*").alias("w")).join(numbered, "__idx").drop("__idx")


def _numbered(units: DataFrame, key: str) -> DataFrame:
    """``units`` with their place ``__idx`` in the order of a hash of the key."""
    hashed = units.withColumn("__h", F.md5(F.col(key).cast("string")))
    return dense_positions(hashed, [], ["__h", key], hash_bucket(F.col("__h")), "__idx").drop("__h")


def _draws(numbered: DataFrame, units: DataFrame, n_repeats: int, seed: int) -> DataFrame:
    """(rep, __idx): as many draws of a place as there are units, in every resample."""
    size = units.agg(F.count("*").alias("__n")).scalar()
    return (
        numbered.select("__idx").repartition(4 * units.sparkSession.sparkContext.defaultParallelism, "__idx").select("__idx", size.alias("__n"))
        .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))
        .select("rep", uniform_int(seeded_key(seed, "rep", "__idx"), F.col("__n")).alias("__idx"))
    )


METRICS = ["auc", "average_precision", "threshold", "sensitivity", "specificity", "ppv", "npv"]


#: Distinct scores of one bucket, and numbers that a bucket draws at a time.
CELL_BUCKET, DRAWN_AT_ONCE = 4096, 1 << 22


class _Tree:
    """How many of ``n`` draws with replacement fall into each bucket of units, in every resample.

    Buckets are the leaves of a binary tree; a node hands its draws to its halves by one binomial draw per resample, from
    a generator seeded with the node alone. A bucket thus learns its own draws by walking down from the root, wherever it is computed.
    """

    def __init__(self, sizes: list[int], n_repeats: int, seed: int):
        self.before, self.n_repeats, self.seed = np.concatenate([[0], np.cumsum(sizes)]), n_repeats, seed

    def generator(self, low: int, high: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(key=(self.seed % (1 << 64)) << 64 | low << 32 | high))

    def draws(self, leaf: int) -> np.ndarray:
        low, high = 0, len(self.before) - 1
        drawn = np.full(self.n_repeats, self.before[-1], dtype=np.int64)
        while high - low > 1:
            middle = (low + high) // 2
            share = (self.before[middle] - self.before[low]) / (self.before[high] - self.before[low])
            first = self.generator(low, high).binomial(drawn, share)
            low, high, drawn = (low, middle, first) if leaf < middle else (middle, high, drawn - first)
        return drawn

    def counts(self, leaf: int, pos: np.ndarray, neg: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first resample, positives, negatives drawn per resample and score): multinomial counts of the bucket's draws."""
        held = np.concatenate([pos, neg])
        drawn, rng = self.draws(leaf), self.generator(leaf, leaf + 1)
        step = max(1, DRAWN_AT_ONCE // len(held))
        for k in range(0, self.n_repeats, step):
            some = rng.multinomial(drawn[k : k + step], held / held.sum())
            yield k, some[:, : len(pos)], some[:, len(pos) :]


def resample_metrics(units: DataFrame, n_repeats: int = 1000, seed: int = 0, target: float = 0.92) -> DataFrame:
    """Every metric per resample with replacement; resamples with a single class are left out.

    Units are counted per distinct score first, and scores dealt into buckets. A resample is one multinomial draw over those counts,
    taken bucket by bucket (``_Tree``) inside tasks, so its cost follows the distinct scores and no unit is ever
    repeated. A first pass gives positives and negatives per bucket and resample; their running totals go back to the buckets, which
    draw the same counts again and return their share of every metric.
    """
    live = units.where(F.col("label").isNotNull() & F.col("score").isNotNull())
    cells = cut_lineage(live.groupBy(F.col("score").cast("double").alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")))
    buckets = max(1, min(4096, -(-cells.count() // CELL_BUCKET)))
    dealt = value_bucket(cells, "score", split_points(cells, "score", buckets))
    sizes = [tuple(r) for r in dealt.groupBy(BUCKET).agg(F.sum(F.col("pos") + F.col("neg"))).orderBy(F.col(BUCKET).desc()).collect()]  # at most 4096
    tree, leaves = _Tree([n for _, n in sizes], n_repeats, seed), {b: i for i, (b, _) in enumerate(sizes)}

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.stack([p.sum(axis=1), n.sum(axis=1)]) for _, p, n in tree.counts(leaves[pdf[BUCKET].iat[0]], *_ordered(pdf))]
        both = np.concatenate(parts, axis=1)
        return pd.DataFrame({BUCKET: pdf[BUCKET].iat[0], "rep": np.arange(n_repeats), "pos": both[0], "neg": both[1]})

    first = dealt.groupBy(BUCKET).applyInPandas(totals, f"{BUCKET} int, rep long, pos long, neg long")
    above = Window.partitionBy("rep").orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("rep")
    offsets = first.select(
        BUCKET, "rep", F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("fp"),
        F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))

    def shares(pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        score, at, out = np.sort(pdf["score"].to_numpy())[::-1], at.sort_values("rep"), []
        for k, pos, neg in tree.counts(leaves[pdf[BUCKET].iat[0]], *_ordered(pdf)):
            tp0, fp0, p, n = (at[c].to_numpy()[k : k + len(pos), None] for c in ("tp", "fp", "p", "n"))
            tp, fp = tp0 + pos.cumsum(axis=1), fp0 + neg.cumsum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                precision = np.where(pos > 0, pos * tp / np.maximum(tp + fp, 1), 0.0).sum(axis=1)
                reached = (tp / p >= target) & (pos + neg > 0)
            some, here = reached.any(axis=1), reached.argmax(axis=1)
            row = np.arange(len(pos))
            out.append(pd.DataFrame({
                "rep": np.arange(k, k + len(pos)), "area": (neg * (2 * tp - pos)).sum(axis=1), "steps": precision,
                "threshold": np.where(some, score[here], np.nan), "tp": np.where(some, tp[row, here], -1), "fp": np.where(some, fp[row, here], -1), "p": p[:, 0], "n": n[:, 0]}))
        return pd.concat(out)

    second = dealt.groupBy(BUCKET).cogroup(offsets.groupBy(BUCKET)).applyInPandas(
        shares, "rep long, area long, steps double, threshold double, tp long, fp long, p long, n long")
    return _resampled(second.where("p > 0 AND n > 0"), F.col("tp") >= 0)


def drawn_metrics(units: DataFrame, key: str, n_repeats: int = 1000, seed: int = 0, target: float = 0.92) -> DataFrame:
    """``resample_metrics`` with draws that can be repeated anywhere: each is a hash of (seed, resample, draw number), as in ``resample_weights``.

    A row per draw meets its unit once and goes to its resample's bucket of scores once; all that follows works on those buckets.
    Draws meet units in a shuffled hash join by hint: the optimizer does not count what the explode adds and would broadcast the draws.
    """
    held = cut_lineage(units.select(key, "label", "score"))
    numbered = cut_lineage(_numbered(held, key))
    edges = split_points(held, "score", max(1, min(4096, -(-held.count() // CELL_BUCKET))))
    cells = value_bucket(numbered.where(F.col("label").isNotNull() & F.col("score").isNotNull()), "score", edges).select("__idx", "label", "score", BUCKET)
    met = _draws(numbered, held, n_repeats, seed).join(cells.hint("shuffle_hash"), "__idx").select("rep", BUCKET, "score", "label").repartition("rep", BUCKET)
    counts = met.groupBy("rep", BUCKET, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    table = running_totals(counts, ["rep"], [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True, with_total=True)
    live = table.where("total_tp > 0 AND total_fp > 0").withColumns({"p": F.col("total_tp"), "n": F.col("total_fp"), "threshold": F.col("score")}).withColumns({
        "area": F.col("neg") * (F.col("tp") * 2 - F.col("pos")), "steps": F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))})
    return _resampled(live, F.col("tp") / F.col("p") >= target)


def _resampled(shares: DataFrame, reached: Column) -> DataFrame:
    """(rep, METRICS) from rows that add up to a resample's area and steps; the operating point is the highest score that ``reached`` holds for."""
    p, n = F.max("p"), F.max("n")
    per = shares.groupBy("rep").agg(
        (F.sum("area").cast("double") / (p * n * 2)).alias("auc"), (F.sum("steps") / p).alias("average_precision"),
        F.max(F.when(reached, F.col("threshold"))).alias("threshold"),
        F.min(F.when(reached, F.col("tp"))).alias("__tp"), F.min(F.when(reached, F.col("fp"))).alias("__fp"), p.alias("__p"), n.alias("__n"),
    )
    tp, fp = F.col("__tp"), F.col("__fp")
    rates = _rates(F.col("__n") - fp, fp, F.col("__p") - tp, tp)
    return per.withColumns({k: rates[k] for k in METRICS if k in rates}).select("rep", *METRICS)


def _ordered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positives and negatives per score, highest score first."""
    pdf = pdf.sort_values("score", ascending=False)
    return pdf["pos"].to_numpy(), pdf["neg"].to_numpy()


def bootstrap_ci(
    units: DataFrame, n_repeats: int = 1000, seed: int = 0, target: float = 0.92, level: float = 0.95, key: str | None = None
) -> DataFrame:
    """(metric, n_valid, median, lower, upper) over the valid resamples.

    With a ``key`` of the units the draws are hashes (``drawn_metrics``), which others can repeat; without one they come from seeded
    generators (``resample_metrics``), whose cost follows the distinct scores. The last percentile runs over one number per resample, a
    fixed count chosen by the caller.
    """
    per = drawn_metrics(units, key, n_repeats, seed, target) if key else resample_metrics(units, n_repeats, seed, target)
    pairs = ", ".join(f"'{m}', {m}" for m in METRICS)
    tail = (1 - level) / 2
    return (
        per.selectExpr(f"stack({len(METRICS)}, {pairs}) AS (metric, value)")
        .where(F.col("value").isNotNull())
        .groupBy("metric")
        .agg(
            F.count("*").alias("n_valid"),
            F.percentile("value", F.lit(0.5)).alias("median"),
            F.percentile("value", F.lit(tail)).alias("lower"),
            F.percentile("value", F.lit(1 - tail)).alias("upper"),
        )
    )


def metrics_record(
    units: DataFrame, target: float = 0.92, n_repeats: int = 0, seed: int = 0, eval_mode: str = "out_of_fold", threshold: float | None = None
) -> DataFrame:
    """One nested row: sizes, ranking metrics, threshold, confusion, ROC point, and the bootstrap table as a map.

    Everything but the bootstrap is one aggregate over one score table. The operating point is the highest score that reaches the
    ``target`` sensitivity, or the given ``threshold``; with a single class and none given it is 0.5.
    """
    p, n, pos, neg, score = F.max("total_tp"), F.max("total_fp"), F.col("pos"), F.col("neg"), F.col("score")
    reached = F.col("tp") / F.nullif(F.col("total_tp"), F.lit(0)) >= target
    from_cut = lambda count, cut: F.coalesce(F.sum(F.when(score >= cut, count)), F.lit(0))
    whole = score_table(units).agg(
        p.alias("n_pos"), n.alias("n_neg"),
        F.try_divide(F.sum(neg * (F.col("tp") * 2 - pos)).cast("double"), (p * n * 2).cast("double")).alias("auc"),
        F.when(n > 0, F.try_divide(F.sum(pos * F.col("tp") / (F.col("tp") + F.col("fp"))), p.cast("double"))).alias("average_precision"),
        F.max(F.when(reached, score)).alias("__cut"), F.min(F.when(reached, F.col("tp"))).alias("__tp"), F.min(F.when(reached, F.col("fp"))).alias("__fp"),
        from_cut(pos, 0.5).alias("__tp_half"), from_cut(neg, 0.5).alias("__fp_half"),
        *([from_cut(pos, threshold).alias("__tp_given"), from_cut(neg, threshold).alias("__fp_given")] if threshold is not None else []),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    if threshold is not None:
        cut, tp, fp, mode = F.lit(float(threshold)), F.col("__tp_given"), F.col("__fp_given"), F.lit("given")
    else:
        cut, mode = F.when(both, F.col("__cut")).otherwise(0.5), F.lit("target_sensitivity")
        tp, fp = F.when(both, F.col("__tp")).otherwise(F.col("__tp_half")), F.when(both, F.col("__fp")).otherwise(F.col("__fp_half"))
    at = whole.withColumns({"value": cut, "mode": mode, "tp": tp, "fp": fp}).withColumns({"tn": F.col("n_neg") - F.col("fp"), "fn": F.col("n_pos") - F.col("tp")})
    half = _rates(F.col("n_neg") - F.col("__fp_half"), F.col("__fp_half"), F.col("n_pos") - F.col("__tp_half"), F.col("__tp_half"))["accuracy"]
    at = at.withColumns(_rates(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")) | {"accuracy_at_half": half})
    record = at.select(
        (F.col("n_pos") + F.col("n_neg")).alias("n_units"), "n_pos", "n_neg", F.lit(eval_mode).alias("eval_mode"),
        F.struct("auc", "average_precision").alias("ranking"),
        F.struct("mode", "value", F.lit(target).alias("target")).alias("threshold"),
        F.struct(
            F.struct("tn", "fp", "fn", "tp").alias("confusion_matrix"), "accuracy", "accuracy_at_half", "sensitivity", "specificity", "ppv", "npv",
        ).alias("report"),
        F.struct((1 - F.col("specificity")).alias("fpr"), F.col("sensitivity").alias("tpr")).alias("roc_point"),
    )
    if n_repeats:
        boot = bootstrap_ci(units, n_repeats, seed, target).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct("median", "lower", "upper"))))).alias("bootstrap")
        )
        record = record.withColumn("bootstrap", boot.scalar())
    return record
