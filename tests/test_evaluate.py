"""ROC, thresholds, bootstrap and folds against brute force."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as hs
from pyspark.sql import functions as F

from slidegrid.operators import evaluate as ev, folds as fd
from slidegrid.plans import workflows
from slidegrid.queries import REGISTRY


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return float(np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])))


def brute_ap(y, s):
    total, out, last = (y == 1).sum(), 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        r, p = (y[hit] == 1).sum() / total, (y[hit] == 1).mean()
        out, last = out + (r - last) * p, r
    return out


def brute_threshold(y, s, target):
    for t in sorted(set(s), reverse=True):
        if (s[y == 1] >= t).mean() >= target:
            return t


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.tuples(hs.integers(0, 1), hs.integers(0, 9)), min_size=6, max_size=60))
def test_ranking_against_brute_force(spark, rows):
    rows = rows + [(0, 3), (1, 4)]
    y, s = np.array([r[0] for r in rows]), np.array([r[1] / 10 for r in rows])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    splits = [0.25, 0.45, 0.7]
    got = ev.auc(df, splits=splits).first()
    assert got["auc"] == pytest.approx(brute_auc(y, s)) and got["average_precision"] == pytest.approx(brute_ap(y, s))
    assert ev.operating_threshold(df, splits=splits).first()["threshold"] == pytest.approx(brute_threshold(y, s, 0.92))


def test_single_class_and_ties(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, score double")
    assert ev.operating_threshold(one).first()["threshold"] == 0.5
    assert ev.auc(one).first()["auc"] is None
    tied = spark.createDataFrame([(i % 2, 0.5) for i in range(10)], "label int, score double")
    assert ev.auc(tied).first()["auc"] == 0.5
    assert ev.confusion(one, 0.5).first()["specificity"] is None


def test_roc_corner_points(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    full = ev.roc_curve(df, splits=[0.3, 0.6]).toPandas().sort_values(["fpr", "tpr"])
    few = ev.roc_curve(df, splits=[0.3, 0.6], drop_collinear=True).toPandas().sort_values(["fpr", "tpr"])
    area = lambda t: float(np.trapezoid(t["tpr"], t["fpr"]))
    assert len(few) <= len(full) and area(full) == pytest.approx(area(few)) == pytest.approx(brute_auc(y, s))


def test_units_take_first_label_and_flag_conflicts(spark):
    preds = spark.createDataFrame(
        [("TCGA-AA-0001-01Z", 1, 0.2, 0), ("TCGA-AA-0001-11A", 0, 0.6, 1), ("other.svs", 0, 0.1, 2)], "slide string, label int, prob double, pos int"
    )
    got = {r["unit"]: (r["label"], round(r["prob"], 6), r["n_slides"], r["label_conflict"]) for r in ev.aggregate_units(preds).collect()}
    assert got == {"TCGA-AA-0001": (1, 0.4, 2, True), "other": (0, 0.1, 1, False)}
    many = spark.range(1500).selectExpr("concat('TCGA-AA-0001-', id) AS slide", "1 AS label", "0.5D AS prob", "CAST(id AS INT) AS pos")
    assert ev.joined_members(many).first()["slides"] == ";".join(f"TCGA-AA-0001-{i}" for i in range(1500))
    assert {r["slides"] for r in ev.joined_members(preds).collect()} == {"TCGA-AA-0001-01Z;TCGA-AA-0001-11A", "other.svs"}


def test_draw_lists(spark):
    units = spark.createDataFrame([(f"u{i}",) for i in range(60)], "unit string")
    w = ev.resample_weights(units, "unit", 30, 3).toPandas()
    assert (w.groupby("rep")["w"].sum() == 60).all()


def test_tree_draws_are_multinomial():
    """Every resample draws n units; means, variances and covariances of the counts are those of drawing with replacement."""
    rng = np.random.default_rng(1)
    cells = [(rng.integers(0, 6, 5), rng.integers(0, 9, 5)) for _ in range(7)]
    sizes = [int(p.sum() + n.sum()) for p, n in cells]
    reps, total = 20_000, sum(sizes)
    tree = ev._Tree(sizes, reps, 5)
    drawn = np.concatenate([np.concatenate([np.concatenate([p, n], axis=1) for _, p, n in tree.counts(i, *cells[i])]) for i in range(7)], axis=1)
    held = np.concatenate([np.concatenate(c) for c in cells])
    assert drawn.shape == (reps, 70) and (drawn.sum(axis=1) == total).all()
    share = held / total
    assert np.abs(drawn.mean(axis=0) - held).max() < 5 * np.sqrt(held.max() / reps)
    want = total * (np.diag(share) - np.outer(share, share))
    assert np.abs(np.cov(drawn.T) - want).max() < 0.05 * held.max()
    again = np.concatenate([np.concatenate([p, n], axis=1) for _, p, n in ev._Tree(sizes, reps, 5).counts(3, *cells[3])])
    assert (again == drawn[:, 30:40]).all() and (drawn != ev._Tree(sizes, reps, 6).counts(0, *cells[0]).__next__()[1].sum()).any()


@pytest.mark.parametrize("bucket", [4096, 6])
def test_resample_metrics_equal_brute_force(spark, monkeypatch, bucket):
    """Metrics of every resample against its counts written out, in one bucket and in many."""
    monkeypatch.setattr(ev, "CELL_BUCKET", bucket)
    monkeypatch.setattr(ev, "DRAWN_AT_ONCE", 300)
    rng = np.random.default_rng(2)
    y = np.r_[np.ones(15), np.zeros(45)].astype(int)
    s = np.round(rng.normal(y * 1.0, 1.0), 1)
    units = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    drawn: dict = {}
    splits = [] if bucket > 6 else [-1.0, -0.4, 0.1, 0.2, 1.1]
    monkeypatch.setattr(ev, "split_points", lambda df, col, n: splits)
    per = ev.resample_metrics(units, 30, 3).toPandas().set_index("rep")
    cells = pd.DataFrame({"score": s, "y": y}).groupby("score")["y"].agg(pos="sum", n="size").reset_index()
    cells["neg"] = cells["n"] - cells["pos"]
    cells["b"] = np.searchsorted(splits, cells["score"], side="right")
    groups = [g.sort_values("score", ascending=False) for _, g in sorted(cells.groupby("b"), key=lambda x: -x[0])]
    tree = ev._Tree([int(g["n"].sum()) for g in groups], 30, 3)
    for leaf, g in enumerate(groups):
        for k, p, n in tree.counts(leaf, g["pos"].to_numpy(), g["neg"].to_numpy()):
            for r in range(len(p)):
                for j, score in enumerate(g["score"]):
                    drawn.setdefault(k + r, []).extend([(1, score)] * int(p[r, j]) + [(0, score)] * int(n[r, j]))
    assert len(groups) > 3 or bucket > 6
    for rep, rows in drawn.items():
        yy, ss = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        assert len(rows) == 60 and per.loc[rep, "auc"] == pytest.approx(brute_auc(yy, ss)) and per.loc[rep, "average_precision"] == pytest.approx(brute_ap(yy, ss))
        t = brute_threshold(yy, ss, 0.92)
        assert per.loc[rep, "threshold"] == t and per.loc[rep, "specificity"] == pytest.approx((ss[yy == 0] < t).mean())
        assert per.loc[rep, "sensitivity"] == pytest.approx((ss[yy == 1] >= t).mean())


def test_intervals_like_plain_resampling(spark):
    rng = np.random.default_rng(4)
    y = np.r_[np.ones(40), np.zeros(80)].astype(int)
    s = np.round(rng.normal(y * 1.0, 1.0), 2)
    units = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    ci = {r["metric"]: r for r in ev.bootstrap_ci(units, 2000, 3).collect()}
    plain = [brute_auc(y[i], s[i]) for i in rng.integers(0, 120, (2000, 120))]
    for name, q in (("lower", 2.5), ("median", 50), ("upper", 97.5)):
        assert ci["auc"][name] == pytest.approx(np.percentile(plain, q), abs=0.012)
    one = spark.createDataFrame([(1, 0.5)] * 5, "label int, score double")
    assert ev.bootstrap_ci(one, 20).count() == 0  # a single class has no valid resample
    assert ev.bootstrap_ci(one.where("label = 0"), 20).count() == 0


def test_record_modes(spark):
    units = spark.createDataFrame([(1, 0.9), (1, 0.6), (0, 0.7), (0, 0.2), (0, 0.1)], "label int, score double")
    record = ev.metrics_record(units, n_repeats=10).first()
    assert record["threshold"]["value"] == 0.6 and record["report"]["confusion_matrix"].asDict() == {"tn": 2, "fp": 1, "fn": 0, "tp": 2}
    assert record["roc_point"]["fpr"] == pytest.approx(1 / 3) and record["roc_point"]["tpr"] == 1.0 and record["report"]["accuracy_at_half"] == 0.8 and record["bootstrap"]
    given = ev.metrics_record(units, threshold=0.8, eval_mode="ensemble").first()
    assert given["threshold"]["mode"] == "given" and given["eval_mode"] == "ensemble" and given["report"]["confusion_matrix"].asDict() == {"tn": 3, "fp": 0, "fn": 1, "tp": 1}
    single = ev.metrics_record(units.where("label = 1")).first()
    assert single["threshold"]["value"] == 0.5 and single["report"]["confusion_matrix"]["tp"] == 2 and single["ranking"]["auc"] is None
    preds = spark.createDataFrame([("a", 0, 0, 0.9), ("a", 0, 1, 0.7), ("b", 0, 0, 0.2), ("b", 0, 1, 0.4)], "slide string, repeat int, fold int, prob double")
    folds = spark.createDataFrame([("a", 0, 0), ("b", 0, 1)], "slide string, repeat int, fold int")
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "slide string, label int")
    for mode, threshold in (("out_of_fold", 0.9), ("ensemble", 0.8)):
        got = workflows.score_report(preds, folds, labels, eval_mode=mode).first()
        assert got["eval_mode"] == mode and got["threshold"]["value"] == pytest.approx(threshold)


def slides(spark, sizes):
    rows = [(f"{p}_{i}", p, label) for p, (n, label) in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "slide string, patient string, label int")


def test_fold_guarantees(spark):
    rng = np.random.default_rng(0)
    df = slides(spark, {f"p{i}": (int(rng.integers(1, 4)), int(i % 4 == 0)) for i in range(60)})
    folds = fd.make_folds(df, 5, 3)
    pdf = folds.toPandas()
    assert len(pdf) == 180 and (pdf.groupby(["repeat", "unit"]).size() == 1).all()
    per = pdf.groupby(["repeat", "label", "fold"]).size().unstack()
    assert (per.max(axis=1) - per.min(axis=1) <= 1).all()
    by_unit = pdf.pivot(index="unit", columns="repeat", values="fold")
    assert (by_unit[0] != by_unit[1]).any()
    held = fd.slide_folds(df, folds).toPandas()
    assert (held.groupby(["repeat", "slide"]).size() == 1).all()
    sides = fd.train_val(fd.slide_folds(df, folds), 5).toPandas()
    assert (sides.groupby(["repeat", "slide"])["is_val"].sum() == 1).all()


def test_fold_errors(spark):
    with pytest.raises(ValueError, match="one class"):
        fd.make_folds(slides(spark, {"a": (2, 1), "b": (1, 1)}))
    with pytest.raises(ValueError, match="cannot cross-validate"):
        fd.make_folds(slides(spark, {"a": (5, 1), "b": (1, 0), "c": (1, 0)}))
    capped = fd.make_folds(slides(spark, {"a": (1, 1), "b": (1, 1), "c": (1, 0), "d": (1, 0), "e": (1, 0)}), 5)
    assert {r["fold"] for r in capped.collect()} == {0, 1}


def test_out_of_fold(spark):
    preds = spark.createDataFrame(
        [("s1", 0, 0, 0.2), ("s1", 0, 1, 0.9), ("s1", 1, 0, 0.9), ("s1", 1, 1, 0.4), ("s2", 0, 1, 0.7)], "slide string, repeat int, fold int, prob double"
    )
    held = spark.createDataFrame([("s1", 0, 0), ("s1", 1, 1), ("s3", 0, 2)], "slide string, repeat int, fold int")
    assert [(r["slide"], round(r["prob"], 6)) for r in ev.out_of_fold(preds, held).collect()] == [("s1", 0.3)]
    problems = {(r["problem"], r["slide"]) for r in ev.out_of_fold_guards(preds, held).collect()}
    assert ("unseen slide", "s2") in problems and ("missing model", None) in problems


def test_no_table_of_slides_is_broadcast(spark):
    """Both sides of the out-of-fold join look small to the optimizer, which does not count what an explode adds."""
    slides = spark.range(40).select(F.col("id").alias("slide"))
    preds = slides.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("prob", F.col("fold") / 10.0)
    held = slides.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("fold", (F.col("slide") % 3).cast("int"))
    for found in (ev.out_of_fold(preds, held), ev.out_of_fold_guards(preds, held)):
        found.collect()
        text = found._jdf.queryExecution().executedPlan().toString()
        sides = [line for line in text.splitlines() if "BroadcastHashJoin" in line and "slide" in line]
        assert not sides and "SortMergeJoin" in text
    got = {r.slide: (r.prob, r.n_repeats) for r in ev.out_of_fold(preds, held).collect()}
    assert got == {i: (i % 3 / 10.0, 2) for i in range(40)}


@pytest.mark.parametrize("bucket", [3, 4096])
def test_hashed_resamples_equal_brute_force(spark, monkeypatch, bucket):
    """Every metric of every resample from draws repeated in plain Python, and the interval query gives intervals."""
    monkeypatch.setattr(ev, "CELL_BUCKET", bucket)
    rows = [(i, i % 3 % 2, round((i * 37 % 11) / 11, 3)) for i in range(23)]
    per = ev.drawn_metrics(spark.createDataFrame(rows, "unit long, label int, score double"), "unit", 25, 5).toPandas().set_index("rep")
    place = sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
    seen = 0
    for rep in range(25):
        drawn = [place[int(hashlib.md5(f"5:{rep}:{i}".encode()).hexdigest()[:15], 16) % 23] for i in range(23)]
        pos, neg = [s for _, y, s in drawn if y == 1], [s for _, y, s in drawn if y == 0]
        if not pos or not neg:
            assert rep not in per.index
            continue
        seen += 1
        auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
        cut = max(c for c in {*pos, *neg} if sum(a >= c for a in pos) / len(pos) >= 0.92)
        assert per.loc[rep, "auc"] == pytest.approx(auc) and per.loc[rep, "threshold"] == cut
        assert per.loc[rep, "specificity"] == pytest.approx(sum(b < cut for b in neg) / len(neg))
    assert seen == len(per)
    assert {"median", "lower", "upper"} <= set(REGISTRY["bootstrap_intervals"].run(spark, "/root/testdata/sf0.001").columns)


def test_draws_are_never_broadcast(spark):
    """A row per draw looks as small as a row per unit to the optimizer, which does not count what the explode adds."""
    units = spark.range(60).select(F.col("id").alias("unit"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") * 37 % 53 / 53.0).alias("score"))
    per = ev.drawn_metrics(units, "unit", 40, 5)
    per.collect()
    text = per._jdf.queryExecution().executedPlan().toString()
    met = [line for line in text.splitlines() if "Join" in line and "__idx" in line]
    assert met and all("ShuffledHashJoin" in line for line in met)
