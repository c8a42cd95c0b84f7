"""Evaluation of scores: events are per-model predictions, users are patients."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidegrid.operators import evaluate, folds as fd
from slidegrid.queries.registry import SCORED_CTE, query, rounded, scored
from slidegrid.session import table

# Per-model predictions: slide = event // 10, model from the event number.
_PREDS = f"""{SCORED_CTE}, preds AS (SELECT event_id // 10 AS slide, CAST(event_id % 10 // 5 AS INTEGER) AS repeat, CAST(event_id % 5 AS INTEGER) AS fold, score AS prob FROM scored)"""


def predictions(spark, d):
    k = F.col("event_id")
    return scored(spark, d).select(
        F.floor(k / 10).alias("slide"), F.floor(k % 10 / 5).cast("int").alias("repeat"), (k % 5).cast("int").alias("fold"), F.col("score").alias("prob")
    )


@query("ensemble_mean", "AG17", f"WITH {_PREDS} SELECT slide, round(avg(prob), 6) AS prob, count(*) AS n_models FROM preds GROUP BY slide")
def ensemble_mean(spark, d):
    return rounded(evaluate.ensemble_mean(predictions(spark, d)), "prob")


# Units: patients over users; slides are events, the first event's class is the patient's.
_UNITS = f"""{SCORED_CTE}, units AS (SELECT user_id AS unit, avg(score) AS prob, arg_min(label, event_id) AS label, count(*) AS n_slides, min(label) <> max(label) AS label_conflict FROM scored GROUP BY 1)"""


def units(spark, d):
    preds = scored(spark, d).select(
        F.col("user_id").alias("patient"), F.col("event_id").alias("slide"), F.col("event_id").alias("pos"), "label", F.col("score").alias("prob")
    )
    return evaluate.aggregate_units(preds)


@query("patient_aggregation", "AG16", f"WITH {_UNITS} SELECT unit, round(prob, 6) AS prob, label, n_slides, label_conflict FROM units")
def patient_aggregation(spark, d):
    return rounded(units(spark, d), "prob")


@query("patient_members", "AG16", f"WITH {SCORED_CTE} SELECT user_id AS unit, count(*) AS n_slides, string_agg(CAST(event_id AS VARCHAR), ';' ORDER BY event_id) AS slides FROM scored GROUP BY user_id")
def patient_members(spark, d):
    preds = scored(spark, d).select(
        F.col("user_id").alias("patient"), F.col("event_id").alias("slide"), F.col("event_id").alias("pos"), "label", F.col("score").alias("prob")
    )
    return evaluate.joined_members(preds)


# Folds by hash, patients = customers, slides = orders.
_FOLD_CTES = """lab AS (SELECT o_orderkey AS slide, o_custkey AS patient, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders),
un AS (SELECT patient AS unit, arg_min(label, slide) AS label, count(*) AS n_slides FROM lab GROUP BY 1),
rk AS (SELECT repeat, unit, label, n_slides, row_number() OVER (PARTITION BY repeat, label ORDER BY n_slides DESC, md5(repeat || ':' || unit), unit) - 1 AS r FROM un, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS repeat)),
folds AS (SELECT repeat, unit, label, n_slides, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INTEGER) AS fold FROM rk)"""


def fold_labels(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("slide"), F.col("o_custkey").alias("patient"), (F.col("o_orderstatus") == "F").cast("int").alias("label")
    )


@query("patient_folds", "TG5", f"WITH {_FOLD_CTES} SELECT repeat, unit, label, n_slides, fold FROM folds")
def patient_folds(spark, d):
    return fd.make_folds(fold_labels(spark, d), 5, 3)


@query("fold_sides", "TG6 TG7", f"""WITH {_FOLD_CTES}, s AS (SELECT repeat, fold AS own, slide FROM lab JOIN folds ON unit = patient WHERE repeat = 0)
SELECT CAST(k AS INTEGER) AS fold, own = k AS is_val, count(*) AS n, CAST(repeat * 100000 + k * 1000 + 7 AS INTEGER) AS seed FROM s, (SELECT unnest(range(0, 5)) AS k) GROUP BY 1, 2, 4""")
def fold_sides(spark, d):
    given = fold_labels(spark, d)
    held = fd.slide_folds(given, fd.make_folds(given, 5, 1))
    sides = fd.train_val(held, 5)
    return sides.groupBy("fold", "is_val", fd.model_seed(F.col("repeat"), F.col("fold")).alias("seed")).agg(F.count("*").alias("n"))


# Out-of-fold pairing: every slide is scored by every (repeat, fold) model; keep its own fold's.
_OOF = f"""{_FOLD_CTES}, p AS (SELECT slide, lab.patient, lab.label, repeat, k AS fold, round((slide * 7919 + repeat * 104729 + k * 1299709) % 1000 / 1000.0 * 0.7 + label * 0.25, 4) AS prob
 FROM lab, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS repeat), (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS k)),
h AS (SELECT p.slide, p.repeat, prob FROM p JOIN folds f ON f.unit = p.patient AND f.repeat = p.repeat AND f.fold = p.fold),
oof AS (SELECT slide, avg(prob) AS prob, count(*) AS n_repeats FROM (SELECT slide, repeat, avg(prob) AS prob FROM h GROUP BY 1, 2) GROUP BY slide)"""


def all_model_scores(spark, d):
    r, k = F.col("repeat"), F.col("fold")
    prob = F.round((F.col("slide") * 7919 + r * 104729 + k * 1299709) % 1000 / 1000.0 * 0.7 + F.col("label") * 0.25, 4)
    return (
        fold_labels(spark, d)
        .withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(2))))
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
        .select("slide", "repeat", "fold", prob.alias("prob"))
    )


def _out_of_fold(spark, d):
    given = fold_labels(spark, d)
    held = fd.slide_folds(given, fd.make_folds(given, 5, 3))
    return all_model_scores(spark, d), held


@query("out_of_fold_scores", "AG18 JN13", f"WITH {_OOF} SELECT slide, round(prob, 6) AS prob, n_repeats FROM oof")
def out_of_fold_scores(spark, d):
    return rounded(evaluate.out_of_fold(*_out_of_fold(spark, d)), "prob")


@query("out_of_fold_guards", "AG18 SO3", f"""WITH {_FOLD_CTES}, p AS (SELECT slide, repeat, k AS fold FROM lab, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS repeat), (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS k) WHERE NOT (repeat = 1 AND k = 3) AND slide % 100 <> 99
 UNION ALL SELECT -c_custkey, 0, 0 FROM customer WHERE c_custkey BETWEEN 1 AND 3), h AS (SELECT slide, folds.repeat, fold FROM lab JOIN folds ON unit = patient)
SELECT 'unseen slide' AS problem, CAST(slide AS VARCHAR) AS slide, CAST(NULL AS INTEGER) AS repeat, CAST(NULL AS INTEGER) AS fold FROM (SELECT DISTINCT slide FROM p WHERE slide NOT IN (SELECT slide FROM h))
UNION ALL SELECT 'missing model', NULL, repeat, fold FROM (SELECT DISTINCT repeat, fold FROM h EXCEPT SELECT repeat, fold FROM p)
UNION ALL SELECT 'never held out', CAST(slide AS VARCHAR), NULL, NULL FROM (SELECT DISTINCT slide FROM p WHERE slide IN (SELECT slide FROM h) AND slide NOT IN (SELECT p.slide FROM p JOIN h ON p.slide = h.slide AND p.repeat = h.repeat AND p.fold = h.fold))""")
def out_of_fold_guards(spark, d):
    preds, held = _out_of_fold(spark, d)
    extra = table(spark, d, "customer").where("c_custkey BETWEEN 1 AND 3").select(
        (-F.col("c_custkey")).alias("slide"), F.lit(0).alias("repeat"), F.lit(0).alias("fold"), F.lit(0.5).alias("prob")
    )
    some = preds.where("NOT (repeat = 1 AND fold = 3) AND slide % 100 <> 99").unionByName(extra)
    return evaluate.out_of_fold_guards(some, held)


_AUC_CTES = """t AS (SELECT g, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM src GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY g) AS p, sum(neg) OVER (PARTITION BY g) AS n FROM t WINDOW w AS (PARTITION BY g ORDER BY score DESC))"""
_AUC = "sum(neg * (2 * tp - pos)) / nullif(CAST(2 * max(p) * max(n) AS DOUBLE), 0)"
_AP = "CASE WHEN max(n) > 0 THEN sum(pos * tp / CAST(tp + fp AS DOUBLE)) / nullif(max(p), 0) END"


@query("ranking_metrics", "AG20 AG21", f"""WITH {SCORED_CTE}, src AS (SELECT 0 AS g, * FROM scored), {_AUC_CTES}
SELECT CAST(max(p) AS BIGINT) AS n_pos, CAST(max(n) AS BIGINT) AS n_neg, round({_AUC}, 6) AS auc, round({_AP}, 6) AS average_precision FROM c""")
def ranking_metrics(spark, d):
    return rounded(evaluate.auc(scored(spark, d)), "auc", "average_precision")


@query("model_auc", "AG22", f"""WITH {SCORED_CTE}, src AS (SELECT CASE WHEN event_type = 'error' THEN 0 ELSE label END AS label, score, user_id % 25 AS repeat, event_id % 5 AS fold, (user_id % 25) * 10 + event_id % 5 AS g FROM scored WHERE NOT (user_id % 25 = 3 AND label = 1)), {_AUC_CTES}
SELECT CAST(g // 10 AS INTEGER) AS repeat, CAST(g % 10 AS INTEGER) AS fold, CAST(max(p) AS BIGINT) AS n_pos, CAST(max(n) AS BIGINT) AS n_neg, round({_AUC}, 6) AS val_auc FROM c GROUP BY g""")
def model_auc(spark, d):
    s = scored(spark, d).where("NOT (user_id % 25 = 3 AND label = 1)").withColumns(
        {"repeat": (F.col("user_id") % 25).cast("int"), "fold": (F.col("event_id") % 5).cast("int")}
    )
    out = evaluate.auc(s, ["repeat", "fold"]).select("repeat", "fold", "n_pos", "n_neg", F.col("auc").alias("val_auc"))
    return rounded(out, "val_auc")


@query("roc_points", "WN12", f"""WITH {SCORED_CTE}, src AS (SELECT 0 AS g, * FROM scored), {_AUC_CTES}
SELECT score, round(tp / CAST(p AS DOUBLE), 6) AS tpr, round(fp / CAST(n AS DOUBLE), 6) AS fpr, round(1 - fp / CAST(n AS DOUBLE), 6) AS specificity FROM c UNION ALL SELECT NULL, 0, 0, 1""")
def roc_points(spark, d):
    return rounded(evaluate.roc_curve(scored(spark, d)), "tpr", "fpr", "specificity")


@query("roc_corners", "WN12", f"""WITH {SCORED_CTE}, src AS (SELECT user_id % 4 AS g, * FROM scored), {_AUC_CTES}, k AS (SELECT *, lead(pos) OVER (PARTITION BY g ORDER BY score DESC) AS np, lead(neg) OVER (PARTITION BY g ORDER BY score DESC) AS nn FROM c)
SELECT g, score, round(tp / CAST(p AS DOUBLE), 6) AS tpr, round(fp / CAST(n AS DOUBLE), 6) AS fpr, round(1 - fp / CAST(n AS DOUBLE), 6) AS specificity FROM k WHERE np IS NULL OR np <> pos OR nn <> neg
UNION ALL SELECT DISTINCT g, NULL, 0, 0, 1 FROM src""")
def roc_corners(spark, d):
    s = scored(spark, d).withColumn("g", F.col("user_id") % 4)
    return rounded(evaluate.roc_curve(s, ["g"], drop_collinear=True), "tpr", "fpr", "specificity")


_THR = "max(score) FILTER (tp / CAST(p AS DOUBLE) >= 0.92)"


@query("operating_threshold", "WN13", f"""WITH {SCORED_CTE}, src AS (SELECT user_id % 10 AS g, * FROM scored WHERE NOT (user_id % 10 = 7 AND label = 1)), {_AUC_CTES}
SELECT g, CASE WHEN max(p) > 0 AND max(n) > 0 THEN {_THR} ELSE 0.5 END AS threshold FROM c GROUP BY g""")
def operating_threshold(spark, d):
    s = scored(spark, d).where("NOT (user_id % 10 = 7 AND label = 1)").withColumn("g", F.col("user_id") % 10)
    return evaluate.operating_threshold(s, ["g"])


@query("confusion_matrix", "AG19 PR20", f"""WITH {SCORED_CTE}, src AS (SELECT user_id % 10 AS g, * FROM scored), {_AUC_CTES}, h AS (SELECT g, {_THR} AS thr FROM c GROUP BY g),
m AS (SELECT s.g, count(*) FILTER (label = 0 AND score < thr) AS tn, count(*) FILTER (label = 0 AND score >= thr) AS fp, count(*) FILTER (label = 1 AND score < thr) AS fn, count(*) FILTER (label = 1 AND score >= thr) AS tp FROM src s JOIN h ON s.g = h.g GROUP BY s.g)
SELECT g, tn, fp, fn, tp, round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS sensitivity, round(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 6) AS specificity,
 round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS ppv, round(tn / nullif(CAST(tn + fn AS DOUBLE), 0), 6) AS npv FROM m""")
def confusion_matrix(spark, d):
    s = scored(spark, d).withColumn("g", F.col("user_id") % 10)
    out = evaluate.confusion(s, evaluate.operating_threshold(s, ["g"]), ["g"])
    return rounded(out, "accuracy", "sensitivity", "specificity", "ppv", "npv")


@query("patient_report", "AG16 AG19 AG20 AG21 WN13 SNK7", f"""WITH {_UNITS}, src AS (SELECT 0 AS g, unit, CAST(n_slides % 3 = 0 AS INTEGER) AS label, round(prob, 6) AS score FROM units), {_AUC_CTES},
h AS (SELECT {_THR} AS thr, max(p) AS p, max(n) AS n, {_AUC} AS auc, {_AP} AS ap FROM c)
SELECT CAST(max(p) AS BIGINT) AS n_pos, CAST(max(n) AS BIGINT) AS n_neg, round(max(auc), 6) AS auc, round(max(ap), 6) AS average_precision, max(thr) AS threshold, count(*) FILTER (label = 0 AND score < thr) AS tn, count(*) FILTER (label = 0 AND score >= thr) AS fp,
 count(*) FILTER (label = 1 AND score < thr) AS fn, count(*) FILTER (label = 1 AND score >= thr) AS tp, round(count(*) FILTER (label = CAST(score >= 0.5 AS INTEGER)) / CAST(count(*) AS DOUBLE), 6) AS accuracy_at_half FROM src, h""")
def patient_report(spark, d):
    """Patient-level report; the class of a patient is drawn from its slide count so that both occur."""
    u = units(spark, d).select("unit", (F.col("n_slides") % 3 == 0).cast("int").alias("label"), F.round("prob", 6).alias("score"))
    record = evaluate.metrics_record(u)
    flat = record.select(
        "n_pos", "n_neg", "ranking.auc", "ranking.average_precision", F.col("threshold.value").alias("threshold"),
        "report.confusion_matrix.*", "report.accuracy_at_half",
    )
    return rounded(flat, "auc", "average_precision", "accuracy_at_half")


_BOOT = f"""{_UNITS}, u AS (SELECT unit, CAST(n_slides % 3 = 0 AS INTEGER) AS label, round(prob, 6) AS score, row_number() OVER (ORDER BY md5(CAST(unit AS VARCHAR)), unit) - 1 AS idx FROM units),
reps AS (SELECT unnest(range(0, {{n}})) AS rep), dr AS (SELECT rep, CAST(('0x' || substr(md5('11:' || rep || ':' || idx), 1, 15)) AS BIGINT) % (SELECT count(*) FROM u) AS idx FROM u, reps),
wt AS (SELECT rep, idx, count(*) AS w FROM dr GROUP BY 1, 2)"""


@query("resample_weights", "SL6", f"WITH {_BOOT.format(n=20)} SELECT rep, unit, w FROM wt JOIN u USING (idx)")
def resample_weights(spark, d):
    return evaluate.resample_weights(units(spark, d).select("unit"), "unit", 20, 11).select(F.col("rep").cast("long").alias("rep"), "unit", "w")


@query("bootstrap_intervals", "AG23 SL6", f"""WITH {_BOOT.format(n=1000)}, t AS (SELECT rep AS g, score, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN w ELSE 0 END) AS neg FROM wt JOIN u USING (idx) GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY g) AS p, sum(neg) OVER (PARTITION BY g) AS n FROM t WINDOW w AS (PARTITION BY g ORDER BY score DESC)),
m AS (SELECT g, {_AUC} AS auc, {_AP} AS average_precision, {_THR} AS threshold, min(tp) FILTER (tp / CAST(p AS DOUBLE) >= 0.92) AS tp0, min(fp) FILTER (tp / CAST(p AS DOUBLE) >= 0.92) AS fp0, max(p) AS p, max(n) AS n FROM c GROUP BY g HAVING max(p) > 0 AND max(n) > 0),
l AS (SELECT 'auc' AS metric, auc AS v FROM m UNION ALL SELECT 'average_precision', average_precision FROM m UNION ALL SELECT 'threshold', threshold FROM m UNION ALL SELECT 'sensitivity', tp0 / CAST(p AS DOUBLE) FROM m
 UNION ALL SELECT 'specificity', (n - fp0) / CAST(n AS DOUBLE) FROM m UNION ALL SELECT 'ppv', tp0 / nullif(CAST(tp0 + fp0 AS DOUBLE), 0) FROM m UNION ALL SELECT 'npv', (n - fp0) / nullif(CAST(n - fp0 + p - tp0 AS DOUBLE), 0) FROM m)
SELECT metric, count(*) AS n_valid, round(quantile_cont(v, 0.5), 5) AS median, round(quantile_cont(v, 0.025), 5) AS lower, round(quantile_cont(v, 0.975), 5) AS upper FROM l WHERE v IS NOT NULL GROUP BY metric""")
def bootstrap_intervals(spark, d):
    """Median and 95 % interval of every metric over 1,000 resamples of the units."""
    u = units(spark, d).select("unit", (F.col("n_slides") % 3 == 0).cast("int").alias("label"), F.round("prob", 6).alias("score"))
    out = evaluate.bootstrap_ci(u, 1000, 11, key="unit")
    return out.select("metric", "n_valid", *[F.round(c, 5).alias(c) for c in ("median", "lower", "upper")])
