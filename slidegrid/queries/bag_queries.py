"""Bags of embeddings: extremes, models, codebooks, attention, tile kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from slidegrid.operators import attention, bags, codebook as cb, folds as fd, tiles
from slidegrid.plans import workflows
from slidegrid.queries.registry import query, r6, rounded
from slidegrid.session import table

BAG_COUNT = 20


def bag_rows(spark, d):
    """Bags over embeddings: the bag is vec_id modulo 20, the tile number vec_id."""
    return table(spark, d, "embeddings").select(
        (F.col("vec_id") % BAG_COUNT).alias("slide"), F.col("vec_id").alias("tile_idx"), F.col("embedding").alias("emb"), "label"
    )


def bag_labels(spark, d):
    """A bag is positive when its first tile's class is even."""
    return bag_rows(spark, d).groupBy("slide").agg((F.min_by("label", "tile_idx") % 2 == 0).cast("int").alias("label"))


_LABELS = "bl AS (SELECT vec_id % 20 AS slide, CAST(arg_min(label, vec_id) % 2 = 0 AS INTEGER) AS label FROM embeddings GROUP BY 1)"


@query("bag_features", "SRC10 JN7", """WITH t AS (SELECT vec_id % 20 AS slide, vec_id AS tile_idx, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id) AS rn FROM embeddings WHERE vec_id % 20 <> 4),
w AS (SELECT c_nationkey AS slide FROM customer GROUP BY 1)
SELECT slide, tile_idx, 'kept' AS state FROM t WHERE rn <= 15 AND slide IN (SELECT slide FROM w) UNION ALL SELECT slide, NULL, 'skipped' FROM w WHERE slide NOT IN (SELECT slide FROM t)""")
def bag_features(spark, d):
    labels = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("slide")).distinct()
    kept, missing = bags.load_bags(bag_rows(spark, d).where("slide <> 4"), labels, 15)
    return kept.select("slide", "tile_idx", F.lit("kept").alias("state")).unionByName(
        missing.select("slide", F.lit(None).cast("long").alias("tile_idx"), F.lit("skipped").alias("state"))
    )


_EXT = """s AS (SELECT user_id AS slide, event_id AS tile_idx, "value" AS score FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY score DESC, tile_idx) AS hi, row_number() OVER (PARTITION BY slide ORDER BY score, tile_idx) AS lo FROM s)"""


def event_scores(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("slide"), F.col("event_id").alias("tile_idx"), F.col("value").alias("score"))


@query("extreme_tiles", "WN3", f"""WITH {_EXT} SELECT slide, tile_idx, score, CAST(hi AS INTEGER) AS rank, 0 AS side FROM r WHERE hi <= 8 UNION ALL SELECT slide, tile_idx, score, CAST(lo AS INTEGER), 1 FROM r WHERE lo <= 8""")
def extreme_tiles(spark, d):
    return bags.extremes(event_scores(spark, d), 8)


@query("extreme_vectors", "WN3", f"""WITH {_EXT} SELECT slide, list_concat(list(score ORDER BY hi) FILTER (hi <= 4), list(score ORDER BY lo) FILTER (lo <= 4)) AS extremes FROM r GROUP BY slide""")
def extreme_vectors(spark, d):
    return bags.extreme_vector(bags.extremes(event_scores(spark, d), 4), ["slide"])


@query("extreme_shrink", "WN4", """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT min(n) AS min_tiles, CAST(CASE WHEN min(n) < 200 THEN greatest(1, min(n) // 2) ELSE 100 END AS INTEGER) AS n_extreme FROM n""")
def extreme_shrink(spark, d):
    return bags.shrink_extremes(event_scores(spark, d), 100)


@query("top_tiles", "WN5", """WITH r AS (SELECT event_type AS slide, event_id AS tile_idx, "value" AS score, row_number() OVER (PARTITION BY event_type ORDER BY "value" DESC, event_id) AS hi, row_number() OVER (PARTITION BY event_type ORDER BY "value", event_id) AS lo FROM events)
SELECT slide, tile_idx, score, CAST(hi AS INTEGER) AS rank, 0 AS side FROM r WHERE hi <= 10 UNION ALL SELECT slide, tile_idx, score, CAST(lo AS INTEGER), 1 FROM r WHERE lo <= 10""")
def top_tiles(spark, d):
    s = table(spark, d, "events").select(F.col("event_type").alias("slide"), F.col("event_id").alias("tile_idx"), F.col("value").alias("score"))
    return bags.top_tiles(s, 10)


def formula_models(dim=64, hidden=4, head=(3, 2), n_extreme=3):
    """Two small models whose weights follow a formula that SQL can repeat."""
    out = []
    for m in range(2):
        def wave(a, b, s):
            return np.array([[np.sin(i * b + j + s + m) for j in range(b)] for i in range(a)])

        w = {"w1": wave(dim, hidden, 0.0), "w2": wave(hidden, 1, 0.3), "h1": wave(2 * n_extreme, head[0], 0.7), "h2": wave(head[0], head[1], 1.1), "h3": wave(head[1], 1, 1.9)}
        w |= {"b" + k: np.full(v.shape[1], 0.1) for k, v in list(w.items())}
        out.append(bags.BagModel(0, m, n_extreme, w))
    return out


_SIG = lambda x: f"1.0 / (1.0 + exp(-({x})))"
_SCORED = f"""e AS (SELECT vec_id % 20 AS slide, vec_id AS tile_idx, CAST(embedding AS DOUBLE[]) AS x, m FROM embeddings, (SELECT CAST(unnest(range(0, 2)) AS DOUBLE) AS m)),
hid AS (SELECT slide, tile_idx, m, list_transform(range(0, 4), lambda j: {_SIG('0.1 + list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * sin(i * 4 + j + m)))')}) AS h FROM e),
sc AS (SELECT slide, tile_idx, m, 0.1 + list_sum(list_transform(range(0, 4), lambda j: h[j + 1] * sin(j + 0.3 + m))) AS score FROM hid)"""


@query("tile_probabilities", "ML1 ML5", f"WITH {_SCORED} SELECT slide, tile_idx, round(avg({_SIG('score')}), 6) AS score FROM sc GROUP BY 1, 2")
def tile_probabilities(spark, d):
    return rounded(bags.tile_probability(bags.score_tiles(bag_rows(spark, d), formula_models())), "score")


@query("slide_probabilities", "ML2 ML3", f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY slide, m ORDER BY score DESC, tile_idx) AS hi, row_number() OVER (PARTITION BY slide, m ORDER BY score, tile_idx) AS lo FROM sc),
v AS (SELECT slide, m, list_concat(list(score ORDER BY hi) FILTER (hi <= 3), list(score ORDER BY lo) FILTER (lo <= 3)) AS s FROM r GROUP BY 1, 2),
a AS (SELECT slide, m, list_transform(range(0, 3), lambda j: {_SIG('0.1 + list_sum(list_transform(range(0, 6), lambda i: s[i + 1] * sin(i * 3 + j + 0.7 + m)))')}) AS a1 FROM v),
b AS (SELECT slide, m, list_transform(range(0, 2), lambda j: {_SIG('0.1 + list_sum(list_transform(range(0, 3), lambda i: a1[i + 1] * sin(i * 2 + j + 1.1 + m)))')}) AS a2 FROM a)
SELECT slide, 0 AS repeat, CAST(m AS INTEGER) AS fold, round({_SIG('0.1 + list_sum(list_transform(range(0, 2), lambda i: a2[i + 1] * sin(i + 1.9 + m)))')}, 6) AS prob FROM b""")
def slide_probabilities(spark, d):
    return rounded(bags.slide_probabilities(bag_rows(spark, d), formula_models()), "prob")


def _trained(spark, d):
    labels = bag_labels(spark, d).withColumn("patient", F.col("slide"))
    return workflows.train_and_report(bag_rows(spark, d), labels, splits=2, repeats=1)


@query("trained_ensemble", "ML4")
def trained_ensemble(spark, d):
    """The default network and epochs over two patient-grouped folds: slide probabilities of the trained models."""
    return rounded(_trained(spark, d)[1], "prob")


@query("training_manifest", "ML7 TG7")
def training_manifest(spark, d):
    labels = bag_labels(spark, d).withColumn("patient", F.col("slide"))
    models, _, _, history = _trained(spark, d)
    folds = fd.make_folds(labels, 2, 1)
    return bags.train_manifest(bags.models_frame(spark, models), folds, len(history), 1e-3).withColumn("models", F.to_json("models"))


@query("tile_embedding", "ML6", "SELECT user_id AS slide, event_id AS tile_idx, list_value(CAST(length(event_type) AS FLOAT), CAST(length(props) AS FLOAT)) AS emb FROM events")
def tile_embedding(spark, d):
    """The hook with a stand-in model: lengths of two texts."""
    t = table(spark, d, "events").select(
        F.col("user_id").alias("slide"), F.col("event_id").alias("tile_idx"), (F.col("event_id") % 64).alias("x"), F.floor(F.col("event_id") / 64).alias("y"),
        F.concat_ws("\t", "event_type", "props").alias("payload"),
    )
    return tiles.embed_tiles(t, lambda: lambda batch: [[len(p) for p in text.split("\t")] for text in batch]).select("slide", "tile_idx", "emb")


@query("tile_kernel", "UD1", """SELECT event_id, CASE WHEN "value" >= 1 THEN round(100 / "value", 6) END AS scaled, CASE WHEN "value" < 1 THEN 'ValueError: too dark' END AS error FROM events""")
def tile_kernel(spark, d):
    def kernel(row):
        if row["value"] < 1:
            raise ValueError("too dark")
        return {"scaled": 100 / row["value"]}

    return rounded(tiles.map_tiles(table(spark, d, "events").select("event_id", "value"), kernel, "scaled double"), "scaled").drop("value")


# ---- codebooks and attention ----------------------------------------------------------------------


def codebook(spark, d):
    return table(spark, d, "embeddings").where("vec_id < 16").select(F.col("vec_id").alias("code"), F.col("embedding").alias("vec"))


def _assigned(spark, d):
    book = cb.fetch_codebook(codebook(spark, d))
    return cb.vq_assign(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec")), *book)


_ASSIGN = """x AS (SELECT a.vec_id, c.vec_id AS code, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) /
 ((sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) + 1e-8) * (sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) + 1e-8)) AS s
 FROM embeddings a, embeddings c WHERE c.vec_id < 16), q AS (SELECT vec_id, arg_min(code, (-round(s, 12), code)) AS code, max(s) AS similarity FROM x GROUP BY 1)"""


@query("codeword_assignment", "VQ1", f"WITH {_ASSIGN} SELECT vec_id, code, round(similarity, 6) AS similarity FROM q")
def codeword_assignment(spark, d):
    return rounded(_assigned(spark, d).select("vec_id", "code", "similarity"), "similarity")


@query("codebook_usage", "AG32", f"""WITH {_ASSIGN}, u AS (SELECT count(DISTINCT code) AS n_used, avg(similarity) AS ms FROM q)
SELECT CAST(16 AS BIGINT) AS n_codes, n_used, round(ms, 6) AS mean_similarity, 16 - n_used AS n_dead, round((16 - n_used) / 16.0, 6) AS dead_share FROM u""")
def codebook_usage(spark, d):
    return rounded(cb.codebook_usage(_assigned(spark, d), codebook(spark, d)), "mean_similarity", "dead_share")


@query("logit_spread", "AG32", """WITH p AS (SELECT list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS r FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT round(stddev_pop(r), 6) AS std_raw, round(stddev_pop(r / 8.0), 6) AS std_scaled, count(*) AS n FROM p""")
def logit_spread(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("q"))
    pair = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("q").alias("k")), "vec_id")
    return rounded(cb.logit_spread(pair, "q", "k"), "std_raw", "std_scaled")


_UNIT = "list_transform(CAST(embedding AS DOUBLE[]), lambda v: v / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1e-8))"


@query("codebook_round", "VQ2", f"""WITH {_ASSIGN}, w AS (SELECT code, {_UNIT} AS u FROM q JOIN embeddings USING (vec_id))
SELECT code, CAST(count(*) AS BIGINT) AS n, round(avg(u[1]), 6) AS m1, round(avg(u[2]), 6) AS m2, round(avg(u[64]), 6) AS m64 FROM w GROUP BY code""")
def codebook_round(spark, d):
    """One round of fitting: rows per codeword and the means that become its next vector (first, second and last component)."""
    _, book = cb.fetch_codebook(codebook(spark, d))
    sums = cb.code_sums(table(spark, d, "embeddings").select(F.col("embedding").alias("vec")), book)
    return sums.select("code", F.col("n").cast("long").alias("n"), *[r6(F.get("s", F.lit(i - 1)) / F.col("n")).alias(f"m{i}") for i in (1, 2, 64)])


@query("codebook_fitting", "VQ2")
def codebook_fitting(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    codes, book = cb.fit_codebook(rows, 12, seed=1)
    return rounded(cb.vq_assign(rows, codes, book).groupBy("code").agg(F.count("*").alias("n"), F.avg("similarity").alias("similarity")), "similarity")


@query("residual_quantisation", "VQ3 JN18")
def residual_quantisation(spark, d):
    """Embeddings laid out on 14 by 14 grids; cells without a vector hold zeros."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 196).alias("slide"), (F.col("vec_id") % 196).cast("int").alias("c"), F.col("embedding").alias("vec"))
    frame = e.select("slide").distinct().withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(195))))
    grid = frame.join(e, ["slide", "c"], "left").select(
        "slide", (F.col("c") % 14).alias("gx"), F.floor(F.col("c") / 14).cast("int").alias("gy"),
        F.coalesce("vec", F.array_repeat(F.lit(0.0).cast("float"), 64)).alias("vec"),
    )
    return rounded(cb.residual_vq(grid, *cb.fetch_codebook(codebook(spark, d)), ["slide"]), "error")


@query("bag_attention", "VQ4", """WITH e AS (SELECT vec_id % 20 AS slide, vec_id AS tile_idx, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS (SELECT q.slide, q.tile_idx, list_dot_product(q.x, k.x) / 8.0 AS z, k.x AS v FROM e q JOIN e k ON q.slide = k.slide),
m AS (SELECT *, max(z) OVER (PARTITION BY slide, tile_idx) AS top FROM l)
SELECT slide, tile_idx, round(sum(exp(z - top) * v[1]) / sum(exp(z - top)), 6) AS o1, round(sum(exp(z - top) * v[2]) / sum(exp(z - top)), 6) AS o2, round(sum(exp(z - top) * v[64]) / sum(exp(z - top)), 6) AS o64,
 1.0::DOUBLE AS weight_sum FROM m GROUP BY 1, 2""")
def bag_attention(spark, d):
    eye = np.eye(64)
    out = attention.bag_attention(bag_rows(spark, d), eye, eye, eye, block=64)
    return out.select(
        "slide", "tile_idx", *[r6(F.get("out", F.lit(i - 1))).alias(f"o{i}") for i in (1, 2, 64)], r6("weight_sum").alias("weight_sum")
    )
