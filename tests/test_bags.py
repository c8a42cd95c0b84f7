"""Bag scoring, gradients, training, codebooks, attention, tile hooks."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slidegrid.operators import attention, bags, codebook as cb, evaluate as ev, tiles
from slidegrid.plans import workflows


def bag_frame(spark, sizes, dim=6, shift=None, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i, n in enumerate(sizes):
        x = rng.normal(0, 1, (n, dim)) + (shift[i] if shift else 0.0)
        rows += [(f"s{i:02d}", t, x[t].tolist()) for t in range(n)]
    return spark.createDataFrame(rows, "slide string, tile_idx int, emb array<float>"), rows


def small_model(n=2, dim=6, seed=1, fold=0):
    return bags.BagModel.fresh(0, fold, dim, n, seed, hidden=5, head=(4, 3))


def by_hand(model, x):
    s = model.score(x)
    idx = np.arange(len(s))
    top = idx[np.lexsort((idx, -s))][: model.n_extreme]
    low = idx[np.lexsort((idx, s))][: model.n_extreme]
    logit, _ = model.head(np.concatenate([s[top], s[low]])[None, :])
    return 1 / (1 + np.exp(-logit[0])), np.concatenate([top, low])


def test_scores_and_probabilities(spark):
    df, rows = bag_frame(spark, [9, 4, 30])
    models = [small_model(), small_model(1, seed=2, fold=1)]
    got = {(r["slide"], r["fold"]): r["prob"] for r in bags.slide_probabilities(df.repartition(7), models).collect()}
    for s in {r[0] for r in rows}:
        x = np.array([r[2] for r in rows if r[0] == s], dtype=np.float32).astype(float)
        for m in models:
            assert got[(s, m.fold)] == pytest.approx(by_hand(m, x)[0])
    p = bags.tile_probability(bags.score_tiles(df, models)).where("slide = 's01' and tile_idx = 2").first()["score"]
    x = np.array(rows[11][2], dtype=np.float32).astype(float)[None]
    assert p == pytest.approx(np.mean([1 / (1 + np.exp(-m.score(x)[0])) for m in models]))


def test_small_bag_is_refused_and_extremes_shrink(spark):
    df, _ = bag_frame(spark, [3, 9])
    got = bags.shrink_extremes(df, 4).first()
    assert (got["min_tiles"], got["n_extreme"]) == (3, 1)
    one = df.where("tile_idx = 0")
    assert bags.shrink_extremes(one, 4).first()["n_extreme"] == 1
    with pytest.raises(Exception, match="fewer tiles"):
        bags.slide_probabilities(one, [small_model(2)]).collect()


def test_extremes_break_ties_by_tile(spark):
    s = spark.createDataFrame([("a", i, 0.5) for i in range(6)] + [("b", 0, 1.0)], "slide string, tile_idx int, score double")
    got = bags.extremes(s, 2).toPandas()
    assert sorted(got[(got.slide == "a") & (got.side == 0)].tile_idx) == [0, 1]
    assert len(got[got.slide == "b"]) == 2


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(3)
    model, x = small_model(), rng.normal(size=(4, 6))
    _, g = bags.bag_gradient(model, x, 1.0, 2.5)
    for name in model.w:
        flat = model.w[name].reshape(-1)
        for i in (0, len(flat) - 1):
            keep, h, out = flat[i], 1e-6, []
            for d in (h, -h):
                flat[i] = keep + d
                out.append(bags.bag_gradient(model, x, 1.0, 2.5)[0])
            flat[i] = keep
            assert g[name].reshape(-1)[i] == pytest.approx((out[0] - out[1]) / (2 * h), abs=1e-6)


def test_two_pass_gradients_equal_whole_bags(spark, monkeypatch):
    """Summed over slides, the two passes give what each slide's selected tiles give by themselves; segments are put together."""
    monkeypatch.setattr(bags, "SEGMENT", 7)
    df, rows = bag_frame(spark, [9, 4, 30, 12])
    models = [small_model(), small_model(1, seed=2, fold=1)]
    targets = spark.createDataFrame([(0, "s00", 1, 2.0), (0, "s02", 0, 2.0), (0, "s01", 1, 2.0), (1, "s03", 1, 0.5), (1, "s02", 0, 0.5)], "model int, slide string, label int, pos_weight double")
    got = bags.ensemble_gradients(bags.store_bags(df), targets, models)
    for i, model in enumerate(models):
        loss, n, flat = 0.0, 0, 0.0
        for t in targets.where(F.col("model") == i).collect():
            x = np.array([r[2] for r in rows if r[0] == t["slide"]], dtype=np.float32).astype(float)
            one, g = bags.bag_gradient(model, x[by_hand(model, x)[1]], t["label"], t["pos_weight"])
            loss, n, flat = loss + one, n + 1, flat + bags._pack(g, [*bags.HEAD_WEIGHTS, *bags.TILE_WEIGHTS])
        assert got[i][1] == n and got[i][0] == pytest.approx(loss) and np.allclose(got[i][2], flat)


def test_no_epoch_shuffles_embeddings(spark):
    """Bags beyond the size of a broadcast: only the narrow side moves."""
    df, _ = bag_frame(spark, [9, 4, 30, 12])
    stored, models = bags.store_bags(df, 4), [small_model()]
    targets = spark.createDataFrame([(0, "s00", 1, 2.0)], "model int, slide string, label int, pos_weight double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = bags.head_pass(stored, targets, models)
        for plan in (first, bags.tile_pass(stored, bags._selected(first), models)):
            text = plan._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            moved = re.findall(r"\) (?:Broadcast)?Exchange\nInput[^\n]*\n", text)
            assert moved and not any("emb#" in m for m in moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_training_separates_shifted_bags(spark):
    sizes = [20, 24, 28, 20, 24, 28, 20, 24]
    df, _ = bag_frame(spark, sizes, shift=[0.0] * 4 + [1.5] * 4)
    labels = spark.createDataFrame([(f"s{i:02d}", f"s{i:02d}", int(i >= 4)) for i in range(8)], "slide string, patient string, label int")
    models, preds, held, history = workflows.train_and_report(df.cache(), labels, 2, 1, epochs=12, lr=0.1, n_extreme=5, hidden=6, head=(5, 4))
    assert history[-1] < history[0] and len(models) == 2
    oof = ev.out_of_fold(preds, held).join(labels, "slide").withColumnRenamed("prob", "score")
    assert ev.auc(oof).first()["auc"] == 1.0
    frame = bags.models_frame(spark, models, {(0, 0): 0.9})
    again = bags.models_from_frame(frame)
    assert np.allclose(again[1].w["w1"], models[1].w["w1"])
    report = workflows.score_report(preds, held, labels).first()
    assert report["n_units"] == 8 and report["ranking"]["auc"] == 1.0


def test_load_bags_reports_missing(spark):
    df, _ = bag_frame(spark, [5, 7])
    labels = spark.createDataFrame([("s00", 1), ("s09", 0)], "slide string, label int")
    kept, missing = bags.load_bags(df, labels, 3)
    assert sorted(r["tile_idx"] for r in kept.collect()) == [0, 1, 2] and [r["slide"] for r in missing.collect()] == ["s09"]


def test_codebook_ties_zero_vectors_and_dead_codes(spark):
    book = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, -1.0])], "code int, vec array<double>")
    rows = spark.createDataFrame([(0, [2.0, 0.1]), (1, [0.0, 0.0]), (2, [0.0, 3.0])], "id int, vec array<float>")
    got = cb.vq_assign(rows, *cb.fetch_codebook(book))
    assert [r["code"] for r in got.orderBy("id").collect()] == [0, 0, 2]
    use = cb.codebook_usage(got, book).first()
    assert (use["n_used"], use["n_dead"], use["dead_share"]) == (2, 2, 0.5)


def test_fit_codebook_restarts_dead_codes(spark):
    rng = np.random.default_rng(0)
    centers = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1.0], [-1, 0, 0]])
    x = np.repeat(centers, 30, axis=0) + rng.normal(0, 0.02, (120, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    codes, book = cb.fit_codebook(df, 4, seed=2, rounds=8)
    got = cb.vq_assign(df, codes, book)
    assert got.select("code").distinct().count() == 4 and got.agg(F.min("similarity")).first()[0] > 0.98


def test_seeding_finds_far_groups(spark):
    """Seven tight groups, one with nearly all rows: parallel seeding starts with a row of each; fewer rows than codes are all taken."""
    rng = np.random.default_rng(5)
    centres = np.linalg.qr(rng.normal(size=(8, 8)))[0][:7]
    x = np.concatenate([np.repeat(centres[:1], 400, axis=0), np.repeat(centres[1:], 3, axis=0)]) + rng.normal(0, 0.005, (418, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>").repartition(3)
    start = cb.seed_codebook(df, 7, seed=4)
    assert sorted((start @ centres.T).argmax(axis=1)) == list(range(7))
    assert (start == cb.seed_codebook(df.repartition(5), 7, seed=4)).all()
    assert len(cb.seed_codebook(df.limit(3), 7)) == 3 and len(cb.seed_codebook(df.limit(0), 7)) == 0
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)], "id int, vec array<double>")
    assert cb.seed_codebook(same, 4).tolist() == [[1.0, 0.0]] * 4


def test_residual_error_falls_with_scales(spark):
    rng = np.random.default_rng(1)
    side = 4
    cells = [("g", x, y, (np.array([x, y, 1.0]) + rng.normal(0, 0.1, 3)).tolist()) for x in range(side) for y in range(side)]
    df = spark.createDataFrame(cells, "slide string, gx int, gy int, vec array<double>")
    book = np.vstack([np.array([c[3] for c in cells]), np.eye(3) * 0.2, -np.eye(3) * 0.2])
    got = cb.residual_vq(df, np.arange(len(book)), book, ["slide"], side, [1, 2, 4]).toPandas().set_index("scale")["error"]
    assert got[4] < got[1]


@pytest.mark.parametrize("heads", [1, 2])
def test_attention_against_numpy(spark, heads):
    df, rows = bag_frame(spark, [11, 1], dim=4)
    rng = np.random.default_rng(5)
    wq, wk, wv = (rng.normal(size=(4, 4)) for _ in range(3))
    wo = rng.normal(size=(4, 4))
    got = attention.bag_attention(df, wq, wk, wv, heads, wo, block=3).toPandas()
    assert np.allclose(got["weight_sum"], 1.0) and len(got) == 12
    x = np.array([r[2] for r in rows if r[0] == "s00"], dtype=np.float32).astype(float)
    q, k, v = x @ wq, x @ wk, x @ wv
    outs = []
    for h in range(heads):
        c = slice(h * 4 // heads, (h + 1) * 4 // heads)
        z = q[:, c] @ k[:, c].T / np.sqrt(4 / heads)
        e = np.exp(z - z.max(1, keepdims=True))
        outs.append(e / e.sum(1, keepdims=True) @ v[:, c])
    want = np.concatenate(outs, 1) @ wo
    mine = np.stack(got[got.slide == "s00"].sort_values("tile_idx")["out"].to_numpy())
    assert np.allclose(mine, want)


@pytest.mark.parametrize("most", [4, 32768])
def test_attention_in_pieces(spark, monkeypatch, most):
    """Whatever the pieces, the result is the same; their number does not grow until they are full, so neither does the shuffle per tile."""
    df, _ = bag_frame(spark, [23, 5, 1], dim=4)
    read = lambda: attention.bag_attention(df, *[np.eye(4)] * 3, block=2).toPandas().sort_values(["slide", "tile_idx"])
    whole = read()
    monkeypatch.setattr(attention, "SMALL_PIECE", 1)
    monkeypatch.setattr(attention, "PIECE_ROWS", most)
    cut = read()
    assert np.allclose(np.stack(whole["out"].to_numpy()), np.stack(cut["out"].to_numpy())) and len(cut) == 29
    made = attention.bag_attention(df, *[np.eye(4)] * 3, block=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(array_distinct" in made and "collect_list(struct(i" not in made


def test_tile_hooks(spark):
    df = spark.createDataFrame([("s", i, i, 0, float(i)) for i in range(6)], "slide string, tile_idx int, x int, y int, payload double")

    def kernel(row):
        if row["tile_idx"] == 3:
            raise ValueError("bad tile")
        return {"twice": row["payload"] * 2}

    got = tiles.map_tiles(df, kernel, "twice double").orderBy("tile_idx").collect()
    assert got[2]["twice"] == 4.0 and got[3]["twice"] is None and got[3]["error"] == "ValueError: bad tile"
    with pytest.raises(Exception, match="bad tile"):
        tiles.map_tiles(df, kernel, "twice double", on_error="raise").collect()
    sums = tiles.map_bags(df, "slide", lambda p: pd.DataFrame({"n": [len(p)]}), "n int", block=4)
    assert sorted(r["n"] for r in sums.collect()) == [2, 4]
    loader = lambda: lambda batch: [[b, b + 1] for b in batch]
    cached = tiles.embed_tiles(df, loader)
    moved = df.withColumn("x", F.when(F.col("tile_idx") == 5, 99).otherwise(F.col("x")))
    assert tiles.embed_stale(df, cached, loader).count() == 6
    assert tiles.embed_stale(moved, cached, loader).where("x = 99").count() == 1


def test_codebook_with_tasks_without_rows(spark):
    """A task that gets no rows passes nothing on; more tasks than rows give the same sums as one."""
    rows = spark.range(6).select("id", F.array(*[(F.col("id") % 3 + i).cast("float") for i in range(4)]).alias("vec"))
    book = np.eye(4)[:2]
    read = lambda df: sorted((r.code, r.n, [round(x, 9) for x in r.s]) for r in cb.code_sums(df, book).collect())
    assert read(rows.repartition(16)) == read(rows.coalesce(1)) != []
    assert read(rows.where("id < 0")) == []
    codes, fitted = cb.fit_codebook(rows.repartition(16), 2, rounds=2, restarts=1)
    assert len(codes) == 2 and np.isfinite(fitted).all()
