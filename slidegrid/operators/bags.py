"""Multiple-instance scoring and training on bags of tile embeddings.

A model scores every tile (linear, sigmoid, linear), keeps the n highest and n lowest scores of a
slide, and feeds those 2n numbers to a small head (2n, 128, 64, 1). Tiles never move: all models
score an Arrow batch in one pass, and only a batch's extreme tiles per slide and model are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from slidegrid.operators.ordered import first_by_index, top_n
from slidegrid.session import cut_lineage, scratch_folder

HIDDEN, HEAD = 128, (128, 64)
MODEL_BYTES_LIMIT = 1 << 30


@dataclass
class BagModel:
    """Weights of one member of the ensemble, as float64 arrays."""

    repeat: int
    fold: int
    n_extreme: int
    w: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(repeat: int, fold: int, dim: int, n_extreme: int, seed: int, hidden: int = HIDDEN, head=HEAD) -> "BagModel":
        rng = np.random.default_rng(seed)
        shapes = {"w1": (dim, hidden), "w2": (hidden, 1), "h1": (2 * n_extreme, head[0]), "h2": (head[0], head[1]), "h3": (head[1], 1)}
        weights = {}
        for name, (a, b) in shapes.items():
            bound = np.sqrt(6.0 / (a + b))
            weights[name] = rng.uniform(-bound, bound, (a, b))
            weights["b" + name] = np.zeros(b)
        return BagModel(repeat, fold, n_extreme, weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        hidden = _sig(x @ self.w["w1"] + self.w["bw1"])
        return (hidden @ self.w["w2"] + self.w["bw2"])[:, 0]

    def head(self, s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        a1 = _sig(s @ self.w["h1"] + self.w["bh1"])
        a2 = _sig(a1 @ self.w["h2"] + self.w["bh2"])
        return (a2 @ self.w["h3"] + self.w["bh3"])[:, 0], [s, a1, a2]


def _sig(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def load_bags(embeddings: DataFrame, labels: DataFrame, max_tiles: int | None = 5000) -> tuple[DataFrame, DataFrame]:
    """(bags of labelled slides, labelled slides without tiles).

    At most the first ``max_tiles`` tiles of a slide are kept when a cap is given, as the recipe asks.
    """
    missing = labels.join(embeddings.select("slide").distinct(), "slide", "left_anti")
    wanted = embeddings.join(labels.select("slide").distinct(), "slide", "left_semi")
    if max_tiles is not None:
        wanted = first_by_index(wanted, ["slide"], "tile_idx", max_tiles)
    return wanted, missing


def shrink_extremes(bags: DataFrame, n_extreme: int) -> DataFrame:
    """One row: n_extreme, lowered to half the smallest bag when that is under 2n."""
    sizes = bags.groupBy("slide").agg(F.count("*").alias("n"))
    return sizes.agg(F.min("n").alias("min_tiles")).select(
        "min_tiles",
        F.when(F.col("min_tiles") < 2 * n_extreme, F.greatest(F.lit(1), F.floor(F.col("min_tiles") / 2)))
        .otherwise(n_extreme).cast("int").alias("n_extreme"),
    )


def extremes(scores: DataFrame, n: int, by: list[str] = ("slide",), carry: list[str] = ()) -> DataFrame:
    """The n highest (descending) and n lowest (ascending) scores per bag, ties by tile_idx.

    Returns rows (by..., side, rank, tile_idx, score): side 0 is the top, 1 the bottom.
    """
    by = list(by)
    cols = scores.select(*by, "tile_idx", "score", *carry)
    high = top_n(cols, by, [F.col("score").desc(), F.col("tile_idx").asc()], n, ["tile_idx"])
    low = top_n(cols, by, [F.col("score").asc(), F.col("tile_idx").asc()], n, ["tile_idx"])
    return high.withColumn("side", F.lit(0)).unionByName(low.withColumn("side", F.lit(1)))


def extreme_vector(picked: DataFrame, by: list[str]) -> DataFrame:
    """The 2n scores of a bag as one array, top block first; never more than 2n items."""
    return picked.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("side", "rank", "score"))), lambda s: s["score"]).alias("extremes")
    )


def _check_size(models: list[BagModel]) -> None:
    size = sum(a.nbytes for m in models for a in m.w.values())
    if size > MODEL_BYTES_LIMIT:
        raise ValueError(f"{size} bytes of weights are too many for one broadcast; score the ensemble in parts")


def score_tiles(bags: DataFrame, models: list[BagModel]) -> DataFrame:
    """(slide, tile_idx, scores): one array with the raw score of every model, in model order."""
    _check_size(models)
    shared = bags.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["emb"].to_numpy()).astype(np.float64)
                s = np.stack([m.score(x) for m in shared.value], axis=1)
                yield pd.DataFrame({"slide": pdf["slide"], "tile_idx": pdf["tile_idx"], "scores": list(s)})

    kinds = dict(bags.dtypes)
    return bags.select("slide", "tile_idx", "emb").mapInPandas(
        run, f"slide {kinds['slide']}, tile_idx {kinds['tile_idx']}, scores array<double>"
    )


def tile_probability(scored: DataFrame) -> DataFrame:
    """Mean over models of sigmoid(score): the tile's probability, kept in the JVM."""
    total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.lit(1.0) / (F.lit(1.0) + F.exp(-s)))
    return scored.select("slide", "tile_idx", (total / F.size("scores")).alias("score"))


def top_tiles(scores: DataFrame, k: int, by: list[str] = ("slide",)) -> DataFrame:
    return extremes(scores, k, by)


def _batch_extremes(bags: DataFrame, models: list[BagModel]) -> DataFrame:
    """Score every tile under every model, passing on only each batch's extremes per slide and model.

    A tile among a slide's n extremes is among the n extremes of its batch, so nothing is lost, and a
    slide of any size sends on at most 2n rows per batch and model.
    """
    _check_size(models)
    shared = bags.sparkSession.sparkContext.broadcast(models)
    kinds = dict(bags.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["emb"].to_numpy()).astype(np.float64)
            groups = list(pdf.groupby("slide", sort=False).indices.items())
            tiles = pdf["tile_idx"].to_numpy()
            for i, model in enumerate(shared.value):
                s, n = model.score(x), model.n_extreme
                for slide, rows in groups:
                    down = rows[np.lexsort((tiles[rows], -s[rows]))[:n]]
                    up = rows[np.lexsort((tiles[rows], s[rows]))[:n]]
                    for side, sel in ((0, down), (1, up)):
                        yield pd.DataFrame({"model": i, "slide": slide, "side": side, "tile_idx": tiles[sel], "score": s[sel]})

    schema = f"model int, slide {kinds['slide']}, side int, tile_idx {kinds['tile_idx']}, score double"
    return bags.select("slide", "tile_idx", "emb").mapInPandas(run, schema)


def _final_extremes(local: DataFrame, models: list[BagModel]) -> DataFrame:
    limit = F.create_map(*[F.lit(v) for i, m in enumerate(models) for v in (i, m.n_extreme)])
    rank = Window.partitionBy("model", "slide", "side").orderBy(
        F.when(F.col("side") == 0, -F.col("score")).otherwise(F.col("score")), "tile_idx"
    )
    most = max(m.n_extreme for m in models)
    ranked = local.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)
    return ranked.where(F.col("rank") <= limit[F.col("model")])


def slide_probabilities(bags: DataFrame, models: list[BagModel]) -> DataFrame:
    """(slide, repeat, fold, prob) for every slide and model: one pass over the tiles."""
    picked = _final_extremes(_batch_extremes(bags, models), models)
    vectors = extreme_vector(picked, ["model", "slide"])
    shared = bags.sparkSession.sparkContext.broadcast(models)
    kinds = dict(bags.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, part in pdf.groupby("model"):
                m = shared.value[int(i)]
                full = part["extremes"].map(len) == 2 * m.n_extreme
                if not full.all():
                    raise ValueError("a bag holds fewer tiles than the model's extremes need")
                logit, _ = m.head(np.stack(part["extremes"].to_numpy()))
                yield pd.DataFrame({"slide": part["slide"], "repeat": m.repeat, "fold": m.fold, "prob": _sig(logit)})

    return vectors.mapInPandas(run, f"slide {kinds['slide']}, repeat int, fold int, prob double")


def _pack(grads: dict[str, np.ndarray], names: list[str]) -> np.ndarray:
    return np.concatenate([grads[k].ravel() for k in names])


def _unpack(flat: np.ndarray, like: dict[str, np.ndarray], names: list[str]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in names:
        size = like[k].size
        out[k] = flat[at : at + size].reshape(like[k].shape)
        at += size
    return out


HEAD_WEIGHTS, TILE_WEIGHTS = ("bh1", "bh2", "bh3", "h1", "h2", "h3"), ("bw1", "bw2", "w1", "w2")
#: Numbers of a gradient that are summed as one row.
SEGMENT = 1 << 15


def head_gradient(model: BagModel, s: np.ndarray, label: np.ndarray, pos_weight: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Losses of slides from their 2n scores each, the head's summed gradient, and the losses' slopes in the scores."""
    w = model.w
    z, (s0, a1, a2) = model.head(s)
    loss = label * pos_weight * np.logaddexp(0, -z) + (1 - label) * np.logaddexp(0, z)
    p = _sig(z)
    dz = (label * pos_weight * (p - 1) + (1 - label) * p)[:, None]
    d2 = (dz @ w["h3"].T) * a2 * (1 - a2)
    d1 = (d2 @ w["h2"].T) * a1 * (1 - a1)
    g = {"h3": a2.T @ dz, "bh3": dz.sum(0), "h2": a1.T @ d2, "bh2": d2.sum(0), "h1": s0.T @ d1, "bh1": d1.sum(0)}
    return loss, g, d1 @ w["h1"].T


def tile_gradient(model: BagModel, emb: np.ndarray, slope: np.ndarray) -> dict[str, np.ndarray]:
    """The scorer's summed gradient from tiles and the losses' slopes in their scores."""
    w, ds = model.w, slope[:, None]
    hidden = _sig(emb @ w["w1"] + w["bw1"])
    dh = (ds @ w["w2"].T) * hidden * (1 - hidden)
    return {"w2": hidden.T @ ds, "bw2": ds.sum(0), "w1": emb.T @ dh, "bw1": dh.sum(0)}


def bag_gradient(model: BagModel, emb: np.ndarray, label: float, pos_weight: float) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradient of one slide from its 2n selected tiles (top block first).

    Tiles that were not selected have no influence on the output, so they need no gradient.
    """
    loss, g, slope = head_gradient(model, model.score(emb)[None, :], np.array([label]), np.array([pos_weight]))
    return float(loss[0]), g | tile_gradient(model, emb, slope[0])


def store_bags(bags: DataFrame, buckets: int | None = None) -> DataFrame:
    """The bags as a table on shared storage, bucketed and sorted by slide and tile.

    Training reads it in every epoch: a join on slide and tile then moves the other side only, and the tiles of a
    large slide lie in many buckets.
    """
    spark = bags.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    name = f"slidegrid_bags_{uuid.uuid4().hex}"
    writer = bags.select("slide", "tile_idx", "emb").repartition(n, "slide", "tile_idx").write.bucketBy(n, "slide", "tile_idx").sortBy("slide", "tile_idx")
    writer.option("path", scratch_folder(spark)).saveAsTable(name)
    return spark.table(name)


class _Sums:
    """Gradients added up in a task, one vector per model; leave it as bounded segments."""

    def __init__(self, part: int):
        self.part, self.held = part, {}

    def add(self, model: int, loss: float, n: int, flat: np.ndarray) -> None:
        held = self.held.setdefault(model, [0.0, 0, 0.0])
        held[0] += loss
        held[1] += n
        held[2] = held[2] + flat

    def rows(self) -> Iterator[dict]:
        for model, (loss, n, flat) in self.held.items():
            for k in range(0, len(flat), SEGMENT):
                yield {"model": model, "part": self.part, "seg": k // SEGMENT, "loss": 0.0 if k else loss, "n": 0 if k else n, "grad": flat[k : k + SEGMENT]}


_SUMS = "model int, part int, seg int, loss double, n long, grad array<double>"


def head_pass(bags: DataFrame, targets: DataFrame, models: list[BagModel]) -> DataFrame:
    """Forward and backward through the heads: rows of selected tiles with their slopes, and rows of summed gradients.

    Only scores are shuffled: n highest and lowest per slide and model, then 2n numbers per slide and model.
    """
    shared = bags.sparkSession.sparkContext.broadcast(models)
    kinds = dict(bags.dtypes)
    picked = _final_extremes(_batch_extremes(bags, models), models).join(targets, ["model", "slide"])
    one = F.struct("side", "rank", "tile_idx", "score")
    per = picked.groupBy("model", "slide").agg(
        F.array_sort(F.collect_list(one)).alias("t"), F.max("label").alias("label"), F.max("pos_weight").alias("pos_weight")
    ).select("model", "slide", F.col("t.tile_idx").alias("tiles"), F.col("t.score").alias("scores"), "label", "pos_weight")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = _Sums(0)
        for pdf in batches:
            for i, rows in pdf.groupby("model"):
                model = shared.value[int(i)]
                s = np.stack(rows["scores"].to_numpy()).astype(float)
                loss, g, slope = head_gradient(model, s, rows["label"].to_numpy(float), rows["pos_weight"].to_numpy(float))
                sums.add(int(i), float(loss.sum()), len(rows), _pack(g, HEAD_WEIGHTS))
                found = {"model": int(i), "slide": rows["slide"].to_numpy(), "tiles": rows["tiles"].to_numpy(), "slopes": list(slope)}
                yield pd.DataFrame(found).assign(part=None, seg=None, loss=None, n=None, grad=None)
        done = pd.DataFrame(list(sums.rows()), columns=["model", "part", "seg", "loss", "n", "grad"])
        yield done.assign(slide=None, tiles=None, slopes=None)

    return per.mapInPandas(run, f"slide {kinds['slide']}, tiles array<{kinds['tile_idx']}>, slopes array<double>, {_SUMS}")


def tile_pass(bags: DataFrame, selected: DataFrame, models: list[BagModel]) -> DataFrame:
    """Summed gradients of the tile scorers: selected tiles (slide, tile_idx, model, slope) go to where the embeddings lie.

    ``bags`` comes from ``store_bags``: the join moves the narrow side alone.
    """
    shared = bags.sparkSession.sparkContext.broadcast(models)
    narrow = selected.groupBy("slide", "tile_idx").agg(F.collect_list("model").alias("of"), F.collect_list("slope").alias("slopes"))  # at most one per model
    met = bags.join(narrow, ["slide", "tile_idx"]).select("emb", "of", "slopes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = _Sums(1)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["emb"].to_numpy()).astype(np.float64)
            row = np.repeat(np.arange(len(pdf)), pdf["of"].map(len).to_numpy())
            of, slope = np.concatenate(pdf["of"].to_numpy()), np.concatenate(pdf["slopes"].to_numpy())
            for i in np.unique(of).tolist():
                mine = of == i
                sums.add(i, 0.0, 0, _pack(tile_gradient(shared.value[i], x[row[mine]], slope[mine]), TILE_WEIGHTS))
        yield pd.DataFrame(list(sums.rows()), columns=["model", "part", "seg", "loss", "n", "grad"])

    return met.mapInPandas(run, _SUMS)


def _selected(first: DataFrame) -> DataFrame:
    both = F.explode(F.arrays_zip("tiles", "slopes")).alias("t")
    return first.where(F.col("tiles").isNotNull()).select("slide", "model", both).select("slide", "model", F.col("t.tiles").alias("tile_idx"), F.col("t.slopes").alias("slope"))


def ensemble_gradients(bags: DataFrame, targets: DataFrame, models: list[BagModel]) -> dict[int, tuple[float, int, np.ndarray]]:
    """Summed loss and gradient per model over its training slides, in two passes over the stored bags.

    ``targets`` has (model, slide, label, pos_weight). The first pass sends scores, the second one number per
    selected tile; embeddings stay where they are stored. Task sums meet per model and segment, and what reaches the driver is
    one gradient per model, its size set by the network alone.
    """
    first = cut_lineage(head_pass(bags, targets, models))
    sums = first.where(F.col("grad").isNotNull()).select("model", "part", "seg", "loss", "n", "grad").unionByName(tile_pass(bags, _selected(first), models))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                one = held.setdefault((int(row.model), int(row.part), int(row.seg)), [0.0, 0, 0.0])
                one[0] += row.loss
                one[1] += row.n
                one[2] = one[2] + np.asarray(row.grad)
        yield pd.DataFrame([(*k, *v) for k, v in held.items()], columns=["model", "part", "seg", "loss", "n", "grad"])

    found = sorted((r["model"], r["part"], r["seg"], r["loss"], r["n"], r["grad"]) for r in sums.repartition("model", "part", "seg").mapInPandas(add_up, _SUMS).toLocalIterator())
    out = {}
    for i, rows in groupby(found, key=lambda r: r[0]):
        rows = list(rows)
        out[i] = (sum(r[3] for r in rows), sum(r[4] for r in rows), np.concatenate([np.asarray(r[5]) for r in rows]))
    return out


def train_ensemble(
    bags: DataFrame, train: DataFrame, models: list[BagModel], epochs: int = 30, lr: float = 1e-3, weight_decay: float = 0.0
) -> tuple[list[BagModel], list[float]]:
    """Adam on weighted cross-entropy, all models advancing together; (models, mean loss per epoch).

    ``bags`` comes from ``store_bags``. ``train`` has (repeat, fold, slide, label) of the slides each model may see. The step is over
    the full batch, so an epoch is two Spark jobs and the driver only holds weights.
    """
    keys = F.create_map(*[v for i, m in enumerate(models) for v in (F.lit(f"{m.repeat}:{m.fold}"), F.lit(i))])
    seen = train.withColumn("model", keys[F.concat_ws(":", "repeat", "fold")]).where(F.col("model").isNotNull())
    ratio = seen.groupBy("model").agg(
        (F.count_if(F.col("label") == 0) / F.greatest(F.count_if(F.col("label") == 1), F.lit(1))).alias("pos_weight")
    )
    targets = cut_lineage(seen.join(F.broadcast(ratio), "model").select("model", "slide", "label", "pos_weight"))
    names = [*HEAD_WEIGHTS, *TILE_WEIGHTS]
    moments = {i: (np.zeros(1), np.zeros(1)) for i in range(len(models))}
    history = []
    for step in range(1, epochs + 1):
        sums = ensemble_gradients(bags, targets, models)
        fresh = []
        for i, model in enumerate(models):
            loss, n, flat = sums[i]
            g = flat / n + weight_decay * _pack(model.w, names)
            m = 0.9 * moments[i][0] + 0.1 * g
            v = 0.999 * moments[i][1] + 0.001 * g * g
            moments[i] = (m, v)
            move = lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            fresh.append(BagModel(model.repeat, model.fold, model.n_extreme, _unpack(_pack(model.w, names) - move, model.w, names)))
        models = fresh
        history.append(sum(s[0] for s in sums.values()) / sum(s[1] for s in sums.values()))
    return models, history


def models_frame(spark, models: list[BagModel], val_auc: dict[tuple[int, int], float] | None = None) -> DataFrame:
    """Model table (repeat, fold, n_extreme, val_auc, weights map) for storage and later scoring."""
    rows = [
        (m.repeat, m.fold, m.n_extreme, (val_auc or {}).get((m.repeat, m.fold)), {k: [list(a.shape), a.ravel().tolist()] for k, a in m.w.items()})
        for m in models
    ]
    rows = [(r, f, n, a, {k: {"shape": s, "data": d} for k, (s, d) in w.items()}) for r, f, n, a, w in rows]
    return spark.createDataFrame(
        rows, "repeat int, fold int, n_extreme int, val_auc double, weights map<string,struct<shape:array<int>,data:array<double>>>"
    )


def models_from_frame(df: DataFrame) -> list[BagModel]:
    """Read a model table back; its size is the ensemble's, never the data's."""
    return [
        BagModel(r["repeat"], r["fold"], r["n_extreme"], {k: np.array(v["data"]).reshape(v["shape"]) for k, v in r["weights"].items()})
        for r in df.orderBy("repeat", "fold").collect()
    ]


def train_manifest(models: DataFrame, folds: DataFrame, epochs: int, lr: float) -> DataFrame:
    """One nested record of a training run."""
    sizes = folds.agg(
        F.struct(F.countDistinct("unit").alias("units"), F.max("repeat").alias("r"), F.max("fold").alias("f"))
    ).scalar()
    return models.agg(
        F.count("*").alias("n_models"),
        F.avg("val_auc").alias("mean_val_auc"),
        F.sort_array(F.collect_list(F.struct("repeat", "fold", "n_extreme", "val_auc"))).alias("models"),
    ).withColumn("__s", sizes).select(
        "n_models", F.col("__s.units").alias("n_units"), (F.col("__s.r") + 1).alias("repeats"), (F.col("__s.f") + 1).alias("splits"),
        F.lit(epochs).alias("epochs"), F.lit(lr).alias("lr"), "mean_val_auc", "models",
    )
