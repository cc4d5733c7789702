"""Shared models over the pooled frame: weighted boosted regression plus a zero gate.

Models over at most ``ROWS_PER_TASK`` rows are fitted side by side, each in a task of its own, by the rules of ``pyspark.ml``'s
boosted trees (``level_trees``): with so few rows ``pyspark.ml`` mostly waits for its jobs, one for each level of each tree.
Fits over more rows run on ``pyspark.ml``, so the rows of all series stay
distributed. One frame per feature holds the feature vector and the targets of all horizons and is kept in
memory while its models are fitted; a model reads one target of it. ``pyspark.ml`` stops without patience, so the number
of rounds is chosen afterwards, from the validation losses of all prefixes of a fitted ensemble.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from barcast.config import MIN_POOLED_TRAIN_ROWS, MIN_POOLED_VAL_ROWS, Params
from barcast.functions.measures import denormalised, gated, is_nonzero, magnitude_weight, normalised
from barcast.functions.scoring import smape
from barcast.operators.level_trees import Settings, boosted, probability
from barcast.operators.pooled import pooled_supervised
from barcast.operators.stats import train_stats
from barcast.session import shared_root, staged

# The learner settings that results are specified with, in terms
# of depth-limited trees (2^5 leaves).
LEARNING_RATE = 0.05
_TREES = dict(featuresCol="x", maxDepth=5, maxBins=255, stepSize=LEARNING_RATE, minInstancesPerNode=20, seed=42, maxMemoryInMB=512, checkpointInterval=5)
_LEVELS = Settings(rate=LEARNING_RATE, depth=_TREES["maxDepth"], bins=_TREES["maxBins"], least_rows=_TREES["minInstancesPerNode"])
ROWS_PER_TASK = 200_000
MAX_PARALLEL = 32  # models fitted at a time, at most

RESULT = "feature string, horizon int, sMAPE double, sMAPE_gated double, rounds int, gate_rounds int"
_SCORED = "feature string, horizon int, y double, mean double, std double, pred_norm double, chance double, rounds int, gate_rounds int"


def best_prefix(losses: list[float], patience: int) -> tuple[int, bool]:
    """Rounds up to the best loss, and whether ``patience`` rounds without a better one ended the search."""
    best = 0
    for at, loss in enumerate(losses):
        if at == 0 or loss < losses[best]:
            best = at
        elif at - best >= patience:
            return best + 1, True
    return best + 1, False


@dataclass(frozen=True)
class Fitted:
    model: object
    rounds: int
    losses: list[float]


def first_rounds(model: GBTRegressionModel | GBTClassificationModel, rounds: int) -> GBTRegressionModel | GBTClassificationModel:
    """The ensemble of the first ``rounds`` trees, which is what a fit of so many rounds gives."""
    if rounds >= model.getNumTrees:
        return model
    gateway, whole = SparkSession.active().sparkContext._gateway, model._java_obj
    package = gateway.jvm.org.apache.spark.ml
    trees, weights = gateway.new_array(package.regression.DecisionTreeRegressionModel, rounds), gateway.new_array(gateway.jvm.double, rounds)
    all_trees = whole.trees()
    for i, weight in enumerate(model.treeWeights[:rounds]):
        trees[i], weights[i] = all_trees[i], weight
    made = package.classification.GBTClassificationModel if isinstance(model, GBTClassificationModel) else package.regression.GBTRegressionModel
    short = made(whole.uid(), trees, weights)
    # the rest of the settings stays as in the whole ensemble
    return type(model)(whole.copyValues(short, package.param.ParamMap()))


def fitted(learner: GBTRegressor | GBTClassifier, train: DataFrame, val: DataFrame, rounds: int, patience: int) -> Fitted:
    """The ensemble of the best number of rounds up to ``rounds``.

    Rounds do not depend on later ones. So a short ensemble, a little longer than
    ``patience``, is tried first, then longer ones; one is enough if its best prefix lies ``patience`` rounds before its end.
    The best prefix is cut out of it, not fitted once more.
    """
    loss = ["squared"] if isinstance(learner, GBTRegressor) else []
    tried = min(rounds, patience + patience // 4)
    while True:
        model = learner.copy({learner.maxIter: tried}).fit(train)
        losses = model.evaluateEachIteration(val, *loss)
        best, ended = best_prefix(losses, patience)
        if ended or tried == rounds:
            break
        tried = min(rounds, 2 * tried)
    return Fitted(first_rounds(model, best), best, losses)


def _with_stats(frame: DataFrame, stats: DataFrame, params: Params) -> DataFrame:
    """``frame`` with the mean and spread of every feature of its series, by one join."""
    wide = stats.groupBy("asset").agg(
        *[F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{c}_{f}") for f in params.features for c in ("mean", "std")]
    )
    return frame.join(wide, "asset")


def _target(feature: str, h: int) -> tuple[Column, Column, Column]:
    """Target in own units, the same through normalising and back, and its row weight."""
    mean, std = F.col(f"mean_{feature}"), F.col(f"std_{feature}")
    norm = normalised(F.col(f"y_{feature}_{h}"), mean, std)
    return norm, denormalised(norm, mean, std), magnitude_weight(norm)


def pooled_rows(frame: DataFrame, stats: DataFrame, params: Params) -> DataFrame:
    """(feature, horizon, n_train, n_val, n_nonzero, sum_weight): what each shared model is fitted on.

    Rows without a target don't count. ``n_nonzero`` and ``sum_weight`` are over
    the training rows. All models come from one aggregation of the stored frame.
    """
    in_train, in_val = F.col("split") == "train", F.col("split") == "val"
    found, rows = [], []
    for f in params.features:
        for h in params.horizons:
            norm, back, weight = _target(f, h)
            columns = {
                "n_train": F.count(F.when(in_train, norm)),
                "n_val": F.count(F.when(in_val, norm)),
                "n_nonzero": F.coalesce(F.sum(F.when(in_train, is_nonzero(back))), F.lit(0)),
                "sum_weight": F.coalesce(F.sum(F.when(in_train, weight)), F.lit(0.0)),
            }
            found += [c.alias(f"{name}_{f}_{h}") for name, c in columns.items()]
            rows.append(F.struct(F.lit(f).alias("feature"), F.lit(h).alias("horizon"), *[F.col(f"{name}_{f}_{h}").alias(name) for name in columns]))
    return _with_stats(frame, stats, params).agg(*found).select(F.inline(F.array(*rows)))


def feature_rows(frame: DataFrame, stats: DataFrame, params: Params, feature: str, *keys: str) -> DataFrame:
    """(keys, split, x, mean, std, y_1..y_H): inputs in units of the target feature's own series, targets of all horizons."""
    mean, std = F.col(f"mean_{feature}"), F.col(f"std_{feature}")
    lags = {f"f_lag{k}": F.col(f"f_lag{k}" if params.lag_source == "last" else f"{feature}_lag{k}") for k in params.lags}
    rows = _with_stats(frame, stats, params).withColumns({name: normalised(c, mean, std) for name, c in lags.items()})
    inputs = VectorAssembler(inputCols=[*lags, "hour", "dow", "asset_code"], outputCol="x").transform(rows)
    targets = [F.col(f"y_{feature}_{h}").alias(f"y_{h}") for h in params.horizons]
    return inputs.select(*keys, "split", "x", mean.alias("mean"), std.alias("std"), *targets)


def _model_rows(rows: DataFrame, y: Column, *keys: str) -> DataFrame:
    mean, std = F.col("mean"), F.col("std")
    norm = normalised(y, mean, std)
    return rows.where(y.isNotNull()).select(
        *keys, "split", "x", "mean", "std", y.alias("y"), norm.alias("y_norm"),
        magnitude_weight(norm).alias("weight"),
        is_nonzero(denormalised(norm, mean, std)).cast("double").alias("nonzero"),
    )


def score_one(rows: DataFrame, size: Row, params: Params) -> tuple:
    """One row of the result: ``rows`` are the feature's, ``size`` its row of ``pooled_rows``."""
    mine = _model_rows(rows, F.col(f"y_{size['horizon']}"))
    train, val = mine.where("split = 'train'"), mine.where("split = 'val'")
    learner = GBTRegressor(labelCol="y_norm", weightCol="weight", predictionCol="pred_norm", **_TREES)
    regression = fitted(learner, train, val, params.pooled_rounds, params.patience)
    scored, gate_rounds = regression.model.transform(val), 0
    if 0 < size["n_nonzero"] < size["n_train"]:
        gate = fitted(GBTClassifier(labelCol="nonzero", **_TREES), train, val, params.pooled_gate_rounds, params.patience)
        scored, gate_rounds = gate.model.transform(scored), gate.rounds
        chance = vector_to_array("probability")[1]
    else:
        chance = F.lit(float(size["n_nonzero"] > 0))
    pred = denormalised(F.col("pred_norm"), F.col("mean"), F.col("std"))
    found = scored.agg(smape(F.col("y"), pred).alias("open"), smape(F.col("y"), gated(pred, chance)).alias("gated")).first()
    return size["feature"], size["horizon"], found["open"], found["gated"], regression.rounds, gate_rounds


def _fit_group(params: Params):
    def fit(rows: pa.Table) -> pa.Table:
        column = {name: rows[name].to_numpy() for name in ("place", "in_val", "y", "mean", "std", "y_norm", "weight", "nonzero")}
        x = rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        # training rows first, in the order of the stored frame: sums depend on it in their last digits, and equal splits on those
        order = np.lexsort((column["place"], column["in_val"]))
        x, column = x[order], {name: values[order] for name, values in column.items()}
        train = int((~column["in_val"]).sum())
        pred, rounds = boosted(x, column["y_norm"], column["weight"], train, _LEVELS, params.pooled_rounds, params.patience)
        nonzero, gate_rounds = column["nonzero"], 0
        n_nonzero = nonzero[:train].sum()
        chance = np.full(len(pred), float(n_nonzero > 0))
        if 0 < n_nonzero < train:
            margin, gate_rounds = boosted(x, nonzero, np.ones(len(x)), train, _LEVELS, params.pooled_gate_rounds, params.patience, classes=True)
            chance = probability(margin)
        out = {name: pa.repeat(rows[name][0], len(pred)) for name in ("feature", "horizon")}
        out |= {name: column[name][train:] for name in ("y", "mean", "std")} | {"pred_norm": pred, "chance": chance}
        return pa.table(out | {"rounds": np.full(len(pred), rounds, np.int32), "gate_rounds": np.full(len(pred), gate_rounds, np.int32)})

    return fit


def score_in_tasks(frame: DataFrame, stats: DataFrame, sizes: list[Row], params: Params, tasks: int) -> list[tuple]:
    """Rows of the result, one for each of ``sizes``: the rows of a model meet in one of ``tasks`` tasks, which fits it."""
    frame, parts = frame.withColumn("place", F.monotonically_increasing_id()), []
    for f in dict.fromkeys(r["feature"] for r in sizes):
        targets = [F.struct(F.lit(r["horizon"]).alias("horizon"), F.col(f"y_{r['horizon']}").alias("y")) for r in sizes if r["feature"] == f]
        rows = feature_rows(frame, stats, params, f, "place").where(F.col("split").isin("train", "val"))
        long = rows.select(F.lit(f).alias("feature"), "place", "split", vector_to_array("x").alias("x"), "mean", "std", F.inline(F.array(*targets)))
        parts.append(_model_rows(long, F.col("y"), "feature", "horizon", "place"))
    rows = reduce(DataFrame.unionByName, parts).withColumn("in_val", F.col("split") == "val").drop("split")
    scored = rows.repartition(tasks, "feature", "horizon").groupBy("feature", "horizon").applyInArrow(_fit_group(params), _SCORED)
    pred = denormalised(F.col("pred_norm"), F.col("mean"), F.col("std"))
    found = scored.groupBy("feature", "horizon").agg(
        smape(F.col("y"), pred).alias("open"),
        smape(F.col("y"), gated(pred, F.col("chance"))).alias("gated"),
        F.max("rounds").alias("rounds"),
        F.max("gate_rounds").alias("gate_rounds"),
    )
    by_model = {(r["feature"], r["horizon"]): tuple(r) for r in found.collect()}  # one row per model
    return [by_model[r["feature"], r["horizon"]] for r in sizes]


def pooled_eval(
    bars: DataFrame,
    params: Params,
    features: tuple[str, ...] | None = None,
    horizons: list[int] | None = None,
    parallelism: int | None = None,
) -> DataFrame:
    """Score one shared model per feature and horizon on the validation part.

    ``features`` and ``horizons`` choose which models to fit; all by default.
    The frame holds every series in any case. Models with too few rows are left out; without any there
    is an error. ``parallelism`` is the number of models fitted at a time; by default as
    many as there are cores, or as it takes for the tasks of a long frame to fill the session's cores.
    """
    spark = bars.sparkSession
    shared_root(spark)  # long boosting chains are cut in the shared folder
    frame = pooled_supervised(bars, params)
    stats = staged(train_stats(frame.where(F.col("split") == "train"), params), "pooled_stats")
    wanted = {(f, h) for f in features or params.features for h in horizons or params.horizons}
    # at most features x horizons rows
    sizes = [r for r in pooled_rows(frame, stats, params).collect() if (r["feature"], r["horizon"]) in wanted]
    enough = [r for r in sizes if r["n_train"] >= MIN_POOLED_TRAIN_ROWS and r["n_val"] >= MIN_POOLED_VAL_ROWS]
    if not enough:
        raise ValueError("no feature and horizon has enough pooled rows")
    tasks = ceil(max(r["n_train"] + r["n_val"] for r in enough) / ROWS_PER_TASK)
    if tasks == 1:
        # more tasks than models, so that few models share one
        return spark.createDataFrame(score_in_tasks(frame, stats, enough, params, parallelism or 4 * len(enough)), RESULT)
    # a small job waits for its scheduling most of the time, so more of them run at once than there are cores
    at_once = parallelism or min(MAX_PARALLEL, max(1, 4 * spark.sparkContext.defaultParallelism // tasks))
    names = list(dict.fromkeys(r["feature"] for r in enough))
    together = max(1, at_once // len(params.horizons))  # features whose rows are held at a time
    done: list[tuple] = []
    for at in range(0, len(names), together):
        held = {f: feature_rows(frame, stats, params, f).repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK) for f in names[at : at + together]}
        for rows in held.values():
            rows.count()  # filled once, before its models run side by side
        with ThreadPoolExecutor(at_once) as pool:
            done += pool.map(lambda size: score_one(held[size["feature"]], size, params), [r for r in enough if r["feature"] in held])
        for rows in held.values():
            rows.unpersist()
    return spark.createDataFrame(done, RESULT)
