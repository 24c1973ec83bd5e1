"""Forecasts: supervised trees for each horizon, with metrics, importances, saved models and serving; and the online learner."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import calendar
from ..plans.scratch import keep, names_in
from .sketch import OnlineForecast
from .stateful import run_batch
from .windows import HORIZONS

SIDE_BY_SIDE = 4
NOT_FEATURES = ("topic", "ts", "seq", "split")


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES and not c.startswith("target_")]


def pipeline(features: list[str], target: str, kind: str = "gbt", trees: int | None = None, depth: int | None = None, seed: int = 0) -> Pipeline:
    """Median imputation and boosted trees ("gbt", 10 trees of depth 4) or a random forest ("rf", 50 trees of depth 8)."""
    filled = [f"{c}__filled" for c in features]
    if kind == "gbt":
        model = GBTRegressor(labelCol=target, maxIter=trees or 10, maxDepth=depth or 4, seed=seed)
    else:
        model = RandomForestRegressor(labelCol=target, numTrees=trees or 50, maxDepth=depth or 8, seed=seed)
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), model])


def train(split: DataFrame, horizons: tuple[int, ...] = HORIZONS, parts: tuple[str, ...] = ("train", "val"), **settings) -> dict[int, PipelineModel]:
    """A model for each horizon, fitted to the rows of the named parts of the split, by default all but the test rows."""
    rows = split.where(F.col("split").isin(*parts))
    names = feature_columns(split)
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in names], *[f"target_H{h}" for h in horizons])
    return {h: pipeline(names, f"target_H{h}", **settings).fit(rows) for h in horizons}


def score(df: DataFrame, models: dict[int, PipelineModel]) -> DataFrame:
    """df with pred_H1.. of the horizons that have a model."""
    names = feature_columns(df)
    df = df.select(*[F.col(c).cast("double").alias(c) if c in names else F.col(c) for c in df.columns])
    for h, m in models.items():
        keep = [*df.columns, F.col("prediction").alias(f"pred_H{h}")]
        df = m.transform(df).select(*keep)
    return df


def for_each_topic(split: DataFrame, run: Callable[[str | None, DataFrame], object]) -> tuple[list, DataFrame]:
    """run(topic, its rows) of topics with training rows, side by side; and the split rows, written down."""
    split = keep(split, "split")
    trained = sorted((r.topic for r in split.where("split <> 'test'").select("topic").distinct().collect()), key=lambda t: (t is not None, t))
    with ThreadPool(SIDE_BY_SIDE) as pool:
        return pool.map(inheritable_thread_target(split.sparkSession)(lambda t: run(t, split.where(F.col("topic").eqNullSafe(F.lit(t))))), trained), split


def report_of_test_rows(split: DataFrame, horizons: tuple[int, ...] = HORIZONS, **settings) -> DataFrame:
    """(topic, horizon, mae, rmse, r2) over each topic's test rows, by models of its own other rows; NULL for topics without any.

    Models of different topics are trained side by side."""

    def predicted(topic: str | None, rows: DataFrame) -> DataFrame:
        scored = score(rows.where("split = 'test'"), train(rows, horizons, **settings))
        return keep(scored.select("topic", *[f"{x}_H{h}" for h in horizons for x in ("target", "pred")]), "predicted")

    parts, split = for_each_topic(split, predicted)
    rest = split.where("split = 'test'").join(split.where("split <> 'test'").select(F.col("topic").alias("_topic")).distinct(), F.col("topic").eqNullSafe(F.col("_topic")), "left_anti")
    scored = rest.select("topic", *[c for h in horizons for c in (f"target_H{h}", F.lit(None).cast("double").alias(f"pred_H{h}"))])
    for part in parts:
        scored = scored.unionByName(part)
    rows = [scored.groupBy("topic").agg(F.lit(h).alias("horizon"), *[c.alias(n) for n, c in metrics(F.col(f"target_H{h}"), F.col(f"pred_H{h}")).items()]) for h in horizons]
    return reduce(DataFrame.unionByName, rows)


MODEL_FILE = re.compile(r"^model_(.+)_H(\d+)_(gbt|rf)$")


def save_models(models: dict[int, PipelineModel], folder: str, target: str, kind: str = "gbt") -> None:
    """Each model under a name that tells its target and horizon."""
    for h, m in models.items():
        m.write().overwrite().save(f"{folder}/model_{target.replace('/', '-')}_H{h}_{kind}")


def scan_models(spark: SparkSession, folder: str, kind: str = "gbt") -> dict[str, dict[int, str]]:
    """Paths of the models in a folder, by target and horizon; names of other forms are left out."""
    found: dict[str, dict[int, str]] = {}
    for name in sorted(names_in(spark, folder)):
        m = MODEL_FILE.match(name)
        if m and m[3] == kind:
            found.setdefault(m[1], {})[int(m[2])] = f"{folder}/{name}"
    return found


def load_models(spark: SparkSession, folder: str, kind: str = "gbt") -> dict[str, dict[int, PipelineModel]]:
    return {t: {h: PipelineModel.load(p) for h, p in paths.items()} for t, paths in scan_models(spark, folder, kind).items()}


def predict(df: DataFrame, models: dict[int, PipelineModel], horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """df with pred_H1.. of all horizons, NULL for those without a model; feature columns that df lacks are NULL to the models."""
    names = sorted({c for m in models.values() for c in m.stages[0].getInputCols()})
    lacking = [c for c in names if c not in df.columns]
    out = score(df.withColumns({c: F.lit(None).cast("double") for c in lacking}), models).drop(*lacking)
    return out.withColumns({f"pred_H{h}": F.lit(None).cast("double") for h in horizons if h not in models})


def save_all(split: DataFrame, folder: str, horizons: tuple[int, ...] = HORIZONS, **settings) -> None:
    """Models of each topic's training and validation rows, saved to the folder."""
    for_each_topic(split, lambda topic, rows: save_models(train(rows, horizons, **settings), folder, str(topic), settings.get("kind", "gbt")))


def serve(df: DataFrame, folder: str, horizons: tuple[int, ...] = HORIZONS, kind: str = "gbt") -> DataFrame:
    """Rows (topic, features) with the predictions of their topic's saved models; NULL for topics without any."""
    models = load_models(df.sparkSession, folder, kind)
    named = F.regexp_replace(F.coalesce("topic", F.lit("None")), "/", "-")
    parts = [predict(df.where(named == t), m, horizons) for t, m in models.items()]
    parts.append(predict(df.where(~named.isin(list(models))), {}, horizons))
    return reduce(DataFrame.unionByName, parts)


def prediction_fields(predictions: DataFrame) -> DataFrame:
    """Predictions named "H+1", "H+2".. as the fields pred_H1, pred_H2..; NULL as NaN, as the store takes them."""
    out = []
    for c in predictions.columns:
        plain = F.col(f"`{c}`")
        out.append(F.coalesce(plain, F.lit(float("nan"))).alias(f"pred_{c.replace('+', '').replace(' ', '_')}") if re.fullmatch(r"H\+\d+", c) else plain.alias(c))
    return predictions.select(*out)


def permutation_importance(model: PipelineModel, rows: DataFrame, target: str, most_rows: int = 1000, repeats: int = 5, top: int = 20, seed: int = 0) -> DataFrame:
    """(feature, importance): how much R2 falls when a feature's values are dealt out anew among the last rows; the largest.

    most_rows: the last rows by time, that many at most."""
    names = model.stages[0].getInputCols()
    by_time = Window.partitionBy(F.lit(0)).orderBy("ts", "seq")
    last = rows.orderBy(F.desc("ts"), F.desc("seq")).limit(most_rows)
    last = keep(last.select(*[F.col(c).cast("double").alias(c) for c in names], F.col(target).alias("_y"), (F.row_number().over(by_time) - 1).alias("_i")), "last")
    turns = last.select("_i", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("_r"))
    turns = turns.withColumn("_j", F.row_number().over(Window.partitionBy("_r").orderBy(F.xxhash64("_i", "_r", F.lit(seed)), "_i")) - 1)
    other = last.select(F.col("_i").alias("_j"), F.struct(*names).alias("_o"))
    dealt = last.join(turns, "_i").join(other, "_j").withColumn("_f", F.explode(F.array(F.lit(""), *map(F.lit, names))))
    dealt = dealt.select("_y", "_r", "_f", *[F.when(F.col("_f") == c, F.col(f"_o.{c}")).otherwise(F.col(c)).alias(c) for c in names])
    scored = model.transform(dealt).groupBy("_f", "_r").agg(metrics(F.col("_y"), F.col("prediction"))["r2"].alias("r2")).groupBy("_f").agg(F.avg("r2").alias("r2"))
    plain = scored.where("_f = ''").select(F.col("r2").alias("_plain"))
    return scored.where("_f <> ''").join(plain).select(F.col("_f").alias("feature"), (F.col("_plain") - F.col("r2")).alias("importance")).orderBy(F.desc("importance"), "feature").limit(top)


def importances_by_topic(split: DataFrame, horizon: int = 1, **settings) -> DataFrame:
    """(topic, feature, importance) of each topic's model, on its last validation rows."""

    def measured(topic: str | None, rows: DataFrame) -> DataFrame:
        model = train(rows, (horizon,), **settings)[horizon]
        return keep(permutation_importance(model, rows.where("split = 'val'"), f"target_H{horizon}").withColumn("topic", F.lit(topic).cast("string")), "importances")

    parts, split = for_each_topic(split, measured)
    none = split.limit(0).select(F.lit("").alias("feature"), F.lit(0.0).alias("importance"), "topic")
    return reduce(DataFrame.unionByName, parts, none).select("topic", "feature", "importance")


def covariates(readings: DataFrame, topics: tuple[str, ...]) -> DataFrame:
    """(ts, {topic}_cur, {topic}_lag1, {topic}_lag3): the topics' values at each of their times, means of equal times."""
    out = None
    for t in topics:
        one = readings.where(F.col("topic") == t).groupBy("ts").agg(F.avg("value").alias("v")).withColumn("topic", F.lit(t))
        w = Window.partitionBy("topic").orderBy("ts")
        one = one.select("ts", F.col("v").alias(f"{t}_cur"), *[F.lag("v", k).over(w).alias(f"{t}_lag{k}") for k in (1, 3)])
        out = one if out is None else out.join(one, "ts", "full")
    return out


def online_inputs(readings: DataFrame, topics: tuple[str, str]) -> tuple[DataFrame, list[str]]:
    """readings with what the online learner takes besides its own lags: the covariates at the row's time, the product of
    their current values, and the calendar. 19 features in all."""
    a, b = topics
    cov = covariates(readings, topics)
    names = [*[f"{t}_{k}" for t in topics for k in ("cur", "lag1", "lag3")], f"{a}_x_{b}", *calendar(F.col("ts"))]
    cov = cov.withColumnRenamed("ts", "_ts")
    joined = readings.join(cov, F.col("ts") == F.col("_ts"), "left").drop("_ts")
    return joined.withColumns({f"{a}_x_{b}": F.col(f"{a}_cur") * F.col(f"{b}_cur")} | calendar(F.col("ts"))), names


def forecast_online(readings: DataFrame, topics: tuple[str, str] = ("t", "rh")) -> DataFrame:
    """readings with online_pred, each topic's prediction of its next reading."""
    inputs, names = online_inputs(readings, topics)
    found = run_batch(inputs, partial(OnlineForecast, len(names)), ["value", *names])
    values = readings.select(F.col("topic").alias("_t"), F.col("ts").alias("_ts"), F.col("seq").alias("_s"), "value")
    same = F.col("topic").eqNullSafe(F.col("_t")) & F.col("ts").eqNullSafe(F.col("_ts")) & F.col("seq").eqNullSafe(F.col("_s"))
    return found.join(values, same).select("topic", "ts", "seq", "value", "online_pred")


def metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    """MAE, RMSE and R2 over rows where both are present."""
    both = actual.isNotNull() & predicted.isNotNull()
    a, e = F.when(both, actual), F.when(both, predicted - actual)
    return {"mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "r2": F.lit(1.0) - F.sum(e * e) / (F.var_pop(a) * F.count(a))}
