"""Novelty and outlier detectors over the sliding window."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bind, quantile, quartiles
from ..plans.scratch import keep
from .sketch import AnomalyDetector, FencedDigest, GlobalOutlier
from .stateful import run_batch
from .windows import by_topic, in_blocks, rows, sliding_values

KEY = ("topic", "ts", "seq")
FENCE = 1.5
MIN_SAMPLES = 8


def novelty(values: Column) -> Column:
    """First differences of a window with missing values replaced by its median and set missing again.

    The first element is 0 if present; a window without values stays as it is."""
    steps = lambda filled: F.transform(values, lambda x, i: F.when(x.isNull(), F.lit(None).cast("double")).when(i == 0, 0.0).otherwise(x - F.element_at(filled, F.greatest(i, F.lit(1)))))
    return bind(quantile(values, 0.5), lambda middle: bind(F.transform(values, lambda x: F.coalesce(x, middle)), steps))


def outside(value: Column, q1: Column, q3: Column, fence: float = FENCE) -> Column:
    """Strictly outside the fences; False for NULL."""
    reach = fence * (q3 - q1)
    return F.coalesce((value < q1 - reach) | (value > q3 + reach), F.lit(False))


def window_outlier(train: Column, value: Column, fence: float = FENCE) -> Column:
    """Whether value is outside the fences of the array train; a missing training value silences it."""
    return F.when(F.exists(train, lambda x: x.isNull()) | (F.size(train) == 0), False).otherwise(quartiles(train, lambda q1, q3: outside(value, q1, q3, fence)))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row, whatever filters on them come later."""
    made = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(made))


def with_novelty(readings: DataFrame, size: int = 8) -> DataFrame:
    """readings with window_size, the window's novelty array and the row's novelty."""
    values = readings.withColumn("window", sliding_values(size))
    values = once(values, novelties=novelty(F.col("window")))
    return values.withColumns({"window_size": F.size("window"), "novelty": F.element_at("novelties", -1)}).drop("window")


def local_flags(readings: DataFrame, size: int = MIN_SAMPLES, fence: float = FENCE) -> DataFrame:
    """readings with missing and local flags; both are False until a topic has `size` rows."""

    def flagged(rows: DataFrame) -> DataFrame:
        n = with_novelty(rows, size)
        ready = F.col("window_size") >= size
        local = window_outlier(F.slice("novelties", 1, size - 1), F.col("novelty"), fence)
        return once(n, missing=ready & F.col("novelty").isNull(), local=ready & local).drop("novelties", "window_size")

    return in_blocks(readings, flagged, size - 1)


def _detector(estimator: Callable) -> AnomalyDetector:
    return AnomalyDetector(far=estimator())


def detect_anomalies(readings: DataFrame, scope: str = "topic", only_found: bool = True, estimator: Callable = FencedDigest) -> DataFrame:
    """readings (topic, ts, seq, value) with novelty and the flags missing, local and global; by default rows with any flag.

    estimator: makes each topic's global estimator. scope: "topic" for a digest of each topic, "shared" for one digest of all topics' novelties in order of time."""
    if scope not in ("topic", "shared"):
        raise ValueError(scope)
    found = run_batch(readings, partial(_detector, estimator))
    if scope == "shared":
        far = run_batch(found, GlobalOutlier, "novelty", together=True)
        ready = found.withColumn("_ready", F.row_number().over(by_topic()) >= MIN_SAMPLES).drop("global")
        far = far.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("flag").alias("_flag"))
        found = ready.join(far, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]).withColumn("global", F.col("_ready") & F.col("_flag"))
    values = readings.select(*[F.col(c).alias(f"_k_{c}") for c in KEY], "value")
    out = found.join(values, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in KEY]).select(*KEY, "value", "novelty", "missing", "local", "global")
    return out.where("missing or local or global") if only_found else out


def recent_stats(last: int = 6) -> dict[str, Column]:
    """Mean, population deviation, minimum, maximum and count of the last present values; needs rows with values only."""
    w = rows(1 - last, 0)
    return {"recent_mean": F.avg("value").over(w), "recent_std": F.stddev_pop("value").over(w), "recent_min": F.min("value").over(w), "recent_max": F.max("value").over(w), "recent_n": F.count("value").over(w)}


def z_flags(readings: DataFrame, last: int = 6, limit: float = 3.5) -> DataFrame:
    """Present readings with the z score among the last present ones and whether it reaches the limit."""
    r = readings.where("value is not null").withColumns(recent_stats(last))
    z = F.when(F.col("recent_std") > 0, (F.col("value") - F.col("recent_mean")) / F.col("recent_std")).otherwise(0.0)
    return r.withColumn("z", z).withColumn("flag", F.abs("z") >= limit)


def local_outlier_factor(points: DataFrame, k: int, contamination: float, column: str = "value") -> DataFrame:
    """Present points with lof, and whether it is over the topic's quantile 1 - contamination.

    In one dimension the k nearest points are among k on either side in the order of (column, seq); of points equally far
    those nearer in that order come first, then the lower. A topic of k points or fewer has as many neighbours as it has;
    a single point has no factor and is no outlier."""
    order = Window.partitionBy("topic").orderBy(column, "seq")
    around = order.rowsBetween(-k, k)
    p = points.where(F.col(column).isNotNull()).withColumn("_i", F.row_number().over(order))
    p = p.withColumn("_near", F.collect_list(F.struct(F.col(column).alias("v"), F.col("_i").alias("i"))).over(around))
    apart = F.transform(F.filter("_near", lambda q: q["i"] != F.col("_i")), lambda q: F.struct(F.abs(q["v"] - F.col(column)).alias("d"), F.abs(q["i"] - F.col("_i")).alias("gap"), q["i"].alias("i")))
    p = p.withColumn("_near", F.slice(F.array_sort(apart), 1, k))
    at = lambda values, i: F.element_at(values, i - F.greatest(F.col("_i") - k, F.lit(1)) + 1)
    mean = lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / F.size(x))
    p = p.withColumn("_far", F.coalesce(F.array_max(F.transform("_near", lambda q: q["d"])), F.lit(0.0)))
    p = p.withColumn("_fars", F.collect_list("_far").over(around))
    p = p.withColumn("_density", F.coalesce(1 / (mean(F.transform("_near", lambda q: F.greatest(q["d"], at(F.col("_fars"), q["i"])))) + 1e-10), F.lit(0.0)))
    p = p.withColumn("_densities", F.collect_list("_density").over(around))
    p = p.withColumn("lof", mean(F.transform("_near", lambda q: at(F.col("_densities"), q["i"]))) / F.col("_density"))
    p = keep(p.drop("_i", "_near", "_far", "_fars", "_density", "_densities"), "lof")
    limits = p.groupBy("topic").agg(F.percentile("lof", F.lit(1 - contamination)).alias("_limit"))
    p = p.join(limits.withColumnRenamed("topic", "_topic"), F.col("topic").eqNullSafe(F.col("_topic")))
    return p.withColumn("outlier", F.coalesce(F.col("lof") > F.col("_limit"), F.lit(False))).drop("_topic", "_limit")
