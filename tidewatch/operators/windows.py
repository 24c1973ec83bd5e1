"""Row-count windows over readings, per topic in the order of (ts, seq)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import calendar, quartiles, t_below
from ..plans.scratch import keep

ORDER = ("ts", "seq")
BLOCK_ROWS = 1_000_000  # of a topic, above which its rows are cut into blocks
LAGS = (1, 2, 3, 6, 12, 24)
ROLLS = (3, 6, 12)
HORIZONS = (1, 2, 3)


def by_topic() -> WindowSpec:
    return Window.partitionBy("topic").orderBy(*ORDER)


def rows(first: int, last: int) -> WindowSpec:
    return by_topic().rowsBetween(first, last)


def so_far() -> WindowSpec:
    return by_topic().rowsBetween(Window.unboundedPreceding, 0)


def numbered(readings: DataFrame, cells: int | None = None) -> DataFrame:
    """readings with _pos, a row's place in its topic from 0, without a topic's rows in one task.

    Rows are dealt out by sorted ranges, whatever topics they are of, and counted; a row for each range and topic
    tells how many of the topic come before. The ranges are written down, so that a task that runs again finds the same."""
    order = ["topic", *ORDER]
    dealt = readings.repartitionByRange(cells, *order) if cells else readings.repartitionByRange(*order)
    dealt = keep(dealt.withColumn("_cell", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("topic").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("topic", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(F.col("topic").alias("_topic"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("topic", "_cell").orderBy(*ORDER)))
    found = inside.join(starts, F.col("topic").eqNullSafe(F.col("_topic")) & (F.col("_cell") == F.col("_c")))
    return found.withColumn("_pos", F.col("_start") + F.col("_k") - 1).drop("_cell", "_topic", "_c", "_start", "_k")


def in_blocks(readings: DataFrame, fn: Callable[[DataFrame], DataFrame], before: int, after: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """fn(readings), where fn looks at `before` rows before each row of a topic and `after` rows after it at most.

    Topics of more than block_rows rows are cut into blocks of that many, each with the rows around it that fn needs, and fn
    runs over blocks as if they were topics; smaller tables go through fn as they are. Rows keep their other columns."""
    most = readings.groupBy("topic").count().agg(F.max("count")).first()[0] or 0
    if most <= block_rows:
        return fn(readings)
    rows_ = numbered(readings)
    own, place = F.floor(F.col("_pos") / block_rows), F.col("_pos") % block_rows
    blocks = F.array_compact(F.array(own, F.when(place >= block_rows - before, own + 1), F.when((place < after) & (own > 0), own - 1)))
    dealt = rows_.withColumn("_block", F.explode(blocks)).withColumnRenamed("topic", "_topic")
    name = F.concat(F.coalesce(F.concat(F.lit("t"), F.col("_topic")), F.lit("n")), F.lit("#"), F.col("_block").cast("string"))
    out = fn(dealt.withColumn("topic", name))
    out = out.where(F.floor(F.col("_pos") / block_rows) == F.col("_block")).drop("topic", "_pos", "_block")
    return out.withColumnRenamed("_topic", "topic").select("topic", *[c for c in out.columns if c != "_topic"])


def running_sums(readings: DataFrame, values: dict[str, Column], cells: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """readings with the running sum of each value over its topic up to the row, NULLs left out.

    If a topic has more than block_rows rows, sums go in two levels: inside sorted ranges, and over a row for each range and topic."""
    most = readings.groupBy("topic").count().agg(F.max("count")).first()[0] or 0
    if most <= block_rows:
        return readings.withColumns({n: F.coalesce(F.sum(c.cast("double")).over(so_far()), F.lit(0.0)) for n, c in values.items()})
    order = ["topic", *ORDER]
    own = readings.columns
    valued = readings.select(*own, *[c.cast("double").alias(f"_v_{n}") for n, c in values.items()])
    dealt = valued.repartitionByRange(cells, *order) if cells else valued.repartitionByRange(*order)
    dealt = keep(dealt.withColumn("_cell", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("topic").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("topic", "_cell").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    starts = starts.select(F.col("topic").alias("_topic"), F.col("_cell").alias("_c"), *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0.0)).alias(f"_b_{n}") for n in values])
    inside = Window.partitionBy("topic", "_cell").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0.0)) for n in values})
    found = sums.join(starts, F.col("topic").eqNullSafe(F.col("_topic")) & (F.col("_cell") == F.col("_c")))
    return found.select(*own, *[(F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in values])


def sliding_values(size: int = 8) -> Column:
    """The last `size` values up to the row as an array that keeps NULLs; shorter for a topic's first rows."""
    return F.transform(F.collect_list(F.struct("value")).over(rows(1 - size, 0)), lambda s: s["value"])


def lags(column: str = "value", steps: tuple[int, ...] = LAGS) -> dict[str, Column]:
    return {f"{column}_lag{k}": F.lag(column, k).over(by_topic()) for k in steps}


def rolls(column: str = "value", widths: tuple[int, ...] = ROLLS, full: bool = True) -> dict[str, Column]:
    """Mean and sample deviation of the rows before; full: NULL unless the whole width has values."""
    out = {}
    for w in widths:
        frame = rows(-w, -1)
        enough = F.count(column).over(frame) >= (w if full else 1)
        out[f"{column}_rollmean{w}"] = F.when(enough, F.avg(column).over(frame))
        out[f"{column}_rollstd{w}"] = F.when(enough, F.stddev_samp(column).over(frame))
    return out


def targets(column: str = "value", horizons: tuple[int, ...] = HORIZONS) -> dict[str, Column]:
    return {f"target_H{h}": F.lead(column, h).over(by_topic()) for h in horizons}


def features(readings: DataFrame, full: bool = True) -> DataFrame:
    """Lags, rolling statistics and calendar columns; the same for training (full) and serving."""
    return in_blocks(readings, lambda r: r.withColumns(lags() | rolls(full=full) | calendar(F.col("ts"))), max(*LAGS, *ROLLS))


def supervised(readings: DataFrame) -> DataFrame:
    """Features with targets, rows with any NULL left out."""
    made = lambda r: r.withColumns(lags() | rolls() | calendar(F.col("ts")) | targets())
    return in_blocks(readings, made, max(*LAGS, *ROLLS), max(HORIZONS)).na.drop()


def time_split(df: DataFrame, train: float = 0.7, validate: float = 0.15) -> DataFrame:
    """df with split ("train", "val", "test") by position in its topic's time order."""
    n = F.count(F.lit(1)).over(Window.partitionBy("topic"))
    k = F.row_number().over(by_topic())
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(train)) + F.floor(n * F.lit(validate))
    return df.withColumn("split", F.when(k <= a, "train").when(k <= b, "val").otherwise("test"))


def differences(column: str = "value") -> Column:
    """Difference to the row before; 0 for the first row, NULL where either is."""
    first = F.row_number().over(by_topic()) == 1
    return F.when(first & F.col(column).isNotNull(), 0.0).otherwise(F.col(column) - F.lag(column).over(by_topic()))


def centred_impute(width: int = 5) -> Column:
    """The value, or for a missing one the mean of the rows around it."""
    half = width // 2
    return F.coalesce(F.col("value"), F.avg("value").over(rows(-half, half)))


def window_peak(size: int = 6, fence: float = 1.5) -> Column:
    """Whether the value lies outside the fences of its own window: above, or positive and below."""
    values = F.transform(F.collect_list(F.struct("value")).over(rows(1 - size, 0)), lambda s: s["value"])
    v = F.col("value")
    return F.coalesce(quartiles(values, lambda q1, q3: ((v > 0) & (v < q1 - fence * (q3 - q1))) | (v > q3 + fence * (q3 - q1))), F.lit(False))


def rolling_t(column: str, width: int = 50) -> Column:
    """One-sample t of the value against the rows before; NULL without two of them or without spread."""
    frame = rows(-width, -1)
    n, sd = F.count(column).over(frame), F.stddev_samp(column).over(frame)
    return F.when((n >= 2) & (sd > 0), (F.avg(column).over(frame) - F.col(column)) / (sd / F.sqrt(n)))


def t_test(column: str, width: int = 50, alpha: float = 0.01) -> Column:
    """Whether the value is above the mean of the `width` rows before, by a one-sided t test at alpha; all of them must have values."""
    below = t_below(rolling_t(column, width), width - 1)
    return F.coalesce((F.count(column).over(rows(-width, -1)) == width) & (below < alpha), F.lit(False))


def with_running_errors(df: DataFrame, actual: str = "value", predicted: str = "pred", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with ae and se, the row's absolute and squared error, and the running mae, rmse and bias of its topic."""
    e = F.col(predicted) - F.col(actual)
    sums = running_sums(df, {"_ae": F.abs(e), "_se": e * e, "_e": e, "_n": F.when(e.isNotNull(), 1.0)}, block_rows=block_rows)
    n = F.when(F.col("_n") > 0, F.col("_n"))
    return sums.withColumns({"ae": F.abs(e), "se": e * e, "mae": F.col("_ae") / n, "rmse": F.sqrt(F.col("_se") / n), "bias": F.col("_e") / n}).drop("_ae", "_se", "_e", "_n")
