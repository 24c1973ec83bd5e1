"""Registered queries of the sensor engine and their DuckDB SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import anomaly as A
from ..operators import forecast as M
from ..operators import sketch as S
from ..operators import windows as W
from ..operators.stateful import Observers, run_batch
from ..sources.readings import from_events, missing_to_null
from ..streaming.store import merged
from .panels import PANELS, panel, panel_sql
from .scratch import new_path

R = "WITH readings AS (SELECT event_id AS seq, ts, event_type AS topic, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS value FROM events)"
T = "PARTITION BY topic ORDER BY ts, seq"
NAMES = {"click": "Clicks", "error": "Errors", "purchase": "Purchases", "signup": "Sign-ups"}

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a function of (readings) with its SQL over the readings CTE."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(from_events(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            ORACLE_SQL[f.__name__] = f"{R} {sql}" if not sql.startswith(",") else R + sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def running(c):
    """Six digits of a running mean; the shift keeps halves from depending on the order of a sum."""
    return F.round(c + F.lit(0.0000001234567), 6)


@query("SELECT seq, topic, value FROM readings")
def readings_null_sentinel(r: DataFrame) -> DataFrame:
    stored = F.coalesce("value", F.lit(-200.0))
    return r.select("seq", "topic", missing_to_null(stored).alias("value"))


@query("SELECT seq, CASE topic WHEN 'click' THEN 'Clicks' WHEN 'error' THEN 'Errors' WHEN 'purchase' THEN 'Purchases' WHEN 'signup' THEN 'Sign-ups' END AS label, CASE topic WHEN 'click' THEN 'Clicks' WHEN 'error' THEN 'Errors' WHEN 'purchase' THEN 'Purchases' WHEN 'signup' THEN 'Sign-ups' ELSE topic END AS label_or_topic FROM readings")
def topic_labels(r: DataFrame) -> DataFrame:
    return r.select("seq", C.label_of(F.col("topic"), NAMES).alias("label"), C.label_of(F.col("topic"), NAMES, F.col("topic")).alias("label_or_topic"))


@query("SELECT seq, topic, CASE WHEN value > 200 THEN 2 WHEN value > 100 THEN 1 ELSE 0 END AS severity, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS missing FROM readings")
def health_status(r: DataFrame) -> DataFrame:
    return r.select("seq", "topic", C.severity(F.col("value") > 200, F.col("value") > 100).alias("severity"), F.col("value").isNull().cast("int").alias("missing"))


NOVELTY = f""", w AS (SELECT topic, ts, seq, value, list(value) OVER ({T} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS win FROM readings),
m AS (SELECT *, len(win) AS n, list_aggregate(list_filter(win, lambda x: x IS NOT NULL), 'median') AS med FROM w),
i AS (SELECT *, list_transform(win, lambda x: coalesce(x, med)) AS imp FROM m),
nov AS (SELECT topic, ts, seq, value, n, list_transform(range(1, n + 1), lambda k: CASE WHEN win[k] IS NULL THEN NULL WHEN k = 1 THEN 0.0 ELSE win[k] - imp[k - 1] END) AS nv FROM i),
flags AS (SELECT *, nv[n] AS novelty, n >= 8 AND nv[n] IS NULL AS missing, list_aggregate(nv[1:7], 'quantile_cont', 0.25) AS q1, list_aggregate(nv[1:7], 'quantile_cont', 0.75) AS q3, len(list_filter(nv[1:7], lambda x: x IS NULL)) AS gaps FROM nov),
loc AS (SELECT topic, ts, seq, value, n, novelty, missing, n >= 8 AND gaps = 0 AND coalesce(novelty < q1 - 1.5 * (q3 - q1) OR novelty > q3 + 1.5 * (q3 - q1), FALSE) AS local FROM flags)"""


@query(NOVELTY + " SELECT e.seq, e.topic, e.value, coalesce(a.local OR a.missing, FALSE) AS anomaly FROM readings e LEFT JOIN (SELECT * FROM loc WHERE local OR missing) a ON e.topic = a.topic AND e.ts = a.ts AND e.seq = a.seq")
def recent_readings_flagged(r: DataFrame) -> DataFrame:
    """Readings with whether any detector fired on them: window, novelty, fences and a left join."""
    found = A.local_flags(r).where("local or missing").select("topic", "ts", "seq", "local", "missing")
    joined = r.join(found, ["topic", "ts", "seq"], "left")
    return joined.select("seq", "topic", "value", F.coalesce(F.col("local") | F.col("missing"), F.lit(False)).alias("anomaly"))


@query(NOVELTY + " SELECT seq, topic, n AS window_size, round(novelty, 6) AS novelty FROM flags")
def novelty_in_window(r: DataFrame) -> DataFrame:
    n = A.with_novelty(r)
    return n.select("seq", "topic", F.col("window_size").cast("long").alias("window_size"), r6("novelty").alias("novelty"))


@query(NOVELTY + " SELECT seq, topic, missing, local FROM loc")
def local_iqr_flags(r: DataFrame) -> DataFrame:
    return A.local_flags(r).select("seq", "topic", "missing", "local")


@query(NOVELTY + f""", g AS (SELECT seq, topic, novelty, quantile_cont(novelty, 0.25) OVER w AS q1, quantile_cont(novelty, 0.75) OVER w AS q3 FROM flags
WINDOW w AS ({T} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT seq, topic, round(q1, 6) AS q1, round(q3, 6) AS q3, coalesce(novelty < q1 - 1.5 * (q3 - q1) OR novelty > q3 + 1.5 * (q3 - q1), FALSE) AS flag FROM g""")
def global_iqr_exact(r: DataFrame) -> DataFrame:
    out = run_batch(A.with_novelty(r), partial(S.GlobalOutlier, None), "novelty")
    return out.select("seq", "topic", r6("q1").alias("q1"), r6("q3").alias("q3"), "flag")


@query()
def anomaly_detector(r: DataFrame) -> DataFrame:
    """All three detectors, the global one by a digest; rows on which any fires."""
    return A.detect_anomalies(r).select("seq", "topic", "value", "missing", "local", "global")


@query(NOVELTY + f""", g AS (SELECT topic, seq, quantile_cont(novelty, 0.25) OVER w AS q1, quantile_cont(novelty, 0.75) OVER w AS q3, novelty FROM flags WINDOW w AS ({T} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
far AS (SELECT topic, seq, coalesce(novelty < q1 - 1.5 * (q3 - q1) OR novelty > q3 + 1.5 * (q3 - q1), FALSE) AS far FROM g)
SELECT loc.seq, loc.topic, loc.value, missing, local, n >= 8 AND far AS global FROM loc JOIN far ON loc.seq = far.seq AND loc.topic = far.topic WHERE missing OR local OR n >= 8 AND far""")
def anomaly_detector_exact(r: DataFrame) -> DataFrame:
    """The same with exact quartiles of all novelties before, which SQL can check; its state is as long as the series."""
    return A.detect_anomalies(r, estimator=S.FencedHistory).select("seq", "topic", "value", "missing", "local", "global")


@query()
def anomaly_detector_shared(r: DataFrame) -> DataFrame:
    """The same with one digest for the novelties of all topics."""
    return A.detect_anomalies(r, "shared").select("seq", "topic", "value", "missing", "local", "global")


def _observed(r: DataFrame) -> dict[str, DataFrame]:
    watchers = Observers()
    watchers.add("anomaly", lambda readings, made: A.detect_anomalies(readings))
    watchers.add("trend", lambda readings, made: run_batch(readings, S.TrendDriver))
    return watchers.run(r)


@query()
def trend_driver(r: DataFrame) -> DataFrame:
    """Exponential statistics, quantiles and trend of each present reading; missing ones are skipped."""
    return _observed(r)["trend"].where("type is not null").drop("ts")


@query()
def trend_driver_with_sentinel(r: DataFrame) -> DataFrame:
    """The same with missing readings taken for the sentinel."""
    return run_batch(r, partial(S.TrendDriver, compat_sentinel=True)).drop("ts")


@query("SELECT topic, seq, ts, value FROM readings QUALIFY row_number() OVER (PARTITION BY topic ORDER BY ts DESC, seq DESC) = 1")
def latest_per_topic(r: DataFrame) -> DataFrame:
    return r.groupBy("topic").agg(F.max_by(F.struct("seq", "ts", "value"), F.struct("ts", "seq")).alias("x")).select("topic", "x.seq", "x.ts", "x.value")


@query("SELECT topic, seq, value FROM readings QUALIFY row_number() OVER (PARTITION BY topic ORDER BY ts DESC, seq DESC) > 1")
def all_but_newest(r: DataFrame) -> DataFrame:
    newest = r.groupBy("topic").agg(F.max(F.struct("ts", "seq")).alias("newest"))
    return r.join(newest, "topic").where(F.struct("ts", "seq") < F.col("newest")).select("topic", "seq", "value")


@query("SELECT topic, arg_max(value, seq) FILTER (WHERE value IS NOT NULL) AS last_value FROM readings GROUP BY topic")
def last_not_null(r: DataFrame) -> DataFrame:
    return r.where("value is not null").groupBy("topic").agg(F.max_by("value", F.struct("ts", "seq")).alias("last_value"))


@query("SELECT seq, topic, value FROM readings WHERE value IS NOT NULL ORDER BY value DESC, seq LIMIT 10")
def top_values(r: DataFrame) -> DataFrame:
    return r.where("value is not null").orderBy(F.desc("value"), "seq").limit(10).select("seq", "topic", "value")


@query(f""", p AS (SELECT *, lag(value) OVER ({T}) AS pred FROM readings)
SELECT seq, topic, round(abs(pred - value) + 0.0000001234567, 6) AS ae, round(avg(abs(pred - value)) OVER w + 0.0000001234567, 6) AS mae, round(sqrt(avg((pred - value) * (pred - value)) OVER w) + 0.0000001234567, 6) AS rmse, round(avg(pred - value) OVER w + 0.0000001234567, 6) AS bias
FROM p WINDOW w AS ({T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def cumulative_error_metrics(r: DataFrame) -> DataFrame:
    p = r.withColumn("pred", F.lag("value").over(W.by_topic()))
    p = W.with_running_errors(p)
    return p.select("seq", "topic", *[running(F.col(c)).alias(c) for c in ("ae", "mae", "rmse", "bias")])


HOURLY = "date_trunc('hour', ts)"


@query(f"SELECT {HOURLY} AS hour, max(CASE WHEN topic = 'click' THEN value END) AS x, max(CASE WHEN topic = 'view' THEN value END) AS y FROM readings GROUP BY 1 HAVING max(CASE WHEN topic = 'click' THEN value END) IS NOT NULL AND max(CASE WHEN topic = 'view' THEN value END) IS NOT NULL")
def pivot_pair_having(r: DataFrame) -> DataFrame:
    x, y = (F.max(F.when(F.col("topic") == t, F.col("value"))) for t in ("click", "view"))
    return r.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(x.alias("x"), y.alias("y")).where("x is not null and y is not null")


@query(f"SELECT {HOURLY} AS hour, round(avg(value) FILTER (WHERE topic = 'click'), 6) AS click, round(avg(value) FILTER (WHERE topic = 'error'), 6) AS error, round(avg(value) FILTER (WHERE topic = 'view'), 6) AS view FROM readings GROUP BY 1")
def hourly_wide(r: DataFrame) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    wide = r.groupBy(hour).pivot("topic", ["click", "error", "view"]).agg(F.avg("value"))
    return wide.select("hour", *[r6(c).alias(c) for c in ("click", "error", "view")])


@query("SELECT topic, count(*) AS n FROM readings WHERE value > 150 GROUP BY topic")
def anomaly_counts(r: DataFrame) -> DataFrame:
    return r.where("value > 150").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT topic) AS topics FROM readings WHERE value > 150")
def anomaly_total(r: DataFrame) -> DataFrame:
    return r.where("value > 150").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("topic").alias("topics"))


@query("SELECT topic, CAST(floor(value / 20) AS BIGINT) AS bucket, count(*) AS n FROM readings WHERE value IS NOT NULL GROUP BY 1, 2")
def value_histogram(r: DataFrame) -> DataFrame:
    return r.where("value is not null").groupBy("topic", F.floor(F.col("value") / 20).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT topic, count(*) AS n, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM readings GROUP BY topic ORDER BY missing DESC")
def missingness(r: DataFrame) -> DataFrame:
    return r.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("value").isNull().cast("double"))).alias("missing")).orderBy(F.desc("missing"))


@query("SELECT topic, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS med, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM readings GROUP BY topic")
def describe_values(r: DataFrame) -> DataFrame:
    q = F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    d = r.groupBy("topic").agg(F.count("value").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("std"), F.min("value").alias("low"), q.alias("q"), F.max("value").alias("high"))
    return d.select("topic", "n", "mean", "std", "low", *[r6(F.element_at("q", i + 1)).alias(c) for i, c in enumerate(("q1", "med", "q3"))], "high")


@query(f"SELECT seq, topic, count(*) OVER w AS size, count(value) OVER w AS present, min(value) OVER w AS low, max(value) OVER w AS high FROM readings WINDOW w AS ({T} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def sliding_window_arrays(r: DataFrame) -> DataFrame:
    w = r.withColumn("w", W.sliding_values(8))
    present = F.filter("w", lambda x: x.isNotNull())
    return w.select("seq", "topic", F.size("w").cast("long").alias("size"), F.size(present).cast("long").alias("present"), F.array_min(present).alias("low"), F.array_max(present).alias("high"))


@query()
def digest_quantiles(r: DataFrame) -> DataFrame:
    return run_batch(r, partial(S.Digest, 0.1))


@query()
def mk_trend(r: DataFrame) -> DataFrame:
    return run_batch(r, S.MannKendall)


@query()
def lossy_ties(r: DataFrame) -> DataFrame:
    return run_batch(r, partial(S.LossyCounting, 0.01, 5.0))


@query("SELECT topic, CAST(floor(value / 5.0) AS BIGINT) AS tie, count(*) AS n FROM readings WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def exact_tie_groups(r: DataFrame) -> DataFrame:
    return r.where("value is not null").groupBy("topic", F.floor(F.col("value") / 5.0).alias("tie")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f""", b AS (SELECT topic, value, k, k // 100 AS block FROM (SELECT topic, value, row_number() OVER ({T}) - 1 AS k FROM readings WHERE value IS NOT NULL))
SELECT a.topic, a.block, count(DISTINCT a.k) AS n, CAST(coalesce(sum(sign(c.value - a.value)), 0) AS BIGINT) AS s FROM b a LEFT JOIN b c ON a.topic = c.topic AND a.block = c.block AND a.k < c.k GROUP BY 1, 2""")
def exact_mk_by_block(r: DataFrame) -> DataFrame:
    """Exact Mann-Kendall S of each 100 readings: a block's values are one short array."""
    k = F.row_number().over(W.by_topic()) - 1
    b = r.where("value is not null").withColumn("k", k).groupBy("topic", F.floor(F.col("k") / 100).alias("block"))
    v = b.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("v"))
    signs = F.transform("v", lambda x, i: F.aggregate(F.slice("v", i + 2, F.size("v")), F.lit(0.0), lambda acc, y: acc + F.signum(y - x)))
    return v.select("topic", "block", F.size("v").cast("long").alias("n"), F.aggregate(signs, F.lit(0.0), lambda a, x: a + x).cast("long").alias("s"))


@query(f""", o AS (SELECT topic, seq, list(value) OVER ({T} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS l, row_number() OVER ({T}) AS n FROM readings WHERE value IS NOT NULL),
e AS (SELECT topic, seq, n, list_reduce(list_prepend(0.0::DOUBLE, l), lambda m, v: 0.7 * m + 0.3 * v) AS m, list_reduce(list_prepend(0.0::DOUBLE, list_transform(l, lambda v: v * v)), lambda m, v: 0.7 * m + 0.3 * v) AS s FROM o)
SELECT seq, topic, round(m + 0.0000001234567, 6) AS mean, round(CASE WHEN n > 1 THEN n * (s - m * m) / (n - 1) ELSE 0 END + 0.00001234, 4) AS variance FROM e""")
def ewma_readings(r: DataFrame) -> DataFrame:
    """Exponential mean and variance at every present reading of a topic."""
    out = run_batch(r.where("value is not null"), partial(S.Ewma, 0.3))
    return out.select("seq", "topic", running(F.col("mean")).alias("mean"), F.round(F.col("variance") + F.lit(0.00001234), 4).alias("variance"))


@query(f"SELECT seq, topic, round(avg(value) OVER w + 0.0000001234567, 6) AS mean, round(coalesce(var_samp(value) OVER w, 0), 4) AS variance FROM readings WHERE value IS NOT NULL WINDOW w AS ({T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def sequential_stats(r: DataFrame) -> DataFrame:
    w = W.so_far()
    return r.where("value is not null").select("seq", "topic", running(F.avg("value").over(w)).alias("mean"), F.round(F.coalesce(F.var_samp("value").over(w), F.lit(0.0)), 4).alias("variance"))


@query(f"SELECT seq, topic, round(CASE WHEN count(*) OVER w = 30 THEN avg(value) OVER w ELSE 0 END, 6) AS mean, round(CASE WHEN count(*) OVER w = 30 THEN var_pop(value) OVER w ELSE 0 END, 4) AS variance FROM readings WHERE value IS NOT NULL WINDOW w AS ({T} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def window_stats_30(r: DataFrame) -> DataFrame:
    w = W.rows(-29, 0)
    full = F.count(F.lit(1)).over(w) == 30
    return r.where("value is not null").select("seq", "topic", r6(F.when(full, F.avg("value").over(w)).otherwise(0.0)).alias("mean"), F.round(F.when(full, F.var_pop("value").over(w)).otherwise(0.0), 4).alias("variance"))


def _roll_sql(full: bool) -> str:
    parts = [f"lag(value, {k}) OVER ({T}) AS value_lag{k}" for k in W.LAGS]
    for w in W.ROLLS:
        frame = f"OVER ({T} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        parts += [f"round(CASE WHEN count(value) {frame} >= {w if full else 1} THEN {f}(value) {frame} END, 6) AS value_roll{n}{w}" for f, n in (("avg", "mean"), ("stddev_samp", "std"))]
    return ", ".join(parts)


FEATURES = [*[f"value_lag{k}" for k in W.LAGS], *[f"value_roll{n}{w}" for w in W.ROLLS for n in ("mean", "std")]]
CALENDAR = "hour(ts) AS hour, isodow(ts) - 1 AS dayofweek, month(ts) AS month, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend"


@query(f"SELECT seq, topic, {_roll_sql(True)} FROM readings")
def lag_roll_features(r: DataFrame) -> DataFrame:
    return W.features(r).select("seq", "topic", *[r6(c).alias(c) for c in FEATURES])


@query(f"SELECT seq, topic, {_roll_sql(False)} FROM readings")
def lag_roll_serving(r: DataFrame) -> DataFrame:
    return W.features(r, full=False).select("seq", "topic", *[r6(c).alias(c) for c in FEATURES])


@query(f"SELECT seq, {CALENDAR} FROM readings")
def calendar_features(r: DataFrame) -> DataFrame:
    return r.select("seq", *[c.cast("long").alias(n) for n, c in C.calendar(F.col("ts")).items()])


SUPERVISED = f""", f AS (SELECT *, {_roll_sql(True)}, lead(value, 1) OVER ({T}) AS t1, lead(value, 2) OVER ({T}) AS t2, lead(value, 3) OVER ({T}) AS t3 FROM readings),
s AS (SELECT * FROM f WHERE {" AND ".join(f"{c} IS NOT NULL" for c in [*FEATURES, "value", "t1", "t2", "t3"])})"""


@query(SUPERVISED + " SELECT seq, topic, value, t1, t2, t3, round(value_rollstd12, 6) AS value_rollstd12 FROM s")
def supervised_rows(r: DataFrame) -> DataFrame:
    return W.supervised(r).select("seq", "topic", "value", *[F.col(f"target_H{h}").alias(f"t{h}") for h in W.HORIZONS], r6("value_rollstd12").alias("value_rollstd12"))


@query(f""", k AS (SELECT seq, topic, row_number() OVER ({T}) AS k, count(*) OVER (PARTITION BY topic) AS n FROM readings)
SELECT topic, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split, count(*) AS n, min(seq) AS first_seq FROM k GROUP BY 1, 2""")
def time_split(r: DataFrame) -> DataFrame:
    return W.time_split(r).groupBy("topic", "split").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


RECENT = f""", p AS (SELECT *, quantile_cont(value, 0.005) OVER w AS lo, quantile_cont(value, 0.995) OVER w AS hi FROM readings WHERE value IS NOT NULL WINDOW w AS ({T} ROWS BETWEEN 4999 PRECEDING AND CURRENT ROW)),
z AS (SELECT seq, topic, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM readings WINDOW w AS ({T} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""


@query(RECENT + " SELECT seq, topic, value < lo OR value > hi AS flag FROM p")
def bounded_quantile_flags(r: DataFrame) -> DataFrame:
    """Present readings outside the quantiles of their topic's last 5,000."""
    out = run_batch(r.where("value is not null"), S.RecentAnomaly).join(r, ["topic", "ts", "seq"])
    return out.select("seq", "topic", ((F.col("value") < F.col("q_low")) | (F.col("value") > F.col("q_high"))).alias("flag"))


@query(RECENT + """ SELECT z.seq, z.topic, CASE WHEN z.value IS NULL OR n < 2 THEN NULL WHEN sd > 0 THEN round((z.value - m) / sd, 6) ELSE 0 END AS z,
coalesce(n >= 2 AND (abs(CASE WHEN sd > 0 THEN (z.value - m) / sd ELSE 0 END) >= 3.5 OR z.value < lo OR z.value > hi), FALSE) AS flag FROM z LEFT JOIN p ON z.seq = p.seq AND z.topic = p.topic""")
def recent_anomalies(r: DataFrame) -> DataFrame:
    """z score among the last six readings or quantiles of the last 5,000 present ones."""
    return run_batch(r, S.RecentAnomaly).select("seq", "topic", r6("z").alias("z"), "flag")


LAST6 = f"FROM readings WHERE value IS NOT NULL WINDOW w AS ({T} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"


@query(f"SELECT seq, topic, round(greatest(least(value * 1.5, greatest(avg(value) OVER w + 3 * stddev_pop(value) OVER w, 1.3 * max(value) OVER w)), least(avg(value) OVER w - 3 * stddev_pop(value) OVER w, min(value) OVER w)), 6) AS clamped {LAST6}")
def recent_band_clamp(r: DataFrame) -> DataFrame:
    s = r.where("value is not null").withColumns(A.recent_stats(6))
    low = F.least(F.col("recent_mean") - 3 * F.col("recent_std"), F.col("recent_min"))
    high = F.greatest(F.col("recent_mean") + 3 * F.col("recent_std"), 1.3 * F.col("recent_max"))
    return s.select("seq", "topic", r6(C.clip(F.col("value") * 1.5, low, high)).alias("clamped"))


@query(f"SELECT seq, topic, round(CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END, 6) AS z, coalesce(abs(CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END) >= 3.5, FALSE) AS flag {LAST6}")
def online_z_flags(r: DataFrame) -> DataFrame:
    return A.z_flags(r).select("seq", "topic", r6("z").alias("z"), "flag")


@query(f"SELECT seq, topic, round(avg(value) OVER (%s ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5 FROM readings WHERE value IS NOT NULL" % T)
def mean_last5(r: DataFrame) -> DataFrame:
    return r.where("value is not null").select("seq", "topic", r6(F.avg("value").over(W.rows(-4, 0))).alias("mean5"))


@query(f"SELECT seq, topic, round(coalesce(value, avg(value) OVER ({T} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), 6) AS value FROM readings")
def centered_impute(r: DataFrame) -> DataFrame:
    return r.select("seq", "topic", r6(W.centred_impute(5)).alias("value"))


@query(f"SELECT seq, topic, round(CASE WHEN row_number() OVER ({T}) = 1 AND value IS NOT NULL THEN 0 ELSE value - lag(value) OVER ({T}) END, 6) AS diff FROM readings")
def first_differences(r: DataFrame) -> DataFrame:
    return r.select("seq", "topic", r6(W.differences()).alias("diff"))


@query(f""", q AS (SELECT seq, topic, value, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3 FROM readings WINDOW w AS ({T} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT seq, topic, coalesce((value > 0 AND value < q1 - 1.5 * (q3 - q1)) OR value > q3 + 1.5 * (q3 - q1), FALSE) AS peak FROM q""")
def archive_peak_flags(r: DataFrame) -> DataFrame:
    return r.select("seq", "topic", W.window_peak().alias("peak"))


@query(f""", d AS (SELECT seq, ts, topic, value - lag(value) OVER ({T}) AS d FROM readings)
SELECT seq, topic, round(CASE WHEN count(d) OVER w >= 2 AND stddev_samp(d) OVER w > 0 THEN (avg(d) OVER w - d) / (stddev_samp(d) OVER w / sqrt(count(d) OVER w)) END, 5) AS t, coalesce(d > avg(d) OVER w, FALSE) AS above
FROM d WINDOW w AS ({T} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)""")
def rolling_tstat(r: DataFrame) -> DataFrame:
    d = r.withColumn("d", F.col("value") - F.lag("value").over(W.by_topic()))
    return d.select("seq", "topic", F.round(W.rolling_t("d", 50), 5).alias("t"), F.coalesce(F.col("d") > F.avg("d").over(W.rows(-50, -1)), F.lit(False)).alias("above"))


@query()
def t_test_flags(r: DataFrame) -> DataFrame:
    """Differences above the mean of the 50 before by a one-sided t test at 0.01."""
    d = r.withColumn("d", F.col("value") - F.lag("value").over(W.by_topic()))
    return d.select("seq", "topic", W.t_test("d").alias("flag"))


@query(", p AS (SELECT seq, topic, CASE WHEN seq % 2 = 0 THEN value END AS a, value * 2 AS b FROM readings WHERE seq % 3 <> 0 UNION ALL SELECT seq, topic, NULL, value FROM readings) SELECT topic, seq, max(a) AS a, min(b) AS b FROM p GROUP BY 1, 2")
def point_merge(r: DataFrame) -> DataFrame:
    """Two writes to one key: for each field the last value written to it."""
    v = F.col("value")
    late = r.where("seq % 3 <> 0").select("topic", "seq", F.when(F.col("seq") % 2 == 0, v).alias("a"), F.lit(None).cast("double").alias("b"), F.lit(2).alias("write_seq"))
    early = r.select("topic", "seq", F.lit(None).cast("double").alias("a"), v.alias("b"), F.lit(1).alias("write_seq"))
    return merged(early.unionByName(late), ["a", "b"], ("topic", "seq"))


LABELS = "SELECT topic, ts FROM readings WHERE value > 180 UNION SELECT topic, ts FROM readings WHERE value < 2"


@query(f"SELECT topic, ts FROM ({LABELS}) x ORDER BY topic, ts")
def label_union(r: DataFrame) -> DataFrame:
    return r.where("value > 180").select("topic", "ts").union(r.where("value < 2").select("topic", "ts")).distinct().orderBy("topic", "ts")


@query(NOVELTY + f", lab AS ({LABELS}), fl AS (SELECT topic, ts FROM loc WHERE local) SELECT count(*) AS labels, count(fl.ts) AS found, round(count(fl.ts) / count(*), 6) AS recall, (SELECT count(*) FROM fl) AS flagged, round(count(fl.ts) / (SELECT count(*) FROM fl), 6) AS exactness FROM lab LEFT JOIN fl ON lab.topic = fl.topic AND lab.ts = fl.ts")
def label_recall(r: DataFrame) -> DataFrame:
    labels = label_union(r).withColumn("labelled", F.lit(1))
    flags = A.local_flags(r).where("local").select("topic", "ts", F.lit(1).alias("flagged"))
    both = labels.join(flags, ["topic", "ts"], "full")
    found = F.coalesce(F.sum(F.col("labelled") * F.col("flagged")), F.lit(0))
    n = F.count("labelled")
    share = lambda of: r6(F.coalesce(F.try_divide(found, of), F.lit(float("nan"))))
    return both.agg(n.alias("labels"), found.alias("found"), share(n).alias("recall"), F.count("flagged").alias("flagged"), share(F.count("flagged")).alias("exactness"))


@query(f""", p AS (SELECT topic, value, lag(value) OVER ({T}) AS pred FROM readings), q AS (SELECT topic, value AS a, pred - value AS e FROM p WHERE value IS NOT NULL AND pred IS NOT NULL)
SELECT topic, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / (var_pop(a) * count(a)), 6) AS r2 FROM q GROUP BY topic""")
def regression_metrics(r: DataFrame) -> DataFrame:
    p = r.withColumn("pred", F.lag("value").over(W.by_topic()))
    return p.groupBy("topic").agg(*[r6(c).alias(n) for n, c in M.metrics(F.col("value"), F.col("pred")).items()])


@query("SELECT seq, topic, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM readings WINDOW w AS (PARTITION BY topic)")
def standardize(r: DataFrame) -> DataFrame:
    stats = r.groupBy("topic").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return r.join(stats, "topic").select("seq", "topic", r6((F.col("value") - F.col("m")) / F.col("s")).alias("z"))


@query(f", h AS (SELECT {HOURLY} AS hour, avg(value) FILTER (WHERE topic = 'click') AS x, avg(value) FILTER (WHERE topic = 'view') AS y FROM readings GROUP BY 1) SELECT round(corr(y, x), 6) AS r, round(regr_slope(y, x), 6) AS slope, count(*) AS n FROM h WHERE x IS NOT NULL AND y IS NOT NULL")
def pair_correlation(r: DataFrame) -> DataFrame:
    wide = hourly_wide_exact(r).where("x is not null and y is not null")
    return wide.agg(r6(F.corr("y", "x")).alias("r"), r6(F.regr_slope("y", "x")).alias("slope"), F.count(F.lit(1)).alias("n"))


def hourly_wide_exact(r: DataFrame) -> DataFrame:
    x, y = (F.avg(F.when(F.col("topic") == t, F.col("value"))) for t in ("click", "view"))
    return r.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(x.alias("x"), y.alias("y"))


@query("SELECT x, y, x * 10 + y AS cell FROM range(0, 24) a(x) CROSS JOIN range(0, 10) b(y)")
def contour_grid(r: DataFrame) -> DataFrame:
    """A fixed grid of points, from two sequences of known length."""
    g = r.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    return g.withColumn("cell", F.col("x") * 10 + F.col("y"))


@query("SELECT seq, topic, value FROM readings WHERE year(ts) >= 2004 AND hour(ts) >= 6 AND hour(ts) < 10 AND value IS NOT NULL")
def rush_hours(r: DataFrame) -> DataFrame:
    return r.where((F.year("ts") >= 2004) & (F.hour("ts") >= 6) & (F.hour("ts") < 10)).na.drop(subset=["value"]).select("seq", "topic", "value")


LOF_K = 5


@query(f""", s AS (SELECT hour(ts) AS h, round(avg(value), 9) AS v, min(seq) AS id FROM readings WHERE topic = 'click' AND value IS NOT NULL GROUP BY 1),
d AS (SELECT a.id AS a, b.id AS b, abs(a.v - b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.v - b.v), b.id) AS k FROM s a JOIN s b ON a.id <> b.id),
n AS (SELECT * FROM d WHERE k <= {LOF_K}), kd AS (SELECT a, max(d) AS kd FROM n GROUP BY a),
lrd AS (SELECT n.a, 1 / avg(greatest(n.d, kd.kd)) AS lrd FROM n JOIN kd ON n.b = kd.a GROUP BY n.a)
SELECT n.a AS id, round(avg(o.lrd) / max(x.lrd), 5) AS lof FROM n JOIN lrd o ON n.b = o.a JOIN lrd x ON n.a = x.a GROUP BY n.a""")
def lof_scores(r: DataFrame) -> DataFrame:
    """Local outlier factor of the 24 mean values by hour of the day: the neighbours are among 24 points whatever the input."""
    s = r.where("topic = 'click' and value is not null").groupBy(F.hour("ts").alias("h")).agg(F.round(F.avg("value"), 9).alias("v"), F.min("seq").alias("id"))
    points = s.agg(F.collect_list(F.struct("id", "v")).alias("p"))
    near = points.select(F.explode("p").alias("x"), "p").select(F.col("x.id").alias("a"), F.explode(F.slice(F.array_sort(F.transform(F.filter("p", lambda q: q["id"] != F.col("x.id")), lambda q: F.struct(F.abs(q["v"] - F.col("x.v")).alias("d"), q["id"].alias("b")))), 1, LOF_K)).alias("n")).select("a", "n.b", "n.d")
    reach = near.groupBy("a").agg(F.max("d").alias("kd"))
    lrd = near.join(reach.withColumnRenamed("a", "b"), "b").groupBy("a").agg((1 / F.avg(F.greatest("d", "kd"))).alias("lrd"))
    other = lrd.select(F.col("a").alias("b"), F.col("lrd").alias("o"))
    return near.join(other, "b").join(lrd, "a").groupBy(F.col("a").alias("id")).agg(F.round(F.avg("o") / F.max("lrd"), 5).alias("lof"))


@query()
def lof_outliers(r: DataFrame) -> DataFrame:
    """Local outlier factors and labels of every topic's present readings and of their differences; lof_scores is a small case that SQL can check."""
    d = r.withColumn("value", W.differences())
    found = [A.local_outlier_factor(x, k, c).withColumn("series", F.lit(n)) for n, x, k, c in (("value", r, 15, 0.075), ("difference", d, 20, 0.05))]
    return found[0].unionByName(found[1]).select("seq", "topic", "series", "value", "lof", "outlier")


def hourly(r: DataFrame) -> DataFrame:
    """Readings by the hour: the mean of each topic, all at the same times, as the sensors of a station are."""
    hour = F.date_trunc("hour", "ts")
    return r.groupBy("topic", hour.alias("ts")).agg(F.avg("value").alias("value")).withColumn("seq", F.unix_seconds(F.col("ts").cast("timestamp")))


@query()
def online_forecast(r: DataFrame) -> DataFrame:
    """Errors of the online learner on hourly readings, with two topics as covariates of all, each prediction against the next reading."""
    p = M.forecast_online(hourly(r), ("click", "view"))
    p = p.withColumn("pred", F.lag("online_pred").over(W.by_topic()))
    return p.groupBy("topic").agg(*[c.alias(n) for n, c in M.metrics(F.col("value"), F.col("pred")).items()])


@query()
def gbt_forecast(r: DataFrame) -> DataFrame:
    """Test metrics of the boosted trees for each topic and horizon."""
    return M.report_of_test_rows(W.time_split(W.supervised(r)))


@query()
def forest_forecast(r: DataFrame) -> DataFrame:
    """Test metrics of random forests for each topic and horizon."""
    return M.report_of_test_rows(W.time_split(W.supervised(r)), kind="rf")


@query()
def offline_serving(r: DataFrame) -> DataFrame:
    """Predictions of each topic's newest reading by models that were saved to files, found there and loaded."""
    folder = new_path(r.sparkSession, "models")
    M.save_all(W.time_split(W.supervised(r)), folder)
    newest = W.features(r, full=False).join(r.groupBy("topic").agg(F.max(F.struct("ts", "seq")).alias("_newest")), "topic").where(F.struct("ts", "seq") == F.col("_newest"))
    return M.serve(newest.drop("_newest"), folder).select("topic", "seq", *[f"pred_H{h}" for h in W.HORIZONS])


@query()
def permutation_importances(r: DataFrame) -> DataFrame:
    """The features whose permutation costs each topic's model of the next reading most."""
    return M.importances_by_topic(W.time_split(W.supervised(r)), horizon=1)


@query("SELECT CAST(h AS TIMESTAMP) AS hour, coalesce(n, 0) AS n, strftime(h, '%Y-%m-%d %H:%M') AS label, strftime(h + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day FROM (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS h FROM readings) a LEFT JOIN (SELECT date_trunc('hour', ts) AS t, count(*) AS n FROM readings GROUP BY 1) b ON a.h = b.t")
def hourly_counts(r: DataFrame) -> DataFrame:
    """Readings in each hour from the first to the last, hours without any too."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    ends = r.agg(F.min(hour).alias("a"), F.max(hour).alias("b"))
    hours = C.hourly_range(ends, F.col("a"), F.col("b"), "hour").select("hour")
    counts = r.groupBy(hour.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    found = hours.join(counts, F.col("hour") == F.col("t"), "left")
    return found.select("hour", F.coalesce("n", F.lit(0)).alias("n"), C.formatted(F.col("hour"), "yyyy-MM-dd HH:mm").alias("label"), C.formatted(C.shifted(F.col("hour"), days=1), "yyyy-MM-dd").alias("next_day"))


@query(f"SELECT {HOURLY} AS hour, max(value) FILTER (WHERE topic = 'click') AS sensor_click, max(value) FILTER (WHERE topic = 'error') AS sensor_error, max(value) FILTER (WHERE topic = 'view') AS sensor_view FROM readings GROUP BY 1")
def frames_by_topic(r: DataFrame) -> DataFrame:
    """A column for each topic, renamed by a pattern."""
    h = r.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return C.renamed_by_regex(C.partitioned_by_values(h, "hour", "topic", "value", ["click", "error", "view"]), "^(?!hour$)", "sensor_")


@query("SELECT seq, topic, value AS number FROM readings")
def json_numbers(r: DataFrame) -> DataFrame:
    """Values that come as JSON text of a bare number."""
    return r.select("seq", "topic", C.bare_number(F.to_json(F.struct("value")).substr(F.lit(10), F.length(F.to_json(F.struct("value"))) - 10)).alias("number"))


for _name in PANELS:
    QUERIES[f"panel_{_name}"] = lambda spark, sf_dir, _name=_name: panel(spark, sf_dir, _name)
    ORACLE_SQL[f"panel_{_name}"] = panel_sql(_name)

__all__ = ["ORACLE_SQL", "QUERIES"]
