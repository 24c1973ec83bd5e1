"""The dashboards' panel queries as SQL over measurement views, with :topic, :from and :to as parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming.store import query

# Measurements as views over events: a topic for each event type, every 97th reading the sentinel, simple
# forecasts and flags that both Spark and DuckDB compute alike.
MEASUREMENTS = {
    "environment": """
        SELECT event_type AS topic, ts AS time, event_id AS seq, CASE WHEN event_id % 97 = 0 THEN -200e0 ELSE value END AS value,
               lag(value, 1) OVER w AS pred_h1, lag(value, 2) OVER w AS pred_h2, lag(value, 3) OVER w AS pred_h3,
               (lag(value, 1) OVER w + lag(value, 2) OVER w) / 2 AS online_pred
        FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
    "anomaly": """
        SELECT topic, time, seq, value, CASE WHEN value = -200 THEN 1e0 ELSE 0e0 END AS missing,
               CASE WHEN value <> -200 AND abs(value - pred_h1) > 120 THEN 1e0 ELSE 0e0 END AS local,
               CASE WHEN value > 200 THEN 1e0 ELSE 0e0 END AS global
        FROM environment WHERE value = -200 OR abs(value - pred_h1) > 120 OR value > 200""",
    "trend": """
        SELECT topic, time, seq, value, value - pred_h3 AS s, CASE WHEN value - pred_h3 > 60 THEN 1e0 WHEN value - pred_h3 < -60 THEN -1e0 ELSE 0e0 END AS type
        FROM environment""",
    "moving_statistics": """
        SELECT topic, time, seq, avg(value) OVER w AS mean, var_pop(value) OVER w AS variance
        FROM environment WINDOW w AS (PARTITION BY topic ORDER BY time, seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "quantiles": """
        SELECT topic, time, seq, min(value) OVER w AS low, max(value) OVER w AS high, avg(value) OVER w AS middle
        FROM environment WINDOW w AS (PARTITION BY topic ORDER BY time, seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""",
}

LABEL = "CASE topic WHEN 'click' THEN 'Clicks' WHEN 'error' THEN 'Errors' WHEN 'purchase' THEN 'Purchases' WHEN 'signup' THEN 'Sign-ups' WHEN 'view' THEN 'Views'"
SELECTED = "topic = :topic AND time >= :from AND time <= :to"


def _rounded(x: str) -> str:
    """Six digits; the shift keeps halves from depending on the order of a sum."""
    return f"round({x} + 0.0000001234567, 6)"


def _errors(column: str, null_safe: bool = False) -> str:
    value = "nullif(value, -200)" if null_safe else "value"
    e = f"({column} - {value})"
    return f"""SELECT seq, time, {_rounded(f'abs{e}')} AS ae, {_rounded(f'power({e}, 2)')} AS se,
               {_rounded(f'avg(abs{e}) OVER w')} AS mae, {_rounded(f'sqrt(avg(power({e}, 2)) OVER w)')} AS rmse, {_rounded(f'avg({e}) OVER w')} AS bias
        FROM environment WHERE {SELECTED} AND {column} IS NOT NULL
        WINDOW w AS (PARTITION BY topic ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


PANELS = {
    "system_overview": f"SELECT seq, time, value, {LABEL} END AS sensor FROM environment WHERE time >= :from AND time <= :to",
    "anomalies_by_sensor": f"SELECT {LABEL} ELSE topic END AS sensor, count(*) AS n FROM anomaly WHERE (global = 1 OR local = 1) AND time >= :from AND time <= :to GROUP BY 1",
    "anomaly_matrix": "SELECT seq, time, topic, global, local, missing FROM anomaly WHERE time >= :from AND time <= :to",
    "global_trends": f"SELECT seq, time, topic, {_rounded('mean')} AS mean FROM moving_statistics WHERE time >= :from AND time <= :to",
    "pair_overlay": "SELECT coalesce(a.time, b.time) AS time, a.value AS clicks, b.value AS views FROM (SELECT date_trunc('hour', time) AS time, max(value) AS value FROM environment WHERE topic = 'click' GROUP BY 1) a FULL JOIN (SELECT date_trunc('hour', time) AS time, max(value) AS value FROM environment WHERE topic = 'view' GROUP BY 1) b ON a.time = b.time",
    "pair_relationship": "SELECT date_trunc('hour', time) AS hour, max(CASE WHEN topic = 'click' THEN value END) AS x, max(CASE WHEN topic = 'view' THEN value END) AS y FROM environment WHERE value <> -200 GROUP BY 1 HAVING max(CASE WHEN topic = 'click' THEN value END) IS NOT NULL AND max(CASE WHEN topic = 'view' THEN value END) IS NOT NULL",
    "sensor_readings": f"SELECT seq, time, CASE WHEN value = -200 THEN NULL ELSE value END AS value FROM environment WHERE {SELECTED}",
    "anomaly_overlay": f"SELECT seq, time, CASE WHEN value = -200 THEN NULL ELSE value END AS anomaly FROM anomaly WHERE {SELECTED}",
    "missing_markers": f"SELECT seq, time, TRUE AS missing_value FROM anomaly WHERE {SELECTED} AND missing = 1",
    "global_markers": f"SELECT seq, time, CASE WHEN value = -200 THEN NULL ELSE value END AS global_anomaly FROM anomaly WHERE {SELECTED} AND global = 1",
    "local_markers": f"SELECT seq, time, CASE WHEN value = -200 THEN NULL ELSE value END AS local_anomaly FROM anomaly WHERE {SELECTED} AND local = 1",
    "total_abnormalities": f"SELECT count(*) AS n FROM anomaly WHERE {SELECTED}",
    "recent_anomalies": f"SELECT seq, time, value, missing, local, global FROM anomaly WHERE {SELECTED} ORDER BY time DESC, seq DESC",
    "performance_online": _errors("online_pred"),
    "performance_h1": _errors("pred_h1"),
    "performance_h2": _errors("pred_h2"),
    "performance_h3": _errors("pred_h3"),
    "performance_online_null_safe": _errors("online_pred", True),
    "prediction_history": f"SELECT seq, time, CASE WHEN value = -200 THEN NULL ELSE value END AS value, pred_h1, pred_h2, pred_h3, online_pred FROM environment WHERE {SELECTED}",
    "online_history": f"SELECT seq, time, CASE WHEN value = -200 THEN NULL ELSE value END AS value, online_pred FROM environment WHERE {SELECTED}",
    "measured_value": f"SELECT seq, time, CASE WHEN value = -200 THEN NULL ELSE value END AS value FROM environment WHERE {SELECTED} ORDER BY time DESC, seq DESC LIMIT 1",
    "recent_readings": "SELECT e.seq, e.time, e.value, coalesce(a.global = 1 OR a.local = 1 OR a.missing = 1, FALSE) AS anomaly FROM environment e LEFT JOIN anomaly a ON e.time = a.time AND e.topic = a.topic WHERE e.topic = :topic AND e.time >= :from AND e.time <= :to",
    "reading_frequency": f"SELECT floor(value / 20) AS bucket, count(*) AS n FROM environment WHERE {SELECTED} GROUP BY 1",
    "sensor_statistics": f"SELECT e.seq, e.time, e.value, round(m.mean + sqrt(m.variance), 6) AS upper, round(m.mean - sqrt(m.variance), 6) AS lower FROM environment e JOIN moving_statistics m ON e.seq = m.seq AND e.topic = m.topic WHERE e.topic = :topic AND e.time >= :from AND e.time <= :to",
    "data_distribution": f"SELECT seq, time, low, {_rounded('middle')} AS middle, high FROM quantiles WHERE {SELECTED}",
    "health_status": f"SELECT seq, time, CASE WHEN global = 1 THEN 2 WHEN local = 1 THEN 1 ELSE 0 END AS anomaly, CASE WHEN missing = 1 THEN 1 ELSE 0 END AS missing FROM anomaly WHERE {SELECTED} ORDER BY time, seq",
    "trend_increase": f"SELECT seq, time, value AS increase FROM trend WHERE {SELECTED} AND type = 1 AND value <> -200 AND time >= '2004-01-01'",
    "trend_decrease": f"SELECT seq, time, value AS decrease FROM trend WHERE {SELECTED} AND type = -1 AND value <> -200 AND time >= '2004-01-01'",
    "trend_original": f"SELECT seq, time, value FROM trend WHERE {SELECTED} AND value <> -200 AND time >= '2004-01-01'",
    "moving_deviation": f"SELECT seq, time, round(sqrt(variance), 6) AS std FROM moving_statistics WHERE {SELECTED}",
    "moving_average": f"SELECT seq, time, {_rounded('mean')} AS mean FROM moving_statistics WHERE {SELECTED}",
    "value_as_double": f"SELECT seq, time, nullif(CAST(value AS DOUBLE), -200) AS value FROM environment WHERE {SELECTED}",
    "forecast_by_upper_topic": "SELECT seq, time, pred_h1 FROM environment WHERE upper(topic) = upper(:topic)",
    "all_but_newest": "SELECT seq, time, value FROM (SELECT seq, time, value, row_number() OVER (PARTITION BY topic ORDER BY time DESC, seq DESC) AS rn FROM environment WHERE topic = :topic) x WHERE rn > 1",
}

ARGS = {"topic": "click", "from": "2000-01-01 00:00:00", "to": "2100-01-01 00:00:00"}


def register_measurements(spark: SparkSession, sf_dir: str) -> None:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    for name, text in MEASUREMENTS.items():
        spark.sql(text).createOrReplaceTempView(name)


def panel(spark: SparkSession, sf_dir: str, name: str, **args) -> DataFrame:
    """A panel's rows for the default or given topic and time range."""
    register_measurements(spark, sf_dir)
    return query(spark, PANELS[name], **(ARGS | args))


def panel_sql(name: str) -> str:
    """The panel in DuckDB SQL, parameters filled in."""
    body = PANELS[name]
    for k in ("topic", "from", "to"):
        body = body.replace(f":{k}", f"'{ARGS[k]}'" if k == "topic" else f"TIMESTAMP '{ARGS[k]}'")
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in MEASUREMENTS.items()) + " " + body
