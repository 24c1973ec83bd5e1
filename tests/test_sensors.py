"""Reducers against plain Python, detectors' known cases, sources, the store, and streams against batch."""

import json
import os
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.functions.columns import clip, normal_cdf, quantile
from tidewatch.operators import anomaly as A
from tidewatch.operators import forecast as M
from tidewatch.operators import sketch as S
from tidewatch.operators import windows as W
from tidewatch.operators.stateful import Observers, run_batch, run_stream
from tidewatch.plans import catalogue
from tidewatch.plans.scratch import new_path
from tidewatch.sources import readings as src
from tidewatch.streaming import store

SF = "/root/testdata/sf0.001"


def series(spark, values, topic="a"):
    return spark.createDataFrame([(topic, i, None if v is None else float(v)) for i, v in enumerate(values)], "topic string, seq long, value double").withColumn("ts", F.timestamp_seconds(F.col("seq") * 3600)).select("topic", "ts", "seq", "value")


def test_window_outlier_cases(spark):
    cases = [(-50, True), (None, False), (0, False), (99, False), (120, False), (145, False), (150, True)]
    df = spark.createDataFrame([(None if x is None else float(x), w) for x, w in cases], "x double, want boolean")
    train = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: i.cast("double"))
    assert df.where(A.window_outlier(train, F.col("x")) != F.col("want")).count() == 0
    gap = F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(2.0))
    assert df.where(A.window_outlier(gap, F.col("x"))).count() == 0


def test_novelty_edges(spark):
    def last(values):
        return A.with_novelty(series(spark, values)).orderBy("seq").collect()[-1].novelties

    assert last([None] * 8) == [None] * 8
    assert last([None, 2, 4, 8]) == [None, -2.0, 2.0, 4.0]
    assert last([3, 3, 5]) == [0.0, 0.0, 2.0]
    got = A.local_flags(series(spark, [1, 2, 1, 2, None, 2, 1, 90])).orderBy("seq").collect()
    assert not got[-1].local and not any(r.missing for r in got)
    assert A.local_flags(series(spark, [1, 2, 1, 2, 1, 2, 1, 90])).orderBy("seq").collect()[-1].local
    assert A.local_flags(series(spark, [1, 2, 1, 2, 1, 2, 1, None])).orderBy("seq").collect()[-1].missing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=120), st.sampled_from([0.01, 0.06, 0.3]))
def test_digest(values, delta):
    d = S.Digest(delta)
    for v in values:
        d.update(v)
    assert sum(d.weights) == len(values) and d.means == sorted(d.means)
    if len(values) < 2 / delta:
        s = sorted(values)
        assert d.percentile(0) == s[0] and d.percentile(100) == s[-1]
        assert d.percentile(50) == s[math.ceil(len(s) / 2) - 1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100)), max_size=60))
def test_exact_outlier(values):
    g, seen = S.GlobalOutlier(None), []
    for x in values:
        q1, q3, flag = g.step(x)
        if seen:
            a, b = np.percentile(seen, [25, 75])
            assert abs(q1 - a) < 1e-9 and abs(q3 - b) < 1e-9
        else:
            assert q1 is None and not flag
        if x is not None:
            seen.append(x)


def test_trend_and_ties():
    def last(values):
        m = S.MannKendall()
        return [m.step(v) for v in values]

    assert last(range(90))[-1][3] == 1 and last(range(90, 0, -1))[-1][3] == -1
    assert all(x[3] == 0 for x in last([5.0] * 150))
    up = last(range(150))
    assert up[100][0] == 0 and up[10][1] is None
    c = S.LossyCounting(0.1, 1.0)
    for x in [1.2, 1.4, 2.5, 1.9, 7.0]:
        c.add(x)
    assert c.kept[1][0] == 3 and c.ties() == [3]


def test_ewma_and_forecast():
    e = S.Ewma(0.1)
    rows = [e.step(x) for x in (None, 1.0, 2.0)]
    assert rows[0] == (0.0, 0.0) and abs(rows[2][0] - 0.29) < 1e-12
    f = S.OnlineForecast()
    out = [f.step(10 + math.sin(i / 3)) for i in range(300)]
    assert out[5] == (None,) and all(8 < p[0] < 14 for p in out[7:])


def test_columns(spark):
    row = spark.range(1).select(normal_cdf(F.lit(1.96)).alias("a"), normal_cdf(F.lit(-1.0)).alias("b"), clip(F.lit(5.0), F.lit(0.0), F.lit(2.0)).alias("c"), quantile(F.array(*map(F.lit, (4.0, 1.0, 3.0, 2.0))), 0.25).alias("d"), quantile(F.expr("cast(array() as array<double>)"), 0.5).alias("e")).first()
    assert abs(row.a - 0.9750021) < 1e-6 and abs(row.b - 0.1586553) < 1e-6 and row.c == 2.0 and row.d == 1.75 and row.e is None


def test_sources(spark, tmp_path):
    head = ";".join(src.RAW_COLUMNS) + ";;\n"
    line = "10/03/2004;18.00.00;2,6;1360;150;11,9;1046;166;1056;113;1692;1268;13,6;48,9;0,7578;;\n"
    late = line.replace("18.00", "17.00").replace("13,6", "-200")
    (tmp_path / "raw.csv").write_text(head + line + late + "bad;x" + ";" * 15 + "\n", "latin1")
    wide = src.read_wide_csv(spark, str(tmp_path / "raw.csv"))
    rows = wide.collect()
    assert len(rows) == 2 and rows[0].T is None and rows[1].T == 13.6 and rows[1]["PT08.S1(CO)"] == 1360
    assert src.read_wide_csv(spark, str(tmp_path / "raw.csv"), skip_rows=1).count() == 1
    long = src.unpivot(wide)
    assert long.count() == 16 and long.where("topic = 't' and value is null").count() == 1
    m = src.from_messages(spark.createDataFrame([("t", "10/03/2004 18.00.00", "13.6"), ("t", "bad", "1"), ("t", "10/03/2004 19.00.00", "-200"), ("t", "10/03/2004 20.00.00", "x")], "topic string, key string, value string"))
    assert [r.value for r in m.orderBy("ts").collect()] == [13.6, None, None]
    (tmp_path / "labels.txt").write_text("2004-07-01 06:00:00\nnothing\n")
    assert src.read_true_labels(spark, str(tmp_path / "labels.txt"), "t").count() == 1
    (tmp_path / "report_T.json").write_text(json.dumps({"target": "T", "horizons": [1], "rows_total": 300, "models": {"H+1": {"metrics_hgb": {"test": {"MAE": 1.0, "RMSE": 2.0, "R2": 0.5}}}}}))
    assert src.read_reports(spark, str(tmp_path / "report_T.json")).first().RMSE == 2.0


@pytest.mark.parametrize("make", [S.Ewma, S.Digest, S.TrendDriver, S.LossyCounting, S.OnlineForecast, S.AnomalyDetector, S.RecentAnomaly])
def test_stream_equals_batch(spark, tmp_path, make):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(6)
    rows = [("ab"[i % 2], f"{1 + i // 24:02d}/03/2004 {i % 24:02d}.00.00", "-200" if i % 11 == 0 else f"{rng.normal(50, 9):.3f}") for i in range(120)]
    for k, (lo, hi) in enumerate([(0, 17), (17, 60), (60, 120)]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(dict(zip(("topic", "key", "value"), r, strict=True))) for r in rows[lo:hi]))
        os.utime(tmp_path / f"in/{k}.json", (1_700_000_000 + k,) * 2)  # the source replays files by modification time
    stream = src.from_messages(src.file_messages(spark, str(tmp_path / "in")))
    out = str(tmp_path / "out")
    q = store.start(run_stream(stream, make), out, str(tmp_path / "check"))
    assert q.awaitTermination(120)
    got = store.register(spark, out, "measured")
    batch = store.as_fields(run_batch(src.from_messages(spark.createDataFrame(rows, "topic string, key string, value string")), make))
    assert got.count() == len(rows) and spark.read.parquet(out).select("write_seq").distinct().count() == 3
    assert batch.exceptAll(got.select(*batch.columns)).count() == 0
    assert store.query(spark, "SELECT count(*) AS n FROM measured WHERE topic = :t", t="a").first().n == 60


def test_store_merges(spark):
    w = spark.createDataFrame([("a", 1, 1.0, None, 1), ("a", 1, None, 5.0, 2), ("a", 2, 3.0, None, 1), ("a", 2, 4.0, None, 3)], "topic string, ts int, x double, y double, write_seq int")
    assert sorted(map(tuple, store.merged(w, ["x", "y"]).collect())) == [("a", 1, 1.0, 5.0), ("a", 2, 4.0, None)]
    assert {r.ts: r.x for r in store.latest(w).collect()} == {1: None, 2: 4.0}


def test_time_split_and_rolls(spark):
    s = W.time_split(series(spark, range(20))).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 14, "val": 3, "test": 3}
    f = W.features(series(spark, [1, 2, 3, 4])).orderBy("seq").collect()
    assert f[2].value_rollmean3 is None and f[3].value_rollmean3 == 2.0 and f[3].value_lag3 == 1.0
    assert W.features(series(spark, [1, 2]), full=False).orderBy("seq").collect()[1].value_rollmean3 == 1.0


NAMES = ("recent_readings_flagged", "global_iqr_exact", "exact_mk_by_block", "ewma_readings", "anomaly_detector_exact", "recent_anomalies", "hourly_counts", "lag_roll_features", "label_recall", "lof_scores", "pair_correlation", "panel_recent_readings", "panel_performance_h1")


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.execute(catalogue.ORACLE_SQL[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    order = [c for c in ("topic", "seq", "block", "id", "tie", "hour") if c in got.columns]
    if order:
        got, want = (d.sort_values(order).reset_index(drop=True) for d in (got, want))
    for c in got.columns:
        if got[c].dtype.kind in "fi":
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=2e-6, equal_nan=True), c
        elif "time" not in str(got[c].dtype):
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """A folder of events whose values have two digits and a small range, so that many lie on a fence to the last bit."""
    folder = tmp_path_factory.mktemp("tied")
    rng = np.random.default_rng(11)
    values = ", ".join(f"({i}, {v})" for i, v in enumerate(np.round(rng.integers(0, 31, 20000) / 100, 2).tolist()))
    duckdb.sql(f"COPY (SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_minutes(i) AS ts, 1::BIGINT AS user_id, CASE i % 2 WHEN 0 THEN 'click' ELSE 'view' END AS event_type, v::DOUBLE AS value, NULL::VARCHAR AS props FROM (VALUES {values}) t(i, v)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def differing(spark, name, folder):
    """Rows of a query that its SQL does not give, and those that only the SQL gives."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    want, got = set(want.fetchall()), set(map(tuple, catalogue.QUERIES[name](spark, folder).select(*columns).collect()))
    return got ^ want


def test_quartiles_to_the_last_bit(spark):
    rng = np.random.default_rng(5)
    arrays = [np.round(rng.exponential(50, k % 9 + 1), 2).tolist() for k in range(3000)]
    want = duckdb.sql(f"SELECT list_aggregate(x, 'quantile_cont', 0.25), list_aggregate(x, 'median'), list_aggregate(x, 'quantile_cont', 0.75) FROM (SELECT unnest({arrays}::DOUBLE[][]) AS x)").fetchall()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(arrays)], "i int, x array<double>")
    got = df.orderBy("i").select(C.quartiles(F.col("x"), lambda a, b: F.array(a, b)).alias("q"), quantile(F.col("x"), 0.5).alias("m")).collect()
    assert [(r.q[0], r.m, r.q[1]) for r in got] == want
    assert [tuple(S.linear_quantile(sorted(x), q) for q in (0.25, 0.5, 0.75)) for x in arrays] == want
    assert [S.linear_quantile([math.inf] * 2, 0.25), S.linear_quantile([1.0, math.inf], 0.0)] == [math.inf, 1.0]
    edge = spark.range(1).select(quantile(F.array(F.lit(math.inf), F.lit(math.inf)), 0.25).alias("a"), quantile(F.array(F.lit(1.0), F.lit(math.inf)), 0.0).alias("b")).first()
    assert (edge.a, edge.b) == (math.inf, 1.0)


def test_peaks_on_a_fence(spark, tied):
    assert not differing(spark, "archive_peak_flags", tied)


#: Of events at 60 times sf0.1: the last difference is a fence to the last bit.
ON_A_FENCE = [30.15, 87.31, 17.65, 0.71, 3.52, 68.47, 45.52, 150.4]


def written_events(folder, topics):
    rows = ", ".join(f"({1 + i + 20 * k}, '{t}', {v}::DOUBLE)" for k, (t, values) in enumerate(topics.items()) for i, v in enumerate(values))
    duckdb.sql(f"COPY (SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_minutes(i) AS ts, t AS event_type, v AS value FROM (VALUES {rows}) x(i, t, v)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["local_iqr_flags", "recent_readings_flagged", "label_recall"])
def test_differences_on_a_fence(spark, tmp_path, name):
    assert not differing(spark, name, written_events(tmp_path, {"purchase": ON_A_FENCE, "view": [5, 6, 5, 6, 5, 6, 5, 190]}))


@pytest.mark.parametrize("values", [[50] * 12, [1] * 12, [5, 6, 5, 6, 5, 6, 5, 90]], ids=["neither", "labels", "flags"])
def test_recall_without_labels_or_flags(spark, tmp_path, values):
    folder = written_events(tmp_path, {"view": values})
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["label_recall"]).fetchall()
    assert np.array_equal(catalogue.QUERIES["label_recall"](spark, folder).collect(), want, equal_nan=True)


def events_by_topic():
    """Present readings of the small events table, from its file: topic -> [(seq, value)] in time order."""
    rows = duckdb.sql(f"SELECT event_type, event_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END FROM '{SF}/events.parquet' ORDER BY ts, event_id").fetchall()
    out = {}
    for t, i, v in rows:
        out.setdefault(t, []).append((i, v))
    return out


def test_ewma_of_every_reading(spark):
    want = {}
    for t, rows in events_by_topic().items():
        m = s = n = 0
        for i, v in rows:
            if v is not None:
                m, s, n = 0.7 * m + 0.3 * v, 0.7 * s + 0.3 * v * v, n + 1
                want[i] = (t, m, n * (s - m * m) / (n - 1) if n > 1 else 0.0)
    got = {r.seq: (r.topic, r.mean, r.variance) for r in catalogue.QUERIES["ewma_readings"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and np.allclose(got[i][1:], want[i][1:]) for i in want)


def brute_lof(values, k):
    """Factors of sorted values by all distances; of equal ones the nearer in order, then the lower."""
    v = np.array(values)
    i = np.arange(len(v))
    near = [sorted(set(range(len(v))) - {a}, key=lambda b, a=a: (abs(v[a] - v[b]), abs(a - b), b))[:k] for a in i]
    d = [np.abs(v[near[a]] - v[a]) for a in i]
    far = np.array([x.max() for x in d])
    density = np.array([1 / (np.maximum(d[a], far[near[a]]).mean() + 1e-10) for a in i])
    return [density[near[a]].mean() / density[a] for a in i]


def test_lof_of_every_reading(spark):
    want = {}
    for t, rows in events_by_topic().items():
        before = [None] + [v for _, v in rows][:-1]
        steps = [(i, 0.0 if not n and v is not None else None if v is None or b is None else v - b) for n, ((i, v), b) in enumerate(zip(rows, before, strict=True))]
        for series_name, points, k, share in (("value", rows, 15, 0.075), ("difference", steps, 20, 0.05)):
            points = sorted((v, i) for i, v in points if v is not None)
            lof = brute_lof([v for v, _ in points], k)
            limit = np.percentile(lof, 100 * (1 - share))
            want |= {(series_name, i): (t, v, x, x > limit) for (v, i), x in zip(points, lof, strict=True)}
    got = {(r.series, r.seq): (r.topic, r.value, r.lof, r.outlier) for r in catalogue.QUERIES["lof_outliers"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and np.allclose(got[x][1:3], want[x][1:3]) and got[x][3] == want[x][3] for x in want)
    few = A.local_outlier_factor(series(spark, [1, 2, 9]).unionByName(series(spark, [5], "b")), 15, 0.075).collect()
    assert {(r.topic, r.value): r.outlier for r in few} == {("a", 1.0): False, ("a", 2.0): True, ("a", 9.0): False, ("b", 5.0): False}  # 16 / 15 at 2, 31 / 32 at 1 and 9


def test_gbt_of_every_topic(spark):
    got = {(r.topic, r.horizon): r for r in catalogue.QUERIES["gbt_forecast"](spark, SF).collect()}
    assert got.keys() == {(t, h) for t in events_by_topic() for h in W.HORIZONS}
    split = W.time_split(W.supervised(src.from_events(spark, SF).where("topic = 'view'")))
    scored = M.score(split.where("split = 'test'"), M.train(split, (2,)))
    want = scored.agg(*[c.alias(n) for n, c in M.metrics(F.col("target_H2"), F.col("pred_H2")).items()]).first()
    assert np.allclose([got["view", 2][n] for n in ("mae", "rmse", "r2")], list(want), rtol=0.2)
    short = M.report_of_test_rows(W.time_split(W.supervised(series(spark, range(30))).limit(1))).collect()
    assert [(r.topic, r.horizon, r.mae) for r in short] == [("a", h, None) for h in W.HORIZONS]


def test_ties_keep_the_later_bound():
    """Buckets of two values. A count first kept in the first bucket gets the bound of its next hit's bucket."""
    c = S.LossyCounting(0.5, 1.0)
    for x in (1, 1, 1, 5, 6, 7):
        c.add(x)
    assert c.kept == {1: [3, 1]}  # 3 + 0 would have gone at the end of the third bucket
    c.add(8)
    c.add(9)
    assert c.kept == {}
    assert S.MannKendall().ties.width == 10


def test_trend_by_hand():
    """Below 2 / delta values the digest holds them all, so S, ties and Z follow from ranks."""
    values = [float(v) for v in (3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9, 3, 2, 3, 8, 4, 6, 2, 6, 4)]
    m = S.MannKendall(0.06)
    out = [m.step(v) for v in values]
    s = 0.0
    for n in range(20, len(values) + 1):
        seen, x = sorted(values[:n]), values[n - 1]
        q = [seen[math.ceil(p / 100 * n) - 1] for p in range(5, 100, 5)]
        k = next((i for i in range(18) if q[i] <= x <= q[i + 1] and q[i] < q[i + 1]), None)
        cdf = 0.0 if x <= q[0] else 1.0 if x >= q[-1] else (5 * (k + 1) + 5 * (x - q[k]) / (q[k + 1] - q[k])) / 100
        s += n * (2 * cdf - 1)
        assert abs(out[n - 1][0] - s) < 1e-9
    assert out[18][1] is None and out[-1][1] is not None


def test_student(spark):
    """Against the density, integrated."""
    for freedom in (1, 2, 3, 8, 49):
        x = np.linspace(-400, 1.3, 4_000_001)
        f = math.gamma((freedom + 1) / 2) / math.sqrt(freedom * math.pi) / math.gamma(freedom / 2) * (1 + x * x / freedom) ** (-(freedom + 1) / 2)
        want = float(((f[1:] + f[:-1]) / 2 * np.diff(x)).sum()) + (1 / math.pi / 400 if freedom == 1 else 0)
        got = spark.range(1).select(C.t_below(F.lit(1.3), freedom).alias("a"), C.t_below(F.lit(-1.3), freedom).alias("b")).first()
        assert abs(got.a - want) < 2e-5 and abs(got.a + got.b - 1) < 1e-12


def test_blocks_equal_whole_topics(spark):
    rng = np.random.default_rng(9)
    values = [None if k % 7 == 3 else float(v) for k, v in enumerate(rng.normal(50, 9, 200))]
    r = series(spark, values).unionByName(series(spark, values[:40], "b")).unionByName(series(spark, values[5:60], None))
    made = lambda x: x.withColumns(W.lags() | W.rolls() | W.targets())
    whole, cut = made(r).collect(), W.in_blocks(r, made, 24, 3, block_rows=30).collect()
    assert sorted(map(str, whole)) == sorted(map(str, cut))
    flags = lambda x: sorted(map(str, x.select("topic", "seq", "missing", "local").collect()))
    assert flags(A.local_flags(r)) == flags(W.in_blocks(r, A.local_flags, 7, block_rows=30))
    place = {(x.topic, x.seq): x._pos for x in W.numbered(r, 5).collect()}
    assert place == {(t, i): i for t, n in (("a", 200), ("b", 40), (None, 55)) for i in range(n)}
    e = r.withColumn("pred", F.lit(50.0))
    a, b = (sorted((x.topic or "", x.seq, x.ae, x.mae, x.rmse, x.bias) for x in W.with_running_errors(e, block_rows=n).collect()) for n in (10**6, 10))
    assert [x[:2] for x in a] == [x[:2] for x in b]
    for x, y in zip(a, b, strict=True):
        assert np.allclose([v or 0 for v in x[2:]], [v or 0 for v in y[2:]])


def test_detectors_and_observers(spark):
    rng = np.random.default_rng(3)
    values = [None if k % 13 == 5 else float(v) for k, v in enumerate(rng.normal(0, 5, 150))]
    r = series(spark, values).unionByName(series(spark, values[::-1], "b"))
    sql = {(x.topic, x.seq): (x.missing, x.local) for x in A.local_flags(r).collect()}
    rows = A.detect_anomalies(r, only_found=False).collect()
    assert {(x.topic, x.seq): (x.missing, x.local) for x in rows} == sql and any(x["global"] for x in rows)
    assert all(not (x["global"] or x.missing or x.local) for x in rows if x.seq < 7)
    shared = A.detect_anomalies(r, "shared", False).collect()
    g, want = S.GlobalOutlier(), {}
    for x in sorted(rows, key=lambda x: (x.ts, x.seq, x.topic)):
        want[x.topic, x.seq] = g.step(x.novelty)[2] and x.seq >= 7
    assert {(x.topic, x.seq): x["global"] for x in shared} == want
    o = Observers()
    o.add("n", lambda x, made: x.groupBy("topic").count())
    o.add("m", lambda x, made: made["n"].agg(F.max("count").alias("most")))
    assert o.run(r)["m"].first().most == 150
    o.remove("n")
    assert list(o.by_name) == ["m"]


def test_late_rows(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    hours = [[3, 4], [2, 5], [5, 1, 6]]
    for k, part in enumerate(hours):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps({"topic": "a", "key": f"01/03/2004 {h:02d}.00.00", "value": "1"}) for h in part))
        os.utime(tmp_path / f"in/{k}.json", (1_700_000_000 + k,) * 2)
    stream = src.from_messages(src.file_messages(spark, str(tmp_path / "in")))
    assert store.start(run_stream(stream, S.Ewma, drop_late=True), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = sorted((r.ts.hour, r.late_rows) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(3, 0), (4, 0), (5, 1), (6, 3)]


def test_models_on_disk(spark):
    split = W.time_split(W.supervised(src.from_events(spark, SF).where("topic = 'view'"))).cache()
    folder = new_path(spark, "models")
    models = M.train(split, (1, 2))
    M.save_models(models, folder, "a/b")
    M.save_models({1: models[1]}, folder, "other", "rf")
    assert {t: list(x) for t, x in M.scan_models(spark, folder).items()} == {"a-b": [1, 2]}
    assert M.scan_models(spark, folder + "-none") == {}
    rows = split.where("split = 'test'")
    served = M.serve(rows.withColumn("topic", F.lit("a/b")).unionByName(rows.limit(1)), folder)
    want = [r.pred_H1 for r in M.score(rows, models).orderBy("seq").collect()]
    got = served.orderBy("topic", "seq").collect()
    assert [r.pred_H1 for r in got[:-1]] == want and all(r.pred_H3 is None for r in got) and got[-1].pred_H2 is None
    lacking = M.predict(rows.drop("value_lag1"), models)
    assert lacking.where("pred_H1 is null").count() == 0 and "value_lag1" not in lacking.columns
    top = M.permutation_importance(models[1], split.where("split = 'val'"), "target_H1").collect()
    assert 0 < len(top) <= 20 and [t.importance for t in top] == sorted((t.importance for t in top), reverse=True)
    f = M.prediction_fields(spark.createDataFrame([("a", 1.0, None)], "topic string, `H+1` double, `H+2` double")).first()
    assert f.pred_H1 == 1.0 and math.isnan(f.pred_H2)


def test_online_features(spark):
    hours = series(spark, [float(k % 24) for k in range(60)], "t").unionByName(series(spark, [None if k == 5 else float(k) for k in range(60)], "rh"))
    rows, names = M.online_inputs(hours, ("t", "rh"))
    assert len(names) + len(S.OnlineForecast.LAGS) + 2 * len(S.OnlineForecast.ROLLS) == 19
    x = rows.where("topic = 't' and seq = 8").first()
    assert (x.t_cur, x.t_lag1, x.t_lag3, x.rh_cur, x.rh_lag3, x.t_x_rh, x.hour) == (8.0, 7.0, 5.0, 8.0, None, 64.0, 8)
    out = M.forecast_online(hours).orderBy("topic", "seq").collect()
    assert len(out) == 120 and all((r.online_pred is None) == (r.seq < 6) for r in out)


def test_names_and_frames(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 4.0)], "h int, topic string, value double")
    wide = C.renamed_by_regex(C.partitioned_by_values(df, "h", "topic", "value", ["a", "b"]), "^([ab])$", r"s_\1")
    assert sorted(map(tuple, wide.collect())) == [(1, 2.0, 3.0), (2, 4.0, None)] and wide.columns == ["h", "s_a", "s_b"]
    with pytest.raises(ValueError):
        C.renamed_by_regex(df, "h|topic", "x")
    row = spark.range(1).select(C.bare_number(F.lit("1.5")).alias("a"), C.bare_number(F.lit("x")).alias("b")).first()
    assert row.a == 1.5 and row.b is None
