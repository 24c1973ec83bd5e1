"""Readings: the canonical rows (topic, ts, seq, value) that all operators take, and where they come from.

Missing values are NULL from here on: the sentinel -200 is replaced once, at ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINEL = -200.0

# The raw file's columns in order, and the sensors that are analysed.
RAW_COLUMNS = ("Date", "Time", "CO(GT)", "PT08.S1(CO)", "NMHC(GT)", "C6H6(GT)", "PT08.S2(NMHC)", "NOx(GT)", "PT08.S3(NOx)", "NO2(GT)", "PT08.S4(NO2)", "PT08.S5(O3)", "T", "RH", "AH")
TOPICS = {
    "pt08_s1_co": "PT08.S1(CO)",
    "pt08_s2_nmhc": "PT08.S2(NMHC)",
    "pt08_s3_nox": "PT08.S3(NOx)",
    "pt08_s4_no2": "PT08.S4(NO2)",
    "pt08_s5_o3": "PT08.S5(O3)",
    "t": "T",
    "rh": "RH",
    "ah": "AH",
}
LABELS = {
    "pt08_s1_co": "Carbon monoxide",
    "pt08_s2_nmhc": "Non-methane hydrocarbons",
    "pt08_s3_nox": "Nitrogen oxides",
    "pt08_s4_no2": "Nitrogen dioxide",
    "pt08_s5_o3": "Ozone",
    "t": "Temperature",
    "rh": "Relative humidity",
    "ah": "Absolute humidity",
}

READING = T.StructType([T.StructField("topic", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()), T.StructField("value", T.DoubleType())])


def missing_to_null(value: Column, sentinel: float = SENTINEL) -> Column:
    """The sentinel and NaN as NULL."""
    v = value.cast("double")
    return F.when(~((v == F.lit(sentinel)) | F.isnan(v)), v)


def decimal_comma(text: Column) -> Column:
    """A number written with a decimal comma; NULL if it is none."""
    return F.regexp_replace(F.trim(text), ",", ".").try_cast("double")


def read_wide_csv(spark: SparkSession, path: str, skip_rows: int = 0) -> DataFrame:
    """The wide hourly file: ";"-separated, decimal commas, Latin-1, empty columns at the end. One row for each time, sorted by it.

    Rows whose date and time do not parse are left out, as are the first skip_rows data rows by time."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*RAW_COLUMNS, "_1", "_2")])
    raw = spark.read.csv(path, schema=schema, sep=";", encoding="ISO-8859-1", header=True, enforceSchema=True)
    ts = F.try_to_timestamp(F.concat_ws(" ", F.trim(F.col("Date")), F.trim(F.col("Time"))), F.lit("dd/MM/yyyy HH.mm.ss"))
    wide = raw.select(ts.alias("ts"), *[missing_to_null(decimal_comma(F.col(f"`{c}`"))).alias(c) for c in RAW_COLUMNS[2:]])
    wide = wide.where("ts is not null")
    if skip_rows:
        first = wide.select("ts").orderBy("ts").limit(skip_rows).agg(F.max("ts")).first()[0]
        wide = wide.where(F.col("ts") > F.lit(first)) if first is not None else wide
    return wide.orderBy("ts")


def unpivot(wide: DataFrame, topics: dict[str, str] = TOPICS) -> DataFrame:
    """A wide frame as readings, one row for each sensor and time; seq orders the sensors of a time."""
    pairs = F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(i).cast("long").alias("seq"), F.col(f"`{c}`").alias("value")) for i, (t, c) in enumerate(topics.items())])
    return wide.select("ts", F.explode(pairs).alias("r")).select("r.topic", "ts", "r.seq", "r.value")


def from_messages(messages: DataFrame) -> DataFrame:
    """Readings from messages (topic, key, value) of strings or bytes, batch or stream; the key is "dd/MM/yyyy HH.mm.ss".

    Rows whose key does not parse are left out; values that are no numbers are NULL."""
    m = messages.select(F.col("topic").cast("string"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("v"))
    ts = F.try_to_timestamp(F.col("key"), F.lit("dd/MM/yyyy HH.mm.ss"))
    value = missing_to_null(F.col("v").try_cast("double"))
    return m.select("topic", ts.alias("ts"), F.unix_micros(ts).alias("seq"), value.alias("value")).where("ts is not null")


def kafka_messages(spark: SparkSession, servers: str, topics: list[str] | None = None, starting: str = "latest") -> DataFrame:
    """A stream of messages from Kafka, if its connector is on the class path."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("startingOffsets", starting)
    return source.option("subscribe", ",".join(topics or TOPICS)).load().select("topic", "key", "value", "partition", "offset")


def file_messages(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A stream of messages (topic, key, value) from JSON files, a replay of a topic in order of the files' modification times."""
    schema = "topic string, key string, value string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def read_true_labels(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """Rows (topic, ts, value = 1.0) from a text file with a time on each line; other lines are left out."""
    ts = F.try_to_timestamp(F.trim("value"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return spark.read.text(path).select(F.lit(topic).alias("topic"), ts.alias("ts"), F.lit(1.0).alias("value")).where("ts is not null")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Model reports: a row for each target and horizon with the test metrics."""
    metric = "struct<MAE:double,RMSE:double,R2:double>"
    schema = f"target string, horizons array<int>, rows_total int, rows_train int, rows_val int, rows_test int, models map<string,struct<metrics_hgb:struct<val:{metric},test:{metric}>,top_features_val:map<string,double>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select("target", "rows_total", F.explode("models").alias("horizon", "m")).select("target", "rows_total", "horizon", "m.metrics_hgb.test.*", "m.top_features_val")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that stand in for a sensor feed: a topic for each event type, with every 97th reading missing."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_id") % 97 == 0, F.lit(SENTINEL)).otherwise(F.col("value"))
    return e.select(F.col("event_type").alias("topic"), "ts", F.col("event_id").alias("seq"), missing_to_null(value).alias("value"))
