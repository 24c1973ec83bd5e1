"""Measurements: idempotent upsert sink for streams, views with the last write, and SQL over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("topic", "ts")


def as_fields(df: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Fields as the dashboards expect: flags as 0.0 and 1.0, numeric text as numbers, doubles to ten digits."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if f.name not in keys and kind == "boolean":
            c = c.cast("double")
        elif f.name not in keys and kind in ("double", "float"):
            c = F.round(c.cast("double"), 10)
        out.append(c.alias(f.name))
    return df.select(*out)


def upsert(path: str):
    """A foreachBatch function: appends a batch once, however often the stream retries it."""

    def write(batch: DataFrame, epoch: int) -> None:
        as_fields(batch).write.mode("overwrite").parquet(f"{path}/write_seq={epoch}")

    return write


def latest(df: DataFrame, keys: tuple[str, ...] = KEY, order: str = "write_seq") -> DataFrame:
    """One row for each key: that of the last write."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merged(writes: DataFrame, fields: list[str], keys: tuple[str, ...] = KEY, order: str = "write_seq") -> DataFrame:
    """One row for each key with the last value written to each field."""
    return writes.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def register(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Reads a measurement's folder and registers its latest rows as a view."""
    df = latest(spark.read.parquet(path))
    df.createOrReplaceTempView(name)
    return df


def query(spark: SparkSession, text: str, **args) -> DataFrame:
    """SQL over the registered views; :name parameters take the arguments."""
    return spark.sql(text, args=args)


def show(df: DataFrame, checkpoint: str, trigger: dict | None = None):
    """Starts a stream that prints its new rows in full."""
    return df.writeStream.format("console").outputMode("append").option("truncate", "false").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Starts a stream into a measurement's folder."""
    return df.writeStream.foreachBatch(upsert(path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
