"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..plans.shipping import ship


_kept: dict[str, Callable] = {}  # of this process, by name


def worker_cache(name: str) -> Callable[[Callable], Callable]:
    """Keeps a function's last result for later tasks of the same Python worker, until a task of another operator needs its memory."""

    def wrap(make: Callable) -> Callable:
        _kept[name] = lru_cache(maxsize=1)(make)
        return _kept[name]

    return wrap


def only(name: str) -> None:
    """Lets go of what other operators keep in this process."""
    for other, made in _kept.items():
        if other != name and made.cache_info().currsize:
            made.cache_clear()


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, keeps: str = "") -> DataFrame:
    """df.mapInArrow, with this package sent to the executors. keeps: the worker_cache that fn uses; others are let go."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(keeps)
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], list], keeps: str = "") -> DataFrame:
    """df with new columns, which fn computes from an Arrow batch; a column of the same name is replaced."""
    names = {f.name for f in fields}
    keep = [c for c in df.columns if c not in names]
    schema = T.StructType([*[df.schema[c] for c in keep], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + fn(b), names=[*keep, *[f.name for f in fields]])

    return map_batches(df, run, schema, keeps)


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out
