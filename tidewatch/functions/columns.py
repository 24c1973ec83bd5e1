"""Column functions over built-in expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by a rational approximation with an error below 7.5e-8."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / F.lit(2.5066282746310002) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def clip(value: Column, low: Column, high: Column) -> Column:
    """value inside [low, high]; bounds that are NULL do not bind."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def between(a: Column, b: Column, d: Column) -> Column:
    """a (1 - d) + b d for d of 0, 1/4, 1/2 or 3/4 to the last bit as DuckDB has it: b d is rounded, and then the sum once.

    Only 3/4 a can lose bits before the sum; what both lose is added at the end."""
    p, z = a * (1 - d), b * d
    s = p + z
    t = s - p
    lost = (p - (s - t)) + (z - t) + (a * 0.25 - (p - a * 0.5))
    return F.when(d == 0, a).when(d == 0.25, s + F.nanvl(lost, F.lit(0.0))).otherwise(s)


def sorted_at(s: Column, n: Column, q: float) -> Column:
    """Quantile q of a sorted array of n values, by linear interpolation."""
    p = (n - 1) * F.lit(q)
    low = F.floor(p).cast("int")
    high = F.ceil(p).cast("int")
    return F.when(n > 0, between(F.element_at(s, low + 1), F.element_at(s, high + 1), p - low))


def quantile(values: Column, q: float) -> Column:
    """Quantile of an array, NULLs left out."""
    return bind(F.sort_array(F.array_compact(values)), lambda s: sorted_at(s, F.size(s), q))


def quartiles(values: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(first, third quartile) of an array, which is sorted once."""
    ends = lambda s: F.struct(sorted_at(s, F.size(s), 0.25).alias("low"), sorted_at(s, F.size(s), 0.75).alias("high"))
    return bind(bind(F.sort_array(F.array_compact(values)), ends), lambda q: use(q["low"], q["high"]))


def calendar(ts: Column) -> dict[str, Column]:
    """Hour, day of the week from Monday = 0, month and weekend flag."""
    day = F.weekday(ts)
    return {"hour": F.hour(ts), "dayofweek": day, "month": F.month(ts), "is_weekend": (day >= 5).cast("int")}


def label_of(topic: Column, labels: dict[str, str], otherwise: Column | None = None) -> Column:
    """Label of a topic; NULL or otherwise for other topics."""
    out = otherwise if otherwise is not None else F.lit(None).cast("string")
    for t, name in labels.items():
        out = F.when(topic == t, name).otherwise(out)
    return out


def severity(is_global: Column, is_local: Column) -> Column:
    """2 for global, 1 for local, else 0."""
    return F.when(is_global, 2).when(is_local, 1).otherwise(0)


def t_below(t: Column, freedom: int) -> Column:
    """Chance that Student's t with a fixed number of degrees of freedom is below t: a finite sum in the angle's sine and cosine."""
    odd = freedom % 2

    def total(cos2: Column) -> Column:
        inner = F.lit(1.0)
        for k in range((freedom - odd) // 2 - 1, 0, -1):
            inner = 1 + inner * cos2 * (2 * k / (2 * k + 1) if odd else (2 * k - 1) / (2 * k))
        return inner if freedom > 1 else F.lit(0.0)

    def chance(angle: Column) -> Column:
        cos = F.cos(angle)
        sums = bind(cos * cos, total)
        return 0.5 + ((angle + F.sin(angle) * cos * sums) / math.pi if odd else F.sin(angle) * sums / 2)

    return bind(F.atan(t / math.sqrt(freedom)), chance)


def shifted(ts: Column, hours: int = 0, days: int = 0) -> Column:
    """A time moved by whole hours and days."""
    return ts + F.make_dt_interval(F.lit(days), F.lit(hours))


def formatted(ts: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(ts, pattern)


def bare_number(text: Column) -> Column:
    """The number that a JSON text consists of; NULL for other texts."""
    return F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v double")["v"]


def hourly_range(df: DataFrame, first: Column, last: Column, name: str = "ts") -> DataFrame:
    """A row for each hour from first to last of each row of df."""
    return df.withColumn(name, F.explode(F.sequence(first, last, F.expr("interval 1 hour"))))


def renamed_by_regex(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """df with the pattern replaced in its column names; names that would clash are an error."""
    names = {c: re.sub(pattern, replacement, c) for c in df.columns}
    if len(set(names.values())) < len(names):
        raise ValueError(f"{pattern}: columns would have one name")
    return df.withColumnsRenamed({a: b for a, b in names.items() if a != b})


def partitioned_by_values(df: DataFrame, key: str, by: str, value: str, values: list[str]) -> DataFrame:
    """A column for each of the values of `by`, a row for each key; values are named so that the schema is fixed."""
    return df.groupBy(key).pivot(by, values).agg(F.max(value))
