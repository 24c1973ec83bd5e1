"""Exact membership in a list by a cascade of Bloom filters.

Level 0 encodes the listed keys; level 1 those unlisted keys of the corpus that pass level 0; level 2
the listed keys that pass level 1; and so on until no key passes wrongly. As the cascade is built over
every key of the corpus, it is exact for the corpus: the first level that a key fails tells by its
parity whether the key is listed, and no join is needed to ask.

A level is one row with an array of 64-bit words, asked through a scalar subquery. Its size is set by
the number of its keys and checked against ``max_bytes``; keys for which that is too little are dealt
into slices by a hash, with a cascade for each.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import keep
from .common import unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    words: int
    hashes: int
    seed: int
    table: DataFrame

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(j)), F.lit(self.words * 64)) for j in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        bits = self.table.scalar()
        found = F.lit(True)
        for p in self.positions(key):
            word = F.element_at(bits, (F.floor(p / 64) + 1).cast("int"))
            found = found & (F.call_function("shiftright", word, (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return found


def encode(keys: DataFrame, count: int, bits_per_key: int, hashes: int, seed: int) -> Level:
    """A filter over the keys (column key); its words are gathered in one row of known size."""
    words = max(1, -(-count * bits_per_key // 64))
    level = Level(words, hashes, seed, keys)
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    filled = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b"))
    every = keys.sparkSession.range(words).withColumnRenamed("id", "w").join(filled, "w", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("x"))
    table = keep(row.select(F.transform("x", lambda s: s["b"]).alias("bits")), f"bloom{seed}")
    return Level(words, hashes, seed, table)


@dataclass(frozen=True)
class Cascade:
    """Levels of each slice of the keys; a key is asked for in its own slice only."""

    slices: list[list[Level]]

    def slice_of(self, key: Column) -> Column:
        return slice_of(key, len(self.slices))

    def listed(self, key: Column, number: int = 0) -> Column:
        """Whether the key, one of the corpus and of this slice, is listed."""
        levels = self.slices[number]
        answer = F.lit(len(levels) % 2 == 1)
        for i in reversed(range(len(levels))):
            answer = F.when(levels[i].passes(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df with a boolean column that tells whether its key is listed; null keys are not.

        Several slices are asked in turn, each on its own rows, which are written down before the next, so that the driver and
        executors hold one slice's filters at a time."""
        if len(self.slices) == 1:
            return df.withColumn(name, F.col(key).isNotNull() & self.listed(F.col(key)))
        rows, k = keep(df, "asked"), F.col(key)
        parts = [keep(rows.where(k.isNotNull() & (self.slice_of(k) == i)).withColumn(name, self.listed(k, i)), "answered") for i in range(len(self.slices))]
        return reduce(DataFrame.unionByName, parts, rows.where(k.isNull()).withColumn(name, F.lit(False)))


def slice_of(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("slice")), F.lit(slices))


class TooLarge(Exception):
    """A level needs more than it may have."""


def _levels(inside: DataFrame, outside: DataFrame, bits_per_key: int, hashes: int, max_bytes: int) -> list[Level]:
    levels: list[Level] = []
    while n := inside.count():
        if n * bits_per_key > max_bytes * 8:
            raise TooLarge
        level = encode(inside, n, bits_per_key, hashes, len(levels))
        levels.append(level)
        inside, outside = keep(outside.where(level.passes(F.col("key"))), "passed"), inside
    return levels


def build(universe: DataFrame, listed: DataFrame, bits_per_key: int = 10, hashes: int = 4, max_bytes: int = 4_000_000, slices: int | None = None) -> Cascade:
    """A cascade for the listed keys over all keys of the corpus; both frames have a column key.

    Null and repeated keys are dropped. Listed keys that the corpus lacks are encoded in level 0 as
    well, so the filter also serves later tables for which it is then approximate. No level is larger than max_bytes: keys
    are dealt into as many slices by a hash as that takes, each with levels of its own, and into twice as many if a level of
    any slice, the later ones included, comes out larger."""
    wanted = listed.select("key").where(F.col("key").isNotNull()).distinct().withColumn("_listed", F.lit(True))
    keys = universe.select("key").where(F.col("key").isNotNull()).distinct()
    keys = keep(keys.join(wanted, "key", "full").select("key", F.coalesce("_listed", F.lit(False)).alias("_listed")), "universe")
    count = {r._listed: r["count"] for r in keys.groupBy("_listed").count().collect()}
    passing = (1 - math.exp(-hashes / bits_per_key)) ** hashes
    most = max(count.get(True, 0), passing * count.get(False, 0))
    slices = slices or max(1, math.ceil(most * bits_per_key / (8 * 0.8 * max_bytes)))
    while True:
        part = lambda i: keys if slices == 1 else keys.where(slice_of(F.col("key"), slices) == i)  # noqa: B023, E731
        try:
            return Cascade([_levels(part(i).where("_listed"), part(i).where("not _listed"), bits_per_key, hashes, max_bytes) for i in range(slices)])
        except TooLarge:
            slices *= 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: then up to "?", "#" or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Of the rules (verdict, host/path), the longest that fits the host or a domain above it and the path's start."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        domain, start = text.split("/", 1)
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str]], blocked: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict ("allow" or "block"); input columns of these names are replaced.

    The longest fitting rule decides; without one, a page is blocked if its host, or its host and path in one, is in blocked
    (column key). A null url or one without "://" has empty host and path and, unless "" is listed, is allowed."""
    host, path = host_and_path(F.col(url))
    seen = pages.withColumns({"host": host, "path": path})
    cascade = build(seen.select(F.explode(F.array(F.col("host"), F.concat("host", "path"))).alias("key")), blocked)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    whole, by_host, by_url, ruled = unused(pages, "whole", "by_host", "by_url", "ruled")
    seen = seen.withColumns({"rule": rule, ruled: verdict, whole: F.concat("host", "path")})
    seen = cascade.mark(cascade.mark(seen, "host", by_host), whole, by_url)
    listed = F.when(F.col(by_host) | F.col(by_url), "block").otherwise("allow")
    return seen.withColumn("verdict", F.coalesce(ruled, listed)).drop(whole, by_host, by_url, ruled)
