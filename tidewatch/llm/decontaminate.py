"""Benchmark decontamination with one Aho-Corasick automaton.

The patterns are anchors, words of the benchmark's items as ``" w1 w2 ... "``; the delimiters never
occur in words, so that a match always covers whole words. Every text is normalised and scanned once,
on the map side, without a shuffle; matches are extended to the windows that hold them, and hit words
are mapped back to code-point offsets of the original text.

An automaton has a bounded number of characters. A benchmark that is larger gives several, which scan
the texts in turn.
"""

from __future__ import annotations

import functools
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import keep
from .common import append_columns, map_batches, unused, worker_cache

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after A-Z are lower-cased
_UPPER = bytes(range(0x41, 0x5B))
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_UPPER + _SEPARATORS, _UPPER.lower() + b" " * len(_SEPARATORS))
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

OUTPUT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("contaminated", T.BooleanType()),
]


def words(text: str | None) -> list[str]:
    """Normalised words of a text; none for null."""
    return [w.decode() for w in text.encode().translate(_TABLE).split()] if text else []


def windows(text: str | None, n: int) -> list[tuple[str, ...]]:
    """All runs of n consecutive words; a shorter text, if it has words, is one window."""
    w = words(text)
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else []


@dataclass(frozen=True)
class Benchmark:
    """What executors need to build an automaton: parts of items, each with its item's id."""

    uid: str
    window: int
    ids: list[str]
    parts: list[list[bytes]]


def parts_of(text: str | None, window: int, most_words: int) -> list[list[bytes]]:
    """Runs of an item's words that hold every window of it in one of them."""
    w = text.encode().translate(_TABLE).split() if text else []
    return [w[i : i + most_words + window - 1] for i in range(0, max(1, len(w) - window + 1), most_words)] if w else []


class Scanner:
    """An automaton over anchors: the words at each half of a window, aligned in the item.

    Any occurrence of a window of n words holds a whole anchor of (n + 1) // 2 words, so anchors find every occurrence, and
    the automaton has about a state for each character of the benchmark. A match is extended to both sides, word by word,
    as far as the item and the text agree; from n words on, it is a run of windows. Items of fewer words are one anchor."""

    def __init__(self, b: Benchmark):
        self.b, self.automaton = b, None
        anchors: dict[str, tuple[int, list[tuple[int, int]]]] = {}
        half = (b.window + 1) // 2
        for number, w in enumerate(b.parts):
            size = half if len(w) >= b.window else len(w)
            for at in range(0, len(w) - size + 1, size) if len(w) >= b.window else (0,):
                anchors.setdefault(f" {b' '.join(w[at : at + size]).decode()} ", (size, []))[1].append((number, at))
        if anchors:
            self.automaton = ahocorasick.Automaton()
            for text, (size, owners) in anchors.items():
                self.automaton.add_word(text, (len(text), size, owners))
            self.automaton.make_automaton()

    def runs(self, w: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, word after the last, item) of all runs of windows in a text's words."""
        if self.automaton is None or not w:
            return []
        text = f" {b' '.join(w).decode()} "
        matches = [(end - size + 1, owners) for end, (size, _, owners) in self.automaton.iter(text)]
        if not matches:
            return []
        before = np.cumsum(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
        out, done = [], {}
        for start, owners in matches:
            q = int(before[start]) - 1
            for number, p in owners:
                part = self.b.parts[number]
                if len(part) < self.b.window:
                    out.append((q, q + len(part), self.b.ids[number]))
                    continue
                if done.get((number, q - p), -1) > q:
                    continue
                lo, hi = 0, 0
                while lo < min(p, q) and part[p - lo - 1] == w[q - lo - 1]:
                    lo += 1
                most = min(len(part) - p, len(w) - q)
                while hi < most and part[p + hi] == w[q + hi]:
                    hi += 1
                done[number, q - p] = q + hi
                if lo + hi >= self.b.window:
                    out.append((q - lo, q + hi, self.b.ids[number]))
        return out


@worker_cache("benchmark")
def _scanner(uid: str, broadcast) -> Scanner:
    return Scanner(broadcast.value)


def described(text: str | None, n_words: int, runs: list[tuple[int, int, str]]) -> tuple[int, list[str], list[dict]]:
    """Hit words, items and hit spans of a text with these runs."""
    if not runs:
        return 0, [], []
    edge = np.zeros(n_words + 1, np.int64)
    for a, b, _ in runs:
        edge[a] += 1
        edge[b] -= 1
    hit = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    at = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
    spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(turns[::2], turns[1::2], strict=True)]
    return int(hit.sum()), sorted({i for _, _, i in runs}), spans


def _columns(rows: list[tuple[int, int, list[str], list[dict]]], per: int) -> list[pa.Array]:
    n, hit, found, spans = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, span), pa.array([h > 0 and per * h >= k for k, h in zip(n, hit, strict=True)], pa.bool_())]


def _words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, least_share: float = 0.05, most_chars: int = 2_000_000) -> DataFrame:
    """docs with n_words, n_hit, item_ids (sorted as strings), hit_spans (code points) and contaminated.

    A word is hit if it lies in an occurrence of a window of the benchmark; a document is contaminated
    if it has hit words and their share is least_share or more. Null and empty texts have no words and
    are clean; an empty benchmark marks nothing; repeated items count once; a null item id reads
    "null". Columns of docs with the names of outputs are replaced, others pass through.

    most_chars: characters of the benchmark in one automaton, about 100 bytes each. A larger benchmark is dealt into several by a hash,
    which are broadcast and scanned in turn; only the runs that each finds are kept.
    """
    per = round(1 / least_share)
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.col(item_text).alias("text"))
    long_words = max(window, most_chars // 64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, b" ".join(p).decode()) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True) for p in parts_of(t, window, long_words)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["id", "part"])

    parts = keep(map_batches(items, cut, "id string, part string").distinct(), "items")
    chars = parts.agg(F.sum(F.length("part") + 1)).first()[0] or 0
    slices = max(1, -(-chars // max(1, int(0.8 * most_chars)))) if chars > most_chars else 1

    def slice_of(number: int):
        rows = parts.where(F.pmod(F.xxhash64("id", "part"), F.lit(slices)) == number).collect()
        made = Benchmark(uuid.uuid4().hex, window, [r.id for r in rows], [r.part.encode().split() for r in rows])
        return made.uid, spark.sparkContext.broadcast(made)

    if slices == 1:
        uid, shared = slice_of(0)

        def fn(batch: pa.RecordBatch) -> list:
            scanner, rows = _scanner(uid, shared), []
            for t in batch.column(text):
                t = t.as_py()
                w = _words(t)
                rows.append((len(w), *described(t, len(w), scanner.runs(w))))
            return _columns(rows, per)

        return append_columns(docs, OUTPUT, fn, "benchmark")

    drop = [f.name for f in OUTPUT if f.name in docs.columns and f.name != text]
    row, runs = unused(docs, "_row", "_runs")
    rows = keep(docs.drop(*drop).withColumn(row, F.expr("uuid()")), "scanned")
    own = rows.select(F.col(row).alias("row"), F.col(text).alias("text"))
    found = []
    for number in range(slices):
        uid, shared = slice_of(number)

        def hits(batches: Iterator[pa.RecordBatch], uid=uid, shared=shared) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(uid, shared)
            for b in batches:
                out = [(i, *r) for i, t in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True) for r in scanner.runs(_words(t))]
                cols = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["row", "a", "b", "id"])

        found.append(keep(map_batches(own, hits, "row string, a long, b long, id string", "benchmark"), "runs"))
        shared.unpersist()
    every = functools.reduce(DataFrame.unionByName, found).distinct().groupBy("row").agg(F.collect_list(F.struct("a", "b", "id")).alias(runs)).withColumnRenamed("row", f"{row}_r")

    def described_rows(batch: pa.RecordBatch) -> list:
        out = []
        for t, r in zip(batch.column(text).to_pylist(), batch.column(runs).to_pylist(), strict=True):
            n = len(_words(t))
            out.append((n, *described(t, n, [(x["a"], x["b"], x["id"]) for x in r or []])))
        return _columns(out, per)

    joined = rows.join(every, F.col(row) == F.col(f"{row}_r"), "left").drop(f"{row}_r")
    return append_columns(joined, OUTPUT, described_rows).drop(row, runs)


def digest(items: list[str]) -> str:
    """Lowercase hex of the comma-joined ids, as the query reports them."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
