"""Toxicity by weak supervision.

1. Lexicons: a fixed one of English insults, and words and word beginnings that mark toxic rows among a
   bounded sample of labelled rows (the held-out fold is never read; near copies count once).
2. Voters: lexicons, parts of them and patterns each vote on every document; a vote is whether it fires.
3. Label model: a latent class for each document; the chance that a voter fires in either class is its
   accuracy. EM runs over the counts of all documents' vote patterns, with the sampled labels as rows of
   known class. Voters whose votes still correlate inside a class are joined into cliques, which have one
   joint table instead of independent chances, and EM runs again.
4. Classifier: logistic regression over lexicon entries and patterns, fitted to the posteriors of all
   documents, grouped by equal votes and features (a bounded number of groups, each with its count); it
   scores each text on its own.

Labels only reach the model through sampled rows; language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import keep
from .common import append_columns, map_batches
from .decontaminate import _TABLE

# Common English insults.
INSULTS = ("clown", "disgusting", "dumb", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless")
BEGINNINGS = (4, 5, 6)
PARTS = 4
VOTERS = ("insult", "two insults", *(f"words {k}" for k in range(PARTS)), *(f"beginnings of {n}" for n in BEGINNINGS), "any entry", "three entries", "dense entries", "shouting", "exclamations", "long runs")
_RUN = re.compile(rb"(.)\1\1\1(?<![\s0-9])")
FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 5; a null id has that of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def tokens_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked by a final "*"."""
    w = word.decode()
    return [word, *(w[:n].encode() + b"*" for n in BEGINNINGS if len(w) >= n)]


@dataclass
class Lexicon:
    """Entries by number: fixed insults first, then learned words and beginnings."""

    entries: list[bytes]
    insults: int
    number: dict[bytes, int] = field(default_factory=dict)
    cache: dict[bytes, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.number = {e: i for i, e in enumerate(self.entries)}
        self.fronts = {e.rstrip(b"*")[:4] for e in self.entries}

    def __getstate__(self):
        return {"entries": self.entries, "insults": self.insults}

    def __setstate__(self, state):
        self.__init__(**state)

    def of(self, word: bytes) -> tuple[int, ...]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > 40_000:
                self.cache.clear()
            found = self.cache[word] = tuple(self.number[t] for t in tokens_of(word) if t in self.number)
        return found

    @property
    def width(self) -> int:
        return len(self.entries) + len(VOTERS)

    def read(self, text: str | None) -> tuple[int, list[int]]:
        """Votes as bits, and features: entries that occur and voters that fire."""
        raw = (text or "").encode()
        words = raw.translate(_TABLE).split()
        fronts = self.fronts  # an entry's first bytes are those of its words
        marked = {w: found for w in set(words) if w[:4] in fronts and (found := self.of(w))}
        hits: set[int] = set().union(*marked.values())
        insults = sum(h < self.insults for h in hits)
        learned = [self.entries[h] for h in hits if h >= self.insults]
        upper = len(raw) - len(raw.translate(None, _CAPITALS))
        lower = len(raw) - len(raw.translate(None, _SMALL)) if upper else 1
        votes = [insults >= 1, insults >= 2]
        votes += [any(not e.endswith(b"*") and zlib.crc32(e) % PARTS == k for e in learned) for k in range(PARTS)]
        votes += [any(e.endswith(b"*") and len(e.decode()) == n + 1 for e in learned) for n in BEGINNINGS]
        votes += [len(marked) >= 1, len(marked) >= 3, len(marked) >= 1 and 100 * sum(map(marked.__contains__, words)) >= len(words)]
        votes += [upper > lower, raw.count(b"!!") >= 3, bool(_RUN.search(raw))]
        mask = sum(1 << i for i, v in enumerate(votes) if v)
        return mask, sorted(hits) + [len(self.entries) + i for i, v in enumerate(votes) if v]


_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SMALL = _CAPITALS.lower()


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most `most` labelled rows of each class outside the held-out fold, by a hash of the id.

    Ids with both labels, null labels and null ids are left out. The chosen ids, a bounded number, are broadcast."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_other")).where("toxic = _other")
    by_hash = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for t in (0, 1)]
    chosen = by_hash[0].union(by_hash[1]).select(F.col("doc_id").alias("_id"), "toxic")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic")


def learn_lexicon(sample: DataFrame, most_entries: int, least_share: float = 0.005, least_ratio: float = 20.0) -> Lexicon:
    """Words and beginnings whose share among toxic rows is least_ratio times that among others."""
    schema = "toxic int, a long, b long, tokens array<string>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words = set((text or "").encode().translate(_TABLE).split())
                tokens = {t for w in words for t in tokens_of(w)}
                keys = np.array([zlib.crc32(w) for w in words] or [0], np.uint64)
                a, c = (int((keys * np.uint64(m) & np.uint64(0xFFFFFFFF)).min()) for m in (2654435761, 2246822519))
                rows.append((toxic, a, c, [t.decode() for t in tokens]))
            cols = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["toxic", "a", "b", "tokens"])

    rows = map_batches(sample.select("text", F.col("toxic").cast("int").alias("toxic")), read, schema)
    row = F.struct("toxic", "a", "b", "tokens")
    for key in ("a", "b"):  # near copies share a smallest hash, most of them
        rows = rows.groupBy(key).agg(F.min(row).alias("r")).select("r.*")
    rows = keep(rows, "labelled")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    counts = rows.select("toxic", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    ratio = (F.col("pos") + 0.5) / (toxic + 1) / ((F.col("neg") + 0.5) / (clean + 1))
    good = counts.where((F.col("pos") >= max(4, least_share * toxic)) & (ratio >= least_ratio)).orderBy(ratio.desc(), F.desc("pos"), "token").limit(most_entries)
    learned = [r.token.encode() for r in good.collect()]
    fixed = [w.encode() for w in INSULTS]
    return Lexicon(fixed + [t for t in learned if t not in set(fixed)], len(fixed))


@dataclass
class LabelModel:
    """Chances of votes in each class, by clique of voters."""

    prior: float
    cliques: list[list[int]]
    tables: list[np.ndarray]
    correlations: dict[tuple[int, int], float]

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        """Chance of the toxic class for each vote pattern."""
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(masks), 1))
        for clique, table in zip(self.cliques, self.tables, strict=True):
            log += np.log(table[_cells(masks, clique)])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """For each voter, its chance to fire on clean and on toxic documents."""
        out = {}
        for clique, table in zip(self.cliques, self.tables, strict=True):
            for k, v in enumerate(clique):
                fires = [(c >> k) & 1 == 1 for c in range(len(table))]
                out[VOTERS[v]] = tuple(map(float, table[fires].sum(0)))
        return out


def _cells(masks: np.ndarray, clique: list[int]) -> np.ndarray:
    return sum(((masks >> v) & 1) << k for k, v in enumerate(clique))


def _em(masks: np.ndarray, counts: np.ndarray, known: np.ndarray, start: np.ndarray, cliques: list[list[int]], rounds: int = 60) -> LabelModel:
    """known: labelled rows of each pattern and class; start: chance of toxic for each pattern to begin with."""
    chance = start
    for _ in range(rounds):
        weight = np.stack([counts * (1 - chance), counts * chance], 1) + known
        prior = float(np.clip(weight[:, 1].sum() / max(weight.sum(), 1e-9), 1e-4, 0.6))
        tables = []
        for clique in cliques:
            t = np.stack([np.bincount(_cells(masks, clique), weight[:, c], 1 << len(clique)) for c in (0, 1)], 1) + 0.1 / (1 << len(clique))
            tables.append(t / t.sum(0))
        model = LabelModel(prior, cliques, tables, {})
        moved, chance = chance, model.posterior(masks)
        if np.abs(moved - chance).max(initial=0.0) < 1e-6:
            break
    return model


def fit_label_model(masks: np.ndarray, counts: np.ndarray, known: np.ndarray, least: float = 0.25, most: int = 6) -> LabelModel:
    """EM with independent voters, then with cliques of voters that correlate by `least` or more inside a class."""
    voters = range(len(VOTERS))
    evidence = known + 0.5 * np.array([[1, 0]]) * (masks == 0)[:, None]
    told = known.sum(1) > 0
    start = np.where(told, (evidence[:, 1] + 0.05) / (evidence.sum(1) + 0.5), np.where((masks & 3) > 0, 0.9, 0.05))
    model = _em(masks, counts, known, start, [[v] for v in voters])
    chance = model.posterior(masks)
    bits = np.stack([(masks >> v) & 1 for v in voters], 1).astype(float)
    found: dict[tuple[int, int], float] = {}
    for w in (counts * (1 - chance), counts * chance):
        if w.sum() < 2:
            continue
        mean = (w[:, None] * bits).sum(0) / w.sum()
        cov = (bits - mean).T @ ((bits - mean) * w[:, None]) / w.sum()
        dev = np.sqrt(np.diag(cov))
        for i in voters:
            for j in range(i):
                if dev[i] > 0.01 and dev[j] > 0.01:
                    r = float(cov[i, j] / dev[i] / dev[j])
                    if abs(r) > abs(found.get((j, i), 0)):
                        found[j, i] = r
    group = {v: [v] for v in voters}
    for (i, j), r in sorted(found.items(), key=lambda x: -abs(x[1])):
        if abs(r) >= least and group[i] is not group[j] and len(group[i]) + len(group[j]) <= most:
            joined = sorted(group[i] + group[j])
            group |= {v: joined for v in joined}
    cliques = [list(g) for g in sorted({tuple(g) for g in group.values()})]
    model = _em(masks, counts, known, chance, cliques)
    model.correlations = found
    return model


def fit_linear(rows: list[list[int]], target: np.ndarray, counts: np.ndarray, width: int, l2: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression over sets of features, each as often as counts says, classes weighing alike, by gradient steps with momentum."""
    w, b = np.zeros(width), 0.0
    if not rows:
        return w, -3.0
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    what = np.array([f for r in rows for f in r], np.int64)
    share = np.clip((target * counts).sum() / counts.sum(), 1e-3, 1 - 1e-3)
    weight = counts * np.where(target >= 0.5, 0.5 / share, 0.5 / (1 - share))
    weight = weight / weight.sum()
    vw, vb, step = np.zeros(width), 0.0, 2.0
    for _ in range(rounds):
        z = b + np.bincount(at, w[what], len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        vw = 0.9 * vw - step * (np.bincount(what, g[at], width) + l2 * w)
        vb = 0.9 * vb - step * g.sum()
        w, b = w + vw, b + vb
    return w, float(b)


SCORE = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with score and predicted; null and empty texts get the score of no features."""
        shared = docs.sparkSession.sparkContext.broadcast((self.lexicon, self.weights, self.bias))

        def fn(b: pa.RecordBatch) -> list:
            lexicon, weights, bias = shared.value
            z = np.array([bias + weights[lexicon.read(t.as_py())[1]].sum() for t in b.column("text")], float)
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            return [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))]

        return append_columns(docs, SCORE, fn)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 6_000, most_entries: int = 2_000, most_fitted: int = 10_000) -> ToxicityModel:
    """The model for docs (doc_id, text, others ignored) and labels (doc_id, toxic 0/1).

    most_labelled: labelled rows of each class that are read; most_entries: learned lexicon entries;
    most_fitted: different sets of votes and features of either side that the classifier is fitted to, by a hash of the set, each
    weighing as many documents as have it. Votes of all documents are counted. Without labels the fixed lexicon and patterns remain; without
    documents every text is scored as clean. Repeated rows count as often as they occur."""
    sample = labelled_sample(docs, labels, most_labelled)
    lexicon = learn_lexicon(sample, most_entries)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for b in batches:
            rows = [(t, *lexicon.read(x)) for t, x in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True)]
            cols = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, (pa.int32(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["toxic", "mask", "features"])

    schema = "toxic int, mask long, features array<int>"
    every = keep(map_batches(docs.select(F.lit(None).cast("int").alias("toxic"), "text"), votes, schema), "votes")
    told = map_batches(sample.select(F.col("toxic").cast("int").alias("toxic"), "text"), votes, schema).groupBy("mask", "toxic").count().collect()
    patterns = {r.mask: r["count"] for r in every.groupBy("mask").count().collect()}  # at most 2 ** len(VOTERS) rows
    masks = np.array(sorted(set(patterns) | {r.mask for r in told}), np.int64)
    where = {m: i for i, m in enumerate(masks.tolist())}
    known = np.zeros((len(masks), 2))
    for r in told:
        known[where[r.mask], r.toxic] += r["count"]
    model = fit_label_model(masks, np.array([patterns.get(m, 0) for m in masks.tolist()], float), known)
    chance = model.posterior(masks)
    marked = [int(m) for m, p in zip(masks, chance, strict=True) if p >= 0.5]
    groups = keep(every.groupBy("mask", "features").agg(F.count(F.lit(1)).alias("n")), "groups")
    sides = [groups.where(c).orderBy(F.xxhash64("features", "mask"), "mask").limit(most_fitted).collect() for c in (F.col("mask").isin(marked), ~F.col("mask").isin(marked))]
    rows = sides[0] + sides[1]
    target, counts = np.array([chance[where[r.mask]] for r in rows]), np.array([float(r.n) for r in rows])
    weights, bias = fit_linear([list(r.features) for r in rows], target, counts, lexicon.width)
    return ToxicityModel(lexicon, model, weights, bias)
