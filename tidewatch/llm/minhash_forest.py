"""MinHash near-duplicates with an LSH forest.

Every distinct set of shingles has a signature of minimum hashes. A tree of the forest is one order of
the signature; its rows, sorted by that order's label, have near-duplicates side by side, those with the
longest common prefix nearest. Rows that share a label's first ``SHALLOW`` hashes are a region. A region of
more than ``LEAF`` rows is parted by its next hash, again and again, so depth adapts to how dense it is;
rows that agree in a whole label are taken with their neighbours in overlapping runs. In a leaf, rows
whose signatures agree well enough are alike.

1. Documents with equal sets are one class; classes in regions of one row drop out early.
2. Sorted rows pass through as a stream. Each leaf gives a spanning forest of rows that are alike, not
   pairs: joined over all trees, they are families.
3. Leaves do not show all of a region of more than ``LEAF`` rows. If such a region holds several families,
   its rows outside the largest are compared with all its rows, in cells of two blocks over many tasks,
   and each cell again gives a forest. A region with very many such rows is first parted by ``FRESH``
   further orders of its own, twice at most; a region of one family costs nothing.
4. Only members of one family can be linked. Each family's full sets meet in one task, or, if it is large,
   in blocks dealt twice at random and then, for members outside its largest component, in cells. The sets
   are compared whole, by a product of matrices over shingles that two of them share, and links leave as
   a forest, so no step writes more rows for a family than in proportion to its members.

A step's task holds two blocks of ``BLOCK`` rows (``BLOCK_SHINGLES`` shingles) at most, or one document that
is larger. Labels are dealt out by sorted ranges, so a region with a third of all rows spreads over many
tasks; a small region cut by such a border loses a tree's view of it, the other trees have other orders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import keep
from .common import map_batches
from .components import components

HASHES, TREES, DEPTH, SHALLOW = 128, 32, 8, 4
LEAF = 32
BLOCK, BLOCK_SHINGLES = 512, 500_000
HELD = 65_536  # rows of a region that a stream of sorted rows holds before it cuts it
FRESH, LEVELS, MANY = 8, 2, 4096  # fresh orders of a region with more than MANY rows outside its largest family, and how often
SLACK = 0.14  # four standard deviations of a share of 128 hashes at a similarity of 0.8
MOST_BROADCAST = 1_000_000

_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
ORDERS = np.concatenate([_rng.permutation(HASHES).reshape(-1, DEPTH) for _ in range(TREES * DEPTH // HASHES)])
FRESH_ORDERS = np.stack([_rng.permutation(HASHES)[: FRESH * SHALLOW].reshape(FRESH, SHALLOW) for _ in range(LEVELS)])
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of each word, kept for up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of n words; fewer words are one shingle; no words give none."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    s = np.full(len(h) - k + 1, k if k < n else 0, np.uint64)
    for i in range(k):
        s = (s ^ h[i : len(h) - k + 1 + i]) * _MIX
        s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    small = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(small), 2048):
        low = np.minimum(low, (_MULTIPLY[:, None] * small[None, i : i + 2048] + _ADD[:, None]).min(1))
    return low


def sign(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, key, signature): key names the set; both are null for documents without words."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            size, key, sig = [], [], []
            for t in b.column("text"):
                s = shingle_set(t.as_py(), n, hashes)
                size.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "key", "signature"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fn, "doc_id long, n_shingles long, key binary, signature binary")


def _signatures(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value of each row of bytes."""
    rows = np.ascontiguousarray(rows)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _bytes(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _region(start: np.ndarray, sig: np.ndarray, order: np.ndarray) -> np.ndarray:
    r = start.copy()
    for k in order:
        r = (r ^ sig[:, k]) * _MIX
        r ^= r >> np.uint64(31)
    return r


def regions(classes: DataFrame) -> DataFrame:
    """(region, cid): a row for each class and tree; region is a hash of the tree and the first hashes."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _signatures(b).astype(np.uint64)
            for t, order in enumerate(ORDERS):
                r = _region(np.full(len(sig), t + 1, np.uint64), sig, order[:SHALLOW])
                yield pa.RecordBatch.from_arrays([pa.array(r.view(np.int64)), b.column("cid")], names=["region", "cid"])

    return map_batches(classes.select("cid", "signature"), fn, "region long, cid long")


def parted(rows: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    """(region, cid): each row of a region in a part of it by each of the level's fresh orders."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, region = _signatures(b).astype(np.uint64), b.column("region").to_numpy().view(np.uint64)
            for t, order in enumerate(FRESH_ORDERS[level]):
                r = _region(region + np.uint64(t + 1), sig, order)
                yield pa.RecordBatch.from_arrays([pa.array(r.view(np.int64)), b.column("cid")], names=["region", "cid"])

    return map_batches(rows.join(classes.select("cid", "signature"), "cid").select("region", "cid", "signature"), fn, "region long, cid long")


def labels(classes: DataFrame) -> DataFrame:
    """(label, cid, bits): a row for each class and tree; label is the tree and its hashes, bits a byte of each hash."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _signatures(b)
            bits = _binary((sig & 0xFF).astype(np.uint8))
            for t, order in enumerate(ORDERS):
                rows = np.empty((len(sig), 1 + 4 * DEPTH), np.uint8)
                rows[:, 0] = t
                rows[:, 1:] = np.ascontiguousarray(sig[:, order].astype(">u4")).view(np.uint8)
                yield pa.RecordBatch.from_arrays([_binary(rows), b.column("cid"), bits], names=["label", "cid", "bits"])

    return map_batches(classes.select("cid", "signature"), fn, "label binary, cid long, bits binary")


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bytes each row of x shares with each row of y, at their places."""
    out = np.empty((len(x), len(y)), np.int16)
    for i in range(0, len(x), 64):
        same = (x[i : i + 64, None, :] == y[None, :, :]).view(np.uint64).sum(2)  # eight counts of bytes in each number
        out[i : i + 64] = (same * np.uint64(0x0101010101010101)) >> np.uint64(56)
    return out


def forest(good: np.ndarray, x: np.ndarray, y: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Of good pairs (i, j) of the rows x[i] and y[j], as many as join what they can join; comp: what is joined before."""
    label = np.unique(comp, return_inverse=True)[1]
    out = []
    for i in np.flatnonzero(good.any(1)).tolist():
        js = np.flatnonzero(good[i])
        others, first = np.unique(label[y[js]], return_index=True)
        own = label[x[i]]
        new = others != own
        if new.any():
            out += [(int(x[i]), int(y[js[k]])) for k in first[new]]
            label[np.isin(label, others[new])] = own
    return out


def leaves(label: np.ndarray, lo: int, hi: int, depth: int) -> Iterator[tuple[int, int]]:
    """Runs of rows lo:hi, sorted by label, of LEAF rows at most, which share as long a prefix as that takes."""
    if hi - lo < 2:
        return
    if hi - lo <= LEAF:
        yield lo, hi
    elif depth == DEPTH:
        for i in range(lo, hi - LEAF // 2, LEAF // 2):
            yield i, min(i + LEAF, hi)
    else:
        part = label[lo:hi, 1 + 4 * depth : 5 + 4 * depth]
        cuts = lo + 1 + np.flatnonzero((part[1:] != part[:-1]).any(1))
        for a, b in pairwise([lo, *cuts.tolist(), hi]):
            yield from leaves(label, a, b, depth + 1)


def region_starts(label: np.ndarray) -> np.ndarray:
    """The first row of each region of sorted rows, and the number of rows."""
    head = label[:, : 1 + 4 * SHALLOW]
    return np.concatenate(([0], 1 + np.flatnonzero((head[1:] != head[:-1]).any(1)), [len(label)]))


def leaf_forest(label: np.ndarray, cid: np.ndarray, bits: np.ndarray, least: float) -> set[tuple[int, int]]:
    """Spanning forests of the rows that are alike in the leaves of sorted rows."""
    found: set[tuple[int, int]] = set()
    starts = region_starts(label)
    size = np.diff(starts)
    twos = starts[:-1][size == 2]
    if len(twos):
        twos = twos[(bits[twos] == bits[twos + 1]).sum(1) >= least * HASHES]
        found.update(zip(cid[twos].tolist(), cid[twos + 1].tolist(), strict=True))
    for lo, n in zip(starts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
        for a, b in leaves(label, lo, lo + n, SHALLOW):
            good = np.triu(agreement(bits[a:b], bits[a:b]) >= least * HASHES, 1)
            if good.any():
                rows = np.arange(b - a)
                found.update((int(cid[a + i]), int(cid[a + j])) for i, j in forest(good, rows, rows, rows))
    return {(min(p), max(p)) for p in found if p[0] != p[1]}


def _pairs(rows) -> pa.RecordBatch:
    rows = sorted(rows)
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])


def alike(classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): forests of classes (cid, signature) that are alike, from the leaves of all trees; a pair may come from several."""
    least = similarity - SLACK

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            got = _bytes(b.column("label"), 1 + 4 * DEPTH), b.column("cid").to_numpy(), _bytes(b.column("bits"), HASHES)
            held = got if held is None else tuple(map(np.concatenate, zip(held, got, strict=True)))
            last = int(region_starts(held[0])[-2])
            last = len(held[0]) if len(held[0]) - last > HELD else last
            if last:
                yield _pairs(leaf_forest(*(x[:last] for x in held), least))
                held = tuple(x[last:] for x in held) if last < len(held[0]) else None
        if held is not None:
            yield _pairs(leaf_forest(*held, least))

    rows = labels(classes)
    return map_batches(rows.repartitionByRange("label", "cid").sortWithinPartitions("label", "cid"), fn, "a long, b long")


def deal(rows: DataFrame, blocks: Callable[[Column, Column], Column]) -> DataFrame:
    """(grp, lo, hi, side, uu, cid, comp): rows (grp, cid, comp, weight) of groups of several components, once for each cell.

    A group's rows outside its largest component are in blocks lo, each compared with every block hi of theirs (uu) and of
    that component. side is 0 for rows of lo, 1 for rows of hi, 2 for rows of both. blocks(n, weight): blocks of n rows."""
    part = rows.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    part = part.groupBy("grp").agg(F.max(F.struct("n", "comp", "w")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("n > main.n")
    part = part.select(F.col("grp").alias("_grp"), F.col("main.comp").alias("main"), blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("nu"), blocks(F.col("main.n"), F.col("main.w")).alias("nm"))
    rows = rows.join(part, F.col("grp") == F.col("_grp"))
    outside, nu, nm = F.col("comp") != F.col("main"), F.col("nu"), F.col("nm")
    own = F.pmod(F.xxhash64("cid"), F.when(outside, nu).otherwise(nm)).cast("int")
    cell = lambda lo, hi, side, uu: F.struct(lo.alias("lo"), hi.alias("hi"), side.alias("side"), F.lit(uu).alias("uu"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    among = F.transform(upto(nu), lambda j: cell(F.least(F.col("own"), j), F.greatest(F.col("own"), j), F.when(F.col("own") < j, 0).when(F.col("own") > j, 1).otherwise(2), True))
    to_main = F.transform(upto(nm), lambda j: cell(F.col("own"), nu + j, F.lit(0), False))
    of_main = F.transform(upto(nu), lambda i: cell(i, nu + F.col("own"), F.lit(1), False))
    dealt = rows.withColumn("own", own).select("grp", "cid", "comp", F.explode(F.when(outside, F.concat(among, to_main)).otherwise(of_main)).alias("c"))
    return dealt.select("grp", "c.lo", "c.hi", "c.side", "c.uu", "cid", "comp")


def joined_in_cells(dealt: DataFrame, payload: DataFrame, name: str, test: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(a, b): forests of the pairs that pass, from each cell of dealt rows; payload: (cid, name) binary.

    test(values, x, y): whether the rows x pass with the rows y, as a matrix."""

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        side, cid, comp = (t.column(c).to_numpy() for c in ("side", "cid", "comp"))
        x, y = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if len(x) and len(y) and (comp != comp[0]).any():
            good = test(t.column(name).to_pylist(), x, y) & (comp[x][:, None] != comp[y][None, :])
            if good.any():
                yield _pairs((min(p), max(p)) for p in ((int(cid[i]), int(cid[j])) for i, j in forest(good, x, y, comp)))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cell = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("grp", "lo", "hi")], 1)
            cuts = 1 + np.flatnonzero((keys[1:] != keys[:-1]).any(1))
            for lo, hi in pairwise([0, *cuts.tolist(), len(keys)]):
                if held and tuple(keys[lo]) != cell:
                    yield from done(held)
                    held = []
                cell = tuple(keys[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from done(held)

    rows = dealt.select("grp", "lo", "hi", "side", "cid", "comp").join(payload.select("cid", name), "cid")
    rows = rows.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "cid")
    return map_batches(rows, fn, "a long, b long")


def few_bits(classes: DataFrame) -> DataFrame:
    """(cid, bits): a byte of each hash."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("cid"), _binary((_signatures(b) & 0xFF).astype(np.uint8))], names=["cid", "bits"])

    return map_batches(classes.select("cid", "signature"), fn, "cid long, bits binary")


def full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cid, shingles) of the wanted classes (cid, rep, key), from the whole text of the document rep."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(t.as_py(), n, hashes).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["key", "shingles"])

    ids = wanted.select(F.col("rep").alias("_rep")).distinct()
    ids = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("_rep"), "left_semi")
    sets = map_batches(texts.select("text"), fn, "key binary, shingles binary")
    return sets.join(wanted.select("cid", "key"), "key").groupBy("cid").agg(F.first("shingles").alias("shingles"))


def intersections(values: list[bytes], x: np.ndarray, y: np.ndarray, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets, and of the intersections of the sets x with the sets y: a product over the shingles that two sets share."""
    sets = [np.frombuffer(v, np.uint64) for v in values]
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner, sorted_ = np.repeat(np.arange(len(sets)), sizes)[order], every[order]
    same = np.concatenate((sorted_[1:] == sorted_[:-1], [False]))
    shared = same | np.concatenate(([False], same[:-1]))
    column = np.cumsum(np.concatenate(([True], ~same[:-1])))[shared]
    owner = owner[shared]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    out = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m[x] @ m[y].T
    return sizes, out.astype(np.int64)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """For each row of docs (doc_id, text; others ignored): doc_id, n_shingles, component_id and kept.

    Links are pairs of similarity percent / 100 or more. component_id is the smallest doc_id of the linked documents, kept
    whether it is the row's own. Null and empty texts have no shingles and stand alone, as do rows with null ids (component
    null, kept). Rows of equal ids and texts are both kept if their id is the smallest. Texts are read whole."""
    least = percent / 100 - SLACK
    signed = keep(sign(docs, shingle), "signed")
    classes = signed.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("weight"), F.first("signature").alias("signature"))
    classes = keep(classes.select(F.monotonically_increasing_id().alias("cid"), "key", "rep", "weight", "signature"), "classes")
    dense = regions(classes)
    crowded = dense.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dense = keep(dense.join(crowded, "region"), "regions")
    near = keep(dense.select("cid").distinct().join(classes, "cid"), "near")

    edges = keep(alike(near, percent / 100).distinct(), "alike")
    families = keep(components(edges), "families")
    crowds = dense.where(F.col("n") > LEAF).select(F.col("region").alias("grp"), "cid")
    more = crowds_alike(crowds, near, families, least)
    if more is not None:
        families = keep(components(edges.unionByName(more)), "families")

    members = families.select(F.col("node").alias("cid"), F.col("component").alias("grp")).join(near.select("cid", "rep", "key", "weight"), "cid")
    members = keep(members, "members")
    sets = keep(full_sets(docs, members, shingle), "sets")

    def linked(values: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        sizes, both = intersections(values, x, y)
        return 100 * both >= percent * (sizes[x][:, None] + sizes[y][None, :] - both)

    count = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    count = keep(count.select(F.col("grp").alias("_grp"), blocks_of_sets(F.col("n"), F.col("w")).alias("nb")), "sizes")
    sized = members.join(count, F.col("grp") == F.col("_grp"))
    block = lambda salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col("nb")).cast("int")
    as_cell = lambda salt: sized.select("grp", block(salt).alias("lo"), F.lit(salt).alias("hi"), F.lit(2).alias("side"), "cid", F.col("cid").alias("comp"))
    large = count.where("nb > 1")
    some_large = not large.isEmpty()
    dealt = as_cell(0)
    if some_large:
        again = as_cell(1).join(large.select("_grp"), F.col("grp") == F.col("_grp"), "left_semi")
        dealt = dealt.unionByName(again)
    links = keep(joined_in_cells(dealt, sets, "shingles", linked), "links")
    if some_large:
        own = members.join(large.select("_grp"), F.col("grp") == F.col("_grp"), "left_semi")
        rest = deal(with_component(own.select("grp", "cid", "weight"), components(links)), blocks_of_sets)
        links = links.unionByName(keep(joined_in_cells(rest, sets, "shingles", linked), "links"))

    joined = components(links)
    named = classes.select("cid", "key", "rep").join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "component").select("key", "component_id")
    rows = signed.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def with_component(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """rows (cid, others) with comp: its component, itself without one."""
    joined = joined.select(F.col("node").alias("_node"), "component")
    return rows.join(joined, F.col("cid") == F.col("_node"), "left").withColumn("comp", F.coalesce("component", "cid")).drop("component", "_node")


def blocks_of_rows(n: Column, weight: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def blocks_of_sets(n: Column, weight: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(weight / BLOCK_SHINGLES)).cast("int")


def crowds_alike(crowds: DataFrame, near: DataFrame, families: DataFrame, least: float) -> DataFrame | None:
    """(a, b): forests over the families of crowds (grp, cid), regions that leaves do not show whole; None if none holds two."""

    def test(values: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(b"".join(values), np.uint8).reshape(-1, HASHES)
        return agreement(bits[x], bits[y]) >= least * HASHES

    found = None
    for level in range(LEVELS + 1):
        rows = with_component(crowds, families).withColumn("weight", F.lit(1))
        outside = rows.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg((F.sum("n") - F.max("n")).alias("outside")).where("outside > 0")
        outside = keep(outside.withColumnRenamed("grp", "_grp"), "open")
        if outside.isEmpty():
            return found
        many = outside.where(F.col("outside") > MANY) if level < LEVELS else outside.limit(0)
        split = level < LEVELS and not many.isEmpty()
        whole = rows.join(outside.where(F.col("outside") <= MANY) if split else outside, F.col("grp") == F.col("_grp"), "left_semi")
        part = keep(joined_in_cells(deal(whole, blocks_of_rows), few_bits(near), "bits", test), "alike")
        found = part if found is None else found.unionByName(part)
        if not split:
            return found
        parts = parted(crowds.join(many, F.col("grp") == F.col("_grp"), "left_semi").select(F.col("grp").alias("region"), "cid"), near, level)
        several = parts.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("region").alias("_region"))
        crowds = keep(parts.join(several, F.col("region") == F.col("_region"), "left_semi").select(F.col("region").alias("grp"), "cid"), "parts")
    return found
