"""Embedding near-duplicates: a small-world graph per shard, every shard queried, links checked, components.

Vectors are compared inside a label (and length). Each label's rows are dealt out to shards by a hash of
the id; a shard's graph is written to the shared folder, and every block of the label's rows queries every
shard. See ``hnsw.links_of`` for how beams widen until the recall audit passes.

Hot balls: a label may hold one vector a great many times, slightly moved. From a bounded sample of a
label, centres of crowds are found. All vectors within half the limit's angle of a centre are linked with
each other, by the triangle inequality, so they are counted, not paired, and stay out of the graphs. A
vector outside a ball but within one and a half times the angle of its centre is compared with the ball's
members, in blocks. Balls change how links are counted, not which links there are.

Links are counted where they are found; only counts and a forest of the links leave a task, so a crowd
that the sample does not show gives rows in proportion to its vectors, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import keep, new_path
from ..plans.shipping import ship
from .common import map_batches, worker_cache
from .components import components
from .hnsw import Graph, links_of
from .token_store import open_fs

SAMPLE = 4096  # rows of a label in which crowds are sought
CROWD = 16  # rows of the sample that make a crowd
ASSIGN_ROWS = 16_384  # rows that meet a label's centres at once
SHARD_ROWS = 20_000
BLOCK_ROWS = 2048


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, unit binary) of rows that can link: no null, zero or non-finite vectors, labels or ids."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, label, v in zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist(), b.column("embedding"), strict=True):
                if not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(x).max(initial=0.0)
                if not top or not np.isfinite(top):
                    continue
                x = x / top  # keeps squares in range
                rows.append((i, label, len(x), (x / np.sqrt(x @ x)).tobytes()))
            cols = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.binary()), strict=True)], names=["vec_id", "label", "dim", "unit"])

    rows = vectors.where("vec_id is not null and label is not null and embedding is not null")
    return map_batches(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding"), fn, "vec_id long, label string, dim int, unit binary")


def _matrix(units) -> np.ndarray:
    units = list(units)
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1) if units else np.zeros((0, 0))


def _centres(least: float):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf.sort_values("vec_id").unit)
        half = np.cos(np.arccos(least) / 2)
        free, out = np.ones(len(x), bool), []
        near = x @ x.T >= least
        while True:
            count = (near & free[None, :]).sum(1) * free
            k = int(count.argmax()) if len(count) else 0
            if not len(count) or count[k] < CROWD:
                break
            c = x[near[k] & free].mean(0)
            c /= np.linalg.norm(c)
            inside = (x @ c >= half) & free
            if inside.sum() >= CROWD:
                out.append(c.tobytes())
            free &= ~(inside | near[k])
        return pd.DataFrame({"label": [pdf.label.iloc[0]] * len(out), "dim": [int(pdf.dim.iloc[0])] * len(out), "centre": out}).astype({"label": object, "dim": "int32", "centre": object})

    return fn


def _assign(rows: DataFrame, centres: DataFrame, least: float) -> DataFrame:
    """rows with ball (number of the centre, null outside all) and around (other balls it may link into).

    A label's centres, at most SAMPLE / CROWD, meet its rows block by block; labels without centres pass by."""
    angle = np.arccos(least)
    inner, outer = np.cos(angle / 2) + 1e-9, np.cos(min(1.5 * angle, np.pi)) - 1e-9
    names = ["vec_id", "label", "dim", "unit", "ball", "around"]

    def fn(key, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        ball, around = [], []
        if len(own):
            numbers = near.ball.to_numpy()
            s = _matrix(own.unit) @ _matrix(near.centre).T
            best = s.argmax(1)
            ball = [int(numbers[k]) if s[i, k] >= inner else None for i, k in enumerate(best)]
            around = [[int(x) for x in numbers[s[i] >= outer] if x != ball[i]] for i in range(len(own))]
        return own[["vec_id", "label", "dim", "unit"]].assign(ball=pd.Series(ball, own.index, dtype="Int64"), around=pd.Series(around, own.index, dtype=object))[names]

    kinds = centres.select(F.col("label").alias("_label"), F.col("dim").alias("_dim")).distinct()
    same = (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim"))
    sizes = rows.join(kinds, same, "left_semi").groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / ASSIGN_ROWS).cast("int").alias("blocks"))
    sizes = keep(sizes.withColumnsRenamed({"label": "_label", "dim": "_dim"}), "blocks")
    dealt = rows.join(sizes, same).withColumn("block", F.pmod(F.xxhash64("vec_id", "unit"), F.col("blocks")).cast("int"))
    met = centres.join(sizes, same).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("label", "dim", "block", "ball", "centre")
    place = ["label", "dim", "block"]
    schema = "vec_id long, label string, dim int, unit binary, ball long, around array<long>"
    ship(rows.sparkSession)
    assigned = dealt.select(*place, "vec_id", "unit").groupBy(*place).cogroup(met.groupBy(*place)).applyInPandas(fn, schema)
    others = rows.join(kinds, same, "left_anti").withColumns({"ball": F.lit(None).cast("long"), "around": F.expr("cast(array() as array<bigint>)")})
    return assigned.unionByName(others)


def _near_balls(rows: DataFrame, balls: DataFrame, least: float, block_rows: int) -> DataFrame:
    """(vec_id, n, ball): links between vectors around a ball and its members; ball is null on the members' rows.

    A ball's members are in blocks, as are the vectors around it, and each pair of blocks is a task. Rows of one vector come
    in several parts. A vector of another ball is asked from both sides, so only its own links are counted here; for a vector
    of no ball the members' are counted as well."""
    asking = rows.where(F.size("around") > 0).select("vec_id", "unit", F.col("ball").isNull().alias("free"), F.explode("around").alias("ball"))
    blocks = balls.join(asking.groupBy("ball").agg(F.count(F.lit(1)).alias("asks")), "ball")
    parts = lambda c, n: F.greatest(F.lit(1), F.ceil(F.col(c) / n)).cast("int")
    blocks = keep(blocks.select(F.col("ball").alias("_ball"), parts("members", block_rows).alias("own"), parts("asks", 4 * block_rows).alias("chunks")), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "unit"), F.col(n)).cast("int")
    ball = F.col("ball") == F.col("_ball")
    place = ["ball", "block", "chunk"]
    member = rows.where("ball is not null").join(blocks, ball).withColumn("block", dealt("own")).withColumn("chunk", every("chunks")).select(*place, "vec_id", "unit")
    asking = asking.join(blocks, ball).withColumn("chunk", dealt("chunks")).withColumn("block", every("own")).select(*[F.col(c).alias(c) for c in place], F.col("vec_id").alias("asking"), F.col("unit").alias("asked"), "free")

    def fn(key, asks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks) and len(own):
            x, y = _matrix(asks.asked), _matrix(own.unit)
            back = np.zeros(len(own), np.int64)
            for lo in range(0, len(x), 512):
                hit = x[lo : lo + 512] @ y.T >= least
                n = hit.sum(1)
                out += [(i, int(k), int(key[0])) for i, k in zip(asks.asking.iloc[lo : lo + 512], n, strict=True) if k]
                back += hit[asks.free.to_numpy()[lo : lo + 512]].sum(0)
            out += [(i, int(k), None) for i, k in zip(own.vec_id, back, strict=True) if k]
        return pd.DataFrame(out, columns=["vec_id", "n", "ball"]).astype({"vec_id": "int64", "n": "int64", "ball": "Int64"})

    ship(rows.sparkSession)
    return asking.groupBy(*place).cogroup(member.groupBy(*place)).applyInPandas(fn, "vec_id long, n long, ball long")


def _build(rows: DataFrame, folder: str) -> DataFrame:
    """A graph file for each (label, dim, shard)."""

    def fn(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "unit"])
        x = _matrix(pdf.unit)
        blob = Graph(x, pdf.vec_id.to_numpy()).dumps()
        import hashlib
        import uuid

        path = f"{folder}/{hashlib.md5(repr(key).encode()).hexdigest()}"
        f, where = open_fs(path)
        f.create_dir(where.rpartition("/")[0], recursive=True)
        part = f"{where}.{uuid.uuid4().hex}"
        with f.open_output_stream(part) as out:
            out.write(len(blob).to_bytes(8, "little") + blob + x.tobytes())
        f.move(part, where)
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "blocks": [int(pdf.blocks.iloc[0])], "path": [path]}).astype({"label": object, "dim": "int32", "shard": "int32", "blocks": "int32", "path": object})

    return rows.groupBy("label", "dim", "shard").applyInPandas(fn, "label string, dim int, shard int, blocks int, path string")


@worker_cache("graph")
def _load(path: str) -> tuple[Graph, np.ndarray]:
    f, where = open_fs(path)
    with f.open_input_stream(where) as s:
        raw = s.read()
    n = int.from_bytes(raw[:8], "little")
    graph = Graph.loads(raw[8 : 8 + n])
    return graph, np.frombuffer(raw[8 + n :], np.float64).reshape(len(graph.x), -1)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """As many of the links (a, b) as join what all of them join."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _query(rows: DataFrame, graphs: DataFrame, least: float) -> DataFrame:
    """What each block of rows finds in each shard of its label: rows (vec_id, n), how many links a vector has there; rows
    (vec_id, other), a forest of the links; and a row (hit, total), the audit's links found and all of them."""
    names = ["vec_id", "n", "other", "hit", "total"]

    def fn(key, asks: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asks) and len(files):
            graph, exact = _load(files.path.iloc[0])
            asks = asks.sort_values(["vec_id", "unit"])
            ids = asks.vec_id.to_numpy()
            q, v, audit = links_of(graph, exact, _matrix(asks.unit), least)
            a, b = ids[q], graph.ids[v]
            found = np.unique(np.stack([a, b], 1)[a != b], axis=0)
            who, n = np.unique(found[:, 0], return_counts=True)
            out += [(i, k, None, None, None) for i, k in zip(who.tolist(), n.tolist(), strict=True)]
            out += [(x, None, y, None, None) for x, y in _forest(found[:, 0], found[:, 1])]
            if audit["total"]:
                out.append((None, None, None, audit["hit"], audit["total"]))
        return pd.DataFrame(out, columns=names).astype(dict.fromkeys(names, "Int64"))

    place = ["label", "dim", "shard", "block"]
    asks = rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    files = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return asks.groupBy(*place).cogroup(files.groupBy(*place)).applyInPandas(fn, ", ".join(f"{n} long" for n in names))


def near_duplicates(vectors: DataFrame, least: float = 0.98, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, least_recall: float = 0.99) -> DataFrame:
    """For each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id and kept.

    n_links counts other vectors of the same label with a cosine of `least` or more; component_id is the smallest vec_id
    that links reach, kept whether it is the row's own. Vectors that are null, zero or hold null or non-finite numbers,
    and rows with null labels, link with nothing; vectors of other lengths neither. Rows with null ids stand alone, kept,
    with a null component. Ids should be distinct: rows of one id count as one vector. Other columns are ignored.
    Fails if the audits of all shards together find a smaller share of their links than least_recall."""
    out, audit = with_audit(vectors, least, shard_rows, block_rows)
    if audit["hit"] < least_recall * audit["total"]:
        raise RuntimeError(f"graphs found {audit['hit']} of {audit['total']} audited links")
    return out


def with_audit(vectors: DataFrame, least: float = 0.98, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, dict[str, int]]:
    """What near_duplicates returns, and the audited links of all shards: hit, those that graphs found, of total."""
    spark = vectors.sparkSession
    ship(spark)
    rows = keep(unit_vectors(vectors), "units")
    sizes = rows.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * SAMPLE / F.col("n")
    sample = rows.join(sizes, ["label", "dim"]).where(part)
    centres = sample.groupBy("label", "dim").applyInPandas(_centres(least), "label string, dim int, centre binary")
    centres = keep(centres.withColumn("ball", F.monotonically_increasing_id()), "centres")
    rows = keep(_assign(rows, centres, least), "assigned")

    inside = rows.where("ball is not null").groupBy("ball", "vec_id").agg(F.count(F.lit(1)).alias("copies"))
    balls = keep(inside.groupBy("ball").agg(F.count(F.lit(1)).alias("members"), F.min("vec_id").alias("first")), "balls")
    around = keep(_near_balls(rows, balls, least, block_rows), "around")

    loose = rows.where("ball is null").select("vec_id", "label", "dim", "unit")
    sizes = loose.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("label", "dim", F.greatest(F.lit(2), F.ceil(F.col("n") / shard_rows)).cast("int").alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows)).cast("int").alias("blocks"))
    loose = loose.join(sizes, ["label", "dim"])
    dealt = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    graphs = keep(_build(loose.withColumn("shard", dealt("shard", "shards")), new_path(spark, "graphs")), "graphs")
    found = keep(_query(loose.withColumn("block", dealt("block", "blocks")), graphs, least), "found")
    audit = found.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hit"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first().asDict()

    ball = F.col("ball") == F.col("_ball")
    home = inside.join(balls.withColumnRenamed("ball", "_ball"), ball)
    counts = found.where("n is not null").select("vec_id", "n").unionByName(home.select("vec_id", (F.col("members") - 1).alias("n"))).unionByName(around.select("vec_id", "n"))
    counts = counts.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    edges = found.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b"))
    to_ball = around.where("ball is not null").join(balls.withColumnRenamed("ball", "_ball"), ball)
    for e in (home, to_ball):
        edges = edges.unionByName(e.select(F.col("vec_id").alias("a"), F.col("first").alias("b")))
    joined = components(edges).withColumnRenamed("node", "vec_id")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(counts, "vec_id", "left").join(joined, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
    return out, audit
