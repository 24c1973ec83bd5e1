"""Mixing sources to target weights by systematic sampling.

Sources' targets are shares of all sizes by weight, stopped at ``most`` times the source's size, the
excess reshared by weight until none is above. Within a source every document expects
``rate = target / source_size`` copies; with their prefix sum P and one random offset u, a document is
emitted once for each integer in (P_before + u, P + u]. Documents are ordered by size, then by a hash of
id and text, so what a source gives differs from its target by about one document's size.

All expected copies in a source are equal, so the prefix sum is rate times an exact rank. A rank within
a source that may hold a third of all rows is summed in three levels: sizes in a source, cells of the
hash in a size, rows in a cell. The hash is uniform, so cells are even whatever the ids are; only rows
that agree in id and text share a place. No task gets more than a cell's rows or a level's totals.

Sources are taken to be few: their totals, a row of some 50 bytes each, are ranked by one task, which a
million of them do not strain. Nothing else grows with their number.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
CELL_ROWS = 65_536


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def place_of(doc_id: Column, text: Column) -> Column:
    """A place in [0, 16 ** 15) by a hash of id and text; nulls read as empty."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """totals (source, source_size) with weight, target and rate.

    Sources by code point, null last, take the weights in turn. The water level is the largest of
    (all - capped before) / (weights from here on) over sources by capacity per weight."""
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    t = totals.withColumn("_rank", F.row_number().over(by_name))
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("_cap", F.col("source_size") * most)
    fill = everything.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    capped = F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("_level", (F.sum("source_size").over(everything) - capped) / rest)
    t = t.withColumn("_level", F.max("_level").over(everything))
    share = F.col("_level") * F.col("weight")
    t = t.withColumn("target", F.when(F.col("_cap") <= share, F.col("_cap").cast("double")).otherwise(share))
    return t.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).drop("_rank", "_cap", "_level")


def offset_of(source: Column, seed: int) -> Column:
    """One offset in [0, 1) for each source: 16 bits of a hash, so that rank * 3 + offset is exact."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("double") / 65536


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, narrow: DataFrame | None = None) -> DataFrame:
    """rows with _copies, _source_size and _target; rows need source, _size and _tie, a place_of.

    narrow: the same rows without wide columns, from which totals are taken (rows itself by default).
    Rows of equal size and place share their copies in any order; a null source is a source of its own;
    sources without words take nothing."""
    n = narrow if narrow is not None else rows
    cells = max(4 * partitions(rows), -(-n.count() // CELL_ROWS))
    cell = F.floor(F.col("_tie") / (16**15 // cells + 1)).alias("_cell")
    by_cell = n.groupBy("source", "_size", cell).agg(F.count(F.lit(1)).alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells_in_size = by_cell.withColumn("_in_size", before(Window.partitionBy("source", "_size").orderBy("_cell")))
    by_size = by_cell.groupBy("source", "_size").agg(F.sum("_n").alias("_n")).withColumn("_in_source", before(Window.partitionBy("source").orderBy("_size"))).drop("_n")
    totals = targets(n.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, most)
    totals = totals.select("source", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate"))

    def joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        b = b.withColumnsRenamed({k: f"{k}__r" for k in keys})
        on = [a[k].eqNullSafe(b[f"{k}__r"]) for k in keys]
        return a.join(b, on, "left").drop(*[f"{k}__r" for k in keys])

    starts = joined(joined(cells_in_size, by_size, ["source", "_size"]), totals, ["source"])
    starts = starts.select("source", "_size", "_cell", (F.col("_in_size") + F.col("_in_source")).alias("_start"), "_source_size", "_target", "_rate")
    ranked = rows.withColumn("_cell", cell).withColumn("_k", F.row_number().over(Window.partitionBy("source", "_size", "_cell").orderBy("_tie")))
    ranked = joined(ranked, starts, ["source", "_size", "_cell"])
    rank, u = F.col("_start") + F.col("_k"), offset_of(F.col("source"), seed)
    copies = F.floor(F.col("_rate") * rank + u) - F.floor(F.col("_rate") * (rank - 1) + u)
    return ranked.withColumn("_copies", copies.cast("long")).drop("_cell", "_k", "_start", "_rate")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """docs (doc_id, source, text and others), each row as often as the mix takes it.

    Columns named like the operator's own (leading underscore) are dropped."""
    own = [c for c in docs.columns if c not in ("_size", "_tie", "_copies", "_source_size", "_target", "_rate", "_cell", "_k", "_start")]
    sized = docs.select(*own, size_of(F.col("text")).alias("_size"), place_of(F.col("doc_id"), F.col("text")).alias("_tie"))
    taken = mix(sized, weights, most, seed, narrow=sized.select("source", "_size", "_tie"))
    return taken.where(F.col("_copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*own)
