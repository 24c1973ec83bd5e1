"""A training corpus from documents: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again before the
next. All but the last return the columns of documents and no others; an empty table gives an empty one.
Rows are what stages decide on: repeated rows and rows with null ids are rows like others, unless a stage
says otherwise, and no stage changes a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import decontaminate, minhash_forest, mixing, token_store, toxicity
from tidewatch.plans.scratch import keep, new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. Null and empty texts have no marks and stay; a null id is never labelled."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs).where("predicted = 0").select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id; rows with null ids come last. Texts without words all stay."""
    rows = keep(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = minhash_forest.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), shingle=5, percent=80)
    ids = rows.select("_row", "doc_id").join(groups.select(F.col("doc_id").alias("_row"), "component_id"), "_row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_row")).alias("x"))
    return rows.join(first.select(F.col("x._row").alias("_row")), "_row", "left_semi").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to count as contaminated. Null and empty texts hold nothing and stay."""
    marked = decontaminate.mark_contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where("not contaminated").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, three times at most. A null source is a source of its own; a source
    without any words gives nothing, rows without words in other sources are taken as often as those with."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold of each document: doc_id, start, n_tokens and ids_crc32. A null text is empty and gives the end
    id alone; null ids come first, and every row of a repeated id gives a row."""
    import public_tokenizers

    manifest = token_store.write_documents(docs, new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_documents(manifest, token_store.crc32, "ids_crc32", T.LongType())


STAGES = [
    ("toxicity", without_toxic),
    ("near-duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("tokens", tokenized),
]

#: SQL cannot express a generative label model, tokenizers or signature forests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
