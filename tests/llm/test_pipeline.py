"""The pipeline's stages against what each operator decides on its own input."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import decontaminate, minhash_forest
from tidewatch.plans.scratch import keep

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "decontamination", "mixing", "tokens"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(keep(stage(spark, kept[-1], SF), name))
        assert kept[-1].columns == docs.columns
    for a, b in zip(kept[:3], kept[1:4], strict=True):
        assert b.exceptAll(a).count() == 0 and 0.5 * a.count() < b.count() <= a.count()
    again = minhash_forest.near_duplicates(kept[2]).where("not kept").count()
    assert again == 0
    assert decontaminate.mark_contamination(kept[3], spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).toPandas().sort_values("start")
    assert len(out) == kept[-1].count()
    assert (out.start.to_numpy() == np.cumsum(out.n_tokens) - out.n_tokens).all() and out.doc_id.is_monotonic_increasing
    assert kept[-1].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_one_row_of_each_group(spark):
    a, b, c = ("one two three four five six seven", "ONE two three four five six seven", "eight nine ten eleven twelve thirteen")
    rows = [(2, a), (2, a), (1, b), (1, c), (4, c), (None, c), (None, "alone in all of these few rows"), (None, "alone in all of these few rows"), (7, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.without_near_duplicates(spark, docs, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    want = [(1, b), (1, c), (None, "alone in all of these few rows"), (7, ""), (8, None)]
    assert sorted(map(str, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(str, want))


def test_stages_on_odd_rows(spark):
    """Nulls in every column, repeated rows, a long text, columns of other names: rows in, whole rows out; and an empty table."""
    rows = [(1, "plain words of one document here", "en", "a", 3), (1, "plain words of one document here", "en", "a", 3), (None, None, None, None, None), (None, "", "en", None, 0), (4, "you idiot moron scum", "en", "b", 1), (5, "long " * 60_000, "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.withColumns({c: F.lit(1) for c in ("_row", "component_id", "kept", "score", "n_hit", "_size", "_runs", "place")})
    plain = {str(tuple(r)) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert got.columns == corpus_pipeline.COLUMNS and {str(tuple(r)) for r in got.collect()} <= plain, name
        assert stage(spark, odd.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), SF).count() == 0
    kept = {r.doc_id for r in corpus_pipeline.without_toxic(spark, odd, SF).collect()}
    assert kept == {1, None, 5}
