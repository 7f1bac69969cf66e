"""The pipeline's stages, one after another, on the smallest tables."""

import __spark_entry__
import corpus_pipeline

TINY = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_drop_what_they_say(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, TINY).cache()
        assert docs.columns == corpus_pipeline.COLUMNS, name
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] >= counts[3] >= counts[4] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, TINY).collect()
    assert len(last) == counts[-1] and all(r.round_trip for r in last)


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11))


def test_rows_that_are_odd_pass(spark):
    rows = [(1, None, None, None, None), (None, "word " * 30, "en", "s", 1), (2, "", "en", "s", 0), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s", 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, TINY).cache()
    assert [r.doc_id for r in docs.collect()] == [3]
