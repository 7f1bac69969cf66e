"""Contradictions over whole tables of documents."""

from collections import Counter

from gleanery.plans import catalog

TINY = "/root/testdata/sf0.001"


def test_all_documents_are_held_against_each_other(spark):
    rates = [61, 45, 61, 30] + [70 + k % 2 for k in range(60)]
    texts = [f"SEAL reaches {n}% accuracy" for n in rates]
    texts += ["here alpha outperforms beta", "so beta beats alpha", "gamma beats delta", "no claim", "", None]
    rows = [(i, "s", t, "s") for i, t in enumerate(texts)]
    want = Counter({i: 0 for i in range(len(texts))})
    # The stated claim is found by two patterns in each document, so all four pairings count.
    for i, a in enumerate(rates):
        want[i] = 4 * sum(a != b for b in rates)
    want[64] = want[65] = 1
    chunks = spark.createDataFrame(rows, "id long, doc_id string, content string, source string")
    assert {r.doc_id: r.n_contradictions for r in catalog.contradicted(chunks).collect()} == dict(want)


def test_query_reads_the_table(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    assert catalog.queries()["document_contradictions"](spark, TINY).count() == docs.count()
