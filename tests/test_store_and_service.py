"""Changes to stores, the service over them, search options and providers, on small inputs."""

import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gleanery.functions import models
from gleanery.functions import understanding as U
from gleanery.operators import assess, context, digest, evaluate, filters, graph, ingest, keyword, vector
from gleanery.plans import benchmarks
from gleanery.plans.search import Config, Engine
from gleanery.plans.service import Service
from gleanery.sources.store import Store, dimensions, write_results


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "filename string, content string")


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    made = Service.at(spark, str(tmp_path_factory.mktemp("store")))
    made.chunk_least = 1
    files = texts(
        spark,
        ("rag.md", "# RAG\n\nRAG uses BM25 for retrieval. It is a method of search."),
        ("crag.md", "# CRAG\n\nCRAG extends RAG. The model is a new method."),
        ("same.md", "# CRAG\n\nCRAG extends RAG. The model is a new method."),
        ("empty.md", "  \n"),
    )
    assert made.ingest(files) == 2
    return made


def test_a_new_store_has_its_seeds_once(spark, service):
    assert [r.domain for r in service.whitelist().collect()][:2] == ["arxiv.org", "export.arxiv.org"]
    Store(spark, service.store.root).seed()
    assert service.whitelist().count() == 6 and {r.name for r in service.collections().collect()} == {"default", "ai-papers"}


def test_ids_have_no_gaps_and_known_texts_are_left_out(spark, service):
    assert sorted(r.id for r in service.documents().collect()) == [1, 2]
    assert service.ingest(texts(spark, ("again.md", "# RAG\n\nRAG uses BM25 for retrieval. It is a method of search."))) == 0
    assert service.stats().first().asDict() == {"documents": 2, "chunks": service.store.table("chunks").count()}


def test_the_index_follows_inserts_and_deletes(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    docs = spark.createDataFrame([("a", "h1"), ("b", "h2")], "filename string, hash string")
    store.add("documents", docs, ["hash"])
    chunks = spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta gamma"), (2, "...")], "doc_id long, content string")
    store.add("chunks", chunks, [])
    rows = lambda: sorted((r.id, r.term or "", r.tf, r.n_terms) for r in store.table("postings").collect())
    assert sorted(r[1] for r in rows()) == ["", "alpha", "beta", "beta", "gamma"]
    queries = spark.createDataFrame([(1, "beta"), (2, "gamma alpha")], "query_id long, query string")
    plain = keyword.bm25(store.table("chunks"), queries, 5).collect()
    assert plain == keyword.bm25_indexed(store.table("postings"), queries, 5).collect() and len(plain) == 4
    entities = spark.createDataFrame([(" RAG\t", "method", 1), ("NQ", "dataset", 2)], "name string, entity_type string, doc_id long")
    store.add("entities", entities, [])
    assert sorted(r.normalized_name for r in store.table("entities").collect()) == ["nq", "rag"]
    links = spark.createDataFrame([(1, 2, "uses"), (1, 2, "uses"), (2, 1, "uses")], "source_entity_id long, target_entity_id long, relationship_type string")
    store.add("relationships", links, ["source_entity_id", "target_entity_id", "relationship_type"])
    assert store.table("relationships").count() == 2
    assert store.remove("documents", store.document(2)) == 1 and store.remove("documents", store.document(9)) == 0
    assert {r.term for r in store.table("postings").collect()} == {"alpha", "beta"}
    assert [r.name for r in store.table("entities").collect()] == [" RAG\t"] and store.table("relationships").isEmpty()


def test_renewing_vectors_goes_on_where_it_stopped(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.add("chunks", spark.createDataFrame([(1, f"word{i}") for i in range(5)] + [(1, "...")], "doc_id long, content string"), [])
    embed = models.hash_embedder(8)
    assert store.reembed(embed, 8, rows=2, most_failures=2) == 5
    assert store.reembed(embed, 8, rows=2, most_failures=1) == 0
    assert {(r.dim, r.n) for r in dimensions(store.table("chunks")).collect()} == {(8, 5), (None, 1)}


def test_collections_and_domains(spark, tmp_path):
    service = Service.at(spark, str(tmp_path))
    made = service.create_collection("mine", "x")
    assert service.create_collection("mine") == made and service.ingest(texts(spark, ("a.md", "some text here")), "mine") == 1
    assert service.documents(made).count() == 1 and service.delete_collection(made) and service.documents().first().collection_id is None
    service.allow("example.org")
    service.set_domain("example.org", False)
    assert [r.enabled for r in service.whitelist().where("domain = 'example.org'").collect()] == [False]
    assert service.forget_domain("example.org") and not service.forget_domain("example.org")
    assert service.delete_document(1) and not service.delete_document(1) and service.health() == {"status": "ok"}


def test_search_tool_digest_and_graph(spark, service):
    q = spark.createDataFrame([(1, "What does CRAG extend"), (2, "")], "query_id long, query string")
    found = service.search(q, 2).where("query_id = 1").orderBy("rank").collect()
    assert found[0].filename == "crag.md"
    only = service.search(q, 2, "RAG.M").where("query_id = 1 and filename = 'crag.md'").count()
    assert only == 1 and {r.filename for r in service.search(q, 2, "cr_g").collect()} == {"crag.md"}
    told = {r.query_id: r.text for r in service.tool(q.where("query_id = 1"), 2).collect()}
    assert re.match(r"\[1\] crag\.md\n", told[1]) and "\n\n---\n\n[2] " in told[1]
    d = service.digest("2200-01-01", hours=24 * 365 * 300).first()
    assert "## CRAG" in d.markdown and "<h2>CRAG</h2>" in d.html and d.n == 2 and d.message.startswith("Digest\n- ")
    counts = {(r.what, r.type): r.n for r in service.build_graph().collect()}
    assert counts[("entity", "method")] >= 3 and counts[("relationship", "extends")] == 1


def test_pages_and_papers_get_headers_and_are_known_again(spark, tmp_path):
    service = Service.at(spark, str(tmp_path))
    service.chunk_least = 1
    pages = spark.createDataFrame([("http://w.org/w/Redstone", "Redstone", "Dust carries a signal.", "2025-01-01"), ("http://w.org/w/File:x", "File", "a signal", "2025-01-01"), ("http://w.org/w/Sky", "Sky", "Blue.", "2025-01-01")], "url string, title string, markdown string, crawled_at string")
    scope = filters.Scope("stones", ["http://w.org/w/Redstone"], ["/w/"], keywords=["signal"])
    assert service.ingest_pages(pages, scope) == 1 and service.ingest_pages(pages.withColumn("crawled_at", F.lit("2026-01-01")), scope) == 0
    doc = service.documents().first()
    assert doc.filename == "stones_Redstone.md" and doc.clean_md == "# Redstone\n\n**Source:** http://w.org/w/Redstone\n**Crawled:** 2025-01-01\n\n---\n\nDust carries a signal."
    papers = spark.createDataFrame([("2401.1", "A Paper", "Short.", ["X", "Y"], ["cs.AI"])], "paper_id string, title string, summary string, authors array<string>, categories array<string>").withColumn("published", F.to_timestamp(F.lit("2024-01-02")))
    assert service.ingest_papers(papers, spark.createDataFrame([("2401.1", "Body of it.")], "paper_id string, text string")) == 1
    md = service.documents().where("filename like 'paper%'").first().clean_md
    assert "**Authors:** X, Y\n**Published:** 2024-01-02" in md and md.endswith("## Abstract\n\nShort.\n\n---\n\nBody of it.")


def docs_(spark):
    rows = [(1, "a", "SEAL achieves 61% accuracy on the test."), (2, "b", "SEAL achieves 45% accuracy on the test."), (3, "c", "Nothing of the kind is said here.")]
    return spark.createDataFrame([(*r, r[1]) for r in rows], "id long, doc_id string, content string, source string")


def test_contradictions_come_with_the_answers_of_v2(spark):
    q = spark.createDataFrame([(1, "What is SEAL accuracy"), (2, "nothing kind")], "query_id long, query string")
    _, answers = Engine.over(docs_(spark), Config(top_k=3)).search_v2(q)
    got = {r.query_id: r for r in answers.collect()}
    assert got[1].n_contradictions >= 1 and got[1].warning == assess.WARNING and got[1].details[0].conflict_type == "factual"
    assert "61%" in got[1].details[0].claim_a + got[1].details[0].claim_b
    _, plain = Engine.over(docs_(spark), Config(top_k=3, contradictions=False)).search_v2(q)
    assert "n_contradictions" not in plain.columns


def test_a_language_model_blends_vectors_and_names_types(spark):
    def generate(prompt):
        return F.when(F.contains(prompt, F.lit("Which is")), "It is exploratory.").otherwise("nothing of the kind")

    engine = Engine.over(docs_(spark))
    q = spark.createDataFrame([(1, "accuracy")], "query_id long, query string")
    engine.generate = generate
    own, both = models.hashed("accuracy", 64), models.hashed("nothing of the kind", 64)
    want = [0.7 * b + 0.3 * a for a, b in zip(own, both, strict=True)]
    size = sum(x * x for x in want) ** 0.5 + 1e-8
    assert engine.query_vectors(q).first().embedding == pytest.approx([x / size for x in want])
    assert engine.analyze(q).first().kind == "exploratory"
    engine.generate = models.no_generator
    assert engine.analyze(q).first().kind == "simple"


def test_replies_of_a_model(spark):
    rows = spark.createDataFrame([('Sure: ["a", "b"] done',), ("no list",), ("[broken",), (None,)], "r string")
    got = [r[0] for r in rows.select(models.asked_list(lambda p: p, F.col("r"), F.array(F.lit("own")))).collect()]
    assert got == [["a", "b"], ["own"], ["own"], ["own"]]
    summed = rows.select(models.summary(models.no_generator, F.col("r"), F.lit("start"))).collect()
    assert {r[0] for r in summed} == {"start"}
    gaps = assess.gaps_with(lambda p: F.lit('["more?"]'), spark.createDataFrame([(1, "q", "simple", ["X"])], "query_id long, query string, kind string, entities array<string>"), spark.createDataFrame([(1, 1, "y")], "query_id long, rank int, content string"))
    assert gaps.first().suggestions == ["more?"]


def test_extractive_compression_keeps_to_the_target(spark):
    long_ = " ".join(f"Sentence number {i} speaks of ranking documents at length today." for i in range(80))
    rows = spark.createDataFrame([(1, 1, 1, "Top one."), (1, 2, 2, "Top two."), (1, 3, 3, long_ + " Graphs of entities are another matter altogether.")], "query_id long, id long, rank int, content string")
    q = spark.createDataFrame([(1, "graphs of entities")], "query_id long, query string")
    for how in ("sentence", "extractive"):
        r = context.compress(rows, q, 250, strategy=how).first()
        assert r.text.startswith("Top one.\n\nTop two.") and r.compressed_tokens <= 250 + 10 < r.original_tokens
        # By text rank, a sentence like no other comes late.
        assert ("Graphs of entities" in r.text) == (how == "sentence")
    with pytest.raises(ValueError, match="unknown strategy"):
        context.compress(rows, q, strategy="other")


def test_two_phases(spark):
    docs = spark.createDataFrame([(i, t, e) for i, (t, e) in enumerate([("cat dog", [1.0, 0.0]), ("cat", [0.0, 1.0]), ("dog dog", None), ("fish", [1.0, 0.0])])], "id long, content string, embedding array<double>")
    q = spark.createDataFrame([(1, "cat dog", [0.0, 1.0]), (2, "bird", [1.0, 0.0])], "query_id long, query string, embedding array<double>")
    found = keyword.overlap(docs, q, matched=True)
    assert {(r.id, tuple(r.matched)) for r in found.collect()} == {(0, ("cat", "dog")), (1, ("cat",)), (2, ("dog",))}
    again = [r.id for r in vector.two_phase(found, docs, q, 5, "rerank").orderBy("rank").collect()]
    assert again == [1, 0, 2]
    fused = vector.two_phase(found, docs, q, 5)
    assert {r.id for r in fused.collect()} == {0, 1, 2}
    with pytest.raises(ValueError, match="unknown fusion"):
        vector.two_phase(found, docs, q, 5, "sum")


def test_vector_search_by_batches_equals_the_join(spark):
    rows = [(i, [float((i * k) % 7 - 3) for k in range(1, 9)]) for i in range(60)] + [(60, None), (61, [0.0] * 8)]
    vecs = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    q = vecs.where("id % 9 = 0 and embedding is not null").select(F.col("id").alias("query_id"), "embedding")
    for dim in (None, 3):
        a = vector.nearest(vecs, q, 7, dim).orderBy("query_id", "rank").collect()
        assert a == vector.nearest_joined(vecs, q, 7, dim).orderBy("query_id", "rank").collect() and len(a) == 49
    assert vector.nearest(vecs, q.limit(0)).count() == 0 and vector.nearest(vecs.limit(0), q).count() == 0


QUESTIONS = [
    (1, 'Did "Blue Train" come before John Coltrane left Prestige Records?', [("John Coltrane", 0), ("Blue Train", 5)], [("John Coltrane", ["John Coltrane was born.", "He left Prestige Records."]), ("Blue Train", ["Blue Train is a record."]), ("Bees", ["Bees fly."])]),
    (2, "what is it", [("Bees", 0)], [("Ants", ["Ants walk."]), ("Bees", ["Bees fly."])]),
]
KIND = "id long, question string, supporting_facts array<struct<title:string,sent_idx:int>>, context array<struct<title:string,sentences:array<string>>>"


def test_names_in_questions():
    asked = QUESTIONS[0][1]
    assert U.names_by_run(asked)[0] == "Blue Train"
    assert {"John Coltrane", "John", "Prestige Records", "Blue Train"} <= set(U.names_by_run(asked)) and "before" not in U.names_by_run(asked)
    assert {"John", "Coltrane", "John Coltrane", "Blue Train"} <= set(U.names_by_word(asked)) and U.names_by_word("what is it") == []


def test_ranking_by_names_and_facts(spark):
    q = spark.createDataFrame(QUESTIONS, KIND)
    assert sorted((r.id, r.sentence) for r in evaluate.supporting_sentences(q).collect()) == [(1, "John Coltrane was born."), (2, "Bees fly.")]
    got = {r.query_id: r for r in benchmarks.by_names(q, 2).collect()}
    assert got[1].recall == 1.0 and got[1].precision == 1.0 and got[2].n_retrieved == 2 and got[2].precision == 0.5
    seconds, rows = benchmarks.timed(lambda: q)
    assert seconds > 0 and rows == 2


def test_query_sets_are_measured_and_written(spark, tmp_path):
    q = spark.createDataFrame([(1, "SEAL accuracy", "a"), (2, "kind", "b")], "query_id long, query string, category string")
    wanted = spark.createDataFrame([(1, "entity", "SEAL"), (1, "entity", "CRAG"), (1, "concept", "accuracy"), (2, "fact", "Nothing of")], "query_id long, what string, wanted string")
    rows, rolled = benchmarks.query_set(Engine.over(docs_(spark)), q, wanted)
    got = {r.query_id: r for r in rows.collect()}
    assert got[1].entity_coverage == 0.5 and got[1].supporting_fact_recall is None and got[2].supporting_fact_recall == 1.0
    assert {r.category for r in rolled.collect()} == {"a", "b", None}
    write_results(rolled, str(tmp_path / "out"))
    assert sum(1 for p in Path(tmp_path / "out").glob("*.json") for line in p.read_text().splitlines() if json.loads(line)) == 3


def test_entity_context_of_an_unknown_name(spark):
    e = spark.createDataFrame([(1, "RAG", "rag"), (2, "BM25", "bm25")], "id long, name string, normalized_name string")
    links = spark.createDataFrame([(1, 2, "uses")], "src long, tgt long, type string")
    mentions = spark.createDataFrame([("rag", 7)], "normalized_name string, chunk_id long")
    chunks = spark.createDataFrame([(7, "rag"), (8, "about bm25")], "id long, content string")
    names = spark.createDataFrame([("rag",), ("bm25",), ("none",)], "normalized_name string")
    got = {r.name: r for r in graph.entity_context(names, e, links, mentions, chunks).collect()}
    assert got["rag"].chunk_ids == [7] and got["rag"].related[0].name == "BM25" and got["rag"].related[0].direction == "outgoing"
    assert got["bm25"].chunk_ids == [8] and not got["none"].found and got["none"].related == []


def test_digest_without_papers(spark):
    none = spark.createDataFrame([], "title string, summary string, url string")
    assert "No new papers" in digest.html(none, "D").first().digest
    odd = spark.createDataFrame([("<b>", "a & b", None)], "title string, summary string, url string")
    page = digest.html(odd, "D").first().digest
    assert "&lt;b&gt;" in page and "a &amp; b" in page and 'href="#"' in page


def test_fetches_are_refused_by_status(spark):
    rows = spark.createDataFrame([("https://a.org/x", 5), ("https://b.net/", 1), ("nonsense", None), ("https://a.org/y", 99)], "url string, size long")
    listed = spark.createDataFrame([("a.org", True), ("b.net", False)], "domain string, enabled boolean")
    got = {r.url: r.status for r in filters.fetch_status(rows, listed, most=50).collect()}
    assert got == {"https://a.org/x": "ok", "https://b.net/": "not whitelisted", "nonsense": "not whitelisted", "https://a.org/y": "too large"}


def test_chunk_tokens_are_counted(spark):
    docs = spark.createDataFrame([(1, "one two three. four five six.\n\n" * 40)], "doc_id long, content string")
    row = ingest.total_tokens(ingest.chunks(docs, 50, 5, 1)).first()
    assert row.chunks > 3 and row.tokens > 200
