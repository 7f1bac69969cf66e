"""Operators on small inputs with results worked out by hand or by a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.functions import models, text, vectors
from gleanery.functions import understanding as U
from gleanery.operators import assess, context, digest, evaluate, filters, graph, ingest, ranking
from gleanery.plans.search import Config, Engine
from gleanery.sources.readers import feed_query, papers, query_sets, text_files
from gleanery.sources.store import Store
from gleanery.streaming import events


def test_soft_diversity_fills_up_and_strict_does_not(spark):
    docs = ["a"] * 8 + ["b"] * 3 + ["c"]
    rows = spark.createDataFrame([(1, i, x, 1.0 - i / 100, i + 1) for i, x in enumerate(docs)], "query_id long, id long, doc_id string, score double, rank int")
    soft = [r.doc_id for r in ranking.diversify(rows, 10, 2).orderBy("rank").collect()]
    assert soft == ["a", "a", "b", "b", "c", "a", "a", "a", "a", "a"]
    assert [r.doc_id for r in ranking.diversify(rows, 10, 2, strict=True).orderBy("rank").collect()] == ["a", "a", "b", "b", "c"]
    assert ranking.diversify(rows, 0).count() == 0


def test_context_window_stops_at_the_first_unlike_neighbour(spark):
    v = lambda *x: [*map(float, x)]
    like, other = v(0.9, 0.3, 0.1), v(0, 0, 1)
    chunks = spark.createDataFrame([(i, "d", i, e) for i, e in enumerate([like, other, like, like, like])], "id long, doc_id string, chunk_index int, embedding array<double>")
    got = context.context_window(chunks.where("id = 2"), chunks, 2, 0.7)
    assert sorted(r.id for r in got.collect()) == [2, 3, 4]


QUESTIONS = [
    ("What is RAG?", "simple"), ("define grounding", "simple"), ("Who is the author", "simple"),
    ("Compare SEAL-RAG and CRAG", "comparative"), ("BM25 vs DPR", "comparative"), ("pros and cons of reranking", "comparative"),
    ("What are the main challenges in retrieval", "exploratory"), ("recent advances in search", "exploratory"),
    ("How does SEAL-RAG address context dilution", "multi_hop"), ("What role does BM25 play in hybrid search", "multi_hop"),
    ("BM25 and DPR", "comparative"), ("RAG and CRAG", "simple"), ("", "simple"),
]


def test_query_types(spark):
    q = spark.createDataFrame(QUESTIONS, "query string, want string").withColumn("entities", U.entities(F.col("query")))
    got = q.withColumn("kind", U.query_type(F.col("query"), F.col("entities"))).collect()
    assert [(r.query, r.kind) for r in got] == QUESTIONS


def test_sub_queries_and_entities(spark):
    q = spark.createDataFrame([("How does SEAL-RAG address context dilution",)], "query string").withColumn("e", U.entities(F.col("query")))
    r = q.select("e", U.sub_queries(F.col("query"), F.lit("multi_hop"), F.col("e")).alias("s")).first()
    assert r.e[:2] == ["SEAL-RAG", "RAG"] and "context dilution" in r.e
    assert r.s[0] == "What is SEAL-RAG?" and r.s[-1].startswith("How does") and len({x.lower() for x in r.s}) == len(r.s)


def test_expansion(spark):
    got = [r.e for r in spark.createDataFrame([("rag",), ("what is LLM",), ("nothing here",)], "q string").select(U.expansions(F.col("q")).alias("e")).collect()]
    assert got[0] == ["rag", "retrieval augmented generation", "retrieval-augmented generation"]
    assert got[1] == ["what is LLM", "what is large language model", "what is large language models"]
    assert got[2] == ["nothing here"]


def test_recency(spark):
    rows = [(1, 1, 0.8, "2023-12-02", 1), (1, 2, 0.8, "2025-12-01", 2), (1, 3, 0.8, None, 3)]
    df = spark.createDataFrame(rows, "query_id long, id long, score double, at string, rank int").withColumn("at", F.to_timestamp("at"))
    got = {r.id: r for r in ranking.recency(df, "at", "2025-12-01").collect()}
    assert got[2].rank == 1 and got[2].score == pytest.approx(0.92) and got[1].score > got[3].score


def test_metadata_and_sql_agree(spark):
    rows = [(i, f"2024-0{i}-15" if i < 5 else None, "ab"[i % 2], i if i != 3 else None) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "id long, ingested_at string, collection string, chunk_count int")
    df.createOrReplaceTempView("meta")
    for kw in ({}, {"date_from": "2024-02-01"}, {"date_to": "2024-03-31"}, {"collection": "a", "min_chunks": 2}, {"exclude": [1, 2]}):
        clause, args = filters.where_clause(**kw)
        want = sorted(r.id for r in spark.sql(f"SELECT id FROM meta WHERE {clause}", args=args).collect())
        assert sorted(r.id for r in df.where(filters.metadata(**kw)).collect()) == want
    assert filters.where_clause() == ("1=1", {})


def test_replacement_keeps_the_budget():
    current = [(1, "alpha"), (2, "nothing")]
    chosen, left = ranking.replace_within(current, [(3, "beta gamma"), (4, "none")], ["beta", "gamma", "delta"], 2)
    assert len(chosen) == 2 and (3, "beta gamma") in chosen and left == ["delta"]


def test_token_budget_equals_a_fold(spark):
    rng = random.Random(1)
    rows = [(q, i, " ".join(["w"] * rng.randint(1, 9)), rng.random()) for q in range(5) for i in range(20)]
    got = ranking.within_budget(spark.createDataFrame(rows, "q int, i int, t string, s double"), "q", "t", "s", "i", 20)
    for q in range(5):
        taken, total = [], 0
        for _, i, t, _ in sorted((r for r in rows if r[0] == q), key=lambda r: -r[3]):
            n = int(len(t.split()) * 1.3)
            if total + n > 20 and len(taken) >= 3:
                break
            taken.append(i)
            total += n
        assert sorted(r.i for r in got.where(f"q = {q}").collect()) == sorted(taken)


def test_entities_and_relations():
    t = "CRAG extends RAG. SEAL-RAG outperforms Self-RAG on HotpotQA. The XYZ model is a new method."
    found = {e[0]: e[1] for e in graph.entities_in(t)}
    assert found["SEAL-RAG"] == "method" and found["HotpotQA"] == "dataset" and found["XYZ"] == "method"
    links = {(a, b, k) for a, b, k, _, _ in graph.relations_in(t, {n.lower() for n in found})}
    assert ("CRAG", "RAG", "extends") in links and ("SEAL-RAG", "Self-RAG", "outperforms") in links


def test_graph_build_and_search(spark):
    docs = spark.createDataFrame([(1, 1, "CRAG extends RAG."), (2, 1, "RAG uses BM25."), (3, 2, "nothing")], "id long, doc_id long, content string")
    entities, mentions, links = graph.build(docs)
    assert {r.normalized_name for r in entities.collect()} == {"crag", "rag", "bm25"} and links.count() == 2
    names = spark.createDataFrame([("crag",), ("nothing",)], "normalized_name string")
    assert sorted((r.normalized_name, r.id) for r in graph.chunks_of(names, mentions, docs).collect()) == [("crag", 1), ("nothing", 3)]
    seed = entities.where("normalized_name = 'crag'").select(F.lit(7).alias("query_id"), "id")
    by_id = mentions.select(F.xxhash64("normalized_name").alias("id"), "chunk_id")
    vector = spark.createDataFrame([(7, 3, 1)], "query_id int, id long, rank int")
    got = {r.id: r.score for r in graph.graph_search(vector, seed, links.withColumnRenamed("type", "type"), by_id).collect()}
    assert got[3] == pytest.approx(0.7) and got[2] == pytest.approx(0.15)


def test_claims_and_contradictions(spark):
    chunks = spark.createDataFrame([(1, "a", "The Alpha system achieves 61% accuracy"), (2, "b", "The Alpha system achieves 45% accuracy"), (3, "c", "Foo outperforms Bar"), (4, "d", "Bar beats Foo")], "id long, source string, content string")
    found = assess.claims(chunks)
    kinds = {(r.chunk_id, r.claim_type) for r in found.collect()}
    assert {(1, "statistic"), (2, "statistic"), (3, "comparison"), (4, "comparison")} <= kinds
    pairs = {(r.chunk_id_a, r.chunk_id_b) for r in assess.contradictions(found).collect()}
    assert pairs == {(1, 2), (3, 4)}


def test_gaps_and_confidence(spark):
    q = spark.createDataFrame([(1, "Compare alpha and beta", "comparative", ["alpha", "beta"])], "query_id long, query string, kind string, entities array<string>")
    r = spark.createDataFrame([(1, 5, "d", 0.9, 1, "Alpha is here")], "query_id long, id long, doc_id string, score double, rank int, content string")
    g = assess.gaps(q, r).first()
    assert g.missing_entities == ["beta"] and g.unanswered == ["comparison between entities"] and g.coverage == pytest.approx(0.62) and g.should_iterate
    assert g.suggestions == ["What is beta?", "differences beta"]
    c = assess.confidence(r, q).first()
    assert (c.score_distribution, c.entity_coverage, c.source_agreement, c.source_diversity) == (0.5, 0.5, 0.5, 0.3)


def test_cleaning_and_sentences(spark):
    t = "Title\n 12 \nPage 3 of 9\nhyphen-\nated “quoted”  text\x0c\n\n\n\nend\x01 © 2020 all rights reserved"
    r = spark.createDataFrame([(t, "Dr. Who came. He left! Why?")], "a string, b string").select(text.clean_text("a").alias("c"), text.sentences("b").alias("s")).first()
    assert "12" not in r.c and "Page" not in r.c and 'hyphenated "quoted" text' in r.c and "\x01" not in r.c and "2020" not in r.c
    assert r.s == ["Dr. Who came.", "He left!", "Why?"]


def test_chunks_respect_size_and_overlap():
    t = "\n\n".join(f"Paragraph {i} " + "word " * 40 for i in range(6)) + "\n\n" + "A sentence of some words here. " * 60
    got = ingest.chunk(t, 120, 16, 10)
    assert len(got) > 4 and all(c["tokens"] <= 120 for c in got) and [c["chunk_index"] for c in got] == list(range(len(got)))
    assert all(t[c["start_char"] : c["start_char"] + 5] == c["text"][:5] for c in got) and ingest.chunk("", 10, 1, 1) == []


def test_pages():
    html = "<html><head><title>Stone - Some Wiki</title></head><body><nav><a href='/no'>x</a></nav><main><h1>Head</h1><p>Text <a href='/to'>link</a></p><ul><li>one</li></ul></main></body></html>"
    assert ingest.read_page(html, "http://h.org/a") == ("Stone", "# Head\n\nText link\n\n- one", ["http://h.org/to"])


def test_crawl_is_breadth_first_within_scope(spark):
    links = {"a": ["b", "c#x"], "b": ["d", "out"], "c": ["a"], "d": ["e"], "e": [], "out": []}
    pages = spark.createDataFrame(list(links.items()), "url string, links array<string>")
    got = ingest.crawl(pages, spark.createDataFrame([("a",)], "url string"), lambda u: u != "out", 2)
    assert {(r.url, r.depth) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}


def test_metrics(spark):
    df = spark.createDataFrame([("The cat sat.", "a cat sat down"), ("", ""), ("x", "")], "p string, g string")
    got = [(r.f, r.e) for r in df.select(evaluate.token_f1(F.col("p"), F.col("g")).alias("f"), evaluate.exact_match(F.col("p"), F.col("g")).alias("e")).collect()]
    assert got == [(0.8, 0.0), (1.0, 1.0), (0.0, 0.0)]
    values = spark.createDataFrame([("k", v) for v in [5, 1, 1, 9]], "k string, v int")
    r = evaluate.nearest_rank(values, ["k"], "v").first()
    assert (r.p50, r.p95, r.p99) == (5, 9, 9)


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0, 0.0], [0.0, 0.0, 0.0])], "a array<double>, z array<double>").select(vectors.cosine(F.col("a"), F.col("a")).alias("one"), vectors.cosine(F.col("a"), F.col("z")).alias("none"), vectors.truncate(F.col("a"), 2).alias("t")).first()
    assert r.one == pytest.approx(1) and r.none == 0 and r.t == pytest.approx([0.6, 0.8])
    q = spark.createDataFrame([(None, "q"), ("I cannot say", "q"), ("fine", "q")], "g string, q string").select(models.or_query(F.col("g"), F.col("q")).alias("x")).collect()
    assert [r.x for r in q] == ["q", "q", "fine"]


def test_store_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.add("collections", spark.createDataFrame([("papers",), ("papers",), ("web",)], "name string"), ["name"])
    ids = {r.name: r.id for r in store.table("collections").collect()}
    assert set(ids) == {"papers", "web"}
    docs = spark.createDataFrame([("a.md", "h1", ids["papers"]), ("b.md", "h2", ids["papers"])], "filename string, hash string, collection_id long")
    store.add("documents", docs, ["hash"])
    store.add("documents", docs, ["hash"])
    got = {r.filename: r.id for r in store.documents().collect()}
    assert len(got) == 2
    store.add("chunks", spark.createDataFrame([(got["a.md"], 0, "text"), (got["b.md"], 0, "more")], "doc_id long, chunk_index int, content string"), ["doc_id", "chunk_index"])
    assert store.remove("documents", spark.createDataFrame([(got["a.md"],)], "id long")) == 1
    assert [r.content for r in store.table("chunks").collect()] == ["more"]
    store.remove("collections", spark.createDataFrame([(ids["papers"],)], "id long"))
    assert store.table("documents").first().collection_id is None and store.documents().first().chunk_count == 1


def test_readers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Hi")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF")
    got = {r.filename: (r.content, r.error) for r in text_files(spark, str(tmp_path / "in")).collect()}
    assert got["a.md"] == ("# Hi", None) and got["b.pdf"][0] is None and "pdf" in got["b.pdf"][1]
    (tmp_path / "q.json").write_text('{"one": [{"id": "1", "query": "q", "type": "simple", "difficulty": "easy"}]}')
    assert [tuple(r) for r in query_sets(spark, str(tmp_path / "q.json")).collect()] == [("one", "1", "q", "simple", "easy")]
    (tmp_path / "f.xml").write_text('<feed><entry><id>http://x/abs/2401.00001v2</id><title> A\n B </title><summary>s</summary><published>2024-01-02T00:00:00Z</published><author><name>N</name></author><category term="cs.AI"/></entry></feed>')
    r = papers(spark, str(tmp_path / "f.xml")).first()
    assert (r.paper_id, r.title, r.authors, r.categories) == ("2401.00001", "A B", ["N"], ["cs.AI"])
    assert feed_query("q", ["a", "b"]) == 'all:"q" AND (cat:a OR cat:b)' and feed_query(None, []) == "cat:cs.AI"


def test_digest(spark):
    df = spark.createDataFrame([("# One\n\nAbstract\nShort.\n\n# Next", "f"), ("plain", "g.md")], "m string, f string")
    got = [(r.t, r.a) for r in df.select(digest.title(F.col("m"), F.col("f")).alias("t"), digest.abstract(F.col("m")).alias("a")).collect()]
    assert got == [("One", "Short."), ("g.md", "plain")]


def test_stream_drops_repeated_documents(spark, tmp_path):
    rows = [("2025-01-01 00:00:00", "a", "same"), ("2025-01-01 00:01:00", "b", "same"), ("2025-01-01 00:02:00", "c", "other")]
    spark.createDataFrame(rows, "ts string, filename string, content string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), "ts timestamp, filename string, content string")
    events.to_parquet(events.new_documents(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["other", "same"]


def test_search_finds_the_document(spark):
    docs = spark.createDataFrame([(i, f"d{i % 3}", t, "") for i, t in enumerate(["rag retrieval systems", "cooking pasta at home", "dense retrieval with rag", "gardening tips"])], "id long, doc_id string, content string, source string")
    engine = Engine.over(docs, Config(top_k=2, iterations=2))
    queries = spark.createDataFrame([(1, "rag retrieval"), (2, "Compare RAG and CRAG"), (3, "How does RAG address retrieval")], "query_id long, query string")
    got = engine.search(queries).where("query_id = 1").collect()
    assert {r.id for r in got} == {0, 2}
    results, answers = engine.search_v2(queries)
    assert answers.count() == 3 and results.where("query_id = 3").count() > 0
    context_ = {r.query_id: r for r in engine.for_llm(queries, 3).collect()}
    assert context_[1].compressed_tokens > 0
