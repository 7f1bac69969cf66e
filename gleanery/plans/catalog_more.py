"""More registered queries: scans and changes of stores, graph walks, evaluation, search by two phases, rendering.

As in catalog, the driver's tables stand in for the engine's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import models, scoring, text, understanding, vectors
from gleanery.operators import assess, digest, evaluate, filters, fusion, graph, ingest, keyword, ranking, vector
from gleanery.operators.common import ranked
from gleanery.plans.catalog import ASCII, ASKED, BM25, EDGES, HYBRID, OVERLAP, TERMS, asked, chunks_, edges, engine, query, table, vecs
from gleanery.sources import store
from gleanery.streaming import events as streams


# Scans. Orders stand for documents, their lines for chunks, parts for entities.


@query("SELECT l_orderkey AS doc_id, l_linenumber AS id, o_orderstatus AS collection FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def searchable_chunks(spark: SparkSession, d: str) -> DataFrame:
    return searchable(spark, d).select("doc_id", "id", "collection")


def searchable(spark: SparkSession, d: str, collection: str | None = None) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("collection"))
    orders = orders.where(F.col("collection") == collection) if collection else orders
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("id")).join(orders, "doc_id")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def searchable_by_collection(spark: SparkSession, d: str) -> DataFrame:
    return searchable(spark, d, "F").select("doc_id", "id")


def orders_(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ingested_at"), F.col("o_orderstatus").alias("collection"))


NEWEST = """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, coalesce(n, 0) AS chunk_count, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders LEFT JOIN n ON l_orderkey = o_orderkey"""


@query(NEWEST)
def documents_newest(spark: SparkSession, d: str) -> DataFrame:
    rows = store.with_counts(orders_(spark, d), table(spark, d, "lineitem"), "id", "l_orderkey", "chunk_count")
    return ranked(rows, F.desc("ingested_at"), F.asc("id"), by="collection", name="place").select("id", "chunk_count", "place")


@query("SELECT o_orderkey AS id, o_orderdate::VARCHAR AS ingested_at, o_orderstatus AS collection FROM orders WHERE o_orderkey = 7")
def document_by_id(spark: SparkSession, d: str) -> DataFrame:
    return store.by_id(orders_(spark, d), 7).withColumn("ingested_at", F.col("ingested_at").cast("string"))


@query("SELECT n_nationkey AS id, n_name AS name, coalesce(n, 0) AS doc_count, row_number() OVER (ORDER BY n_name) AS place FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def collections_by_name(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    counted = store.with_counts(rows, table(spark, d, "customer"), "id", "c_nationkey", "doc_count")
    return ranked(counted.withColumn("one", F.lit(1)), F.asc("name"), by="one", name="place").drop("one")


@query("SELECT (SELECT count(*) FROM orders) AS documents, (SELECT count(*) FROM lineitem) AS chunks")
def store_totals(spark: SparkSession, d: str) -> DataFrame:
    return store.totals(table(spark, d, "orders"), table(spark, d, "lineitem"))


@query("SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def vector_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return store.dimensions(vecs(spark, d))


@query("SELECT vec_id AS id, len(embedding) AS dim FROM embeddings WHERE len(embedding) <> 48")
def vectors_to_renew(spark: SparkSession, d: str) -> DataFrame:
    return store.with_dim(vecs(spark, d)).where("dim <> 48").select("id", "dim")


PART_ENTITIES = r"SELECT p_partkey AS id, p_name AS name, lower(regexp_replace(p_name, '^\s+|\s+$', '', 'g')) AS normalized_name, p_brand AS entity_type, p_size AS doc_id FROM part"


def part_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("entity_type"), F.col("p_size").alias("doc_id"))
    return rows.withColumn("normalized_name", store.normalized("name"))


@query(f"WITH e AS ({PART_ENTITIES}) SELECT id, normalized_name FROM e WHERE id IN (SELECT min(id) FROM e WHERE normalized_name = 'small ring')")
def entity_by_name(spark: SparkSession, d: str) -> DataFrame:
    return store.first_by_name(part_entities(spark, d), " Small Ring ").select("id", "normalized_name")


@query(f"WITH e AS ({PART_ENTITIES}) SELECT id, name, 'type' AS asked FROM e WHERE entity_type = 'Brand#2' UNION ALL SELECT id, name, 'document' FROM e WHERE doc_id = 11")
def entities_by_type_and_document(spark: SparkSession, d: str) -> DataFrame:
    e = part_entities(spark, d)
    return store.of_type(e, "Brand#2").select("id", "name", F.lit("type").alias("asked")).unionByName(store.of_document(e, 11).select("id", "name", F.lit("document").alias("asked")))


@query("SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE lang = 'en' ORDER BY 1")
def scan_in_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("lang = 'en'").select("doc_id", "n_chars", "lang")
    return ranked(rows, F.asc("doc_id"), by="lang", name="place").drop("lang")


# Changes, on the rows a store starts with and on those of the tables.


@query("SELECT DISTINCT o_custkey AS source_entity_id, o_orderstatus AS relationship_type FROM orders WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey < 500 AND o.o_custkey = orders.o_custkey AND o.o_orderstatus = orders.o_orderstatus)")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    keys = ["source_entity_id", "relationship_type"]
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias(keys[0]), F.col("o_orderstatus").alias(keys[1]))
    return store.absent(rows, rows.where("o_orderkey < 500"), keys).select(*keys)


@query("SELECT sha256(text) AS hash FROM documents GROUP BY 1 HAVING max((doc_id < 300)::INT) = 0")
def unseen_hashes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", text.content_hash("text").alias("hash"))
    return filters.unseen(rows, rows.where("doc_id < 300").select("hash")).select("hash")


@query(rf"""WITH t AS (SELECT doc_id AS id, {TERMS.format('text')} AS t FROM documents)
SELECT id, term, count(*) AS tf, any_value(n) AS n_terms FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM t) GROUP BY id, term UNION ALL SELECT id, NULL, 1, 0 FROM t WHERE len(t) = 0""")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return keyword.postings(chunks_(spark, d))


@query(f"WITH {BM25} SELECT query_id, id, score, rank FROM bm25 WHERE rank <= 10")
def bm25_from_index(spark: SparkSession, d: str) -> DataFrame:
    return keyword.bm25_indexed(keyword.postings(chunks_(spark, d)), asked(spark, d), 10).select("query_id", "id", "score", "rank")


# Filters and statuses.


@query(r"""WITH h AS (SELECT page_id, url, strlen(html) AS size, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN NOT (host = 'org' OR host LIKE '%.org' OR host = 'example.com' OR host LIKE '%.example.com') THEN 'not whitelisted' WHEN size > 15000 THEN 'too large' ELSE 'ok' END AS status FROM h""")
def fetch_status(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url", F.octet_length("html").alias("size"))
    listed = spark.createDataFrame([("org", True), ("example.com", True), ("net", False)], "domain string, enabled boolean")
    return filters.fetch_status(pages, listed, most=15000).select("page_id", "status")


@query("SELECT doc_id FROM documents WHERE contains(lower(source), 'rc1') AND source ILIKE '%c_5%'")
def name_filters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(filters.name_like(F.col("source"), "RC1")).where(filters.name_like(F.col("source"), "C_5", wildcards=True)).select("doc_id")


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(url, '(?i)(?:/tag/|#)') AND regexp_matches(url, '(?i)(?:/[a-m])') AND contains(lower(html), 'the')")
def scope_pages(spark: SparkSession, d: str) -> DataFrame:
    scope = filters.Scope("letters", [], ["/[a-m]"], ["/tag/", "#"], ["the"])
    return table(spark, d, "pages").where(scope.takes(F.col("url"), F.col("html"))).select("page_id")


@query("SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 3 DAY AND value > 5.0")
def published_since(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("ingested_at"), "value")
    return digest.recent(rows, "2024-01-20", 72).where("value > 5.0").select("id")


# Text and scores.


@query(r"SELECT doc_id, substr(regexp_replace(text, '[^\w\s-]', '', 'g'), 1, 50) AS name FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS text FROM documents)")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.safe_name(F.regexp_replace("text", r"[^\x00-\x7F]", "_")).alias("name"))


@query("SELECT doc_id, sha256(concat('# ', source, chr(10), chr(10), '**Source:** ', lang, chr(10), '**Crawled:** ', n_chars, chr(10), chr(10), '---', chr(10), chr(10), text)) AS hash FROM documents")
def page_headers(spark: SparkSession, d: str) -> DataFrame:
    head = ingest.page_header(F.col("source"), F.col("lang"), F.col("n_chars"))
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat(head, "text"), 256).alias("hash"))


@query("""WITH n AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('2401.0', 1000 + doc_id, '.pdf') WHEN 1 THEN concat('report_2024_', doc_id, '.pdf') WHEN 2 THEN concat('notes', doc_id, '.md') WHEN 3 THEN concat('paper_2023_', doc_id) ELSE '' END AS name FROM documents)
SELECT doc_id, round(least(1.0::DOUBLE, 0.5 + 0.2::DOUBLE * (contains(lower(name), 'arxiv') OR regexp_matches(name, '[0-9]{4}[.][0-9]+'))::INT
 + CASE regexp_extract(name, '20(2[3-5])', 1) WHEN '25' THEN 0.15::DOUBLE WHEN '24' THEN 0.15::DOUBLE WHEN '23' THEN 0.1::DOUBLE ELSE 0 END + 0.05::DOUBLE * (name LIKE '%.pdf')::INT), 6) AS quality FROM n""")
def source_qualities(spark: SparkSession, d: str) -> DataFrame:
    k, i = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    name = F.when(k == 0, F.concat(F.lit("2401.0"), (F.col("doc_id") + 1000).cast("string"), F.lit(".pdf"))).when(k == 1, F.concat(F.lit("report_2024_"), i, F.lit(".pdf")))
    name = name.when(k == 2, F.concat(F.lit("notes"), i, F.lit(".md"))).when(k == 3, F.concat(F.lit("paper_2023_"), i)).otherwise("")
    return table(spark, d, "documents").select("doc_id", F.round(scoring.source_quality(name), 6).alias("quality"))


@query("""WITH m AS (SELECT doc_id, n_chars % 100 / 100.0::DOUBLE AS a, n_chars % 7 / 7.0::DOUBLE AS b, n_chars % 11 / 11.0::DOUBLE AS c FROM documents)
SELECT doc_id, round(a * 0.4::DOUBLE + b * 0.2::DOUBLE + c * 0.2::DOUBLE + 0.5 * 0.1::DOUBLE + b * 0.1::DOUBLE, 6) AS combined FROM m""")
def combined_scores(spark: SparkSession, d: str) -> DataFrame:
    part = lambda n: (F.col("n_chars") % n) / F.lit(float(n))
    total = scoring.combined(relevance=part(100), specificity=part(7), factual_density=part(11), source_quality=F.lit(0.5), confidence=part(7))
    return table(spark, d, "documents").select("doc_id", F.round(total, 6).alias("combined"))


@query("""WITH t AS (SELECT doc_id, concat(source, ' says: [', '"', lang, '", "', doc_id, '"', ']') AS reply FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 3 = 1)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(lang, ',', doc_id) ELSE 'rules' END AS list FROM documents""")
def reply_lists(spark: SparkSession, d: str) -> DataFrame:
    def generate(prompt):
        return F.when(F.col("doc_id") % 3 == 0, F.concat(prompt, F.lit(' says: ["'), "lang", F.lit('", "'), F.col("doc_id").cast("string"), F.lit('"]'))).when(F.col("doc_id") % 3 == 1, prompt)

    found = models.asked_list(generate, F.col("source"), F.array(F.lit("rules")))
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("list"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 1 THEN 'I cannot say' ELSE text END = text AS same, CASE WHEN doc_id % 4 = 3 THEN 'imagined' ELSE 'query' END AS used FROM documents WHERE doc_id % 4 <> 1 UNION ALL SELECT doc_id, true, 'query' FROM documents WHERE doc_id % 4 = 1")
def refusals_fall_back(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    generated = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "I CANNOT say").when(k == 2, "  ").otherwise("an imagined passage")
    used = models.or_query(generated, F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.lit(True).alias("same"), F.when(used == F.col("text"), "query").otherwise("imagined").alias("used"))


@query("SELECT name, dim FROM (VALUES ('fast', 128), ('balanced', 256), ('quality', 512), ('full', 1024)) t(name, dim)")
def vector_presets(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(models.DIMENSIONS.items()), "name string, dim int")


@query("""SELECT item_id AS query_id, CASE WHEN contains(lower(text), 'what is') OR contains(lower(text), 'define') OR contains(lower(text), 'meaning of') THEN 'definition' WHEN contains(lower(text), 'how to') OR contains(lower(text), 'how do') OR contains(lower(text), 'how can') OR contains(lower(text), 'steps to') THEN 'how_to'
WHEN contains(lower(text), 'compare') OR contains(lower(text), 'difference between') OR contains(lower(text), 'vs') OR contains(lower(text), 'versus') THEN 'comparison' WHEN contains(lower(text), 'explain') OR contains(lower(text), 'describe') OR contains(lower(text), 'how does') OR contains(lower(text), 'why does') THEN 'technical' ELSE 'factual' END AS kind FROM benchmark""")
def prompt_types(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("query_id", understanding.prompt_type(F.col("query")).alias("kind"))


@query("""WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, k, avg(x) AS x FROM e GROUP BY 1, 2)
SELECT label AS query_id, k - 1 AS "at", round(x, 6) AS x FROM m""")
def mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    mean = vector.mean_vector(table(spark, d, "embeddings").withColumnRenamed("label", "query_id"))
    return mean.select("query_id", F.posexplode("embedding").alias("at", "x")).withColumn("x", F.round("x", 6))


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS q FROM embeddings), p AS (SELECT a.vec_id, list_transform(list_zip(a.q, b.q), lambda z: z[2] * 0.7::DOUBLE + z[1] * 0.3::DOUBLE) AS m FROM q a JOIN q b ON b.vec_id = a.vec_id + 1),
n AS (SELECT vec_id, m, sqrt(list_dot_product(m, m)) AS size FROM p) SELECT vec_id AS id, generate_subscripts(m, 1) - 1 AS "at", round(unnest(m) / (size + 1e-8), 6) AS x FROM n""")
def blended_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = vecs(spark, d).select("id", F.col("embedding").alias("own"))
    both = v.join(v.select((F.col("id") - 1).alias("id"), F.col("own").alias("other")), "id")
    blend = vectors.blend(F.transform("own", lambda x: x.cast("double")), F.col("other"), 0.7)
    return both.select("id", F.posexplode(blend).alias("at", "x")).withColumn("x", F.round("x", 6))


# Ranking, fusion, graphs.


@query(f"WITH {ASKED}, {OVERLAP}, m AS (SELECT query_id, id, list_sort(list(term)) AS matched FROM have JOIN asked USING (term) GROUP BY 1, 2) SELECT query_id, id, score, rank, array_to_string(matched, ' ') AS matched FROM overlap JOIN m USING (query_id, id) WHERE rank <= 20")
def matched_terms(spark: SparkSession, d: str) -> DataFrame:
    found = keyword.overlap(chunks_(spark, d), asked(spark, d), 20, matched=True)
    return found.select("query_id", "id", "score", "rank", F.array_join("matched", " ").alias("matched"))


PHASES = f"""{ASKED}, {OVERLAP}, c AS (SELECT query_id, id, rank FROM overlap WHERE rank <= 50), v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT c.query_id, c.id, c.rank AS rank_a, round(coalesce(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 0), 6) AS score FROM c LEFT JOIN v USING (id) LEFT JOIN v q ON q.id = c.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank_b FROM n)"""


def phased(spark: SparkSession, d: str, how: str) -> DataFrame:
    q = vecs(spark, d).select(F.col("id").alias("query_id"), "embedding")
    return vector.two_phase(keyword.overlap(chunks_(spark, d), asked(spark, d), 50), vecs(spark, d), q, 10, how)


@query(f"WITH {PHASES} SELECT query_id, id, score, rank_b AS rank FROM r WHERE rank_b <= 10")
def two_phase_rerank(spark: SparkSession, d: str) -> DataFrame:
    return phased(spark, d, "rerank")


@query(f"WITH {PHASES}, f AS (SELECT query_id, id, rank_a, rank_b, round(1.0::DOUBLE / (60 + rank_a) + 1.0::DOUBLE / (60 + rank_b), 9) AS score FROM r) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10")
def two_phase_rrf(spark: SparkSession, d: str) -> DataFrame:
    return phased(spark, d, "rrf")


COVERED = "SELECT b.query_id, b.id, round(len(list_filter(['the', 'der', 'que'], lambda x: contains(lower(x_.text), x))) / 3.0::DOUBLE, 2) AS entity FROM {} b JOIN documents x_ ON x_.doc_id = b.id WHERE b.rank <= 20"


@query(f"""WITH {BM25}, {OVERLAP}, e AS ({COVERED.format('bm25')}), s AS (SELECT query_id, id, score AS semantic FROM overlap WHERE rank <= 20),
h AS (SELECT coalesce(s.query_id, e.query_id) AS query_id, coalesce(s.id, e.id) AS id, round(coalesce(semantic, 0) * 0.3::DOUBLE + coalesce(entity, 0) * (1 - 0.3::DOUBLE), 9) AS score FROM s FULL JOIN e ON s.query_id = e.query_id AND s.id = e.id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h) WHERE rank <= 10""")
def hybrid_ranking(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("the", "der", "que")))
    found = keyword.bm25(chunks_(spark, d), asked(spark, d), 20).join(chunks_(spark, d).select("id", "content"), "id")
    entity = found.select("query_id", "id", ranking.entity_coverage(F.col("content"), names).alias("score"))
    return vector.hybrid_rank(keyword.overlap(chunks_(spark, d), asked(spark, d), 20), entity, 0.3)


@query(f"WITH {BM25}, {OVERLAP} SELECT query_id, id, rank FROM bm25 WHERE rank <= 5 AND query_id % 2 = 0 UNION ALL SELECT query_id, id, rank FROM overlap WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM bm25 WHERE query_id % 2 = 0)")
def semantic_fallback(spark: SparkSession, d: str) -> DataFrame:
    near = keyword.bm25(chunks_(spark, d), asked(spark, d), 5).where("query_id % 2 = 0")
    return vector.semantic_or_words(near, keyword.overlap(chunks_(spark, d), asked(spark, d), 5)).select("query_id", "id", "rank")


@query(f"WITH {BM25} SELECT query_id, id, round(1.0::DOUBLE / rank, 9) AS score, rank FROM bm25 WHERE rank <= 30")
def positional_scores(spark: SparkSession, d: str) -> DataFrame:
    return fusion.positional(keyword.bm25(chunks_(spark, d), asked(spark, d), 30)).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH {BM25}, {OVERLAP}, u AS (SELECT query_id, id, 0 AS branch, rank AS k FROM bm25 WHERE rank <= 10 UNION ALL SELECT query_id, id, 1, rank FROM overlap WHERE rank <= 10),
f AS (SELECT query_id, id, min(branch * 1000 + k) AS first FROM u GROUP BY 1, 2) SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY first, id) AS rank FROM f) WHERE rank <= 12""")
def graph_augmented(spark: SparkSession, d: str) -> DataFrame:
    return graph.augment(keyword.bm25(chunks_(spark, d), asked(spark, d), 10), keyword.overlap(chunks_(spark, d), asked(spark, d), 10), 12).select("query_id", "id", "rank")


@query(f"""WITH {BM25}, t AS (SELECT b.query_id, b.id, b.rank AS before, lower(x.text) AS low, length(x.text) AS n FROM bm25 b JOIN documents x ON x.doc_id = b.id WHERE b.rank <= 30),
f AS (SELECT *, list_filter(['the', 'der', 'que'], lambda w: contains(low, w)) AS found FROM t),
s AS (SELECT query_id, id, before, round(round_even(len(found) / 3.0::DOUBLE, 2) + coalesce(0.1::DOUBLE * (1 - (list_min(list_transform(found, lambda w: instr(low, w))) - 1) / n), 0), 9) AS score FROM f)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM s) WHERE rank <= 10""")
def entity_first(spark: SparkSession, d: str) -> DataFrame:
    found = keyword.bm25(chunks_(spark, d), asked(spark, d), 30).join(chunks_(spark, d).select("id", "content"), "id")
    rows = found.withColumn("entities", F.array(*map(F.lit, ("the", "der", "que"))))
    return ranking.by_entities(rows).select("query_id", "id", F.col("entity_score").alias("score"), "rank")


@query("""WITH f AS (SELECT doc_id, list_filter(['the', 'der'], lambda w: contains(lower(text), w)) AS missing, list_filter(['the', 'der', 'que', 'les', 'xyz'], lambda w: contains(lower(text), w)) AS every FROM documents)
SELECT doc_id, round_even(len(missing) / 2.0::DOUBLE, 2) AS missing_coverage, array_to_string(missing, ',') AS found_missing, len(missing) > 0 AS is_valuable, round_even(len(every) / 5.0::DOUBLE, 2) AS total_coverage, array_to_string(every, ',') AS found_all FROM f""")
def entity_breakdown(spark: SparkSession, d: str) -> DataFrame:
    names = lambda *x: F.array(*map(F.lit, x))
    b = ranking.entity_breakdown(F.col("text"), names("the", "der"), names("the", "der", "que", "les", "xyz"))
    rows = table(spark, d, "documents").select("doc_id", b.alias("b")).select("doc_id", "b.*")
    return rows.withColumn("found_missing", F.array_join("found_missing", ",")).withColumn("found_all", F.array_join("found_all", ","))


@query(f"""WITH RECURSIVE {EDGES}, both_ways AS (SELECT src, tgt FROM edges UNION SELECT tgt, src FROM edges),
walk AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT tgt, depth + 1 FROM walk JOIN both_ways ON src = id WHERE depth < 2),
near AS (SELECT id FROM walk GROUP BY id HAVING min(depth) < 2)
SELECT src AS source, tgt AS target, type, 'outgoing' AS direction FROM edges JOIN near ON src = id UNION ALL SELECT tgt, src, type, 'incoming' FROM edges JOIN near ON tgt = id""")
def subgraph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.subgraph(edges(spark, d), spark.createDataFrame([(1,)], "id long"), 2)[1]


@query(f"WITH {EDGES} SELECT 'relationship' AS what, type, count(*) AS n FROM edges GROUP BY type UNION ALL SELECT 'entity', p_brand, count(*) FROM part GROUP BY p_brand")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.counts_by_type(part_entities(spark, d), edges(spark, d))


def named_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nations and customers as entities of the graph of edges()."""
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_name").alias("name"))
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("id"), F.col("c_name").alias("name"))
    return n.unionByName(c).withColumn("normalized_name", F.lower("name"))


MENTIONS = "mentions AS (SELECT 'nation_3' AS name, doc_id FROM documents WHERE doc_id % 7 = 3)"


@query(f"""WITH {EDGES}, {MENTIONS}, nodes AS (SELECT n_nationkey + 100 AS id, n_name AS name FROM nation UNION ALL SELECT c_custkey + 1000, c_name FROM customer),
asked AS (SELECT unnest(['nation_3', 'the', 'no such name at all']) AS name), known AS (SELECT a.name, min(nodes.id) AS id FROM asked a LEFT JOIN nodes ON lower(nodes.name) = a.name GROUP BY 1),
near AS (SELECT src AS id, tgt AS other FROM edges UNION ALL SELECT tgt, src FROM edges), r AS (SELECT known.name, count(*) AS n FROM known JOIN near USING (id) JOIN nodes ON nodes.id = near.other GROUP BY 1)
SELECT known.name, known.id IS NOT NULL AS found, coalesce(r.n, 0) AS n_related, CASE WHEN known.id IS NULL THEN '' ELSE coalesce((SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM mentions WHERE mentions.name = known.name ORDER BY doc_id LIMIT 5)), '') END AS chunk_ids FROM known LEFT JOIN r USING (name)""")
def entity_contexts(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("nation_3",), ("the",), ("no such name at all",)], "normalized_name string")
    mentions = table(spark, d, "documents").where("doc_id % 7 = 3").select(F.lit("nation_3").alias("normalized_name"), F.col("doc_id").alias("chunk_id"))
    got = graph.entity_context(names, named_nodes(spark, d), edges(spark, d), mentions, chunks_(spark, d))
    return got.select("name", "found", F.size("related").alias("n_related"), F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"))


@query("""WITH t AS (SELECT doc_id AS id, lower(text) AS low FROM documents), m AS (SELECT w AS normalized_name, id FROM t, (SELECT unnest(['ation', 'ung']) AS w) WHERE contains(low, w)), l AS (SELECT 'linked' AS normalized_name, id FROM t WHERE id % 11 = 0)
SELECT normalized_name, id FROM (SELECT *, row_number() OVER (PARTITION BY normalized_name ORDER BY id) AS n FROM (SELECT * FROM m UNION ALL SELECT * FROM l)) WHERE n <= 20""")
def chunks_of_entities(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("ation",), ("ung",), ("linked",)], "normalized_name string")
    mentions = table(spark, d, "documents").where("doc_id % 11 = 0").select(F.lit("linked").alias("normalized_name"), F.col("doc_id").alias("chunk_id"))
    return graph.chunks_of(names, mentions, chunks_(spark, d))


@query(f"""WITH {BM25}, {EDGES}, seeds AS (SELECT item_id AS query_id, 100 + item_id % 5 AS id FROM benchmark), mentions AS (SELECT 1000 + doc_id % 200 AS id, doc_id AS chunk_id FROM documents),
near AS (SELECT src AS id, tgt AS other FROM edges UNION SELECT tgt, src FROM edges), p AS (SELECT query_id, other, row_number() OVER (PARTITION BY query_id ORDER BY other) AS place FROM (SELECT DISTINCT query_id, other FROM seeds JOIN near USING (id))),
few AS (SELECT id, chunk_id, row_number() OVER (PARTITION BY id ORDER BY chunk_id) AS n FROM mentions), g AS (SELECT DISTINCT query_id, chunk_id AS id, true AS from_graph FROM p JOIN few ON few.id = other WHERE place <= 5 AND n <= 3), v AS (SELECT * FROM bm25 WHERE rank <= 10),
m AS (SELECT coalesce(v.query_id, g.query_id) AS query_id, coalesce(v.id, g.id) AS id, v.rank AS vector_rank, coalesce(from_graph, false) AS from_graph FROM v FULL JOIN g ON v.query_id = g.query_id AND v.id = g.id),
s AS (SELECT *, round(CASE WHEN vector_rank IS NULL THEN 0.15::DOUBLE ELSE 1.0::DOUBLE / vector_rank * 0.7 + CASE WHEN from_graph THEN 0.06::DOUBLE ELSE 0 END END, 9) AS score FROM m)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def graph_searched(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 5 + 100).alias("id"))
    mentions = table(spark, d, "documents").select((F.col("doc_id") % 200 + 1000).alias("id"), F.col("doc_id").alias("chunk_id"))
    return graph.graph_search(keyword.bm25(chunks_(spark, d), asked(spark, d), 10), seeds, edges(spark, d), mentions)


# Evaluation.

RESULTS = "r AS (SELECT b.query_id, b.id, b.score, b.rank, x.text AS content, x.source AS filename FROM bm25 b JOIN documents x ON x.doc_id = b.id WHERE b.rank <= 5)"
WANTED = "w AS (SELECT item_id AS query_id, unnest(['the', 'der', 'zzz', lower(split_part(text, ' ', 1))]) AS wanted FROM benchmark)"


def results_(spark: SparkSession, d: str) -> DataFrame:
    docs = chunks_(spark, d).select("id", "doc_id", "content", F.col("source").alias("filename"))
    return keyword.bm25(chunks_(spark, d), asked(spark, d), 5).join(docs, "id")


def wanted_(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(F.lit("the"), F.lit("der"), F.lit("zzz"), F.lower(F.split_part("query", F.lit(" "), F.lit(1))))
    return asked(spark, d).select("query_id", F.explode(names).alias("wanted"))


TEXTS = "t AS (SELECT query_id, lower(string_agg(content, ' ' ORDER BY rank)) AS content FROM r GROUP BY 1)"


@query(f"""WITH {BM25}, {RESULTS}, {WANTED}, {TEXTS}, e AS (SELECT w.query_id, round(count(*) FILTER (contains(content, wanted)) / count(*), 6) AS entity_coverage FROM w JOIN t USING (query_id) GROUP BY 1),
c AS (SELECT query_id, id, score, count(*) FILTER (contains(lower(content), wanted)) / count(*) AS share FROM r JOIN w USING (query_id) GROUP BY 1, 2, 3), cr AS (SELECT query_id, round(avg(share * 0.6::DOUBLE + least(score, 1.0) * 0.4::DOUBLE), 6) AS concept_relevance FROM c GROUP BY 1),
p AS (SELECT query_id, count(*) AS num_chunks, round(avg(score), 6) AS avg_retrieval_score, max(score) AS max_retrieval_score FROM r GROUP BY 1)
SELECT *, entity_coverage AS supporting_fact_recall FROM p JOIN e USING (query_id) JOIN cr USING (query_id)""")
def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    w = wanted_(spark, d)
    return evaluate.metric_rows(results_(spark, d), w, w, w)


@query(f"""WITH {BM25}, {RESULTS}, {WANTED}, h AS (SELECT r.query_id, r.id, wanted, contains(lower(content), wanted) AS has FROM r JOIN (SELECT DISTINCT * FROM w) w USING (query_id)),
a AS (SELECT query_id, count(DISTINCT id) FILTER (has) AS relevant, count(DISTINCT id) AS n, count(DISTINCT wanted) FILTER (has) AS found FROM h GROUP BY 1), k AS (SELECT query_id, count(DISTINCT wanted) AS wanted FROM w GROUP BY 1),
m AS (SELECT query_id, coalesce(relevant, 0) AS relevant, coalesce(relevant / n, 0) AS p, coalesce(found / wanted, 0) AS c FROM k LEFT JOIN a USING (query_id))
SELECT query_id, round(p, 6) AS precision, round(c, 6) AS recall, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END, 6) AS f1, relevant FROM m""")
def chunk_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.chunk_metrics(results_(spark, d), wanted_(spark, d))


@query(f"""WITH {BM25}, {RESULTS}, {WANTED}, {TEXTS}, g AS (SELECT DISTINCT query_id, lower(wanted) AS title FROM w), h AS (SELECT DISTINCT g.query_id, title FROM g JOIN r USING (query_id) WHERE contains(lower(concat(filename, ' ', content)), title)),
a AS (SELECT query_id, (SELECT count(*) FROM g x WHERE x.query_id = q.query_id) AS n_gold, (SELECT count(*) FROM h x WHERE x.query_id = q.query_id) AS n_hit, (SELECT count(*) FROM r x WHERE x.query_id = q.query_id) AS n_results FROM (SELECT DISTINCT query_id FROM g) q),
m AS (SELECT query_id, CASE WHEN n_results > 0 THEN n_hit / n_results ELSE 0 END AS p, n_hit / n_gold AS c FROM a), f AS (SELECT w.query_id, round(count(*) FILTER (contains(content, wanted)) / count(*), 6) AS sf_recall FROM w LEFT JOIN t USING (query_id) GROUP BY 1)
SELECT query_id, round(p, 6) AS doc_precision, round(c, 6) AS doc_recall, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END, 6) AS doc_f1, sf_recall FROM m JOIN f USING (query_id)""")
def document_metrics(spark: SparkSession, d: str) -> DataFrame:
    w = wanted_(spark, d)
    return evaluate.document_metrics(results_(spark, d), w, w)


@query(f"WITH {BM25}, {RESULTS}, {TEXTS}, a AS (SELECT item_id AS query_id, concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3)) AS wanted FROM benchmark) SELECT a.query_id, coalesce(contains(content, lower(wanted)), false) AS found FROM a LEFT JOIN t USING (query_id)")
def answers_in_context(spark: SparkSession, d: str) -> DataFrame:
    part = lambda n: F.split_part("query", F.lit(" "), F.lit(n))
    return evaluate.answer_in_context(results_(spark, d), asked(spark, d).select("query_id", F.concat(part(2), F.lit(" "), part(3)).alias("wanted")))


PUNCT = r"'[!-/:-@\[-`{-~]'"
NORMAL = rf"string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(TOLD), {PUNCT}, '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')), ' ')"
TURNS = r"""t AS (SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', 'a', 'g') AS text FROM conversations), p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


@query(rf"""WITH {TURNS}, n AS (SELECT conv_id, turn, list_filter({NORMAL.replace('TOLD', 'x')}, lambda w: w <> '') AS x, list_filter({NORMAL.replace('TOLD', 'y')}, lambda w: w <> '') AS y FROM p),
cx AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(x) AS w FROM n) GROUP BY ALL), cy AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(y) AS w FROM n) GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(least(cx.c, cy.c)) AS common FROM cx JOIN cy USING (conv_id, turn, w) GROUP BY ALL)
SELECT conv_id, turn, (x = y)::INT::DOUBLE AS em, CASE WHEN len(x) = 0 OR len(y) = 0 THEN (len(x) = len(y))::INT::DOUBLE ELSE round(2.0::DOUBLE * coalesce(common, 0) / (len(x) + len(y)), 6) END AS f1 FROM n LEFT JOIN s USING (conv_id, turn)""")
def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[^\x00-\x7F]", "a").alias("x"))
    both = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"])
    return both.select("conv_id", "turn", evaluate.exact_match(F.col("x"), F.col("y")).alias("em"), evaluate.token_f1(F.col("x"), F.col("y")).alias("f1"))


@query("""WITH p AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS k, count(*) OVER () AS n FROM documents)
SELECT count(*) AS n, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, min(n_chars) AS low, max(n_chars) AS high, max(n_chars) FILTER (k = least(floor(n * 95 / 100), n - 1)) AS p95 FROM p""")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.summary(table(spark, d, "documents"), "n_chars")


def questions_(spark: SparkSession, d: str) -> DataFrame:
    """Documents as questions, their lines as the sentences of one context document, with facts in and out of bounds."""
    lines = F.split("text", "\n")
    fact = lambda title, at: F.struct(title.alias("title"), at.cast("int").alias("sent_idx"))
    told = F.array(F.struct(F.col("source").alias("title"), lines.alias("sentences")), F.struct(F.lit("other").alias("title"), F.array(F.lit("One."), F.lit("Two.")).alias("sentences")))
    facts = F.array(fact(F.col("source"), F.col("doc_id") % 4), fact(F.lit("other"), F.col("doc_id") % 3), fact(F.lit("none"), F.lit(0)))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"), facts.alias("supporting_facts"), told.alias("context"))


@query("""WITH l AS (SELECT doc_id AS id, source AS title, string_split(text, chr(10)) AS s FROM documents)
SELECT id, title, (id % 4)::INT AS sent_idx, sha256(s[id % 4 + 1]) AS sentence FROM l WHERE id % 4 < len(s) UNION ALL SELECT id, 'other', (id % 3)::INT, sha256(['One.', 'Two.'][id % 3 + 1]) FROM l WHERE id % 3 < 2""")
def supporting_sentences(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.supporting_sentences(questions_(spark, d)).withColumn("sentence", F.sha2("sentence", 256))


@query("SELECT doc_id AS id, source AS title, sha256(array_to_string(string_split(text, chr(10)), ' ')) AS content, true AS gold FROM documents UNION ALL SELECT doc_id, 'other', sha256('One. Two.'), true FROM documents")
def question_documents(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.context_documents(questions_(spark, d)).select("id", "title", F.sha2("content", 256).alias("content"), "gold")


@query("SELECT source AS doc_id, count(*) AS chunks, sum(n_chars) AS tokens FROM documents GROUP BY 1")
def token_totals(spark: SparkSession, d: str) -> DataFrame:
    return ingest.total_tokens(table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("n_chars").alias("tokens")))


# Rendering.


@query(f"WITH {BM25}, {RESULTS} SELECT item_id AS query_id, sha256(coalesce(string_agg(concat('[', rank, '] ', filename, chr(10), content), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank), 'No results found.')) AS text FROM benchmark LEFT JOIN r ON query_id = item_id GROUP BY 1")
def tool_blocks(spark: SparkSession, d: str) -> DataFrame:
    return digest.blocks_or_nothing(asked(spark, d), results_(spark, d)).withColumn("text", F.sha2("text", 256))


PAPERS = "p AS (SELECT concat('Paper ', lpad(doc_id::VARCHAR, 9, '0')) AS title, concat(lang, ' & more') AS summary, source AS url FROM documents ORDER BY title LIMIT 20)"


def papers_(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.lit("Paper "), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("title"), F.concat("lang", F.lit(" & more")).alias("summary"), F.col("source").alias("url"))


@query(f"""WITH {PAPERS} SELECT concat('<!DOCTYPE html>', chr(10), '<html><body><h1>Digest</h1>', chr(10), string_agg(concat('<div class="paper"><h2>', title, '</h2><a href="', url, '">', url, '</a><p>', replace(summary, '&', '&amp;'), '</p></div>'), chr(10) ORDER BY title), chr(10), '</body></html>') AS digest, count(*) AS n FROM p""")
def digest_page(spark: SparkSession, d: str) -> DataFrame:
    return digest.html(papers_(spark, d), "Digest", 20)


@query(f"WITH {PAPERS} SELECT concat('# Digest', chr(10), chr(10), string_agg(concat('## ', title, chr(10), chr(10), summary, chr(10), chr(10), url), concat(chr(10), chr(10)) ORDER BY title)) AS digest, count(*) AS n FROM p")
def digest_markdown(spark: SparkSession, d: str) -> DataFrame:
    return digest.markdown(papers_(spark, d), "Digest", 20)


@query(f"WITH {PAPERS} SELECT substr(concat('New', chr(10), string_agg(concat('- ', title), chr(10) ORDER BY title)), 1, 60) AS message FROM (SELECT * FROM p ORDER BY title LIMIT 5)")
def digest_message(spark: SparkSession, d: str) -> DataFrame:
    return digest.message(papers_(spark, d), "New", longest=60)


# Understanding, gaps, confidence.

U = understanding
UNDERSTOOD = ", ".join(f"CASE WHEN contains(low, '{e.lower()}') THEN [{{'at': instr(low, '{e.lower()}'), 'size': {-len(e)}, 'name': '{e}'}}] ELSE [] END" for e in U.ENTITIES)
NAMED = rf"""q AS (SELECT item_id AS query_id, {ASCII} AS query, lower({ASCII}) AS low FROM (SELECT item_id, concat('How does SEAL-RAG differ from ', ['DPR and XYZ', 'Multi-Vector search', 'it'][item_id % 3 + 1], '? ', text) AS text FROM benchmark)),
k AS (SELECT *, list_transform(list_sort(flatten([{UNDERSTOOD}])), lambda e: e.name) AS known FROM q),
e AS (SELECT query_id, query, low, flatten([known, regexp_extract_all(query, '\b[A-Z]{{2,}}\b'), regexp_extract_all(query, '\b[A-Z][a-z]+(?:-[A-Z][a-z]+)+\b')]) AS every FROM k),
entities AS (SELECT query_id, query, low, list_filter(every, lambda x, i: list_position(every, x) = i) AS entities FROM e)"""


def named_queries(spark: SparkSession, d: str) -> DataFrame:
    ask = F.concat(F.lit("How does SEAL-RAG differ from "), F.element_at(F.array(F.lit("DPR and XYZ"), F.lit("Multi-Vector search"), F.lit("it")), (F.col("query_id") % 3 + 1).cast("int")), F.lit("? "), "query")
    q = asked(spark, d).select("query_id", F.regexp_replace(ask, r"[^\x00-\x7F]", "a").alias("query"))
    return q.withColumn("entities", U.entities(F.col("query")))


@query(f"WITH {NAMED} SELECT query_id, array_to_string(entities, '|') AS entities FROM entities")
def query_entities(spark: SparkSession, d: str) -> DataFrame:
    return named_queries(spark, d).select("query_id", F.array_join("entities", "|").alias("entities"))


KINDS = "['simple', 'comparative', 'exploratory', 'multi_hop'][query_id % 4 + 1]"


def with_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("simple", "comparative", "exploratory", "multi_hop")))
    return named_queries(spark, d).withColumn("kind", F.element_at(kinds, (F.col("query_id") % 4 + 1).cast("int")))


@query(rf"""WITH {NAMED}, t AS (SELECT *, {KINDS} AS kind, len(regexp_extract_all(query, '[^ \t\n\r\f\x0B]+')) AS n FROM entities)
SELECT query_id, CASE WHEN kind = 'comparative' THEN 'compare' WHEN kind = 'exploratory' THEN 'explore' WHEN kind = 'multi_hop' AND (contains(low, 'how') OR contains(low, 'why') OR contains(low, 'explain') OR contains(low, 'describe')) THEN 'explain' ELSE 'lookup' END AS intent,
least(CASE kind WHEN 'simple' THEN 1 WHEN 'exploratory' THEN 4 ELSE 3 END + least(len(entities), 2) + (n > 15)::INT, 5)::INT AS complexity FROM t""")
def query_intents(spark: SparkSession, d: str) -> DataFrame:
    q = with_kinds(spark, d)
    return q.select("query_id", U.intent(F.col("query"), F.col("kind")).alias("intent"), U.complexity(F.col("query"), F.col("kind"), F.col("entities")).alias("complexity"))


@query(rf"""WITH {NAMED}, t AS (SELECT *, {KINDS} AS kind FROM entities),
p AS (SELECT *, list_filter([trim(regexp_extract(query, '(?i)how does (.+) compare to (.+)', 1)), trim(regexp_extract(query, '(?i)how does (.+) compare to (.+)', 2))], lambda g: g <> '' AND length(g) < 50) AS chain FROM t),
s AS (SELECT query_id, kind, query, entities, CASE WHEN kind = 'comparative' AND len(entities) >= 2 THEN list_concat(list_transform(entities[1:3], lambda e: concat('What is ', e, '?')), [query])
 WHEN kind = 'multi_hop' THEN list_concat(list_transform(list_concat(entities[1:2], chain), lambda e: concat('What is ', e, '?')), [query]) WHEN kind = 'exploratory' THEN list_concat([query], list_transform(entities[1:2], lambda e: concat('What is ', e, '?'))) ELSE [query] END AS subs FROM p)
SELECT query_id, sha256(array_to_string(list_filter(subs, lambda x, i: kind <> 'multi_hop' OR list_position(list_transform(subs, lambda y: lower(y)), lower(x)) = i), '|')) AS subs FROM s""")
def query_parts(spark: SparkSession, d: str) -> DataFrame:
    q = with_kinds(spark, d)
    return q.select("query_id", F.sha2(F.array_join(U.sub_queries(F.col("query"), F.col("kind"), F.col("entities")), "|"), 256).alias("subs"))


SEEN = "seen AS (SELECT item_id AS query_id, text AS query, ['the', 'zzz', split_part(text, ' ', 1), 'Xyzzy'] AS entities, ['simple', 'comparative', 'exploratory', 'multi_hop'][item_id % 4 + 1] AS kind FROM benchmark)"


def seen_queries(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("simple", "comparative", "exploratory", "multi_hop")))
    names = F.array(F.lit("the"), F.lit("zzz"), F.split_part("query", F.lit(" "), F.lit(1)), F.lit("Xyzzy"))
    return asked(spark, d).select("query_id", "query", names.alias("entities"), F.element_at(kinds, (F.col("query_id") % 4 + 1).cast("int")).alias("kind"))


@query(f"""WITH {BM25}, {RESULTS}, {TEXTS}, {SEEN}, g AS (SELECT seen.*, coalesce(content, '') AS content FROM seen LEFT JOIN t USING (query_id)),
m AS (SELECT *, list_filter(entities, lambda e: NOT contains(content, lower(e))) AS missing, list_filter([CASE WHEN kind = 'comparative' AND NOT (contains(content, 'difference') OR contains(content, 'similar') OR contains(content, 'better') OR contains(content, 'worse') OR contains(content, 'compared') OR contains(content, 'vs')) THEN 'comparison between entities' END,
 CASE WHEN kind = 'exploratory' AND length(content) < 500 THEN 'broader coverage of topic' END], lambda x: x IS NOT NULL) AS open FROM g),
c AS (SELECT *, round((1 - len(missing) / len(entities)) * 0.6::DOUBLE + greatest(0.0::DOUBLE, 1 - len(open) * 0.2::DOUBLE) * 0.4::DOUBLE, 6) AS coverage,
 list_concat(list_transform(missing[1:2], lambda e: concat('What is ', e, '?')), list_transform(open[1:2], lambda o: CASE WHEN contains(o, 'comparison') THEN concat('differences ', array_to_string(missing[1:2], ' ')) ELSE query END)) AS asks FROM m)
SELECT query_id, array_to_string(missing, ',') AS missing, array_to_string(open, ',') AS unanswered, coverage, sha256(array_to_string(asks, '|')) AS suggestions, coverage < 0.7 OR len(missing) > 0 AS should_iterate FROM c""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = assess.gaps(seen_queries(spark, d), results_(spark, d))
    joined = lambda c, by=",": F.array_join(c, by)
    return g.select("query_id", joined("missing_entities").alias("missing"), joined("unanswered").alias("unanswered"), "coverage", F.sha2(joined("suggestions", "|"), 256).alias("suggestions"), "should_iterate")


@query(f"""WITH {BM25}, {RESULTS}, {TEXTS}, {SEEN},
f AS (SELECT query_id, round(len(list_filter(entities, lambda e: contains(content, lower(e)))) / len(entities)::DOUBLE, 6) AS entity_coverage FROM seen JOIN t USING (query_id)),
d AS (SELECT query_id, count(*) AS n, round(least(1.0, count(DISTINCT filename) / least(count(*), 5)::DOUBLE), 6) AS source_diversity FROM r GROUP BY 1)
SELECT query_id, entity_coverage, source_diversity, CASE WHEN entity_coverage > 0.8 THEN 'covers all query entities' WHEN entity_coverage < 0.5 THEN 'missing some query entities' ELSE '' END AS told FROM f JOIN d USING (query_id)""")
def confidence_explained(spark: SparkSession, d: str) -> DataFrame:
    sure = assess.confidence(results_(spark, d).withColumn("doc_id", F.col("filename")), seen_queries(spark, d))
    told = F.regexp_extract("explanation", "covers all query entities|missing some query entities", 0)
    return sure.select("query_id", "entity_coverage", "source_diversity", told.alias("told"))


@query(f"""WITH {BM25}, {RESULTS}, {SEEN}, a AS (SELECT r.query_id, id, score / 100 AS score, lower(content) AS low, entities, list_distinct(list_filter(string_split_regex(lower(query), '\\s+'), lambda w: w <> '')) AS asked FROM r JOIN seen USING (query_id)),
b AS (SELECT *, least(1.0::DOUBLE, least(1.0::DOUBLE, greatest(0.0::DOUBLE, score)) + least(0.2::DOUBLE, len(list_filter(entities, lambda e: contains(low, lower(e)))) * 0.1::DOUBLE)) AS start FROM a)
SELECT query_id, id, round(least(1.0::DOUBLE, start + len(list_intersect(asked, string_split_regex(low, '\\s+'))) / len(asked)::DOUBLE * 0.1::DOUBLE), 6) AS relevance FROM b""".replace("\\\\", "\\"))
def chunk_relevance(spark: SparkSession, d: str) -> DataFrame:
    r = results_(spark, d).join(seen_queries(spark, d), "query_id")
    return r.select("query_id", "id", F.round(scoring.relevance(F.col("score") / 100, F.col("content"), F.col("query"), F.col("entities")), 6).alias("relevance"))


# Crawls and sliding windows.


@query(r"""WITH RECURSIVE p AS (SELECT page_id, concat('http://h/', page_id % 60) AS url, list_transform([page_id * 7 % 60, page_id * 11 % 60, 60 + page_id], lambda k: concat('http://h/', k, '#top')) AS links FROM pages WHERE page_id < 60),
out AS (SELECT url, split_part(unnest(links), '#', 1) AS next FROM p), walk AS (SELECT 'http://h/1' AS url, 0 AS depth UNION SELECT next, depth + 1 FROM walk JOIN out USING (url) WHERE depth < 3 AND NOT regexp_matches(next, '/1[0-9]$'))
SELECT url, min(depth)::INT AS depth FROM walk WHERE url IN (SELECT url FROM p) GROUP BY url""")
def crawl_pages(spark: SparkSession, d: str) -> DataFrame:
    to = lambda k: F.concat(F.lit("http://h/"), k.cast("string"))
    n = F.col("page_id")
    links = F.array(*[F.concat(to(k), F.lit("#top")) for k in (n * 7 % 60, n * 11 % 60, n + 60)])
    pages = table(spark, d, "pages").where("page_id < 60").select(to(n % 60).alias("url"), links.alias("links"))
    seeds = spark.createDataFrame([("http://h/1#start",)], "url string")
    return ingest.crawl(pages, seeds, lambda url: filters.url_in_scope(url, [], ["/1[0-9]$"]), hops=3)


@query("""WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start, event_type AS key, value FROM events)
SELECT window_start::VARCHAR AS window_start, key, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def event_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.windowed(table(spark, d, "events"), "event_type", "value", "1 hour", "30 minutes").withColumn("window_start", F.col("window_start").cast("string"))


@query(f"WITH {HYBRID} SELECT query_id, id, doc_id, score, rank FROM hybrid WHERE query_id % 2 = 0")
def hybrid_search_hyde(spark: SparkSession, d: str) -> DataFrame:
    """With a generator that refuses, passages fall back to the queries, and the search is the plain one."""
    e = engine(spark, d)
    e.generate = lambda prompt: F.lit("I cannot help with that.")
    return e.search(asked(spark, d).where("query_id % 2 = 0")).select("query_id", "id", "doc_id", "score", "rank")
