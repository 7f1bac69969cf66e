"""All registered queries of the library's own operators, with their SQL.

Texts of `documents` stand for chunks and their sources for documents,
`benchmark` items for queries, `embeddings` for chunk vectors with labels for
documents, `events` for dated results, and the star schema for metadata and
edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import models, scoring, text, understanding, vectors
from gleanery.operators import assess, context, digest, evaluate, filters, fusion, graph, ingest, keyword, ranking, vector
from gleanery.plans.search import Config, Engine
from gleanery.session import cut
from gleanery.sources.store import with_counts
from gleanery.streaming import events as streams

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def register(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Files up to this size are often one row group, which one task would read alone; their rows are dealt out.
SPREAD_BYTES = 64 << 20
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if name in TEXTS and 1 << 20 < size <= SPREAD_BYTES else df


def chunks_(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc_id"), F.col("text").alias("content"), "source")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vecs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("doc_id"))


def vec_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches: every hundredth vector."""
    return vecs(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")


TERMS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
ASKED = f"asked AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark)"
BM25 = f"""{ASKED},
tokens AS (SELECT doc_id AS id, {TERMS.format('text')} AS t FROM documents),
totals AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_terms FROM tokens),
flat AS (SELECT id, len(t) AS n_terms, unnest(t) AS term FROM tokens),
tf AS (SELECT id, n_terms, term, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / mean_terms))), 6) AS score
  FROM tf JOIN df USING (term) CROSS JOIN totals JOIN asked USING (term) GROUP BY query_id, id),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm)"""
OVERLAP = f"""have AS (SELECT DISTINCT doc_id AS id, unnest({TERMS.format('text')}) AS term FROM documents),
sizes AS (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id),
ov AS (SELECT query_id, id, round(count(*) / any_value(n), 6) AS score FROM have JOIN asked USING (term) JOIN sizes USING (query_id) GROUP BY query_id, id),
overlap AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ov)"""


@query(f"WITH {BM25} SELECT query_id, id, score, rank FROM bm25 WHERE rank <= 30")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return keyword.bm25(chunks_(spark, d), asked(spark, d), 30).select("query_id", "id", "score", "rank")


@query(f"WITH {ASKED}, {OVERLAP} SELECT query_id, id, score, rank FROM overlap WHERE rank <= 50")
def kw_overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    return keyword.overlap(chunks_(spark, d), asked(spark, d), 50).select("query_id", "id", "score", "rank")


def both_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return keyword.bm25(chunks_(spark, d), asked(spark, d), 30), keyword.overlap(chunks_(spark, d), asked(spark, d), 30)


RRF = """fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.rank AS rank_a, b.rank AS rank_b,
  round(coalesce({} / (60 + a.rank), 0) + coalesce({} / (60 + b.rank), 0), 9) AS score
  FROM (SELECT * FROM bm25 WHERE rank <= 30) a FULL JOIN (SELECT * FROM overlap WHERE rank <= 30) b ON a.query_id = b.query_id AND a.id = b.id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10"""


@query(f"WITH {BM25}, {OVERLAP}, {RRF.format('0.65::DOUBLE', '0.35::DOUBLE')}")
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(*both_lists(spark, d), top_k=10)


@query(f"WITH {BM25}, {OVERLAP}, {RRF.format('1.0::DOUBLE', '1.0::DOUBLE')}")
def rrf_unweighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(*both_lists(spark, d), weights=(1.0, 1.0), top_k=10)


@query(f"""WITH {BM25}, {OVERLAP},
v AS (SELECT query_id, id, score, rank, 0 AS variant FROM bm25 WHERE rank <= 30 UNION ALL SELECT query_id, id, score * 40, rank, 1 FROM overlap WHERE rank <= 30),
m AS (SELECT query_id, id, max(score) AS score, count(*) AS match_count, min(variant * 1000 + rank) AS first FROM v GROUP BY query_id, id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS before FROM m),
b AS (SELECT query_id, id, match_count, before, round(score * (1 + 0.05::DOUBLE * (match_count - 1)), 9) AS score FROM r WHERE before <= 20)
SELECT query_id, id, score, match_count, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, id) AS rank FROM b""")
def merge_and_boost(spark: SparkSession, d: str) -> DataFrame:
    a, b = both_lists(spark, d)
    variants = a.select("query_id", "id", "score", "rank", F.lit(0).alias("variant")).unionByName(b.select("query_id", "id", F.col("score") * 40, "rank", F.lit(1).alias("variant")).toDF("query_id", "id", "score", "rank", "variant"))
    return fusion.boost_matches(fusion.merge_variants(variants, 20)).select("query_id", "id", "score", "match_count", "rank")


DIVERSE = """d AS (SELECT b.query_id, b.id, x.source AS doc_id, b.rank AS before, (row_number() OVER (PARTITION BY b.query_id, x.source ORDER BY b.rank) > 2)::INT AS over
  FROM bm25 b JOIN documents x ON x.doc_id = b.id WHERE b.rank <= 30)
SELECT query_id, id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over, before) AS rank FROM d {}) WHERE rank <= 10"""


@query(f"WITH {BM25}, {DIVERSE.format('')}")
def diversify_soft(spark: SparkSession, d: str) -> DataFrame:
    found = keyword.bm25(chunks_(spark, d), asked(spark, d), 30).join(chunks_(spark, d).select("id", "doc_id"), "id")
    return ranking.diversify(found, 10, 2).select("query_id", "id", "doc_id", "rank")


@query(f"WITH {BM25}, {DIVERSE.format('WHERE over = 0')}")
def diversify_hard(spark: SparkSession, d: str) -> DataFrame:
    found = keyword.bm25(chunks_(spark, d), asked(spark, d), 30).join(chunks_(spark, d).select("id", "doc_id"), "id")
    return ranking.diversify(found, 10, 2, strict=True).select("query_id", "id", "doc_id", "rank")


VECS = "v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT id AS query_id, e AS qe FROM v WHERE id % 100 = 0)"
COS = "round(list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))), 6)"


@query(f"""WITH {VECS}, s AS (SELECT query_id, id, {COS.format('qe', 'e')} AS score FROM v CROSS JOIN q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector.nearest(vecs(spark, d), vec_queries(spark, d), 10)


MATRYOSHKA = f"{VECS}, s AS (SELECT query_id, id, {COS.format('qe[:16]', 'e[:16]')} AS score FROM v CROSS JOIN q), coarse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"


@query(f"WITH {MATRYOSHKA} SELECT * FROM coarse WHERE rank <= 50")
def matryoshka_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector.nearest(vecs(spark, d), vec_queries(spark, d), 50, dim=16)


@query(f"""WITH {MATRYOSHKA}, f AS (SELECT query_id, id, {COS.format('qe', 'e')} AS score FROM coarse JOIN v USING (id) JOIN q USING (query_id) WHERE rank <= 50)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""")
def two_phase_vector(spark: SparkSession, d: str) -> DataFrame:
    coarse = vector.nearest(vecs(spark, d), vec_queries(spark, d), 50, dim=16)
    return vector.rerank(coarse, vecs(spark, d), vec_queries(spark, d), 10)


@query(f"""WITH {VECS}, c AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS chunk_index, e FROM v),
p AS (SELECT m.id AS match_id, x.id, x.chunk_index, x.chunk_index - m.chunk_index AS step, CASE WHEN x.id = m.id THEN 1.0 ELSE {COS.format('m.e', 'x.e')} END AS similarity
  FROM c m JOIN c x ON m.label = x.label AND abs(x.chunk_index - m.chunk_index) <= 2 WHERE m.id % 100 = 0),
w AS (SELECT *, min(similarity) OVER (PARTITION BY match_id, sign(step) ORDER BY abs(step)) AS weakest FROM p)
SELECT match_id, id, chunk_index, similarity FROM w WHERE step = 0 OR weakest >= 0.0""")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("id")
    numbered = vecs(spark, d).withColumn("chunk_index", F.row_number().over(order) - 1)
    return context.context_window(numbered.where("id % 100 = 0"), numbered, 2, 0.0)


@query("""WITH e AS (SELECT event_type AS query_id, event_id AS id, value, floor(epoch(TIMESTAMP '2025-12-01' - ts) / 86400) AS age, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS before FROM events),
b AS (SELECT *, exp(-0.03::DOUBLE * age / 30) AS boost FROM e)
SELECT query_id, id, round(value * (1 + 0.15::DOUBLE * boost), 9) AS score, round(boost, 9) AS recency_boost, row_number() OVER (PARTITION BY query_id ORDER BY round(value * (1 + 0.15::DOUBLE * boost), 9) DESC, before) AS rank FROM b""")
def recency_weight(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("score"), "ts")
    r = e.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranking.recency(r, "ts", "2025-12-01").select("query_id", "id", "score", "recency_boost", "rank")


@query("""SELECT o_orderkey AS id, o_orderstatus AS collection, coalesce(n, 0) AS chunk_count FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') >= '1994-01-01' AND strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') <= '1996-12-31' AND o_orderstatus = 'O' AND coalesce(n, 0) >= 3""")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ingested_at"), F.col("o_orderstatus").alias("collection"))
    counted = with_counts(orders, table(spark, d, "lineitem"), "id", "l_orderkey", "chunk_count")
    return counted.where(filters.metadata("1994-01-01", "1996-12-31", "O", 3)).select("id", "collection", "chunk_count")


@query("SELECT source AS collection, count(*) AS doc_count, count(DISTINCT lang) AS n_types, sum(n_chars) AS n_chars FROM documents GROUP BY source")
def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("doc_count"), F.count_distinct("lang").alias("n_types"), F.sum("n_chars").alias("n_chars"))


@query("SELECT DISTINCT sha256(text) AS hash FROM documents")
def dedupe_hash(spark: SparkSession, d: str) -> DataFrame:
    hashed = table(spark, d, "documents").select(text.content_hash("text").alias("hash"))
    return filters.unseen(hashed, hashed.limit(0))


@query(r"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS domain, split_part(url, '#', 1) AS plain_url, NOT regexp_matches(url, '(?i)(?:login|/tag/)') AND regexp_matches(url, '(?i)(?:page|news|a)') AS in_scope, contains(lower(html), 'the') OR contains(lower(html), 'der') AS on_topic FROM pages")
def url_and_content_scope(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id",
        text.domain(url).alias("domain"),
        text.without_fragment(url).alias("plain_url"),
        filters.url_in_scope(url, ["page", "news", "a"], ["login", "/tag/"]).alias("in_scope"),
        filters.content_in_scope(F.col("html"), ["the", "der"]).alias("on_topic"),
    )


@query(r"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages),
w AS (SELECT unnest(['example.com', 'example.org', 'org']) AS domain)
SELECT DISTINCT page_id, url FROM h, w WHERE host = domain OR host LIKE concat('%.', domain)""")
def domain_whitelist(spark: SparkSession, d: str) -> DataFrame:
    listed = spark.createDataFrame([("example.com", True), ("example.org", True), ("org", True), ("net", False)], "domain string, enabled boolean")
    return filters.whitelisted(table(spark, d, "pages").select("page_id", "url"), listed)


WATCHED = ["the", "der", "tion", "que", "les"]


@query(f"""WITH e AS (SELECT doc_id, text, list_filter({WATCHED}, lambda x: contains(lower(text), x)) AS found FROM documents)
SELECT doc_id, round_even(len(found) / 5.0::DOUBLE, 2) AS coverage,
round(coalesce(0.1::DOUBLE * (1 - (list_min(list_transform(found, lambda x: instr(lower(text), x))) - 1) / length(text)), 0), 6) AS bonus FROM e""")
def entity_coverage(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, WATCHED))
    return table(spark, d, "documents").select("doc_id", ranking.entity_coverage(F.col("text"), names).alias("coverage"), F.round(ranking.position_bonus(F.col("text"), names), 6).alias("bonus"))


ASCII = r"regexp_replace(text, '[^\x00-\x7F]', 'a', 'g')"
NWORDS = r"len(regexp_extract_all({}, '[^ \t\n\r\f\x0B]+'))"


def n_of(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


NUMBER = scoring.NUMBER


def any_hits(words: list[str]) -> str:
    return " + ".join(rf"regexp_matches(lower(t), '\b{w}\b')::INT" for w in words)


@query(rf"""WITH d AS (SELECT doc_id, source, {ASCII} AS t FROM documents), n AS (SELECT *, {NWORDS.format('t')} AS n FROM d)
SELECT doc_id,
round(least(1.0::DOUBLE, (least({n_of(NUMBER)}, 5) + least({n_of(r'\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b')}, 5) + least({n_of(r'\b[A-Z]{2,}\b|\b\w+-\w+\b')}, 3) + least({n_of(r'\([^)]*\d{4}[^)]*\)|\[\d+\]')}, 3)) / 10.0), 6) AS specificity,
round(CASE WHEN n < 10 THEN 0.0 ELSE least(1.0::DOUBLE, ({n_of(NUMBER)} + {n_of(r'\b[A-Z][a-z]+\b')} + {n_of(r'\b[A-Z]{2,}\b')} + {n_of('[=<>]')}) * 100.0::DOUBLE / n / 20.0) END, 6) AS factual_density,
0.5::DOUBLE AS source_quality,
round(CASE WHEN n < 10 THEN 0.5 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 + ({any_hits(scoring.CONFIDENT)} - ({any_hits(scoring.HEDGES)})) * 0.1::DOUBLE * 100 / n)) END, 6) AS confidence FROM n""")
def chunk_score(spark: SparkSession, d: str) -> DataFrame:
    plain = table(spark, d, "documents").select("doc_id", "source", F.regexp_replace("text", r"[^\x00-\x7F]", "a").alias("t"))
    t = F.col("t")
    return plain.select(
        "doc_id",
        F.round(scoring.specificity(t), 6).alias("specificity"),
        F.round(scoring.factual_density(t), 6).alias("factual_density"),
        scoring.source_quality(F.col("source")).alias("source_quality"),
        F.round(scoring.confidence(t), 6).alias("confidence"),
    )


@query(f"""WITH {BM25},
r AS (SELECT b.query_id, b.id, b.rank, b.score / 100 AS score, x.source AS doc_id, list_distinct(list_transform(regexp_extract_all({ASCII.replace('text', 'x.text')}, '\\b[A-Z][a-z]+(?:-[A-Z][a-z]+)*\\b'), lambda s: lower(s))) AS terms FROM bm25 b JOIN documents x ON x.doc_id = b.id WHERE b.rank <= 8),
s AS (SELECT query_id, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS spread, count(DISTINCT doc_id) AS docs FROM r GROUP BY query_id),
j AS (SELECT a.query_id, avg(len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms)))::DOUBLE) AS agreement FROM r a JOIN r b ON a.query_id = b.query_id AND a.rank < b.rank WHERE len(a.terms) > 0 AND len(b.terms) > 0 GROUP BY 1),
p AS (SELECT query_id, n, round(CASE WHEN n < 2 THEN 0.5 ELSE mean * 0.6 + (1 - least(spread * 2, 1.0)) * 0.4 END, 6) AS score_distribution, 0.7::DOUBLE AS entity_coverage,
  round(CASE WHEN n < 2 THEN 0.5 ELSE coalesce(agreement, 0.5) END, 6) AS source_agreement, round(CASE WHEN n < 2 THEN 0.3 ELSE least(1.0, docs / least(n, 5)::DOUBLE) END, 6) AS source_diversity FROM s LEFT JOIN j USING (query_id))
SELECT *, round(score_distribution * 0.2 + entity_coverage * 0.3 + source_agreement * 0.3 + source_diversity * 0.2, 8) AS overall FROM p""")
def confidence_parts(spark: SparkSession, d: str) -> DataFrame:
    found = keyword.bm25(chunks_(spark, d), asked(spark, d), 8).withColumn("score", F.col("score") / 100)
    docs = chunks_(spark, d).withColumn("content", F.regexp_replace("content", r"[^\x00-\x7F]", "a"))
    q = asked(spark, d).withColumn("entities", F.array().cast("array<string>"))
    return assess.confidence(found.join(docs, "id"), q).drop("explanation")


CLAIMS = [
    (1, "A", 0, "SEAL reaches 61% accuracy", "statistic", "SEAL"),
    (2, "B", 0, "seal reaches 45% accuracy", "statistic", "seal"),
    (3, "C", 0, "X-RAG outperforms Y-RAG", "comparison", "X-RAG"),
    (4, "D", 0, "Y-RAG beats X-RAG", "comparison", "Y-RAG"),
    (5, "E", 0, "DPR reaches 61% accuracy", "statistic", "DPR"),
]
VALUES = ", ".join(f"({a}, {p}, '{t}', '{k}', '{s}')" for a, _, p, t, k, s in CLAIMS)


@query(f"""WITH c AS (SELECT *, lower(s) AS key, regexp_extract(t, '\\d+(?:\\.\\d+)?%?') AS num, lower(regexp_extract(t, '(?i)(\\w+(?:-\\w+)?)\\s+(?:outperforms?|beats?|exceeds?|is better than)\\s+(\\w+(?:-\\w+)?)', 1)) AS b,
lower(regexp_extract(t, '(?i)(\\w+(?:-\\w+)?)\\s+(?:outperforms?|beats?|exceeds?|is better than)\\s+(\\w+(?:-\\w+)?)', 2)) AS w FROM (VALUES {VALUES}) x(chunk_id, pos, t, k, s))
SELECT x.chunk_id AS chunk_id_a, y.chunk_id AS chunk_id_b, CASE WHEN x.k = 'statistic' THEN 0.9::DOUBLE ELSE 0.85 END AS confidence FROM c x JOIN c y ON x.chunk_id < y.chunk_id AND x.k = y.k
AND ((x.k = 'statistic' AND x.key = y.key AND x.num <> y.num) OR (x.k = 'comparison' AND x.b = y.w AND x.w = y.b))""")
def contradiction_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = spark.createDataFrame(CLAIMS, "chunk_id long, source string, pos int, text string, claim_type string, subject string")
    return assess.contradictions(c).select("chunk_id_a", "chunk_id_b", "confidence")


def contradicted(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_contradictions) for every chunk: how many pairs of claims that can't both hold it has a part in."""
    pairs = assess.contradictions(cut(assess.claims(chunks))).select(F.explode(F.array("chunk_id_a", "chunk_id_b")).alias("id"))
    counts = pairs.groupBy("id").agg(F.count("*").alias("n"))
    return chunks.select("id").join(counts, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("n", F.lit(0)).alias("n_contradictions"))


@query("""WITH p AS (SELECT doc_id, doc_id // 2 AS pair, doc_id % 90 + 10 AS value FROM documents), n AS (SELECT a.doc_id, count(*) FILTER (a.value <> b.value) * 4 AS n FROM p a JOIN p b ON a.pair = b.pair AND a.doc_id <> b.doc_id GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_contradictions FROM documents LEFT JOIN n USING (doc_id)""")
def document_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return contradicted(claiming(spark, d))


def claiming(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents after a sentence of their own that claims something; two at a time speak of one subject."""
    subject = F.translate(F.floor(F.col("id") / 2).cast("string"), "0123456789", "abcdefghij")
    said = F.concat(F.lit("Model-"), subject, F.lit(" achieves "), (F.col("id") % 90 + 10).cast("string"), F.lit("% accuracy. "))
    return chunks_(spark, d).withColumn("content", F.concat(said, "content"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as a graph; ids of the three kinds apart."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    up = n.select(F.col("n_regionkey").alias("src"), (F.col("n_nationkey") + 100).alias("tgt"), F.lit("has").alias("type"))
    return up.unionByName(c.select((F.col("c_nationkey") + 100).alias("src"), (F.col("c_custkey") + 1000).alias("tgt"), F.lit("serves").alias("type")))


EDGES = "edges AS (SELECT n_regionkey::BIGINT AS src, n_nationkey + 100::BIGINT AS tgt, 'has' AS type FROM nation UNION ALL SELECT c_nationkey + 100, c_custkey + 1000, 'serves' FROM customer)"


@query(f"WITH {EDGES} SELECT src AS id, tgt AS other, type, 'outgoing' AS direction FROM edges WHERE src IN (1, 103) UNION ALL SELECT tgt, src, type, 'incoming' FROM edges WHERE tgt IN (1, 103)")
def related_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.related(edges(spark, d), spark.createDataFrame([(1,), (103,)], "id long"))


@query(f"""WITH RECURSIVE {EDGES}, both_ways AS (SELECT src, tgt FROM edges UNION SELECT tgt, src FROM edges),
walk AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT tgt, depth + 1 FROM walk JOIN both_ways ON src = id WHERE depth < 2)
SELECT id, min(depth)::INT AS depth FROM walk GROUP BY id""")
def subgraph_khop(spark: SparkSession, d: str) -> DataFrame:
    return graph.within_hops(edges(spark, d), spark.createDataFrame([(1,)], "id long"), 2)


@query(f"""WITH {BM25}, {OVERLAP}, v AS (SELECT * FROM bm25 WHERE rank <= 10), g AS (SELECT DISTINCT query_id, id, true AS from_graph FROM overlap WHERE rank <= 10),
m AS (SELECT coalesce(v.query_id, g.query_id) AS query_id, coalesce(v.id, g.id) AS id, v.rank AS vector_rank, coalesce(from_graph, false) AS from_graph FROM v FULL JOIN g ON v.query_id = g.query_id AND v.id = g.id),
s AS (SELECT *, round(CASE WHEN vector_rank IS NULL THEN 0.15::DOUBLE ELSE 1.0::DOUBLE / vector_rank * 0.7 + CASE WHEN from_graph THEN 0.06::DOUBLE ELSE 0 END END, 9) AS score FROM m)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def graph_merge(spark: SparkSession, d: str) -> DataFrame:
    return fusion.merge_graph(keyword.bm25(chunks_(spark, d), asked(spark, d), 10), keyword.overlap(chunks_(spark, d), asked(spark, d), 10))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
t AS (SELECT *, {NWORDS.format('line')} AS n, floor({NWORDS.format('line')} * 13 / 10)::INT AS tokens FROM l),
o AS (SELECT *, sum(tokens) OVER w AS total, row_number() OVER w AS place FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY n DESC, line_no ROWS UNBOUNDED PRECEDING))
SELECT doc_id, line_no, tokens FROM o WHERE total <= 100 OR place <= 3""")
def budget_select(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("n", text.n_words("line"))
    return ranking.within_budget(lines, "doc_id", "line", "n", "line_no", 100).select("doc_id", "line_no", "tokens")


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 48)) AS start FROM w)
SELECT doc_id, start, array_to_string(w[start + 1:start + 64], ' ') AS text FROM s""")
def chunk_word_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(text.word_windows("text", 64, 48)).alias("w")).select("doc_id", "w.start", "w.text")


@query(r"SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS normal FROM (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', 'a', 'g') AS text FROM benchmark)")
def normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", text.normalize_answer(F.regexp_replace("text", r"[^\x00-\x7F]", "a")).alias("normal"))


WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]+"
LINE_ENDS = r"^[\s\x1c-\x1f\x{85}\x{a0}]+|[\s\x1c-\x1f\x{85}\x{a0}]+$"
CLEAN = "text"
for _pattern, _into in text.CLEANING:
    _pattern = _pattern.replace(r"(?U)(\w+)-\n(\w+)", f"({WORD})-\\n({WORD})").replace("'", "''")
    CLEAN = f"regexp_replace({CLEAN}, '{_pattern}', " + {"$1$2": r"'\1\2'", "\n\n": "chr(10) || chr(10)", "\n": "chr(10)"}.get(_into, "'" + _into.replace("'", "''") + "'") + ", 'g')"


@query(f"SELECT doc_id, sha256(regexp_replace(array_to_string(list_transform(string_split({CLEAN}, chr(10)), lambda x: regexp_replace(x, '{LINE_ENDS}', '', 'g')), chr(10)), '{LINE_ENDS}', '', 'g')) AS clean_sha256 FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(text.clean_text("text"), 256).alias("clean_sha256"))


@query("""WITH g AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, max(n_chars) FILTER (place = least(floor(n * 50 / 100), n - 1)) AS p50, max(n_chars) FILTER (place = least(floor(n * 95 / 100), n - 1)) AS p95, max(n_chars) FILTER (place = least(floor(n * 99 / 100), n - 1)) AS p99 FROM g GROUP BY source""")
def metric_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.nearest_rank(table(spark, d, "documents"), ["source"], "n_chars")


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY ROLLUP (lang)")
def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.roll_up(table(spark, d, "documents"), "lang", "n_chars")


@query(f"""WITH {BM25}, {OVERLAP}, r AS (SELECT query_id, id FROM bm25 WHERE rank <= 10), g AS (SELECT query_id, id FROM overlap WHERE rank <= 5),
h AS (SELECT r.query_id, count(*) AS n_retrieved, count(g.id) AS n_hit FROM r LEFT JOIN g ON r.query_id = g.query_id AND r.id = g.id GROUP BY 1), n AS (SELECT query_id, count(*) AS n_gold FROM g GROUP BY 1),
b AS (SELECT query_id, coalesce(n_retrieved, 0) AS n_retrieved, n_gold, coalesce(n_hit, 0) AS n_hit FROM n LEFT JOIN h USING (query_id))
SELECT *, round(CASE WHEN n_retrieved > 0 THEN n_hit / n_retrieved ELSE 0 END, 6) AS precision, round(n_hit / n_gold, 6) AS recall, round(CASE WHEN n_hit > 0 THEN 2 * (n_hit / n_retrieved) * (n_hit / n_gold) / (n_hit / n_retrieved + n_hit / n_gold) ELSE 0 END, 6) AS f1 FROM b""")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.precision_recall(keyword.bm25(chunks_(spark, d), asked(spark, d), 10), keyword.overlap(chunks_(spark, d), asked(spark, d), 5))


U = understanding


def matches(patterns: list[str], c: str = "q") -> str:
    return f"regexp_matches({c}, '{U.any_of(patterns)}')"


@query(rf"""WITH t AS (SELECT conv_id, turn, {ASCII} AS q FROM conversations WHERE role = 'user'), n AS (SELECT *, {NWORDS.format('q')} AS n FROM t)
SELECT conv_id, turn, CASE WHEN {matches(U.DEFINITIONS, 'lower(q)')} THEN 'simple' WHEN {matches(U.COMPARATIVE)} THEN 'comparative' WHEN {matches(U.EXPLORATORY)} THEN 'exploratory' WHEN {matches(U.MULTI_HOP)} THEN 'multi_hop' ELSE 'simple' END AS kind FROM n""")
def query_classify(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.regexp_replace("text", r"[^\x00-\x7F]", "a").alias("q"))
    return turns.select("conv_id", "turn", U.query_type(F.col("q"), F.array().cast("array<string>")).alias("kind"))


WHOLE = ", ".join(f"CASE WHEN low = '{t}' THEN {e[:3]} ELSE [] END" for t, e in U.EXPANSIONS)
HELD = ", ".join("CASE WHEN contains(low, '{0}') AND low <> '{0}' THEN [{1}] ELSE [] END".format(t, ", ".join(f"replace(low, '{t}', '{x}')" for x in e[:3])) for t, e in U.EXPANSIONS)


@query(f"""WITH t AS (SELECT conv_id, turn, text, lower(trim(text)) AS low FROM conversations WHERE role = 'user'),
x AS (SELECT conv_id, turn, flatten([[text], {WHOLE}, {HELD}]) AS all_ FROM t),
u AS (SELECT conv_id, turn, list_filter(all_, lambda e, i: list_position(all_, e) = i)[:4] AS e FROM x)
SELECT conv_id, turn, unnest(e) AS expanded, generate_subscripts(e, 1) - 1 AS variant FROM u""")
def query_expand(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", F.posexplode(U.expansions(F.col("text"))).alias("variant", "expanded"))


@query("SELECT event_id AS id, ts::VARCHAR AS at FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR AND event_type = 'click'")
def digest_recent(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    now = str(e.agg(F.max("ts")).first()[0])
    rows = e.select(F.col("event_id").alias("id"), F.col("ts").alias("ingested_at"), F.col("event_type").alias("collection"))
    return digest.recent(rows, now, 48, "click").select("id", F.col("ingested_at").cast("string").alias("at"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS window_start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.windowed(table(spark, d, "events"), "event_type", "value").withColumn("window_start", F.col("window_start").cast("string"))


@query("""WITH g AS (SELECT user_id AS key, ts, (coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true))::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT key, ts, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT key, min(ts)::VARCHAR AS session_start, (max(ts) + INTERVAL 30 MINUTE)::VARCHAR AS session_end, count(*) AS n FROM s GROUP BY key, s.s""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = streams.sessions(table(spark, d, "events"), "user_id")
    return s.withColumn("session_start", F.col("session_start").cast("string")).withColumn("session_end", F.col("session_end").cast("string"))


def engine(spark: SparkSession, d: str, **config) -> Engine:
    return Engine.over(chunks_(spark, d), Config(**config))


EMBEDDED = f"""asked_all AS (SELECT item_id AS id, unnest({TERMS.format('text')}) AS term FROM benchmark),
dvec AS (SELECT id, ('0x' || md5(term)[1:2])::INT % 64 AS p, sum(CASE WHEN ('0x' || md5(term)[3:4])::INT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM flat GROUP BY 1, 2),
qvec AS (SELECT id AS query_id, ('0x' || md5(term)[1:2])::INT % 64 AS p, sum(CASE WHEN ('0x' || md5(term)[3:4])::INT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM asked_all GROUP BY 1, 2)"""
NEAR = """dn AS (SELECT id, sqrt(sum(x * x)) AS size FROM dvec GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(x * x)) AS size FROM qvec GROUP BY 1),
dots AS (SELECT query_id, id, sum(d.x * q.x) AS dot FROM dvec d JOIN qvec q USING (p) GROUP BY 1, 2),
ns AS (SELECT qn.query_id, dn.id, round(CASE WHEN qn.size * dn.size > 0 THEN coalesce(dot, 0) / (qn.size * dn.size) ELSE 0 END, 6) AS score FROM qn CROSS JOIN dn LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.id = dn.id),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ns)"""
HYBRID = f"""{BM25}, {OVERLAP}, {EMBEDDED}, {NEAR},
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, round(coalesce(0.65::DOUBLE / (60 + a.rank), 0) + coalesce(0.35::DOUBLE / (60 + b.rank), 0), 9) AS score
  FROM (SELECT * FROM near WHERE rank <= 30) a FULL JOIN (SELECT * FROM bm25 WHERE rank <= 30) b ON a.query_id = b.query_id AND a.id = b.id),
p AS (SELECT query_id, id, rank, 1.0::DOUBLE / rank AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 30),
s AS (SELECT p.*, x.source AS doc_id, coalesce(ov.score, 0) AS reranked, count(*) OVER (PARTITION BY p.query_id) AS n FROM p JOIN documents x ON x.doc_id = p.id LEFT JOIN ov ON ov.query_id = p.query_id AND ov.id = p.id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 10 THEN reranked END DESC NULLS LAST, rank) AS before FROM s),
v AS (SELECT *, (row_number() OVER (PARTITION BY query_id, doc_id ORDER BY before) > 3)::INT AS over FROM t),
hybrid AS (SELECT * FROM (SELECT query_id, id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY over, before) AS rank FROM v) WHERE rank <= 10)"""


@query(f"WITH {HYBRID} SELECT query_id, id, doc_id, score, rank FROM hybrid")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).search(asked(spark, d)).select("query_id", "id", "doc_id", "score", "rank")


@query()
def hybrid_search_expanded(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d, expand=True).search(asked(spark, d)).select("query_id", "id", "doc_id", "score", "rank")


@query()
def search_for_llm(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).for_llm(asked(spark, d), 400)


@query()
def analyze_queries(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).analyze(asked(spark, d))


@query()
def adaptive_search(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    return e.adaptive(e.analyze(asked(spark, d))).select("query_id", "id", "k", "rank", "depth_status")


@query()
def iterative_search(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    return e.iterate(e.analyze(asked(spark, d))).select("query_id", "id", "rank")


@query()
def search_v2(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).search_v2(asked(spark, d))[1]


@query()
def gap_analysis(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    found = keyword.bm25(chunks_(spark, d), asked(spark, d), 5).join(chunks_(spark, d), "id")
    return assess.gaps(e.analyze(asked(spark, d)), found)


@query()
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"))
    return ingest.chunks(docs, 128, 16, 20)


@query()
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return ingest.pages_to_markdown(table(spark, d, "pages"))


@query(r"""WITH c AS (SELECT doc_id, source, concat('Model-', translate((doc_id // 2)::VARCHAR, '0123456789', 'abcdefghij')) AS subject, (doc_id % 90 + 10)::VARCHAR AS value, text FROM documents),
t AS (SELECT *, concat(subject, ' achieves ', value, '% accuracy') AS said FROM c), x AS (SELECT *, regexp_replace(substr(concat(said, '. ', text), 1, length(said) + 50), '[\s\x{85}\x{a0}]+$', '') AS told FROM t)
SELECT doc_id AS chunk_id, source, pos::INT AS pos, told AS text, 'statistic' AS claim_type, subject, 0.9::DOUBLE AS confidence FROM x, (SELECT unnest([0, 1]) AS pos)""".replace("\\\\", "\\"))
def extract_claims(spark: SparkSession, d: str) -> DataFrame:
    return assess.claims(claiming(spark, d))


@query()
def extract_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.extract(chunks_(spark, d))


@query()
def textrank_sentences(spark: SparkSession, d: str) -> DataFrame:
    found = keyword.bm25(chunks_(spark, d), asked(spark, d), 3).join(chunks_(spark, d), "id")
    embed = models.hash_embedder()
    rows = context.sentence_rows(found).join(asked(spark, d), "query_id")
    return context.extractive(rows.select("query_id", "sentence_no", embed(F.col("sentence")).alias("embedding"), embed(F.col("query")).alias("query_embedding")))


@query(f"""WITH flat AS (SELECT 0 AS id, 'x' AS term), {EMBEDDED}, grid AS (SELECT item_id AS query_id, unnest(range(64)) AS p FROM benchmark),
m AS (SELECT query_id, p, coalesce(x, 0) * 0.7::DOUBLE + coalesce(x, 0) * (1 - 0.7::DOUBLE) AS m FROM grid LEFT JOIN qvec USING (query_id, p)), n AS (SELECT query_id, sqrt(sum(m * m)) AS size FROM m GROUP BY 1)
SELECT query_id, p AS "at", round(m / (size + 1e-8), 6) AS x FROM m JOIN n USING (query_id)""")
def hyde_blend(spark: SparkSession, d: str) -> DataFrame:
    embed = models.hash_embedder()
    q = asked(spark, d).select("query_id", "query", embed(F.col("query")).alias("q"), embed(models.or_query(F.lit(None).cast("string"), F.col("query"))).alias("h"))
    return q.select("query_id", F.posexplode(vectors.blend(F.col("q"), F.col("h"), 0.7)).alias("at", "x")).withColumn("x", F.round("x", 6))


@query()
def select_budget(spark: SparkSession, d: str) -> DataFrame:
    found = keyword.bm25(chunks_(spark, d), asked(spark, d), 30).join(chunks_(spark, d).select("id", "doc_id"), "id")
    return ranking.select_budget(found.withColumn("combined", F.col("score") / 100), 10)


@query()
def replace_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = chunks_(spark, d).select("id", "content")
    found = keyword.bm25(chunks_(spark, d), asked(spark, d), 15).join(docs, "id")
    missing = asked(spark, d).select("query_id", F.slice(F.array_distinct(text.terms("query")), 1, 5).alias("entities"))
    return ranking.replace_chunks(found.where("rank <= 5"), found.where("rank > 5"), missing, 8)


@query()
def random_baseline(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.random_baseline(keyword.bm25(chunks_(spark, d), asked(spark, d), 30).drop("rank"), 42, 3)


def queries() -> dict[str, Q]:
    from gleanery.plans import catalog_more  # noqa: F401  it registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
