"""Keyword search over many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import n_terms, terms
from gleanery.operators.common import best, fits, small


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), each term once."""
    return queries.select("query_id", F.explode(F.array_distinct(terms("query"))).alias("term"))


def postings(docs: DataFrame) -> DataFrame:
    """The inverted index: (id, term, tf, n_terms); a document without terms has one row, with a null term."""
    tokens = docs.select("id", terms("content").alias("t"))
    split = tokens.select("id", F.size("t").alias("n_terms"), F.explode_outer("t").alias("term"))
    return split.groupBy("id", "n_terms", "term").agg(F.count("*").alias("tf")).select("id", "term", "tf", "n_terms")


def bm25(docs: DataFrame, queries: DataFrame, top_k: int = 30, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank) by Okapi BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    Only terms that some query has leave the scan; documents and mean length
    come from one aggregate without a shuffle of texts. Blank queries have no
    rows. Ties go to the smaller id.
    """
    asked = query_terms(queries)
    wanted = small(asked.select("term").distinct())
    tokens = docs.select("id", terms("content").alias("t"))
    totals = docs.agg(F.count("*").alias("n_docs"), F.avg(n_terms("content")).alias("mean_terms"))
    own = tokens.select("id", F.size("t").alias("n_terms"), F.explode("t").alias("term")).join(wanted, "term", "left_semi")
    tf = own.groupBy("id", "n_terms", "term").agg(F.count("*").alias("tf"))
    return okapi(tf, totals, asked, top_k, k1, b)


def bm25_indexed(index: DataFrame, queries: DataFrame, top_k: int = 30, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The same from a stored index (id, term, tf, n_terms): no text is read. A document without terms must have a row with a null term."""
    asked = query_terms(queries)
    sizes = index.select("id", "n_terms").distinct()
    totals = sizes.agg(F.count("*").alias("n_docs"), F.avg("n_terms").alias("mean_terms"))
    tf = index.join(small(asked.select("term").distinct()), "term", "left_semi").select("id", "n_terms", "term", "tf")
    return okapi(tf, totals, asked, top_k, k1, b)


def okapi(tf: DataFrame, totals: DataFrame, asked: DataFrame, top_k: int, k1: float, b: float) -> DataFrame:
    # One row for each different term of a query at most: where these fit, postings of a common term needn't meet its count in one task.
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # The totals are one row.
    scored = tf.join(F.broadcast(df) if fits(asked) else df, "term").crossJoin(F.broadcast(totals))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / F.col("mean_terms")))
    summed = scored.select("term", "id", part.alias("part")).join(small(asked), "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    return best(summed, top_k)


def overlap(docs: DataFrame, queries: DataFrame, top_k: int = 50, matched: bool = False) -> DataFrame:
    """(query_id, id, score, rank): share of the query's terms that the document has; documents without any are left out.

    With matched, also the terms that both have, sorted: as many as the query has at most.
    """
    asked = query_terms(queries)
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("asked"))
    have = docs.select("id", F.explode(F.array_distinct(terms("content"))).alias("term"))
    found = [F.sort_array(F.collect_list("term")).alias("matched")] if matched else []
    hits = have.join(small(asked), "term").groupBy("query_id", "id").agg(F.count("*").alias("hits"), *found)
    share = F.round(F.col("hits") / F.col("asked"), 6).alias("score")
    return best(hits.join(small(sizes), "query_id").select("query_id", "id", share, *["matched"] * matched), top_k)
