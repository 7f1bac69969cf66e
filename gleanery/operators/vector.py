"""Exact vector search over many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import vectors as V
from gleanery.operators.common import best, fits, ranked, small
from gleanery.operators.fusion import rrf


def nearest(vecs: DataFrame, queries: DataFrame, top_k: int = 10, dim: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) by cosine; with dim, over the first dim entries.

    vecs has id and embedding, queries query_id and embedding. The queries are a
    stated set: they are held against all vectors where those lie, a batch at a
    time as one matrix product, and each batch keeps top_k a query. Only a set
    that fits is handed to the tasks so; a larger one is joined. Vectors that are
    null are left out; a null query is like none.
    """
    if not fits(queries):
        return nearest_joined(vecs, queries, top_k, dim)
    asked = queries.select("query_id", "embedding").collect()
    keys = queries.sparkSession.createDataFrame([(i, r.query_id) for i, r in enumerate(asked)], T.StructType([T.StructField("_q", T.IntegerType()), queries.schema["query_id"]]))
    if not asked:
        return nearest_joined(vecs, queries, top_k, dim)
    matrix = stacked([r.embedding for r in asked], dim)
    size = lengths(matrix)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pc.is_valid(batch.column(1)))
            if not kept.num_rows:
                continue
            own = stacked(kept.column(1).to_pylist(), dim, matrix.shape[1])
            both = lengths(own)[:, None] * size
            scores = np.divide(own @ matrix.T, both, out=np.zeros_like(both), where=both > 0)
            order = np.lexsort((np.broadcast_to(np.argsort(np.argsort(kept.column(0).to_numpy(zero_copy_only=False))), scores.T.shape), -np.round(scores.T, 6)), axis=-1)[:, :top_k]
            q = np.repeat(np.arange(len(matrix)), order.shape[1])
            at = order.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), kept.column(0).take(pa.array(at)), pa.array(scores[at, q])], names=["_q", "id", "score"])

    kind = vecs.schema["id"].dataType.simpleString()
    found = vecs.select("id", "embedding").mapInArrow(rows, f"_q int, id {kind}, score double")
    return best(found.join(F.broadcast(keys), "_q").select("query_id", "id", F.round("score", 6).alias("score")), top_k)


def stacked(vectors: list, dim: int | None, size: int | None = None) -> np.ndarray:
    """The first dim entries of each vector as a row; a null one gives zeros, shorter ones are filled up."""
    cut = [(v or [])[:dim] for v in vectors]
    width = size or max(map(len, cut), default=0)
    out = np.zeros((len(cut), width))
    for i, v in enumerate(cut):
        out[i, : len(v)] = v[:width]
    return out


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def nearest_joined(vecs: DataFrame, queries: DataFrame, top_k: int, dim: int | None) -> DataFrame:
    cut = (lambda c: V.truncate(c, dim)) if dim else (lambda c: c)
    q = queries.select("query_id", cut(F.col("embedding")).alias("q"))
    pairs = vecs.where("embedding is not null").select("id", cut(F.col("embedding")).alias("v")).join(q, F.lit(True), "cross")
    return best(pairs.select("query_id", "id", F.round(V.cosine(F.col("q"), F.col("v")), 6).alias("score")), top_k)


def rerank(candidates: DataFrame, vecs: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """The candidates (query_id, id) of each query by cosine."""
    joined = candidates.select("query_id", "id").join(vecs.select("id", "embedding"), "id")
    joined = joined.join(small(queries.select("query_id", F.col("embedding").alias("q"))), "query_id")
    return best(joined.select("query_id", "id", F.round(V.cosine(F.col("q"), F.col("embedding")), 6).alias("score")), top_k)


def two_phase(candidates: DataFrame, vecs: DataFrame, queries: DataFrame, top_k: int = 10, fusion: str = "rrf") -> DataFrame:
    """Keyword candidates (query_id, id, rank) and their vectors: ranked by cosine alone, or both ranks fused with equal weights.

    A candidate without a vector has likeness 0. No candidates, no rows.
    """
    if fusion not in ("rrf", "rerank"):
        raise ValueError(f"unknown fusion: {fusion}")
    joined = candidates.select("query_id", "id").join(vecs.select("id", "embedding"), "id", "left")
    joined = joined.join(small(queries.select("query_id", F.col("embedding").alias("q"))), "query_id", "left")
    near = joined.select("query_id", "id", F.round(F.coalesce(V.cosine(F.col("q"), F.col("embedding")), F.lit(0.0)), 6).alias("score"))
    if fusion == "rerank":
        return best(near, top_k)
    return rrf(candidates, ranked(near, F.desc("score"), F.asc("id")), (1.0, 1.0), top_k=top_k)


def hybrid_rank(semantic: DataFrame, entity: DataFrame, weight: float = 0.5, top_k: int = 10) -> DataFrame:
    """weight times the semantic score, the rest of the entity score; a missing one counts as 0."""
    both = semantic.select("query_id", "id", F.col("score").alias("semantic")).join(entity.select("query_id", "id", F.col("score").alias("entity")), ["query_id", "id"], "full_outer")
    mixed = F.coalesce("semantic", F.lit(0.0)) * weight + F.coalesce("entity", F.lit(0.0)) * (1 - weight)
    return best(both.select("query_id", "id", F.round(mixed, 9).alias("score")), top_k)


def semantic_or_words(near: DataFrame, words: DataFrame) -> DataFrame:
    """Results by vector for queries that have some, by shared words for the others."""
    return near.unionByName(words.join(near.select("query_id").distinct(), "query_id", "left_anti"), allowMissingColumns=True)


def mean_vector(rows: DataFrame, by: str = "query_id", name: str = "embedding") -> DataFrame:
    """The mean vector of each group, entry by entry; partial sums, so a group needn't be gathered."""
    flat = rows.select(by, F.posexplode(name).alias("at", "x")).groupBy(by, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return flat.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias(name))
