"""Fusing ranked lists, merging variants, boosting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.common import best, ranked


def rrf(a: DataFrame, b: DataFrame, weights: tuple[float, float] = (0.65, 0.35), k: int = 60, top_k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank), with both ranks. Ties go to the smaller id."""
    both = a.select("query_id", "id", F.col("rank").alias("rank_a")).join(b.select("query_id", "id", F.col("rank").alias("rank_b")), ["query_id", "id"], "full_outer")
    parts = [F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0)) for w, r in zip(weights, ("rank_a", "rank_b"), strict=True)]
    scored = both.withColumn("score", F.round(parts[0] + parts[1], 9))
    return best(scored, top_k) if top_k else ranked(scored, F.desc("score"), F.asc("id"))


def positional(results: DataFrame) -> DataFrame:
    """score becomes 1 / rank."""
    return results.withColumn("score", F.lit(1.0) / F.col("rank"))


def merge_variants(results: DataFrame, top_k: int = 10) -> DataFrame:
    """One row for each id of a query: the best score over the variants, how many had it, and where it came first.

    Needs variant and rank. Of equal scores the earlier variant and rank count.
    """
    place = F.struct("variant", "rank")
    merged = results.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.count("*").alias("match_count"), F.min(place).alias("first"))
    return ranked(merged, F.desc("score"), F.asc("first"), F.asc("id")).where(F.col("rank") <= top_k).drop("first")


def boost_matches(results: DataFrame, each: float = 0.05) -> DataFrame:
    """Raise what several variants found by `each` for every further one, and rank anew."""
    raised = F.round(F.col("score") * (1 + each * (F.greatest(F.col("match_count"), F.lit(1)) - 1)), 9)
    return ranked(results.withColumn("before", F.col("rank")).withColumn("score", raised).drop("rank"), F.desc("score"), F.asc("before"), F.asc("id")).drop("before")


def merge_graph(vector: DataFrame, graph: DataFrame, weight: float = 0.3, top_k: int = 10) -> DataFrame:
    """Vector results by 1 / rank, raised where the graph found them too; what only the graph found has a fixed score."""
    v = vector.select("query_id", "id", F.col("rank").alias("vector_rank"))
    g = graph.select("query_id", "id").distinct().withColumn("from_graph", F.lit(True))
    both = v.join(g, ["query_id", "id"], "full_outer").withColumn("from_graph", F.coalesce("from_graph", F.lit(False)))
    own = (1.0 / F.col("vector_rank")) * (1 - weight) + F.when(F.col("from_graph"), 0.2 * weight).otherwise(0.0)
    return best(both.withColumn("score", F.round(F.when(F.col("vector_rank").isNull(), 0.5 * weight).otherwise(own), 9)), top_k)


def union_first(*branches: DataFrame) -> DataFrame:
    """Rows of the branches one after another, each id of a query where it comes first."""
    tagged = [b.select("query_id", "id", "score", F.col("rank").alias("at"), F.lit(i).alias("branch")) for i, b in enumerate(branches)]
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t)
    seen = Window.partitionBy("query_id", "id").orderBy("branch", "at")
    first = whole.withColumn("n", F.row_number().over(seen)).where("n = 1")
    return ranked(first, F.asc("branch"), F.asc("at"), F.asc("id")).drop("n", "at", "branch")
