"""Ranking helpers shared by the operators. Results are (query_id, id, score, rank) and what else they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a query side that may be broadcast; a larger one is joined by shuffling.
BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame) -> bool:
    """Whether the optimizer's estimate of df's size is within what may be broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it fits."""
    return F.broadcast(df) if fits(df) else df


def ranked(df: DataFrame, *order: Column, by: str = "query_id", name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def best(df: DataFrame, top_k: int, score: str = "score") -> DataFrame:
    """The top_k of each query, ties to the smaller id; Spark cuts the groups before the shuffle."""
    return ranked(df, F.desc(score), F.asc("id")).where(F.col("rank") <= top_k)
