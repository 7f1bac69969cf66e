"""Measuring an engine on query sets and on questions with known documents."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.understanding import question_names
from gleanery.operators import evaluate, ranking
from gleanery.operators.common import ranked
from gleanery.plans.search import Engine


def timed(make: Callable[[], DataFrame]) -> tuple[float, int]:
    """Seconds and rows of a query, run to its end without keeping anything."""
    began = time.perf_counter()
    rows = make().count()
    return time.perf_counter() - began, rows


def query_set(engine: Engine, queries: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metric rows, roll-up by category) of a query set.

    queries: query_id, query, category. wanted: query_id, what ('entity',
    'concept' or 'fact') and wanted.
    """
    results = engine.search(queries).select("query_id", "id", "score", "rank", "content")
    of = lambda what: wanted.where(F.col("what") == what).select("query_id", "wanted")
    rows = evaluate.metric_rows(results, of("entity"), of("concept"), of("fact")).join(queries.select("query_id", "category"), "query_id")
    return rows, evaluate.roll_up(rows, "category", "avg_retrieval_score")


def by_names(questions: DataFrame, top_k: int = 3, runs: bool = False) -> DataFrame:
    """(query_id, n_retrieved, ..., f1) of ranking each question's own documents by what the question names; the first ones if it names nothing.

    questions: id, question, supporting_facts, context, as in evaluate.
    """
    told = evaluate.context_documents(questions).withColumnRenamed("id", "query_id")
    names = questions.select(F.col("id").alias("query_id"), question_names(F.col("question"), runs).alias("entities"))
    rows = told.select("query_id", F.col("title").alias("id"), "content", (F.col("pos") + 1).alias("rank")).join(names, "query_id")
    found = ranking.by_entities(rows.where(F.size("entities") > 0), top_k=top_k).select("query_id", "id")
    plain = ranked(rows.where(F.size("entities") == 0).drop("rank"), F.asc("id")).where(F.col("rank") <= top_k).select("query_id", "id")
    gold = told.where("gold").select("query_id", F.col("title").alias("id"))
    return evaluate.precision_recall(found.unionByName(plain), gold)
