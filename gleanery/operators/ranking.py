"""Re-ranking results: diversity, recency, entities, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import approx_tokens
from gleanery.operators.common import ranked

# Fixed value: days that a result without a date counts as old.
OLD_DAYS = 365 * 5


def diversify(results: DataFrame, top_k: int = 10, per_doc: int = 2, strict: bool = False) -> DataFrame:
    """At most per_doc of a document first; unless strict, the others follow to fill up. rank becomes the new one."""
    of_doc = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))
    counted = results.withColumn("over", (of_doc > per_doc).cast("int")).withColumnRenamed("rank", "before")
    counted = counted.where("over = 0") if strict else counted
    return ranked(counted, F.asc("over"), F.asc("before")).where(F.col("rank") <= max(0, top_k)).drop("over", "before")


def recency(results: DataFrame, date: str, now: str, decay: float = 0.03, weight: float = 0.15) -> DataFrame:
    """score * (1 + weight * exp(-decay * age in months)), by whole days; without a date as five years old."""
    age = F.floor((F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(F.col(date).cast("timestamp"))) / 86_400_000_000)
    boost = F.exp(-decay * F.coalesce(age, F.lit(OLD_DAYS)) / 30.0)
    raised = results.withColumn("recency_boost", F.round(boost, 9)).withColumn("score", F.round(F.col("score") * (1 + weight * boost), 9)).withColumnRenamed("rank", "before")
    return ranked(raised, F.desc("score"), F.asc("before")).drop("before")


def entity_coverage(content: Column, entities: Column) -> Column:
    """Share of the entities that the text has as substrings, to two digits, half to even; 0 without entities."""
    found = F.filter(entities, lambda e: F.contains(F.lower(content), F.lower(e)))
    return F.when(F.size(entities) > 0, F.bround(F.size(found) / F.size(entities), 2)).otherwise(0.0)


def position_bonus(content: Column, entities: Column) -> Column:
    """Up to 0.1 for an entity at the very start."""
    low = F.lower(content)
    places = F.filter(F.transform(entities, lambda e: F.position(F.lower(e), low)), lambda p: p > 0)
    nearest = F.array_min(places)
    return F.coalesce(0.1 * (1 - (nearest - 1) / F.char_length(content)), F.lit(0.0))


def by_entities(results: DataFrame, content: str = "content", entities: str = "entities", top_k: int = 10) -> DataFrame:
    """Rank by coverage of the query's entities, then by how early they come."""
    c, e = F.col(content), F.col(entities)
    scored = results.withColumn("coverage", entity_coverage(c, e)).withColumn("entity_score", F.round(F.col("coverage") + position_bonus(c, e), 9)).withColumnRenamed("rank", "before")
    return ranked(scored, F.desc("entity_score"), F.asc("before")).where(F.col("rank") <= top_k).drop("before")


def entity_breakdown(content: Column, missing: Column, every: Column) -> Column:
    """struct: coverage of the missing entities and which of them the text has, of all the query's, and whether the text fills a gap."""
    has = lambda names: F.filter(names, lambda e: F.contains(F.lower(content), F.lower(e)))
    return F.struct(
        entity_coverage(content, missing).alias("missing_coverage"),
        has(missing).alias("found_missing"),
        (F.size(has(missing)) > 0).alias("is_valuable"),
        F.when(F.size(every) > 0, entity_coverage(content, every)).alias("total_coverage"),
        has(every).alias("found_all"),
    )


def within_budget(rows: DataFrame, by: str, text: str, score: str, at: str, target: int, least: int = 3) -> DataFrame:
    """Texts by score until the tokens exceed the target, but `least` of them at any rate; at restores the order."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(at))
    counted = rows.withColumn("tokens", approx_tokens(F.col(text)))
    counted = counted.withColumn("place", F.row_number().over(order)).withColumn("total", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.where((F.col("total") <= target) | (F.col("place") <= least)).drop("place")


def select_budget(rows: DataFrame, budget: int = 10, penalty: float = 0.1) -> DataFrame:
    """Best scores first; a document's further chunks count less, and weak ones only fill half the budget.

    Needs query_id, id, doc_id, combined. What is taken depends on what was, so
    each query's candidates, a few dozen, are folded in one group.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        seen: dict = {}
        taken = []
        for i, row in enumerate(frame.sort_values(["combined", "id"], ascending=[False, True], kind="stable").itertuples()):
            if len(taken) >= budget:
                break
            if row.combined * (1 - penalty * seen.get(row.doc_id, 0)) > 0.1 or len(taken) < budget // 2:
                taken.append((row.query_id, row.id, row.doc_id, row.combined, len(taken) + 1))
                seen[row.doc_id] = seen.get(row.doc_id, 0) + 1
        return pd.DataFrame(taken, columns=["query_id", "id", "doc_id", "combined", "rank"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, doc_id {kinds['doc_id']}, combined double, rank int"
    return rows.select("query_id", "id", "doc_id", "combined").groupBy("query_id").applyInPandas(fold, schema)


def covered(content: str, entities: list[str]) -> set[str]:
    low = content.lower()
    return {e.lower() for e in entities if e.lower() in low}


def replace_within(current: list[tuple], new: list[tuple], missing: list[str], budget: int, threshold: float = 0.1) -> tuple[list[tuple], list[str]]:
    """Fill the budget with the new chunks that cover most, then swap the worst for better ones.

    Chunks are (id, content). Returns the chunks and what is still missing.
    """
    score = lambda c: round(len(covered(c[1], missing)) / len(missing), 2) if missing else 0.0
    chosen = [*current, *sorted(new, key=lambda c: -score(c))[: max(0, budget - len(current))]]
    rest = sorted((c for c in new if c not in chosen), key=lambda c: -score(c))
    worst = sorted(range(len(chosen)), key=lambda i: score(chosen[i]))
    for i in worst if missing else ():
        better = next((c for c in rest if score(c) - score(chosen[i]) > threshold), None)
        if better is not None:
            rest.remove(better)
            chosen[i] = better
    chosen = chosen[:budget]
    found = set().union(*(covered(c[1], missing) for c in chosen)) if chosen else set()
    return chosen, [e for e in missing if e.lower() not in found]


def replace_chunks(current: DataFrame, new: DataFrame, missing: DataFrame, budget: int = 10) -> DataFrame:
    """replace_within for every query: (query_id, id, rank, still_missing).

    current and new have query_id, id, content, rank; missing has query_id and
    entities. A query's chunks number a few times the budget, and are folded in
    one group.
    """
    rows = current.select("query_id", "id", "content", "rank", F.lit(0).alias("is_new")).unionByName(new.select("query_id", "id", "content", "rank", F.lit(1).alias("is_new")))
    rows = rows.join(missing.select("query_id", "entities"), "query_id")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["is_new", "rank"])
        old, fresh = ([(r.id, r.content) for r in frame[frame.is_new == k].itertuples()] for k in (0, 1))
        chosen, left = replace_within(old, fresh, list(frame.entities.iloc[0]), budget)
        return pd.DataFrame({"query_id": frame.query_id.iloc[0], "id": [c[0] for c in chosen], "rank": range(1, len(chosen) + 1), "still_missing": [left] * len(chosen)})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("query_id").applyInPandas(fold, f"query_id {kinds['query_id']}, id {kinds['id']}, rank int, still_missing array<string>")
