"""Coverage gaps, confidence, claims and contradictions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.models import Generate, asked_list
from gleanery.functions.text import n_words
from gleanery.session import cut


def gathered(results: DataFrame) -> DataFrame:
    """(query_id, content): all texts of a query's results in order, lower-cased. Results are bounded by top_k."""
    parts = F.array_sort(F.collect_list(F.struct("rank", "content")))
    return results.groupBy("query_id").agg(F.lower(F.array_join(F.transform(parts, lambda r: r["content"]), " ")).alias("content"))


def gaps(queries: DataFrame, results: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row a query: missing_entities, unanswered, coverage, suggestions, should_iterate.

    queries has query_id, query, kind and entities.
    """
    q = queries.select("query_id", "query", "kind", "entities").join(gathered(results), "query_id", "left").withColumn("content", F.coalesce("content", F.lit("")))
    text, low, kind, entities = F.col("content"), F.lower("query"), F.col("kind"), F.col("entities")

    def has(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])

    # Question shapes, the words that answer them, and what is said of those left open.
    shapes = [
        ("how does (.+) (?:address|solve|improve)", "mechanism/approach"),
        ("what (?:role|part) does (.+) play", "role/contribution"),
        ("what evidence .+ for (.+)", "supporting evidence"),
    ]
    aspects = [F.when((kind == "comparative") & ~has("difference", "similar", "better", "worse", "compared", "vs"), "comparison between entities")]
    aspects += [F.when((kind == "multi_hop") & low.rlike(shape) & ~has(*aspect.split("/")), f"explanation of {aspect}") for shape, aspect in shapes]
    aspects += [F.when((kind == "exploratory") & (F.char_length(text) < 500), "broader coverage of topic")]
    missing = F.filter(entities, lambda e: ~F.contains(text, F.lower(e)))
    q = q.withColumn("missing_entities", missing).withColumn("unanswered", F.array_compact(F.array(*aspects)))
    covered = F.when(F.size(entities) > 0, 1 - F.size("missing_entities") / F.size(entities)).otherwise(1.0)
    coverage = F.round(covered * 0.6 + F.greatest(F.lit(0.0), 1 - F.size("unanswered") * 0.2) * 0.4, 6)
    two = F.slice("missing_entities", 1, 2)
    middle = F.array_join(F.slice(F.split("query", " "), 3, 3), " ")

    # What is asked for an open aspect.
    def ask(aspect: Column) -> Column:
        return (
            F.when(F.contains(aspect, F.lit("comparison")), F.concat(F.lit("differences "), F.array_join(two, " ")))
            .when(aspect.rlike("mechanism|approach"), F.concat(F.lit("how "), middle, F.lit(" works")))
            .when(F.contains(aspect, F.lit("evidence")), F.concat(F.lit("results "), F.array_join(F.slice("missing_entities", 1, 1), " ")))
            .otherwise(F.col("query"))
        )

    asked = F.concat(F.transform(two, lambda e: F.concat(F.lit("What is "), e, F.lit("?"))), F.transform(F.slice("unanswered", 1, 2), ask))
    overview = F.when((n_words("query") > 5) & (F.size(entities) > 0), F.array(F.concat(F.get(entities, F.lit(0)), F.lit(" overview")))).otherwise(F.array().cast("array<string>"))
    q = q.withColumn("coverage", coverage).withColumn("suggestions", F.when(F.size(asked) > 0, asked).otherwise(overview))
    iterate = (F.col("coverage") < threshold) | (F.size("missing_entities") > 0) | (kind.isin("multi_hop", "comparative") & (F.size("unanswered") > 0))
    return q.withColumn("should_iterate", iterate).drop("content")


def goes_on(iteration: int, most: int, threshold: float = 0.7, gain: float = 0.05) -> Column:
    """Whether a query iterates again: coverage low but rising by `gain`, with something to ask."""
    rising = F.col("coverage") - F.col("previous") >= gain
    return F.lit(iteration < most) & (F.col("coverage") < threshold) & rising & F.col("should_iterate") & (F.size("suggestions") > 0)


def confidence(results: DataFrame, queries: DataFrame) -> DataFrame:
    """One row a query with results: overall confidence, its four parts and an explanation.

    Scores: 0.6 of their mean and 0.4 of their evenness. Entities found in the
    texts. Agreement: mean Jaccard likeness of the capitalised terms of each two
    results; their number is bounded by top_k. Diversity: documents against the
    best possible, at most five.
    """
    caps = F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(r"\b[A-Z][a-z]+(?:-[A-Z][a-z]+)*\b"), F.lit(0)), F.lower))
    r = results.withColumn("terms", caps)
    stats = r.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread"), F.count_distinct("doc_id").alias("docs"))
    a, b = (r.where(F.size("terms") > 0).select("query_id", F.col("rank").alias(f"{x}_rank"), F.col("terms").alias(f"{x}_terms")) for x in "ab")
    alike = F.size(F.array_intersect("a_terms", "b_terms")) / F.size(F.array_union("a_terms", "b_terms"))
    agreement = a.join(b, "query_id").where("a_rank < b_rank").groupBy("query_id").agg(F.avg(alike).alias("agreement"))
    text = gathered(results)
    all_ = stats.join(agreement, "query_id", "left").join(text, "query_id").join(queries.select("query_id", "entities"), "query_id", "left")
    found = F.size(F.filter("entities", lambda e: F.contains(F.col("content"), F.lower(e))))
    n = F.col("n")
    out = all_.select(
        "query_id",
        "n",
        F.round(F.when(n < 2, 0.5).otherwise(F.col("mean") * 0.6 + (1 - F.least(F.col("spread") * 2, F.lit(1.0))) * 0.4), 6).alias("score_distribution"),
        F.round(F.when(F.coalesce(F.size("entities"), F.lit(0)) <= 0, 0.7).otherwise(found / F.size("entities")), 6).alias("entity_coverage"),
        F.round(F.when(n < 2, 0.5).otherwise(F.coalesce("agreement", F.lit(0.5))), 6).alias("source_agreement"),
        F.round(F.when(n < 2, 0.3).otherwise(F.least(F.lit(1.0), F.col("docs") / F.least(n, F.lit(5)))), 6).alias("source_diversity"),
    )
    overall = F.col("score_distribution") * 0.2 + F.col("entity_coverage") * 0.3 + F.col("source_agreement") * 0.3 + F.col("source_diversity") * 0.2
    return out.withColumn("overall", F.round(overall, 8)).withColumn("explanation", explanation())


def explanation() -> Column:
    # What is said above and below which value of each part.
    said = [
        ("score_distribution", 0.7, "results have high relevance scores", 0.3, "results have low relevance scores"),
        ("entity_coverage", 0.8, "covers all query entities", 0.5, "missing some query entities"),
        ("source_agreement", 0.7, "sources agree on key points", 0.3, "sources have limited agreement"),
        ("source_diversity", 0.7, "information from diverse sources", 0.3, "limited source diversity"),
    ]
    parts = F.concat_ws("; ", *[F.when(F.col(c) > high, above).when(F.col(c) < low, below) for c, high, above, low, below in said])
    start = F.concat(F.lit("Based on "), F.col("n").cast("string"), F.lit(" results"))
    return F.when(parts == "", start).otherwise(F.concat_ws(": ", start, parts))


# Patterns of claims, with the characters of context on each side, the confidence, and whether the first group is the subject.
WORD = r"(\w+(?:-\w+)?)"
CLAIMS = [
    ("statistic", 50, 0.9, [
        r"(?:achieves?|reaches?|obtains?|gets?)\s+(\d+(?:\.\d+)?%?\s*(?:accuracy|precision|recall|F1|score))",
        r"(\d+(?:\.\d+)?%)\s+(?:accuracy|precision|recall|improvement)",
        r"(?:improves? by|increases? by|reduces? by)\s+(\d+(?:\.\d+)?%?)",
    ]),
    ("comparison", 30, 0.8, [
        WORD + r"\s+(?:outperforms?|beats?|exceeds?)\s+" + WORD,
        WORD + r"\s+is\s+(?:better|worse|faster|slower)\s+than\s+" + WORD,
        WORD + r"\s+(?:achieves?|has)\s+(?:higher|lower)\s+.*?\s+than\s+" + WORD,
    ]),
    ("methodology", 20, 0.7, [
        r"(?:uses?|employs?|applies?|implements?)\s+([\w\s-]+(?:method|approach|technique|algorithm))",
        r"(?:based on|built on|extends?)\s+([\w\s-]+)",
    ]),
]
SUBJECTS = [re.compile(r"(\b[A-Z][\w-]+(?:-[A-Z][\w]+)?)\b"), re.compile(r"\b([A-Z]{2,})\b")]
COMPILED = [(kind, around, sure, re.compile(p, re.I)) for kind, around, sure, ps in CLAIMS for p in ps]


def subject_before(text: str, at: int) -> str | None:
    """The last name in the 100 characters before, of the first pattern that has one."""
    before = text[max(0, at - 100) : at]
    return next((found[-1] for p in SUBJECTS if (found := p.findall(before))), None)


def claims_in(text: str) -> Iterator[tuple[str, str, str | None, float]]:
    """(text with context, type, subject, confidence) of every claim."""
    for kind, around, sure, pattern in COMPILED:
        for m in pattern.finditer(text):
            subject = subject_before(text, m.start()) if kind == "statistic" else m.group(1)
            yield text[max(0, m.start() - around) : m.end() + around].strip(), kind, subject, sure


def claims(chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """(chunk_id, source, pos, text, claim_type, subject, confidence) for the chunks' claims. Offsets of matches need Python."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(r.id, r.source, i, *c) for r in frame.itertuples() for i, c in enumerate(claims_in(r.content or "")) if c[3] >= least]
            yield pd.DataFrame(out, columns=["chunk_id", "source", "pos", "text", "claim_type", "subject", "confidence"])

    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}
    return chunks.select("id", "source", "content").mapInPandas(rows, f"chunk_id {kinds['id']}, source string, pos int, text string, claim_type string, subject string, confidence double")


REVERSIBLE = r"(?i)" + WORD + r"\s+(?:outperforms?|beats?|exceeds?|is better than)\s+" + WORD
NUMBER = r"\d+(?:\.\d+)?%?"


def contradictions(claim_rows: DataFrame) -> DataFrame:
    """Pairs of claims of different chunks that can't both hold.

    Statistics of one subject with different first numbers, and comparisons of
    which one reverses the other. Both are equi-joins: on the subject, and on the
    pair of names turned round.
    """
    c = claim_rows.select("chunk_id", "pos", "text", "claim_type", F.lower("subject").alias("key"), F.regexp_extract("text", NUMBER, 0).alias("number"), *[F.lower(F.regexp_extract("text", REVERSIBLE, g)).alias(n) for g, n in ((1, "better"), (2, "worse"))])
    side = lambda df, x: df.select(*[F.col(n).alias(f"{n}_{x}") for n in ("chunk_id", "pos", "text", "key", "number", "better", "worse")])
    first = F.struct("chunk_id_a", "pos_a") < F.struct("chunk_id_b", "pos_b")
    apart = first & (F.col("chunk_id_a") != F.col("chunk_id_b"))
    stats = c.where("claim_type = 'statistic' and key is not null and number <> ''")
    s = side(stats, "a").join(side(stats, "b"), F.col("key_a") == F.col("key_b")).where(apart & (F.col("number_a") != F.col("number_b")))
    comps = c.where("claim_type = 'comparison' and better <> ''")
    r = side(comps, "a").join(side(comps, "b"), (F.col("better_a") == F.col("worse_b")) & (F.col("worse_a") == F.col("better_b"))).where(apart)
    out = ["chunk_id_a", "pos_a", "chunk_id_b", "pos_b"]
    why = F.concat(F.lit("Conflicting statistics for "), F.col("key_a"), F.lit(": "), F.col("number_a"), F.lit(" vs "), F.col("number_b"))
    kinds = [F.lit("factual").alias("conflict_type"), F.lit("high").alias("severity")]
    return s.select(*out, *kinds, F.lit(0.9).alias("confidence"), why.alias("explanation")).unionByName(r.select(*out, *kinds, F.lit(0.85).alias("confidence"), F.lit("Reversed comparison claims").alias("explanation")))


def contradictions_by_query(results: DataFrame) -> DataFrame:
    """(query_id, chunk_id_a, chunk_id_b, claim_a, claim_b, ...): contradictions among the results of each query with two or more.

    Claims are looked for once in each different chunk, and pairs once in all;
    a query has those whose chunks are both among its results.
    """
    several = results.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).where("n > 1")
    chunks = several.select("id", F.col("doc_id").cast("string").alias("source"), "content").dropDuplicates(["id"])
    found = cut(claims(chunks))
    told = found.select("chunk_id", "pos", F.col("text").alias("claim"), "source")
    side = lambda x: told.select(*[F.col(c).alias(f"{c}_{x}") for c in told.columns])
    pairs = contradictions(found).join(side("a"), ["chunk_id_a", "pos_a"]).join(side("b"), ["chunk_id_b", "pos_b"])
    own = lambda x: several.select("query_id", F.col("id").alias(f"chunk_id_{x}"))
    return pairs.join(own("a"), "chunk_id_a").join(own("b"), ["query_id", "chunk_id_b"])


# Fixed value: what is said beside conflicting claims.
WARNING = "Retrieved information contains conflicting claims. Please verify with primary sources."


def surfaced(pairs: DataFrame, strategy: str = "surface", longest: int = 200) -> DataFrame:
    """(query_id, count, strategy, details, warning) for queries with contradictions; claims are cut to 200 characters."""
    detail = F.struct(
        F.substring("claim_a", 1, longest).alias("claim_a"), "source_a", F.substring("claim_b", 1, longest).alias("claim_b"), "source_b", "conflict_type", "severity", "explanation"
    )
    rows = pairs.groupBy("query_id").agg(F.count("*").alias("count"), F.sort_array(F.collect_list(detail)).alias("details"))
    return rows.select("query_id", "count", F.lit(strategy).alias("strategy"), "details", F.lit(WARNING).alias("warning"))


def gaps_with(generate: Generate, queries: DataFrame, results: DataFrame) -> DataFrame:
    """gaps(), with suggestions from a language model where it gives a list."""
    found = gaps(queries, results)
    prompt = F.concat(F.lit("Which questions does this query leave open? Answer with a JSON list.\n"), "query", F.lit("\nMissing: "), F.array_join("missing_entities", ", "))
    return found.withColumn("suggestions", asked_list(generate, prompt, F.col("suggestions")))


__all__ = ["claims", "claims_in", "confidence", "contradictions", "contradictions_by_query", "gaps", "gaps_with", "gathered", "goes_on", "surfaced"]
