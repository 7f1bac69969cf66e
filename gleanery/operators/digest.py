"""Digests of recent documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import strip


def recent(docs: DataFrame, now: str, hours: int = 24, collection: str | None = None) -> DataFrame:
    """Documents of the last hours, newest first."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours))
    rows = docs.where(F.col("ingested_at").cast("timestamp") >= since)
    return (rows.where(F.col("collection") == collection) if collection else rows).orderBy(F.desc("ingested_at"), "id")


def title(markdown: Column, name: Column) -> Column:
    """The first heading, or else the file name."""
    found = F.regexp_extract(markdown, r"(?m)^# (.*)$", 1)
    return F.when(found != "", F.trim(found)).otherwise(name)


def abstract(markdown: Column, most: int = 500) -> Column:
    """What follows a heading Abstract, up to the next heading; else the start."""
    found = F.regexp_extract(markdown, r"(?is)(?:^|\n)#*\s*abstract\s*\n(.*?)(?:\n#|$)", 1)
    return F.substring(strip(F.when(found != "", found).otherwise(markdown)), 1, most)


def markdown(papers: DataFrame, heading: str, most: int = 100) -> DataFrame:
    """One row: the digest of (title, summary, url) rows as markdown. At most `most` entries, as a report has."""
    few = papers.orderBy("title").limit(most)
    entry = F.concat(F.lit("## "), "title", F.lit("\n\n"), F.coalesce("summary", F.lit("")), F.lit("\n\n"), F.coalesce("url", F.lit("")))
    joined = F.array_join(F.array_sort(F.collect_list(entry)), "\n\n")
    return few.agg(F.concat(F.lit(f"# {heading}\n\n"), joined).alias("digest"), F.count("*").alias("n"))


def message(papers: DataFrame, heading: str, most: int = 5, longest: int = 2000) -> DataFrame:
    """One row: a chat message of the first papers, cut to the length such messages may have."""
    few = papers.orderBy("title").limit(most)
    joined = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "title"))), "\n")
    return few.agg(F.substring(F.concat(F.lit(f"{heading}\n"), joined), 1, longest).alias("message"))


def escaped(c: Column | str) -> Column:
    return reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), F.col(c) if isinstance(c, str) else c)


def html(papers: DataFrame, heading: str, most: int = 100) -> DataFrame:
    """One row: the digest of (title, summary, url) rows as a page. At most `most` entries, as a report has."""
    url = escaped(F.coalesce("url", F.lit("#")))
    said = F.coalesce("summary", F.lit("No summary available."))
    entry = F.concat(F.lit('<div class="paper"><h2>'), escaped("title"), F.lit('</h2><a href="'), url, F.lit('">'), url, F.lit("</a><p>"), escaped(said), F.lit("</p></div>"))
    joined = F.array_join(F.array_sort(F.collect_list(entry)), "\n")
    body = F.when(F.count("*") > 0, joined).otherwise("<p>No new papers in this period.</p>")
    page = F.concat(F.lit(f"<!DOCTYPE html>\n<html><body><h1>{heading}</h1>\n"), body, F.lit("\n</body></html>"))
    return papers.orderBy("title").limit(most).agg(page.alias("digest"), F.count("*").alias("n"))


def blocks(results: DataFrame, name: str = "filename") -> DataFrame:
    """(query_id, text): the results of each query as numbered blocks, in order; as many as its top_k."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce(F.col(name), F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n---\n\n").alias("text"))


def blocks_or_nothing(queries: DataFrame, results: DataFrame, name: str = "filename") -> DataFrame:
    """blocks() for every query; those without results say so."""
    return queries.select("query_id").distinct().join(blocks(results, name), "query_id", "left").select("query_id", F.coalesce("text", F.lit("No results found.")).alias("text"))
