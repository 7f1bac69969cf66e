"""Inputs other than tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of files that are text as they are.
TEXT_SUFFIXES = ("md", "txt", "markdown")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content, error): text files as they are; other kinds need a converter and are reported, not dropped."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.element_at(F.split(name, r"\."), -1))
    plain = suffix.isin(*TEXT_SUFFIXES)
    return files.select(
        name.alias("filename"),
        F.when(plain, F.decode("content", "utf-8")).alias("content"),
        F.when(~plain, F.concat(F.lit("no converter for ."), suffix)).alias("error"),
    )


def query_sets(spark: SparkSession, path: str) -> DataFrame:
    """(category, query_id, query, type, difficulty) from a JSON object of arrays by category."""
    raw = spark.read.option("multiLine", True).json(path)
    arrays = [f.name for f in raw.schema if f.dataType.typeName() == "array"]
    parts = [raw.select(F.lit(c).alias("category"), F.explode(c).alias("q")).select("category", F.col("q.id").alias("query_id"), "q.query", "q.type", "q.difficulty") for c in arrays]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ATOM = "entry struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>,category:array<struct<_term:string>>>"


def papers(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Entries of Atom feeds: id, title, summary, published, authors, categories; entries that don't parse are left out."""
    schema = "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").option("mode", "PERMISSIVE").schema(schema).load(path).where("id is not null")
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    out = rows.select(
        F.regexp_extract("id", r"abs/(.+?)(?:v\d+)?$", 1).alias("paper_id"),
        squeeze("title").alias("title"),
        squeeze("summary").alias("summary"),
        F.try_to_timestamp("published").alias("published"),
        F.transform("author", lambda a: a["name"]).alias("authors"),
        F.array_distinct(F.transform("category", lambda c: c["_term"])).alias("categories"),
    )
    return out.where(F.col("published") >= F.lit(since).cast("timestamp")) if since else out


def feed_query(query: str | None, categories: list[str]) -> str:
    """The search expression of the feed: text and any of the categories; artificial intelligence if neither is given."""
    cats = " OR ".join(f"cat:{c}" for c in categories)
    parts = [f'all:"{query}"' if query else "", f"({cats})" if cats else ""]
    return " AND ".join(p for p in parts if p) or "cat:cs.AI"
