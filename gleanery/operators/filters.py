"""Metadata, domain and scope filters."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import domain
from gleanery.operators.common import small


def metadata(date_from: str | None = None, date_to: str | None = None, collection: str | None = None, min_chunks: int | None = None, exclude: list | None = None) -> Column:
    """All conditions given; dates compare as text, and a missing one fails date_from only; a missing count is 0."""
    date = F.coalesce(F.col("ingested_at").cast("string"), F.lit(""))
    parts = [
        date >= date_from if date_from else None,
        date <= date_to if date_to else None,
        F.col("collection") == collection if collection else None,
        F.coalesce("chunk_count", F.lit(0)) >= min_chunks if min_chunks else None,
        ~F.col("id").isin(exclude) if exclude else None,
    ]
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def where_clause(date_from: str | None = None, date_to: str | None = None, collection: str | None = None, min_chunks: int | None = None, exclude: list | None = None) -> tuple[str, dict]:
    """The same as SQL text with named parameters, for spark.sql(text, args=...); no condition gives 1=1."""
    parts, args = [], {}
    for name, value, sql in (
        ("date_from", date_from, "coalesce(cast(ingested_at as string), '') >= :date_from"),
        ("date_to", date_to, "coalesce(cast(ingested_at as string), '') <= :date_to"),
        ("collection", collection, "collection = :collection"),
        ("min_chunks", min_chunks, "coalesce(chunk_count, 0) >= :min_chunks"),
    ):
        if value:
            parts.append(sql)
            args[name] = value
    for i, x in enumerate(exclude or ()):
        parts.append(f"id <> :exclude_{i}")
        args[f"exclude_{i}"] = x
    return " AND ".join(parts) or "1=1", args


def name_like(name: Column, part: str | None, wildcards: bool = False) -> Column:
    """Names with the part in them, whatever the case; with wildcards % and _ in it count."""
    if not part:
        return F.lit(True)
    return name.ilike(f"%{part}%") if wildcards else F.contains(F.lower(name), F.lit(part.lower()))


def whitelisted(pages: DataFrame, whitelist: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose host is an enabled domain or below one.

    The host's own suffixes are joined with the domains by equality, so no
    nested loop over the list.
    """
    labels = F.split(domain(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    enabled = small(whitelist.where("enabled").select("domain").distinct())
    keyed = pages.withColumn("_domain", F.explode(suffixes))
    # Of a host's suffixes several may be listed; the page counts once.
    return keyed.join(enabled.withColumnRenamed("domain", "_domain"), "_domain", "left_semi").drop("_domain").distinct()


def url_in_scope(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Excluded patterns first; then any included one, or all if none are given."""
    out = url.rlike("(?i)(?:" + "|".join(exclude) + ")") if exclude else F.lit(False)
    return ~out & (url.rlike("(?i)(?:" + "|".join(include) + ")") if include else F.lit(True))


def content_in_scope(text: Column, keywords: list[str]) -> Column:
    """Any keyword as a substring, whatever the case; all texts if none are given."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(k.lower())) for k in keywords]) if keywords else F.lit(True)


def unseen(new: DataFrame, known: DataFrame, key: str = "hash") -> DataFrame:
    """New rows whose hash isn't known, each hash once."""
    return new.join(known.select(key), key, "left_anti").dropDuplicates([key])


#: Bytes that a fetched file may have.
MOST_BYTES = 50 << 20


def fetch_status(pages: DataFrame, whitelist: DataFrame, url: str = "url", size: str = "size", most: int = MOST_BYTES) -> DataFrame:
    """pages with status: 'not whitelisted', 'too large', or 'ok'. A refusal is a row, not an error."""
    keep = pages.columns
    listed = whitelisted(pages.select(url).distinct(), whitelist, url).withColumn("_listed", F.lit(True))
    joined = pages.join(listed, url, "left")
    status = F.when(F.col("_listed").isNull(), "not whitelisted").when(F.coalesce(F.col(size), F.lit(0)) > most, "too large").otherwise("ok")
    return joined.select(*keep, status.alias("status"))


# Parts of addresses that a scope leaves out unless told otherwise.
LEFT_OUT = ["/File:", "/Category:", "/Template:", "/User:", "/Talk:", "/Special:", r"\?", "#"]


@dataclass(frozen=True)
class Scope:
    """What a crawl of one subject takes in."""

    name: str
    seeds: list[str]
    include: list[str]
    exclude: list[str] = field(default_factory=lambda: list(LEFT_OUT))
    keywords: list[str] = field(default_factory=list)
    collection: str | None = None

    @property
    def into(self) -> str:
        return self.collection or self.name

    def takes(self, url: Column, text: Column | None = None) -> Column:
        inside = url_in_scope(url, self.include, self.exclude)
        return inside if text is None else inside & content_in_scope(text, self.keywords)
