"""Text functions over columns; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """Runs of characters other than white space; none for null."""
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))


def terms(c: Column | str) -> Column:
    """Lower-cased ASCII letter and digit runs, for keyword search."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def n_terms(c: Column | str) -> Column:
    return F.regexp_count(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9]+"))


def n_words(c: Column | str) -> Column:
    return F.size(words(c))


def approx_tokens(c: Column | str) -> Column:
    """Words times 1.3, rounded down."""
    return F.floor(n_words(c) * F.lit(13) / F.lit(10)).cast("int")


# The rewrites of clean_text, applied in this order.
CLEANING = [
    (r"(?m)^\s*\d+\s*$", ""),
    (r"Page \d+ of \d+", ""),
    (r"(?i)©.*?\d{4}.*?(?:rights reserved)?", ""),
    (r"(?i)Copyright.*?\d{4}", ""),
    (r"\n{3,}", "\n\n"),
    (r"[ \t]+", " "),
    (r"(?U)(\w+)-\n(\w+)", "$1$2"),
    ("[“”„]", '"'),
    ("[‘’‚]", "'"),
    (r"\x0c", "\n"),
    (r"[\x00-\x08\x0b\x0e-\x1f]", ""),
]
TRIM = r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$"


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), TRIM, "")


def clean_text(c: Column | str) -> Column:
    """Drop page numbers and notices, join broken words, straighten quotes, trim every line."""
    done = reduce(lambda t, step: F.regexp_replace(t, step[0], step[1]), CLEANING, col(c))
    return strip(F.array_join(F.transform(F.split(done, "\n"), strip), "\n"))


def sentences(c: Column | str) -> Column:
    """array<string>: split after . ! or ?, but not after common abbreviations."""
    guarded = F.regexp_replace(col(c), r"\b(Dr|Mr|Mrs|Ms|Prof|etc|vs|e\.g|i\.e)\.\s", "$1<DOT> ")
    parts = F.transform(F.split(guarded, r"(?<=[.!?])\s+"), lambda s: strip(F.replace(s, F.lit("<DOT>"), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def normalize_answer(c: Column | str) -> Column:
    """Lower case without punctuation and articles, single spaces."""
    plain = F.regexp_replace(F.lower(col(c)), r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(a|an|the)\b", " "), r"\s+", " "))


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def safe_name(c: Column | str) -> Column:
    return F.substring(F.regexp_replace(col(c), r"(?U)[^\w\s-]", ""), 1, 50)


def domain(url: Column | str) -> Column:
    """The host, with its port, in lower case."""
    return F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def without_fragment(url: Column | str) -> Column:
    return F.split_part(col(url), F.lit("#"), F.lit(1))


def wiki_title(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s*[-–|].*[Ww]iki.*$", ""))


def word_windows(c: Column | str, size: int, step: int) -> Column:
    """array<struct<start,text>>: windows of `size` words every `step`; the last may be shorter."""

    def windows(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice(w, s + 1, F.lit(size)), " ").alias("text")))

    # As a variable the words are found once, not once for each window.
    return F.flatten(F.transform(F.array(words(c)), windows))
