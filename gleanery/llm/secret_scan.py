"""Secret scans: patterns, and character Markov models of random strings (native: DataFrame functions only).

Two first-order models over the candidates' characters, one of random strings
and one of ordinary identifiers, are learnt from labelled samples; by default
the samples are the corpus's own: values that the patterns find are random
strings, longer words are ordinary. A candidate is a run of the alphabet that
no pattern covers; it is reported when the mean log-likelihood ratio of its
transitions and their sum are high enough.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, with the lengths their matches need.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6
# Fixed value: characters of candidates; a code is the place in this string, from 1.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Lower-case parts of which an assignment holds at least one; cheaper to look for than the pattern.
HINTS = ("password", "passwd", "secret", "token", "api")
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"[A-Za-z_]{6,}"
CODES = len(ALPHABET) + 1
#: Weight of the single characters against the transitions seen.
BACKING = 20.0
KINDS = ("assign", "access", "hex", "markov")
SPANS = "array<struct<start:int,end:int,i:int>>"


def places(found: str, between: str) -> Column:
    """Start, end (code points) and number of each match, from the matches and the pieces between them."""

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.char_length(F.element_at(between, i))
        end = start + F.char_length(F.element_at(found, i))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), i.alias("i")))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    walked = F.aggregate(F.sequence(F.lit(1), F.size(found)), start, step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, walked).otherwise(F.array().cast(SPANS))


def matches(df: DataFrame, patterns: dict[str, tuple[Column, str]]) -> DataFrame:
    """For each name: <name>_found, and <name>_between where something is found; guard decides if to look."""
    none = F.array().cast("array<string>")
    df = df.select("*", *[F.when(guard, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"{n}_found") for n, (guard, p) in patterns.items()])
    return df.select("*", *[F.when(F.size(f"{n}_found") > 0, F.split("text", p, -1)).otherwise(none).alias(f"{n}_between") for n, (_, p) in patterns.items()])


def base_matches(df: DataFrame, more: dict[str, tuple[Column, str]]) -> DataFrame:
    """text to what the base patterns, and more, find in it. The length that an assignment's value needs is checked after matching."""
    low = F.lower("text")
    hinted = reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in HINTS])
    # Access keys and hex strings are whole runs of their class, so a pattern with the length finds the same runs.
    patterns = {"assign": (hinted, ASSIGN), "access": (F.contains("text", F.lit("AKIA")), ACCESS), "hex": (F.lit(True), HEX)} | more
    df = matches(df, patterns)
    values = F.when(F.size("assign_found") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("assign_values", values)


def pairs(word: Column) -> Column:
    """array<int>: for each two neighbours in the word, code * CODES + code. Characters are split off once, as substrings would be counted out from the start each."""
    codes = F.transform(F.split(word, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    last = F.greatest(F.char_length(word) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, F.lit(1), last), F.slice(codes, F.lit(2), last), lambda a, b: a * CODES + b)


def labelled_samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(value, secret): the different values the base patterns find, and the different longer words, of the whole corpus."""
    found = base_matches(docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")), {})
    secret = F.concat(F.filter("assign_values", lambda v: F.char_length(v) >= ASSIGN_VALUE), "access_found", "hex_found")
    secrets = found.select(F.explode(secret).alias("value")).select(F.translate("value", ".", "").alias("value"), F.lit(True).alias("secret"))
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(ORDINARY), F.lit(0))).alias("value"), F.lit(False).alias("secret"))
    return secrets.unionByName(words).distinct()


def ratio_model(samples: DataFrame) -> DataFrame:
    """One row, one array: the log-likelihood ratio of each transition, random over ordinary, at code * CODES + code + 1.

    Transitions are backed by how often the second character comes at all, and
    that by 1, so that samples of one kind or none give a uniform model. The array has CODES ** 2 entries whatever the input.
    """
    seen = samples.select("secret", F.explode(pairs(F.col("value"))).alias("pair")).groupBy("pair").agg(
        F.count_if("secret").alias("s"), F.count_if(~F.col("secret")).alias("o")
    )
    grid = samples.sparkSession.range(CODES * CODES).select(F.col("id").cast("int").alias("pair"))
    counts = grid.join(F.broadcast(seen), "pair", "left").select(
        "pair",
        F.floor(F.col("pair") / CODES).alias("from"),
        (F.col("pair") % CODES).alias("to"),
        F.coalesce("s", F.lit(0)).alias("s"),
        F.coalesce("o", F.lit(0)).alias("o"),
    )
    # The grid has CODES ** 2 rows.
    leaving = counts.groupBy("from").agg(F.sum("s").alias("from_s"), F.sum("o").alias("from_o"))
    arriving = counts.groupBy("to").agg((F.sum("s") + 1).alias("to_s"), (F.sum("o") + 1).alias("to_o"))
    whole = counts.agg((F.sum("s") + CODES).alias("all_s"), (F.sum("o") + CODES).alias("all_o"))
    full = counts.join(F.broadcast(leaving), "from").join(F.broadcast(arriving), "to").join(F.broadcast(whole), F.lit(True))

    def likelihood(k: str) -> Column:
        return (F.col(k) + BACKING * F.col(f"to_{k}") / F.col(f"all_{k}")) / (F.col(f"from_{k}") + BACKING)

    rated = full.select(F.struct("pair", (F.log(likelihood("s")) - F.log(likelihood("o"))).alias("ratio")).alias("x"))
    return rated.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["ratio"]).alias("model"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(
    docs: DataFrame,
    text: str = "text",
    samples: DataFrame | None = None,
    mean_ratio: float = 0.5,
    sum_ratio: float = 12.0,
) -> DataFrame:
    """Append base_spans and spans: array<struct<start, kind, end>>, in code points, end exclusive.

    Kinds are places in KINDS. base_spans has assignments, access keys and hex
    strings, leftmost matches that don't overlap within a kind; spans adds runs
    of kind markov: CANDIDATE matches with a letter and a digit that no base
    span touches, whose transitions have a mean log-likelihood ratio of at
    least mean_ratio and a sum of at least sum_ratio. Both are by start, then
    kind. Columns of docs with these names are replaced; working columns are
    taken off again and can't clash, as the text is worked on beside a struct
    of the row.

    A null or empty text has no spans. No row moves but the different sample
    values for the model, which are counted with partial aggregation.
    """
    keep = [c for c in docs.columns if c.lower() not in {"base_spans", "spans"}]
    model = ratio_model(samples if samples is not None else labelled_samples(docs, text)).scalar()
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    df = base_matches(df, {"markov": (F.lit(True), CANDIDATE)})
    df = df.select("row", "markov_found", "assign_values", *[places(f"{k}_found", f"{k}_between").alias(k) for k in KINDS])
    long_enough = F.filter("assign", lambda s: F.char_length(F.element_at("assign_values", s["i"])) >= ASSIGN_VALUE)

    def as_kind(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    base = F.array_sort(F.concat(as_kind(long_enough, 0), as_kind(F.col("access"), 1), as_kind(F.col("hex"), 2)))
    df = df.select("row", "markov_found", "markov", base.alias("base_spans"))

    def random(s: Column) -> Column:
        word = F.element_at("markov_found", s["i"])
        total = F.aggregate(pairs(word), F.lit(0.0), lambda acc, p: acc + F.element_at("model", p + 1))
        free = ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return word.rlike("[0-9]") & word.rlike("[A-Za-z]") & free & (total >= sum_ratio) & (total >= mean_ratio * (F.char_length(word) - 1))

    df = df.withColumn("model", F.when(F.size("markov") > 0, model))
    added = F.when(F.size("markov") > 0, as_kind(F.filter("markov", random), 3)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    df = df.select("row", "base_spans", F.array_sort(F.concat("base_spans", added)).alias("spans"))
    return df.select("row.*", "base_spans", "spans")


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as text."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select(F.col(f"`{key}`").alias("doc_id"), *map(count, range(3)), F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))
