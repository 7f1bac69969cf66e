"""Near copies of texts: exact Jaccard similarity over word shingles, with SimHash groups for a start.

SimHash at a few bits finds the closest copies, but no bit limit finds all pairs
of a given similarity. So its groups only give the first pairs to look at; an
exact set-similarity join over rare shingles (see line_dedup) gives the others,
and every pair is verified on its whole sets of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import INT, LONG, Scratch, fields, free_name, map_texts, stored
from gleanery.llm.line_dedup import Similarity, likely, parted
from gleanery.llm.simhash import components, group_names, majority, shingles

LONGS = T.ArrayType(LONG)
#: About so many texts are looked at to tell common shingles; this decides on the order only, never on results.
SAMPLE = 10_000
#: Most common shingles that are put last, and how often the sample has them at least.
COMMON, OFTEN = 1 << 16, 4


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingles(text, shingle).view(np.int64))


def lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, dtype=np.int64)])))


def with_sets(df: DataFrame, shingle: int) -> DataFrame:
    """df with its text replaced by the set of its shingles."""

    def make():
        return lambda texts: [lists([shingle_set(t, shingle) for t in texts])]

    return map_texts(df, make, fields(words=LONGS)).drop("text")


def common_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    share = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod("th", F.lit(share)) == 0).select("text")
    counted = with_sets(some, shingle).select(F.explode("words").alias("word")).groupBy("word").count()
    top = counted.where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "word").limit(COMMON).collect()
    return np.sort(np.array([r.word for r in top], dtype=np.int64))


def described(texts: DataFrame, shingle: int, common: np.ndarray) -> DataFrame:
    """(key, th, fp, node, n, words): node stands for the set of n shingles, words is its prefix, common shingles last."""

    def prefix(s: np.ndarray) -> np.ndarray:
        last = np.isin(s, common)
        return np.concatenate([s[~last], s[last]])[: len(s) - (4 * len(s) + 4) // 5 + 1]

    def make():
        from xxhash import xxh64_intdigest

        def work(rows: list[str | None]) -> list:
            plain = [shingles(t, shingle) for t in rows]
            sets = [np.unique(x.view(np.int64)) for x in plain]
            nodes = np.array([xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            return [[majority(x) for x in plain], nodes.tolist(), [len(s) for s in sets], lists([prefix(s) for s in sets])]

        return work

    return map_texts(texts, make, fields(fp=LONG, node=LONG, n=INT, words=LONGS)).drop("text")


def passing(like: Similarity, i: Column, n: Column, j: Column, m: Column) -> Column:
    """Size and positional filters for sets of n and m with a shingle in common at places i and j."""
    return like.sizes(n, m) & (F.least(n - i, m - j) >= like.overlap(n, m))


def pair(x: Column, y: Column) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def hopeful(pairs: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """The pairs (a, b) of nodes whose prefixes share as many shingles as those of similar sets do."""
    halves = sets.select(F.col("node").alias("id"), "n", F.transform("words", lambda w: F.hash(w)).alias("words"))
    found = likely(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")), halves, like)
    return found.select(F.col("x").alias("a"), F.col("y").alias("b"))


def similar(pairs: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, like: Similarity, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes that are as similar as asked: sets are made again for their texts alone."""
    pairs = scratch.stored(hopeful(pairs, sets, like))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = scratch.stored(ids.join(sets.select("node", "th"), "node").select("node", "th"))
    some, _ = parted(texts.select("th", "text"), ids.select(F.col("th").alias("doc"), F.lit(0).alias("line")), "th", F.lit(0))
    whole = some.join(ids, "th").dropDuplicates(["node"]).select("node", "text")
    whole = scratch.stored(with_sets(whole, shingle), {"compression": "none"})
    side = lambda x: whole.select(F.col("node").alias(x), F.col("words").alias(f"{x}_words"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    enough = F.size(F.array_intersect("a_words", "b_words")) >= like.overlap(F.size("a_words"), F.size("b_words"))
    found = scratch.stored(both.where(enough).select("a", "b"))
    scratch.drop(whole)
    return found


def groups(texts: DataFrame, shingle: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(key, th, node) of every row of texts (key, text, th), and (node, root) of nodes that similar pairs join."""
    like, scratch = Similarity(4, 5), Scratch(texts)
    wide = scratch.stored(described(texts, shingle, common_shingles(texts, shingle)))
    rows = stored(wide.select("key", "th", "node"))
    sets = scratch.stored(wide.groupBy("node").agg(*[F.first(c).alias(c) for c in ("th", "fp", "n", "words")]))
    scratch.drop(wide)
    by_word = Window.partitionBy("word").orderBy("node")
    words = sets.select("node", "n", F.posexplode("words").alias("pos", "word"))
    words = words.withColumn("lead", F.first(F.struct("node", "n", "pos")).over(by_word.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    words = words.withColumn("shared", F.lag("node").over(by_word).isNotNull() | F.lead("node").over(by_word).isNotNull())
    shared = scratch.stored(words.where("shared").drop("shared"))
    # First pairs: with the first text of the SimHash group, and with the first text that has a shingle. In groups of copies most are similar.
    named = sets.where("n > 0").select(F.col("node").alias("key"), "fp")
    tight = named.join(group_names(named, most), "fp").where("key <> component_id").select(*pair(F.col("key"), F.col("component_id")))
    led = shared.where(F.col("node") != F.col("lead.node")).where(passing(like, F.col("pos"), F.col("n"), F.col("lead.pos"), F.col("lead.n")))
    # Of a text's leads the one with most words; the other pairs are met below.
    counted = led.groupBy("node", F.col("lead.node").alias("lead")).agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", "lead")).alias("best"))
    firsts = scratch.stored(tight.unionByName(counted.select(*pair(F.col("node"), F.col("best.lead")))).distinct())
    links = similar(firsts, sets, texts, shingle, like, scratch)
    # Then all others that share a rare shingle and aren't joined yet.
    marked = shared.join(components(links), "node", "left").select("word", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
    x, y = [marked.select("word", *[F.col(c).alias(f"{p}_{c}") for c in ("node", "n", "pos", "root")]) for p in "xy"]
    near = x.join(y, "word").where("x_node > y_node and x_root <> y_root").where(passing(like, F.col("x_pos"), F.col("x_n"), F.col("y_pos"), F.col("y_n")))
    others = scratch.stored(near.select(*pair(F.col("x_node"), F.col("y_node"))).distinct().join(firsts, ["a", "b"], "left_anti"))
    scratch.drop(shared, firsts)
    more = similar(others, sets, texts, shingle, like, scratch)
    # components() has checkpointed all that it needs.
    roots = components(links.unionByName(more))
    scratch.drop()
    return rows, roots


def keep_first_copy(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, most: int = 5) -> DataFrame:
    """The first row of each group of near copies, by key, with all its columns.

    Texts whose sets of shingles (lower-cased in ASCII) have a Jaccard similarity
    of 0.8 or more are near copies; chains of them are a group, and texts without
    words are one. Sets are taken as equal if their 64-bit hashes are. most is
    the number of bits of the SimHash groups that give the first pairs; results
    don't depend on it.

    Rows with one key and different texts are told apart by a hash of the text,
    and the smaller one is first; of rows equal in key and text one stays. Rows
    with a null key stay, as they can't be told apart from the first of a group.
    """
    th = F.xxhash64(F.col(f"`{text}`"))
    rows, roots = groups(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), th.alias("th")), shingle, most)
    named = rows.where("key is not null").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    first = named.agg(F.min(F.struct("key", "th")).alias("first")).select("first.*", F.lit(True).alias("stays"))
    # Most rows are alone with their id and text and stay: only the others are shuffled with all their columns.
    counted = rows.where("key is not null").groupBy("key", "th").count().join(first, ["key", "th"], "left")
    doubt = stored(counted.where("stays is null or count > 1").select("key", "th", F.coalesce("stays", F.lit(False)).alias("stays")))
    Scratch(docs).drop(rows)
    whole = docs.where(F.col(f"`{key}`").isNotNull()).withColumn(mark := free_name(docs, "text_hash"), th)
    some, sure = parted(whole, doubt.select(F.col("key").alias("doc"), F.col("th").alias("line")), f"`{key}`", mark)
    names = [free_name(whole, n) for n in ("doubt_key", "doubt_hash", "stays")]
    some = some.join(doubt.toDF(*names), (F.col(f"`{key}`") == F.col(names[0])) & (F.col(mark) == F.col(names[1])), "left")
    some = some.where(F.coalesce(names[2], F.lit(True))).dropDuplicates([key, mark]).drop(*names)
    return some.unionByName(sure).drop(mark).unionByName(docs.where(F.col(f"`{key}`").isNull()))
