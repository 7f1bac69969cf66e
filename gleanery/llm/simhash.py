"""SimHash near-duplicate groups by a Gray-order hierarchical index.

Fingerprints that differ in at most `most` bits agree in a whole block of bits
if there are more blocks than that, so they meet in a bucket (block, value of
the block). In a bucket they are sorted by Gray rank, which puts similar
patterns side by side; every FAN neighbours share the bits they agree on with an
upper node, and so on to the top. A search goes down from the top with the
differences in the shared bits added up, and leaves a node, with all that is
below it, once they exceed the limit, or once node and query are known to be in
one group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import LONG, cut, fields, free_name, map_texts

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FAN = 16
#: Rows of a bucket from which it is split by further blocks.
HOT_BUCKET = 200_000
#: Pairs of query and node looked at in one step.
STEP = 1 << 20


def shingles(text: str | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """Hashes (uint64) of all shingles in order; a shorter text is one shingle, one without words has none."""
    words = WORD.findall(text.encode().lower()) if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    width = min(shingle, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    ends = (starts + sizes)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends, strict=False)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, as a signed number: a bit is 1 if over half the hashes have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64 bits, as a signed number: a bit is 1 if over half the shingle hashes have it."""
    return majority(shingles(text, shingle, seed))


def add_fingerprints(docs: DataFrame, name: str, text: str = "text", shingle: int = 4) -> DataFrame:
    def make():
        return lambda texts: [[fingerprint(t, shingle) for t in texts]]

    return map_texts(docs, make, fields(**{name: LONG}), text)


def blocks(bits: int, count: int) -> list[tuple[int, int]]:
    """(shift, width) of `count` blocks of nearly equal width."""
    edges = [round(bits * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def block_value(c: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(c, shift).bitwiseAND(F.lit((1 << width) - 1))


def bucket_keys(fp: Column, scheme: tuple[int, int]) -> Column:
    """array<long>: for each choice of blocks, its number and the values of its blocks."""
    count, agree = scheme
    keys = []
    for number, chosen in enumerate(combinations(blocks(64, count), agree)):
        key = F.lit(number).cast("long")
        for shift, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(block_value(fp, shift, width))
        keys.append(key)
    return F.array(*keys)


def scheme_for(rows: int, most: int) -> tuple[int, int]:
    """Number of blocks, and of those that must agree: more as the rows grow, so that buckets stay small.

    Every scheme finds the same links: with `agree` + most blocks, `most`
    differences leave `agree` blocks untouched.
    """
    agree = 1 if rows < 2_000_000 else 2 if rows < 500_000_000 else 3
    return most + agree, agree


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the Gray code sequence."""
    rank = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def levels(patterns: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, own bits) of the nodes of each level, leaves first; a node's own bits are those it shares that its parent doesn't."""
    full = np.full(len(patterns), ~np.uint64(0))
    made = [(patterns, full)]
    while len(made[-1][0]) > 1:
        value, mask = made[-1]
        at = np.arange(0, len(value), FAN)
        ones = np.bitwise_and.reduceat(value | ~mask, at)
        zeros = np.bitwise_or.reduceat(value & mask, at)
        same = np.bitwise_and.reduceat(mask, at) & ~(ones ^ zeros)
        made.append((zeros & same, same))
    out = []
    for depth, (value, mask) in enumerate(made):
        above = np.repeat(made[depth + 1][1], FAN)[: len(mask)] if depth + 1 < len(made) else np.zeros(len(mask), dtype=np.uint64)
        out.append((value, mask & ~above))
    return out


def forest(patterns: np.ndarray, most: int) -> np.ndarray:
    """For Gray-sorted patterns, the smallest index of each one's group under links of at most `most` bits."""
    n = len(patterns)
    group = np.arange(n)
    near = np.flatnonzero(np.bitwise_count(patterns[1:] ^ patterns[:-1]) <= most)
    group = merge(group, near, near + 1)
    index = levels(patterns)
    queries_at_once = max(1, STEP // FAN // 16)
    for begin in range(0, n, queries_at_once):
        # Groups only grow, so what one chunk joined prunes the next.
        uniform = [group]
        for value, _ in index[1:]:
            below = uniform[-1]
            at = np.arange(0, len(below), FAN)
            low, high = np.minimum.reduceat(below, at), np.maximum.reduceat(below, at)
            mixed = np.minimum.reduceat(np.where(below < 0, -1, 0), at) < 0
            uniform.append(np.where((low == high) & ~mixed, low, -1))
        query = np.arange(begin, min(n, begin + queries_at_once))
        node, spent = np.zeros(len(query), dtype=np.int64), np.zeros(len(query), dtype=np.int64)
        node = np.zeros(len(query), dtype=np.int64)
        pending = [(len(index) - 1, query, node, spent)]
        while pending:
            depth, query, node, spent = pending.pop()
            if len(query) > STEP:
                half = len(query) // 2
                pending += [(depth, query[half:], node[half:], spent[half:]), (depth, query[:half], node[:half], spent[:half])]
                continue
            value, own = index[depth]
            spent = spent + np.bitwise_count((patterns[query] ^ value[node]) & own[node])
            alive = (spent <= most) & (uniform[depth][node] != group[query])
            query, node, spent = query[alive], node[alive], spent[alive]
            if not len(query):
                continue
            if depth == 0:
                # A link to a later leaf is found from there as well.
                group = merge(group, query, node)
                continue
            below = len(index[depth - 1][0])
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            query, spent = np.repeat(query, FAN), np.repeat(spent, FAN)
            real = child < below
            pending.append((depth - 1, query[real], child[real], spent[real]))
    return group


def merge(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Groups (smallest index in each) after linking a[i] with b[i]."""
    a, b = group[a], group[b]
    while True:
        open_ = a != b
        if not open_.any():
            return group
        a, b = a[open_], b[open_]
        np.minimum.at(group, np.maximum(a, b), np.minimum(a, b))
        while (group != (up := group[group])).any():
            group = up
        a, b = group[a], group[b]


def bucket_links(most: int):
    """Rows (bucket, fp) sorted by bucket to links (fp, smallest-index fp of its group in the bucket)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            held_key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            held = np.concatenate([held, batch.column(1).to_numpy(zero_copy_only=False)])
            changes = np.flatnonzero(held_key[1:] != held_key[:-1]) + 1
            if len(changes):
                yield from links(held[: changes[-1]], changes)
                held_key, held = held_key[changes[-1] :], held[changes[-1] :]
        if len(held):
            yield from links(held, np.array([len(held)]))

    def links(fps: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b, start = [], [], 0
        for end in ends.tolist():
            if end - start > 1:
                bits = np.unique(fps[start:end].view(np.uint64))
                bits = bits[np.argsort(gray_rank(bits))]
                group = forest(bits, most)
                linked = np.flatnonzero(group != np.arange(len(bits)))
                a.append(bits[linked].view(np.int64))
                b.append(bits[group[linked]].view(np.int64))
            start = end
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return rows


def link_fingerprints(fps: DataFrame, name: str, most: int = 4) -> DataFrame:
    """Links (a, b) that connect what chains of at most `most` differing bits connect: a forest for each bucket.

    fps has different fingerprints. A bucket of more than HOT_BUCKET rows is
    split: its rows go to buckets of further blocks instead, which the same
    argument makes complete. The table of hot buckets has at most one row for
    HOT_BUCKET rows of input, and is joined as Spark sees fit.
    """
    rows = fps.count()
    agree = scheme_for(rows, most)
    keyed = fps.select(F.col(name).alias("fp"), F.explode(bucket_keys(F.col(name), agree)).alias("bucket"))
    if rows > HOT_BUCKET:
        hot = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BUCKET).select("bucket", F.lit(True).alias("hot"))
        finer = bucket_keys(F.col("fp"), (most + agree[1] + 1, agree[1] + 1))
        split = F.when(F.col("hot"), F.transform(finer, lambda k: F.xxhash64("bucket", k))).otherwise(F.array("bucket"))
        keyed = keyed.join(hot, "bucket", "left").select("fp", F.explode(split).alias("bucket"))
    return (
        keyed.select("bucket", "fp")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(bucket_links(most), "a long, b long")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links: root is the smallest node of its component.

    Rounds of large-star and small-star: each hooks the neighbours of a node to
    the smallest of them. Groups are reduced by partial minima, and these are
    checkpointed before they are joined back, so that Spark can split a node of
    many links between tasks; every round is checkpointed.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = cut(small.where("a <> b").distinct())
        n = edges.count()
        if after.count() == n and edges.join(after, ["a", "b"], "left_anti").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = after


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """(key, fp, component_id) for every row of docs: its fingerprint as a long, and its group.

    Fingerprints link at `most` or fewer differing bits; component_id is the
    smallest key that chains of links reach, the row's own included. Other
    columns are left out.

    Texts without words, null and empty ones too, have fingerprint 0 and link
    like any other. Rows with a null key belong to components but never name
    them; a component of null keys only has a null id. Equal rows stay. Equal
    fingerprints are reduced to one before any comparison, with partial
    aggregation, so groups of copies cost a row each.
    """
    plain = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    marked = cut(add_fingerprints(plain, "fp", "text", shingle).select("key", "fp"))
    return marked.join(group_names(marked, most), "fp").select("key", "fp", "component_id")


def group_names(marked: DataFrame, most: int) -> DataFrame:
    """(fp, component_id) for the different fingerprints of (key, fp)."""
    distinct = cut(marked.groupBy("fp").agg(F.min("key").alias("least")))
    roots = components(link_fingerprints(distinct.select("fp"), "fp", most))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Apart from the join, so that a group of many fingerprints can be split between tasks.
    least = cut(named.groupBy("root").agg(F.min("least").alias("component_id")))
    return named.join(least, "root").select("fp", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, most: int = 4) -> DataFrame:
    """The rows of docs whose key names their group, with all their columns: one of each group.

    Of rows that share such a key, one stays. Rows with a null key stay, as they
    can't be told apart from the first of a group.
    """
    named = near_duplicates(docs, key, text, shingle, most)
    first = named.where("key = component_id").select(F.col("key").alias(own := free_name(docs, "first_key"))).distinct()
    whole = docs.where(F.col(f"`{key}`").isNotNull()).join(first, F.col(f"`{key}`") == F.col(own), "left_semi").dropDuplicates([key])
    return whole.unionByName(docs.where(F.col(f"`{key}`").isNull()))
