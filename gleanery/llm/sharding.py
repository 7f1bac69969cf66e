"""Sharding by jump consistent hashing (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import cut

# Fixed value: the multiplier of the linear congruential generator in the jump
# consistent hash paper (Lamping and Veach, 2014).
MULTIPLIER = 2862933555777941757
RANGE = 1 << 64
#: Columns beside the key.
OUTPUTS = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}


def jump_targets(key: Column, shards: int) -> Column:
    """array<int> of the shards that the key jumps to, up to the last one below `shards`.

    The key's 64 bits seed the generator; each draw names the next shard count
    at which the key moves. Products need up to 38 digits, so states are
    decimals, which don't overflow under ANSI rules. A null key counts as 0.
    """
    big = "decimal(38,0)"
    state = F.coalesce(key.cast("long"), F.lit(0)).cast(big)
    start = F.struct(
        F.when(state < 0, state + F.lit(str(RANGE)).cast(big)).otherwise(state).cast("decimal(20,0)").alias("state"),
        F.lit(-1).cast("long").alias("at"),
        F.lit(0).cast("long").alias("next"),
        F.array().cast("array<int>").alias("path"),
    )

    def step(acc: Column, _: Column) -> Column:
        state = ((acc["state"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) % F.lit(str(RANGE)).cast("decimal(20,0)")).cast("decimal(20,0)")
        unit = F.lit(1 << 33).cast("decimal(10,0)")
        draw = ((state - state % unit) / unit).cast("double") + 1
        following = F.floor((acc["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / draw)).cast("long")
        moved = F.struct(state.alias("state"), acc["next"].alias("at"), following.alias("next"), F.concat(acc["path"], F.array(acc["next"].cast("int"))).alias("path"))
        return F.when(acc["next"] < shards, moved).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda acc: acc["path"])


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Assign every row to a shard by its key, and to a gapless slot within the shard.

    Returns the key column, size (UTF-8 bytes of the text plus 1), text_crc32,
    law ('key'), shard, slot (from 0), grown_shard (with one more shard: equal
    to shard or the new one). Only key and text are read; other columns, clashing
    names included, are left out.

    Null or empty texts have size 1 and crc32 0. A null key shards as 0; one that
    isn't a whole number shards by the XXH64 of its text. A key column named like
    one of the others gets an underscore. Rows
    with equal keys share a shard and get different slots. An empty table gives
    an empty result.

    No row moves: each row keeps the task that read it, and its number there is
    frozen with the narrow columns by one checkpoint. A slot is the count of the
    shard's rows in earlier tasks plus the row's rank in its own task, so no task
    ever gathers a shard, and equal or null keys can't make a hot one.
    """
    text_bytes = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    own = F.col(f"`{key}`")
    whole = isinstance(docs.select(own).schema[0].dataType, T.IntegralType)
    path = jump_targets(own if whole else F.when(own.isNotNull(), F.xxhash64(own.cast("string"))), shards + 1)
    marked = docs.select(
        F.col(f"`{key}`").alias("key"),
        (F.octet_length(text_bytes) + 1).cast("long").alias("size"),
        F.crc32(text_bytes).alias("text_crc32"),
        path.alias("path"),
        F.monotonically_increasing_id().alias("row"),
    )
    narrow = cut(
        marked.select(
            "key",
            "size",
            "text_crc32",
            F.element_at(F.filter("path", lambda b: b < shards), -1).alias("shard"),
            F.element_at("path", -1).alias("grown_shard"),
            F.shiftright("row", 33).alias("task"),
            "row",
        )
    )
    counts = narrow.groupBy("shard", "task").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("shard"), F.col("task"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")
    )
    in_task = Window.partitionBy("shard", "task").orderBy("row")
    ranked = narrow.withColumn("rank", F.row_number().over(in_task) - 1)
    name = key
    while name.lower() in OUTPUTS:
        name += "_"
    return ranked.join(offsets, ["shard", "task"]).select(
        F.col("key").alias(name),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("offset") + F.col("rank")).cast("long").alias("slot"),
        "grown_shard",
    )
