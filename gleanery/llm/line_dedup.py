"""Near-duplicate lines by an exact set-similarity join (native: DataFrame functions only).

A line is the set of its words. Words are ordered by rarity; two sets as similar
as asked share a word among their first few (the prefix), are of similar size,
and share that word near enough to the front for the rest to suffice. What
passes these filters is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import Scratch, cut, free_name, stored

#: Blanks beside the space and the line feed.
OTHER_BLANKS = "\t\x0b\x0c\r"
#: Words are counted in so many buckets of their hash: enough to tell rare from common, and a fixed size to hand out.
RARITY_BITS = 18
#: Bits of the map of lines to verify; it spares shuffling the others, and its size is fixed.
MAP_BITS = 23
#: For each rare word of a set, how many of the last ones before it are looked at first.
LAST_ONES = 3
#: Of these, how many at most are compared whole before the join that has all.
TURNS = 4
#: Words from which sets have a wide signature.
LONG_SET = 64
#: What a null id counts as.
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Similarity:
    """A least Jaccard similarity of num / den, in whole numbers."""

    num: int = 4
    den: int = 5

    def prefix(self, n: Column) -> Column:
        """Words of a set of n among which it shares one with any set similar to it."""
        return n - F.floor((n * self.num + self.den - 1) / self.den).cast("int") + 1

    def head(self, n: Column) -> Column:
        """Words at the front that the wide signature is made of: twice the prefix."""
        return F.least(n, 2 * self.prefix(n))

    def overlap(self, n: Column, m: Column) -> Column:
        """Words that sets of n and m must share."""
        return F.floor(((n + m) * self.num + self.num + self.den - 1) / (self.num + self.den)).cast("int")

    def sizes(self, n: Column, m: Column) -> Column:
        return (n * self.den >= m * self.num) & (m * self.den >= n * self.num)


def doc_of(key: str) -> Column:
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID)).alias("doc")


def repeated_ids(docs: DataFrame, key: str) -> DataFrame:
    """One row, one array: a bit map of the ids that several rows have, null ids included."""
    again = docs.select(doc_of(key)).groupBy("doc").count().where("count > 1")
    return cut(line_map(again.select("doc", F.lit(0).alias("line"))))


def with_own(docs: DataFrame, key: str, text: str, repeated: DataFrame) -> DataFrame:
    """docs with doc, and with own to tell rows of one id apart: a hash of the text where the map has the id, else 0.

    That the map has other ids too does no harm; a 0 for most costs next to no disk.
    """
    at, one = spot("doc", F.lit(0))
    marked = docs.withColumn("doc", doc_of(key)).withColumn("map", repeated.scalar())
    return marked.withColumn("own", F.when(F.get("map", at).bitwiseAND(one) != 0, F.xxhash64(F.col(text))).otherwise(F.lit(0).cast("long"))).drop("map")


def lines_of(docs: DataFrame, key: str, text: str, repeated: DataFrame) -> DataFrame:
    """(doc, own, line, s): all lines, lower-cased, with spaces for all blanks."""
    plain = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    lines = with_own(plain, "key", "text", repeated).select("doc", "own", F.posexplode(F.split(F.lower("text"), "\n")).alias("line", "s"))
    # Few lines have other blanks, and looking for them is cheaper than rewriting all.
    other = reduce(lambda x, y: x | y, [F.contains("s", F.lit(c)) for c in OTHER_BLANKS])
    return lines.withColumn("s", F.when(other, F.translate("s", OTHER_BLANKS, " " * len(OTHER_BLANKS))).otherwise(F.col("s")))


def one_at(place: Column) -> Column:
    """A long with one bit, at the last six bits of place."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place_in(place))


def place_in(place: Column) -> Column:
    return place.bitwiseAND(F.lit(63)).cast("int")


def bucket_of(h: Column, bits: int) -> Column:
    return h.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def as_array(df: DataFrame, at: str, value: str, size: int, default: int) -> DataFrame:
    """One row, one array: value at each place below size."""
    grid = df.sparkSession.range(size).select(F.col("id").cast("int").alias(at))
    full = grid.join(F.broadcast(df), at, "left").select(F.struct(at, F.coalesce(value, F.lit(default)).alias("v")).alias("x"))
    return full.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("a"))


def hashed(lines: DataFrame) -> DataFrame:
    """(doc, own, line, words, h1, h2) of the lines with words: the sorted hashes of the different words, and two hashes that stand for the set."""
    every = F.transform(F.split("s", " "), lambda w: F.xxhash64(w))
    words = F.sort_array(F.array_remove(F.array_distinct(every), F.xxhash64(F.lit(""))))
    # The filter is on the line: one on the words would be moved down and make them twice.
    sets = lines.where(F.trim("s") != "").select("doc", "own", "line", words.alias("words"))
    return sets.select("*", F.xxhash64("words").alias("h1"), F.hash("words").alias("h2"))


def rarity(lines: DataFrame) -> DataFrame:
    return word_places(hashed(lines))


def word_places(sets: DataFrame) -> DataFrame:
    """One row: for each bucket of words its place from the rarest to the most common, by the lines of the whole corpus that have one."""
    size = 1 << RARITY_BITS
    counted = sets.select(F.explode("words").alias("h")).groupBy(bucket_of(F.col("h"), RARITY_BITS).alias("bucket")).agg(F.count("*").alias("n"))
    grid = sets.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket"))
    full = grid.join(F.broadcast(counted), "bucket", "left").select(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "bucket").alias("x"))
    ordered = full.agg(F.array_sort(F.collect_list("x")).alias("x")).select(F.posexplode("x").alias("place", "x"))
    return as_array(ordered.select("x.bucket", F.col("place").cast("long").alias("place")), "bucket", "place", size, 0)


def ranked(lines: DataFrame, places: DataFrame) -> DataFrame:
    return by_rarity(hashed(lines), places)


def by_rarity(sets: DataFrame, places: DataFrame) -> DataFrame:
    """sets with their words numbered anew and sorted: the place of the hash's bucket, then the rest of the hash.

    Numbers tell apart what hashes do and sort by rarity, the rarest first.
    """
    # Longs have a sign: places count from the middle, or the commoner half would sort first.
    table = places.select(F.transform("a", lambda p: F.shiftleft(p.cast("long") - (1 << (RARITY_BITS - 1)), 64 - RARITY_BITS))).scalar()

    def number(h: Column) -> Column:
        # Never null, and said so: an array that may have nulls is sorted as objects.
        return F.coalesce(F.get("places", bucket_of(h, RARITY_BITS)).bitwiseOR(F.shiftrightunsigned(h, RARITY_BITS)), F.lit(0).cast("long"))

    rest = [c for c in sets.columns if c != "words"]
    return sets.withColumn("places", table).select(*rest, F.sort_array(F.transform("words", number)).alias("words"))


def described(sets: DataFrame, like: Similarity) -> DataFrame:
    """(doc, own, line, h1, h2, n, sig, sig_a, sig_b, words): words stands for the prefix.

    sig has the parity of the words in each of 64 classes. That tells little of a
    long set, and takes long; sig_a and sig_b have the parity of its head's words
    in each of 128. sig is for all sets as similar as asked to one that isn't long.
    """
    n, zero, head = F.size("words").alias("n"), F.lit(0).cast("long"), F.slice("words", F.lit(1), like.head(F.col("n")))
    # Arrays are worked through expression by expression: the last bits of a number are hash enough, and each class is a shift without a condition.
    flip = lambda acc, w: acc.bitwiseXOR(one_at(w))
    flip_b = lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", F.shiftrightunsigned(w, 6).bitwiseAND(F.lit(1)), place_in(w)))
    wide = lambda step: F.when(F.col("n") >= LONG_SET, F.aggregate(head, zero, step)).otherwise(zero)
    # Half of a number is enough to meet by.
    prefix = F.transform(F.slice("words", F.lit(1), like.prefix(F.col("n"))), lambda w: F.hash(w))
    sig = F.when(F.col("n") * like.num < LONG_SET * like.den, F.aggregate("words", zero, flip)).otherwise(zero).alias("sig")
    both = sets.select("*", n).select("doc", "own", "line", "h1", "h2", "n", sig, wide(flip).alias("sig_ab"), wide(flip_b).alias("sig_b"), prefix.alias("words"))
    return both.select("doc", "own", "line", "h1", "h2", "n", "sig", F.col("sig_ab").bitwiseXOR(F.col("sig_b")).alias("sig_a"), "sig_b", "words")


#: Columns of a set and a word of its prefix.
SET = ("id", "n", "sig", "sig_a", "sig_b", "pos")
Cell = Callable[[str], Column]


def passing(like: Similarity, x: Cell, y: Cell) -> Column:
    """Length, positional and signature filters on sets with a word in common, given their columns by name.

    The positional filter may take the word as the first the two share: for the
    one that is the first, it holds. Sets differ in at least as many words as
    their signatures in bits. Of sets of n and m that share at least o words the
    first few of these are in both heads, as at most n - o and m - o other words
    come before; so the heads differ in few words as well.
    """
    n, m = x("n"), y("n")
    shared = like.overlap(n, m)
    bits = lambda c: F.bit_count(x(c).bitwiseXOR(y(c)))
    common = F.least(like.head(n) - n, like.head(m) - m) + shared
    few = F.when(F.least(n, m) < LONG_SET, bits("sig") <= n + m - 2 * shared).otherwise(bits("sig_a") + bits("sig_b") <= like.head(n) + like.head(m) - 2 * common)
    return like.sizes(n, m) & few & (F.least(n - x("pos"), m - y("pos")) >= shared)


def line_map(ids: DataFrame) -> DataFrame:
    """One row, one array: a bit map of the lines' places, of a fixed size."""
    at, one = spot()
    return as_array(ids.select(at.alias("at"), one.alias("b")).groupBy("at").agg(F.bit_or("b").alias("b")), "at", "b", 1 << (MAP_BITS - 6), 0)


def spot(doc: str = "doc", line: str | Column = "line") -> tuple[Column, Column]:
    h = F.xxhash64(doc, line)
    return F.shiftrightunsigned(h, 64 - MAP_BITS + 6).cast("int"), one_at(F.shiftrightunsigned(h, 64 - MAP_BITS))


def parted(df: DataFrame, ids: DataFrame, doc: str, line: str | Column) -> tuple[DataFrame, DataFrame]:
    """Rows of df that may be among ids (doc, line), and those that surely aren't, which so need no shuffle."""
    at, one = spot(doc, line)
    marked = df.withColumn(name := free_name(df, "map"), cut(line_map(ids)).scalar())
    among = F.get(F.col(name), at).bitwiseAND(one) != 0
    return marked.where(among).drop(name), marked.where(~among).drop(name)


def likely(pairs: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """(x, y, alike): the pairs whose prefixes share enough words, and how many.

    Of sets of n and m that share at least o words, the first of these come
    after at most n - o and m - o other words; as many as fit into both prefixes
    are in both. Words count as equal if their halves are, so none is missed.
    """
    side = lambda p: sets.select(F.col("id").alias(p), F.col("n").alias(f"{p}_n"), F.col("words").alias(f"{p}_words"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    n, m = F.col("x_n"), F.col("y_n")
    least = F.least(like.prefix(n) - n, like.prefix(m) - m) + like.overlap(n, m)
    # Two words of a set may have one half; then it counts for both.
    alike = F.size(F.array_intersect("x_words", "y_words")) + F.size("x_words") - F.size(F.array_distinct("x_words"))
    return both.select("x", "y", alike.alias("alike"), least.alias("least")).where("alike >= least").drop("least")


def verified(pairs: DataFrame, sets: DataFrame, lines: DataFrame, like: Similarity, scratch: Scratch, twice: bool) -> DataFrame:
    """The ids x of pairs (x, y) of sets that are as similar as asked, by the whole sets. twice: whether a line may be there more than once."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    wanted = scratch.stored(sets.select("id", "doc", "own", "line").join(ids, "id"))
    # The map only spares the other lines the shuffle; the join decides.
    at, bit = spot()
    some = lines.select("doc", "own", "line", "words").withColumn("map", line_map(wanted).scalar()).where(F.get("map", at).bitwiseAND(bit) != 0)
    whole = some.join(wanted, ["doc", "own", "line"]).select("id", "words")
    whole = scratch.stored(whole.dropDuplicates(["id"]) if twice else whole)
    both = pairs.join(whole.select(F.col("id").alias("x"), F.col("words").alias("x_words")), "x").join(whole.select(F.col("id").alias("y"), F.col("words").alias("y_words")), "y")
    enough = F.size(F.array_intersect("x_words", "y_words")) >= like.overlap(F.size("x_words"), F.size("y_words"))
    found = scratch.stored(both.where(enough).select(F.col("x").alias("id")).distinct())
    scratch.drop(whole)
    return found


def first_lines(lines: DataFrame) -> DataFrame:
    """One row for each different set: its first line, how many lines have it, and an id in the order of the first lines."""
    first = F.min(F.struct("doc", "line", "own")).alias("first")
    sets = lines.groupBy("h1", "h2").agg(first, F.count("*").alias("rows"), *[F.first(c).alias(c) for c in (*SET[1:-1], "words")])
    return sets.select("first.*", "h1", "h2", "rows", *SET[1:-1], "words").orderBy("doc", "line", "own").withColumn("id", F.monotonically_increasing_id())


def prefix_words(sets: DataFrame, *more: str) -> DataFrame:
    return sets.select(*SET[:-1], *more, F.posexplode("words").alias("pos", "word"))


def packed(words: DataFrame, *more: str) -> DataFrame:
    """words with n, pos and more (0 or 1) in one long: of a shuffled row every column counts."""
    flags = reduce(lambda x, c: F.shiftleft(x, 1).bitwiseOR(F.col(c)), more, F.col("pos").cast("long"))
    return words.withColumn("at", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(flags)).drop("n", "pos", *more)


def of_packed(cell: Cell) -> Cell:
    low = F.lit((1 << 32) - 1)
    return lambda c: F.shiftright(cell("at"), 32).cast("int") if c == "n" else cell("at").bitwiseAND(low).cast("int") if c == "pos" else cell(c)


def unpacked(words: DataFrame, *more: str) -> DataFrame:
    low = F.col("at").bitwiseAND(F.lit((1 << 32) - 1))
    flags = [F.shiftright(low, k).bitwiseAND(F.lit(1)).cast("int").alias(c) for k, c in enumerate(reversed(more))]
    rest = [c for c in words.columns if c != "at"]
    return words.select(*rest, F.shiftright("at", 32).cast("int").alias("n"), F.shiftright(low, len(more)).cast("int").alias("pos"), *flags)


def at_front(like: Similarity) -> Column:
    """Whether a word is among those of which a set shares one with any similar set that isn't smaller."""
    return F.col("n") - F.col("pos") >= like.overlap(F.col("n"), F.col("n"))


def lead_pairs(sets: DataFrame, like: Similarity) -> DataFrame:
    """(x, y): each set x with a few earlier ones that pass the filters: the first and the last before it of those of about its size that share a rare word.

    This settles groups of copies at a few pairs a line; all else is found later.
    """
    near = prefix_words(sets).where(at_front(like))
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(like.den / like.num)).alias("size")
    near = packed(near.select("*", size))
    by_word, own = Window.partitionBy("word", "size").orderBy("id"), F.struct("id", "at", *SET[2:-1])
    first = F.first(own).over(by_word.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    names = [f"before_{k}" for k in range(LAST_ONES + 1)]
    led = near.select("id", "at", *SET[2:-1], *[c.alias(k) for k, c in zip(names, [first, *[F.lag(own, k).over(by_word) for k in range(1, LAST_ONES + 1)]], strict=True)])
    # Most words are of one set. A pair a row keeps the filters in one piece of code, small enough for the JVM to compile.
    met = led.where(F.col(names[1]).isNotNull()).select("id", "at", *SET[2:-1], F.explode(F.array(*names)).alias("y"))
    y = of_packed(lambda c: F.col("y")[c])
    return met.where((F.col("id") > y("id")) & passing(like, of_packed(F.col), y)).select(F.col("id").alias("x"), y("id").alias("y")).distinct()


def other_pairs(sets: DataFrame, settled: DataFrame, like: Similarity) -> DataFrame:
    """(x, y): all pairs that pass the filters, with y before x, for each x that isn't settled."""
    # Pairs are met with the smaller set first, whichever comes later.
    some, rest = parted(sets.select(*SET[:-1], "words"), settled.select(F.col("id").alias("doc"), F.lit(0).alias("line")), "id", F.lit(0))
    some = some.join(settled.select("id", F.lit(0).alias("open")), "id", "left").withColumn("open", F.coalesce("open", F.lit(1)))
    known = some.unionByName(rest.withColumn("open", F.lit(1)))
    words = packed(prefix_words(known, "open"), "open").repartition("word")
    words = unpacked(words, "open")
    # The smaller set, or the earlier of two of one size, has its word near the front. Said so that it isn't done before the shuffle, which both sides share.
    near = words.where(F.when(F.spark_partition_id() >= 0, at_front(like)))
    x, y = [df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("word", *SET, "open")]) for p, df in (("x", near), ("y", words))]
    # What most pairs fail comes first.
    smaller = (F.col("x_n") <= F.col("y_n")) & (F.col("x_n") * like.den >= F.col("y_n") * like.num) & ((F.col("x_n") < F.col("y_n")) | (F.col("x_id") < F.col("y_id")))
    asked = F.when(F.col("x_id") > F.col("y_id"), F.col("x_open")).otherwise(F.col("y_open")) == 1
    passes = passing(like, lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"))
    found = x.join(y, (F.col("x_word") == F.col("y_word")) & smaller & passes & asked)
    return found.select(F.greatest("x_id", "y_id").alias("x"), F.least("x_id", "y_id").alias("y")).distinct()


def duplicate_lines(docs: DataFrame, repeated: DataFrame, key: str = "doc_id", text: str = "text", like: Similarity = Similarity()) -> DataFrame:
    """(doc, own, removed): the line numbers, from 0, that go from each document with some.

    A line goes if an earlier one, by document id, line number and then own, is
    as similar as asked. Lines without words are never compared.

    The set of every line is written once to the shared folder, and read from
    there by all that follows. Equal sets are reduced to their first line before
    anything is compared, with partial aggregation, so a line in a third of all
    documents is one row. A set is held against a few others first; groups of
    near copies are settled so, at a few pairs a line. Sets that these don't settle
    are then joined with all earlier ones that share a word of the prefix.
    """
    scratch = Scratch(docs)
    # Words repeat, so a dictionary large enough makes the table half as large.
    lines = scratch.stored(hashed(lines_of(docs, key, text, repeated)), {"parquet.dictionary.page.size": str(8 << 20), "compression": "none"})
    twice = not repeated.where("exists(a, x -> x <> 0)").isEmpty()
    places = cut(word_places(lines))
    sets = scratch.stored(first_lines(described(by_rarity(lines, places), like)))
    # Pairs are stored before their sets are looked at, so that the words' shuffle is gone when the sets are shuffled.
    met = scratch.stored(lead_pairs(sets, like))
    leads = scratch.stored(likely(met, sets, like))
    # The most alike one of each first, then the next few of those that it doesn't settle. The join below has all that are left out here.
    turns = leads.withColumn("turn", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("alike"), "y"))).where(F.col("turn") <= TURNS)
    turns = scratch.stored(turns.select("x", "y", "turn"))
    scratch.drop(met, leads)
    settled = verified(turns.where("turn = 1").select("x", "y"), sets, lines, like, scratch, twice)
    rest = scratch.stored(turns.where("turn > 1").join(settled.select(F.col("id").alias("x")), "x", "left_anti").select("x", "y"))
    settled = settled.unionByName(verified(rest, sets, lines, like, scratch, twice))
    # Filters inferred for one use of the words would keep the other from sharing their shuffle.
    met = scratch.stored(other_pairs(sets, settled, like), spark__sql__constraintPropagation__enabled="false")
    others = scratch.stored(likely(met, sets, like))
    scratch.drop(met)
    gone = settled.unionByName(verified(others, sets, lines, like, scratch, twice)).withColumn("gone", F.lit(True))
    groups = sets.select("id", "h1", "h2", "rows", *[F.col(c).alias(f"first_{c}") for c in ("doc", "own", "line")]).join(gone, "id", "left")
    # Most sets have one line, and it stays: they need no second look.
    groups = groups.where("gone or rows > 1").drop("id", "rows")
    out = lines.select("doc", "own", "line", "h1", "h2").join(groups, ["h1", "h2"]).where("gone or doc <> first_doc or line <> first_line or own <> first_own")
    result = stored(out.groupBy("doc", "own").agg(F.sort_array(F.collect_set("line")).alias("removed")))
    scratch.drop()
    return result


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Similarity = Similarity(), with_text: bool = True) -> DataFrame:
    """Remove near-duplicate lines: append n_lines, n_removed and removed_lines, and take them out of the text.

    removed_lines has line numbers from 0. Without with_text the text column is
    dropped instead, and no text is shuffled. Columns of docs with these names
    are replaced; all others stay.

    A null text stays null with 0 lines; an empty one has one line without words,
    which stays. Null ids count as the smallest. Rows with one id and different
    texts are documents of their own; of their lines with one number, that of the
    text with the smaller hash is earlier. Rows equal in id and text are one
    document: the same lines go from each.
    """
    new = {"n_lines", "n_removed", "removed_lines"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    count = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(F.split(F.col(f"`{text}`"), "\n"))).cast("long")
    repeated = repeated_ids(docs, key)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if with_text or c != text]).alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), count.alias("n_lines"))
    rows = with_own(rows, "key", "text", repeated).select("row", "doc", "own", "n_lines")
    none = F.array().cast("array<int>")
    removed = duplicate_lines(docs, repeated, key, text, like)
    # Most documents lose no line: only the others' texts are shuffled.
    some, whole = parted(rows, removed.select("doc", F.col("own").alias("line")), "doc", "own")
    out = some.join(removed, ["doc", "own"], "left").select("row", "n_lines", F.coalesce("removed", none).alias("removed_lines"))
    out = out.unionByName(whole.select("row", "n_lines", none.alias("removed_lines")))
    out = out.select("row.*", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")
    if not with_text:
        return out
    stays = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda _, i: ~F.array_contains("removed_lines", i))
    return out.withColumn(text, F.when(F.size("removed_lines") > 0, F.array_join(stays, "\n")).otherwise(F.col(f"`{text}`")))
