"""The order of words in line dedup."""

from collections import Counter

import xxhash

from gleanery.llm import line_dedup


def test_prefixes_hold_the_rarest_words(spark):
    texts = [" ".join(f"w{k}" for k in range(30) if i % (k + 1) == 0) for i in range(1, 400)]
    lines = spark.createDataFrame([(i, 0, 0, t) for i, t in enumerate(texts)], "doc long, own long, line int, s string")
    ranked = line_dedup.ranked(lines, line_dedup.cut(line_dedup.rarity(lines))).select("doc", "words").collect()
    count = Counter(w for t in texts for w in t.split())
    rest = {(h := xxhash.xxh64_intdigest(w.encode(), 42)) >> line_dedup.RARITY_BITS: (h, n) for w, n in count.items()}
    assert len(rest) == len(count) == len({h & 0xFFFF for h, _ in rest.values()})
    for r in ranked:
        numbers = [rest[w & (1 << 64 - line_dedup.RARITY_BITS) - 1][1] for w in r.words]
        assert len(numbers) == len(texts[r.doc].split()) and numbers == sorted(numbers)


def test_common_places_come_last(spark):
    """Places on both sides of the middle of the range: the word of the last place sorts last."""
    size = 1 << line_dedup.RARITY_BITS
    places = spark.range(size).selectExpr("array_agg(id) AS a")
    places = line_dedup.cut(places.selectExpr("array_sort(a) AS a"))
    words = [f"w{i}" for i in range(200)]
    lines = spark.createDataFrame([(1, 0, 0, " ".join(words))], "doc long, own long, line int, s string")
    got = line_dedup.ranked(lines, places).first().words
    want = sorted((xxhash.xxh64_intdigest(w.encode(), 42) & (size - 1) for w in words))
    assert [(w >> (64 - line_dedup.RARITY_BITS)) + size // 2 for w in got] == want


def test_packed_words_come_back(spark):
    rows = [(7, n, pos, open_) for n, pos in ((1, 0), (10, 9), (70_000, 14_000), (2**31 - 1, 2**30)) for open_ in (0, 1)]
    words = spark.createDataFrame(rows, "word int, n int, pos int, open int")
    packed = line_dedup.packed(words, "open")
    assert packed.columns == ["word", "at"]
    assert sorted(map(tuple, line_dedup.unpacked(packed, "open").select("word", "n", "pos", "open").collect())) == sorted(rows)
    plain = line_dedup.packed(words.drop("open"))
    cell = line_dedup.of_packed(lambda c: plain[c])
    assert sorted(map(tuple, plain.select(cell("n"), cell("pos")).collect())) == sorted(r[1:3] for r in rows)
