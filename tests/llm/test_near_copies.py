"""Near copies at a Jaccard similarity around 0.8, against brute force."""

import random
import re

from gleanery.llm import near_copies, simhash

WORDS = [a + b + c for a in "bdfg" for b in "aeiou" for c in "klmnprst"]


def shingle_set(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(s, o):
    return 5 * len(s & o) >= 4 * len(s | o)


def brute_first(rows):
    """Ids that stay: the least of each group that similar pairs join."""
    sets, group = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return sorted({min(rows[j][0] for j in range(len(rows)) if group[j] == group[i]) for i in range(len(rows))})


def planted(rng, copies=6):
    """Texts with copies of which some words are changed: Jaccard from about 0.7 to 0.97."""
    passage = " ".join(rng.choice(WORDS) for _ in range(40))
    texts = []
    for k in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(base) + (" " + passage if k % 2 else ""))
        for c in range(copies):
            other = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) * (c + 1) // 180)):
                other[at] = rng.choice(WORDS)
            texts.append(" ".join(other) + (" " + passage if k % 2 else ""))
    texts += ["", " \n", None, "one two", "ONE two", texts[0], "a b c d e f"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies_at_all_likenesses_match_brute_force(spark):
    rows = planted(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_first(rows)
    tight = sorted(r.doc_id for r in simhash.keep_first(docs, shingle=5, most=5).select("doc_id").collect())
    assert len(tight) > len(want)  # five bits leave near copies in
    got = near_copies.keep_first_copy(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == want


def test_common_shingles_only_change_the_order(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "OFTEN", 10**9)
    rows = planted(random.Random(8), copies=3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_first_copy(docs).collect()) == brute_first(rows)


def test_no_rows(spark):
    assert near_copies.keep_first_copy(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_of_one_id_with_unlike_texts_stay(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(rng.choice(WORDS) for _ in range(50)) for _ in range(3))
    rows = [(3, a), (3, b), (3, b), (4, b), (2, c), (3, c), (None, a)]
    got = near_copies.keep_first_copy(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted([(3, a), (3, b), (2, c), (-1, a)])


def test_texts_that_share_a_passage_alone_are_not_compared_whole(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage, base = text(30), text(100)
    # The passage holds rare shingles of each, so each is met with another.
    rows = list(enumerate([f"{text(45)} {passage} {text(45)}" for _ in range(40)] + [base, base + " more"]))
    made = []
    whole = near_copies.with_sets

    def seen(df, shingle):
        if "node" in df.columns:
            made.append(df.count())
        return whole(df, shingle)

    monkeypatch.setattr(near_copies, "with_sets", seen)
    got = near_copies.keep_first_copy(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == brute_first(rows) == list(range(41))
    assert sum(made) == 2


def test_rows_alone_with_their_text_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(60))) for i in range(30)]
    rows += [(40, rows[3][1]), rows[4], (None, rows[5][1]), (None, rows[5][1])]
    want = sorted(((i if i is not None else -1, t) for i, t in rows[:30] + rows[-2:]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shuffled = []
    parted = near_copies.parted

    def seen(df, *more):
        some, rest = parted(df, *more)
        shuffled.append((some.count(), df.columns))
        return some, rest

    monkeypatch.setattr(near_copies, "parted", seen)
    got = near_copies.keep_first_copy(docs)
    assert got.columns == docs.columns and sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in got.collect()) == want
    assert shuffled[-1][0] < 10
    # A full map only means more to shuffle.
    monkeypatch.setattr(near_copies, "parted", lambda df, *more: (df, df.limit(0)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in near_copies.keep_first_copy(docs).collect()) == want
