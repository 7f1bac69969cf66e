"""Line dedup of rows that share an id or have none, against brute force."""

import random
import re

import xxhash

from gleanery.llm import line_dedup


def signed(t):
    h = xxhash.xxh64_intdigest(t.encode(), 42)
    return h - (1 << 64) * (h >> 63)


def brute(rows):
    """{(id, text): removed line numbers}; rows equal in id and text are one."""
    seen, gone = [], {}
    for k, n, _, own, line in sorted((line_dedup.NO_ID if i is None else i, n, signed(t), (i, t), x) for i, t in set(rows) for n, x in enumerate(t.split("\n"))):
        s = frozenset(x for x in re.split("[\x20\x09-\x0d]+", line.lower()) if x)
        gone.setdefault(own, [])
        if s:
            if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone[own].append(n)
            seen.append(s)
    return gone


def test_null_and_repeated_ids_lose_only_their_own_lines(spark):
    rng = random.Random(6)
    words = [a + b + c for a in "bdfg" for b in "aeiou" for c in "klmn"]
    stock = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(30)]

    def line():
        return rng.choice(stock) if rng.random() < 0.3 else " ".join(rng.choice(words) for _ in range(12))

    rows = [(rng.choice([None, None, 3, 3, 7, k + 10]), "\n".join(line() for _ in range(rng.randint(1, 6)))) for k in range(60)]
    rows += [rows[0], rows[5], (None, "x one\ny two\nz three"), (None, "p four\nq five\nz three"), (3, ""), (None, "")]
    want = brute(rows)
    assert sum(map(len, want.values())) > 10
    got = line_dedup.dedup_lines(spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, was string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        lines = want[r.doc_id, r.was]
        assert r.removed_lines == lines, (r.doc_id, r.was)
        assert r.text == "\n".join(x for n, x in enumerate(r.was.split("\n")) if n not in lines)


def test_only_documents_that_lose_lines_are_shuffled(spark, monkeypatch):
    rng = random.Random(7)
    words = [a + b + c for a in "bdfg" for b in "aeiou" for c in "klmn"]
    rows = [(k, "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(3))) for k in range(40)]
    rows += [(50, rows[0][1]), (51, "one\n" + rows[1][1]), (None, rows[2][1])]
    want = {i: lines for (i, _), lines in brute(rows).items()}
    shuffled = []
    parted = line_dedup.parted

    def seen(df, *more):
        some, rest = parted(df, *more)
        shuffled.append(some.count())
        return some, rest

    monkeypatch.setattr(line_dedup, "parted", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.dedup_lines(docs).collect()
    assert {r.doc_id: r.removed_lines for r in got} == want and len(got) == len(rows)
    assert shuffled[-1] == sum(bool(x) for x in want.values())
