"""The pipeline's stages against brute force, on rows with planted near copies, odd ids and benchmark passages."""

import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import sentencepiece
from test_line_ids import brute, signed
from test_near_copies import alike, shingle_set

TINY = "/root/testdata/sf0.001"


def good(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    if len(w) < 10 or 100 * len(again) > 20 * len(w):
        return False
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    chars, letters = sum(map(len, w)), re.findall("[A-Za-z]", t)
    return (
        10 * len(re.findall("[#*$%&|<>]", t)) <= len(w)
        and 2 * sum(x.isupper() for x in letters) <= len(letters)
        and 10 * (len(lines) - len(set(lines))) <= 5 * len(lines)
        and 2 * len(w) <= chars <= 15 * len(w)
    )


def found(t):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def windows(w, n):
    return {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if w else set()


def first_copies(rows):
    """Of each group the least (id, text hash); all rows without an id; rows equal in id and text once."""
    sets, group = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    named = {}
    for (i, t), g in zip(rows, group, strict=True):
        if i is not None:
            named[g] = min(named.get(g, (i, signed(t), t)), (i, signed(t), t))
    return [(i, t) for i, _, t in named.values()] + [x for x in rows if x[0] is None]


def test_all_stages_match_brute_force(spark):
    rng = random.Random(12)
    words = [a + b + c for a in ["b", "d", "f", "str", "kl"] for b in "aeiou" for c in ["k", "lm", "n", "pt", "r", "sch"]]
    wrap = lambda w, n: "\n".join(" ".join(w[a : a + n]) for a in range(0, len(w), n))
    items = [r.text for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    passage = max(items, key=len)
    texts, likeness = [], []
    for k in range(10):
        # Wrapped at other widths, copies have no lines in common but nearly the same shingles.
        base = [rng.choice(words) for _ in range(180)]
        texts.append(wrap(base, 12))
        for c, width in ((1, 17), (2, 23), (3, 29), (5, 37)):
            copy = list(base)
            for at in range(20, 20 + 30 * c, 30):
                copy[at] = "new" + rng.choice(words)
            texts.append(wrap(copy, width))
            s, o = shingle_set(texts[-1]), shingle_set(wrap(base, 12))
            likeness.append(len(s & o) / len(s | o))
    assert sum(0.8 <= x <= 0.95 for x in likeness) >= 20 and min(likeness) < 0.8
    texts += [wrap([rng.choice(words) for _ in range(60)] + passage.split() + [rng.choice(words)], 15), texts[0], "too short", "", None, "the same " * 40]
    ids = [i for i in range(len(texts))]
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    rows += [(5, wrap([rng.choice(words) for _ in range(40)], 10)), (None, wrap([rng.choice(words) for _ in range(40)], 10)), (None, texts[5]), rows[2]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    want = [x for x in rows if good(x[1])]
    gone = brute(want)
    lined = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i, t])) for i, t in want]
    kept = first_copies(lined)
    benchmark = [found(t) for t in items]
    leaks = {g for w in benchmark for g in windows(w, min(10, len(w)))}
    clean = [x for x in kept if not any(windows(found(x[1]), n) & leaks for n in {len(g) for g in leaks})]
    assert len(rows) > len(want) > len(kept) + 15 and len(kept) > len(clean)

    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], (want, lined, kept, clean), strict=True):
        docs = stage(spark, docs, TINY).cache()
        got = docs.collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter(expected), name
        assert all(r.n_chars == len(r.text) for r in got), name
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, TINY).collect()
    assert Counter((r.doc_id, r.text, tuple(r.piece_ids), r.n_pieces, r.round_trip) for r in last) == Counter((i, t, p := tuple(library.encode(t)), len(p), True) for i, t in clean)
