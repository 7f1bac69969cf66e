"""Features read whole texts."""

import random

from gleanery.llm import quality_model

AT = quality_model.FEATURES.index("distinct_words")


def test_variety_reads_past_the_first_200_words():
    rng = random.Random(2)
    head = [f"word{i}" for i in range(200)]
    tail = [f"other{i}" for i in range(200)]
    value = lambda w: quality_model.features(" ".join(w))[AT]
    assert value(head) == value(head + tail) == 1.0
    assert value(head + ["junk"] * 200) == (1.0 + 1 / 200) / 2
    assert value(head + ["junk"] * 50) == (1.0 + 151 / 200) / 2
    assert value(head + tail + ["junk", "junk"]) < 1.0
    assert value(["a", "b", "a", "a"]) == 0.5
    long = [f"w{rng.randint(0, 999)}" for _ in range(20_000)]
    assert abs(value(long) - value(long[:1000])) < 0.03
