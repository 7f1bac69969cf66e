"""What a Python worker holds of a shard of text, and that it gives it back."""

import random
import tracemalloc
from types import SimpleNamespace

import pytest
from gleanery.llm import decontaminate


def worker(monkeypatch, items, **more):
    """The function that find_contamination runs in a task."""
    made = []
    monkeypatch.setattr(decontaminate, "map_texts", lambda docs, make, *_: made.append(make()))
    monkeypatch.setattr(decontaminate, "test_blocks", lambda *_: [SimpleNamespace(value=b) for b in items])
    decontaminate.find_contamination(None, None, **more)
    return made[0]


@pytest.mark.parametrize("split", [False, True])
def test_a_shard_takes_little_more_than_its_text(monkeypatch, split):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(3000)]
    item = [rng.choice(words) for _ in range(30)]
    items = [("a", " ".join(item)), ("b", " ".join(rng.choices(words, k=12)))]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(1000)]
    texts[7] += " " + " ".join(item[3:15])
    texts[9:12] = [None, "", items[1][1]]
    work = worker(monkeypatch, [items[:1], items[1:]] if split else [items])
    tracemalloc.start()
    n_words, n_hit, n_items, _, longest, contaminated = work(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # With an object for each word it took over 14 times the text.
    assert peak < 8 * sum(len(t or "") for t in texts)
    assert n_words[7:12] == [412, 400, 0, 0, 12]
    assert {i: (n_hit[i], n_items[i], longest[i]) for i, c in enumerate(contaminated) if c} == {7: (12, 1, 12), 11: (12, 1, 12)}
