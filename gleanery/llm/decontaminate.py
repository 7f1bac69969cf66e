"""Benchmark decontamination by suffix arrays over shards of the training text."""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import BOOLEAN, LONG, STRING, fields, map_texts
from gleanery.llm.suffixes import known_run, search, spread, suffix_array

#: ASCII digits and letters and every byte of other characters, of text with A-Z lower-cased.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class TestSet:
    """Some benchmark items as word ids, and all their suffixes as queries."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        texts = [(name, ws) for name, text in items if (ws := words_of(text))]
        vocabulary = sorted({w for _, ws in texts for w in ws})
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.names = sorted({name for name, _ in texts})
        rank = {name: i for i, name in enumerate(self.names)}
        lengths = np.array([len(ws) for _, ws in texts], dtype=np.int64)
        self.words = np.array([self.ids[w] for _, ws in texts for w in ws], dtype=np.int64)
        self.item = np.repeat(np.array([rank[n] for n, _ in texts], dtype=np.int64), lengths)
        ends = np.repeat(np.cumsum(lengths), lengths)
        self.left = ends - np.arange(len(self.words))
        own_window = np.repeat(np.minimum(lengths, window), lengths)
        # A suffix shorter than its item's window can't start an occurrence.
        self.starts = np.flatnonzero(self.left >= own_window)
        self.window = own_window[self.starts]
        self.longest = int(lengths.max(initial=0))
        self.shortest = int(self.window.min(initial=window))


def word_ids(texts: list[str | None], ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words of all texts, a 0 after each text, and how many there are of each with its 0.

    Words are objects for one text at a time: those of a whole shard take many times the memory of its text.
    """
    out, sizes = array("i"), []
    for t in texts:
        found = words_of(t)
        out.extend(map(ids.get, found, repeat(0)))
        out.append(0)
        sizes.append(len(found) + 1)
    return np.frombuffer(out, dtype=np.int32), np.array(sizes, dtype=np.int64)


def scan_marks(ids: np.ndarray, sizes: np.ndarray, tests: TestSet) -> tuple[np.ndarray, dict[int, set[int]], np.ndarray]:
    """One shard, as word_ids gives it: hit marks of all words, items by document, longest match by document."""
    hits, items, longest = np.zeros(len(ids), dtype=bool), {}, np.zeros(len(sizes), dtype=np.int64)
    starts = np.flatnonzero(known_run(ids) >= tests.shortest) if tests.starts.size else np.zeros(0, dtype=np.int64)
    if len(starts):
        ends, marks = np.cumsum(sizes), np.zeros(len(ids) + 1, dtype=np.int32)
        of = lambda at: np.searchsorted(ends, at, "right")
        padded = np.concatenate([ids, np.zeros(tests.longest, dtype=ids.dtype)])
        order = suffix_array(ids, starts, tests.longest)
        for depth, query, low, high, below in search(padded, order, tests):
            # Suffixes that agree so far share a range: one look at it is enough.
            whole = tests.window[query] == depth
            rank, which = np.unique(low[whole], return_inverse=True)
            at, part = spread(rank, high[whole][first_of(which)])
            begin = order[at]
            np.add.at(marks, begin, 1)
            np.add.at(marks, begin + depth, -1)
            by_range: list[set[int]] = [set() for _ in rank]
            for r, i in zip(which.tolist(), tests.item[tests.starts[query[whole]]].tolist(), strict=True):
                by_range[r].add(i)
            for d, r in np.unique(np.stack([of(begin), part], axis=1), axis=0).tolist():
                items.setdefault(d, set()).update(by_range[r])
            # Occurrences that go no deeper end here, at both edges of what does.
            deep = tests.window[query] <= depth
            edges = np.concatenate([np.stack([low, below[0]], axis=1)[deep], np.stack([below[1], high], axis=1)[deep]])
            at, _ = spread(*np.unique(edges[edges[:, 0] < edges[:, 1]], axis=0).T)
            longest[of(order[at])] = depth
        hits = np.cumsum(marks[:-1], dtype=np.int32) > 0
    return hits, items, longest


def first_of(which: np.ndarray) -> np.ndarray:
    """The first place of each number from 0 on."""
    return np.unique(which, return_index=True)[1]


def test_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list:
    """The benchmark in broadcast blocks of a checked size: as many blocks as it takes."""
    context, blocks, block, size = benchmark.sparkSession.sparkContext, [], [], 0
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text}`").alias("t"))
    for row in rows.toLocalIterator():
        if block and size + len(row.t or "") > block_bytes:
            blocks.append(context.broadcast(block))
            block, size = [], 0
        block.append((row.i, row.t))
        size += len(row.t or "")
    return [*blocks, context.broadcast(block)]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = 16 << 20,
    shard_bytes: int = 16 << 20,
) -> DataFrame:
    """Append what each document shares with the benchmark; no row moves.

    A window is `window` consecutive words of an item; an item of fewer words,
    but not none, is one window. Appends n_words, n_hit (words inside an
    occurrence of a window), n_items (items with occurring windows),
    items_sha256 (of their ids, sorted as strings, comma-joined), longest_match
    (words of the longest verbatim match, 0 below a window) and contaminated
    (n_hit > 0). Columns of docs with these names are replaced.

    Null and empty texts have no words and no hits. Items without words match
    nothing; items with equal ids count once; a null id counts as ''. An empty
    benchmark leaves every document clean.

    Each run of rows of about shard_bytes of text is a shard with a suffix array
    of its own over word ids; words that no item has are 0 and end a match, and
    suffixes with fewer known words than the shortest window are left out. All
    suffixes of all items are binary-searched in every shard, block by block.
    """
    blocks = test_blocks(benchmark, item, item_text, block_bytes)

    def make():
        only = TestSet(blocks[0].value, window) if len(blocks) == 1 else None

        def work(texts: list[str | None]) -> list[list]:
            names: list[set[str]] = [set() for _ in texts]
            covered, longest = False, np.zeros(len(texts), dtype=np.int64)
            for block in blocks:
                tests = only or TestSet(block.value, window)
                ids, sizes = word_ids(texts, tests.ids)
                hits, found, deepest = scan_marks(ids, sizes, tests)
                covered = hits | covered
                longest = np.maximum(longest, deepest)
                for d, ranks in found.items():
                    names[d].update(tests.names[i] for i in ranks)
            n_hit = np.add.reduceat(covered, np.cumsum(sizes) - sizes, dtype=np.int64).tolist()
            digest = [hashlib.sha256(",".join(sorted(n)).encode()).hexdigest() for n in names]
            return [(sizes - 1).tolist(), n_hit, [len(n) for n in names], digest, longest.tolist(), [n > 0 for n in n_hit]]

        return work

    made = fields(n_words=LONG, n_hit=LONG, n_items=LONG, items_sha256=STRING, longest_match=LONG, contaminated=BOOLEAN)
    return map_texts(docs, make, made, text, shard_bytes)
