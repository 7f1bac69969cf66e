"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that the worker doesn't know yet are laid one after another
and indexed by a suffix array; every piece of the model is binary-searched in it,
which gives its occurrences as a range. Each occurrence is an edge from where it
starts to where it ends. Edges are sorted by the place of their end in the word
and relaxed in that order, all words at once.

The model merges pairs by score (BPE), so the path wanted isn't the one of the
highest sum: it is the one on which no two neighbours would have been merged
across their border. For each place there is one such last piece, so relaxing
keeps the edge whose piece may follow the last piece at its start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import INT, fields, give_back, map_texts
from gleanery.llm.suffixes import Patterns, packed_keys, sort_suffixes, spread
from gleanery.llm.token_count import SPACE, check_model, pretokens

NEVER = np.iinfo(np.int64).max
#: Bits of the tables of fixed size that pairs of pieces are looked up in.
SLOT_BITS = 20


class Pieces:
    """The model's pieces as symbol ids, with what relaxing needs to know of their merges."""

    def __init__(self, processor):
        check_model(processor)
        self.size = processor.get_piece_size()
        kinds = [processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i) for i in range(self.size)]
        text = {i: processor.id_to_piece(i) for i in range(self.size) if not kinds[i]}
        by_text = {p: i for i, p in text.items()}
        self.unknown = self.size
        # Rank of the merge that makes a piece: the higher its score, the earlier. A single character needs none.
        self.rank = np.full(self.size + 1, -1, dtype=np.int64)
        merged = sorted((i for i, p in text.items() if len(p) > 1), key=lambda i: -processor.get_score(i))
        self.rank[merged] = np.arange(len(merged))
        self.left, self.right = np.arange(self.size + 1), np.arange(self.size + 1)
        rank = self.rank.tolist()
        usable = []
        for i, p in text.items():
            last = self.last_merge(p, by_text, rank)
            if last is not None:
                self.left[i], self.right[i] = last if last else (i, i)
                usable.append(i)
        joins = {}
        for i, p in text.items():
            for k in range(1, len(p)):
                a, b = by_text.get(p[:k]), by_text.get(p[k:])
                if a is not None and b is not None:
                    joins[a * (self.size + 1) + b] = rank[i]
        self.join_keys = np.array(sorted(joins), dtype=np.int64)
        self.join_ranks = np.array([joins[k] for k in sorted(joins)], dtype=np.int64)
        self.joined = np.zeros(1 << SLOT_BITS, dtype=bool)
        self.joined[self.slots(self.join_keys)] = True
        self.asked, self.answers = np.full(1 << SLOT_BITS, -1, dtype=np.int64), np.zeros(1 << SLOT_BITS, dtype=bool)
        characters = sorted({c for p in text.values() for c in p})
        self.codes = np.array([ord(c) for c in characters], dtype=np.uint32)
        code = {c: i + 1 for i, c in enumerate(characters)}
        lengths = np.array([len(text[i]) for i in usable], dtype=np.int64)
        words = np.array([code[c] for i in usable for c in text[i]], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        self.bits = max(1, len(characters).bit_length())
        self.patterns = Patterns(words, starts, lengths, self.bits)
        self.usable, self.lengths = np.array(usable, dtype=np.int32), lengths.astype(np.int32)
        self.bytes = np.array([processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)

    @staticmethod
    def last_merge(piece: str, by_text: dict[str, int], rank: list[int]) -> tuple[int, ...] | None:
        """The two pieces last merged into this one; () for one character; None if merging its text ends elsewhere."""
        parts, last = list(piece), ()
        while len(parts) > 1:
            options = [(rank[by_text[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in by_text]
            if not options:
                return None
            _, i = min(options)
            last = (by_text.get(parts[i], -1), by_text.get(parts[i + 1], -1))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return last if -1 not in last else None

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of a and b together leaves exactly a and b. Remembers what was asked, an answer a slot."""
        key = a.astype(np.int64) * (self.size + 1) + b
        slot = self.slots(key)
        apart = self.answers[slot]
        new = np.flatnonzero(self.asked[slot] != key)
        apart[new] = self.borders(key[new])
        self.asked[slot[new]], self.answers[slot[new]] = key[new], apart[new]
        # Of two keys for one slot either may have left its answer there.
        mixed = new[self.asked[slot[new]] != key[new]]
        self.asked[slot[mixed]] = -1
        return apart

    @staticmethod
    def slots(key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def borders(self, key: np.ndarray) -> np.ndarray:
        """For pairs (a, b) as numbers: undoes the later merge of the two pieces at the border, again and again.

        A merge across the border must not come before the merge undone last. Of
        two merges of one rank the left one comes first.
        """
        apart, at, limit = np.ones(len(key), dtype=bool), np.arange(len(key)), np.full(len(key), NEVER)
        a, b = np.divmod(key, self.size + 1)
        while len(at):
            key = a * (self.size + 1) + b
            maybe = np.flatnonzero(self.joined[self.slots(key)])
            place = np.minimum(np.searchsorted(self.join_keys, key[maybe]), len(self.join_keys) - 1)
            crossing = np.zeros(len(key), dtype=bool)
            crossing[maybe] = np.where(self.join_keys[place] == key[maybe], self.join_ranks[place], NEVER) < limit[maybe]
            apart[at[crossing]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            more = ~crossing & ((rank_a >= 0) | (rank_b >= 0))
            at, a, b, rank_a, rank_b = at[more], a[more], b[more], rank_a[more], rank_b[more]
            left = rank_a > rank_b
            limit = np.where(left, rank_a, rank_b + 1)
            a, b = np.where(left, self.right[a], a), np.where(left, b, self.left[b])
        return apart

    def encode(self, words: list[str]) -> list[bytes]:
        """For each word its ids, as 32-bit numbers in the machine's order."""
        sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        points = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        place = np.minimum(np.searchsorted(self.codes, points), len(self.codes) - 1)
        ids = np.where(self.codes[place] == points, place + 1, 0)
        ids[begin + sizes - 1] = 0
        longest = self.patterns.longest
        keys = packed_keys(ids, longest, self.bits)
        array = sort_suffixes(keys, np.flatnonzero(ids > 0), longest, self.patterns.per_key).astype(np.int32)
        inside = np.ones(len(ids), dtype=bool)
        inside[begin + sizes - 1] = False
        lone = np.flatnonzero((ids == 0) & inside).astype(np.int32)
        query, low, high = self.patterns.search(keys, array)
        at, which = spread(low, high)
        query = query[which]
        start = np.concatenate([lone, array[at]])
        piece = np.concatenate([np.full(len(lone), self.unknown, dtype=np.int32), self.usable[query]])
        span = np.concatenate([np.ones(len(lone), dtype=np.int32), self.lengths[query]])
        del keys, array, at, which, query, place, ids
        origin = np.repeat(begin, sizes).astype(np.int32)
        reach = start + span - origin[start]
        by = np.argsort(reach, kind="stable")
        start, piece, span, reach = start[by], piece[by], span[by], reach[by]
        del by
        last, back = np.full(len(points) + 1, -1, dtype=np.int32), np.zeros(len(points) + 1, dtype=np.int32)
        edges = np.searchsorted(reach, np.arange(1, int(reach.max(initial=0)) + 2))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            s, p = start[low:high], piece[low:high]
            before = last[s]
            good = s == origin[s]
            inner = np.flatnonzero(~good & (before >= 0))
            good[inner] = self.stay_apart(before[inner], p[inner])
            # Place s belongs to the border before it, so a word's first border is free of the word before.
            e = s[good] + span[low:high][good]
            last[e], back[e] = p[good], s[good]
        return self.paths(words, points, begin, sizes, last, back)

    def paths(self, words, points, begin, sizes, last, back) -> list[bytes]:
        """Follow the kept edges back from the end of all words at once."""
        at, word = begin + sizes - 1, np.arange(len(words))
        owners, ends, found = [], [], []
        while True:
            open_ = at > begin[word]
            at, word = at[open_], word[open_]
            if not len(at):
                break
            owners.append(word)
            ends.append(at)
            found.append(last[at])
            at = back[at]
        if not owners:
            return [b""] * len(words)
        owner, end, piece = map(np.concatenate, (owners, ends, found))
        by = np.argsort(end, kind="stable")
        owner, end, piece = owner[by], end[by], piece[by]
        lone = np.flatnonzero(piece == self.unknown)
        counts = np.ones(len(piece), dtype=np.int64)
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in points[end[lone] - 1].tolist()]
        counts[lone] = [len(x) for x in spelled]
        out = np.repeat(piece, counts).astype(np.int32)
        first = np.cumsum(counts) - counts
        for i, x in zip(first[lone].tolist(), spelled, strict=True):
            out[i : i + len(x)] = self.bytes[np.frombuffer(x, dtype=np.uint8)]
        stops = np.cumsum(np.bincount(owner, weights=counts, minlength=len(words)).astype(np.int64)) * 4
        raw = out.tobytes()
        return [raw[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist(), strict=False)]


def spelling(processor) -> list[bytes]:
    """What each id stands for in a decoded text."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif processor.is_control(i):
            out.append(b"")
        elif processor.is_unknown(i):
            out.append(" ⁇ ".encode())
        else:
            out.append(piece.replace(SPACE, " ").encode())
    return out


def decode(ids: list[int], table: list[bytes]) -> str:
    """The text of some ids, without the space that encoding put before it."""
    data = b"".join(map(table.__getitem__, ids))
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def blocks_of(words: list[str], most: int) -> Iterator[list[str]]:
    """Runs of words of about `most` characters; a longer word is a run of its own."""
    block, size = [], 0
    for w in words:
        if block and size + len(w) > most:
            yield block
            block, size = [], 0
        block.append(w)
        size += len(w) + 1
    if block:
        yield block


def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@lru_cache(maxsize=2)
def pieces_of(model: str) -> Pieces:
    """Kept by the worker from task to task."""
    return Pieces(load(model))


def encode_texts(
    docs: DataFrame,
    model: str,
    text: str = "text",
    ids: str = "piece_ids",
    cache_entries: int = 120_000,
    block_chars: int = 150_000,
) -> DataFrame:
    """Append ids: array<int>, the ids of each whole text, as the model's own library gives them.

    No begin, end or added tokens; characters the model lacks become bytes. Null
    and empty texts have no ids. A column of docs named like ids is replaced. No
    row moves. Words known to the worker come from its cache of about
    cache_entries entries, of which the half not asked for lately goes at a time;
    new ones are matched in blocks of about block_chars.
    """

    def make() -> Callable:
        pieces, recent, older = pieces_of(model), {}, {}

        def work(texts: list[str | None]) -> list:
            nonlocal recent, older
            if len(recent) > cache_entries // 2:
                recent, older = {}, recent
            parts = [pretokens(t) if t else [] for t in texts]
            fresh = set().union(*parts).difference(recent)
            known = fresh.intersection(older)
            recent.update((w, older[w]) for w in known)
            missing = list(fresh.difference(known))
            for block in blocks_of(missing, block_chars):
                recent.update(zip(block, pieces.encode(block), strict=True))
            raw = [b"".join(map(recent.__getitem__, p)) for p in parts]
            for w in missing:
                if len(w) > 64:
                    del recent[w]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), dtype=np.int32)))]

        return work

    return map_texts(docs, make, fields(**{ids: T.ArrayType(INT)}), text, 2 << 20)


def decode_ids(docs: DataFrame, model: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """Append the text that each array of ids stands for; null ids give null, none an empty text.

    Bytes that are no UTF-8 become U+FFFD. A column of docs named like text is
    replaced. No row moves.
    """
    table = spelling(load(model))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("string")
    def as_text(column: pd.Series) -> pd.Series:
        texts = column.map(lambda x: None if x is None else decode(x.tolist(), shared.value))
        give_back()
        return texts

    return docs.withColumn(text, as_text(F.col(f"`{ids}`")))
