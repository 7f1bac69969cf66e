"""Removal of repeated substrings by prefix-free parsing.

A rolling hash over GRAM bytes cuts every text into phrases: the trigger of a
window of `length` bytes is the position in it whose hash is smallest, and a
phrase is a run of windows with one trigger. Phrases overlap by length - 1
bytes, so each window lies in exactly one phrase, and equal windows lie in
phrases with an equal trigger at an equal distance. The parse is the list of
phrase occurrences; the dictionary is the set of different phrases, each with
its first occurrence in corpus order. Windows of a phrase that occurs again
repeat whole; windows that two different phrases share are found in the suffix
array of the dictionary phrases that have a trigger in common. No comparison of
`length` bytes runs past a phrase, so the order of first occurrences stands in
for the suffix array of the parse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import slices

#: Bytes that the rolling hash covers: every window of a phrase holds them all.
GRAM = 32
U = np.uint64
MIX_1, MIX_2, BASE_1, BASE_2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
#: Bytes of text parsed at once, and of dictionary phrases ordered at once.
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20
#: Bits for a position in a shard; the rest of a trigger's hash decides which is smallest.
PLACE = 31
#: What a null id counts as.
NO_ID = -(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * MIX_2
    x ^= x >> U(29)
    x *= MIX_1
    x ^= x >> U(32)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """For each position the eight bytes that start there, big-endian; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(15, dtype=np.uint8)])
    out = np.zeros(len(data), dtype=np.uint64)
    for start in range(min(8, len(data))):
        n = (len(data) - start + 7) // 8
        out[start::8] = padded[start : start + 8 * n].view(">u8")
    return out


def ahead(x: np.ndarray, by: int) -> np.ndarray:
    """x moved `by` places to the front, zeros behind."""
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mixed hashes of 8 and of GRAM = 32 bytes at every position."""
    h8 = mix(eights(data) + MIX_1)
    h16 = mix(h8 * BASE_1 + ahead(h8, 8))
    return h8, mix(h16 * BASE_2 + ahead(h16, 16))


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i with a whole window."""
    got, span = x, 1
    while 2 * span <= width:
        got = np.minimum(got[:-span], got[span:]) if len(got) > span else got[:0]
        span *= 2
    rest = width - span
    return np.minimum(got[: len(got) - rest], got[rest:]) if rest and len(got) > rest else got if not rest else got[:0]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i below n."""
    known = _POWERS.get(int(base))
    if known is None or len(known[0]) < n:
        size = max(n, SHARD_BYTES + 1)
        up, down = np.full(size, base, dtype=np.uint64), np.full(size, U(pow(int(base), -1, 1 << 64)), dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[int(base)] = known = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return known


def span_hash(symbols: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end], equal for equal spans wherever they lie."""
    up, down = powers(len(symbols) + 1, base)
    total = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def parse(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Phrases of texts: (text, first byte, windows, trigger hash, content hash, second content hash)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n_windows = len(data) - length + 1
    empty = np.zeros(0, dtype=np.int64)
    if n_windows <= 0:
        return empty, empty, empty, empty, empty, empty
    h8, h32 = gram_hashes(data)
    begin = np.cumsum(sizes) - sizes
    # The place breaks ties between equal hashes: the first trigger of a window counts.
    keyed = ((h32 >> U(PLACE)) << U(PLACE)) | np.arange(len(data), dtype=np.uint64)
    trigger = window_minimum(keyed[: len(data) - GRAM + 1], length - GRAM + 1)
    whole = np.zeros(n_windows + 1, dtype=np.int64)
    long_ = sizes >= length
    np.add.at(whole, begin[long_], 1)
    np.add.at(whole, begin[long_] + sizes[long_] - length + 1, -1)
    inside = np.cumsum(whole[:-1]) > 0
    new = inside.copy()
    new[1:] &= (trigger[1:] != trigger[:-1]) | ~inside[:-1]
    new[begin[long_]] = True
    starts = np.flatnonzero(new)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | new[1:]
    stops = np.flatnonzero(last) + 1
    at = (trigger[starts] & U((1 << PLACE) - 1)).astype(np.int64)
    text = np.searchsorted(begin, starts, side="right") - 1
    ends = stops + length - 1
    # A span of grams of eight bytes spells the phrase when it stops seven bytes before its end.
    first, second = (span_hash(h8, base, starts, ends - 7) for base in (BASE_1, BASE_2))
    return text, starts - begin[text], stops - starts, h32[at].view(np.int64), first.view(np.int64), second.view(np.int64)


PHRASES = "kind int, trigger long, content long, content2 long, d long, h long, start long, n long"
MARKS = "d long, h long, kind int, start long, n long, trigger long"
REPEAT, PHRASE = 1, 0


def runs(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the intervals of each owner: sorted, apart from each other."""
    by = np.lexsort((start, owner))
    owner, start, end = owner[by], start[by], end[by]
    if not len(owner):
        return owner, start, end
    # Owners far apart on one axis make a single running maximum enough.
    shift = (np.cumsum(np.concatenate([[0], owner[1:] != owner[:-1]]))) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:] - 1, [len(new) - 1]])
    return owner[at], start[at], (reach - shift)[last]


def table(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, {"int": pa.int32(), "long": pa.int64()}[k]) for c, k in zip(columns, kinds, strict=True)], names=names)


def parse_rows(length: int):
    """(d, h, text) to phrase occurrences, each content once a shard; its repeats there are settled as spans."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SHARD_BYTES):
                d, h = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                # Parts of one long text stay whole; texts below the length have no window.
                texts = part.column(2).cast(pa.large_binary()).to_pylist()
                text, start, n, trigger, content, content2 = parse(texts, length)
                if not len(text):
                    continue
                by = np.lexsort((start, h[text], d[text], content2, content, trigger))
                text, start, n, trigger, content, content2 = (x[by] for x in (text, start, n, trigger, content, content2))
                first = np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (content[1:] != content[:-1]) | (content2[1:] != content2[:-1])])
                lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
                twin = (d[text] == d[text[lead]]) & (h[text] == h[text[lead]]) & (start == start[lead])
                again = ~first & ~twin
                owner, low, high = runs(text[again], start[again], start[again] + n[again] + length - 1)
                zero = np.zeros(len(owner), dtype=np.int64)
                yield table([zero + REPEAT, h[owner], zero, zero, d[owner], h[owner], low, high - low], PHRASES)
                yield table([np.zeros(int(first.sum()), dtype=np.int64) + PHRASE, trigger[first], content[first], content2[first], d[text[first]], h[text[first]], start[first], n[first]], PHRASES)

    return rows


def settle_rows(length: int):
    """Sorted phrase occurrences to spans that repeat, and to phrases that another phrase with the trigger may share windows with.

    Keeps one row from batch to batch, whatever the size of a group.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None
        joined = False  # whether the carried phrase has its trigger from the phrase before
        for batch in batches:
            kind, *columns = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(8))
            done = kind == REPEAT
            if done.any():
                _, _, _, d, h, start, n = (c[done] for c in columns)
                zero = np.zeros(len(d), dtype=np.int64)
                yield table([d, h, zero + REPEAT, start, n, zero], MARKS)
            if done.all():
                continue
            columns = [c[~done] for c in columns]
            known = carry is not None
            if known:
                columns = [np.concatenate(x) for x in zip(carry, columns, strict=True)]
            trigger, content, content2, d, h, start, n = columns
            first = np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (content[1:] != content[:-1]) | (content2[1:] != content2[:-1])])
            lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            again = ~first & ~((d == d[lead]) & (h == h[lead]) & (start == start[lead]))
            zero = np.zeros(int(again.sum()), dtype=np.int64)
            yield table([d[again], h[again], zero + REPEAT, start[again], n[again] + length - 1, zero], MARKS)
            at = np.flatnonzero(first)
            before = np.concatenate([[joined], trigger[at[1:]] == trigger[at[:-1]]])
            shared = at[:-1][before[:-1] | before[1:]]
            yield table([d[shared], h[shared], np.full(len(shared), PHRASE), start[shared], n[shared], trigger[shared]], MARKS)
            carry, joined = [c[at[-1:]] for c in columns], bool(before[-1])
        if joined:
            trigger, _, _, d, h, start, n = carry
            yield table([d, h, np.full(1, PHRASE), start, n, trigger], MARKS)

    return rows


def phrase_rows(length: int):
    """Documents with their marks to the bytes of the phrases marked as shared."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["trigger", "d", "h", "start", "n", "bytes"]
        for batch in batches:
            for part in slices(batch, 2, SHARD_BYTES):
                out: list[list] = [[] for _ in names]
                for d, h, text, marks in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    data = text.encode()
                    for m in marks:
                        piece = data[m["start"] : m["start"] + m["n"] + length - 1]
                        for column, x in zip(out, (m["trigger"], d, h, m["start"], m["n"], piece), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:5]), pa.array(out[5], pa.binary())], names=names)

    return rows


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Dense ranks of all suffixes by their first `length` bytes, by prefix doubling."""
    rank, span = np.unique(eights(data), return_inverse=True)[1], min(8, length)
    while span < length:
        step = min(span, length - span)
        rank = np.unique(rank * (int(rank.max()) + 2) + ahead(rank + 1, step), return_inverse=True)[1]
        span += step
    return rank


def shared_windows(rows: list[np.ndarray], pieces: list[bytes], length: int) -> pa.RecordBatch:
    """Windows that lie in several dictionary phrases: all but the first in corpus order, as spans."""
    _, d, h, start, n = rows
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    rank = suffix_ranks(np.frombuffer(b"".join(pieces), dtype=np.uint8), length)
    piece = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    window = rank[begin[piece] + offset]
    at = start[piece] + offset
    by = np.lexsort((at, h[piece], d[piece], window))
    window, place = window[by], (d[piece][by], h[piece][by], at[by])
    first = np.ones(len(by), dtype=bool)
    first[1:] = window[1:] != window[:-1]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    # Rows equal in id and text give one place several times: that is no repeat of the row that stays.
    again = np.zeros(len(by), dtype=bool)
    again[by] = ~first & ~np.logical_and.reduce([x == x[lead] for x in place])
    owner, low, high = runs(piece[again], at[again], at[again] + length)
    zero = np.zeros(len(owner), dtype=np.int64)
    return table([d[owner], h[owner], zero + REPEAT, low, high - low, zero], MARKS)


def dictionary_rows(length: int):
    """Phrases sorted by trigger to spans; whole triggers are gathered up to BLOCK_BYTES."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 5
        pieces: list[bytes] = []
        for batch in batches:
            held = [np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(held)]
            pieces += batch.column(5).to_pylist()
            changes = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
            ends = np.cumsum([len(p) for p in pieces])
            cut = 0
            while (rest := changes[changes > cut]).size:
                full = np.flatnonzero(ends[rest - 1] - (ends[cut - 1] if cut else 0) <= BLOCK_BYTES)
                upto = int(rest[full[-1]] if full.size else rest[0])
                yield shared_windows([x[cut:upto] for x in held], pieces[cut:upto], length)
                cut = upto
            held, pieces = [x[cut:] for x in held], pieces[cut:]
        if pieces:
            yield shared_windows(held, pieces, length)

    return rows


def result_rows(length: int, with_bytes: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept_bytes"] * with_bytes]
        for batch in batches:
            for part in slices(batch, 2):
                out: list[list] = [[] for _ in range(7)]
                for d, text, copy, *marks in zip(*(part.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                    data = (text or "").encode()
                    if copy > 1:
                        spans = [(0, len(data))] if len(data) >= length else []
                    else:
                        spans = union([(m["start"], m["start"] + m["n"]) for x in marks for m in x or ()])
                    kept, end = [], 0
                    for a, b in spans:
                        kept.append(data[end:a])
                        end = b
                    kept = b"".join([*kept, data[end:]])
                    values = (None if d == NO_ID else d, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [x for s in spans for x in s], kept)
                    for column, x in zip(out, values, strict=True):
                        column.append(x)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)][: len(names)], names=names)

    return rows


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", with_bytes: bool = False) -> DataFrame:
    """Remove every byte that a `length`-byte string covers which also starts earlier in the corpus.

    Texts count as UTF-8 bytes; strings never cross documents; the corpus order
    is by id, then by place. Strings are judged on the input. Returns doc_id,
    n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans (start
    and end of each run, flat) and, with_bytes, the kept bytes. Other columns are
    left out.

    A null text counts as empty. A null id counts as the smallest. Rows with
    equal ids and different texts are ordered by a hash of the text; of rows
    equal in both, one stands first and the others are removed whole, if they
    have `length` bytes. Two different phrases count as equal if three 64-bit
    hashes are (one of the trigger, two of the content).

    Each task settles repeats within its shards, so that a phrase reaches the
    shuffle at most once a shard however common it is; what follows reads sorted
    rows and holds one phrase at a time. Phrases are compared byte by byte only
    where different ones share a trigger. Needs length > GRAM.
    """
    if length <= GRAM:
        raise ValueError(f"length must exceed {GRAM}")
    source = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID)).alias("d"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("h"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    order = ["kind", "trigger", "content", "content2", "d", "h", "start"]
    occurrences = source.mapInArrow(parse_rows(length), PHRASES).repartition("trigger").sortWithinPartitions(*order)
    marks = occurrences.mapInArrow(settle_rows(length), MARKS)
    mark = F.struct("kind", "start", "n", "trigger")
    by_doc = marks.groupBy("d", "h").agg(F.collect_list(mark).alias("marks"))
    marked = source.join(by_doc, ["d", "h"], "left")
    shared = marked.select("d", "h", "text", F.filter("marks", lambda m: m["kind"] == PHRASE).alias("shared")).where(F.size("shared") > 0)
    phrases = shared.mapInArrow(phrase_rows(length), "trigger long, d long, h long, start long, n long, bytes binary")
    windows = phrases.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(dictionary_rows(length), MARKS)
    more = windows.groupBy("d", "h").agg(F.collect_list(mark).alias("more"))
    copy = F.row_number().over(Window.partitionBy("d", "h").orderBy("d"))
    full = marked.withColumn("copy", copy).join(more, ["d", "h"], "left")
    final = full.select("d", "h", "text", "copy", F.filter("marks", lambda m: m["kind"] == REPEAT).alias("marks"), "more")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>" + ", kept_bytes binary" * with_bytes
    return final.mapInArrow(result_rows(length, with_bytes), schema)
