"""Token counts by a two-tier lookup of pre-token lengths."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import BOOLEAN, LONG, fields, map_texts, slices

#: A pre-token: a run of the space mark and what follows up to the next mark. No
#: piece has a mark after another character, so merges never cross its borders.
SPACE = "▁"
PRETOKEN = re.compile(f"{SPACE}+[^{SPACE}]*")


def pretokens(text: str) -> list[str]:
    """The normalised text (a mark before it and for each space) in pre-tokens."""
    return PRETOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []


def check_model(processor) -> None:
    """Refuse a model for which pre-tokens can't be encoded one by one."""
    crossing = re.compile(f"[^{SPACE}]{SPACE}")
    if any(crossing.search(processor.id_to_piece(i)) for i in range(processor.get_piece_size())):
        raise ValueError("the model has pieces that cross a space; pre-tokens would depend on their neighbours")
    if "".join(processor.encode("a  b ", out_type=str)) != f"{SPACE}a{SPACE}{SPACE}b{SPACE}":
        raise ValueError("the model doesn't keep spaces as they are")


class FrequentLengths:
    """Token counts of frequent pre-tokens in two flat buffers; size bounded by `most` entries of `longest` bytes."""

    def __init__(self, counts: dict[str, int]):
        encoded = {k.encode(): v for k, v in counts.items()}
        self.keys = b"".join(encoded)
        self.ends = np.cumsum([len(k) for k in encoded], dtype=np.uint32)
        self.lengths = np.array(list(encoded.values()), dtype=np.uint16)

    def table(self) -> dict[str, int]:
        starts = [0, *self.ends.tolist()]
        return {
            self.keys[a:b].decode(): n
            for a, b, n in zip(starts, starts[1:], self.lengths.tolist(), strict=False)
        }


#: Tables of leading pre-tokens that one task merges.
FAN = 16


def frequent_lengths(docs: DataFrame, model: str, text: str, fraction: float, most: int, longest: int = 64) -> FrequentLengths:
    """The first tier: lengths of the pre-tokens seen most often in a sample.

    The sample decides only where a length is looked up, never what it is, so
    its size has no bearing on results. Each task makes one table of at most
    `most` pre-tokens that it has seen twice; tables are merged FAN at a time,
    and cut to `most` again, until one is left, so no pre-token is a shuffle key
    and no task or driver holds more than FAN tables. Entries are at most
    `longest` bytes, so the broadcast is bounded by most * (longest + 6) bytes.
    """

    def table(seen: Counter[str]) -> pa.RecordBatch:
        top = sorted(((k, n) for k, n in seen.items() if n > 1 and len(k.encode()) <= longest), key=lambda x: (-x[1], x[0]))[:most]
        return pa.RecordBatch.from_arrays([pa.array([[k for k, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], names=["words", "n"])

    def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, 0):
                for t in part.column(0).to_pylist():
                    seen.update(pretokens(t or ""))
            if len(seen) > 8 * most:
                seen = Counter(dict(seen.most_common(2 * most)))
        yield table(seen)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for words, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, v in zip(words, n, strict=True):
                    seen[k] += v
        yield table(seen)

    sample = docs.select(F.col(f"`{text}`").alias("text")).sample(fraction, seed=11)
    schema, left = "words array<string>, n array<long>", sample.rdd.getNumPartitions()
    tables = sample.mapInArrow(leaders, schema)
    while left > 1:
        left = -(-left // FAN)
        tables = tables.repartition(left).mapInArrow(merged, schema)
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    check_model(processor)
    words = [w for r in tables.collect() for w in r.words]
    return FrequentLengths(dict(zip(words, map(len, encode_each(processor, words)), strict=True)))


def encode_each(processor, words: list[str]) -> list[list[int]]:
    """Ids of each pre-token. The library puts the first mark back itself, but for an empty text."""
    if not words:
        return []
    ids = processor.encode([w[1:].replace(SPACE, " ") for w in words], num_threads=1)
    return [x or [processor.piece_to_id(SPACE)] for x in ids]


def count_tokens(
    docs: DataFrame,
    model: str,
    text: str = "text",
    limit: int = 4096,
    sample_fraction: float = 0.01,
    frequent: int = 20_000,
    cache_entries: int = 400_000,
) -> DataFrame:
    """Append n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to every row.

    Counts equal those of the SentencePiece model on the whole text, without
    begin, end or added tokens. Null and empty texts have 0 bytes and 0 tokens.
    Columns of docs with one of the three names are replaced.

    Nothing is shuffled by pre-token. A lookup goes to the broadcast table of
    frequent pre-tokens, then to the worker's cache of at most `cache_entries`
    entries; what both miss is encoded by the library in one call for each run
    of rows. A long pre-token is never cached.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model, text, sample_fraction, frequent))

    def make():
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        first, cache = shared.value.table(), {}

        def work(texts: list[str | None]) -> list[list]:
            if len(cache) > cache_entries:
                cache.clear()
            parts = [pretokens(t) if t else [] for t in texts]
            missing = list({w for p in parts for w in p if w not in first and w not in cache})
            fresh = dict(zip(missing, map(len, encode_each(processor, missing)), strict=True))
            n_tokens = [sum(first.get(w) or fresh.get(w) or cache[w] for w in p) for p in parts]
            cache.update((w, n) for w, n in fresh.items() if len(w) <= 64)
            return [[len(t.encode()) if t else 0 for t in texts], n_tokens, [n > limit for n in n_tokens]]

        return work

    return map_texts(docs, make, fields(n_bytes=LONG, n_tokens=LONG, over_limit=BOOLEAN), text)
