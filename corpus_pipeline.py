"""A corpus pipeline of five of the operators, each stage on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import decontaminate, line_dedup, piece_codec, quality_rules
from gleanery.llm.common import cut
from gleanery.llm.near_copies import keep_first_copy

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality cascade keeps; null and empty texts go."""
    return quality_rules.quality_cascade(docs).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take near-duplicate lines out of the texts. All documents stay, be it with an empty text; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near copies: Jaccard 0.8 or more over five-word shingles. Documents without words are one group.

    Of rows equal in id and text one stays; rows without an id stay.
    """
    return keep_first_copy(docs, shingle=5, most=5).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share a window with a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_contamination(docs, benchmark).where("not contaminated").select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text, and decode it again to tell whether it comes back whole."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = piece_codec.decode_ids(piece_codec.encode_texts(docs, model), model)
    whole = (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    return both.select(*COLUMNS, "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), whole)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("SentencePiece encoding and decoding", pieces),
]
#: SimHash hashes words with XXH64, which SQL has no function for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
