"""Quality classifier: Bradley-Terry ranking from preference pairs, cut at a score quantile."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import DOUBLE, INT, fields, map_texts
from gleanery.llm.quality_rules import Text

FEATURES = (
    "bias_short", "log_words", "word_length", "symbols", "upper", "repeated", "duplicate_lines", "distinct_words",
    "same_as_before", "exclamations", "bars", "digits", "commas", "stops", "capital_words", "line_words", "function_words", "punctuation",
)
DIGIT = re.compile(r"[0-9]")
OTHER = re.compile(r"[^\w\s.,;:'-]")


def variety(words: list[str], width: int = 200) -> float:
    """Share of different words, as a mean over all windows of `width` words one after another; the last one ends with the text.

    All windows are of one width, so longer texts get no lower value.
    """
    n = len(words)
    starts = [*range(0, n - width, width), max(0, n - width)]
    return sum(len(set(words[a : a + width])) / min(n, width) for a in starts) / len(starts)


def features(text: str | None) -> list[float]:
    """Ratios that don't depend on the language; all 0 for a text without words but bias_short."""
    t = Text(text)
    n, chars = t.n_words, max(1, len(t.text))
    if not n:
        return [1.0] + [0.0] * (len(FEATURES) - 1)
    w = t.words
    return [
        1.0 / n,
        math.log(n),
        min(20.0, t.word_chars / n),
        min(1.0, t.n_symbols / n),
        t.upper / max(1, t.letters),
        t.n_repeat_words / n,
        t.n_dup_lines / max(1, len(t.lines)),
        variety(w),
        sum(map(str.__eq__, w, w[1:])) / n,
        min(1.0, t.text.count("!") / n),
        min(1.0, t.text.count("|") / n),
        len(DIGIT.findall(t.text)) / chars,
        min(1.0, t.text.count(",") / n),
        min(1.0, t.text.count(".") / n),
        sum(x[0].isupper() for x in w) / n,
        min(1.0, n / max(1, len(t.lines)) / 100),
        sum(len(x) <= 3 for x in w) / n,
        min(1.0, len(OTHER.findall(t.text)) / chars * 5),
    ]


@dataclass(frozen=True)
class Model:
    """score = sigmoid(weights . (features - mean) / spread - threshold)."""

    mean: list[float]
    spread: list[float]
    weights: list[float]
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = (x - np.array(self.mean)) / np.array(self.spread) @ np.array(self.weights) - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


def learn(x: np.ndarray, good: np.ndarray, pairs_each: int = 8, ridge: float = 1e-4, rounds: int = 60, seed: int = 3) -> Model:
    """Bradley-Terry weights from pairs of a good and a bad document.

    P(good one preferred) = sigmoid(w . (difference of features)); Newton steps on
    the mean logistic loss with a ridge. Pairs are drawn at random, pairs_each for
    each document of the commoner kind. The threshold is the quantile of the sample's
    scores at the share of bad documents. Without both kinds all weights are 0
    and every score is 0.5.
    """
    k = x.shape[1] if x.ndim == 2 and len(x) else len(FEATURES)
    if not good.any() or good.all():
        return Model([0.0] * k, [1.0] * k, [0.0] * k, 0.0)
    mean, spread = x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    z = (x - mean) / spread
    high, low = np.flatnonzero(good), np.flatnonzero(~good)
    rng, n = np.random.default_rng(seed), pairs_each * max(len(high), len(low))
    difference = z[rng.choice(high, n)] - z[rng.choice(low, n)]
    w = np.zeros(k)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(difference @ w, -50, 50)))
        gradient = difference.T @ (p - 1) / n + ridge * w
        hessian = (difference * (p * (1 - p))[:, None]).T @ difference / n + ridge * np.eye(k)
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, float(np.linalg.norm(step)))
        if np.linalg.norm(step) < 1e-6:
            break
    threshold = float(np.quantile(z @ w, 1 - good.mean()))
    return Model(mean.tolist(), spread.tolist(), w.tolist(), threshold)


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 3; of a null key as of ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", held_out: int = 1, sample_rows: int = 12_000) -> Model:
    """Fit on at most sample_rows labelled rows outside the held-out fold, the first by a hash of the key.

    The sample bounds what is joined by broadcast and what the driver fits on
    (sample_rows times 18 numbers). Rows without a key or label don't count; of
    labels that name one document several times each counts.
    """
    own = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("label")).where("k is not null and label is not null")
    chosen = own.where(fold(F.col("k")) != held_out).orderBy(F.xxhash64("k"), "k", "label").limit(sample_rows)
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "k")

    def make():
        return lambda texts: [[features(t) for t in texts]]

    fitted = map_texts(rows, make, fields(x=T.ArrayType(DOUBLE)), "text").select("k", "label", "x").orderBy("k", "label").collect()
    return learn(np.array([r.x for r in fitted]), np.array([r.label == 1 for r in fitted], dtype=bool))


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append score (0 to 1, higher: better) and predicted (1 if score >= 0.5) from the text alone.

    Null and empty texts get a score like any other. Columns of docs with these
    names are replaced. No row moves.
    """

    def make():
        def work(texts: list[str | None]) -> list[list]:
            s = model.scores(np.array([features(t) for t in texts]))
            return [s.tolist(), (s >= 0.5).astype(int).tolist()]

        return work

    return map_texts(docs, make, fields(score=DOUBLE, predicted=INT), text, 1 << 20)
