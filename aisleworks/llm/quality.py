"""Text quality by weak labels.

Method: overlapping heuristics (shares of capitals, of symbols, of repeated words and lines, word lengths and more) vote
good or bad or not at all, at limits read from labelled rows. Expectation-maximisation estimates their accuracies, and that
of the given labels, which start it and vote like the others; the posterior labels train a linear scorer on hashed
word shapes and their binned shares of the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleworks.llm.common import KEPT_CHARACTERS, bounded_batches, texts_of, two_columns, written
from aisleworks.llm.weak_labels import Hits, fitted_scorer, learning_rows

STATISTICS = ("capitals", "symbols", "digits", "symbol words", "repeats", "distinct", "length", "lines", "words")
KEPT_CHUNKS = 400_000
#: Shares of the text of a shape or pair of shapes are told apart by powers of two down to this one.
LEAST_SHARE = 2.0**-10


def shape(chunk: str) -> str:
    """A chunk with each run of letters as ``a``, ``A`` (capitals alone) or ``Aa`` and each run of digits as ``0``."""
    out = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a", chunk)
    return re.sub(r"\d+", "0", out)[:24]


class Shapes:
    """Per chunk its shape and counts of letters, capitals, digits and other characters, kept in a bounded table."""

    def __init__(self):
        self.known: dict[str, tuple] = {}

    def __call__(self, chunk: str) -> tuple:
        found = self.known.get(chunk)
        if found is None:
            if len(self.known) > KEPT_CHUNKS:
                self.known.clear()
            letters = sum(map(str.isalpha, chunk))
            capitals = sum(map(str.isupper, chunk))
            digits = sum(map(str.isdigit, chunk))
            found = (shape(chunk), letters, capitals, digits, len(chunk) - letters - digits)
            if len(chunk) <= KEPT_CHARACTERS:
                self.known[chunk] = found
        return found


def described(text: str, shapes: Shapes) -> tuple[list[int], list[float]]:
    """Hashed features (shapes and statistics with binned values) and the statistics the heuristics look at."""
    chunks = text.split()
    words = max(len(chunks), 1)
    counted = Counter(chunks)
    seen: Counter[str] = Counter()
    letters = capitals = digits = others = symbol_words = 0
    for chunk, n in counted.items():
        form, a, b, c, d = shapes(chunk)
        seen[form] += n
        letters, capitals, digits, others = letters + a * n, capitals + b * n, digits + c * n, others + d * n
        symbol_words += n * (d * 2 > a)
    size = max(letters + digits + others, 1)
    repeats = sum(map(str.__eq__, chunks, chunks[1:]))
    lines = [line for line in text.split("\n") if line.strip()]
    statistics = [
        capitals / max(letters, 1),
        others / size,
        digits / size,
        symbol_words / words,
        repeats / words,
        len(counted) / words,
        letters / words,
        1 - len(set(lines)) / max(len(lines), 1),
        float(len(chunks)),
    ]
    names = [f"{form}|{level(n / words)}" for form, n in seen.items()]
    names += [f"#{name}|{level(value)}" for name, value in zip(STATISTICS, statistics, strict=True)]
    return sorted({xxhash.xxh32_intdigest(name) >> 1 for name in names}), statistics


def level(value: float) -> int:
    return round(math.log2(max(value, LEAST_SHARE)))


def feature_rows(rows: DataFrame) -> DataFrame:
    """``features, statistics, y`` of ``text, y`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in bounded_batches(batches):
            found = [described(text, shapes) for text in texts_of(batch.column(0))]
            columns = [pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], names=["features", "statistics", "y"])

    return rows.mapInArrow(run, "features array<int>, statistics array<double>, y int")


def votes(_: Hits, y: np.ndarray, extra: list[list], __: np.ndarray) -> np.ndarray:
    """Per statistic two labellers, one for each tail: bad beyond a limit, good short of another, else no vote.

    A limit is the outermost tenth, hundredth or thousandth of the good rows that leaves most bad rows beyond it.
    """
    values = np.array(extra[0], dtype=np.float64)
    good, bad = values[y == 1], values[y == 0]
    out = []
    for k in range(values.shape[1]):
        for side in (1, -1):
            own, best, limit = side * values[:, k], -1.0, np.inf
            for tail in (0.9, 0.99, 0.999):
                at = np.quantile(side * good[:, k], tail)
                gain = (side * bad[:, k] > at).mean() - 2 * (1 - tail)
                if gain > best:
                    best, limit = gain, at
            if best < 0.05:  # this tail tells nothing
                continue
            middle = np.quantile(side * good[:, k], 0.5)
            out.append(np.where(own > limit, -1, np.where(own <= max(middle, min(limit, middle + 1e-9)), 1, 0)))
    return np.stack(out, axis=1).astype(np.int8) if out else np.zeros((len(y), 0), dtype=np.int8)


def scored(rows: DataFrame, features: np.ndarray, weights: np.ndarray, bias: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(dict(zip(features.tolist(), weights.tolist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        weight_of = shared.value
        for batch in bounded_batches(batches):
            margins = [
                sum(weight_of.get(f, 0.0) for f in described(text, shapes)[0]) + bias for text in texts_of(batch.column(1))
            ]
            scores = 1 / (1 + np.exp(-np.clip(np.array(margins, dtype=np.float64), -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def quality(
    docs: DataFrame,
    labels: DataFrame,
    learns: Column | None = None,
    label: str = "quality",
    threshold: float = 0.5,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: ``doc_id, score`` (0 to 1, higher for better text), ``predicted`` (score of at least ``threshold``).

    ``learns`` is a condition on ``doc_id`` of the labels; labels that are null or neither 0 nor 1 teach nothing. A null
    or empty text is scored as a text without words. With labels of one kind only, all texts get that kind's side.
    Equal texts have equal scores; an empty table gives no row. Other columns are not read.
    """
    texts = two_columns(docs, id_column, text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    learns = F.lit(True) if learns is None else learns
    rows = written(feature_rows(learning_rows(texts, labels, F.col(label), learns)), "quality-features")
    scores = scored(texts, *fitted_scorer(rows, votes, ["statistics"]))
    return scores.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
