"""Toxicity by weak supervision.

Method: words and word beginnings that labelled rows show to be toxic are dealt to many lexicon and pattern voters;
voters for the absence of any such word vote the other way. A generative label model estimates the voters' accuracies and
correlations, and a linear classifier on hashed words and word beginnings is trained on its posterior labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleworks.llm.common import KEPT_CHARACTERS, bounded_batches, crc_mod, texts_of, two_columns, written
from aisleworks.llm.weak_labels import Hits, fitted_scorer, learning_rows

#: Share of toxic rows from which a feature is in a lexicon, and voters that each kind of feature is dealt to.
LEXICON_SHARE, VOTERS_EACH = 0.8, 16
#: Lengths of word beginnings; a word's kind is 0, a beginning's kind its place here plus 1.
BEGINNINGS = (4, 5, 6)
KINDS = 1 + len(BEGINNINGS)
KEPT_CHUNKS = 400_000
_LETTERS = regex.compile(r"\p{L}+")


def chunk_features(chunk: str) -> list[int]:
    """Hashed features (31 bits, the kind in the lowest two) of the words in a chunk without white space."""
    out = []
    for word in _LETTERS.findall(chunk.lower()):
        keys = [word, *(word[:n] for n in BEGINNINGS if len(word) >= n)]
        kinds = [0, *(k + 1 for k, n in enumerate(BEGINNINGS) if len(word) >= n)]
        out += [(xxhash.xxh32_intdigest(key, seed=kind) >> 3) << 2 | kind for key, kind in zip(keys, kinds, strict=True)]
    return out


def feature_rows(rows: DataFrame) -> DataFrame:
    """``features, y`` of ``text, y`` rows; each feature once per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in bounded_batches(batches):
            out = []
            for text in texts_of(batch.column(0)):
                found: set[int] = set()
                for chunk in set(text.split()):
                    hit = known.get(chunk)
                    if hit is None:
                        hit = chunk_features(chunk)
                        if len(chunk) <= KEPT_CHARACTERS:
                            known[chunk] = hit
                    found.update(hit)
                out.append(sorted(found))
            if len(known) > KEPT_CHUNKS // 4:
                known.clear()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), batch.column(1)], names=["features", "y"])

    return rows.mapInArrow(run, "features array<int>, y int")


def votes(hits: Hits, y: np.ndarray, _: list[list], features: np.ndarray) -> np.ndarray:
    """Votes of the lexicon and pattern voters (toxic or none) and of one voter per kind for no toxic feature of it."""
    rows = np.bincount(hits.feature, minlength=hits.width)
    toxic = np.bincount(hits.feature, weights=y[hits.row], minlength=hits.width)
    listed = toxic >= LEXICON_SHARE * np.maximum(rows, 1)
    kind = features & 3
    voter = kind * VOTERS_EACH + (features >> 2) % VOTERS_EACH
    out = np.zeros((hits.count, KINDS * (VOTERS_EACH + 1)), dtype=np.int8)
    out[:, KINDS * VOTERS_EACH :] = -1
    at = listed[hits.feature]
    out[hits.row[at], voter[hits.feature[at]]] = 1
    out[hits.row[at], KINDS * VOTERS_EACH + kind[hits.feature[at]]] = 0
    return out


def scored(rows: DataFrame, features: np.ndarray, weights: np.ndarray, bias: float) -> DataFrame:
    """``doc_id, score`` of ``doc_id, text`` rows."""
    shared = rows.sparkSession.sparkContext.broadcast(dict(zip(features.tolist(), weights.tolist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight_of = shared.value
        known: dict[str, tuple[int, ...]] = {}
        for batch in bounded_batches(batches):
            margins = []
            for text in texts_of(batch.column(1)):
                found: set[int] = set()
                for chunk in set(text.split()):
                    hit = known.get(chunk)
                    if hit is None:
                        hit = tuple(f for f in chunk_features(chunk) if f in weight_of)
                        if len(chunk) <= KEPT_CHARACTERS:
                            known[chunk] = hit
                    if hit:
                        found.update(hit)
                margins.append(sum(map(weight_of.__getitem__, sorted(found))) + bias)
            if len(known) > KEPT_CHUNKS:
                known.clear()
            scores = 1 / (1 + np.exp(-np.clip(np.array(margins, dtype=np.float64), -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learns: Column | None = None,
    label: str = "toxic",
    threshold: float = 0.7,
    id_column: str = "doc_id",
    text_column: str = "text",
    result_column: str | None = None,
) -> DataFrame:
    """Per row: ``doc_id, score, predicted`` (score of at least ``threshold``).

    Labels meet documents by ``id_column``; the result's ``doc_id`` has the values of ``result_column`` if that is given.
    ``learns`` is a condition on ``doc_id`` of the labels; labels that are null or neither 0 nor 1 teach nothing. A null
    or empty text has the score of a text without listed words; texts of any length count whole. If there is nothing to learn from, all scores are
    low. Equal texts have equal scores; an empty table gives no row. Other columns are not read.
    """
    texts = two_columns(docs, id_column, text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    learns = F.lit(True) if learns is None else learns
    rows = written(feature_rows(learning_rows(texts, labels, F.col(label), learns)), "toxic-features")
    named = two_columns(docs, result_column or id_column, text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    scores = scored(named, *fitted_scorer(rows, votes, []))
    return scores.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out_third() -> Column:
    return crc_mod("doc_id", 3) == 1
