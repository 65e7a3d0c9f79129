"""Weak supervision shared by the text classifiers: votes, a generative label model, a linear scorer on its posteriors.

Learning uses a bounded sample of labelled rows. Their features are hashed and counted on the cluster; what reaches
the driver is the sample's hits among a bounded number of selected features and one small vote row per sample row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows learnt from at most, chosen by a hash of their id.
MOST_LEARNING = 20_000
#: Hashed features that a scorer weighs, and rows that a feature must be in to be one.
MOST_FEATURES, LEAST_ROWS = 8192, 4
#: z score below which a feature's rows may differ from the average by chance.
LEAST_DEVIATION = 5.0
#: Correlation of two voters' residuals, given the label, from which they count as dependent.
DEPENDENT = 0.3
#: How often a given label is taken to be right before its accuracy is estimated.
FIRST_ACCURACY = 0.9


def learning_rows(docs: DataFrame, labels: DataFrame, label: Column, learns: Column) -> DataFrame:
    """``text, y`` of at most ``MOST_LEARNING`` labelled rows of ``doc_id, text`` documents.

    Labels that are null or not 0 or 1 teach nothing; of several labels of an id the largest holds, of several texts of an id
    the one of the smallest hash, so the bound is on rows however often an id is repeated.
    """
    named = labels.select(F.col("doc_id").alias("of"), label.cast("int").alias("y"), learns.alias("learns"))
    usable = named.where("learns AND of IS NOT NULL AND y IN (0, 1)").groupBy("of").agg(F.max("y").alias("y"))
    chosen = usable.orderBy(F.xxhash64(F.lit(11), "of"), "of").limit(MOST_LEARNING)
    # at most MOST_LEARNING rows of two numbers
    taught = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("of"))
    return taught.groupBy("of").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y")).select("text", "y")


def selected_features(rows: DataFrame) -> np.ndarray:
    """Sorted ids of the features (array ``features``) whose rows' labels differ most from the average, by their z score."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("share")).first()
    if not total["n"] or total["share"] in (0.0, 1.0):
        return np.zeros(0, dtype=np.int32)
    counted = rows.select("y", F.explode("features").alias("feature")).groupBy("feature")
    share = total["share"]
    deviation = F.abs(F.col("ones") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = (
        counted.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
        .where((F.col("n") >= LEAST_ROWS) & (deviation >= LEAST_DEVIATION))
        .orderBy(deviation.desc(), "feature")
        .limit(MOST_FEATURES)
    )
    return np.sort(np.array([r[0] for r in best.select("feature").collect()], dtype=np.int32))


class Hits:
    """Occurrences of selected features in the learning rows, as parallel arrays of row and feature number."""

    def __init__(self, rows: list[np.ndarray], features: np.ndarray):
        self.count, self.width = len(rows), len(features)
        flat = np.concatenate([*rows, np.zeros(0, dtype=np.int32)]).astype(np.int32)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.minimum(np.searchsorted(features, flat), max(len(features) - 1, 0))
        good = features[at] == flat if len(features) else np.zeros(len(flat), dtype=bool)
        self.row, self.feature = owner[good], at[good]


def collected(rows: DataFrame, features: np.ndarray, extra: list[str]) -> tuple[Hits, np.ndarray, list[list]]:
    """Hits, labels and extra columns of the (bounded) learning rows."""
    wanted = rows.sparkSession.sparkContext.broadcast(features)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept = [
                np.array(f, dtype=np.int32)[np.isin(f, wanted.value)] if f else np.zeros(0, dtype=np.int32)
                for f in batch.column(0).to_pylist()
            ]
            columns = [pa.array(kept, pa.list_(pa.int32())), *[batch.column(i) for i in range(1, batch.num_columns)]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    chosen = rows.select("features", "y", *extra)
    got = chosen.mapInArrow(run, chosen.schema).collect()
    hits = Hits([np.array(r["features"], dtype=np.int32) for r in got], features)
    return hits, np.array([r["y"] for r in got], dtype=np.float64), [[r[c] for r in got] for c in extra]


def label_posteriors(votes: np.ndarray, given: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of label 1 from votes (1, -1, or 0 for none), the voters' accuracies, and their dependence weights, the given
    label's last in both.

    Each voter has a distribution over its three votes given the true label, estimated by expectation-maximisation. The
    ``given`` labels of the rows only start it: they are one more voter, whose accuracy is estimated like that of the others,
    so wrong labels are outvoted where the voters agree. Voters whose residuals are correlated given the label share
    one voter's weight; the model is then fitted again with these weights.
    """
    own = np.where(given == 1, 1, -1)
    votes = np.column_stack([votes, own])
    rows, voters = votes.shape
    indicator = np.stack([votes == v for v in (-1, 0, 1)]).astype(np.float64)
    weight = np.ones(voters)
    posterior = np.where(own == 1, FIRST_ACCURACY, 1 - FIRST_ACCURACY)
    table = np.full((2, 3, voters), 1 / 3)
    for _ in range(2):
        for _ in range(rounds):
            for y, belief in ((0, 1 - posterior), (1, posterior)):
                counts = np.einsum("n,vnm->vm", belief, indicator) + 0.5
                table[y] = counts / counts.sum(axis=0)
            share = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
            ratio = np.einsum("vnm,vm->n", indicator, (np.log(table[1]) - np.log(table[0])) * weight)
            posterior = 1 / (1 + np.exp(-np.clip(ratio + np.log(share / (1 - share)), -40, 40)))
        expected = np.stack([table[y][2] - table[y][0] for y in (0, 1)])
        residual = votes - (np.outer(1 - posterior, expected[0]) + np.outer(posterior, expected[1]))
        spread = np.sqrt((residual**2).mean(axis=0)) + 1e-9
        correlation = np.abs(residual.T @ residual / max(rows, 1) / np.outer(spread, spread))
        np.fill_diagonal(correlation, 0)
        weight = 1 / (1 + np.where(correlation > DEPENDENT, correlation, 0).sum(axis=1))
    share = posterior.mean()
    accuracy = share * table[1][2] + (1 - share) * table[0][0]
    voted = share * (table[1][2] + table[1][0]) + (1 - share) * (table[0][2] + table[0][0])
    return posterior, accuracy / np.maximum(voted, 1e-9), weight


def linear_scorer(hits: Hits, target: np.ndarray, penalty: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on soft labels, by Adam over all rows in each step."""
    weights = np.zeros(hits.width + 1)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        margin = np.bincount(hits.row, weights=weights[hits.feature], minlength=hits.count) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - target
        slope = np.append(np.bincount(hits.feature, weights=error[hits.row], minlength=hits.width), error.sum())
        slope = slope / max(hits.count, 1) + penalty * np.append(weights[:-1], 0)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


def fitted_scorer(rows: DataFrame, voters: Callable[[Hits, np.ndarray, list[list], np.ndarray], np.ndarray], extra: list[str]):
    """Selected features, weights and bias from learning rows ``features, y, ...``; no features if there is nothing to learn."""
    features = selected_features(rows)
    if not len(features):
        share = rows.agg(F.avg("y")).first()[0]
        return features, np.zeros(0), 0.0 if share is None else (4.0 if share > 0.5 else -4.0)
    hits, y, more = collected(rows, features, extra)
    posterior, _, _ = label_posteriors(voters(hits, y, more, features), y)
    weights, bias = linear_scorer(hits, posterior)
    return features, weights, bias
