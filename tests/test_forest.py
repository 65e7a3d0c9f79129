"""The forest grown over blocks against one grown row by row, and against Spark's own."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from aisleworks.operators import forecast, forest
from aisleworks.operators.features import FEATURES, TARGET

INPUTS = ["a", "b", "c", "same"]


def table(spark, n=400, whole=True, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 7, n), rng.normal(size=n), rng.integers(0, 2, n)
    y = np.round(10 * a * c + 8 * (b > 0.3) + rng.integers(-3, 4, n)) + (0 if whole else rng.random(n))
    rows = [(float(a[i]), float(b[i]), int(c[i]), 4.0, float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "a double, b double, c int, same double, y double").coalesce(1)


def regressor(**forest):
    given = {"numTrees": 3, "maxDepth": 4, "minInstancesPerNode": 3, "seed": 7, "featureSubsetStrategy": "all", **forest}
    return RandomForestRegressor(labelCol="y", featuresCol="features", **given)


def scored(model, df):
    return model.transform(VectorAssembler(inputCols=INPUTS, outputCol="features").transform(df))


def grown_by_rows(x, y, w, thresholds, depth, least):
    """Predictions of one tree for its own rows."""
    n, total = w.sum(), (w * y).sum()
    out = np.full(len(y), total / n)
    best = (1e-9, None)
    for i, cuts in enumerate(thresholds if depth else []):
        for cut in cuts:
            left = x[:, i] <= cut
            ln, lt = w[left].sum(), (w * y)[left].sum()
            if ln >= least and n - ln >= least:
                gain = lt**2 / ln + (total - lt) ** 2 / (n - ln) - total**2 / n
                if gain > best[0] * (1 + 1e-9) and gain > 1e-9 * n:
                    best = (gain, left)
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = grown_by_rows(x[side], y[side], w[side], thresholds, depth - 1, least)
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_trees_equal_those_grown_row_by_row(spark, whole):
    df = table(spark, whole=whole)
    rows = np.array(df.collect())
    x, y = rows[:, :-1], rows[:, -1]
    model = forest.fit(df, INPUTS, "y", regressor())
    thresholds = forest.split_points(df.select(*INPUTS), INPUTS, 32)
    assert [len(t) for t in thresholds] == [6, 31, 1, 0]
    bounds = forest._draw_bounds(1.0)
    trees = [grown_by_rows(x, y, forest._drawn(7, 0, t, len(y), bounds).astype(float), thresholds, 4, 3) for t in range(3)]
    got = [r["prediction"] for r in scored(model, df).select("prediction").collect()]
    assert np.allclose(got, np.mean(trees, axis=0))
    assert model.getNumTrees == 3 and sum(model.featureImportances) == pytest.approx(1) and model.featureImportances[3] == 0


def test_blocks_and_tasks_add_up(spark, monkeypatch):
    """The same trees whether rows lie in one block or in many, if every row is drawn once."""
    monkeypatch.setattr(forest, "_drawn", lambda seed, block, tree, n, bounds: np.ones(n, np.uint8))
    rng = np.random.default_rng(1)
    sizes = [7, 40, 2, 1]
    shape = forest.Shape(1, 5, 3, 0.0, 1.0, 7, 64)
    bins = np.stack([rng.integers(0, s, 900) for s in sizes]).astype(np.uint8)
    y = (bins[0] * 3.0 + (bins[1] > 20) * 5 + rng.integers(0, 3, 900))
    found = []
    for parts in (1, 6):
        sums = None
        walks, groups = [([], 1)], forest._joined(sizes, 64)
        for some in np.array_split(np.arange(900), parts):
            block = forest._Block(0, len(some), bins[:, some].tobytes(), y[some].tobytes(), sizes, groups)
            ((_, n, total, node),) = forest._counted([block], walks, sizes, groups, forest._draw_bounds(1.0), shape.seed)
            sums = [n, total, node] if sums is None else [s + o for s, o in zip(sums, (n, total, node))]
        found.append(sums)
    for one, many in zip(*found):
        assert np.array_equal(one, many)
    assert found[0][2][0].tolist() == [900, y.sum(), (y * y).sum()]
    assert np.array_equal(found[0][0][0, :7], np.bincount(bins[0]))


def test_samples_are_drawn_by_poisson_chances():
    times = forest._drawn(1, 2, 3, 400_000, forest._draw_bounds(1.0))
    assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02 and abs((times == 0).mean() - np.exp(-1)) < 0.01
    assert np.array_equal(times, forest._drawn(1, 2, 3, 400_000, forest._draw_bounds(1.0)))


def test_many_values_keep_their_counts():
    values = np.random.default_rng(2).normal(size=50_000)
    found, counts = forest._summary(values, np.ones(len(values)))
    assert len(found) <= forest.SUMMARY_POINTS + 1 and counts.sum() == len(values)
    cuts = forest._thresholds(found, counts, 31)
    shares = np.histogram(values, [-np.inf, *cuts, np.inf])[0] / len(values)
    assert len(cuts) == 31 and abs(shares - 1 / 32).max() < 0.003


def test_production_forest_is_grown_over_blocks(spark, monkeypatch):
    """Spark's own training keeps about a kilobyte a row for 100 trees; it is not asked for the production parameters."""
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda *_: pytest.fail("left to Spark's training"))
    rng = np.random.default_rng(5)
    rows = [tuple(float(v) for v in rng.integers(0, 5, len(FEATURES))) + (int(rng.integers(0, 50)),) for _ in range(200)]
    df = spark.createDataFrame(rows, ", ".join([*(f"{c} double" for c in FEATURES), f"{TARGET} bigint"]))
    model = forecast.fitted(df, numTrees=5)
    assert model.transform(df).where(F.col("prediction").between(0, 49)).count() == 200
    assert model.stages[-1].getNumTrees == 5


def test_error_is_that_of_sparks_own(spark):
    df, fresh = table(spark, 3000).cache(), table(spark, 2000, seed=4)
    asked = regressor(numTrees=30, maxDepth=6)
    assembled = VectorAssembler(inputCols=INPUTS, outputCol="features").transform(df)
    rmse = [
        scored(model, fresh).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
        for model in (forest.fit(df, INPUTS, "y", asked), asked.fit(assembled))
    ]
    assert rmse[0] < 1.05 * rmse[1]
    df.unpersist()


def test_scores_equal_the_models_own(spark, monkeypatch):
    df = table(spark, 3000)
    model = forest.fit(df, INPUTS, "y", regressor(numTrees=20, maxDepth=8))
    want = sorted((r["b"], r["prediction"]) for r in scored(model, df).select("b", "prediction").collect())
    got = forest.predicted(model, INPUTS, df.repartition(3), "found").select("b", "found").collect()
    assert sorted(map(tuple, got)) == want
    monkeypatch.setattr(forest, "COMBINATION_ROWS", 10)
    run = forest.scorer(*forest.trees_of(model))
    rows = np.array(df.select("b", *INPUTS).collect()).T
    assert sorted(zip(rows[0], run(rows[1:]))) == want


def test_forecast_of_every_key_is_not_scored_row_by_row(spark, monkeypatch):
    """Spark's forest takes some 50 microseconds a row for 100 trees; forecasts don't go through it."""
    rng = np.random.default_rng(5)
    rows = [tuple(float(v) for v in rng.integers(0, 5, len(FEATURES))) + (int(rng.integers(0, 50)),) for _ in range(200)]
    df = spark.createDataFrame(rows, ", ".join([*(f"{c} double" for c in FEATURES), f"{TARGET} bigint"]))
    model = forecast.fitted(df, numTrees=5)
    want = sorted(r[0] for r in model.transform(df).select("prediction").collect())
    found = forecast.scored(model, df)
    assert sorted(r[0] for r in found.select("prediction").collect()) == want
    assert "ArrowEvalPython" in found._jdf.queryExecution().toString()
