import random

from pyspark.sql import functions as F

from aisleworks.functions.rounding import grouped_integer, quantity_text, round_half_even, round_half_up


def test_half_even_equals_python_round(spark):
    rng = random.Random(3)
    values = [2.675, 1.005, 0.5, 1.5, 2.5, -0.5, 0.125, 5.445, 9.9 * 0.55, -2.675, 1e7 + 0.5, 0.0]
    values += [rng.randint(-(10**6), 10**6) / 1000 for _ in range(3000)]
    values += [rng.randint(1, 10**6) / 100 * (1 - p / 100) for p in (7, 15, 25, 30, 45, 50) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    shown = df.select("x", *[round_half_even(F.col("x"), n).alias(f"r{n}") for n in range(4)]).collect()
    for row in shown:
        assert [row[f"r{n}"] for n in range(4)] == [round(row["x"], n) for n in range(4)]


def test_half_even_passes_what_is_not_finite(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (1e12 + 0.125,)], "x double")
    got = [r[0] for r in df.select(round_half_even(F.col("x"), 2)).collect()]
    assert got[:2] == [float("inf"), float("-inf")] and got[2] != got[2] and got[3] is None and got[4] == round(1e12 + 0.125, 2)


def test_half_up_rounds_away_from_zero(spark):
    df = spark.createDataFrame([(2.675,), (-2.675,), (0.005,), (1.1 * 1.1 * 100,)], "x double")
    assert [r[0] for r in df.select(round_half_up(F.col("x"), 2)).collect()] == [2.68, -2.68, 0.01, 121.0]


def test_text_forms(spark):
    df = spark.createDataFrame([(45.0, 1234.5), (0.0, 2.5), (12345678.0, 1235.5)], "q double, v double")
    shown = df.select(quantity_text(F.col("q")), grouped_integer(F.col("v"))).collect()
    assert [tuple(r) for r in shown] == [("45.0", "1,234"), ("0", "2"), ("12345678.0", "1,236")]
