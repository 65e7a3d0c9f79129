"""Merges that take many rows by stretches of keys, and what they leave on disk."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from aisleworks.session import materialize, release, shared_folder
from aisleworks.sources import snapshots
from aisleworks.sources.keyed_files import KeyedTable
from driverbind import catalog
from tests.test_oracle import FOLDER


def entries(spark, keys, amount, made):
    found = [(f"K{k:04d}" if k is not None else None, (k or 0) % 3, amount, made, made) for k in keys]
    return spark.createDataFrame(found, "id string, place int, amount int, made string, changed string").selectExpr(
        "id", "place", "amount", "CAST(made AS date) made", "CAST(changed AS date) changed"
    )


def shuffles(spark):
    """Shuffles whose files the driver knows of."""
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


@pytest.mark.parametrize("keys", [("id",), ("id", "place")])
@pytest.mark.parametrize("partition", [None, ("entry_year", "YEAR(made)")])
def test_slices_merge_like_the_plan(spark, tmp_path, keys, partition):
    current = entries(spark, [*range(0, 300), None], 1, "2025-12-31")
    batch = entries(spark, [*range(200, 520), *range(250, 260), None], 2, "2026-01-01")
    rule, now = snapshots.Rule(["made"], "changed"), F.lit("2026-02-02").cast("date")
    want = sorted(map(str, snapshots.upsert(current, batch, list(keys), F.col("amount"), rule.keep, rule.touched, now).collect()))
    table = KeyedTable(spark, str(tmp_path / "t"), current.schema, keys, partition, slice_rows=100)
    spans = table.stretches(batch)
    cuts = table.slices(spans, 650)
    assert len(cuts) == 7
    met = batch.select(sum((c.cast("int") for c in cuts[1:]), cuts[0].cast("int")).alias("n")).distinct().collect()
    assert [r["n"] for r in met] == [1]  # every row is in one slice
    writes = []
    table_write = KeyedTable.write

    def counted(self, rows, name):
        writes.append(name)
        table_write(self, rows, name)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(KeyedTable, "write", counted)
        snapshots.overwrite_touched(table, current, F.col("amount"), rule, now)
        first = len(writes)
        snapshots.overwrite_touched(table, batch, F.col("amount"), rule, now)
    assert first > 2 and len(writes) - first > 4 and len(set(writes)) == 2  # two changes, each in slices
    assert sorted(map(str, table.read(table.data_files()).collect())) == want
    assert not table.folder.names("_pending") and not table.folder.names("_staged")


def test_merges_delete_their_shuffles(spark, tmp_path):
    current, batch = entries(spark, range(300), 1, "2026-01-01"), entries(spark, range(100, 400), 2, "2026-01-02")
    table = KeyedTable(spark, str(tmp_path / "t"), current.schema, ("id",))
    table.append(current)
    batch = materialize(batch.groupBy(*batch.columns).count().drop("count"), "batch")
    before = shuffles(spark)
    snapshots.overwrite_touched(table, batch, F.col("amount"), snapshots.Rule())
    assert shuffles(spark) <= before
    assert table.read(table.data_files()).count() == 400
    release(batch)


def test_parts_are_one_table(spark):
    rows = spark.range(100)
    table = materialize([rows.where(F.col("id") % 3 == n) for n in range(3)], "parts")
    assert sorted(r["id"] for r in table.collect()) == list(range(100))
    release(table)


@pytest.mark.parametrize("name", ["category_trends", "store_trends"])
def test_kept_reports_leave_the_grain_alone(spark, monkeypatch, name):
    shared = Path(shared_folder(spark))
    whole = sorted(map(str, catalog.QUERIES[name](spark, FOLDER).collect()))
    before = {p.name for p in shared.iterdir()} if shared.exists() else set()
    monkeypatch.setattr(catalog, "SLICE_ROWS", 2000)
    found = catalog.QUERIES[f"{name}_kept"](spark, FOLDER)
    assert {p.name.split("-")[0] for p in shared.iterdir() if p.name not in before} == {"rollup"}
    assert sorted(map(str, found.collect())) == whole
