import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from aisleworks import schemas
from aisleworks.operators import cleaning
from aisleworks.plans import ingest
from aisleworks.session import shared_folder
from aisleworks.sources import snapshots
from aisleworks.sources.exports import INGEST_ORDER, MALFORMED, parse_lines, read_export
from aisleworks.sources.keyed_files import Folder, KeyedTable
from aisleworks.sources.tables import empty_table, read_table
from aisleworks.streaming.feed import merge_batches
from tests.conftest import by, rows

DDL = "k string, v int, created_at timestamp_ntz, updated_at timestamp_ntz"
OLD = dt.datetime(2025, 1, 1)
NEW = dt.datetime(2026, 1, 1)


def merged(spark, current, batch, order=None):
    now = F.lit("2026-05-05 00:00:00").cast("timestamp_ntz")
    return snapshots.upsert(current, batch, ["k"], keep=["created_at"], touched="updated_at", now=now, order=F.col("v") if order is None else order)


def test_insert_keeps_existing_and_first_of_batch(spark):
    current = spark.createDataFrame([("a", 1)], "k string, v int")
    batch = spark.createDataFrame([("a", 9, 1), ("b", 2, 3), ("b", 3, 2)], "k string, v int, n int")
    once = snapshots.insert_if_absent(current, batch, ["k"], order="n")
    assert {r["k"]: r["v"] for r in rows(once)} == {"a": 1, "b": 3}
    twice = snapshots.insert_if_absent(once, batch, ["k"], order="n")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_upsert_overwrites_with_null_and_keeps_created(spark):
    current = spark.createDataFrame([("a", 1, OLD, OLD), ("z", 5, OLD, OLD)], DDL)
    batch = spark.createDataFrame([("a", None, NEW, NEW), ("b", 2, NEW, NEW)], DDL)
    got = by(merged(spark, current, batch), "k")
    assert got["a"] == {"k": "a", "v": None, "created_at": OLD, "updated_at": dt.datetime(2026, 5, 5)}
    assert got["b"] == {"k": "b", "v": 2, "created_at": NEW, "updated_at": NEW}
    assert got["z"]["v"] == 5 and len(got) == 3


def test_upsert_last_of_batch_wins_and_repeats_cleanly(spark):
    current = spark.createDataFrame([("a", 1, OLD, OLD)], DDL)
    batch = spark.createDataFrame([("a", 7, NEW, NEW), ("a", 8, NEW, NEW)], DDL).withColumn("n", F.col("v"))
    once = merged(spark, current, batch, order="n")
    assert by(once, "k")["a"]["v"] == 8
    assert rows(merged(spark, once, batch, order="n")) == rows(once)


def test_hot_key_in_a_batch_stays_one_row(spark):
    batch = spark.range(3000).select(
        F.when(F.col("id") < 1000, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    kept = snapshots.one_per_key(batch.withColumn("n", F.col("v")), ["k"], "last", "n")
    assert kept.count() == 2001 and kept.where("k = 'hot'").first()["v"] == 999


def test_repeated_keys_never_multiply(spark):
    current = spark.createDataFrame([(1, "a")], "k int, v string")
    batch = spark.createDataFrame([(1, "b"), (1, "c"), (2, "d"), (2, "e")], "k int, v string")
    order = F.col("v")
    assert sorted(map(tuple, snapshots.upsert(current, batch, ["k"], order).collect())) == [(1, "c"), (2, "e")]
    assert sorted(map(tuple, snapshots.insert_if_absent(current, batch, ["k"], order).collect())) == [(1, "a"), (2, "d")]


def scans(df, name):
    """Scans of a folder in the executed plan, by its nodes: texts of a plan are cut to a length."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "FileSourceScanExec":
            roots = node.relation().location().rootPaths()
            return int(any(roots.apply(i).getName() == name for i in range(roots.size())))
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind == "ReusedExchangeExec":
            return 0
        inner = list(map(node.children().apply, range(node.children().size())))
        inner += list(map(node.subqueries().apply, range(node.subqueries().size())))
        return sum(map(walk, inner))

    return walk(df._jdf.queryExecution().executedPlan())


def test_merge_plans_evaluate_the_batch_once(spark, tmp_path):
    for name in ("current", "batch"):
        spark.createDataFrame([("a", 1, OLD, OLD)], DDL).write.parquet(str(tmp_path / name))
    current, batch = (spark.read.parquet(str(tmp_path / name)) for name in ("current", "batch"))
    assert scans(merged(spark, current, batch, order=F.col("v")), "batch") == 1
    assert scans(snapshots.insert_if_absent(current, batch, ["k"], F.col("v")), "batch") == 1


def test_ingest_export_end_to_end(spark, tmp_path):
    export, table = tmp_path / "brand.csv", str(tmp_path / "brand")
    export.write_text('brand_id,brand_name,brand_country,is_active,created_at\n'
                      '1,"A, ""quoted""",India,TRUE,2025-01-02\n2,B,nan,maybe,\n1,Late,India,TRUE,\nLegend: x,,,,\n')
    rejects = ingest.ingest(spark, "brand", str(export), table)
    got = by(spark.read.parquet(table), "brand_id")
    assert got[1]["brand_name"] == 'A, "quoted"' and got[2]["brand_country"] is None and len(got) == 2
    assert [r["reject_reason"] for r in rows(rejects)] == ["key is not a whole number"]
    ingest.release(rejects)
    files = sorted(p.name for p in (tmp_path / "brand").glob("part-*"))
    ingest.release(ingest.ingest(spark, "brand", str(export), table))
    assert rows(spark.read.parquet(table).orderBy("brand_id")) == [got[1], got[2]]
    assert set(files) <= {p.name for p in (tmp_path / "brand").glob("part-*")}  # appended to, not rewritten


def test_ingest_dates_overwrite_all_but_the_id(spark, tmp_path):
    first, second, table = tmp_path / "a.csv", tmp_path / "b.csv", str(tmp_path / "date")
    first.write_text("date_id,full_date,day,season\n7,2025-01-02,2,Winter\n")
    second.write_text("date_id,full_date,day,season\n99,2025-01-02,,Summer \n8,2025-01-03,3,\n9,bad,3,\n")
    for export in (first, second, second):  # the last is a replay
        ingest.release(ingest.ingest(spark, "date", str(export), table))
    got = by(spark.read.parquet(table), "date_id")
    assert set(got) == {7, 8} and got[7]["season"] == "Summer" and got[7]["day"] is None


def data_files(folder):
    return {p.relative_to(folder): p.stat().st_mtime_ns for p in folder.rglob("part-*.parquet") if "_key_ranges" not in p.parts}


def keyed(spark, folder, ddl="k string, v int", rows=8, partition=None, keys=("k",)):
    return KeyedTable(spark, str(folder), spark.createDataFrame([], ddl).schema, keys, partition, rows)


def test_overwrite_leaves_untouched_files_alone(spark, tmp_path):
    table = keyed(spark, tmp_path / "t")
    first = spark.createDataFrame([(f"k{n:02d}", n) for n in range(40)], table.schema)
    snapshots.overwrite_touched(table, first, F.col("v"), snapshots.Rule())
    before = data_files(tmp_path / "t")
    assert len(before) >= 5
    snapshots.overwrite_touched(table, spark.createDataFrame([("k01", 99), ("k03", 98)], table.schema), F.col("v"), snapshots.Rule())
    after = data_files(tmp_path / "t")
    assert len(before.keys() - after.keys()) == 1 and all(after[p] == before[p] for p in before.keys() & after.keys())
    got = {r["k"]: r["v"] for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {**{f"k{n:02d}": n for n in range(40)}, "k01": 99, "k03": 98}


SALES = "transaction_id string, date_id int, v int, created_at timestamp_ntz, updated_at timestamp_ntz"
MONTHLY = ("sale_month", "CAST(FLOOR(date_id / 100) AS INT)")
RULE = snapshots.Rule(["created_at"], "updated_at")


def sales_rows(spark, numbers, v=0, at=OLD, date=None):
    return spark.createDataFrame([(f"T{n:05d}", date or 20250101 + n // 10 * 100, v, at, at) for n in numbers], SALES)


def test_recent_days_rewrite_only_their_folders(spark, tmp_path):
    table = keyed(spark, tmp_path / "t", SALES, 1000, MONTHLY, ("transaction_id",))
    snapshots.overwrite_touched(table, sales_rows(spark, range(120)), F.col("v"), RULE)
    before = data_files(tmp_path / "t")
    assert {p.parts[0] for p in before} == {f"sale_month={202501 + m}" for m in range(12)}
    snapshots.overwrite_touched(table, sales_rows(spark, range(105, 125), 7, NEW), F.col("v"), RULE)
    after = data_files(tmp_path / "t")
    assert {p.parts[0] for p in before.keys() ^ after.keys()} == {"sale_month=202511", "sale_month=202512", "sale_month=202513"}
    written = sum((tmp_path / "t" / p).stat().st_size for p in after.keys() - before.keys())
    assert written < sum((tmp_path / "t" / p).stat().st_size for p in after) / 3
    got = by(spark.read.parquet(str(tmp_path / "t")), "transaction_id")
    assert len(got) == 125 and sum(r["v"] == 7 for r in got.values()) == 20 and got["T00110"]["created_at"] == OLD


def test_a_sale_whose_date_changes_leaves_its_old_folder(spark, tmp_path):
    table = keyed(spark, tmp_path / "t", SALES, 1000, MONTHLY, ("transaction_id",))
    snapshots.overwrite_touched(table, sales_rows(spark, range(20)), F.col("v"), RULE)
    snapshots.overwrite_touched(table, sales_rows(spark, range(10), 1, NEW, 20260401), F.col("v"), RULE)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).groupBy("sale_month").count().orderBy("sale_month").collect()]
    assert got == [(202502, 10), (202604, 10)]


def plain(df):
    return sorted((r["transaction_id"], r["date_id"], r["v"], r["created_at"], r["updated_at"]) for r in df.collect())


def test_deltas_read_and_compact_like_upserts_one_by_one(spark, tmp_path):
    table = keyed(spark, tmp_path / "t", SALES, 1000, MONTHLY, ("transaction_id",))
    base = sales_rows(spark, range(60))
    snapshots.overwrite_touched(table, base, F.col("v"), RULE)
    before = data_files(tmp_path / "t")
    batches = [
        sales_rows(spark, [55, 58, 61, 62], 1, NEW), sales_rows(spark, [62, 55], 2, NEW), sales_rows(spark, [3], 3, NEW, 20260101),
        sales_rows(spark, [61], None, NEW),
    ]
    expected = base
    for number, batch in enumerate(batches):
        stamp = F.lit(f"2026-05-0{number + 1} 00:00:00").cast("timestamp_ntz")
        snapshots.add_delta(table, batch, F.col("v"), number, stamp)
        expected = snapshots.upsert(expected, batch, ["transaction_id"], F.col("v"), RULE.keep, RULE.touched, stamp)
    snapshots.add_delta(table, batches[3], F.col("v"), 3, F.lit("2026-05-04 00:00:00").cast("timestamp_ntz"))  # a replay
    assert data_files(tmp_path / "t").items() >= before.items()  # setting aside rewrites nothing
    wanted = plain(expected)
    assert plain(snapshots.read_merged(table, RULE)) == wanted
    untouched = {p for p in before if p.parts[0] in ("sale_month=202502", "sale_month=202503", "sale_month=202504")}
    assert snapshots.compact(table, RULE) == 4 and snapshots.deltas(table) == []
    assert plain(spark.read.parquet(str(tmp_path / "t"))) == plain(snapshots.read_merged(table, RULE)) == wanted
    after = data_files(tmp_path / "t")
    assert len(untouched) == 3 and untouched <= after.keys() and all(after[p] == before[p] for p in untouched)


def test_a_change_cut_off_in_between_is_finished(spark, tmp_path, monkeypatch):
    table = keyed(spark, tmp_path / "t", SALES, 1000, MONTHLY, ("transaction_id",))
    snapshots.overwrite_touched(table, sales_rows(spark, range(40)), F.col("v"), RULE)
    for call in range(1, 5):  # the driver is lost before its first, second ... move or deletion
        left = [call]

        def lost(self, name, *to, original=None, left=left):
            if not name.endswith(".draft"):
                left[0] -= 1
                if left[0] == 0:
                    raise KeyboardInterrupt
            return original(self, name, *to)

        with monkeypatch.context() as patch:
            for method in ("move", "delete"):
                original = getattr(Folder, method)
                patch.setattr(Folder, method, lambda self, name, *to, original=original: lost(self, name, *to, original=original))
            try:
                snapshots.overwrite_touched(table, sales_rows(spark, range(5, 25), call, NEW), F.col("v"), RULE)
            except KeyboardInterrupt:
                pass
        table.recover()
        got = by(table.read(table.data_files()), "transaction_id")
        assert len(got) == table.read(table.data_files()).count() == 40
        assert {r["v"] for k, r in got.items() if "T00005" <= k < "T00025"} == {call}
        assert not table.folder.names("_staged") and not table.folder.names("_pending")


def test_an_insert_opens_only_files_its_keys_can_meet(spark, tmp_path, monkeypatch):
    table = keyed(spark, tmp_path / "t", rows=10)
    stored = spark.createDataFrame([(f"k{n:03d}", n) for n in range(100)], table.schema)
    snapshots.append_new(table, stored, F.col("v"))
    opened = []
    read = KeyedTable.read
    monkeypatch.setattr(KeyedTable, "read", lambda self, files: opened.append(files) or read(self, files))
    batch = spark.createDataFrame([("k095", 1), ("k101", 2), ("k100", 3), ("k100", 4), (None, 5)], table.schema)
    for expected in (1, 2):  # then again, with the file just added
        opened.clear()
        snapshots.append_new(table, batch.where("k IS NOT NULL"), F.col("v"))
        assert len(opened[-1]) == expected and len(table.data_files()) == 11
    plan = snapshots.insert_if_absent(stored, batch.where("k IS NOT NULL"), ["k"], F.col("v"))
    assert sorted(map(tuple, spark.read.parquet(table.path).collect())) == sorted(map(tuple, plan.collect()))


def test_small_files_are_merged_and_ranges_follow(spark, tmp_path):
    table = keyed(spark, tmp_path / "t", rows=1000)
    for n in range(5):
        snapshots.append_new(table, spark.createDataFrame([(f"k{n}", n), (f"k{n}b", n)], table.schema), F.col("v"))
    assert table.merge_small_files(at_least=6) == 0 and len(table.data_files()) == 5
    assert table.merge_small_files(at_least=5) == 5 and len(table.data_files()) == 1
    (found,) = table.ranges().values()
    assert (tuple(found["low"]), tuple(found["high"]), found["rows"]) == (("k0",), ("k4b",), 10)


def test_merged_tables_are_read_whole(spark, tmp_path):
    path = str(tmp_path / "transaction")
    schema = schemas.struct("transaction")
    row = dict.fromkeys(schema.names) | {"transaction_id": "T1", "date_id": 20250105, "quantity_sold": 1}
    for number, sold in enumerate([1, 5]):
        batch = spark.createDataFrame([tuple((row | {"quantity_sold": sold}).values())], schema)
        merge_batches("transaction", path, F.col("quantity_sold"))(batch, number)
    assert [r["quantity_sold"] for r in read_table(spark, "transaction", path).collect()] == [5]
    merge_batches("transaction", path, F.col("quantity_sold"), compact_every=1)(batch, 2)
    assert [r["quantity_sold"] for r in read_table(spark, "transaction", path).collect()] == [5]
    assert {p.parts[0] for p in data_files(tmp_path / "transaction")} == {"sale_month=202501"}


def test_ingest_category_and_festival_products(spark, tmp_path):
    export = tmp_path / "category.csv"
    export.write_text("CATEGORY_ID,Category_Name,PARENT_CATEGORY_ID,IS_ACTIVE\n1,Tea,33,yes\n33,Mine,,1\n")
    ingest.release(ingest.ingest(spark, "category", str(export), str(tmp_path / "c1")))
    got = by(spark.read.parquet(str(tmp_path / "c1")), "category_id")
    assert len(got) == 7 and got[33]["category_name"] == "Snacks & Beverages" and got[1]["parent_category_id"] == 33
    fest = tmp_path / "festival.csv"
    fest.write_text('festival_id,top_product_ids,top_product_names\nFES1,"P1, P2, P1","A,B,C"\n')
    ingest.ingest_festival_products(spark, str(fest), str(tmp_path / "f1"))
    kept = {r["product_id"]: r["rank"] for r in rows(spark.read.parquet(str(tmp_path / "f1")))}
    assert kept == {"P1": 1, "P2": 2}


def test_nothing_is_left_in_the_shared_folder(spark, tmp_path):
    shared = Path(shared_folder(spark).removeprefix("file://"))
    before = {p.name for p in shared.iterdir()}
    export = tmp_path / "brand.csv"
    export.write_text("brand_id,brand_name\n1,A\n")
    ingest.release(ingest.ingest(spark, "brand", str(export), str(tmp_path / "brand")))
    assert {p.name for p in shared.iterdir()} == before


def test_export_scan_and_column_choice(spark, tmp_path):
    (tmp_path / "x.csv").write_text("B,a\n1,x\n2,y\n")
    raw = read_export(spark, str(tmp_path / "x.csv"), lower_header=True)
    assert raw.columns == ["b", "a", MALFORMED, INGEST_ORDER] and dict(raw.dtypes)["b"] == "string"
    assert [r["a"] for r in raw.orderBy(INGEST_ORDER).collect()] == ["x", "y"]


RAGGED = ["1,A,India", "2,B,UK,yes,2025-01-02,extra", '3,"C, D",India,1,2025-01-02', '4,"open,India,1', "5,E,,,", '6,F,"x ""y""",no,']


def test_ragged_rows_are_rejects_with_their_line(spark, tmp_path):
    export = tmp_path / "brand.csv"
    header = "brand_id,brand_name,brand_country,is_active,created_at"
    export.write_text("\n".join([header, *RAGGED]) + "\n")
    rejects = ingest.ingest(spark, "brand", str(export), str(tmp_path / "brand"))
    found = by(rejects, "brand_id")
    assert {k: r[MALFORMED] for k, r in found.items()} == {"1": RAGGED[0], "2": RAGGED[1], "4": RAGGED[3]}
    assert {r["reject_reason"] for r in found.values()} == {"row does not have the header's fields"}
    ingest.release(rejects)
    got = by(spark.read.parquet(str(tmp_path / "brand")), "brand_id")
    assert {k: r["brand_name"] for k, r in got.items()} == {3: "C, D", 5: "E", 6: "F"} and got[6]["brand_country"] == 'x "y"'
    lines = spark.createDataFrame([(line,) for line in RAGGED], "value string")
    from_lines = cleaning.clean_brand(parse_lines(lines, header.split(",")))
    assert rows(from_lines.valid.orderBy("brand_id")) == [got[3], got[5], got[6]]
    assert {r[MALFORMED] for r in rows(from_lines.rejects)} == {RAGGED[0], RAGGED[1], RAGGED[3]}


def test_ragged_festival_rows_name_no_products(spark, tmp_path):
    fest = tmp_path / "festival.csv"
    fest.write_text('festival_id,top_product_ids,top_product_names\nFES1,"P1","A"\nFES2,P2,B,C\n')
    ingest.ingest_festival_products(spark, str(fest), str(tmp_path / "f"))
    assert [r["festival_id"] for r in rows(spark.read.parquet(str(tmp_path / "f")))] == ["FES1"]


def test_stream_of_batches_and_replay(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "out")
    schema = schemas.struct("brand")
    for k, name in [(1, "first"), (1, "again"), (2, "second")]:
        spark.createDataFrame([(k, name, None, True, None)], schema).coalesce(1).write.mode("append").parquet(
            str(source))
        feed = (spark.readStream.schema(schema).parquet(str(source)).writeStream
                .foreachBatch(merge_batches("brand", table, F.col("brand_name")))
                .option("checkpointLocation", str(tmp_path / "state"))
                .trigger(availableNow=True).start())
        feed.awaitTermination()
    last = rows(spark.read.parquet(table).orderBy("brand_id"))
    assert {r["brand_id"]: r["brand_name"] for r in last} == {1: "first", 2: "second"}
    replay = spark.createDataFrame([(2, "second", None, True, None)], schema)
    merge_batches("brand", table, F.col("brand_name"))(replay, 2)
    assert rows(spark.read.parquet(table).orderBy("brand_id")) == last


def test_empty_table_has_the_declared_schema(spark):
    assert empty_table(spark, "transaction").columns == schemas.columns("transaction")
