"""Merging a batch into a table: by plan (current rows in, next rows out) or in place, by the files it touches.

The plans evaluate the batch once and read the current rows once (an insert reads their keys a second time).
In place, files are known by their key ranges (``KeyedTable``). An insert reads the keys of the files its batch can meet and
appends the new rows. An overwrite rewrites the files its batch can meet; or the batch is set aside as a delta, which costs
no more than the batch itself, is merged in by readers, and is folded into the files later together with others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aisleworks.sources.exports import INGEST_ORDER
from aisleworks.sources.keyed_files import DELTAS, KeyedTable


def one_per_key(batch: DataFrame, keys: list[str], keep: str = "first", order: str | Column = INGEST_ORDER) -> DataFrame:
    """First or last row of each key by the ingest order, which is dropped.

    A key repeated in a third of the batch is cut to one row per task before the
    shuffle (a row-number limit of one is pushed below it).
    """
    position = F.col(order) if isinstance(order, str) else order
    direction = position.asc() if keep == "first" else position.desc()
    ranked = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(direction)))
    kept = ranked.where(F.col("_n") == 1).drop("_n")
    return kept.drop(order) if isinstance(order, str) else kept


def _same_key(keys: list[str]):
    condition = F.lit(True)
    for key in keys:
        condition = condition & (F.col(f"c.{key}") == F.col(f"b.{key}"))
    return condition


def new_keys_only(current: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Batch rows whose key the current table lacks."""
    return batch.join(current.select(*keys), keys, "left_anti")


def insert_if_absent(current: DataFrame, batch: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """Existing rows stay as they are; of equal new keys the first by ``order`` wins."""
    fresh = new_keys_only(current, one_per_key(batch, keys, "first", order), keys)
    return current.unionByName(fresh.select(*current.columns))


def upsert(
    current: DataFrame,
    batch: DataFrame,
    keys: list[str],
    order: str | Column,
    keep: list[str] | None = None,
    touched: str | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Matching rows take the batch's values, new NULLs included; the rest is inserted.

    ``keep`` names columns a match leaves alone, ``touched`` a timestamp column a
    match sets to ``now``. Of equal batch keys the last by ``order`` wins.
    """
    stamp = F.current_timestamp() if now is None else now
    return folded(current, one_per_key(batch, keys, "last", order).withColumn(STAMP, stamp), keys, keep, touched)


#: Time that a match sets, and number of the batch a delta's rows came with.
STAMP, VERSION = "_stamp", "_version"


def folded(current: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str] | None, touched: str | None) -> DataFrame:
    """``upsert`` of rows that are one per key and carry the time that a match sets."""
    kept = set(keep or [])
    marked = incoming.withColumn("_new", F.lit(True)).alias("b")
    old = current.withColumn("_old", F.lit(True)).alias("c")
    is_new, is_old = F.col("b._new"), F.col("c._old")

    def merged(field) -> Column:
        name = field.name
        mine, theirs = F.col(f"c.{name}"), F.col(f"b.{name}")
        if name in keys:
            value = F.coalesce(mine, theirs)
        elif name in kept:
            value = F.when(is_old, mine).otherwise(theirs)
        elif name == touched:
            value = F.when(is_new & is_old, F.col(f"b.{STAMP}")).when(is_new, theirs).otherwise(mine)
        else:
            value = F.when(is_new, theirs).otherwise(mine)
        return value.cast(field.dataType).alias(name)

    return old.join(marked, _same_key(keys), "full").select(*[merged(field) for field in current.schema])


# --- in place -----------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """How an overwritten table treats a match: columns it leaves alone and the column that takes the time of the merge."""

    keep: list[str] = field(default_factory=list)
    touched: str | None = None


def append_new(table: KeyedTable, batch: DataFrame, order: str | Column) -> None:
    """Adds the batch's new keys to the table as files of their own; a replay finds them there and adds nothing.

    Keys are read from the files whose range meets the batch's alone.
    """
    table.recover()
    keys = list(table.keys)
    stored_keys = table.read(table.touched(batch))
    fresh = new_keys_only(stored_keys, one_per_key(batch, keys, "first", order), keys)
    table.append(fresh.select(*table.columns))


def overwrite_touched(table: KeyedTable, batch: DataFrame, order: str | Column, rule: Rule, now: Column | None = None) -> None:
    """Upserts the batch into the table, reading and rewriting the files whose range meets the batch's keys.

    Batches set aside before are folded in first. A replay after a failure overwrites the same rows with the same values.
    Many rows are merged by stretches of keys, so that one stretch is shuffled at a time, and take their place together.
    """
    table.recover()
    compact(table, rule)
    rows = batch.count()
    many = rows + sum(r["rows"] for r in table.ranges().values()) > table.slice_rows
    spans = table.stretches(batch) if many else None
    old = table.touched(batch, spans)
    slices = table.slices(spans, rows + sum(table.ranges()[name]["rows"] for name in old)) if many else [F.lit(True)]
    stored = table.read(old)
    merged = (
        upsert(stored.where(part), batch.where(part), list(table.keys), order, rule.keep, rule.touched, now) for part in slices
    )
    table.replace(merged, old)


def add_delta(table: KeyedTable, batch: DataFrame, order: str | Column, version: int, now: Column | None = None) -> None:
    """Sets a batch aside under its number; the stored rows are not read. A replay of a number takes its place."""
    table.recover()
    stamp = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    rows = one_per_key(batch, list(table.keys), "last", order).select(*table.columns, stamp.alias(STAMP))
    whole = " AND ".join(f"`{key}` IS NOT NULL" for key in table.keys)
    name = f"{DELTAS}/{version:010d}"
    rows.where(whole).withColumn(VERSION, F.lit(version).cast("long")).write.mode("overwrite").parquet(table.folder.at(name))


def deltas(table: KeyedTable) -> list[str]:
    """Numbers of the batches that were set aside whole, oldest first."""
    return [name for name in table.folder.names(DELTAS) if table.folder.exists(f"{DELTAS}/{name}/_SUCCESS")]


def resolved_deltas(table: KeyedTable, names: list[str], rule: Rule) -> DataFrame:
    """One row per key of the deltas, as their upserts one after the other would leave it in an empty table."""
    shape = StructType(list(table.schema)).add(STAMP, "timestamp_ntz").add(VERSION, "long")
    rows = table.spark.read.schema(shape).parquet(*[table.folder.at(f"{DELTAS}/{name}") for name in names])
    keys = list(table.keys)
    values = [c for c in table.columns if c not in keys]
    last = F.max_by(F.struct(*values, STAMP), VERSION).alias("last")
    first = F.min_by(F.struct(*values), VERSION).alias("first")
    per_key = rows.groupBy(*keys).agg(last, first, F.count(F.lit(1)).alias("n"))

    def value(name: str) -> Column:
        if name in rule.keep:
            return F.col(f"first.{name}")
        if name == rule.touched:
            return F.when(F.col("n") > 1, F.col(f"last.{STAMP}").cast(table.schema[name].dataType)).otherwise(F.col(f"last.{name}"))
        return F.col(f"last.{name}")

    return per_key.select(*keys, *[value(c).alias(c) for c in values], F.col(f"last.{STAMP}").alias(STAMP))


def read_merged(table: KeyedTable, rule: Rule) -> DataFrame:
    """The table with its deltas merged in; files that no delta can meet are scanned as they are, without a shuffle."""
    names = deltas(table)
    if not names:
        return table.read(table.data_files())
    incoming = resolved_deltas(table, names, rule)
    met = table.touched(incoming)
    rest = table.read(sorted(set(table.data_files()) - set(met)))
    return rest.unionByName(folded(table.read(met), incoming, list(table.keys), rule.keep, rule.touched))


def compact(table: KeyedTable, rule: Rule) -> int:
    """Folds the deltas into the files they meet and drops them, as one logged change; returns how many there were."""
    names = deltas(table)
    if names:
        incoming = resolved_deltas(table, names, rule)
        old = table.touched(incoming)
        table.replace(folded(table.read(old), incoming, list(table.keys), rule.keep, rule.touched), old, names)
    return len(names)
