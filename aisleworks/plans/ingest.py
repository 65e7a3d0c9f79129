"""Loading exports: scan, clean, merge into the table in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleworks import schemas
from aisleworks.operators import cleaning
from aisleworks.session import materialize, materialized, release
from aisleworks.sources import snapshots
from aisleworks.sources.exports import INGEST_ORDER, read_export
from aisleworks.sources.tables import keyed_table, overwrite_rule

#: Batches set aside in an overwritten table before they are folded into its files.
COMPACT_EVERY = 16


def merge_into(
    spark: SparkSession,
    table: str,
    path: str,
    batch: DataFrame,
    order: str | Column,
    version: int | None = None,
    compact_every: int = COMPACT_EVERY,
) -> None:
    """The table's own conflict rule: overwrite for dates and transactions, keep for the rest.

    A numbered batch of an overwritten table is set aside and folded into the files with others, every ``compact_every``
    batches; readers (``read_tables``) merge it in until then. Small files of the other tables are merged as they gather.
    """
    target = keyed_table(spark, table, path)
    if table not in schemas.OVERWRITTEN:
        snapshots.append_new(target, batch, order)
        target.merge_small_files()
        return
    now, rule = F.current_timestamp().cast("timestamp_ntz"), overwrite_rule(table)
    if version is None:
        snapshots.overwrite_touched(target, batch, order, rule, now)
        return
    snapshots.add_delta(target, batch, order, version, now)
    if len(snapshots.deltas(target)) >= compact_every:
        snapshots.compact(target, rule)


def ingest(spark: SparkSession, table: str, export: str, target: str) -> DataFrame:
    """Load one export into the table at ``target``; returns the rejected rows with their reason.

    The export is parsed and judged once: the judged rows are written to the shared folder, from where the merge
    reads the valid ones. The rejects stay written there until ``release`` is called on them.
    """
    raw = read_export(spark, export, lower_header=table == "category")
    judged = cleaning.JOBS[table](raw, carry=[INGEST_ORDER])
    with materialized(judged.rows, "judged") as written:
        outcome = judged.over(written)
        valid = outcome.valid
        if table == "category":
            valid = cleaning.with_parent_categories(valid)
        merge_into(spark, table, target, valid, INGEST_ORDER)
        return materialize(outcome.rejects, "rejects")


def ingest_festival_products(spark: SparkSession, export: str, target: str) -> None:
    """The product lists of the festival export."""
    links = cleaning.festival_products(read_export(spark, export), carry=[INGEST_ORDER])
    ordered = links.withColumn(INGEST_ORDER, F.struct(INGEST_ORDER, "rank"))
    with materialized(ordered, "links") as written:
        merge_into(spark, "festival_products", target, written, INGEST_ORDER)


__all__ = ["ingest", "ingest_festival_products", "merge_into", "release"]
