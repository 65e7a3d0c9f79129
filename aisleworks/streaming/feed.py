"""A feed of exports merged batch by batch into a table in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from aisleworks.plans.ingest import COMPACT_EVERY, merge_into


def merge_batches(
    table: str, path: str, order: str | Column, compact_every: int = COMPACT_EVERY
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges cleaned rows into the table at ``path``.

    ``order`` decides between rows of one key in a batch. A batch is computed once and kept for the merge's readers.
    One replayed after a failure changes nothing it has already done: an insert finds its keys, an overwrite is set aside
    under the batch's number again. A batch costs what it holds; every ``compact_every`` batches are folded into the files.
    """

    def merge_one(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            merge_into(batch.sparkSession, table, path, kept, order, batch_id, compact_every)
        finally:
            kept.unpersist()

    return merge_one
