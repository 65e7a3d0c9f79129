"""Incremental loads: the batch merge called from a stream's foreachBatch."""
