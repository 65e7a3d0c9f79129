"""Sources and sinks: exports, tables, snapshots, models."""
