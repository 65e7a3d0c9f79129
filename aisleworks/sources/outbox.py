"""The alert outbox: a table that runs write to and whatever sends the alerts reads from.

An alert's key is made of what it is about (kind, priority, store, product, day, channel), not of its text, so a run that
is repeated or resumed adds nothing, and of two runs of a day the first one's text stands. A row is pending until its
delivery is recorded; a failed attempt is counted and stays pending until the attempts are used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aisleworks.operators.alerts import alert_outbox
from aisleworks.sources import snapshots
from aisleworks.sources.keyed_files import KeyedTable

SCHEMA = (
    "alert_key string, alert_type string, priority string, title string, message string, store_id string, "
    "product_id string, created_at date, channel string, state string, attempts int, attempted_at timestamp_ntz"
)
SUBJECT = ["alert_type", "priority", "store_id", "product_id", "created_at", "channel"]
PENDING, SENT, FAILED = "pending", "sent", "failed"
MOST_ATTEMPTS = 5


def outbox_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, StructType.fromDDL(SCHEMA), ("alert_key",))


def alert_key() -> Column:
    """Each part with its length before it, so parts can't run into each other; a missing part is ``-``."""
    parts = []
    for name in SUBJECT:
        text = F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def outbox_rows(routed: DataFrame) -> DataFrame:
    """Pending rows of routed alerts, one per channel."""
    rows = alert_outbox(routed).withColumns(
        {
            "alert_key": alert_key(),
            "state": F.lit(PENDING),
            "attempts": F.lit(0),
            "attempted_at": F.lit(None).cast("timestamp_ntz"),
        }
    )
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMA)])


def post(routed: DataFrame, path: str) -> None:
    """Adds the alerts to the outbox at ``path``; those it has already stay as they are, sent or not."""
    snapshots.append_new(outbox_table(routed.sparkSession, path), outbox_rows(routed), F.col("title"))


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    table = outbox_table(spark, path)
    return table.read(table.data_files())


def due(spark: SparkSession, path: str, channel: str | None = None) -> DataFrame:
    """Rows to be sent, of one channel or all."""
    rows = read_outbox(spark, path).where(F.col("state") == PENDING)
    return rows if channel is None else rows.where(F.col("channel") == channel)


def record_deliveries(outcomes: DataFrame, path: str, most_attempts: int = MOST_ATTEMPTS) -> None:
    """Notes ``alert_key, delivered, attempted_at`` rows: delivered ones are sent, others count an attempt.

    An outcome noted before (no later than the row's last attempt), or of an alert that is not pending, changes nothing, so
    outcomes may be reported again. Of several outcomes of an alert the latest counts.
    """
    table = outbox_table(outcomes.sparkSession, path)
    table.recover()
    latest = snapshots.one_per_key(outcomes, ["alert_key"], "last", F.col("attempted_at")).select(
        "alert_key", F.coalesce("delivered", F.lit(False)).alias("_delivered"), F.col("attempted_at").cast("timestamp_ntz").alias("_at")
    )
    old = table.touched(latest)
    fresh = (F.col("state") == PENDING) & (F.col("attempted_at").isNull() | (F.col("_at") > F.col("attempted_at")))
    attempts = F.col("attempts") + 1
    state = F.when(F.col("_delivered"), SENT).when(attempts >= most_attempts, FAILED).otherwise(PENDING)
    marked = table.read(old).join(latest, "alert_key", "left")
    fresh = F.coalesce(fresh, F.lit(False)) & F.col("_at").isNotNull()
    changed = marked.withColumns(
        {
            "state": F.when(fresh, state).otherwise(F.col("state")),
            "attempts": F.when(fresh, attempts).otherwise(F.col("attempts")),
            "attempted_at": F.when(fresh, F.col("_at")).otherwise(F.col("attempted_at")),
        }
    )
    if old:
        table.replace(changed.select(*table.columns), old)
