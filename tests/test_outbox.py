import datetime as dt

import pytest
from pyspark.sql import functions as F

from aisleworks.operators import alerts
from aisleworks.sources import outbox
from tests.conftest import by, rows

DAY = dt.date(2026, 3, 1)
ALERT = "alert_type string, priority string, title string, message string, store_id string, product_id string, created_at date, data string"


def routed(spark, title="t", stores=("S1", "S2", None)):
    found = [("RESTOCK", "CRITICAL", title, "m", s, None, DAY, None) for s in stores]
    return alerts.route_alerts(spark.createDataFrame(found, ALERT), dry_run=False)


def outcome(spark, path, delivered, hour, channel="telegram"):
    at = F.lit(f"2026-03-01 {hour:02d}:00:00").cast("timestamp_ntz").alias("attempted_at")
    return outbox.due(spark, path, channel).select("alert_key", F.lit(delivered).alias("delivered"), at)


def test_alerts_are_posted_once(spark, tmp_path):
    path = str(tmp_path / "outbox")
    outbox.post(routed(spark), path)
    first = rows(outbox.read_outbox(spark, path).orderBy("alert_key"))
    assert len(first) == 6 and {r["state"] for r in first} == {"pending"} and len({r["alert_key"] for r in first}) == 6
    outbox.post(routed(spark), path)
    outbox.post(routed(spark, "changed text"), path)  # the same alerts, however they are put
    assert rows(outbox.read_outbox(spark, path).orderBy("alert_key")) == first
    outbox.post(routed(spark, stores=("S3",)), path)
    assert outbox.read_outbox(spark, path).count() == 8


def test_missing_and_odd_parts_keep_keys_apart(spark, tmp_path):
    path = str(tmp_path / "outbox")
    outbox.post(routed(spark, stores=(None, "-", "", "4:x", "x")), path)
    assert outbox.read_outbox(spark, path).count() == 10


def test_deliveries_count_attempts_and_end(spark, tmp_path):
    path = str(tmp_path / "outbox")
    outbox.post(routed(spark, stores=("S1",)), path)
    failed = spark.createDataFrame(outcome(spark, path, False, 8).collect())
    for _ in range(2):  # reported twice, counted once
        outbox.record_deliveries(failed, path)
    state = by(outbox.read_outbox(spark, path), "channel")
    assert (state["telegram"]["state"], state["telegram"]["attempts"]) == ("pending", 1) and state["whatsapp"]["attempts"] == 0
    outbox.record_deliveries(outcome(spark, path, True, 9), path)
    sent = by(outbox.read_outbox(spark, path), "channel")["telegram"]
    assert (sent["state"], sent["attempts"], sent["attempted_at"].hour) == ("sent", 2, 9)
    assert outbox.due(spark, path, "telegram").count() == 0
    outbox.post(routed(spark, stores=("S1",)), path)  # a later run does not raise what was sent
    assert outbox.due(spark, path, "telegram").count() == 0
    for hour in (10, 11):
        outbox.record_deliveries(outcome(spark, path, False, hour, "whatsapp"), path, most_attempts=2)
    assert by(outbox.read_outbox(spark, path), "channel")["whatsapp"]["state"] == "failed"


def test_a_run_that_sends_needs_an_outbox(spark, tmp_path):
    from aisleworks.plans.agents import _posted

    with pytest.raises(ValueError):
        _posted(routed(spark), False, None)
    _posted(routed(spark), True, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    _posted(routed(spark), False, str(tmp_path / "some"))
    assert outbox.read_outbox(spark, str(tmp_path / "some")).count() == 6
