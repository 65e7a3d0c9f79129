"""The restock and expiry runs: decisions turned into orders, alerts and supplier messages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from aisleworks.operators import alerts, decisions, orders
from aisleworks.plans.presentation import present
from aisleworks.plans.reports import within
from aisleworks.session import materialize, release
from aisleworks.sources.outbox import post
from aisleworks.sources.tables import Tables


@dataclass
class RestockRun:
    """``lines`` are the written order lines, ``orders`` the same in presentation order; ``close`` deletes them."""

    lines: DataFrame
    orders: DataFrame
    summary: DataFrame
    totals: DataFrame

    def close(self) -> None:
        release(self.lines)


@dataclass
class RestockNotice:
    run: RestockRun
    alerts: DataFrame
    supplier_orders: DataFrame


def restock_run(
    tables: Tables,
    forecast: DataFrame | Callable[[DataFrame], DataFrame],
    stores: list | None = None,
    top_n: int = orders.TOP_N,
    as_of: dt.date | str | None = None,
) -> RestockRun:
    """Orders of all (or the named) stores in one plan, written once for the summaries to read.

    ``Forecasting.weekly_quantity`` given as it stands (a function of keys) is only asked for the chosen lines.
    """
    within("top_n", top_n, 1, 200)
    t = tables
    candidates = decisions.restock_candidates(
        t.inventory, t.product, t.category, t.store, t.supplier, as_of=as_of
    )
    lines = materialize(orders.restock_orders(candidates, forecast, top_n, stores, as_of), "restock-orders")
    scanned = t.store if stores is None else t.store.where(t.store["store_id"].isin(list(stores)))
    return RestockRun(
        lines,
        present("restock_orders", lines),
        orders.restock_run_summary(lines, scanned),
        orders.restock_run_totals(lines, as_of),
    )


def restock_notify(
    tables: Tables,
    forecast: DataFrame | Callable[[DataFrame], DataFrame],
    stores: list | None = None,
    as_of: dt.date | str | None = None,
    dry_run: bool = True,
    outbox: str | None = None,
    **letter,
) -> RestockNotice:
    """A restock run plus its routed alerts and supplier messages.

    ``letter`` takes the ``sender`` and ``signature`` printed in the messages. Unless it is a dry run, the alerts are
    written to the table at ``outbox``, each once.
    """
    run = restock_run(tables, forecast, stores, as_of=as_of)
    routed = _posted(alerts.route_alerts(alerts.restock_alerts(run.lines, as_of), dry_run), dry_run, outbox)
    messages = orders.supplier_messages(run.lines, as_of, dry_run=dry_run, **letter)
    return RestockNotice(run, routed, present("supplier_orders", messages))


def _posted(routed: DataFrame, dry_run: bool, outbox: str | None) -> DataFrame:
    if not dry_run:
        if outbox is None:
            raise ValueError("name the outbox that alerts are to be written to, or make it a dry run")
        post(routed, outbox)
    return routed


def expiry_notify(
    tables: Tables,
    days_window: int = 30,
    as_of: dt.date | str | None = None,
    dry_run: bool = True,
    outbox: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Expiring items and the routed alerts about them, which are written to ``outbox`` unless it is a dry run."""
    t = tables
    items = decisions.expiry_alerts(t.inventory, t.product, t.category, t.store, as_of, days_window)
    return present("expiry_alerts", items), _posted(
        alerts.route_alerts(alerts.expiry_alert_rollup(items, as_of), dry_run), dry_run, outbox
    )
