"""Every analytic and decision report over a set of tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from aisleworks.operators import decisions, festivals, spikes, taste, trends
from aisleworks.plans.presentation import present
from aisleworks.sources.tables import Tables


def within(name: str, value, low, high):
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value}")
    return value


class Reports:
    """Reports in presentation order. ``as_of`` replaces "today"; ``stores`` limits the taste reports."""

    def __init__(self, tables: Tables, as_of: dt.date | str | None = None, stores: list | None = None):
        self.tables, self.as_of, self.stores = tables, as_of, stores

    def category_trends(self) -> DataFrame:
        t = self.tables
        return present("category_trends", trends.category_trends(t.transaction, t.date, t.product, t.category))

    def store_trends(self) -> DataFrame:
        t = self.tables
        return present("store_trends", trends.store_trends(t.transaction, t.date, t.store))

    def demand_spikes(self, z_threshold: float = 2.0) -> DataFrame:
        t = self.tables
        within("z_threshold", z_threshold, 1.0, 4.0)
        found = spikes.demand_spikes(t.transaction, t.date, t.product, t.category, z_threshold)
        return present("demand_spikes", found)

    def category_demand_status(self) -> DataFrame:
        t = self.tables
        status = spikes.category_demand_status(t.transaction, t.date, t.product, t.category)
        return present("category_demand_status", status)

    def weather_demand(self) -> DataFrame:
        t = self.tables
        return present("weather_demand", spikes.weather_demand(t.transaction, t.date, t.external_factors))

    def upcoming_festivals(self, days_ahead: int = 30) -> DataFrame:
        within("days_ahead", days_ahead, 1, 90)
        coming = festivals.upcoming_festivals(self.tables.festival, self.as_of, days_ahead)
        return present("upcoming_festivals", coming)

    def festival_product_recs(self, festival_id: str | None = None) -> DataFrame:
        t = self.tables
        recs = festivals.festival_product_recs(
            t.festival_products, t.product, t.category, t.inventory, t.transaction, t.date, self.as_of, festival_id
        )
        return present("festival_product_recs", recs)

    def festival_day_revenue(self) -> DataFrame:
        t = self.tables
        return festivals.festival_day_revenue(t.transaction, t.date, t.external_factors)

    def festival_uplift(self) -> DataFrame:
        t = self.tables
        return festivals.festival_uplift(t.transaction, t.date, t.external_factors)

    def store_category_preferences(self) -> DataFrame:
        t = self.tables
        liked = taste.store_category_preferences(t.transaction, t.store, t.product, t.category, self.stores)
        return present("store_category_preferences", liked)

    def seasonal_category_mix(self) -> DataFrame:
        t = self.tables
        mix = taste.seasonal_category_mix(t.transaction, t.date, t.product, t.category)
        return present("seasonal_category_mix", mix)

    def payment_preference(self) -> DataFrame:
        t = self.tables
        return present("payment_preference", taste.payment_preference(t.transaction, t.store, self.stores))

    def customer_type_breakdown(self) -> DataFrame:
        t = self.tables
        kinds = taste.customer_type_breakdown(t.transaction, t.store, t.customer, self.stores)
        return present("customer_type_breakdown", kinds)

    def restock_candidates(self, store_id=None, latest_only: bool = False) -> DataFrame:
        t = self.tables
        found = decisions.restock_candidates(
            self._inventory(latest_only), t.product, t.category, t.store, t.supplier, store_id, self.as_of
        )
        return present("restock_candidates", found)

    def stockout_alerts(self, latest_only: bool = False) -> DataFrame:
        t = self.tables
        out = decisions.stockout_alerts(self._inventory(latest_only), t.product, t.category, t.store, t.supplier)
        return present("stockout_alerts", out)

    def expiry_alerts(self, days_window: int = 90, latest_only: bool = False) -> DataFrame:
        t = self.tables
        within("days_window", days_window, 1, 365)
        due = decisions.expiry_alerts(
            self._inventory(latest_only), t.product, t.category, t.store, self.as_of, days_window
        )
        return present("expiry_alerts", due)

    def low_margin_products(self) -> DataFrame:
        t = self.tables
        return present("low_margin_products", decisions.low_margin_products(t.product, t.category, t.supplier))

    def _inventory(self, latest_only: bool) -> DataFrame:
        return decisions.latest_inventory(self.tables.inventory) if latest_only else self.tables.inventory
