"""Schemas of the raw tables, table lists, policy constants and column lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_KINDS = {"str": T.StringType(), "dbl": T.DoubleType(), "long": T.LongType(), "date": T.DateType()}


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split(":") for x in spec.split())])


RAW: dict[str, T.StructType] = {
    "products": _schema("product_id:str product_name:str category:str unit_cost:dbl unit_price:dbl shelf_life_days:long supplier_id:str lead_time_days:long target_service_level:dbl"),
    "suppliers": _schema("supplier_id:str supplier_name:str supplier_region:str reliability_score:dbl average_lead_time_days:long lead_time_variability:dbl minimum_order_qty:long"),
    "warehouses": _schema("warehouse_id:str warehouse_name:str region:str storage_capacity_units:long"),
    "inventory_snapshots": _schema("snapshot_date:date warehouse_id:str product_id:str on_hand_units:long on_order_units:long reserved_units:long available_units:long inventory_value:dbl days_of_supply:dbl"),
    "demand_history": _schema("date:date warehouse_id:str product_id:str region:str units_demanded:long units_fulfilled:long units_lost_sales:long stockout_flag:long promo_flag:long seasonality_index:dbl"),
    "purchase_orders": _schema("po_id:str supplier_id:str product_id:str warehouse_id:str order_date:date expected_arrival_date:date actual_arrival_date:date ordered_units:long received_units:long late_delivery_flag:long"),
    "product_classification": _schema("product_id:str abc_class:str criticality_level:str"),
}

KEYS: dict[str, list[str]] = {
    "products": ["product_id"],
    "suppliers": ["supplier_id"],
    "warehouses": ["warehouse_id"],
    "inventory_snapshots": ["snapshot_date", "warehouse_id", "product_id"],
    "demand_history": ["date", "warehouse_id", "product_id"],
    "purchase_orders": ["po_id"],
    "product_classification": ["product_id"],
}

DAILY_COLUMNS = [
    "date", "warehouse_id", "region", "product_id", "category", "supplier_id", "abc_class", "criticality_level", "units_demanded", "units_fulfilled", "units_lost_sales",
    "stockout_flag", "fill_rate", "promo_flag", "on_hand_units", "on_order_units", "available_units", "days_of_supply", "inventory_value", "lost_sales_revenue", "service_gap_units",
]


@dataclass(frozen=True)
class Policy:
    """(good, bad) bounds of the linear scores and (low, high) bounds of the share scores."""

    fill_gap: tuple[float, float] = (0.01, 0.15)
    service_gap: tuple[float, float] = (0.0, 0.20)
    stockout_rate: tuple[float, float] = (0.01, 0.18)
    persistence: tuple[float, float] = (0.10, 0.65)
    dos_stretch: tuple[float, float] = (1.0, 2.25)
    excess_days: tuple[float, float] = (0.05, 0.40)
    slow_moving: tuple[float, float] = (0.01, 0.12)
    criticality: tuple[float, float] = (0.45, 0.85)
    late: tuple[float, float] = (0.05, 0.45)
    delay: tuple[float, float] = (0.5, 5.0)
    lead_time: tuple[float, float] = (1.5, 10.0)
    underfill: tuple[float, float] = (0.0, 0.08)
    lost_share: tuple[float, float] = (0.0005, 0.08)
    inventory_share: tuple[float, float] = (0.001, 0.12)


@dataclass(frozen=True)
class Assumptions:
    """What the money impact assumes."""

    slow_weight: float = 0.50
    margin_recovery: float = 0.35
    capital_release: float = 0.25
    delay_weights: tuple[float, float, float] = (0.45, 0.35, 0.20)
    delay_norm: float = 7.0
    lead_time_norm: float = 10.0
    missing_margin: float = 0.30
    missing_delay: float = 0.25
    top_margin: float = 0.90
