"""Staging: trimmed and cased keys, rows without their keys left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _upper(name: str) -> Column:
    return F.upper(F.trim(F.col(name))).alias(name)


def _trim(name: str) -> Column:
    return F.trim(F.col(name)).alias(name)


def _as(name: str, kind: str) -> Column:
    return F.col(name).cast(kind).alias(name)


def stage_shipments(raw: DataFrame) -> DataFrame:
    keys = [_upper(c) for c in ("shipment_id", "carrier_id", "origin_state", "destination_state")]
    return raw.filter("shipment_id is not null and carrier_id is not null").select(*keys, "pickup_ts", "promised_delivery_ts", "actual_delivery_ts", _as("shipping_cost_usd", "double"), _as("distance_miles", "double"), "updated_at")


def stage_carriers(raw: DataFrame) -> DataFrame:
    kept = raw.filter("carrier_id is not null and carrier_name is not null and service_mode is not null")
    return kept.select(_upper("carrier_id"), _trim("carrier_name"), *(_upper(c) for c in ("scac", "service_mode", "home_region_code")), _as("is_active", "boolean"), "updated_at")


def stage_delivery_events(raw: DataFrame) -> DataFrame:
    kept = raw.filter("event_id is not null and shipment_id is not null and event_type is not null")
    return kept.select(*(_upper(c) for c in ("event_id", "shipment_id", "event_type")), "event_ts", _trim("event_city"), *(_upper(c) for c in ("event_state", "delay_reason")), _as("attempt_number", "int"), "updated_at")
