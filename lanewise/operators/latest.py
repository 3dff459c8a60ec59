"""The latest row of each key, in a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], ties: Sequence[str] = ()) -> DataFrame:
    """One row a key: the first by ``order``, then by ``ties`` ascending, nulls last.

    Catalyst plans the filter on the rank as a partial and a final group limit, so a key's losers are
    dropped before the shuffle.
    """
    if any(k not in df.columns for k in keys):
        return df
    by = [*order, *(F.col(t).asc_nulls_last() for t in ties if t in df.columns)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(by or [F.lit(1)])))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def newest(*names: str) -> list[Column]:
    return [F.col(n).desc_nulls_last() for n in names]


SHIPMENT_TIES = ("carrier_id", "shipping_cost_usd", "distance_miles", "origin_state", "destination_state", "promised_delivery_ts", "actual_delivery_ts")
CARRIER_TIES = ("scac", "service_mode", "home_region_code", "is_active")
EVENT_TIES = ("shipment_id", "event_type", "event_state", "event_city", "delay_reason", "attempt_number")


def latest_shipments(df: DataFrame) -> DataFrame:
    return latest_by(df, ["shipment_id"], newest(*(c for c in ("updated_at", "pickup_ts") if c in df.columns)), SHIPMENT_TIES)


def latest_carriers(df: DataFrame) -> DataFrame:
    return latest_by(df, ["carrier_id"], [*newest("updated_at"), F.col("carrier_name").asc_nulls_last()], CARRIER_TIES)


def latest_events(df: DataFrame) -> DataFrame:
    return latest_by(df, ["event_id"], newest(*(c for c in ("updated_at", "event_ts") if c in df.columns)), EVENT_TIES)
