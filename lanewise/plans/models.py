"""Curated models. Builders are pure plans; they return anything that is no DataFrame as it came."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import columns as C
from lanewise.operators.latest import SHIPMENT_TIES, latest_carriers, latest_events, latest_shipments
from lanewise.operators.regions import enrich_delivery_events_with_region, enrich_shipments_with_region
from lanewise.operators.standardize import normalize_region_code_values, standardize_carrier_names, standardize_columns

UNKNOWN = "UNKNOWN"
GRAIN = ["p_date", "region_code", "carrier_id"]


def _keyed(df: DataFrame, *names: str) -> DataFrame:
    there = [n for n in names if n in df.columns]
    return df.withColumns({n: F.upper(F.trim(F.col(n))) for n in there}) if there else df


def _tidy_key(df: DataFrame, name: str) -> DataFrame:
    """The key as ``standardize_columns`` and ``_keyed`` make it, so that the latest row can be taken before the rest is standardized."""
    return df.withColumn(name, F.upper(C.clean_text(F.col(name)))) if name in df.columns else df


def _present(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(n for n in names if n in df.columns))


def _known(df: DataFrame, *names: str) -> Column:
    """The first of the columns that there are which is not null, else UNKNOWN."""
    return F.coalesce(*(F.col(n) for n in names if n in df.columns), F.lit(UNKNOWN))


def _day(*names: str) -> Column:
    return F.coalesce(*(F.to_date(F.col(n)) for n in names), F.current_date())


def build_dim_carrier(stg_carriers_df: Any, run_date: str | None = None) -> Any:
    """A carrier's latest row, dated by the run."""
    if not isinstance(stg_carriers_df, DataFrame):
        return stg_carriers_df
    rows = normalize_region_code_values(standardize_carrier_names(stg_carriers_df), ["home_region_code", "region_code"])
    rows = latest_carriers(_keyed(rows, "carrier_id"))
    date = F.to_date(F.lit(run_date)) if run_date else F.current_date()
    rows = rows.withColumns({"p_date": date, "region_code": _known(rows, "home_region_code", "region_code"), "carrier_id": _known(rows, "carrier_id")})
    return _present(rows, "carrier_id", "carrier_name", "scac", "service_mode", "region_code", "is_active", "updated_at", "p_date")


def build_fct_shipment(stg_shipments_df: Any, region_lookup_df: Any = None) -> Any:
    """A shipment's latest row, with its regions, delivery flags, delay, transit time and pick-up day."""
    if not isinstance(stg_shipments_df, DataFrame):
        return stg_shipments_df
    rows = _keyed(standardize_columns(latest_shipments(_tidy_key(stg_shipments_df, "shipment_id")), ["shipment_id"]), "carrier_id")
    if isinstance(region_lookup_df, DataFrame):
        rows = enrich_shipments_with_region(rows, region_lookup_df, tidy=True)
    picked, promised, actual = F.col("pickup_ts"), F.col("promised_delivery_ts"), F.col("actual_delivery_ts")
    overdue = actual.isNull() & (F.col("updated_at") > promised)
    rows = rows.withColumns(
        {
            "region_code": _known(rows, "region_code"),
            "carrier_id": _known(rows, "carrier_id"),
            "delivered_flag": C.flag(actual.isNotNull()),
            "on_time_delivery_flag": C.flag(actual <= promised),
            "delay_minutes": C.delay_minutes(actual, promised),
            "exception_flag": C.flag(F.col("destination_state").isNull() | F.coalesce(overdue, F.lit(False))),
            "transit_time_hours": C.transit_hours(picked, actual),
            "p_date": _day("pickup_ts", "promised_delivery_ts", "updated_at"),
        }
    )
    return _present(
        rows, "shipment_id", "carrier_id", "origin_state", "destination_state", "origin_region_code", "region_code", "pickup_ts", "promised_delivery_ts", "actual_delivery_ts", "updated_at",
        "shipping_cost_usd", "distance_miles", "delivered_flag", "on_time_delivery_flag", "delay_minutes", "exception_flag", "transit_time_hours", "p_date",
    )


_SHIPMENT_NEEDS = ("carrier_id", "destination_state", "region_code", "pickup_ts", "promised_delivery_ts", "updated_at")
_OF_SHIPMENT = {"carrier_id": "__carrier", "pickup_ts": "__picked", "promised_delivery_ts": "__promised", "__region": "__shipment_region", "region_code": "__base_region"}


def build_fct_delivery_event(stg_events_df: Any, stg_shipments_df: Any = None, region_lookup_df: Any = None) -> Any:
    """An event's latest row, with its shipment's carrier and dates. The region of the event's state beats the shipment's."""
    if not isinstance(stg_events_df, DataFrame):
        return stg_events_df
    looked_up = isinstance(region_lookup_df, DataFrame)
    rows = _keyed(standardize_columns(latest_events(_tidy_key(stg_events_df, "event_id")), ["event_id"]), "shipment_id")
    if looked_up:
        rows = enrich_delivery_events_with_region(rows, region_lookup_df, "event_state", "__event_region", tidy=True)
    if isinstance(stg_shipments_df, DataFrame):
        if "delivered_flag" in stg_shipments_df.columns:
            shipments = stg_shipments_df  # shipment facts: one tidy row a shipment
        else:
            needed = _present(_tidy_key(stg_shipments_df, "shipment_id"), *dict.fromkeys(("shipment_id", *_SHIPMENT_NEEDS, *SHIPMENT_TIES)))
            shipments = _keyed(standardize_columns(_present(latest_shipments(needed), "shipment_id", *_SHIPMENT_NEEDS), ["shipment_id"]), "carrier_id")
        if looked_up:
            shipments = enrich_shipments_with_region(shipments, region_lookup_df, output_region_column="__region", include_origin_region=False, tidy=True)
        shipments = _present(shipments, "shipment_id", *_OF_SHIPMENT).withColumnsRenamed(_OF_SHIPMENT)
        rows = rows.join(shipments, "shipment_id", "left")
    else:
        rows = rows.withColumns({"__picked": F.lit(None).cast("timestamp"), "__promised": F.lit(None).cast("timestamp")})
    at, delivered = F.col("event_ts"), F.col("event_type") == "DELIVERED"
    rows = rows.withColumns(
        {
            "carrier_id": _known(rows, "__carrier", "carrier_id"),
            "region_code": _known(rows, "__event_region", "__shipment_region", "__base_region", "region_code"),
            "p_date": _day("event_ts", "updated_at"),
            "on_time_delivery_flag": C.flag(delivered & (at <= F.col("__promised"))),
            "delay_minutes": C.delay_minutes(at, F.col("__promised")),
            "exception_flag": C.flag(F.col("event_type").isin("EXCEPTION", "HOLD")),
            "transit_time_hours": F.when(delivered, C.transit_hours(F.col("__picked"), at)),
        }
    )
    return _present(
        rows, "event_id", "shipment_id", "carrier_id", "event_type", "event_ts", "event_city", "event_state", "delay_reason", "attempt_number", "updated_at",
        "region_code", "p_date", "on_time_delivery_flag", "delay_minutes", "exception_flag", "transit_time_hours",
    )


def _grain(df: DataFrame) -> dict[str, Column]:
    date = F.coalesce("p_date", F.current_date()) if "p_date" in df.columns else F.current_date()
    return {"p_date": date, "region_code": _known(df, "region_code"), "carrier_id": _known(df, "carrier_id")}


def _sum(value: str, default: float = 0) -> Column:
    return F.sum(F.coalesce(F.col(value), F.lit(default)))


def _steady_sum(value: str) -> Column:
    """Sum of doubles as decimals, so that the order of rows, or a task that runs again, can't change the last digits.

    What is no decimal of six places (NaN, infinities, huge values) is added as it is.
    """
    exact = F.col(value).try_cast("decimal(28,6)")
    rest = F.sum(F.when(exact.isNull(), F.col(value)))
    return F.coalesce(F.sum(exact).cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))


def build_agg_shipment_daily(fct_shipment_df: Any) -> Any:
    """Shipments by day, region and carrier."""
    if not isinstance(fct_shipment_df, DataFrame):
        return fct_shipment_df
    late = F.col("delay_minutes") > 0
    counts = {"delivered_shipments": "delivered_flag", "on_time_shipments": "on_time_delivery_flag", "exception_shipments": "exception_flag"}
    totals = {n: _sum(c).cast("bigint").alias(n) for n, c in counts.items()}
    out = (
        fct_shipment_df.withColumns(_grain(fct_shipment_df))
        .groupBy(*GRAIN)
        .agg(
            F.count_distinct("shipment_id").alias("total_shipments"),
            totals["delivered_shipments"],
            totals["on_time_shipments"],
            F.sum(C.flag(late)).cast("bigint").alias("delayed_shipments"),
            totals["exception_shipments"],
            _sum("delay_minutes", 0.0).alias("total_delay_minutes"),
            F.avg(F.when(late, F.col("delay_minutes"))).alias("avg_delay_minutes"),
            F.avg("transit_time_hours").alias("avg_transit_time_hours"),
            _steady_sum("shipping_cost_usd").alias("total_shipping_cost_usd"),
            _steady_sum("distance_miles").alias("total_distance_miles"),
        )
    )
    return out.withColumns(
        {
            "on_time_delivery_rate": C.ratio(F.col("on_time_shipments"), F.col("delivered_shipments")),
            "exception_rate": C.ratio(F.col("exception_shipments"), F.col("total_shipments")),
            "avg_cost_per_mile": C.ratio(F.col("total_shipping_cost_usd"), F.col("total_distance_miles")),
        }
    )


EVENT_COUNTS = ("total_delivery_events", "delivered_event_shipments", "first_attempt_success_shipments")


def delivery_event_metrics(fct_delivery_event_df: DataFrame) -> DataFrame:
    """Events, shipments delivered, and shipments delivered at the first attempt, by day, region and carrier."""
    delivered = F.col("event_type") == "DELIVERED"
    return fct_delivery_event_df.groupBy(*GRAIN).agg(
        F.count(F.lit(1)).alias("total_delivery_events"),
        F.count_distinct(F.when(delivered, F.col("shipment_id"))).alias("delivered_event_shipments"),
        F.count_distinct(F.when(delivered & (F.col("attempt_number") == 1), F.col("shipment_id"))).alias("first_attempt_success_shipments"),
    )


def build_kpi_delivery_daily(agg_shipment_daily_df: Any, fct_delivery_event_df: Any = None) -> Any:
    """Delivery KPIs by day, region and carrier. Columns that the aggregate lacks count as 0."""
    if not isinstance(agg_shipment_daily_df, DataFrame):
        return agg_shipment_daily_df
    df = agg_shipment_daily_df
    counts = ("total_shipments", "delivered_shipments", "on_time_shipments", "delayed_shipments", "exception_shipments")
    sums = ("total_shipping_cost_usd", "total_distance_miles")
    given = lambda n, kind, default: (F.col(n) if n in df.columns else F.lit(default)).cast(kind)
    base = df.select(*(c.alias(n) for n, c in _grain(df).items()), *(given(n, "bigint", 0).alias(n) for n in counts), *(given(n, "double", 0.0).alias(n) for n in sums), given("avg_transit_time_hours", "double", None).alias("avg_transit_time_hours"))
    if isinstance(fct_delivery_event_df, DataFrame):
        base = base.join(delivery_event_metrics(fct_delivery_event_df), GRAIN, "left")
    else:
        base = base.withColumns({n: F.lit(None).cast("bigint") for n in EVENT_COUNTS})
    base = base.withColumns({n: F.coalesce(n, F.lit(0).cast("bigint")) for n in EVENT_COUNTS})
    done, total = F.greatest("delivered_event_shipments", "delivered_shipments"), F.col("total_shipments")
    kpis = {
        "on_time_delivery_rate": C.ratio(F.col("on_time_shipments"), done),
        "avg_transit_hours": F.coalesce("avg_transit_time_hours", F.lit(0.0)),
        "late_delivery_rate": C.ratio(F.col("delayed_shipments"), done),
        "first_attempt_success_rate": C.ratio(F.col("first_attempt_success_shipments"), done),
        "exception_rate": C.ratio(F.col("exception_shipments"), total),
        "avg_cost_per_mile": C.ratio(F.col("total_shipping_cost_usd"), F.col("total_distance_miles")),
        "volume_by_carrier": total,
        "delivery_event_density": C.ratio(F.col("total_delivery_events"), total),
    }
    return base.select(*GRAIN, *(c.alias(n) for n, c in kpis.items()), *counts, "total_delivery_events")
