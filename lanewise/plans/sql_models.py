"""The curated models as Spark SQL, over frames passed by name.

They differ from the builders where SQL models differ by contract: no origin region, the aggregate counts events,
the look-up is not deduplicated, and the KPI model has no counts passed through. Constants are DOUBLE, so ratios are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIM_CARRIER = """
SELECT coalesce(upper(trim(carrier_id)), 'UNKNOWN') AS carrier_id, carrier_name, scac, service_mode,
  coalesce(home_region_code, 'UNKNOWN') AS region_code, is_active, updated_at, to_date(:run_date) AS p_date
FROM (SELECT *, row_number() OVER (PARTITION BY carrier_id ORDER BY updated_at DESC NULLS LAST, carrier_name NULLS LAST, scac NULLS LAST, service_mode NULLS LAST) AS rn FROM {carriers})
WHERE rn = 1
"""

# The facts go into several models, so they have subqueries and no WITH: Spark can't take one frame's WITH twice into a plan.
FCT_SHIPMENT = """
SELECT s.shipment_id, coalesce(s.carrier_id, 'UNKNOWN') AS carrier_id, s.origin_state, s.destination_state,
  coalesce(r.region_code, 'UNKNOWN') AS region_code, s.pickup_ts, s.promised_delivery_ts, s.actual_delivery_ts, s.updated_at, s.shipping_cost_usd, s.distance_miles,
  if(s.actual_delivery_ts IS NOT NULL, 1, 0) AS delivered_flag,
  if(s.actual_delivery_ts <= s.promised_delivery_ts, 1, 0) AS on_time_delivery_flag,
  CASE WHEN s.actual_delivery_ts IS NOT NULL AND s.promised_delivery_ts IS NOT NULL
    THEN greatest((unix_timestamp(s.actual_delivery_ts) - unix_timestamp(s.promised_delivery_ts)) / 60D, 0D) END AS delay_minutes,
  if(s.destination_state IS NULL OR (s.actual_delivery_ts IS NULL AND s.updated_at > s.promised_delivery_ts), 1, 0) AS exception_flag,
  (unix_timestamp(s.actual_delivery_ts) - unix_timestamp(s.pickup_ts)) / 3600D AS transit_time_hours,
  coalesce(to_date(s.pickup_ts), to_date(s.promised_delivery_ts), to_date(s.updated_at), current_date()) AS p_date
FROM (
  SELECT *, row_number() OVER (PARTITION BY shipment_id
    ORDER BY updated_at DESC NULLS LAST, pickup_ts DESC NULLS LAST, carrier_id NULLS LAST, shipping_cost_usd NULLS LAST, distance_miles NULLS LAST) AS rn FROM {shipments}) s
LEFT JOIN {lookup} r ON s.destination_state = r.state_code
WHERE s.rn = 1
"""

FCT_DELIVERY_EVENT = """
SELECT e.event_id, e.shipment_id, coalesce(s.carrier_id, 'UNKNOWN') AS carrier_id, e.event_type, e.event_ts, e.event_city, e.event_state, e.delay_reason, e.attempt_number, e.updated_at,
  coalesce(er.region_code, sr.region_code, 'UNKNOWN') AS region_code,
  coalesce(to_date(e.event_ts), to_date(e.updated_at), current_date()) AS p_date,
  if(e.event_type = 'DELIVERED' AND e.event_ts <= s.promised_delivery_ts, 1, 0) AS on_time_delivery_flag,
  CASE WHEN e.event_ts IS NOT NULL AND s.promised_delivery_ts IS NOT NULL
    THEN greatest((unix_timestamp(e.event_ts) - unix_timestamp(s.promised_delivery_ts)) / 60D, 0D) END AS delay_minutes,
  if(e.event_type IN ('EXCEPTION', 'HOLD'), 1, 0) AS exception_flag,
  CASE WHEN e.event_type = 'DELIVERED' THEN (unix_timestamp(e.event_ts) - unix_timestamp(s.pickup_ts)) / 3600D END AS transit_time_hours
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY updated_at DESC NULLS LAST, event_ts DESC NULLS LAST) AS rn FROM {events}) e
LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY updated_at DESC NULLS LAST, pickup_ts DESC NULLS LAST, carrier_id NULLS LAST, shipping_cost_usd NULLS LAST, distance_miles NULLS LAST) AS rn
  FROM {shipments}) s ON e.shipment_id = s.shipment_id AND s.rn = 1
LEFT JOIN {lookup} er ON e.event_state = er.state_code
LEFT JOIN {lookup} sr ON s.destination_state = sr.state_code
WHERE e.rn = 1
"""

AGG_SHIPMENT_DAILY = """
WITH s AS (
  SELECT p_date, region_code, carrier_id, count(DISTINCT shipment_id) AS total_shipments, sum(delivered_flag) AS delivered_shipments,
    sum(on_time_delivery_flag) AS on_time_shipments, count_if(delay_minutes > 0) AS delayed_shipments, sum(exception_flag) AS exception_shipments,
    sum(coalesce(delay_minutes, 0D)) AS total_delay_minutes, avg(delay_minutes) FILTER (WHERE delay_minutes > 0) AS avg_delay_minutes,
    avg(transit_time_hours) AS avg_transit_time_hours, CAST(sum(CAST(coalesce(shipping_cost_usd, 0D) AS DECIMAL(28, 6))) AS DOUBLE) AS total_shipping_cost_usd, CAST(sum(CAST(coalesce(distance_miles, 0D) AS DECIMAL(28, 6))) AS DOUBLE) AS total_distance_miles
  FROM {fct_shipment} GROUP BY ALL),
e AS (SELECT p_date, region_code, carrier_id, count(*) AS n FROM {fct_delivery_event} GROUP BY ALL)
SELECT s.*, coalesce(e.n, 0) AS total_delivery_events,
  CASE WHEN delivered_shipments > 0 THEN on_time_shipments / delivered_shipments ELSE 0D END AS on_time_delivery_rate,
  CASE WHEN total_shipments > 0 THEN exception_shipments / total_shipments ELSE 0D END AS exception_rate,
  CASE WHEN total_distance_miles > 0 THEN total_shipping_cost_usd / total_distance_miles ELSE 0D END AS avg_cost_per_mile
FROM s LEFT JOIN e USING (p_date, region_code, carrier_id)
"""

KPI_DELIVERY_DAILY = """
WITH f AS (
  SELECT p_date, region_code, carrier_id, count(*) AS events, count(DISTINCT if(event_type = 'DELIVERED', shipment_id, NULL)) AS delivered,
    count(DISTINCT if(event_type = 'DELIVERED' AND attempt_number = 1, shipment_id, NULL)) AS first_try
  FROM {fct_delivery_event} GROUP BY ALL),
b AS (
  SELECT a.*, coalesce(f.events, 0) AS events, coalesce(f.first_try, 0) AS first_try, greatest(a.delivered_shipments, coalesce(f.delivered, 0)) AS done
  FROM {agg_shipment_daily} a LEFT JOIN f USING (p_date, region_code, carrier_id))
SELECT p_date, region_code, carrier_id,
  CASE WHEN done > 0 THEN on_time_shipments / done ELSE 0D END AS on_time_delivery_rate,
  coalesce(avg_transit_time_hours, 0D) AS avg_transit_hours,
  CASE WHEN done > 0 THEN delayed_shipments / done ELSE 0D END AS late_delivery_rate,
  CASE WHEN done > 0 THEN first_try / done ELSE 0D END AS first_attempt_success_rate,
  CASE WHEN total_shipments > 0 THEN exception_shipments / total_shipments ELSE 0D END AS exception_rate,
  CASE WHEN total_distance_miles > 0 THEN total_shipping_cost_usd / total_distance_miles ELSE 0D END AS avg_cost_per_mile,
  total_shipments AS volume_by_carrier,
  CASE WHEN total_shipments > 0 THEN events / total_shipments ELSE 0D END AS delivery_event_density
FROM b
"""

NULL_CHECKS = """
SELECT * FROM (
  SELECT inline(array(
      struct('fct_shipment' AS table_name, 'shipment_id' AS column_name, count_if(trim(shipment_id) = '' OR shipment_id IS NULL) AS null_count),
      struct('fct_shipment' AS table_name, 'carrier_id' AS column_name, count_if(trim(carrier_id) = '' OR carrier_id IS NULL) AS null_count),
      struct('fct_shipment' AS table_name, 'pickup_ts' AS column_name, count_if(pickup_ts IS NULL) AS null_count))) FROM {fct_shipment}
  UNION ALL
  SELECT inline(array(
      struct('dim_carrier' AS table_name, 'carrier_id' AS column_name, count_if(trim(carrier_id) = '' OR carrier_id IS NULL) AS null_count),
      struct('dim_carrier' AS table_name, 'carrier_name' AS column_name, count_if(trim(carrier_name) = '' OR carrier_name IS NULL) AS null_count))) FROM {dim_carrier}
  UNION ALL
  SELECT inline(array(
      struct('fct_delivery_event' AS table_name, 'event_id' AS column_name, count_if(trim(event_id) = '' OR event_id IS NULL) AS null_count),
      struct('fct_delivery_event' AS table_name, 'shipment_id' AS column_name, count_if(trim(shipment_id) = '' OR shipment_id IS NULL) AS null_count),
      struct('fct_delivery_event' AS table_name, 'event_ts' AS column_name, count_if(event_ts IS NULL) AS null_count))) FROM {fct_delivery_event})
WHERE null_count > 0 ORDER BY null_count DESC, table_name, column_name
"""

DUPLICATE_CHECKS = """
SELECT 'fct_shipment' AS table_name, shipment_id AS key_value, CAST(NULL AS STRING) AS key_value_2, count(*) AS row_count FROM {fct_shipment} GROUP BY shipment_id HAVING count(*) > 1
UNION ALL
SELECT 'dim_carrier', carrier_id, CAST(p_date AS STRING), count(*) FROM {dim_carrier} GROUP BY carrier_id, p_date HAVING count(*) > 1
UNION ALL
SELECT 'fct_delivery_event', event_id, CAST(NULL AS STRING), count(*) FROM {fct_delivery_event} GROUP BY event_id HAVING count(*) > 1
ORDER BY table_name, row_count DESC, key_value
"""

RECONCILIATION = """
WITH s AS (
  SELECT 'shipments' AS entity, count(DISTINCT shipment_id) AS staging_count FROM {stg_shipments}
  UNION ALL SELECT 'carriers', count(DISTINCT carrier_id) FROM {stg_carriers}
  UNION ALL SELECT 'delivery_events', count(DISTINCT event_id) FROM {stg_delivery_events}),
c AS (
  SELECT 'shipments' AS entity, count(DISTINCT shipment_id) AS curated_count FROM {fct_shipment}
  UNION ALL SELECT 'carriers', count(DISTINCT carrier_id) FROM {dim_carrier}
  UNION ALL SELECT 'delivery_events', count(DISTINCT event_id) FROM {fct_delivery_event})
SELECT entity, staging_count, curated_count, curated_count - staging_count AS row_delta,
  CASE WHEN staging_count = 0 THEN 0D ELSE (curated_count - staging_count) / staging_count END AS variance_ratio
FROM s JOIN c USING (entity) ORDER BY entity
"""


def run_model(spark: SparkSession, query: str, run_date: str | None = None, **frames: DataFrame) -> DataFrame:
    """Run one of the queries above over frames of the names that it has in braces."""
    return spark.sql(query, args={"run_date": run_date} if run_date else {}, **frames)
