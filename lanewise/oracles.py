"""DuckDB SQL of the delivery queries, over the star-schema tables."""

from __future__ import annotations

from lanewise.adapter import RUN_DATE

#: Shared steps, in order of need.
STEPS = {
    "lookup": "SELECT chr(65 + n_nationkey) || 'X' AS state_code, replace(r_name, ' ', '_') AS region_code FROM nation JOIN region ON n_regionkey = r_regionkey",
    "ordered": "SELECT o_orderkey, o_orderdate AS ordered, o_orderpriority, chr(65 + c_nationkey) || 'X' AS destination_state FROM orders JOIN customer ON o_custkey = c_custkey",
    "ship": """
      SELECT l_orderkey || '-' || l_linenumber AS shipment_id, 'CAR' || l_suppkey AS carrier_id, chr(65 + s_nationkey) || 'X' AS origin_state, destination_state,
        ordered AS pickup_ts, ordered + to_days(14 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS promised_delivery_ts,
        CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS actual_delivery_ts, l_extendedprice AS shipping_cost_usd, l_quantity AS distance_miles, l_shipdate AS updated_at
      FROM lineitem JOIN ordered ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "vship": "SELECT * FROM ship WHERE coalesce(promised_delivery_ts >= pickup_ts, true) AND coalesce(actual_delivery_ts >= pickup_ts, true)",
    "carr": """
      SELECT 'CAR' || s_suppkey AS carrier_id, s_name AS carrier_name, 'S' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') AS scac,
        CASE s_suppkey % 3 WHEN 0 THEN 'FTL' WHEN 1 THEN 'LTL' ELSE 'PARCEL' END AS service_mode,
        CASE WHEN s_suppkey % 10 <> 0 THEN r_name END AS home_region_code, s_acctbal > 0 AS is_active, TIMESTAMP '2024-01-01' AS updated_at
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ev": """
      SELECT 'EVT' || event_id AS event_id, event_id || '-1' AS shipment_id,
        CASE event_type WHEN 'click' THEN 'DELIVERY_ATTEMPT' WHEN 'view' THEN 'IN_TRANSIT' WHEN 'purchase' THEN 'DELIVERED' WHEN 'signup' THEN 'PICKED_UP' WHEN 'error' THEN 'EXCEPTION' END AS event_type,
        ordered + to_seconds(floor(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) / 10)::BIGINT) AS event_ts,
        NULL::VARCHAR AS event_city, CASE WHEN user_id % 7 <> 0 THEN destination_state END AS event_state,
        CASE WHEN event_type = 'error' THEN 'K' || json_extract_string(props, '$.k') END AS delay_reason, (user_id % 3)::INTEGER AS attempt_number
      FROM events LEFT JOIN ordered ON event_id = o_orderkey""",
    "ev2": """
      SELECT *, event_ts AS updated_at, concat_ws(',', CASE WHEN event_type IS NULL THEN 'missing_required:event_type' END,
        CASE WHEN event_ts IS NULL THEN 'missing_required:event_ts,missing_required:updated_at' END,
        CASE WHEN attempt_number < 1 THEN 'below_min:attempt_number' END,
        CASE WHEN event_type = 'EXCEPTION' AND delay_reason IS NULL THEN 'missing_required:delay_reason_for_delay_or_exception' END) AS errors FROM ev""",
    "vev": "SELECT event_id, shipment_id, event_type, event_ts, event_city, event_state, delay_reason, attempt_number, updated_at FROM ev2 WHERE errors = ''",
    "lship": """
      SELECT * FROM vship QUALIFY row_number() OVER (PARTITION BY shipment_id ORDER BY updated_at DESC NULLS LAST, pickup_ts DESC NULLS LAST,
        carrier_id, shipping_cost_usd, distance_miles, origin_state, destination_state, promised_delivery_ts, actual_delivery_ts NULLS LAST) = 1""",
    "fct": """
      SELECT s.*, d.region_code, o.region_code AS origin_region_code, (actual_delivery_ts IS NOT NULL)::INTEGER AS delivered_flag,
        coalesce(actual_delivery_ts <= promised_delivery_ts, false)::INTEGER AS on_time_delivery_flag,
        CASE WHEN actual_delivery_ts IS NOT NULL THEN greatest(date_diff('second', promised_delivery_ts, actual_delivery_ts) / 60::DOUBLE, 0::DOUBLE) END AS delay_minutes,
        (actual_delivery_ts IS NULL AND updated_at > promised_delivery_ts)::INTEGER AS exception_flag,
        date_diff('second', pickup_ts, actual_delivery_ts) / 3600::DOUBLE AS transit_time_hours, pickup_ts::DATE AS p_date
      FROM lship s LEFT JOIN lookup d ON s.destination_state = d.state_code LEFT JOIN lookup o ON s.origin_state = o.state_code""",
    "fev": """
      SELECT e.event_id, e.shipment_id, coalesce(s.carrier_id, 'UNKNOWN') AS carrier_id, event_type, event_ts, event_city, event_state, delay_reason, attempt_number, e.updated_at,
        coalesce(er.region_code, sr.region_code, 'UNKNOWN') AS region_code, event_ts::DATE AS p_date,
        coalesce(event_type = 'DELIVERED' AND event_ts <= promised_delivery_ts, false)::INTEGER AS on_time_delivery_flag,
        CASE WHEN promised_delivery_ts IS NOT NULL THEN greatest(date_diff('second', promised_delivery_ts, event_ts) / 60::DOUBLE, 0::DOUBLE) END AS delay_minutes,
        (event_type IN ('EXCEPTION', 'HOLD'))::INTEGER AS exception_flag,
        CASE WHEN event_type = 'DELIVERED' THEN date_diff('second', pickup_ts, event_ts) / 3600::DOUBLE END AS transit_time_hours
      FROM vev e LEFT JOIN lship s USING (shipment_id) LEFT JOIN lookup er ON event_state = er.state_code LEFT JOIN lookup sr ON s.destination_state = sr.state_code""",
    "agg": """
      SELECT p_date, region_code, carrier_id, count(DISTINCT shipment_id) AS total_shipments, sum(delivered_flag)::BIGINT AS delivered_shipments, sum(on_time_delivery_flag)::BIGINT AS on_time_shipments,
        count(*) FILTER (delay_minutes > 0) AS delayed_shipments, sum(exception_flag)::BIGINT AS exception_shipments, sum(coalesce(delay_minutes, 0)) AS total_delay_minutes,
        avg(delay_minutes) FILTER (delay_minutes > 0) AS avg_delay_minutes, avg(transit_time_hours) AS avg_transit_time_hours,
        sum(coalesce(shipping_cost_usd, 0)::DECIMAL(28, 6))::DOUBLE AS total_shipping_cost_usd, sum(coalesce(distance_miles, 0)::DECIMAL(28, 6))::DOUBLE AS total_distance_miles FROM fct GROUP BY ALL""",
    "rated": """
      SELECT *, CASE WHEN delivered_shipments > 0 THEN on_time_shipments / delivered_shipments::DOUBLE ELSE 0 END AS on_time_delivery_rate,
        CASE WHEN total_shipments > 0 THEN exception_shipments / total_shipments::DOUBLE ELSE 0 END AS exception_rate,
        CASE WHEN total_distance_miles > 0 THEN total_shipping_cost_usd / total_distance_miles ELSE 0 END AS avg_cost_per_mile FROM agg""",
    "metrics": """
      SELECT p_date, region_code, carrier_id, count(*) AS total_delivery_events, count(DISTINCT CASE WHEN event_type = 'DELIVERED' THEN shipment_id END) AS delivered_event_shipments,
        count(DISTINCT CASE WHEN event_type = 'DELIVERED' AND attempt_number = 1 THEN shipment_id END) AS first_attempt_success_shipments FROM fev GROUP BY ALL""",
    "kpi": """
      SELECT p_date, region_code, carrier_id, CASE WHEN done > 0 THEN on_time_shipments / done::DOUBLE ELSE 0 END AS on_time_delivery_rate, coalesce(avg_transit_time_hours, 0) AS avg_transit_hours,
        CASE WHEN done > 0 THEN delayed_shipments / done::DOUBLE ELSE 0 END AS late_delivery_rate, CASE WHEN done > 0 THEN first_try / done::DOUBLE ELSE 0 END AS first_attempt_success_rate,
        CASE WHEN total_shipments > 0 THEN exception_shipments / total_shipments::DOUBLE ELSE 0 END AS exception_rate,
        CASE WHEN total_distance_miles > 0 THEN total_shipping_cost_usd / total_distance_miles ELSE 0 END AS avg_cost_per_mile, total_shipments AS volume_by_carrier,
        CASE WHEN total_shipments > 0 THEN total_delivery_events / total_shipments::DOUBLE ELSE 0 END AS delivery_event_density,
        total_shipments, delivered_shipments, on_time_shipments, delayed_shipments, exception_shipments, total_delivery_events
      FROM (SELECT agg.*, coalesce(m.total_delivery_events, 0) AS total_delivery_events, coalesce(m.first_attempt_success_shipments, 0) AS first_try,
        greatest(delivered_shipments, coalesce(m.delivered_event_shipments, 0)) AS done FROM agg LEFT JOIN metrics m USING (p_date, region_code, carrier_id))""",
    "dim": f"SELECT carrier_id, carrier_name, scac, service_mode, coalesce(replace(home_region_code, ' ', '_'), 'UNKNOWN') AS region_code, is_active, updated_at, DATE '{RUN_DATE}' AS p_date FROM carr",
}


def _with(query: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in STEPS.items()) + "\n" + query


_SHIP = "shipment_id, carrier_id, origin_state, destination_state, pickup_ts, promised_delivery_ts, actual_delivery_ts, shipping_cost_usd, distance_miles, updated_at"
_FCT = "shipment_id, carrier_id, origin_state, destination_state, origin_region_code, region_code, pickup_ts, promised_delivery_ts, actual_delivery_ts, updated_at, shipping_cost_usd, distance_miles, delivered_flag, on_time_delivery_flag, delay_minutes, exception_flag, transit_time_hours, p_date"
_SHIP_ERRORS = "CASE WHEN promised_delivery_ts < pickup_ts THEN 'invalid_time_order:promised_delivery_ts_before_pickup_ts' END, CASE WHEN actual_delivery_ts < pickup_ts THEN 'invalid_time_order:actual_delivery_ts_before_pickup_ts' END"

# Source lines with planted faults: what must come of them.
_SECOND = lambda c: f"date_trunc('second', {c})"
STEPS["csv_ship"] = f"""
      SELECT l_orderkey % 20 AS k, 'S' || l_orderkey || '-' || l_linenumber AS shipment_id, CASE WHEN l_orderkey % 20 <> 0 THEN 'C' || l_suppkey END AS carrier_id,
        CASE WHEN l_orderkey % 20 = 1 THEN 'ABC' ELSE chr((65 + l_suppkey % 26)::INTEGER) || 'X' END AS origin_state, CASE WHEN l_orderkey % 20 <> 5 THEN chr((65 + l_orderkey % 26)::INTEGER) || 'X' END AS destination_state,
        CASE WHEN l_orderkey % 20 <> 5 THEN {_SECOND('o_orderdate')} END AS pickup_ts,
        CASE WHEN l_orderkey % 20 = 8 THEN {_SECOND('o_orderdate')} - INTERVAL 1 DAY WHEN l_orderkey % 20 NOT IN (4, 5, 13) THEN {_SECOND('o_orderdate')} + INTERVAL 10 DAY END AS promised_delivery_ts,
        CASE WHEN l_linestatus = 'F' AND l_orderkey % 20 <> 5 THEN {_SECOND('l_shipdate')} END AS actual_delivery_ts,
        CASE WHEN l_orderkey % 20 = 2 THEN -1.5::DOUBLE WHEN l_orderkey % 20 <> 5 THEN l_extendedprice END AS shipping_cost_usd,
        CASE WHEN l_orderkey % 20 NOT IN (3, 5, 15) THEN l_quantity END AS distance_miles, CASE WHEN l_orderkey % 20 NOT IN (5, 9) THEN {_SECOND('l_shipdate')} END AS updated_at
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
_MISSING = lambda *names: ", ".join(f"CASE WHEN {n} IS NULL THEN 'missing_required:{n}' END" for n in names)
STEPS["csv_ship2"] = f"""
      SELECT *, concat_ws(',', CASE WHEN k IN (5, 6) THEN 'corrupt_record' END, {_MISSING('shipment_id', 'carrier_id', 'origin_state', 'destination_state', 'pickup_ts', 'promised_delivery_ts', 'updated_at')},
        CASE WHEN length(origin_state) <> 2 THEN 'invalid_length:origin_state' END, CASE WHEN k = 4 THEN 'invalid_timestamp:promised_delivery_ts' END, CASE WHEN shipping_cost_usd < 0 THEN 'below_min:shipping_cost_usd' END,
        CASE WHEN k = 3 THEN 'invalid_double:distance_miles' END, {_SHIP_ERRORS}) AS errors FROM csv_ship"""
STEPS["csv_ev"] = f"""
      SELECT event_id % 20 AS k, 'E' || event_id AS event_id, 'S' || user_id AS shipment_id,
        CASE event_id % 20 WHEN 0 THEN 'TELEPORTED' WHEN 1 THEN NULL ELSE CASE event_type WHEN 'click' THEN 'DELIVERY_ATTEMPT' WHEN 'view' THEN 'IN_TRANSIT' WHEN 'purchase' THEN 'DELIVERED' WHEN 'signup' THEN 'PICKED_UP' WHEN 'error' THEN 'EXCEPTION' ELSE 'HOLD' END END AS event_type,
        CASE WHEN event_id % 20 <> 2 THEN {_SECOND('ts')} END AS event_ts, CASE WHEN event_id % 20 = 3 THEN 'New, York' END AS event_city, CASE WHEN event_id % 20 = 4 THEN 'TXX' ELSE 'TX' END AS event_state,
        CASE WHEN event_id % 2 = 1 THEN 'WEATHER' END AS delay_reason, CASE event_id % 20 WHEN 6 THEN 0 WHEN 7 THEN NULL WHEN 8 THEN 2 WHEN 9 THEN NULL ELSE user_id % 3 + 1 END::INTEGER AS attempt_number,
        {_SECOND('ts')} - CASE WHEN event_id % 20 = 10 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS updated_at
      FROM events"""
STEPS["csv_ev2"] = f"""
      SELECT *, concat_ws(',', {_MISSING('event_type', 'event_ts')}, CASE WHEN event_type = 'TELEPORTED' THEN 'invalid_value:event_type' END, CASE WHEN k = 2 THEN 'invalid_timestamp:event_ts' END,
        CASE WHEN length(event_state) <> 2 THEN 'invalid_length:event_state' END, CASE WHEN k = 9 THEN 'invalid_int:attempt_number' END, CASE WHEN attempt_number < 1 THEN 'below_min:attempt_number' END,
        CASE WHEN event_type IN ('DELIVERY_ATTEMPT', 'DELIVERED') AND attempt_number IS NULL THEN 'missing_required:attempt_number_for_delivery_event' END,
        CASE WHEN event_type IN ('DELAYED', 'EXCEPTION', 'HOLD') AND delay_reason IS NULL THEN 'missing_required:delay_reason_for_delay_or_exception' END,
        CASE WHEN updated_at < event_ts THEN 'invalid_time_order:updated_at_before_event_ts' END) AS errors FROM csv_ev"""
STEPS["csv_carr"] = """
      SELECT 'C' || s_suppkey AS carrier_id, CASE WHEN s_suppkey % 10 <> 1 THEN s_name END AS carrier_name, CASE WHEN s_suppkey % 10 = 2 THEN 'TOOLONG' ELSE 'ABCD' END AS scac, CASE WHEN s_suppkey % 10 = 3 THEN 'AIR' ELSE 'LTL' END AS service_mode,
        'WEST' AS home_region_code, CASE s_suppkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS is_active, TIMESTAMP '2024-01-01' AS updated_at,
        concat_ws(',', CASE WHEN s_suppkey % 10 = 1 THEN 'missing_required:carrier_name' END, CASE WHEN s_suppkey % 10 = 2 THEN 'invalid_length:scac' END, CASE WHEN s_suppkey % 10 = 3 THEN 'invalid_value:service_mode' END,
          CASE WHEN s_suppkey % 5 = 4 THEN 'invalid_boolean:is_active' END) AS errors FROM supplier"""
STEPS["faulty"] = "SELECT * REPLACE (CASE WHEN carrier_id <> 'CAR1' THEN carrier_id END AS carrier_id, CASE WHEN distance_miles > 49 THEN -shipping_cost_usd ELSE shipping_cost_usd END AS shipping_cost_usd) FROM ship"
STEPS["broken"] = """
      SELECT *, 'required_nulls' AS rule_name, 'carrier_id' AS reason FROM faulty WHERE carrier_id IS NULL
      UNION ALL SELECT *, 'duplicate_keys', 'duplicate_key:shipment_id' FROM faulty WHERE shipment_id IN (SELECT shipment_id FROM faulty GROUP BY shipment_id HAVING count(*) > 1)
      UNION ALL SELECT *, 'non_negative:shipping_cost_usd', 'negative_value:shipping_cost_usd:' || shipping_cost_usd FROM faulty WHERE shipping_cost_usd < 0
      UNION ALL SELECT *, 'timestamp_order:pickup_ts->promised_delivery_ts', 'invalid_timestamp_order:pickup_ts->promised_delivery_ts' FROM faulty WHERE promised_delivery_ts < pickup_ts
      UNION ALL SELECT *, 'timestamp_order:pickup_ts->actual_delivery_ts', 'invalid_timestamp_order:pickup_ts->actual_delivery_ts' FROM faulty WHERE actual_delivery_ts < pickup_ts"""
#: The one schema finding is that the derived shipment_id is never null, while the contract of a typed frame allows nulls.
_RULES = ("required_nulls", "duplicate_keys", "non_negative:shipping_cost_usd", "non_negative:distance_miles", "timestamp_order:pickup_ts->promised_delivery_ts", "timestamp_order:pickup_ts->actual_delivery_ts")

_BODIES = {
    "csv_shipments_valid": f"SELECT {_SHIP} FROM csv_ship2 WHERE errors = ''",
    "csv_shipments_errors": "SELECT shipment_id, errors FROM csv_ship2 WHERE errors <> ''",
    "csv_events_valid": "SELECT event_id, shipment_id, event_type, event_ts, event_city, event_state, delay_reason, attempt_number, updated_at FROM csv_ev2 WHERE errors = ''",
    "csv_events_errors": "SELECT event_id, errors FROM csv_ev2 WHERE errors <> ''",
    "csv_carriers_valid": "SELECT * EXCLUDE (errors) FROM csv_carr WHERE errors = ''",
    "csv_carriers_errors": "SELECT carrier_id, errors FROM csv_carr WHERE errors <> ''",
    "csv_quarantine": "SELECT c.carrier_id, ['Yes', 'n', 'TRUE', '0', 'perhaps'][(s_suppkey % 5 + 1)::INTEGER] AS __raw_is_active, 'carriers' AS entity, TIMESTAMP '2024-01-31' AS ingested_at, errors FROM csv_carr c JOIN supplier ON c.carrier_id = 'C' || s_suppkey WHERE errors <> ''",
    "quality_rules_run": "SELECT rule_name, n AS failed_count, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT r.rule_name, count(b.rule_name) AS n FROM (VALUES " + ", ".join(f"('{r}')" for r in _RULES) + ") r(rule_name) LEFT JOIN broken b USING (rule_name) GROUP BY r.rule_name UNION ALL SELECT 'schema_drift', 1) UNION ALL SELECT 'all', count(*), CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END FROM broken",
    "quality_rules_clean": "SELECT shipment_id, carrier_id, updated_at FROM faulty WHERE shipment_id NOT IN (SELECT shipment_id FROM broken)",
    "quality_rules_invalid": "SELECT rule_name, reason, count(*) AS n_rows FROM broken GROUP BY ALL",
    "catalog_roundtrip": "SELECT carrier_id, carrier_name, service_mode, region_code, p_date FROM dim",
    "scan_shipments": "SELECT * FROM ship",
    "scan_lineitem_pruned": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_linestatus = 'F'",
    "region_lookup": "SELECT * FROM lookup",
    "staging_shipments": f"SELECT {_SHIP} FROM vship",
    "staging_carriers": "SELECT carrier_id, upper(scac) AS scac, carrier_name, service_mode, upper(home_region_code) AS home_region_code, is_active, updated_at FROM carr",
    "staging_events": "SELECT * FROM vev",
    "valid_rows": f"SELECT {_SHIP} FROM vship",
    "invalid_rows_with_errors": f"SELECT * FROM (SELECT shipment_id, carrier_id, updated_at, concat_ws(',', {_SHIP_ERRORS}) AS errors FROM ship) WHERE errors <> ''",
    "invalid_events_with_errors": "SELECT event_id, errors FROM ev2 WHERE errors <> ''",
    "error_array": f"SELECT error, count(*) AS n_rows FROM (SELECT unnest([{_SHIP_ERRORS}]) AS error FROM ship) WHERE error IS NOT NULL GROUP BY error",
    "bool_parse": "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS flag FROM customer",
    "timestamp_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN date_trunc('second', o_orderdate) END AS parsed FROM orders",
    "try_cast_numeric": "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 1 THEN p_partkey::INTEGER END AS as_int, CASE p_partkey % 4 WHEN 0 THEN p_partkey + 0.5::DOUBLE WHEN 1 THEN NULL ELSE p_partkey::DOUBLE END AS as_double FROM part",
    "blank_null_filter": "SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0",
    "allowed_values": "SELECT o_orderkey, 'allowed_values:o_orderstatus' AS rule_name, 'invalid_allowed_value:o_orderstatus:' || o_orderstatus AS reason FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
    "non_negative": "SELECT c_custkey, 'non_negative:c_acctbal' AS rule_name FROM customer WHERE c_acctbal < 0",
    "timestamp_order": "SELECT shipment_id, updated_at, 'invalid_timestamp_order:pickup_ts->actual_delivery_ts' AS reason FROM ship WHERE actual_delivery_ts < pickup_ts",
    "null_counts": "SELECT count(*) FILTER (trim(coalesce(carrier_id, '')) = '') AS carrier_id, count(*) FILTER (trim(coalesce(scac, '')) = '') AS scac, count(*) FILTER (trim(coalesce(home_region_code, '')) = '') AS home_region_code FROM carr",
    "null_profile": "SELECT column_name, null_count, total_count, null_count / total_count::DOUBLE AS null_rate FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, count(*) AS total_count FROM carr" for c in ("carrier_id", "carrier_name", "home_region_code")) + ")",
    "required_nulls_rows": "SELECT carrier_id, 'home_region_code' AS failed FROM carr WHERE home_region_code IS NULL",
    "quality_summary": """
      SELECT 'non_negative:shipping_cost_usd' AS rule_name, count(*) FILTER (shipping_cost_usd < 0) AS failed_count FROM ship
      UNION ALL SELECT 'non_negative:distance_miles', count(*) FILTER (distance_miles < 0) FROM ship
      UNION ALL SELECT 'timestamp_order:pickup_ts->promised_delivery_ts', count(*) FILTER (promised_delivery_ts < pickup_ts OR promised_delivery_ts IS NULL) FROM ship
      UNION ALL SELECT 'timestamp_order:pickup_ts->actual_delivery_ts', count(*) FILTER (actual_delivery_ts < pickup_ts) FROM ship""",
    "union_by_name_invalid": """
      SELECT shipment_id, updated_at, distance_miles, NULL AS mode, 'timestamp_order:pickup_ts->actual_delivery_ts' AS rule_name FROM ship WHERE actual_delivery_ts < pickup_ts
      UNION ALL SELECT shipment_id, updated_at, distance_miles, 'FAR', 'allowed_values:mode' FROM ship WHERE distance_miles > 45""",
    "clean_anti_join": "SELECT * FROM ship WHERE shipment_id NOT IN (SELECT shipment_id FROM ship WHERE actual_delivery_ts < pickup_ts)",
    "schema_drift": """
      SELECT row_number() OVER () - 1 AS position, finding FROM (VALUES ('missing_column:o_note'), ('unexpected_column:o_custkey'), ('unexpected_column:o_orderstatus'), ('unexpected_column:o_orderdate'),
      ('unexpected_column:o_orderpriority'), ('type_mismatch:o_totalprice:expected=string:actual=double')) t(finding)""",
    "having_duplicates": "SELECT shipment_id, count(*) AS duplicate_count FROM vship GROUP BY shipment_id HAVING count(*) > 1",
    "duplicate_rows_inner_join": "SELECT shipment_id, carrier_id, updated_at, shipping_cost_usd FROM vship JOIN (SELECT shipment_id FROM vship GROUP BY shipment_id HAVING count(*) > 1) USING (shipment_id)",
    "distinct_keys": "SELECT DISTINCT carrier_id FROM vship",
    "latest_shipment": "SELECT * FROM lship",
    "latest_carrier": "SELECT carrier_id, 'A ' || carrier_name AS carrier_name, scac, service_mode, home_region_code, is_active, updated_at FROM carr",
    "latest_event": "SELECT event_id, CASE WHEN attempt_number = 1 THEN 'HOLD' ELSE event_type END AS event_type, CASE WHEN attempt_number = 1 THEN updated_at + INTERVAL 1 HOUR ELSE updated_at END AS updated_at FROM vev",
    "lookup_dedupe": "SELECT state_code, least(region_code, 'MIDWEST') AS region_code FROM lookup",
    "split_duplicates": """
      SELECT shipment_id, carrier_id, shipping_cost_usd, updated_at, CASE WHEN row_number() OVER (PARTITION BY shipment_id ORDER BY updated_at DESC NULLS LAST, pickup_ts DESC NULLS LAST,
        carrier_id NULLS LAST, shipping_cost_usd NULLS LAST, distance_miles NULLS LAST) = 1 THEN 'kept' ELSE 'dropped' END AS part FROM vship""",
    "clean_text": "SELECT p_partkey, trim(p_name) AS name FROM part",
    "state_norm": "SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 0 THEN upper(substr(n_name, 1, 1)) || 'X' END AS state_code FROM nation",
    "region_norm": "SELECT n_nationkey, CASE n_nationkey WHEN 0 THEN 'WEST' WHEN 1 THEN 'MIDWEST' WHEN 2 THEN 'NORTHEAST' WHEN 3 THEN 'NORTHEAST' WHEN 4 THEN 'SOUTH' WHEN 5 THEN 'MIDWEST' ELSE replace(r_name, ' ', '_') END AS region_code FROM nation JOIN region ON n_regionkey = r_regionkey",
    "status_norm": "SELECT event_id, CASE event_type WHEN 'click' THEN 'DELIVERY_ATTEMPT' WHEN 'view' THEN 'IN_TRANSIT' WHEN 'purchase' THEN 'DELIVERED' WHEN 'signup' THEN 'PICK_UP' WHEN 'error' THEN 'EXCEPTION' END AS event_type FROM events",
    "carrier_name_norm": "SELECT s_suppkey, trim(regexp_replace(replace(s_name, '#', ' # '), '\\s+', ' ', 'g')) AS carrier_name FROM supplier",
    "map_lookup": "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'DELIVERED' WHEN 'error' THEN 'EXCEPTION' ELSE upper(event_type) END AS status FROM events",
    "delay_transit": """
      SELECT shipment_id, carrier_id, shipping_cost_usd, CASE WHEN actual_delivery_ts IS NOT NULL THEN greatest(date_diff('second', promised_delivery_ts, actual_delivery_ts) / 60::DOUBLE, 0::DOUBLE) END AS delay_minutes,
        date_diff('second', pickup_ts, actual_delivery_ts) / 3600::DOUBLE AS transit_time_hours FROM vship""",
    "region_left_join": "SELECT shipment_id, updated_at, destination_state, region_code FROM vship LEFT JOIN (SELECT * FROM lookup WHERE region_code <> 'ASIA') ON destination_state = state_code",
    "event_shipment_left_join": "SELECT e.shipment_id, event_id, carrier_id, promised_delivery_ts FROM vev e LEFT JOIN lship s USING (shipment_id)",
    "agg_event_left_join": "SELECT a.*, coalesce(m.total_delivery_events, 0) AS total_delivery_events FROM (SELECT p_date, region_code, carrier_id, count(*) AS shipments FROM fct GROUP BY ALL) a LEFT JOIN metrics m USING (p_date, region_code, carrier_id)",
    "multi_left_join": """
      SELECT event_id, e.shipment_id, carrier_id, coalesce(er.region_code, sr.region_code, 'UNKNOWN') AS region_code
      FROM vev e LEFT JOIN lship s USING (shipment_id) LEFT JOIN lookup er ON e.event_state = er.state_code LEFT JOIN lookup sr ON s.destination_state = sr.state_code""",
    "group_multi_agg": """
      SELECT region_code, count(DISTINCT shipment_id) AS shipments, sum(delivered_flag)::BIGINT AS delivered, count(*) FILTER (delay_minutes > 0) AS delayed,
        sum(coalesce(shipping_cost_usd, 0)::DECIMAL(18, 2))::DOUBLE AS cost, max(delay_minutes) AS longest_delay FROM fct GROUP BY region_code""",
    "conditional_count_distinct": "SELECT * FROM metrics",
    "safe_ratio": "SELECT carrier_id, on_time, delivered, CASE WHEN delivered > 0 THEN on_time / delivered::DOUBLE ELSE 0 END AS rate FROM (SELECT carrier_id, sum(on_time_delivery_flag)::BIGINT AS on_time, sum(delivered_flag)::BIGINT AS delivered FROM fct GROUP BY carrier_id)",
    "top10_lane_days": "SELECT p_date, region_code, carrier_id, total_shipments FROM agg ORDER BY total_shipments DESC, p_date, region_code, carrier_id LIMIT 10",
    "region_exception_rank": """
      SELECT region_code, sum(exception_flag)::BIGINT AS exceptions, count(*) AS shipments, sum(exception_flag)::BIGINT / count(*)::DOUBLE AS exception_rate FROM fct
      WHERE p_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY region_code""",
    "kpi_by_region": "SELECT p_date, region_code, carrier_id, on_time_delivery_rate, volume_by_carrier FROM kpi WHERE region_code = 'EUROPE' AND p_date >= DATE '1997-01-01'",
    "union_all_checks": "SELECT 'fct_shipment' AS table_name, 'carrier_id' AS column_name, count(*) AS null_count FROM fct WHERE carrier_id = 'CAR1' HAVING count(*) > 0",
    "duplicate_checks": "SELECT 'fct_shipment' AS table_name, shipment_id AS key_value, NULL::VARCHAR AS key_value_2, count(*) AS row_count FROM vship GROUP BY shipment_id HAVING count(*) > 1",
    "reconciliation_join": """
      SELECT entity, staging_count, curated_count, curated_count - staging_count AS row_delta, CASE WHEN staging_count = 0 THEN 0 ELSE (curated_count - staging_count) / staging_count::DOUBLE END AS variance_ratio FROM (
        SELECT 'shipments' AS entity, (SELECT count(DISTINCT shipment_id) FROM ship) AS staging_count, (SELECT count(DISTINCT shipment_id) FROM fct) AS curated_count
        UNION ALL SELECT 'carriers', (SELECT count(DISTINCT carrier_id) FROM carr), (SELECT count(DISTINCT carrier_id) FROM dim)
        UNION ALL SELECT 'delivery_events', (SELECT count(DISTINCT event_id) FROM ev), (SELECT count(DISTINCT event_id) FROM fev))""",
    "dim_carrier": "SELECT * FROM dim",
    "fct_shipment": f"SELECT {_FCT} FROM fct",
    "fct_delivery_event": "SELECT * FROM fev",
    "agg_shipment_daily": "SELECT * FROM rated",
    "kpi_delivery_daily": "SELECT * FROM kpi",
    "sql_dim_carrier": "SELECT * FROM dim",
    "sql_fct_shipment": f"SELECT {_FCT.replace('origin_region_code, ', '')} FROM fct",
    "sql_fct_delivery_event": "SELECT * FROM fev",
    "sql_agg_shipment_daily": "SELECT rated.*, coalesce(m.total_delivery_events, 0) AS total_delivery_events FROM rated LEFT JOIN metrics m USING (p_date, region_code, carrier_id)",
    "sql_kpi_delivery_daily": "SELECT p_date, region_code, carrier_id, on_time_delivery_rate, avg_transit_hours, late_delivery_rate, first_attempt_success_rate, exception_rate, avg_cost_per_mile, volume_by_carrier, delivery_event_density FROM kpi",
    "partition_write_roundtrip": "SELECT carrier_id, carrier_name, service_mode, region_code, p_date FROM dim",
}

ORACLES = {name: _with(body) for name, body in _BODIES.items()}
