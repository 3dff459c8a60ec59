"""The library's entry points in one place."""

from lanewise.main import build_parser, main
from lanewise.operators.drift import detect_df_schema_drift, detect_schema_drift, has_schema_drift, normalize_schema
from lanewise.operators.duplicates import duplicate_records, find_duplicate_keys, find_entity_duplicates, key_columns_for_entity, split_by_duplicates
from lanewise.operators.latest import latest_by
from lanewise.operators.nulls import check_required_nulls, critical_columns_for_entity, filter_rows_with_required_nulls, null_profile, split_by_required_nulls
from lanewise.operators.regions import enrich_delivery_events_with_region, enrich_shipments_with_region, enrich_with_region, load_region_lookup, prepare_region_lookup
from lanewise.operators.rules import quarantine_bad_records, run_quality_rules, validate_allowed_values, validate_non_negative, validate_timestamp_order
from lanewise.operators.standardize import clean_text_columns, normalize_region_code_values, normalize_state_code_values, standardize_carrier_names, standardize_columns, standardize_event_type_values, standardize_status_values
from lanewise.plans.jobs import run_backfill_batch, run_daily_batch
from lanewise.plans.logs import build_audit_record, emit_batch_metrics, configure_logging, get_logger
from lanewise.plans.models import build_agg_shipment_daily, build_dim_carrier, build_fct_delivery_event, build_fct_shipment, build_kpi_delivery_daily
from lanewise.plans.publish import ensure_curated_database, ensure_partition_columns, register_parquet_table, required_partition_columns, table_exists, write_partitioned_table
from lanewise.plans.session import build_spark_conf, create_spark_session, create_spark_session_from_config, stop_spark_session
from lanewise.plans.settings import apply_overrides, enumerate_dates, load_config, parse_date, resolve_backfill_window, resolve_config_path, resolve_run_date
from lanewise.plans.staging import stage_carriers, stage_delivery_events, stage_shipments
from lanewise.sources.contracts import load_carriers_schema_definition, load_contract, load_delivery_events_schema_definition, load_shipments_schema_definition
from lanewise.sources.files import is_cloud_path, path_exists, read_csv, read_parquet, write_frame, write_parquet, write_quarantine
from lanewise.sources.ingest import read_carriers_raw, read_delivery_events_raw, read_shipments_raw

__all__ = sorted(n for n in globals() if not n.startswith("_"))
