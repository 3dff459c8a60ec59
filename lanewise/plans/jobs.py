"""The daily run and the backfill."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lanewise.operators.regions import enrich_delivery_events_with_region, enrich_shipments_with_region, load_region_lookup
from lanewise.operators.rules import run_quality_rules
from lanewise.operators.standardize import standardize_columns
from lanewise.sources import files
from lanewise.sources.contracts import CONTRACTS, Contract
from lanewise.sources.ingest import ingest

from . import models, staging
from .logs import build_audit_record, configure_logging, emit_batch_metrics, get_logger
from .publish import PARTITIONS, write_partitioned_table
from .session import create_spark_session_from_config, stop_spark_session
from .settings import apply_overrides, enumerate_dates, load_config, resolve_backfill_window, resolve_run_date

# The order of time stamps within a row, and whether the later may be missing.
TIME_ORDER = {
    "shipments": [("pickup_ts", "promised_delivery_ts", False), ("pickup_ts", "actual_delivery_ts", True)],
    "delivery_events": [("event_ts", "updated_at", False)],
}
BLOCKING = {"schema_drift": "fail_on_schema_drift", "required_nulls": "fail_on_required_nulls", "duplicate_keys": "fail_on_duplicate_primary_keys"}
STAGES = {"shipments": staging.stage_shipments, "carriers": staging.stage_carriers, "delivery_events": staging.stage_delivery_events}


def rule_context(contract: Contract, df: DataFrame, **more: Any) -> dict[str, Any]:
    """The rules that a contract implies. Nullability is not compared: ingest leaves every column nullable."""
    return {
        "df": df,
        "entity": contract.entity,
        "schema_expected": {"columns": [{"name": c.name, "type": c.type, "nullable": True} for c in contract.columns]},
        "required_columns": contract.required_columns,
        "duplicate_keys": list(contract.primary_key),
        "allowed_values": {c.name: list(c.allowed) for c in contract.columns if c.allowed is not None},
        "non_negative_columns": [c.name for c in contract.columns if c.kind in ("double", "int", "bigint") and c.min is not None and c.min >= 0] if contract.checks_range else [],
        "timestamp_order_rules": [{"start_column": a, "end_column": b, "allow_equal": True, "allow_null_end": n} for a, b, n in TIME_ORDER.get(contract.entity, ())],
        "primary_key": list(contract.primary_key),
        **more,
    }


def blocking_failures(failed_rules: list[str], quality: Mapping[str, Any]) -> list[str]:
    return [rule for rule, switch in BLOCKING.items() if rule in failed_rules and quality.get(switch, True)]


def clean_frame(result: Mapping[str, Any], fallback: DataFrame) -> DataFrame:
    """If duplicates are all that failed, every row goes on: the models keep the latest of a key."""
    if set(result["failed_rules"]) == {"duplicate_keys"} or result.get("clean_df") is None:
        return fallback
    return result["clean_df"]


def _section(config: Mapping[str, Any], name: str) -> dict[str, Any]:
    return config[name] if isinstance(config.get(name), Mapping) else {}


def execute_daily_flow(spark: SparkSession, config: Mapping[str, Any], batch_date: str, logger: Any) -> dict[str, Any]:
    paths, hive, quality = _section(config, "paths"), _section(config, "hive"), _section(config, "quality")
    raw, stage_base = str(paths.get("raw_base_path", "data/raw")), str(paths.get("staging_base_path", "data/staging"))
    fail_fast = bool(_section(config, "runtime").get("fail_fast", True))
    sources = {e: files.source_path(raw, e, batch_date) for e in CONTRACTS}
    lookup = load_region_lookup(spark, files.region_lookup_path(str(paths.get("reference_base_path", "data/reference"))))
    bad = {kind: files.join_path(stage_base, "quarantine", kind, f"p_date={batch_date}") for kind in ("ingest", "quality")}

    staged: dict[str, DataFrame] = {}
    checks: dict[str, dict[str, Any]] = {}
    for entity, contract in CONTRACTS.items():
        valid = ingest(spark, contract, sources[entity], bad["ingest"])
        # One columnar copy of the valid rows serves all later passes; the text is parsed once.
        at = files.write_frame(valid, files.join_path(stage_base, "valid", entity, f"p_date={batch_date}", "rows"))
        valid = spark.read.schema(valid.schema).parquet(at)
        result = checks[entity] = run_quality_rules(rule_context(contract, valid, quarantine_path=bad["quality"], fail_fast=fail_fast, logger=logger))
        if (blocked := blocking_failures(result["failed_rules"], quality)) and fail_fast:
            raise ValueError(f"Blocking quality failures for '{entity}': {blocked}")
        staged[entity] = standardize_columns(STAGES[entity](clean_frame(result, valid)))

    shipments = enrich_shipments_with_region(staged["shipments"], lookup)
    events = enrich_delivery_events_with_region(staged["delivery_events"], lookup)
    for name, frame in (("stg_shipments", shipments), ("stg_carriers", staged["carriers"]), ("stg_delivery_events", events)):
        frame.createOrReplaceTempView(name)

    keys = [str(k) for k in _section(config, "partitioning").get("keys") or PARTITIONS]
    curated = str(paths.get("curated_base_path", "data/curated"))
    outputs: dict[str, str] = {}

    def publish(name: str, frame: DataFrame) -> DataFrame:
        """Compute a table once, into staging; publish that copy, and return it for the tables made from it.

        The published folder can't be read back instead: it keeps the partitions of other days.
        """
        copy = files.write_frame(frame, files.join_path(stage_base, "curated", name, f"p_date={batch_date}", "rows"))
        frame = spark.read.schema(frame.schema).parquet(copy)
        at = outputs[name] = write_partitioned_table(
            frame, name, files.join_path(curated, name), keys, str(hive.get("mode", "overwrite")), spark, str(hive.get("database", "curated")),
            bool(hive.get("register_tables", True)), bool(hive.get("repair_partitions", True)), _section(config, "io").get("parquet"),
        )
        logger.info("Wrote %s to %s", name, at)
        return frame

    publish("dim_carrier", models.build_dim_carrier(staged["carriers"], batch_date))
    fct = publish("fct_shipment", models.build_fct_shipment(shipments, lookup))
    # The shipment facts are the latest shipments already: the events need no second pass over the source rows.
    event_fct = publish("fct_delivery_event", models.build_fct_delivery_event(events, fct, lookup))
    agg = publish("agg_shipment_daily", models.build_agg_shipment_daily(fct))
    publish("kpi_delivery_daily", models.build_kpi_delivery_daily(agg, event_fct))
    return {"batch_date": batch_date, "outputs": outputs, "quality": {e: {k: r[k] for k in ("status", "failed_rules", "invalid_count")} for e, r in checks.items()}}


def resolve_batch_date(run_date: str | None, raw_base_path: str) -> str:
    return resolve_run_date(run_date or files.latest_date(raw_base_path, list(CONTRACTS)))


def run_daily_batch(config_path: str | None = None, run_date: str | None = None, overrides: Mapping[str, Any] | None = None) -> int:
    """0 if the run went through, 2 if a module is missing, 1 on any other failure."""
    config = apply_overrides(load_config(config_path), overrides)
    logs = config["logging"]
    configure_logging(str(logs.get("level", "INFO")), bool(logs.get("json", False)))
    date = resolve_batch_date(run_date, str(config["paths"].get("raw_base_path", "data/raw")))
    run_id, began = f"daily_{date}_{uuid.uuid4().hex[:8]}", time.monotonic()
    logger = get_logger("lanewise.daily", run_id=run_id, job="daily", env=str(config["app"].get("env", "unknown")), batch_date=date)
    spark = None
    try:
        spark = create_spark_session_from_config(config)
        result = execute_daily_flow(spark, config, date, logger)
        failed = {e: q["invalid_count"] for e, q in result["quality"].items()}
        emit_batch_metrics(build_audit_record(run_id, "ok", {"seconds": round(time.monotonic() - began, 3), "tables": len(result["outputs"]), "invalid_rows": failed}))
        logger.info("Daily run finished: %s", result["outputs"])
        return 0
    except ModuleNotFoundError as error:
        logger.error("A module is missing: %s", error)
        return 2
    except Exception:
        logger.exception("Daily run failed")
        return 1
    finally:
        stop_spark_session(spark)


def run_backfill_batch(config_path: str | None = None, start_date: str | None = None, end_date: str | None = None, overrides: Mapping[str, Any] | None = None) -> int:
    """Daily runs of every date in turn; 1 if the window is wrong or a run failed. With fail_fast the first failure ends it."""
    config = apply_overrides(load_config(config_path), overrides)
    configure_logging(str(config["logging"].get("level", "INFO")), bool(config["logging"].get("json", False)))
    logger = get_logger("lanewise.backfill", job="backfill", env=str(config["app"].get("env", "unknown")))
    try:
        dates = enumerate_dates(*resolve_backfill_window(start_date, end_date))
    except ValueError as error:
        logger.error("%s", error)
        return 1
    failed = []
    for date in dates:
        if run_daily_batch(config_path, date, overrides):
            failed.append(date)
            if _section(config, "runtime").get("fail_fast", True):
                break
    if failed:
        logger.error("Backfill failed on %s", failed)
    return int(bool(failed))
