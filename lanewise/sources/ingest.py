"""Contract-driven ingest: one pass from text columns to typed columns and a list of errors.

Error codes are part of the interface, in this order: corrupt_record; missing_required:<c> for each required
column; then by column invalid_<type>, invalid_length, below_min, above_max, invalid_value; then the
entity's own rules.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions.columns import filled, parsed

from .contracts import CARRIERS, CORRUPT, DELIVERY_EVENTS, SHIPMENTS, ColumnSpec, Contract
from .files import join_path, read_csv, write_quarantine

ERRORS = "__ingest_errors"
VALID = "__is_valid"


class Ingested(NamedTuple):
    valid: DataFrame  # contract columns
    invalid: DataFrame  # contract columns, raw texts and errors


class Error(NamedTuple):
    """A row has the error where ``when`` is true; null is not true."""

    when: Column
    code: str


def _before(late: str, early: str) -> Error:
    return Error(F.col(late) < F.col(early), f"invalid_time_order:{late}_before_{early}")


def entity_errors(entity: str) -> list[Error]:
    """Rules across columns."""
    if entity == "shipments":
        return [_before("promised_delivery_ts", "pickup_ts"), _before("actual_delivery_ts", "pickup_ts")]
    if entity == "delivery_events":
        kind = F.col("event_type")
        return [
            Error(kind.isin("DELIVERY_ATTEMPT", "DELIVERED") & F.col("attempt_number").isNull(), "missing_required:attempt_number_for_delivery_event"),
            Error(kind.isin("DELAYED", "EXCEPTION", "HOLD") & F.col("delay_reason").isNull(), "missing_required:delay_reason_for_delay_or_exception"),
            _before("updated_at", "event_ts"),
        ]
    return []


def _column_errors(spec: ColumnSpec, ranges: bool) -> list[Error]:
    value, name = F.col(spec.name), spec.name
    out = []
    if spec.kind != "string":
        out.append(Error(F.col(f"__raw_{name}").isNotNull() & value.isNull(), f"invalid_{spec.type.lower()}:{name}"))
    if spec.length is not None:
        out.append(Error(F.length(value.cast("string")) != int(spec.length), f"invalid_length:{name}"))
    if ranges and spec.min is not None:
        out.append(Error(value < F.lit(spec.min), f"below_min:{name}"))
    if ranges and spec.max is not None:
        out.append(Error(value > F.lit(spec.max), f"above_max:{name}"))
    if spec.allowed is not None:
        out.append(Error(~value.cast("string").isin(*spec.allowed), f"invalid_value:{name}"))
    return out


def typed(raw: DataFrame, contract: Contract) -> DataFrame:
    """Text columns trimmed, cased and parsed; the text of a parsed column is kept as ``__raw_<name>``."""
    case = {"upper": F.upper, "lower": F.lower, None: lambda c: c}
    texts = raw.select(*(case[c.case](filled(F.col(c.name))).alias(c.name) for c in contract.columns), *([CORRUPT] if CORRUPT in raw.columns else []))
    values = [parsed(F.col(c.name), c.kind, contract.timestamp_formats).alias(c.name) for c in contract.columns]
    shadows = [F.col(c.name).alias(f"__raw_{c.name}") for c in contract.columns if c.kind != "string"]
    return texts.select(*values, *shadows, *([CORRUPT] if CORRUPT in raw.columns else []))


def checked(frame: DataFrame, contract: Contract) -> DataFrame:
    """``typed`` rows with their errors and whether they have none."""
    codes = [Error(F.col(CORRUPT).isNotNull(), "corrupt_record")] if CORRUPT in frame.columns else []
    codes += [Error(F.col(c).isNull(), f"missing_required:{c}") for c in contract.required_columns]
    codes += [e for c in contract.columns for e in _column_errors(c, contract.checks_range)]
    codes += entity_errors(contract.entity)
    errors = F.array_compact(F.array(*(F.when(e.when, F.lit(e.code)) for e in codes))) if codes else F.array()
    # Validity by itself needs no array: it is cheap, and the array is pruned where only valid rows go on.
    valid = reduce(and_, (~F.coalesce(e.when, F.lit(False)) for e in codes), F.lit(True))
    return frame.withColumns({ERRORS: errors.cast("array<string>"), VALID: valid})


def validate(raw: DataFrame, contract: Contract) -> Ingested:
    rows = checked(typed(raw, contract), contract)
    return Ingested(rows.filter(VALID).select(*contract.names), rows.filter(~F.col(VALID)).drop(VALID))


def read_raw(spark: SparkSession, contract: Contract, path: str, options: Mapping[str, Any] | None = None) -> DataFrame:
    """A CSV source as text columns. Rows that don't parse keep their line in ``_corrupt_record``.

    Column pruning would let Spark skip the fields that show a row to be malformed, so the reader is told not to prune.
    """
    own = {k: v for k, v in contract.options.items() if not k.startswith("timestamp_format")}
    return read_csv(spark, path, contract.raw_schema(), own | {"columnNameOfCorruptRecord": CORRUPT, "columnPruning": "false"} | dict(options or {}))


def ingest(spark: SparkSession, contract: Contract, path: str, bad_records_path: str | None = None, options: Mapping[str, Any] | None = None, ingested_at: str | None = None) -> DataFrame:
    """Valid rows of a source. Invalid ones go to ``<bad_records_path>/<entity>``, if given, with their source and time."""
    valid, invalid = validate(read_raw(spark, contract, path, options), contract)
    if bad_records_path:
        at = F.lit(ingested_at).cast("timestamp") if ingested_at else F.current_timestamp()
        labelled = invalid.withColumns({"entity": F.lit(contract.entity), "source_path": F.lit(path), "ingested_at": at})
        write_quarantine(labelled, join_path(bad_records_path, contract.entity))
    return valid


def read_shipments_raw(spark: SparkSession, source_path: str, bad_records_path: str | None = None, read_options: Mapping[str, Any] | None = None) -> DataFrame:
    return ingest(spark, SHIPMENTS, source_path, bad_records_path, read_options)


def read_carriers_raw(spark: SparkSession, source_path: str, bad_records_path: str | None = None, read_options: Mapping[str, Any] | None = None) -> DataFrame:
    return ingest(spark, CARRIERS, source_path, bad_records_path, read_options)


def read_delivery_events_raw(spark: SparkSession, source_path: str, bad_records_path: str | None = None, read_options: Mapping[str, Any] | None = None) -> DataFrame:
    return ingest(spark, DELIVERY_EVENTS, source_path, bad_records_path, read_options)
