"""Value standardization; every function is idempotent and one projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.functions import columns as C

STATE_COLUMNS = ("state_code", "origin_state", "destination_state", "event_state")
REGION_COLUMNS = ("region_code", "home_region_code", "origin_region_code", "destination_region_code")


def _mapped(df: DataFrame, names: Sequence[str], f: Callable[[Column], Column]) -> DataFrame:
    """``f`` over the columns of ``names`` that are there."""
    there = [n for n in names if n in df.columns]
    return df.withColumns({n: f(F.col(n)) for n in there}) if there else df


def clean_text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _mapped(df, columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)], C.clean_text)


def normalize_state_code_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _mapped(df, columns or STATE_COLUMNS, C.state_code)


def normalize_region_code_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _mapped(df, columns or REGION_COLUMNS, C.region_code)


def standardize_status_values(df: DataFrame, status_column: str = "status") -> DataFrame:
    return _mapped(df, [status_column], C.status_code)


def standardize_event_type_values(df: DataFrame, event_type_column: str = "event_type") -> DataFrame:
    return _mapped(df, [event_type_column], C.status_code)


def standardize_carrier_names(df: DataFrame, carrier_name_column: str = "carrier_name") -> DataFrame:
    return _mapped(df, [carrier_name_column], C.carrier_name)


def standardize_columns(df: DataFrame, done: Sequence[str] = ()) -> DataFrame:
    """Clean texts, then states, regions, statuses, event types and carrier names; columns of ``done`` are clean already."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in done]
    df = clean_text_columns(df, texts) if texts else df
    codes = dict.fromkeys(STATE_COLUMNS, C.state_code) | dict.fromkeys(REGION_COLUMNS, C.region_code) | dict.fromkeys(("status", "event_type"), C.status_code) | {"carrier_name": C.carrier_name}
    there = {n: f(F.col(n)) for n, f in codes.items() if n in df.columns}
    return df.withColumns(there) if there else df
