"""Region look-up by state."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.functions import columns as C
from lanewise.sources.files import read_csv

LOGGER = logging.getLogger(__name__)
LOOKUP_SCHEMA = T.StructType([T.StructField("state_code", T.StringType()), T.StructField("region_code", T.StringType())])


def prepare_region_lookup(lookup: DataFrame) -> DataFrame:
    """One region for each state: the alphabetically first of those given. At most 26 * 26 rows, since a state is two letters."""
    tidy = lookup.select(C.state_code(F.col("state_code")).alias("state_code"), C.region_code(F.col("region_code")).alias("region_code")).dropna()
    return tidy.groupBy("state_code").agg(F.min("region_code").alias("region_code"))


def load_region_lookup(spark: SparkSession, lookup_path: str, read_options: Mapping[str, Any] | None = None) -> DataFrame:
    return prepare_region_lookup(read_csv(spark, lookup_path, LOOKUP_SCHEMA, read_options))


def enrich_with_region(df: DataFrame, region_lookup_df: DataFrame, state_column: str = "destination_state", output_column: str = "region_code", tidy: bool = False) -> DataFrame:
    """The state's region, else the row's own, as a canonical code. The look-up is broadcast: its size is bounded by its key.

    Codes are made once for each state of the look-up; of the rows only a region of their own is. ``tidy`` says that the rows' states are state codes already.
    """
    if state_column not in df.columns:
        LOGGER.warning("State column '%s' not found; region look-up skipped", state_column)
        return df
    lookup = prepare_region_lookup(region_lookup_df).select(F.col("state_code").alias("__key"), F.col("region_code").alias("__found"))
    rows = df if tidy else df.withColumn(state_column, C.state_code(F.col(state_column)))
    joined = rows.join(F.broadcast(lookup), F.col(state_column) == F.col("__key"), "left")
    found = F.coalesce("__found", C.region_code(F.col(output_column))) if output_column in df.columns else F.col("__found")
    return joined.withColumn(output_column, found).drop("__key", "__found")


def enrich_shipments_with_region(
    shipments_df: DataFrame,
    region_lookup_df: DataFrame,
    destination_state_column: str = "destination_state",
    output_region_column: str = "region_code",
    include_origin_region: bool = True,
    origin_state_column: str = "origin_state",
    origin_region_column: str = "origin_region_code",
    tidy: bool = False,
) -> DataFrame:
    out = enrich_with_region(shipments_df, region_lookup_df, destination_state_column, output_region_column, tidy)
    if include_origin_region and origin_state_column in out.columns:
        out = enrich_with_region(out, region_lookup_df, origin_state_column, origin_region_column, tidy)
    return out


def enrich_delivery_events_with_region(events_df: DataFrame, region_lookup_df: DataFrame, event_state_column: str = "event_state", output_region_column: str = "region_code", tidy: bool = False) -> DataFrame:
    return enrich_with_region(events_df, region_lookup_df, event_state_column, output_region_column, tidy)
