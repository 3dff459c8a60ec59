"""The delivery queries, by name; each takes (spark, sf_dir) and returns a whole result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.adapter import RUN_DATE, Source
from lanewise.functions import columns as C
from lanewise.operators import duplicates, latest, nulls, regions, rules, standardize
from lanewise.operators.drift import detect_schema_drift
from lanewise.plans import models, publish, sql_models, staging
from lanewise.plans.jobs import rule_context
from lanewise.sources.contracts import CARRIERS, DELIVERY_EVENTS, SHIPMENTS
from lanewise.sources.ingest import ERRORS, VALID, ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
    """Register ``f`` under its name. Time stamps leave as they came: without a zone."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(Source(spark, sf_dir))
        stamps = {n: F.col(n).cast("timestamp_ntz") for n, kind in out.dtypes if kind == "timestamp"}
        return out.withColumns(stamps) if stamps else out

    QUERIES[f.__name__] = run
    return f


# Scans and staging


@query
def scan_shipments(s):
    return s.shipments()


@query
def scan_lineitem_pruned(s):
    """Filter and columns reach the scan."""
    return s.table("lineitem").filter("l_quantity >= 45 and l_linestatus = 'F'").select("l_orderkey", "l_linenumber", "l_quantity")


@query
def region_lookup(s):
    return regions.prepare_region_lookup(s.lookup())


@query
def staging_shipments(s):
    return staging.stage_shipments(s.valid_shipments())


@query
def staging_carriers(s):
    return staging.stage_carriers(s.valid_carriers())


@query
def staging_events(s):
    return staging.stage_delivery_events(s.valid_events())


# Ingest checks


@query
def valid_rows(s):
    return s.valid_shipments()


@query
def invalid_rows_with_errors(s):
    bad = s.checked(SHIPMENTS, s.shipments()).filter(~F.col(VALID))
    return bad.select("shipment_id", "carrier_id", "updated_at", F.array_join(ERRORS, ",").alias("errors"))


@query
def invalid_events_with_errors(s):
    bad = s.checked(DELIVERY_EVENTS, s.events()).filter(~F.col(VALID))
    return bad.select("event_id", F.array_join(ERRORS, ",").alias("errors"))


@query
def error_array(s):
    rows = s.checked(SHIPMENTS, s.shipments())
    return rows.select(F.explode(ERRORS).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n_rows"))


def _ids_and_errors(invalid, key):
    return invalid.select(key, F.array_join(ERRORS, ",").alias("errors"))


@query
def csv_shipments_valid(s):
    """Source lines read by contract: trimmed, cased and parsed."""
    return s.ingested(SHIPMENTS, s.shipment_lines()).valid


@query
def csv_shipments_errors(s):
    return _ids_and_errors(s.ingested(SHIPMENTS, s.shipment_lines()).invalid, "shipment_id")


@query
def csv_events_valid(s):
    return s.ingested(DELIVERY_EVENTS, s.event_lines()).valid


@query
def csv_events_errors(s):
    return _ids_and_errors(s.ingested(DELIVERY_EVENTS, s.event_lines()).invalid, "event_id")


@query
def csv_carriers_valid(s):
    return s.ingested(CARRIERS, s.carrier_lines()).valid


@query
def csv_carriers_errors(s):
    return _ids_and_errors(s.ingested(CARRIERS, s.carrier_lines()).invalid, "carrier_id")


@query
def csv_quarantine(s):
    """Invalid rows as the quarantine keeps them: their texts, errors and source."""
    base = f"{s.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quarantine-{uuid.uuid4().hex}"
    s.carrier_lines().write.text(f"{base}/lines")
    ingest(s.spark, CARRIERS, f"{base}/lines", f"{base}/bad", {"header": "false"}, ingested_at="2024-01-31 00:00:00")
    kept = s.spark.read.parquet(f"{base}/bad/carriers")
    return kept.select("carrier_id", "__raw_is_active", "entity", "ingested_at", F.array_join(ERRORS, ",").alias("errors"))


@query
def bool_parse(s):
    text = F.element_at(F.array(*(F.lit(x) for x in ("Yes", "no", "T", "0", "maybe", ""))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return s.table("customer").select("c_custkey", C.parsed_boolean(C.filled(text)).alias("flag"))


@query
def timestamp_parse(s):
    at = F.col("o_orderdate").cast("timestamp")
    key = F.col("o_orderkey") % 3
    text = F.when(key == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(key == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise("not a time")
    return s.table("orders").select("o_orderkey", C.parsed_timestamp(text, SHIPMENTS.timestamp_formats).alias("parsed"))


@query
def try_cast_numeric(s):
    key = F.col("p_partkey")
    text = F.when(key % 4 == 0, F.concat(key.cast("string"), F.lit(".5"))).when(key % 4 == 1, F.lit("n/a")).otherwise(key.cast("string"))
    return s.table("part").select("p_partkey", C.parsed(text, "int").alias("as_int"), C.parsed(text, "double").alias("as_double"))


# Predicates and rules


@query
def blank_null_filter(s):
    name = F.when(F.col("c_custkey") % 5 == 0, F.lit("  ")).when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.col("c_name"))
    return s.table("customer").withColumn("name", name).filter(C.is_blank(F.col("name"))).select("c_custkey")


@query
def allowed_values(s):
    bad = rules.validate_allowed_values(s.table("orders"), "o_orderstatus", ["F", "O"])
    return bad.select("o_orderkey", F.col(rules.NAME).alias("rule_name"), F.col(rules.REASON).alias("reason"))


@query
def non_negative(s):
    return rules.validate_non_negative(s.table("customer"), "c_acctbal").select("c_custkey", F.col(rules.NAME).alias("rule_name"))


@query
def timestamp_order(s):
    bad = rules.validate_timestamp_order(s.shipments(), "pickup_ts", "actual_delivery_ts")
    return bad.select("shipment_id", "updated_at", F.col(rules.REASON).alias("reason"))


@query
def null_counts(s):
    counts = s.valid_carriers().agg(*(F.sum(C.flag(C.is_blank(F.col(c)))).cast("bigint").alias(c) for c in ("carrier_id", "scac", "home_region_code")))
    return counts


@query
def null_profile(s):
    return nulls.null_profile(s.valid_carriers(), ["carrier_id", "carrier_name", "home_region_code"])


@query
def required_nulls_rows(s):
    bad = nulls.filter_rows_with_required_nulls(s.valid_carriers(), ["carrier_name", "home_region_code"])
    return bad.select("carrier_id", F.array_join(nulls.FAILED, ",").alias("failed"))


@query
def quality_summary(s):
    """Rows that break each rule, from one pass over the rows."""
    df = s.shipments()
    listed = [
        rules.non_negative_rule(df, "shipping_cost_usd"),
        rules.non_negative_rule(df, "distance_miles"),
        rules.timestamp_order_rule(df, "pickup_ts", "promised_delivery_ts", allow_null_end=False),
        rules.timestamp_order_rule(df, "pickup_ts", "actual_delivery_ts"),
    ]
    counts = rules.rule_counts(df, listed)
    return counts.select(F.inline(F.array(*(F.struct(F.lit(r.name).alias("rule_name"), F.col(f"`{r.name}`").alias("failed_count")) for r in listed))))


def _faulty_shipments(s):
    return s.shipments().withColumns({"carrier_id": F.when(F.col("carrier_id") != "CAR1", F.col("carrier_id")), "shipping_cost_usd": F.when(F.col("distance_miles") > 49, -F.col("shipping_cost_usd")).otherwise(F.col("shipping_cost_usd"))})


def _checked_rules(s):
    df = _faulty_shipments(s)
    return rules.run_quality_rules(rule_context(SHIPMENTS, df))


@query
def quality_rules_run(s):
    """All rules of a contract in one run: their counts and states, and the rows that they find."""
    out = _checked_rules(s)
    listed = [(r["rule_name"], r["failed_count"], r["status"]) for r in out["rule_results"]]
    return s.spark.createDataFrame([*listed, ("all", out["invalid_count"], out["status"])], "rule_name string, failed_count bigint, status string")


@query
def quality_rules_clean(s):
    return _checked_rules(s)["clean_df"].select("shipment_id", "carrier_id", "updated_at")


@query
def quality_rules_invalid(s):
    return _checked_rules(s)["invalid_df"].groupBy(F.col(rules.NAME).alias("rule_name"), F.col(rules.REASON).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def union_by_name_invalid(s):
    df = s.shipments()
    late = rules.validate_timestamp_order(df, "pickup_ts", "actual_delivery_ts")
    dear = rules.validate_allowed_values(df.withColumn("mode", F.when(F.col("distance_miles") > 45, "FAR").otherwise("NEAR")), "mode", ["NEAR"])
    both = late.unionByName(dear, allowMissingColumns=True)
    return both.select("shipment_id", "updated_at", "distance_miles", "mode", F.col(rules.NAME).alias("rule_name"))


@query
def clean_anti_join(s):
    df = s.shipments()
    keys = rules.validate_timestamp_order(df, "pickup_ts", "actual_delivery_ts").select("shipment_id").dropna().distinct()
    return df.join(keys, "shipment_id", "left_anti")


@query
def schema_drift(s):
    found = detect_schema_drift(s.table("orders").schema, {"columns": [{"name": "o_orderkey", "type": "long"}, {"name": "o_totalprice", "type": "string"}, {"name": "o_note", "type": "string"}]})
    return s.spark.createDataFrame([(i, f) for i, f in enumerate(found)], "position bigint, finding string")


# Duplicates and windows


@query
def having_duplicates(s):
    return duplicates.find_duplicate_keys(s.valid_shipments(), ["shipment_id"])


@query
def duplicate_rows_inner_join(s):
    return duplicates.duplicate_records(s.valid_shipments(), ["shipment_id"]).select("shipment_id", "carrier_id", "updated_at", "shipping_cost_usd")


@query
def distinct_keys(s):
    return s.valid_shipments().select("carrier_id").dropna().distinct()


@query
def latest_shipment(s):
    return latest.latest_shipments(s.valid_shipments())


@query
def latest_carrier(s):
    twice = s.valid_carriers().unionAll(s.valid_carriers().withColumn("carrier_name", F.concat(F.lit("A "), "carrier_name")))
    return latest.latest_carriers(twice)


@query
def latest_event(s):
    events = s.valid_events()
    later = events.filter("attempt_number = 1").withColumn("updated_at", F.timestamp_add("HOUR", F.lit(1), F.col("updated_at"))).withColumn("event_type", F.lit("HOLD"))
    return latest.latest_events(events.unionAll(later)).select("event_id", "event_type", "updated_at")


@query
def lookup_dedupe(s):
    mixed = s.lookup().unionAll(s.lookup().select(F.lower("state_code").alias("state_code"), F.lit("central").alias("region_code")))
    return regions.prepare_region_lookup(mixed)


@query
def split_duplicates(s):
    first, rest = duplicates.split_by_duplicates(s.valid_shipments(), ["shipment_id"], ["updated_at", "pickup_ts"], ["carrier_id", "shipping_cost_usd", "distance_miles"])
    return first.withColumn("part", F.lit("kept")).unionAll(rest.withColumn("part", F.lit("dropped"))).select("shipment_id", "carrier_id", "shipping_cost_usd", "updated_at", "part")


# Values


@query
def clean_text(s):
    raw = F.concat(F.lit(" \t"), F.regexp_replace("p_name", " ", "  \n"), F.lit("\u0007 "))
    return standardize.clean_text_columns(s.table("part").select("p_partkey", raw.alias("name")))


@query
def state_norm(s):
    raw = F.concat(F.lit(" "), F.lower(F.substring("n_name", 1, 1)), F.lit("."), F.when(F.col("n_nationkey") % 4 == 0, "1").otherwise("x."))
    return standardize.normalize_state_code_values(s.table("nation").select("n_nationkey", raw.alias("state_code")))


@query
def region_norm(s):
    words = ("Western", "mid-west", " north east ", "NE", "southern", "Central")
    raw = F.coalesce(F.element_at(F.array(*map(F.lit, words)), F.when(F.col("n_nationkey") < 6, F.col("n_nationkey") + 1).otherwise(1)), F.lit(""))
    raw = F.when(F.col("n_nationkey") < 6, raw).otherwise(F.lower(F.col("r_name")))
    joined = s.table("nation").join(s.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return standardize.normalize_region_code_values(joined.select("n_nationkey", raw.alias("region_code")))


@query
def status_norm(s):
    words = {"click": "attempted", "view": "in transit", "purchase": "Completed", "signup": "pick-up", "error": "failed"}
    raw = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))[F.col("event_type")]
    return standardize.standardize_event_type_values(s.table("events").select("event_id", raw.alias("event_type")))


@query
def carrier_name_norm(s):
    raw = F.concat(F.lit("  "), F.regexp_replace("s_name", "#", " #  "), F.lit(" "))
    return standardize.standardize_carrier_names(s.table("supplier").select("s_suppkey", raw.alias("carrier_name")))


@query
def map_lookup(s):
    token = C.token(F.col("event_type"))
    return s.table("events").select("event_id", C.lookup({"DELIVERED": ("PURCHASE",), "EXCEPTION": ("ERROR",)}, token).alias("status"))


@query
def delay_transit(s):
    picked, promised, actual = F.col("pickup_ts"), F.col("promised_delivery_ts"), F.col("actual_delivery_ts")
    return s.valid_shipments().select("shipment_id", "carrier_id", "shipping_cost_usd", C.delay_minutes(actual, promised).alias("delay_minutes"), C.transit_hours(picked, actual).alias("transit_time_hours"))


# Joins and aggregates


def _fct(s):
    return models.build_fct_shipment(staging.stage_shipments(s.valid_shipments()), s.lookup())


def _events(s):
    return models.build_fct_delivery_event(staging.stage_delivery_events(s.valid_events()), staging.stage_shipments(s.valid_shipments()), s.lookup())


def _events_of(s, fct):
    """Events from the shipment facts, so that the shipments are read and ranked once."""
    return models.build_fct_delivery_event(staging.stage_delivery_events(s.valid_events()), fct, s.lookup())


def _kpi(s):
    fct = _fct(s)
    return models.build_kpi_delivery_daily(models.build_agg_shipment_daily(fct), _events_of(s, fct))


@query
def region_left_join(s):
    known = s.lookup().filter("region_code <> 'ASIA'")
    return regions.enrich_with_region(s.valid_shipments().select("shipment_id", "updated_at", "destination_state"), known)


@query
def event_shipment_left_join(s):
    shipments = latest.latest_shipments(s.valid_shipments()).select("shipment_id", "carrier_id", "promised_delivery_ts")
    return s.valid_events().select("event_id", "shipment_id").join(shipments, "shipment_id", "left")


@query
def agg_event_left_join(s):
    fct = _fct(s)
    per_day = fct.groupBy(*models.GRAIN).agg(F.count(F.lit(1)).alias("shipments"))
    counts = models.delivery_event_metrics(_events_of(s, fct)).select(*models.GRAIN, "total_delivery_events")
    return per_day.join(counts, models.GRAIN, "left").withColumn("total_delivery_events", F.coalesce("total_delivery_events", F.lit(0).cast("bigint")))


@query
def multi_left_join(s):
    lookup = F.broadcast(regions.prepare_region_lookup(s.lookup()))
    shipments = latest.latest_shipments(s.valid_shipments()).select("shipment_id", "carrier_id", "destination_state")
    event_region, shipment_region = lookup.toDF("event_state", "event_region"), lookup.toDF("destination_state", "shipment_region")
    joined = s.valid_events().select("event_id", "shipment_id", "event_state").join(shipments, "shipment_id", "left").join(event_region, "event_state", "left").join(shipment_region, "destination_state", "left")
    return joined.select("event_id", "shipment_id", "carrier_id", F.coalesce("event_region", "shipment_region", F.lit("UNKNOWN")).alias("region_code"))


@query
def group_multi_agg(s):
    late = F.col("delay_minutes") > 0
    return _fct(s).groupBy("region_code").agg(
        F.count_distinct("shipment_id").alias("shipments"),
        F.sum("delivered_flag").cast("bigint").alias("delivered"),
        F.sum(C.flag(late)).cast("bigint").alias("delayed"),
        F.sum(F.coalesce("shipping_cost_usd", F.lit(0.0)).cast("decimal(18,2)")).cast("double").alias("cost"),
        F.max("delay_minutes").alias("longest_delay"),
    )


@query
def conditional_count_distinct(s):
    return models.delivery_event_metrics(_events(s))


@query
def safe_ratio(s):
    per = _fct(s).groupBy("carrier_id").agg(F.sum("on_time_delivery_flag").cast("bigint").alias("on_time"), F.sum("delivered_flag").cast("bigint").alias("delivered"))
    return per.withColumn("rate", C.ratio(F.col("on_time"), F.col("delivered")))


@query
def top10_lane_days(s):
    """The ten largest lane-days: a top-k report."""
    agg = models.build_agg_shipment_daily(_fct(s))
    return agg.orderBy(F.desc("total_shipments"), "p_date", "region_code", "carrier_id").limit(10).select(*models.GRAIN, "total_shipments")


@query
def region_exception_rank(s):
    agg = _fct(s).filter("p_date between date '1995-01-01' and date '1996-12-31'").groupBy("region_code")
    out = agg.agg(F.sum("exception_flag").cast("bigint").alias("exceptions"), F.count(F.lit(1)).alias("shipments"))
    return out.withColumn("exception_rate", C.ratio(F.col("exceptions"), F.col("shipments"))).orderBy(F.desc("exception_rate"), "region_code")


@query
def kpi_by_region(s):
    return _kpi(s).filter("region_code = 'EUROPE' and p_date >= date '1997-01-01'").select(*models.GRAIN, "on_time_delivery_rate", "volume_by_carrier").orderBy(*models.GRAIN)


@query
def union_all_checks(s):
    fct = _fct(s)
    events = _events_of(s, fct)
    return sql_models.run_model(s.spark, sql_models.NULL_CHECKS, fct_shipment=fct.withColumn("carrier_id", F.when(F.col("carrier_id") != "CAR1", F.col("carrier_id"))), dim_carrier=models.build_dim_carrier(s.valid_carriers(), RUN_DATE), fct_delivery_event=events)


@query
def duplicate_checks(s):
    return sql_models.run_model(s.spark, sql_models.DUPLICATE_CHECKS, fct_shipment=s.valid_shipments(), dim_carrier=models.build_dim_carrier(s.valid_carriers(), RUN_DATE), fct_delivery_event=_events(s))


@query
def reconciliation_join(s):
    fct = _fct(s)
    return sql_models.run_model(
        s.spark, sql_models.RECONCILIATION, stg_shipments=s.shipments(), stg_carriers=s.carriers(), stg_delivery_events=s.events(),
        fct_shipment=fct, dim_carrier=models.build_dim_carrier(s.valid_carriers(), RUN_DATE), fct_delivery_event=_events_of(s, fct),
    )


# Curated models


@query
def dim_carrier(s):
    return models.build_dim_carrier(staging.stage_carriers(s.valid_carriers()), RUN_DATE)


@query
def fct_shipment(s):
    return _fct(s)


@query
def fct_delivery_event(s):
    return _events(s)


@query
def agg_shipment_daily(s):
    return models.build_agg_shipment_daily(_fct(s))


@query
def kpi_delivery_daily(s):
    return _kpi(s)


@query
def sql_dim_carrier(s):
    carriers = standardize.standardize_columns(staging.stage_carriers(s.valid_carriers()))
    return sql_models.run_model(s.spark, sql_models.DIM_CARRIER, RUN_DATE, carriers=carriers)


def _sql_fct(s):
    return sql_models.run_model(s.spark, sql_models.FCT_SHIPMENT, shipments=staging.stage_shipments(s.valid_shipments()), lookup=regions.prepare_region_lookup(s.lookup()))


def _sql_events(s, fct=None):
    """From the shipment facts, if they are there."""
    shipments = staging.stage_shipments(s.valid_shipments()) if fct is None else fct
    return sql_models.run_model(s.spark, sql_models.FCT_DELIVERY_EVENT, events=staging.stage_delivery_events(s.valid_events()), shipments=shipments, lookup=regions.prepare_region_lookup(s.lookup()))


@query
def sql_fct_shipment(s):
    return _sql_fct(s)


@query
def sql_fct_delivery_event(s):
    return _sql_events(s)


@query
def sql_agg_shipment_daily(s):
    fct = _sql_fct(s)
    return sql_models.run_model(s.spark, sql_models.AGG_SHIPMENT_DAILY, fct_shipment=fct, fct_delivery_event=_sql_events(s, fct))


@query
def sql_kpi_delivery_daily(s):
    fct = _sql_fct(s)
    events = _sql_events(s, fct)
    agg = sql_models.run_model(s.spark, sql_models.AGG_SHIPMENT_DAILY, fct_shipment=fct, fct_delivery_event=events)
    return sql_models.run_model(s.spark, sql_models.KPI_DELIVERY_DAILY, agg_shipment_daily=agg, fct_delivery_event=events)


@query
def catalog_roundtrip(s):
    """A table written by its partitions, registered, and read by its name; the database is a fresh one."""
    name = f"lanewise_{uuid.uuid4().hex}"
    at = f"{s.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}"
    carriers = models.build_dim_carrier(staging.stage_carriers(s.valid_carriers()), RUN_DATE)
    publish.write_partitioned_table(carriers, "dim_carrier", at, ["p_date", "region_code"], database=name)
    return s.spark.table(f"{name}.dim_carrier").select("carrier_id", "carrier_name", "service_mode", "region_code", "p_date")


@query
def partition_write_roundtrip(s):
    """A table written by its partitions and read back; the folder is a fresh one of the warehouse."""
    base = s.spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    at = f"{base}/roundtrip-{uuid.uuid4().hex}"
    carriers = models.build_dim_carrier(staging.stage_carriers(s.valid_carriers()), RUN_DATE)
    publish.write_partitioned_table(carriers, "dim_carrier", at, ["p_date", "region_code"], register_hive_table=False)
    return s.spark.read.parquet(at).select("carrier_id", "carrier_name", "service_mode", "region_code", "p_date")
