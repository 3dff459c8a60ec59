from datetime import date

import pytest
from pyspark.sql import functions as F

from lanewise.operators import regions, standardize
from lanewise.plans import models, publish, sql_models

TS = "pickup_ts timestamp, promised_delivery_ts timestamp, actual_delivery_ts timestamp"
SHIPMENT = f"shipment_id string, carrier_id string, origin_state string, destination_state string, {TS}, shipping_cost_usd double, distance_miles double, updated_at timestamp"
EVENT = "event_id string, shipment_id string, event_type string, event_ts timestamp, event_city string, event_state string, delay_reason string, attempt_number int, updated_at timestamp"


def frame(spark, rows, schema):
    from datetime import datetime, timezone

    read = lambda v: datetime.fromisoformat(v).replace(tzinfo=timezone.utc) if isinstance(v, str) and v.startswith("2026") else v
    return spark.createDataFrame([tuple(map(read, r)) for r in rows], schema)


@pytest.fixture
def lookup(spark):
    return spark.createDataFrame([("ca", "Western"), ("TX", "South"), ("TX", "north east"), ("N.Y.", "NE"), (None, "X")], "state_code string, region_code string")


@pytest.fixture
def shipments(spark):
    d = "2026-01-0"
    return frame(
        spark,
        [
            ("s1", "c1", "CA", "TX", f"{d}1", f"{d}3", f"{d}2", 10.0, 5.0, f"{d}2"),  # on time
            ("s1", "c1", "CA", "TX", f"{d}1", f"{d}3", f"{d}4", 20.0, 5.0, f"{d}4"),  # its later state: a day late
            ("s2", "c1", "CA", "TX", f"{d}1", f"{d}2", None, None, 0.0, f"{d}3"),  # overdue
            ("s3", None, "TX", "ZZ", f"{d}2", f"{d}2", f"{d}2", 1.0, None, f"{d}2"),  # no carrier, no region
            ("s4", "c2", "TX", None, f"{d}2", f"{d}2", None, 1.0, 1.0, f"{d}1"),  # no destination
        ],
        SHIPMENT,
    )


@pytest.fixture
def events(spark):
    d = "2026-01-0"
    return frame(
        spark,
        [
            ("e1", "s1", "delivered", f"{d}1", "X", "TX", None, 1, f"{d}1"),
            ("e2", "s1", "on hold", f"{d}4", None, None, "R", None, f"{d}4"),
            ("e3", "s9", "PICKED_UP", f"{d}1", None, "CA", None, None, f"{d}1"),
            ("e3", "s9", "IN_TRANSIT", f"{d}2", None, "CA", None, None, f"{d}2"),
        ],
        EVENT,
    )


def test_lookup_keeps_the_first_region(lookup):
    assert {tuple(r) for r in regions.prepare_region_lookup(lookup).collect()} == {("CA", "WEST"), ("TX", "NORTHEAST"), ("NY", "NORTHEAST")}


def test_enrichment_is_idempotent(shipments, lookup):
    once = regions.enrich_shipments_with_region(shipments, lookup)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, regions.enrich_shipments_with_region(once, lookup).collect()))
    assert regions.enrich_with_region(shipments, lookup, "no_state") is shipments
    assert sorted(map(repr, standardize.standardize_columns(shipments).collect())) == sorted(map(repr, standardize.standardize_columns(standardize.standardize_columns(shipments)).collect()))


def test_fct_shipment(shipments, lookup):
    rows = {r["shipment_id"]: r for r in models.build_fct_shipment(shipments, lookup).collect()}
    assert len(rows) == 4
    one = rows["S1"]
    assert (one["region_code"], one["origin_region_code"], one["delay_minutes"], one["transit_time_hours"], one["on_time_delivery_flag"], one["shipping_cost_usd"]) == ("NORTHEAST", "WEST", 1440.0, 72.0, 0, 20.0)
    assert (rows["S2"]["exception_flag"], rows["S2"]["delivered_flag"], rows["S2"]["delay_minutes"]) == (1, 0, None)
    assert (rows["S3"]["carrier_id"], rows["S3"]["region_code"], rows["S3"]["on_time_delivery_flag"]) == ("UNKNOWN", "UNKNOWN", 1)
    assert rows["S4"]["exception_flag"] == 1 and rows["S4"]["p_date"] == date(2026, 1, 2)


def test_fct_delivery_event(shipments, events, lookup):
    rows = {r["event_id"]: r for r in models.build_fct_delivery_event(events, shipments, lookup).collect()}
    assert (rows["E1"]["on_time_delivery_flag"], rows["E1"]["transit_time_hours"], rows["E1"]["region_code"]) == (1, 0.0, "NORTHEAST")
    assert (rows["E2"]["event_type"], rows["E2"]["exception_flag"], rows["E2"]["delay_minutes"], rows["E2"]["region_code"]) == ("HOLD", 1, 1440.0, "NORTHEAST")
    assert (rows["E3"]["event_type"], rows["E3"]["carrier_id"], rows["E3"]["region_code"]) == ("IN_TRANSIT", "UNKNOWN", "WEST")
    assert models.build_fct_delivery_event(events).count() == 3


def test_agg_kpi_and_sql_twins(spark, shipments, events, lookup):
    fct = models.build_fct_shipment(shipments, lookup)
    facts = models.build_fct_delivery_event(events, shipments, lookup)
    agg = models.build_agg_shipment_daily(fct)
    kpi = models.build_kpi_delivery_daily(agg, facts)
    one = kpi.filter("carrier_id = 'C1'").first()
    assert (one["total_shipments"], one["late_delivery_rate"], one["exception_rate"], one["first_attempt_success_rate"], one["avg_cost_per_mile"], one["delivery_event_density"]) == (2, 1.0, 0.5, 1.0, 4.0, 0.5)
    assert agg.agg(F.sum("total_shipments")).first()[0] == fct.count() == kpi.agg(F.sum("volume_by_carrier")).first()[0]
    for name in ("on_time_delivery_rate", "late_delivery_rate", "exception_rate", "first_attempt_success_rate"):
        assert kpi.filter(f"{name} < 0 or {name} > 1").count() == 0
    alone = models.build_kpi_delivery_daily(agg.drop("exception_shipments"))
    assert alone.agg(F.sum("total_delivery_events"), F.sum("exception_shipments")).first()[:] == (0, 0)
    tidy = standardize.standardize_columns(shipments).withColumns({"shipment_id": F.upper("shipment_id"), "carrier_id": F.upper("carrier_id")})
    twin = sql_models.run_model(spark, sql_models.FCT_SHIPMENT, shipments=tidy, lookup=regions.prepare_region_lookup(lookup))
    assert sorted(map(repr, twin.collect())) == sorted(map(repr, fct.select(*twin.columns).collect()))
    sql_kpi = sql_models.run_model(spark, sql_models.KPI_DELIVERY_DAILY, agg_shipment_daily=agg, fct_delivery_event=facts)
    assert sorted(map(repr, sql_kpi.collect())) == sorted(map(repr, kpi.select(*sql_kpi.columns).collect()))


def test_dim_carrier(spark):
    rows = [("c1", " Old   Co", "western", "2026-01-01"), ("C1 ", "New", None, "2026-01-02"), ("c2", "X", " ", "2026-01-01")]
    carriers = frame(spark, rows, "carrier_id string, carrier_name string, home_region_code string, updated_at timestamp")
    got = {r["carrier_id"]: r for r in models.build_dim_carrier(carriers, "2026-01-05").collect()}
    assert (got["C1"]["carrier_name"], got["C1"]["region_code"], got["C1"]["p_date"]) == ("New", "UNKNOWN", date(2026, 1, 5))


def test_builders_pass_what_is_no_frame():
    for f in (models.build_dim_carrier, models.build_fct_shipment, models.build_fct_delivery_event, models.build_agg_shipment_daily, models.build_kpi_delivery_daily):
        marker = object()
        assert f(marker) is marker


def test_partitions_and_catalog(spark, shipments, tmp_path):
    rows = shipments.withColumn("carrier_id", F.when(F.col("carrier_id") == "c1", "c1"))
    ready = publish.ensure_partition_columns(rows)
    assert ready.filter("p_date is null or region_code is null or carrier_id is null").count() == 0
    assert sorted(map(repr, publish.ensure_partition_columns(ready).collect())) == sorted(map(repr, ready.collect()))
    assert publish.ensure_partition_columns(spark.range(1)).first()["p_date"] == date(1970, 1, 1)
    at = publish.write_partitioned_table(rows, "fct", str(tmp_path / "fct"), database="lanes")
    assert publish.table_exists(spark, "lanes", "fct")
    assert spark.table("lanes.fct").count() == 5 == spark.read.parquet(at).count()
    assert (tmp_path / "fct" / "p_date=2026-01-01" / "region_code=UNKNOWN" / "carrier_id=c1").is_dir()
    with pytest.raises(ValueError):
        publish.register_parquet_table(spark, "t", at, spark.range(1).schema, ["id"], "lanes")
    assert publish.write_partitioned_table(None, "x", "nowhere") == "nowhere"
    spark.sql("DROP DATABASE lanes CASCADE")
