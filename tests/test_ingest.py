import json

import pytest
from pyspark.sql import functions as F

from lanewise.sources import files
from lanewise.sources.contracts import CARRIERS, DELIVERY_EVENTS, SHIPMENTS, contract_for, from_definition, load_contract
from lanewise.sources.ingest import ERRORS, ingest, read_raw, validate

SHIPMENT_HEAD = "shipment_id,carrier_id,origin_state,destination_state,pickup_ts,promised_delivery_ts,actual_delivery_ts,shipping_cost_usd,distance_miles,updated_at"


def written(path, head, *rows, bom=True):
    path.write_text(("\ufeff" if bom else "") + "\n".join([head, *rows]) + "\n", encoding="utf-8")
    return str(path)


def errors(spark, contract, path):
    invalid = validate(read_raw(spark, contract, path), contract).invalid
    return {r[0]: r[1] for r in invalid.select(contract.primary_key[0], ERRORS).collect()}


def test_shipment_errors_in_order(spark, tmp_path):
    day = "2026-01-02T00:00:00Z"
    path = written(
        tmp_path / "s.csv",
        SHIPMENT_HEAD,
        f" s1 ,c1,ca,tx,{day},{day},,1.5,2,{day}",  # valid
        f"s2,c1,cal,,{day},{day},,-1,x,{day}",
        f"s3,,CA,TX,{day},2026-01-01 00:00:00,2025-12-31T00:00:00Z,1,1,never",
        "s4,c1,CA",  # too few fields
        f"s5,c1,CA,TX,{day},{day},,1,1,{day},more",  # too many
    )
    found = errors(spark, SHIPMENTS, path)
    assert found["S2"] == ["missing_required:destination_state", "invalid_length:origin_state", "below_min:shipping_cost_usd", "invalid_double:distance_miles"]
    assert found["S3"] == ["missing_required:carrier_id", "missing_required:updated_at", "invalid_timestamp:updated_at", "invalid_time_order:promised_delivery_ts_before_pickup_ts", "invalid_time_order:actual_delivery_ts_before_pickup_ts"]
    assert found["S4"][0] == "corrupt_record" and "missing_required:updated_at" in found["S4"]
    assert found["S5"] == ["corrupt_record"]
    valid = ingest(spark, SHIPMENTS, path)
    assert valid.columns == SHIPMENTS.names
    assert [r["shipment_id"] for r in valid.collect()] == ["S1"] and valid.count() == 1


def test_event_and_carrier_errors(spark, tmp_path):
    day = "2026-01-02T00:00:00Z"
    events = written(
        tmp_path / "e.csv",
        "event_id,shipment_id,event_type,event_ts,event_city,event_state,delay_reason,attempt_number,updated_at",
        f"e1,s1,delivered,{day},,TX,,1,{day}",
        f"e2,s1,DELIVERED,{day},,TX,,,{day}",
        f"e3,s1,HOLD,{day},,TX,,,2026-01-01T00:00:00Z",
        f"e4,s1,COMPLETED,{day},,TXX,,0,{day}",
    )
    assert errors(spark, DELIVERY_EVENTS, events) == {
        "E2": ["missing_required:attempt_number_for_delivery_event"],
        "E3": ["missing_required:delay_reason_for_delay_or_exception", "invalid_time_order:updated_at_before_event_ts"],
        "E4": ["invalid_value:event_type", "invalid_length:event_state", "below_min:attempt_number"],
    }
    carriers = written(tmp_path / "c.csv", "carrier_id,carrier_name,scac,service_mode,home_region_code,is_active,updated_at", f"c1,Sun,ABC,air,,perhaps,{day}", f"c2,Sun,abcd,ftl,west,yes,{day}", bom=False)
    assert errors(spark, CARRIERS, carriers) == {"C1": ["invalid_length:scac", "invalid_value:service_mode", "invalid_boolean:is_active"]}


def test_quarantine_is_written_even_when_empty(spark, tmp_path):
    path = written(tmp_path / "s.csv", SHIPMENT_HEAD, "s1,c1,CA,TX,2026-01-02T00:00:00Z,2026-01-02T00:00:00Z,,1,1,2026-01-02T00:00:00Z", "s2,c1,,,,,,,,")
    ingest(spark, SHIPMENTS, path, str(tmp_path / "bad"), ingested_at="2026-01-03 00:00:00")
    row = spark.read.parquet(str(tmp_path / "bad" / "shipments")).first()
    assert row["entity"] == "shipments" and row["source_path"] == path and row["ingested_at"] is not None
    empty = written(tmp_path / "t.csv", SHIPMENT_HEAD)
    ingest(spark, SHIPMENTS, empty, str(tmp_path / "none"))
    assert spark.read.schema("entity string").parquet(str(tmp_path / "none" / "shipments")).count() == 0


def test_contracts(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(DELIVERY_EVENTS.definition()), encoding="utf-8-sig")
    assert load_contract(tmp_path / "c.json").columns == DELIVERY_EVENTS.columns
    assert contract_for("shipment") is SHIPMENTS and contract_for("nothing") is None
    assert from_definition({"columns": [{"name": "a", "nullable": False}, {"name": "b"}]}).required_columns == ["a"]
    with pytest.raises(ValueError):
        from_definition({})
    with pytest.raises(ValueError):
        from_definition({"columns": [{"name": "a", "type": "money"}]}).schema()
    with pytest.raises(FileNotFoundError):
        load_contract(tmp_path / "no.json")


def test_files(spark, tmp_path):
    for name in ("shipments_2026-01-01.csv", "shipments_2026-01-03.csv", "carriers.csv"):
        (tmp_path / name).write_text("a\n1\n")
    base = str(tmp_path)
    assert files.latest_date(base, ["shipments", "carriers"]) == "2026-01-03"
    assert files.source_path(base, "shipments", "2026-01-01").endswith("_2026-01-01.csv")
    assert files.source_path(base, "shipments", "2026-01-02").endswith("_2026-01-03.csv")
    assert files.source_path(base, "carriers", "2026-01-02").endswith("carriers.csv")
    assert files.is_cloud_path("s3a://b/k") and files.path_exists("s3://b/k") and files.latest_date("s3://b", ["x"]) is None
    for missing in (lambda: files.source_path(base, "events", "2026-01-01"), lambda: files.read_csv(spark, base + "/no.csv"), lambda: files.region_lookup_path(base)):
        with pytest.raises(FileNotFoundError):
            missing()
    assert files.path_exists(f"file://{base}/carriers.csv") and files.path_exists(f"file:{base}") and not files.path_exists(f"file:{base}/no") and files.path_exists("hdfs://n/x")
    frame = spark.range(3).withColumn("b", F.lit("x"))
    for fmt in ("json", "csv", "parquet"):
        at = files.write_frame(frame, f"{base}/{fmt}", fmt)
        assert spark.read.option("header", "true").format(fmt).load(at).count() == 3
    with pytest.raises(ValueError):
        files.write_frame(frame, base + "/x", "orc")
    assert files.read_parquet(spark, f"{base}/parquet").count() == 3
