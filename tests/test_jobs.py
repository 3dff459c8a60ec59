"""Settings, command line, and whole runs on files."""

import datetime
import json
import logging

import pytest

from lanewise import main as cli
from lanewise.plans import jobs, logs, session, settings

DAY = "2026-01-0"


@pytest.fixture
def base(tmp_path):
    raw, ref = tmp_path / "raw", tmp_path / "ref"
    raw.mkdir()
    ref.mkdir()
    at = lambda d, h=0: f"{DAY}{d}T{h:02}:00:00Z"
    head = "shipment_id,carrier_id,origin_state,destination_state,pickup_ts,promised_delivery_ts,actual_delivery_ts,shipping_cost_usd,distance_miles,updated_at"
    rows = [
        f"p1,k1,CA,TX,{at(1)},{at(2)},{at(1, 12)},100,50,{at(1, 12)}",
        f"p1,k1,CA,TX,{at(1)},{at(2)},{at(2, 6)},110,50,{at(2, 6)}",
        f"p2,k2,TX,CA,{at(2)},{at(3)},,70,,{at(4)}",
        f"p3,k2,TX,,{at(2)},{at(3)},,70,10,{at(3)}",
    ]
    (raw / "shipments_2026-01-01.csv").write_text("\n".join([head, *rows]) + "\n", encoding="utf-8-sig")
    (raw / "carriers_2026-01-01.csv").write_text(f"carrier_id,carrier_name,scac,service_mode,home_region_code,is_active,updated_at\nk1,One,AAAA,FTL,western,true,{at(1)}\nk2,Two,,LTL,,no,{at(1)}\n")
    (raw / "delivery_events_2026-01-01.csv").write_text(f"event_id,shipment_id,event_type,event_ts,event_city,event_state,delay_reason,attempt_number,updated_at\nv1,p1,DELIVERED,{at(1, 12)},,TX,,1,{at(1, 12)}\nv2,p3,PICKED_UP,{at(2)},,,,,{at(2)}\n")
    (ref / "region_lookup.csv").write_text("state_code,region_code\nCA,WEST\nTX,SOUTH\n")
    return tmp_path


def paths(base):
    return {"paths.raw_base_path": str(base / "raw"), "paths.reference_base_path": str(base / "ref"), "paths.staging_base_path": str(base / "stage"), "paths.curated_base_path": str(base / "out"), "spark.enable_hive_support": False, "spark.conf": {}}


def test_daily_run(spark, base):
    assert jobs.run_daily_batch("dev", "2026-01-01", paths(base)) == 0
    read = lambda name: spark.read.parquet(str(base / "out" / name))
    fct = {r["shipment_id"]: r for r in read("fct_shipment").collect()}
    assert set(fct) == {"P1", "P2"}  # P3 has no destination
    assert (fct["P1"]["shipping_cost_usd"], fct["P1"]["delay_minutes"], fct["P1"]["region_code"]) == (110.0, 360.0, "SOUTH")
    assert fct["P2"]["exception_flag"] == 1
    assert read("dim_carrier").count() == 2 and read("agg_shipment_daily").count() == 2
    events = {r["event_id"]: r["carrier_id"] for r in read("fct_delivery_event").collect()}
    assert events == {"V1": "K1", "V2": "UNKNOWN"}
    kpi = read("kpi_delivery_daily").filter("carrier_id = 'K1'").first()
    assert (kpi["late_delivery_rate"], kpi["first_attempt_success_rate"], kpi["delivery_event_density"], kpi["avg_cost_per_mile"]) == (1.0, 1.0, 1.0, 2.2)
    bad = spark.read.parquet(str(base / "stage/quarantine/ingest/p_date=2026-01-01/shipments"))
    assert bad.count() == 1
    assert spark.read.parquet(str(base / "stage/quarantine/quality/p_date=2026-01-01/shipments/duplicate_keys")).count() == 2


def test_fail_fast_and_missing_sources(spark, base):
    over = paths(base) | {"runtime.fail_fast": True}
    assert jobs.run_daily_batch("dev", "2026-01-01", over) == 1  # a duplicate key
    assert jobs.run_daily_batch("dev", "2026-01-01", paths(base) | {"paths.raw_base_path": str(base / "nowhere")}) == 1


def test_backfill(monkeypatch):
    seen = []
    monkeypatch.setattr(jobs, "run_daily_batch", lambda config, date, over: seen.append(date) or int(date.endswith("02")))
    assert jobs.run_backfill_batch("dev", "2026-01-01", "2026-01-03") == 1
    assert seen == ["2026-01-01", "2026-01-02", "2026-01-03"]
    seen.clear()
    assert jobs.run_backfill_batch("dev", "2026-01-01", "2026-01-03", {"runtime.fail_fast": True}) == 1
    assert seen == ["2026-01-01", "2026-01-02"]
    assert jobs.run_backfill_batch("dev", "2026-01-03", "2026-01-04") == 0
    assert jobs.run_backfill_batch("dev", "2026-01-03", "2026-01-01") == 1 == jobs.run_backfill_batch("dev", None, None)


def test_command_line(monkeypatch):
    calls = []
    monkeypatch.setattr(jobs, "run_daily_batch", lambda **k: calls.append(("daily", k)) or 0)
    monkeypatch.setattr(jobs, "run_backfill_batch", lambda **k: calls.append(("backfill", k)) or 3)
    assert cli.main([]) == 0
    assert cli.main(["--job", "daily", "--config", "prod", "--run-date", "2026-01-01", "--raw-base-path", "r", "--no-fail-fast", "--register-hive", "--spark-profile", "emr", "--hive-database", "d"]) == 0
    assert cli.main(["--job", "backfill", "--start-date", "2026-01-01", "--end-date", "2026-01-02"]) == 3
    assert calls[0] == ("daily", {"config_path": "dev", "run_date": None, "overrides": None})
    assert calls[1][1]["overrides"] == {"paths.raw_base_path": "r", "runtime.fail_fast": False, "hive.register_tables": True, "spark.profile": "emr", "hive.database": "d"}
    assert calls[2] == ("backfill", {"config_path": "dev", "start_date": "2026-01-01", "end_date": "2026-01-02", "overrides": None})


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: $HERE/z}\nspark: {conf: {k: v}}\n")
    (tmp_path / "dev.yaml").write_text("a: {x: 2}\n")
    monkeypatch.setenv("HERE", "/here")
    config = settings.load_config(config_dir=tmp_path)
    assert config["a"] == {"x": 2, "y": "/here/z"} and config["spark"]["conf"] == {"k": "v"} and config["paths"] == {}
    assert settings.load_config("base", tmp_path)["a"]["x"] == 1
    assert settings.apply_overrides(config, {"a.x": None, "b.c.d": 1}) | {} == config | {"b": {"c": {"d": 1}}}
    (tmp_path / "list.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        settings.load_config(tmp_path / "list.yaml", tmp_path)
    with pytest.raises(FileNotFoundError):
        settings.load_config(tmp_path / "no.yaml", tmp_path)
    assert settings.load_config("prod")["spark"]["profile"] == "emr"
    assert settings.enumerate_dates(*settings.resolve_backfill_window("2026-02-27", "2026-03-01")) == ["2026-02-27", "2026-02-28", "2026-03-01"]
    for wrong in ("2026-13-01", "2026-1", "", None, "01.02.2026"):
        with pytest.raises(ValueError):
            settings.parse_date(wrong)


def test_settings_layers_of_unlike_shape():
    """A value over a mapping, a mapping over a value, an empty mapping over a full one, and dots inside names."""
    flat = settings.leaves({"a": {"b": 1}, "c": 2, "d": {"x.y": [1]}}) | {("a",): 5} | settings.leaves({"c": {"e": 3}, "d": {}})
    assert settings.tree_of(flat) == {"a": 5, "c": {"e": 3}, "d": {"x.y": [1]}}
    config = {"spark": {"conf": {"x.y": 1}, "profile": "p"}}
    assert settings.apply_overrides(config, {"spark.conf": {}}) == {"spark": {"conf": {}, "profile": "p"}}
    assert config == {"spark": {"conf": {"x.y": 1}, "profile": "p"}}


def test_session_and_logs(spark):
    assert session.build_spark_conf("local", {"a": True}, {"spark.sql.shuffle.partitions": 9})["spark.sql.shuffle.partitions"] == "9"
    with pytest.raises(ValueError):
        session.build_spark_conf("moon")
    session.stop_spark_session(spark)  # not ours to stop
    assert spark.range(2).count() == 2
    record = logging.LogRecord("n", logging.INFO, "f", 1, "hi %s", ("you",), None)
    record.run_id = "r"
    line = json.loads(logs.JsonFormatter().format(record))
    assert (line["message"], line["run_id"]) == ("hi you", "r")
    assert logs.build_audit_record("r", "ok") == {"run_id": "r", "status": "ok", "details": {}}


def test_metrics_are_one_line_of_json(caplog):
    with caplog.at_level(logging.INFO, "lanewise.metrics"):
        logs.emit_batch_metrics({"rows": 3, "day": datetime.date(2026, 1, 1)})
    assert [json.loads(r.getMessage()) for r in caplog.records] == [{"rows": 3, "day": "2026-01-01"}]


def test_a_day_of_invented_files_against_plain_python(spark, tmp_path):
    """Random shipments with late states, carriers and events; facts and KPIs are worked out again row by row."""
    import random
    from collections import defaultdict
    from datetime import timedelta

    rng, start = random.Random(5), datetime.datetime(2026, 1, 1)
    show = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ") if t else ""
    regions = {"CA": "WEST", "TX": "SOUTH", "IL": "MIDWEST", "NY": "NORTHEAST"}
    ships, events = [], []
    for i in range(120):
        picked = start + timedelta(hours=rng.randrange(72))
        for _ in range(rng.choice((1, 1, 2))):
            promised, arrived = picked + timedelta(hours=rng.randrange(1, 60)), picked + timedelta(minutes=rng.randrange(1, 5000)) if rng.random() < 0.8 else None
            ships.append((f"P{i}", f"K{i % 4}", rng.choice(list(regions)), rng.choice([*regions, "ZZ"]), picked, promised, arrived, rng.randrange(10, 500), rng.randrange(1, 900), start + timedelta(minutes=len(ships))))
    for i in range(200):
        at = start + timedelta(hours=rng.randrange(96))
        events.append((f"V{i}", f"P{rng.randrange(130)}", rng.choice(["PICKED_UP", "IN_TRANSIT", "DELIVERED", "DELIVERED", "EXCEPTION"]), at, "", rng.choice([*regions, "", ""]), "R", rng.randrange(1, 4), at))
    write = lambda name, head, rows: (tmp_path / name).write_text("\n".join([head, *(",".join(show(v) if isinstance(v, datetime.datetime) or v is None else str(v) for v in r) for r in rows)]) + "\n")
    (tmp_path / "raw").mkdir(), (tmp_path / "ref").mkdir()
    write("raw/shipments.csv", "shipment_id,carrier_id,origin_state,destination_state,pickup_ts,promised_delivery_ts,actual_delivery_ts,shipping_cost_usd,distance_miles,updated_at", ships)
    write("raw/delivery_events.csv", "event_id,shipment_id,event_type,event_ts,event_city,event_state,delay_reason,attempt_number,updated_at", events)
    write("raw/carriers.csv", "carrier_id,carrier_name,scac,service_mode,home_region_code,is_active,updated_at", [(f"K{k}", f"Carrier {k}", "AAAA", "FTL", "WEST", "yes", start) for k in range(4)])
    write("ref/region_lookup.csv", "state_code,region_code", list(regions.items()))
    assert jobs.run_daily_batch("dev", "2026-01-01", paths(tmp_path)) == 0
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name)).collect()

    last = {}
    for r in sorted(ships, key=lambda r: r[9]):
        last[r[0]] = r
    fct = {r["shipment_id"]: r for r in read("fct_shipment")}
    assert set(fct) == set(last)
    lanes = defaultdict(lambda: dict.fromkeys(("n", "done", "on_time", "late", "bad", "cost", "miles", "events", "first"), 0) | {"delivered": set(), "tried": set()})
    for key, (_, carrier, _, to, picked, promised, arrived, cost, miles, updated) in last.items():
        late = max(0.0, (arrived - promised).total_seconds() / 60) if arrived else None
        r = fct[key]
        assert (r["delay_minutes"], r["region_code"], r["p_date"], r["shipping_cost_usd"]) == (late, regions.get(to, "UNKNOWN"), picked.date(), cost)
        lane = lanes[picked.date(), regions.get(to, "UNKNOWN"), carrier]
        for name, value in (("n", 1), ("done", arrived is not None), ("on_time", late == 0), ("late", bool(late)), ("bad", arrived is None and updated > promised), ("cost", cost), ("miles", miles)):
            lane[name] += value
    for event, ship, kind, at, _, state, _, attempt, _ in events:
        of = last.get(ship)
        region = regions.get(state) or (regions.get(of[3]) if of else None) or "UNKNOWN"
        lane = lanes.get((at.date(), region, of[1] if of else "UNKNOWN"))
        if lane:
            lane["events"] += 1
            lane["delivered"] |= {ship} if kind == "DELIVERED" else set()
            lane["tried"] |= {ship} if kind == "DELIVERED" and attempt == 1 else set()
    ratio = lambda a, b: a / b if b > 0 else 0.0
    kpis = {(r["p_date"], r["region_code"], r["carrier_id"]): r for r in read("kpi_delivery_daily")}
    assert set(kpis) == set(lanes)
    for key, v in lanes.items():
        done = max(v["done"], len(v["delivered"]))
        want = (ratio(v["on_time"], done), ratio(v["late"], done), ratio(len(v["tried"]), done), ratio(v["bad"], v["n"]), ratio(v["cost"], v["miles"]), v["n"], ratio(v["events"], v["n"]))
        got = tuple(kpis[key][c] for c in ("on_time_delivery_rate", "late_delivery_rate", "first_attempt_success_rate", "exception_rate", "avg_cost_per_mile", "volume_by_carrier", "delivery_event_density"))
        assert got == pytest.approx(want), key


def test_api_names_resolve():
    from lanewise import api

    assert {"run_daily_batch", "run_quality_rules", "build_kpi_delivery_daily", "read_shipments_raw", "write_partitioned_table"} <= set(api.__all__)
    assert all(callable(getattr(api, n)) for n in api.__all__)
