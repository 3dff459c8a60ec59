import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.operators import duplicates, drift, nulls, rules


@pytest.fixture
def frame(spark):
    rows = [("a", "X", 1.0, 1, 2), ("a", "Y", 1.0, 1, 2), ("b", "Z", -1.0, 3, 2), ("c", None, 1.0, 1, None), (None, "X", 1.0, 1, 1), (" ", "X", 1.0, 1, 1)]
    return spark.createDataFrame(rows, "k string, mode string, cost double, t0 int, t1 int")


def context(df, **more):
    return {"df": df, "required_columns": ["k"], "duplicate_keys": ["k"], "allowed_values": {"mode": ["X", "Y"]}, "non_negative_columns": ["cost"], "timestamp_order_rules": [{"start_column": "t0", "end_column": "t1", "allow_null_end": False}], "primary_key": ["k"], **more}


def test_run_counts_like_single_rules(frame, tmp_path, spark):
    out = rules.run_quality_rules(context(frame, entity="things", quarantine_path=str(tmp_path)))
    assert [(r["rule_name"], r["failed_count"]) for r in out["rule_results"]] == [("required_nulls", 2), ("duplicate_keys", 2), ("allowed_values:mode", 1), ("non_negative:cost", 1), ("timestamp_order:t0->t1", 2)]
    assert out["status"] == "FAIL" and out["invalid_count"] == 8 == out["invalid_df"].count()
    assert [r["k"] for r in out["clean_df"].collect()] == [None]
    singles = {"allowed_values:mode": rules.validate_allowed_values(frame, "mode", ["X", "Y"]), "non_negative:cost": rules.validate_non_negative(frame, "cost"), "timestamp_order:t0->t1": rules.validate_timestamp_order(frame, "t0", "t1", allow_null_end=False)}
    for r in out["rule_results"]:
        if r["rule_name"] in singles:
            assert singles[r["rule_name"]].count() == r["failed_count"]
        assert spark.read.parquet(f"{tmp_path}/things/{r['rule_name']}").count() == r["failed_count"]
    reasons = {r[0] for r in out["invalid_df"].select(rules.REASON).collect()}
    assert {"invalid_allowed_value:mode:Z", "negative_value:cost:-1.0", "duplicate_key:k", "k", "invalid_timestamp_order:t0->t1"} == reasons


def test_noop_pass_and_fail_fast(frame):
    assert rules.run_quality_rules({"df": None})["status"] == "NOOP"
    good = frame.filter("k = 'c'").drop("t1")
    out = rules.run_quality_rules(context(good, schema_expected=good.schema))
    assert out["status"] == "PASS" and out["invalid_df"].count() == 0 and out["clean_df"].count() == 1
    with pytest.raises(ValueError, match="required_nulls"):
        rules.run_quality_rules(context(frame, fail_fast=True))
    with pytest.raises(ValueError, match="drift"):
        rules.run_quality_rules(context(frame, fail_fast=True, schema_expected={"x": "int"}))


def test_missing_columns_break_nothing(frame):
    assert rules.validate_allowed_values(frame, "no", [1]).count() == 0
    assert rules.validate_non_negative(frame, "no").count() == 0
    assert rules.validate_timestamp_order(frame, "no", "t1").count() == 0
    assert rules.validate_allowed_values(frame, "mode", ["X", "Y", "Z"], allow_null=False).count() == 0


def test_nulls(frame):
    assert nulls.check_required_nulls(frame, ["k", "mode", "no"]) == {"k": 2, "mode": 1, "no": 6}
    assert nulls.check_required_nulls(None, ["k"]) == {"k": 0}
    valid, invalid = nulls.split_by_required_nulls(frame, ["k", "mode"])
    assert (valid.count(), invalid.count()) == (3, 3)
    profile = {r["column_name"]: (r["null_count"], r["null_rate"]) for r in nulls.null_profile(frame, ["k", "no"]).collect()}
    assert profile == {"k": (2, 2 / 6), "no": (6, 1.0)}
    assert [r["null_rate"] for r in nulls.null_profile(frame.limit(0), ["k"]).collect()] == [0.0]
    assert nulls.critical_columns_for_entity("carrier") == ["carrier_id", "carrier_name", "service_mode", "updated_at"]
    assert nulls.critical_columns_for_entity("x") == []


def test_duplicates(spark, frame):
    assert [tuple(r) for r in duplicates.find_duplicate_keys(frame, ["k"]).collect()] == [("a", 2)]
    assert duplicates.find_duplicate_keys(frame.unionAll(frame.filter("k is null")), ["k"]).count() == 2
    assert duplicates.duplicate_records(frame, ["k"]).count() == 2
    assert duplicates.find_duplicate_keys(None, ["k"]) is None
    assert duplicates.key_columns_for_entity("shipment") == ["shipment_id"]
    for keys in ([], ["no"]):
        with pytest.raises(ValueError):
            duplicates.find_duplicate_keys(frame, keys)
    first, rest = duplicates.split_by_duplicates(frame, ["k"], ["mode"])
    assert [r["mode"] for r in rest.collect()] == ["X"] and first.count() == 5


def test_drift():
    expected = {"columns": [{"name": "a", "type": "int"}, {"name": "b"}, {"name": "c", "type": "float", "nullable": False}]}
    assert not drift.has_schema_drift({"a": "integer", "b": "varchar", "c": {"type": "double", "nullable": False}}, expected)
    actual = T.StructType([T.StructField("c", T.DoubleType()), T.StructField("a", T.LongType()), T.StructField("d", T.StringType())])
    assert drift.detect_schema_drift(actual, expected, enforce_column_order=True) == ["missing_column:b", "unexpected_column:d", "type_mismatch:a:expected=integer:actual=long", "nullability_mismatch:c:expected=False:actual=True", "column_order_mismatch"]
    assert drift.normalize_schema(None) == [] and drift.normalize_schema([{"name": "x"}])[0]["type"] == "string"
    with pytest.raises(TypeError):
        drift.normalize_schema(3)
    with pytest.raises(ValueError):
        drift.detect_df_schema_drift(None, expected)
