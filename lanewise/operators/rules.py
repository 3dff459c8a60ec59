"""Dataset rules. All row rules are counted in one pass; invalid rows are built only for rules that fail."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.columns import flag
from lanewise.sources.files import join_path, write_quarantine

from . import nulls
from .drift import detect_schema_drift
from .duplicates import duplicate_records, find_duplicate_keys, key_columns_for_entity

LOGGER = logging.getLogger(__name__)
NAME, REASON = "__rule_name", "__rule_reason"


@dataclass(frozen=True)
class RuleResult:
    rule_name: str
    failed_count: int
    status: str


@dataclass(frozen=True)
class RowRule:
    """Rows for which ``broken`` is true break the rule; null is not true."""

    name: str
    broken: Column
    reason: Column

    def invalid(self, df: DataFrame) -> DataFrame:
        return df.filter(self.broken).withColumns({NAME: F.lit(self.name), REASON: self.reason})


def _absent(name: str, columns: Sequence[str]) -> RowRule:
    return RowRule(name, F.lit(False), F.lit(f"missing_column:{','.join(columns)}"))


def allowed_values_rule(df: DataFrame, column: str, allowed: Sequence[Any], allow_null: bool = True) -> RowRule:
    """A null breaks nothing, allowed or not: a comparison with it is unknown."""
    name = f"allowed_values:{column}"
    if column not in df.columns:
        return _absent(name, [column])
    value = F.col(column).cast("string")
    broken = ~value.isin(*map(str, allowed))
    return RowRule(name, broken & value.isNotNull() if allow_null else broken, F.concat(F.lit(f"invalid_allowed_value:{column}:"), value))


def non_negative_rule(df: DataFrame, column: str) -> RowRule:
    name = f"non_negative:{column}"
    if column not in df.columns:
        return _absent(name, [column])
    return RowRule(name, F.col(column) < 0, F.concat(F.lit(f"negative_value:{column}:"), F.col(column).cast("string")))


def timestamp_order_rule(df: DataFrame, start: str, end: str, allow_equal: bool = True, allow_null_end: bool = True) -> RowRule:
    name = f"timestamp_order:{start}->{end}"
    if missing := [c for c in (start, end) if c not in df.columns]:
        return _absent(name, missing)
    a, b = F.col(start), F.col(end)
    broken = b < a if allow_equal else b <= a
    if not allow_null_end:
        broken = broken | (a.isNotNull() & b.isNull())
    return RowRule(name, broken, F.lit(f"invalid_timestamp_order:{start}->{end}"))


def validate_allowed_values(df: DataFrame, column: str, allowed_values: Sequence[Any], allow_null: bool = True) -> DataFrame:
    return allowed_values_rule(df, column, allowed_values, allow_null).invalid(df)


def validate_non_negative(df: DataFrame, column: str) -> DataFrame:
    return non_negative_rule(df, column).invalid(df)


def validate_timestamp_order(df: DataFrame, start_column: str, end_column: str, allow_equal: bool = True, allow_null_end: bool = True) -> DataFrame:
    return timestamp_order_rule(df, start_column, end_column, allow_equal, allow_null_end).invalid(df)


def quarantine_bad_records(invalid_df: DataFrame, quarantine_base_path: str, entity: str, rule_name: str, mode: str = "append", quarantined_at: str | None = None) -> str:
    at = F.lit(quarantined_at).cast("timestamp") if quarantined_at else F.current_timestamp()
    return write_quarantine(invalid_df.withColumn("quarantined_at", at), join_path(quarantine_base_path, entity, rule_name), mode=mode)


def _rules(df: DataFrame, context: Mapping[str, Any], entity: str) -> tuple[list[RowRule], list[str]]:
    """Row rules in order, and the keys of the duplicate rule."""
    required = context.get("required_columns")
    required = [str(c) for c in required] if isinstance(required, list) else nulls.critical_columns_for_entity(entity)
    keys = context.get("duplicate_keys")
    keys = [str(k) for k in keys] if isinstance(keys, list) else key_columns_for_entity(entity)
    rules = []
    if required:
        failed = nulls._failed(df, required)
        rules.append(RowRule("required_nulls", F.size(failed) > 0, F.concat_ws(",", failed)))
    rules += [allowed_values_rule(df, str(c), v) for c, v in (context.get("allowed_values") or {}).items() if isinstance(v, list)]
    rules += [non_negative_rule(df, str(c)) for c in context.get("non_negative_columns") or ()]
    for r in context.get("timestamp_order_rules") or ():
        if isinstance(r, Mapping) and r.get("start_column") and r.get("end_column"):
            rules.append(timestamp_order_rule(df, str(r["start_column"]), str(r["end_column"]), bool(r.get("allow_equal", True)), bool(r.get("allow_null_end", True))))
    return rules, keys


def rule_counts(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """One row, one column for each rule: the rows that break it."""
    return df.agg(*(F.coalesce(F.sum(flag(r.broken)), F.lit(0)).cast("bigint").alias(r.name) for r in rules))


def run_quality_rules(context: Mapping[str, Any]) -> dict[str, Any]:
    """Check ``context["df"]``; returns status, failed_rules, rule_results, invalid_count, clean_df and invalid_df.

    Rules in order: schema_drift, required_nulls, duplicate_keys, allowed_values, non_negative, timestamp_order. Counts come from
    one aggregate over the rows and one over the keys. A row that breaks two rules counts twice. The clean frame
    lacks every row whose primary key has an invalid row, so all copies of a duplicate key. With fail_fast the first failing rule raises.
    """
    df = context.get("df")
    if df is None:
        return {"status": "NOOP", "failed_rules": [], "rule_results": [], "invalid_count": 0, "clean_df": None, "invalid_df": None}
    entity = str(context.get("entity", "dataset")).strip().lower()
    log = context.get("logger") or LOGGER
    fail_fast = bool(context.get("fail_fast", False))
    results: list[RuleResult] = []

    def note(name: str, count: int, detail: Any = "") -> None:
        results.append(RuleResult(name, count, "FAIL" if count else "PASS"))
        if count:
            log.warning("Quality rule failed: %s (rows=%s) %s", name, count, detail)

    if context.get("schema_expected") is not None:
        findings = detect_schema_drift(df.schema, context["schema_expected"])
        note("schema_drift", len(findings), findings)
        if findings and fail_fast:
            raise ValueError(f"Schema drift detected: {findings}")

    rules, keys = _rules(df, context, entity)
    counted = rule_counts(df, rules).first() if rules else None
    frames = {r.name: (int(counted[i]), r) for i, r in enumerate(rules)}
    if keys:
        same = find_duplicate_keys(df, keys).dropna(subset=keys).agg(F.sum("duplicate_count")).first()[0]
        frames["duplicate_keys"] = int(same or 0), None
    order = sorted(frames, key=lambda n: (n != "required_nulls", n != "duplicate_keys"))  # stable: the rest as given

    invalid: list[DataFrame] = []
    total = 0
    for name in order:
        count, rule = frames[name]
        note(name, count)
        if not count:
            continue
        if rule is None:
            bad = duplicate_records(df, keys).withColumns({NAME: F.lit(name), REASON: F.lit(f"duplicate_key:{','.join(keys)}")})
        elif name == "required_nulls":
            bad = rule.invalid(df).withColumn(nulls.FAILED, F.split(REASON, ","))
        else:
            bad = rule.invalid(df)
        total += count
        invalid.append(bad)
        if context.get("quarantine_path"):
            quarantine_bad_records(bad, str(context["quarantine_path"]), entity, name)
        if fail_fast:
            raise ValueError(f"Quality rule failed: {name} (rows={count})")

    merged = df.limit(0).withColumns({NAME: F.lit(None).cast("string"), REASON: F.lit(None).cast("string")})
    for i, frame in enumerate(invalid):
        merged = frame if i == 0 else merged.unionByName(frame, allowMissingColumns=True)
    clean, key = df, context.get("primary_key")
    if invalid and isinstance(key, list) and all(k in df.columns for k in key):
        clean = df.join(merged.select(*key).dropna().distinct(), key, "left_anti")
    failed = [r.rule_name for r in results if r.failed_count]
    return {"status": "FAIL" if failed else "PASS", "failed_rules": failed, "rule_results": [asdict(r) for r in results], "invalid_count": total, "clean_df": clean, "invalid_df": merged}
