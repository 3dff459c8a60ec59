"""Schema drift between what came and what was expected."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Other names of types.
ALIASES = {"str": "string", "varchar": "string", "char": "string", "int": "integer", "bigint": "long", "float": "double", "bool": "boolean", "timestamp_ntz": "timestamp"}


class Column(NamedTuple):
    name: str
    type: str
    nullable: bool


def _column(name: Any, kind: Any = "string", nullable: Any = True) -> Column:
    word = str(kind).strip().lower()
    return Column(str(name).strip(), ALIASES.get(word, word), bool(nullable))


def _columns(schema: Any) -> list[Column]:
    if isinstance(schema, (str, Path)) and Path(schema).suffix.lower() == ".json" and Path(schema).exists():
        schema = json.loads(Path(schema).read_text(encoding="utf-8-sig"))
    if schema is None:
        return []
    if isinstance(schema, T.StructType):
        return [_column(f.name, f.dataType.simpleString(), f.nullable) for f in schema]
    if isinstance(schema, Mapping) and "columns" not in schema:
        pairs = ((n, v if isinstance(v, Mapping) else {"type": v}) for n, v in schema.items())
        return [_column(n, v.get("type", "string"), v.get("nullable", True)) for n, v in pairs]
    listed = schema["columns"] if isinstance(schema, Mapping) else schema
    if isinstance(schema, Mapping) and not isinstance(listed, list):
        raise ValueError("A schema definition needs a 'columns' list")
    if isinstance(listed, Sequence) and not isinstance(listed, (str, bytes, bytearray)):
        return [_column(c["name"], c.get("type", "string"), c.get("nullable", True)) for c in listed if isinstance(c, Mapping)]
    raise TypeError(f"Unsupported schema: {type(schema)}")


def normalize_schema(schema: Any) -> list[dict[str, Any]]:
    """{name, type, nullable} of each column of a struct type, a definition, a mapping, a list or a JSON file."""
    return [c._asdict() for c in _columns(schema)]


def detect_schema_drift(actual_schema: Any, expected_schema: Any, enforce_column_order: bool = False) -> list[str]:
    """Findings: columns missing, unexpected, of another type or nullability; then, if asked, another order."""
    actual, expected = ({c.name: c for c in _columns(s)} for s in (actual_schema, expected_schema))
    findings = [f"missing_column:{n}" for n in expected if n not in actual]
    findings += [f"unexpected_column:{n}" for n in actual if n not in expected]
    shared = [n for n in expected if n in actual]
    for n in shared:
        a, e = actual[n], expected[n]
        if a.type != e.type:
            findings.append(f"type_mismatch:{n}:expected={e.type}:actual={a.type}")
        if a.nullable != e.nullable:
            findings.append(f"nullability_mismatch:{n}:expected={e.nullable}:actual={a.nullable}")
    if enforce_column_order and shared != [n for n in actual if n in expected]:
        findings.append("column_order_mismatch")
    return findings


def has_schema_drift(actual_schema: Any, expected_schema: Any, enforce_column_order: bool = False) -> bool:
    return bool(detect_schema_drift(actual_schema, expected_schema, enforce_column_order))


def detect_df_schema_drift(df: DataFrame, expected_schema: Any, enforce_column_order: bool = False) -> list[str]:
    if not hasattr(df, "schema"):
        raise ValueError("A DataFrame is needed")
    return detect_schema_drift(df.schema, expected_schema, enforce_column_order)
