"""Entity contracts: columns, types and checks of the source files."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import types as T

from lanewise.functions.columns import DEFAULT_TIMESTAMP_FORMAT

#: Contract type to Spark type; float is widened.
KINDS = {"string": "string", "double": "double", "float": "double", "int": "int", "integer": "int", "long": "bigint", "bigint": "bigint", "boolean": "boolean", "bool": "boolean", "timestamp": "timestamp"}
CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str = "string"
    nullable: bool = True
    case: str | None = None  # upper or lower
    length: int | None = None
    min: float | None = None
    max: float | None = None
    allowed: tuple[str, ...] | None = None

    @property
    def kind(self) -> str:
        try:
            return KINDS[self.type.strip().lower()]
        except KeyError:
            raise ValueError(f"Unsupported contract type: {self.type}") from None


@dataclass(frozen=True)
class Contract:
    entity: str
    primary_key: tuple[str, ...]
    columns: tuple[ColumnSpec, ...]
    required: tuple[str, ...] | None = None
    options: Mapping[str, Any] = field(default_factory=dict)
    checks_range: bool = True

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def required_columns(self) -> list[str]:
        return list(self.required) if self.required is not None else [c.name for c in self.columns if not c.nullable]

    @property
    def timestamp_formats(self) -> list[str]:
        many = self.options.get("timestamp_formats")
        if isinstance(many, (list, tuple)) and many:
            return [str(f) for f in many]
        return [str(self.options.get("timestamp_format") or DEFAULT_TIMESTAMP_FORMAT)]

    def raw_schema(self) -> T.StructType:
        """All strings, as a CSV holds them, and the place for rows that don't parse."""
        return T.StructType([T.StructField(n, T.StringType()) for n in (*self.names, CORRUPT)])

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, T._parse_datatype_string(c.kind), c.nullable) for c in self.columns])

    def definition(self) -> dict[str, Any]:
        """The contract as a JSON-like mapping."""
        columns = []
        for c in self.columns:
            one: dict[str, Any] = {"name": c.name, "type": c.type, "nullable": c.nullable}
            if c.case:
                one[f"{c.case}case"] = True
            one |= {k: v for k, v in (("length", c.length), ("min", c.min), ("max", c.max)) if v is not None}
            if c.allowed is not None:
                one["allowed_values"] = list(c.allowed)
            columns.append(one)
        return {"entity": self.entity, "primary_key": list(self.primary_key), "required_columns": self.required_columns, "options": dict(self.options), "columns": columns}


def from_definition(definition: Mapping[str, Any], checks_range: bool = True) -> Contract:
    if not isinstance(definition.get("columns"), list):
        raise ValueError("A contract needs a 'columns' list")
    columns = tuple(
        ColumnSpec(
            name=str(c["name"]),
            type=str(c.get("type", "string")),
            nullable=bool(c.get("nullable", True)),
            case="upper" if c.get("uppercase") else "lower" if c.get("lowercase") else None,
            length=c.get("length"),
            min=c.get("min"),
            max=c.get("max"),
            allowed=tuple(map(str, c["allowed_values"])) if isinstance(c.get("allowed_values"), list) else None,
        )
        for c in definition["columns"]
    )
    required = definition.get("required_columns")
    return Contract(str(definition.get("entity", "dataset")), tuple(definition.get("primary_key") or ()), columns, tuple(required) if isinstance(required, list) else None, definition.get("options") or {}, checks_range)


def load_contract(path: str | Path) -> Contract:
    """Read a contract file (JSON, with or without a byte-order mark)."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"Contract file not found: {path}")
    return from_definition(json.loads(path.read_text(encoding="utf-8-sig")))


_CSV = {"header": "true", "delimiter": ",", "quote": '"', "escape": "\\", "mode": "PERMISSIVE", "timestamp_formats": [DEFAULT_TIMESTAMP_FORMAT, "yyyy-MM-dd HH:mm:ss"]}


def _id(name: str, **more) -> ColumnSpec:
    return ColumnSpec(name, nullable=False, case="upper", **more)


def _time(name: str, nullable: bool = False) -> ColumnSpec:
    return ColumnSpec(name, "timestamp", nullable)


# Statuses that a tracking event may have, and service modes of a carrier.
EVENT_TYPES = ("PICKED_UP", "IN_TRANSIT", "OUT_FOR_DELIVERY", "DELIVERY_ATTEMPT", "DELIVERED", "DELAYED", "EXCEPTION", "HOLD")
SERVICE_MODES = ("FTL", "LTL", "PARCEL")

SHIPMENTS = Contract(
    "shipments",
    ("shipment_id",),
    (
        *map(_id, ("shipment_id", "carrier_id")),
        *(_id(n, length=2) for n in ("origin_state", "destination_state")),
        *map(_time, ("pickup_ts", "promised_delivery_ts")),
        _time("actual_delivery_ts", True),
        *(ColumnSpec(n, "double", min=0) for n in ("shipping_cost_usd", "distance_miles")),
        _time("updated_at"),
    ),
    options=_CSV,
)
CARRIERS = Contract(
    "carriers",
    ("carrier_id",),
    (
        _id("carrier_id"),
        ColumnSpec("carrier_name", nullable=False),
        ColumnSpec("scac", case="upper", length=4),
        _id("service_mode", allowed=SERVICE_MODES),
        ColumnSpec("home_region_code", case="upper"),
        ColumnSpec("is_active", "boolean"),
        _time("updated_at"),
    ),
    options=_CSV,
    checks_range=False,
)
DELIVERY_EVENTS = Contract(
    "delivery_events",
    ("event_id",),
    (
        *map(_id, ("event_id", "shipment_id")),
        _id("event_type", allowed=EVENT_TYPES),
        _time("event_ts"),
        ColumnSpec("event_city"),
        ColumnSpec("event_state", case="upper", length=2),
        ColumnSpec("delay_reason", case="upper"),
        ColumnSpec("attempt_number", "int", min=1),
        _time("updated_at"),
    ),
    options=_CSV,
)
CONTRACTS = {c.entity: c for c in (SHIPMENTS, CARRIERS, DELIVERY_EVENTS)}


def contract_for(entity: str) -> Contract | None:
    """By entity name, singular or plural."""
    name = entity.strip().lower()
    return CONTRACTS.get(name if name.endswith("s") else f"{name}s")


def load_shipments_schema_definition(path: str | Path | None = None) -> dict[str, Any]:
    return (load_contract(path) if path else SHIPMENTS).definition()


def load_carriers_schema_definition(path: str | Path | None = None) -> dict[str, Any]:
    return (load_contract(path) if path else CARRIERS).definition()


def load_delivery_events_schema_definition(path: str | Path | None = None) -> dict[str, Any]:
    return (load_contract(path) if path else DELIVERY_EVENTS).definition()
