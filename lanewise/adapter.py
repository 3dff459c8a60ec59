"""Shipments, carriers, tracking events and a region look-up derived from the star-schema tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.sources.contracts import CARRIERS, DELIVERY_EVENTS, SHIPMENTS, Contract
from lanewise.sources.ingest import VALID, Ingested, checked, read_raw, validate

RUN_DATE = "2024-01-31"
DAY = 86_400_000_000  # microseconds


class Source:
    """The derived frames of one folder of tables. Time stamps are read as UTC."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """A table, its times without a zone read as UTC by the scan, so that no row needs a conversion."""
        path = f"{self.dir}/{name}.parquet"
        found = self.spark.read.parquet(path)
        if all(f.dataType != T.TimestampNTZType() for f in found.schema):
            return found
        zoned = T.StructType([T.StructField(f.name, T.TimestampType() if f.dataType == T.TimestampNTZType() else f.dataType, f.nullable) for f in found.schema])
        return self.spark.read.schema(zoned).parquet(path)

    @staticmethod
    def _state(nation_key: str) -> Column:
        return F.concat(F.char(F.lit(65) + F.col(nation_key)), F.lit("X"))

    def lookup(self) -> DataFrame:
        joined = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(self._state("n_nationkey").alias("state_code"), F.col("r_name").alias("region_code"))

    def _orders(self) -> DataFrame:
        return self.table("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("ordered"), "o_orderpriority")

    def _customers(self) -> DataFrame:
        return self.table("customer").select("c_custkey", self._state("c_nationkey").alias("destination_state"))

    def shipments(self) -> DataFrame:
        """A line item is a shipment; the rows of an order's line number are its states."""
        suppliers = self.table("supplier").select("s_suppkey", self._state("s_nationkey").alias("origin_state"))
        days = 14 * F.substring("o_orderpriority", 1, 1).cast("int")
        shipped = F.col("l_shipdate").cast("timestamp")
        # Each table is joined by itself: the size of a join is a guess, that of a table is known, so the smaller side is.
        joined = self.table("lineitem").join(self._orders(), F.col("l_orderkey") == F.col("o_orderkey")).join(self._customers(), F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        return joined.select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("shipment_id"),
            F.concat(F.lit("CAR"), F.col("l_suppkey").cast("string")).alias("carrier_id"),
            "origin_state",
            "destination_state",
            F.col("ordered").alias("pickup_ts"),
            F.timestamp_micros(F.unix_micros("ordered") + days.cast("bigint") * DAY).alias("promised_delivery_ts"),
            F.when(F.col("l_linestatus") == "F", shipped).alias("actual_delivery_ts"),
            F.col("l_extendedprice").alias("shipping_cost_usd"),
            F.col("l_quantity").alias("distance_miles"),
            shipped.alias("updated_at"),
        )

    def carriers(self) -> DataFrame:
        joined = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        key = F.col("s_suppkey")
        return joined.select(
            F.concat(F.lit("CAR"), key.cast("string")).alias("carrier_id"),
            F.col("s_name").alias("carrier_name"),
            F.concat(F.lit("S"), F.lpad((key % 1000).cast("string"), 3, "0")).alias("scac"),
            F.when(key % 3 == 0, "FTL").when(key % 3 == 1, "LTL").otherwise("PARCEL").alias("service_mode"),
            F.when(key % 10 != 0, F.col("r_name")).alias("home_region_code"),
            (F.col("s_acctbal") > 0).alias("is_active"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"),
        )

    def events(self) -> DataFrame:
        """An event belongs to the first line of the order of its number, a tenth of its time after the order."""
        at = F.col("ts").cast("timestamp")
        since = F.floor((F.unix_timestamp(at) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 10)
        kind = F.col("event_type")
        ordered = self._orders().join(self._customers(), F.col("o_custkey") == F.col("c_custkey"))
        joined = self.table("events").join(ordered, F.col("event_id") == F.col("o_orderkey"), "left")
        event_ts = F.timestamp_micros(F.unix_micros("ordered") + since.cast("bigint") * 1_000_000)
        reason = F.when(kind == "error", F.concat(F.lit("K"), F.get_json_object("props", "$.k")))
        return joined.select(
            F.concat(F.lit("EVT"), F.col("event_id").cast("string")).alias("event_id"),
            F.concat(F.col("event_id").cast("string"), F.lit("-1")).alias("shipment_id"),
            F.when(kind == "click", "DELIVERY_ATTEMPT").when(kind == "view", "IN_TRANSIT").when(kind == "purchase", "DELIVERED").when(kind == "signup", "PICKED_UP").when(kind == "error", "EXCEPTION").alias("event_type"),
            event_ts.alias("event_ts"),
            F.lit(None).cast("string").alias("event_city"),
            F.when(F.col("user_id") % 7 != 0, F.col("destination_state")).alias("event_state"),
            reason.alias("delay_reason"),
            (F.col("user_id") % 3).cast("int").alias("attempt_number"),
            event_ts.alias("updated_at"),
        )

    def checked(self, contract: Contract, frame: DataFrame) -> DataFrame:
        # The tables are typed: a value that is there was read well, so it stands for its own text.
        shadows = {f"__raw_{c.name}": F.col(c.name) for c in contract.columns if c.kind != "string"}
        return checked(frame.withColumns(shadows), contract)

    def valid(self, contract: Contract, frame: DataFrame) -> DataFrame:
        return self.checked(contract, frame).filter(VALID).select(*contract.names)

    def valid_shipments(self) -> DataFrame:
        return self.valid(SHIPMENTS, self.shipments())

    def valid_carriers(self) -> DataFrame:
        return self.valid(CARRIERS, self.carriers())

    def valid_events(self) -> DataFrame:
        return self.valid(DELIVERY_EVENTS, self.events())

    # Source files as they come: text lines with planted faults, to be ingested by contract.

    def shipment_lines(self) -> DataFrame:
        """A CSV line for each line item. The order number modulo 20 tells its fault, if any."""
        k = F.col("l_orderkey") % 20
        at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        ordered, shipped = F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp")
        promised = F.timestamp_micros(F.unix_micros(ordered) + 10 * DAY)
        origin = F.concat(F.char(F.lit(65) + F.col("l_suppkey") % 26), F.lit("X"))
        fields = [
            F.concat(F.when(k == 12, "  ").otherwise(""), F.lit("s"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.when(k == 12, " ").otherwise("")),
            F.when(k == 0, "  ").otherwise(F.concat(F.lit("c"), F.col("l_suppkey").cast("string"))),
            F.when(k == 1, "abc").when(k == 10, F.concat(F.lit('"'), origin, F.lit('"'))).otherwise(F.lower(origin)),
            F.concat(F.char(F.lit(65) + F.col("l_orderkey") % 26), F.lit("X")),
            at(ordered),
            F.when(k == 4, "never").when(k == 7, F.date_format(promised, "yyyy-MM-dd HH:mm:ss")).when(k == 8, at(F.timestamp_micros(F.unix_micros(ordered) - DAY))).when(k == 13, "").otherwise(at(promised)),
            F.when(F.col("l_linestatus") == "F", at(shipped)).otherwise(""),
            F.when(k == 2, "-1.5").otherwise(F.col("l_extendedprice").cast("string")),
            F.when(k == 3, "x").when(k == 15, "").otherwise(F.col("l_quantity").cast("string")),
            F.when(k == 9, "").otherwise(at(shipped)),
        ]
        line = F.when(k == 5, F.concat_ws(",", *fields[:3])).when(k == 6, F.concat_ws(",", *fields, F.lit("more"))).otherwise(F.concat_ws(",", *fields))
        return self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(line.alias("value"))

    def event_lines(self) -> DataFrame:
        """A CSV line for each event. Its number modulo 20 tells its fault, if any."""
        k, kind, ts = F.col("event_id") % 20, F.col("event_type"), F.col("ts").cast("timestamp")
        at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        known = F.when(kind == "click", "delivery_attempt").when(kind == "view", "IN_TRANSIT").when(kind == "purchase", "Delivered").when(kind == "signup", "PICKED_UP").when(kind == "error", " exception ").otherwise("HOLD")
        line = F.concat_ws(
            ",",
            F.concat(F.lit("e"), F.col("event_id").cast("string")),
            F.concat(F.lit("s"), F.col("user_id").cast("string")),
            F.when(k == 0, "TELEPORTED").when(k == 1, "").otherwise(known),
            F.when(k == 2, "31/12/2024").otherwise(at(ts)),
            F.when(k == 3, '"New, York"').otherwise("  "),
            F.when(k == 4, "TXX").otherwise("tx"),
            F.when(k % 2 == 1, "weather").otherwise(""),
            F.when(k == 6, "0").when(k == 7, "").when(k == 8, "2.9").when(k == 9, "one").otherwise((F.col("user_id") % 3 + 1).cast("string")),
            F.when(k == 10, at(F.timestamp_micros(F.unix_micros(ts) - DAY))).otherwise(at(ts)),
        )
        return self.table("events").select(line.alias("value"))

    def carrier_lines(self) -> DataFrame:
        """A CSV line for each supplier. Its number modulo 10 tells its fault, if any."""
        k = F.col("s_suppkey") % 10
        words = F.element_at(F.array(*(F.lit(w) for w in ("Yes", "n", "TRUE", "0", "perhaps"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
        line = F.concat_ws(
            ",",
            F.concat(F.lit("c"), F.col("s_suppkey").cast("string")),
            F.when(k == 1, "").otherwise(F.col("s_name")),
            F.when(k == 2, "toolong").otherwise("abcd"),
            F.when(k == 3, "air").otherwise("ltl"),
            F.lit("west"),
            words,
            F.lit("2024-01-01 00:00:00"),
        )
        return self.table("supplier").select(line.alias("value"))

    def ingested(self, contract: Contract, lines: DataFrame) -> Ingested:
        """``lines`` written to text files without a header in a fresh folder of the warehouse, and read back by contract."""
        at = f"{self.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lines-{uuid.uuid4().hex}"
        lines.write.text(at)
        return validate(read_raw(self.spark, contract, at, {"header": "false"}), contract)
