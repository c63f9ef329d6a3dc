"""What a feed promises: names, types, business key and validity rules."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    """A named validity rule: a SQL predicate that is true for a bad row; null is not bad."""

    name: str
    bad_when: str


@dataclass(frozen=True)
class FeedContract:
    """columns: target name to Spark type, in order. renames: source name to target (matched without case)."""

    columns: dict[str, str]
    renames: dict[str, str]
    key: list[str]
    start: str
    end: str
    rules: list[Rule] = field(default_factory=list)
    lineage: tuple[str, str] = ("_source_file", "_ingested_at")


# The trip feed's names and types, its business key and its validity limits, and below them the columns of
# the fact and the trusted table, which readers of these tables rely on.
TRIP_COLUMNS = {
    "vendor_id": "int", "pickup_ts": "timestamp_ntz", "dropoff_ts": "timestamp_ntz", "passenger_count": "int", "trip_distance": "double",
    "rate_code_id": "int", "store_and_fwd_flag": "string", "pickup_zone_id": "int", "dropoff_zone_id": "int", "payment_type_id": "int",
    "fare_amount": "double", "extra": "double", "mta_tax": "double", "tip_amount": "double", "tolls_amount": "double",
    "improvement_surcharge": "double", "total_amount": "double", "congestion_surcharge": "double", "airport_fee": "double",
}
TRIP_RENAMES = {
    "VendorID": "vendor_id", "tpep_pickup_datetime": "pickup_ts", "tpep_dropoff_datetime": "dropoff_ts", "RatecodeID": "rate_code_id",
    "PULocationID": "pickup_zone_id", "DOLocationID": "dropoff_zone_id", "payment_type": "payment_type_id", "Airport_fee": "airport_fee",
}
TRIP_KEY = ["vendor_id", "pickup_ts", "dropoff_ts", "pickup_zone_id", "dropoff_zone_id", "total_amount"]
TRIP_RULES = [
    Rule("null_pickup_ts", "pickup_ts IS NULL"),
    Rule("null_dropoff_ts", "dropoff_ts IS NULL"),
    Rule("dropoff_before_pickup", "dropoff_ts < pickup_ts"),
    Rule("trip_longer_than_24h", "{seconds} > 86400"),
    Rule("invalid_trip_distance", "trip_distance < 0 OR trip_distance > 500"),
    Rule("non_positive_total_amount", "total_amount <= 0"),
    Rule("invalid_passenger_count", "passenger_count < 0 OR passenger_count > 8"),
    Rule("null_zone_id", "pickup_zone_id IS NULL OR dropoff_zone_id IS NULL"),
]
FACT_COLUMNS = [
    "trip_hash", "date_key", "pickup_ts", "dropoff_ts", "vendor_id", "rate_code_id", "payment_type_id", "pickup_zone_id", "dropoff_zone_id",
    "passenger_count", "trip_distance", "trip_minutes", "avg_speed_mph", "fare_amount", "tip_amount", "tip_pct", "tolls_amount",
    "congestion_surcharge", "airport_fee", "total_amount",
]
SILVER_COLUMNS = [*TRIP_COLUMNS, "pickup_date", "pickup_hour", "trip_minutes", "avg_speed_mph", "tip_pct", "trip_hash", "_source_file", "_ingested_at"]
TRIPS = FeedContract(TRIP_COLUMNS, TRIP_RENAMES, TRIP_KEY, "pickup_ts", "dropoff_ts", TRIP_RULES)
