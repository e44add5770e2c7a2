"""Fixed table schemas. TIME columns are integer seconds of day."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _B, _D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()
_DATE, _TS = T.DateType(), T.TimestampNTZType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


EVENT_SCHEMA = _schema(
    ("event_id", _L), ("event_name", _S), ("dance_style", _S), ("description", _S), ("day_of_week", _S),
    ("start_date", _DATE), ("end_date", _DATE), ("start_sec", _I), ("end_sec", _I), ("source", _S),
    ("location", _S), ("price", _S), ("url", _S), ("event_type", _S), ("address_id", _L), ("time_stamp", _TS),
)
EVENT_HISTORY_SCHEMA = T.StructType(EVENT_SCHEMA.fields + [T.StructField("original_event_id", _L, True)])
ADDRESS_SCHEMA = _schema(
    ("address_id", _L), ("full_address", _S), ("building_name", _S), ("street_number", _S), ("street_name", _S),
    ("street_type", _S), ("direction", _S), ("city", _S), ("met_area", _S), ("province_or_state", _S),
    ("postal_code", _S), ("country_id", _S), ("time_stamp", _TS),
)
RAW_LOCATION_SCHEMA = _schema(("raw_location", _S), ("address_id", _L), ("created_at", _TS))
CRAWL_LOG_SCHEMA = _schema(
    ("link", _S), ("parent_url", _S), ("source", _S), ("keywords", _S), ("relevant", _B), ("crawl_try", _I),
    ("time_stamp", _TS), ("decision_reason", _S),
)
SEED_SCHEMA = _schema(("source", _S), ("keywords", _S), ("link", _S))
DELETE_AUDIT_SCHEMA = T.StructType([
    T.StructField("deleted_at_utc", _S), T.StructField("deletion_source", _S), T.StructField("deletion_reason", _S),
    T.StructField("extra_context", T.MapType(_S, _S)),
    T.StructField("event", T.StructType([T.StructField(f.name, _S if f.dataType in (_DATE, _TS) else f.dataType) for f in EVENT_SCHEMA.fields])),
    T.StructField("corrupt", _S),
])
