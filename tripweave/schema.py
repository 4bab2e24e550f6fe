"""Declared schemas: raw messages, their JSON payload, labels and stored points."""

from pyspark.sql import types as T

_S, _D, _L, _I, _B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()
_AS = T.ArrayType(T.StringType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# Field names of a location message as the phones send it.
PAYLOAD = _struct(
    ("_type", _S), ("lat", _D), ("lon", _D), ("tst", _L), ("tid", _S), ("acc", _I), ("alt", _I),
    ("batt", _I), ("bs", _I), ("cog", _I), ("vel", _I), ("vac", _I), ("m", _I), ("rad", _I),
    ("p", _D), ("conn", _S), ("SSID", _S), ("BSSID", _S), ("t", _S), ("poi", _S), ("tag", _S),
    ("topic", _S), ("created_at", _L), ("inregions", _AS), ("inrids", _AS), ("motionactivities", _AS),
    ("received_at", _S), ("_receiver_user", _S), ("_receiver_device", _S),
)

_RAW_FIELDS = (
    ("id", _L), ("received_at", T.TimestampType()), ("msg_type", _S), ("user", _S), ("device", _S), ("payload", _S),
)
RAW = _struct(*_RAW_FIELDS)
# as stored: partitioned by the received date
RAW_STORED = _struct(*_RAW_FIELDS, ("received_date", T.DateType()))

LEDGER = _struct(("id", _L), ("synced_at", T.TimestampType()), ("received_at", T.TimestampType()))

LABELS = _struct(
    ("user", _S), ("device", _S), ("commute_id", _S), ("segment_id", _L), ("original_mode", _S),
    ("corrected_mode", _S), ("notes", _S), ("labeled_at", T.TimestampType()),
)

POINTS = _struct(
    ("user", _S), ("device", _S), ("record_id", _L), ("tst", _L), ("lat", _D), ("lon", _D),
    ("timestamp", T.TimestampType()), ("timezone", _S), ("timestamp_local", T.TimestampNTZType()),
    ("distance_m", _D), ("time_delta_s", _D), ("speed_kmh", _D), ("is_stationary", _B),
    ("at_home", _B), ("at_work", _B), ("commute_id", _S), ("commute_direction", _S),
    ("predicted_mode", _S), ("transport_mode", _S), ("segment_id", _L),
    ("local_date", T.DateType()), ("entity_bucket", _I),
)
