"""Column layout of the state tables, the raw feed and the exports."""

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _table(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


RAW_NOTIFICATIONS = _table(
    ("plc_name", _S, False), ("node_id", _S, False), ("source_ts", _TS, True),
    ("received_ts", _TS, False), ("status_code", _L, False), ("data_type", _S, True),
    ("v_bool", _B, True), ("v_num", _D, True), ("v_text", _S, True), ("seq", _L, False),
)
READINGS = _table(
    ("id", _L, False), ("tag_id", _I, False), ("ts_utc", _L, False), ("ts_received_utc", _L, True),
    ("value", _D, True), ("value_text", _S, True), ("quality", _I, False),
)
TAGS = _table(
    ("tag_id", _I, False), ("plc_id", _I, False), ("node_id", _S, False), ("tag_name", _S, False),
    ("data_type", _S, False), ("units", _S, True), ("deadband_override", _D, True),
    ("first_seen_at", _S, False), ("last_seen_at", _S, False), ("active", _I, False),
    ("enabled", _I, False),
)
PLCS = _table(
    ("plc_id", _I, False), ("name", _S, False), ("endpoint_url", _S, False),
    ("security_policy", _S, False),
)
PARTITIONS = _table(
    ("partition_start", _L, False), ("partition_hours", _I, False), ("file_name", _S, False),
    ("row_count", _L, False), ("max_reading_id", _L, False), ("exported_at", _S, False),
    ("uploaded_at", _S, True), ("local_deleted", _I, False),
)
EXPORT_STATE = _table(
    ("plc_id", _I, False), ("file_name", _S, False), ("file_path", _S, False),
    ("last_reading_id", _L, False), ("row_count", _L, False), ("exported_at", _S, True),
    ("uploaded_reading_id", _L, False), ("uploaded_at", _S, True), ("status", _S, False),
)
SETTINGS = _table(("key", _S, False), ("value", _S, False))
EXPORTED_PARQUET = _table(
    ("ts_utc", _L, False), ("ts_received_utc", _L, True), ("plc_name", _S, False),
    ("tag_name", _S, False), ("value", _D, True), ("value_text", _S, True), ("quality", _I, False),
)
EXPORTED_CSV = _table(
    ("timestamp_utc", _S, True), ("plc_name", _S, True), ("tag_name", _S, True),
    ("value", _S, True), ("quality", _S, True),
)
ADDRESS_EDGES = _table(
    ("plc_name", _S, False), ("parent", _S, False), ("child", _S, False), ("node_class", _S, False),
    ("display_name", _S, True), ("browse_name", _S, True),
)
CONNECTION_EVENTS = _table(
    ("seq", _L, False), ("plc_name", _S, False), ("kind", _S, False), ("endpoint_url", _S, True),
    ("error", _S, True), ("at", _TS, False),
)
# What a stream has to know of a node; ``version`` orders the changes of one node.
SELECTION = _table(
    ("plc_name", _S, False), ("node_id", _S, False), ("tag_id", _I, False), ("live", _B, False),
    ("deadband_override", _D, True), ("version", _L, False),
)
UPLOAD_OUTCOMES = _table(("file_name", _S, False), ("outcome", _S, False), ("at", _S, True))

_PLC_ENTRY = _table(("Name", _S, True), ("EndpointUrl", _S, True), ("SecurityPolicy", _S, True))
_SCHEDULE = _table(
    ("Mode", _S, True), ("IntervalMinutes", _I, True), ("DailyAtLocalTime", _S, True),
    ("DayOfWeek", _I, True), ("DayOfMonth", _I, True), ("PartitionHours", _I, True),
    ("KeepUploadedPartitions", _B, True),
)
_DRIVE = _table(("CredentialsPath", _S, True), ("TokenStorePath", _S, True))
_UPLOAD = _table(("Provider", _S, True), ("DestinationFolder", _S, True), ("GoogleDrive", _DRIVE, True))

# One document per site; ``site`` tells the documents of a fleet apart.
SITE_DOCUMENT = _table(
    ("site", _L, True), ("SiteName", _S, True), ("Schedule", _SCHEDULE, True),
    ("RetentionDays", _I, True), ("Plcs", T.ArrayType(_PLC_ENTRY), True), ("Upload", _UPLOAD, True),
)
